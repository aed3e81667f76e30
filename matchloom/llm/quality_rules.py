"""Weakly supervised quality rules: rules vote or abstain, expectation-maximisation weighs them.

Every rule looks at a signal of its own and votes good (1), bad (0) or abstains (-1, between its two thresholds); no rule
is made of others.  The only thing gathered on the driver is the number of documents per vote pattern (at most 3 ** rules
rows, whatever the corpus holds).  Documents are good or of one kind of bad per rule (noise has many forms, which break
different rules).  EM over the patterns estimates how often each rule votes bad on good documents (its false alarms) and
on each kind of bad ones; the posterior of a document is a column expression of the votes.  A vote does not decide by
itself: a rule that stands alone against the others is overruled if its alarms are not borne out by theirs.
DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import scratch

#: White space between words.
GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Characters that are rare in prose.
MARKS = "#*$%&|<>!?{}[]()\\^~=_+/@"
#: What ends or parts sentences.
STOPS = ".,;:。、"
#: Repeated windows of a text up to which their positions are looked up one by one.
FEW = 32
#: A document is kept if the posterior probability of good quality is at least this.
KEEP = 0.5
GOOD, BAD, ABSTAIN = 1, 0, -1
#: Beliefs before any document is seen: how often a rule votes bad on good documents, on the kind of bad documents that is
#: its own, and on the others; the share of good documents; how many votes and documents these beliefs weigh.
ALARM, HIT, ELSE, PRIOR, WEIGHT = 0.05, 0.9, 0.1, 0.8, 10.0
#: Bounds of all estimates; a rule is never believed to accuse more than MOST_ALARM of good documents, so that classes cannot trade places.
LEAST, MOST, MOST_ALARM = 0.001, 0.98, 0.3


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id with the counts that contract and rules use.  A null text counts as an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        F.filter(F.split("text", GAP), lambda x: x != "").alias("w"),
        F.filter(F.split("text", "\n"), lambda x: F.regexp_replace(x, GAP, "") != "").alias("lines"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", "\\p{Lu}", ""))).cast("long").alias("n_upper"),
        (F.length("text") - F.length(F.translate("text", "!?", ""))).cast("long").alias("n_bangs"),
        (F.length("text") - F.length(F.translate("text", MARKS, ""))).cast("long").alias("n_marks"),
        (F.length("text") - F.length(F.translate("text", STOPS, ""))).cast("long").alias("n_stops"),
        (F.length("text") - F.length(F.translate("text", "0123456789", ""))).cast("long").alias("n_digits"),
    )
    n, one = F.size("w"), F.lit(1)
    base = base.select("*", n.cast("long").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    pairs = F.zip_with("h", F.slice("h", 2, F.greatest(n, one)), lambda a, b: F.xxhash64(a, b))
    base = base.withColumn("pairs", pairs).drop("w")
    m = F.size("h")
    grams = F.slice(F.zip_with("pairs", F.slice("h", 3, F.greatest(m, one)), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(m - 2, F.lit(0)))
    base = base.withColumn("g", grams).drop("pairs", "h")
    # equal windows stand side by side once sorted: first their hashes alone, which few texts repeat
    base = base.withColumn("sorted", F.sort_array("g"))
    again = F.zip_with("sorted", F.slice("sorted", 2, F.greatest(F.size("sorted"), one)), lambda a, b: F.when(a == b, a))
    base = base.withColumn("again", F.array_distinct(F.array_compact(again))).drop("sorted")
    few = F.size("again") <= FEW
    at = F.filter(F.transform("g", lambda h, i: F.when(F.array_contains("again", h), i)), lambda i: i.isNotNull())
    # many repeated windows: positions sorted with their hashes, so that the work stays n log n
    base = base.withColumn("s", F.when(~few, F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    size = F.greatest(F.size("s"), one)
    neighbours = F.arrays_zip(F.col("s").alias("s"), F.concat(F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).alias("i"))), F.slice("s", 1, size)).alias("prev"), F.slice("s", 2, size).alias("next"))
    twice = F.filter(neighbours, lambda x: F.coalesce(x["s"]["h"] == x["prev"]["h"], F.lit(False)) | F.coalesce(x["s"]["h"] == x["next"]["h"], F.lit(False)))
    starts = F.when(F.size("again") == 0, F.array().cast("array<int>")).when(few, at).otherwise(F.transform(twice, lambda x: x["s"]["i"]))
    base = base.withColumn("starts", starts)
    covered = F.size(F.array_distinct(F.flatten(F.transform("starts", lambda i: F.array(i, i + 1, i + 2)))))
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_upper", "n_bangs", "n_marks", "n_stops", "n_digits",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), F.col("n_distinct").cast("long").alias("n_distinct"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """name -> vote.  Without words only the length rule speaks."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    few = F.col("n_words") < 2000
    signals = {  # what the rule looks at, good below or within, bad above or outside
        "symbols": (F.col("n_symbols") / n, lambda x: x < 0.02, lambda x: x > 0.25),
        "marks": (F.col("n_marks") / chars, lambda x: x < 0.02, lambda x: x > 0.1),
        "case": (F.col("n_upper") / chars, lambda x: x < 0.1, lambda x: x > 0.3),
        "bangs": (F.col("n_bangs") / n, lambda x: x < 0.05, lambda x: x > 0.4),
        "repeats": (F.col("n_repeat_words") / n, lambda x: x < 0.1, lambda x: x > 0.4),
        "variety": (F.col("n_distinct") / n, lambda x: (x > 0.3) | ~few & (x > 0.1), lambda x: (x < 0.02) | few & (x < 0.15)),
        "dup_lines": (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), lambda x: x < 0.1, lambda x: x > 0.4),
        "word_length": (chars / n, lambda x: x.between(3, 9), lambda x: (x < 2) | (x > 14)),
        "stops": (F.col("n_stops") / n, lambda x: x.between(0.03, 0.3), lambda x: (x < 0.01) | (x > 1)),
        "digits": (F.col("n_digits") / chars, lambda x: x < 0.05, lambda x: x > 0.3),
    }
    length = {"length": _vote(F.col("n_words") >= 80, F.col("n_words") < 30)}
    return length | {k: F.when(F.col("n_words") == 0, ABSTAIN).otherwise(_vote(good(x), bad(x))) for k, (x, good, bad) in signals.items()}


@dataclass(frozen=True)
class Model:
    """Class 0 is good, class r + 1 the kind of bad documents of rule r: shares, and chances of a bad vote by rule."""

    share: tuple[float, ...]
    bad: tuple[tuple[float, ...], ...]

    @staticmethod
    def before(rules: int) -> Model:
        kinds = [tuple(HIT if i == r else ELSE for i in range(rules)) for r in range(rules)]
        return Model((PRIOR, *[(1 - PRIOR) / max(1, rules)] * rules), ((ALARM,) * rules, *kinds))

    def classes(self, votes: tuple[int, ...]) -> list[float]:
        """Probability of each class of a document with these votes; abstentions say nothing."""
        logs = [math.log(s) + sum(math.log(p if v == BAD else 1 - p) for p, v in zip(ps, votes) if v != ABSTAIN) for s, ps in zip(self.share, self.bad)]
        top = max(logs)
        found = [math.exp(x - top) for x in logs]
        return [x / sum(found) for x in found]

    def posterior(self, votes: list[Column]) -> Column:
        """Probability that a document is good, as a column."""
        logs = [F.lit(math.log(s)) for s in self.share]
        for i, v in enumerate(votes):
            logs = [x + F.when(v == BAD, math.log(ps[i])).when(v == GOOD, math.log(1 - ps[i])).otherwise(0.0) for x, ps in zip(logs, self.bad)]
        return F.aggregate(F.array(*logs[1:]), F.struct(logs[0].alias("good"), F.lit(1.0).alias("all")), lambda a, x: F.struct(a["good"].alias("good"), (a["all"] + F.exp(x - a["good"])).alias("all")), lambda a: 1 / a["all"])


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 40) -> Model:
    """The model that EM finds for counts of vote patterns, from Model.before."""
    first = model = Model.before(rules)
    total = sum(k for _, k in patterns)
    for _ in range(rounds if total else 0):
        size = [WEIGHT * s for s in first.share]
        accused = [[WEIGHT * p for p in ps] for ps in first.bad]
        voted = [[WEIGHT] * rules for _ in first.bad]
        for votes, k in patterns:
            for c, q in enumerate(model.classes(votes)):
                size[c] += k * q
                for r, v in enumerate(votes):
                    if v != ABSTAIN:
                        voted[c][r] += k * q
                        accused[c][r] += k * q if v == BAD else 0.0
        bad = [tuple(min(MOST_ALARM if c == 0 else MOST, max(LEAST, a / n)) for a, n in zip(accused[c], voted[c])) for c in range(rules + 1)]
        model = Model(tuple(x / (total + WEIGHT) for x in size), tuple(bad))
    return model


def judge(docs: DataFrame) -> DataFrame:
    """Statistics, votes (v_<rule>), posterior, base_failed and kept for every row of docs(doc_id, text).

    Empty and null texts have base_failed true.  Repeated rows are judged alike; an empty table gives no rows.  A
    posterior of exactly KEEP (ties) keeps.  Columns other than doc_id and text are ignored, whatever their names.  A
    text's words and windows are arrays of one row: about 100 bytes a word.
    """
    stats = scratch.checkpoint(statistics(docs))
    names = list(rules())
    voted = stats.withColumns({f"v_{k}": v for k, v in rules().items()})
    cols = [f"v_{k}" for k in names]
    patterns = [(tuple(r[c] for c in cols), r["count"]) for r in voted.groupBy(*cols).count().collect()]
    model = expectation_maximisation(sorted(patterns), len(cols))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("posterior", model.posterior([F.col(c) for c in cols])).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))
