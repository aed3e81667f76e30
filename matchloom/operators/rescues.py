"""Second routes for targets that are not linked: digit drops, clear addresses, blank and cut-off addresses, namesakes, learned tokens."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from matchloom.functions.similarity import ratio
from matchloom.operators import blocking, evaluate, learn, rules

# Legal words that a transform of a name may drop, state codes that end a cut-off address.
TRANSFORM_LEGAL = "sarl sas sa eurl ei sci snc ltd llc inc corp pvt private limited llp lp pllc pc plc co company corporation incorporated l c p".split()
STATES = "MH KA DL TN UP GJ RJ WB TS TG AP KL HR PB MP OD BR CG JH UK HP GA AS".split()


def first_number(address: Column) -> Column:
    """First house number without leading zeros (empty: none); digits joined by a hyphen, slash or space are one number."""
    joined = F.regexp_replace(address, "(?<=[0-9])[-/ ](?=[0-9])", "")
    return F.ltrim(F.regexp_extract(joined, "([0-9]+)", 1), F.lit("0"))


def digit_drop_pairs(targets: DataFrame, anchors: DataFrame) -> DataFrame:
    """tid, aid: the only anchor of the target's name, whose house number is part of the target's or holds it.

    Records: id, country, core, address, legal.  A legal form of the target must be the anchor's; blank names never match.
    """
    t, a = targets.where("core <> ''"), anchors.select(F.col("id").alias("aid"), F.col("address").alias("a_address"), F.col("legal").alias("a_legal"))
    x = rules.unique_key_pairs(t, anchors, "country", "core").join(t.select(F.col("id").alias("tid"), "address", "legal"), "tid").join(a, "aid")
    x = x.withColumns({"n": first_number(F.col("address")), "m": first_number(F.col("a_address"))})
    part = F.col("n").contains(F.col("m")) | F.col("m").contains(F.col("n"))
    return x.where((F.col("n") != "") & (F.col("m") != "") & (F.col("n") != F.col("m")) & part & ((F.col("legal") == "") | (F.col("legal") == F.col("a_legal")))).select("tid", "aid")


def residue(fired: DataFrame, links: DataFrame, truth: DataFrame) -> DataFrame:
    """scope, n, precision, linked: a rule's pairs, all and those on unlinked targets, and the share that is linked so already."""
    x = fired.select("tid", "aid").join(truth.select("tid", "aid", F.lit(1.0).alias("ok")), ["tid", "aid"], "left").join(links.select("tid", F.col("aid").alias("now")), "tid", "left")
    x = x.withColumns({"ok": F.coalesce("ok", F.lit(0.0)), "there": F.coalesce((F.col("now") == F.col("aid")).cast("double"), F.lit(0.0))})
    scopes = F.when(F.col("now").isNull(), F.array(F.lit("all"), F.lit("unlinked"))).otherwise(F.array(F.lit("all")))
    return x.withColumn("scope", F.explode(scopes)).groupBy("scope").agg(F.count("*").alias("n"), F.avg("ok").alias("precision"), F.avg("there").alias("linked"))


def clear_best(blocked: DataFrame) -> DataFrame:
    """tid, aid, sim, gap: each target's best blocked pair (tid, aid, sim) and its lead over the second."""
    per = Window.partitionBy("tid").orderBy(F.desc("sim"), "aid")
    x = blocked.select("tid", "aid", "sim", F.row_number().over(per).alias("r"), F.lead("sim", 1, 0.0).over(per).alias("second"))
    return x.where("r = 1").select("tid", "aid", "sim", (F.col("sim") - F.col("second")).alias("gap"))


def clear_best_grid(blocked: DataFrame, links: DataFrame, truth: DataFrame, anchors: DataFrame, sims: list[float], gaps: list[float]) -> DataFrame:
    """sim, gap, fires, precision, macro_f05: unlinked targets go to their clear best, for every setting, in one plan.

    Per anchor and setting only counts travel: what is linked already is counted once and the additions are put on top.
    """
    table = F.array(*(F.struct(F.lit(float(s)).alias("sim"), F.lit(float(g)).alias("gap")) for s, g in itertools.product(sims, gaps)))
    true = truth.select("tid", "aid").distinct().withColumn("t", F.lit(1))
    free = clear_best(blocked).join(links.select("tid"), "tid", "left_anti").join(true, ["tid", "aid"], "left").withColumn("o", F.explode(table))
    fired = free.where((F.col("sim") >= F.col("o.sim")) & (F.col("gap") >= F.col("o.gap"))).groupBy("o", "aid").agg(F.count("*").alias("more"), F.count("t").alias("hits"))
    base = evaluate.per_anchor(anchors.select("aid"), links, truth).select("aid", "pred", "truth", "tp").withColumn("o", F.explode(table))
    x = base.join(fired, ["o", "aid"], "left").na.fill(0, ["more", "hits"])
    score = evaluate.f05(F.col("pred") + F.col("more"), F.col("truth"), F.col("tp") + F.col("hits"))
    return x.groupBy("o").agg(F.sum("more").alias("fires"), ratio(F.sum("hits"), F.sum("more")).alias("precision"), F.avg(score).alias("macro_f05")).select("o.sim", "o.gap", "fires", "precision", "macro_f05")


def made_up_features(blocked: DataFrame, decisions: DataFrame, links: DataFrame, scores: DataFrame) -> DataFrame:
    """Eleven columns of address-only pairs(tid, aid, sim): similarity, scorer's score (scores: tid, aid, score), and what is decided."""
    per = Window.partitionBy("tid")
    by_sim = per.orderBy(F.desc("sim"), "aid")
    x = blocked.select("tid", "aid", "sim").join(scores.select("tid", "aid", F.col("score").alias("ce")), ["tid", "aid"], "left").na.fill(0.0, ["ce"])
    x = x.withColumns({"rank": F.row_number().over(by_sim) - 1, "best": F.max("sim").over(per), "ce_gap": F.max("ce").over(per) - F.col("ce"), "ce_rank": F.row_number().over(per.orderBy(F.desc("ce"), "aid")) - 1, "ce_sum": F.sum("ce").over(per)})
    x = x.withColumn("second", F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("sim"))).over(per), F.lit(0.0)))
    load = links.groupBy("aid").agg(F.count("*").alias("load"))
    x = x.join(decisions.select("tid", F.col("aid").alias("top"), "q"), "tid", "left").join(load, "aid", "left")
    return x.select(
        "tid", "aid", "sim", "rank", (F.col("best") - F.col("sim")).alias("sim_gap"), (F.col("best") - F.col("second")).alias("lead"), "ce", "ce_gap", "ce_rank", "ce_sum",
        F.coalesce("q", F.lit(0.0)).alias("q"), F.coalesce((F.col("top") == F.col("aid")).cast("int"), F.lit(0)).alias("same_as_top"), F.coalesce("load", F.lit(0)).alias("load"),
    )


def core_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*TRANSFORM_LEGAL))


def word_drop_features(words: Column, a_words: Column, a_name: Column, idf: Column) -> dict[str, Column]:
    """Seventeen columns about the words of an anchor's name that a target's name lacks (word lists in order; idf: a map column)."""
    core, a_core = core_words(words), core_words(a_words)
    legal = lambda ws: F.filter(ws, lambda w: w.isin(*TRANSFORM_LEGAL))
    n = F.size(a_core)
    kept = F.transform(a_core, lambda w: F.array_contains(core, w))
    places = F.filter(F.transform(kept, lambda k, i: F.when(k, i)), lambda i: i.isNotNull())
    gone = F.filter(F.transform(kept, lambda k, i: F.when(~k, i)), lambda i: i.isNotNull())
    weights = F.transform(F.filter(a_core, lambda w: ~F.array_contains(core, w)), lambda w: F.coalesce(F.try_element_at(idf, w), F.lit(0.0)))
    run = (F.size(places) > 0) & (F.array_max(places) - F.array_min(places) + 1 == F.size(places))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "dropped": F.size(gone).cast("double"), "a_words": n.cast("double"), "first_gone": yes(F.array_contains(gone, 0)), "last_gone": yes(F.array_contains(gone, n - 1)),
        "inner_gone": yes(F.exists(gone, lambda i: (i > 0) & (i < n - 1))), "idf_sum": F.aggregate(weights, F.lit(0.0), lambda s, v: s + v),
        "idf_max": F.coalesce(F.array_max(weights), F.lit(0.0)), "idf_min": F.coalesce(F.array_min(weights), F.lit(0.0)), "run": yes(run), "prefix": yes(run & (F.array_min(places) == 0)),
        "in_order": yes(F.filter(a_core, lambda w: F.array_contains(core, w)) == F.filter(core, lambda w: F.array_contains(a_core, w))),
        "legal": yes(F.size(legal(words)) > 0), "a_legal": yes(F.size(legal(a_words)) > 0), "same_legal": yes(legal(words) == legal(a_words)),
        "shared_legal": yes(F.arrays_overlap(legal(words), legal(a_words))), "a_all_words": F.size(a_words).cast("double"), "a_length": F.length(a_name).cast("double"),
    }


def unsure(targets: DataFrame, decisions: DataFrame, links: DataFrame, least: float = 0.5) -> DataFrame:
    """Targets (id, ...) that are not linked with probability ``least`` or more."""
    sure = links.select("tid", "aid").join(decisions.where(F.col("q") >= least).select("tid", "aid"), ["tid", "aid"], "left_semi")
    return targets.join(sure.select(F.col("tid").alias("id")), "id", "left_anti")


def blank_blocks(targets: DataFrame, anchors: DataFrame, k: int = 5, max_df: float = 0.005) -> DataFrame:
    """tid, aid, sim for targets without an address: best names by tf-idf of character trigrams within words, so that typos matter little.

    Records: id, country, core (words joined by spaces), address.
    """
    grams = lambda df: df.withColumn("tokens", F.flatten(F.transform(F.filter(F.split("core", " "), lambda w: w != ""), _word_grams)))
    return blocking.tfidf_top_k(grams(targets.where("address = '' AND core <> ''")), grams(anchors), k, max_df)


def _word_grams(word: Column) -> Column:
    """Trigrams of one word with a space on both sides."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))


def cut_off(raw_address: Column) -> Column:
    """Whether a raw address ends with a state code after a comma."""
    return raw_address.rlike(",\\s*(?:" + "|".join(STATES) + ")\\s*$")


def cut_off_blocks(targets: DataFrame, anchors: DataFrame, first: int = 30, keep: int = 5, most: int = 20_000) -> DataFrame:
    """tid, aid, sim, overlap, n_cand: anchors with a common rare house number, the ``first`` by name, of these the best with shared address words.

    Records: id, country, numbers, grams (of the name's skeleton), address_words.
    """
    x = rules.number_blocks(targets, anchors, most).select("tid", "aid")
    x = x.join(targets.select(F.col("id").alias("tid"), F.col("grams").alias("q"), F.col("address_words").alias("qa")), "tid").join(anchors.select(F.col("id").alias("aid"), F.col("grams").alias("a"), F.col("address_words").alias("aa")), "aid")
    x = x.withColumn("sim", F.round(ratio(F.size(F.array_intersect("q", "a")), F.sqrt(F.size("q") * F.size("a"))), 9))
    per = Window.partitionBy("tid")
    x = x.withColumns({"n_cand": F.count("*").over(per), "near": F.row_number().over(per.orderBy(F.desc("sim"), "aid"))}).where(F.col("near") <= first)
    x = x.withColumn("overlap", F.size(F.array_intersect("qa", "aa")))
    best = F.row_number().over(per.orderBy(F.desc(F.round(F.col("sim") + 0.02 * F.col("overlap"), 9)), "aid"))
    return x.withColumn("r", best).where(F.col("r") <= keep).select("tid", "aid", "sim", "overlap", "n_cand")


def namesake_hints(missed: DataFrame, anchors: DataFrame, links: DataFrame, truth: DataFrame) -> DataFrame:
    """hint, n, hit: how often a simple choice among anchors of one name (aid, core, number) is the owner of missed targets (tid, aid).

    A choice that several namesakes share counts by its share.
    """
    counted = lambda df, c: df.groupBy("aid").agg(F.count("*").alias(c))
    x = anchors.select("aid", "core", "number").join(counted(links, "linked"), "aid", "left").join(counted(truth, "true"), "aid", "left").na.fill(0, ["linked", "true"])
    by = {"first row": ("aid", F.min), "last row": ("aid", F.max), "smallest id": ("number", F.min), "largest id": ("number", F.max), "fewest linked": ("linked", F.min), "most linked": ("linked", F.max), "most true": ("true", F.max)}
    keys = sorted({c for c, _ in by.values()})
    stats = x.groupBy("core").agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c, f in sorted({v for v in by.values()}, key=str))).where("n > 1")
    tied = x.join(stats, "core").groupBy("core").agg(*(F.sum((F.col(c) == F.col(f"{f.__name__}_{c}")).cast("int")).alias(f"ties_{f.__name__}_{c}") for c, f in by.values()))
    own = missed.select("tid", "aid").join(x.select("aid", "core", *(k for k in keys if k != "aid")), "aid").join(stats, "core").join(tied, "core")
    hit = [F.struct(F.lit(h).alias("hint"), F.when(F.col(c) == F.col(f"{f.__name__}_{c}"), 1 / F.col(f"ties_{f.__name__}_{c}")).otherwise(0.0).alias("hit")) for h, (c, f) in by.items()]
    hit.append(F.struct(F.lit("random").alias("hint"), (1 / F.col("n")).alias("hit")))
    return own.select(F.explode(F.array(*hit)).alias("h")).groupBy("h.hint").agg(F.count("*").alias("n"), F.avg("h.hit").alias("hit"))


def errors_by_flag(targets: DataFrame, flags: dict[str, Column], links: DataFrame, truth: DataFrame) -> DataFrame:
    """flag, true, missed, missed_share, false of targets (tid, ...) on which a flag holds: which operations cost links."""
    own, now = truth.select("tid", F.col("aid").alias("own")), links.select("tid", F.col("aid").alias("now"))
    x = targets.join(own, "tid", "left").join(now, "tid", "left")
    x = x.withColumns({"owned": F.col("own").isNotNull(), "lost": F.col("own").isNotNull() & ~F.col("own").eqNullSafe(F.col("now")), "wrong": F.col("now").isNotNull() & ~F.col("own").eqNullSafe(F.col("now"))})
    held = F.filter(F.array(*(F.when(F.coalesce(c.cast("boolean"), F.lit(False)), F.lit(k)) for k, c in flags.items())), lambda f: f.isNotNull())
    count = lambda c: F.sum(F.col(c).cast("long"))
    g = x.withColumn("flag", F.explode(held)).groupBy("flag").agg(count("owned").alias("true"), count("lost").alias("missed"), count("wrong").alias("false"))
    return g.withColumn("missed_share", ratio(F.col("missed"), F.greatest("true", F.lit(1))))


def joint_rows(real: DataFrame, pseudo: DataFrame, sizes: DataFrame, weight: float = 0.5) -> DataFrame:
    """tid, aid, label, weight: labelled pairs (tid, aid, label, rank) and pseudo-labelled ones under one sampling rule.

    Labelled rows weigh one over the root of their anchor's number of links (sizes: aid, truth), the others ``weight``.
    """
    kept = lambda df: df.where(learn.sampled(F.col("label"), F.col("rank"), F.col("tid"), F.col("aid")))
    own = kept(real).join(sizes.select("aid", "truth"), "aid", "left").withColumn("weight", 1 / F.sqrt(F.greatest(F.coalesce("truth", F.lit(1)), F.lit(1))))
    return own.select("tid", "aid", "label", "weight").unionByName(kept(pseudo).select("tid", "aid", "label", F.lit(weight).alias("weight")))


def dispositions(aliases: DataFrame, unsafe: list[str]) -> DataFrame:
    """field, source, target, decision, reason, cycle of learned aliases (field, source, target): none is approved, each has its reason."""
    back = aliases.select("field", F.col("source").alias("target"), F.col("target").alias("source"), F.lit(1).alias("cycle"))
    x = aliases.select("field", "source", "target").join(back, ["field", "source", "target"], "left").na.fill(0, ["cycle"])
    reason = F.when(F.col("cycle") == 1, "cycle").when((F.col("field") == "address") & F.col("source").isin(*unsafe), "unsafe").otherwise("unproven")
    return x.select("field", "source", "target", F.lit("QUARANTINE").alias("decision"), reason.alias("reason"), "cycle")


# learned tokens


def skeleton(word: str) -> str:
    """A word with single letters for runs of one letter, and without vowels after its first letter."""
    once = "".join(c for c, _ in itertools.groupby(word))
    return once[:1] + "".join(c for c in once[1:] if c not in "aeiouy")


def token_similarity(a: str, b: str) -> float:
    """Letters that two skeletons share over the longer one's, and 0.3 for one first letter."""
    x, y = skeleton(a), skeleton(b)
    if not x or not y:
        return 0.0
    shared = sum(min(x.count(c), y.count(c)) for c in set(x))
    return shared / max(len(x), len(y)) + 0.3 * (x[0] == y[0])


def aligned(left: list[str], right: list[str], least: float = 0.5, longest: int = 8) -> list[tuple[str, str]]:
    """Pairs of words in the order-preserving alignment of the highest total similarity; lists of over ``longest`` words have none.

    Of equal totals, skipping a word of the left list is preferred to skipping one of the right, and both to matching nothing.
    """
    if not left or not right or max(len(left), len(right)) > longest:
        return []
    best: dict[tuple[int, int], tuple[float, list[tuple[str, str]]]] = {}
    for i, j in itertools.product(range(len(left) + 1), range(len(right) + 1)):
        if not i or not j:
            best[i, j] = (0.0, [])
            continue
        s = token_similarity(left[i - 1], right[j - 1])
        total, found = best[i - 1, j - 1]
        match = (total + s, found + ([(left[i - 1], right[j - 1])] if s >= least else []))
        best[i, j] = max(best[i - 1, j], best[i, j - 1], match, key=lambda x: x[0])
    return best[len(left), len(right)][1]


@F.pandas_udf(ArrayType(StructType([StructField("source", StringType()), StructField("target", StringType())])))
def _aligned(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([[{"source": a, "target": b} for a, b in aligned((x or "").split(), (y or "").split())] for x, y in zip(left, right)])


def learned_tokens(pairs: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """source, target, n: the usual translation of a word over labelled names (core, a_core), seen ``least`` times with ``share`` of its uses."""
    x = pairs.select(F.explode(_aligned(F.col("core"), F.col("a_core"))).alias("p")).select("p.*").where("source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))
    per = Window.partitionBy("source")
    x = x.withColumns({"r": F.row_number().over(per.orderBy(F.desc("n"), "target")), "all": F.sum("n").over(per)})
    return x.where((F.col("r") == 1) & (F.col("n") >= least) & (F.col("n") >= share * F.col("all"))).select("source", "target", "n")
