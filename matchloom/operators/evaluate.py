"""Exact macro F0.5 per anchor, comparisons, error budgets, slices and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.similarity import ratio


def f05(pred: Column, truth: Column, tp: Column) -> Column:
    return F.when((pred == 0) & (truth == 0), 1.0).otherwise(ratio(1.25 * tp, pred + 0.25 * truth))


def per_anchor(anchors: DataFrame, links: DataFrame, truth: DataFrame) -> DataFrame:
    """aid (and other anchor columns), pred, truth, tp, f of every anchor; links and truth: tid, aid."""
    both = links.select("tid", "aid").distinct().withColumn("l", F.lit(1)).join(truth.select("tid", "aid").distinct().withColumn("t", F.lit(1)), ["tid", "aid"], "full")
    sums = both.groupBy("aid").agg(F.coalesce(F.sum("l"), F.lit(0)).alias("pred"), F.coalesce(F.sum("t"), F.lit(0)).alias("truth"), F.sum(F.when(F.col("l").isNotNull() & F.col("t").isNotNull(), 1).otherwise(0)).alias("tp"))
    x = anchors.join(sums, "aid", "left").na.fill(0, ["pred", "truth", "tp"])
    return x.withColumn("f", f05(F.col("pred"), F.col("truth"), F.col("tp")))


def summary(scored: DataFrame, *by: str) -> DataFrame:
    """anchors, macro_f05, precision, recall, links and false links of anchors without truth."""
    return scored.groupBy(*by).agg(
        F.count("*").alias("anchors"), F.avg("f").alias("macro_f05"), ratio(F.sum("tp"), F.sum("pred")).alias("precision"),
        ratio(F.sum("tp"), F.sum("truth")).alias("recall"), F.sum("pred").alias("links"), F.sum(F.when(F.col("truth") == 0, F.col("pred")).otherwise(0)).alias("singleton_false"),
    )


def macro(anchors: DataFrame, links: DataFrame, truth: DataFrame) -> DataFrame:
    return summary(per_anchor(anchors, links, truth))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean difference b - a of per-anchor f, its standard error, better and worse anchors, verdict at two errors."""
    d = a.select("aid", F.col("f").alias("fa")).join(b.select("aid", F.col("f").alias("fb")), "aid").withColumn("d", F.col("fb") - F.col("fa"))
    x = d.agg(F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"), F.sum((F.col("d") > 0).cast("int")).alias("better"), F.sum((F.col("d") < 0).cast("int")).alias("worse"))
    return x.withColumn("verdict", F.when(F.col("mean") > 2 * F.col("se"), "better").when(F.col("mean") < -2 * F.col("se"), "worse").otherwise("same"))


def error_budget(anchors: DataFrame, links: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """cause, n: why true links are absent (never a candidate, another anchor won, rejected) and what false links are."""
    lost = truth.select("tid", "aid").join(links.select("tid", "aid"), ["tid", "aid"], "left_anti")
    seen = lost.join(candidates.select("tid", "aid", F.lit(1).alias("c")).distinct(), ["tid", "aid"], "left").join(links.select("tid", F.lit(1).alias("w")).distinct(), "tid", "left")
    cause = F.when(F.col("c").isNull(), "not_a_candidate").when(F.col("w").isNotNull(), "wrong_anchor").otherwise("rejected")
    false = links.select("tid", "aid").join(truth.select("tid", "aid"), ["tid", "aid"], "left_anti").join(truth.select("tid", F.lit(1).alias("o")).distinct(), "tid", "left")
    kind = F.when(F.col("o").isNull(), "decoy_linked").otherwise("owned_by_another")
    return seen.select(cause.alias("cause")).unionByName(false.select(kind.alias("cause"))).groupBy("cause").agg(F.count("*").alias("n"))


def gain_if_fixed(anchors: DataFrame, links: DataFrame, truth: DataFrame, fixes: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """cause, gain: macro F0.5 after adding and removing the given pairs, minus before."""
    base = macro(anchors, links, truth).select(F.col("macro_f05").alias("base"))
    out = None
    for cause, (add, drop) in fixes.items():
        fixed = links.select("tid", "aid").join(drop.select("tid", "aid"), ["tid", "aid"], "left_anti").unionByName(add.select("tid", "aid")).distinct()
        row = macro(anchors, fixed, truth).crossJoin(base).select(F.lit(cause).alias("cause"), (F.col("macro_f05") - F.col("base")).alias("gain"))
        out = row if out is None else out.unionByName(row)
    return out


def slices(scored: DataFrame) -> DataFrame:
    bucket = F.when(F.col("truth") == 0, "0").when(F.col("truth") == 1, "1").when(F.col("truth") <= 3, "2-3").otherwise("4+")
    return summary(scored.withColumn("slice", bucket), "slice")


def recall_at(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """k, recall of true links among the first k candidates (ranked: tid, aid, position from 0)."""
    hit = truth.select("tid", "aid").join(ranked.select("tid", "aid", "position"), ["tid", "aid"], "left")
    row = hit.agg(*(F.avg(F.coalesce((F.col("position") < k).cast("double"), F.lit(0.0))).alias(str(k)) for k in ks))
    return row.unpivot([], [str(k) for k in ks], "k", "recall")


def rule_gate(decisions: DataFrame, rule: DataFrame, truth: DataFrame) -> DataFrame:
    """scope, n, precision of a rule's pairs: all of them, and those on targets that are not linked yet."""
    judged = rule.select("tid", "aid").join(truth.select("tid", "aid", F.lit(1.0).alias("ok")), ["tid", "aid"], "left").join(decisions.select("tid", F.lit(1).alias("linked")).distinct(), "tid", "left")
    x = judged.select(F.coalesce("ok", F.lit(0.0)).alias("ok"), F.explode(F.when(F.col("linked").isNull(), F.array(F.lit("all"), F.lit("unlinked"))).otherwise(F.array(F.lit("all")))).alias("scope"))
    return x.groupBy("scope").agg(F.count("*").alias("n"), F.avg("ok").alias("precision"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, n of link sets (tid, aid): in both, only in a, only in b."""
    x = a.select("tid", "aid").distinct().withColumn("a", F.lit(1)).join(b.select("tid", "aid").distinct().withColumn("b", F.lit(1)), ["tid", "aid"], "full")
    side = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("both")
    return x.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equality of two tables as multisets."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def output_audit(anchors: DataFrame, lines: DataFrame, targets: DataFrame) -> DataFrame:
    """One row of violations of an output table (source1_entity_id, matched_entity_ids)."""
    ids = lines.where(F.length("matched_entity_ids") > 0).select("source1_entity_id", F.explode(F.split("matched_entity_ids", ",")).alias("target_id"))
    tests = {
        "missing_anchor": anchors.join(lines, anchors["entity_id"] == lines["source1_entity_id"], "left_anti"),
        "unknown_anchor": lines.join(anchors, anchors["entity_id"] == lines["source1_entity_id"], "left_anti"),
        "repeated_anchor": lines.groupBy("source1_entity_id").count().where("count > 1"),
        "unknown_target": ids.join(targets, ids["target_id"] == targets["entity_id"], "left_anti"),
        "repeated_target": ids.groupBy("target_id").count().where("count > 1"),
    }
    out = None
    for k, d in tests.items():
        one = d.agg(F.count("*").alias(k))
        out = one if out is None else out.crossJoin(one)
    return out


def lineage(decisions: DataFrame, again: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """One row: rows whose probability cannot be derived again (tid, aid, q in both; 0 where there is no candidate)."""
    x = decisions.select("tid", "aid", "q").join(again.select("tid", F.col("q").alias("r")), "tid", "full")
    bad = F.col("q").isNull() | F.col("r").isNull() | F.isnan("q") | (F.abs(F.col("q") - F.col("r")) > tolerance) | ((F.col("aid") < 0) & (F.col("q") != 0))
    return x.agg(F.coalesce(F.sum(bad.cast("int")), F.lit(0)).alias("violations"), F.count("*").alias("n"))


def auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve from rank sums over distinct scores (ties count half; no global sort of rows)."""
    from matchloom.operators.order import running_sum

    g = scored.groupBy(score).agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    return running_sum(g, score, "n", "below").agg((F.sum(F.col("p") * (F.col("below") + 0.5 * F.col("n"))) / (F.sum("p") * F.sum("n"))).alias("auc"))


def alias_cycles(aliases: dict[str, str]) -> list[str]:
    """Aliases that lead back to themselves or to another alias (normalising twice would differ from once)."""
    return sorted(k for k, v in aliases.items() if any(w in aliases for w in v.split()))


def oracle_ceiling(anchors: DataFrame, pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Summary of a perfect choice among the candidates: what blocking alone leaves possible."""
    return macro(anchors, truth.join(pairs.select("tid", "aid").distinct(), ["tid", "aid"], "left_semi"), truth)


def rank_histogram(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """position, n of true links (position -1: never a candidate), and how many candidates their targets have on average."""
    sizes = ranked.groupBy("tid").agg(F.count("*").alias("c"))
    hit = truth.select("tid", "aid").join(ranked.select("tid", "aid", "position"), ["tid", "aid"], "left").join(sizes, "tid", "left")
    return hit.groupBy(F.coalesce("position", F.lit(-1)).alias("position")).agg(F.count("*").alias("n"), F.avg(F.coalesce("c", F.lit(0))).alias("candidates"))


def out_of_place(a: DataFrame, b: DataFrame, place: str, *columns: str) -> DataFrame:
    """One row: rows that two files do not share at the same place (a full join on the place, each difference counted)."""
    x = a.select(place, *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(1).alias("a_")).join(b.select(place, *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(1).alias("b_")), place, "full")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    both = F.col("a_").isNotNull() & F.col("b_").isNotNull()
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    return x.agg(F.count("*").alias("places"), count(F.col("b_").isNull()).alias("only_a"), count(F.col("a_").isNull()).alias("only_b"), count(both & ~same).alias("changed"))


def looked_up(pairs: DataFrame, scores: DataFrame, column: str) -> DataFrame:
    """pairs(tid, aid, ...) with a score that every one of them must have; a pair without one fails the query."""
    x = pairs.join(scores.select("tid", "aid", column), ["tid", "aid"], "left")
    found = F.assert_true(F.col(column).isNotNull(), F.concat(F.lit("no score of pair "), F.col("tid").cast("string"), F.lit(","), F.col("aid").cast("string")))
    return x.where(F.coalesce(found.isNull(), F.lit(True)))


def set_audit(stages: dict[str, DataFrame]) -> DataFrame:
    """stage, pairs, missing, extra: pairs (tid, aid) of each stage as a set, against the first one's."""
    names = list(stages)
    first = stages[names[0]].select("tid", "aid").distinct()
    out = None
    for name in names:
        own = stages[name].select("tid", "aid").distinct()
        both = first.withColumn("f", F.lit(1)).join(own.withColumn("o", F.lit(1)), ["tid", "aid"], "full")
        row = both.agg(F.lit(name).alias("stage"), F.count("o").alias("pairs"), F.sum(F.col("o").isNull().cast("int")).alias("missing"), F.sum(F.col("f").isNull().cast("int")).alias("extra"))
        out = row if out is None else out.unionByName(row)
    return out


def disagreement(a: DataFrame, b: DataFrame, truth: DataFrame, records: DataFrame) -> DataFrame:
    """pattern, slice, n, a_right, b_right over targets on which two link sets (tid, aid) differ.

    records: tid, aid, core and address of the target and of its candidate anchor (a_core, a_address).
    """
    x = a.select("tid", F.col("aid").alias("a")).join(b.select("tid", F.col("aid").alias("b")), "tid", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    pattern = F.when(F.col("b").isNull(), "only a links").when(F.col("a").isNull(), "only b links").otherwise("other anchor")
    x = x.withColumn("aid", F.coalesce("b", "a")).join(records, ["tid", "aid"]).join(truth.select("tid", F.col("aid").alias("own")), "tid", "left")
    name, place = F.col("core") == F.col("a_core"), F.col("address") == F.col("a_address")
    part = F.when(F.col("address") == "", "no address").when(name & place, "same name and address").when(name, "same name").when(place, "same address").otherwise("both differ")
    right = lambda c: F.avg(F.col(c).eqNullSafe(F.col("own")).cast("double"))
    return x.groupBy(pattern.alias("pattern"), part.alias("slice")).agg(F.count("*").alias("n"), right("a").alias("a_right"), right("b").alias("b_right"))


def flag_table(rows: DataFrame, flags: dict[str, Column], label: str) -> DataFrame:
    """flag, n, rate, odds: how often each flag holds, how often labelled rows are 1 where it does, and the odds ratio to the rest."""
    made = rows.select(F.col(label).cast("double").alias("y"), F.explode(F.array(*(F.struct(F.lit(k).alias("flag"), v.cast("double").alias("on")) for k, v in flags.items()))).alias("f"))
    g = made.groupBy(F.col("f.flag").alias("flag")).agg(F.sum("f.on").alias("n"), F.sum(F.col("f.on") * F.col("y")).alias("n1"), F.count("*").alias("all"), F.sum("y").alias("all1"))
    inside, outside = F.col("n1") + 0.5, F.col("all1") - F.col("n1") + 0.5
    odds = (inside / (F.col("n") - F.col("n1") + 0.5)) / (outside / (F.col("all") - F.col("n") - F.col("all1") + F.col("n1") + 0.5))
    return g.select("flag", F.col("n").cast("long").alias("n"), ratio(F.col("n1"), F.col("n")).alias("rate"), odds.alias("odds"))


def fidelity(real: DataFrame, made: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """flag, real, made, ratio: rates of each flag in real and synthetic records."""
    rates = lambda df, name: df.agg(*(F.avg(v.cast("double")).alias(k) for k, v in flags.items())).unpivot([], list(flags), "flag", name)
    return rates(real, "real").join(rates(made, "made"), "flag").withColumn("ratio", ratio(F.col("made"), F.col("real")))


def statistics(records: DataFrame) -> DataFrame:
    """country, section, key, n over records(country, name, address): sizes, name lengths in words, scripts, missing addresses, shared names."""
    from matchloom.operators.evidence import script

    words = F.size(F.filter(F.split("name", " "), lambda w: w != ""))
    sections = F.array(
        F.struct(F.lit("records").alias("section"), F.lit("all").alias("key")),
        F.struct(F.lit("name_words").alias("section"), F.least(words, F.lit(8)).cast("string").alias("key")),
        F.struct(F.lit("script").alias("section"), script(F.col("name")).alias("key")),
        F.struct(F.lit("address").alias("section"), F.when(F.trim("address") == "", "missing").otherwise("present").alias("key")),
    )
    rows = records.select("country", F.explode(sections).alias("s")).groupBy("country", "s.section", "s.key").agg(F.count("*").alias("n"))
    shared = records.groupBy("country", "name").agg(F.count("*").alias("c")).groupBy("country", F.lit("namesakes").alias("section"), F.least("c", F.lit(5)).cast("string").alias("key")).agg(F.count("*").alias("n"))
    return rows.unionByName(shared)
