"""From pair scores to links: best candidates, calibration inputs, expected-F decoding, re-decision, budgets, assembly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from matchloom.functions import similarity as S


@dataclass(frozen=True)
class Knobs:
    missing: float = 0.1
    empty_scale: float = 6.0
    min_margin: float = 0.015
    floor: float = 0.0


def best_two(pairs: DataFrame) -> DataFrame:
    """tid, aid, p, aid2, p2, n_cand: first and second candidate by p, ties by aid (pairs: tid, aid, p)."""
    per = Window.partitionBy("tid")
    x = pairs.withColumn("r", F.row_number().over(per.orderBy(F.desc("p"), "aid"))).where("r <= 2")
    out = x.groupBy("tid").agg(F.max(F.when(F.col("r") == 1, F.col("aid"))).alias("aid"), F.max(F.when(F.col("r") == 1, F.col("p"))).alias("p"), F.max(F.when(F.col("r") == 2, F.col("aid"))).alias("aid2"), F.max(F.when(F.col("r") == 2, F.col("p"))).alias("p2"))
    return out.select("tid", "aid", "p", F.coalesce("aid2", F.lit(-1)).alias("aid2"), F.coalesce("p2", F.lit(0.0)).alias("p2"))


def other_best(df: DataFrame, value: str, out: str, group: str = "tid", key: str = "aid") -> DataFrame:
    """Largest value among the other rows of the group; -1 for a row that is alone."""
    per = Window.partitionBy(group)
    x = df.withColumn("_r", F.row_number().over(per.orderBy(F.desc(value), key)))
    top = lambda k: F.max(F.when(F.col("_r") == k, F.col(value))).over(per)
    return x.withColumn(out, F.coalesce(F.when(F.col("_r") == 1, top(2)).otherwise(top(1)), F.lit(-1.0))).drop("_r")


def decode(decisions: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """Linked rows of decisions(tid, aid, q, margin): per anchor the prefix by q that maximises the expected F0.5.

    Windows over one partitioning (aid).  An anchor stays empty if that is expected to score strictly more.
    """
    rows = decisions.where((F.col("aid") >= 0) & (F.col("margin") >= knobs.min_margin) & (F.col("q") > knobs.floor))
    x = _prefixes(rows, Window.partitionBy("aid"), F.lit(knobs.missing), F.lit(knobs.empty_scale))
    return x.where("k <= depth").select("tid", "aid", "q", "margin", "k", "score")


def _prefixes(rows: DataFrame, per: WindowSpec, missing: Column, empty_scale: Column) -> DataFrame:
    """rows with their place k in the group's order, the score of the prefix that ends there, and the depth of the best one."""
    order = per.orderBy(F.desc("q"), "tid")
    x = rows.withColumns({
        "k": F.row_number().over(order),
        "cs": F.sum("q").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "total": F.sum("q").over(per),
        "empty": empty_scale * F.exp(F.sum(F.log(1 - F.least("q", F.lit(1 - 1e-7)))).over(per)),
    })
    x = x.withColumn("score", 1.25 * F.col("cs") / (F.col("k") + 0.25 * (F.col("total") + missing)))
    x = x.withColumn("best", F.max("score").over(per))
    return x.withColumn("depth", F.when(F.col("empty") > F.col("best"), 0).otherwise(F.min(F.when(F.col("score") == F.col("best"), F.col("k"))).over(per)))


def threshold(decisions: DataFrame, least: float, margin: float = 0.0) -> DataFrame:
    return decisions.where((F.col("aid") >= 0) & (F.col("q") >= least) & (F.col("margin") >= margin))


def band(decisions: DataFrame, pairs: DataFrame, low: float, high: float) -> DataFrame:
    """Pairs of targets whose decision is uncertain (semi-join before the expensive scorer)."""
    return pairs.join(decisions.where((F.col("q") >= low) & (F.col("q") < high)).select("tid"), "tid", "left_semi")


def redecide(decisions: DataFrame, rescored: DataFrame) -> DataFrame:
    """Targets in rescored(tid, aid, p) take its best anchor with margin 1; all others stay as they are."""
    new = rescored.withColumn("r", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("p"), "aid"))).where("r = 1").select("tid", F.col("aid").alias("aid_"), F.col("p").alias("p_"))
    x = decisions.join(new, "tid", "left")
    touched = F.col("aid_").isNotNull()
    return x.select("tid", F.coalesce("aid_", "aid").alias("aid"), F.coalesce("p_", "q").alias("q"), F.when(touched, 1.0).otherwise(F.col("margin")).alias("margin"))


def with_secondary(decisions: DataFrame, pairs: DataFrame, least: float, scale: float) -> DataFrame:
    """Adds pairs of other anchors with p >= least as further rows, scaled."""
    extra = pairs.where(F.col("p") >= least).join(decisions.select("tid", "aid"), ["tid", "aid"], "left_anti").select("tid", "aid", (F.col("p") * scale).alias("q"), F.lit(1.0).alias("margin"))
    return decisions.select("tid", "aid", "q", "margin").unionByName(extra)


def judged(decisions: DataFrame, judge: DataFrame, least: float) -> DataFrame:
    """Decision A unless the judge (tid, aid, q) backs another anchor with q >= least."""
    x = decisions.join(judge.select("tid", F.col("aid").alias("b"), F.col("q").alias("qb")), "tid", "left")
    swap = F.coalesce((F.col("b") != F.col("aid")) & (F.col("qb") >= least), F.lit(False))
    return x.select("tid", F.when(swap, F.col("b")).otherwise(F.col("aid")).alias("aid"), F.when(swap, F.col("qb")).otherwise(F.col("q")).alias("q"), "margin")


def assemble(parts: dict[str, DataFrame], odds: dict[str, float], country: str = "country") -> DataFrame:
    """Rows of each country from its own model, with scaled odds."""
    out = None
    for name, df in parts.items():
        own = df.where(F.col(country) == name).withColumn("q", S.scale_odds(F.col("q"), odds.get(name, 1.0)))
        out = own if out is None else out.unionByName(own)
    return out


def exclude(decisions: DataFrame, zone: DataFrame, keep: float) -> DataFrame:
    """Drops links in an exclusion zone (tid, aid) unless q >= keep."""
    return decisions.join(zone.select("tid", "aid").join(decisions.where(F.col("q") < keep).select("tid", "aid"), ["tid", "aid"], "left_semi"), ["tid", "aid"], "left_anti")


def prune(links: DataFrame, budget: int, bytes_per_link: int) -> DataFrame:
    """Drops the links whose loss per byte is least until they fit: last links first, each anchor re-evaluated.

    Dropping always the cheapest last link is the same as an order: a link goes when the dearest of those after it in its
    anchor has gone.  So losses are windows over anchors, and what goes is the front of one distributed sort.
    """
    over = links.count() * bytes_per_link - budget
    if over <= 0:
        return links
    per = Window.partitionBy("aid")
    ahead = per.orderBy(F.desc("q"), "tid")
    x = links.select("tid", "aid", "q").withColumns({
        "k": F.row_number().over(ahead), "total": F.sum("q").over(per),
        "cs": F.sum("q").over(ahead.rowsBetween(Window.unboundedPreceding, 0)),
        "none": F.exp(F.sum(F.log(1 - F.least("q", F.lit(1 - 1e-7)))).over(per)),
    })
    x = x.withColumn("value", 1.25 * F.col("cs") / (F.col("k") + 0.25 * F.col("total")))
    x = x.withColumn("loss", F.col("value") - F.coalesce(F.lag("value").over(per.orderBy("k")), F.col("none")))
    x = x.withColumn("cost", F.max("loss").over(per.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)))
    gone = x.orderBy(F.round("cost", 9), "aid", F.desc("k")).limit(-(-over // bytes_per_link)).select("tid", "aid")
    return links.join(gone, ["tid", "aid"], "left_anti")


def grid(decisions: DataFrame, truth: DataFrame, anchors: DataFrame, options: list[Knobs]) -> DataFrame:
    """Macro F0.5 of each setting in one plan: rows carry the number of a setting, windows go by setting and anchor."""
    fields = ("missing", "empty_scale", "min_margin", "floor")
    table = F.array(*(F.struct(F.lit(i).alias("option"), *(F.lit(float(getattr(k, f))).alias(f) for f in fields)) for i, k in enumerate(options)))
    x = decisions.where(F.col("aid") >= 0).withColumn("o", F.explode(table)).select("tid", "aid", "q", "margin", "o.*")
    x = x.where((F.col("margin") >= F.col("min_margin")) & (F.col("q") > F.col("floor")))
    per = Window.partitionBy("option", "aid")
    linked = _prefixes(x, per, F.col("missing"), F.col("empty_scale")).where("k <= depth").select("option", "tid", "aid")
    true = truth.select("tid", "aid").distinct()
    found = linked.join(true.withColumn("t", F.lit(1)), ["tid", "aid"], "left").groupBy("option", "aid").agg(F.count("*").alias("pred"), F.count("t").alias("tp"))
    wanted = anchors.select("aid").join(true.groupBy("aid").agg(F.count("*").alias("truth")), "aid", "left")
    every = wanted.withColumn("o", F.explode(table)).select("aid", "truth", "o.*").join(found, ["option", "aid"], "left").na.fill(0, ["truth", "pred", "tp"])
    from matchloom.operators.evaluate import f05

    return every.groupBy("option", *fields).agg(F.avg(f05(F.col("pred"), F.col("truth"), F.col("tp"))).alias("macro_f05"))


def threshold_grid(decisions: DataFrame, truth: DataFrame, anchors: DataFrame, thresholds: list[float], gaps: list[float]) -> DataFrame:
    """threshold, gap, macro_f05 of every setting of the threshold rule, in one plan; the first row by (rounded score, threshold) wins."""
    table = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.lit(float(g)).alias("gap")) for t in thresholds for g in gaps))
    true = truth.select("tid", "aid").distinct()
    rows = decisions.where(F.col("aid") >= 0).join(true.withColumn("t", F.lit(1)), ["tid", "aid"], "left").withColumn("o", F.explode(table)).where((F.col("q") >= F.col("o.threshold")) & (F.col("margin") >= F.col("o.gap")))
    found = rows.groupBy("o", "aid").agg(F.count("*").alias("pred"), F.count("t").alias("tp"))
    wanted = anchors.select("aid").join(true.groupBy("aid").agg(F.count("*").alias("truth")), "aid", "left").withColumn("o", F.explode(table))
    from matchloom.operators.evaluate import f05

    x = wanted.join(found, ["o", "aid"], "left").na.fill(0, ["truth", "pred", "tp"])
    return x.groupBy("o").agg(F.avg(f05(F.col("pred"), F.col("truth"), F.col("tp"))).alias("macro_f05")).select("o.threshold", "o.gap", "macro_f05")


def best_threshold(grid: DataFrame) -> DataFrame:
    """The setting of the best score to five digits; of ties, the higher threshold, then the smaller gap."""
    return grid.orderBy(F.desc(F.round("macro_f05", 5)), F.desc("threshold"), "gap").limit(1)


def blocking_cut(pairs: DataFrame, most_rank: int | None = None, least_dice: float | None = None) -> DataFrame:
    """Pairs(rank, dense, name_dice, address_dice) that stay candidates: by lexical rank, dense ones by their better Dice."""
    keep = F.lit(True)
    if most_rank is not None:
        keep = keep & ((F.col("dense") == 1) | (F.col("rank") < most_rank))
    if least_dice is not None:
        keep = keep & ((F.col("dense") == 0) | (F.greatest("name_dice", "address_dice") >= least_dice))
    return pairs.where(keep)


def shift_country(decisions: DataFrame, country: str, delta: float) -> DataFrame:
    """decisions(country, q, ...) with the logit of one country's q shifted; the others stay as they are."""
    return decisions.withColumn("q", F.when(F.col("country") == country, S.shift_logit(F.col("q"), delta)).otherwise(F.col("q")))


def additions(current: DataFrame, lists: list[DataFrame], caps: dict[str, int]) -> DataFrame:
    """Merges ordered additions (tid, aid, src, pos) into links (tid, aid, src): used targets are skipped, caps per anchor hold.

    Within a list a target's first row counts; each list sees what the lists before it added.
    """
    have = current.select("tid", "aid", "src")
    for new in lists:
        fresh = new.join(have.select("tid"), "tid", "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("tid").orderBy("pos"))).where("n = 1").drop("n")
        used = have.groupBy("aid", "src").agg(F.count("*").alias("used"))
        room = F.coalesce(*(F.when(F.col("src") == s, F.lit(c)) for s, c in caps.items())) - F.coalesce("used", F.lit(0))
        ranked = fresh.join(used, ["aid", "src"], "left").withColumn("n", F.row_number().over(Window.partitionBy("aid", "src").orderBy("pos")))
        have = have.unionByName(ranked.where(F.col("n") <= room).select("tid", "aid", "src"))
    return have


def removed_anchors(share: float, seed: int = 7) -> Column:
    """A share of anchors by a hash of aid."""
    return F.pmod(F.xxhash64("aid", F.lit(seed)), F.lit(1000)) < int(share * 1000)


def thinned(decisions: DataFrame, pairs: DataFrame, gone: Column, runner_up: DataFrame | None = None) -> DataFrame:
    """A denser world: anchors of which ``gone`` holds are removed, their targets move to their best surviving candidate.

    pairs: tid, aid, p.  A target without one moves to its surviving runner-up (tid, aid, q; q calibrated, see
    learn.isotonic), else to none.  Moved targets get margin 1.
    """
    best = best_two(pairs.where(~gone)).select("tid", F.col("aid").alias("next"), F.col("p").alias("qn"))
    x = decisions.withColumn("lost", gone).join(best, "tid", "left")
    if runner_up is not None:
        late = runner_up.where(~gone).select("tid", F.col("aid").alias("late"), F.col("q").alias("ql"))
        x = x.join(late, "tid", "left").withColumn("qn", F.when(F.col("next").isNull(), F.col("ql")).otherwise(F.col("qn"))).withColumn("next", F.coalesce("next", "late"))
    moved = F.col("lost") & F.col("next").isNotNull()
    return x.select("tid", F.when(F.col("lost"), F.coalesce("next", F.lit(-1))).otherwise(F.col("aid")).alias("aid"), F.when(F.col("lost"), F.coalesce("qn", F.lit(0.0))).otherwise(F.col("q")).alias("q"), F.when(moved, 1.0).otherwise(F.col("margin")).alias("margin"))
