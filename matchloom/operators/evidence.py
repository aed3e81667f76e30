"""Second-stage evidence: what other candidates, siblings, twins and anchors say about a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import similarity as S
from matchloom.operators.decide import other_best

CONFIDENT = 0.999


def pair_table(pairs: DataFrame, decisions: DataFrame, extra: dict[str, DataFrame] | None = None) -> DataFrame:
    """Ten base columns of pairs(tid, aid, p, ce), and score, other, gap and presence per extra scorer (tid, aid, score)."""
    per = Window.partitionBy("tid")
    x = pairs.withColumn("rank_p", F.row_number().over(per.orderBy(F.desc("p"), "aid")) - 1).withColumn("rank_ce", F.row_number().over(per.orderBy(F.desc("ce"), "aid")) - 1)
    x = other_best(other_best(x, "p", "other_p"), "ce", "other_ce")
    x = x.withColumns({"p_gap": F.col("p") - F.col("other_p"), "ce_gap": F.col("ce") - F.col("other_ce"), "n_cand": F.count("*").over(per)})
    x = x.join(decisions.select("tid", F.col("q").alias("q_best")), "tid", "left")
    for name, scores in (extra or {}).items():
        x = x.join(scores.select("tid", "aid", F.col("score").alias(f"{name}_raw")), ["tid", "aid"], "left")
        x = x.withColumn(f"{name}_has", F.col(f"{name}_raw").isNotNull().cast("int")).withColumn(name, F.coalesce(f"{name}_raw", F.lit(-1.0))).drop(f"{name}_raw")
        x = other_best(x, name, f"{name}_other")
        x = x.withColumn(f"{name}_gap", F.when(F.col(f"{name}_has") == 1, F.col(name) - F.greatest(f"{name}_other", F.lit(0.0))).otherwise(0.0))
    return x


def group(pairs: DataFrame, decisions: DataFrame, targets: DataFrame) -> DataFrame:
    """conf_all, conf_same_src, sibling_name_eq, target_no_addr per pair (targets: tid, src, core, missing)."""
    sure = decisions.where(F.col("q") >= CONFIDENT).join(targets.select("tid", "src", "core"), "tid")
    count = lambda *by: sure.groupBy(*by).agg(F.count("*").alias("n"))
    names = sure.select("aid", "core").distinct().withColumn("sibling", F.lit(1))
    own = sure.select("tid", "aid", F.lit(1).alias("self"))
    x = pairs.join(targets.select("tid", "src", "core", "missing"), "tid").join(own, ["tid", "aid"], "left")
    x = x.join(count("aid").withColumnRenamed("n", "a"), "aid", "left").join(count("aid", "src").withColumnRenamed("n", "s"), ["aid", "src"], "left").join(names, ["aid", "core"], "left")
    self_ = F.coalesce("self", F.lit(0))
    return x.select(*pairs.columns, (F.coalesce("a", F.lit(0)) - self_).alias("conf_all"), (F.coalesce("s", F.lit(0)) - self_).alias("conf_same_src"), F.coalesce("sibling", F.lit(0)).alias("sibling_name_eq"), F.col("missing").alias("target_no_addr"))


def decoys(targets: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per target: twins by name in its own and the other source, address crowding, load of its anchor (logarithms)."""
    by_name = targets.groupBy("country", "core").agg(F.count("*").alias("all")).join(targets.groupBy("country", "core", "src").agg(F.count("*").alias("own")), ["country", "core"])
    crowd = targets.where("address <> ''").groupBy("country", "address").agg(F.count("*").alias("crowd"))
    load = decisions.where("aid >= 0").groupBy("aid").agg(F.count("*").alias("load"))
    x = targets.join(by_name, ["country", "core", "src"], "left").join(crowd, ["country", "address"], "left").join(decisions.select("tid", "aid"), "tid", "left").join(load, "aid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return x.select("tid", F.log1p(zero(F.col("all") - F.col("own"))).alias("twins_other_source"), F.log1p(zero(F.col("own")) - 1).alias("twins_same_source"), F.log1p(zero("crowd")).alias("address_crowding"), "missing", F.log1p(zero("load")).alias("anchor_load"))


def competition(pairs: DataFrame) -> DataFrame:
    """Per target: sum, number, entropy and effective number of candidate probabilities, and the gap of the first two."""
    per = Window.partitionBy("tid")
    x = pairs.withColumn("s", F.sum("p").over(per)).withColumn("r", F.row_number().over(per.orderBy(F.desc("p"), "aid")))
    w = F.col("p") / F.col("s")
    h = -F.sum(F.when(w > 0, w * F.log(w)).otherwise(0.0))
    top = lambda k: F.coalesce(F.max(F.when(F.col("r") == k, F.col("p"))), F.lit(0.0))
    return x.groupBy("tid").agg(F.sum("p").alias("p_sum"), F.count("*").alias("n_cand"), h.alias("entropy"), F.exp(h).alias("effective"), (top(1) - top(2)).alias("gap"))


def anchor_level(decisions: DataFrame) -> DataFrame:
    """Rank of q within its anchor, sum of the others, number of rows."""
    per = Window.partitionBy("aid")
    return decisions.select("*", F.row_number().over(per.orderBy(F.desc("q"), "tid")).alias("q_rank"), (F.sum("q").over(per) - F.col("q")).alias("q_others"), F.count("*").over(per).alias("n_rows"))


# The 21 flags of how a raw record is written (patterns must equal those whose results are matched).
NAME_PATTERNS = {
    "name_bracket": "[\\[\\]]", "name_paren": "[()]", "name_phone": "- [0-9]{6,}", "name_accent": "[\u00C0-\u024F]", "name_nonlatin": "[^\\x00-\u024F]",
    "name_hyphen_glue": "[\\p{L}\\p{N}_]-[\\p{L}\\p{N}_]|&-", "name_prefix": "^(?:Dr|Smt|Inc|The|Shri|Sri|M/s)\\b",
    "name_suffix_word": "\\b(?:Center|Services|Partners|Group|Enterprises|Co|Global)[^\\p{L}\\p{N}_]*$", "name_punct_end": "[!&.,]\\s*$",
}
ADDRESS_PATTERNS = {"addr_null": "\\bnull\\b", "addr_numletter": "\\b[0-9]+[A-Z]\\b|\\b[0-9]+-[A-Z]\\b", "addr_nonlatin": "[^\\x00-\u024F]"}


def fingerprints(name: str = "business_name", address: str = "business_address") -> dict[str, Column]:
    """The 21 flags of a raw name and address."""
    n, a = F.col(name), F.col(address)
    flags = {k: n.rlike(p) for k, p in NAME_PATTERNS.items()} | {k: a.rlike(p) for k, p in ADDRESS_PATTERNS.items()}
    flags |= {
        "addr_empty": F.trim(a) == "", "addr_upper": (F.upper(a) == a) & a.rlike("[A-Z]"), "addr_hash": a.contains("#"), "addr_www": a.contains("www."),
        "name_dblspace": n.contains("  "), "name_www": n.contains("www.") | a.contains("www."), "name_upper": (F.upper(n) == n) & n.rlike("[A-Z]"),
        "name_lower": (F.lower(n) == n) & n.rlike("[a-z]"), "name_one_word": ~F.trim(n).contains(" "),
    }
    return {k: v.cast("int") for k, v in sorted(flags.items())}


# Syllables of made-up names, words before another name, and look-alike characters.
SYLLABLES = (
    "onyx kor delta xylo wex novi brix halo gild umbra faye nex kelo zeph calo aria lum jax cira dova veo nyla tavo mira yuma ecto "
    "riza lyra flux pyra belo drex arc sol evo vera syn orbi iri avi vio vantage zeta quo io x"
).split()
ALSO = "dba d/b/a aka formerly doing_business_as t/a f/k/a".split()


def operation_flags(name: str = "business_name") -> dict[str, Column]:
    """Made-up name (syllables, look-alikes undone), bare acronym, a second name, a domain."""
    n = F.col(name)
    plain = F.trim(F.translate(F.lower(n), "105", "los"))
    return {
        "op_made_up": plain.rlike("^(?:" + "|".join(SYLLABLES) + "){2,}$").cast("int"),
        "op_acronym": F.trim(n).rlike("^[A-Z]{2,4}$").cast("int"),
        "op_alias": F.lower(n).rlike("\\b(?:" + "|".join(x.replace("_", " ") for x in ALSO) + ")\\b").cast("int"),
        "op_domain": F.lower(n).rlike("\\.c[o0]m\\b").cast("int"),
    }


def lookalikes(name: str = "business_name") -> dict[str, Column]:
    """Characters that stand for letters they resemble."""
    patterns = {"l_for_i": "\\bl[bcdfgjkmnpqrstvwxz]", "5_for_s": "\\b5[a-z]", "0_for_o": "[a-zA-Z]0|0[a-zA-Z]", "1_for_l": "[a-zA-Z]1[a-zA-Z]"}  # fixed values
    return {k: F.col(name).rlike(p).cast("int") for k, p in patterns.items()}


def address_ambiguity(pairs: DataFrame, targets: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchors_at (-1 without an address), same_address, same_name of pairs(tid, aid); records: id, country, core, address."""
    a = anchors.select(F.col("id").alias("aid"), F.col("country").alias("a_country"), F.col("core").alias("a_core"), F.col("address").alias("a_address"))
    crowd = anchors.where("address <> ''").groupBy("country", "address").agg(F.count("*").alias("at"))
    x = pairs.join(targets.select(F.col("id").alias("tid"), "country", "core", "address"), "tid").join(a, "aid").join(crowd, ["country", "address"], "left")
    here = F.col("country") == F.col("a_country")
    return x.select(
        "tid", "aid", F.when(F.col("address") == "", -1).otherwise(F.coalesce("at", F.lit(0))).alias("anchors_at"),
        ((F.col("address") != "") & here & (F.col("address") == F.col("a_address"))).cast("int").alias("same_address"), (here & (F.col("core") == F.col("a_core"))).cast("int").alias("same_name"),
    )


def namesake_counts(decisions: DataFrame, targets: DataFrame, anchors: DataFrame) -> DataFrame:
    """Logarithms of how many anchors share the chosen anchor's name, its address, and the target's name (-1 without an anchor)."""
    name = anchors.groupBy("country", "core").agg(F.count("*").alias("names"))
    place = anchors.groupBy("country", "address").agg(F.count("*").alias("places"))
    own = anchors.join(name, ["country", "core"]).join(place, ["country", "address"]).select(F.col("id").alias("aid"), "names", "places")
    x = decisions.select("tid", "aid").join(targets.select(F.col("id").alias("tid"), "country", "core"), "tid").join(own, "aid", "left").join(name.withColumnRenamed("names", "like"), ["country", "core"], "left")
    log = lambda c: F.when(F.col("aid") < 0, -1.0).otherwise(F.log1p(F.coalesce(c, F.lit(0))))
    return x.select("tid", log("names").alias("anchor_namesakes"), log("places").alias("anchor_neighbours"), log("like").alias("target_namesakes"))


def query_relative(pairs: DataFrame) -> DataFrame:
    """Eleven columns of a target's candidates (tid, aid, p) relative to the best: gaps, near ones, shares, entropy, numbers."""
    per = Window.partitionBy("tid")
    x = pairs.withColumns({"r": F.row_number().over(per.orderBy(F.desc("p"), "aid")), "top": F.max("p").over(per), "s": F.sum("p").over(per)})
    w = F.col("p") / F.greatest("s", F.lit(1e-9))
    at = lambda k: F.coalesce(F.max(F.when(F.col("r") == k, F.col("p"))), F.lit(0.0))
    near = lambda d: F.sum((F.col("p") >= F.col("top") - d).cast("int"))
    total, n = F.greatest(F.max("s"), F.lit(1e-9)), F.count("*")
    return x.groupBy("tid").agg(
        (at(1) - at(2)).alias("gap12"), (at(2) - at(3)).alias("gap23"), (at(1) - at(3)).alias("gap13"), near(0.01).alias("near_01"), near(0.03).alias("near_03"), near(0.05).alias("near_05"),
        (at(2) / total).alias("second_share"), ((at(2) + at(3)) / total).alias("runners_share"),
        (-F.sum(w * F.log(F.greatest(w, F.lit(1e-12)))) / F.log(F.greatest(n, F.lit(2)))).alias("even"), (1 / F.greatest(F.sum(w * w), F.lit(1e-9))).alias("effective"), n.alias("n_cand"),
    )


def agreeing_twins(pairs: DataFrame, decisions: DataFrame, targets: DataFrame) -> DataFrame:
    """agree: confident records of the other source that are linked to the pair's anchor under the target's name (targets: tid, src, core)."""
    sure = decisions.where(F.col("q") >= CONFIDENT).join(targets.select("tid", "src", "core"), "tid").groupBy("aid", "core", "src").agg(F.count("*").alias("n"))
    other = F.when(F.col("src") == "S2", "S3").otherwise("S2")
    x = pairs.select("tid", "aid").join(targets.select("tid", "core", other.alias("src")), "tid").join(sure, ["aid", "core", "src"], "left")
    return x.select("tid", "aid", F.coalesce("n", F.lit(0)).alias("agree"))


def rescue_features(blocked: DataFrame, decisions: DataFrame, linked: DataFrame, scores: dict[str, DataFrame]) -> DataFrame:
    """Columns of blocked pairs(tid, aid, sim, overlap) of a second route: ranks, scorers' leads, and what is decided already."""
    per = Window.partitionBy("tid")
    x = blocked.withColumns({"n_cand": F.count("*").over(per), "rank": F.row_number().over(per.orderBy(F.desc("sim"), "aid")) - 1})
    for k, s in scores.items():
        x = x.join(s.select("tid", "aid", F.col("score").alias(k)), ["tid", "aid"], "left").na.fill(0.0, [k])
        x = x.withColumns({f"{k}_gap": F.max(k).over(per) - F.col(k), f"{k}_rank": F.row_number().over(per.orderBy(F.desc(k), "aid")) - 1})
    load = linked.groupBy("aid").agg(F.count("*").alias("load"))
    x = x.join(decisions.select("tid", F.col("aid").alias("top"), "q"), "tid", "left").join(linked.select("tid", F.lit(1).alias("linked")).distinct(), "tid", "left").join(load, "aid", "left")
    return x.withColumns({"same_as_top": F.coalesce((F.col("aid") == F.col("top")).cast("int"), F.lit(0)), "linked": F.coalesce("linked", F.lit(0)), "load": F.coalesce("load", F.lit(0)), "q": F.coalesce("q", F.lit(0.0))}).drop("top")


SCRIPTS = {"devanagari": "\\u0900-\\u097F", "bengali": "\\u0980-\\u09FF", "gurmukhi": "\\u0A00-\\u0A7F", "gujarati": "\\u0A80-\\u0AFF", "oriya": "\\u0B00-\\u0B7F", "tamil": "\\u0B80-\\u0BFF", "telugu": "\\u0C00-\\u0C7F", "kannada": "\\u0C80-\\u0CFF", "malayalam": "\\u0D00-\\u0D7F"}


def script(x):
    out = None
    for name, block in SCRIPTS.items():
        out = F.when(x.rlike(f"[{block}]"), name) if out is None else out.when(x.rlike(f"[{block}]"), name)
    return out.otherwise("other")


#: Pair columns that calibration sees beside the scores.  Fixed values.
CALIBRATION = (
    "name_edit name_trigram_dice full_name_edit address_edit address_trigram_dice address_token_min target_address_missing target_name_nonascii "
    "name_address_product retrieval_rank retrieval_best_margin name_frequency_log"
).split()


def calibration_inputs(best: DataFrame) -> DataFrame:
    """logit p, logit p2, p - p2 beside the columns of best(tid, aid, p, aid2, p2, cos, route and CALIBRATION where known)."""
    return best.withColumns({"logit_p": S.logit(F.col("p")), "logit_p2": S.logit(F.col("p2")), "p_gap": F.col("p") - F.col("p2")})
