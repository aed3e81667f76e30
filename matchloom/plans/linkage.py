"""The linkage slice over scored pairs, and candidate generation over names and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import similarity as S
from matchloom.operators import blocking, decide, evaluate, evidence
from matchloom.plans.common import BEST, DECISIONS, PAIRS, TRUTH, anchors, decisions, pairs, table, truth
from matchloom.registry import register

KNOBS = decide.Knobs(missing=0.1, empty_scale=6.0, min_margin=0.015, floor=0.2)


def decoded_sql(knobs: decide.Knobs = KNOBS) -> str:
    return f"""SELECT tid, aid, q, k FROM (
 SELECT *, CASE WHEN empty > best THEN 0 ELSE min(CASE WHEN score = best THEN k END) OVER (PARTITION BY aid) END AS depth FROM (
  SELECT *, max(score) OVER (PARTITION BY aid) AS best FROM (
   SELECT *, 1.25 * cs / (k + 0.25 * (total + {knobs.missing})) AS score FROM (
    SELECT tid, aid, q, row_number() OVER o AS k, sum(q) OVER (PARTITION BY aid ORDER BY q DESC, tid ROWS UNBOUNDED PRECEDING) AS cs, sum(q) OVER (PARTITION BY aid) AS total,
     {knobs.empty_scale} * exp(sum(ln(1 - least(q, 1 - 1e-7))) OVER (PARTITION BY aid)) AS empty
    FROM ({DECISIONS}) WHERE margin >= {knobs.min_margin} AND q > {knobs.floor} WINDOW o AS (PARTITION BY aid ORDER BY q DESC, tid))))) WHERE k <= depth"""


def scored_sql(links: str) -> str:
    return f"""SELECT s_suppkey AS aid, s_nationkey AS country, coalesce(pred, 0) AS pred, coalesce(truth, 0) AS truth, coalesce(tp, 0) AS tp,
 CASE WHEN coalesce(pred, 0) = 0 AND coalesce(truth, 0) = 0 THEN 1.0 WHEN coalesce(pred, 0) + 0.25 * coalesce(truth, 0) = 0 THEN 0.0 ELSE 1.25 * coalesce(tp, 0) / (coalesce(pred, 0) + 0.25 * coalesce(truth, 0)) END AS f
 FROM supplier LEFT JOIN (SELECT aid, sum(l) AS pred, sum(t) AS truth, sum(l * t) AS tp FROM (SELECT coalesce(a.aid, b.aid) AS aid, CASE WHEN a.tid IS NULL THEN 0 ELSE 1 END AS l, CASE WHEN b.tid IS NULL THEN 0 ELSE 1 END AS t
  FROM (SELECT tid, aid FROM ({links})) a FULL JOIN ({TRUTH}) b ON a.tid = b.tid AND a.aid = b.aid) GROUP BY aid) ON s_suppkey = aid"""


SUMMARY = "count(*) AS anchors, round(avg(f), 6) AS macro_f05, round(CASE WHEN sum(pred) = 0 THEN 0 ELSE sum(tp) / sum(pred) END, 6) AS precision, round(CASE WHEN sum(truth) = 0 THEN 0 ELSE sum(tp) / sum(truth) END, 6) AS recall, sum(pred)::BIGINT AS links"


def _rounded(df, *by):
    return df.select(*by, "anchors", *(F.round(c, 6).alias(c) for c in ("macro_f05", "precision", "recall")), F.col("links").cast("long").alias("links"))


@register(f"SELECT {SUMMARY} FROM ({scored_sql(decoded_sql())})")
def match_pipeline_macro_f05(spark, d):
    """Candidates, best two, decoder and evaluator in one plan."""
    links = decide.decode(decisions(spark, d), KNOBS)
    return _rounded(evaluate.macro(anchors(spark, d), links, truth(spark, d)))


@register(decoded_sql())
def decide_expected_f05(spark, d):
    return decide.decode(decisions(spark, d), KNOBS).select("tid", "aid", "q", "k")


@register(f"SELECT tid, aid, q, margin FROM ({DECISIONS}) WHERE q >= 0.7 AND margin >= 0.05")
def decide_threshold(spark, d):
    return decide.threshold(decisions(spark, d), 0.7, 0.05)


@register(f"WITH n AS (SELECT tid, aid, p FROM (SELECT tid, aid, 1 - p AS p, row_number() OVER (PARTITION BY tid ORDER BY 1 - p DESC, aid) AS r FROM ({PAIRS}) WHERE tid IN (SELECT tid FROM ({DECISIONS}) WHERE q >= 0.2 AND q < 0.6)) WHERE r = 1) SELECT t.tid, coalesce(n.aid, t.aid) AS aid, round(coalesce(n.p, q), 6) AS q, round(CASE WHEN n.tid IS NULL THEN margin ELSE 1.0 END, 6) AS margin FROM ({DECISIONS}) t LEFT JOIN n ON t.tid = n.tid")
def decide_redecide(spark, d):
    own = decisions(spark, d)
    again = decide.band(own, pairs(spark, d), 0.2, 0.6).select("tid", "aid", (1 - F.col("p")).alias("p"))
    return decide.redecide(own, again).select("tid", "aid", F.round("q", 6).alias("q"), F.round("margin", 6).alias("margin"))


OPTIONS = [decide.Knobs(m, e, 0.015, 0.2) for m in (0.0, 0.1, 0.5) for e in (1.0, 6.0)]


@register(" UNION ALL ".join(f"SELECT {i} AS option, {k.missing}::DOUBLE AS missing, {k.empty_scale}::DOUBLE AS empty_scale, round(avg(f), 6) AS macro_f05 FROM ({scored_sql(decoded_sql(k))})" for i, k in enumerate(OPTIONS)))
def decide_knob_grid(spark, d):
    return decide.grid(decisions(spark, d), truth(spark, d), anchors(spark, d), OPTIONS).select("option", "missing", "empty_scale", F.round("macro_f05", 6).alias("macro_f05"))


ADDED = "SELECT tid, aid FROM (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY p DESC, tid) AS n FROM ({new}) x LEFT JOIN (SELECT aid AS a2, count(*) AS used FROM ({cur}) GROUP BY aid) u ON x.aid = u.a2) WHERE n <= 120 - coalesce(used, 0)"


@register(f"WITH cur AS (SELECT tid, aid FROM ({DECISIONS}) WHERE q >= 0.7), one AS (SELECT tid, aid, p FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY p DESC, aid) AS r FROM ({PAIRS}) WHERE tid NOT IN (SELECT tid FROM cur)) WHERE r = 1) SELECT tid, aid FROM cur UNION ALL " + ADDED.format(new="SELECT * FROM one", cur="SELECT * FROM cur"))
def decide_additions_with_caps(spark, d):
    cur = decisions(spark, d).where("q >= 0.7").select("tid", "aid", F.lit("S2").alias("src"))
    new = pairs(spark, d).select("tid", "aid", F.lit("S2").alias("src"), F.struct(-F.col("p"), "aid", "tid").alias("pos"))
    # list order within a target is by score; per anchor by score, then target
    new = new.select("tid", "aid", "src", F.struct(F.col("pos").getField("col1").alias("s"), F.col("tid").alias("t"), F.col("aid").alias("a")).alias("pos"))
    return decide.additions(cur, [new], {"S2": 120}).select("tid", "aid")


@register(f"SELECT aid, country, pred::BIGINT AS pred, truth::BIGINT AS truth, tp::BIGINT AS tp, round(f, 6) AS f FROM ({scored_sql(BEST)})")
def evaluate_per_anchor(spark, d):
    x = evaluate.per_anchor(anchors(spark, d), decide.best_two(pairs(spark, d)), truth(spark, d))
    return x.select("aid", "country", *(F.col(c).cast("long").alias(c) for c in ("pred", "truth", "tp")), F.round("f", 6).alias("f"))


@register(f"SELECT country, {SUMMARY} FROM ({scored_sql(BEST)}) GROUP BY country")
def evaluate_by_country(spark, d):
    x = evaluate.per_anchor(anchors(spark, d), decide.best_two(pairs(spark, d)), truth(spark, d))
    return _rounded(evaluate.summary(x, "country"), "country")


@register(f"SELECT round(avg(x), 6) AS mean, round(stddev_samp(x) / sqrt(count(*)), 6) AS se, count(*) FILTER (x > 0) AS better, count(*) FILTER (x < 0) AS worse FROM (SELECT b.f - a.f AS x FROM ({scored_sql(BEST)}) a JOIN ({scored_sql(decoded_sql())}) b ON a.aid = b.aid)")
def evaluate_paired(spark, d):
    score = lambda links: evaluate.per_anchor(anchors(spark, d), links, truth(spark, d))
    x = evaluate.paired(score(decide.best_two(pairs(spark, d))), score(decide.decode(decisions(spark, d), KNOBS)))
    return x.select(F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), "better", "worse")


@register(f"""WITH l AS (SELECT tid, aid FROM ({DECISIONS}) WHERE q >= 0.7), t AS ({TRUTH}), lost AS (SELECT t.* FROM t ANTI JOIN l ON t.tid = l.tid AND t.aid = l.aid),
 bad AS (SELECT l.* FROM l ANTI JOIN t ON t.tid = l.tid AND t.aid = l.aid)
 SELECT cause, count(*) AS n FROM (SELECT CASE WHEN l.tid IS NOT NULL THEN 'wrong_anchor' ELSE 'rejected' END AS cause FROM lost LEFT JOIN l ON lost.tid = l.tid
 UNION ALL SELECT CASE WHEN t.tid IS NULL THEN 'decoy_linked' ELSE 'owned_by_another' END FROM bad LEFT JOIN t ON bad.tid = t.tid) GROUP BY cause""")
def evaluate_error_budget(spark, d):
    return evaluate.error_budget(anchors(spark, d), decide.threshold(decisions(spark, d), 0.7), truth(spark, d), pairs(spark, d))


@register(f"SELECT k, avg(CASE WHEN r <= k::INTEGER THEN 1.0 ELSE 0.0 END) AS recall FROM ({TRUTH}) t JOIN (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY p DESC, aid) AS r FROM ({PAIRS})) x ON t.tid = x.tid AND t.aid = x.aid, (VALUES ('1'), ('2'), ('4'), ('8')) AS v(k) GROUP BY k".replace("avg(CASE WHEN r <= k::INTEGER THEN 1.0 ELSE 0.0 END)", "round(avg(CASE WHEN r <= k::INTEGER THEN 1.0 ELSE 0.0 END), 6)"))
def evaluate_recall_at_k(spark, d):
    from pyspark.sql import Window

    ranked = pairs(spark, d).withColumn("position", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("p"), "aid")) - 1)
    return evaluate.recall_at(ranked, truth(spark, d)).select("k", F.round("recall", 6).alias("recall"))


@register(f"SELECT round(sum(p * (below + 0.5 * n)) / (sum(p) * sum(n)), 6) AS auc FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT x.p AS score, count(*) FILTER (t.tid IS NOT NULL) AS p, count(*) FILTER (t.tid IS NULL) AS n FROM ({PAIRS}) x LEFT JOIN ({TRUTH}) t ON x.tid = t.tid AND x.aid = t.aid GROUP BY x.p))")
def evaluate_auc(spark, d):
    x = pairs(spark, d).join(truth(spark, d).withColumn("label", F.lit(1)), ["tid", "aid"], "left").select(F.col("p").alias("score"), F.coalesce("label", F.lit(0)).alias("label"))
    return evaluate.auc(x).select(F.round("auc", 6).alias("auc"))


@register(f"SELECT tid, round(sum(p), 6) AS p_sum, count(*) AS n_cand, round(-sum(CASE WHEN w > 0 THEN w * ln(w) ELSE 0 END), 6) AS entropy FROM (SELECT tid, p, p / sum(p) OVER (PARTITION BY tid) AS w FROM ({PAIRS})) GROUP BY tid")
def evidence_competition(spark, d):
    return evidence.competition(pairs(spark, d)).select("tid", F.round("p_sum", 6).alias("p_sum"), "n_cand", F.round("entropy", 6).alias("entropy"))


@register(f"SELECT tid, aid, q, row_number() OVER (PARTITION BY aid ORDER BY q DESC, tid) AS q_rank, round(sum(q) OVER (PARTITION BY aid) - q, 4) AS q_others, count(*) OVER (PARTITION BY aid) AS n_rows FROM ({DECISIONS})")
def evidence_anchor_level(spark, d):
    return evidence.anchor_level(decisions(spark, d)).select("tid", "aid", "q", "q_rank", F.round("q_others", 4).alias("q_others"), "n_rows")


@register(f"SELECT tid, round(ln(greatest(least(p, 0.999999), 0.000001) / (1 - greatest(least(p, 0.999999), 0.000001))), 6) AS logit_p, round(p - p2, 6) AS p_gap FROM ({BEST})")
def evidence_calibration_inputs(spark, d):
    return evidence.calibration_inputs(decide.best_two(pairs(spark, d))).select("tid", F.round("logit_p", 6).alias("logit_p"), F.round("p_gap", 6).alias("p_gap"))


@register("SELECT a.vec_id AS tid, b.vec_id AS aid, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cos FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) <= 4")
def block_vector_top_k(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("part"), "embedding")
    return blocking.vector_top_k(v, v, 4).select("tid", "aid", F.round("cos", 5).alias("cos"))


def _names(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("country"), F.col("p_name").alias("core"), F.concat(F.col("p_size").cast("string"), F.lit(" "), F.lower("p_type"), F.lit(" rd")).alias("address"), F.col("p_name").alias("phonetic"), F.lit(0).alias("missing"))


@register("""WITH k AS (SELECT p_partkey AS id, p_brand AS country, 0 AS type, replace(p_name, ' ', '') AS token FROM part
 UNION ALL SELECT p_partkey, p_brand, 1, unnest(list_filter(list_distinct(string_split(p_name, ' ')), lambda w: len(w) >= 2)) FROM part
 UNION ALL SELECT p_partkey, p_brand, 2, unnest(list_distinct(list_transform(range(1, len(p_name) + 1), lambda i: substr(' ' || p_name || ' ', i, 3)))) FROM part)
 SELECT type, count(*) AS keys, count(DISTINCT country || '|' || token) AS terms FROM k GROUP BY type""")
def block_keys(spark, d):
    k = blocking.keys(_names(spark, d)).where("type <= 2")
    return k.groupBy("type").agg(F.count("*").alias("keys"), F.countDistinct("country", "token").alias("terms"))


@register("""WITH r AS (SELECT p_partkey AS id, p_brand AS country, p_name, p_size || ' ' || lower(p_type) || ' rd' AS address FROM part),
 k AS (SELECT id, country, 3 AS type, unnest(list_filter(list_distinct(string_split(address, ' ')), lambda w: len(w) >= 2)) AS token FROM r
 UNION ALL SELECT id, country, 4, unnest(list_distinct(list_transform(range(1, len(address)), lambda i: substr(' ' || address || ' ', i, 4)))) FROM r
 UNION ALL SELECT id, country, 5, unnest(list_filter(list_distinct(string_split(p_name, ' ')), lambda w: len(w) >= 2)) FROM r
 UNION ALL SELECT id, country, 6, address FROM r)
 SELECT type, count(*) AS keys, count(DISTINCT country || '|' || token) AS terms FROM k GROUP BY type""")
def block_keys_address(spark, d):
    """The key types that block_keys leaves out: address tokens and 4-grams, phonetic tokens and whole addresses."""
    k = blocking.keys(_names(spark, d)).where("type > 2")
    return k.groupBy("type").agg(F.count("*").alias("keys"), F.countDistinct("country", "token").alias("terms"))


@register()
def block_candidates(spark, d):
    """All of B1-B11 on part names within a brand (block_* have a twin of every step)."""
    x = _names(spark, d)
    out = blocking.candidates(x, x)
    return out.select("tid", "aid", "position", F.round("rank", 6).alias("rank"), F.round("margin", 6).alias("margin"), "near_identical", "dense")


@register()
def pair_features_63(spark, d):
    from matchloom.operators import pair_features

    x = _names(spark, d)
    total = x.count()
    terms, _ = blocking.postings(blocking.keys(blocking.kinds(x)), total)
    found = blocking.candidates(x, x)
    retrieval = found.select("tid", "aid", F.col("ns").alias("retrieval_name_score"), F.col("ads").alias("retrieval_address_score"), F.col("rank").alias("retrieval_combined"), F.col("position").cast("double").alias("retrieval_rank"), F.col("margin").alias("retrieval_best_margin"), F.col("near_identical").cast("double").alias("near_identical_candidates"), F.col("dense").cast("double").alias("dense_route"))
    full = x.withColumns({"norm": F.col("core"), "legal": F.lit(""), "non_ascii": F.lit(0), "source": F.lit("S2")})
    return pair_features.compare(retrieval, full, full, terms)
