"""Relational operators on the driver tables: scans, filters, joins, aggregates, windows, sets, sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions import similarity as S
from matchloom.operators import learn, order
from matchloom.plans.common import BEST, PAIRS, TRUTH, pairs, table, truth
from matchloom.registry import register
from matchloom.sources import records


@register("SELECT c_custkey AS id, (('0x' || substr(sha256(lower(c_name) || '|' || lower(c_mktsegment) || '|' || n_name), 1, 8))::BIGINT % 100)::INTEGER AS fold FROM customer JOIN nation ON c_nationkey = n_nationkey")
def scan_fold_hash(spark, d):
    x = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.select(F.col("c_custkey").alias("id"), records.fold(F.col("c_name"), F.col("c_mktsegment"), F.col("n_name")).alias("fold"))


@register("SELECT c_nationkey AS country, count(*) AS n, count(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY c_nationkey")
def agg_country_counts(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("country")).agg(F.count("*").alias("n"), F.countDistinct("c_mktsegment").alias("segments"))


@register("SELECT l_orderkey AS tid, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY l_orderkey HAVING count(*) > 1")
def agg_shared_targets_having(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tid"), "l_suppkey").distinct().groupBy("tid").agg(F.count("*").alias("n")).where("n > 1")


@register("SELECT o_orderkey AS rid, coalesce(c_custkey, -1) AS aid, coalesce(c_nationkey, -1) AS fold FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def join_left_labels(spark, d):
    good = table(spark, d, "customer").where("c_acctbal > 0")
    x = table(spark, d, "orders").join(good, F.col("o_custkey") == F.col("c_custkey"), "left")
    return x.select(F.col("o_orderkey").alias("rid"), F.coalesce("c_custkey", F.lit(-1)).alias("aid"), F.coalesce("c_nationkey", F.lit(-1)).alias("fold"))


@register("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_anti_orphans(spark, d):
    dear = table(spark, d, "orders").where("o_totalprice > 200000")
    return table(spark, d, "customer").join(dear, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"))


@register("SELECT l_orderkey AS tid, l_suppkey AS aid, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY l_orderkey, l_suppkey")
def join_cross_country_residual(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
    return x.groupBy(F.col("l_orderkey").alias("tid"), F.col("l_suppkey").alias("aid")).agg(F.count("*").alias("n"))


@register(f"SELECT tid, aid, p FROM ({PAIRS}) WHERE tid IN (SELECT tid FROM ({BEST}) WHERE p >= 0.2 AND p < 0.6)")
def filter_uncertain_band(spark, d):
    from matchloom.operators import decide

    x = pairs(spark, d)
    return decide.band(decide.best_two(x).select("tid", F.col("p").alias("q")), x, 0.2, 0.6)


@register(f"WITH x AS (SELECT tid, aid, row_number() OVER (PARTITION BY tid ORDER BY p DESC, aid) - 1 AS r, (tid * 2654435761 + aid * 2246822519) % 4294967291 AS h FROM ({PAIRS})) SELECT x.tid, x.aid FROM x LEFT JOIN ({TRUTH}) t ON x.tid = t.tid AND x.aid = t.aid WHERE t.tid IS NOT NULL OR (r = 0 AND h % 2 = 0) OR (r = 1 AND h % 8 = 0) OR h % 64 = 0")
def filter_hash_sample(spark, d):
    x = pairs(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("p"), "aid")) - 1)
    x = x.join(truth(spark, d).withColumn("y", F.lit(1)), ["tid", "aid"], "left")
    return x.where(learn.sampled(F.coalesce("y", F.lit(0)), F.col("r"), F.col("tid"), F.col("aid"))).select("tid", "aid")


@register(f"SELECT tid, aid, round(q, 6) AS q FROM (SELECT tid, aid, p * 0.7 / (p * 0.7 + 1 - p) AS q FROM ({PAIRS}))")
def project_odds_scaling(spark, d):
    return pairs(spark, d).select("tid", "aid", F.round(S.scale_odds(F.col("p"), 0.7), 6).alias("q"))


@register(BEST)
def window_best_two(spark, d):
    from matchloom.operators.decide import best_two

    return best_two(pairs(spark, d))


@register(f"SELECT tid, aid, p, coalesce(CASE WHEN r = 1 THEN max(CASE WHEN r = 2 THEN p END) OVER (PARTITION BY tid) ELSE max(CASE WHEN r = 1 THEN p END) OVER (PARTITION BY tid) END, -1.0) AS other FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY p DESC, aid) AS r FROM ({PAIRS}))")
def window_other_best(spark, d):
    from matchloom.operators.decide import other_best

    return other_best(pairs(spark, d), "p", "other")


@register(f"SELECT tid, aid, p, lag(p) OVER w AS before, lead(p) OVER w AS after, count(*) OVER (PARTITION BY tid) AS n FROM ({PAIRS}) WINDOW w AS (PARTITION BY tid ORDER BY p DESC, aid)")
def window_partner(spark, d):
    w = Window.partitionBy("tid").orderBy(F.desc("p"), "aid")
    return pairs(spark, d).select("tid", "aid", "p", F.lag("p").over(w).alias("before"), F.lead("p").over(w).alias("after"), F.count("*").over(Window.partitionBy("tid")).alias("n"))


@register("SELECT c_custkey AS id, c_acctbal AS v, row_number() OVER (ORDER BY c_custkey) - 1 AS rid FROM customer")
def window_file_order_ids(spark, d):
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return records.numbered(x, "id")


@register(f"SELECT aid, count(*) AS load, round(sum(p), 4) AS mass, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS sd FROM ({PAIRS}) GROUP BY aid")
def agg_anchor_load(spark, d):
    return pairs(spark, d).groupBy("aid").agg(F.count("*").alias("load"), F.round(F.sum("p"), 4).alias("mass"), F.round(F.avg("p"), 6).alias("mean"), F.round(F.stddev_samp("p"), 6).alias("sd"))


@register("SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr, round(quantile_cont(l_extendedprice, 0.5), 4) AS median FROM lineitem")
def agg_corr_median(spark, d):
    x = table(spark, d, "lineitem")
    corr, median = x.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr")), order.quantile(x, "l_extendedprice", 0.5)
    return corr.crossJoin(median.select(F.round("quantile", 4).alias("median")))  # single rows


@register("SELECT o_orderstatus AS status, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, count(*) FILTER (o_orderpriority LIKE '2%') AS high, count(*) FILTER (o_orderpriority LIKE '5%') AS low FROM orders GROUP BY o_orderstatus")
def agg_crosstab(spark, d):
    x = table(spark, d, "orders").withColumn("k", F.substring("o_orderpriority", 1, 1)).groupBy(F.col("o_orderstatus").alias("status")).pivot("k", ["1", "2", "5"]).count().na.fill(0)
    return x.select("status", F.col("1").alias("urgent"), F.col("2").alias("high"), F.col("5").alias("low"))


@register("SELECT least(floor(l_extendedprice / 10000), 11)::INTEGER AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def agg_histogram(spark, d):
    return table(spark, d, "lineitem").groupBy(F.least(F.floor(F.col("l_extendedprice") / 10000), F.lit(11)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@register("SELECT c_custkey AS source1_entity_id, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS matched_entity_ids FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def sink_match_lists(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("rid"), F.col("c_custkey").alias("entity_id"))
    links = table(spark, d, "orders").select(F.col("o_custkey").alias("source1_entity_id"), F.col("o_orderkey").alias("target_id"))
    return records.match_lines(a, links).select("source1_entity_id", "matched_entity_ids")


@register("""SELECT (SELECT count(*) FROM (SELECT o_custkey, o_orderkey FROM orders GROUP BY ALL HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(DISTINCT o_custkey) > 1)) AS shared,
 (SELECT count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey) AS orphan_anchor, (SELECT count(*) FROM orders ANTI JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey) AS orphan_target,
 (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey WHERE c_nationkey % 5 <> 1) AS cross_country""")
def audit_links(spark, d):
    links = table(spark, d, "orders").select(F.col("o_custkey").alias("source1_entity_id"), F.col("o_orderkey").alias("target_id"))
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), (F.col("c_nationkey") % 5).alias("country"))
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.lit(1).alias("country")).distinct()
    return records.link_audit(links, a, t)


@register("SELECT c_nationkey AS k, 'c' AS side FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
def set_union_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("side")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("side")))


@register(f"SELECT side, count(*) AS n FROM (SELECT CASE WHEN a.tid IS NULL THEN 'only_b' WHEN b.tid IS NULL THEN 'only_a' ELSE 'both' END AS side FROM (SELECT tid, aid FROM ({BEST})) a FULL JOIN ({TRUTH}) b ON a.tid = b.tid AND a.aid = b.aid) GROUP BY side")
def set_link_difference(spark, d):
    from matchloom.operators import decide, evaluate

    return evaluate.difference(decide.best_two(pairs(spark, d)), truth(spark, d))


@register("SELECT aid, pos, tid FROM (SELECT o_custkey AS aid, o_orderkey AS tid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders) WHERE pos <= 5")
def topk_per_anchor(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("aid"), F.row_number().over(w).alias("pos"), F.col("o_orderkey").alias("tid")).where("pos <= 5")


@register("SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, name LIMIT 10")
def topk_frequency(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10)
