"""Evaluation, audits and reports beside SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.operators import decide, evaluate
from matchloom.plans.common import BEST, DECISIONS, PAIRS, TRUTH, anchors, decisions, pairs, table, truth
from matchloom.plans.evidence_rules import TARGETS, _targets
from matchloom.plans.linkage import SUMMARY, _rounded, scored_sql
from matchloom.registry import register

#: Truth of two orders in three: the others have no owner.
SOME = f"SELECT tid, aid FROM ({TRUTH}) WHERE tid % 3 > 0"
SURE = f"SELECT tid, aid FROM ({DECISIONS}) WHERE q >= 0.7"


def _sure(spark, d):
    return decide.threshold(decisions(spark, d), 0.7).select("tid", "aid")


def _some(spark, d):
    return truth(spark, d).where("tid % 3 > 0")


@register(f"SELECT '4+' AS slice, {SUMMARY} FROM ({scored_sql(BEST)}) WHERE truth > 3 GROUP BY 1 UNION ALL SELECT CASE WHEN truth = 0 THEN '0' WHEN truth = 1 THEN '1' ELSE '2-3' END, {SUMMARY} FROM ({scored_sql(BEST)}) WHERE truth <= 3 GROUP BY 1")
def evaluate_slices(spark, d):
    """By number of true links."""
    return _rounded(evaluate.slices(evaluate.per_anchor(anchors(spark, d), decide.best_two(pairs(spark, d)), truth(spark, d))), "slice")


@register(f"WITH r AS (SELECT x.tid, x.aid, (t.tid IS NOT NULL)::INTEGER AS ok, (l.tid IS NULL) AS free FROM (SELECT tid, aid FROM ({PAIRS}) WHERE p >= 0.5) x LEFT JOIN ({SOME}) t ON t.tid = x.tid AND t.aid = x.aid LEFT JOIN ({SURE}) l ON l.tid = x.tid) SELECT 'all' AS scope, count(*) AS n, round(avg(ok), 6) AS precision FROM r UNION ALL SELECT 'unlinked', count(*), round(avg(ok), 6) FROM r WHERE free")
def evaluate_rule_gate(spark, d):
    """Precision of a rule on all of its pairs, and on targets that are not linked yet."""
    x = evaluate.rule_gate(_sure(spark, d), pairs(spark, d).where("p >= 0.5"), _some(spark, d))
    return x.select("scope", "n", F.round("precision", 6).alias("precision"))


@register(f"SELECT {SUMMARY} FROM ({scored_sql(f'SELECT p.tid, p.aid FROM ({PAIRS}) p JOIN ({TRUTH}) t ON t.tid = p.tid AND t.aid = p.aid WHERE p.p >= 0.3')})")
def evaluate_oracle_ceiling(spark, d):
    """What a perfect choice among the candidates would score."""
    return _rounded(evaluate.oracle_ceiling(anchors(spark, d), pairs(spark, d).where("p >= 0.3"), truth(spark, d)))


@register(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY p DESC, aid) - 1 AS position, count(*) OVER (PARTITION BY tid) AS c FROM ({PAIRS}) WHERE p >= 0.2), s AS (SELECT tid, max(c) AS c FROM r GROUP BY tid) SELECT coalesce(position, -1) AS position, count(*) AS n, round(avg(coalesce(s.c, 0)), 6) AS candidates FROM ({TRUTH}) t LEFT JOIN r ON r.tid = t.tid AND r.aid = t.aid LEFT JOIN s ON s.tid = t.tid GROUP BY 1")
def evaluate_rank_histogram(spark, d):
    x = pairs(spark, d).where("p >= 0.2").withColumn("position", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("p"), "aid")) - 1)
    return evaluate.rank_histogram(x, truth(spark, d)).select("position", "n", F.round("candidates", 6).alias("candidates"))


@register("SELECT count(*) AS places, count(*) FILTER (b.k IS NULL) AS only_a, count(*) FILTER (a.k IS NULL) AS only_b, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL AND a.v <> b.v) AS changed FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 10 > 0) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 15 > 0) b ON a.k = b.k")
def audit_places(spark, d):
    """Two files side by side, place by place."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return evaluate.out_of_place(c.where("k % 10 > 0"), c.where("k % 15 > 0").withColumn("v", F.when(F.col("k") % 4 == 0, "x").otherwise(F.col("v"))), "k", "v")


@register(f"SELECT d.tid, d.aid, round(p, 6) AS p FROM ({DECISIONS}) d JOIN ({PAIRS}) x ON x.tid = d.tid AND x.aid = d.aid")
def audit_looked_up(spark, d):
    """Every decision finds its score; one without would fail the query."""
    x = evaluate.looked_up(decisions(spark, d).select("tid", "aid"), pairs(spark, d), "p")
    return x.select("tid", "aid", F.round("p", 6).alias("p"))


@register(f"SELECT 'retrieved' AS stage, count(*) AS pairs, 0 AS missing, 0 AS extra FROM ({PAIRS}) UNION ALL SELECT 'scored', count(*) FILTER (tid % 9 > 0) + 1, count(*) FILTER (tid % 9 = 0), 1 FROM ({PAIRS}) UNION ALL SELECT 'written', count(*), 0, 0 FROM ({PAIRS})")
def audit_stages(spark, d):
    """Retrieved, scored and written pairs as sets (the scored ones lack some here and have one that is none)."""
    x = pairs(spark, d).select("tid", "aid")
    odd = x.where("tid % 9 > 0").unionByName(spark.range(1).select(F.lit(-5).cast("long").alias("tid"), F.lit(-5).cast("long").alias("aid")))
    out = evaluate.set_audit({"retrieved": x, "scored": odd, "written": x.unionByName(x.where("tid % 4 = 0"))})
    return out.select("stage", "pairs", F.col("missing").cast("long").alias("missing"), F.col("extra").cast("long").alias("extra"))


NAMED = f"SELECT t.tid, s_suppkey AS aid, t.core, t.address, 'n' || s_suppkey % 40 AS a_core, 'a' || s_suppkey % 60 AS a_address FROM ({TARGETS}) t JOIN (SELECT DISTINCT tid, aid FROM ({PAIRS})) p ON p.tid = t.tid JOIN supplier ON s_suppkey = p.aid"


@register(f"""WITH a AS ({SURE}), b AS (SELECT tid, CASE WHEN tid % 5 = 0 THEN aid2 ELSE aid END AS aid FROM ({BEST}) WHERE aid2 >= 0 AND p >= 0.6), x AS (SELECT coalesce(a.tid, b.tid) AS tid, a.aid AS a, b.aid AS b FROM a FULL JOIN b ON a.tid = b.tid WHERE a.aid IS DISTINCT FROM b.aid)
 SELECT CASE WHEN b IS NULL THEN 'only a links' WHEN a IS NULL THEN 'only b links' ELSE 'other anchor' END AS pattern, CASE WHEN address = '' THEN 'no address' WHEN core = a_core AND address = a_address THEN 'same name and address' WHEN core = a_core THEN 'same name' WHEN address = a_address THEN 'same address' ELSE 'both differ' END AS slice,
 count(*) AS n, round(avg((a IS NOT DISTINCT FROM t.aid)::INTEGER), 6) AS a_right, round(avg((b IS NOT DISTINCT FROM t.aid)::INTEGER), 6) AS b_right FROM x JOIN ({NAMED}) n ON n.tid = x.tid AND n.aid = coalesce(b, a) LEFT JOIN ({SOME}) t ON t.tid = x.tid GROUP BY ALL""")
def evaluate_disagreement(spark, d):
    b = decide.best_two(pairs(spark, d)).where("aid2 >= 0 AND p >= 0.6").select("tid", F.when(F.col("tid") % 5 == 0, F.col("aid2")).otherwise(F.col("aid")).alias("aid"))
    k = F.col("aid")
    named = pairs(spark, d).select("tid", "aid").join(_targets(spark, d).select("tid", "core", "address"), "tid").withColumns({"a_core": F.concat(F.lit("n"), (k % 40).cast("string")), "a_address": F.concat(F.lit("a"), (k % 60).cast("string"))})
    x = evaluate.disagreement(_sure(spark, d), b, _some(spark, d), named)
    return x.select("pattern", "slice", "n", F.round("a_right", 6).alias("a_right"), F.round("b_right", 6).alias("b_right"))


FLAGS = {"heavy": "l_quantity > 25", "cheap": "l_discount > 0.05", "late": "l_linenumber > 3"}


@register("WITH x AS (SELECT (l_returnflag = 'R')::INTEGER AS y, *  FROM lineitem), f AS (" + " UNION ALL ".join(f"SELECT '{k}' AS flag, y, ({v})::INTEGER AS f FROM x" for k, v in FLAGS.items()) + ") SELECT flag, sum(f)::BIGINT AS n, round(sum(f * y) / sum(f), 6) AS rate, round(((sum(f * y) + 0.5) / (sum(f * (1 - y)) + 0.5)) / ((sum((1 - f) * y) + 0.5) / (sum((1 - f) * (1 - y)) + 0.5)), 5) AS odds FROM f GROUP BY flag")
def evaluate_flag_table(spark, d):
    """How often each flag holds, the rate of ones where it does, and the odds ratio to the rest."""
    x = table(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return evaluate.flag_table(x, {k: F.expr(v) for k, v in FLAGS.items()}, "y").select("flag", "n", F.round("rate", 6).alias("rate"), F.round("odds", 5).alias("odds"))


@register(" UNION ALL ".join(f"SELECT '{k}' AS flag, round(avg(({v})::INTEGER) FILTER (l_shipmode = 'AIR'), 6) AS real, round(avg(({v})::INTEGER) FILTER (l_shipmode <> 'AIR'), 6) AS made, round(avg(({v})::INTEGER) FILTER (l_shipmode <> 'AIR') / avg(({v})::INTEGER) FILTER (l_shipmode = 'AIR'), 5) AS ratio FROM (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN 'AIR' ELSE 'SEA' END AS l_shipmode FROM (SELECT l_orderkey, l_quantity, l_discount, l_linenumber FROM lineitem))" for k, v in FLAGS.items()))
def evaluate_fidelity(spark, d):
    """Rates of flags in one set of records against another."""
    x = table(spark, d, "lineitem")
    out = evaluate.fidelity(x.where("l_orderkey % 3 = 0"), x.where("l_orderkey % 3 <> 0"), {k: F.expr(v) for k, v in FLAGS.items()})
    return out.select("flag", F.round("real", 6).alias("real"), F.round("made", 6).alias("made"), F.round("ratio", 5).alias("ratio"))


PLACES = "SELECT p_brand AS country, p_name AS name, CASE WHEN p_size % 7 = 0 THEN ' ' ELSE p_type END AS address FROM part"


@register(f"""WITH r AS ({PLACES}) SELECT country, 'records' AS section, 'all' AS key, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT country, 'name_words', least(len(string_split(name, ' ')), 8)::VARCHAR, count(*) FROM r GROUP BY ALL UNION ALL SELECT country, 'script', 'other', count(*) FROM r GROUP BY ALL
 UNION ALL SELECT country, 'address', CASE WHEN trim(address) = '' THEN 'missing' ELSE 'present' END, count(*) FROM r GROUP BY ALL UNION ALL SELECT country, 'namesakes', least(c, 5)::VARCHAR, count(*) FROM (SELECT country, name, count(*) AS c FROM r GROUP BY ALL) GROUP BY ALL""")
def report_statistics(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("country"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("p_type")).alias("address"))
    return evaluate.statistics(p)


LINES = "SELECT s_suppkey AS a, CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN s_suppkey::VARCHAR ELSE s_suppkey || ',' || (s_suppkey + 1) END AS ids FROM supplier WHERE s_suppkey % 9 > 0"


@register(f"WITH l AS ({LINES}), i AS (SELECT a, unnest(string_split(ids, ',')) AS t FROM l WHERE ids <> '') SELECT (SELECT count(*) FROM supplier ANTI JOIN l ON s_suppkey = a) AS missing_anchor, 0::BIGINT AS unknown_anchor, 0::BIGINT AS repeated_anchor, (SELECT count(*) FROM i ANTI JOIN customer ON c_custkey::VARCHAR = t AND c_custkey % 10 > 0) AS unknown_target, (SELECT count(*) FROM (SELECT t FROM i GROUP BY t HAVING count(*) > 1)) AS repeated_target")
def audit_output(spark, d):
    """Coverage, known ids and no target twice, of a written list table."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("entity_id"), "s_suppkey")
    k = F.col("s_suppkey")
    lines = s.where("s_suppkey % 9 > 0").select(F.col("entity_id").alias("source1_entity_id"), F.when(k % 5 == 0, "").when(k % 5 == 1, k.cast("string")).otherwise(F.concat_ws(",", k.cast("string"), (k + 1).cast("string"))).alias("matched_entity_ids"))
    t = table(spark, d, "customer").where("c_custkey % 10 > 0").select(F.col("c_custkey").cast("string").alias("entity_id"))
    return evaluate.output_audit(s, lines, t)


@register(f"SELECT count(*) FILTER (tid % 11 = 0 OR tid % 13 = 0) AS violations, count(*) AS n FROM ({DECISIONS})")
def audit_lineage(spark, d):
    """Probabilities that cannot be derived again: changed ones and lost ones."""
    own = decisions(spark, d).select("tid", "aid", "q")
    again = own.where("tid % 13 <> 0").withColumn("q", F.when(F.col("tid") % 11 == 0, F.col("q") + 0.01).otherwise(F.col("q")))
    return evaluate.lineage(own, again).select(F.col("violations").cast("long").alias("violations"), "n")


@register(f"WITH l AS ({SURE}), t AS ({TRUTH}), f AS (SELECT l.* FROM l JOIN t ON t.tid = l.tid AND t.aid = l.aid), w AS (SELECT l.* FROM l ANTI JOIN f ON f.tid = l.tid AND f.aid = l.aid) SELECT 'false links' AS cause, round((SELECT avg(f) FROM ({scored_sql('SELECT * FROM f')})) - (SELECT avg(f) FROM ({scored_sql('SELECT * FROM l')})), 6) AS gain UNION ALL SELECT 'lost links', round((SELECT avg(f) FROM ({scored_sql('SELECT * FROM l UNION SELECT * FROM t')})) - (SELECT avg(f) FROM ({scored_sql('SELECT * FROM l')})), 6)")
def evaluate_gain_if_fixed(spark, d):
    links, true = _sure(spark, d), truth(spark, d)
    false = links.join(true, ["tid", "aid"], "left_anti")
    x = evaluate.gain_if_fixed(anchors(spark, d), links, true, {"false links": (links.limit(0), false), "lost links": (true, links.limit(0))})
    return x.select("cause", F.round("gain", 6).alias("gain"))


@register("SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 25")
def topk_offset(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(25).limit(40).select(F.col("o_orderkey").alias("id"))


@register("SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey >= 7")
def filter_parameters(spark, d):
    """A prepared statement: values are bound, not pasted."""
    return spark.sql("SELECT c_custkey AS id, c_acctbal AS v FROM {customer} WHERE c_mktsegment = :segment AND c_nationkey >= :least", args={"segment": "BUILDING", "least": 7}, customer=table(spark, d, "customer"))


ODDS = (0.5, 1.0, 2.0)


@register(" UNION ALL ".join(f"SELECT {o}::DOUBLE AS odds, count(*) AS links, round(avg(q), 6) AS mean FROM (SELECT q * {o} / (q * {o} + 1 - q) AS q FROM ({DECISIONS})) WHERE q >= 0.5" for o in ODDS))
def report_odds_sweep(spark, d):
    """Links and their mean probability under scaled odds, all settings in one plan."""
    from matchloom.functions.similarity import scale_odds

    x = decisions(spark, d).withColumn("odds", F.explode(F.array(*map(F.lit, ODDS)))).withColumn("q", scale_odds(F.col("q"), F.col("odds")))
    return x.where("q >= 0.5").groupBy("odds").agg(F.count("*").alias("links"), F.round(F.avg("q"), 6).alias("mean"))


@register(f"SELECT CASE WHEN p_size % 7 = 0 THEN 'missing' ELSE 'present' END AS address, count(*) AS links, count(*) FILTER (n <= 5) AS reached FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part) GROUP BY 1")
def report_block_recall(spark, d):
    """Links that the house-number route can reach, by presence of an address: each part with itself."""
    from matchloom.operators import rules

    p = table(spark, d, "part")
    x = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("country"), F.array(F.col("p_size").cast("string")).alias("numbers"))
    found = rules.number_blocks(x, x, 5).where("tid = aid").select(F.col("tid").alias("p_partkey"), F.lit(1).alias("hit"))
    part = F.when(F.col("p_size") % 7 == 0, "missing").otherwise("present")
    return p.join(found, "p_partkey", "left").groupBy(part.alias("address")).agg(F.count("*").alias("links"), F.count("hit").alias("reached"))

