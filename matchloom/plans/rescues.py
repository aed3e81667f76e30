"""Second routes and reports of matchloom.operators.rescues beside SQL: parts, orders, suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.operators import decide, rescues, rules
from matchloom.plans.common import DECISIONS, PAIRS, TRUTH, anchors, decisions, pairs, table, truth
from matchloom.plans.evidence_rules import _r
from matchloom.plans.linkage import scored_sql
from matchloom.plans.reports import SOME, SURE, _some, _sure
from matchloom.registry import register

#: Parts stand for anchors and, changed, for targets; n and m are the first house numbers of both.
DROPS = "SELECT p_partkey AS k, p_brand AS country, p_name, CASE p_partkey % 4 WHEN 0 THEN (p_partkey * 10 + p_size % 10)::VARCHAR WHEN 1 THEN p_partkey::VARCHAR WHEN 2 THEN '' ELSE '1' || p_partkey END AS n, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'ltd' ELSE 'inc' END AS legal, CASE p_partkey % 2 WHEN 0 THEN 'ltd' ELSE 'inc' END AS a_legal FROM part WHERE p_partkey > 0"


@register(f"WITH x AS ({DROPS}), u AS (SELECT country, p_name, min(k) AS aid FROM x GROUP BY ALL HAVING count(*) = 1) SELECT x.k AS tid, u.aid FROM x JOIN u USING (country, p_name) JOIN x a ON a.k = u.aid WHERE x.k % 11 > 0 AND x.n <> '' AND x.n <> u.aid::VARCHAR AND (contains(x.n, u.aid::VARCHAR) OR contains(u.aid::VARCHAR, x.n)) AND (x.legal = '' OR x.legal = a.a_legal)")
def rule_digit_drop(spark, d):
    """House numbers with a digit more or less, written with zeros and hyphens; the name has one anchor."""
    k = F.col("p_partkey")
    key = k.cast("string")
    p = table(spark, d, "part").where("p_partkey > 0").select(k.alias("id"), F.col("p_brand").alias("country"), F.col("p_name").alias("core"), "p_size")
    k, key = F.col("id"), F.col("id").cast("string")
    a = p.select("id", "country", "core", F.concat(F.lit("00"), key, F.lit(" rd, 5")).alias("address"), F.when(k % 2 == 0, "ltd").otherwise("inc").alias("legal"))
    number = F.when(k % 4 == 0, F.concat(key, (F.col("p_size") % 10).cast("string"))).when(k % 4 == 1, F.concat(F.lit("0"), key)).when(k % 4 == 2, "none").otherwise(F.concat(F.lit("1-"), key))
    t = p.select("id", "country", F.when(k % 11 == 0, "").otherwise(F.col("core")).alias("core"), F.concat(number, F.lit(", rd")).alias("address"), F.when(k % 3 == 0, "").when(k % 3 == 1, "ltd").otherwise("inc").alias("legal"))
    return rescues.digit_drop_pairs(t, a)


@register(f"WITH r AS (SELECT x.tid, (t.tid IS NOT NULL)::INTEGER AS ok, coalesce((l.aid = x.aid)::INTEGER, 0) AS there, l.tid IS NULL AS free FROM (SELECT tid, aid FROM ({PAIRS}) WHERE p >= 0.5) x LEFT JOIN ({SOME}) t ON t.tid = x.tid AND t.aid = x.aid LEFT JOIN ({SURE}) l ON l.tid = x.tid) SELECT 'all' AS scope, count(*) AS n, round(avg(ok), 6) AS precision, round(avg(there), 6) AS linked FROM r UNION ALL SELECT 'unlinked', count(*), round(avg(ok), 6), round(avg(there), 6) FROM r WHERE free")
def evaluate_residue(spark, d):
    return _r(rescues.residue(pairs(spark, d).where("p >= 0.5"), _sure(spark, d), _some(spark, d)), "scope", "n", precision=6, linked=6)


SIMS, GAPS = [0.3, 0.5], [0.0, 0.1]
CLEAR = f"SELECT tid, max(CASE WHEN r = 1 THEN aid END) AS aid, max(CASE WHEN r = 1 THEN p END) AS sim, max(CASE WHEN r = 1 THEN p END) - coalesce(max(CASE WHEN r = 2 THEN p END), 0) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY p DESC, aid) AS r FROM ({PAIRS})) GROUP BY tid"


def _clear(s: float, g: float) -> str:
    fired = f"SELECT tid, aid FROM ({CLEAR}) WHERE sim >= {s} AND gap >= {g}::DOUBLE AND tid NOT IN (SELECT tid FROM ({SURE}))"
    with_them = scored_sql(f"SELECT * FROM ({SURE}) UNION ALL {fired}")
    return f"SELECT {s}::DOUBLE AS sim, {g}::DOUBLE AS gap, (SELECT count(*) FROM ({fired})) AS fires, round((SELECT avg((t.tid IS NOT NULL)::INTEGER) FROM ({fired}) f LEFT JOIN ({TRUTH}) t ON t.tid = f.tid AND t.aid = f.aid), 6) AS precision, round((SELECT avg(f) FROM ({with_them})), 6) AS macro_f05"


@register(" UNION ALL ".join(_clear(s, g) for s in SIMS for g in GAPS))
def rule_clear_best_grid(spark, d):
    """Unlinked targets to their clear best: what each setting fires, its precision and the score with it."""
    x = rescues.clear_best_grid(pairs(spark, d).withColumnRenamed("p", "sim"), _sure(spark, d), truth(spark, d), anchors(spark, d), SIMS, GAPS)
    return _r(x, "sim", "gap", "fires", precision=6, macro_f05=6)


@register(f"""WITH x AS (SELECT tid, aid, p AS sim, CASE WHEN aid % 5 = 0 THEN 0.0 ELSE round(1 - p, 4) END AS ce FROM ({PAIRS})), y AS (SELECT *, row_number() OVER w - 1 AS rank, max(sim) OVER (PARTITION BY tid) AS best, coalesce(nth_value(sim, 2) OVER (PARTITION BY tid ORDER BY sim DESC, aid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS second,
 max(ce) OVER (PARTITION BY tid) - ce AS ce_gap, row_number() OVER (PARTITION BY tid ORDER BY ce DESC, aid) - 1 AS ce_rank, sum(ce) OVER (PARTITION BY tid) AS ce_sum FROM x WINDOW w AS (PARTITION BY tid ORDER BY sim DESC, aid))
 SELECT y.tid, y.aid, rank, ce_rank, round(sim, 5) AS sim, round(best - sim, 5) AS sim_gap, round(best - second, 5) AS lead, round(ce, 5) AS ce, round(ce_gap, 5) AS ce_gap, round(ce_sum, 5) AS ce_sum, round(q, 5) AS q, (d.aid = y.aid)::INTEGER AS same_as_top, coalesce(n, 0) AS load
 FROM y JOIN ({DECISIONS}) d ON d.tid = y.tid LEFT JOIN (SELECT aid, count(*) AS n FROM ({SURE}) GROUP BY aid) l ON l.aid = y.aid""")
def evidence_made_up(spark, d):
    """Eleven columns of address-only candidates; a fifth of the pairs has no second score."""
    ce = pairs(spark, d).where("aid % 5 <> 0").select("tid", "aid", F.round(1 - F.col("p"), 4).alias("score"))
    x = rescues.made_up_features(pairs(spark, d).withColumnRenamed("p", "sim"), decisions(spark, d), _sure(spark, d), ce)
    return _r(x, "tid", "aid", "rank", "ce_rank", "same_as_top", "load", sim=5, sim_gap=5, lead=5, ce=5, ce_gap=5, ce_sum=5, q=5)


#: c: the anchor's words, t: the target's, which lacks the first, a middle or the last word, or has them turned; legal words on either side.
DROPPED = "SELECT p_partkey AS id, string_split(p_name, ' ') || [lower(p_type), 'k' || p_size] AS c, CASE p_partkey % 5 WHEN 0 THEN c[2:4] WHEN 1 THEN c[1:3] WHEN 2 THEN [c[1], c[4]] WHEN 3 THEN [c[2], c[1]] ELSE [c[3]] END AS t, CASE p_partkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['ltd'] ELSE ['inc', 'co'] END AS lt, CASE p_partkey % 2 WHEN 0 THEN ['inc'] ELSE []::VARCHAR[] END AS la, p_name FROM part"


@register(f"""WITH x AS ({DROPPED}), y AS (SELECT *, list_filter(range(1, 5), lambda i: list_contains(t, c[i])) AS kept, list_filter(range(1, 5), lambda i: NOT list_contains(t, c[i])) AS gone FROM x), z AS (SELECT *, (len(kept) > 0 AND list_max(kept) - list_min(kept) + 1 = len(kept)) AS run, list_transform(gone, lambda i: len(c[i])::DOUBLE) AS w FROM y)
 SELECT id, len(gone)::DOUBLE AS dropped, 4::DOUBLE AS a_words, list_contains(gone, 1)::INTEGER::DOUBLE AS first_gone, list_contains(gone, 4)::INTEGER::DOUBLE AS last_gone, (list_contains(gone, 2) OR list_contains(gone, 3))::INTEGER::DOUBLE AS inner_gone, coalesce(list_sum(w), 0)::DOUBLE AS idf_sum, coalesce(list_max(w), 0)::DOUBLE AS idf_max, coalesce(list_min(w), 0)::DOUBLE AS idf_min,
 run::INTEGER::DOUBLE AS run, (run AND list_min(kept) = 1)::INTEGER::DOUBLE AS prefix, (list_transform(kept, lambda i: c[i]) = list_filter(t, lambda v: list_contains(c, v)))::INTEGER::DOUBLE AS in_order, (len(lt) > 0)::INTEGER::DOUBLE AS legal, (len(la) > 0)::INTEGER::DOUBLE AS a_legal, (lt = la)::INTEGER::DOUBLE AS same_legal, (len(list_intersect(lt, la)) > 0)::INTEGER::DOUBLE AS shared_legal, (4 + len(la))::DOUBLE AS a_all_words, len(p_name)::DOUBLE AS a_length FROM z""")
def evidence_word_drop(spark, d):
    """Seventeen columns about words that a name lacks; words weigh by their length here."""
    k = F.col("p_partkey")
    c = F.concat(F.split("p_name", " "), F.array(F.lower("p_type"), F.concat(F.lit("k"), F.col("p_size").cast("string"))))
    p = table(spark, d, "part").withColumn("c", c)
    w = F.when(k % 5 == 0, F.slice("c", 2, 3)).when(k % 5 == 1, F.slice("c", 1, 3)).when(k % 5 == 2, F.array(F.col("c")[0], F.col("c")[3])).when(k % 5 == 3, F.array(F.col("c")[1], F.col("c")[0])).otherwise(F.slice("c", 3, 1))
    tail = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("ltd"))).otherwise(F.array(F.lit("inc"), F.lit("co")))
    weights = F.map_from_entries(F.transform(F.array_distinct("c"), lambda v: F.struct(v, F.length(v).cast("double"))))
    p = p.withColumns({"t": F.concat(w, tail), "a": F.concat("c", F.when(k % 2 == 0, F.array(F.lit("inc"))).otherwise(F.array().cast("array<string>"))), "m": weights})
    return p.select(k.alias("id"), *(v.alias(n) for n, v in rescues.word_drop_features(F.col("t"), F.col("a"), F.col("p_name"), F.col("m")).items()))


@register(f"SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT tid FROM ({DECISIONS}) WHERE q >= 0.75)")
def filter_unsure(spark, d):
    """Targets without a link of three quarters."""
    return rescues.unsure(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), decisions(spark, d), _sure(spark, d), 0.75)


@register("""WITH t AS (SELECT p_partkey AS id, p_brand AS country, p_size % 3 = 0 AS blank, unnest(string_split(p_name, ' ')) AS word FROM part), g AS (SELECT id, country, blank, unnest(list_transform(range(1, len(word) + 1), lambda i: substr(' ' || word || ' ', i, 3))) AS w FROM t), tf AS (SELECT id, country, blank, w, 1 + ln(count(*)) AS tf FROM g GROUP BY ALL),
 idf AS (SELECT w, ln((1 + (SELECT count(*) FROM part)::DOUBLE) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY w HAVING count(*) <= greatest(1, floor(0.15 * (SELECT count(*) FROM part)))), v AS (SELECT id, country, blank, w, tf * idf AS v FROM tf JOIN idf USING (w)), u AS (SELECT v.id, country, blank, w, v / l AS v FROM v JOIN (SELECT id, sqrt(sum(v * v)) AS l FROM v GROUP BY id) n ON v.id = n.id)
 SELECT tid, count(*) AS n, round(max(sim), 5) AS best, round(sum(sim), 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY sim DESC, aid) AS r FROM (SELECT a.id AS tid, b.id AS aid, sum(a.v * b.v) AS sim FROM u a JOIN u b USING (country, w) WHERE a.blank GROUP BY ALL)) WHERE r <= 4 GROUP BY tid""")
def block_blank(spark, d):
    """Names of targets without an address by trigrams within words (compared by score: ties may go to another id)."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("country"), F.col("p_name").alias("core"), F.when(F.col("p_size") % 3 == 0, "").otherwise("x").alias("address"))
    return rescues.blank_blocks(p, p, 4, 0.15).groupBy("tid").agg(F.count("*").alias("n"), F.round(F.max("sim"), 5).alias("best"), F.round(F.sum("sim"), 4).alias("total"))


@register("""WITH p AS (SELECT p_partkey AS id, p_brand AS country, p_size % 10 AS number, p_size % 2 = 1 AS cut, list_distinct(list_transform(range(1, len(p_name) - 1), lambda i: substr(p_name, i, 3))) AS g, list_distinct([lower(p_type), 's' || p_size, 'rd']) AS w FROM part), r AS (SELECT country, number FROM p GROUP BY ALL HAVING count(*) <= 6),
 x AS (SELECT t.id AS tid, a.id AS aid, round(len(list_intersect(t.g, a.g)) / sqrt(len(t.g) * len(a.g)), 9) AS sim, len(list_intersect(t.w, a.w)) AS overlap FROM p t JOIN p a USING (country, number) JOIN r USING (country, number) WHERE t.cut), y AS (SELECT *, count(*) OVER (PARTITION BY tid) AS n_cand, row_number() OVER (PARTITION BY tid ORDER BY sim DESC, aid) AS near FROM x)
 SELECT tid, aid, round(sim, 6) AS sim, overlap, n_cand FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY round(sim + 0.02 * overlap, 9) DESC, aid) AS r FROM y WHERE near <= 3) WHERE r <= 2""")
def block_cut_off(spark, d):
    """Addresses that end with a state code: a common rare house number, then names, then address words."""
    g = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("p_name") - 2), lambda i: F.substr("p_name", i, F.lit(3))))
    number = F.array((F.col("p_size") % 10).cast("string"))
    words = F.array_distinct(F.array(F.lower("p_type"), F.concat(F.lit("s"), F.col("p_size").cast("string")), F.lit("rd")))
    raw = F.concat("p_type", F.when(F.col("p_size") % 2 == 1, ", MH ").otherwise(" MH"))
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("country"), number.alias("numbers"), g.alias("grams"), words.alias("address_words"), raw.alias("raw"))
    found = rescues.cut_off_blocks(x.where(rescues.cut_off(F.col("raw"))), x, 3, 2, 6)
    return _r(found.withColumn("overlap", F.col("overlap").cast("long")), "tid", "aid", "overlap", "n_cand", sim=6)


HINTS = {"first row": ("aid", "min"), "last row": ("aid", "max"), "smallest id": ("number", "min"), "largest id": ("number", "max"), "fewest linked": ("linked", "min"), "most linked": ("linked", "max"), "most true": ("true_", "max")}


@register(f"""WITH x AS (SELECT s_suppkey AS aid, s_suppkey % 3 AS core, s_suppkey * 37 % 101 AS number, (SELECT count(*) FROM ({SURE}) l WHERE l.aid = s_suppkey) AS linked, (SELECT count(*) FROM ({SOME}) t WHERE t.aid = s_suppkey) AS true_ FROM supplier),
 s AS (SELECT *, count(*) OVER (PARTITION BY core) AS n FROM x), m AS (SELECT t.tid, s.* FROM ({SOME}) t ANTI JOIN ({SURE}) l ON l.tid = t.tid AND l.aid = t.aid JOIN s ON s.aid = t.aid WHERE n > 1), h AS (""" + " UNION ALL ".join(f"SELECT '{h}' AS hint, CASE WHEN m.{c} = (SELECT {f}({c}) FROM x WHERE x.core = m.core) THEN 1 / (SELECT count(*) FROM x WHERE x.core = m.core AND x.{c} = m.{c}) ELSE 0 END AS hit FROM m" for h, (c, f) in HINTS.items()) + " UNION ALL SELECT 'random', 1 / n FROM m) SELECT hint, count(*) AS n, round(avg(hit), 6) AS hit FROM h GROUP BY hint")
def evaluate_namesake_hints(spark, d):
    k = F.col("s_suppkey")
    x = table(spark, d, "supplier").select(k.alias("aid"), (k % 3).alias("core"), (k * 37 % 101).alias("number"))
    missed = _some(spark, d).join(_sure(spark, d), ["tid", "aid"], "left_anti")
    return _r(rescues.namesake_hints(missed, x, _sure(spark, d), _some(spark, d)), "hint", "n", hit=6)


OPERATIONS = {"urgent": "o_orderpriority = '1-URGENT'", "finished": "o_orderstatus = 'F'", "dear": "o_totalprice > 300000"}


@register(f"WITH x AS (SELECT o.*, t.aid AS own, l.aid AS now FROM orders o LEFT JOIN ({SOME}) t ON t.tid = o_orderkey LEFT JOIN ({SURE}) l ON l.tid = o_orderkey), f AS (" + " UNION ALL ".join(f"SELECT '{k}' AS flag, own, now FROM x WHERE {v}" for k, v in OPERATIONS.items()) + ') SELECT flag, count(own) AS "true", count(*) FILTER (own IS NOT NULL AND now IS DISTINCT FROM own) AS missed, count(*) FILTER (now IS NOT NULL AND now IS DISTINCT FROM own) AS "false", round(count(*) FILTER (own IS NOT NULL AND now IS DISTINCT FROM own) / greatest(count(own), 1), 6) AS missed_share FROM f GROUP BY flag')
def report_errors_by_flag(spark, d):
    x = table(spark, d, "orders").withColumnRenamed("o_orderkey", "tid")
    return _r(rescues.errors_by_flag(x, {k: F.expr(v) for k, v in OPERATIONS.items()}, _sure(spark, d), _some(spark, d)), "flag", "true", "missed", "false", missed_share=6)


KEEP = "(label = 1 OR (rank = 0 AND h % 2 = 0) OR (rank = 1 AND h % 8 = 0) OR h % 64 = 0)"


@register(f"""WITH r AS (SELECT p.tid, p.aid, (t.tid IS NOT NULL)::INTEGER AS label, row_number() OVER (PARTITION BY p.tid ORDER BY p DESC, p.aid) - 1 AS rank, (p.tid * 2654435761 + p.aid * 2246822519) % 4294967291 AS h FROM ({PAIRS}) p LEFT JOIN ({TRUTH}) t ON t.tid = p.tid AND t.aid = p.aid)
 SELECT r.tid, r.aid, label, round(CASE WHEN r.tid % 4 = 0 THEN 0.5 ELSE 1 / sqrt(greatest(coalesce(n, 1), 1)) END, 6) AS weight FROM r LEFT JOIN (SELECT aid, count(*) AS n FROM ({TRUTH}) GROUP BY aid) s ON s.aid = r.aid WHERE {KEEP}""")
def learn_joint_rows(spark, d):
    """Labelled and pseudo-labelled pairs (here every fourth target's) under one sampling rule."""
    from pyspark.sql import Window

    true = truth(spark, d)
    x = pairs(spark, d).join(true.withColumn("label", F.lit(1)), ["tid", "aid"], "left").na.fill(0, ["label"])
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("p"), "aid")) - 1)
    sizes = true.groupBy("aid").agg(F.count("*").alias("truth"))
    return _r(rescues.joint_rows(x.where("tid % 4 <> 0"), x.where("tid % 4 = 0"), sizes), "tid", "aid", "label", weight=6)


ALIASES = "SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'name' ELSE 'address' END AS field, CASE WHEN p_size % 4 < 2 THEN string_split(p_name, ' ')[1] ELSE string_split(p_name, ' ')[2] END AS source, CASE WHEN p_size % 4 < 2 THEN string_split(p_name, ' ')[2] ELSE string_split(p_name, ' ')[1] END AS target FROM part WHERE p_partkey % 3 = 0"


@register(f"WITH x AS ({ALIASES}) SELECT x.*, 'QUARANTINE' AS decision, CASE WHEN y.field IS NOT NULL THEN 'cycle' WHEN x.field = 'address' AND x.source IN ('blue', 'cold') THEN 'unsafe' ELSE 'unproven' END AS reason, (y.field IS NOT NULL)::INTEGER AS cycle FROM x LEFT JOIN x y ON y.field = x.field AND y.source = x.target AND y.target = x.source")
def audit_aliases(spark, d):
    w, k = F.split("p_name", " "), F.col("p_size")
    x = table(spark, d, "part").where("p_partkey % 3 = 0").select(F.when(k % 2 == 0, "name").otherwise("address").alias("field"), F.when(k % 4 < 2, w[0]).otherwise(w[1]).alias("source"), F.when(k % 4 < 2, w[1]).otherwise(w[0]).alias("target")).distinct()
    return rescues.dispositions(x, ["blue", "cold"])


@register("WITH p AS (SELECT p_partkey, p_size, unnest([{'w': string_split(p_name, ' ')[1], 'i': 1}, {'w': string_split(p_name, ' ')[2], 'i': 2}]) AS s FROM part), x AS (SELECT replace(s.w, 'l', 'll') AS source, CASE WHEN s.i = 1 AND p_size % len(s.w) < 2 THEN s.w || 'x' ELSE s.w END AS target FROM p), g AS (SELECT source, target, count(*) AS n FROM x WHERE source <> target GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS r, sum(n) OVER (PARTITION BY source) AS every FROM g) SELECT source, target, n FROM r WHERE r = 1 AND n >= 3 AND n >= 0.6 * every")
def learn_tokens(spark, d):
    """Usual translations of words that are spelled with doubled letters."""
    w = F.split("p_name", " ")
    first = F.when(F.col("p_size") % F.length(w[0]) < 2, F.concat(w[0], F.lit("x"))).otherwise(w[0])
    x = table(spark, d, "part").select(F.replace("p_name", F.lit("l"), F.lit("ll")).alias("core"), F.concat_ws(" ", first, w[1]).alias("a_core"))
    return rescues.learned_tokens(x)


GONE = "aid % 4 = 1"


@register(f"""WITH alive AS (SELECT tid, max(CASE WHEN r = 1 THEN aid END) AS aid, max(CASE WHEN r = 1 THEN p END) AS p FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY p DESC, aid) AS r FROM ({PAIRS}) WHERE NOT ({GONE}) AND p >= 0.4) GROUP BY tid), late AS (SELECT tid, aid, p / 2 AS q FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY p, aid) AS r FROM ({PAIRS})) WHERE r = 1 AND NOT ({GONE}))
 SELECT d.tid, CASE WHEN {GONE.replace('aid', 'd.aid')} THEN coalesce(a.aid, l.aid, -1) ELSE d.aid END AS aid, round(CASE WHEN {GONE.replace('aid', 'd.aid')} THEN coalesce(a.p, l.q, 0) ELSE d.q END, 6) AS q, round(CASE WHEN {GONE.replace('aid', 'd.aid')} AND coalesce(a.aid, l.aid) IS NOT NULL THEN 1 ELSE d.margin END, 6) AS margin FROM ({DECISIONS}) d LEFT JOIN alive a ON a.tid = d.tid LEFT JOIN late l ON l.tid = d.tid""")
def decide_thinned(spark, d):
    """A world without a quarter of the anchors: best surviving candidate, else the runner-up with its calibrated score."""
    from pyspark.sql import Window

    late = pairs(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("tid").orderBy("p", "aid"))).where("r = 1").select("tid", "aid", (F.col("p") / 2).alias("q"))
    return _r(decide.thinned(decisions(spark, d), pairs(spark, d).where("p >= 0.4"), F.expr(GONE), late), "tid", "aid", q=6, margin=6)


@register("WITH p AS (SELECT p_partkey AS id, string_split(p_name, ' ') || [lower(p_type)] AS w FROM part) SELECT DISTINCT id, list_reduce(list_transform(range(1, i), lambda j: substr(v[j], 1, 1)) || v[i:3], lambda a, b: a || b) AS key FROM (SELECT id, w[r:3] || w[1:r - 1] AS v, i FROM p, (SELECT unnest([1, 2, 3]) AS r), (SELECT unnest([1, 2, 3]) AS i))")
def rule_domain_keys(spark, d):
    """Rotations with any number of leading words as initials; a legal word at the end makes no other keys than its absence and presence."""
    words = F.concat(F.split("p_name", " "), F.array(F.lower("p_type")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(rules.domain_keys(words)).alias("key"))


@register("SELECT p_partkey AS id, p_name || ' private limited' AS name_norm, string_split(p_name, ' ')[1] || ' ' || string_split(p_name, ' ')[2] AS name_core, p_size || ' main rd no 7 ' || CASE WHEN p_size % 2 = 0 THEN 'ny' ELSE 'ca' END || ' 1st fl' AS address_norm FROM part")
def views_1(spark, d):
    """The first normaliser: its own aliases, states in one or more words, ordinals, legal and small words anywhere."""
    place = F.when(F.col("p_size") % 2 == 0, "NEW  York").otherwise("Califórnia")
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.initcap("p_name"), F.lit(" Pvt. Ltd")).alias("business_name"), F.concat(F.col("p_size").cast("string"), F.lit(" Main Road Number ７, "), place, F.lit(", First-Floor")).alias("business_address"))
    return T.first_views(x).select("id", "name_norm", "name_core", "address_norm")
