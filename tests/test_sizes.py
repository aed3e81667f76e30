"""Large groups of copies: work that grows with the square of a group is cut off by a clock and fails."""

import functools
import math
import re
import threading
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom import registry
from matchloom.operators import blocking, record_pairs, rescues, retrieval, sparse, vectors


def within(spark, seconds, f):
    """What f gives; its jobs are cancelled after so many seconds."""
    spark.sparkContext.setJobGroup("within", "within", True)
    clock = threading.Timer(seconds, lambda: spark.sparkContext.cancelJobGroup("within"))
    clock.start()
    try:
        return f()
    finally:
        clock.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def plain_top_k(targets, anchors, k, most):
    """{tid: [(aid, sim)]} by loops over (id, country, tokens)."""
    df = Counter(w for _, _, ws in anchors for w in set(ws))
    idf = {w: math.log((1 + len(anchors)) / (1 + n)) + 1 for w, n in df.items() if n <= max(1, int(most * len(anchors)))}

    def vector(ws):
        v = {w: (1 + math.log(n)) * idf[w] for w, n in Counter(ws).items() if w in idf}
        return {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}

    out = {}
    for t, c, ws in targets:
        sims = [(a, sum(x * vector(us).get(w, 0) for w, x in vector(ws).items())) for a, d, us in anchors if c == d and set(vector(ws)) & set(vector(us))]
        if sims:
            out[t] = sorted(sims, key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return out


def test_names_by_tfidf_with_copies(spark):
    words = ["red bolt", "bolt red", "red red bolt", "blue rod", "blue bolt", "", "old gear"]
    rows = [(i, "XY"[i % 3 == 0], words[(i * i + i // 5) % 7].split()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, country string, tokens array<string>")
    got = {}
    for r in blocking.tfidf_top_k(df.where("id % 2 = 0"), df, 4, 0.7).collect():
        got.setdefault(r.tid, []).append((r.aid, r.sim))
    want = plain_top_k([r for r in rows if r[0] % 2 == 0], rows, 4, 0.7)
    assert set(got) == set(want)
    for t, found in got.items():
        assert [a for a, _ in sorted(found, key=lambda x: (-round(x[1], 9), x[0]))] == [a for a, _ in want[t]]
        assert sorted(s for _, s in found) == pytest.approx(sorted(s for _, s in want[t]))


def test_names_without_address_in_large_groups(spark):
    rows = spark.range(60_000).select("id", F.lit("X").alias("country"), F.when(F.col("id") < 20_000, "red bolt").otherwise(F.concat(F.lit("n"), F.col("id").cast("string"))).alias("core"), F.lit("").alias("address"))
    found = rescues.blank_blocks(rows.where("id < 20000"), rows, 4, 0.5)
    assert within(spark, 60, lambda: found.agg(F.count("*"), F.max("aid"), F.countDistinct("tid")).first()) == (80_000, 3, 20_000)


def test_tokens_in_large_groups(spark):
    rows = spark.range(20_000).select("id", F.lit("X").alias("country"), F.when(F.col("id") % 2 == 0, F.array(F.lit("red"), F.lit("bolt"))).otherwise(F.array(F.lit("bolt"), F.lit("rod"))).alias("tokens"))
    found = blocking.tfidf_top_k(rows, rows, 3, 1.0).groupBy("tid").agg(F.max("aid").alias("last"))
    got = within(spark, 60, lambda: found.groupBy(F.col("tid") % 2, "last").count().collect())
    assert sorted(tuple(r) for r in got) == [(0, 4, 10_000), (1, 5, 10_000)]


def plain_nearest(queries, base, k):
    """{tid: [(aid, cos)]} by loops over (id, part, embedding); NaN first, null last."""

    def cosine(x, y):
        if x is None or y is None or len(x) != len(y) or None in x or None in y:
            return None
        dot = lambda p, q: functools.reduce(lambda s, ab: s + ab[0] * ab[1], zip(p, q), 0.0)
        length = math.sqrt(dot(x, x) * dot(y, y))
        return 0.0 if length == 0 else c if math.isnan(c := dot(x, y) / length) else max(-1.0, min(1.0, c))

    place = lambda c: (2, 0) if c is None else (0, 0) if math.isnan(c) else (1, -c)
    out = {}
    for t, p, x in queries:
        found = sorted(((a, cosine(x, y)) for a, q, y in base if p == q and a != t), key=lambda f: (place(f[1]), f[0]))[:k]
        out |= {t: found} if found else {}
    return out


@pytest.mark.parametrize("block", [8_192, 7])
def test_nearest_vectors_with_copies_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    odd = {3: None, 17: [1.0, None, 2.0], 31: [0.0, 0.0, 0.0], 45: [1.0, 2.0], 46: [2.0, 1.0], 59: [], 60: [math.nan, 1.0, 2.0], 61: [1e-30, 2e-30, 3e-30], 62: None}
    rows = [(i, None if i == 80 else i % 3, odd.get(i, [float(i * i % 5 - 2), 0.1 * (i % 4) + 0.3, 0.7 * (1 + i % 2)] if i % 5 else [0.3 * i, 0.1 * i, 0.7 * i])) for i in range(90)] + [(91, 7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "id long, part int, embedding array<double>")
    for asked in (df, df.where("id % 4 = 1")):
        got = {}
        for r in blocking.vector_top_k(asked, df, 4).collect():
            got.setdefault(r.tid, []).append((r.aid, r.cos))
        base = [r for r in rows if r[1] is not None]
        want = plain_nearest([r for r in base if asked is df or r[0] % 4 == 1], base, 4)
        assert {t: sorted(map(str, f)) for t, f in got.items()} == {t: sorted(map(str, f)) for t, f in want.items()}


def test_nearest_vectors_of_a_large_partition(spark):
    x = spark.range(12_000).select("id", F.lit(1).alias("part"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.greatest(F.col("id"), F.lit(4_000)) * i)).alias("embedding"))
    found = blocking.vector_top_k(x, x, 4)
    got = within(spark, 60, lambda: found.agg(F.count("*"), F.max(F.when(F.col("tid") < 4_000, F.col("aid")))).first())
    assert got == (48_000, 4)


def above_pairs(spark, name):
    """The part of a query's optimised plan that works on every pair of records."""
    lines = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    return "\n".join(lines[: next((i for i, x in enumerate(lines) if "Generate inline" in x), len(lines))])


@pytest.mark.parametrize("name, costly", [("rule_decoy_signature", "array_sort|array_except"), ("rule_offset_and_swap", "zip_with|zipwith|array_except"), ("rule_kill_switch", "array_intersect"), ("fn_edit_similarity", "levenshtein"), ("fn_token_similarities", "array_intersect")])
def test_words_are_compared_once_per_pair_of_names(spark, name, costly):
    assert not re.search(costly, above_pairs(spark, name), re.I)


def test_containment_of_copies(spark):
    t = spark.range(40_000).select("id", F.lit("X").alias("country"), F.array(F.lit("a"), F.lit("b")).alias("words"))
    a = spark.range(4_000).select("id", F.lit("X").alias("country"), F.array(F.lit("a"), F.when(F.col("id") < 3, "b").otherwise("c")).alias("words"))
    got = within(spark, 20, lambda: blocking.containment(t, a).groupBy("aid").count().collect())
    assert sorted(tuple(r) for r in got) == [(i, 40_000) for i in range(3)]


@pytest.mark.parametrize("listed", [4_096, 7])
def test_containment_in_many_anchors(spark, monkeypatch, listed):
    monkeypatch.setattr(blocking, "LISTED", listed)
    words = lambda *xs: F.array(*(F.lit(x) for x in xs))
    t = spark.range(50).select("id", F.lit("X").alias("country"), F.when(F.col("id") == 7, words("b", "c")).otherwise(words("a", "b")).alias("words"))
    a = spark.range(200).select("id", F.lit("X").alias("country"), F.when(F.col("id") == 9, words("b", "c")).when(F.col("id") % 2 == 0, words("a", "b")).otherwise(words("a", "c")).alias("words"))
    got = sorted((r.tid, r.aid) for r in blocking.containment(t, a).collect())
    assert got == [(t, a) for t in range(50) if t != 7 for a in range(0, 200, 2)]


def test_candidates_of_copies(spark):
    x = spark.range(9_000).select("id", F.lit("X").alias("country"), F.lit("red bolt").alias("core"), F.lit("12 large rd").alias("address"), F.lit("red bolt").alias("phonetic"), F.lit(0).alias("missing"))
    found = blocking.candidates(x, x).agg(F.count("*"), F.max("aid"), F.countDistinct("tid"), F.max("margin"))
    assert within(spark, 60, found.first) == (72_000, 7, 9_000, 0.0)


@pytest.mark.parametrize("asked, held, rare", [(1_024, 16_384, 256), (7, 5, 256), (7, 50, 2), (30, 5, 1)])
def test_candidates_in_small_chunks(spark, monkeypatch, asked, held, rare):
    for name, n in (("ASKED", asked), ("HELD", held), ("RARE", rare)):
        monkeypatch.setattr(retrieval, name, n)
    words = ["red bolt", "bolt red", "red rod", "blue rod", "blue bolt 7", "", "old gear"]
    rows = [(i * 7 % 121, "XY"[i % 3 == 0] if i != 40 else None, f"{words[(i * i + i // 5) % 7]} {i % 11}".strip(), ["", "12 large rd", f"{i % 5} small rd"][i % 3 * (i % 2)], words[i % 7]) for i in range(121)]
    rows += [(i + 200, *r[1:]) for i, r in enumerate(rows[::3])]
    x = spark.createDataFrame(rows, "id long, country string, core string, address string, phonetic string").withColumn("missing", (F.col("address") == "").cast("int"))
    config = blocking.Config(cap=90, preliminary=5, routes=2, keep=3)
    t, a = x.where("id % 2 = 0"), x
    got = blocking.candidates(a, t, None, config)
    terms, lists = blocking.postings(blocking.keys(a), a.count(), config)
    pairs = blocking.preliminary(blocking.scores(blocking.chosen_terms(blocking.keys(t), terms, config), lists, config), config)
    pairs = pairs.drop("rank", "n", "a").join(blocking.ready(a, "aid", "a"), "aid").join(blocking.ready(t, "tid", "q"), "tid")
    want = blocking.final(blocking.filter_rank(pairs).withColumn("missing", F.col("q.missing")).drop("a", "q"), None, config)
    of = lambda df: sorted((r.tid, r.aid, r.position, round(r.rank, 9), round(r.ns, 9), round(r.ads, 9), r.near_identical) for r in df.collect())
    assert len(want.collect()) > 150 and of(got) == of(want)


@pytest.mark.parametrize("name", ["features_names", "pair_features_63"])
def test_features_are_made_once_per_pair_of_kinds(spark, name):
    lines = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = [next(i for i, x in enumerate(lines) if w in x) for w in ("Join", "levenshtein")]
    assert at[0] < at[1] and any("Aggregate [_a" in x for x in lines[at[1] :])


@pytest.mark.parametrize("name", ["block_final", "block_chosen_terms"])
def test_plans_of_settled_rows_are_small(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" not in plan and "log1p" not in plan.lower()


def test_candidates_of_distinct_names(spark):
    i = F.col("id").cast("string")
    x = spark.range(8_000).select("id", F.lit("X").alias("country"), F.concat(F.lit("red bolt "), i).alias("core"), F.concat((F.col("id") % 50).cast("string"), F.lit(" large rd")).alias("address"), F.lit("red bolt").alias("phonetic"), F.lit(0).alias("missing"))
    found = blocking.candidates(x, x).agg(F.countDistinct("tid"), F.sum(((F.col("tid") == F.col("aid")) & (F.col("position") == 0)).cast("int")))
    assert tuple(within(spark, 60, found.first)) == (8_000, 8_000)


def test_terms_of_kinds_are_those_of_records(spark):
    x = spark.range(90).select("id", F.lit("X").alias("country"), F.concat(F.lit("red "), (F.col("id") % 4).cast("string"), F.lit("x")).alias("core"), F.when(F.col("id") % 3 == 0, "").otherwise("7 rd").alias("address"), F.lit("rd").alias("phonetic"), F.lit(0).alias("missing"))
    kinds = blocking.kinds(x)
    assert kinds.count() == 8
    sets = [set(map(tuple, blocking.postings(blocking.keys(r), 90)[0].collect())) for r in (x, kinds)]
    assert sets[0] == sets[1]


#: Queries of all pairs, and the rows of 8,000 distinct names of one brand and type.
PAIRED = [("rule_kill_switch", 16_000_000), ("rule_offset_and_swap", 31_996_000), ("fn_token_similarities", 31_996_000)]


def parts(spark, path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{path}/part.parquet")
    return str(path)


@pytest.mark.parametrize("name, pairs", PAIRED)
def test_pairs_of_distinct_names(spark, tmp_path, name, pairs):
    x = spark.range(8_000).select(F.col("id").alias("p_partkey"), F.concat_ws(" ", F.get(F.array(*map(F.lit, ("red", "blue"))), (F.col("id") % 2).cast("int")), F.concat(F.lit("m"), (F.col("id") % 4 - F.col("id") % 2).cast("string"), F.col("id") % 2), F.col("id").cast("string")).alias("p_name"), F.lit("B").alias("p_brand"), F.lit("T").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"))
    x.write.parquet(f"{tmp_path}/part.parquet")
    df = registry.queries()[name](spark, str(tmp_path))
    got = within(spark, 40, lambda: df.agg(F.count("*"), F.min("aid"), F.max("tid"), *(F.count(c) for c in df.columns)).first())
    assert got[0] == pairs and got[1] == 0 and got[2] == 7_999


def test_ratios_and_counts_by_either_way(monkeypatch):
    p, q = np.arange(40)[:, None], np.arange(300)[None]
    sets = [set("abc"), set("bcd"), set(), set("xa")]
    ways = []
    for wide in (1 << 14, 0):
        monkeypatch.setattr(record_pairs, "WIDE", wide)
        monkeypatch.setattr(record_pairs, "CELLS", wide)
        ways.append((record_pairs._ratios(39, 299, 2, 6)(p, q).tolist(), record_pairs._shared(sets[:3], sets)(1, 3).tolist()))
    assert ways[0] == ways[1] and ways[0][1] == [[2, 3, 0, 0], [0, 0, 0, 0]] and ways[0][0][1][256] == 0.007813


@pytest.mark.parametrize("chunk", [2_048, 9])
@pytest.mark.parametrize("name, _", PAIRED)
def test_pairs_with_copies_and_odd_names(spark, tmp_path, monkeypatch, name, _, chunk):
    monkeypatch.setattr(record_pairs, "CHUNK", chunk)
    names = ["red bolt", "bolt red", "red rod", "rod", "red red", "red red rod", "old rod rod", "old old rod", "été rod 7", "red bolt 12", "red bolt 13", "blue bolt 12"] + ([None] if name != "rule_kill_switch" else [None, "rod"])
    d = parts(spark, tmp_path, [(i * 7 % 121 - 5, names[(i * i + i // 7) % len(names)], "XY"[i % 5 == 0] if i != 40 else None, "ab"[i % 2] if i != 41 else None, i % 37) for i in range(120)])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{d}/part.parquet/*.parquet'")
    df = registry.queries()[name](spark, d)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracles()[name]})").fetchall()
    assert len(want) > 300 and sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_distinct_names_by_tfidf(spark):
    g = F.col("id") % 4
    rows = spark.range(20_000).select("id", F.lit("X").alias("country"), F.array(F.concat(F.lit("a"), g.cast("string")), F.concat(F.lit("b"), g.cast("string")), F.col("id").cast("string")).alias("tokens"))
    found = blocking.tfidf_top_k(rows, rows, 3, 1.0).groupBy("tid").agg(F.count("*").alias("n"), F.max("aid").alias("last"), F.sum("aid").alias("all"))
    g, i = F.col("tid") % 4, F.col("tid")
    right = (F.col("n") == 3) & (F.col("last") == F.greatest(i, g + 8)) & (F.col("all") == 2 * g + 4 + F.greatest(i, g + 8))
    assert tuple(within(spark, 40, lambda: found.agg(F.count("*"), F.sum(right.cast("int"))).first())) == (20_000, 20_000)


def test_names_by_tfidf_in_small_chunks(spark, monkeypatch):
    words = ["red bolt", "bolt red", "red red bolt", "blue rod", "blue bolt 7", "", "old gear"]
    rows = [(i, None if i == 9 else "XY"[i % 3 == 0], f"{words[(i * i + i // 5) % 7]} {i // 2}".split()) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, country string, tokens array<string>")
    ways = []
    for asked, held in ((4_096, 16_384), (7, 5)):
        monkeypatch.setattr(sparse, "ASKED", asked)
        monkeypatch.setattr(sparse, "HELD", held)
        ways.append(sorted((r.tid, r.aid, round(r.sim, 9)) for r in blocking.tfidf_top_k(df, df, 4, 0.7).collect()))
    want = plain_top_k([r for r in rows if r[1]], rows, 4, 0.7)
    assert ways[0] == ways[1] and {t for t, _, _ in ways[0]} == set(want)
    assert all(sorted(round(s, 7) for t, _, s in ways[0] if t == x) == sorted(round(s, 7) for _, s in f) for x, f in want.items())
