"""Second routes, learned tokens and the library parts without a query, against hand values."""

import zipfile

import pytest
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.operators import decide, learn, rescues, rules
from matchloom.sources import records
from matchloom.streaming.incremental import match_arrivals


def test_alignment_keeps_order():
    assert rescues.skeleton("ddijittaal") == "djtl" and rescues.skeleton("") == ""
    assert rescues.token_similarity("paaoy", "") == 0
    assert rescues.aligned("ddijittaal paaoy".split(), "digital power".split()) == [("ddijittaal", "digital"), ("paaoy", "power")]
    assert rescues.aligned("paaoy ddijittaal".split(), "digital power".split()) == [("ddijittaal", "digital")]
    assert rescues.aligned([], ["a"]) == [] and rescues.aligned(["a"] * 9, ["a"]) == []


def test_learned_tokens_need_support_and_share(spark):
    rows = [("taara", "tara")] * 3 + [("beelt", "belt"), ("beelt", "bolt")] * 3 + [("raara", "rara")] * 2 + [(None, "x"), ("same", "same")]
    got = rescues.learned_tokens(spark.createDataFrame(rows, "core string, a_core string")).collect()
    assert [tuple(r) for r in got] == [("taara", "tara", 3)]


def test_first_views(spark):
    rows = [(0, "ACME Pvt Ltd", "12 Main Road, New York", 0), (1, "www.Foo-bar.com", "दिल्ली", 0), (2, "The Co", None, 1), (3, None, "  ", 1), (4, "Inc.com", "Opposite West Virginia", 0)]
    df = spark.createDataFrame([r[:3] for r in rows], "i int, business_name string, business_address string")
    v = [r.asDict() for r in T.first_views(df).orderBy("i").collect()]
    assert [x["address_missing"] for x in v] == [r[3] for r in rows]
    assert (v[0]["name_norm"], v[0]["name_core"], v[0]["address_norm"]) == ("acme private limited", "acme", "12 main rd ny")
    assert v[1]["name_core"] == "foo bar" and v[2]["name_core"] == "the company" and v[3]["name_norm"] == ""
    assert v[4]["address_norm"] == "opp wv" and v[4]["name_core"] == "inc com"


def test_domain_keys(spark):
    df = spark.createDataFrame([(["acme", "blue", "ltd"],), ([],), (["ltd"],)], "w array<string>")
    keys = [set(r[0]) for r in df.select(rules.domain_keys(F.col("w"))).collect()]
    assert {"acmeblueltd", "abl" + "td", "ablueltd", "blueltdacme", "acmeblue", "ablue", "bacme"} <= keys[0]
    assert keys[1] == set() and keys[2] == {"ltd"}


def test_cut_off_addresses(spark):
    df = spark.createDataFrame([("5 rd, MH",), ("5 rd, MH ",), ("5 rd MH",), ("5 rd, mh",), ("5 rd, XX",)], "a string")
    assert [r[0] for r in df.select(rescues.cut_off(F.col("a"))).collect()] == [True, True, False, False, False]


def test_empty_tables(spark):
    pairs = spark.createDataFrame([], "tid long, aid long, sim double")
    links = spark.createDataFrame([], "tid long, aid long")
    assert rescues.clear_best(pairs).count() == 0 and rescues.residue(links, links, links).count() == 0
    grid = rescues.clear_best_grid(pairs, links, links, spark.createDataFrame([(1,)], "aid long"), [0.5], [0.1]).collect()
    assert [(r["fires"], r["macro_f05"]) for r in grid] == [(0, 1.0)]


def test_bundles_and_digests(tmp_path):
    a, b = tmp_path / "a.tsv", tmp_path / "b.tsv"
    a.write_text("x\n"), b.write_text("x\n")
    z = str(tmp_path / "out.zip")
    hashes = records.bundle(z, [str(a)])
    assert records.audit_bundle(z, [str(a)], (str(a), str(b))) == hashes
    b.write_text("y\n")
    with pytest.raises(ValueError):
        records.audit_bundle(z, [str(a)], (str(a), str(b)))
    a.write_text("z\n")
    with pytest.raises(ValueError):
        records.audit_bundle(z, [str(a)])
    with zipfile.ZipFile(z) as archive:
        assert archive.namelist() == ["a.tsv"]


def test_scores_are_checked(spark):
    good = spark.createDataFrame([(i, i / 10) for i in range(11)], "key long, score double")
    assert records.score_integrity(good, good)["n"] == 11
    for bad in (good.withColumn("score", F.lit(0.5)), good.withColumn("score", F.col("score") * 2), good.withColumn("score", F.when(F.col("key") > 2, F.col("score")))):
        with pytest.raises(ValueError):
            records.score_integrity(bad)
    with pytest.raises(ValueError):
        records.score_integrity(good, good.withColumn("score", 1 - F.col("score")))


def test_once_keeps_the_first_result(spark, tmp_path):
    made = []
    make = lambda n: lambda: made.append(n) or spark.range(n)
    assert records.once(str(tmp_path / "t"), make(3), spark).count() == 3
    assert records.once(str(tmp_path / "t"), make(5), spark).count() == 3 and made == [3]


def test_rate_sample_is_stable(spark):
    x = spark.range(20_000)
    kept = {r[0] for r in x.where(learn.rate_sample(F.col("id"), 0.25, 3)).collect()}
    assert kept == {r[0] for r in x.repartition(7).where(learn.rate_sample(F.col("id"), 0.25, 3)).collect()}
    assert 0.22 < len(kept) / 20_000 < 0.28 and x.where(learn.rate_sample(F.col("id"), 1.0)).count() == 20_000


def test_models_learn_and_calibrate(spark):
    rows = spark.range(600).select((F.col("id") % 10 / 10).alias("a"), (F.col("id") % 7 / 7).alias("b"), (F.col("id") % 10 >= 5).cast("int").alias("label"), F.lit(1.0).alias("w"), (F.col("id") % 11 == 0).alias("stop"))
    trees = learn.probability(learn.boosted(rows, ["a", "b"], depth=2, rounds=5, weight="w", validation="stop"), rows)
    line = learn.probability(learn.calibrator(rows, ["a", "b"]), rows, known=F.col("a") > 0.05)
    for scored in (trees, line):
        assert scored.where((F.col("q") >= 0.5) == (F.col("label") == 1)).count() == 600
    assert {r[0] for r in line.where("a < 0.05").select("q").distinct().collect()} == {0.0}
    model = learn.isotonic(rows.withColumn("p", F.col("a")))
    from pyspark.ml.feature import VectorAssembler

    mapped = model.transform(VectorAssembler(inputCols=["p"], outputCol="_v").transform(rows.withColumn("p", F.col("a")))).groupBy("a").agg(F.min("prediction").alias("y")).orderBy("a").collect()
    assert [r["y"] for r in mapped] == sorted(r["y"] for r in mapped) and (mapped[0]["y"], mapped[-1]["y"]) == (0.0, 1.0)


def test_lexical_scorer(spark):
    pairs = spark.createDataFrame([(1, 2, "abcd", "abcd"), (1, 3, "abcd", "wxyz"), (1, 4, "", "")], "tid long, aid long, left string, right string")
    got = {r["aid"]: r["ce"] for r in learn.score_pairs(pairs, learn.lexical).collect()}
    assert got[2] == 1.0 and got[3] == 0.0 and got[4] == 1.0


def test_removed_anchors(spark):
    share = spark.range(20_000).withColumnRenamed("id", "aid").where(decide.removed_anchors(0.3)).count() / 20_000
    assert 0.28 < share < 0.32


def test_arriving_files_are_matched_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    anchors = spark.createDataFrame([(1, "a"), (2, "b")], "aid long, core string")
    match = lambda batch: batch.join(anchors, "core").select("tid", "aid")
    for rows, want in (([(10, "a"), (11, "x")], {(10, 1)}), ([(12, "b"), (13, "a")], {(10, 1), (12, 2), (13, 1)}), ([], {(10, 1), (12, 2), (13, 1)})):
        if rows:
            spark.createDataFrame(rows, "tid long, core string").coalesce(1).write.mode("append").parquet(source)
        match_arrivals(spark, source, "tid long, core string", match, sink, state)
        assert sorted((r["tid"], r["aid"]) for r in spark.read.parquet(sink).collect()) == sorted(want)


def test_budget_counts_bytes(spark):
    lines = spark.createDataFrame([("a", "é"), ("b", "")], "k string, ids string")
    assert records.Budget(8).size(lines, "k", "ids") == 5 + 3
    records.Budget(8).check(lines, "k", "ids")
    with pytest.raises(ValueError):
        records.Budget(7).check(lines, "k", "ids")
