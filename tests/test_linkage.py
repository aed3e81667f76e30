"""Views, metric, decoder, additions and sources against hand values and plain Python."""

import itertools
import math
import random

import pytest

from matchloom import registry
from matchloom.functions import similarity as S
from matchloom.functions import text as T
from matchloom.operators import decide, evaluate, rules, synth
from matchloom.sources import records
from pyspark.sql import functions as F


def _views(spark, rows, version):
    df = spark.createDataFrame([(i, n, a, c) for i, (n, a, c) in enumerate(rows)], "i int, business_name string, business_address string, country string")
    return [r.asDict() for r in T.views(df, version).orderBy("i").collect()]


def test_views_version_2(spark):
    rows = [("ABC Pvt Ltd", "12 Main Road", "USA"), ("The Company Store", "49th Avenue", "United States"), ("Co", None, "U.S."), ("ABC & Sons", "NA", "us"), ("Café Étoile", "null", "IN"), ("abc​def", "Shop 00127, Road 36, Unit 108-B / 115-119", "FR"), ("दुकान १२७", "दुकान १२७", "IN"), (None, " ", None)]
    v = _views(spark, rows, 2)
    assert [x["name_norm"] for x in v[:4]] == ["abc private limited", "the company store", "co", "abc and sons"]
    assert [x["name_core"] for x in v[:4]] == ["abc", "the company store", "co", "abc and sons"]
    assert [x["address_norm"] for x in v[:2]] == ["12 main rd", "49th ave"]
    assert {x["country_key"] for x in v[:4]} == {"US"}
    assert (v[2]["address_missing"], v[3]["address_missing"], v[4]["address_norm"]) == (1, 0, "null")
    assert v[4]["name_norm"] == "cafe etoile" and v[4]["name_unicode"] == "café étoile"
    assert v[5]["name_norm"] == "abc def"
    assert v[5]["numbers"] == ["00127", "36", "108", "115", "119"] and v[5]["numbers_unpadded"] == ["127", "36", "108", "115", "119"]
    assert v[6]["numbers"] == ["127"] and v[6]["name_norm"] and v[6]["non_ascii_name"] == 1
    assert v[7]["name_norm"] == ""


def test_views_version_3(spark):
    rows = ["Acme Holdings, L.L.C.", "TENNIS GAVROCHES LYCEE E.U.R.L.", "QHC Culture [EURL]", "Marina Ecole France Sarl", "SCI Ptit Àmicale", "M/s Sharma Traders Pvt. Ltd.", "Ms Sharma", "Hyderabad Technology Public Limited", "Public School Society", "Littlejohn Inc. Inc.", "Dr Deccan Traders Pvt.Ltd.", "raam maarketti g praaivett limittedd", "Shree Parvati", "Parvati Traders Limited", "A.B.C. Traders"]
    v = _views(spark, [(r, "63 R. DE DIEPPE", "France") for r in rows], 3)
    assert v[0]["name_norm"] == "acme holdings llc"
    cores = [x["name_core"] for x in v]
    assert cores[:5] == ["acme holdings", "tennis gavroches lycee", "qhc culture", "marina ecole france", "ptit amicale"]
    assert v[5]["name_norm"] == "messrs sharma traders private limited" and cores[5] == "sharma traders" and v[6]["name_norm"] == "ms sharma"
    assert cores[7] == "hyderabad technology" and v[7]["legal_form"] == "public limited" and cores[8] == "public school society"
    assert v[9]["name_norm"] == "littlejohn inc" and cores[10] == "deccan traders"
    assert cores[11] == "raam maarketti g" and v[11]["legal_form"] == "private limited"
    assert cores[12] == "shree parvati" and cores[13] == "parvati traders" and v[14]["name_norm"] == "abc traders"
    assert v[0]["address_norm"] == "63 rue de dieppe"


def test_learned_maps_are_refused():
    with pytest.raises(ValueError):
        T.check_learned({"a": {"b": "c"}})
    assert evaluate.alias_cycles(T.ADDRESS_ALIASES_3) == []


def test_edit_similarity(spark):
    row = spark.createDataFrame([("", "", "abc", "abd", "a" * 130)], "e string, f string, a string, b string, l string")
    got = row.select(S.edit(F.col("e"), F.col("f")), S.edit(F.col("a"), F.col("e")), S.edit(F.col("a"), F.col("b")), S.edit(F.col("l"), F.concat("l", F.lit("b")))).first()
    assert got[0] == 0 and got[1] == 0 and abs(got[2] - 2 / 3) < 1e-9 and 0 < got[3] < 1


def test_metric(spark):
    cases = [([], [], 1), ([], [1], 0), ([1, 2], [1, 2], 1), ([1, 2], [1, 2, 3], 5 / 7), ([1, 2], [1], 5 / 6), ([1], [], 0)]
    anchors = spark.createDataFrame([(i,) for i in range(len(cases))], "aid long")
    truth = spark.createDataFrame([(100 * i + t, i) for i, c in enumerate(cases) for t in c[0]], "tid long, aid long")
    links = spark.createDataFrame([(100 * i + t, i) for i, c in enumerate(cases) for t in c[1]], "tid long, aid long")
    got = {r.aid: r.f for r in evaluate.per_anchor(anchors, links, truth).collect()}
    assert all(abs(got[i] - c[2]) < 1e-9 for i, c in enumerate(cases))


def test_decoder_by_hand_and_against_all_prefixes(spark):
    knobs = decide.Knobs(0.25, 2.0, 0.0, 0.0)
    rnd = random.Random(5)
    groups = {1: [0.9, 0.8, 0.1], 2: [0.2], 3: [0.99]} | {a: [round(rnd.random(), 3) for _ in range(rnd.randrange(1, 9))] for a in range(4, 60)}
    rows = [(100 * a + i, a, q, 1.0) for a, qs in groups.items() for i, q in enumerate(qs)]
    got = {}
    for r in decide.decode(spark.createDataFrame(rows, "tid long, aid long, q double, margin double"), knobs).collect():
        got[r.aid] = got.get(r.aid, 0) + 1
    assert (got[1], got.get(2, 0), got[3]) == (2, 0, 1)
    for a, qs in groups.items():
        qs = sorted(qs, reverse=True)
        score = [1.25 * sum(qs[:k]) / (k + 0.25 * (sum(qs) + 0.25)) for k in range(1, len(qs) + 1)]
        empty = 2 * math.prod(1 - min(q, 1 - 1e-7) for q in qs)
        assert got.get(a, 0) == (0 if empty > max(score) else score.index(max(score)) + 1)


def test_additions_respect_caps_and_used_targets(spark):
    cur = spark.createDataFrame([(1, 7, "S2")], "tid long, aid long, src string")
    new = spark.createDataFrame([(1, 8, "S2", 0), (2, 7, "S2", 1), (3, 7, "S2", 2), (4, 7, "S3", 3)], "tid long, aid long, src string, pos long")
    got = {(r.tid, r.aid) for r in decide.additions(cur, [new], {"S2": 2, "S3": 1}).collect()}
    assert got == {(1, 7), (2, 7), (4, 7)}


def test_literal_reading_and_lists(spark, tmp_path):
    lines = ["entity_id\tbusiness_name\tbusiness_address\tcountry", 'S1-1\t"Open quote\t12 rd\tUS', "S1-2\tback\\\t\tFR", "S1-3\tNA\tnull\tIN"]
    (tmp_path / "a.tsv").write_text("\n".join(lines) + "\n")
    got = records.numbered(records.read_literal(spark, str(tmp_path / "a.tsv")), "entity_id").orderBy("rid").collect()
    assert [r.business_name for r in got] == ['"Open quote', "back\\", "NA"] and got[1].business_address == "" and [r.rid for r in got] == [0, 1, 2]
    (tmp_path / "b.tsv").write_text(lines[0] + "\nS1-1\tx\n")
    with pytest.raises(Exception):
        records.read_literal(spark, str(tmp_path / "b.tsv")).collect()


def test_manifest_gate(spark):
    t = {"a": spark.range(3).toDF("x")}
    m = records.manifest(t, "g1")
    records.gate(m, t)
    for bad, tables in ((m | {"status": "draft"}, t), (m | {"generation_id": "g2"}, t), (m, {"a": spark.range(4).toDF("x")})):
        with pytest.raises(ValueError):
            records.gate(bad, tables)


def test_rules(spark):
    row = spark.createDataFrame([("compagnie générale des eaux sarl".replace("é", "e"), "12", "13", "120", "x")], "n string, a string, b string, c string, d string")
    got = row.select(rules.initials(F.col("n")), rules.house_number_relation(F.col("a"), F.col("b")), rules.house_number_relation(F.col("a"), F.col("c")), rules.one_word_swap(F.split(F.lit("a b c"), " "), F.split(F.lit("a x c"), " "))).first()
    assert tuple(got) == ("CGE", "one_digit", "unrelated", True)


def test_lineage_and_sample(spark):
    a = spark.createDataFrame([(0, 0, 0.9), (1, 1, 0.6), (2, -1, 0.0)], "tid long, aid long, q double")
    assert evaluate.lineage(a, a).first()["violations"] == 0
    assert evaluate.lineage(a, a.withColumn("q", F.col("q") + 0.1)).first()["violations"] == 3


def test_generated_world_is_matched(spark):
    """Noisy copies of anchors find their anchor: blocking recall, then decoder and metric on a hand-weighted score."""
    from matchloom.operators import blocking

    rnd = random.Random(3)
    words = ["".join(p) for p in itertools.product(["ba", "ke", "li", "mo", "nu"], ["rta", "sse", "vin", "dor"])]
    rows = [(f"S1-{i}", f"{rnd.choice(words)} {rnd.choice(words)} {rnd.choice(words)}", f"{rnd.randrange(1, 900)} {rnd.choice(words)} street", "FR") for i in range(300)]
    base = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    made = synth.copies(base).collect()
    targets = spark.createDataFrame([(i, *r) for i, r in enumerate(made)], "tid long, entity_id string, business_name string, business_address string, country string, owner string")
    a = T.views(base.withColumn("id", F.substring("entity_id", 4, 9).cast("long")))
    t = T.views(targets.withColumn("id", F.col("tid")))
    record = lambda v: v.select("id", F.col("country_key").alias("country"), F.col("name_core").alias("core"), F.col("address_norm").alias("address"), "phonetic", F.col("address_missing").alias("missing"))
    found = blocking.candidates(record(a), record(t)).cache()
    truth = targets.where("owner IS NOT NULL").select("tid", F.substring("owner", 4, 9).cast("long").alias("aid"))
    r = blocking.recall(found, truth).first()
    assert r["retrieved"] / r["links"] > 0.9
    best = decide.best_two(found.select("tid", "aid", F.least(F.col("rank"), F.lit(0.99)).alias("p")))
    own = best.select("tid", "aid", F.col("p").alias("q"), (F.col("p") - F.col("p2")).alias("margin"))
    score = evaluate.macro(a.select(F.col("id").alias("aid")), decide.decode(own, decide.Knobs(0.1, 6.0, 0.01, 0.4)), truth).first()
    same = t.select("tid", F.col("name_core").alias("c")).join(a.select(F.col("id").alias("aid"), F.col("name_core").alias("c")), "c").select("tid", "aid")
    equal = evaluate.macro(a.select(F.col("id").alias("aid")), same, truth).first()
    assert score["macro_f05"] > equal["macro_f05"]


def test_all_key_types_have_a_twin(spark):
    both = [registry.queries()[n](spark, "/root/testdata/sf0.001").collect() for n in ("block_keys", "block_keys_address")]
    assert sorted(r.type for rows in both for r in rows) == list(range(7))
    assert {"block_keys", "block_keys_address"} <= set(registry.oracles())


def test_prune_equals_a_heap(spark):
    import heapq
    import math

    rnd = random.Random(6)
    rows = [(t, rnd.randrange(30), round(rnd.random(), 3)) for t in range(200)]
    links = spark.createDataFrame(rows, "tid long, aid long, q double")
    value = lambda qs, k: 1.25 * sum(qs[:k]) / (k + 0.25 * sum(qs)) if k else math.exp(sum(math.log(1 - min(q, 1 - 1e-7)) for q in qs))
    held = {a: sorted(((q, t) for t, b, q in rows if b == a), key=lambda x: (-x[0], x[1])) for _, a, _ in rows}
    qs = {a: [q for q, _ in x] for a, x in held.items()}
    heap = [(round(value(q, len(q)) - value(q, len(q) - 1), 9), a, len(q)) for a, q in qs.items()]
    heapq.heapify(heap)
    gone = set()
    for _ in range(80):
        _, a, k = heapq.heappop(heap)
        gone.add(held[a][k - 1][1])
        if k > 1:
            heapq.heappush(heap, (round(value(qs[a], k - 1) - value(qs[a], k - 2), 9), a, k - 1))
    assert {r.tid for r in decide.prune(links, 1200, 10).collect()} == {t for t, _, _ in rows} - gone
    assert decide.prune(links, 2000, 10).count() == 200


def test_order_over_ranges(spark, monkeypatch):
    from matchloom.operators import order

    monkeypatch.setattr(order, "RANGES", 7)
    rnd = random.Random(2)
    values = [rnd.randrange(10**6) for _ in range(500)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(sorted(set(values), key=lambda _: rnd.random()))], "v long, x long")
    got = {r.v: r.rid for r in order.numbered(df, "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))}
    assert order.quantile(df, "v", 0.5).first()[0] == __import__("statistics").median(got)
    assert order.numbered(df.limit(0), "v").count() == 0 and order.quantile(df.limit(0), "v", 0.5).first()[0] is None


def test_vector_recall_of_the_hashed_route(spark):
    """Sign-pattern buckets against all rows, for a stated set of queries."""
    from matchloom.operators import blocking

    rnd = random.Random(9)
    centre = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, 0, [x + rnd.gauss(0, 0.05) for x in centre[i % 12]]) for i in range(480)]
    v = spark.createDataFrame(rows, "id long, part int, embedding array<double>")
    asked = v.where("id % 20 = 0")
    exact = {(r.tid, r.aid) for r in blocking.vector_top_k(asked, v, 4).collect()}
    near = {(r.tid, r.aid) for r in blocking.vector_top_k(asked, v, 4, planes=5, tables=8).collect()}
    assert len(exact) == 96 and len(exact & near) / len(exact) >= 0.9


def test_models_of_the_second_stage(spark):
    from matchloom.operators import learn

    rnd = random.Random(4)
    rows = []
    for i in range(600):
        y = i % 2
        rows.append((i, 80 + i % 10, 0, y, 0.2 + 0.6 * rnd.random(), rnd.random(), y + rnd.gauss(0, 0.3)))
    table = spark.createDataFrame(rows, "tid long, fold int, linked int, label int, q double, margin double, x double")
    full, control = learn.banded_model(table, ["q", "margin", "x"], ["q", "margin"], rounds=5)
    score = lambda m: evaluate.auc(learn.probability(m, table, "score").select("score", "label")).first()[0]
    assert score(full) > 0.9 > score(control)
    assert evaluate.auc(learn.probability(learn.rescue(table, ["x"], rounds=5), table, "score").select("score", "label")).first()[0] > 0.9
    texts = spark.createDataFrame([(1, "abcdef"), (2, "abcdeg"), (3, "zzzzzz"), (4, None)], "id long, text string")
    made = learn.embedded(texts, learn.hashed_grams)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 9)], "tid long, aid long")
    cos = {r.aid: r.multilingual_cosine for r in learn.with_vectors(pairs, made, made).collect()}
    assert cos[2] > 0.5 > cos[3] and cos[4] == cos[9] == 0
