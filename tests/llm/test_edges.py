"""Every operator on empty tables, nulls, empty and very long texts, repeated rows, ties and clashing column names."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from matchloom.llm import bpe_codec, chat_quotes, dart_dedup, langid, pii, quality_qda, quality_rules, rlz_dedup, scratch, suffix_dedup, tiling_decontam

#: Names that operators use for columns of their own.
CLASH = "doc_id long, text string, lang string, kd string, kt string, row string, base string, spans string, held_out string, x string, score string, seeds string, item_id string, node string, comp string, n_words string, line string, term string, posterior string, bands string"
LONG = " ".join(f"word{k % 977} thing{k % 31}" for k in range(120_000)) + " a@b.example " + "z" * 30_000
ROWS = [(1, None, "en"), (2, "", "en"), (3, " \n ", None), (4, LONG, "en"), (5, "same words here and there again", "xx"), (5, "same words here and there again", "xx"), (None, "same words here and there again", None), (6, "\x00 é\u2028 \U0001f600", "xx"), (7, LONG, None)]
BENCH = "item_id long, text string, doc_id string, kd string, item string, place string, n_tokens string"


def docs(spark, rows):
    width = len(CLASH.split(",")) - 3
    return spark.createDataFrame([(d, t, g, *["c"] * width) for d, t, g in rows], CLASH)


def bench(spark, rows=((1, "same words here and there"), (2, None), (3, ""))):
    return spark.createDataFrame([(i, t, "d", "k", "i", "p", "n") for i, t in rows], BENCH)


def labels(spark, rows=((1, 1), (4, 1), (5, 0), (6, 0), (None, 1), (7, None))):
    return spark.createDataFrame([(d, q, "x", "t") for d, q in rows], "doc_id long, quality int, x string, text string")


OPERATORS = {
    "quality": lambda spark, d: quality_qda.classify(d, labels(spark)).select("doc_id", "held_out", F.round("score", 9).alias("score"), "predicted"),
    "bytes": lambda spark, d: suffix_dedup.remove_repeated_bytes(d),
    "words": lambda spark, d: rlz_dedup.remove_repeated_words(d),
    "language": lambda spark, d: langid.identify(d, "doc_id = 6").select("doc_id", "held_out", "lang_pred", F.round("score", 6).alias("score")),
    "personal": lambda spark, d: pii.find(d).select("doc_id", pii.listed(F.col("spans")).alias("s")),
    "rules": lambda spark, d: quality_rules.judge(d).select("doc_id", "n_words", "kept"),
    "tokens": lambda spark, d: bpe_codec.digests(d),
    "near": lambda spark, d: dart_dedup.classes(d).select("doc_id", "class_id"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows(spark, name):
    f = OPERATORS[name]
    assert f(spark, docs(spark, [])).collect() == []
    got = f(spark, docs(spark, ROWS)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _, _ in ROWS)
    assert len({tuple(r) for r in got if r.doc_id == 5}) == 1  # repeated rows alike
    # column names make no difference
    plain = f(spark, spark.createDataFrame(ROWS, "doc_id long, text string, lang string")).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, plain))


def test_defined_results(spark):
    d = docs(spark, ROWS)
    near = {r.doc_id: r.class_id for r in dart_dedup.classes(d).collect() if r.doc_id is not None}
    assert near == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 4}
    gone = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeated_bytes(d).collect()}
    size = len(LONG.encode())
    assert gone[1] == gone[2] == (0, 0) and gone[4] == gone[7] == (size, size)
    words = {r.doc_id: (r.n_words, r.n_removed) for r in rlz_dedup.remove_repeated_words(d).collect()}
    assert words[4] == words[7] == (240_002, 240_002) and words[1] == words[2] == words[3] == (0, 0)
    spans = {r.doc_id: r.s for r in OPERATORS["personal"](spark, d).collect()}
    at = LONG.index("a@b.example")
    assert spans[4] == f"email:{at}:{at + 11}" and spans[1] == spans[6] == ""
    und = {r.doc_id: r.lang_pred for r in langid.identify(d, "doc_id = 6").collect()}
    assert [und[k] for k in (1, 2, 3, 6)] == ["und", "und", "und", "xx"]
    judged = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.judge(d).collect()}
    assert judged[1] == judged[2] == judged[3] == (True, False)


def test_whole_row_operators(spark):
    d = docs(spark, ROWS)
    for out in (pii.sanitise(d), quality_qda.keep_good(d, labels(spark, [(1, 1), (5, 1)])), dart_dedup.deduplicate(d), tiling_decontam.decontaminate(d, bench(spark))):
        assert out.schema.names == d.schema.names and all(r.kd == "c" for r in out.collect())
    for f in (pii.sanitise, dart_dedup.deduplicate, lambda x: quality_qda.keep_good(x, labels(spark)), lambda x: tiling_decontam.decontaminate(x, bench(spark))):
        assert f(docs(spark, [])).collect() == []
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in dart_dedup.deduplicate(d).collect()) == [(False, k) for k in (1, 2, 3, 4, 5, 6)]
    assert Counter(r.doc_id for r in tiling_decontam.decontaminate(d, bench(spark)).collect()) == Counter([1, 2, 3, 4, 6, 7])
    assert tiling_decontam.leaks(d, bench(spark, [])).collect() == [] and tiling_decontam.leaks(docs(spark, []), bench(spark)).collect() == []
    assert {(r.doc_id, r.item_id, r.coverage) for r in tiling_decontam.leaks(d, bench(spark)).collect()} == {(5, 1, 1.0), (None, 1, 1.0)}


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, parts string, thread string, said string, hash string"
    rows = [(1, 0, "u", "hello there"), (1, 0, "u", "hello there"), (1, 1, None, "> hello there\nyes"), (1, None, "u", "> hello there"), (None, 0, "u", None), (1, 2, "u", ""), (1, 3, "u", "x" * 200_000 + "\n> yes")]
    got = chat_quotes.link(spark.createDataFrame([(*r, "p", "t", "s", "h") for r in rows], schema)).collect()
    assert Counter((r.conv_id, r.turn, r.reply_to, r.thread) for r in got) == Counter([(1, 0, None, 0), (1, 0, None, 0), (1, 1, 0, 0), (1, None, None, None), (None, 0, None, 0), (1, 2, None, 2), (1, 3, 1, 0)])
    assert chat_quotes.link(spark.createDataFrame([], schema)).collect() == []


def test_no_private_folder_on_a_cluster(spark):
    class Context:
        master, _conf = "spark://somewhere:7077", {}

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session())
