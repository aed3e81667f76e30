"""The five stages on whole small tables: what each keeps follows from what the one before kept."""

import corpus_pipeline
import numpy as np


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf).write.parquet(f"{tmp_path}/{i}")
        seen.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "bpe"]
    assert all(d.columns == columns for d in seen[1:-1])
    rows = [d.count() for d in seen]
    assert rows == sorted(rows, reverse=True) and rows[3] == rows[4] == rows[5]
    texts = {r.doc_id: r.text for r in seen[4].collect()}
    assert not any("@" in t and ".com" in t and "example" in t for t in texts.values() if t)
    from matchloom.llm.bpe_codec import codec

    for r in seen[5].collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.n_tokens and codec().decode(ids) == texts[r.doc_id]
    run = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, sf).collect()}
    assert run == {r.doc_id: bytes(r.ids) for r in seen[5].collect()}
