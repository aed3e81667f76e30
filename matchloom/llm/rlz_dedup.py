"""Word-level substring removal by relative Lempel-Ziv parsing.

The reference is every block of the corpus, indexed by content (see seqanchor).  A block that the index holds twice
is one factor.  Blocks at the edges of repeated passages are parsed greedily against the blocks that share their
anchor: all places of the seed of a factor are looked up in the index, the one that agrees furthest is the factor, and
the parse resumes inside the factor's last window, so that windows across factor boundaries are checked too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import repeats

WINDOW, GRAM = 35, 8


def _longest(words: np.ndarray, size: np.ndarray, i: int, s: int, places: list[tuple[int, int]]) -> int:
    """Words of the longest factor at word s of block i: of all places of its seed in other blocks, the one that agrees furthest."""
    at = np.array([x for x in places if x[0] != i]).reshape(-1, 2)
    if not len(at):
        return 0
    block, t = at[:, 0], at[:, 1]
    k = WINDOW
    while s + k < size[i]:
        on = t + k < size[block]
        block, t = block[on], t[on]
        on = words[block, t + k] == words[i, s + k]
        block, t = block[on], t[on]
        if not len(block):
            break
        k += 1
    return k


def solve(group: np.ndarray, weight: np.ndarray, n: np.ndarray, p: np.ndarray, contents: list) -> list[np.ndarray]:
    """Which windows of each block are inside a factor of at least WINDOW words (weight 2: the block itself repeats)."""
    found = [d.tolist() for d in repeats.digests(SPEC, n, contents)]
    size = np.array([len(c) for c in contents], np.int64)
    words = np.zeros((len(contents), int(size.max(initial=0)) + 1), np.uint64)
    for i, c in enumerate(contents):
        words[i, : len(c)] = c
    marks = [np.zeros(k, bool) for k in n]
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1], [True]))) if len(order) else []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        members = order[lo:hi].tolist()
        index: dict[int, list[tuple[int, int]]] = {}
        for i in members:
            for s, h in enumerate(found[i]):
                index.setdefault(h, []).append((i, s))
        for i in members:
            if weight[i] >= 2:
                continue
            s, mine, mark = 0, found[i], marks[i]
            while s < n[i]:
                places = index[mine[s]]
                k = _longest(words, size, i, s, places) if len(places) > 1 else 0
                if k:
                    mark[s : s + k - WINDOW + 1] = True
                    s += k - WINDOW
                s += 1
    return marks


SPEC = repeats.Spec(window=WINDOW, gram=GRAM, words=True, solver=solve)


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for text, spans in zip(frame["text"], frame["spans"]):
            words = text.encode().split()
            start, end = repeats.union_of(spans)
            kept, at = [], 0
            for s, e in zip(start.tolist(), end.tolist()):
                kept += words[at:s]
                at = e
            kept += words[at:]
            rows.append((len(words), int((end - start).sum()), b" ".join(kept)))
        yield pd.DataFrame({"doc_id": frame["doc_id"], **{c: [r[i] for r in rows] for i, c in enumerate(("n_words", "n_removed", "kept"))}})


def remove_repeated_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (binary, UTF-8) of every row of docs(doc_id, text).

    A null or short text has no window: its words stay, joined by one space.  Repeated rows are copies of each other.
    A null doc_id is returned as null.  Other columns are ignored, whatever their names.  An empty table gives no rows.
    Which of several equally long factors is taken (ties) does not change what is removed.  Words are compared by 64-bit
    hashes.  One text is handled whole: a task needs memory of about 60 times the bytes of its longest text.
    """
    rows = repeats.keyed(docs)
    spans = repeats.repeated(rows, SPEC)
    return rows.join(spans, ["kd", "kt"], "left").select("doc_id", "text", "spans").mapInPandas(_cut, "doc_id long, n_words long, n_removed long, kept binary")


def op4_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
