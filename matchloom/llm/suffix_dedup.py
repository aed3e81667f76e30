"""Byte-level substring removal by suffix sorting (deep-shallow).

Suffixes that start at the anchors of blocks (see seqanchor) are sorted by multikey quicksort to a shallow depth;
groups that still agree are ordered by blind tries.  The sort gives, per anchor, the longest common extensions to the
right; the same sort of the reversed text before the anchor gives those to the left; both together decide every window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import repeats

WINDOW, GRAM = 200, 48
#: Bytes per character of the quicksort (7 bytes and their number make a 64-bit key), and its depth.
STEP, SHALLOW = 7, 28


def _common(a: bytes, b: bytes) -> int:
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def blind_trie(items: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order of the strings and the common prefix of each with its predecessor, by a Patricia trie.

    Inner nodes are [depth, {byte or -1 for the end: child}], leaves are lists of indices of equal strings wrapped in
    a tuple.  Descent looks at one byte per node (blind); one comparison with the leaf reached tells where to insert.
    """
    root: list | tuple = ([0],)
    for i in range(1, len(items)):
        s = items[i]
        m = len(s)
        node = root
        while type(node) is list:
            c = s[node[0]] if node[0] < m else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        t = items[node[0][0]]
        d = _common(s, t)
        if d == m == len(t):
            node[0].append(i)
            continue
        above, node = None, root
        while type(node) is list and node[0] < d:
            above, node = node, node[1][s[node[0]]]
        c = s[d] if d < m else -1
        if type(node) is list and node[0] == d:
            node[1][c] = ([i],)
            continue
        new = [d, {(t[d] if d < len(t) else -1): node, c: ([i],)}]
        if above is None:
            root = new
        else:
            above[1][s[above[0]]] = new
    order: list[int] = []
    lcp: list[int] = []
    stack: list[tuple] = [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if type(node) is tuple:
            same = node[0]
            order += same
            lcp += [shared] + [len(items[same[0]])] * (len(same) - 1)
            continue
        for k, c in enumerate(reversed(ordered := sorted(node[1]))):
            stack.append((node[1][c], shared if k == len(ordered) - 1 else node[0]))
    return order, lcp


def _multikey_quicksort(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of keys (one "character" a column) within groups, and segments of rows that are equal in all columns.

    All open segments are partitioned at once around a pivot each, into less, equal and greater; the equal part goes on
    with the next column.
    """
    n, columns = keys.shape
    _, first = np.unique(group, return_inverse=True)
    order = np.argsort(first, kind="stable")
    seg = first[order].astype(np.int64)
    depth = np.zeros(n, np.int64)
    at = np.arange(n)  # positions in open segments
    while True:
        # a segment is open if it has two rows at least and columns left
        fresh = np.concatenate(([True], seg[at][1:] != seg[at][:-1])) if len(at) else np.empty(0, bool)
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(at)))
        number = np.repeat(np.arange(len(begin)), size)
        live = (size[number] > 1) & (depth[at] < columns)
        at = at[live]
        if not len(at):
            return order, seg
        fresh = np.concatenate(([True], seg[at][1:] != seg[at][:-1]))
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(at)))
        number = np.repeat(np.arange(len(begin)), size)
        key = keys[order[at], depth[at]]
        pivot = key[begin + size // 2][number]
        side = (key > pivot).astype(np.int64) - (key < pivot) + 1
        by = np.argsort(3 * number + side, kind="stable")
        order[at] = order[at][by]
        side = side[by]
        depth[at] += side == 1
        # segments are named by the position of their first row, so that names ascend
        part = 3 * number + side
        head = np.concatenate(([True], part[1:] != part[:-1]))
        seg[at] = n + at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]


def deep_shallow(items: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within each group (groups ascending), and common prefix with the predecessor (-1: none)."""
    n = len(items)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    length = np.fromiter(map(len, items), np.int64, n)
    flat = np.frombuffer(b"".join(x[:SHALLOW].ljust(SHALLOW, b"\0") for x in items), np.uint8).reshape(n, SHALLOW)
    weights = np.uint64(1) << (np.arange(STEP - 1, -1, -1, dtype=np.uint64) * np.uint64(8) + np.uint64(8))
    have = np.clip(length[:, None] - np.arange(0, SHALLOW, STEP), 0, STEP).astype(np.uint64)
    keys = flat.reshape(n, -1, STEP).astype(np.uint64) @ weights | have
    order, seg = _multikey_quicksort(keys, group)
    differ = flat[order[1:]] != flat[order[:-1]]
    ends = np.minimum(np.minimum(length[order[1:]], length[order[:-1]]), SHALLOW)
    lcp = np.full(n, -1, np.int64)
    lcp[1:] = np.where(group[order[1:]] == group[order[:-1]], np.minimum(np.where(differ.any(1), differ.argmax(1), SHALLOW), ends), -1)
    start = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    stop = np.append(start[1:], n)
    for lo, hi in zip(start[stop - start > 1].tolist(), stop[stop - start > 1].tolist()):
        if length[order[lo:hi]].max() <= SHALLOW:  # all of them end here: equal strings
            continue
        tails = [items[i][SHALLOW:] for i in order[lo:hi]]
        rank, shared = blind_trie(tails)
        order[lo:hi] = order[lo:hi][rank]
        lcp[lo + 1 : hi] = SHALLOW + np.array(shared[1:])
    return order, lcp


def solve(group: np.ndarray, weight: np.ndarray, n: np.ndarray, p: np.ndarray, contents: list, window: int = WINDOW, gram: int = GRAM) -> list[np.ndarray]:
    """Which windows of each block also occur in another block of its group (weight 2: the block itself repeats)."""
    m = len(contents)
    marks = [np.zeros(k, bool) for k in n]
    right, shared_right = deep_shallow([c[q + gram : q + window] for c, q in zip(contents, p)], group)
    left, shared_left = deep_shallow([c[:q][::-1] for c, q in zip(contents, p)], group)
    offset = np.concatenate(([0], np.cumsum(n)))
    flat = np.zeros(offset[-1], bool)
    class_r, class_l = np.empty(m, np.int64), np.empty(m, np.int64)
    for back in range(int(p.max()) + 1 if m else 0):  # windows that start `back` symbols before the anchor
        live = np.flatnonzero((back <= p) & (p - back < n))
        if not len(live):
            continue
        class_r[right] = np.cumsum(shared_right + gram * (shared_right >= 0) < window - back)
        class_l[left] = np.cumsum(shared_left < back)
        pair = class_r[live] * (m + 1) + class_l[live]
        _, inverse = np.unique(pair, return_inverse=True)
        many = np.bincount(inverse, weight[live]) >= 2
        flat[offset[live] + (p[live] - back)] = many[inverse]
    for i in range(m):
        marks[i] = flat[offset[i] : offset[i + 1]]
    return marks


SPEC = repeats.Spec(window=WINDOW, gram=GRAM, words=False, solver=solve)


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for text, spans in zip(frame["text"], frame["spans"]):
            data = text.encode()
            start, end = repeats.union_of(spans)
            kept, at = [], 0
            for s, e in zip(start.tolist(), end.tolist()):
                kept.append(data[at:s])
                at = e
            kept.append(data[at:])
            rows.append((len(data), int((end - start).sum()), len(start), b"".join(kept)))
        yield pd.DataFrame({"doc_id": frame["doc_id"], **{c: [r[i] for r in rows] for i, c in enumerate(("n_bytes", "n_removed", "n_spans", "kept"))}})


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row of docs(doc_id, text).

    A null or short text has no window and stays as it is (null: empty).  Repeated rows are copies of each other,
    hence removed wholly if they have 200 bytes.  A null doc_id is returned as null.  Other columns are ignored,
    whatever their names.  An empty table gives no rows.  Nothing depends on the order of equal strings (ties).  One text
    is handled whole: a task needs memory of about 60 times the bytes of its longest text.
    """
    rows = repeats.keyed(docs)
    spans = repeats.repeated(rows, SPEC)
    return rows.join(spans, ["kd", "kt"], "left").select("doc_id", "text", "spans").mapInPandas(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
