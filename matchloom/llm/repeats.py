"""Exact discovery of windows that repeat anywhere in a corpus, shared by the two substring de-duplicators.

Plan (see seqanchor for anchors and blocks):

1. one scan turns documents into block descriptors, packed per chunk of a task (shared scratch table);
2. *ask*: every chunk sends each distinct block hash and each distinct anchor once, so that a hot passage costs one
   entry per chunk however many documents hold it; *answer*: repeated / leader / mixed flags per entry;
3. chunks turn flags into spans (repeated blocks) and requests (blocks at the edges of repeated passages);
4. the symbols of requested blocks are grouped by anchor and given to a *solver*, which decides window by window.
   Anchors with more than ``GROUP`` different blocks are dealt to several shards; shards compare what is unique
   to them by window digests, again once per shard and window.

Nothing is sampled or capped: groups of any size are split, not cut.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm import scratch
from matchloom.llm.seqanchor import U64, Rolling, blocks, byte_symbols, word_symbols

#: Symbols handled at a time, and per chunk (the unit of local combining).
SLICE, CHUNK = 2_000_000, 12_000_000
#: Entries that one answering group holds, about.
ENTRIES = 1_000_000
#: Different blocks of one anchor solved together; larger groups are dealt to shards.
GROUP = 4096
NULL_ID = -(1 << 63)

#: solver(group, weight, n, p, contents) -> one boolean array per block, True where a window repeats.
Solver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list], list]


@dataclass(frozen=True)
class Spec:
    """window and gram in symbols; words: symbols are words instead of bytes."""

    window: int
    gram: int
    words: bool
    solver: Solver

    @property
    def width(self) -> int:
        return 8 if self.words else 1

    def symbols(self, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of texts laid end to end (each followed by one separator byte), and symbols per text."""
        if not self.words:
            return byte_symbols(buf), np.diff(ends, prepend=0)
        sym, start, _ = word_symbols(buf)
        return sym, np.diff(np.searchsorted(start, ends), prepend=0)


def keyed(docs: DataFrame) -> DataFrame:
    """kd, kt: what names a row; rows with one id and different texts stay apart, repeated rows count as copies."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("kd"), F.xxhash64(text).alias("kt"), F.col("doc_id"), text.alias("text"))


def boxed(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns, whatever their names), kd, kt and text (null: empty) of docs(doc_id, text, ...)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("kd"), F.xxhash64(text).alias("kt"), text.alias("text"))


def _slices(column: pa.Array, words: bool, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, end offsets) of runs of texts of about size bytes; words: texts end in a line feed."""
    column = column.cast(pa.large_binary())
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        if words:
            parts = [raw[off[x] : off[x + 1]].tobytes() for x in range(i, j)]
            yield i, j, np.frombuffer(b"\n".join([*parts, b""]), np.uint8), off[i + 1 : j + 1] - off[i] + np.arange(1, j - i + 1)
        else:
            yield i, j, raw[off[i] : off[j]], off[i + 1 : j + 1] - off[i]
        i = j


R_SCHEMA = "chunk long, kd binary, kt binary, doc binary, a binary, n binary, p binary, anchor binary, body binary, n_blocks long"
KINDS = {"doc": np.int32, "a": np.int32, "n": np.int32, "p": np.int32, "anchor": np.int64, "body": np.int64}


def _describe(spec: Spec) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        keys: list[tuple] = []
        symbols = docs = 0
        number = itertools.count()

        def flush() -> pa.RecordBatch:
            kd, kt = (np.concatenate([k[i] for k in keys]) for i in (0, 1))
            cols = {c: np.concatenate([h[c] for h in held]).astype(t) for c, t in KINDS.items()}
            # unique also among chunks of equal rows; the table is written once, so it stays
            chunk = (TaskContext.get().partitionId() << 32) + next(number)
            # only documents with a block are kept
            row = [[chunk], [kd.tobytes()], [kt.tobytes()], *([cols[c].tobytes()] for c in KINDS), [len(cols["a"])]]
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(x, pa.binary()) for x in row[1:-1]), pa.array(row[-1], pa.int64())], names=["chunk", "kd", "kt", *KINDS, "n_blocks"])

        for batch in batches:
            kd, kt = (np.asarray(batch.column(i)) for i in (0, 1))
            for i, j, buf, ends in _slices(batch.column(2), spec.words):
                sym, lengths = spec.symbols(buf, ends)
                out = blocks(sym, lengths, spec.window, spec.gram)
                out["doc"] = out["doc"] + docs
                held.append(out)
                keys.append((kd[i:j], kt[i:j]))
                docs += j - i
                symbols += len(sym) * (6 if spec.words else 1)
                if symbols >= CHUNK:
                    yield flush()
                    held, keys, symbols, docs = [], [], 0, 0
        if held:
            yield flush()

    return run


def _distinct(body: np.ndarray, anchor: np.ndarray) -> tuple:
    """Distinct block hashes with their counts and anchors with the block hash they have if it is only one, else 0."""
    ub, back_b, count = np.unique(body, return_inverse=True, return_counts=True)
    ua, back_a = np.unique(anchor, return_inverse=True)
    low, high = np.full(len(ua), np.iinfo(np.int64).max), np.full(len(ua), np.iinfo(np.int64).min)
    np.minimum.at(low, back_a, body)
    np.maximum.at(high, back_a, body)
    return ub, back_b, np.minimum(count, 2).astype(np.uint8), ua, back_a, np.where(low == high, low, 0)


def _dest(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key.view(U64) >> U64(17)) % U64(parts)).astype(np.int64)


def _runs(dest: np.ndarray) -> dict[int, np.ndarray]:
    """Places of each destination that occurs, so that the work grows with the entries, not with the destinations."""
    order = np.argsort(dest, kind="stable")
    cut = np.flatnonzero(np.diff(dest[order])) + 1
    return {int(dest[x[0]]): x for x in np.split(order, cut)} if len(order) else {}


def _ask(parts: int) -> Callable:
    names = ["dest", "chunk", "body", "count", "anchor", "single"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ub, _, count, ua, _, single = _distinct(np.frombuffer(row["body"], np.int64), np.frombuffer(row["anchor"], np.int64))
                at_b, at_a, none = _runs(_dest(ub, parts)), _runs(_dest(ua, parts)), np.empty(0, np.int64)
                out = [(d, row["chunk"], ub[x := at_b.get(d, none)].tobytes(), count[x].tobytes(), ua[y := at_a.get(d, none)].tobytes(), single[y].tobytes()) for d in sorted(at_b.keys() | at_a.keys())]
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=names)

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each chunk's entries, in its order: flags of block hashes (1 repeated, 2 leader) and anchors (1 mixed)."""
    pdf = pdf.sort_values("chunk", kind="stable")
    bodies = [np.frombuffer(x, np.int64) for x in pdf["body"]]
    anchors = [np.frombuffer(x, np.int64) for x in pdf["anchor"]]
    _, first, back = np.unique(np.concatenate(bodies), return_index=True, return_inverse=True)
    total = np.bincount(back, np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["count"]]), minlength=len(first))
    flag = (total >= 2).astype(np.uint8)[back]
    flag[first] |= 2
    ua, back = np.unique(np.concatenate(anchors), return_inverse=True)
    single = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["single"]])
    low, high = np.full(len(ua), np.iinfo(np.int64).max), np.full(len(ua), np.iinfo(np.int64).min)
    np.minimum.at(low, back, single)
    np.maximum.at(high, back, single)
    mixed = ((low != high) | (low == 0)).astype(np.uint8)[back]
    eb, ea = np.cumsum([len(x) for x in bodies])[:-1], np.cumsum([len(x) for x in anchors])[:-1]
    return pd.DataFrame({"chunk": pdf["chunk"].values, "dest": pdf["dest"].values, "body": [x.tobytes() for x in np.split(flag, eb)], "anchor": [x.tobytes() for x in np.split(mixed, ea)]})


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges; ranges that touch become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[new], reach[np.concatenate((new[1:], [True]))]


def pack(start: np.ndarray, end: np.ndarray) -> bytes:
    return np.stack([start, end], 1).astype(np.int32).tobytes()


REQUEST = np.dtype([("anchor", "<i8"), ("a", "<i4"), ("n", "<i4"), ("p", "<i4"), ("weight", "<i4")])


def _apply(spec: Spec, parts: int) -> Callable:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        flags = {d: (np.frombuffer(b, np.uint8), np.frombuffer(a, np.uint8)) for d, b, a in zip(right["dest"], right["body"], right["anchor"])}
        for row in left.to_dict("records"):
            c = {k: np.frombuffer(row[k], t) for k, t in KINDS.items()}
            kd, kt = np.frombuffer(row["kd"], np.int64), np.frombuffer(row["kt"], np.int64)
            if not len(c["a"]):
                continue
            ub, back_b, _, ua, back_a, _ = _distinct(c["body"], c["anchor"])
            got = []
            for i, (key, back) in enumerate(((ub, back_b), (ua, back_a))):
                flag = np.zeros(len(key), np.uint8)
                for d, at in _runs(_dest(key, parts)).items():
                    flag[at] = flags[d][i]
                got.append(flag[back])
            repeated, leader, mixed = got[0] & 1 > 0, got[0] & 2 > 0, got[1] > 0
            first = np.zeros(len(back_b), bool)
            first[np.unique(back_b, return_index=True)[1]] = True
            asked = mixed & (~repeated | (leader & first))
            for d in np.unique(c["doc"][repeated | asked]):
                lo, hi = np.searchsorted(c["doc"], (d, d + 1))
                s = slice(lo, hi)
                r = repeated[s]
                spans = pack(*merge(c["a"][s][r], (c["a"][s] + c["n"][s] - 1 + spec.window)[r])) if r.any() else None
                q = np.flatnonzero(asked[s]) + lo
                req = np.empty(len(q), REQUEST)
                for k in ("anchor", "a", "n", "p"):
                    req[k] = c[k][q]
                req["weight"] = 1 + repeated[q]
                out.append((kd[d], kt[d], spans, req.tobytes() if len(q) else None))
        return pd.DataFrame(out, columns=["kd", "kt", "spans", "asked"])

    return run


def _contents(spec: Spec) -> Callable:
    """Symbols of the asked blocks: raw bytes, or 64-bit word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kd, kt, text, asked in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = text.encode()
                if spec.words:
                    data = word_symbols(np.frombuffer(data, np.uint8))[0].tobytes()
                w = spec.width
                rows += [(q["anchor"], q["salt"], q["weight"], kd, kt, q["a"], q["n"], q["p"], data[w * q["a"] : w * (q["a"] + q["n"] - 1 + spec.window)]) for q in asked]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["anchor", "salt", "weight", "kd", "kt", "a", "n", "p", "data"])

    return run


B_SCHEMA = "anchor long, salt int, weight int, kd long, kt long, a int, n int, p int, data binary"
S_SCHEMA = "kd long, kt long, spans binary"


def _decode(spec: Spec, rows: pd.DataFrame) -> tuple:
    contents = [np.frombuffer(x, np.int64).view(U64) for x in rows["data"]] if spec.words else list(rows["data"])
    return rows["weight"].to_numpy(), rows["n"].to_numpy(), rows["p"].to_numpy(), contents


def _spans(spec: Spec, rows: pd.DataFrame, marks: list) -> Iterator[tuple]:
    for kd, kt, a, weight, mark in zip(rows["kd"], rows["kt"], rows["a"], rows["weight"], marks):
        if weight < 2 and mark.any():
            at = a + np.flatnonzero(mark)
            yield kd, kt, pack(*merge(at, at + spec.window))


def _solve_sorted(spec: Spec) -> Callable:
    """Solves groups that arrive sorted by anchor, many at a time; a group that crosses batches is carried over."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solved(rows: pd.DataFrame) -> pd.DataFrame:
            weight, n, p, contents = _decode(spec, rows)
            return pd.DataFrame(_spans(spec, rows, spec.solver(rows["anchor"].to_numpy(), weight, n, p, contents)), columns=["kd", "kt", "spans"])

        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= 2 * GROUP:
                rows = pd.concat(held)
                last = rows["anchor"].iloc[-1]
                cut = int(np.argmax(rows["anchor"].to_numpy() == last))
                if cut:
                    yield solved(rows.iloc[:cut])
                    held = [rows.iloc[cut:]]
        if held:
            yield solved(pd.concat(held))

    return run


def digests(spec: Spec, n: np.ndarray, contents: list) -> list:
    """64-bit hash of each window of each block."""
    out = []
    for m, c in zip(n, contents):
        roll = Rolling(c if spec.words else byte_symbols(np.frombuffer(c, np.uint8)))
        s = np.arange(m)
        out.append(roll.ranges(s, s + spec.window))
    return out


def _shard_ask(spec: Spec, parts: int) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        weight, n, _, contents = _decode(spec, rows)
        found = digests(spec, n, contents)
        key, back = np.unique(np.concatenate(found), return_inverse=True)
        key = key.view(np.int64)
        count = np.minimum(np.bincount(back, np.repeat(weight, n)), 2).astype(np.uint8)
        anchor, salt = rows["anchor"].iloc[0], rows["salt"].iloc[0]
        return pd.DataFrame([(d, anchor, salt, key[x].tobytes(), count[x].tobytes()) for d, x in _runs(_dest(key, parts)).items()], columns=["dest", "anchor", "salt", "key", "count"])

    return run


def _shard_answer(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = [np.frombuffer(x, np.int64) for x in pdf["key"]]
    counts = [np.frombuffer(x, np.uint8) for x in pdf["count"]]
    _, back = np.unique(np.concatenate(keys), return_inverse=True)
    many = (np.bincount(back, np.concatenate(counts)) >= 2)[back]
    cut = np.cumsum([len(x) for x in keys])[:-1]
    return pd.DataFrame([(a, s, k[m & (c < 2)].tobytes()) for a, s, k, c, m in zip(pdf["anchor"], pdf["salt"], keys, counts, np.split(many, cut))], columns=["anchor", "salt", "key"])


def _shard_solve(spec: Spec) -> Callable:
    def run(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        weight, n, p, contents = _decode(spec, rows)
        marks = spec.solver(np.zeros(len(rows), np.int64), weight, n, p, contents)
        known = np.sort(np.concatenate([np.frombuffer(x, np.int64) for x in got["key"]] or [np.empty(0, np.int64)]))
        if len(known):
            marks = [m | (known[np.minimum(np.searchsorted(known, d.view(np.int64)), len(known) - 1)] == d.view(np.int64)) for m, d in zip(marks, digests(spec, n, contents))]
        return pd.DataFrame(_spans(spec, rows, marks), columns=["kd", "kt", "spans"])

    return run


def repeated(docs: DataFrame, spec: Spec) -> DataFrame:
    """kd, kt, spans (list of packed int32 start/end pairs, in symbols) of documents with a repeated window."""
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = scratch.Table(docs.select("kd", "kt", "text").mapInArrow(_describe(spec), R_SCHEMA), "blocks")
    described = table.read()
    total = described.agg(F.sum("n_blocks")).first()[0] or 0
    parts = max(4 * width, -(-total // ENTRIES))  # an answering group holds ENTRIES entries, however many there are
    ask = described.select("chunk", "body", "anchor").mapInArrow(_ask(parts), "dest long, chunk long, body binary, count binary, anchor binary, single binary")
    answers = ask.groupBy("dest").applyInPandas(_answer, "chunk long, dest long, body binary, anchor binary")
    found = described.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_apply(spec, parts), "kd long, kt long, spans binary, asked binary")
    found = scratch.checkpoint(found)
    table.drop()

    asked = found.where("asked IS NOT NULL").mapInArrow(_requests, "kd long, kt long, anchor long, a int, n int, p int, weight int")
    sizes = asked.groupBy("anchor").count()
    hot = scratch.checkpoint(sizes.where(F.col("count") > GROUP).select("anchor", F.ceil(F.col("count") / GROUP).cast("int").alias("shards")))
    some_hot = not hot.isEmpty()
    if some_hot:
        # windows of sharded blocks, an entry each at most: answering groups hold ENTRIES of them too
        windows = asked.join(hot, "anchor", "left_semi").agg(F.sum("n")).first()[0]
        shard_parts = max(width, -(-windows // ENTRIES))
        asked = asked.join(hot, "anchor", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("kd", "kt", "a"), F.col("shards")).cast("int"), F.lit(-1))).drop("shards")
    else:
        asked = asked.withColumn("salt", F.lit(-1))
    wanted = asked.groupBy("kd", "kt").agg(F.collect_list(F.struct("anchor", "salt", "a", "n", "p", "weight")).alias("asked"))
    contents = scratch.Table(docs.select("kd", "kt", "text").dropDuplicates(["kd", "kt"]).join(wanted, ["kd", "kt"]).select("kd", "kt", "text", "asked").mapInArrow(_contents(spec), B_SCHEMA), "contents")
    rows = contents.read()
    solved = rows.where("salt < 0").repartition(F.col("anchor")).sortWithinPartitions("anchor").mapInPandas(_solve_sorted(spec), S_SCHEMA)
    if some_hot:
        shards = rows.where("salt >= 0")
        keys = shards.groupBy("anchor", "salt").applyInPandas(_shard_ask(spec, shard_parts), "dest long, anchor long, salt int, key binary, count binary")
        got = keys.groupBy("dest").applyInPandas(_shard_answer, "anchor long, salt int, key binary")
        solved = solved.unionByName(shards.groupBy("anchor", "salt").cogroup(got.groupBy("anchor", "salt")).applyInPandas(_shard_solve(spec), S_SCHEMA))
    solved = scratch.checkpoint(solved)
    contents.drop()
    return found.where("spans IS NOT NULL").select("kd", "kt", "spans").unionByName(solved).groupBy("kd", "kt").agg(F.collect_list("spans").alias("spans"))


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kd, kt = (np.asarray(batch.column(i)) for i in (0, 1))
        reqs = [np.frombuffer(x, REQUEST) for x in batch.column(3).to_pylist()]
        many = [len(r) for r in reqs]
        if sum(many):
            all_ = np.concatenate(reqs)
            cols = [np.repeat(kd, many), np.repeat(kt, many), *(np.ascontiguousarray(all_[c]) for c in ("anchor", "a", "n", "p", "weight"))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kd", "kt", "anchor", "a", "n", "p", "weight"])


def union_of(packed: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    if packed is None or not len(packed):
        none = np.empty(0, np.int64)
        return none, none
    both = np.concatenate([np.frombuffer(x, np.int32) for x in packed]).astype(np.int64)
    return merge(both[0::2], both[1::2])
