"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed (SEED lower-case tokens in a row) are joined by the seed alone.  A tile
lies in shared seeds, so the tokens of the item that they cover bound its coverage from above; only pairs whose bound
reaches COVERAGE get their texts.  There the longest common runs of unmarked tokens are marked repeatedly (running
Karp-Rabin: hashes of windows of one length at a time, long windows first), whatever their order, so that reordered
passages count.  An item is leaked into a document if its marked tokens are COVERAGE of all of its tokens at least.
An item of fewer than SEED tokens is its own seed: a document that has them in a row holds all of it, one tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import memory, repeats, scratch
from matchloom.llm.seqanchor import U64, Rolling, byte_symbols, mix

SEED, TILE, START, COVERAGE = 5, 5, 20, 0.5
#: Benchmark seeds that the scan may hold in memory to skip documents early (8 bytes each); beyond, all seeds are joined.
HELD = 2_000_000


def _separators() -> np.ndarray:
    table = np.ones(256, bool)
    table[0x80:] = False
    for c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[c] = False
    return table


SEPARATOR = _separators()


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts laid end to end, tokens per text.  Tokens: runs of letters, digits and marks, of any script."""
    column = pc.replace_substring_regex(pc.utf8_lower(column.cast(pa.large_string())), r"[^\x00-\x7f\p{L}\p{N}\p{M}]+", " ")
    parts = [(x.as_py() or "").encode() for x in column]
    buf = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    word = ~SEPARATOR[buf]
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sym = Rolling(byte_symbols(buf)).ranges(start, end) if len(start) else np.empty(0, U64)
    return sym, np.diff(np.searchsorted(start, np.cumsum([len(p) + 1 for p in parts])), prepend=0)


def seeds(sym: np.ndarray, lengths: np.ndarray, size: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed hashes (size tokens in a row), the text each belongs to and its place there."""
    if len(sym) < size:
        return (np.empty(0, np.int64),) * 3
    h = Rolling(sym).grams(size)
    h = (h if size == SEED else mix(h + U64(size))).view(np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(sym)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = doc[: len(h)] == doc[size - 1 :]
    return h[inside], doc[: len(h)][inside], place[: len(h)][inside]


def tile(item: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in text, length) of at least TILE tokens, longest first."""
    used_p, used_t = np.zeros(len(item), bool), np.zeros(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    size = max(TILE, min(START, len(item)))
    while size >= TILE:
        found = []
        if len(item) >= size and len(text) >= size:
            index: dict[int, list[int]] = {}
            for i, h in enumerate(Rolling(item).grams(size).tolist()):
                if not used_p[i : i + size].any():
                    index.setdefault(h, []).append(i)
            hashes = Rolling(text).grams(size)
            for t in np.flatnonzero(np.isin(hashes, np.fromiter(index, U64, len(index)))).tolist() if index else ():
                if used_t[t : t + size].any():
                    continue
                for i in index[int(hashes[t])]:
                    if i and t and item[i - 1] == text[t - 1] and not used_p[i - 1] and not used_t[t - 1]:
                        continue  # part of a longer match that starts before
                    k = size
                    while i + k < len(item) and t + k < len(text) and item[i + k] == text[t + k] and not used_p[i + k] and not used_t[t + k]:
                        k += 1
                    found.append((k, i, t))
        longest = max((k for k, _, _ in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        again = False
        for k, i, t in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if not used_p[i : i + k].any() and not used_t[t : t + k].any():
                tiles.append((i, t, k))
                used_p[i : i + k] = used_t[t : t + k] = True
            else:
                again = True  # what is left of it may still be a tile of this length
        if again and any(k >= size for k, _, _ in found):
            rest = [1 for k, i, t in found if _free(used_p[i : i + k] | used_t[t : t + k]) >= size]
            if rest:
                continue
        size = size // 2 if size >= 2 * TILE else TILE if size > TILE else 0
    return tiles


def _free(used: np.ndarray) -> int:
    """Longest run of unmarked tokens."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], used, [True])).astype(np.int8)))
    return int((edge[1::2] - edge[0::2]).max()) if len(edge) else 0


def _scan(held, sizes: list[int]):
    """Texts with their distinct seeds of the given sizes; held: a broadcast array of all seeds of items, if they fit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if held is None else held.value
        for batch in batches:
            size = max(1, min(500, batch.num_rows))
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                sym, lengths = tokens(part.column(3))
                all_ = [seeds(sym, lengths, k) for k in sizes]
                h, doc = (np.concatenate([x[i] for x in all_]) for i in (0, 1))
                if known is not None:
                    hit = known[np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))] == h if len(known) else np.zeros(len(h), bool)
                    h, doc = h[hit], doc[hit]
                if len(h):
                    pairs = np.unique(np.stack([doc, h], 1), axis=0)
                    rows, cut = np.unique(pairs[:, 0], return_index=True)
                    yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(rows)) for i in range(4)), pa.ListArray.from_arrays(pa.array(np.append(cut, len(pairs)), pa.int32()), pa.array(pairs[:, 1]))], names=["kd", "kt", "doc_id", "text", "seeds"])
            memory.give_back()

    return run


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, seed, place and the item's number of tokens; an item of fewer than SEED tokens is one seed."""
    for batch in batches:
        sym, lengths = tokens(batch.column(1))
        for size in range(1, SEED + 1):
            h, doc, place = seeds(sym, lengths, size)
            own = lengths[doc] == size if size < SEED else lengths[doc] >= SEED
            doc = doc[own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(h[own]), pa.array(place[own].astype(np.int32)), pa.array(lengths[doc].astype(np.int32))], names=["item", "seed", "place", "n_tokens"])


def _tile(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, t = None, None
    for frame in frames:
        rows = []
        for kd, kt, doc_id, text, item_id, item in frame[["kd", "kt", "doc_id", "text", "item_id", "item_text"]].itertuples(index=False):
            if last != (kd, kt):  # pairs come sorted by document: its tokens are made once
                last, t = (kd, kt), tokens(pa.array([text]))[0]
            p = tokens(pa.array([item]))[0]
            tiles = tile(p, t)
            rows.append((kd, kt, doc_id, item_id, sum(k for _, _, k in tiles) / max(1, len(p)), len(tiles)))
        yield pd.DataFrame(rows, columns=["kd", "kt", "doc_id", "item_id", "coverage", "n_tiles"])


def _bound(places: Column) -> Column:
    """Tokens that seeds at these places (sorted) cover."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    add = lambda a, p: F.struct((p + SEED).alias("end"), (a["n"] + p + SEED - F.greatest(a["end"], p)).alias("n"))
    return F.aggregate(places, start, add, lambda a: a["n"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """kd, kt, doc_id, item_id, coverage, n_tiles of each pair of docs(doc_id, text) and benchmark(item_id, text) that leaks.

    Null texts have no tokens, and an item without tokens never matches.  Repeated rows give one pair; an item_id with
    several texts gives its best coverage (of ties, the fewest tiles).  Empty tables give no rows; other columns are
    ignored, whatever their names.  Of equally long matches the first in the item, then in the text, is marked first.
    Texts are tokenised whole, in memory of about 60 times the bytes of the longest.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.xxhash64("item_id", F.coalesce("text", F.lit(""))).alias("item"), "item_id", F.coalesce("text", F.lit("")).alias("item_text")).dropDuplicates(["item"])
    index = scratch.checkpoint(items.select("item", "item_text").mapInArrow(_item_seeds, "item long, seed long, place int, n_tokens int"))
    sizes = sorted({min(r[0], SEED) for r in index.select("n_tokens").distinct().where(F.col("n_tokens") <= SEED).collect()} | {SEED})
    bound = index.select("seed").distinct()
    held = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in bound.collect()], np.int64))) if bound.count() <= HELD else None
    rows = repeats.keyed(docs).select("kd", "kt", "doc_id", "text")
    found = scratch.Table(rows.mapInArrow(_scan(held, sizes), "kd long, kt long, doc_id long, text string, seeds array<long>"), "seeded")
    seeded = found.read().dropDuplicates(["kd", "kt"])
    met = seeded.select("kd", "kt", "doc_id", F.explode("seeds").alias("seed")).join(index, "seed")
    short = met.where(F.col("n_tokens") < SEED).select("kd", "kt", "doc_id", "item").distinct().join(items.select("item", "item_id"), "item")
    short = short.select("kd", "kt", "doc_id", "item_id", F.lit(1.0).alias("coverage"), F.lit(1).alias("n_tiles"))
    pairs = met.where(F.col("n_tokens") >= SEED).groupBy("kd", "kt", "item", "n_tokens").agg(F.sort_array(F.collect_list("place")).alias("places"))
    pairs = pairs.where(_bound(F.col("places")) >= COVERAGE * F.col("n_tokens")).select("kd", "kt", "item")
    joined = seeded.select("kd", "kt", "doc_id", "text").join(pairs, ["kd", "kt"]).join(items, "item").select("kd", "kt", "doc_id", "text", "item_id", "item_text")
    tiled = joined.sortWithinPartitions("kd", "kt").mapInPandas(_tile, "kd long, kt long, doc_id long, item_id long, coverage double, n_tiles int")
    out = scratch.checkpoint(tiled.where(F.col("coverage") >= COVERAGE).unionByName(short))
    found.drop()
    return out.groupBy("kd", "kt", "doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.min_by("n_tiles", F.struct(-F.col("coverage"), "n_tiles")).alias("n_tiles"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs (all columns) into which no benchmark item leaks."""
    bad = leaks(docs.select("doc_id", "text"), benchmark).select("kd", "kt").distinct()
    return repeats.boxed(docs).select("row", "kd", "kt").join(bad, ["kd", "kt"], "left_anti").select("row.*")


def op3_tiling_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "n_tiles")
