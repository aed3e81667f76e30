"""Near-duplicates by DartMinHash, banded joining and exact verification.

Elements are five-word shingles, weighted by how often a text has them.  The weight axis of an element is cut into regions
[0, 1), [1, 2), [2, 4), [4, 8) ...; each region is hit by a hashed Poisson stream of darts with rising ranks, as dense as
it is wide, and a dart counts for a text whose weight lies beyond it.  Each dart falls on one of COORDINATES slots, and
the earliest dart per slot is the signature: two texts agree in a slot with the probability of their weighted Jaccard
similarity, at a cost of a few streams per element, however heavy it is, instead of one hash per element and slot.

Texts with equal words form one node first.  Nodes that share a band of the signature are candidates: all members of
a bucket are compared with its least member; what that leaves unconnected is compared with the whole bucket, block by
block.  Two bags of similarity THRESHOLD share one of the rarest elements of each (of the block's order, as many as the
threshold lets differ, and one), so only members that share such an element are compared, and a bucket of texts that have
nothing but frequent elements in common costs far less than its square.  Candidates are verified on their whole shingle
bags; classes are the connected components of pairs of similarity THRESHOLD or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import memory, repeats, scratch
from matchloom.llm.seqanchor import U64, Rolling, mix, word_symbols

SHINGLE, THRESHOLD = 5, 0.8
#: Bands of ROWS slots: a pair of similarity 0.8 shares a band with probability 0.9998.
BANDS, ROWS = 28, 6
COORDINATES = BANDS * ROWS
#: Expected darts per text; an empty slot doubles it for that text.
DARTS = COORDINATES * (np.log(COORDINATES) + 3)
#: Texts signed together, darts thrown at a time and bytes of texts taken at a time (one text at least), which bound a
#: task's memory.
TOGETHER, STEP, SLICE = 256, 200_000, 800_000
#: Members of a bucket, and elements of their bags, that one task holds of either side; larger buckets are dealt to several.
BLOCK, HOLD = 2000, 8_000_000


def _shingle_hashes(sym: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles (under five words: one), their texts, and where a text's first is."""
    starts = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), np.where(lengths >= SHINGLE, lengths - SHINGLE + 1, np.minimum(lengths, 1)))
    if not len(doc):
        return np.empty(0, U64), doc, np.empty(0, bool)
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    rank = np.arange(len(doc)) - np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))
    at = starts[doc] + rank
    return Rolling(sym).ranges(at, at + np.minimum(lengths, SHINGLE)[doc]), doc, first


def bags(sym: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements of bags (hash of shingle and of how often it came before) and their text: similarity is that of sets."""
    h, doc, _ = _shingle_hashes(sym, lengths)
    own = mix(h ^ mix(doc.astype(U64) + U64(1)))
    order = np.argsort(own, kind="stable")
    run = np.concatenate(([True], own[order][1:] != own[order][:-1])) if len(own) else np.empty(0, bool)
    before = np.empty(len(doc), np.int64)
    before[order] = np.arange(len(doc)) - np.maximum.accumulate(np.where(run, np.arange(len(doc)), 0))
    return mix(h + before.astype(U64) * U64(0x9E3779B97F4A7C15)), doc


def weighted(sym: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their texts and how often the text has them."""
    elements, doc, first = _shingle_hashes(sym, lengths)
    own = mix(elements ^ mix(doc.astype(U64) + U64(1)))
    _, at, weight = np.unique(own, return_index=True, return_counts=True)
    order = np.argsort(doc[at], kind="stable")
    return elements[at][order], doc[at][order], weight[order]


def signatures(elements: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """[n, COORDINATES] identities of the earliest darts; texts without elements have zeros."""
    out = np.zeros((n, COORDINATES), U64)
    total = np.bincount(doc, weight, minlength=n)
    reach = np.where(total > 0, DARTS / np.maximum(total, 1), 0.0)
    # regions of the weight axis that an element reaches into: from low on, so wide, with so much of it inside
    regions = [(np.flatnonzero(weight > low), low, max(low, 1)) for low in (0, *(1 << np.arange(int(weight.max(initial=1)).bit_length())).tolist())]
    at = np.concatenate([r[0] for r in regions])
    low = np.concatenate([np.full(len(r[0]), r[1]) for r in regions])
    width = np.concatenate([np.full(len(r[0]), float(r[2])) for r in regions])
    stream, owner = mix(elements[at] + low.astype(U64) * U64(0x9E3779B97F4A7C15)), doc[at]
    inside = np.minimum(1.0, (weight[at] - low) / width)
    todo = np.flatnonzero(total)
    while len(todo):
        local = np.full(n, -1)
        local[todo] = np.arange(len(todo))
        mine = np.flatnonzero(local[owner] >= 0)
        e, slot_base, limit, wide, part = stream[mine], local[owner[mine]] * COORDINATES, reach[owner[mine]], width[mine], inside[mine]
        best = np.full(len(todo) * COORDINATES, np.iinfo(np.uint64).max, U64)
        rank, turn = np.zeros(len(e)), 0
        while len(e):
            # several darts of each region at once where few regions are left
            ahead = np.arange(turn + 1, turn + 1 + max(1, min(256, STEP // len(e))), dtype=U64) * U64(0xD1342543DE82EF95)
            turn += len(ahead)
            u = mix(e[:, None] + ahead)
            ranks = np.cumsum(-np.log(((u >> U64(11)).astype(np.float64) + 1) / (1 << 53)) / wide[:, None], axis=1) + rank[:, None]
            hit = ranks < limit[:, None]
            live = hit[:, -1]
            u = mix(u[hit])
            place = (mix(u + U64(0xA0761D6478BD642F)) >> U64(11)).astype(np.float64) / (1 << 53)
            counts = place < np.broadcast_to(part[:, None], hit.shape)[hit]
            u = u[counts]
            dart = (ranks[hit][counts].astype(np.float32).view(np.uint32).astype(U64) << U64(32)) | (u & U64(0xFFFFFFFF))
            np.minimum.at(best, np.broadcast_to(slot_base[:, None], hit.shape)[hit][counts] + ((u >> U64(32)) % U64(COORDINATES)).astype(np.int64), dart)
            e, slot_base, limit, rank, wide, part = e[live], slot_base[live], limit[live], ranks[live, -1], wide[live], part[live]
        best = best.reshape(len(todo), COORDINATES)
        full = (best != np.iinfo(np.uint64).max).all(1)
        out[todo[full]] = best[full] & U64(0xFFFFFFFF)
        todo = todo[~full]
        reach[todo] *= 2
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    h = np.tile(np.arange(1, BANDS + 1, dtype=U64), (len(sig), 1))
    for r in range(ROWS):
        h = mix(h * U64(0x9E3779B97F4A7C15) + sig[:, r::ROWS][:, :BANDS])
    return h.view(np.int64)


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, buf, ends in repeats._slices(batch.column(at), True, SLICE):
        sym, start, _ = word_symbols(buf)
        yield i, j, sym, np.diff(np.searchsorted(start, ends), prepend=0)
    memory.give_back()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, sym, lengths in _texts(batch, 3):
            ends = np.cumsum(lengths)
            one, two = Rolling(sym).ranges(ends - lengths, ends), Rolling(mix(sym)).ranges(ends - lengths, ends)
            elements, doc, weight = weighted(sym, lengths)
            cut = np.searchsorted(doc, np.arange(0, j - i + TOGETHER, TOGETHER))
            parts = [signatures(elements[lo:hi], doc[lo:hi] - k * TOGETHER, weight[lo:hi], min(TOGETHER, j - i - k * TOGETHER)) for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:]))]
            keys = band_keys(np.concatenate(parts))
            node = [a.tobytes() + b.tobytes() for a, b in zip(one, two)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in range(3)), pa.array(node, pa.binary()), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(np.arange(j - i + 1, dtype=np.int32) * BANDS, pa.array(keys.ravel()))], names=["kd", "kt", "doc_id", "node", "n_words", "bands"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, sym, lengths in _texts(batch, 1):
            elements, doc = bags(sym, lengths)
            small = (elements >> U64(32)).astype(np.uint32)
            cut = np.searchsorted(doc, np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([np.unique(small[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["node", "bag"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sims = np.zeros(batch.num_rows)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            a, b = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
            if min(len(a), len(b)) >= 0.5 * max(len(a), len(b)):
                both = len(np.intersect1d(a, b, assume_unique=True))
                sims[i] = both / max(1, len(a) + len(b) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims)], names=["a", "b", "sim"])


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between components: similar pairs of an asking member and any other of the block.

    Of the links that join what the block has joined already, none is returned: connections are the same without.
    """
    asks = rows["asks"].to_numpy(bool)
    mine = rows["mine"].to_numpy(object)
    root: dict[bytes, bytes] = {m: m for m in mine}

    def find(x: bytes) -> bytes:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    bag = [np.frombuffer(x, np.uint32) for x in rows["bag"]]
    size = np.array([len(x) for x in bag])
    known, number = np.unique(np.concatenate(bag), return_inverse=True)
    # elements named by how rare they are among the block's members; prefixes are a bag's rarest
    rarity = np.argsort(np.argsort(np.bincount(number, minlength=len(known)), kind="stable"), kind="stable")
    named = np.split(rarity[number], np.cumsum(size)[:-1])
    prefix = [np.sort(x)[: len(x) - int(np.ceil(THRESHOLD * len(x) - 1e-9)) + 1] for x in named]
    member = np.array(sorted(np.flatnonzero(~asks), key=lambda i: mine[i]), np.int64)
    flat = np.concatenate([prefix[i] for i in member]) if len(member) else np.empty(0, np.int64)
    owner = np.repeat(member, [len(prefix[i]) for i in member])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = []
    for q in np.flatnonzero(asks):
        met = np.zeros(len(bag), bool)
        for lo, hi in zip(np.searchsorted(flat, prefix[q], "left").tolist(), np.searchsorted(flat, prefix[q], "right").tolist()):
            met[owner[lo:hi]] = True
        met &= (size >= THRESHOLD * size[q] - 1e-9) & (THRESHOLD * size <= size[q] + 1e-9)
        own = find(mine[q])
        for k in np.flatnonzero(met).tolist():
            other = find(mine[k])
            if own == other:
                continue
            both = len(np.intersect1d(bag[q], bag[k], assume_unique=True))
            if both >= THRESHOLD * (size[q] + size[k] - both) - 1e-9:
                root[max(own, other)] = own = min(own, other)
                out.append((mine[q], mine[k]))
    return pd.DataFrame(out, columns=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, comp (least node of its component) of the nodes of edges(a, b): least labels, with pointer jumping."""
    both = scratch.checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = scratch.checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = label.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = step.alias("s").join(label.select(F.col("node").alias("comp"), F.col("comp").alias("far")), "comp").select("node", "old", F.least("comp", "far").alias("comp"))
        new = scratch.checkpoint(jump)
        changed = not new.where("comp <> old").isEmpty()
        label = new.select("node", "comp")
        if not changed:
            return label


def classes(docs: DataFrame) -> DataFrame:
    """kd, kt (which name id and text), doc_id, class_id (least doc_id of the class), kept of every row of docs(doc_id, text).

    Texts with equal words are one node.  A text without words (null, empty)
    is a class of its own.  A null doc_id has the class_id of its class, or null if all of its ids are null.  Of rows that
    tie for being kept (id and text repeated) all are marked kept.  An empty table gives no rows; other columns are ignored,
    whatever their names.  One text is signed whole, in memory of about 60 times its bytes.
    """
    rows = repeats.keyed(docs).withColumn("kt", F.xxhash64("text", F.col("doc_id").isNull()))  # apart from a real id that NULL_ID stands for
    signed = scratch.Table(rows.select("kd", "kt", "doc_id", "text").mapInArrow(_sign, "kd long, kt long, doc_id long, node binary, n_words long, bands array<long>"), "signed")
    known = signed.read().where("n_words > 0")
    nodes = known.select("node", "n_words", "bands").dropDuplicates(["node"])
    keyed = nodes.select("node", "n_words", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n"), F.sum("n_words").alias("held")).where("n > 1")
    bucket_table = scratch.Table(keyed.join(shared, "key"), "buckets")
    buckets = bucket_table.read()
    pairs = scratch.checkpoint(buckets.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())

    # shingle bags of the nodes that share a bucket with another one
    owner = known.select("node", "kd", "kt").groupBy("node").agg(F.min(F.struct("kd", "kt")).alias("k"))
    wanted = owner.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "k.kd", "k.kt")
    bag_table = scratch.Table(rows.select("kd", "kt", "text").dropDuplicates(["kd", "kt"]).join(wanted, ["kd", "kt"]).select("node", "text").mapInArrow(_shingles, "node binary, bag binary"), "bags")
    bag = bag_table.read()

    def verified(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(bag.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a").join(bag.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
        return scratch.checkpoint(joined.select("a", "b", "bag_a", "bag_b").mapInArrow(_compare, "a binary, b binary, sim double"))

    sims = verified(pairs)
    label = components(sims.where(F.col("sim") >= THRESHOLD))
    # what a bucket's least member did not connect is compared with all of the bucket, in blocks
    named = buckets.where("n > 2").join(label.select("node", F.col("comp").alias("mine")), "node", "left").withColumn("mine", F.coalesce("mine", "node"))
    theirs = label.select(F.col("node").alias("least"), F.col("comp").alias("theirs"))
    apart = scratch.checkpoint(named.join(theirs, "least", "left").where(F.col("mine") != F.coalesce("theirs", "least")).select("key", "node", "n_words"))
    more = label
    if not apart.isEmpty():
        groups = scratch.checkpoint(apart.groupBy("key").agg(F.count("*").alias("asking"), F.sum("n_words").alias("weigh")))
        rest = named.join(groups, "key").join(apart.select("key", "node", F.lit(True).alias("asks")), ["key", "node"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        parts = lambda count, held: F.ceil(F.greatest(F.col(count) / BLOCK, F.col(held) / HOLD)).cast("int")
        sides = parts("asking", "weigh"), parts("n", "held")
        own = F.pmod(F.xxhash64("node"), F.lit(1 << 30)).cast("int")
        asked = rest.select("key", "node", "mine", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), sides[0] - 1)).alias("qb"), (own % sides[1]).alias("mb"))
        asking = rest.where("asks").select("key", "node", "mine", "asks", (own % sides[0]).alias("qb"), F.explode(F.sequence(F.lit(0), sides[1] - 1)).alias("mb"))
        met = asked.unionByName(asking).join(bag, "node").groupBy("key", "qb", "mb").applyInPandas(_meet, "a binary, b binary")
        more = components(scratch.checkpoint(met.distinct()))
    member = scratch.checkpoint(signed.read().select("kd", "kt", "doc_id", "node", "n_words"))
    for table in (signed, bucket_table, bag_table):
        table.drop()
    found = member.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    found = found.join(more.select(F.col("node").alias("comp"), F.col("comp").alias("wider")), "comp", "left").withColumn("comp", F.coalesce("wider", "comp"))
    # written, so that the join below reads both sides from shuffles of their own, which adaptive execution splits where one class is hot
    least = scratch.checkpoint(found.where("n_words > 0").groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "kd", "kt")).alias("keeper")))
    out = found.join(least, "comp", "left")
    lone = F.col("n_words") == 0
    keeps = (F.col("keeper.kd") == F.col("kd")) & (F.col("keeper.kt") == F.col("kt"))
    return out.select("kd", "kt", "doc_id", F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (lone | keeps).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each class of docs(doc_id, text, ...), all columns kept: the one with the least doc_id (null only if all are).

    Of rows that repeat id and text, one stays.  Texts without words all stay (once per id).
    """
    keep = scratch.checkpoint(classes(docs.select("doc_id", "text")).where("kept").select("kd", "kt").distinct())
    rows = repeats.boxed(docs).withColumn("kt", F.xxhash64("text", F.col("row.doc_id").isNull()))
    return rows.select("row", "kd", "kt").dropDuplicates(["kd", "kt"]).join(keep, ["kd", "kt"], "left_semi").select("row.*")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "class_id")
