"""Nearest weighted bags of words: chunks meet in tasks, so that no pair of bags is moved or written."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.vectors import SLACK, _cut

#: About so many queries meet so many bags in one task.
ASKED, HELD = 4_096, 16_384
#: So many numbers are held at once in one matrix.
CELLS = 1 << 22
#: A word is rare if less than one of so many pairs has it.
RARE = 512


def nearest(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """tid, aid, sim: of each chunk of a country the best k bags by cosine, with a common word at least; ties to the least id.

    Columns id (integer), country, x: array of (w, v), sorted, v positive; ids are distinct.
    """
    queries, base = (x.where("id IS NOT NULL AND country IS NOT NULL") for x in (queries, base))
    sizes = [x.groupBy("country").agg(F.ceil(F.count("*") / n).alias(c)).where(F.col(c) > 1) for x, n, c in ((queries, ASKED, "_nq"), (base, HELD, "_nb"))]
    counted = lambda x: x.join(F.broadcast(sizes[0]), "country", "left").join(F.broadcast(sizes[1]), "country", "left").na.fill(1, ["_nq", "_nb"])
    of, all_ = (lambda n: F.pmod(F.xxhash64("id"), F.col(n))), (lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    fields = [F.col("country").alias("country"), F.col("id").alias("id"), F.col("x.w").alias("w"), F.col("x.v").alias("v")]
    q = counted(queries).select(*fields, of("_nq").alias("_qb"), all_("_nb").alias("_bb"))
    b = counted(base).select(*fields, all_("_nq").alias("_qb"), of("_nb").alias("_bb"))
    on, dealt = ["country", "_qb", "_bb"], int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q, b = q.repartition(dealt, *on), b.repartition(dealt, *on)
    return q.groupBy(*on).cogroup(b.groupBy(*on)).applyInArrow(_meet(k), "tid long, aid long, sim double")


def _meet(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(q: pa.Table, b: pa.Table) -> pa.Table:
        if not q.num_rows or not b.num_rows:
            return pa.table({"tid": pa.array([], pa.int64()), "aid": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        b = b.sort_by("id")
        words = pc.unique(pc.list_flatten(q["w"]))
        words = words.take(pc.array_sort_indices(words))
        (qi, qw, qv), (bi, bw, bv) = (_entries(x, words) for x in (q, b))
        both = np.intersect1d(qw, bw)
        at = np.full(len(words), -1)
        at[both] = np.arange(len(both))
        (qi, qw, qv), (bi, bw, bv) = ((i[at[w] >= 0], at[w][at[w] >= 0], v[at[w] >= 0]) for i, w, v in ((qi, qw, qv), (bi, bw, bv)))
        # Products of frequent words are a matrix product, those of rare ones are added one by one.
        often = np.bincount(qw, minlength=len(both)) * np.bincount(bw, minlength=len(both)) * RARE > q.num_rows * b.num_rows
        dense = np.cumsum(often) - 1
        own, key = np.bincount(qi, minlength=q.num_rows), bi * max(1, len(both)) + bw  # sorted
        start, most, wide = np.cumsum(own) - own, int(own.max(initial=0)), max(1, int(often.sum()))
        rq, rb = ~often[qw], ~often[bw]
        by_word = np.argsort(bw[rb], kind="stable")
        rare_b, rare_v = bi[rb][by_word], bv[rb][by_word]
        many = np.bincount(bw[rb], minlength=len(both))
        begin = np.cumsum(many) - many
        held = np.zeros((b.num_rows, wide))
        held[bi[~rb], dense[bw[~rb]]] = bv[~rb]
        rows = max(1, CELLS // max(b.num_rows, wide))
        out = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        for first in range(0, q.num_rows, rows):
            last = min(first + rows, q.num_rows)
            mine = slice(start[first], start[last - 1] + own[last - 1])
            i, w, v, rare = qi[mine] - first, qw[mine], qv[mine], rq[mine]
            asked = np.zeros((last - first, wide))
            asked[i[~rare], dense[w[~rare]]] = v[~rare]
            about = asked @ held.T
            i, w, v = i[rare], w[rare], v[rare]
            at = np.repeat(np.arange(len(i)), many[w])
            to = np.arange(len(at)) - np.repeat(np.cumsum(many[w]) - many[w], many[w]) + begin[w][at]
            np.add.at(about, (i[at], rare_b[to]), v[at] * rare_v[to])
            near = about > 0
            if b.num_rows > k:
                near &= about >= np.partition(about, b.num_rows - k, axis=1)[:, b.num_rows - k, None] - SLACK
            u, c = np.nonzero(near)
            sim = np.zeros(len(u))
            for j in range(most):  # in the order of words, so that equal bags have equal sums
                there = np.flatnonzero(own[u + first] > j)
                entry = start[u[there] + first] + j
                word = qw[entry]
                plain = often[word]
                sim[there[plain]] += qv[entry[plain]] * held[c[there[plain]], dense[word[plain]]]
                there, entry, word = there[~plain], entry[~plain], word[~plain]
                sought = c[there] * max(1, len(both)) + word
                place = np.minimum(np.searchsorted(key, sought), len(key) - 1)
                sim[there] += np.where(key[place] == sought, qv[entry] * bv[place], 0.0)
            u, c, sim = _cut(u, c, sim, k, c, sim)
            out.append((u + first, c, sim))
        u, c, sim = (np.concatenate(x) for x in zip(*out))
        u, c, sim = _cut(u, c, sim, k, c, sim)
        return pa.table({"tid": q["id"].take(pa.array(u)), "aid": b["id"].take(pa.array(c)), "sim": pa.array(sim)})

    return run


def _entries(table: pa.Table, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, numbers of words and values of unit length, of the words that are known; in the order of rows and words."""
    w, v = table["w"].combine_chunks(), table["v"].combine_chunks()
    many = pc.list_value_length(w).to_numpy(zero_copy_only=False)
    row, value = np.repeat(np.arange(len(many)), many), pc.list_flatten(v).to_numpy(zero_copy_only=False)
    length = np.zeros(len(many))
    np.add.at(length, row, value * value)
    number = pc.fill_null(pc.index_in(pc.list_flatten(w), value_set=words), -1).to_numpy(zero_copy_only=False)
    known = number >= 0
    return row[known], number[known], (value / np.sqrt(length)[row])[known]
