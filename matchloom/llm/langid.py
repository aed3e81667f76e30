"""Language identification with unigram piece models, marginalised over segmentations.

Per language, every piece of a fixed public vocabulary has a probability; the probability of a word is the sum over all
ways to cut it into pieces (forward algorithm, any length), that of a text the product over its words.  Probabilities
are estimated by expectation-maximisation over the words of a bounded sample of labelled rows of each language
(SAMPLE).  Scoring works on distinct words, vectorised over words of one length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.seqanchor import U64, Rolling, mix

#: Labelled rows of each language to learn from, about: rows are taken by a hash of id and text, whole texts.
SAMPLE, ROUNDS = 800, 2
#: Positions between two rescalings of forward and backward sums, and lattice cells (word, position, piece) held at once.
STEP, CELLS = 16, 1_000_000
#: Probability of a character that no piece covers, and smoothing of piece counts.
UNKNOWN, SMOOTH = 1e-7, 0.01
VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
LETTER = regex.compile(r"\p{L}")


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)


def _symbols(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(U64) + U64(1))


class Vocabulary:
    """All ordinary pieces by hash: an open-addressed table in NumPy arrays.  reach: length of the longest piece."""

    BITS = 18

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.pieces = [p for p in dict.fromkeys(pieces) if p]
        self.reach = max(map(len, self.pieces))
        codes = _codes(self.pieces)
        end = np.cumsum([len(p) for p in self.pieces])
        start = np.concatenate(([0], end[:-1]))
        keys = Rolling(_symbols(codes)).ranges(start, end)
        size = 1 << self.BITS
        self.key, self.value = np.zeros(size, U64), np.full(size, -1, np.int32)
        self.probes = 0
        for i, k in enumerate(keys.tolist()):
            at, n = k >> (64 - self.BITS), 1
            while self.value[at] >= 0:
                at, n = (at + 1) % size, n + 1
            self.key[at], self.value[at] = k, i
            self.probes = max(self.probes, n)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or -1."""
        at = (keys >> U64(64 - self.BITS)).astype(np.int64)
        value = self.value[at]
        out = np.where(self.key[at] == keys, value, -1)
        rest = np.flatnonzero((out < 0) & (value >= 0))
        at = at[rest]
        for _ in range(self.probes - 1):
            if not len(rest):
                break
            at = (at + 1) % len(self.key)
            now = self.value[at]
            hit = (now >= 0) & (self.key[at] == keys[rest])
            out[rest[hit]] = now[hit]
            more = ~hit & (now >= 0)
            rest, at = rest[more], at[more]
        return out


@lru_cache(maxsize=1)
def vocabulary(path: str | None) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(path or public_tokenizers.path(VOCABULARY))


class Lattice:
    """Words of one length side by side, and which pieces end at which position."""

    def __init__(self, words: list[str], voc: Vocabulary) -> None:
        self.n, self.length, self.voc = len(words), len(words[0]), voc
        self.roll = Rolling(_symbols(_codes(words)))
        self.starts = range(0, self.length, STEP)
        self.reach = min(voc.reach, self.length)

    def pieces(self, s: int) -> np.ndarray:
        """[word, position s + 1.., k] index of the piece of reach - k characters that ends there (-1: none)."""
        end = np.arange(s + 1, min(s + STEP, self.length) + 1)
        j, i = np.broadcast_arrays(end[:, None], end[:, None] - np.arange(self.reach, 0, -1))
        fits = np.flatnonzero(i.ravel() >= 0)
        base = (np.arange(self.n) * self.length)[:, None]
        found = np.full((self.n, i.size), -1, np.int32)
        found[:, fits] = self.voc.find(self.roll.ranges((base + i.ravel()[fits]).ravel(), (base + j.ravel()[fits]).ravel())).reshape(self.n, len(fits))
        return found.reshape(self.n, *i.shape)


def lattices(words: list[str], voc: Vocabulary) -> Iterator[tuple[np.ndarray, Lattice]]:
    """Groups of words of one length, with their indices."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    for members in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else ():
        most = max(1, CELLS // (min(int(size[members[0]]), STEP) * voc.reach))
        for lo in range(0, len(members), most):
            rows = members[lo : lo + most]
            yield rows, Lattice([words[i] for i in rows], voc)


def _weights(table: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Probability of each arc (last row of the table: none); a character without a piece has UNKNOWN."""
    w = table[found]
    w[:, :, -1] = np.maximum(w[:, :, -1], UNKNOWN)
    return w


def _table(probs: np.ndarray) -> np.ndarray:
    return np.concatenate([probs.T.astype(float), np.zeros((1, len(probs)))])


def log_probabilities(words: list[str], probs: np.ndarray, voc: Vocabulary) -> np.ndarray:
    """[words, languages] natural logarithms of word probabilities: sums over all segmentations, rescaled on the way."""
    out = np.zeros((len(words), len(probs)))
    table = _table(probs)
    for rows, lat in lattices(words, voc):
        r = lat.reach
        a = np.zeros((lat.n, r + STEP, len(probs)))
        a[:, r - 1] = 1
        logs = np.zeros((lat.n, len(probs)))
        for s in lat.starts:
            w = _weights(table, lat.pieces(s))
            m = w.shape[1]
            for t in range(m):
                a[:, r + t] = np.einsum("nkc,nkc->nc", a[:, t : r + t], w[:, t])
            last = a[:, m : m + r].copy()
            top = last.max(1)
            logs += np.log(top)
            a[:, :r] = last / top[:, None]
        out[rows] = logs + np.log(a[:, r - 1])
    return out


def expected(lat: Lattice, times: np.ndarray, prob: np.ndarray, total: np.ndarray) -> None:
    """Adds the expected uses of each piece (last entry: of no piece) in words that occur so many times; in logarithms."""
    r, table = lat.reach, _table(prob[None])
    alpha, beta = (np.full((lat.n, r + lat.length), -np.inf) for _ in range(2))
    alpha[:, r - 1], beta[:, -1] = 0, np.log(times)
    with np.errstate(divide="ignore"):
        for s in lat.starts:
            w = np.log(_weights(table, lat.pieces(s))[..., 0])
            for t in range(w.shape[1]):
                alpha[:, r + s + t] = np.logaddexp.reduce(alpha[:, s + t : r + s + t] + w[:, t], axis=1)
        beta[:, -1] -= alpha[:, -1]
        for s in reversed(lat.starts):
            found = lat.pieces(s)
            w = np.log(_weights(table, found)[..., 0])
            for t in reversed(range(w.shape[1])):
                through = w[:, t] + beta[:, r + s + t, None]
                at = slice(s + t, r + s + t)
                uses = np.exp(alpha[:, at] + through)
                total += np.bincount(found[:, t].ravel() % len(total), uses.ravel(), minlength=len(total))
                beta[:, at] = np.logaddexp(beta[:, at], through)


def learn(counts: dict[str, Counter], voc: Vocabulary) -> tuple[list[str], np.ndarray]:
    """Languages and [languages, pieces] probabilities from word counts per language."""
    langs = sorted(counts)
    probs = np.full((len(langs), len(voc.pieces)), 1 / max(1, len(voc.pieces)))
    for c, lang in enumerate(langs):
        words = list(counts[lang])
        times = np.fromiter(counts[lang].values(), float, len(words))
        for _ in range(ROUNDS if words else 0):
            total = np.full(len(voc.pieces) + 1, SMOOTH)
            for rows, lat in lattices(words, voc):
                expected(lat, times[rows], probs[c], total)
            probs[c] = total[:-1] / total[:-1].sum()
    return langs, probs


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, Counter] = {}
    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"]):
            total.setdefault(lang, Counter()).update(MARK + w for w in text.split())
    for lang, own in total.items():
        if own:
            yield pd.DataFrame({"lang": lang, "word": list(own), "n": list(own.values())})


class Scorer:
    """Scores texts; remembers words it has met (MEMORY characters at most, then starts afresh)."""

    MEMORY = 12_000_000

    def __init__(self, langs: list[str], probs: np.ndarray, voc: Vocabulary) -> None:
        self.langs, self.probs, self.voc = langs, probs, voc
        self.known: dict[str, int] = {}
        self.logs, self.size = np.empty((0, len(langs))), 0

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        counts = [Counter(t.split()) if t and LETTER.search(t) else None for t in texts]
        fresh = list({w for c in counts if c for w in c if w not in self.known})
        if self.size + sum(map(len, fresh)) > self.MEMORY:
            self.known, self.logs, self.size = {}, self.logs[:0], 0
            fresh = list({w for c in counts if c for w in c})
        if fresh and self.langs:
            new = log_probabilities([MARK + w for w in fresh], self.probs, self.voc)
            self.known.update(zip(fresh, range(len(self.logs), len(self.logs) + len(fresh))))
            self.logs = np.concatenate([self.logs, new])
            self.size += sum(map(len, fresh))
        best, score = [], np.zeros(len(texts))
        for i, c in enumerate(counts):
            if not c or not self.langs:
                best.append("und")
                continue
            at = np.fromiter(map(self.known.__getitem__, c), np.int64, len(c))
            total = np.fromiter(c.values(), float, len(c)) @ self.logs[at]
            p = np.exp(total - total.max())
            best.append(self.langs[k := int(p.argmax())])
            score[i] = p[k] / p.sum()
        return best, score


def identify(docs: DataFrame, held_out: str, path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang).

    held_out: SQL condition on doc_id (null: false).  Learns from rows that are not held out and whose lang and text
    are not null, about SAMPLE rows of each lang, however rare it is (all if it has fewer); repeated rows are taken
    together.  A text that is null or has no letter (Unicode category L) is `und` with score 0, and so is every text
    if nothing could be learned.  Ties go to the language that sorts first.  Words of any length are summed whole, in
    memory of about 100 bytes a character of the longest word.  Columns other than doc_id, text, lang are ignored.
    """
    rows = docs.select("doc_id", "text", "lang", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"))
    known = rows.where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL")
    # one row per language, as the model itself has
    rows_of = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    part = F.create_map(*(F.lit(x) for k, n in rows_of.items() for x in (k, int(min(1.0, SAMPLE / n) * (1 << 40))))) if rows_of else F.lit(None).cast("map<string,bigint>")
    sample = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < part[F.col("lang")])
    counts: dict[str, Counter] = {}
    for r in sample.select("lang", "text").mapInPandas(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    langs, probs = learn(counts, vocabulary(path))
    probs = probs.astype(np.float32)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(langs, probs, vocabulary(path))
        for frame in frames:
            for lo in range(0, len(frame), 1000):
                part = frame.iloc[lo : lo + 1000]
                best, score = scorer.texts(list(part["text"]))
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": best, "score": score})

    return rows.select("doc_id", "text", "held_out").mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), "crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2")
