"""Regularised quadratic discriminant analysis over transformed document statistics.

Statistics are computed once per document; means and covariances per class are sums over all labelled rows (no
sample); each class covariance is shrunk towards the pooled one and the identity; the score is the logistic of the
difference of the two Gaussian log-densities, whose Mahalanobis terms use Cholesky factors inverted once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import memory, scratch

THRESHOLD = 0.3
#: Shrinkage towards the pooled covariance and towards the identity (of standardised statistics).
TO_POOLED, TO_IDENTITY = 0.3, 0.1
#: Bytes of texts measured between two results of a task (one text at least).
SLICE = 1_000_000
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
SYMBOLS, BANGS, STOPS = b"#*$%&|<>{}[]\\^~=_", b"!?", b".,;:"
NAMES = ["words", "word_length", "distinct", "top_word", "adjacent", "lines", "line_words", "dup_lines", "symbols", "bangs", "stops", "upper", "digits", "spaces", "long_words"]


def measure(text: str | None) -> list[float]:
    """Transformed statistics of one text: logarithms of sizes and of shares (plus a small offset)."""
    data = (text or "").encode()
    words = data.split()
    n = max(len(words), 1)
    size = max(len(data), 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = max(len(lines), 1)
    share = lambda chars, of: (len(data) - len(data.translate(None, chars))) / of
    log = lambda x, e: math.log(x + e)
    count = Counter(words)
    top = max(count.values(), default=0)
    return [
        math.log1p(len(words)),
        sum(map(len, words)) / n,
        log(len(count) / n, 0.02) if words else 0.0,
        log(top / n, 0.02) if words else 0.0,
        log(sum(map(eq, words, words[1:])) / n, 0.01),
        math.log1p(len(lines)),
        math.log1p(n / m),
        log((len(lines) - len(set(lines))) / m, 0.05),
        log(share(SYMBOLS, n), 0.02),
        log(share(BANGS, n), 0.02),
        log(share(STOPS, n), 0.02),
        log(share(UPPER, size), 0.02),
        log(share(DIGITS, size), 0.01),
        log((len(data) - sum(map(len, words))) / size, 0.05),
        log(sum(len(w) > 20 for w in words) / n, 0.01),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        x = pa.array([measure(t.as_py()) for t in part["text"]], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], x], names=["doc_id", "held_out", "x"])

    return memory.in_parts(batches, "text", SLICE, make)


def _moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per class: number, sums and products of the statistics of one task, long form."""
    total: dict[int, np.ndarray] = {}
    for frame in frames:
        if len(frame):
            x = np.column_stack([np.ones(len(frame)), np.stack(frame["x"])])
            for c in (0, 1):
                z = x[frame["quality"].to_numpy() == c]
                total[c] = total.get(c, 0) + z.T @ z
    for c, s in total.items():
        yield pd.DataFrame({"class": c, "pos": np.arange(s.size), "value": s.ravel()})


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    mean: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    offset: tuple[float, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        logs = [self.offset[c] - 0.5 * (((z - self.mean[c]) @ self.whiten[c].T) ** 2).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -700, 700)))


def fit(sums: dict[int, np.ndarray]) -> Model | None:
    """Model from {class: sum of [1, x][1, x]'}; None unless both classes have two rows at least."""
    if any(sums.get(c) is None or sums[c][0, 0] < 2 for c in (0, 1)):
        return None
    n = {c: s[0, 0] for c, s in sums.items()}
    both = sums[0] + sums[1]
    centre = both[0, 1:] / both[0, 0]
    scale = np.sqrt(np.maximum(np.diag(both)[1:] / both[0, 0] - centre**2, 1e-12))
    scale = np.where(scale > 1e-5, scale, 1.0)
    mean, cov = {}, {}
    for c in (0, 1):
        raw = sums[c][0, 1:] / n[c]
        mean[c] = (raw - centre) / scale
        cov[c] = (sums[c][1:, 1:] / n[c] - np.outer(raw, raw)) / np.outer(scale, scale)
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    whiten, offset = [], []
    for c in (0, 1):
        shrunk = (1 - TO_POOLED - TO_IDENTITY) * cov[c] + TO_POOLED * pooled + TO_IDENTITY * np.eye(len(centre))
        factor = np.linalg.cholesky(shrunk)
        whiten.append(np.linalg.inv(factor))
        offset.append(math.log(n[c] / (n[0] + n[1])) - np.log(np.diag(factor)).sum())
    return Model(centre, scale, (mean[0], mean[1]), tuple(whiten), tuple(offset))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and statistics x of every row (checkpointed: computed once, read by fit and scores)."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scratch.checkpoint(docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(_features, "doc_id long, held_out boolean, x array<double>"))


@dataclass(frozen=True)
class Classifier:
    """A fitted model, or a constant where a class has too few rows."""

    model: Model | None
    flat: float

    def scores(self, x: list) -> np.ndarray:
        return self.model.score(np.stack(x)) if self.model is not None and len(x) else np.full(len(x), self.flat)


def train(table: DataFrame, labels: DataFrame) -> Classifier:
    """Fits to the measured rows that are not held out and have a label."""
    known = labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    found = table.where("NOT held_out").join(known, "doc_id").select("x", "quality").mapInPandas(_moments, "class int, pos int, value double").groupBy("class", "pos").agg(F.sum("value").alias("value")).collect()
    width = len(NAMES) + 1
    sums: dict[int, np.ndarray] = {}
    for r in found:
        sums.setdefault(r["class"], np.zeros(width * width))[r["pos"]] = r["value"]
    sums = {c: s.reshape(width, width) for c, s in sums.items()}
    rows = sum(s[0, 0] for s in sums.values())
    return Classifier(fit(sums), float(sums[1][0, 0] / rows) if rows else 0.5)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text).

    Learns from labels(doc_id, quality) of rows that are not held out; null labels and ids teach nothing, an id that is
    labelled twice counts twice.  Null and empty texts have the statistics of an empty text.  If a class has fewer
    than two rows, every score is the share of label 1 (0.5 without labels).  Repeated rows are scored alike, an empty
    table gives no rows, a score of exactly THRESHOLD (ties) predicts 1; other columns are ignored, whatever their names.
    One text is measured whole, in memory of about 30 times its bytes.
    """
    table = measured(docs)
    fitted = train(table, labels)

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            score = fitted.scores(list(frame["x"]))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)})

    return table.mapInPandas(apply, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs (all columns) that classify would predict 1.

    Only labelled rows are measured to fit; the rest is a row-wise filter, without a shuffle.  Ties (a score of exactly
    THRESHOLD) stay; null and empty texts are judged as empty ones; repeated rows alike; an empty table gives no rows.
    """
    some = labels.where("quality IN (0, 1)").select("doc_id").distinct()
    fitted = train(measured(docs.select("doc_id", "text").join(some, "doc_id", "left_semi")), labels)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        found = pa.array(fitted.scores([measure(t.as_py()) for t in text]), pa.float64())
        memory.give_back()
        return found

    return docs.where(score("text") >= THRESHOLD)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
