"""Byte-level BPE encoding by tree concatenation, and decoding.

A text of more than LEAF characters is cut into leaves, without regard to where the vocabulary's pattern would split it.
All leaves of a slice of texts are encoded in parallel (threads of the tokenizer's own code, outside Python's lock) and
joined pairwise, level by level: a window around the join is encoded anew, and grows until it starts and ends with what
the left and the right side have there.

* Between a visible character and white space the pattern always splits, and what follows a split does not depend on what
  is before it.  A window from such a place in the left side to such a place in the right side is thus encoded as in the
  whole text (``join``).
* A stretch without such places (``RUN`` characters or more) may be one piece of any length.  Texts with one are split by
  the pattern, and long pieces are halved down to leaves and joined by tokens (``join_tokens``): the window grows until its
  first and last token equal those of both sides.  Then every pair of neighbouring tokens is one that BPE itself leaves
  apart, which makes the sequence the encoding of the whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import memory

#: Characters of a leaf; of a stretch that makes a text take the way of long pieces; of a join's first window, each side.
LEAF, RUN, NEAR = 1024, 256, 16
#: Bytes of texts encoded together and between two results of a task (one text at least).
SLICE = 1_000_000
THREADS = 2
SPECIAL = "<|endoftext|>"
RANKS = "byte_bpe_50k.tiktoken"


class Codec:
    """path: rank file; the special token's id follows the ranks."""

    def __init__(self, path: str, pattern: str, threads: int = THREADS) -> None:
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.special = len(ranks)
        self.split = tiktoken.Encoding("split", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.table = [b""] * (len(ranks) + 1)
        for k, v in ranks.items():
            self.table[v] = k
        self.table[self.special] = SPECIAL.encode()
        self.pieces = regex.compile(pattern)
        self.long = regex.compile(rf"\S{{{RUN},}}+|\s{{{RUN},}}+")
        self.edge = regex.compile(r"(?<=[\p{L}\p{N}\p{P}\p{S}])(?=[ \n])")
        self.threads = threads
        self.joins = 0

    # leaves and joins of text

    def join(self, a: tuple[str, list[int]], b: tuple[str, list[int]]) -> tuple[str, list[int]]:
        """Text and tokens of two neighbouring parts as one."""
        (left, x), (right, y) = a, b
        self.joins += 1
        size = NEAR
        while True:
            # the window starts and ends at a split or at the end of a side
            lo = max((m.start() for m in self.edge.finditer(left, max(0, len(left) - 4 * size), max(0, len(left) - size))), default=0 if len(left) <= 4 * size else None)
            hi = next((m.start() for m in self.edge.finditer(right, size, 4 * size)), len(right) if len(right) <= 4 * size else None)
            if lo is None or hi is None:
                size *= 2
                continue
            window = self.split.encode_ordinary(left[lo:] + right[:hi])
            i = len(x) - self._tokens(reversed(x), len(left[lo:].encode()))
            j = self._tokens(y, len(right[:hi].encode()))
            if (lo == 0 or window[0] == x[i]) and (hi == len(right) or window[-1] == y[j - 1]):
                return left + right, x[:i] + window + y[j:]
            size *= 2

    def _tokens(self, tokens: Iterable[int], n: int) -> int:
        """How many tokens n bytes take (no token crosses a split)."""
        k = 0
        for t in tokens:
            if n <= 0:
                break
            n -= len(self.table[t])
            k += 1
        return k

    # leaves and joins of a piece

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        size = 4
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            while i > 0 and self.table[left[i]][0] & 0xC0 == 0x80:  # a window is text: it starts and ends between characters
                i -= 1
            while j < len(right) and self.table[right[j]][0] & 0xC0 == 0x80:
                j += 1
            window = self.whole.encode_ordinary(b"".join(map(self.table.__getitem__, left[i:] + right[:j])).decode())
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            size *= 2

    def piece(self, text: str) -> list[int]:
        """Encoding of one piece of any length."""
        parts = self.whole.encode_ordinary_batch([text[i : i + LEAF] for i in range(0, len(text), LEAF)], num_threads=self.threads)
        while len(parts) > 1:
            self.joins += len(parts) // 2
            parts = [self.join_tokens(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def _pieces(self, text: str) -> list[int]:
        """Encoding of a text with long stretches, piece by piece."""
        out: list[int] = []
        for x in self.pieces.findall(text):
            out += self.piece(x) if len(x) > LEAF else self.whole.encode_ordinary(x)
        return out

    # texts

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """ids (uint32) of each text; the special token's string is that token, as in the library's files."""
        segments = [(k, i, x) for k, text in enumerate(texts) for i, x in enumerate(text.split(SPECIAL))]
        plain = [s for s in segments if self.long.search(s[2]) is None]
        leaves = [(s, [s[2][i : i + LEAF] for i in range(0, len(s[2]), LEAF)] or [""]) for s in plain]
        coded = iter(self.split.encode_ordinary_batch([y for _, x in leaves for y in x], num_threads=self.threads) if leaves else [])
        found = {}
        for (k, i, _), parts in leaves:
            level = [(y, next(coded)) for y in parts]
            while len(level) > 1:
                level = [self.join(*level[j : j + 2]) if j + 1 < len(level) else level[j] for j in range(0, len(level), 2)]
            found[k, i] = level[0][1]
        out: list[list[int]] = [[] for _ in texts]
        for k, i, x in segments:
            out[k] += [self.special] if i else []
            out[k] += found[k, i] if (k, i) in found else self._pieces(x)
        return [np.array(x, np.uint32) for x in out]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text or ""])[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str | None = None) -> Codec:
    import public_tokenizers

    return Codec(path or public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def _run(path: str | None, texts: bool):
    names = ("n_tokens", "ids", "decoded") if texts else ("n_tokens", "ids_sha256", "decoded_sha256")
    kinds = (pa.int64(), pa.binary(), pa.string()) if texts else (pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)

        def make(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for ids in own.encode_all([text.as_py() or "" for text in part["text"]]):
                back = own.decode(ids)
                raw = ids.astype("<u4").tobytes()
                rows.append((len(ids), raw, back) if texts else (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            return pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", *names])

        yield from memory.in_parts(batches, "text", SLICE, make)

    return run


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32 bit), decoded, for every row of docs(doc_id, text).

    A null text is an empty one: no tokens.  Row by row, without a shuffle; repeated rows are encoded alike, an empty table
    gives no rows, other columns are ignored, whatever their names.  One text is encoded whole, in memory of about 30
    times its bytes.
    """
    return docs.select("doc_id", "text").mapInArrow(_run(path, True), "doc_id long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As tokenize, with SHA-256 of ids and decoded text in place of both."""
    return docs.select("doc_id", "text").mapInArrow(_run(path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
