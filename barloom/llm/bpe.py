"""Byte-level BPE with a hierarchical-bitmap rank queue.

All pre-tokens of a batch that are not known yet are laid end to end as one doubly linked list of bytes, cut
between pre-tokens.  Every adjacent pair that can merge waits in the bucket of its rank; a bitmap over the
ranks with two summary levels finds the next rank with find-first-set.  Merges put new pairs into other
buckets and leave stale entries behind, which are skipped when their bucket is opened.  A merge costs the same
however long the pre-token is, so a pre-token of a million bytes is no harder than a million short ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import SegmentTable, by_size, id_lists, pre_tokens, resident, tokenizer_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class RankQueue:
    """Positions by rank.  ``pop`` gives the smallest rank that has a bucket, and the bucket."""

    def __init__(self, ranks: int):
        low = (ranks >> 6) + 1
        self.low, self.mid, self.top = [0] * low, [0] * ((low >> 6) + 1), 0
        self.buckets: dict[int, list[int]] = {}

    def open(self, rank: int, bucket: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = bucket
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]] | None:
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        m = self.mid[b]
        a = b << 6 | (m & -m).bit_length() - 1
        x = self.low[a]
        rank = a << 6 | (x & -x).bit_length() - 1
        x &= x - 1
        self.low[a] = x
        if not x:
            m &= m - 1
            self.mid[b] = m
            if not m:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class Bpe:
    """Merges by rank; a token's rank is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)])
        self.size = max(ranks.values()) + 1
        self.pairs: dict[int, int] = {}  # id << 20 | id -> rank of the joined bytes
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = rank
        self.first = np.full((256, 256), -1)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = rank
        self.segments = SegmentTable(self.learn, limit=250_000)

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian unsigned 32-bit integers."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        cut = ends[(ends > 0) & (ends < n)]
        after, before = np.arange(1, n + 1), np.arange(-1, n)
        after[cut - 1] = n  # no pair reaches over the end of a pre-token
        before[cut] = -1
        wait = np.full(n + 1, -1)  # rank of the pair that begins here
        if n > 1:
            wait[: n - 1] = self.first[raw[:-1], raw[1:]]
            wait[cut - 1] = -1
        queue = RankQueue(self.size)
        begin = np.flatnonzero(wait >= 0)
        begin = begin[np.argsort(wait[begin], kind="stable")]
        rank, at = np.unique(wait[begin], return_index=True)
        for r, positions in zip(rank.tolist(), np.split(begin, at[1:]), strict=bool(len(rank))):
            queue.open(r, positions.tolist())
        ids, after, before, wait = self.single[raw].tolist(), after.tolist(), before.tolist(), wait.tolist()
        bucket_of, start, rank_of = queue.buckets.get, queue.open, self.pairs.get
        while (item := queue.pop()) is not None:
            rank, bucket = item
            bucket.sort()  # equal ranks merge from left to right
            for at, i in enumerate(bucket):
                if wait[i] != rank:
                    continue  # stale
                j = after[i]
                k = after[i] = after[j]
                ids[i], ids[j], wait[j], lower = rank, -1, -1, False
                if k < n:
                    before[k] = i
                    r = wait[i] = rank_of(rank << 20 | ids[k], -1)
                    if r >= 0:
                        if (b := bucket_of(r)) is not None:
                            b.append(i)
                        else:
                            start(r, [i])
                        lower = r < rank
                else:
                    wait[i] = -1
                h = before[i]
                if h >= 0:
                    r = wait[h] = rank_of(ids[h] << 20 | rank, -1)
                    if r >= 0:
                        if (b := bucket_of(r)) is not None:
                            b.append(h)
                        else:
                            start(r, [h])
                        lower = lower or r < rank
                if lower:  # a smaller rank has come up and goes first
                    if rest := bucket[at + 1 :]:
                        start(rank, rest)
                    break
        left = np.array(ids, np.int64)
        kept = left >= 0
        sizes = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])] * 4 if n else np.zeros(len(words) + 1, int)
        flat = left[kept].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)]

    def learn(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment."""
        known, new = self.segments.value, {}
        cut = [pre_tokens(s, self.split) for s in segments]
        for parts in cut:
            for p in parts:
                if p not in new:
                    new[p] = known(p)
        words = [p for p, found in new.items() if found is None]
        new.update(zip(words, self.merge([p.encode("utf-8", "replace") for p in words]), strict=True))
        return [b"".join(map(new.__getitem__, parts)) for parts in cut]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.segments.joined(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I").tolist()))


def loaded(path: str, pattern: str) -> Bpe:
    """The vocabulary of ``path``, read once by each worker."""
    return resident(("bpe", path, pattern), lambda: Bpe.load(path, pattern))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per input row: identifier, ids array<int>, n_tokens, ids_sha256, decoded_sha256.

    ``path`` is a rank file present on every executor and ``pattern`` splits text into pre-tokens; by default
    those of the installed package.  ids_sha256 is over the ids as little-endian unsigned 32-bit integers,
    decoded_sha256 over the bytes that the ids decode to.  Null texts count as empty: no ids.  Repeated rows
    and null identifiers give a row each; other columns are ignored.
    """
    import public_tokenizers

    path, pattern = path or tokenizer_path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for b in batches:
            lo = 0
            for texts in by_size([t or "" for t in b.column(1).to_pylist()]):
                ids = bpe.encode_batch(texts)
                lists, sizes = id_lists(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, len(texts)), lists, pa.array(sizes, pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
                    ],
                    ["_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                lo += len(texts)

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = df.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"_id {kind}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("_id", id_col)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the bytes that ``ids_col`` decodes to; null ids give null, an empty list no bytes."""
    import public_tokenizers

    path, pattern = path or tokenizer_path(VOCABULARY), public_tokenizers.PATTERN

    @F.pandas_udf("binary")
    def bytes_of(ids):
        bpe = loaded(path, pattern)
        return ids.map(lambda x: None if x is None else b"".join(bpe.bytes_of[i] for i in x))

    return df.withColumn(out_col, bytes_of(F.col(ids_col)))
