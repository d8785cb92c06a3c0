"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

All n-grams of a test item are its seeds, whatever their frequency; a document that holds a seed becomes a candidate
for the item, and the words around its seeds are aligned with the item's words where enough of them stand there for
the score.  The alignment bears replaced, dropped and added words, so edited copies are scored too.

Test items go to the tasks in blocks of at most ``BLOCK`` n-grams; each block is one pass over the corpus, so what
a task holds does not grow with the number of items.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import free_name, release

N = 5  # words of a seed
SIMILARITY = 0.6  # alignment score over that of a perfect copy; 0.6 bears about a quarter of the words edited
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK = 1_000_000

def _cut(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts, ``size`` bytes or one text at a time, with the number of the first."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= size or i + 1 == len(texts):
            yield lo, texts[lo : i + 1]
            lo, n = i + 1, 0


_KEEP = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum())
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c in _KEEP else 32 for c in range(256))
_CUT = np.uint64(1 << 60)  # number of the word that stands between two texts
_FACTOR = 0x9E3779B97F4A7C15


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space and punctuation, A-Z lowered."""
    return (text or b"").translate(_TABLE).split()


def _mixed(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word numbers; n is part of it."""
    h = np.full(len(ids) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ ids[k : len(ids) - n + 1 + k]) * np.uint64(_FACTOR)
        h ^= h >> np.uint64(29)
    return h


def align(item: np.ndarray, other: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: best local score, and where in ``other`` that alignment begins and ends."""
    m = len(other)
    score, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best, first, last = 0, 0, 0
    place = np.arange(m + 1)
    for w in item:
        hit = np.where(other == w, MATCH, MISMATCH)
        up, diagonal = score + GAP, np.concatenate([[0], score[:-1] + hit])
        new = np.maximum(np.maximum(diagonal, up), 0)
        origin = np.where(new == 0, place, np.where(diagonal >= up, np.concatenate([[0], begin[:-1]]), begin))
        # gaps along the row: a running maximum, as each further word costs the same
        lifted = new - GAP * place
        peak = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == peak, place, 0))
        score = np.maximum(peak + GAP * place, 0)
        begin = np.where(score == 0, place, origin[source])
        at = int(score.argmax())
        if score[at] > best:
            best, first, last = int(score[at]), int(begin[at]), at
    return best, first, last


class Items:
    """A block of test items: their words as numbers, and n-grams that lead to them."""

    def __init__(self, items: list[tuple[object, list[bytes]]]):
        self.names = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        self.words = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in ws], np.uint64) for _, ws in items]
        at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.sizes = sorted({min(N, len(ws)) for ws in self.words if len(ws)})
        for i, ws in enumerate(self.words):
            if len(ws):
                for k, h in enumerate(_mixed(ws, min(N, len(ws))).tolist()):
                    at[h].append((i, k))
        self.at = dict(at)
        self.number[b"\xff"] = int(_CUT)
        self.hashes = np.sort(np.array(list(self.at), np.uint64))

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all texts end to end, where each begins, and positions and hashes of the n-grams found."""
        joined = b" \xff ".join([t.translate(_TABLE) for t in texts])  # a word that no text has
        ws = joined.split()
        ids = np.fromiter(map(self.number.get, ws, repeat(0)), np.uint64, len(ws))
        cuts = ids == _CUT
        begins = np.concatenate([[0], np.flatnonzero(cuts) + 1])
        known = (ids != 0) & ~cuts
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for n in self.sizes if len(self.hashes) else ():
            if len(ids) < n:
                continue
            run = known[: len(known) - n + 1].copy()
            for k in range(1, n):
                run &= known[k : len(known) - n + 1 + k]
            at = np.flatnonzero(run)
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = (h ^ ids[at + k]) * np.uint64(_FACTOR)
                h ^= h >> np.uint64(29)
            here = self.hashes[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)] == h
            places.append(at[here])
            found.append(h[here])
        return ids, begins, np.concatenate(places), np.concatenate(found)

    def by_text(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text that holds an n-gram: its number, its words, and positions and hashes of the n-grams."""
        for lo, part in _cut(texts):
            ids, begins, places, found = self.hits(part)
            order = np.argsort(places, kind="stable")
            places, found = places[order], found[order]
            owner = np.searchsorted(begins, places, "right") - 1
            ends = np.concatenate([begins[1:] - 1, [len(ids)]])
            for i in np.unique(owner).tolist():
                a, b = np.searchsorted(owner, [i, i + 1])
                yield lo + i, ids[begins[i] : ends[i]], places[a:b] - begins[i], found[a:b]

    def matches(self, ids: np.ndarray, places: np.ndarray, found: np.ndarray, least: float) -> list[tuple[object, float, int, int]]:
        """(item, similarity, first word, end word) of each item that the text holds at ``least``."""
        by_item: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, h in zip(places.tolist(), found.tolist(), strict=True):
            for i, k in self.at[h]:
                by_item[i].append((p - k, p))
        out = []
        for i, seeds in by_item.items():
            item, best = self.words[i], (0.0, 0, 0)
            size, done = len(item), -len(item)
            for diagonal in sorted({d for d, _ in seeds}):
                if diagonal >= 0 and np.array_equal(ids[diagonal : diagonal + size], item):
                    best = (1.0, diagonal, diagonal + size)
                    break
                if diagonal < done:
                    continue  # inside the window aligned last
                lo, hi = max(0, diagonal - size // 2), max(0, diagonal) + 2 * size
                done = diagonal + size // 2
                if np.isin(item, ids[lo:hi]).sum() < least * size - 1e-9:
                    continue  # each word of the item that is aligned adds MATCH at most
                score, first, last = align(item, ids[lo:hi])
                best = max(best, (score / (MATCH * size), lo + first, lo + last))
            if best[0] >= least:
                out.append((self.names[i], *best))
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The test items in blocks; only one block at a time is on the driver."""
    rows = benchmark.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    sizes = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    n = int(sizes // (2 * BLOCK)) + 1  # a word has two bytes at least
    for i in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("_id"), F.lit(n)) == i)
        yield Items([(r["_id"], words_of(bytes(r["_text"] or b""))) for r in part.collect()])


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.to_pylist()]


def _text(text_col: str):
    return F.col(text_col).cast("string").cast("binary")


def contaminated(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", least: float = SIMILARITY,
) -> DataFrame:
    """One row per document and test item that it holds: identifier, item, similarity, first_word, end_word.

    Null and empty texts and items without words match nothing; an item shorter than a seed is its own seed.
    Repeated rows of documents or items give a row each.  Documents without a match have no row.
    """
    rows = df.select(F.col(id_col).alias("_id"), _text(text_col).alias("_text"))
    kinds = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    out = None
    for items in _blocks(benchmark, item_col, item_text):

        def run(batches: Iterable[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            release()
            kind = pa.array(items.names).type if items.names else pa.int64()
            for b in batches:
                found = [(i, *m) for i, *seen in items.by_text(_bytes(b.column(1))) for m in items.matches(*seen, least)]
                cols = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], kind), pa.array(cols[2], pa.float64()),
                     pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                    ["_id", "_item", "similarity", "first_word", "end_word"],
                )

        part = rows.mapInArrow(run, f"_id {kinds[0]}, _item {kinds[1]}, similarity double, first_word long, end_word long")
        out = part if out is None else out.unionByName(part)
    names = {"_id": id_col, "_item": item_col if item_col != id_col else f"item_{item_col}"}
    return out.withColumnsRenamed(names)


def drop_contaminated(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = SIMILARITY
) -> DataFrame:
    """The rows of ``df`` that hold no test item, with all their columns.

    Null and empty texts hold nothing and stay; items without words match nothing, and an item shorter than a seed is its
    own seed.  Repeated rows stay or go together.  An empty benchmark drops nothing.  Column names are free.
    """
    name, out = free_name(df.columns, "_text"), df
    for items in _blocks(benchmark, item_col, item_text):

        def run(batches: Iterable[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            release()
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for i, *seen in items.by_text(_bytes(b.column(b.num_columns - 1))):
                    clean[i] = not items.matches(*seen, least)
                yield b.filter(pa.array(clean)).select(list(range(b.num_columns - 1)))

        out = out.withColumn(name, _text(text_col)).mapInArrow(run, T.StructType(list(df.schema)))
    return out
