"""Near copies by SimHash and the Jaccard similarity of their word shingles.

Candidates are all pairs whose SimHash fingerprints differ in three or fewer bits: they meet in one of the 15 tables of
``simhash``.  Edited texts whose fingerprints lie further apart (about ten bits at a similarity of 0.8) are added by MinHash:
texts whose ``ROWS`` minima agree in one of ``BANDS`` tables share a bucket there.  A pair of similarity 0.8 is missed by all tables with probability (1 - 0.8^5)^28 = 1.5e-5, a closer one more rarely.
Inside a bucket whole shingle sets are compared, so a link always stands for a pair of at least that similarity; a
bucket gives a spanning forest of its links, never all pairs.  Equal sets collapse first.  Oversized buckets are cut
into blocks and compared block against block in separate groups, so what a task holds at a time is bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import simhash
from barloom.llm.common import attach, discard, free_name, release, stored
from barloom.llm.simhash import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS, SEED = 28, 5, 42
SETS, ELEMENTS = 512, 200_000  # of a block: sets, and shingles in all of them
_A, _B = (np.random.default_rng(SEED + k).integers(0, 1 << 64, BANDS * ROWS, np.uint64) for k in (0, 1))
_A |= np.uint64(1)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different shingles of a text: A-Z lowered, words between ASCII white space."""
    ws = (text or b"").lower().split()
    runs = [b" ".join(ws)] if 0 < len(ws) < words else map(b" ".join, zip(*(ws[i:] for i in range(words)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """One key of each table; none of a text without words."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(found), 256):
        h = found[i : i + 256, None] * _A + _B
        least = np.minimum(least, (h ^ h >> np.uint64(32)).min(0))
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in least.reshape(BANDS, ROWS)), np.uint64, BANDS).view(np.int64)


def _key(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for b in batches:
        both = [(shingles(t), simhash.fingerprint(t)) for t in (x.as_py() for x in b.column(2))]
        sets, fps = [s for s, _ in both], np.array([f for _, f in both], np.uint64).view(np.int64)
        keys, sizes = pa.array(list(map(_key, sets)), pa.int64()), pa.array(list(map(len, sets)), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), keys, sizes, pa.array(fps), pa.array(list(map(bands, sets)), pa.list_(pa.int64()))], ["_id", "_digest", "_set", "_size", "_fp", "_bands"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for b in batches:
        sets = list(map(shingles, (t.as_py() for t in b.column(1))))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["_set", "_shingles"])


def forest(sets: list[np.ndarray], least: float = SIMILARITY) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the graph of pairs of at least that Jaccard similarity; no set is empty."""
    sizes = np.array(list(map(len, sets)))
    begins = np.cumsum(sizes) - sizes
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    left, right, fresh = [], [], np.ones(len(sets), bool)
    for start in range(len(sets)):
        if not fresh[start]:
            continue
        fresh[start] = False
        queue = [start]
        while queue and fresh.any():
            u = queue.pop()
            mark = np.zeros(len(values), np.int64)
            mark[flat[begins[u] : begins[u] + sizes[u]]] = 1
            common = np.add.reduceat(mark[flat], begins)
            found = np.flatnonzero(fresh & (common >= least * (sizes + sizes[u] - common) - 1e-9))
            fresh[found] = False
            queue += found.tolist()
            left += [u] * len(found)
            right += found.tolist()
    return left, right


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass over rows sorted by bucket: the links of each bucket, held one bucket at a time."""
    release()
    held: dict[int, np.ndarray] = {}
    key = None

    def out():
        keys = np.array(list(held), np.int64)
        a, b = forest(list(held.values()))
        x, y = keys[a], keys[b]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["u", "v"])

    for b in batches:
        for *now, s, found in zip(*(b.column(c).to_pylist() for c in ("t", "k", "i", "j", "_set", "_shingles")), strict=True):
            if now != key:
                if len(held) > 1:
                    yield out()
                held, key = {}, now
            held[s] = np.frombuffer(found, np.uint64)
    if len(held) > 1:
        yield out()


def _keys() -> Column:
    """(t, k) of all tables of a set: those of its fingerprints (every pair within three bits meets in one), then the bands."""
    masks = [simhash._signed(m) for m in simhash.masks()]
    of = lambda f: F.array(*(F.struct(F.lit(BANDS + i).alias("t"), f.bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)))
    close = F.array_distinct(F.flatten(F.transform("_fps", of)))
    return F.concat(close, F.transform("_bands", lambda k, t: F.struct(t.alias("t"), k.alias("k"))))


def _pairs(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) between distinct sets.  ``rows``: _set, _size, _fps, _bands, _digest; ``texts``: _digest, _text."""
    tables = rows.filter("_size > 0").select("_set", "_size", "_digest", F.explode(_keys()).alias("x")).select("_set", "_size", "_digest", "x.t", "x.k")
    # Buckets of the same sets give the same links: one of them is compared (members known by 128 bits of hash and their number).
    members = [F.bit_xor(F.xxhash64("_set", F.lit(i))).alias(f"_x{i}") for i in (0, 1)]
    sizes = tables.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("m"), *members).filter("n > 1")
    sizes = sizes.groupBy("n", "m", "_x0", "_x1").agg(F.min(F.struct("t", "k")).alias("b")).select("b.t", "b.k", "n", "m")
    blocks = F.greatest(F.ceil(F.col("n") / SETS), F.ceil(F.col("m") / ELEMENTS))
    tables = stored(tables.join(sizes, ["t", "k"]).select("t", "k", "_set", "_digest", blocks.alias("blocks")))
    wanted = stored(tables.select("_digest", "_set").distinct())
    sets = attach(texts, wanted, ["_digest"], "inner").select("_set", "_text").mapInArrow(_sets, "_set long, _shingles binary")
    sets = stored(sets.dropDuplicates(["_set"]))
    own = F.pmod(F.xxhash64("_set"), F.col("blocks"))
    dealt = tables.select("_set", "t", "k", own.alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o"))
    by = ["t", "k", "i", "j"]
    dealt = dealt.select("_set", "t", "k", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j")).join(sets, "_set")
    links = stored(dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_links, "u long, v long").distinct())
    discard(tables, wanted, sets)
    return links


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of linked texts stays, with all its columns: the one with the smallest identifier.

    Texts are linked where the sets of their five-word shingles have a Jaccard similarity of 0.8 or more; texts
    without words are alike.  Of several rows with the smallest identifier, the one with the smallest digest of its
    text stays; rows that repeat both stay together.  Where a component has no identifier at all, its rows all stay.
    """
    text = F.col(text_col).cast("string")
    texts = df.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_digest"), text.cast("binary").alias("_text"))
    rows = stored(texts.mapInArrow(_signed, f"_id {df.schema[id_col].dataType.simpleString()}, _digest long, _set long, _size long, _fp long, _bands array<bigint>"))
    sets = stored(rows.groupBy("_set").agg(F.min("_id").alias("_least"), F.min("_digest").alias("_digest"), F.first("_size").alias("_size"), F.first("_bands").alias("_bands"), F.collect_set("_fp").alias("_fps")))
    roots = components(_pairs(sets, texts.select("_digest", "_text"))).withColumnRenamed("vertex", "_set")
    named = stored(sets.select("_set", "_least").join(roots, "_set", "left").select("_set", "_least", F.coalesce("root", "_set").alias("_root")))
    least = named.groupBy("_root").agg(F.min("_least").alias("_component"))
    placed = rows.select("_id", "_digest", "_set").join(named.join(least, "_root").select("_set", "_component"), "_set")
    best = placed.filter("_id = _component").groupBy("_component").agg(F.min("_digest").alias("_best"))
    gone = placed.join(best, "_component").filter("_id is null or _id != _component or _digest != _best")
    name = free_name(df.columns, "_digest")
    other_id, other = free_name([*df.columns, name], "_gone_id"), free_name([*df.columns, name], "_gone_digest")
    gone = gone.select(F.col("_id").alias(other_id), F.col("_digest").alias(other)).distinct()
    kept = df.withColumn(name, F.xxhash64(text))
    same = F.col(id_col).eqNullSafe(F.col(other_id)) & (F.col(name) == F.col(other))
    return kept.join(gone, same, "left_anti").drop(name)
