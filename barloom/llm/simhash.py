"""Near duplicates by SimHash with covering locality-sensitive hashing.

Bit i of a fingerprint gets a vector m(i) of r+1 bits; the mask of a nonzero vector v holds the bits with
<m(i), v> = 1 (mod 2).  The r or fewer bits in which two fingerprints differ span at most r dimensions, so
some v is orthogonal to all their vectors: that mask avoids every differing bit and both fingerprints meet in
its table.  For r = 3 these are 15 tables of 32 to 36 bits each, and no pair within the radius is missed.

Equal fingerprints collapse first, so copies never multiply.  A bucket gives a spanning forest of its links,
never all pairs.  An oversized bucket is cut by four blocks of the bits outside its mask (a pair within the
radius agrees on one of them), and what is still too large is compared block against block in separate groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import discard, free_name, release, stored

SEED, WORDS, RADIUS, BUCKET = 42, 3, 3, 512


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int = RADIUS) -> list[int]:
    """The bit masks of all tables: one for each nonzero vector of radius+1 bits; radius 0 to 6.

    The vectors of the bits are dealt evenly, or for radius 6 are those of a first-order Reed-Muller code, so that
    every mask holds about half of the bits.
    """
    if not 0 <= radius <= 6:
        raise ValueError("64 bits carry masks of enough bits up to radius 6")
    size = 1 << (radius + 1)
    vectors = [64 + i if radius == 6 else i % (size - 1) + 1 for i in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, size)]


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """SimHash of a whole text: A-Z lowered, words between ASCII white space, shingles with repeats."""
    ws = (text or b"").lower().split()
    if not ws:
        return 0
    if len(ws) < words:
        shingles: Iterable[bytes] = [b" ".join(ws)]
    else:
        shingles = map(b" ".join, zip(*(ws[i:] for i in range(words)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for b in batches:
        fps = np.array([fingerprint(t.as_py()) for t in b.column(2)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["_id", "_digest", "_fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _digest of the text, _fp) of every row; null text: fingerprint 0."""
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_digest"), text.cast("binary").alias("_text"))
    return rows.mapInArrow(_fingerprints, f"_id {df.schema[id_col].dataType.simpleString()}, _digest long, _fp long")


def _forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the graph of pairs within the radius."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    left, right, fresh = [], [], np.ones(len(fps), bool)
    for start in range(len(fps)):
        if not fresh[start]:
            continue
        fresh[start] = False
        queue = [start]
        while queue:
            u = queue.pop()
            found = np.flatnonzero(near[u] & fresh)
            fresh[found] = False
            queue += found.tolist()
            left += [u] * len(found)
            right += found.tolist()
    return left, right


def _links(radius: int):
    """Pass over rows sorted by bucket: the links of each bucket, held one bucket at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, key = [], None

        def out(parts):
            fps = np.unique(np.concatenate(parts)).view(np.uint64)
            a, b = _forest(fps, radius)
            x, y = fps[a].view(np.int64), fps[b].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            fps = b.column("_fp").to_numpy()
            cols = np.column_stack([b.column(c).to_numpy() for c in ("t", "k", "i", "j")])
            cuts = np.flatnonzero((cols[1:] != cols[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(fps)], strict=True):
                now = tuple(cols[lo])
                if key is not None and now != key:
                    if sum(map(len, held)) > 1:
                        yield out(held)
                    held = []
                key = now
                held.append(fps[lo:hi])
        if sum(map(len, held)) > 1:
            yield out(held)

    return run


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of buckets with two or more fingerprints, with the size of the bucket."""
    sizes = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(sizes, ["t", "k"])


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) between distinct fingerprints that connect all pairs within the radius. ``fps``: distinct ``_fp``."""
    fp, all_masks = F.col("_fp"), [_signed(m) for m in masks(radius)]
    tables = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("t"), fp.bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(all_masks))))
    rows = stored(_sized(fps.select("_fp", tables.alias("x")).select("_fp", "x.t", "x.k")))
    small = rows.filter(f"n <= {bucket}").select("_fp", "t", "k", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    # Oversized buckets: radius+1 blocks of the bits outside the mask; a pair within the radius agrees on one.
    cut = []
    for i, m in enumerate(masks(radius)):
        rest = [x for x in range(64) if not m >> x & 1]
        for s in range(radius + 1):
            cut.append((i, s, _signed(m | sum(1 << x for x in rest[s :: radius + 1]))))
    finer = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s).alias("s"), F.lit(m).alias("m")) for i, s, m in cut))
    over = rows.filter(f"n > {bucket}").select("_fp", "t", F.explode(F.filter(finer, lambda x: x["i"] == F.col("t"))).alias("x"))
    over = _sized(over.select("_fp", ((F.col("t") + 1) * 1000 + F.col("x.s")).alias("t"), fp.bitwiseAND(F.col("x.m")).alias("k")))
    blocks = F.ceil(F.col("n") / bucket)
    own = F.pmod(F.xxhash64("_fp"), blocks)
    over = over.select("_fp", "t", "k", own.alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("o"))
    over = over.select("_fp", "t", "k", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    by = ["t", "k", "i", "j"]
    dealt = small.unionByName(over).repartition(*by).sortWithinPartitions(*by)
    return dealt.mapInArrow(_links(radius), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex of ``edges`` (u, v); the root is the smallest vertex of its component.

    Each round ranks the vertices anew by a hash, every vertex moves to the first-ranked of itself and its neighbours, and
    the edges are contracted, until none is left.  About half of the vertices of a chain stay, so the rounds grow with
    the logarithm of the longest path, whatever order its vertices have.
    """
    edges, roots, turn = stored(edges.filter("u != v").select("u", "v")), None, 0
    while not edges.isEmpty():
        rank = lambda x: F.struct(F.xxhash64(x, F.lit(turn)).alias("h"), F.col(x).alias("x"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy(F.col("u").alias("vertex")).agg(F.min(rank("v")).alias("m"))
        to = stored(first.select("vertex", F.least(rank("vertex"), "m")["x"].alias("root")))
        a, b = to.select(F.col("vertex").alias("u"), F.col("root").alias("a")), to.select(F.col("vertex").alias("v"), F.col("root").alias("b"))
        moved = edges.join(a, "u").join(b, "v").filter("a != b")
        moved = stored(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        if roots is None:
            new = to
        else:
            step = to.select(F.col("vertex").alias("root"), F.col("root").alias("_next"))
            new = stored(roots.join(step, "root", "left").select("vertex", F.coalesce("_next", "root").alias("root")))
            discard(roots, to)
        discard(edges)
        edges, roots, turn = moved, new, turn + 1
    if roots is None:
        return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    least = roots.groupBy("root").agg(F.min("vertex").alias("_least"))
    return roots.join(least, "root").select("vertex", F.col("_least").alias("root"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: identifier, fingerprint (16 hex digits), component_id (smallest identifier reachable).

    Null and blank texts have fingerprint zero and are linked like any other.  Null identifiers are ignored for
    component_id unless a component has no other; repeated identifiers are rows of their own.
    """
    return _components_of(stored(fingerprints(df, id_col, text_col)), radius).select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), F.col("_component").alias("component_id")
    )


def _components_of(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``rows`` (_id, _fp, ...) with ``_component``."""
    fps = stored(rows.groupBy("_fp").agg(F.min("_id").alias("_least")))
    roots = components(links(fps.select("_fp"), radius)).withColumnRenamed("vertex", "_fp")
    named = stored(fps.join(roots, "_fp", "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root")))
    least = named.groupBy("_root").agg(F.min("_least").alias("_component"))
    return rows.join(named.join(least, "_root").select("_fp", "_component"), "_fp")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each component stays, with all its columns: the one with the smallest identifier.

    Of several rows with that identifier, the one with the smallest digest of its text stays; rows that repeat
    both stay together.  Where a component has no identifier at all, its rows all stay.
    """
    slim = stored(fingerprints(df, id_col, text_col))
    placed = _components_of(slim, radius)
    best = placed.filter("_id = _component").groupBy("_component").agg(F.min("_digest").alias("_best"))
    gone = placed.join(best, "_component").filter("_id is null or _id != _component or _digest != _best")
    name = free_name(df.columns, "_digest")
    other_id, other = free_name([*df.columns, name], "_gone_id"), free_name([*df.columns, name], "_gone_digest")
    gone = gone.select(F.col("_id").alias(other_id), F.col("_digest").alias(other)).distinct()
    kept = df.withColumn(name, F.xxhash64(F.col(text_col).cast("string")))
    same = F.col(id_col).eqNullSafe(F.col(other_id)) & (F.col(name) == F.col(other))
    return kept.join(gone, same, "left_anti").drop(name)
