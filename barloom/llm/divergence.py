"""Audit of sources by how their terms diverge, over terms found by iceberg prefix refinement.

A term is kept where at least ``DOCUMENTS`` documents of its language hold it.  Prefixes of terms are extended level by
level (4, 12, 36, ... bytes): at each level the distinct documents of every prefix are counted, prefixes below the
threshold are discarded with all their terms, and only terms of the others go on to the next level.  A term that ends
within its level's prefix is complete there and is kept or dropped by its own count.  A document is counted for a prefix
once, in the task that reads it, so the counts of tasks add up and only prefixes are shuffled.

Kept terms are then counted by (language, source).  The pairs of sources are compared on dense blocks of a bounded
number of terms, and the sums of all blocks are added up.  All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import attach, discard, release, stored

DOCUMENTS, TOP, SCALE, SMOOTH = 3, 200, 1_000_000_000, 1
FIRST, GROWTH = 4, 3  # bytes of the first level's prefixes, and how they grow from level to level
BLOCK, CELLS = 4096, 1 << 20  # terms of a block; cells of a matrix that is held at a time
_TABLE = bytes(32 if c < 65 or 90 < c < 97 or 122 < c < 128 else c + 32 if c <= 90 else c for c in range(256))
_OPEN = b"\0"  # ends the prefix of a term that goes on; no term holds it


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters and characters beyond ASCII, A-Z lowered, as UTF-8."""
    return (text or b"").translate(_TABLE).split()


def _lists(terms: list[list[bytes]], counts: list[Iterable[int]]) -> tuple[pa.Array, pa.Array]:
    offsets = pa.array(np.concatenate([[0], np.cumsum(list(map(len, terms)))]).astype(np.int32))
    flat = pa.array(list(chain.from_iterable(terms)), pa.binary()), pa.array(np.fromiter(chain.from_iterable(counts), np.int64))
    return pa.ListArray.from_arrays(offsets, flat[0]), pa.ListArray.from_arrays(offsets, flat[1])


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            part = b.slice(lo, 500)
            found = [Counter(terms_of(t.as_py())) for t in part.column(2)]
            names = list(map(sorted, found))
            terms, counts = _lists(names, [map(c.__getitem__, x) for c, x in zip(found, names, strict=True)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), terms, counts], ["lang", "source", "terms", "counts"])


def _summed(rows: pa.Table, by: list[str], values: str) -> pa.Table:
    """The sums of ``values`` by keys."""
    return rows.group_by(by, use_threads=False).aggregate([(values, "sum")]).rename_columns([*by, values])


def _named(rows: pa.Table, langs: pa.Array) -> pa.RecordBatch:
    """One batch, with languages in place of their numbers."""
    return rows.set_column(0, "lang", langs.take(rows.column(0).combine_chunks())).combine_chunks().to_batches()[0]


def _prefixes(length: int, before: int):
    """(lang, key, n): documents by prefix, of terms longer than ``before`` bytes.

    ``key``: a complete term of at most ``length`` bytes, or the first
    ``length`` bytes of a longer one and a zero byte.  The terms of a document are sorted, so equal keys are neighbours.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            terms = b.column(1)
            flat, doc = terms.flatten(), pc.list_parent_indices(terms)
            longer = pc.greater(pc.binary_length(flat), before)
            flat, doc = flat.filter(longer), doc.filter(longer)
            if not len(flat):
                continue
            goes_on = pc.greater(pc.binary_length(flat), length)
            head = pc.binary_slice(flat, 0, length)
            key = pc.if_else(goes_on, pc.binary_join_element_wise(head, pa.scalar(_OPEN, pa.binary()), pa.scalar(b"", pa.binary())), head)
            first = np.ones(len(flat), bool)
            first[1:] = pc.or_(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)), pc.not_equal(doc.slice(1), doc.slice(0, len(doc) - 1))).to_numpy(zero_copy_only=False)
            first = pa.array(first)
            lang = b.column(0).dictionary_encode()
            table = pa.table({"lang": lang.indices.take(doc.filter(first)), "key": key.filter(first)})
            table = table.append_column("n", pa.array(np.ones(table.num_rows, np.int64)))
            yield _named(_summed(table, ["lang", "key"], "n"), lang.dictionary)

    return run


def kept_terms(documents: DataFrame, least: int = DOCUMENTS, first: int = FIRST) -> DataFrame:
    """(lang, term) of the terms that at least ``least`` documents of their language hold.  ``documents``: lang, terms."""
    out, alive, before, length = None, None, 0, first
    while True:
        counted = documents.select("lang", "terms").mapInArrow(_prefixes(length, before), "lang string, key binary, n long")
        if alive is not None:
            counted = counted.withColumn("parent", F.expr(f"substring(key, 1, {before})"))
            counted = attach(counted, alive, ["lang", "parent"], "left_semi")
        counted = stored(counted.groupBy("lang", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "key"))
        goes_on = F.substring("key", -1, 1) == F.lit(_OPEN)
        done = counted.filter(~goes_on).select("lang", F.col("key").alias("term"))
        out = done if out is None else out.unionByName(done)
        alive = counted.filter(goes_on).select("lang", F.expr(f"substring(key, 1, {length})").alias("parent"))
        if alive.isEmpty():
            return out
        before, length = length, GROWTH * length


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences by language and term, with the sources (their codes) that hold the term."""
    release()
    for b in batches:
        doc = pc.list_parent_indices(b.column(2))
        if not len(doc):
            continue
        lang = b.column(0).dictionary_encode()
        table = pa.table({"lang": lang.indices.take(doc), "term": b.column(2).flatten(), "source": b.column(1).take(doc), "n": b.column(3).flatten()})
        rows = _summed(table, ["lang", "term", "source"], "n")
        rows = rows.group_by(["lang", "term"], use_threads=False).aggregate([("source", "list"), ("n", "list")]).combine_chunks()
        held, counts = rows.column("source_list").chunk(0), rows.column("n_list").chunk(0)
        cells = pa.StructArray.from_arrays([held.values, counts.values], ["source", "n"])
        rows = rows.select(["lang", "term"]).append_column("cells", pa.ListArray.from_arrays(held.offsets, cells))
        yield _named(rows, lang.dictionary)


def weights(counts: np.ndarray, totals: np.ndarray, v: int) -> np.ndarray:
    """p of each (term, source): 1 + floor(SCALE * (count + 1) / (total + v)); Python's whole numbers where 64 bits don't hold."""
    if counts.size and int(counts.max()) >= (1 << 62) // SCALE:
        counts, totals = counts.astype(object), totals.astype(object)
    return 1 + SCALE * (counts + SMOOTH) // (totals + SMOOTH * v)


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the terms of a block for each pair of sources of its language: (lang, source, item, value)."""
    release()
    for b in batches:
        for row in range(b.num_rows):
            lang, sources, codes, totals, v = (b.column(c)[row] for c in ("lang", "sources", "codes", "totals", "v"))
            names, totals, v = sources.values, totals.values.to_numpy(), v.as_py()
            held = b.column("cells")[row].values  # of each term its (source, n)
            at, cells = pc.list_parent_indices(held).to_numpy(), held.flatten()
            at = at - at[0]
            col, n = pc.index_in(cells.field("source"), codes.values).to_numpy(), cells.field("n").to_numpy()
            size, step = len(names), max(1, CELLS // len(names))
            value = np.zeros((size, size), object)
            for lo in range(0, int(at.max()) + 1, step):
                here = (at >= lo) & (at < lo + step)
                counts = np.zeros((min(step, int(at.max()) + 1 - lo), size), np.int64)
                counts[at[here] - lo, col[here]] = n[here]
                p = weights(counts, totals, v)
                for j in range(size):
                    q = p[:, j : j + 1]
                    value[:, j] += ((p - q) * (p - q) // q).sum(0)
            i, j = np.nonzero(~np.eye(size, dtype=bool))
            took = pa.array(i), pa.array(j)
            yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(i), pa.string()), names.take(took[0]), names.take(took[1]), pa.array(value[i, j].tolist(), pa.int64())], ["lang", "source", "item", "value"])


def source_divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = DOCUMENTS, top: int = TOP) -> DataFrame:
    """How far each (lang, source) stands from the other sources of its language, and by which terms.

    Rows: lang, source, part, item, value (long), rank (int).  Each kept term of a language weighs
    p = 1 + floor(10^9 * (count + 1) / (all counts + kept terms)) in a source and in the language.  Part ``pair``: item is
    another source, value the sum of floor((p - q)^2 / q) over all kept terms, q being the other's weight; 0 where the
    language keeps no term.  Part ``term``: item is a term of the source with a greater weight than in its language, the
    first ``top`` by value.  Ranks begin at 1, by value descending, then item in byte order.

    Null texts, languages and sources count as empty strings; a source without terms takes part in pairs.  Repeated rows
    count as often as they stand there.  Other columns are ignored.
    """
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    docs = df.select(name(lang_col).alias("lang"), name(source_col).alias("source"), name(text_col).cast("binary").alias("text"))
    # 64-bit codes of sources take their place until the end
    docs = stored(docs.mapInArrow(_documents, "lang string, source string, terms array<binary>, counts array<bigint>"))
    kept = stored(kept_terms(docs, least).select("lang", F.col("term").cast("string").alias("term")))
    coded = docs.select("lang", F.xxhash64("source").alias("code"), "terms", "counts")
    found = coded.mapInArrow(_counts, "lang string, term binary, cells array<struct<source: bigint, n: bigint>>").withColumn("term", F.col("term").cast("string"))
    # hashed, not sorted: a partition's share of the kept terms is far smaller than that of their counts
    found = found.join(kept.hint("shuffle_hash"), ["lang", "term"], "left_semi").select("lang", "term", F.explode("cells").alias("x"))
    found = found.groupBy("lang", "term", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    # of each term its count by source: at most one entry for each
    terms = stored(found.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("cells"), F.sum("n").alias("all")))
    totals = terms.select("lang", F.explode("cells").alias("x")).groupBy("lang", F.col("x.source").alias("code")).agg(F.sum("x.n").alias("total"))
    groups = docs.select("lang", "source", F.xxhash64("source").alias("code")).distinct()
    groups = stored(groups.join(totals, ["lang", "code"], "left").fillna(0, ["total"]))
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    ordered = F.sort_array(F.collect_list(F.struct("source", "code", "total")))
    langs = groups.groupBy("lang").agg(ordered.alias("g"), F.sum("total").alias("lang_total")).join(size, "lang", "left").fillna(0, ["v"])
    langs = stored(langs.select("lang", F.col("g.source").alias("sources"), F.col("g.code").alias("codes"), F.col("g.total").alias("totals"), "lang_total", "v"))
    discard(docs)
    # pairs: blocks of terms, each with the sources of its language
    sized = attach(terms, langs.select("lang", "v"), ["lang"], "inner")
    blocks = sized.groupBy("lang", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / BLOCK)).alias("block")).agg(F.collect_list("cells").alias("cells"))
    sums = blocks.join(langs, "lang").mapInArrow(_pairs, "lang string, source string, item string, value long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    grid = langs.select("lang", F.explode("sources").alias("source"), "sources").select("lang", "source", F.explode("sources").alias("item")).filter("source != item")
    pairs = grid.join(sums, ["lang", "source", "item"], "left").fillna(0, ["value"])
    # terms against the whole language
    sizes = stored(groups.join(langs.select("lang", "lang_total", "v"), "lang"))
    rows = attach(terms.select("lang", "term", "all", F.explode("cells").alias("x")).select("lang", "term", "all", F.col("x.source").alias("code"), "x.n"), sizes, ["lang", "code"], "inner")
    p = lambda n, total: F.expr(f"1 + cast(cast({SCALE} * cast({n} + {SMOOTH} as decimal(20,0)) as decimal(38,0)) div cast({total} + {SMOOTH} * v as decimal(20,0)) as long)")
    rows = rows.select("lang", "source", F.col("term").alias("item"), p("n", "total").alias("p"), p("all", "lang_total").alias("q")).filter("p > q")
    terms = rows.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(w).alias("rank")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)
