"""Line dedup by overlapping chunks of two lines.

Every two consecutive lines make a chunk, so a repeated passage of two or more lines is covered by its chunks from its
first line to its last, whatever stands around it.  Chunks that occur more than once in the corpus are compared byte by
byte; the occurrence with the smallest identifier (then the smallest line number) stays and the lines of the others are
taken out.  The first occurrence of a line in the corpus always stays, as each chunk that holds it is a first one too.

Only hashes are shuffled for all chunks; texts are read again for chunks whose hash repeats.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import attach, free_name, stored

LINES = 2


def chunks(text: bytes) -> list[tuple[int, int]]:
    """(first line, end line) of each chunk."""
    return [(lo, lo + LINES) for lo in range(text.count(b"\n") + 2 - LINES)]


def _key(id_col: str):
    """The identifier as it enters a row's digest: null differs from every value."""
    return F.to_json(F.struct(F.col(id_col).alias("i")))


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, first, end, one, two = [], [], [], [], []
        for i, text in enumerate(b.column(2).to_pylist()):
            if not text or b"\n" not in text:
                continue
            lines = text.split(b"\n")
            for lo, hi in chunks(text):
                h = xxhash.xxh3_128_intdigest(b"\n".join(lines[lo:hi]))
                rows.append(i)
                first.append(lo)
                end.append(hi)
                one.append(h >> 64)
                two.append(h & (1 << 64) - 1)
        take = pa.array(rows, pa.int64())
        signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(take), b.column(1).take(take), pa.array(first, pa.int32()), pa.array(end, pa.int32()), *signed],
            ["_id", "_digest", "first", "end", "h1", "h2"],
        )


def repeated_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks to take out: _id, _digest (of identifier and text), first, end (lines).  See ``drop_repeated_chunks``."""
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).alias("_id"), F.xxhash64(_key(id_col), text).alias("_digest"), text.alias("_text"))
    kind = df.schema[id_col].dataType.simpleString()
    found = docs.withColumn("_text", F.col("_text").cast("binary")).mapInArrow(_hashed, f"_id {kind}, _digest long, first int, end int, h1 long, h2 long")
    found = stored(found)
    often = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = stored(found.join(often, ["h1", "h2"]).distinct())
    # The bytes of these chunks: equal hashes count only where all occurrences hold the same text.
    lists = stored(found.groupBy("_digest").agg(F.collect_list(F.struct("first", "end", "h1", "h2")).alias("_chunks")))
    lines = F.split("_text", "\n", -1)
    read = attach(docs.select("_digest", "_text"), lists, ["_digest"], "inner", size="_chunks")
    read = read.withColumn("_lines", lines).select("_lines", F.explode("_chunks").alias("c"))
    read = read.select("c.h1", "c.h2", F.array_join(F.slice("_lines", F.col("c.first") + 1, F.col("c.end") - F.col("c.first")), "\n").alias("_chunk"))
    texts = read.groupBy("h1", "h2", "_chunk").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("texts"))
    same = texts.filter("texts = 1").select("h1", "h2")
    order = F.struct(F.col("_id").isNull().alias("z"), "_id", "_digest", "first")
    keep = found.groupBy("h1", "h2").agg(F.min(order).alias("k")).join(same, ["h1", "h2"])
    return found.join(keep, ["h1", "h2"]).filter(order != F.col("k")).select("_id", "_digest", "first", "end")


def drop_repeated_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with its texts free of repeated passages of two or more lines; all rows and columns stay.

    Null texts stay null.  A text that loses all its lines becomes empty.  Rows with equal identifier and text
    are treated alike: the first of a set of repeated rows does not lose its chunks to its twins.  Null
    identifiers come last when the occurrence that stays is chosen.
    """
    # Chunks that overlap or touch make one run; a window of one document, bounded by its lines.
    w = Window.partitionBy("_digest").orderBy("first")
    gone = repeated_chunks(df, id_col, text_col).select("_digest", "first", "end").distinct()
    gone = gone.withColumn("new", F.when(F.lag("end").over(w) >= F.col("first"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    gone = gone.groupBy("_digest", "run").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    gone = gone.groupBy("_digest").agg(F.collect_list(F.struct("first", "end")).alias("_gone"))
    digest, cut = free_name(df.columns, "_digest"), free_name(df.columns, "_gone")
    lists = stored(gone.withColumnsRenamed({"_digest": digest, "_gone": cut}))
    rows = df.withColumn(digest, F.xxhash64(_key(id_col), F.col(text_col).cast("string")))
    rows = attach(rows, lists, [digest], "left", size=cut)
    left = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.exists(F.col(cut), lambda r: (i >= r["first"]) & (i < r["end"])))
    text = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return rows.withColumn(text_col, text).select(*df.columns)
