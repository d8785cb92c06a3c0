"""Exact duplicates by content sort.

Rows are range-partitioned by sampled splitters over the normalised bytes, sorted inside each partition, and
every row is compared in full with its neighbour; the smallest identifier of a run of equal texts stays.

The splitter key is (first 64 characters, 64-bit digest, identifier).  It has a bounded size, so the sample
that reaches the driver does not grow with the texts, and the identifier lets a run of copies that holds a
large share of all rows spread over many partitions.  A run that crosses partitions is put together
afterwards: each partition reports the texts of the runs at its two ends, which is a number of rows bounded by
the number of partitions, and equal ones are merged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import free_name, release, stored

PREFIX = 64


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text.

    The pattern leaves a lone space alone, which is what it would be replaced by.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _runs(columns: list[str], heads_only: bool):
    """Pass over sorted rows: number the runs of equal texts and report the texts at both ends of the partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        base = TaskContext.get().partitionId() << 40
        n_runs, last_text, last_key, schema, head = 0, None, None, None, None
        at_start, first_key = True, None
        tail: list[tuple[int, object, str]] = []  # the runs that share the newest splitter key
        empty: list = []

        def edge(rows):
            cols = {"_kind": pa.array([1] * len(rows), pa.int8()), "_run": pa.array([r for r, _, _ in rows], pa.int64()),
                    "_first": pa.array([False] * len(rows)), "_head": pa.array([h for _, h, _ in rows], schema.field("_id").type),
                    "_edge": pa.array([t for _, _, t in rows], pa.string())}
            cols |= {c: pa.nulls(len(rows), schema.field(c).type) for c in columns}
            return pa.RecordBatch.from_pydict(cols)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            schema = batch.schema
            text, key, ids = batch.column("_norm"), batch.column("_key"), batch.column("_id")
            new = np.ones(n, bool)
            if n > 1:
                new[1:] = ~pc.equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[0] = last_text is None or text[0].as_py() != last_text
            runs = n_runs + np.cumsum(new) - 1
            starts = np.flatnonzero(new)
            # identifier of the first row of each row's run; a run that goes on from the last batch keeps its own
            owner = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            heads = pc.take(ids, pa.array(np.maximum(owner, 0)))
            if not new[0]:
                heads = pc.if_else(pa.array(owner >= 0), heads, head)
            for i in starts:
                k = key[int(i)].as_py()
                if first_key is None:
                    first_key = k
                if k != last_key:
                    if at_start and last_key is not None:
                        at_start = False
                        empty += tail
                    tail, last_key = [], k
                tail.append((base + int(runs[i]), ids[int(i)].as_py(), text[int(i)].as_py()))
            take = pa.array(starts) if heads_only else None
            out = {"_kind": pa.array(np.zeros(n, np.int8)), "_run": pa.array(base + runs), "_first": pa.array(new), "_head": heads,
                   "_edge": pa.nulls(n, pa.string())} | {c: batch.column(c) for c in columns}
            done = pa.RecordBatch.from_pydict(out)
            yield done.take(take) if heads_only else done
            n_runs, last_text, head = int(runs[-1]) + 1, text[n - 1].as_py(), heads[n - 1]
        if schema is not None:
            yield edge(empty + tail)

    return run


def _marked(df: DataFrame, id_col: str, text: Column, keep: dict[str, Column], heads_only: bool) -> tuple[DataFrame, dict[str, str]]:
    """Rows with their run, evaluated once, and rows of kind 1 for the runs at partition ends."""
    names = {c: f"_c{i}" for i, c in enumerate(keep)}
    rows = df.select(F.col(id_col).alias("_id"), normalised(text).alias("_norm"), *(x.alias(names[c]) for c, x in keep.items()))
    if "_sha" in keep:
        rows = rows.withColumn(names["_sha"], F.sha2("_norm", 256))
    rows = rows.withColumn("_key", F.struct(F.substring("_norm", 1, PREFIX).alias("p"), F.xxhash64("_norm").alias("h")))
    order = [F.col("_key"), F.col("_id").asc_nulls_last()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(F.col("_key"), F.col("_norm"), F.col("_id").asc_nulls_last())
    idt, kinds = df.schema[id_col].dataType, {c: rows.schema[names[c]].dataType for c in keep}
    schema = T.StructType([
        T.StructField("_kind", T.ByteType()), T.StructField("_run", T.LongType()), T.StructField("_first", T.BooleanType()),
        T.StructField("_head", idt), T.StructField("_edge", T.StringType()), *(T.StructField(names[c], kinds[c]) for c in keep),
    ])
    return stored(rows.mapInArrow(_runs(list(names.values()), heads_only), schema)), names


def _merged(marked: DataFrame) -> DataFrame:
    """Runs at partition ends with the run and identifier that their text begins with; at most a few per partition."""
    ends = marked.filter("_kind = 1").select("_run", "_head", "_edge").distinct()
    same = Window.partitionBy("_edge")
    by_id = same.orderBy(F.col("_head").asc_nulls_last(), F.col("_run")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.struct("_run", "_head")).over(by_id)
    return ends.select(F.col("_run").alias("_from"), first.alias("_to")).filter("_from != _to._run")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: identifier, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after ``normalised``.  Null texts count as empty.  Repeated identifiers are
    rows of their own; exactly one row of each group is kept, among ties any one.  Null identifiers come last,
    so keep_id is null only in a group without any identifier.  Other columns are ignored.
    """
    marked, names = _marked(df, id_col, F.col(text_col), {"_id": F.col(id_col), "_sha": F.lit("")}, heads_only=False)
    rows = marked.filter("_kind = 0").join(F.broadcast(_merged(marked)), F.col("_run") == F.col("_from"), "left")
    rows = rows.select(
        F.col(names["_id"]).alias("_id"), F.col(names["_sha"]).alias("_sha"), F.coalesce("_to._run", "_run").alias("_group"),
        F.when(F.col("_to").isNotNull(), F.col("_to._head")).otherwise(F.col("_head")).alias("_keep"),
        (F.col("_first") & F.col("_to").isNull()).alias("_kept"),
    )
    sizes = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_size"))
    return rows.join(sizes, "_group").select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``exact_dedup`` keeps, with all their columns, whatever their names.

    Null texts count as empty, so of those one row stays; null identifiers come last, and of repeated rows one stays.
    """
    name = free_name(df.columns, "_kept_columns")
    whole = df.withColumn(name, F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    marked, names = _marked(whole, id_col, F.col(text_col), {name: F.col(name)}, heads_only=True)
    gone = F.broadcast(_merged(marked).select(F.col("_from").alias("_run")))
    return marked.filter("_kind = 0").join(gone, "_run", "left_anti").select(f"{names[name]}.*")
