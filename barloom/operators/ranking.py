"""Global order statistics without a single-task window.

A rank over a whole table, or inside a group that may hold a third of it, is built from a range partitioning
on (group, value): rows of one group spread over many partitions, each partition is ranked on its own and
shifted by the number of rows before it.  The shift table has one row per (partition, group).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import parts_of, settle


def global_row_number(df: DataFrame, order: Sequence[Column], out: str = "rn") -> DataFrame:
    """1..n in the given total order over the whole table (order keys must be unique)."""
    placed = settle(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # monotonically_increasing_id is (partition << 33) + position inside the partition.
    part = F.shiftright("_at", 33)
    placed = placed.withColumn("_part", part)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_off"),
    )
    position = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return placed.join(offsets, "_part").withColumn(out, F.col("_off") + position + 1).drop("_at", "_part", "_off")


def grouped_row_number(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "rn", total: str | None = None
) -> DataFrame:
    """Row number inside each group, with hot groups spread over range partitions.

    ``total`` adds the group's row count.  Order keys must be unique inside a group.
    """
    numbered = global_row_number(df, [F.col(g) for g in group] + list(order), "_grn")
    bounds = numbered.groupBy(*group).agg(F.min("_grn").alias("_first"), F.count(F.lit(1)).alias("_size"))
    joined = numbered.join(bounds, list(group)).withColumn(out, F.col("_grn") - F.col("_first") + 1)
    if total:
        joined = joined.withColumnRenamed("_size", total)
    return joined.drop("_grn", "_first", "_size")


def value_ranks(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """One row per distinct (group, value): ``cnt`` rows, ``below`` rows under it, ``n`` rows in the group.

    Equal values collapse before the shuffle, so a value that fills a third of the table is one row here.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("cnt"))
    order = [F.col(g) for g in group] + [F.col(value)]
    placed = settle(counts.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part", *group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_local", F.coalesce(F.sum("cnt").over(local), F.lit(0)))
    parts = placed.groupBy("_part", *group).agg(F.sum("cnt").alias("_t"))
    across = Window.partitionBy(*group) if group else Window.partitionBy()
    offsets = parts.select(
        "_part",
        *group,
        F.coalesce(
            F.sum("_t").over(across.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_off"),
        F.sum("_t").over(across).alias("n"),
    )
    return placed.join(offsets, ["_part", *group]).select(
        *group, value, "cnt", (F.col("_off") + F.col("_local")).alias("below"), "n"
    )


def _differs(col: pa.Array) -> np.ndarray:
    """Whether each element differs from the one before; nulls are equal, and so are NaNs."""
    a, b = col.slice(1), col.slice(0, len(col) - 1)
    same = pc.fill_null(pc.equal(a, b), False)
    same = pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(col.type):
        nan = lambda x: pc.fill_null(pc.is_nan(x), False)
        same = pc.or_(same, pc.and_(nan(a), nan(b)))
    return ~same.to_numpy(zero_copy_only=False)


def _local_ties(group: Sequence[str], value: str):
    """Pass over sorted rows: the place of each row's ties in its group and their number, inside the partition.

    ``_tie_side``: bit 0 for the first ties of the partition, bit 1 for its last; those may go on in a neighbour.  Rows
    of the newest ties are held until they end.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: pa.RecordBatch | None = None
        base, opening = 0, True  # rows of the group before ``held``; whether no ties have ended so far

        def out(rows: pa.RecordBatch, lo, n, side):
            cols = [*rows.columns, pa.array(np.full(rows.num_rows, part, np.int32)), pa.array(lo), pa.array(n), pa.array(side.astype(np.int8))]
            return pa.RecordBatch.from_arrays(cols, [*rows.schema.names, "_tie_part", "_tie_lo", "_tie_cnt", "_tie_side"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = b if held is None else pa.concat_batches([held, b])
            new_group = np.ones(rows.num_rows, bool)
            new_group[1:] = np.any([_differs(rows.column(g)) for g in group], axis=0) if group else False
            new = new_group.copy()
            new[1:] |= _differs(rows.column(value))
            starts = np.flatnonzero(new)
            heads = np.maximum.accumulate(np.where(new_group[starts], starts, 0))
            first = np.where(heads == 0, base + starts, starts - heads)  # place in the group of each run of ties
            done = int(starts[-1])
            if done:
                sizes = np.diff(starts)
                side = np.zeros(len(sizes), np.int64)
                side[0] = opening
                opening = False
                yield out(rows.slice(0, done), np.repeat(first[:-1], sizes), np.repeat(sizes, sizes), np.repeat(side, sizes))
            held, base = rows.slice(done), int(first[-1])
        if held is not None:
            n = held.num_rows
            yield out(held, np.full(n, base), np.full(n, n), np.full(n, 2 + opening))

    return run


FIXES = 100_000


def tie_ranks(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with the average rank of ``value`` inside its group in ``out``; ties share their mean rank.

    Rows are range-partitioned by group, value and their own digest, so one value or group with a third of all rows
    lies in many partitions.  Ranks are given inside the sorted partitions; ties that cross partitions are put
    together from one row per partition end, and no row is joined by its value.  Null values rank first.
    """
    order = [*[F.col(g) for g in group], F.col(value)]
    spread = F.xxhash64(*[F.col(f"`{n}`") for n in df.columns], F.monotonically_increasing_id())
    ranged = df.withColumn("_tie_spread", spread).repartitionByRange(*order, F.col("_tie_spread")).drop("_tie_spread").sortWithinPartitions(*order)
    added = [("_tie_part", T.IntegerType()), ("_tie_lo", T.LongType()), ("_tie_cnt", T.LongType()), ("_tie_side", T.ByteType())]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in added)])
    placed = settle(ranged.mapInArrow(_local_ties(group, value), schema))
    sizes = placed.groupBy("_tie_part", *group).agg(F.max(F.col("_tie_lo") + F.col("_tie_cnt")).alias("_tie_n"))
    ends = placed.where("_tie_side > 0").groupBy("_tie_part", *group, "_tie_side").agg(F.first(value).alias("_tie_v"), F.first("_tie_lo").alias("_tie_lo"), F.first("_tie_cnt").alias("_tie_cnt"))
    fixes = _attachable(_tie_fixes(sizes, ends, group))
    same = [F.col("_tie_part").eqNullSafe(F.col("_tie_p")), *[F.col(g).eqNullSafe(F.col(f"_tie_g{i}")) for i, g in enumerate(group)]]
    rank = _fixed([F.col(f"_tie_r{k}") for k in (1, 2, 3)], F.col("_tie_off") + F.col("_tie_lo") + (F.col("_tie_cnt") + 1) / 2)
    return placed.join(fixes, same).select(*df.columns, rank.alias(out))


def _fixed(ends: Sequence[Column], inside: Column) -> Column:
    """The rank of ties at a partition end by their side, else the rank that was given inside the partition."""
    return F.coalesce(*[F.when(F.col("_tie_side") == k, x) for k, x in zip((1, 2, 3), ends, strict=True)], inside)


def _attachable(fixes: DataFrame) -> DataFrame:
    """Stored, and sent to every task as long as it is small: it has a row for each partition, and one more where a group begins."""
    fixes = settle(fixes)
    return F.broadcast(fixes) if fixes.count() <= FIXES else fixes


def _tie_fixes(sizes: DataFrame, ends: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows before each (partition, group), and the ranks of the ties at partition ends."""
    across = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_tie_n").over(across.orderBy("_tie_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_tie_part", *group, before.alias("_tie_off"))
    same = [F.col("_tie_part").eqNullSafe(F.col("_tie_p")), *[F.col(g).eqNullSafe(F.col(f"_tie_g{i}")) for i, g in enumerate(group)]]
    named = sizes.select(F.col("_tie_part").alias("_tie_p"), *[F.col(g).alias(f"_tie_g{i}") for i, g in enumerate(group)], "_tie_off")
    ends = ends.join(named, same).withColumn("_tie_at", F.col("_tie_off") + F.col("_tie_lo"))
    ties = Window.partitionBy(*group, "_tie_v")
    ends = ends.withColumn("_tie_rank", F.min("_tie_at").over(ties) + (F.sum("_tie_cnt").over(ties) + 1) / 2)
    fixes = ends.groupBy("_tie_p", *[f"_tie_g{i}" for i in range(len(group))]).agg(*[F.max(F.when(F.col("_tie_side") == k, F.col("_tie_rank"))).alias(f"_tie_r{k}") for k in (1, 2, 3)])
    on = [F.col("_tie_p").eqNullSafe(F.col("_tie_q")), *[F.col(f"_tie_g{i}").eqNullSafe(F.col(f"_tie_h{i}")) for i in range(len(group))]]
    fixes = fixes.withColumnsRenamed({"_tie_p": "_tie_q", **{f"_tie_g{i}": f"_tie_h{i}" for i in range(len(group))}})
    return named.join(fixes, on, "left").drop("_tie_q", *[f"_tie_h{i}" for i in range(len(group))])


def _ties_of_each(value: str, cols: Sequence[str]):
    """Pass over sorted rows: for each column, the average rank of the row's ties among the partition's rows that have the column."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: pa.RecordBatch | None = None
        base, opening = np.zeros((len(cols), 1), np.int64), True  # rows before ``held``; whether no ties have ended so far

        def out(rows: pa.RecordBatch, starts: np.ndarray, side: np.ndarray):
            sizes = np.diff([*starts, rows.num_rows])
            has = np.stack([pc.is_valid(rows.column(n)).to_numpy(zero_copy_only=False) for n in cols])
            cnt = np.add.reduceat(has.astype(np.int64), starts, axis=1)
            first = base + np.cumsum(cnt, axis=1) - cnt
            ranks = np.repeat(first + (cnt + 1) / 2, sizes, axis=1)
            made = [pa.array(r, mask=~h) for r, h in zip(ranks, has, strict=True)]
            made += [pa.array(np.full(rows.num_rows, part, np.int32)), pa.array(np.repeat(side, sizes).astype(np.int8))]
            names = [*rows.schema.names, *[f"_tie_{i}" for i in range(len(cols))], "_tie_part", "_tie_side"]
            return pa.RecordBatch.from_arrays([*rows.columns, *made], names), base + cnt.sum(axis=1, keepdims=True)

        for b in batches:
            if not b.num_rows:
                continue
            rows = b if held is None else pa.concat_batches([held, b])
            new = np.ones(rows.num_rows, bool)
            new[1:] = _differs(rows.column(value))
            starts = np.flatnonzero(new)
            done = int(starts[-1])
            if done:
                side = np.zeros(len(starts) - 1, np.int64)
                side[0] = opening
                opening = False
                batch, base = out(rows.slice(0, done), starts[:-1], side)
                yield batch
            held = rows.slice(done)
        if held is not None:
            yield out(held, np.zeros(1, np.int64), np.array([2 + opening]))[0]

    return run


def _equal_values(n: int):
    """Rows of ``n`` features and ``n`` scores to one row per batch, feature and value: rows, sum of scores, and the feature's
    sum of squared scores on the batch's first value of it.  A value with a third of all rows is one row in a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(n):
                there = pc.is_valid(b.column(i))
                x = b.column(i).filter(there).to_numpy(zero_copy_only=False)
                if not len(x):
                    continue
                score = b.column(n + i).filter(there).to_numpy(zero_copy_only=False)
                values, at, cnt = np.unique(x + 0.0, return_inverse=True, return_counts=True)
                squares = np.zeros(len(values))
                squares[0] = score @ score
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), i, np.int32)), pa.array(values), pa.array(cnt), pa.array(np.bincount(at, score)), pa.array(squares)],
                    ["_f", "_x", "_n", "_s", "_q"],
                )

    return run


def _rank_products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of values, in any order, to one row per feature: rows, sum of scores, of scores times the value's average rank
    inside the partition, of (t^3 - t) / 12 over ties, and of squares.  Partitions have some half a million values on average."""
    parts: dict[int, list[list[np.ndarray]]] = {}
    for b in batches:
        f, *rest = (col.to_numpy(zero_copy_only=False) for col in b.columns)
        for k in np.unique(f).tolist():
            parts.setdefault(k, []).append([v[f == k] for v in rest])
    sums = []
    for k, found in parts.items():
        x, n, s, q = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.argsort(x)
        x, cnt, s = x[order], n[order].astype(float), s[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))
        starts = np.flatnonzero(new)
        cnt, s = np.add.reduceat(cnt, starts), np.add.reduceat(s, starts)
        rank = np.cumsum(cnt) - cnt + (cnt + 1) / 2
        sums.append([k, cnt.sum(), s.sum(), s @ rank, ((cnt**3 - cnt) / 12).sum(), q.sum()])
    if sums:
        f, *cols = np.array(sums).T
        part = np.full(len(sums), TaskContext.get().partitionId(), np.int32)
        made = [part, f.astype(np.int32), *cols]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in made], ["_part", "_f", "_n", "_s", "_sr", "_t", "_q"])


def rank_correlations(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """Spearman (average ranks) of every column with ``y`` over the rows that have both: ``_f``, the column's number, and ``spearman``.

    ``df`` is stored and has doubles.  Its rows are sorted by ``y`` once for all columns: the rank of a row for one of them counts the rows
    before it that have that one.  Values of the columns then go into ranges with the sum of their rows' ranks, equal
    ones of a batch in one row, and each range leaves one row of sums for each column; nothing is joined by value.
    """
    n, *filled = df.agg(F.count(F.lit(1)), *[F.count(x) for x in cols]).first()
    spark = df.sparkSession
    rows = df.select(y, *cols)
    spread = F.xxhash64(*[F.col(f"`{x}`") for x in rows.columns], F.monotonically_increasing_id())
    ranged = rows.withColumn("_tie_spread", spread).repartitionByRange(parts_of(spark, n), F.col(y), F.col("_tie_spread")).drop("_tie_spread").sortWithinPartitions(y)
    added = [*[(f"_tie_{i}", T.DoubleType()) for i in range(len(cols))], ("_tie_part", T.IntegerType()), ("_tie_side", T.ByteType())]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(x, k) for x, k in added)])
    placed = settle(ranged.mapInArrow(_ties_of_each(y, cols), schema))
    # A row for each partition, end and column.
    sizes = placed.groupBy("_tie_part").agg(*[F.count(x).alias(f"_n{i}") for i, x in enumerate(cols)])
    sizes = sizes.select("_tie_part", F.posexplode(F.array(*[f"_n{i}" for i in range(len(cols))])).alias("_f", "_tie_n"))
    ends = placed.where("_tie_side > 0").groupBy("_tie_part", "_tie_side").agg(
        F.first(y).alias("_tie_v"), F.array(*[F.struct(F.count(x).alias("n"), F.max(f"_tie_{i}").alias("r")) for i, x in enumerate(cols)]).alias("_e")
    )
    ends = ends.select("_tie_part", "_tie_side", "_tie_v", F.posexplode("_e").alias("_f", "_e")).where("_e.n > 0")
    ends = ends.select("_tie_part", "_f", "_tie_side", "_tie_v", (F.col("_e.r") - (F.col("_e.n") + 1) / 2).cast("bigint").alias("_tie_lo"), F.col("_e.n").alias("_tie_cnt"))
    fixes = _tie_fixes(sizes, ends, ["_f"])
    of = lambda i, x: F.max(F.when(F.col("_tie_g0") == i, F.col(x)))
    wide = [of(i, f"_tie_{x}").alias(f"_{x}_{i}") for i in range(len(cols)) for x in ("off", "r1", "r2", "r3")]
    fixes = _attachable(fixes.groupBy("_tie_p").agg(*wide))
    # Average ranks of n rows have the mean (n + 1) / 2; what is left has the mean zero.
    rank = lambda i: _fixed([F.col(f"_r{k}_{i}") for k in (1, 2, 3)], F.col(f"_off_{i}") + F.col(f"_tie_{i}"))
    scores = [(rank(i) - (filled[i] + 1) / 2).alias(f"_s{i}") for i in range(len(cols))]
    ranked = placed.join(fixes, F.col("_tie_part") == F.col("_tie_p")).select(*cols, *scores)
    values = ranked.mapInArrow(_equal_values(len(cols)), "_f int, _x double, _n bigint, _s double, _q double")
    by_value = values.repartitionByRange(parts_of(spark, n * len(cols)), "_f", "_x")
    sums = by_value.mapInArrow(_rank_products, "_part int, _f int, _n double, _s double, _sr double, _t double, _q double")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_f").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = sums.withColumn("_p", F.col("_sr") + before * F.col("_s")).groupBy("_f").agg(*[F.sum(x).alias(x) for x in ("_n", "_p", "_t", "_q")])
    spread_x = (F.pow("_n", F.lit(3)) - F.col("_n")) / 12 - F.col("_t")
    return total.select("_f", F.try_divide(F.col("_p"), F.sqrt(spread_x) * F.sqrt("_q")).alias("spearman"))


def average_ranks(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """Distinct (group, value) with the average rank of its ties."""
    r = value_ranks(df, group, value)
    return r.select(*group, value, (F.col("below") + (F.col("cnt") + 1) / 2).alias(out))


def exact_percentiles(
    df: DataFrame, group: Sequence[str], value: str, points: dict[str, float]
) -> DataFrame:
    """Exact interpolated percentiles per group (continuous definition), hot groups included."""
    ranks = value_ranks(df, group, value)
    cols = []
    for name, p in points.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        inside = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("cnt"))
        cols += [
            F.max(F.when(inside(lo), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(inside(hi), F.col(value))).alias(f"_hi_{name}"),
            F.max(pos - lo).alias(f"_f_{name}"),
        ]
    agg = ranks.groupBy(*group).agg(*cols)
    return agg.select(
        *group,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in points
        ],
    )


def ntile_from_rank(rn: Column, n: Column, buckets: int) -> Column:
    """NTILE bucket of row ``rn`` out of ``n``: the first n % buckets buckets take one row more."""
    small = F.floor(n / buckets)
    extra = n % buckets
    cut = extra * (small + 1)
    return F.when(rn <= cut, F.ceil(rn / (small + 1))).otherwise(
        extra + F.ceil((rn - cut) / F.greatest(small, F.lit(1)))
    )


def shuffled_order(*cols: str, seed: int = 42) -> Column:
    """A reproducible random sort key: the digest of the row's key and the seed."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))
