"""Helpers shared by the corpus operators: stored tables, free column names, word segments and text batches."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import ensure_checkpoint_dir

# White space as tokenizer patterns mean it (the Unicode property), which is narrower than Python's own \s.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

# Cuts a text where every tokenizer of this family cuts as well: each segment holds whole pre-tokens, so its
# tokens do not depend on what stands around it.
SEGMENT = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

# Letters of blocks without exceptions, then ASCII punctuation other than the apostrophe: one pre-token each.
_SIMPLE = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


def pre_tokens(segment: str, pattern) -> list[str]:
    """The pre-tokens of a segment by ``pattern`` (compiled), found without it where the segment is simple."""
    m = _SIMPLE(segment)
    if m is None:
        return pattern.findall(segment)
    return [m[1], m[2]] if m[2] else [m[1]]

_RESIDENT: dict = {}


def release() -> None:
    """Drop what ``resident`` keeps and give free memory back to the system; tasks of operators that keep nothing begin with it."""
    _RESIDENT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def resident(key, make: Callable):
    """What a worker process keeps between tasks: one thing at a time, so operators run one after another add nothing up."""
    if key not in _RESIDENT:
        release()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def work_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: one evaluation, no lineage, no lost blocks."""
    path = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned, once everything built on them is stored itself."""
    for t in tables:
        _delete(t.sparkSession, t._stored_at)


def clear_stored(spark: SparkSession) -> None:
    """Delete what ``stored`` wrote in this application; call it when the results built on it are written."""
    _delete(spark, work_folder(spark))


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, or ``name`` with underscores before it until no column is called so."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def segments(text: str, window: int = 4 << 20) -> Iterator[list[str]]:
    """The segments of a text, a window at a time, so that a very long text is never held as one list."""
    at, n = 0, len(text)
    while at < n:
        found = SEGMENT.findall(text, at, at + window)
        if at + window < n:
            if len(found) < 3:
                window *= 2
                continue
            del found[-2:]  # these may go on behind the window
            at += sum(map(len, found))
        else:
            at = n
        yield found


# Keys of segments.  The usual segment, a space and what follows it, goes by what follows it; marks stand for the
# others: _BARE before a segment without that space, _LINE for a line end.
_BARE, _LINE = "\0", "\1"
_ODD = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def segment_keys(text: str, window: int = 4 << 20) -> Iterator[list[str]]:
    """Keys of the segments of a text.

    Where single spaces and single line ends are the only white space, splitting at them gives the segments.
    """
    rare = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", _BARE, _LINE)
    if len(text) > window or any(x in text for x in rare) or not (text.isascii() or _ODD.search(text) is None):
        for part in segments(text, window):
            yield [key_of(s) for s in part]
    elif text:
        yield (_BARE + text.replace("\n", f" {_LINE} {_BARE}")).split(" ")


def key_of(segment: str) -> str:
    if segment[0] == " " and len(segment) > 1 and segment[1] not in (_BARE, _LINE) and SEGMENT.match(segment).end() == len(segment):
        return segment[1:]
    return _LINE if segment == "\n" else _BARE + segment


def segment_of(key: str) -> str:
    return key[1:] if key[:1] == _BARE else "\n" if key == _LINE else " " + key


class SegmentTable(dict):
    """Numbers the segments it meets and keeps one value for each: what ``learn`` makes of the new ones.

    It holds about ``limit`` segments.  When it has more, those met only once are forgotten.  ``cut`` gives the
    keys of a text and ``named`` the segment of a key.
    """

    def __init__(self, learn: Callable[[list[str]], list], limit: int = 400_000, cut=segment_keys, named=segment_of):
        super().__init__()
        self.learn, self.limit, self.cut, self.named = learn, limit, cut, named
        self.new, self.values_of = [], []
        self.met = np.zeros(0, np.int64)

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n

    def value(self, segment: str):
        """The value of a segment that has one by now, else None."""
        n = self.get(key_of(segment))
        return self.values_of[n] if n is not None and n < len(self.values_of) else None

    def forget(self) -> None:
        words = list(self)
        kept = np.flatnonzero(self.met > 1)
        if len(kept) > self.limit // 2:
            kept = np.sort(kept[np.argsort(-self.met[kept], kind="stable")[: self.limit // 2]])
        self.values_of = [self.values_of[i] for i in kept]
        self.met = self.met[kept]
        self.clear()
        for n, i in enumerate(kept.tolist()):
            self[words[i]] = n

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of the segments of each text; ``values_of`` has a value for each until the next call."""
        if len(self) > self.limit:
            self.forget()
        found = []
        for t in texts:
            parts = [np.array(list(map(self.__getitem__, s)), np.int32) for s in self.cut(t)]
            found.append(parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.int32), *parts]))
        for i in range(0, len(self.new), 20_000):
            self.values_of += self.learn(list(map(self.named, self.new[i : i + 20_000])))
        self.new.clear()
        self.met = np.concatenate([self.met, np.zeros(len(self) - len(self.met), np.int64)])
        if found:
            self.met += np.bincount(np.concatenate(found), minlength=len(self))
        return found

    def joined(self, texts: list[str]) -> list[bytes]:
        """The values (bytes) of all segments of each text, one after another."""
        found = self.numbers(texts)
        value = self.values_of.__getitem__
        return [b"".join(map(value, x.tolist())) for x in found]


def by_size(texts: list[str], size: int = 4 << 20) -> Iterator[list[str]]:
    """Consecutive texts, about ``size`` characters or one text at a time."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= size:
            yield texts[lo : i + 1]
            lo, n = i + 1, 0
    if lo < len(texts):
        yield texts[lo:]


def id_lists(ids: list[bytes]) -> tuple[pa.ListArray, list[int]]:
    """Little-endian 32-bit ids of many rows as one Arrow list column, and their number by row."""
    sizes = [len(x) // 4 for x in ids]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    flat = pa.Array.from_buffers(pa.int32(), sum(sizes), [None, pa.py_buffer(b"".join(ids))])
    return pa.ListArray.from_arrays(offsets, flat), sizes


def tokenizer_path(name: str) -> str:
    """Where the installed package keeps a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def attach(df: DataFrame, lists: DataFrame, keys: list[str], how: str, rows: int = 300_000, elements: int = 3_000_000, size: str | None = None) -> DataFrame:
    """``df`` joined with ``lists`` (a stored table, one row per key).

    The lists are broadcast where they have at most ``rows`` rows and, with ``size`` naming an array column,
    ``elements`` array elements; beyond that both sides are shuffled.
    """
    total = F.sum(F.size(size)) if size else F.lit(0).cast("long")
    n, m = lists.agg(F.count(F.lit(1)), F.coalesce(total, F.lit(0))).first()
    return df.join(F.broadcast(lists) if n <= rows and m <= elements else lists, keys, how)


SHARES = 1000


def sized_join(rows: DataFrame, sizes: DataFrame, keys: list[str], size: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``sizes`` (both stored), which has one row per key and in ``size`` its rows in ``rows``.

    Keys with more than a ``SHARES``-th of the rows are fewer than ``SHARES``; those are broadcast, so their rows stay
    where they are.  The others are shuffled.
    """
    total = sizes.agg(F.sum(size)).first()[0] or 0
    hot = sizes.filter(F.col(size) > total / SHARES)
    if hot.isEmpty():
        return rows.join(sizes, keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(sizes.filter(F.col(size) <= total / SHARES), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` stored in that order, with the place of each row (from 0) in ``name``; no task sees more than its range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(ranged.withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(name), 33)
    sizes = sorted((p, n) for p, n in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    begins, at = [], 0
    for p, n in sizes:
        begins.append((p, at - (p << 33)))
        at += n
    begins = df.sparkSession.createDataFrame(begins, "_part long, _begin long")
    return rows.withColumn("_part", part).join(F.broadcast(begins), "_part").withColumn(name, F.col(name) + F.col("_begin")).drop("_part", "_begin")
