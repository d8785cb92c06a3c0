"""Repeated word sequences by relative Lempel-Ziv parsing.

A window is ``LEAST`` consecutive words.  Its anchor is the run of ``CORE`` words inside it whose hash is the smallest (the
last among equals), so equal windows have equal anchors at the same place.  Consecutive windows of a document with one
anchor make a segment.  The segments of an anchor are a reference block: what repeats one of its windows has a segment
there.  Each document is thus parsed against every block that can hold a copy of its text, and against no other.

Segments that occur more than once as a whole need no parse: all their windows repeat.  The others are factored greedily
against their block: the longest match with another segment that begins at the present word becomes a factor, and the
parse goes on with the first window that crosses the factor's end, so windows at factor boundaries are looked up as
well.  Only the text of different segments with an anchor in common is moved.

An anchor with more than ``SEGMENTS`` different segments (the words around a very common passage) is no block that
one task holds: its segments are cut into their windows, which are counted by hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import discard, free_name, release, sized_join, stored

LEAST, CORE, SEGMENTS = 35, 12, 256
PIECE = 1 << 20  # words that are hashed at a time
_FACTORS = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_PLACE = np.uint64((1 << 24) - 1)
_POWERS: dict = {}


def _powers(factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd factor and of its inverse, modulo 2^64."""
    if len(_POWERS.get(factor, ((),))[0]) < n:
        made = []
        for x in (factor, pow(factor, -1, 1 << 64)):
            steps = np.full(max(n, 1 << 16), x, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _POWERS[factor] = tuple(made)
    return _POWERS[factor][0][:n], _POWERS[factor][1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def range_hashes(h: np.ndarray, first: np.ndarray, end: np.ndarray, factor: int) -> np.ndarray:
    """Hash of each run of word hashes [first, end), by prefix sums of a polynomial modulo 2^64."""
    up, down = _powers(factor, len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:-1])])
    return _mixed((sums[end] - sums[first]) * down[first])


def _least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    span = 1
    while span < width:
        step = min(span, width - span)
        x = np.minimum(x[:-step], x[step:])
        span += step
    return x


def segments(h: np.ndarray, ends: np.ndarray, least: int = LEAST, core: int = CORE) -> tuple[np.ndarray, ...]:
    """Segments of texts laid end to end: first word, end word, place and hash of the anchor, hash of the segment.

    ``h``: word hashes, ``ends``: where each text ends; at most 2^24 words in all.
    """
    none = np.zeros(0, np.int64)
    if len(h) < least:
        return none, none, none, none, none
    at = np.arange(len(h) - core + 1)
    cores = range_hashes(h, at, at + core, _FACTORS[0])
    key = cores & ~_PLACE | (_PLACE - at.astype(np.uint64))
    anchor = (_PLACE - (_least_of(key, least - core + 1) & _PLACE)).astype(np.int64)
    starts = np.arange(len(anchor))
    inside = starts + least <= ends[np.searchsorted(ends, starts, "right")]
    starts, anchor = starts[inside], anchor[inside]
    if not len(starts):
        return none, none, none, none, none
    fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = starts[fresh]
    end = np.concatenate([starts[:-1][fresh[1:]], starts[-1:]]) + least
    return first, end, anchor[fresh], cores[anchor[fresh]].view(np.int64), range_hashes(h, first, end, _FACTORS[1]).view(np.int64)


def _pieces(texts: list[bytes | None], least: int) -> Iterator[tuple[list[tuple[int, int]], list[bytes], list[int]]]:
    """Words of many texts, about ``PIECE`` at a time: (row, first word) of each piece, all words, where each piece ends.

    A very long text is cut into pieces that share ``least`` - 1 words, so each window lies in one piece.
    """
    held, words, ends = [], [], []
    for row, text in enumerate(texts):
        found = text.split() if text else []
        if len(found) < least:
            continue
        for lo in range(0, len(found) - least + 1, PIECE):
            held.append((row, lo))
            words += found[lo : lo + PIECE + least - 1]
            ends.append(len(words))
            if len(words) >= PIECE:
                yield held, words, ends
                held, words, ends = [], [], []
    if held:
        yield held, words, ends


def found_segments(least: int, core: int):
    """Rows of the columns before the text, which is the last one, with each segment: pos, words, at (its anchor's place), core, seg."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            for held, words, ends in _pieces(b.column(b.num_columns - 1).to_pylist(), least):
                h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
                ends = np.array(ends)
                first, end, anchor, cores, segs = segments(h, ends, least, core)
                piece = np.searchsorted(ends, first, "right")
                begin = np.concatenate([[0], ends[:-1]])[piece]
                rows, lo = np.array(held)[piece].reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(rows)) for c in b.columns[:-1]), pa.array((first - begin + lo).astype(np.int32)),
                     pa.array((end - first).astype(np.int32)), pa.array((anchor - first).astype(np.int32)), pa.array(cores), pa.array(segs)],
                    [*b.schema.names[:-1], "pos", "words", "at", "core", "seg"],
                )

    return run


def _texts(least: int):
    """The text of each wanted segment, or of each of its windows the hash."""
    names = ["core", "seg", "n", "_doc", "pos", "text", "h1", "h2"]
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        out: list[tuple] = []

        def flush():
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for b in batches:
            for doc, text, wanted in zip(*(b.column(c).to_pylist() for c in ("_doc", "_text", "_wanted")), strict=True):
                words = text.split()
                for s in wanted:
                    lo, hi = s["pos"], s["pos"] + s["words"]
                    head = (s["core"], s["seg"], s["n"], doc)
                    if s["hot"]:
                        for p in range(lo, hi - least + 1):
                            h = xxhash.xxh3_128_intdigest(b" ".join(words[p : p + least]))
                            out.append((*head, p, None, signed(h >> 64), signed(h & (1 << 64) - 1)))
                    else:
                        out.append((*head, lo, b" ".join(words[lo:hi]), None, None))
                    if len(out) > 20_000:
                        yield flush()
        yield flush()

    return run


def factors(block: list[tuple[bool, list[bytes]]], least: int = LEAST) -> Iterator[tuple[int, int, int]]:
    """Greedy parse of the segments of a block: (segment, first word, end word) of the factors found in another one.

    ``block``: for each segment whether it is to be parsed, and its words.
    """
    index: dict[bytes, list[tuple[int, int]]] = {}
    for i, (_, words) in enumerate(block):
        for s in range(len(words) - least + 1):
            places = index.setdefault(b" ".join(words[s : s + least]), [])
            if len(places) < 2:  # of two different segments one is another than the one parsed
                places.append((i, s))
    for i, (parse, words) in enumerate(block):
        s = 0
        while parse and s <= len(words) - least:
            other = next((x for x in index[b" ".join(words[s : s + least])] if x[0] != i), None)
            if other is None:
                s += 1
                continue
            end, (j, t) = s + least, other
            t += least
            while end < len(words) and t < len(block[j][1]) and words[end] == block[j][1][t]:
                end, t = end + 1, t + 1
            yield i, s, end
            s = end - least + 1


def _parsed(least: int):
    """Pass over rows sorted by anchor: the factors of each block, held one block at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        block: dict[int, tuple] = {}
        key, out = None, []

        def close():
            rows = list(block.values())
            for i, a, z in factors([(n == 1, t.split(b" ")) for n, _, _, t in rows], least):
                _, doc, pos, _ = rows[i]
                out.append((doc, pos + a, pos + z))

        def flush():
            cols = list(zip(*out, strict=True)) or [()] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["_doc", "a", "z"])

        for b in batches:
            for core, seg, *row in zip(*(b.column(c).to_pylist() for c in ("core", "seg", "n", "_doc", "pos", "text")), strict=True):
                if core != key:
                    close()
                    block, key = {}, core
                    if len(out) > 20_000:
                        yield flush()
                block[seg] = tuple(row)
        close()
        yield flush()

    return run


def repeated_spans(docs: DataFrame, least: int = LEAST, core: int = CORE) -> DataFrame:
    """(_doc, a, z): words [a, z) of a text are covered by windows that start elsewhere too.  ``docs``: _doc, _text."""
    found = stored(docs.mapInArrow(found_segments(least, core), "_doc long, pos int, words int, at int, core long, seg long").drop("at"))
    cores = found.groupBy("core").agg(F.count(F.lit(1)).alias("n"), (F.min("seg") == F.max("seg")).alias("alike"))
    cores = stored(cores.filter("n > 1"))
    rows = stored(sized_join(found, cores, ["core"]).drop("n"))
    discard(found, cores)
    place = F.min(F.struct("_doc", "pos", "words")).alias("place")
    segs = stored(rows.groupBy("core", "seg").agg(F.count(F.lit(1)).alias("n"), F.first("alike").alias("alike"), place))
    whole = stored(segs.filter("n > 1").select("core", "seg", "n"))
    spans = sized_join(rows.select("_doc", "pos", "words", "core", "seg"), whole, ["core", "seg"])
    spans = spans.select("_doc", F.col("pos").alias("a"), (F.col("pos") + F.col("words")).alias("z"))
    # blocks with different segments: their texts, one place for each
    mixed = segs.filter("not alike").select("core", "seg", "n", "place.*")
    sizes = stored(mixed.groupBy("core").agg(F.count(F.lit(1)).alias("variants")))
    mixed = sized_join(mixed, sizes, ["core"], "variants").withColumn("hot", F.col("variants") > SEGMENTS)
    wanted = stored(mixed.groupBy("_doc").agg(F.collect_list(F.struct("core", "seg", "n", "pos", "words", "hot")).alias("_wanted")))
    kinds = "core long, seg long, n long, _doc long, pos int, text binary, h1 long, h2 long"
    texts = stored(docs.join(wanted, "_doc").select("_doc", "_text", "_wanted").mapInArrow(_texts(least), kinds))
    discard(segs, sizes, wanted)
    cold = texts.filter("text is not null").repartition("core").sortWithinPartitions("core")
    cold = cold.mapInArrow(_parsed(least), "_doc long, a int, z int")
    windows = texts.filter("text is null").select("seg", "n", "_doc", "pos", "h1", "h2").distinct()
    held = stored(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("times")).filter("times > 1"))
    hot = sized_join(windows.filter("n = 1"), held, ["h1", "h2"], "rows")
    hot = hot.select("_doc", F.col("pos").alias("a"), (F.col("pos") + least).alias("z"))
    return spans.unionByName(cold).unionByName(hot)


def _kept(text_at: int, spans_at: int, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            texts, counts, gone = [], [], []
            for text, spans in zip(b.column(text_at).to_pylist(), b.column(spans_at).to_pylist(), strict=True):
                words = (text or "").encode().split()
                keep = np.ones(len(words), bool)
                for s in spans or ():
                    keep[s["a"] : s["z"]] = False
                counts.append(len(words))
                gone.append(len(words) - int(keep.sum()))
                left = words if not gone[-1] else [words[i] for i in np.flatnonzero(keep).tolist()]
                texts.append(None if text is None else b" ".join(left).decode())
            cols = [pa.array(texts, pa.string()) if i == text_at else c for i, c in enumerate(b.columns) if i != spans_at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names)

    return run


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, core: int = CORE, counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """``df`` with each text cut down to the words that no repeated window covers, joined by single spaces.

    Words stand between ASCII white space and are compared as bytes.  A window repeats when its ``least`` words start
    anywhere else as well, in the same text or in another row, on the texts as they come; rows that repeat each other
    repeat all their windows.  Null texts stay null and have no words.  All rows and columns stay; ``counts`` names two
    columns that are added: the words of the text and those taken out (an earlier column of that name is replaced).
    Null identifiers are like any other.  A span of words in a document is taken out wherever the document's row repeats.
    """
    text = F.col(f"`{text_col}`").cast("string")
    key = F.xxhash64(F.to_json(F.struct(F.col(f"`{id_col}`").alias("i"))), text)
    docs = df.select(key.alias("_doc"), text.cast("binary").alias("_text"))
    spans = repeated_spans(docs, least, core)
    rows = df.drop(*counts).withColumn(text_col, text)
    doc, cut = free_name(rows.columns, "_doc"), free_name(rows.columns, "_spans")
    lists = spans.groupBy(F.col("_doc").alias(doc)).agg(F.collect_set(F.struct("a", "z")).alias(cut))
    kept = rows.withColumn(doc, key).join(lists, doc, "left").select(*(F.col(f"`{c}`") for c in rows.columns), cut)
    schema = T.StructType([*rows.schema.fields, T.StructField(counts[0], T.LongType()), T.StructField(counts[1], T.LongType())])
    at = [c.lower() for c in rows.columns].index(text_col.lower())
    kept = kept.toDF(*(f"_{i}" for i in range(len(kept.columns))))  # a name with a dot can't be passed on
    return kept.mapInArrow(_kept(at, len(rows.columns), schema.names), schema)
