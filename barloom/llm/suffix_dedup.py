"""Repeated passages by a sparse suffix array.

Of all word suffixes of the corpus, only those are retained that begin at a minimiser: the position whose hash of
``CORE`` words is the smallest in a window of ``LEAST`` words.  Two documents that share a window share the minimiser
inside it, at the same place.  A suffix is kept with as much text as its windows reach to both sides, and suffixes whose
core occurs in one document alone cannot match and are left out before any text is moved.

Suffixes with one core are a stretch of the sorted order.  Where all of them have the same text around the core, every
window of it is shared.  Otherwise they are sorted by their text, neighbours are compared word by word, and for each
length to the right the suffixes that share it are a run of the order; inside a run the match is extended to the left.
So the documents that hold a window are known, and the first of them keeps it.  The suffixes of a very common core
(the edges of a passage in most documents) are no stretch for one task: they are cut into their windows, which meet by
hash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import discard, release, sized_join, stored
from barloom.llm.substring_dedup import found_segments

LEAST, CORE, SUFFIXES = 50, 25, 256


def shared_windows(block: list[tuple], least: int = LEAST) -> list[list[tuple[int, int]]]:
    """For each suffix of a core: (words before the core, holder) of its windows that another document holds too.

    ``block``: (first holder, smallest and largest document, words before the core from the nearest on, words from the
    core on) of different suffixes; a holder is a comparable key that ends in its document.
    """
    order = sorted(range(len(block)), key=lambda i: block[i][4])
    common = [0] * len(order)  # words shared with the suffix before
    for n in range(1, len(order)):
        a, b = block[order[n - 1]][4], block[order[n]][4]
        k, most = 0, min(len(a), len(b))
        while k < most and a[k] == b[k]:
            k += 1
        common[n] = k
    out: list[list[tuple[int, int]]] = [[] for _ in block]

    def close(run: list[int], before: int) -> None:
        alike = defaultdict(list)
        for i in run:
            left = block[i][3]
            if len(left) >= before:
                alike[tuple(left[:before])].append(i)
        for held in alike.values():
            if min(block[i][1] for i in held) != max(block[i][2] for i in held):
                holder = min(block[i][0] for i in held)[-1]
                for i in held:
                    out[i].append((before, holder))

    for before in range(max(len(b[3]) for b in block) + 1):
        behind, run = least - before, []
        for n, i in enumerate(order):
            if len(block[i][4]) < behind:
                close(run, before)
                run = []
                continue
            if run and common[n] < behind:
                close(run, before)
                run = []
            run.append(i)
        close(run, before)
    return out


_KNOWN = ["core", "seg", "null", "name", "holder", "low", "high"]


def _texts(least: int):
    """The text of each wanted suffix, or of each of its windows the hash."""
    names = [*_KNOWN, "at", "text", "h1", "h2"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        out: list[tuple] = []
        fields: pa.StructType | None = None

        def flush():
            kinds = [*(fields.field(n).type for n in _KNOWN), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for b in batches:
            fields = b.column(1).type.value_type
            for text, wanted in zip(*(b.column(c).to_pylist() for c in ("_text", "_wanted")), strict=True):
                words = text.split()
                for s in wanted:
                    lo, hi = s["pos"], s["pos"] + s["words"]
                    head = tuple(s[n] for n in _KNOWN)
                    if s["hot"]:  # windows by their place in the segment
                        for p in range(lo, hi - least + 1):
                            h = xxhash.xxh3_128_intdigest(b" ".join(words[p : p + least]))
                            out.append((*head, p - lo, None, signed(h >> 64), signed(h & (1 << 64) - 1)))
                    else:
                        out.append((*head, s["at"], b" ".join(words[lo:hi]), None, None))
                    if len(out) > 20_000:
                        yield flush()
        if out:
            yield flush()

    return run


def _compared(least: int):
    """Pass over suffixes sorted by core: (core, seg, first, end, holder) of runs of shared windows, by their place in the segment."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        block: dict[int, tuple] = {}
        key, out = None, []

        def close():
            if not block:
                return
            for (seg, at), found in zip(((s, v[5]) for s, v in block.items()), shared_windows(list(block.values()), least), strict=True):
                for before, holder in sorted(found, reverse=True):  # from the first window on
                    place = at - before
                    if out and out[-1][:2] == (key, seg) and out[-1][3] == place and out[-1][4] == holder:
                        out[-1] = (*out[-1][:3], place + 1, holder)
                    else:
                        out.append((key, seg, place, place + 1, holder))

        def flush():
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["core", "seg", "a", "z", "holder"])

        for b in batches:
            for core, seg, null, name, doc, low, high, at, text in zip(*(b.column(c).to_pylist() for c in (*_KNOWN, "at", "text")), strict=True):
                if core != key:
                    close()
                    block, key = {}, core
                    if len(out) > 20_000:
                        yield flush()
                words = text.split(b" ")
                block[seg] = ((null, 0 if name is None else name, doc), low, high, words[:at][::-1], words[at:], at)
        close()
        yield flush()

    return run


def runs(held: np.ndarray, foreign: np.ndarray, least: int) -> list[tuple[int, int, bool]]:
    """(first word, end word, kept) of the maximal runs of equal flag.

    ``held``: (first, end) places of shared windows; ``foreign``: those of them that another document keeps, with all
    of their words.
    """
    size = int(held[:, 1].max()) + least if len(held) else 0

    def cover(at):
        steps = np.zeros(size + 1, np.int64)
        np.add.at(steps, at[:, 0], 1)
        np.add.at(steps, at[:, 1] - 1 + least, -1)
        return np.cumsum(steps)[:size] > 0

    flags = np.append(cover(held).astype(np.int8) + cover(foreign), np.int8(0))
    edges = np.flatnonzero(np.diff(flags, prepend=np.int8(0)))
    return [(int(a), int(b), bool(flags[a] == 1)) for a, b in zip(edges[:-1], edges[1:], strict=True) if flags[a]]


def _runs(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cols = [], ([], [], [])
            for row, places in enumerate(b.column(1).to_pylist()):
                at = np.array([(p["a"], p["z"]) for p in places], np.int64)
                foreign = at[~np.array([p["k"] for p in places], bool)]
                for r in runs(at, foreign, least):
                    rows.append(row)
                    for c, x in zip(cols, r, strict=True):
                        c.append(x)
            kinds = (pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["_id", "first_word", "end_word", "kept"])

    return run


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, core: int = CORE) -> DataFrame:
    """Passages of ``least`` or more words that another document holds too: identifier, first_word, end_word, n_words, kept.

    Words are what stands between ASCII white space, compared as bytes.  A word counts when it lies in ``least`` words
    that one other document holds as well.  ``kept`` is false for words of such a window whose first holder (by
    identifier, null last) is another document, and true for the others; a row is a maximal run of words of equal
    ``kept``, so the rows of a chain of passages adjoin and may be shorter than ``least``.  Null texts have no words; rows
    with equal identifier and text are one document, and repeats inside one document don't count; documents without such
    a passage have no row.  Other columns are ignored.
    """
    if not 0 < core < least:
        raise ValueError("a core is shorter than a window")
    text = F.col(text_col).cast("string")
    doc = F.xxhash64(F.to_json(F.struct(F.col(id_col).alias("i"))), text)
    docs = df.select(F.col(id_col).alias("_id"), doc.alias("_doc"), text.cast("binary").alias("_text"))
    kind = df.schema[id_col].dataType.simpleString()
    found = stored(docs.mapInArrow(found_segments(least, core), f"_id {kind}, _doc long, pos int, words int, at int, core long, seg long"))
    cores = found.groupBy("core").agg(F.count(F.lit(1)).alias("n"), (F.min("_doc") != F.max("_doc")).alias("shared"), (F.min("seg") == F.max("seg")).alias("alike"))
    cores = stored(cores.filter("shared").drop("shared"))
    rows = stored(sized_join(found, cores, ["core"]).drop("n"))
    discard(found, cores)
    first = F.struct(F.col("_id").isNull().alias("null"), F.col("_id").alias("name"), F.col("_doc").alias("holder"))
    segs = rows.groupBy("core", "seg").agg(
        F.count(F.lit(1)).alias("n"), F.first("alike").alias("alike"), F.min(first).alias("f"), F.min("_doc").alias("low"), F.max("_doc").alias("high"),
        F.min(F.struct("_doc", "pos", "words", "at")).alias("place"),
    )
    segs = stored(segs.select("core", "seg", "n", "alike", "f.*", "low", "high", "place"))
    window = lambda a, z: [a.alias("a"), z.alias("z"), "holder"]
    # one text around the core in all documents: every window is shared; places count from the segment's first word
    verdicts = segs.filter("alike").select("core", "seg", *window(F.lit(0), F.lit(None).cast("int")))
    mixed = segs.filter("not alike")
    sizes = stored(mixed.groupBy("core").agg(F.count(F.lit(1)).alias("variants")))
    wanted = sized_join(mixed.select(*_KNOWN, "place.*"), sizes, ["core"], "variants")
    wanted = wanted.select("_doc", F.struct(*_KNOWN, "pos", "words", "at", (F.col("variants") > SUFFIXES).alias("hot")).alias("w"))
    lists = wanted.groupBy("_doc").agg(F.collect_list("w").alias("_wanted"))
    texts = docs.select("_doc", "_text").join(lists, "_doc").select("_text", "_wanted")
    texts = stored(texts.mapInArrow(_texts(least), f"core long, seg long, null boolean, name {kind}, holder long, low long, high long, at int, text binary, h1 long, h2 long"))
    cold = texts.filter("text is not null").repartition("core").sortWithinPartitions("core").mapInArrow(_compared(least), "core long, seg long, a int, z int, holder long")
    hot = stored(texts.filter("text is null").drop("text").distinct())  # a document whose row repeats is one document
    held = hot.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.struct("null", "name", "holder"))["holder"].alias("first"), (F.min("low") != F.max("high")).alias("shared")
    )
    hot = sized_join(hot.select("core", "seg", "at", "h1", "h2"), stored(held.filter("shared")), ["h1", "h2"], "rows")
    hot = hot.select("core", "seg", *window(F.col("at"), F.col("at") + 1)[:2], F.col("first").alias("holder"))
    verdicts = stored(verdicts.unionByName(cold).unionByName(hot))
    runs_of = verdicts.groupBy("core", "seg").agg(F.collect_list(F.struct("a", "z", "holder")).alias("v"))  # windows of one segment
    runs_of = stored(runs_of.join(segs.select("core", "seg", "n"), ["core", "seg"]))
    marked = sized_join(rows.select("_id", "_doc", "pos", "words", "core", "seg"), runs_of, ["core", "seg"])
    marked = marked.select("_id", "_doc", "pos", "words", F.explode("v").alias("v"))
    begin, end = F.col("pos") + F.col("v.a"), F.col("pos") + F.coalesce("v.z", F.col("words") - (least - 1))
    marked = marked.select("_id", "_doc", F.struct(begin.alias("a"), end.alias("z"), (F.col("v.holder") == F.col("_doc")).alias("k")).alias("w"))
    passages = marked.groupBy("_doc").agg(F.first("_id").alias("_id"), F.collect_set("w").alias("_windows")).select("_id", "_windows")
    passages = passages.mapInArrow(_runs(least), f"_id {kind}, first_word int, end_word int, kept boolean")
    return passages.select(F.col("_id").alias(id_col), "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), "kept")
