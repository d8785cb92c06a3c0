"""Phrase collocations by level-wise tries.

Frequent words get numbers and texts become arrays of them, cut where no phrase can pass.  Candidates of the next length
are Apriori-safe: a phrase enters only where the phrase without its last word and the one without its first are
frequent, seen at the same position, and where such sightings of all tasks reach the threshold; so the tries hold about as
much as the result of their level, and passes over the corpus don't grow with what is merely possible.  Candidates go to the tasks as double-array tries of at most ``BLOCK`` phrases: a word number is read
digit by digit, and numpy advances the states of all positions of a shard at once, a level at a time.  Accepting states
are counted with bincount; a task sums those of its shards and gives them in rows of ``PART`` phrases, which are added up.

A task holds one trie at a time, so its memory does not grow with the number of phrases.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import attach, discard, numbered, release, stored

LONGEST, LEAST, TOP, COVER = 4, 30, 2000, 80
BLOCK = 400_000  # words or phrases that are broadcast at a time
SHARD = 1 << 20  # words of a shard
PART = 1024  # phrases whose counts leave a task in one row
ROW = 4096  # words that are stored together, so that a batch of rows stays small
SLICE = 2000  # texts that are encoded at a time
DIGIT = 6  # bits of a word number that a level of a trie reads
_WIDE = 16  # children from which a state gets cells of its own
_CUT = b"\xff"  # between pieces; no UTF-8 text holds it
_TABLE = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with ``_CUT`` between its pieces: A-Z lowered, pieces end at .,;:!? and line ends."""
    return (text or "").encode().translate(_TABLE).replace(b"\n", b" " + _CUT + b" ").split()


class Trie:
    """A double array over (state, word number) pairs; both arrays sorted by them, each pair once, ``values`` their numbers."""

    def __init__(self, states: np.ndarray, words: np.ndarray, values: np.ndarray, digits: int):
        self.digits = digits
        self.roots, node = np.unique(states, return_inverse=True)
        parents, labels, begin = [], [], 0
        for d in range(digits):
            arcs, inner = np.unique(node.astype(np.int64) << DIGIT | words >> DIGIT * (digits - 1 - d) & (1 << DIGIT) - 1, return_inverse=True)
            parents.append((begin + (arcs >> DIGIT)).astype(np.int32))
            labels.append((arcs & (1 << DIGIT) - 1).astype(np.int32))
            begin += len(self.roots) if d == 0 else len(parents[d - 1])
            node = inner
        del arcs, inner, node
        parent, label = np.concatenate(parents), np.concatenate(labels)
        places = _placed(parent, label)
        cell = places[parent] + label
        self.size = int(places.max(initial=0)) + (1 << DIGIT)
        state = np.concatenate([self.size + np.arange(len(self.roots), dtype=np.int32), cell])
        self.base = np.zeros(self.size + len(self.roots), np.int32)
        self.base[state[: len(places)]] = places
        self.base[state[len(state) - len(values) :]] = values
        self.check = np.full(self.size, -1, np.int32)
        self.check[cell] = state[parent]

    def advance(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which positions reach an accepting state from their state by their word, and the number of that state."""
        row = np.minimum(np.searchsorted(self.roots, states), len(self.roots) - 1)
        alive = np.flatnonzero(self.roots[row] == states)
        at, words = self.size + row[alive], words[alive]
        for d in range(self.digits):
            to = self.base[at] + (words >> DIGIT * (self.digits - 1 - d) & (1 << DIGIT) - 1)
            ok = self.check[to] == at
            alive, words, at = alive[ok], words[ok], to[ok]
        return alive, self.base[at]


def _placed(parent: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Where the cells of each state begin, so that no two arcs share a cell."""
    children = np.bincount(parent)
    places = np.zeros(len(children), np.int32)
    wide = np.flatnonzero(children > _WIDE)
    places[wide] = np.arange(len(wide)) << DIGIT
    low = len(wide) << DIGIT
    rest = children[parent] <= _WIDE
    parent, label = parent[rest], label[rest]
    order = np.argsort(-children[parent], kind="stable")  # the larger ones while there is room
    parent, label = parent[order], label[order]
    span = 3 * len(parent) + (1 << DIGIT)
    owner, rnd = np.full(span + (1 << DIGIT), -1, np.int32), np.random.default_rng(1)
    mark = np.zeros(len(owner), np.int32)
    for size in range(_WIDE, 0, -1):
        mine = children[parent] == size
        p, x = parent[mine], label[mine]
        while len(p):
            states, row = np.unique(p, return_inverse=True)
            tried = rnd.integers(0, span, len(states), np.int32)
            cell = tried[row] + x
            free = owner[cell] < 0
            mark[cell] = np.arange(len(cell), dtype=np.int32)  # the last to ask for a cell may have it
            won = mark[cell] == np.arange(len(cell), dtype=np.int32)
            lost = np.zeros(len(states), bool)
            lost[row[~(free & won)]] = True
            done = ~lost[row]
            owner[cell[done]] = p[done]
            places[states[~lost]] = low + tried[~lost]
            p, x = p[~done], x[~done]
    return places


def _hashes(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes as rows of two words."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)


class Numbers:
    """Numbers of a block of words, found by their 128-bit hash."""

    def __init__(self, keys: list[bytes], numbers: np.ndarray):
        both = _hashes(keys)
        order = np.argsort(both[:, 0])
        self.high, self.low, self.numbers = both[order, 0], both[order, 1], numbers[order]

    def of(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.high, high), len(self.high) - 1)
        return np.where((self.high[at] == high) & (self.low[at] == low), self.numbers[at], -1)


def _each(blocks: list[Broadcast]) -> Iterator:
    """The broadcast blocks one after another; with several, only the present one stays in memory."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            vars(b).pop("_value", None)


def _key(lang: str, word: bytes) -> bytes:
    return lang.encode() + b"\0" + word


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n); the empty word stands for all words."""
    release()
    found: dict[str, Counter] = defaultdict(Counter)

    def flush():
        for lang, c in found.items():
            c.pop(_CUT, None)
            c[b""] = sum(c.values())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])
        found.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            found[lang].update(words_of(text.as_py()))
        if sum(map(len, found.values())) > 400_000:
            yield from flush()
    yield from flush()


def packed(ids: np.ndarray) -> np.ndarray:
    """Numbers without those that have no neighbour, and one -1 where others stood between."""
    live = np.concatenate([[False], ids >= 0, [False]])
    keep = live[1:-1] & (live[:-2] | live[2:])
    cut = ~live[1:-1] & np.concatenate([[False], keep[:-1]])
    return ids[keep | cut]


def _encoded(blocks: list[Broadcast]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in (x.slice(lo, SLICE) for x in batches for lo in range(0, x.num_rows, SLICE)):
            by_lang: dict[str, dict[bytes, int]] = {}
            keys: list[bytes] = []
            parts: list[np.ndarray] = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                known = by_lang.setdefault(lang, {})
                words = words_of(text.as_py())
                for w in filterfalse(known.__contains__, set(words)):
                    known[w] = len(keys)
                    keys.append(_key(lang, w) if w != _CUT else w)
                parts += np.fromiter(map(known.__getitem__, words), np.int32, len(words)), np.full(1, -1, np.int32)
            both = _hashes(keys)
            numbers = np.full(len(keys) + 1, -1, np.int32)  # the last one for -1
            for block in _each(blocks):
                numbers[:-1] = np.maximum(numbers[:-1], block.of(both[:, 0], both[:, 1]))
            ids = packed(numbers[np.concatenate([np.full(1, -1, np.int32), *parts])]).astype(np.int32)
            ends = np.flatnonzero(ids < 0) + 1
            cuts = np.unique(ends[np.searchsorted(ends, np.arange(ROW, len(ids), ROW), "left").clip(max=len(ends) - 1)]) if len(ends) else []
            rows = np.split(ids, cuts)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(ids))], ["ids"])

    return run


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Numbers of a task's rows end to end with -1 between, about ``SHARD`` at a time."""
    held, n = [], 0
    for b in batches:
        for row in b.column(0):
            held += [row.values.to_numpy(), np.full(1, -1, np.int32)]
            n += len(held[-2])
            if n >= SHARD:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def _walked(ids: np.ndarray, tries: list[list[Broadcast]]) -> np.ndarray:
    """For each position the number of the frequent phrase that begins there, of the length the tries reach, or -1."""
    states = ids
    for n, blocks in enumerate(tries, 1):
        found = np.full(len(ids), -1, np.int32)
        live = np.flatnonzero((states[: len(ids) - n] >= 0) & (ids[n:] >= 0))
        for trie in _each(blocks):
            at, number = trie.advance(states[live], ids[live + n])
            found[live[at]] = number
        states = found
    return states


def _extensions(tries: list[list[Broadcast]], k: int):
    """(state << 32 | word, n): positions where a phrase of k words can be frequent, by that phrase."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for ids in _shards(batches):
            states = _walked(ids, tries)
            at = np.flatnonzero((states[: len(ids) - k + 1] >= 0) & (states[1 : len(ids) - k + 2] >= 0)) if len(ids) >= k else np.zeros(0, np.int64)
            keys, n = np.unique(states[at].astype(np.int64) << 32 | ids[at + k - 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

    return run


def _counted(tries: list[list[Broadcast]], block: Broadcast, k: int, first: int, size: int):
    """(part, counts): occurrences of the candidates of one block, ``PART`` consecutive ones in a row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(size, np.int64)
        for ids in _shards(batches):
            states = _walked(ids, tries)
            live = np.flatnonzero((states[: len(ids) - k + 1] >= 0) & (ids[k - 1 :] >= 0)) if len(ids) >= k else np.zeros(0, np.int64)
            _, number = block.value.advance(states[live], ids[live + k - 1])
            total += np.bincount(number - first, minlength=size)
        rows = [(i, total[i : i + PART]) for i in range(0, size, PART) if total[i : i + PART].any()]
        counts = pa.array([x for _, x in rows], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([first + i for i, _ in rows], pa.int64()), counts], ["part", "counts"])

    return run


def _summed(least: int):
    """Pass over rows sorted by part: (number, f) of the candidates with f >= ``least``, their counts in all tasks summed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, part = np.zeros(0, np.int64), -1

        def out():
            at = np.flatnonzero(held >= least)
            return pa.RecordBatch.from_arrays([pa.array(at + part), pa.array(held[at])], ["number", "f"])

        for b in batches:
            for p, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if p != part:
                    if part >= 0:
                        yield out()
                    held, part = np.zeros(len(counts), np.int64), p
                held = held + counts.values.to_numpy()
        if part >= 0:
            yield out()

    return run


def _blocks(rows: DataFrame, number: str, columns: list[str], make) -> Iterator[tuple[int, int, Broadcast]]:
    """(first number, rows, broadcast) of at most ``BLOCK`` consecutive rows each; one at a time is on the driver."""
    total = rows.count()
    for first in range(0, total, BLOCK):
        part = rows.filter((F.col(number) >= first) & (F.col(number) < first + BLOCK)).select(*columns, number).toArrow()
        part = part.sort_by(number)
        size, made = part.num_rows, make(part)
        del part
        release()
        yield first, size, rows.sparkSession.sparkContext.broadcast(made)
        del made


def frequent_phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, words (array of numbers), phrase, f of all phrases of up to ``longest`` words with f >= ``least``,
    and the number of words by language.  See ``collocations`` for what a word is."""
    name = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang")
    docs = df.select(name, F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = docs.mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    counts = stored(counts.filter((F.col("f") >= least) | (F.length("word") == 0)))
    totals = counts.filter(F.length("word") == 0).select("lang", F.col("f").alias("n"))
    words = stored(numbered(counts.filter(F.length("word") > 0), ["lang", "word"], "number"))
    made = lambda t: Numbers([_key(a, w) for a, w in zip(t["lang"].to_pylist(), t["word"].to_pylist(), strict=True)], t["number"].to_numpy())
    numbers = [b for _, _, b in _blocks(words, "number", ["lang", "word"], made)]
    size = words.count()
    phrases = words.select("lang", "number", F.array(F.col("number")).alias("words"), F.col("word").cast("string").alias("phrase"), "f")
    out, tries = [phrases], []
    encoded = stored(docs.mapInArrow(_encoded(numbers), "ids array<int>"))
    digits = max(1, -(-max(1, size - 1).bit_length() // DIGIT))
    trie = lambda t: Trie(t["state"].to_numpy(), t["word"].to_numpy(), t["number"].to_numpy(), digits)
    for k in range(2, longest + 1):
        found = encoded.mapInArrow(_extensions(tries, k), "key long, n long")
        found = found.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        found = found.select(F.shiftright("key", 32).alias("state"), F.col("key").bitwiseAND((1 << 32) - 1).alias("word"))
        candidates = stored(numbered(stored(found), ["state", "word"], "number"))
        seen = []
        for first, n, block in _blocks(candidates, "number", ["state", "word"], trie):
            rows = encoded.mapInArrow(_counted(tries, block, k, first, n), "part long, counts array<bigint>")
            rows = rows.repartition("part").sortWithinPartitions("part")
            seen.append(stored(rows.mapInArrow(_summed(least), "number long, f long")))
            block.destroy()
        if not seen:
            break
        counted = seen[0]
        for x in seen[1:]:
            counted = counted.unionByName(x)
        kept = stored(numbered(candidates.join(counted, "number").drop("number"), ["state", "word"], "number"))
        discard(candidates)
        tries.append([b for _, _, b in _blocks(kept, "number", ["state", "word"], trie)])
        if not tries[-1]:
            break
        before = phrases.select(F.col("number").alias("state"), "lang", "words", "phrase")
        last = words.select(F.col("number").alias("word"), F.col("word").cast("string").alias("_last"))
        joined = attach(attach(kept, before, ["state"], "inner"), last, ["word"], "inner")
        phrases = stored(joined.select(
            "lang", "number", F.concat("words", F.array("word")).alias("words"), F.concat_ws(" ", "phrase", "_last").alias("phrase"), "f",
        ))
        out.append(phrases)
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    rows = stored(rows.drop("number"))
    for blocks in [numbers, *tries]:
        for b in blocks:
            b.destroy()
    discard(encoded)
    return rows, totals


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts have A-Z lowered and are split at .,;:!? and line ends into pieces, those at spaces and tabs into words.  A
    candidate is a phrase of 2 to 4 words with a = its contiguous occurrences (overlaps too) >= ``least``.  A cut gives
    l and r, the occurrences of both parts, and floor(2000000 a / (l + r)); the lowest such score counts, among equals
    that of the first cut.  A candidate inside a longer one that has ``cover`` percent of its occurrences is left out.
    Order: score and a descending, then the phrase in byte order.  n: all words of the language.

    Null texts are empty, the null language is ``und``.  Repeated rows count as often as they stand there.  Languages without
    a candidate have no row.  Other columns are ignored.
    """
    phrases, totals = frequent_phrases(df, text_col, lang_col, least)
    candidates = phrases.filter(F.size("words") > 1)
    parts = phrases.select("words", "f")
    cuts = candidates.select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("words", F.lit(1), F.col("k"))).withColumn("right", F.expr("slice(words, k + 1, size(words) - k)"))
    cuts = attach(cuts, parts.select(F.col("words").alias("left"), F.col("f").alias("l")), ["left"], "inner")
    cuts = attach(cuts, parts.select(F.col("words").alias("right"), F.col("f").alias("r")), ["right"], "inner")
    score = F.expr("cast(2000000 * cast(a as decimal(20,0)) as decimal(38,0)) div cast(l + r as decimal(20,0))")
    scored = cuts.select("lang", "words", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    scored = scored.groupBy("words").agg(F.first("lang").alias("lang"), F.first("phrase").alias("phrase"), F.first("a").alias("a"), F.min("cut").alias("cut"))
    inside = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))")
    longer = candidates.filter(F.size("words") > 2).select("f", F.explode(F.array_distinct(inside)).alias("words"))
    longer = longer.groupBy("words").agg(F.max("f").alias("most"))
    left = scored.join(longer, "words", "left").filter(f"most is null or cast(most as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {cover}")
    rows = attach(left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), stored(totals), ["lang"], "inner")
    w = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
