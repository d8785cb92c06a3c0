"""Toxicity scores.

A lexicon of terms (whole words, and stems that words begin with) is held in a trie.  Its intersection with
the Levenshtein automaton is determinised as texts need it: a state is the set of (trie node, edits spent) that
the letters read so far can stand for, and its transitions are kept, so a word costs one look-up per letter and
most words fall into the dead state after a few.  Misspelled words are caught this way; stems match exactly.

Each hit is weighed by its term's log-odds and judged by the words around it: inside quotation marks or beside a
reporting verb it counts as quoted, beside a second-person word as abuse.  A logistic regression over the sums
gives the score.

Lexicon, weights and regression are learned from at most ``TRAIN`` labelled documents outside the held-out
fifth, those with the smallest digests of their identifiers.  Labels, language, source and identifier are no
inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import SegmentTable, by_size, free_name, release, resident

TRAIN = 4000  # labelled documents that the model is fitted on
TERMS = 400  # learned terms
RATIO, SUPPORT = 8.0, 0.01  # a learned term is so much more frequent in toxic documents, and in this share of them
WINDOW, REACH = 8, 120  # words and letters on either side of a hit that are read with it

# Words of abuse that need no evidence, reporting verbs, second-person words, quotation marks.
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "pathetic", "scum", "trash", "worthless", "disgusting", "clown")
REPORTING = frozenset("said says wrote writes quoted quote called claimed dit écrit cite sagte schrieb zitiert dijo escribió citó".split())
ADDRESS = frozenset("you your you're yourself u ur tu toi vous votre du dich dein ihr euch tú te vosotros usted ustedes".split())
OPENING, CLOSING = "\"“«„‹", "\"”»“›"

WORD = re.compile(r"\w+")


def words_of(text: str, window: int = 4 << 20) -> Iterator[list[str]]:
    """Lower-case words, a window of the text at a time."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + window)
        while end < n and (text[end].isalnum() or text[end] == "_") and end - at < 2 * window:
            end += 1  # not inside a word
        yield WORD.findall(text[at:end].lower())
        at = end


def edits_for(term: str) -> int:
    """Edits that a whole-word term bears: short words would turn into other words."""
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class Automaton:
    """Lexicon trie and Levenshtein automaton, intersected and determinised on demand."""

    def __init__(self, words: list[str], stems: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.word, self.stem, self.bound = [-1], [-1], [0]
        self.names = [*words, *stems]
        for n, term in enumerate(self.names):
            node, exact = 0, n >= len(words)
            for c in term:
                if not exact:
                    self.bound[node] = max(self.bound[node], edits_for(term))
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                    self.bound.append(0)
                node = self.child[node][c]
            if exact:
                self.stem[node] = n
            else:
                self.word[node] = n
                self.bound[node] = max(self.bound[node], edits_for(term))
        self.restart()

    def restart(self) -> None:
        self.number: dict[frozenset, int] = {frozenset(): 0}
        self.states: list[dict[int, int]] = [{}]
        self.begun = [-1]  # the stem that words in this state begin with
        self.next: dict[int, int] = {}  # state << 21 | letter -> state
        self.first = self._state(self._closed({0: 0}))

    def _state(self, live: dict[int, int]) -> int:
        key = frozenset(live.items())
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append(live)
            self.begun.append(max((self.stem[x] for x, spent in live.items() if not spent), default=-1))
        return n

    def _closed(self, live: dict[int, int]) -> dict[int, int]:
        """With letters of a term left out."""
        queue = list(live.items())
        while queue:
            node, spent = queue.pop()
            for to in self.child[node].values():
                if spent < self.bound[to] and live.get(to, 9) > spent + 1:
                    live[to] = spent + 1
                    queue.append((to, spent + 1))
        return live

    def _make(self, state: int, c: str) -> int:
        live: dict[int, int] = {}

        def reach(node, spent):
            if live.get(node, 9) > spent:
                live[node] = spent

        for node, spent in self.states[state].items():
            for x, to in self.child[node].items():
                if x == c:
                    reach(to, spent)
                elif spent < self.bound[to]:
                    reach(to, spent + 1)
            if spent < self.bound[node]:
                reach(node, spent + 1)
        out = self.next[state << 21 | ord(c)] = self._state(self._closed(live))
        return out

    def match(self, word: str) -> tuple[int, int]:
        """(term, edits) of the best term that the word is, or begins with; (-1, 0): none."""
        if len(self.states) > 200_000:
            self.restart()
        state, stem, known, begun = self.first, -1, self.next.get, self.begun
        for c in word:
            to = known(state << 21 | ord(c))
            state = self._make(state, c) if to is None else to
            if not state:
                return stem, 0
            if begun[state] >= 0:
                stem = begun[state]
        found = []
        for node, spent in self.states[state].items():
            n = self.word[node]
            if n >= 0 and spent <= edits_for(self.names[n]):
                found.append((spent, n))
        if found and (stem < 0 or min(found)[0] == 0):
            return min(found)[1], min(found)[0]
        return (stem, 0) if stem >= 0 else (-1, 0)


@dataclass
class Model:
    words: list[str] = field(default_factory=lambda: list(SEED_TERMS))
    stems: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [4.0] * len(SEED_TERMS))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(6))
    scale: np.ndarray = field(default_factory=lambda: np.ones(6))
    # bias and coefficients of ``features``; these stand in where there are no labels of both kinds
    beta: np.ndarray = field(default_factory=lambda: np.array([-4.0, 1.0, 0.5, 0.5, -0.5, 0.5, 0.0]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.beta[0] + ((x - self.centre) / self.scale) @ self.beta[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Reader:
    """Features of texts under one lexicon."""

    def __init__(self, model: Model):
        self.automaton, self.weights = Automaton(model.words, model.stems), model.weights
        self.table = SegmentTable(lambda words: [self.automaton.match(w) for w in words], limit=100_000, cut=words_of, named=str)

    def context(self, text: str, hits: dict[str, float]) -> tuple[float, float]:
        """Weights of the hits that are quoted, and of those that address someone."""
        quoted = abuse = 0.0
        low = text.lower()
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(hits)))})(?!\w)", low):
            left, right = low[max(0, m.start() - REACH) : m.start()], low[m.end() : m.end() + REACH]
            near = {*WORD.findall(left)[-WINDOW:], *WORD.findall(right)[:WINDOW]}
            inside = any(c in left for c in OPENING) and any(c in right for c in CLOSING)
            if inside or not REPORTING.isdisjoint(near):
                quoted += hits[m[0]]
            elif not ADDRESS.isdisjoint(near):
                abuse += hits[m[0]]
        return quoted, abuse

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: log of weighted hits, weighted hits per 100 words, misspelled part, quoted, abuse, log of words."""
        found = self.table.numbers(texts)
        terms = np.array(self.table.values_of, np.int64).reshape(-1, 2)
        values = np.where(terms[:, 0] >= 0, np.array([*self.weights, 0.0])[terms[:, 0]] / (1 + terms[:, 1]), 0)
        bent = np.where(terms[:, 1] > 0, values, 0)
        names, hot = list(self.table), values > 0
        out = np.zeros((len(texts), 6))
        for i, x in enumerate(found):
            if not len(x):
                continue
            total = values[x].sum()
            out[i, 5] = math.log1p(len(x))
            if total > 0:
                quoted, abuse = self.context(texts[i], {names[n]: float(values[n]) for n in np.unique(x[hot[x]])})
                out[i, :5] = math.log1p(total), 100 * total / (len(x) + 20), math.log1p(bent[x].sum()), math.log1p(quoted), math.log1p(abuse)
        return out


def _reader(model: Model) -> Reader:
    return resident(("reader", repr((model.words, model.stems, model.weights))), lambda: Reader(model))


def remainder(ident: Column) -> Column:
    """crc32 of the identifier as text, modulo 5; 0: held out.  Null identifiers count as the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 5


def _prefix_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, whole, toxic, documents, occurrences) of words and their beginnings, at most 3 occurrences a document."""
    release()
    found: dict[tuple[str, bool, int], list[int]] = {}

    def out():
        keys, values = list(found), list(found.values())
        cols = [[k[i] for k in keys] for i in range(3)] + [[v[i] for v in values] for i in range(2)]
        kinds = (pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["term", "whole", "toxic", "docs", "n"])

    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            terms: Counter = Counter()
            for part in words_of(text or ""):
                for w, n in Counter(part).items():
                    terms[w, True] += n
                    for k in range(3, min(len(w), 8) + 1):
                        terms[w[:k], False] += n
            for (t, whole), n in terms.items():
                v = found.setdefault((t, whole, toxic), [0, 0])
                v[0] += 1
                v[1] += min(n, 3)
            if len(found) > 100_000:
                yield out()
                found.clear()
    if found:
        yield out()


def _lexicon(sample: DataFrame) -> Model:
    counts = sample.mapInArrow(_prefix_counts, "term string, whole boolean, toxic int, docs long, n long")
    bad = F.col("toxic") == 1
    counts = counts.groupBy("term", "whole").agg(
        F.sum(F.when(bad, F.col("docs"))).alias("docs"), F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~bad, F.col("n")).otherwise(0)).alias("b")
    )
    words = F.size(F.regexp_extract_all(F.lower(F.coalesce("_text", F.lit(""))), F.lit(r"(\w+)"), 1))
    sizes = {r["_toxic"]: (r["d"], r["w"]) for r in sample.groupBy("_toxic").agg(F.count(F.lit(1)).alias("d"), F.sum(words).alias("w")).collect()}
    (n_bad, w_bad), (_, w_good) = sizes[1], sizes[0]
    rate = F.col("a") / F.lit(float(max(w_bad, 1))) / ((F.col("b") + 0.5) / F.lit(float(max(w_good, 1))))
    counts = counts.filter(F.col("docs") >= max(4.0, SUPPORT * n_bad)).withColumn("rate", rate).filter(F.col("rate") >= RATIO)
    # bounded by TERMS
    best = counts.orderBy((F.col("a") * F.log("rate")).desc(), F.length("term").desc(), F.col("whole").desc(), "term").limit(4 * TERMS).collect()
    words, stems, weights = list(SEED_TERMS), [], dict.fromkeys(SEED_TERMS, 4.0)
    wholes = {r["term"]: r for r in best if r["whole"]}
    for r in best:
        t = r["term"]
        if len(weights) >= TERMS or (t in weights and t not in SEED_TERMS):
            continue
        weight = min(math.log(r["rate"]), 8.0)
        if r["whole"]:
            if t in SEED_TERMS:
                weights[t] = weight
            elif not any(t.startswith(s) for s in stems):
                words.append(t)
                weights[t] = weight
            continue
        # a beginning that is mostly one word, or part of what is taken already, is no stem of its own
        whole = next((w for w in wholes.values() if w["term"].startswith(t) and w["a"] > 0.7 * r["a"]), None)
        if whole or any(t.startswith(s) or s.startswith(t) for s in stems) or any(w.startswith(t) for w in words):
            continue
        stems.append(t)
        weights[t] = weight
    words = [w for w in words if w in SEED_TERMS or not any(w.startswith(s) for s in stems)]
    return Model(words, stems, [weights[t] for t in (*words, *stems)])


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: int = TRAIN) -> Model:
    """A model from at most ``train`` labelled documents that are not held out.

    Rows of ``labels`` with null in identifier or ``toxic`` are passed over.  Without documents of both kinds
    the seed terms and set coefficients are used.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & (remainder(F.col(id_col)) != 0))
    known = known.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    known = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic")).orderBy(F.xxhash64("_id"), "_id").limit(train)
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    sample = texts.join(F.broadcast(known), "_id").select("_text", "_toxic").persist()  # at most ``train`` labelled documents
    try:
        if {r["_toxic"] for r in sample.select("_toxic").distinct().collect()} != {0, 1}:
            return Model()
        model = _lexicon(sample)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _reader(model).features([t or "" for t in b.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), b.column(1)], ["x", "y"])

        rows = sample.mapInArrow(run, "x array<double>, y int").collect()
    finally:
        sample.unpersist()
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
    model.centre, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([np.ones(len(x)), (x - model.centre) / model.scale])
    beta, ridge = np.zeros(z.shape[1]), np.diag([1e-6, *[1e-2 * math.sqrt(len(x))] * 6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    model.beta = beta
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: identifier, held_out, score (0 to 1), predicted.

    Null and empty texts get the score of a text without hits.  Repeated rows and null identifiers give a row
    each; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(model)
        for b in batches:
            lo = 0
            for texts in by_size([t or "" for t in b.column(2).to_pylist()]):
                part = b.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(model.scores(reader.features(texts)))], ["_id", "held_out", "score"])
                lo += len(texts)

    rows = df.select(F.col(id_col).alias("_id"), (remainder(F.col(id_col)) == 0).alias("held_out"), F.col(text_col).cast("string").alias("_text"))
    out = rows.mapInArrow(run, f"_id {df.schema[id_col].dataType.simpleString()}, held_out boolean, score double")
    return out.select(F.col("_id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The rows whose score is under ``most``, with all their columns, whatever their names.

    A null text scores as the empty one; repeated rows stay or go together; identifiers play no part.
    """
    name = free_name(df.columns, "_text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(model)
        for b in batches:
            lo = 0
            for texts in by_size([t or "" for t in b.column(b.num_columns - 1).to_pylist()]):
                part = b.slice(lo, len(texts))
                yield part.filter(pa.array(model.scores(reader.features(texts)) < most)).select(list(range(b.num_columns - 1)))
                lo += len(texts)

    schema = T.StructType(list(df.schema))
    return df.withColumn(name, F.col(text_col).cast("string")).mapInArrow(run, schema)
