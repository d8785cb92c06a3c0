"""Token counts by finite-state transducers.

A byte-level BPE vocabulary is compiled, as far as the texts need it, into a deterministic transducer over the
bytes of a pre-token.  The emission of a transition is the change in the number of tokens of what has been
read.  It rests on two facts about BPE by merge order: the encoding of a prefix ends in exactly one token t
whose predecessor is the last token of the encoding of the prefix without t, and two tokens may stand next to
each other exactly if merging their joined bytes gives the two again.  A state is therefore the node of the
token trie that the read bytes end in, with, for each suffix that may still grow into a token, the last token
before it and the number of tokens since then.

A segment of text (see ``common.SEGMENT``) begins and ends in the start state, so its state map is one number,
and maps of consecutive segments compose by addition: a prefix scan over all segments of a batch, read off at
the ends of the documents.  In a very long pre-token the map of each chunk is kept for the entry states it was
met with, and chunk maps compose in order.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import SegmentTable, by_size, pre_tokens, resident, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
CHUNK = 1024  # bytes of a long pre-token whose state map is kept
STATES = 400_000  # compiled states before compilation starts anew

# Fixed value: the pattern that byte-level tokenizer files stand for when they name no other.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files: itself if printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """States and transitions, made when first needed."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.rank = {i: -1 for i in vocab.values()}  # merge order; single bytes have none
        self.parts = {}
        self.joined = {}
        for n, (a, b) in enumerate(merges):
            t = vocab[a + b]
            if self.rank[t] < 0:
                self.rank[t], self.parts[t] = n, (vocab[a], vocab[b])
                self.joined[vocab[a] << 20 | vocab[b]] = n
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.token, self.depth = [-1], [0]
        for b, i in vocab.items():
            if len(b) > 1 and self.rank[i] < 0:
                continue  # no merge makes it
            node = 0
            for x in b:
                key = node << 8 | x
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[key >> 8] + 1)
            self.token[node] = i
        self._link()
        self.fits: dict[int, bool] = {}
        self._restart()

    def _link(self) -> None:
        """The longest proper suffix of each node that is a node too."""
        self.suffix = [0] * len(self.token)
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.child.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        queue = deque([0])
        while queue:
            up = queue.popleft()
            for x, node in below.get(up, ()):
                if up:
                    self.suffix[node] = self._step(self.suffix[up], x)
                queue.append(node)

    def _step(self, node: int, x: int) -> int:
        child, suffix = self.child, self.suffix
        while (to := child.get(node << 8 | x)) is None and node:
            node = suffix[node]
        return to or 0

    def _restart(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: dict[int, int] = {}  # state << 8 | byte -> state << 12 | emission + 2048
        self.chunks: dict[tuple[int, bytes], tuple[int, int]] = {}
        self._state((0, ((0, -1, 0),)))

    def _state(self, state: tuple) -> int:
        n = self.number.get(state)
        if n is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
        return n

    def adjacent(self, a: int, b: int) -> bool:
        """May token b follow token a: no merge across the boundary comes before those that make a and b.

        The tokens at the boundary are taken apart, always the one made last, and at each stage the merge across
        the boundary must come later than the one just undone.
        """
        key = a << 20 | b
        known = self.fits.get(key)
        if known is not None:
            return known
        rank, parts, across = self.rank, self.parts, self.joined.get
        limit, good = 1 << 40, True  # a merge across that is older than the limit takes place
        while True:
            r = across(a << 20 | b)
            if r is not None and r < limit:
                good = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            # of equal age the left one was merged first, so the right one is undone first
            if ra > rb:
                a, limit = parts[a][1], ra
            else:
                b, limit = parts[b][0], rb + 1
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[key] = good
        return good

    def _make(self, state: int, x: int) -> int:
        node, live = self.states[state]
        before = {m: (last, count) for m, last, count in live}
        to = self._step(node, x)
        at, chain = to, []
        while at:
            chain.append(at)
            at = self.suffix[at]
        last = emitted = None
        for at in chain:
            t = self.token[at]
            if t >= 0:
                prior, count = before[self.depth[at] - 1]
                if prior < 0 or self.adjacent(prior, t):
                    last, emitted = t, count + 1
                    break
        grown = [(self.depth[at], *before[self.depth[at] - 1]) for at in chain]
        grown = [(m, prior, count - emitted) for m, prior, count in grown]
        new = self._state((to, ((0, last, 0), *grown)))
        out = self.next[state << 8 | x] = new << 12 | emitted + 2048
        return out

    def run(self, state: int, data: bytes) -> tuple[int, int]:
        """The state map of ``data`` at one entry state: exit state and tokens emitted."""
        known, make, total = self.next.get, self._make, 0
        for x in data:
            out = known(state << 8 | x)
            if out is None:
                out = make(state, x)
            state = out >> 12
            total += out & 4095
        return state, total - 2048 * len(data)

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token."""
        if len(self.states) > STATES:
            self._restart()
        if len(word) <= CHUNK:
            return self.run(0, word)[1]
        state = total = 0
        for i in range(0, len(word), CHUNK):
            key = (state, word[i : i + CHUNK])
            found = self.chunks.get(key)
            if found is None:
                if len(self.chunks) > 10_000:
                    self.chunks.clear()
                found = self.chunks[key] = self.run(*key)
            state = found[0]
            total += found[1]
            if len(self.states) > 4 * STATES:  # one endless pre-token: keep only the state it is in
                now = self.states[state]
                self._restart()
                state = self._state(now)
        return total


class Counter:
    """Token counts of whole texts for a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model["type"] != "BPE":
            raise ValueError("a byte-level BPE tokenizer file without normaliser is asked for")
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {raw(k): v for k, v in model["vocab"].items() if all(c in letters for c in k)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.transducer = Transducer(vocab, [(raw(a), raw(b)) for a, b in pairs])
        special = [t["content"] for t in spec.get("added_tokens", ())]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(BYTE_LEVEL)
        self.segments = SegmentTable(self.learn, limit=250_000)

    def learn(self, segments: list[str]) -> list[int]:
        count = self.transducer.count
        return [sum(count(p.encode("utf-8", "replace")) for p in pre_tokens(s, self.split)) for s in segments]

    def count_batch(self, texts: list[str]) -> list[int]:
        """Special strings inside a text are one token each, as the tokenizer's file has them."""
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            cut = self.special.split(t) if self.special else [t]
            extra[i] = len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        found = self.segments.numbers(parts)
        values = np.array(self.segments.values_of, np.int64)
        scan = np.concatenate([[0], np.cumsum(values[np.concatenate([np.zeros(0, np.int32), *found])])])
        ends = np.cumsum([len(x) for x in found]) if found else np.zeros(0, np.int64)
        totals = np.diff(scan[np.concatenate([[0], ends])])
        return (extra + np.bincount(owner, totals, len(texts)).astype(np.int64)).tolist()


def loaded(path: str) -> Counter:
    """The compiled tokenizer of ``path``, one for each worker."""
    return resident(("counter", path), lambda: Counter(path))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 1024) -> DataFrame:
    """One row per input row: identifier, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``path`` is a tokenizer file present on every executor.  No begin, end or added special tokens, nothing cut
    or padded.  Null texts count as empty.  Repeated rows and null identifiers give a row each; other columns
    are ignored.
    """
    path = path or tokenizer_path(VOCABULARY)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for b in batches:
            counts: list[int] = []
            for texts in by_size([t or "" for t in b.column(2).to_pylist()]):
                counts += counter.count_batch(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    out = rows.mapInArrow(run, f"_id {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
