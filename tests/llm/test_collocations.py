"""Collocations against plain counting, and the double array against a dictionary."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from barloom.llm import collocations
from llm_fixtures import none, odd  # noqa: F401


def brute(rows, least, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, low = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, all_ in counts.items():
        found = {g: n for g, n in all_.items() if n >= least and len(g) > 1}
        rows = []
        for g, a in found.items():
            score, _, l, r = min((2000000 * a // (all_[g[:k]] + all_[g[k:]]), k, all_[g[:k]], all_[g[k:]]) for k in range(1, len(g)))
            inside = lambda x: any(x[i : i + len(g)] == g for i in range(len(x) - len(g) + 1))  # noqa: B023, E731
            if not any(len(x) > len(g) and 100 * n >= 80 * a and inside(x) for x, n in found.items()):
                rows.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, n, p.decode(), -a, l, r, totals[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.collocations(df, **options).collect())


def rows_of(rng, n=120):
    words = ["The", "of", "and", "é", "x'y", "\x01c", "ab c", "w\x1fz", "end"]
    out = []
    for i in range(n):
        text = "".join(f"{rng.choice(words)}{rng.choice([' ', ' ', ' ', '  ', chr(9), '. ', ',', chr(10)])}" for _ in range(int(rng.integers(0, 60))))
        out.append((["en", None, "und", ""][i % 4], None if i % 19 == 0 else text + rng.choice(["", "of the same kind. "])))
    return [*out, ("fr", None), ("de", "ein Wort")]


def test_collocations_match_brute_force(spark, monkeypatch):
    rows = rows_of(np.random.default_rng(3))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    want = brute(rows, 6)
    assert got(df, least=6) == want and {len(x[2].split()) for x in want} == {2, 3, 4}
    assert got(df, least=6, top=5) == brute(rows, 6, 5)
    monkeypatch.setattr(collocations, "BLOCK", 7)  # several tries for each length
    monkeypatch.setattr(collocations, "SHARD", 64)
    assert got(df, least=8) == brute(rows, 8)


def test_double_array_holds_what_it_was_given():
    rng = np.random.default_rng(4)
    for n, states, words, digits in ((1, 1, 2, 1), (40_000, 30, 4000, 2), (60_000, 30_000, 250_000, 3), (5000, 1, 60_000, 3)):
        pairs = np.unique(rng.integers(0, states, n) * words + rng.integers(0, words, n))
        trie = collocations.Trie(pairs // words, pairs % words, np.arange(len(pairs)) + 5, digits)
        asked = np.concatenate([pairs, rng.integers(0, states * words, n)])
        at, number = trie.advance(asked // words, asked % words)
        known = {int(p): i + 5 for i, p in enumerate(pairs)}
        assert dict(zip(at.tolist(), number.tolist(), strict=True)) == {i: known[int(p)] for i, p in enumerate(asked) if int(p) in known}


def test_packed_keeps_all_phrases():
    ids = np.array([-1, 3, -1, -1, 4, 5, -1, 6, -1, 7, 8, 9])
    assert collocations.packed(ids).tolist() == [4, 5, -1, 7, 8, 9]


def test_odd_rows(odd, none):
    df = odd.selectExpr("*", "case when doc_id > 3 then null else 'en' end as lang", "'q' as words", "'q' as phrase", "'q' as f")
    assert got(df, least=2) == brute([(r["lang"], r["text"]) for r in df.collect()], 2)
    assert collocations.collocations(none.selectExpr("*", "'en' as lang")).count() == 0


def test_counts_leave_a_task_in_few_rows():
    """A task gives one row for PART phrases, and the sums over tasks are those of plain counting."""
    rng, digits, size = np.random.default_rng(5), 1, 50 * 50
    pairs = np.arange(size)
    trie = collocations.Trie(pairs // 50, pairs % 50, pairs.astype(np.int32), digits)
    block = type("Block", (), {"value": trie})()
    tasks = [rng.integers(0, 50, 30_000).astype(np.int32) for _ in range(3)]
    batch = lambda ids: pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int32()))], ["ids"])
    given = [x for ids in tasks for x in collocations._counted([], block, 2, 0, size)([batch(ids)])]
    assert all(x.num_rows <= -(-size // collocations.PART) for x in given)
    rows = pa.Table.from_batches(given).sort_by("part")
    found = pa.Table.from_batches(list(collocations._summed(36)(rows.to_batches())))
    want = Counter(int(a) * 50 + int(b) for ids in tasks for a, b in zip(ids, ids[1:]))
    assert dict(zip(found["number"].to_pylist(), found["f"].to_pylist(), strict=True)) == {k: n for k, n in want.items() if n >= 36}
