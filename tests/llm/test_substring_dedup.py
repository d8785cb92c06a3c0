"""Repeated windows of words against brute force."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from barloom.llm import substring_dedup
from llm_fixtures import docs, none, odd, texts  # noqa: F401


def brute(rows, least=35):
    """For each row (identifier, text): (identifier, words, words removed, text left)."""
    where = defaultdict(list)
    words = [(t or "").encode().split() for _, t in rows]
    for r, w in enumerate(words):
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].append((r, k))
    gone = defaultdict(set)
    for places in where.values():
        for r, k in places if len(places) > 1 else ():
            gone[r].update(range(k, k + least))
    return sorted(
        (repr(i), len(w), len(gone[r]), None if t is None else b" ".join(x for n, x in enumerate(w) if n not in gone[r]).decode())
        for r, ((i, t), w) in enumerate(zip(rows, words, strict=True))
    )


def got(df, **options):
    return sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.drop_repeats(df, **options).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_repeats_match_brute_force(docs, texts):
    want = brute(list(texts.items()))
    assert sorted((i, a, b, t or "") for i, a, b, t in got(docs)) == want and any(x[2] for x in want)


def test_edges_chains_and_periods(spark, monkeypatch):
    """Copies that begin and end anywhere, edited copies, a passage in most rows, periodic text, repeats in one row."""
    rng = np.random.default_rng(5)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 30, n)]
    rows, base = [], [new(400) for _ in range(6)]
    for i in range(120):
        b = base[i % 6]
        lo = int(rng.integers(0, 330))
        part = b[lo : lo + int(rng.integers(20, 120))]
        if i % 5 == 0:
            part = [x if rng.random() > 0.03 else "edited" for x in part]
        rows.append((i, " ".join(new(int(rng.integers(0, 40))) + part + new(int(rng.integers(0, 40))))))
    common = new(60)
    rows += [(1000 + i, " ".join([f"o{i}x{k}" for k in range(50)] + common + [f"o{i}y{k}" for k in range(50)])) for i in range(200)]
    twice = new(35)
    rows += [(2000, "in " * 200), (2001, "in " * 34 + "end"), (2002, "at to " * 60), (2003, " ".join([*twice, "and", *twice])), (2004, " ".join(new(34)))]
    want = brute(rows)
    df = frame(spark, rows).repartition(7)
    assert got(df) == want
    monkeypatch.setattr(substring_dedup, "SEGMENTS", 4)  # most anchors are cut into windows
    assert got(df) == want
    monkeypatch.setattr(substring_dedup, "PIECE", 50)  # texts are hashed in pieces
    assert got(df) == want


def test_parse_looks_up_windows_at_factor_boundaries():
    a, b, c = ([f"{x}{i}".encode() for i in range(40)] for x in "abc")
    block = [(True, a + b + c), (False, a + b[:5]), (False, a[20:] + b[:20]), (False, b[10:] + c)]
    found = list(substring_dedup.factors(block))
    covered = {x for i, s, e in found for x in range(s, e)}
    assert {i for i, _, _ in found} == {0} and covered == set(range(120)) and found[0] == (0, 0, 45)


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd) == brute(rows)
    out = substring_dedup.drop_repeats(odd)
    assert out.columns == [*odd.columns, "n_words", "n_removed"] and substring_dedup.drop_repeats(none).count() == 0
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(None, passage), (None, passage), (1, f"x {passage}"), (1, f"x {passage}"), (2, None)]
    named = frame(spark, rows).selectExpr("doc_id", "text", "1 as n_words", "'q' as _spans", "'q' as _doc", "'q' as `a.b`")
    assert got(named) == brute(rows) and set(named.columns) < set(substring_dedup.drop_repeats(named).columns)
