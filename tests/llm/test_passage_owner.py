"""Passages that adjoin others: what is kept of them, and windows that no single document shares."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from barloom.llm import suffix_dedup


def flags(texts, least=50):
    """(document, word) -> kept, from all windows of ``least`` words."""
    where = defaultdict(list)
    words = {i: t.split() for i, t in texts.items()}
    for i, w in sorted(words.items()):
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].append((i, k))
    out = {}
    for places in where.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                for x in range(k, k + least):
                    out[i, x] = out.get((i, x), True) and i == places[0][0]
    return out


def test_each_passage_is_kept_once(spark):
    rng = np.random.default_rng(8)
    new = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 30, n))
    x, y, z, left, right, core = new(70), new(60), new(50), new(40), new(40), new(25)
    texts = {
        2: f"{new(20)} {y} {new(9)}", 5: f"{new(7)} {x} {y} {z} {new(30)}", 9: f"{x} {new(12)} {z}",
        20: f"{left} {core} {right}",
    }
    near = lambda n, t: " ".join(t.split()[:n])
    texts[21], texts[22] = f"{' '.join(left.split()[-20:])} {core} {new(60)}", f"{new(60)} {core} {near(20, right)}"
    # the first document to hold a core may hold no window of its passage
    for i in range(30, 60):
        passage = new(50).split()
        texts |= {i: f"{new(30)} {' '.join(passage[12:38])} {new(30)}", 100 + i: f"{new(20)} {' '.join(passage)}", 200 + i: f"{' '.join(passage)} {new(20)}"}
    rows = suffix_dedup.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    got = {(r["doc_id"], w): r["kept"] for r in rows for w in range(r["first_word"], r["end_word"])}
    assert got == flags(texts) and len(got) == sum(r["n_words"] for r in rows)
    assert [(r["first_word"], r["end_word"], r["kept"]) for r in sorted(rows) if r["doc_id"] == 5] == [(7, 77, True), (77, 137, False), (137, 187, True)]
    assert not any(r["doc_id"] in (20, 21, 22) for r in rows)
