"""Divergence of sources against whole-number arithmetic on all terms."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

from barloom.llm import divergence
from llm_fixtures import none, odd  # noqa: F401


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)


def brute(rows, top=200):
    """Rows (lang, source, text) to the result's rows."""
    held, counts, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        held[lang].update(set(terms(text)))
        counts[lang, source].update(terms(text))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in held[lang].items() if n >= 3]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        p = lambda n, all_: 1 + 10**9 * (n + 1) // (all_ + len(kept))
        for s in sources:
            mine = {t: p(counts[lang, s][t], total[s]) for t in kept}
            pairs = [(sum((mine[t] - (q := p(counts[lang, o][t], total[o]))) ** 2 // q for t in kept), o) for o in sources if o != s]
            own = [((mine[t] - q) ** 2 // q, t) for t in kept if counts[lang, s][t] and mine[t] > (q := p(whole[t], sum(total.values())))]
            for part, found in (("pair", pairs), ("term", own)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, n) for n, (v, item) in enumerate(found, 1) if part == "pair" or n <= top]
    return sorted(out)


def got(df, **options):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.source_divergence(df, **options).collect())


def test_divergence_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in ("Alpha", "réal", "ZZ", "x", "日本語", "é" * 9, "q" * 40) for b in ("", "a", "bc", "É", "x" * 30)]
    rows = []
    for i in range(300):
        lang = ["en", "de", None, ""][int(rng.integers(0, 4))]
        source = ["s1", "s2", None, "é", "s10", "only"][int(rng.zipf(1.6)) % 6]
        text = " ".join(rng.choice(words, int(rng.integers(0, 12)))) + rng.choice(["", " 12'rare", f" once{chr(97 + i % 26)}{chr(97 + i // 26)}"])
        rows.append((lang, source, None if i % 17 == 0 else text))
    rows += [("fr", "a", "seul mot"), ("fr", "b", None), ("xx", "lone", None)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(6)
    want = brute(rows)
    assert got(df) == want and got(df, top=3) == brute(rows, 3)
    monkeypatch.setattr(divergence, "BLOCK", 4)
    monkeypatch.setattr(divergence, "CELLS", 8)
    assert got(df) == want


def test_kept_terms_by_prefixes(spark):
    """Terms that share prefixes: only those held by three documents stay, at every length."""
    docs = [["a", "ab", "abcd", "abcde"], ["ab", "abcdX", "abcde"], ["ab", "abcde" * 9, "a"], ["abcde" * 9], ["abcde" * 9, "abcde"], ["b" * 16], ["b" * 16], ["b" * 17], ["b" * 16]]
    rows = [("l", sorted(t.encode() for t in d)) for d in docs]
    df = spark.createDataFrame(rows, "lang string, terms array<binary>").repartition(3)
    for first in (1, 2, 4, 5):
        found = {bytes(r["term"]).decode() for r in divergence.kept_terms(df, first=first).collect()}
        assert found == {"ab", "abcde", "abcde" * 9, "b" * 16}


def test_weights_beyond_64_bits():
    counts, totals = np.array([[9_300_000_000, 3]]), np.array([10_000_000_000, 5])
    assert divergence.weights(counts, totals, 7).tolist() == [[1 + 10**9 * (n + 1) // (t + 7) for n, t in zip([9_300_000_000, 3], [10_000_000_000, 5], strict=True)]]


def test_odd_rows(odd, none):
    df = odd.selectExpr("*", "case when doc_id > 3 then null else 'en' end as lang", "cast(doc_id as string) as source", "'q' as term", "'q' as n", "'q' as value")
    assert got(df) == brute([(r["lang"], r["source"], r["text"]) for r in df.collect()])
    assert divergence.source_divergence(none.selectExpr("*", "'en' as lang", "'s' as source")).count() == 0
