"""Exact, near, line and passage dedup against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from barloom.llm import exact_dedup, line_dedup, simhash, suffix_dedup
from llm_fixtures import docs, none, odd, texts  # noqa: F401


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def test_exact_dedup_matches_brute_force(docs, texts):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[norm(t)].append(i)
    for r in exact_dedup.exact_dedup(docs).collect():
        same = groups[norm(texts[r["doc_id"]])]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(same), len(same), r["doc_id"] == min(same))
        assert r["text_sha256"] == hashlib.sha256(norm(texts[r["doc_id"]]).encode()).hexdigest()


def test_exact_dedup_odd_rows(odd, none):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == odd.count()
    abc = [r for r in rows if r["doc_id"] in (1, 8)]
    assert {r["keep_id"] for r in abc} == {1} and {r["group_size"] for r in abc} == {3} and sum(r["kept"] for r in abc) == 1
    blank = [r for r in rows if r["doc_id"] in (2, 3) or (r["doc_id"] is None and r["keep_id"] == 2)]
    assert len(blank) == 3 and all(r["keep_id"] == 2 and r["group_size"] == 3 for r in blank)
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    assert Counter(norm(r["text"]) for r in kept.collect()) == Counter({norm(r["text"]) for r in odd.collect()})
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_copies_across_partitions(spark):
    """A group with most of the rows lies in many partitions and is still one group."""
    rows = [(i, "same text" if i % 3 else f"other {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    big = [r for r in exact_dedup.exact_dedup(df).collect() if r["group_size"] > 1]
    assert len(big) == 2000 and {r["keep_id"] for r in big} == {1} and sum(r["kept"] for r in big) == 1
    assert exact_dedup.drop_copies(df).count() == 1001


def fingerprint(t):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps: dict, radius: int) -> dict:
    ids = sorted(fps)
    at = {i: i for i in ids}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                at[y] = x
    return {i: root(i) for i in ids}


def test_near_dedup_matches_brute_force(docs, texts):
    fps = {i: fingerprint(t) for i, t in texts.items()}
    want = components(fps, 3)
    for r in simhash.near_dedup(docs).collect():
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]
    want = components(fps, 6)
    assert {r["doc_id"] for r in simhash.drop_near_copies(docs, radius=6).select("doc_id").collect()} == set(want.values())


def test_near_dedup_odd_rows(odd, none):
    rows = simhash.near_dedup(odd).collect()
    assert len(rows) == odd.count()
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {2}
    kept = simhash.drop_near_copies(odd)
    assert kept.schema == odd.schema
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 1, 2, None, 5, 7, 9])
    assert simhash.near_dedup(none).count() == 0 and simhash.drop_near_copies(none).count() == 0


def test_links_of_oversized_buckets(spark):
    """Buckets over the size go through finer cuts and block pairs and lose no link."""
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = set()
    for c in centre.tolist():
        for _ in range(250):
            x = c
            for b in rng.integers(0, 64, 4).tolist():
                x ^= 1 << b
            fps.add(x)
    signed = {x - (1 << 64) if x >> 63 else x: x for x in fps}
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "_fp long"), bucket=8)
    got = {r["vertex"]: r["root"] for r in simhash.components(edges).collect()}
    want = components({s: x for s, x in signed.items()}, 3)
    sizes = Counter(want.values())
    assert {s: want[s] for s in signed if sizes[want[s]] > 1} == got


def test_rounds_of_a_long_chain(spark, monkeypatch):
    """A chain in ascending order, which is the worst case where vertices move to their smallest neighbour."""
    calls = []
    monkeypatch.setattr(simhash, "stored", lambda df, f=simhash.stored: calls.append(1) or f(df))
    n = 10_000
    edges = spark.range(n - 1).selectExpr("id as u", "id + 1 as v").unionByName(spark.createDataFrame([(-7, -5), (-6, -5), (3, 3)], "u long, v long"))
    got = {r["vertex"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, -7: -7, -6: -7, -5: -7}
    assert len(calls) <= 3 * 20


def test_masks_cover_the_radius():
    rng = np.random.default_rng(1)
    for radius in range(7):
        masks = simhash.masks(radius)
        for _ in range(300):
            differ = sum(1 << b for b in rng.choice(64, radius, replace=False).tolist())
            assert any(not m & differ for m in masks)


def test_line_dedup_matches_brute_force(docs, texts):
    seen, want = {}, {}
    places = defaultdict(list)
    for i in sorted(texts):
        lines = texts[i].encode().split(b"\n")
        for lo, hi in line_dedup.chunks(texts[i].encode()):
            if hi - lo > 1:
                places[b"\n".join(lines[lo:hi])].append((i, lo, hi))
    gone = defaultdict(set)
    for p in places.values():
        for i, lo, hi in sorted(p)[1:]:
            gone[i].update(range(lo, hi))
    for i, t in texts.items():
        want[i] = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])
    seen = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_chunks(docs).collect()}
    assert seen == want and any(gone.values())


def test_line_chunks_resist_shifts():
    rng = np.random.default_rng(2)
    lines = [b"line %d" % x for x in rng.integers(0, 1 << 30, 400)]
    text = b"\n".join(lines)
    shifted = b"\n".join([b"new"] + lines)
    cut = lambda t: {tuple(t.split(b"\n")[a:b]) for a, b in line_dedup.chunks(t)}
    assert len(cut(text) - cut(shifted)) <= 1


def test_line_dedup_odd_rows(odd, none, spark):
    left = line_dedup.drop_repeated_chunks(odd)
    assert left.schema == odd.schema and left.count() == odd.count()
    assert line_dedup.drop_repeated_chunks(none).count() == 0
    block = "\n".join(f"passage {i}" for i in range(40))
    df = spark.createDataFrame([(None, block), (1, block), (2, "top\n" + block), (2, "top\n" + block)], "doc_id long, text string")
    got = line_dedup.drop_repeated_chunks(df).collect()
    assert [r["text"] for r in got if r["doc_id"] == 1] == [block]
    assert all(len(r["text"].split("\n")) < 12 for r in got if r["doc_id"] != 1)


def passages(texts, least):
    where = defaultdict(set)
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].add(i)
    out = {}
    for i, w in words.items():
        held = {x for k in range(len(w) - least + 1) if len(where[tuple(w[k : k + least])]) > 1 for x in range(k, k + least)}
        if held:
            out[i] = held
    return out


def covered(rows):
    out = defaultdict(set)
    for r in rows:
        out[r["doc_id"]].update(range(r["first_word"], r["end_word"]))
    return dict(out)


def test_repeated_passages_match_brute_force(docs, texts):
    assert covered(suffix_dedup.repeated_passages(docs).collect()) == passages(texts, 50)


def test_repeated_passages_in_many_documents(spark):
    """One passage in most documents, in periodic text too, over many partitions."""
    rng = np.random.default_rng(5)
    common = " ".join(f"w{x}" for x in rng.integers(0, 50, 70))
    rows = []
    for i in range(300):
        own = " ".join(f"o{x}" for x in rng.integers(0, 1 << 30, 60))
        rows.append((i, f"{own} {common} {own[::-1]}" if i % 3 else own))
    rows += [(1000, "in " * 200), (1001, "in " * 90 + "end"), (1002, "at " * 300), (1003, None), (1004, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    found = suffix_dedup.repeated_passages(df).collect()
    assert covered(found) == passages(dict(rows), 50)
    assert [r["doc_id"] for r in found if r["kept"] and r["doc_id"] < 1000] == [1]


def test_repeated_passages_of_common_cores(spark, monkeypatch):
    """Edited copies and passages that begin anywhere, with all but the rarest cores cut into windows."""
    rng = np.random.default_rng(9)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 30, n)]
    base, rows = [new(300) for _ in range(4)], []
    for i in range(80):
        lo = int(rng.integers(0, 220))
        part = base[i % 4][lo : lo + int(rng.integers(40, 130))]
        part = [x if rng.random() > 0.02 else "edited" for x in part] if i % 3 == 0 else part
        rows.append((i, " ".join(new(int(rng.integers(0, 30))) + part + new(int(rng.integers(0, 30))))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(suffix_dedup.repeated_passages(df).collect())
    assert covered(want) == passages(dict(rows), 50)
    monkeypatch.setattr(suffix_dedup, "SUFFIXES", 3)
    assert sorted(suffix_dedup.repeated_passages(df).collect()) == want


def test_repeated_passages_odd_rows(spark, odd, none):
    assert covered(suffix_dedup.repeated_passages(odd).collect()) == {}
    assert suffix_dedup.repeated_passages(none).count() == 0
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(None, passage), (3, f"x {passage}"), (3, f"x {passage}"), (4, passage), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as _doc", "'q' as core", "'q' as kept")
    got = {(r["doc_id"], r["first_word"], r["end_word"], r["kept"]) for r in suffix_dedup.repeated_passages(df).collect()}
    assert got == {(3, 1, 61, True), (4, 0, 60, False), (None, 0, 60, False)}
