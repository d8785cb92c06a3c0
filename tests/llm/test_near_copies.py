"""The pipeline's near-dedup against brute-force similarity of five-word shingles."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from barloom.llm import near_copies, simhash
from llm_fixtures import docs, none, odd, texts  # noqa: F401


def sets(texts):
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    return {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}


def kept(texts):
    """Identifiers that stay: the smallest of each component of pairs with similarity of 0.8 or more."""
    found, root = sets(texts), {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if 5 * len(found[i] & found[j]) >= 4 * len(found[i] | found[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i for i in ids if top(i) == i}


def left(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}


def edited(rng, words, share):
    return [f"e{rng.integers(0, 1 << 30)}" if rng.random() < share else w for w in words]


def test_near_copies_match_brute_force(spark, monkeypatch):
    """Edited copies on both sides of 0.8, a group larger than a block, short texts and texts without words."""
    rng = np.random.default_rng(3)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 30, n)]
    texts = {}
    for base in [new(int(rng.integers(8, 400))) for _ in range(60)]:
        for share in (0, 0.01, 0.02, 0.03, 0.05):
            texts[len(texts)] = " ".join(edited(rng, base, share))
    group = new(120)
    for _ in range(80):
        texts[len(texts)] = " ".join(edited(rng, group, 0.008))
    texts |= {1000: "a b", 1001: "A  b", 1002: "a c", 1003: "", 1004: " \n", 1005: None}
    want = kept(texts)
    assert 60 < len(want) < len(texts) - 100
    assert left(spark, texts) == want
    monkeypatch.setattr(near_copies, "SETS", 16)
    assert left(spark, texts) == want


def test_near_copies_of_documents(spark, texts):
    assert left(spark, texts) == kept(texts)


def test_near_copies_odd_rows(odd, none):
    out = near_copies.drop_near_copies(odd)
    assert out.schema == odd.schema and near_copies.drop_near_copies(none).count() == 0
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == [1, 1, 2, 5, 7, 9]


def test_simhash_alone_links_close_fingerprints(spark):
    """Without MinHash tables, pairs within three bits are still compared and linked by their similarity."""
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 1 << 30, 3000)]
    texts = [" ".join(x).encode() for x in (base, [*base[:-1], "z"], ["y", *base[1:]], base[:1500])]
    fps = [simhash.fingerprint(t) for t in texts]
    assert all((fps[0] ^ x).bit_count() <= 3 for x in fps[1:3])
    rows = [(i, len(near_copies.shingles(t)), i, [int(np.uint64(f).view(np.int64))], []) for i, (t, f) in enumerate(zip(texts, fps, strict=True))]
    sets = spark.createDataFrame(rows, "_set long, _size long, _digest long, _fps array<long>, _bands array<long>")
    held = spark.createDataFrame(list(enumerate(map(bytearray, texts))), "_digest long, _text binary")
    roots = simhash.components(near_copies._pairs(sets, held)).collect()
    assert {(r["vertex"], r["root"]) for r in roots} == {(0, 0), (1, 0), (2, 0)}
