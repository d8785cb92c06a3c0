"""Line dedup against all repeated passages of two or more lines, found without the operator's chunks."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from barloom.llm import line_dedup


def test_whole_repeated_passages_go(spark):
    rng = np.random.default_rng(4)
    new = lambda n: [f"line {x}" for x in rng.integers(0, 1 << 40, n)]
    passages = [new(int(n)) for n in rng.integers(2, 9, 40)]
    texts = {i: sum((new(2) + passages[j] for j in rng.choice(40, 4, replace=False)), []) + new(2) for i in range(60)}
    texts[60] = ["alone", *["again"] * 30, "end"]
    where = defaultdict(list)
    for i, lines in sorted(texts.items()):
        for k in range(len(lines) - 1):
            where[lines[k], lines[k + 1]].append((i, k))
    gone = defaultdict(set)
    for places in where.values():
        for i, k in places[1:]:
            gone[i] |= {k, k + 1}
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.drop_repeated_chunks(df).collect()}
    assert got == {i: [x for k, x in enumerate(lines) if k not in gone[i]] for i, lines in texts.items()}
    assert {x for lines in got.values() for x in lines} == {x for lines in texts.values() for x in lines}
    assert sum(map(len, got.values())) == len({x for lines in texts.values() for x in lines})
