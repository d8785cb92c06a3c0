"""Test items in many documents: parts of an item count however often its n-grams occur."""

from __future__ import annotations

import numpy as np

from barloom.llm import decontaminate


def test_frequent_items_are_found_by_any_part(spark):
    rng = np.random.default_rng(6)
    item = [f"w{x}" for x in rng.integers(0, 1 << 30, 200)]
    rows = [(i, " ".join(item)) for i in range(150)] + [(1000 + i, "before " + " ".join(item[70:]) + " behind") for i in range(5)]
    read = lambda x, n: spark.createDataFrame(x, f"{n} long, text string")
    docs, items = read(rows, "doc_id"), read([(7, " ".join(item))], "item_id")
    found = {r["doc_id"]: r["similarity"] for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {i: 1.0 if i < 1000 else 0.65 for i, _ in rows}
    assert decontaminate.drop_contaminated(docs, items).count() == 0
