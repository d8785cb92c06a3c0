"""Fixtures of the corpus tests (not a conftest: the tests beside this folder import theirs by that name)."""

from __future__ import annotations

import os

import pytest

DATA = os.environ.get("BARLOOM_TEST_DATA", "/root/testdata/sf0.001")

ROWS = [
    (1, "a b c"), (1, "a b c"), (2, None), (None, "x y"), (3, ""), (4, " \n "), (5, "lang wort " * 40_000), (6, "a  b\tc\n"),
    (None, None), (7, "z" * 60_000), (8, "a b c"), (9, "Straße 'quoted' it's 12 <|endoftext|> 　 …\x00 end\n\n\n x "),
]
#: Other columns whose names the operators use themselves.
CLASH = ["_id", "_text", "_digest", "_fp", "_doc", "_key", "_run", "_kind", "_gone", "ids", "score", "_kept_columns"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing names."""
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(i, t, *["q"] * len(CLASH)) for i, t in ROWS], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
