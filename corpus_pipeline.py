"""A corpus pipeline over ``documents``: toxic documents, exact copies, near copies and documents that hold test
items go; what is left is encoded with byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.  All but the last return rows of
``docs`` with their columns unchanged; the last returns doc_id, ids, n_tokens, ids_sha256 and decoded_sha256.

Null and empty texts are texts without words: they are never toxic or contaminated, one of them stays among copies, and
they encode to no ids.  Rows with a null identifier are like any other and come last where one row of several stays.  Very
long texts are read whole.  Further columns, whatever their names, pass through.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import bpe, decontaminate, exact_dedup, near_copies, toxicity
from barloom.llm.common import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the model is fitted on a bounded sample of labelled documents."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space, the one with the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their five-word shingles, the one with the smallest doc_id stays;
    SimHash gives the candidates, MinHash those that differ in more than three bits."""
    return near_copies.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also edited, go."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digest of what they decode to."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level bpe", encode),
]

#: Toxicity, SimHash, shingle similarity, alignment and BPE have no SQL form; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
