"""Token ids as Parquet list columns.

A file holds the documents of one range of identifiers in ascending order: identifier, number of tokens, the
tokens before it in its file, and the ids as a list column.  Metadata columns are delta-encoded; ids are
dictionary-encoded while a row group's dictionary stays small and delta-encoded otherwise.  Row groups and
pages have a set size and page indexes are written, so a reader of a few identifiers or of metadata alone
touches only the pages it needs.  ``spark.read.parquet(folder)`` reads it, as does any Parquet library.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import SegmentTable, by_size, id_lists, pre_tokens, resident, tokenizer_path, work_folder
from barloom.llm.token_count import BYTE_LEVEL, byte_letters

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
ROW_GROUP, PAGE, DICTIONARY = 32 << 20, 256 << 10, 1 << 20

OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",  # delta encoding where no dictionary is used
    "parquet.block.size": str(ROW_GROUP),
    "parquet.page.size": str(PAGE),
    "parquet.page.row.count.limit": "1000",
    "parquet.dictionary.page.size": str(DICTIONARY),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#start_in_file": "false",
    "compression": "zstd",
}


class Encoder:
    """The tokenizers library, asked once for each new segment where the file allows it, else for whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.by_segment = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
        )
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.ids = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        self.special = re.compile("|".join(map(re.escape, sorted(self.ids, key=len, reverse=True)))) if added else None
        self.letters = {b: c for c, b in byte_letters().items()}
        self.split = regex.compile(BYTE_LEVEL)
        self.segments = SegmentTable(self.learn, limit=800_000)

    def learn(self, segments: list[str]) -> list[bytes]:
        tokenize, known, fresh = self.tokenizer.model.tokenize, self.segments.value, {}

        def ids(p: str) -> bytes:
            found = fresh.get(p)
            if found is None:
                found = known(p)
            if found is None:
                letters = p.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
                found = fresh[p] = array("I", [t.id for t in tokenize(letters)]).tobytes()
            return found

        return [b"".join(map(ids, pre_tokens(s, self.split))) for s in segments]

    def encode_batch(self, texts: list[str], end: bytes) -> list[bytes]:
        """Ids of each text with ``end`` after them, as little-endian unsigned 32-bit integers."""
        if not self.by_segment:
            found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [np.array(x.ids, "<u4").tobytes() + end for x in found]
        out: list[bytes | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if not (self.special and self.special.search(t))]
        for i, ids in zip(plain, self.segments.joined([texts[i] for i in plain]), strict=True):
            out[i] = ids + end
        for i, ids in enumerate(out):
            if ids is None:  # a text with special strings: what stands between them is encoded by itself
                between = self.segments.joined(self.special.split(texts[i]))
                marks = [self.ids[m] for m in self.special.findall(texts[i])]
                out[i] = b"".join(x + y for x, y in zip(between, [*marks, b""], strict=True)) + end
        return out


def loaded(path: str) -> Encoder:
    return resident(("encoder", path), lambda: Encoder(path))


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The rows of the file format, in ascending identifier order inside and across partitions.

    Null texts count as empty and give the end id alone; null identifiers come first; rows with the same
    identifier follow one another in no set order.
    """
    path, end = path or tokenizer_path(VOCABULARY), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before, part = loaded(path), 0, TaskContext.get().partitionId()
        for b in batches:
            lo = 0
            for texts in by_size([t or "" for t in b.column(1).to_pylist()]):
                lists, sizes = id_lists(encoder.encode_batch(texts, end))
                starts = before + np.concatenate([[0], np.cumsum(sizes)])
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n), pa.array([part] * n, pa.int32()), pa.array(starts[:-1], pa.int64()), pa.array(sizes, pa.int64()), lists],
                    ["doc_id", "file", "start_in_file", "n_tokens", "ids"],
                )
                lo, before = lo + n, int(starts[-1])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, file int, start_in_file long, n_tokens long, ids array<int>")


def write_tokens(rows: DataFrame, folder: str) -> str:
    rows.write.options(**OPTIONS).parquet(folder)
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids.

    Without ``ids`` in what is asked for, the pages of the list column are not read.
    """
    rows = spark.read.parquet(folder)
    # One row per file: the number of files bounds this window and the broadcast.
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = F.broadcast(sums.select("file", before.alias("_base")))
    return rows.join(bases, "file").select("doc_id", (F.col("_base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            offsets, flat = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            crc = [zlib.crc32(flat[4 * lo : 4 * hi]) for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, folder: str | None = None) -> DataFrame:
    """Encode, write the files to ``folder`` (by default a new one in the shared work folder), read them back and sum them.

    Null texts are empty and give the end token alone.  Null identifiers come first in the order; rows with equal
    identifiers are rows of their own, in any order among them.  Other columns are ignored.  No rows give no rows.
    """
    spark = df.sparkSession
    folder = folder or f"{work_folder(spark)}/{uuid.uuid4().hex}"
    write_tokens(encoded(df, id_col, text_col, path), folder)
    return checksums(read_tokens(spark, folder)).withColumnRenamed("doc_id", id_col)
