"""Token counts, token files and BPE against the libraries that own the vocabularies."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from barloom.llm import bpe, common, token_count, token_output
from llm_fixtures import docs, none, odd, texts  # noqa: F401


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def ranked():
    own = bpe.Bpe.load(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={}), own


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def strange(n, seed=1):
    rnd = random.Random(seed)
    letters = [chr(c) for c in [*range(0x2FFF), 0x3000, 0x1F600, 0x200B, 0xFEFF]]
    for k in range(n):
        t = "".join(rnd.choice(letters if rnd.random() < 0.3 else "aa'sdl  \n\t.1eté\x00\x01") for _ in range(rnd.randint(0, 60)))
        yield t + ("<|endoftext|>" + t if k % 5 == 0 else "")


LONG = ["a" * 20_000, " " * 5000, "ab" * 4000, "=" * 3000, "the" * 4000, "x " * 3000, "\n" * 999]


def test_segments_join_to_the_text():
    for t in [*strange(500), *LONG]:
        assert "".join(s for part in common.segments(t, 16) for s in part) == t
        assert "".join(common.segment_of(k) for part in common.segment_keys(t) for k in part) == t


def test_counts_of_strange_texts(library):
    counter = token_count.Counter(public_tokenizers.path(token_count.VOCABULARY))
    some = [*strange(1500), *LONG]
    assert counter.count_batch(some) == [len(ids_of(library, t)) for t in some]
    counter.transducer._restart()
    counter.segments = common.SegmentTable(counter.learn, limit=10)
    assert sum((counter.count_batch([t]) for t in some[:300]), []) == [len(ids_of(library, t)) for t in some[:300]]


def test_token_counts(docs, texts, library):
    for r in token_count.token_counts(docs).collect():
        t = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(ids_of(library, t))) and r["over_limit"] == (r["n_tokens"] > 1024)


def test_token_files(docs, texts, library, tmp_path):
    start = 0
    got = {r["doc_id"]: r for r in token_output.token_files(docs).collect()}
    for i in sorted(texts):
        ids = [*ids_of(library, texts[i]), 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(raw(ids)))
        start += len(ids)


def test_token_files_by_the_page(docs, tmp_path):
    import pyarrow.parquet as pq

    folder = token_output.write_tokens(token_output.encoded(docs), str(tmp_path / "tokens"))
    file = pq.ParquetFile(sorted((tmp_path / "tokens").glob("part-*"))[0])
    columns = {file.metadata.row_group(0).column(i).path_in_schema: file.metadata.row_group(0).column(i) for i in range(file.metadata.num_columns)}
    assert all(c.has_offset_index and c.has_column_index for n, c in columns.items() if "ids" not in n)
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    # metadata alone: the list column is not read
    plan = token_output.read_tokens(docs.sparkSession, folder).select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_bpe_matches_library(docs, texts, ranked):
    encoding, own = ranked
    for r in bpe.encode(docs).collect():
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(raw(ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_of_strange_texts(ranked):
    encoding, own = ranked
    some = [*strange(1500, 2), *LONG]
    assert own.encode_batch(some) == [raw(encoding.encode_ordinary(t)) for t in some]
    assert [own.decode(x) for x in own.encode_batch(some)] == [t.encode() for t in some]
    # the rank queue takes ranks up to the token's own, so each token must be what its bytes merge to
    tokens = [t for t in own.ranks][:20_000]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.merge(tokens)] == [[own.ranks[t]] for t in tokens]


def test_rank_queue_pops_in_order():
    rnd = random.Random(3)
    ranks = rnd.sample(range(50_000), 2000)
    queue = bpe.RankQueue(50_256)
    for r in ranks:
        queue.open(r, [r])
    assert [queue.pop()[0] for _ in ranks] == sorted(ranks) and queue.pop() is None


def test_odd_rows(odd, none, library, ranked):
    rows = odd.select("doc_id", "text").collect()
    counts = [(r["doc_id"], r["n_tokens"]) for r in token_count.token_counts(odd).collect()]
    assert sorted(counts, key=str) == sorted(((r["doc_id"], len(ids_of(library, r["text"]))) for r in rows), key=str)
    got = bpe.encode(odd).collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=str) == sorted(((r["doc_id"], ranked[0].encode_ordinary(r["text"] or "")) for r in rows), key=str)
    back = bpe.decode(bpe.encode(odd)).collect()
    assert sorted(bytes(r["decoded"]) for r in back) == sorted((r["text"] or "").encode() for r in rows)
    files = token_output.token_files(odd).collect()
    assert sorted(r["n_tokens"] for r in files) == sorted(len(ids_of(library, r["text"])) + 1 for r in rows)
    by_start = sorted(files, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == [sum(r["n_tokens"] for r in by_start[:k]) for k in range(len(by_start))]
    for f in (token_count.token_counts, bpe.encode, token_output.token_files):
        assert f(none).count() == 0
