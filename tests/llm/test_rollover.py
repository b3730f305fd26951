"""A writer goes on to its next file when one is full, and a row larger than a file has one of its own: nothing is lost or split."""

import random

import pyarrow as pa
import pytest

from tickloom.llm import encoding, sstable, tokencount, warc


@pytest.fixture
def task(monkeypatch):
    import pyspark

    class Task:
        def partitionId(self):  # noqa: N802
            return 3

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(Task))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    short = [" ".join(str(rng.randint(0, 10**6)) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    return [*short[:200], " ".join(str(rng.random()) for _ in range(40_000)), None, "", *short[200:]]


def batches(texts, size=60):
    for i in range(0, len(texts), size):
        yield pa.RecordBatch.from_arrays([pa.array(range(i, i + len(texts[i : i + size])), pa.int64()), pa.array(texts[i : i + size], pa.string())], ["doc_id", "text"])


def plain(texts, end):
    lib = encoding.Encoder(encoding.default_vocabulary()).lib
    return [[*lib.encode(t or "", add_special_tokens=False).ids, end] for t in texts]


def test_token_shards(task, texts, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD_BYTES", 30_000)
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 4_000)
    rows = [r for b in sstable._shards(encoding.default_vocabulary(), 2)(batches(texts)) for r in b.to_pylist()]
    assert [(r["part"], r["seq"]) for r in rows] == [(3, i) for i in range(len(rows))] and len(rows) > 3
    assert max(len(r["shard"]) for r in rows) > 3 * sstable.SHARD_BYTES
    read = [(sstable.id_of(k), ids.tolist()) for r in rows for k, _, ids in sstable.Reader(r["shard"]).scan()]
    assert read == list(enumerate(plain(texts, 2)))
    assert sum(r["n_docs"] for r in rows) == len(texts) and all(sstable.Reader(r["shard"]).ids == r["n_ids"] for r in rows)


def test_flat_token_files(task, texts, monkeypatch):
    monkeypatch.setattr(tokencount, "FILE_BLOCKS", 3)
    rows = [r for b in tokencount._flat(encoding.default_vocabulary(), tokencount.END_ID, 2_000, 2)(batches(texts)) for r in b.to_pylist()]
    assert len({r["file_id"] for r in rows}) > 3 and {r["file_id"] >> 20 for r in rows} == {3}
    flat = b"".join(r["ids"] for r in rows)
    want = [i for ids in plain(texts, tokencount.END_ID) for i in ids]
    assert list(memoryview(flat).cast("H")) == want and [d for r in rows for d in r["doc_ids"]] == list(range(len(texts)))
    for f in {r["file_id"] for r in rows}:  # a file ends where a document does
        last = [r for r in rows if r["file_id"] == f][-1]
        assert last["ids"][-2:] == tokencount.END_ID.to_bytes(2, "little") and [r["block"] for r in rows if r["file_id"] == f] == list(range(last["block"] + 1))


def test_archives(spark, texts, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    n = len(texts)
    columns = [pa.array(range(n), pa.int64()), pa.array([f"http://h/{i}" for i in range(n)]), pa.array([t or "" for t in texts]), pa.nulls(n, pa.int64()), pa.array([False] * n)]
    rows = [r for b in warc._write(iter([pa.RecordBatch.from_arrays(columns, ["page_id", "url", "html", "first", "revisit"])])) for r in b.to_pylist()]
    assert len(rows) > 3 and sum(r["n_records"] for r in rows) == n and max(len(r["archive"]) for r in rows) > 10 * warc.ARCHIVE_BYTES
    got = warc.read_records(spark.createDataFrame([(r["n_records"], bytearray(r["archive"])) for r in rows], "n_records bigint, archive binary")).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in got) == [(i, len((t or "").encode())) for i, t in enumerate(texts)]
