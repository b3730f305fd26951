"""Token ids as sorted-string-table shards: documents keyed by id, found by binary search.

Shard layout, all integers little-endian:

    block*  index  bloom  footer
    block   zstd of: entries, restart offsets u32 each, number of restarts u32
    entry   varint shared, varint unshared, varint value length, the unshared end of the key, value
            (every RESTART-th entry shares nothing, so a search can begin there)
    value   width u8 (2 or 4), ids of that width
    index   for each block: key length u16, its last key, offset u64, length u32, ids before it in the shard u64
    bloom   hashes u8, then the bits
    footer  index offset u64, index length u64, bloom offset u64, bloom length u64, documents u64, ids u64, magic 8 bytes

A key is one byte (0 for a null id, else 1) and the id as a big-endian number with its sign bit turned, so that bytes sort as
ids do. Documents are dealt out by ranges of their id and sorted there; shard (part, seq) follows all before it in that order.

Defined results: a null or empty text is the end id alone. A null id comes first. Repeated ids are neighbours, ordered by
text; all of them are stored, and a lookup returns them all. Other columns are not read. An empty table makes no shards.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .encoding import default_vocabulary, encoder
from .shared import arrow_batches, partitions, written

MAGIC = b"TLSSTv1\n"
FOOTER = struct.Struct("<6Q8s")
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 4 << 20
#: Texts in an Arrow batch at most.
BATCH_ROWS = 1000
RESTART = 16
BLOOM_BITS = 10
BLOOM_HASHES = 7
END_ID = 2


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" + bytes(8) if doc_id is None else b"\x01" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    h = hashlib.blake2b(key, digest_size=16).digest()
    a, b = int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little") | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """One shard in memory, at most SHARD_BYTES and a document large."""

    def __init__(self) -> None:
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.out = bytearray()
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.ids = 0
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.n, self.last, self.before = bytearray(), [], 0, b"", self.ids

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
        value = bytes([width]) + ids.astype(f"<u{width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.n += 1
        self.ids += len(ids)
        self.last = key
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        if self.n:
            self.block += struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            packed = self.pack(self.block)
            self.index.append((self.last, len(self.out), len(packed), self.before))
            self.out += packed
        self._open()

    def full(self) -> bool:
        return len(self.out) >= SHARD_BYTES

    def finish(self) -> bytearray:
        """The shard, in the buffer that its blocks stand in."""
        self._close()
        at = len(self.out)
        for k, o, n, b in self.index:
            self.out += struct.pack("<H", len(k)) + k + struct.pack("<QIQ", o, n, b)
        bloom_at = len(self.out)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for k in self.keys:
            for p in _bloom_places(k, len(bloom) * 8, BLOOM_HASHES):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.append(BLOOM_HASHES)
        self.out += bloom
        self.out += FOOTER.pack(at, bloom_at - at, bloom_at, len(self.out) - bloom_at, len(self.keys), self.ids, MAGIC)
        return self.out


class Reader:
    """Reads a shard from its footer backwards; blocks are unpacked as they are asked for."""

    def __init__(self, data: bytes) -> None:
        import zstandard

        self.unpack = zstandard.ZstdDecompressor().decompress
        self.data = data
        index_at, index_n, bloom_at, bloom_n, self.documents, self.ids, magic = FOOTER.unpack_from(data, len(data) - FOOTER.size)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.index, at, end = [], index_at, index_at + index_n
        while at < end:
            (n,) = struct.unpack_from("<H", data, at)
            self.index.append((bytes(data[at + 2 : at + 2 + n]), *struct.unpack_from("<QIQ", data, at + 2 + n)))
            at += 2 + n + 20
        self.hashes, self.bloom = data[bloom_at], data[bloom_at + 1 : bloom_at + bloom_n]

    @staticmethod
    def _ids(value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{value[0]}", offset=1)

    def _block(self, i: int) -> bytes:
        _, at, n, _ = self.index[i]
        return self.unpack(bytes(self.data[at : at + n]))

    @staticmethod
    def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            yield key, raw[at + own : at + own + n]
            at += own + n

    def scan(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids before it in the shard, ids) of every document."""
        for i, (_, _, _, before) in enumerate(self.index):
            raw = self._block(i)
            (n,) = struct.unpack_from("<I", raw, len(raw) - 4)
            for key, value in self._entries(raw, 0, len(raw) - 4 * (n + 1)):
                ids = self._ids(value)
                yield key, before, ids
                before += len(ids)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every document with this key: Bloom filter, index, restarts, then at most a few entries."""
        from bisect import bisect_left

        bits = len(self.bloom) * 8
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, bits, self.hashes)):
            return []
        out: list[np.ndarray] = []
        for i in range(bisect_left(self.index, key, key=lambda x: x[0]), len(self.index)):
            raw = self._block(i)
            (n,) = struct.unpack_from("<I", raw, len(raw) - 4)
            end = len(raw) - 4 * (n + 1)
            restarts = struct.unpack_from(f"<{n}I", raw, end)
            r = max(0, bisect_left(restarts, key, key=lambda at: next(self._entries(raw, at, end))[0]) - 1)  # noqa: B023
            for k, value in self._entries(raw, restarts[r], end):
                if k > key:
                    return out
                if k == key:
                    out.append(self._ids(value))
        return out


def _shards(path: str, end_id: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, w, enc = TaskContext.get().partitionId(), 0, Writer(), encoder(path)

        def row() -> pa.RecordBatch:
            out = w.finish()
            shard = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, len(out)], np.int32)), pa.py_buffer(out)])
            narrow = ([part], [seq], [len(w.keys)], [w.ids], [w.keys[0]], [w.keys[-1]])
            return pa.RecordBatch.from_arrays([*(pa.array(v, f.type) for v, f in zip(narrow, SHARD_SCHEMA, strict=False)), shard], schema=SHARD_SCHEMA)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, j, data, offsets in K.chunks(batch.column(1)):
                ids, at = enc.encode(data, offsets)
                for d in range(j - i):
                    w.add(key_of(names[i + d]), np.append(ids[at[d] : at[d + 1]], np.uint32(end_id)))
                    if w.full():
                        yield row()
                        seq, w = seq + 1, Writer()
        if w.keys:
            yield row()

    return run


SHARD_SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("shard", pa.binary())])


def write_shards(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, seq, n_docs, n_ids, first_key, last_key, shard) of all documents, in ascending order of id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(_shards(vocabulary or default_vocabulary(), end_id), "part int, seq int, n_docs bigint, n_ids bigint, first_key binary, last_key binary, shard binary")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, shard in zip(*(batch.column(i) for i in range(3)), strict=True):
            rows = [(id_of(k), before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for k, before, ids in Reader(memoryview(shard.as_buffer())).scan()]
            cols = list(zip(*rows, strict=True))
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), *(pa.array(c, pa.int64()) for c in cols)], ["part", "seq", "doc_id", "before", "n_tokens", "ids_crc32"])


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards; start counts all ids before it.

    What stands before a shard is summed by part, a row a part, and then within its part.
    """
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids")).select(F.col("part").alias("_p"), (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before_part"))
    order = Window.partitionBy("part").orderBy("seq")
    own = shards.select("part", "seq", "n_ids").withColumn("own", F.sum("n_ids").over(order) - F.col("n_ids"))
    starts = own.join(F.broadcast(parts), F.col("part") == F.col("_p")).select("part", "seq", (F.col("before_part") + F.col("own")).alias("base"))
    rows = shards.select("part", "seq", "shard").mapInArrow(_scan, "part int, seq int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def lookup(shards: DataFrame, doc_id: int | None) -> list[list[int]]:
    """The ids of the documents with this id: shards whose key range holds it ask their Bloom filter, then one block, where they lie."""
    key = key_of(doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, shard in zip(*(batch.column(i) for i in range(3)), strict=True):
                for n, ids in enumerate(Reader(memoryview(shard.as_buffer())).get(key)):
                    yield pa.RecordBatch.from_pydict({"part": [part.as_py()], "seq": [seq.as_py()], "n": [n], "ids": [ids.tolist()]})

    hits = shards.where((F.col("first_key") <= F.lit(bytearray(key))) & (F.col("last_key") >= F.lit(bytearray(key)))).select("part", "seq", "shard")
    found = hits.mapInArrow(run, "part bigint, seq bigint, n bigint, ids array<bigint>").collect()
    return [r["ids"] for r in sorted(found, key=lambda r: (r["part"], r["seq"], r["n"]))]


def stored(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The shards of docs as a table in the shared folder."""
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        return written(write_shards(docs, vocabulary, end_id), "shards", compression="none")


def query(spark, sf_dir):  # noqa: ANN001, ANN201
    from .shared import table

    return read_documents(stored(table(spark, sf_dir, "documents")))
