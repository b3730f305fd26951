"""Token counts of flat token files without an index: a vectorised search for the end-of-document id.

A file is a run of fixed-width ids, documents end to end, each closed by the end id. It is read as blocks of fixed size that
know nothing of documents. Each block is searched on its own; what a block can't know (how much of its first document came
before) is one number, the ids after the last separator so far, and a prefix scan over the blocks' summaries supplies it.

Defined results: a null or empty text is the end id alone, so it counts 0 tokens. A control string inside a text is encoded
as ordinary text, so no text can hold the end id. Ids behind a file's last separator are an
unfinished document and counted as such (``closed`` false). Repeated rows and ties are documents of their own. Other columns
are not read. An empty table makes no files. Block boundaries never change a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .encoding import default_vocabulary, encoder, id_width
from .shared import written

END_ID = 50256
BLOCK_IDS = 1 << 20
FILE_BLOCKS = 64


def _flat(path: str, end_id: int, block_ids: int, width: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, file, block, enc = TaskContext.get().partitionId(), 0, 0, encoder(path, plain=True)
        held: list[np.ndarray] = []
        names: list = []
        have = 0

        def cut(ids: np.ndarray) -> pa.RecordBatch:
            ends = int((ids == end_id).sum())
            mine, names[:] = names[:ends], names[ends:]
            return pa.RecordBatch.from_arrays(
                [pa.array([part * (1 << 20) + file], pa.int64()), pa.array([block], pa.int32()), pa.array([ids.astype(f"<u{width}").tobytes()], pa.binary()), pa.array([mine], pa.list_(pa.int64()))], ["file_id", "block", "ids", "doc_ids"]
            )

        for batch in batches:
            all_names = batch.column(0).to_pylist()
            for i, j, data, offsets in K.chunks(batch.column(1)):
                ids, at = enc.encode(data, offsets)
                out = np.insert(ids, at[1:], np.uint32(end_id))
                if (ids == end_id).any():
                    raise ValueError(f"the vocabulary gives {end_id} to ordinary text")
                names += all_names[i:j]
                held.append(out)
                have += len(out)
                if have >= block_ids:
                    flat = np.concatenate(held)
                    n = have // block_ids * block_ids
                    for a in range(0, n, block_ids):
                        yield cut(flat[a : a + block_ids])
                        block += 1
                    held, have = [flat[n:].copy()], have - n
                if block >= FILE_BLOCKS:  # a file ends where a document does
                    if have:
                        yield cut(np.concatenate(held))
                    file, block, held, have = file + 1, 0, [], 0
        if have:
            yield cut(np.concatenate(held))

    return run


def write_flat(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(file_id, block, ids, doc_ids): the files' blocks in order; doc_ids, which the scan never reads, names the documents that end in a block.

    Ids are two or four bytes wide, as the vocabulary needs (``encoding.id_width``).
    """
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_flat(vocabulary, end_id, block_ids, id_width(vocabulary)), "file_id bigint, block int, ids binary, doc_ids array<bigint>")


def _search(end_id: int, width: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, total = [], []
            for v in batch.column(2):
                ids = np.frombuffer(v.as_buffer(), f"<u{width}")
                found.append(np.flatnonzero(ids == end_id))
                total.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["file_id", "block", "n_ids", "ends"])

    return run


def scan(blocks: DataFrame, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """(file_id, ordinal, start, n_tokens, closed) of every document, from (file_id, block, ids) alone."""
    found = written(blocks.select("file_id", "block", "ids").mapInArrow(_search(end_id, width), "file_id bigint, block int, n_ids bigint, ends array<bigint>"), "ends")
    # one summary row for each block; a file has at most FILE_BLOCKS of them
    order = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.size("ends")
    tops = found.select("file_id", "block", "n_ids", ends.alias("n_ends"), F.when(ends > 0, F.get("ends", ends - 1)).alias("top"))
    tops = tops.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).withColumn("ordinal", F.coalesce(F.sum("n_ends").over(order), F.lit(0)))
    tops = tops.withColumn("open", F.coalesce(F.max(F.when(F.col("top").isNotNull(), F.col("base") + F.col("top") + 1)).over(order), F.lit(0)))
    both = found.drop("n_ids").join(tops.select("file_id", "block", "base", "ordinal", "open"), ["file_id", "block"])
    rows = both.select("file_id", "base", "ordinal", "open", F.posexplode(F.arrays_zip(F.col("ends").alias("end"), F.concat(F.array(F.lit(-1).cast("long")), "ends").alias("prev"))).alias("k", "e")).where("e.end IS NOT NULL")
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.col("base") + F.col("e.prev") + 1)
    done = rows.select("file_id", (F.col("ordinal") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("e.end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    last = tops.groupBy("file_id").agg(F.max(F.col("base") + F.col("n_ids")).alias("size"), F.sum("n_ends").alias("ordinal"), F.max(F.when(F.col("top").isNotNull(), F.col("base") + F.col("top") + 1)).alias("start"))
    rest = last.select("file_id", "ordinal", F.coalesce("start", F.lit(0)).alias("start"), "size").where("start < size")
    return done.unionByName(rest.select("file_id", "ordinal", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")))


def query(spark, sf_dir):  # noqa: ANN001, ANN201
    from .shared import table

    blocks = written(write_flat(table(spark, sf_dir, "documents")), "flat", compression="zstd")
    order = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the documents' names, dealt to ordinals
    base = blocks.select("file_id", "block", "doc_ids").withColumn("first", F.coalesce(F.sum(F.size("doc_ids")).over(order), F.lit(0)))
    named = base.select("file_id", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("file_id", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return scan(blocks).join(named, ["file_id", "ordinal"]).select("doc_id", "n_tokens", "closed")
