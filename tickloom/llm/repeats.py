"""Removal of every byte under a string of LENGTH bytes that also starts elsewhere, by prefix-free parsing.

1. Parse. A rolling hash over GRAM bytes chooses triggers: in each window of LENGTH bytes, the least hash (the last of equals).
   A trigger depends on the window's bytes alone, so equal windows have equal triggers at the same place, wherever they stand.
   Windows with one trigger are neighbours and form a phrase: trigger, first and last window. Phrases overlap by LENGTH - 1 bytes.
2. Dictionary. Phrases are counted by trigger and digest of their bytes, summed before they are shuffled, so thousands of copies
   are one entry. An entry that stands twice is repeated from end to end, and where a trigger stands once, none of its windows
   can repeat: for both that is all there is to say, and no byte of them is looked at again.
3. Order. Other entries stand once, but another entry has their trigger. The bytes of such a trigger's entries, once each, meet in
   one task, which builds their suffix array up to LENGTH bytes by doubling: ranks of 8 bytes, of 16, of 32 and so on, each
   from pairs of the last. Windows of equal rank are equal byte by byte. As phrases overlap, no window crosses from
   one to the next, so the order of the parse itself is never needed. Equal windows have their trigger at the same place, so windows
   whose trigger's places lie within PART of each other are looked at together first: where the bytes that they have in common
   stand nowhere else in the task, neither do they, and nothing of them is sorted.
   The entries of one trigger are dealt into blocks of some BLOCK. A trigger of several blocks (the border of a passage that very
   many texts share) is sorted block by block, and each task names its blocks' distinct windows by fingerprint, one of each rank. Where
   two tasks name one fingerprint, the bytes of those windows meet and decide. So at every size windows are equal if their bytes
   are, no task holds a whole trigger, and a window that a thousand entries have is named once by each task.
4. Repeated windows go back to their documents as byte ranges and are cut out there.

Defined results: a null text is empty; texts shorter than LENGTH keep all. Matches never cross texts. Repeated rows are
elsewhere to one another, so both lose their bytes. Null ids and clashing columns do no harm: rows are named by id and hash
of the text, and nothing else is read. An empty table gives no rows. Texts of any length are judged whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import let_go, partitions, written

LENGTH = 200
GRAM = 48
#: Bytes of phrases that one task sorts, about.
TASK_BYTES = 4 << 20
#: Entries of a trigger that meet in one suffix array, about.
BLOCK = 1_000
#: Windows of an entry that are looked at together.
PART = 16
#: Hashes of so many documents go to every executor whole (8 MB); beyond that the documents are joined by shuffle alone.
BROADCAST_ROWS = 500_000


def phrases(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, trigger hash, digest, first window, last window) of each phrase; windows are counted from the text's first byte."""
    sizes = np.diff(offsets)
    if len(sizes) == 1 and sizes[0] > 2 * K.CHUNK_BYTES:  # a very long text in parts: each window is in one of them
        parts = [(s, phrases(part := data[s : s + K.CHUNK_BYTES + length - 1], np.array([0, len(part)]), length, gram)) for s in range(0, int(sizes[0]), K.CHUNK_BYTES)]
        return tuple(np.concatenate([p[c] + (s if c > 2 else 0) for s, p in parts]) for c in range(5))
    counts = np.maximum(sizes - (length - 1), 0)
    total = int(counts.sum())
    if not total:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    prefix = K.prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = K.span_hash(prefix, at, at + gram)
    least = (grams >> K.U(32) << K.U(32)) | (K.U(0xFFFFFFFF) - at.astype(K.U))
    span, step = length - gram + 1, 1
    while 2 * step <= span:  # minima over windows that double in width
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < span:
        least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
    text = np.repeat(np.arange(len(sizes)), counts)
    local = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    trigger = (K.U(0xFFFFFFFF) - (least[offsets[text] + local] & K.U(0xFFFFFFFF))).astype(np.int64)
    new = np.r_[True, (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], total] - 1
    begin = offsets[text[first]]
    digest = K.span_hash(prefix, begin + local[first], begin + local[last] + length)
    return text[first], grams[trigger[first]].view(np.int64), digest.view(np.int64), local[first], local[last]


def _parsed(length: int, gram: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column(2)):
                text, g, d, a, b = phrases(data, offsets, length, gram)
                ends = np.searchsorted(text, np.arange(j - i + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (g, d, a.astype(np.int32), b.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(np.arange(made, made + j - i)), *lists], ["doc_id", "h", "uid", "g", "d", "first", "last"])
                made += j - i

    return run


def _pieces(length: int):  # noqa: ANN202
    """The bytes of the entries that a row is to hand in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                found = batch.column(3)[r].values
                if found is None or not len(found):
                    continue
                raw = batch.column(2)[r].as_py().encode()
                g, a, b, once, block = (found.field(n) for n in ("g", "first", "last", "once", "block"))
                pieces = [raw[x : y + length] for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
                rows = pa.array(np.full(len(found), r))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), g, a, once, block, pa.array(pieces, pa.binary())], ["doc_id", "h", "g", "first", "once", "block", "bytes"])

    return run


PIECES = "doc_id bigint, h bigint, g bigint, first int, once boolean, block int, bytes binary"


def window_ranks(data: np.ndarray, offsets: np.ndarray, length: int, wanted: np.ndarray) -> np.ndarray:
    """A rank for every window of every piece, in order, -1 where no other has its bytes: a suffix array that looks length bytes far.

    Ranks of twice as many bytes come from pairs of ranks. A place whose bytes so far stand nowhere else has no equal further on
    either, so it is put aside (-1) and not sorted again. length is 8 bytes at least. Places that no wanted window's
    rank is made of aren't sorted.
    """
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    steps = [8]
    while steps[-1] < length:
        steps.append(min(2 * steps[-1], length))
    # the places whose ranks a step asks for: windows at last, and before that what their ranks are made of
    asked = np.zeros(len(data), bool)
    asked[np.flatnonzero(left >= length)[wanted]] = True
    needs = [asked]
    for step, longer in zip(steps[-2::-1], steps[:0:-1], strict=True):
        asked = asked.copy()
        asked[longer - step :] |= needs[-1][: len(data) - (longer - step)]
        needs.append(asked)
    at = np.flatnonzero(needs.pop())
    key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[at]).view(">u8").ravel().astype(np.uint64)
    for step, longer in zip(steps, [*steps[1:], 0], strict=True):
        order = np.argsort(key)
        ranked = key[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]] if len(key) else np.zeros(0, bool)
        alone = new & np.r_[new[1:], True] if len(key) else new
        rank = np.full(len(data), -1, np.int64)
        rank[at[order]] = np.where(alone, -1, np.cumsum(new) - 1)
        if longer:
            at = np.flatnonzero(needs.pop() & (rank >= 0))
            at = at[rank[at + longer - step] >= 0]
            key = rank[at] * len(data) + rank[at + longer - step]
    return rank[left >= length]


def _places(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of every piece, in order: the piece, where it begins in the pieces' bytes, and where in its document."""
    sizes = pa.compute.binary_length(batch.column("bytes")).to_numpy().astype(np.int64)
    counts = sizes - (length - 1)
    row = np.repeat(np.arange(batch.num_rows), counts)
    local = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, (np.cumsum(sizes) - sizes)[row] + local, local + batch.column("first").to_numpy().astype(np.int64)[row]


def _runs(row: np.ndarray, window: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first, last window) of the runs of windows that stand again."""
    edge = np.r_[True, row[1:] != row[:-1]]
    start = np.flatnonzero(again & (edge | ~np.r_[False, again[:-1]]))
    end = np.flatnonzero(again & (np.r_[edge[1:], True] | ~np.r_[again[1:], False]))
    return row[start], window[start], window[end]


def _pieces_hashed(batch: pa.RecordBatch, row: np.ndarray):  # noqa: ANN202
    """(first piece, end piece, first window, end window, bytes before, offsets, prefix sums) of runs of pieces of about 1 MB."""
    before = 0
    for i, j, data, offsets in K.chunks(batch.column("bytes")):
        a, b = np.searchsorted(row, [i, j])
        yield i, j, a, b, before, offsets, K.prefix_hash(data)
        before += len(data)


def _shared_parts(batch: pa.RecordBatch, row: np.ndarray, begin: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Of every window whether what it has in common with its part of the entry, the trigger within, stands in another entry too."""
    trigger = batch.column("g").to_numpy()
    cores, part = [], np.zeros(len(row), np.int64)
    n = 0
    for i, j, a, b, before, offsets, prefix in _pieces_hashed(batch, row):
        last = np.diff(offsets) - length  # last window; a trigger lies in all windows and is the last such place with its hash
        counts = length - gram - last + 1
        piece = np.repeat(np.arange(j - i), counts)
        local = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts) + last[piece]
        at = offsets[piece] + local
        hit = K.span_hash(prefix, at, at + gram).view(np.int64) == trigger[i:j][piece]
        place = np.zeros(j - i, np.int64)
        place[piece[hit]] = local[hit]
        here = row[a:b] - i
        back = offsets[here] + place[here] - (begin[a:b] - before)
        q = back // PART
        new = np.r_[True, (here[1:] != here[:-1]) | (q[1:] != q[:-1])]
        part[a:b] = np.cumsum(new) - 1 + n
        of, low = here[new], q[new] * PART
        high = np.minimum(low + PART - 1, length - gram)
        middle = offsets[of] + place[of]
        cores.append(K.span_hash(prefix, middle - low, middle - high + length))
        n += len(of)
    _, which, times = np.unique(np.concatenate(cores), return_inverse=True, return_counts=True)
    return (times > 1)[which][part]


def _ordered(length: int, gram: int, buckets: int = 0):  # noqa: ANN202
    """All entries of some triggers or of some of their blocks: suffix array, and what of them is repeated.

    With buckets, a row for each of them too: the fingerprints of the distinct windows that fall there, to be held against other tasks'.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        raw = batch.column("bytes").to_pylist()
        offsets = np.r_[0, np.cumsum([len(v) for v in raw])]
        data = np.frombuffer(b"".join(raw), np.uint8)
        del raw
        row, begin, window = _places(batch, length)
        rank = window_ranks(data, offsets, length, _shared_parts(batch, row, begin, length, gram))
        once = batch.column("once").to_numpy(zero_copy_only=False)[row]
        piece, first, last = _runs(row, window, (rank >= 0) & once)
        which = pa.array(piece)
        ranges = [batch.column("doc_id").take(which), batch.column("h").take(which), pa.array(first), pa.array(last + length)]
        if not buckets:
            yield pa.RecordBatch.from_arrays(ranges, ["doc_id", "h", "start", "end"])
            return
        names = ["doc_id", "h", "start", "end", "bucket", "task", "windows"]
        yield pa.RecordBatch.from_arrays([*ranges, *[pa.nulls(len(piece), t) for t in (pa.int32(), pa.int32(), pa.list_(WINDOW))]], names)
        several = np.flatnonzero(rank >= 0)
        named = np.zeros(len(row), bool)
        named[rank < 0] = True
        named[several[np.unique(rank[several], return_index=True)[1]]] = True
        mark = np.zeros(len(row), np.int64)
        for _, _, a, b, before, _, prefix in _pieces_hashed(batch, row):
            mark[a:b] = K.span_hash(prefix, begin[a:b] - before, begin[a:b] - before + length).view(np.int64)
        one = np.flatnonzero(named)
        bucket = (mark[one].view(K.U) % K.U(buckets)).astype(np.int64)
        one = one[np.argsort(bucket, kind="stable")]
        which = pa.array(row[one])
        fields = [pa.array(mark[one]), *[batch.column(n).take(which) for n in ("doc_id", "h", "g", "first")], pa.array(window[one]), pa.array((rank[one] < 0) & once[one])]
        ends = np.r_[0, np.cumsum(np.bincount(bucket, minlength=buckets))].astype(np.int32)
        full = pa.array(np.flatnonzero(np.diff(ends)))
        lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, fields=list(WINDOW))).take(full)
        task = pa.array(np.full(len(full), TaskContext.get().partitionId(), np.int32))
        yield from pa.Table.from_arrays([*[pa.nulls(len(full), pa.int64())] * 4, full.cast(pa.int32()), task, lists], names).to_batches(max_chunksize=100)

    return run


WINDOW = pa.struct([("mark", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("first", pa.int32()), ("start", pa.int64()), ("alone", pa.bool_())])
WINDOW_SQL = "mark: bigint, doc_id: bigint, h: bigint, g: bigint, first: int, start: bigint, alone: boolean"


def _named_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows whose fingerprint two tasks name, of some buckets. A task names none twice."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    lists = pa.concat_arrays([b.column("windows") for b in held])
    task = np.repeat(np.concatenate([b.column("task").to_numpy() for b in held]), pa.compute.list_value_length(lists).to_numpy())
    windows = lists.flatten()
    _, which, times = np.unique(windows.field("mark").to_numpy(), return_inverse=True, return_counts=True)
    met = pa.array(np.flatnonzero((times > 1)[which]))
    names = ["doc_id", "h", "g", "first", "start", "alone"]
    yield from pa.Table.from_arrays([*[windows.field(n).take(met) for n in names], pa.array(task).take(met)], [*names, "task"]).to_batches(max_chunksize=100_000)


RANGES = "doc_id bigint, h bigint, start bigint, end bigint"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(keep_text: bool, length: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                raw = (batch.column(2)[r].as_py() or "").encode()
                whole = [(s["first"], s["last"] + length) for s in batch.column(3)[r].as_py() or []]
                spans = _merged(whole + [(s["start"], s["end"]) for s in batch.column(4)[r].as_py() or []])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                cols = [batch.column(0)[r : r + 1], pa.array([len(raw)], pa.int64()), pa.array([len(raw) - len(left)], pa.int64()), pa.array([len(spans)], pa.int64()), pa.array([hashlib.sha256(left).hexdigest()])]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if keep_text:
                    cols += [pa.array([left], pa.binary()), pa.array([[{"start": a, "end": b} for a, b in spans]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                    names += ["kept", "spans"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _same_row(a: str, b: str):  # noqa: ANN202
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))


def _across_blocks(docs: DataFrame, found: DataFrame, length: int, gram: int) -> DataFrame | None:
    """Ranges of bytes under repeated windows of the triggers that are dealt into blocks; None where there are none."""
    dealt = found.where(F.size("dealt") > 0).select("doc_id", "h", F.col("dealt").alias("found"))
    rows, entries = dealt.agg(F.count("*"), F.coalesce(F.sum(F.size("found")), F.lit(0))).first()
    if not rows:
        return None
    if rows <= BROADCAST_ROWS:  # other texts needn't be shuffled
        docs = docs.join(F.broadcast(dealt.select("h").distinct()), "h", "left_semi").select("doc_id", "h", "text")
    d, f = docs.alias("d"), dealt.alias("f")
    pieces = d.join(f, _same_row("d", "f")).select("d.doc_id", "d.h", "d.text", "f.found").mapInArrow(_pieces(length), PIECES)
    pieces = written(pieces, "pieces")
    tasks = max(partitions(docs.sparkSession), -(-entries * 2 * length // TASK_BYTES))
    buckets = 1 + entries * (length - gram + 1) * 40 // TASK_BYTES
    ordered = pieces.repartition(tasks, "g", "block").mapInArrow(_ordered(length, gram, buckets), f"{RANGES}, bucket int, task int, windows array<struct<{WINDOW_SQL}>>")
    ordered = written(ordered, "ordered")
    named = ordered.where("bucket IS NOT NULL").select("bucket", "task", "windows").repartition(buckets, "bucket")
    named = named.mapInArrow(_named_twice, "doc_id bigint, h bigint, g bigint, first int, start bigint, alone boolean, task int")
    # an entry has no more windows than a trigger has places in one
    asked = named.groupBy("doc_id", "h", "g", "first").agg(F.collect_set(F.struct("start", "alone", "task")).alias("asked"))
    p, a = pieces.alias("p"), asked.alias("a")
    windows = p.join(a, _same_row("p", "a") & (F.col("p.g") == F.col("a.g")) & (F.col("p.first") == F.col("a.first")))
    windows = windows.select("p.doc_id", "p.h", "p.g", "p.first", "p.bytes", F.inline("a.asked"))
    windows = written(windows.select("doc_id", "h", "g", "task", "start", "alone", F.expr(f"substring(bytes, int(start - first + 1), {length})").alias("window")), "windows")
    let_go(pieces)
    equal = windows.groupBy("g", "window").agg((F.min("task") < F.max("task")).alias("two")).where("two").select("g", "window")
    again = windows.where("alone").join(equal, ["g", "window"], "left_semi").select("doc_id", "h", "start", (F.col("start") + length).alias("end"))
    return ordered.where("bucket IS NULL").select("doc_id", "h", "start", "end").unionByName(again)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; with keep_text the bytes kept and the spans removed too."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text")
    parsed = written(docs.mapInArrow(_parsed(length, gram), "doc_id bigint, h bigint, uid bigint, g array<bigint>, d array<bigint>, first array<int>, last array<int>"), "parsed")
    entries = parsed.select("uid", F.inline(F.arrays_zip("g", "d"))).groupBy("g", "d").agg(F.count("*").alias("n"), F.min("uid").alias("from"))
    entries = written(entries, "entries")
    of = entries.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.min("n").alias("least")).where("total > 1")
    block = F.when(F.col("kinds") > BLOCK, F.pmod("d", F.ceil(F.col("kinds") / BLOCK)).cast("int"))
    known = written(entries.join(of, "g").select("g", "d", "n", "from", ((F.col("kinds") > 1) & (F.col("least") == 1)).alias("sorted"), block.alias("block")), "dictionary")
    each = parsed.select("doc_id", "h", "uid", F.inline(F.arrays_zip("g", "d", "first", "last"))).join(known, ["g", "d"])
    let_go(entries)
    # what stands twice is gone as a whole; what is to be sorted is handed in by the first row that has it
    handed = F.col("sorted") & (F.col("uid") == F.col("from"))
    entry = F.struct("g", "first", "last", (F.col("n") == 1).alias("once"), "block")
    found = each.groupBy("doc_id", "h").agg(
        F.collect_set(F.when(F.col("n") > 1, F.struct("first", "last"))).alias("whole"),
        F.collect_set(F.when(handed & F.isnull("block"), entry)).alias("found"),
        F.collect_set(F.when(handed & F.isnotnull("block"), entry)).alias("dealt"),
        F.sum(F.when(handed & F.isnull("block"), F.col("last") - F.col("first") + length).otherwise(0)).alias("size"),
    )
    found = written(found, "found")
    let_go(parsed, known)
    size = found.agg(F.sum("size")).first()[0] or 0
    tasks = max(partitions(docs.sparkSession), -(-size // TASK_BYTES))
    d, f = docs.alias("d"), found.alias("f")
    # left, like the join at the end, so that the texts are dealt out once for both
    texts = d.join(f, _same_row("d", "f"), "left").select("d.doc_id", "d.h", "d.text", "f.found", "f.whole")
    pieces = texts.select("doc_id", "h", "text", "found").mapInArrow(_pieces(length), PIECES)
    ranges = pieces.repartition(tasks, "g").mapInArrow(_ordered(length, gram), RANGES)
    across = _across_blocks(docs, found, length, gram)
    ranges = ranges if across is None else ranges.unionByName(across)
    ranges = ranges.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    kind = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary, spans array<struct<start: bigint, end: bigint>>" if keep_text else "")
    t, r = texts.alias("t"), ranges.alias("r")
    return t.join(r, _same_row("t", "r"), "left").select("t.doc_id", "t.text", "t.h", "t.whole", "r.spans").select("doc_id", "h", "text", "whole", "spans").mapInArrow(_cut(keep_text, length), kind)


def query(spark, sf_dir):  # noqa: ANN001, ANN201
    from .shared import table

    return without_repeats(table(spark, sf_dir, "documents"))
