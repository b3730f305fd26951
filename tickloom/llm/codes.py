"""Vector code compression: product codes whose codebooks are found by Lloyd rounds, with Elkan's bounds kept between them.

Components become integers floor(SCALE x); a vector is cut into PARTS equal parts, each with a codebook of ENTRIES integer entries.
Of each part the state table keeps its entry, an upper bound of the distance to it, and a lower bound of the distance to every
entry. Before a round, bounds shift by how far the entries moved. Then a part can change only if its upper bound reaches half the
distance from its entry to the nearest other one; if so, its own distance is found, and of the other entries only those whose lower
bound, and half of whose distance from its entry, are not above it. All pruning is strict, and bounds are rounded outwards, so
an entry as near as the best is always compared; distances are whole squared numbers, and ties go to the lower index. The first
round compares all.

Bounds take 2 bytes an entry (half floats, rounded down) and 4 bytes a part. Each round reads the state of the round before and writes
its own, in place of the other; a lost executor costs a re-read. New entries come from whole sums a partition, merged by treeAggregate.
Codebooks and their distances are the size of the codebook, whatever the table; each round sends them to the tasks.

Defined results: a row whose vector is null or holds a null or a number that isn't finite is dropped. The vectors' length is the most
frequent one (of several the greatest); others are dropped. A length that PARTS doesn't divide is filled up with zeros. |SCALE x|
beyond 2^26 counts as 2^26. Codebooks start from the smallest ids (null last; equal ids by their vectors); with fewer vectors than
ENTRIES they have that many entries. Repeated ids are rows like others. Errors are exact for 2^37 vectors. Other columns are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import let_go, looked_up, written
from .vectors import CHUNK_ROWS, Lists, floored, length_of, tree

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
LIMIT = 1 << 26
#: Bounds give way by so much, more than their rounding in doubles.
SLACK = 1e-5


def up(x: np.ndarray) -> np.ndarray:
    """x as 4-byte floats that are not below it."""
    y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)


def down(x: np.ndarray) -> np.ndarray:
    """x as 2-byte floats that are not above it, nor below 0."""
    x = np.clip(x, 0, 65504)
    y = x.astype(np.float16)
    return np.where(y > x, np.nextafter(y, np.float16(0)), y).astype(np.float16)


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) ** 2 * 4 * max(1, x.shape[1]) < 1 << 53:  # doubles hold all sums
        a, b = x.astype(float), book.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in book], 1)


@dataclass
class Book:
    """One part's entries, how far each has moved at most, and how far they are from each other at least."""

    entries: np.ndarray
    moved: np.ndarray

    def __post_init__(self) -> None:
        gaps = np.sqrt(squares(self.entries, self.entries).astype(float)) - SLACK
        np.fill_diagonal(gaps, np.inf)
        self.half_gaps = gaps / 2
        self.half_nearest = self.half_gaps.min(1)

    def replaced(self, sums: np.ndarray, counts: np.ndarray) -> Book:
        new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], self.entries)
        return Book(new, np.sqrt(((new - self.entries) ** 2).sum(1).astype(float)) + SLACK)


def first(x: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper bound, lower bounds) of each row, all entries compared."""
    d = squares(x, book.entries)
    at = d.argmin(1)
    return at, up(np.sqrt(d[np.arange(len(x)), at].astype(float)) + SLACK), down(np.sqrt(d.astype(float)) - SLACK)


def again(x: np.ndarray, book: Book, at: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same from the bounds of the round before, and how many distances were found for it."""
    at, high, low = at.copy(), up(high.astype(float) + book.moved[at] + SLACK), down(low.astype(float) - book.moved - SLACK)
    todo = np.flatnonzero(~(high < book.half_nearest[at]))
    if not len(todo):
        return at, high, low, 0
    mine = at[todo]
    own = ((x[todo] - book.entries[mine]) ** 2).sum(1)
    reach = up(np.sqrt(own.astype(float)) + SLACK)
    low[todo, mine] = down(np.sqrt(own.astype(float)) - SLACK)
    near = (low[todo] <= reach[:, None]) & (book.half_gaps[mine] <= reach[:, None])
    near[np.arange(len(todo)), mine] = False
    row, entry = np.nonzero(near)
    d = np.empty(len(row), np.int64)
    for i in range(0, len(row), CHUNK_ROWS * 16):
        j = slice(i, i + CHUNK_ROWS * 16)
        d[j] = ((x[todo[row[j]]] - book.entries[entry[j]]) ** 2).sum(1)
    low[todo[row], entry] = down(np.sqrt(d.astype(float)) - SLACK)
    best = own.copy()
    np.minimum.at(best, row, d)
    choice = np.where(own == best, mine, len(book.entries))
    tied = d == best[row]
    np.minimum.at(choice, row[tied], entry[tied])
    at[todo], high[todo] = choice, up(np.sqrt(best.astype(float)) + SLACK)
    return at, high, low, len(todo) + len(row)


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    size = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * size), pa.py_buffer(x)])


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, kind, offset=int(at[0]), count=len(column) * width).reshape(len(column), width) if width and len(column) else np.zeros((len(column), width), kind)


def _state(kind: list[str]) -> str:
    return f"vec_id {kind[0]}, label {kind[1]}, x binary, at binary, high binary, low binary"


def _whole(rows: DataFrame, d: int, width: int, kind: list[str]) -> DataFrame:
    """(vec_id, label, x) with whole components, filled up to PARTS * width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in Lists(batch.column(2)).matrices(d):
                x = np.zeros((len(part), PARTS * width), np.int32)
                x[:, :d] = floored(values, SCALE, LIMIT)
                where = pa.array(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), _binary(x)], ["vec_id", "label", "x"])

    return rows.mapInArrow(run, f"vec_id {kind[0]}, label {kind[1]}, x binary")


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, CHUNK_ROWS) for i in range(0, batch.num_rows, CHUNK_ROWS))


def _assigned(state: DataFrame, books: list[Book], width: int, kind: list[str], start: bool) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(books)
    n = len(books[0].entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (c for b in batches for c in _chunks(b)):
            x = _matrix(batch.column(2), np.int32, PARTS * width).astype(np.int64)
            if not start:
                was = _matrix(batch.column(3), np.uint8, PARTS), _matrix(batch.column(4), np.float32, PARTS), _matrix(batch.column(5), np.float16, PARTS * n)
            at, high, low = np.empty((len(x), PARTS), np.uint8), np.empty((len(x), PARTS), np.float32), np.empty((len(x), PARTS * n), np.float16)
            for p, book in enumerate(shared.value):
                own, bounds = x[:, p * width : (p + 1) * width], slice(p * n, (p + 1) * n)
                if start:
                    at[:, p], high[:, p], low[:, bounds] = first(own, book)
                else:
                    at[:, p], high[:, p], low[:, bounds], _ = again(own, book, was[0][:, p].astype(np.int64), was[1][:, p], was[2][:, bounds])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _binary(at), _binary(high), _binary(low)], ["vec_id", "label", "x", "at", "high", "low"])

    return state.mapInArrow(run, _state(kind))


def _moved(state: DataFrame, books: list[Book], width: int) -> list[Book]:
    """The codebooks with each entry replaced by the mean of its parts."""
    n = len(books[0].entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((PARTS, n, width), np.int64), np.zeros((PARTS, n), np.int64)
        for batch in (c for b in batches for c in _chunks(b)):
            x, at = _matrix(batch.column(0), np.int32, PARTS * width), _matrix(batch.column(1), np.uint8, PARTS)
            for p in range(PARTS):
                counts[p] += np.bincount(at[:, p], minlength=n)
                for j in range(width):  # doubles hold the sums of a chunk
                    sums[p, :, j] += np.bincount(at[:, p], weights=x[:, p * width + j], minlength=n).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"sums": [sums.tobytes()], "counts": [counts.tobytes()]})

    partials = state.select("x", "at").mapInArrow(run, "sums binary, counts binary")
    read = lambda b, shape: np.frombuffer(b, np.int64).reshape(shape)
    sums, counts = tree(partials, lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda r: (read(r["sums"], (PARTS, n, width)), read(r["counts"], (PARTS, n))))
    return [b.replaced(s, c) for b, s, c in zip(books, sums, counts, strict=True)]


def _measured(state: DataFrame, books: list[Book], width: int, kind: list[str]) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast([b.entries for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (c for b in batches for c in _chunks(b)):
            x, at = _matrix(batch.column(2), np.int32, PARTS * width).astype(np.int64), _matrix(batch.column(3), np.uint8, PARTS)
            error = sum(((x[:, p * width : (p + 1) * width] - entries[at[:, p]]) ** 2).sum(1) for p, entries in enumerate(shared.value))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([r.tobytes().hex() for r in at]), pa.array(error)], ["vec_id", "label", "code", "error"])

    return state.select("vec_id", "label", "x", "at").mapInArrow(run, f"vec_id {kind[0]}, label {kind[1]}, code string, error bigint")


def digest(books: list[np.ndarray]) -> str:
    """Of all entries' components in decimal, by part, entry and position, between commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every vector, and each part's codebook."""
    kind = [vectors.schema[c].dataType.simpleString() for c in (id_col, label)]
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"), column)
    d = length_of(rows, column)
    if d is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind[0]}, label {kind[1]}, code string, error bigint"), []
    width = -(-d // PARTS)
    state = written(_whole(rows, d, width, kind), "vectors")
    start = state.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    seeds = np.array([np.frombuffer(r["x"], np.int32) for r in start], np.int64).reshape(len(start), PARTS, width)
    books = [Book(np.ascontiguousarray(seeds[:, p]), np.zeros(len(start))) for p in range(PARTS)]
    for k in range(rounds + 1):
        before, state = state, written(_assigned(state, books, width, kind, k == 0), "assigned")
        let_go(before)
        if k < rounds:
            books = _moved(state, books, width)
    out = written(_measured(state, books, width, kind), "codes")
    let_go(state)
    return out, [b.entries for b in books]


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error: the errors of all rows of an equal label together."""
    labels = written(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n_rows")), "label_errors")
    return looked_up(codes, labels, "label", "n_rows", labels.agg(F.sum("n_rows")).first()[0] or 0)


def query(spark, sf_dir):  # noqa: ANN001, ANN201
    from .shared import table

    codes, books = compressed(table(spark, sf_dir, "embeddings"))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
