"""Embedding whitening: covariance in two passes, symmetric eigenvectors, and a projection that every task gets by broadcast.

Entries become integers x = floor(SCALE c) + OFFSET. The first pass sums them exactly, which gives the mean as S = n m + r with
integers m and 0 <= r < n. The second centres, (x - m) - r / n, and sums the outer products of a batch by one matrix product.
What tasks found is merged by treeAggregate, so that neither the driver nor a task takes in more than a few d x d matrices at
once. The driver finds the eigenvectors (LAPACK, symmetric). A third pass measures the covariance of the projected vectors: each
batch is centred on its own mean, and (n, mean, sum of products) of two sets merge without going back to the rows.

Nothing is shuffled but matrices of d x d; the number of rows bounds no memory. d is a few thousand at most: the matrices are
8 d^2 bytes.

Defined results: a row whose vector is null or holds a null or a number that isn't finite is dropped. The vectors' length is the
most frequent one (of several the greatest); others are dropped. |SCALE c| beyond 2^40 counts as 2^40. A deviation that doesn't
fit a long is null. A component whose eigenvalue is 0 but for rounding (at most d times the double's precision of the greatest)
has null in whitened and is left out of identity_error, which is null if none is left; explained is null where the trace is 0.
Signs are such that a component's largest entry is positive. Repeated and null ids are rows like others. Other columns are not
read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import Lists, floored, tree

SCALE, OFFSET = 64, 1_000_000
LIMIT = 1 << 40
COMPONENTS = 32
#: So many rows' sums of numbers up to LIMIT fit a long.
SUM_ROWS = 1 << 22

Moments = tuple[int, np.ndarray, np.ndarray]


def entries(values: np.ndarray) -> np.ndarray:
    return floored(values, SCALE, LIMIT) + OFFSET


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, n, sums) of vectors of each length; whole numbers all through."""
    found: dict[int, list] = {}

    def rows(which: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"d": which, "n": [found[d][0] for d in which], "sums": [found[d][1].tolist() for d in which]}, pa.schema([("d", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    for batch in batches:
        lists = Lists(batch.column(0))
        for d in np.unique(lists.length[lists.length >= 0]).tolist():
            for part, values in lists.matrices(d):
                had = found.setdefault(d, [0, np.zeros(d, np.int64)])
                had[0] += len(part)
                had[1] += entries(values).sum(0)
                if had[0] >= SUM_ROWS:
                    yield rows([d])
                    del found[d]
    if found:
        yield rows(list(found))


def merged(a: Moments, b: Moments) -> Moments:
    """(n, mean, sum of products of what is centred on it) of two sets together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * (b[0] / n))


def moments(z: np.ndarray) -> Moments:
    mean = z.mean(0)
    c = z - mean
    return len(z), mean, c.T @ c


@dataclass
class Whitening:
    n: int
    sums: list[int]
    #: All eigenvalues, falling; the eigenvectors of the first components are the columns of axes.
    values: np.ndarray
    axes: np.ndarray
    trace: float
    #: Components that are more than rounding.
    whole: int
    column: str = "embedding"
    identity_error: float | None = None

    @property
    def explained(self) -> list[float | None]:
        return [float(e) / self.trace if self.trace else None for e in self.values[: self.axes.shape[1]]]

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The floors of the means, and what is left of them."""
        m = [s // self.n for s in self.sums]
        return np.array(m, np.int64), np.array([(s - k * self.n) / self.n for s, k in zip(self.sums, m, strict=True)])

    def projection(self) -> np.ndarray:
        return self.axes[:, : self.whole] / np.sqrt(self.values[: self.whole])

    def projected(self, vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
        """(id, deviation, whitened: array<double>) of all rows that the fit has kept."""
        n, d, k = self.n, len(self.sums), self.axes.shape[1]
        shared = vectors.sparkSession.sparkContext.broadcast((*self.centre(), self.projection(), [s % n for s in self.sums]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, rest, turn, left = shared.value
            for batch in batches:
                for rows, values in Lists(batch.column(1)).matrices(d):
                    gap = entries(values) - m
                    z = np.full((len(rows), k), np.nan)
                    z[:, : turn.shape[1]] = (gap - rest) @ turn
                    flat = pa.array(z.ravel(), mask=np.isnan(z).ravel())
                    white = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), flat)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), deviations(gap, n, left), white], [id_col, "deviation", "whitened"])

        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.select(id_col, self.column).mapInArrow(run, f"`{id_col}` {kind}, deviation bigint, whitened array<double>")


def deviations(gap: np.ndarray, n: int, left: list[int]) -> pa.Array:
    """Of each row the sum of (n gap - left)^2; null if it doesn't fit a long."""
    most = int(np.abs(gap).max(initial=0)) + 1
    if (n * most) ** 2 * max(1, gap.shape[1]) < 1 << 63:
        return pa.array((((n * gap) - np.array(left, np.int64)) ** 2).sum(1))
    exact = (((gap.astype(object) * n) - np.array(left, object)) ** 2).sum(1)
    return pa.array([int(x) if x < 1 << 63 else None for x in exact], pa.int64())


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors; None if there are none."""
    rows = vectors.select(column)
    by_length = tree(
        rows.mapInArrow(_sums, "d bigint, n bigint, sums array<bigint>"),
        lambda a, b: a | {d: (a[d][0] + n, [x + y for x, y in zip(a[d][1], s, strict=True)]) if d in a else (n, s) for d, (n, s) in b.items()},
        lambda r: {r["d"]: (r["n"], list(r["sums"]))},
    )
    if not by_length:
        return None
    d = max(by_length, key=lambda k: (by_length[k][0], k))
    n, sums = by_length[d]
    out = Whitening(n, sums, np.zeros(d), np.zeros((d, 0)), 0.0, 0, column)
    context = vectors.sparkSession.sparkContext
    centre = context.broadcast(out.centre())

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, rest = centre.value
        total = np.zeros((d, d))
        for batch in batches:
            for _, values in Lists(batch.column(0)).matrices(d):
                c = (entries(values) - m) - rest
                total += c.T @ c
        yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

    v = tree(rows.mapInArrow(products, "total binary"), np.add, lambda r: np.frombuffer(r["total"]).reshape(d, d)) / n
    values, axes = np.linalg.eigh((v + v.T) / 2) if d else (np.zeros(0), np.zeros((0, 0)))
    values, axes = values[::-1], axes[:, ::-1][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0) if d else axes
    out.values, out.axes, out.trace = values, axes, float(np.trace(v))
    out.whole = int((values[:components] > d * np.finfo(float).eps * values.max(initial=0)).sum())
    turn = context.broadcast(out.projection())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, rest = centre.value
        found = None
        for batch in batches:
            for _, values in Lists(batch.column(0)).matrices(d):
                here = moments(((entries(values) - m) - rest) @ turn.value)
                found = here if found is None else merged(found, here)
        if found:
            yield pa.RecordBatch.from_pydict({"n": [found[0]], "mean": [found[1].tobytes()], "products": [found[2].tobytes()]})

    if out.whole:
        k = out.whole
        _, _, got = tree(rows.mapInArrow(spread, "n bigint, mean binary, products binary"), merged, lambda r: (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["products"]).reshape(k, k)))
        out.identity_error = float(np.abs(got / n - np.eye(k)).max())
    return out


def whitened(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    model = fit(vectors, column, components)
    if model is None:
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    rows = model.projected(vectors, id_col).select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.array(*[F.lit(e).cast("double") for e in model.explained]) if model.explained else F.array().cast("array<double>")
    return rows.select(id_col, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))


def query(spark, sf_dir):  # noqa: ANN001, ANN201
    from .shared import table

    return whitened(table(spark, sf_dir, "embeddings"))
