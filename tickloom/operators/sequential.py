"""Grouped application of the folds: one series in order at a time, streamed through its state.

Guards, gates, deadbands and scores cut a series into slices that many tasks work on (``chunked``). Renko keeps one task a ticker: where
its bricks stand follows from the first one for good, so no slice can begin on its own. Rows come to Python in Arrow batches,
already sorted by Spark, so memory holds a batch and the state, not the series.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import exprs as X
from ..functions import folds
from ..session import dealt
from .chunked import arrow, by_row, composed, segments, speculated


def fold_rows(df: DataFrame, key: str, order: list[str], schema: str, make: Callable, step: Callable) -> DataFrame:
    """step(state, row) gives the output rows for one input row; make() gives a key's first state. Keys are hashed to tasks, sorted there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if getattr(row, key) != now:
                    now, state = getattr(row, key), make()
                out += step(state, row)
            yield pd.DataFrame(out, columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    return dealt(df, key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def kept_rows(df: DataFrame, key: str, order: list[str], value: str, make: Callable) -> DataFrame:
    """The rows, with all their columns, whose value a key's fold accepts: accepts(values) gives a mask and moves the state on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = object(), None
        for batch in batches:
            keys, values = batch.column(k).to_pylist(), batch.column(v).to_numpy(zero_copy_only=False)
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            mask = np.zeros(len(keys), bool)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    if keys[a] != now:
                        now, fold = keys[a], make()
                    mask[a:b] = fold.accepts(values[a:b])
            yield batch.filter(pa.array(mask))

    k, v = df.columns.index(key), df.columns.index(value)
    return dealt(df, key).sortWithinPartitions(key, *order).mapInArrow(run, df.schema)


#: Series are cut into slices of an hour, or of so many sequence numbers where those are their order.
SLICE_MS = 3_600_000
SLICE_ROWS = 1_000_000


def folded(df: DataFrame, order: list[str], schema: str, make: Callable, step: Callable, width: int) -> DataFrame:
    """fold_rows by ticker, in many tasks a ticker."""
    kind = StructType.fromDDL(schema)
    return speculated(df, "ticker", order, kind, make, by_row(arrow(kind), step), width)


def guarded(ticks: DataFrame, ts: str = "tc_ms", value: str = "mid", slice_ms: int = SLICE_MS, parallel: bool = False) -> DataFrame:
    """The rows that the two-fold guard accepts, with all their columns; nulls and insane prices are not. Null tickers are a series.

    A row can only be refused if prices more than a factor of two apart stand in its slice of time or the one before that has
    any. That is two minima a slice, summed where the rows are; only tickers with such a slice are folded, one task each, or with
    parallel by slices, which runs jobs at once.
    """
    rows = ticks.where(X.sane_px(value))
    spans = rows.groupBy("ticker", X.bucket(ts, slice_ms).alias("_s")).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    w = Window.partitionBy("ticker").orderBy("_s")
    lo, hi = (F.coalesce(F.lag(c).over(w), F.col(c)) for c in ("lo", "hi"))
    wide = spans.withColumn("_r", F.greatest("hi", hi) / F.least("lo", lo)).where("_r > 2").select(F.col("ticker").alias("_wide")).distinct()
    same = F.col("ticker").eqNullSafe(F.col("_wide"))
    still, moving = rows.join(wide, same, "left_anti"), rows.join(wide, same, "left_semi")
    if parallel:
        moving = speculated(moving, "ticker", [ts, "seq"], moving.schema, folds.SaneMid, lambda s, r: r.filter(pa.array(s.accepts(r.column(value).to_numpy(zero_copy_only=False)))), slice_ms)
    else:
        moving = kept_rows(moving, "ticker", [ts, "seq"], value, folds.SaneMid)
    return still.unionByName(moving)


def sane_mids(ticks: DataFrame, ts: str = "tc_ms", value: str = "mid", slice_ms: int = SLICE_MS) -> DataFrame:
    """(ticker, ts, seq, mid) of the rows that the two-fold guard accepts."""
    return guarded(ticks.select("ticker", F.col(ts).alias("ts"), "seq", F.col(value).cast("double").alias("mid")), "ts", slice_ms=slice_ms, parallel=True)


class _Scores(folds.ScoreMap):
    def add(self, rows: pa.RecordBatch) -> None:
        super().add(rows.column("mid").to_numpy())


def zscores(ticks: DataFrame, ts: str = "tc_ms", floor_bps: float = 0.0, slice_ms: int = SLICE_MS) -> DataFrame:
    """(ticker, ts, seq, z); null mids are left out. Means and variances of slices compose, so a ticker's slices are scored in many tasks."""
    rows = ticks.where(F.col("mid").isNotNull()).select("ticker", F.col(ts).alias("ts"), "seq", F.col("mid").cast("double").alias("mid"))
    kind = StructType.fromDDL("ticker string, ts bigint, seq bigint, z double")
    names = kind.names

    def advance(s, r):  # noqa: ANN001, ANN202
        x = r.column("mid").to_numpy()
        return pa.RecordBatch.from_arrays([*r.columns[:3], pa.array(s.scores(x, x * floor_bps * 1e-4))], names)

    return composed(rows, "ticker", ["ts", "seq"], kind, folds.RunningStats, _Scores, advance, slice_ms)


def z_gated(ticks: DataFrame, limit: float = 4.0, floor_bps: float = 2.0) -> DataFrame:
    return zscores(ticks, floor_bps=floor_bps).where(F.col("z") <= limit)


def _mids(ticks: DataFrame, ts: str, value: str = "mid") -> DataFrame:
    return ticks.where(F.col(value).isNotNull()).select("ticker", F.col(ts).alias("ts"), "seq", F.col(value).cast("double").alias("mid"))


def jump_guarded(ticks: DataFrame, frac: float = 0.05, limit: int = 30, ts: str = "tc_ms", value: str = "mid", slice_ms: int = SLICE_MS) -> DataFrame:
    """(ticker, ts, seq, mid) of what the guard accepts; null prices are left out, here and below."""
    return folded(_mids(ticks, ts, value), ["ts", "seq"], "ticker string, ts bigint, seq bigint, mid double", lambda: folds.JumpGuard(frac, limit), lambda s, r: [(r.ticker, r.ts, r.seq, r.mid)] if s.accept(r.mid) else [], slice_ms)


def deadband(ticks: DataFrame, eps_bps: float, ts: str = "tc_ms", slice_ms: int = SLICE_MS) -> DataFrame:
    return folded(_mids(ticks, ts), ["ts", "seq"], "ticker string, ts bigint, seq bigint, mark double", lambda: folds.Deadband(eps_bps), lambda s, r: [(r.ticker, r.ts, r.seq, s.next(r.mid))], slice_ms)


def peg_confirmed(ticks: DataFrame, ts: str = "tc_ms", bps: float = 4.0, slice_ms: int = SLICE_MS) -> DataFrame:
    return folded(_mids(ticks, ts), ["ts", "seq"], "ticker string, ts bigint, seq bigint, mark double", lambda: folds.PegConfirm(bps), lambda s, r: [(r.ticker, r.ts, r.seq, s.next(r.ts, r.mid))], slice_ms)


def basis_gate(minutes: DataFrame, run: int, slice_ms: int = SLICE_MS) -> DataFrame:
    """(ticker, ts, seq, breach) rows, one a minute, to whether the provider is in; a null breach is none."""
    rows = minutes.select("ticker", "ts", "seq", F.coalesce("breach", F.lit(False)).alias("breach"))
    return folded(rows, ["ts", "seq"], "ticker string, ts bigint, seq bigint, admitted boolean", lambda: folds.BasisGate(run), lambda s, r: [(r.ticker, r.ts, r.seq, s.next(r.breach))], slice_ms)


def delta_gated(rows: DataFrame, sentinel_ms: int = 60_000, ts: str = "tc_ms", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """What a delta-gated store writes: changed rows, a row each day, and copies flagged 1 in quiet times."""
    rows = rows.select("ticker", F.col(ts).alias("ts"), "seq", "bid", "ask", "vbid", "vask", "ci")

    def step(s, r):  # noqa: ANN001, ANN202
        flag = s.next(r.ts, (r.bid, r.ask, r.vbid, r.vask, r.ci))
        return [] if flag is None else [(r.ticker, r.ts, r.seq, r.bid, r.ask, flag)]

    return folded(rows, ["seq"], "ticker string, ts bigint, seq bigint, bid double, ask double, flags int", lambda: folds.DeltaGate(sentinel_ms), step, slice_rows)


def time_bounded(rows: DataFrame, now_ms: int, ts: str = "tc_ms", flags: str = "flags") -> DataFrame:
    """Adds ``quarantine``: later than a minute from now, or older than 730 days and not a backfill."""
    late = F.col(ts) > now_ms + 60_000
    old = (F.col(ts) < now_ms - 730 * 86_400_000) & ~X.has_flag(flags, X.INDEX_FLAGS["HISTORICAL_BACKFILL"])
    return rows.withColumn("quarantine", F.when(late, "future").when(old, "past"))


LEG_STATE = "last_update bigint, live_at bigint, joined bigint, ema_ipi double, last_gap double, injected boolean"


LEGS = f"ticker string, provider bigint, leg string, ts bigint, seq bigint, bid double, ask double, vbid double, vask double, {LEG_STATE}"


def leg_states(ticks: DataFrame, ts: str = "tc_ms") -> DataFrame:
    """The state of each (ticker, provider) leg after each frame. A ``kind`` column (tick, carry, inject), where there is one, decides.

    A leg's frames are one fold, so a ticker is split by its providers. Without kinds all follows from the gaps between frames, whose
    exponential mean is taken over a batch at once. Null prices count as frames and are refused by the composite; null times are left out.
    """
    rows = ticks.where(F.col(ts).isNotNull()).select("ticker", F.col("provider").cast("long").alias("provider"), F.concat_ws("|", "ticker", "provider").alias("leg"), F.col(ts).cast("long").alias("ts"), F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("double").alias(c) for c in ("bid", "ask", "vbid", "vask")])
    if "kind" not in ticks.columns:
        return dealt(rows, "leg").sortWithinPartitions("leg", "ts", "seq").mapInArrow(_steady_legs, LEGS)
    rows = ticks.where(F.col(ts).isNotNull()).select("ticker", "provider", F.concat_ws("|", "ticker", "provider").alias("leg"), F.col(ts).alias("ts"), "seq", "bid", "ask", "vbid", "vask", F.coalesce("kind", F.lit("tick")).alias("kind"))

    def step(s, r):  # noqa: ANN001, ANN202
        s.update(r.ts, r.bid, r.ask, r.vbid, r.vask, r.kind)
        return [(r.ticker, r.provider, r.leg, r.ts, r.seq, s.bid, s.ask, s.vbid, s.vask, s.last_update, s.live_at, s.joined, s.ema_ipi, s.last_gap, s.injected)]

    return fold_rows(rows, "leg", ["ts", "seq"], LEGS, folds.LegState, step)


def _steady_legs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LegState of legs that only tick: (joined, last time, mean gap) is all that goes on from batch to batch."""
    now, state = None, None
    names = [c.split()[0] for c in LEGS.split(", ")]
    for batch in batches:
        for (leg,), part in segments(batch, [2]):
            at = part.column("ts").to_numpy()
            if leg != now:
                now, state = leg, (int(at[0]), int(at[0]), folds.LegState().ema_ipi)
                gaps = np.r_[0.0, np.diff(at) / 1000.0]  # the first frame has none, and leaves the mean as it is
                before, end = folds.ema(np.clip(gaps[1:], 1e-6, 300.0), 0.1, state[2])
                after = np.r_[before, end]
            else:
                gaps = np.diff(np.r_[state[1], at]) / 1000.0
                before, end = folds.ema(np.clip(gaps, 1e-6, 300.0), 0.1, state[2])
                after = np.r_[before[1:], end]
            state = state[0], int(at[-1]), float(after[-1])
            own = [pa.array(v) for v in (at, at, np.full(len(at), state[0]), after, gaps, np.zeros(len(at), bool))]
            yield pa.RecordBatch.from_arrays([*part.columns, *own], names)


BRICKS = "ticker string, ts bigint, seq bigint, brick_no bigint, open double, high double, low double, close double, up boolean, tick_count int, flags int, brick double"


def renko(ticks: DataFrame, sigma: DataFrame | None = None, k: float = 1.0, min_pct: float = 0.0, ts: str = "tc_ms", default_sigma: float = 0.01, jump: float | None = None, jump_limit: int = 30, closes: dict[str, float] | None = None, most: int = 1000) -> DataFrame:
    """Price-move bars of each ticker; sigma (ticker, bin_start_ms, sigma) is that of the tick's 30-minute bin.

    jump: prices further than this part from the last brick's close are skipped, until jump_limit in a row start the series anew.
    closes: last closes to go on from, by ticker, with no wick. A ``k`` column in ticks changes k at the next 30-minute period. A
    ticker is one task's fold. Null and insane prices are skipped; ties in time go by seq. A tick makes ``most`` bricks at most; the
    last of them has flag 256 (``folds.CAPPED``) if the price was further away.
    """
    rows = ticks.where(X.sane_px("mid")).select("ticker", F.col(ts).alias("ts"), "seq", "mid", *(["k"] if "k" in ticks.columns else []))
    own = F.lit(default_sigma)
    if sigma is not None:
        s = sigma.select(F.col("ticker").alias("_t"), F.col("bin_start_ms").alias("_b"), "sigma")
        rows, own = rows.join(s, (F.col("ticker") == F.col("_t")) & (X.bucket("ts", X.BIN_MS) == F.col("_b")), "left"), F.coalesce("sigma", F.lit(default_sigma))
    hot = F.col("k").cast("double") if "k" in ticks.columns else F.lit(float(k))
    rows = rows.select("ticker", "ts", "seq", "mid", own.alias("sigma"), F.coalesce(hot, F.lit(float(k))).alias("k"))

    class Numbered:
        def __init__(self) -> None:
            self.fold, self.n, self.trips, self.begun = folds.Renko(k, min_pct, most=most), 0, 0, False

    def step(s, r):  # noqa: ANN001, ANN202
        if not s.begun:
            s.begun, s.fold.k = True, r.k
            if closes and r.ticker in closes:
                s.fold.resume(closes[r.ticker], r.ts, r.mid, r.sigma)
        s.fold.retune(r.k)
        last = s.fold.last_close
        if jump is not None and last is not None and abs(r.mid - last) > jump * last:
            s.trips += 1
            if s.trips < jump_limit:
                return []
            s.fold.last_close = None
        s.trips = 0
        out = []
        for b in s.fold.feed(r.ts, r.mid, r.sigma):
            out.append((r.ticker, r.ts, r.seq, s.n, b["open"], b["high"], b["low"], b["close"], b["up"], b["tick_count"], b["flags"], b["brick"]))
            s.n += 1
        return out

    return fold_rows(rows, "ticker", ["ts", "seq"], BRICKS, Numbered, step)


def renko_with_microstructure(ticks: DataFrame, sigma: DataFrame | None = None, k: float = 1.0, ts: str = "tc_ms", **options) -> DataFrame:  # noqa: ANN003
    """Bricks with what the ticks since the brick before did, the closing tick included: the fields of a full bar. Further bricks of one tick have none."""
    from .bars import microstructure

    bricks = renko(ticks, sigma, k, ts=ts, **options)
    first = bricks.where("tick_count > 0").select("ticker", "seq", F.lit(1).alias("_end"))
    tagged = ticks.join(first, ["ticker", "seq"], "left")
    w = Window.partitionBy("ticker").orderBy(ts, "seq").rowsBetween(Window.unboundedPreceding, -1)
    tagged = tagged.withColumn("_id", F.coalesce(F.sum("_end").over(w), F.lit(0)))
    ends = tagged.groupBy("ticker", "_id").agg(F.max(F.when(F.col("_end") == 1, F.col("seq"))).alias("seq")).where("seq IS NOT NULL")
    stats = microstructure(tagged, ["ticker", "_id"], ts).drop("open", "high", "low", "close", "tick_count", "open_ts", "close_ts")
    own = stats.join(ends, ["ticker", "_id"]).drop("_id").withColumn("_first", F.lit(True))
    out = bricks.withColumn("_first", F.col("tick_count") > 0).join(own, ["ticker", "seq", "_first"], "left").drop("_first")
    return out.na.fill(0, ["realized_var", "bipower_var", "drift", "vol_imbalance", "max_abs_return", "avg_ci_ubp", "reject_rate", "vbid", "vask"])


def bricks_per_day(bricks: DataFrame) -> DataFrame:
    return bricks.groupBy("ticker", (F.col("ts") - F.pmod("ts", F.lit(86_400_000))).alias("day_ms")).agg(F.count("*").alias("bricks"))


class _Series:
    """The times, prices and sigmas of one ticker, in memory up to SPOOL_BYTES and then in a file of the task."""

    def __init__(self) -> None:
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)  # noqa: SIM115
        self.last: tuple | None = None

    def add(self, ts: np.ndarray, price: np.ndarray, sigma: np.ndarray) -> None:
        """Prices that repeat the one before within a 30-minute period are left out: no brick can come of them."""
        keep = np.ones(len(ts), bool)
        keep[1:] = (price[1:] != price[:-1]) | (ts[1:] // X.BIN_MS != ts[:-1] // X.BIN_MS)
        if self.last is not None and len(ts):
            keep[0] = (float(price[0]), int(ts[0]) // X.BIN_MS) != self.last
        if len(ts):
            self.last = float(price[-1]), int(ts[-1]) // X.BIN_MS
        rows = np.empty(int(keep.sum()), [("ts", "i8"), ("price", "f8"), ("sigma", "f8")])
        rows["ts"], rows["price"], rows["sigma"] = ts[keep], price[keep], sigma[keep]
        self.file.write(rows.tobytes())

    def rows(self) -> np.ndarray:
        kind = np.dtype([("ts", "i8"), ("price", "f8"), ("sigma", "f8")])
        if self.file._rolled:
            self.file.flush()
            return np.memmap(self.file._file, kind, "r") if self.file.tell() else np.zeros(0, kind)
        return np.frombuffer(self.file._file.getvalue(), kind)


#: A ticker's ticks are held in memory up to so many bytes while its k is searched.
SPOOL_BYTES = 256 << 20


def calibrate_k(ticks: DataFrame, target: float, grid: tuple[float, ...] = (0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0), ts: str = "tc_ms", default_sigma: float = 0.01, sigma: DataFrame | None = None, tolerance: float = 0.05, steps: int = 12) -> DataFrame:
    """(ticker, k, median): a k whose median bricks a day is within tolerance of target.

    One job, whatever the number of tickers: the task that has a ticker, sorted, keeps its prices and searches (``folds.search_k``). After
    the last step the nearest k stands; no bricks, no row. Null tickers and insane prices are left out.
    """
    rows = ticks.where(X.sane_px("mid") & F.col("ticker").isNotNull()).select("ticker", F.col(ts).alias("ts"), "seq", "mid")
    own = F.lit(default_sigma)
    if sigma is not None:
        s = sigma.select(F.col("ticker").alias("_t"), F.col("bin_start_ms").alias("_b"), "sigma")
        rows = rows.join(s, (F.col("ticker") == F.col("_t")) & (X.bucket("ts", X.BIN_MS) == F.col("_b")), "left")
        own = F.coalesce("sigma", own)
    rows = rows.select("ticker", "ts", "seq", "mid", own.alias("sigma"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, series = None, None

        def found() -> Iterator[pa.RecordBatch]:
            r = series.rows()
            best = folds.search_k(lambda k: folds.bricks_by_day(r["ts"], r["price"], r["sigma"], k), target, grid, tolerance, steps)
            if best:
                yield pa.RecordBatch.from_pydict({"ticker": [now], "k": [best[0]], "median": [best[1]]})

        for batch in batches:
            for (name,), part in segments(batch, [0]):
                if name != now:
                    if series:
                        yield from found()
                    now, series = name, _Series()
                series.add(*(part.column(c).to_numpy(zero_copy_only=False) for c in ("ts", "mid", "sigma")))
        if series:
            yield from found()

    return dealt(rows, "ticker").sortWithinPartitions("ticker", "ts", "seq").mapInArrow(run, "ticker string, k double, median double")
