"""Event-time operators with keyed state: what must see a series in order waits for the watermark.

Rows of a key wait in a list state until the watermark has passed them, and an event-time timer hands them on in order of (time, seq), so
that a stream gives what the batch operator gives on the same rows, whatever order they arrive in within the watermark's
delay. Later ones are dropped by the engine. What a row yields carries its event time, so another stateful operator can follow.

State is as large as a key's rows within the delay, and its fold. It lives in RocksDB and in the checkpoint, and a query
goes on from there. Rows wait in packed blocks, not one by one, and a worker holds those that wait for a key and what a batch brings of it, as
columns: so a batch must be bounded, which ``collected`` sees to. Null event times never pass the watermark and are left out. A key without rows has no state.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions import exprs as X
from ..functions import folds, tdwap
from ..session import shared_dir
from .live import in_frames

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which keyed state needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


#: Rows of a block of waiting ones, and most rows that a stream takes in one batch.
BLOCK_ROWS, BATCH_ROWS = 100_000, 2_000_000


class InOrder(StatefulProcessor):
    """Hands a key's rows on in order once they are final. columns: (name, Spark type); the first is the time in ms, the second seq."""

    def __init__(self, columns: list[tuple[str, str]]) -> None:
        self.columns = columns
        self.kind = to_arrow_schema(StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in columns)))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.least = handle.getValueState("least", "ts bigint")

    def _packed(self, rows: pa.Table) -> list[tuple[bytes]]:
        out = []
        for i in range(0, rows.num_rows, BLOCK_ROWS):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.kind) as to:
                to.write_table(rows.slice(i, BLOCK_ROWS))
            out.append((sink.getvalue().to_pybytes(),))
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: ANN401, N802, N803
        new = pa.concat_tables([pa.Table.from_pandas(pdf[self.kind.names], schema=self.kind, preserve_index=False) for pdf in rows])
        if new.num_rows:
            self.waiting.appendList(self._packed(new.combine_chunks()))
            self._wait(min(pc.min(new[0]).as_py(), self.least.get()[0] if self.least.exists() else 1 << 62))
        return iter(())

    def _wait(self, least: int) -> None:
        self.least.update((least,))
        self.handle.registerTimer(max(least, 0))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: ANN401, N802, N803
        upto, done = timerValues.getCurrentWatermarkInMs(), self.kind.empty_table()
        if self.least.exists() and self.least.get()[0] <= upto:
            rows = pa.concat_tables([pa.ipc.open_stream(r[0]).read_all() for r in self.waiting.get()])
            final = pc.less_equal(rows[0], upto)
            done, rest = rows.filter(final), rows.filter(pc.invert(final))
            if rest.num_rows:
                self.waiting.put(self._packed(rest.combine_chunks()))
                self._wait(pc.min(rest[0]).as_py())
            else:
                self.waiting.clear()
                self.least.clear()
            done = done.sort_by([(n, "ascending") for n in self.kind.names])
        yield from self.passed(key, _tuples(done), upto)

    def passed(self, key: tuple, rows: Iterator[tuple], upto: int) -> Iterator[pd.DataFrame]:
        """rows: final, in order; no further ones up to that time will come."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def _tuples(rows: pa.Table) -> Iterator[tuple]:
    for batch in rows.to_batches(max_chunksize=10_000):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


class Folded(InOrder):
    """A fold over final rows: step(state, row) gives tuples of the output."""

    def __init__(self, columns: list[tuple[str, str]], names: list[str], make: Callable, step: Callable) -> None:
        super().__init__(columns)
        self.names, self.make, self.step = names, make, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.fold = handle.getValueState("fold", "fold binary")

    def passed(self, key: tuple, rows: Iterator[tuple], upto: int) -> Iterator[pd.DataFrame]:
        first = next(rows, None)
        if first is not None:
            state = pickle.loads(self.fold.get()[0]) if self.fold.exists() else self.make()
            yield from in_frames((o for r in chain([first], rows) for o in self.step(state, r)), self.names)
            self.fold.update((pickle.dumps(state),))


def _columns(df: DataFrame, names: list[str]) -> list[tuple[str, str]]:
    return [(n, df.schema[n].dataType.simpleString()) for n in names]


def timed(rows: DataFrame, late: str, ts: str = "tc_ms") -> DataFrame:
    """rows with their event time ``at`` and a watermark that is so late."""
    return rows.where(F.col(ts).isNotNull()).withColumn("at", F.timestamp_millis(ts)).withWatermark("at", late)


def in_order(rows: DataFrame, key: str, columns: list[str], schema: str, make: Callable, step: Callable, event_time: str = "") -> DataFrame:
    """A fold over each key of a stream with a watermark. columns: time, seq and what step reads; event_time: the output column that carries it on."""
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.groupBy(key).transformWithStateInPandas(Folded(_columns(rows, columns), names, make, step), schema, "Append", "EventTime", eventTimeColumnName=event_time)


def guarded(ticks: DataFrame, late: str = "10 seconds", value: str = "mid", carry: tuple[str, ...] = (), ts: str = "tc_ms") -> DataFrame:
    """(ticker, at, ts, seq, mid, carried columns) of what the two-fold guard accepts, in order; nulls are not accepted."""
    rows = timed(ticks.where(X.sane_px(value)), late, ts)
    kinds = "".join(f", {n} {t}" for n, t in _columns(ticks, list(carry)))
    rows = rows.withColumn("ticker", F.coalesce("ticker", F.lit("")))

    def step(s, r):  # noqa: ANN001, ANN202
        return [(r[2], pd.Timestamp(r[0], unit="ms"), r[0], r[1], r[3], *r[4:])] if s.accept(r[3]) else []

    return in_order(rows, "ticker", [ts, "seq", "ticker", value, *carry], f"ticker string, at timestamp, ts bigint, seq bigint, mid double{kinds}", folds.SaneMid, step, "at")


def guarded_ohlc(ticks: DataFrame, seconds: int, late: str = "10 seconds", value: str = "mid", ts: str = "tc_ms") -> DataFrame:
    """Bars behind the two-fold guard: two stateful operators, the guard's rows carry the watermark on to the bars."""
    kept = guarded(ticks, late, value, ts=ts)
    order = F.struct("ts", "seq")
    g = kept.groupBy(F.window("at", f"{seconds} seconds"), "ticker").agg(F.min_by("mid", order).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", order).alias("close"), F.count("*").alias("tick_count"))
    return g.select("ticker", F.unix_millis("window.start").alias("bar_ts"), "open", "high", "low", "close", "tick_count")


def asof_cross(base: DataFrame, quote: DataFrame, pair: str, ttl_ms: int = 5000, late: str = "10 seconds", ts: str = "tc_ms") -> DataFrame:
    """On each tick of either leg the cross with the other's latest: both legs in one stream, keyed by the pair, with the two last quotes as state."""
    fields = [ts, "seq", "side", "bid", "ask", "vbid", "vask", "ci", "accepted"]
    side = lambda df, s: df.withColumn("side", F.lit(s)).withColumn("pair", F.lit(pair)).select("pair", *fields)
    both = timed(side(base, 0).unionByName(side(quote, 1)), late, ts)

    def step(s, r):  # noqa: ANN001, ANN202
        out = s.next(*r)
        return [(pair, *out)] if out else []

    return in_order(both, "pair", fields, "pair string, ts bigint, seq bigint, bid double, ask double, vbid bigint, vask bigint, accepted bigint, ci int", lambda: folds.AsOfPair(ttl_ms), step)


def heartbeats(ticks: DataFrame, every_ms: int, most_ms: int, late: str = "10 seconds", ts: str = "tc_ms") -> DataFrame:
    """(ticker, ts, seq, bid, ask, flags): each quote, and in quiet times its copies flagged 1 each every_ms behind it, up to most_ms, by event time."""
    fields = [ts, "seq", "ticker", "bid", "ask"]
    rows = timed(ticks.where(F.col("ticker").isNotNull()), late, ts)
    out = "ticker string, ts bigint, seq bigint, bid double, ask double, flags int"
    return rows.groupBy("ticker").transformWithStateInPandas(Beats(_columns(rows, fields), every_ms, most_ms), out, "Append", "EventTime")


class Beats(InOrder):
    def __init__(self, columns: list[tuple[str, str]], every_ms: int, most_ms: int) -> None:
        super().__init__(columns)
        self.every, self.most = every_ms, most_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "ts bigint, seq bigint, ticker string, bid double, ask double, beat bigint")

    def passed(self, key: tuple, rows: Iterator[tuple], upto: int) -> Iterator[pd.DataFrame]:
        now = tuple(self.last.get()) if self.last.exists() else None

        def beats() -> Iterator[tuple]:
            nonlocal now
            for r in chain(rows, [None]):
                end = upto + 1 if r is None else r[0]
                while now and now[5] < end and now[5] <= now[0] + self.most:
                    yield now[2], now[5], now[1], now[3], now[4], 1
                    now = (*now[:5], now[5] + self.every)
                if r is not None:
                    yield r[2], r[0], r[1], r[3], r[4], 0
                    now = (*r, r[0] + self.every)

        yield from in_frames(beats(), ["ticker", "ts", "seq", "bid", "ask", "flags"])
        if now and now[5] <= now[0] + self.most:
            self.last.update(now)
            self.handle.registerTimer(int(now[5]))
        elif self.last.exists():
            self.last.clear()


COMPOSITE = "ticker string, t bigint, bid double, ask double, accepted int, ci int, confidence int, flags int, n_eff double, top_share double, computed boolean"


class Composite(InOrder):
    """The composite of a ticker at each instant that any leg stands at; legs are a map from provider to what is known of it.

    An instant is emitted once the watermark has reached it, whether rows come or not. With refresh_ms a quote whose legs say the
    same as at the instant before isn't computed anew until so much time has passed since they last changed.
    """

    LEG = "bid double, ask double, vbid double, vask double, last_update bigint, live_at bigint, joined bigint, ema_ipi double, last_gap double, injected boolean"

    def __init__(self, columns: list[tuple[str, str]], step_ms: int, horizon_ms: int, market: Callable, stale: float, kernel: str, refresh_ms: int) -> None:
        super().__init__(columns)
        self.step, self.horizon, self.market, self.stale, self.kernel, self.refresh = step_ms, horizon_ms, market, stale, kernel, refresh_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.legs = handle.getMapState("legs", "provider bigint", self.LEG)
        self.at = handle.getValueState("at", "next bigint, held binary")

    def passed(self, key: tuple, rows: Iterator[tuple], upto: int) -> Iterator[pd.DataFrame]:
        legs = {k[0]: folds.LegState(*v) for k, v in self.legs.iterator()}
        t, held = (self.at.get()[0], pickle.loads(self.at.get()[1])) if self.at.exists() else (None, None)
        moved = set()

        def quotes() -> Iterator[tuple]:
            nonlocal t, held
            for r in chain(rows, [None]):
                end = upto + 1 if r is None else r[0]
                while t is not None and t <= end:
                    stand = {p: s for p, s in legs.items() if t - s.last_update <= self.horizon}
                    if not stand:
                        t = None
                        break
                    held, row = self.instant(key[0], t, stand, held)
                    yield from row
                    t += self.step
                if r is not None:
                    ts, _, provider, bid, ask, vbid, vask = r
                    legs.setdefault(provider, folds.LegState()).update(ts, *(float("nan") if v is None else v for v in (bid, ask)), vbid or 0.0, vask or 0.0)
                    moved.add(provider)
                    first = ts - ts % self.step + self.step
                    t = first if t is None else t

        yield from in_frames(quotes(), [c.split()[0] for c in COMPOSITE.split(", ")])
        for p in moved:
            s = legs[p]
            self.legs.updateValue((p,), (s.bid, s.ask, float(s.vbid), float(s.vask), s.last_update, s.live_at, s.joined, s.ema_ipi, s.last_gap, s.injected))
        self.at.update((t, pickle.dumps(held)))
        if t is not None:
            self.handle.registerTimer(max(t - 1, 0))

    def instant(self, ticker: str, t: int, stand: dict, held: tuple | None) -> tuple[tuple, list[tuple]]:
        """held: what the legs said, when they last changed, the refresh that is out, and it."""
        said = tuple(sorted((p, s.bid, s.ask, s.vbid, s.vask) for p, s in stand.items()))
        changed = t if held is None or held[0] != said else held[1]
        due = changed + (t - changed) // self.refresh * self.refresh if self.refresh else t
        fresh = held is None or held[1] != changed or held[2] != due
        if fresh:
            now = [tdwap.Leg(p, s.bid, s.ask, (s.last_update - t) / 1000.0, s.vbid, s.vask, *self.market(p), s.injected, s.ema_ipi, None if s.joined is None else (s.joined - t) / 1000.0, s.last_gap) for p, s in sorted(stand.items())]
            c = tdwap.composite(now, 0.0, self.stale, self.kernel)
        else:
            c = held[3]
        row = [(ticker, t, *(c[k] for k in ("bid", "ask", "accepted", "ci", "confidence", "flags", "n_eff", "top_share")), fresh)] if c else []
        return (said, changed, due, c), row


def composites(ticks: DataFrame, step_ms: int, market: Callable, stale: float = 10.0, kernel: str = "ALT", horizon_ms: int = 60_000, refresh_ms: int = 0, late: str = "10 seconds", ts: str = "tc_ms") -> DataFrame:
    """Live quotes of each ticker across its providers; market(provider) gives a leg's weight and whether it is mapped.

    Equal to the batch composites of leg_states and legs_at. A null ticker or provider is left out.
    """
    fields = [ts, "seq", "provider", "bid", "ask", "vbid", "vask"]
    rows = timed(ticks.where("ticker IS NOT NULL AND provider IS NOT NULL"), late, ts)
    return rows.groupBy("ticker").transformWithStateInPandas(Composite(_columns(rows, fields), step_ms, horizon_ms, market, stale, kernel, refresh_ms), COMPOSITE, "Append", "EventTime")


def _slices(part: DataFrame, order: str, batch_rows: int, path: str) -> list[DataFrame]:
    """part itself, or, where it has more than batch_rows rows, about so many at a time by ascending ``order``. Rows of one value of it stay together."""
    n = math.ceil(part.count() / batch_rows)
    if n < 2:
        return [part]
    found = part.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10_000), F.max(order)).first()
    cuts = sorted({c for c in found[0] or [] if c < found[1]})
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    part.withColumn("slice", at).repartition("slice").write.partitionBy("slice").parquet(path)
    return [part.sparkSession.read.schema(part.schema).parquet(f"{path}/slice={i}") for i in range(len(cuts) + 1)]


def collected(spark: SparkSession, parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], name: str, order: str | None = None, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """What a stream emits to which parts arrive one after another; the query is stopped after each and goes on from its checkpoint.

    A part of more than batch_rows rows arrives by its column ``order`` in files of about so many, one to a batch; else a part is a batch.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    kind = parts[0].schema
    out, n = None, 0
    with rocksdb(spark):
        for i, part in enumerate(parts):
            slices = _slices(part, order, batch_rows, f"{path}/slices/{i}") if order else [part]
            for s in slices:  # a folder each, so that files of one moment are listed in turn
                (s.coalesce(1) if len(slices) > 1 else s).write.parquet(f"{path}/in/{n:06d}")
                n += 1
            stream = spark.readStream.schema(kind)
            out = make((stream.option("maxFilesPerTrigger", 1) if len(slices) > 1 else stream).parquet(f"{path}/in/*"))
            q = out.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")
