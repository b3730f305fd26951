"""Streaming twins: bars by watermark, de-duplication, and folds as keyed state shared with the batch operators."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import exprs as X
from ..functions import folds


def stream_ohlc(ticks: DataFrame, seconds: int, late: str = "0 seconds", ts: str = "tc_ms") -> DataFrame:
    """Bars of a stream in append mode: each is emitted once the watermark has passed its end."""
    at = F.struct(ts, "seq")
    rows = ticks.where(X.sane_px("mid")).withColumn("at", F.timestamp_millis(ts)).withWatermark("at", late)
    g = rows.groupBy(F.window("at", f"{seconds} seconds"), "ticker").agg(F.min_by("mid", at).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", at).alias("close"), F.count("*").alias("tick_count"))
    return g.select("ticker", F.unix_millis("window.start").alias("bar_ts"), "open", "high", "low", "close", "tick_count")


def deduplicated(frames: DataFrame, late: str = "10 seconds", ts: str = "ts_ms") -> DataFrame:
    """Drops the second copy of a frame: same provider, time and sequence."""
    return frames.withColumn("at", F.timestamp_millis(ts)).withWatermark("at", late).dropDuplicatesWithinWatermark(["provider", ts, "seq"]).drop("at")


def in_frames(rows: Iterable[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """rows, some thousands to a frame, as they come."""
    rows = iter(rows)
    while part := list(islice(rows, 10_000)):
        yield pd.DataFrame(part, columns=names)


def folded(stream: DataFrame, key: str, order: list[str], schema: str, make: Any, step: Any) -> DataFrame:  # noqa: ANN401
    """A fold as keyed streaming state: the class that the batch operator uses, pickled between batches.

    What a batch brings of a key is sorted in one worker, so the stream's batches must be bounded (``stateful.collected`` does so).
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = pickle.loads(state.get[0]) if state.exists else make()
        rows = pd.concat(list(batches)).sort_values(order)
        yield from in_frames((o for r in rows.itertuples(index=False) for o in step(fold, r)), names)
        state.update((pickle.dumps(fold),))

    return stream.groupBy(key).applyInPandasWithState(run, schema, "fold binary", "append", GroupStateTimeout.NoTimeout)


def stream_delta_gate(rows: DataFrame, sentinel_ms: int = 60_000) -> DataFrame:
    def step(s, r):  # noqa: ANN001, ANN202
        flag = s.next(r.tc_ms, (r.bid, r.ask, r.vbid, r.vask, r.ci))
        return [] if flag is None else [(r.ticker, r.tc_ms, r.seq, r.bid, r.ask, flag)]

    return folded(rows.select("ticker", "tc_ms", "seq", "bid", "ask", "vbid", "vask", "ci"), "ticker", ["seq"], "ticker string, ts bigint, seq bigint, bid double, ask double, flags int", lambda: folds.DeltaGate(sentinel_ms), step)


def stream_renko(rows: DataFrame, k: float, sigma: float) -> DataFrame:
    def step(s, r):  # noqa: ANN001, ANN202
        return [(r.ticker, b["ts"], r.seq, b["open"], b["close"], b["flags"]) for b in s.feed(r.tc_ms, r.mid, sigma)]

    return folded(rows.select("ticker", "tc_ms", "seq", "mid"), "ticker", ["tc_ms", "seq"], "ticker string, ts bigint, seq bigint, open double, close double, flags int", lambda: folds.Renko(k), step)


def stream_leg_states(rows: DataFrame) -> DataFrame:
    """The state of each (ticker, provider) leg after each of its quotes."""
    legs = rows.select(F.concat_ws("|", "ticker", "provider").alias("leg"), "tc_ms", "seq", "bid", "ask", "vbid", "vask")

    def step(s, r):  # noqa: ANN001, ANN202
        s.update(r.tc_ms, r.bid, r.ask, r.vbid, r.vask)
        return [(r.leg, r.tc_ms, r.seq, s.ema_ipi, s.last_gap)]

    return folded(legs, "leg", ["tc_ms", "seq"], "leg string, ts bigint, seq bigint, ema_ipi double, last_gap double", folds.LegState, step)


def stream_zscores(rows: DataFrame, floor_bps: float = 0.0) -> DataFrame:
    return folded(rows.select("ticker", "tc_ms", "seq", "mid"), "ticker", ["tc_ms", "seq"], "ticker string, ts bigint, seq bigint, z double", folds.RunningStats, lambda s, r: [(r.ticker, r.tc_ms, r.seq, s.score(r.mid, r.mid * floor_bps * 1e-4))])


def stream_sane_mids(rows: DataFrame) -> DataFrame:
    """The rows that the two-fold guard accepts; null prices aren't."""
    return folded(rows.where(F.col("mid").isNotNull()).select("ticker", "tc_ms", "seq", "mid"), "ticker", ["tc_ms", "seq"], "ticker string, ts bigint, seq bigint, mid double", folds.SaneMid, lambda s, r: [(r.ticker, r.tc_ms, r.seq, r.mid)] if s.accept(r.mid) else [])


def stream_vol_rows(bins: DataFrame, period: int = 28) -> DataFrame:
    """Smoothed sigma of a stream of closed bins (ticker, bin_start_ms, raw)."""
    return folded(bins, "ticker", ["bin_start_ms"], "ticker string, bin_start_ms bigint, raw double, sigma double", lambda: folds.VolEma(period), lambda s, r: [(r.ticker, r.bin_start_ms, r.raw, s.next(r.raw))])


def stream_replay_check(rows: DataFrame) -> DataFrame:
    return folded(rows, "peer", ["ts", "seq"], "peer string, ts bigint, seq bigint", folds.ReplayWindow, lambda s, r: [(r.peer, r.ts, r.seq)] if s.accept(r.ts, r.seq) else [])


def stream_last(rows: DataFrame, heartbeat_s: int = 1) -> DataFrame:
    """The last quote of each ticker, repeated in quiet times: a processing-time timer re-emits it, flagged as heartbeat."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            row = (*state.get, 1)
        else:
            last = pd.concat(list(batches)).sort_values(["tc_ms", "seq"]).iloc[-1]
            state.update((k[0], int(last.tc_ms), float(last.bid), float(last.ask)))
            row = (k[0], int(last.tc_ms), float(last.bid), float(last.ask), 0)
        state.setTimeoutDuration(heartbeat_s * 1000)
        yield pd.DataFrame([row], columns=["ticker", "ts", "bid", "ask", "flags"])

    return rows.groupBy("ticker").applyInPandasWithState(run, "ticker string, ts bigint, bid double, ask double, flags int", "ticker string, ts bigint, bid double, ask double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def subscribed(stream: DataFrame, ids: list) -> DataFrame:
    """The rows of listed tickers; an empty list has none, and null tickers are in no list."""
    return stream.where(F.col("ticker").isin(ids)) if ids else stream.where("false")


def acknowledged(ids: list, known: DataFrame) -> dict[str, list]:
    """What a subscription answers: which of the ids are known tickers, in the order asked, and which are rejected."""
    found = {r["ticker"] for r in known.where(F.col("ticker").isin(ids)).select("ticker").distinct().collect()} if ids else set()
    return {"subscribed": [i for i in ids if i in found], "rejected": [i for i in ids if i not in found]}


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:  # noqa: ANN001
    return spark.readStream.schema(schema).parquet(path)


def reloaded(stream: DataFrame, params_path: str, apply: Any, sink: Any):  # noqa: ANN201, ANN401
    """foreachBatch with the parameters read anew whenever their bytes change."""
    held: dict = {}

    def batch(df: DataFrame, epoch: int) -> None:
        raw = df.sparkSession.read.format("binaryFile").load(params_path).select(F.sha2("content", 256).alias("h")).first()["h"]
        if held.get("h") != raw:
            held["h"], held["params"] = raw, df.sparkSession.read.option("multiLine", "true").json(params_path).first().asDict(recursive=True)
        sink(apply(df, held["params"]), epoch)

    return stream.writeStream.foreachBatch(batch)


def collected(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it emitted, as a Parquet table in the folder that all executors share."""
    from ..session import shared_dir

    path = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def attested(rows: DataFrame) -> DataFrame:
    """(seat, ts, boot, seq, verdict) of signed beats, by what each seat's newest valid one was."""
    schema = "seat string, ts bigint, boot bigint, seq bigint, verdict string"
    return folded(rows, "seat", ["arrived"], schema, folds.AttestState, lambda s, r: [(r.seat, r.ts, r.boot, r.seq, s.judge(r.boot, r.seq, r.ts))])
