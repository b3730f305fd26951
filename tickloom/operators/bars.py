"""Time bars: resampling, roll-up, microstructure, gap filling and the per-provider accumulator.

All are grouped aggregates or windows over (ticker, bucket); order inside a bucket is (time, seq). No operator sorts or
collects a ticker's whole history except gap filling, which works on bars.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def ohlc(ticks: DataFrame, tf_ms: int, ts: str = "tc_ms", guard: bool = True) -> DataFrame:
    """Light candles of the mids that the two-fold guard accepts; ci is averaged decoded and encoded again. No bars for empty buckets.

    Null and insane mids are left out. Ties in time go by seq. guard=False takes every sane price.
    """
    from .sequential import guarded

    at = F.struct(ts, "seq")
    rows = guarded(ticks, ts) if guard else ticks.where(X.sane_px("mid"))
    g = rows.withColumn("bar_ts", X.bucket(ts, tf_ms)).groupBy("ticker", "bar_ts")
    out = g.agg(
        F.min_by("mid", at).alias("open"),
        F.max("mid").alias("high"),
        F.min("mid").alias("low"),
        F.max_by("mid", at).alias("close"),
        F.sum("vbid").alias("vbid"),
        F.sum("vask").alias("vask"),
        F.count("*").alias("tick_count"),
        X.ci_encode(F.avg(X.ci_decode("ci"))).alias("avg_ci"),
    )
    return out.withColumn("close_ts", F.col("bar_ts") + tf_ms - 1)


def ohlc_late_dropped(ticks: DataFrame, tf_ms: int, ts: str = "tc_ms") -> DataFrame:
    """As ohlc over rows in arrival order (seq): a row of an earlier bucket than one already seen is late and left out."""
    rows = ticks.withColumn("_b", X.bucket(ts, tf_ms))
    seen = Window.partitionBy("ticker").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return ohlc(rows.withColumn("_top", F.max("_b").over(seen)).where(F.col("_b") >= F.col("_top")).drop("_b", "_top"), tf_ms, ts)


def rollup(bars: DataFrame, src_ms: int, dst_ms: int) -> DataFrame:
    """Bars (ticker, bar_ts, close_ts, ...) into wider ones. A bar that ends in a later bucket than it opens in touches both.

    The opening touch gives open, high, low and close; the closing touch gives its close as a price of the next bucket, which it
    opens with the bar's own open if nothing came before. Volume and tick count go to every bucket touched; ci is weighted by ticks.
    """
    if dst_ms % src_ms:
        raise ValueError(f"{dst_ms} ms is not a multiple of {src_ms} ms")
    own, last = X.bucket("bar_ts", dst_ms), X.bucket("close_ts", dst_ms)
    both = F.when(own == last, F.array(F.struct(own.alias("b"), F.lit(0).alias("leg")))).otherwise(F.array(F.struct(own.alias("b"), F.lit(0).alias("leg")), F.struct(last.alias("b"), F.lit(1).alias("leg"))))
    t = bars.withColumn("_t", F.explode(both))
    at = F.struct("bar_ts", "_t.leg")
    straddles = F.col("_t.leg") == 1
    w = F.greatest(F.col("tick_count"), F.lit(1))
    return t.groupBy("ticker", F.col("_t.b").alias("dst_ts")).agg(
        F.min_by("open", at).alias("open"),
        F.max(F.when(straddles, F.greatest("open", "close")).otherwise(F.col("high"))).alias("high"),
        F.min(F.when(straddles, F.least("open", "close")).otherwise(F.col("low"))).alias("low"),
        F.max_by("close", at).alias("close"),
        F.sum("vbid").alias("vbid"),
        F.sum("vask").alias("vask"),
        F.sum("tick_count").alias("tick_count"),
        X.ci_encode(F.sum(X.ci_decode("avg_ci") * w) / F.sum(w)).alias("avg_ci"),
    )


def full_bars(ticks: DataFrame, tf_ms: int, ts: str = "tc_ms") -> DataFrame:
    """Bars with microstructure: variances, drift, flow, spread, quality. Returns restart in every bar."""
    return microstructure(ticks.withColumn("bar_ts", X.bucket(ts, tf_ms)), ["ticker", "bar_ts"], ts)


def microstructure(rows: DataFrame, keys: list[str], ts: str = "tc_ms") -> DataFrame:
    """The fields of a full bar for each group of ticks, in order of time and seq within it."""
    order = Window.partitionBy(*keys).orderBy(ts, "seq")
    r = F.log(F.col("mid") / F.lag("mid").over(order))
    rows = rows.withColumn("r", r).withColumn("x", (F.col(ts) - F.first(ts).over(order)) / 1000.0)
    rows = rows.withColumn("rp", F.lag("r").over(order)).withColumn("vol", F.col("vbid") + F.col("vask"))
    at = F.struct(ts, "seq")
    moved = F.col("r").isNotNull()
    g = rows.groupBy(*keys).agg(
        F.min(ts).alias("open_ts"),
        F.max(ts).alias("close_ts"),
        F.min_by("mid", at).alias("open"),
        F.max("mid").alias("high"),
        F.min("mid").alias("low"),
        F.max_by("mid", at).alias("close"),
        X.saturate(F.sum("vbid"), 32).alias("vbid"),
        X.saturate(F.sum("vask"), 32).alias("vask"),
        F.count("*").alias("tick_count"),
        F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0)).alias("realized_var"),
        F.coalesce(F.sum(F.abs("r") * F.abs("rp")) * (math.pi / 2), F.lit(0.0)).alias("bipower_var"),
        F.regr_slope("mid", "x").alias("_slope"),
        F.max("x").alias("_last_x"),
        F.var_pop("x").alias("_vx"),
        F.sum(F.when(moved, F.signum("r") * F.col("vol"))).alias("_flow"),
        F.sum(F.when(moved, F.col("vol"))).alias("_flow_vol"),
        F.avg(F.when(F.col("ask") > F.col("bid"), X.spread_bps())).alias("_spread"),
        F.coalesce(F.max(F.abs("r")), F.lit(0.0)).alias("max_abs_return"),
        F.sum(X.ci_decode("ci") * F.col("accepted")).alias("_ci"),
        F.sum("accepted").alias("_acc"),
        F.sum("rejected").alias("_rej"),
    )
    trend = (F.col("tick_count") >= 2) & (F.col("_last_x") > 0) & (F.abs("close") > 1e-10) & (F.col("_vx") * F.col("tick_count") * F.col("tick_count") > 1e-12)
    return g.select(
        *keys, "open_ts", "close_ts", "open", "high", "low", "close", "vbid", "vask", "tick_count", "realized_var", "bipower_var",
        F.when(trend, F.col("_slope") * F.col("_last_x") / F.col("close")).otherwise(0.0).alias("drift"),
        F.when(F.col("_flow_vol") > 0, F.col("_flow") / F.col("_flow_vol")).otherwise(0.0).alias("vol_imbalance"),
        F.coalesce("_spread", F.lit(float("nan"))).alias("avg_spread_bps"),
        "max_abs_return",
        F.when(F.col("_acc") > 0, X.ci_encode(F.col("_ci") / F.col("_acc"))).otherwise(0).alias("avg_ci_ubp"),
        F.when(F.col("_acc") + F.col("_rej") > 0, X.round_half_away(F.col("_rej") / (F.col("_acc") + F.col("_rej")) * 65535)).otherwise(0).cast("int").alias("reject_rate"),
    )


def flat_fill(bars: DataFrame, tf_ms: int) -> DataFrame:
    """Adds a flat bar (flag 64, no ticks, previous close) for every bucket missing between a ticker's first and last."""
    own = bars.select("ticker", "bar_ts", "open", "high", "low", "close", "tick_count")
    nxt = F.lead("bar_ts").over(Window.partitionBy("ticker").orderBy("bar_ts"))
    gaps = own.withColumn("_n", nxt).where(F.col("_n") > F.col("bar_ts") + tf_ms)
    flat = gaps.select("ticker", F.explode(F.sequence(F.col("bar_ts") + tf_ms, F.col("_n") - tf_ms, F.lit(tf_ms).cast("long"))).alias("bar_ts"), *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], F.lit(0).cast("long").alias("tick_count"), F.lit(64).alias("flags"))
    return own.withColumn("flags", F.lit(0)).unionByName(flat)


def grid_stamped(bars: DataFrame, tf_ms: int = 10_000) -> DataFrame:
    """open_ts and close_ts on the bucket's own edges."""
    b = X.bucket("open_ts", tf_ms)
    return bars.withColumn("open_ts", b).withColumn("close_ts", b + tf_ms - 1)


def bar_to_ohlc(bars: DataFrame) -> DataFrame:
    return bars.select("ticker", F.col("open_ts").alias("bar_ts"), "close_ts", "open", "high", "low", "close", "vbid", "vask", "tick_count", F.col("avg_ci_ubp").alias("avg_ci"))


def level1(ticks: DataFrame, cycle_ms: int = 200, ts: str = "tc_ms") -> DataFrame:
    """One quote a cycle for each provider and ticker: last book, summed volumes, counts clamped to their widths.

    A ``kind`` column (tick, reaffirm, carry, reject), where there is one, decides: rejects only count beside accepted rows, and
    a cycle without real ticks is flagged REAFFIRM, or REAFFIRM and CARRY if only carried.
    """
    kind = F.col("kind") if "kind" in ticks.columns else F.lit("tick")
    rows = ticks.withColumn("cycle_ts", X.bucket(ts, cycle_ms)).withColumn("_k", kind)
    at, ok = F.struct(ts, "seq"), F.col("_k") != "reject"
    g = rows.groupBy("provider", "ticker", "cycle_ts").agg(
        F.max_by(F.when(ok, F.col("bid")), F.when(ok, at)).alias("bid"),
        F.max_by(F.when(ok, F.col("ask")), F.when(ok, at)).alias("ask"),
        X.saturate(F.sum(F.when(ok, F.col("vbid")).otherwise(0)), 32).alias("vbid"),
        X.saturate(F.sum(F.when(ok, F.col("vask")).otherwise(0)), 32).alias("vask"),
        X.saturate(F.count_if(ok), 16).alias("tick_count"),
        X.saturate(F.sum(F.when(ok, F.col("rejected")).otherwise(1)), 8).alias("rejected"),
        F.bool_or(F.col("_k") == "tick").alias("_real"),
        F.bool_or(F.col("_k") == "reaffirm").alias("_re"),
    )
    flags = F.when(F.col("_real"), 0).when(F.col("_re"), 4).otherwise(20)
    return g.where("tick_count > 0").select("provider", "ticker", "cycle_ts", "bid", "ask", "vbid", "vask", "tick_count", "rejected", flags.alias("flags"))


def quote_notional(price: str = "price", qty: str = "qty"):  # noqa: ANN201
    return X.saturate(X.round_half_away(F.col(price) * F.col(qty)), 32)


def last_in_window(rows: DataFrame, window_ms: int, ts: str = "tc_ms", key: str = "ticker") -> DataFrame:
    """The last row of each key in every window."""
    cols = [c for c in rows.columns if c != key]
    g = rows.withColumn("window_ts", X.bucket(ts, window_ms)).groupBy(key, "window_ts").agg(F.max_by(F.struct(*cols), F.struct(ts, "seq")).alias("r"))
    return g.select(key, "window_ts", "r.*")
