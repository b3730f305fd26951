"""Volatility of bars: estimators, 30-minute rows, and the blend over several windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import folds
from . import bars as B
from .sequential import fold_rows

FLOOR = 0.01


def parkinson_sigma(bars: DataFrame) -> DataFrame:
    """One sigma a ticker over its valid bars; 0 without any."""
    ok = X.sane_any(F.col("high")) & X.sane_any(F.col("low"))
    return bars.groupBy("ticker").agg(F.coalesce(F.sqrt(F.avg(F.when(ok, X.parkinson_var("high", "low")))), F.lit(0.0)).alias("sigma"))


def gk_sigma(bars: DataFrame) -> DataFrame:
    """Each bar's variance is held at 0 or above before the mean."""
    return bars.groupBy("ticker").agg(F.coalesce(F.sqrt(F.avg(F.greatest(X.gk_var("open", "high", "low", "close"), F.lit(0.0)))), F.lit(0.0)).alias("sigma"))


def yz_sigma(bars: DataFrame) -> DataFrame:
    """Yang-Zhang over a ticker's bars in order; 0 with fewer than two bars or two gaps."""
    w = Window.partitionBy("ticker").orderBy("bar_ts")
    prev = F.lag("close").over(w)
    rows = bars.withColumn("_o", F.log(F.col("open") / prev)).withColumn("_c", F.log(F.col("close") / F.col("open"))).withColumn("_rs", X.rs_var("open", "high", "low", "close"))
    g = rows.groupBy("ticker").agg(F.count("*").alias("n"), F.count("_o").alias("gaps"), F.var_samp("_o").alias("vo"), F.var_samp(F.when(F.col("_o").isNotNull(), F.col("_c"))).alias("vc"), F.sum("_rs").alias("rs"))
    k = 0.34 / (1.34 + (F.col("n") + 1) / (F.col("n") - 1))
    v = F.col("vo") + k * F.col("vc") + (1 - k) * F.col("rs") / F.col("n")
    return g.select("ticker", F.when((F.col("n") < 2) | (F.col("gaps") < 2), 0.0).otherwise(F.sqrt(F.greatest(v, F.lit(0.0)))).alias("sigma"))


def sigma_by(estimator: str, bars: DataFrame) -> DataFrame:
    return {"parkinson": parkinson_sigma, "gk": gk_sigma, "yz": yz_sigma}[estimator](bars)


def vol_rows(bars: DataFrame, period: int = 28, src_ms: int = 10_000, history: DataFrame | None = None) -> DataFrame:
    """(ticker, bin_start_ms, raw, sigma): Rogers-Satchell of each 30-minute bin, smoothed. The last, open bin is left out.

    history (ticker, bin_start_ms, sigma): rows smoothed before; they are kept as they are, count towards the period, and the series
    goes on from the last of them with later bins. Bars with a price that isn't positive are ignored.
    """
    good = bars.where((F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0))
    if src_ms == X.BIN_MS:
        bins = good.select("ticker", F.col("bar_ts").alias("bin_start_ms"), X.rs_sigma("open", "high", "low", "close").alias("raw"))
    else:
        bins = B.rollup(good, src_ms, X.BIN_MS).select("ticker", F.col("dst_ts").alias("bin_start_ms"), X.rs_sigma("open", "high", "low", "close").alias("raw"))
    last = F.max("bin_start_ms").over(Window.partitionBy("ticker"))
    closed = bins.withColumn("_last", last).where("bin_start_ms < _last").select("ticker", "bin_start_ms", "raw", F.lit(None).cast("double").alias("known"))
    if history is not None:
        end = history.groupBy("ticker").agg(F.max("bin_start_ms").alias("_e"))
        closed = closed.join(end, "ticker", "left").where(F.col("_e").isNull() | (F.col("bin_start_ms") > F.col("_e"))).drop("_e")
        closed = closed.unionByName(history.select("ticker", "bin_start_ms", F.lit(None).cast("double").alias("raw"), F.col("sigma").alias("known")))

    def step(s, r):  # noqa: ANN001, ANN202
        if r.known == r.known and r.known is not None:
            s.value, s.n = r.known, s.n + 1
            return [(r.ticker, r.bin_start_ms, None, r.known)]
        return [(r.ticker, r.bin_start_ms, r.raw, s.next(r.raw))]

    return fold_rows(closed, "ticker", ["bin_start_ms"], "ticker string, bin_start_ms bigint, raw double, sigma double", lambda: folds.VolEma(period), step)


def winsorized(values: Column, least: int = 5, cut: float = 0.05) -> Column:
    """struct(mean, var) of an array, its lowest and highest shares clamped; var is that of a sample.

    The bounds travel in the fold's state: an expression inside a lambda would be evaluated for each element.
    """
    v = F.array_sort(values)
    n = F.size(values)
    few = n < least
    lo = F.get(v, F.when(few, 0).otherwise(F.floor(n * cut)).cast("int"))
    hi = F.get(v, F.when(few, n - 1).otherwise(F.least(F.greatest(F.floor(n * (1 - cut)).cast("int") - 1, F.lit(0)), n - 1)))

    def step(a: Column, x: Column) -> Column:
        d = F.greatest(F.least(x, a["hi"]), a["lo"]) - a["lo"]
        return F.struct(a["lo"].alias("lo"), a["hi"].alias("hi"), (a["s"] + d).alias("s"), (a["q"] + d * d).alias("q"))

    def finish(a: Column) -> Column:
        var = (a["q"] - a["s"] * a["s"] / n) / F.greatest(n - 1, F.lit(1))
        return F.struct((a["lo"] + a["s"] / n).alias("mean"), F.when(n < 2, 0.0).otherwise(F.greatest(var, F.lit(0.0))).alias("var"))

    return F.aggregate(values, F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), step, finish)


def mtf_blend(rows: DataFrame, windows: tuple[tuple[int, float], ...] = ((672, 1.0), (2880, 1.0), (8640, 1.0)), least: int = 48) -> DataFrame:
    """Adds blend: windows (bins, weight) look back over w bins and the row itself; their winsorised means weigh weight / var.

    One pass over a ticker's bins, which are 48 a day, with its windows kept sorted.
    """
    schema = "ticker string, bin_start_ms bigint, sigma double, blend double"
    return fold_rows(rows.select("ticker", "bin_start_ms", "sigma"), "ticker", ["bin_start_ms"], schema, lambda: folds.MtfBlend(windows, least, FLOOR), lambda s, r: [(r.ticker, r.bin_start_ms, r.sigma, s.next(r.sigma))])


def spike_floor(rows: DataFrame, half_life: float = 3.0, cap: float = 8.0) -> DataFrame:
    """Adds effective: never below a fast mean of the last bins, which itself stays under cap times the blend."""
    alpha = 1 - 2 ** (-1 / half_life)
    n = math.ceil(6 * half_life)
    order = Window.partitionBy("ticker").orderBy("bin_start_ms").rowsBetween(-(n - 1), 0)
    v = F.filter(F.collect_list("sigma").over(order), lambda x: x > 0)
    out = rows.withColumn("_v", v)
    fast = F.aggregate("_v", F.lit(None).cast("double"), lambda a, x: F.coalesce(a + alpha * (x - a), x))
    return out.withColumn("effective", F.greatest("blend", F.least(F.coalesce(fast, F.lit(0.0)), cap * F.col("blend")))).drop("_v")


def leg_bars(window_min: float, bar_min: float) -> int:
    return max(int(window_min // bar_min), 1)


def to_30m(sigma: Column | str, bar_min: float) -> Column:
    return (F.col(sigma) if isinstance(sigma, str) else sigma) * math.sqrt(30 / bar_min)


def span_bars_30m(window_min: float) -> int:
    """30-minute bins that a window spans, one at least."""
    return max(int(window_min // 30), 1)


def max_days(windows_min: list[float]) -> int:
    """Days of history that the longest window needs."""
    return math.ceil(max(windows_min, default=0) / 1440)


def feed_legs(windows_min: list[float], estimators: list[str] | None = None, bar_min: list[float] | None = None) -> list[dict]:
    """Every window with every estimator and bar width, Parkinson over 30 minutes where none is named, each with its bars and factor to 30 minutes."""
    return [{"window_min": w, "estimator": e, "bar_min": b, "bars": leg_bars(w, b), "factor": math.sqrt(30 / b)} for w in windows_min for e in estimators or ["parkinson"] for b in bar_min or [30.0]]


def rolling_sigma(bars: DataFrame, n: int, estimator: str = "parkinson", factor: float = 1.0) -> DataFrame:
    """Adds sigma over the last n bars of each ticker: the root of the mean variance, scaled; bars with bad prices don't count."""
    v = {"parkinson": X.parkinson_var("high", "low"), "rs": X.rs_var("open", "high", "low", "close"), "gk": X.gk_var("open", "high", "low", "close")}[estimator]
    ok = (F.least("open", "high", "low", "close") > 0) & X.finite(v)
    w = Window.partitionBy("ticker").orderBy("bar_ts").rowsBetween(-(n - 1), 0)
    return bars.withColumn("sigma", F.coalesce(F.sqrt(F.avg(F.when(ok, F.greatest(v, F.lit(0.0)))).over(w)), F.lit(0.0)) * factor)


def signed_blend(legs: DataFrame, key: str | list[str] = "ticker") -> DataFrame:
    """(key, weight, quality, sigma) legs to sum(w q s) / sum(w q); a bad weight counts as 1, a bad quality drops the leg."""
    w = F.when(X.finite("weight") & (F.col("weight") > 0), F.col("weight")).otherwise(1.0)
    ok = X.finite("quality") & (F.col("quality") > 0) & X.finite("sigma")
    s = lambda x: F.sum(F.when(ok, x))
    return legs.groupBy(*([key] if isinstance(key, str) else key)).agg((s(w * F.col("quality") * F.col("sigma")) / s(w * F.col("quality"))).alias("sigma"))
