"""Synthetic crosses from real legs: ticks, as-of merges, bars, and rolling correlation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import written

LN16 = 4 * math.log(2)
#: Provider of composed quotes.
SYNTH = 2010


def compose_ticks(paths: DataFrame, quotes: DataFrame, max_price: float = X.ANY_MAX_PRICE) -> DataFrame:
    """paths (path, legs: array of (sym, exp)) against quotes (sym, bid, ask, mid, conf).

    A path gives no row unless every leg is quoted and sane; the empty path is 1. A crossed result has conf 0.
    """
    legs = paths.select("path", F.size("legs").alias("n"), F.posexplode_outer("legs").alias("i", "leg")).select("path", "n", "i", "leg.*")
    q = quotes.where(X.sane_px("bid") & X.sane_px("ask") & (F.col("bid") <= max_price) & (F.col("ask") <= max_price))
    j = legs.join(q, "sym", "left")
    up = F.col("exp") > 0
    parts = F.struct("i", F.when(up, F.col("bid")).otherwise(1 / F.col("ask")).alias("b"), F.when(up, F.col("ask")).otherwise(1 / F.col("bid")).alias("a"), F.when(up, F.col("mid")).otherwise(1 / F.col("mid")).alias("m"))
    g = j.groupBy("path", "n").agg(F.sort_array(F.collect_list(F.when(F.col("bid").isNotNull(), parts))).alias("p"), F.min("conf").alias("conf"))
    product = lambda f: F.aggregate("p", F.lit(1.0), lambda a, x: a * x[f])
    out = g.where(F.size("p") == F.greatest("n", F.lit(0))).select("path", product("b").alias("bid"), product("a").alias("ask"), product("m").alias("mid"), F.coalesce("conf", F.lit(10000)).alias("conf"))
    return out.withColumn("conf", F.when(F.col("bid") > F.col("ask"), 0).otherwise(F.col("conf")))


def asof_cross(base: DataFrame, quote: DataFrame, ttl_ms: int = 5000, ts: str = "tc_ms", slice_ms: int = 3_600_000) -> DataFrame:
    """On each tick of either leg, the cross with the other's latest, if neither is older than ttl_ms. Ties go by seq.

    A ``confidence`` column, where both legs have one, must not be 0 and the less of the two stands; provider is SYNTH.

    A union and an ordered pass with last(): no inequality join. The pass runs for each slice of time by itself: what a slice
    needs from the one before is at most ttl_ms old, so those rows are dealt to both and give results in their own only.
    """
    slice_ms = max(slice_ms, ttl_ms)
    conf = lambda df: F.col("confidence") if "confidence" in base.columns and "confidence" in quote.columns else F.lit(1)
    row = lambda df, side: df.select(F.col(ts).alias("ts"), "seq", F.lit(side).alias("side"), F.struct(F.col(ts).alias("ts"), "bid", "ask", "vbid", "vask", "ci", "accepted", conf(df).alias("confidence")).alias("q"))
    own = X.bucket("ts", slice_ms)
    late = F.col("ts") >= own + slice_ms - ttl_ms
    both = row(base, 0).unionByName(row(quote, 1)).withColumn("slice", F.explode(F.when(late, F.array(own, own + slice_ms)).otherwise(F.array(own))))
    w = Window.partitionBy("slice").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda s: F.last(F.when(F.col("side") == s, F.col("q")), ignorenulls=True).over(w)
    j = both.withColumn("b", last(0)).withColumn("c", last(1)).where("b IS NOT NULL AND c IS NOT NULL").where(F.col("slice") == own)
    j = j.where((F.col("ts") - F.col("b.ts") <= ttl_ms) & (F.col("ts") - F.col("c.ts") <= ttl_ms))
    j = j.where((F.col("b.confidence") != 0) & (F.col("c.confidence") != 0))
    ci = X.ci_encode(F.sqrt(F.pow(X.ci_decode("b.ci"), F.lit(2.0)) + F.pow(X.ci_decode("c.ci"), F.lit(2.0))))
    out = j.select("ts", "seq", (F.col("b.bid") / F.col("c.ask")).alias("bid"), (F.col("b.ask") / F.col("c.bid")).alias("ask"), F.least("b.vbid", "c.vbid").alias("vbid"), F.least("b.vask", "c.vask").alias("vask"), F.least("b.accepted", "c.accepted").alias("accepted"), ci.alias("ci"), F.least("b.confidence", "c.confidence").alias("confidence"), F.lit(SYNTH).alias("provider"))
    return out.where(X.sane_px("bid") & X.sane_px("ask"))


def aligned(left: DataFrame, right: DataFrame, on: str = "bar_ts") -> DataFrame:
    """Inner join of two legs' bars on their close, columns suffixed _1 and _2."""
    a = left.select(F.col(on), *[F.col(c).alias(f"{c}_1") for c in left.columns if c not in (on, "ticker")])
    b = right.select(F.col(on), *[F.col(c).alias(f"{c}_2") for c in right.columns if c not in (on, "ticker")])
    return a.join(b, on)


def aligned_legs(bars: DataFrame, path: list[str], on: str = "bar_ts") -> DataFrame:
    """The bars at which every leg of a path (tickers in order, any number, one may stand twice) has one: columns suffixed _1, _2, ...

    One grouped pass over the bars and no join. Of several bars of a ticker at one time the largest row counts; null tickers are none.
    """
    own = [c for c in bars.columns if c not in (on, "ticker")]
    g = bars.where(F.col("ticker").isin(path)).groupBy(on).agg(*[F.max(F.when(F.col("ticker") == t, F.struct(*own))).alias(f"_{i}") for i, t in enumerate(path, 1)])
    g = g.where(" AND ".join(f"_{i} IS NOT NULL" for i in range(1, len(path) + 1)))
    return g.select(on, *[F.col(f"_{i}.{c}").alias(f"{c}_{i}") for i in range(1, len(path) + 1) for c in own])


def _var(side: int, estimator: str) -> Column:
    c = [f"{x}_{side}" for x in ("open", "high", "low", "close")]
    v = F.greatest(X.rs_var(*c) if estimator == "rs" else X.parkinson_var(c[1], c[2]), F.lit(0.0))
    return F.when(X.finite(v), v).otherwise(0.0)


def _product(field: str, exps: tuple[int, ...]) -> Column:
    out = F.lit(1.0)
    for i, e in enumerate(exps, 1):
        out = out * F.col(f"{field}_{i}") if e > 0 else out / F.col(f"{field}_{i}")
    return out


def _quadratic(values: list[Column], exps: tuple[int, ...], rho) -> Column:  # noqa: ANN001
    """sum(v) + 2 sum over pairs of e_i e_j rho_ij sqrt(v_i v_j). rho: one number or column for all pairs, or {(i, j): rho} from 1, i < j."""
    total = values[0]
    for v in values[1:]:
        total = total + v
    for i in range(len(exps)):
        for j in range(i + 1, len(exps)):
            r = rho.get((i + 1, j + 1), 0.0) if isinstance(rho, dict) else rho
            r = r if isinstance(r, Column) else F.lit(float(r))
            total = total + 2 * exps[i] * exps[j] * r * F.sqrt(values[i] * values[j])
    return total


def _ranged(exps: tuple[int, ...], rho, estimator: str) -> list[Column]:  # noqa: ANN001
    v = F.greatest(_quadratic([_var(i, estimator) for i in range(1, len(exps) + 1)], exps, rho), F.lit(1e-12))
    half = F.sqrt(LN16 * v) / 2
    o, c = _product("open", exps), _product("close", exps)
    m = F.sqrt(o * c)
    return [o.alias("open"), F.greatest(m * F.exp(half), o, c).alias("high"), F.least(m * F.exp(-half), o, c).alias("low"), c.alias("close")]


def _whole(exps: tuple[int, ...]) -> Column:
    """Every leg has positive prices the right way round."""
    ok = F.lit(True)
    for i in range(1, len(exps) + 1):
        ok = ok & (F.least(f"open_{i}", f"high_{i}", f"low_{i}", f"close_{i}") > 0) & (F.col(f"high_{i}") >= F.col(f"low_{i}"))
    return ok


def synth_ohlc(legs: DataFrame, rho=0.0, exps: tuple[int, ...] = (1, -1), estimator: str = "rs") -> DataFrame:  # noqa: ANN001
    """Open and close are products; the range comes from the legs' variances and their correlations, centred on sqrt(O C)."""
    return legs.where(_whole(exps)).select("bar_ts", *_ranged(exps, rho, estimator))


def synth_bar(legs: DataFrame, rho=0.0, exps: tuple[int, ...] = (1, -1), estimator: str = "rs") -> DataFrame:  # noqa: ANN001
    """synth_ohlc with microstructure: a quadratic form of realised variances, all else from the leg with the worst ci (the first on ties)."""
    n = range(1, len(exps) + 1)
    rv = F.greatest(_quadratic([F.greatest(F.col(f"realized_var_{i}"), F.lit(0.0)) for i in n], exps, rho), F.lit(0.0))
    fields = ("bipower_var", "drift", "vol_imbalance", "avg_spread_bps", "max_abs_return", "avg_ci_ubp", "reject_rate", "vbid", "vask", "tick_count")
    worst = F.array_max(F.array(*[F.struct(F.col(f"avg_ci_ubp_{i}").alias("ci"), F.lit(-i).alias("i"), *[F.col(f"{c}_{i}").alias(c) for c in fields]) for i in n]))
    return legs.where(_whole(exps)).select("bar_ts", *_ranged(exps, rho, estimator), rv.alias("realized_var"), worst.alias("_w")).select("bar_ts", "open", "high", "low", "close", "realized_var", *[f"_w.{c}" for c in fields])


def synth_rollup(bars: DataFrame, tf_ms: int) -> DataFrame:
    """Synthetic bars to wider ones, on epoch milliseconds: extremes, sums, and the quality of the worst bar."""
    at = F.struct(F.col("bar_ts"))
    g = bars.withColumn("dst_ts", X.bucket("bar_ts", tf_ms)).groupBy("dst_ts")
    worst = F.struct("avg_ci_ubp", -F.col("bar_ts"))
    return g.agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"), F.sum("realized_var").alias("realized_var"), F.sum("bipower_var").alias("bipower_var"),
        F.sum("vbid").alias("vbid"), F.sum("vask").alias("vask"), F.sum("tick_count").alias("tick_count"), F.max("max_abs_return").alias("max_abs_return"), F.max("avg_ci_ubp").alias("avg_ci_ubp"), F.max_by("reject_rate", worst).alias("reject_rate"),
    )


def ohlc_monoid(bars: DataFrame, tf_ms: int) -> DataFrame:
    """Plain OHLC to a wider frame."""
    g = bars.withColumn("dst_ts", X.bucket("bar_ts", tf_ms)).groupBy("dst_ts")
    return g.agg(F.min_by("open", "bar_ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_ts").alias("close"), F.count("*").alias("n"))


def chunked(rows: DataFrame, order: str, overlap: int, slice_ms: int = 86_400_000, least: int = 4096) -> DataFrame:
    """rows in runs of their order, each with the last ``overlap`` rows of the run before: adds _chunk and _own, which those lack.

    Slices of time are counted (a row a slice), so a row's place is its slice's beginning and its place there; no task sorts it all. What
    rows come from is run once: they are a table, as they are read twice.
    """
    size = max(least, overlap)
    s = written(rows, "series").withColumn("_s", X.bucket(order, slice_ms))
    sizes = s.groupBy("_s").agg(F.count("*").alias("_k"))
    begins = sizes.select(F.col("_s").alias("_b"), (F.sum("_k").over(Window.orderBy("_s")) - F.col("_k")).alias("_begin"))
    s = s.join(F.broadcast(begins), F.col("_s") == F.col("_b")).withColumn("_n", F.col("_begin") + F.row_number().over(Window.partitionBy("_s").orderBy(order)) - 1)
    own = F.floor(F.col("_n") / size)
    s = s.withColumn("_home", own).withColumn("_chunk", F.explode(F.when(F.col("_n") % size >= size - overlap, F.array(own, own + 1)).otherwise(F.array(own))))
    return s.withColumn("_own", F.col("_chunk") == F.col("_home")).drop("_s", "_b", "_begin", "_n", "_home")


def rolling_corr(pairs: DataFrame, n: int, a: str = "a", b: str = "b", order: str = "bar_ts", key: str | None = None) -> DataFrame:
    """Adds rho of the last n pairs: 0 where it is undefined, held within 0.99. Without a key the rows are one series, dealt out in runs."""
    rows = pairs if key else chunked(pairs, order, n - 1)
    w = Window.partitionBy(key or "_chunk").orderBy(order).rowsBetween(-(n - 1), 0)
    ok = X.finite(a) & X.finite(b)
    rho = F.corr(F.when(ok, F.col(a)), F.when(ok, F.col(b))).over(w)
    rho = F.when(F.isnan(rho), 0.0).otherwise(F.coalesce(rho, F.lit(0.0)))
    out = rows.withColumn("rho", F.least(F.greatest(rho, F.lit(-0.99)), F.lit(0.99)))
    return out if key else out.where("_own").drop("_own", "_chunk")


def rho_cache(legs: DataFrame, n: int = 180, i: int = 1, j: int = 2) -> DataFrame:
    """Correlation of log returns between consecutive common bars of two of the aligned legs."""
    w = Window.partitionBy("_chunk").orderBy("bar_ts")
    r = lambda c: F.log(F.col(c) / F.lag(c).over(w))
    pairs = chunked(legs, "bar_ts", 1).withColumn("a", r(f"close_{i}")).withColumn("b", r(f"close_{j}"))
    return rolling_corr(pairs.where("_own AND a IS NOT NULL AND b IS NOT NULL").drop("_own", "_chunk"), n)


def synth_bar_rolling(legs: DataFrame, exps: tuple[int, ...] = (1, -1), n: int = 180, estimator: str = "rs") -> DataFrame:
    """synth_bar with the legs' own correlations over the last n common returns; 0 where a bar has none yet."""
    rho = {}
    rows = legs
    for i in range(1, len(exps) + 1):
        for j in range(i + 1, len(exps) + 1):
            name = f"_rho_{i}_{j}"
            own = rho_cache(legs, n, i, j).select("bar_ts", F.col("rho").alias(name))
            rows = rows.join(own, "bar_ts", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
            rho[i, j] = F.col(name)
    return synth_bar(rows, rho, exps, estimator)


def cross_bar(legs: DataFrame, exps: tuple[int, ...] = (1, -1)) -> DataFrame:
    """A 10-second cross bar: exact open and close, extremes from the corner products; flagged composed, no fast fields."""
    n = range(1, len(exps) + 1)
    every = lambda c: [F.col(f"{c}_{i}") for i in n]
    total = lambda cols: sum(cols[1:], cols[0])
    pick = lambda f, cols: f(*cols) if len(cols) > 1 else cols[0]
    o, c, hh, ll = (_product(f, exps) for f in ("open", "close", "high", "low"))
    ci = X.ci_encode(F.sqrt(total([F.pow(X.ci_decode(x), F.lit(2.0)) for x in every("avg_ci_ubp")])))
    out = legs.select(
        "bar_ts", o.alias("open"), F.greatest(o, c, hh, ll).alias("high"), F.least(o, c, hh, ll).alias("low"), c.alias("close"), pick(F.least, every("vbid")).alias("vbid"), pick(F.least, every("vask")).alias("vask"),
        pick(F.greatest, every("tick_count")).alias("tick_count"), total(every("avg_spread_bps")).alias("avg_spread_bps"), ci.alias("avg_ci_ubp"), pick(F.greatest, every("reject_rate")).alias("reject_rate"), F.lit(128).alias("flags"),
    )
    return out.where(X.sane_px("open") & X.sane_px("high") & X.sane_px("low") & X.sane_px("close") & (F.col("high") >= F.col("low")))
