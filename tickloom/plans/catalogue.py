"""More registered queries, small ones for single operators, each with its DuckDB SQL. Importing this adds them to ``queries.QUERIES``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import bars as B
from ..operators import composite as C
from ..operators import graph as G
from ..operators import ranges as R
from ..operators import resolve as N
from ..operators import sequential as Q
from ..operators import stats as S
from ..operators import synth as Y
from ..operators import vol as V
from ..session import table, ticks
from ..sources import codec
from ..streaming import live as L
from ..streaming import stateful as SF
from . import queries as P
from .queries import H30, MIN, S10, query, r

# bars


def _value_ticks(spark, d):  # noqa: ANN001, ANN202
    return ticks(spark, d).withColumn("mid", F.col("value").cast("double"))


@query(P._GUARD + f""", k AS (SELECT t.* FROM g JOIN o ON o.ticker = g.ticker AND o.n = g.n JOIN ticks t ON t.seq = o.seq WHERE g.ok)
SELECT ticker, tc_ms // {MIN} * {MIN} AS bar_ts, round(arg_min(value, (tc_ms, seq)), 8) AS open, round(max(value), 8) AS high, round(min(value), 8) AS low, round(arg_max(value, (tc_ms, seq)), 8) AS close, count(*) AS tick_count FROM k GROUP BY ALL""")
def ohlc_guarded(spark, d):  # noqa: ANN001, ANN201
    return B.ohlc(_value_ticks(spark, d), MIN).select("ticker", "bar_ts", r("open"), r("high"), r("low"), r("close"), "tick_count")


@query(f""", b AS (SELECT *, ts_ms // {S10} AS b FROM ticks), s AS (SELECT *, max(b) OVER (PARTITION BY ticker ORDER BY (seq * 7919) % 10007, seq) AS top FROM b)
SELECT ticker, b * {S10} AS bar_ts, round(max(mid), 8) AS high, round(min(mid), 8) AS low, count(*) AS tick_count FROM s WHERE b >= top GROUP BY ALL""")
def ohlc_late_dropped(spark, d):  # noqa: ANN001, ANN201
    """Rows in an arrival order that isn't that of time."""
    t = ticks(spark, d).withColumn("seq", (F.col("seq") * 7919) % 10007 * 100_000_000 + F.col("seq"))
    return B.ohlc_late_dropped(t, S10, "ts_ms").select("ticker", "bar_ts", r("high"), r("low"), "tick_count")


@query(f"""SELECT ticker, tc_ms // {MIN} * {MIN} AS bar_ts, tc_ms // {MIN} * {MIN} + {MIN - 1} AS close_ts, round(arg_min(mid, (tc_ms, seq)), 8) AS open, round(arg_max(mid, (tc_ms, seq)), 8) AS close, CAST(least(65535, round(sqrt(sum((ci / 16.0) * (ci / 16.0) * accepted) / sum(accepted)) * 16)) AS INT) AS avg_ci FROM ticks GROUP BY ALL""")
def bar_to_candle(spark, d):  # noqa: ANN001, ANN201
    return B.bar_to_ohlc(B.grid_stamped(B.full_bars(ticks(spark, d), MIN), MIN)).select("ticker", "bar_ts", "close_ts", r("open"), r("close"), "avg_ci")


@query("SELECT seq, least(4294967295, greatest(0, CAST(floor(mid * value + 0.5) AS BIGINT))) AS notional FROM ticks")
def quote_notional(spark, d):  # noqa: ANN001, ANN201
    return ticks(spark, d).select("seq", B.quote_notional("mid", "value").alias("notional"))


# volatility


@query(P._B30 + "SELECT 'gk' AS estimator, ticker, round(sqrt(avg(greatest(0, 0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2)))), 9) AS sigma FROM b GROUP BY ticker UNION ALL SELECT 'parkinson', ticker, round(sqrt(avg(pow(ln(high / low), 2) / (4 * ln(2)))), 9) FROM b GROUP BY ticker")
def vol_by_estimator(spark, d):  # noqa: ANN001, ANN201
    b = B.ohlc(ticks(spark, d), H30, "ts_ms")
    one = lambda e: V.sigma_by(e, b).select(F.lit(e).alias("estimator"), "ticker", r("sigma", 9))
    return one("gk").unionByName(one("parkinson"))


@query(P._B30 + "SELECT ticker, bar_ts, round(sqrt(avg(pow(ln(high / low), 2) / (4 * ln(2))) OVER (PARTITION BY ticker ORDER BY bar_ts ROWS 47 PRECEDING)) * sqrt(30 / 30.0), 9) AS sigma FROM b")
def vol_leg_sigma(spark, d):  # noqa: ANN001, ANN201
    leg = V.feed_legs([1440.0])[0]
    return V.rolling_sigma(B.ohlc(ticks(spark, d), H30, "ts_ms"), leg["bars"], leg["estimator"], leg["factor"]).select("ticker", "bar_ts", r("sigma", 9))


@query(P._B30 + """, s AS (SELECT ticker, bar_ts, sqrt(greatest(""" + P._RS + """, 0)) AS raw, max(bar_ts) OVER (PARTITION BY ticker) AS last, min(bar_ts) OVER (PARTITION BY ticker) AS beg FROM b),
q AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bar_ts) AS n FROM (SELECT ticker, bar_ts, CASE WHEN bar_ts < beg + 360000000 THEN NULL ELSE raw END AS raw, CASE WHEN bar_ts < beg + 360000000 THEN 0.02 + (bar_ts // 1800000 % 7) * 0.001 END AS known FROM s WHERE bar_ts < last)),
m AS (WITH RECURSIVE m(ticker, n, v) AS (SELECT ticker, n, CAST(known AS DOUBLE) FROM q WHERE n = 1 UNION ALL SELECT q.ticker, q.n, CASE WHEN known IS NOT NULL THEN known WHEN q.n <= 28 THEN m.v + (q.raw - m.v) / q.n ELSE m.v + 2.0 / 29 * (q.raw - m.v) END FROM m JOIN q ON q.ticker = m.ticker AND q.n = m.n + 1) SELECT * FROM m)
SELECT q.ticker, q.bar_ts AS bin_start_ms, round(v, 9) AS sigma FROM q JOIN m ON m.ticker = q.ticker AND m.n = q.n""")
def vol_primed(spark, d):  # noqa: ANN001, ANN201
    """The first hundred hours come from history as they are; later bins go on from there."""
    b = B.ohlc(ticks(spark, d), H30, "ts_ms")
    own = b.join(b.groupBy("ticker").agg(F.min("bar_ts").alias("beg"), F.max("bar_ts").alias("end")), "ticker").where("bar_ts < beg + 360000000 AND bar_ts < end")
    history = own.select("ticker", F.col("bar_ts").alias("bin_start_ms"), (0.02 + (F.floor(F.col("bar_ts") / H30) % 7) * 0.001).alias("sigma"))
    return V.vol_rows(b, src_ms=H30, history=history).select("ticker", "bin_start_ms", r("sigma", 9))


@query(P._V30 + """, x AS (SELECT q.ticker, q.bar_ts AS bin_start_ms, CASE WHEN q.n % 11 = 0 THEN -v ELSE v END AS sigma, row_number() OVER (PARTITION BY q.ticker ORDER BY q.bar_ts DESC) AS k FROM q JOIN m ON m.ticker = q.ticker AND m.n = q.n)
SELECT ticker, bin_start_ms, round(sigma, 9) AS sigma FROM x WHERE k <= 100 AND sigma >= 0""")
def vol_tail(spark, d):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    v = P._vol30(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy("bin_start_ms")))
    return R.vol_tail(v.withColumn("sigma", F.when(F.col("n") % 11 == 0, -F.col("sigma")).otherwise(F.col("sigma"))), 100).select("ticker", "bin_start_ms", r("sigma", 9))


@query(P._B30 + "SELECT ticker, bar_ts, round(close, 8) AS sigma FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bar_ts DESC) AS k FROM b) WHERE k <= 50")
def vol_append_trim(spark, d):  # noqa: ANN001, ANN201
    """Rows of the first half, then all rows appended: those that are there already aren't again."""
    v = B.ohlc(ticks(spark, d), H30, "ts_ms").select("ticker", "bar_ts", F.col("close").alias("sigma"))
    half = v.join(v.groupBy("ticker").agg(F.expr("percentile(bar_ts, 0.5)").alias("m")), "ticker").where("bar_ts <= m").drop("m")
    return R.vol_appended(half, v, 50, ts="bar_ts").select("ticker", "bar_ts", r("sigma"))


# composite helpers


@query("""SELECT seq, round(sqrt(mid * mid + value * value), 6) AS rss, round(least(50.0, greatest(0.0, value / 3)), 8) AS grid_bps, CASE WHEN ticker = 'click' THEN CAST(0.00025 AS DOUBLE) WHEN ticker = 'view' THEN 0.0008 ELSE 0.0002 END AS floor FROM ticks""")
def mark_helpers(spark, d):  # noqa: ANN001, ANN201
    kind = F.when(F.col("ticker") == "click", "FX").when(F.col("ticker") == "view", "CR").otherwise("STABLE")
    return ticks(spark, d).select("seq", r(C.rss("mid", "value"), 6, "rss"), r(C.mark_grid_bps("value", 3.0, 50.0), 8, "grid_bps"), X.class_floor(kind).alias("floor"))


@query("""SELECT ticker, cycle, round(arg_max(mid, (vbid, provider)), 8) AS mid, round(least(max(vbid) + 0.5 * (sum(CASE WHEN abs(mid / m - 1) * 1e4 <= 25 AND vbid >= 0.1 * d THEN vbid ELSE 0 END) - max(vbid)), 2 * max(vbid)), 6) AS volume
FROM (SELECT *, arg_max(mid, (vbid, provider)) OVER p AS m, max(vbid) OVER p AS d FROM (SELECT ticker, provider, tc_ms // 600000 AS cycle, arg_max(mid, (tc_ms, seq)) AS mid, CAST(arg_max(vbid, (tc_ms, seq)) + 1 + any_value(provider) * 0.01 AS DOUBLE) AS vbid FROM ticks GROUP BY ALL) WINDOW p AS (PARTITION BY ticker, cycle)) GROUP BY ticker, cycle""")
def multi_market(spark, d):  # noqa: ANN001, ANN201
    at = F.struct("tc_ms", "seq")
    t = ticks(spark, d).groupBy("ticker", "provider", F.floor(F.col("tc_ms") / 600_000).alias("cycle")).agg(F.max_by("mid", at).alias("mid"), (F.max_by("vbid", at) + 1 + F.col("provider") * 0.01).alias("volume"))
    return C.multi_market(t, ["ticker", "cycle"]).select("ticker", "cycle", r("mid"), r("volume", 6))


@query(f""", b AS (SELECT ticker, tc_ms // {MIN} AS minute, arg_max(mid, (tc_ms, seq)) AS m FROM ticks GROUP BY ALL), p AS (SELECT 'x' AS ticker, a.minute, a.m AS leg, b.m AS refm FROM b a JOIN b ON a.minute = b.minute AND a.ticker = 'click' AND b.ticker = 'view')
SELECT minute, round(greatest(-0.02, least(0.02, median(ln(leg / refm)) OVER (ORDER BY minute RANGE 29 PRECEDING))), 8) AS basis FROM p""")
def parity_basis(spark, d):  # noqa: ANN001, ANN201
    b = B.last_in_window(ticks(spark, d), MIN).select("ticker", (F.col("window_ts") / MIN).cast("long").alias("minute"), "mid")
    p = b.where("ticker = 'click'").select("minute", F.lit("x").alias("ticker"), F.col("mid").alias("leg_mid")).join(b.where("ticker = 'view'").select("minute", F.col("mid").alias("ref_mid")), "minute")
    return C.parity_basis(p).select("minute", r("basis"))


@query("""SELECT seq, round(coalesce(p, spare * last_value(p / spare IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY tc_ms, seq)), 8) AS price FROM (SELECT *, CASE WHEN seq % 5 <> 0 THEN mid END AS p, value + 1 AS spare FROM ticks)""")
def price_fallback(spark, d):  # noqa: ANN001, ANN201
    t = ticks(spark, d).withColumn("primary", F.when(F.col("seq") % 5 != 0, F.col("mid"))).withColumn("spare", F.col("value") + 1).withColumn("at", F.struct("tc_ms", "seq"))
    return C.fallback(t, "ticker", "at", "primary", "spare").select("seq", r("price"))


@query(P._O + """, b AS (SELECT *, value > 100 AS breach FROM o), g AS (WITH RECURSIVE g(ticker, n, gone, run) AS (SELECT ticker, n, false, CASE WHEN breach THEN 1 ELSE 0 END FROM b WHERE n = 1
  UNION ALL SELECT ticker, n, CASE WHEN run >= 3 THEN NOT gone ELSE gone END, CASE WHEN run >= 3 THEN 0 ELSE run END FROM (SELECT b.ticker, b.n, g.gone, CASE WHEN b.breach <> g.gone THEN g.run + 1 ELSE 0 END AS run FROM g JOIN b ON b.ticker = g.ticker AND b.n = g.n + 1)) SELECT * FROM g)
SELECT o.ticker, tc_ms AS ts, seq, NOT gone AS admitted FROM g JOIN o ON o.ticker = g.ticker AND o.n = g.n""")
def basis_gate(spark, d):  # noqa: ANN001, ANN201
    t = ticks(spark, d).select("ticker", F.col("tc_ms").alias("ts"), "seq", (F.col("value") > 100).alias("breach"))
    return Q.basis_gate(t, 3)


# renko


@query("SELECT seq, round(CASE WHEN abs(x - floor(x / (u * 2) + 0.5) * u * 2) <= abs(x - floor(x / (u * 5) + 0.5) * u * 5) THEN floor(x / (u * 2) + 0.5) * u * 2 ELSE floor(x / (u * 5) + 0.5) * u * 5 END, 9) AS brick FROM (SELECT *, pow(10, floor(log10(x)) - 3) AS u FROM (SELECT seq, mid * greatest(CAST(CAST(0.075 AS FLOAT) AS DOUBLE) * (value + 1) / 1000, CAST(CAST(0.002 AS FLOAT) AS DOUBLE)) AS x FROM ticks))")
def renko_brick_size(spark, d):  # noqa: ANN001, ANN201
    return ticks(spark, d).select("seq", r(X.brick_size("mid", (F.col("value") + 1) / 1000, 0.075, 0.002), 9, "brick"))


_CLASSES = "SELECT o_orderkey, o_orderkey % 7 AS k, CAST(CASE o_orderkey % 7 WHEN 3 THEN 3 WHEN 4 THEN 3 WHEN 6 THEN 4 ELSE 6 END AS INT) AS b, CAST(CASE o_orderkey % 7 WHEN 3 THEN 3 WHEN 4 THEN 3 WHEN 6 THEN 0 ELSE 6 END AS INT) AS q FROM orders"


def _classes(spark, d):  # noqa: ANN001, ANN202
    k = F.col("o_orderkey") % 7
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int"))
    t = table(spark, d, "orders").select("o_orderkey", pick("btc", "SOL", "DAI", "EUR", "EUR", "SOL", "WTI").alias("base"), pick("USDT", "USDT", "USDC", "usd", "THB", "BTC", "AAPL").alias("quote"), pick(6, 6, 6, 3, 3, 6, 4).alias("b"), pick(6, 6, 6, 3, 3, 6, 0).alias("q"))
    return t.withColumn("ticker_id", X.make_ticker(0, F.col("b"), 1, F.col("q"), 2))


@query(f"SELECT o_orderkey, CASE k WHEN 0 THEN 'crypto_major' WHEN 1 THEN 'crypto_alt' WHEN 2 THEN 'crypto_stable' WHEN 3 THEN 'fx_major' WHEN 4 THEN 'fx_cross' WHEN 5 THEN 'crypto_cross' ELSE 'default' END AS bucket FROM ({_CLASSES})", raw=True)
def class_bucket(spark, d):  # noqa: ANN001, ANN201
    return _classes(spark, d).select("o_orderkey", X.bucket_class("ticker_id").alias("bucket"))


@query(f"SELECT o_orderkey, CASE WHEN k = 2 THEN 0.0002e0 WHEN k = 1 THEN 0.00025e0 WHEN b = 3 THEN 0.00025e0 WHEN b = 4 THEN 0.0014e0 ELSE 0.0008e0 END AS floor, CASE WHEN b = 6 THEN 'ALT' ELSE 'FX_METAL' END AS kernel, round(CASE WHEN k = 0 THEN {10 * X.kernel_sigma(6.0)!r} ELSE {X.kernel_sigma(6.0)!r} END, 12) AS sigma FROM ({_CLASSES})", raw=True)
def class_floors(spark, d):  # noqa: ANN001, ANN201
    k = F.col("o_orderkey") % 7
    peg = F.when(k == 2, "same_numeraire").when(k == 1, "cross_fiat")
    measured = F.when(k == 0, 1.0).when(k == 1, float("nan")).otherwise(0.0)
    return _classes(spark, d).select("o_orderkey", X.sigma_floor("ticker_id", peg).alias("floor"), X.wire_kernel("ticker_id").alias("kernel"), r(X.clamped_sigma(measured, "MAJOR"), 12, "sigma"))


@query(P._renko_sql(1.0, 0.0) + "SELECT ticker, ts, seq, round(close, 8) AS close FROM bricks WHERE flags & 4 = 0")
def renko_real_bricks(spark, d):  # noqa: ANN001, ANN201
    return R.without_synthetic(Q.renko(ticks(spark, d), k=1.0, ts="ts_ms")).select("ticker", "ts", "seq", r("close"))


# crosses of three legs

_LEG3 = P._FULL_BARS + """, j AS (SELECT x.bar_ts, x.o * y.o / z.o AS o, x.c * y.c / z.c AS c, x.v AS v1, y.v AS v2, z.v AS v3, x.rv AS r1, y.rv AS r2, z.rv AS r3, greatest(x.ci, y.ci, z.ci) AS ci, CASE WHEN x.ci >= y.ci AND x.ci >= z.ci THEN x.n WHEN y.ci >= z.ci THEN y.n ELSE z.n END AS n,
 greatest(x.o * y.o / z.o, x.c * y.c / z.c, x.h * y.h / z.h, x.l * y.l / z.l) AS hh, least(x.o * y.o / z.o, x.c * y.c / z.c, x.h * y.h / z.h, x.l * y.l / z.l) AS ll FROM fv x JOIN fv y ON x.bar_ts = y.bar_ts AND x.ticker = 'click' AND y.ticker = 'view' JOIN fv z ON z.bar_ts = x.bar_ts AND z.ticker = 'error'),
k AS (SELECT *, sqrt(4 * ln(2) * greatest(v1 + v2 + v3 + 2 * 0.3 * sqrt(v1 * v2) - 2 * 0.2 * sqrt(v2 * v3), 1e-12)) / 2 AS half, greatest(r1 + r2 + r3 + 2 * 0.3 * sqrt(r1 * r2) - 2 * 0.2 * sqrt(r2 * r3), 0) AS rv FROM j)
"""
_PATH3, _EXPS3, _RHO3 = ["click", "view", "error"], (1, 1, -1), {(1, 2): 0.3, (2, 3): 0.2}


@query(_LEG3 + "SELECT bar_ts, round(o, 6) AS open, round(greatest(sqrt(o * c) * exp(half), o, c), 6) AS high, round(least(sqrt(o * c) * exp(-half), o, c), 6) AS low, round(c, 6) AS close, round(rv, 8) AS realized_var, ci AS avg_ci_ubp, n AS tick_count FROM k")
def synth_bar_three_legs(spark, d):  # noqa: ANN001, ANN201
    legs = Y.aligned_legs(B.full_bars(ticks(spark, d), MIN), _PATH3)
    return Y.synth_bar(legs, _RHO3, _EXPS3).select("bar_ts", r("open", 6), r("high", 6), r("low", 6), r("close", 6), r("realized_var"), "avg_ci_ubp", "tick_count")


@query(_LEG3 + "SELECT bar_ts // 600000 * 600000 AS dst_ts, round(arg_min(o, bar_ts), 6) AS open, round(max(greatest(sqrt(o * c) * exp(half), o, c)), 6) AS high, round(min(least(sqrt(o * c) * exp(-half), o, c)), 6) AS low, round(arg_max(c, bar_ts), 6) AS close, count(*) AS n FROM k GROUP BY ALL")
def synth_ohlc_rollup(spark, d):  # noqa: ANN001, ANN201
    legs = Y.aligned_legs(B.full_bars(ticks(spark, d), MIN), _PATH3)
    return Y.ohlc_monoid(Y.synth_ohlc(legs, _RHO3, _EXPS3), 600_000).select("dst_ts", r("open", 6), r("high", 6), r("low", 6), r("close", 6), "n")


@query(_LEG3 + "SELECT bar_ts, round(o, 6) AS open, round(hh, 6) AS high, round(ll, 6) AS low, round(c, 6) AS close, 128 AS flags FROM k")
def cross_bar_three_legs(spark, d):  # noqa: ANN001, ANN201
    legs = Y.aligned_legs(B.full_bars(ticks(spark, d), MIN), _PATH3)
    return Y.cross_bar(legs, _EXPS3).select("bar_ts", r("open", 6), r("high", 6), r("low", 6), r("close", 6), "flags")


@query(P._FULL_BARS + """, j AS (SELECT x.bar_ts, x.o / y.o AS o, x.c / y.c AS c, x.v AS v1, y.v AS v2, x.rv AS r1, y.rv AS r2, ln(x.c / lag(x.c) OVER w) AS a, ln(y.c / lag(y.c) OVER w) AS b FROM fv x JOIN fv y ON x.bar_ts = y.bar_ts AND x.ticker = 'click' AND y.ticker = 'view' WINDOW w AS (ORDER BY x.bar_ts)),
p AS (SELECT bar_ts, row_number() OVER (ORDER BY bar_ts) AS n, corr(a, b) OVER (ORDER BY bar_ts ROWS 59 PRECEDING) AS rho FROM j WHERE a IS NOT NULL), k AS (SELECT j.*, CASE WHEN p.n IS NULL OR p.n < 2 OR isnan(p.rho) THEN 0 ELSE least(0.99, greatest(-0.99, p.rho)) END AS rho FROM j LEFT JOIN p ON p.bar_ts = j.bar_ts),
m AS (SELECT *, sqrt(4 * ln(2) * greatest(v1 + v2 - 2 * rho * sqrt(v1 * v2), 1e-12)) / 2 AS half FROM k)
SELECT bar_ts, round(greatest(sqrt(o * c) * exp(half), o, c), 6) AS high, round(least(sqrt(o * c) * exp(-half), o, c), 6) AS low, round(greatest(r1 + r2 - 2 * rho * sqrt(r1 * r2), 0), 8) AS realized_var FROM m""")
def synth_bar_rolling_rho(spark, d):  # noqa: ANN001, ANN201
    return Y.synth_bar_rolling(P._full_pair(spark, d), n=60).select("bar_ts", r("high", 6), r("low", 6), r("realized_var"))


# graph: nations that trade with nations of their region, and with one of another

_GRAPH = """WITH RECURSIVE p AS (SELECT a.n_nationkey * 100 + b.n_nationkey AS ticker_id, a.n_name AS base, b.n_name AS quote, a.n_name || '/' || b.n_name AS sym, CAST((a.n_nationkey * 7 + b.n_nationkey * 3) % 11 AS DOUBLE) AS volume FROM nation a JOIN nation b ON (a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey AND (a.n_nationkey + b.n_nationkey) % 3 <> 0) OR b.n_nationkey = a.n_nationkey + 6),
e AS (SELECT base AS src, quote AS dst, sym, ticker_id, volume FROM p UNION ALL SELECT quote, base, sym, ticker_id, volume FROM p),
w AS (SELECT src, dst, [src, dst] AS seen, [sym] AS legs, [ticker_id] AS ids, volume FROM e UNION ALL SELECT w.src, e.dst, list_append(w.seen, e.dst), list_append(w.legs, e.sym), list_append(w.ids, e.ticker_id), least(w.volume, e.volume) FROM w JOIN e ON e.src = w.dst WHERE len(w.legs) < 3 AND NOT list_contains(w.seen, e.dst))
"""


def _nation_edges(spark, d):  # noqa: ANN001, ANN202
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    a, b = (n.select(*[F.col(c).alias(f"{s}_{c[2:]}") for c in n.columns]) for s in "ab")
    near = (F.col("a_regionkey") == F.col("b_regionkey")) & (F.col("a_nationkey") < F.col("b_nationkey")) & ((F.col("a_nationkey") + F.col("b_nationkey")) % 3 != 0)
    p = a.join(b, near).unionByName(a.join(b, F.col("b_nationkey") == F.col("a_nationkey") + 6)).distinct()
    p = p.select(F.concat_ws("/", "a_name", "b_name").alias("sym"), F.col("a_name").alias("base"), F.col("b_name").alias("quote"), (F.col("a_nationkey") * 100 + F.col("b_nationkey")).cast("long").alias("ticker_id"), ((F.col("a_nationkey") * 7 + F.col("b_nationkey") * 3) % 11).cast("double").alias("volume"))
    return p, G.edges(p.drop("volume"), p.select("sym", "volume"))


@query(_GRAPH + "SELECT src, dst, CAST(len(legs) AS INT) AS hops, volume AS bottleneck, array_to_string(legs, ' ') AS legs FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY len(legs), volume DESC, legs) AS r FROM w) WHERE r = 1", raw=True)
def nation_routes(spark, d):  # noqa: ANN001, ANN201
    e = _nation_edges(spark, d)[1]
    return G.routes(e).select("src", "dst", "hops", "bottleneck", F.array_join(F.transform("legs", lambda x: x["sym"]), " ").alias("legs"))


@query(_GRAPH + ", v AS (SELECT w.* FROM w LEFT JOIN p ON p.base = w.src AND p.quote = w.dst WHERE p.ticker_id IS NULL OR NOT list_contains(w.ids, p.ticker_id)) SELECT src, dst, CAST(len(legs) AS INT) AS hops, array_to_string(legs, ' ') AS legs FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY len(legs), volume DESC, legs) AS r FROM v) WHERE r = 1", raw=True)
def nation_decomposed(spark, d):  # noqa: ANN001, ANN201
    """Routes that a pair's own ticker doesn't serve."""
    p, e = _nation_edges(spark, d)
    own = p.select(F.col("base").alias("src"), F.col("quote").alias("dst"), "ticker_id")
    return G.routes(e, own).select("src", "dst", "hops", F.array_join(F.transform("legs", lambda x: x["sym"]), " ").alias("legs"))


@query(_GRAPH + "SELECT DISTINCT src, dst FROM w", raw=True)
def nation_servable(spark, d):  # noqa: ANN001, ANN201
    return G.servable(_nation_edges(spark, d)[1])


@query(_GRAPH + """, b AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY len(legs), volume DESC, legs) AS r FROM w), l AS (SELECT src, dst, unnest(ids) AS id FROM b WHERE r = 1), q AS (SELECT src, dst, CAST(id % 13 AS DOUBLE) AS age, CAST(id % 300 AS INT) AS ci, CAST(id % 5 AS INT) AS accepted, id % 3 <> 0 AS fresh FROM l)
SELECT src, dst, max(age) AS age, CAST(CASE WHEN min(ci) = 0 THEN 0 ELSE least(65535, round(sqrt(sqrt(sum(pow(ci / 16.0, 4)))) * 16)) END AS INT) AS ci, min(accepted) AS accepted, bool_and(fresh) AS fresh FROM q GROUP BY ALL""", raw=True)
def nation_composed(spark, d):  # noqa: ANN001, ANN201
    p, e = _nation_edges(spark, d)
    i = F.col("ticker_id")
    q = p.select("sym", (i % 13).cast("double").alias("age"), (i % 300).cast("int").alias("ci"), (i % 5).cast("int").alias("accepted"), (i % 3 != 0).alias("fresh"))
    return G.composed(G.routes(e), q)


@query("SELECT s_suppkey, CAST((s_suppkey % 16) AS BIGINT) AS quote_class, CAST((s_suppkey * 31) % 65536 AS BIGINT) AS quote_id, CAST(7 AS BIGINT) AS base_class, CAST(s_suppkey % 65536 AS BIGINT) AS base_id FROM supplier", raw=True)
def inverse_ticker(spark, d):  # noqa: ANN001, ANN201
    k = F.col("s_suppkey").cast("long")
    t = table(spark, d, "supplier").select("s_suppkey", X.inverse_ticker(X.make_ticker(0, k % 16, (k * 31) % 65536, 7, k % 65536)).alias("id"))
    return t.select("s_suppkey", *[c for c in X.ticker_parts("id") if any(n in str(c) for n in ("quote_class", "quote_id", "base_class", "base_id"))])


@query("""WITH t AS (SELECT s_suppkey, (s_suppkey % 2) * 3 + 3 AS bc, s_suppkey % 50 AS bi FROM supplier) SELECT s_suppkey, (CAST(bc AS BIGINT) << 56) | (CAST(CASE WHEN bc = 6 AND bi < 10 THEN bi + 1000 ELSE bi END AS BIGINT) << 40) | (CAST(3 AS BIGINT) << 36) | (CAST(101 AS BIGINT) << 20) AS alias_id FROM t""", raw=True)
def series_alias(spark, d):  # noqa: ANN001, ANN201
    k = F.col("s_suppkey").cast("long")
    t = table(spark, d, "supplier").select("s_suppkey", X.make_ticker(0, (k % 2) * 3 + 3, k % 50, 3, 101).alias("ticker_id"))
    wraps = spark.range(10).select(X.asset_key(F.lit(6), F.col("id")).alias("wrapped"), X.asset_key(F.lit(6), F.col("id") + 1000).alias("underlying"))
    return G.rebased(t, wraps).select("s_suppkey", "alias_id")


# admission


@query("""WITH t AS (SELECT p_partkey AS k FROM part), f AS (SELECT k, k % 9 = 0 AS perp, k % 7 AS b, k % 5 AS q FROM t)
SELECT k, CASE WHEN perp THEN 'shape' WHEN b IN (0, 3) THEN 'base' WHEN q = 3 THEN 'quote' END AS refusal FROM f""", raw=True)
def admissible(spark, d):  # noqa: ANN001, ANN201
    """Assets 1 to 6 of class 6 are registered, 3 is on the black list."""
    k = F.col("p_partkey").cast("long")
    t = table(spark, d, "part").select(k.alias("k"), X.make_ticker(F.when(k % 9 == 0, 1).otherwise(0), 6, k % 7, 6, F.when(k % 5 == 0, 6).otherwise(k % 5)).alias("ticker_id"))
    a = spark.range(1, 7).select(F.col("id").alias("asset_id"), F.concat(F.lit("n"), "id").alias("name"), F.array(F.concat(F.lit("ALIAS"), "id")).alias("aliases"), X.asset_key(F.lit(6), "id").alias("asset_key"))
    return R.admissible(t, R.blacklisted(a, ["alias3"])).select("k", "refusal")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN true WHEN o_orderkey % 4 = 1 THEN false END AS stored, o_orderkey % 4 = 2 AS pegged FROM orders", raw=True)
def orientation(spark, d):  # noqa: ANN001, ANN201
    k = F.col("o_orderkey") % 4
    p = table(spark, d, "orders").select("o_orderkey", F.when(k == 0, "EUR").when(k == 1, "USD").when(k == 2, "dai").otherwise("SOL").alias("base"), F.when(k == 0, "USD").when(k == 1, "JPY").when(k == 2, "USDC").otherwise("BTC").alias("quote"))
    return R.pegged_pairs(R.orientation(p, {"EUR": "USD"}), ("DAI", "USDC")).select("o_orderkey", "stored", "pegged")


@query("""SELECT seq, CASE WHEN ts_ms > 1705000000000 + 60000 THEN 'future' WHEN ts_ms < 1705000000000 AND seq % 3 <> 0 AND ts_ms < 1704400000000 THEN 'past' END AS quarantine FROM ticks""")
def writer_bounds(spark, d):  # noqa: ANN001, ANN201
    """Quotes before a time, moved back by two years, are too old unless they are a backfill."""
    t = ticks(spark, d).withColumn("flags", F.when(F.col("seq") % 3 == 0, 2).otherwise(0)).withColumn("at", F.when(F.col("ts_ms") < 1704400000000, F.col("ts_ms") - 731 * 86_400_000).otherwise(F.col("ts_ms")))
    return Q.time_bounded(t, 1705000000000, "at").select("seq", "quarantine")


@query("SELECT ticker, provider, CASE WHEN date_diff('day', CAST(to_timestamp(max(ts_ms) / 1000) AT TIME ZONE 'UTC' AS DATE), DATE '2024-02-02') > 3 THEN 'stale' ELSE 'live' END AS status FROM ticks GROUP BY ALL")
def shard_status(spark, d):  # noqa: ANN001, ANN201
    last = ticks(spark, d).groupBy("ticker", "provider").agg(F.to_date(F.timestamp_millis(F.max("ts_ms"))).alias("day"))
    return last.select("ticker", "provider", X.shard_status("day", F.lit("2024-02-02").cast("date")).alias("status"))


# ranges


@query("SELECT seq, tc_ms FROM ticks WHERE ticker = 'click' AND tc_ms > 1704070000000 AND tc_ms <= 1704085000000 ORDER BY tc_ms, seq LIMIT 300")
def history_builder(spark, d):  # noqa: ANN001, ANN201
    from ..api import Market

    m = Market(spark, {"idx": ticks(spark, d).drop("ts_ms")})
    return m.get().history().pair("click").idx().cursor(1704070000000).end(1704085000000).limit(300).fetch().select("seq", "tc_ms")


@query("SELECT ticker, CAST(arg_max(seq, (tc_ms, seq)) AS BIGINT) AS seq FROM ticks WHERE ticker IN ('click', 'view') GROUP BY ticker")
def last_of_idents(spark, d):  # noqa: ANN001, ANN201
    return R.last_per_key(R.idents(ticks(spark, d), ["click", "view"]), "tc_ms").select("ticker", "seq")


@query("SELECT ticker, CAST(unnest(generate_series(min(epoch_ms(ts_ms))::DATE, max(epoch_ms(ts_ms))::DATE, INTERVAL 1 DAY))::DATE AS VARCHAR) AS day FROM ticks WHERE seq % 9 = 0 AND value > 60 GROUP BY ticker")
def day_range(spark, d):  # noqa: ANN001, ANN201
    """Days from the first to the last of the rare large values of a ticker."""
    return R.days_of(ticks(spark, d).where("seq % 9 = 0 AND value > 60")).select("ticker", F.col("day").cast("string").alias("day"))


@query("SELECT seq, provider FROM (SELECT seq, 60 + seq % 400 AS provider FROM ticks) WHERE provider NOT IN (71, 361, 371)")
def excluded_providers(spark, d):  # noqa: ANN001, ANN201
    return R.without_excluded(ticks(spark, d).withColumn("provider", 60 + F.col("seq") % 400)).select("seq", "provider")


@query("""SELECT ticker, count(DISTINCT provider) AS total, array_to_string(list_sort(list(DISTINCT provider))[1:3], ',') AS providers FROM ticks GROUP BY ticker""")
def markets_detail(spark, d):  # noqa: ANN001, ANN201
    return R.markets(ticks(spark, d), 3).select("ticker", F.col("total").cast("long").alias("total"), F.concat_ws(",", F.transform("providers", lambda x: x.cast("string"))).alias("providers"))


@query("""SELECT ticker, provider, round((1704093120000 - max(tc_ms)) / 1000.0, 3) AS age_s FROM ticks GROUP BY ticker, provider HAVING 1704093120000 - max(tc_ms) <= 2000000""")
def max_age(spark, d):  # noqa: ANN001, ANN201
    t = ticks(spark, d).withColumn("leg", F.struct("ticker", "provider"))
    return R.last_status(t, "tc_ms", 1704093120000, "leg", 2_000_000).select("leg.ticker", "leg.provider", r("age_s", 3))


@query(""", l AS (SELECT ticker, arg_max(mid, (tc_ms, seq)) AS mid FROM ticks GROUP BY ticker) SELECT ticker AS asset, round(mid, 8) AS price, round(CASE WHEN ticker = 'view' THEN mid WHEN ticker = 'click' THEN mid * 1.25 END, 8) AS quote_price FROM l""")
def last_in_quote(spark, d):  # noqa: ANN001, ANN201
    last = R.last_per_key(ticks(spark, d), "tc_ms").select("ticker", "mid")
    storage = last.select(F.col("ticker").alias("asset"), "ticker", F.when(F.col("ticker") == "view", "EUR").when(F.col("ticker") == "click", "USD").otherwise("XXX").alias("quote"))
    rates = spark.createDataFrame([("USD", "EUR", 1.25), ("EUR", "USD", 0.8)], "src string, dst string, rate double")
    return R.last_in_quote(last, rates, storage, "EUR").select("asset", r("price"), r("quote_price"))


@query("SELECT seq, CAST((tc_ms - 2000) // 86400000 AS BIGINT) AS s10_day, CAST((tc_ms - 4000) // 86400000 AS BIGINT) AS renko_day FROM ticks")
def routed_days(spark, d):  # noqa: ANN001, ANN201
    t = ticks(spark, d)
    a = R.routed_days(t, "s10", "tc_ms").select("seq", F.unix_date("dt").cast("long").alias("s10_day"))
    return a.join(R.routed_days(t, "renko", "tc_ms").select("seq", F.unix_date("dt").cast("long").alias("renko_day")), "seq")


# statistics and scalars


@query("SELECT seq, round(CASE WHEN value = 0 THEN 0 ELSE sign(value) * floor(abs(value) * pow(10, 2 - floor(log10(abs(value)))) + 0.5) / pow(10, 2 - floor(log10(abs(value)))) END, 9) AS sig3, round((bid + ask) * 0.5, 9) AS mid, round((ask - bid) / ((bid + ask) * 0.5) * 1e4, 9) AS spread_bps FROM ticks")
def scalar_prices(spark, d):  # noqa: ANN001, ANN201
    return ticks(spark, d).select("seq", r(X.round_sig("value", 3), 9, "sig3"), r(X.mid(), 9, "mid"), r(X.spread_bps(), 9, "spread_bps"))


@query(P._LAG.replace("SELECT ticker, bucket, count(*)", "SELECT ticker, bucket, 2 * count(*)") + "SELECT ticker, bucket, CAST(n AS BIGINT) AS n, worst FROM h")
def lag_merge(spark, d):  # noqa: ANN001, ANN201
    h = S.lag_histogram(ticks(spark, d).withColumn("ms", F.floor("value")), "ticker", "ms")
    return S.merged(h, h)


@query("SELECT seq, CASE WHEN vbid < 50 OR vask < 40 THEN vbid ELSE vbid - 50 END AS a, CASE WHEN vbid < 50 OR vask < 40 THEN vask ELSE vask - 40 END AS b FROM ticks")
def lag_since(spark, d):  # noqa: ANN001, ANN201
    g = S.since(F.array(F.col("vbid"), F.col("vask")), F.array(F.lit(50).cast("long"), F.lit(40).cast("long")))
    return ticks(spark, d).select("seq", g[0].alias("a"), g[1].alias("b"))


@query("SELECT c_custkey, sha256(c_name) AS digest FROM customer", raw=True)
def content_hash(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "customer").select("c_custkey", F.sha2(F.col("c_name").cast("binary"), 256).alias("digest"))


@query("SELECT seq, CASE WHEN f & 64 <> 0 THEN c & 127 WHEN f & 8 <> 0 THEN NULL ELSE c END AS live, CAST(CASE WHEN f & 64 <> 0 THEN CASE WHEN c & 128 <> 0 THEN 10000 ELSE 0 END WHEN f & 8 <> 0 THEN floor(c * 10000 / 255) ELSE 0 END AS INT) AS bps FROM (SELECT seq, CAST(seq % 256 AS INT) AS c, CAST(seq % 3 * 8 * CASE WHEN seq % 3 = 2 THEN 4 ELSE 1 END AS INT) AS f FROM ticks)")
def confidence_bytes(spark, d):  # noqa: ANN001, ANN201
    t = ticks(spark, d).select("seq", (F.col("seq") % 256).cast("int").alias("c"), (F.col("seq") % 3 * 8 * F.when(F.col("seq") % 3 == 2, 4).otherwise(1)).cast("int").alias("f"))
    return t.select("seq", X.confidence_count("c", "f").alias("live"), X.confidence_bps("c", "f").alias("bps"))


# codecs


@query(f"""SELECT ticker, 1262304000000 + ((tc_ms // {MIN} * {MIN} - 1262304000000) * 1000 // 16) * 16 // 1000 AS open_ms, arg_min(mid, (tc_ms, seq)) AS open, max(mid) AS high, CAST(sum(vbid) AS BIGINT) AS vbid, count(*) AS tick_count FROM ticks GROUP BY ticker, tc_ms // {MIN}""")
def bar_codec_roundtrip(spark, d):  # noqa: ANN001, ANN201
    b = B.full_bars(ticks(spark, d), MIN).select("ticker", X.ms_to_mts("bar_ts").alias("open_mts"), X.ms_to_mts("bar_ts").alias("close_mts"), "open", "high", "low", "close", "vbid", "vask", "tick_count")
    blobs = codec.encode_rows(b, "bar", ["ticker"], ["open_mts"])
    return codec.bar_view(codec.decode_column(blobs, "bar", label="ticker")).select("ticker", "open_ms", "open", "high", "vbid", "tick_count")


@query(P._V30 + "SELECT q.ticker, 1262304000000 + ((q.bar_ts - 1262304000000) * 1000 // 16) * 16 // 1000 AS ms, round(v, 12) AS sigma FROM q JOIN m ON m.ticker = q.ticker AND m.n = q.n")
def vol_codec_torn(spark, d):  # noqa: ANN001, ANN201
    """Volatility files with a torn record at their end, which the lenient reader leaves out."""
    v = P._vol30(spark, d).select("ticker", X.ms_to_mts("bin_start_ms").alias("mts"), "sigma")
    blobs = codec.encode_rows(v, "vol", ["ticker"], ["mts"]).withColumn("content", F.concat("content", F.lit(b"torn").cast("binary")))
    return codec.decode_column(blobs, "vol", strict=False, label="ticker").select("ticker", X.mts_to_ms("mts").alias("ms"), r("sigma", 12))


@query("SELECT seq, round((p >> 12) * pow(10.0, (p & 127) - 64 - ((p >> 7) & 31)), 6) AS price FROM (SELECT seq, (CAST(floor(value * 100) AS BIGINT) << 12) | (2 << 7) | 64 AS p FROM ticks)")
def signed_price(spark, d):  # noqa: ANN001, ANN201
    p = F.shiftleft(F.floor(F.col("value") * 100).cast("long"), 12).bitwiseOR(F.lit((2 << 7) | 64).cast("long"))
    return ticks(spark, d).select("seq", r(codec.b64_price_column(p), 6, "price"))


@query("SELECT event_id AS id FROM events", raw=True)
def id_list_frames(spark, d):  # noqa: ANN001, ANN201
    """Ids as packed little-endian lists, a blob for each ticker, and back."""
    le = F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex("event_id"), 16, "0"), F.lit("(..)"), 1)), ""))
    blobs = table(spark, d, "events").groupBy(F.col("event_type").alias("path")).agg(F.unhex(F.array_join(F.collect_list(F.hex(le)), "")).alias("content"))
    return codec.decoded_frames(blobs, "ids").select("id")


# symbols

_NORM = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[!-*,./:-@\[-`{{-~]+$', ''), '^the ', ''), '^(.*?) (corporation|company|inc|corp|ltd|llc|limited|group|cie)$', '\1'), '[^\p{{L}}\p{{N}}+-]', '', 'g')"""
_STRIP = r"""regexp_replace(regexp_replace(lower({0}), '^[\^.$#_]', ''), '[-_.$^#](us|m|c|z|b|r|d|i)$', '')"""
_SPELLINGS = """s AS (SELECT DISTINCT symbol FROM (SELECT unnest([lower(n_name), '^' || n_name, n_name || '.US', substr(n_name, 1, 3), substr(n_name, 1, length(n_name) - 1), 'x' || n_name, ' The ' || n_name || ' Corp.', reverse(n_name)]) AS symbol FROM nation))"""


def _nation_registry(spark, d):  # noqa: ANN001, ANN202
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.array(F.substring("n_name", 1, 3)).alias("aliases"), F.lit("EQ").alias("class"), F.lit(0).alias("class_id"), (F.col("n_nationkey") + 1).cast("int").alias("asset_id"))
    g = table(spark, d, "region").select(F.col("r_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit("IN").alias("class"), F.lit(9).alias("class_id"), (F.col("r_regionkey") + 1).cast("int").alias("asset_id"))
    return n.unionByName(g)


def _spellings(spark, d):  # noqa: ANN001, ANN202
    n = F.col("n_name")
    every = F.array(F.lower(n), F.concat(F.lit("^"), n), F.concat(n, F.lit(".US")), F.substring(n, 1, 3), F.substring(n, F.lit(1), F.length(n) - 1), F.concat(F.lit("x"), n), F.concat(F.lit(" The "), n, F.lit(" Corp.")), F.reverse(n))
    return table(spark, d, "nation").select(F.explode(every).alias("symbol"))


_REG = f"""r AS (SELECT n_name AS name, 'EQ' AS class, 0 AS class_id, CAST(n_nationkey + 1 AS INT) AS asset_id FROM nation UNION ALL SELECT r_name, 'IN', 9, CAST(r_regionkey + 1 AS INT) FROM region),
k AS (SELECT {_NORM.format("name")} AS key, name, class, class_id, asset_id FROM r UNION SELECT {_NORM.format("substr(n_name, 1, 3)")}, n_name, 'EQ', 0, CAST(n_nationkey + 1 AS INT) FROM nation)"""


@query(f"""WITH {_REG}, {_SPELLINGS}, q AS (SELECT symbol, {_NORM.format("symbol")} AS k1, {_NORM.format(_STRIP.format("symbol"))} AS k2 FROM s),
c AS (SELECT symbol, name, class, class_id, asset_id, CASE WHEN k1 = key THEN 3.0 WHEN k2 = key THEN 2.0 ELSE jaro_winkler_similarity(k2, key) END AS jw, CASE WHEN length(k2) <= 4 THEN 0.95 ELSE 0.9 END AS need FROM q, k)
SELECT symbol, name, class, asset_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY jw DESC, CASE WHEN jw >= 2 THEN 0 ELSE length(name) END, class_id, asset_id) AS n FROM c WHERE jw >= need) WHERE n = 1""", raw=True)
def resolve_symbols(spark, d):  # noqa: ANN001, ANN201
    return N.resolved(_spellings(spark, d), _nation_registry(spark, d)).select("symbol", "name", "class", "asset_id")


@query(f"""WITH {_REG} SELECT class, key, count(DISTINCT asset_id) AS n FROM k GROUP BY ALL HAVING count(DISTINCT asset_id) > 1""", raw=True)
def registry_collisions(spark, d):  # noqa: ANN001, ANN201
    return N.collisions(_nation_registry(spark, d))


def _token_registry(spark, d):  # noqa: ANN001, ANN202
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(F.concat(F.lit("Token "), k).alias("name"), F.array(F.upper(F.substring(F.md5(k.cast("string").cast("binary")), 1, 8))).alias("aliases"), F.when(k % 2 == 0, "CR").otherwise("EQ").alias("class"), F.when(k % 2 == 0, 6).otherwise(0).alias("class_id"), (k % 65000 + 1).cast("int").alias("asset_id"))
    own = [("US Dollar", ["USD"], "FX", 3, 5001), ("Euro", ["EUR"], "FX", 3, 1301), ("Tether", ["USDT"], "CR", 6, 65001), ("Bitcoin", ["BTC"], "CR", 6, 65002)]
    return s.unionByName(spark.createDataFrame(own, N.ASSET))


_TOKENS = """WITH t AS (SELECT s_suppkey AS k, upper(substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 8)) AS a FROM supplier),
y AS (SELECT k, a, CAST(CASE WHEN k % 2 = 0 THEN 6 ELSE 0 END AS BIGINT) AS bc, CAST(k % 65000 + 1 AS BIGINT) AS bi, CASE k % 5 WHEN 0 THEN a || '/USDT' WHEN 1 THEN a || '-eur' WHEN 2 THEN a || 'USD' WHEN 3 THEN a || '_BTC:PERP' ELSE lower(a) END AS symbol,
 CAST(CASE WHEN k % 5 = 3 THEN 1 ELSE 0 END AS BIGINT) AS it, CAST(CASE k % 5 WHEN 0 THEN 6 WHEN 3 THEN 6 ELSE 3 END AS BIGINT) AS qc, CAST(CASE k % 5 WHEN 0 THEN 65001 WHEN 1 THEN 1301 WHEN 3 THEN 65002 ELSE 5001 END AS BIGINT) AS qi FROM t),
z AS (SELECT *, (it << 60) | (bc << 56) | (bi << 40) | (qc << 36) | (qi << 20) AS ticker_id FROM y)
"""


def _token_symbols(spark, d):  # noqa: ANN001, ANN202
    k = F.col("s_suppkey")
    a = F.upper(F.substring(F.md5(k.cast("string").cast("binary")), 1, 8))
    form = F.when(k % 5 == 0, F.concat(a, F.lit("/USDT"))).when(k % 5 == 1, F.concat(a, F.lit("-eur"))).when(k % 5 == 2, F.concat(a, F.lit("USD"))).when(k % 5 == 3, F.concat(a, F.lit("_BTC:PERP"))).otherwise(F.lower(a))
    return table(spark, d, "supplier").select(form.alias("symbol"))


@query(_TOKENS + "SELECT symbol, ticker_id FROM z", raw=True)
def resolve_tickers(spark, d):  # noqa: ANN001, ANN201
    return N.resolved_tickers(_token_symbols(spark, d), _token_registry(spark, d)).select("symbol", "ticker_id")


@query(_TOKENS + "SELECT ticker_id, 'TOKEN ' || k AS base, CASE qi WHEN 65001 THEN 'TETHER' WHEN 1301 THEN 'EURO' WHEN 65002 THEN 'BITCOIN' ELSE 'US DOLLAR' END AS quote, it AS itype FROM z", raw=True)
def reverse_tickers(spark, d):  # noqa: ANN001, ANN201
    """Each ticker once, however many symbols resolve to it, with every name that its ids stand for."""
    g = _token_registry(spark, d)
    t = N.resolved_tickers(_token_symbols(spark, d), g).select("ticker_id").distinct()
    return N.named_tickers(t, g).select("ticker_id", "base", "quote", "itype")


@query("SELECT t.seq, n.n_name AS provider_name FROM ticks t LEFT JOIN nation n ON n.n_nationkey = t.provider AND n.n_nationkey < 6")
def provider_names(spark, d):  # noqa: ANN001, ANN201
    p = table(spark, d, "nation").where("n_nationkey < 6").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return N.providers_named(ticks(spark, d), p).select("seq", "provider_name")


@query("""SELECT c_custkey, replace(s, '-', '/') AS slash, CASE WHEN c_custkey % 2 = 0 THEN 'EUR' END AS base, CASE WHEN c_custkey % 2 = 0 THEN 'USD' END AS quote, c_custkey % 3 = 0 AS perp FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'eurUSD' ELSE 'A-B' || c_custkey END AS s FROM customer)""", raw=True)
def symbol_forms(spark, d):  # noqa: ANN001, ANN201
    k = F.col("c_custkey")
    s = F.when(k % 2 == 0, "eurUSD").otherwise(F.concat(F.lit("A-B"), k))
    t = table(spark, d, "customer").select("c_custkey", s.alias("s"), F.concat(s, F.when(k % 3 == 0, ":perp").otherwise("")).alias("p"))
    return t.withColumn("x", N.fx6("s")).select("c_custkey", N.to_slash("s").alias("slash"), "x.base", "x.quote", N.is_perp("p").alias("perp"))


# streams


@query(P.ORACLE["leg_state_ipi"], raw=True)
def stream_leg_state(spark, d):  # noqa: ANN001, ANN201
    return SF.collected(spark, [ticks(spark, d)], L.stream_leg_states, "tl_stream_legs", "tc_ms").select("leg", "ts", "seq", r("ema_ipi", 6))


@query(P.ORACLE["zscore_gate"], raw=True)
def stream_zscore_gate(spark, d):  # noqa: ANN001, ANN201
    return SF.collected(spark, [ticks(spark, d)], lambda s: L.stream_zscores(s, 2.0), "tl_stream_z", "tc_ms").where("z <= 4").select("ticker", "ts", "seq", r("z", 6))


@query(P._GUARD.replace("value", "mid") + "SELECT o.ticker, o.tc_ms AS ts, o.seq, round(o.mid, 8) AS mid FROM g JOIN o ON o.ticker = g.ticker AND o.n = g.n WHERE g.ok")
def stream_guard(spark, d):  # noqa: ANN001, ANN201
    return SF.collected(spark, [ticks(spark, d)], L.stream_sane_mids, "tl_stream_sane", "tc_ms").select("ticker", "ts", "seq", r("mid"))


_SENT = """, u AS (SELECT ticker AS peer, seq, (seq + CASE WHEN seq % 50 = 0 THEN 2500 ELSE 0 END) * 2 AS ts FROM ticks UNION ALL SELECT ticker, seq, (seq + seq * 7919 % 3000) * 2 + 1 FROM ticks),
v AS (SELECT *, max(seq) OVER (PARTITION BY peer ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, row_number() OVER (PARTITION BY peer, seq ORDER BY ts) AS nth FROM u)
SELECT peer, ts, seq FROM v WHERE nth = 1 AND (top IS NULL OR seq > top - 1024)"""


@query(_SENT)
def stream_replay_window(spark, d):  # noqa: ANN001, ANN201
    """Every frame of a peer twice, the second one late, and some first ones later than the window reaches back.

    Frames of one ts go by seq. The SQL leaves their order open, so where a row hangs on it DuckDB may keep it or not.
    """
    t = ticks(spark, d).select(F.col("ticker").alias("peer"), "seq")
    n = F.col("seq")
    one = t.withColumn("ts", (n + F.when(n % 50 == 0, 2500).otherwise(0)) * 2)
    sent = one.unionByName(t.withColumn("ts", (n + n * 7919 % 3000) * 2 + 1))
    return SF.collected(spark, _halves(sent, "ts"), L.stream_replay_check, "tl_replay", "ts").select("peer", "ts", "seq")


def _halves(rows, order: str) -> list:  # noqa: ANN001
    cut = rows.agg(F.percentile_approx(order, 0.5, 1000)).first()[0] or 0
    return [rows.where(F.col(order) <= cut), rows.where(F.col(order) > cut)]


_BEAT_ROWS = """, n AS (SELECT ticker AS seat, seq AS arrived, row_number() OVER (PARTITION BY ticker ORDER BY seq) AS k FROM ticks),
b AS (SELECT seat, arrived, k, k // 200 - CASE WHEN k % 97 = 0 THEN 1 ELSE 0 END AS boot, k - CASE WHEN k % 13 = 0 THEN 7 WHEN k % 11 = 0 THEN 1 ELSE 0 END AS seq, k * 10 - CASE WHEN k % 17 = 0 THEN 300 ELSE 0 END AS ts FROM n),
g AS (WITH RECURSIVE g(seat, k, nb, ns, nt, verdict) AS (SELECT seat, k, boot, seq, ts, 'valid' FROM b WHERE k = 1
  UNION ALL SELECT seat, k, CASE WHEN verdict = 'valid' THEN boot ELSE nb END, CASE WHEN verdict = 'valid' THEN seq ELSE ns END, CASE WHEN verdict = 'valid' THEN ts ELSE nt END, verdict
  FROM (SELECT b.*, g.nb, g.ns, g.nt, CASE WHEN b.boot = g.nb AND b.seq = g.ns THEN 'duplicate' WHEN b.boot = g.nb AND (b.seq < g.ns OR b.ts < g.nt) THEN 'regression' WHEN b.boot <> g.nb AND b.ts <= g.nt THEN 'regression' ELSE 'valid' END AS verdict FROM g JOIN b ON b.seat = g.seat AND b.k = g.k + 1)) SELECT * FROM g)
SELECT b.seat, b.ts, b.boot, b.seq, verdict FROM b JOIN g ON g.seat = b.seat AND g.k = b.k"""


@query(_BEAT_ROWS)
def stream_attested(spark, d):  # noqa: ANN001, ANN201
    """Beats of a seat over several boots, with repeats, steps back in sequence and time, and beats of a boot that is over."""
    from pyspark.sql import Window

    k = F.col("k")
    n = ticks(spark, d).select(F.col("ticker").alias("seat"), F.col("seq").alias("arrived"), F.row_number().over(Window.partitionBy("ticker").orderBy("seq")).cast("long").alias("k"))
    rows = n.select("seat", "arrived", (F.floor(k / 200) - F.when(k % 97 == 0, 1).otherwise(0)).alias("boot"), (k - F.when(k % 13 == 0, 7).when(k % 11 == 0, 1).otherwise(0)).alias("seq"), (k * 10 - F.when(k % 17 == 0, 300).otherwise(0)).alias("ts"))
    return SF.collected(spark, _halves(rows, "arrived"), L.attested, "tl_attested", "arrived")
