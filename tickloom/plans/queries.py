"""Registered queries over the driver's tables, each with the SQL that gives the same rows where SQL can.

Doubles are rounded so that two engines' last digits don't matter; orders are total, by time and sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
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
from ..session import TICKS_SQL, stream_ticks, table, ticks
from ..streaming import live as L
from ..streaming import stateful as SF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MIN, S10, H30 = 60_000, 10_000, X.BIN_MS


def query(sql: str | None = None, raw: bool = False):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql if raw else f"{TICKS_SQL}\n{sql}"
        return f

    return add


def r(c: str | Column, n: int = 8, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, n).alias(name or c)


def _ohlc_sql(tf: int, ts: str = "tc_ms", source: str = "ticks") -> str:
    return f"""SELECT ticker, {ts} // {tf} * {tf} AS bar_ts, arg_min(mid, ({ts}, seq)) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, ({ts}, seq)) AS close, CAST(sum(vbid) AS BIGINT) AS vbid, CAST(sum(vask) AS BIGINT) AS vask,
 count(*) AS tick_count, CAST(least(65535, round(sqrt(avg((ci / 16.0) * (ci / 16.0))) * 16)) AS INT) AS avg_ci FROM {source} GROUP BY ALL"""


def _ohlc_out(sql: str) -> str:
    return f"SELECT ticker, bar_ts, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, vbid, vask, tick_count, avg_ci FROM ({sql})"


def _ohlc_cols(df: DataFrame, ts: str = "bar_ts") -> DataFrame:
    return df.select("ticker", ts, r("open"), r("high"), r("low"), r("close"), "vbid", "vask", "tick_count", "avg_ci")


# bars


@query(_ohlc_out(_ohlc_sql(S10)))
def ohlc_10s(spark, d):  # noqa: ANN001, ANN201
    return _ohlc_cols(B.ohlc(ticks(spark, d), S10))


@query(_ohlc_out(_ohlc_sql(MIN)))
def ohlc_1m(spark, d):  # noqa: ANN001, ANN201
    return _ohlc_cols(B.ohlc(ticks(spark, d), MIN))


@query(_ohlc_out(_ohlc_sql(H30, "ts_ms")))
def ohlc_30m(spark, d):  # noqa: ANN001, ANN201
    return _ohlc_cols(B.ohlc(ticks(spark, d), H30, "ts_ms"))


_GUARD = """, o AS (SELECT ticker, seq, tc_ms, value, row_number() OVER (PARTITION BY ticker ORDER BY tc_ms, seq) AS n FROM ticks),
g AS (WITH RECURSIVE g(ticker, n, last, ok) AS (SELECT ticker, n, CASE WHEN value > 0 THEN value END, value > 0 FROM o WHERE n = 1
  UNION ALL SELECT o.ticker, o.n, CASE WHEN o.value > 0 AND (g.last IS NULL OR o.value / g.last BETWEEN 0.5 AND 2) THEN o.value ELSE g.last END, o.value > 0 AND (g.last IS NULL OR o.value / g.last BETWEEN 0.5 AND 2)
  FROM g JOIN o ON o.ticker = g.ticker AND o.n = g.n + 1) SELECT * FROM g)
"""


@query(_GUARD + "SELECT o.ticker, o.tc_ms AS ts, o.seq, o.value AS mid FROM g JOIN o ON o.ticker = g.ticker AND o.n = g.n WHERE g.ok")
def sane_mid_guard(spark, d):  # noqa: ANN001, ANN201
    return Q.sane_mids(ticks(spark, d), value="value")


def _rollup_sql(extra: int) -> str:
    return f""", b AS ({_ohlc_sql(S10)}), t AS (SELECT *, bar_ts // {MIN} * {MIN} AS b1, (bar_ts + {extra}) // {MIN} * {MIN} AS b2 FROM b),
u AS (SELECT *, b1 AS dst_ts, 0 AS leg FROM t UNION ALL SELECT *, b2 AS dst_ts, 1 AS leg FROM t WHERE b1 <> b2)
SELECT ticker, dst_ts, round(arg_min(open, (bar_ts, leg)), 8) AS open, round(max(CASE WHEN leg = 1 THEN greatest(open, close) ELSE high END), 8) AS high, round(min(CASE WHEN leg = 1 THEN least(open, close) ELSE low END), 8) AS low,
 round(arg_max(close, (bar_ts, leg)), 8) AS close, CAST(sum(vbid) AS BIGINT) AS vbid, CAST(sum(vask) AS BIGINT) AS vask, CAST(sum(tick_count) AS BIGINT) AS tick_count,
 CAST(least(65535, round(sqrt(sum((avg_ci / 16.0) * (avg_ci / 16.0) * greatest(tick_count, 1)) / sum(greatest(tick_count, 1))) * 16)) AS INT) AS avg_ci FROM u GROUP BY ALL"""


@query(_rollup_sql(9999))
def ohlc_rollup(spark, d):  # noqa: ANN001, ANN201
    return _ohlc_cols(B.rollup(B.ohlc(ticks(spark, d), S10), S10, MIN), "dst_ts")


@query(_rollup_sql(10000))
def ohlc_rollup_straddle(spark, d):  # noqa: ANN001, ANN201
    bars = B.ohlc(ticks(spark, d), S10).withColumn("close_ts", F.col("bar_ts") + 10_000)
    return _ohlc_cols(B.rollup(bars, S10, MIN), "dst_ts")


_FULL = f""", a AS (SELECT *, tc_ms // {MIN} * {MIN} AS bar_ts, ln(mid / lag(mid) OVER w) AS r, (tc_ms - first_value(tc_ms) OVER w) / 1000.0 AS x FROM ticks WINDOW w AS (PARTITION BY ticker, tc_ms // {MIN} ORDER BY tc_ms, seq)),
c AS (SELECT *, lag(r) OVER (PARTITION BY ticker, bar_ts ORDER BY tc_ms, seq) AS rp, vbid + vask AS vol FROM a)
"""


@query(_FULL + "SELECT ticker, bar_ts, min(tc_ms) AS open_ts, max(tc_ms) AS close_ts, round(arg_min(mid, (tc_ms, seq)), 8) AS open, round(max(mid), 8) AS high, round(min(mid), 8) AS low, round(arg_max(mid, (tc_ms, seq)), 8) AS close, CAST(sum(vbid) AS BIGINT) AS vbid, CAST(sum(vask) AS BIGINT) AS vask, count(*) AS tick_count FROM c GROUP BY ALL")
def bar_core(spark, d):  # noqa: ANN001, ANN201
    return B.full_bars(ticks(spark, d), MIN).select("ticker", "bar_ts", "open_ts", "close_ts", r("open"), r("high"), r("low"), r("close"), "vbid", "vask", "tick_count")


@query(_FULL + "SELECT ticker, bar_ts, round(coalesce(sum(r * r), 0), 8) AS realized_var, round(coalesce(sum(abs(r) * abs(rp)) * pi() / 2, 0), 8) AS bipower_var, round(coalesce(max(abs(r)), 0), 8) AS max_abs_return FROM c GROUP BY ALL")
def bar_variances(spark, d):  # noqa: ANN001, ANN201
    return B.full_bars(ticks(spark, d), MIN).select("ticker", "bar_ts", r("realized_var"), r("bipower_var"), r("max_abs_return"))


@query(_FULL + "SELECT ticker, bar_ts, round(CASE WHEN count(*) >= 2 AND max(x) > 0 AND var_pop(x) * count(*) * count(*) > 1e-12 THEN regr_slope(mid, x) * max(x) / arg_max(mid, (tc_ms, seq)) ELSE 0 END, 6) AS drift FROM c GROUP BY ALL")
def bar_drift(spark, d):  # noqa: ANN001, ANN201
    return B.full_bars(ticks(spark, d), MIN).select("ticker", "bar_ts", r("drift", 6))


@query(_FULL + "SELECT ticker, bar_ts, round(CASE WHEN sum(CASE WHEN r IS NOT NULL THEN vol END) > 0 THEN sum(sign(r) * vol) / sum(CASE WHEN r IS NOT NULL THEN vol END) ELSE 0 END, 6) AS vol_imbalance, coalesce(round(avg(CASE WHEN ask > bid THEN (ask - bid) / ((ask + bid) * 0.5) * 1e4 END), 6), -1) AS avg_spread_bps FROM c GROUP BY ALL")
def bar_flow_spread(spark, d):  # noqa: ANN001, ANN201
    return B.full_bars(ticks(spark, d), MIN).select("ticker", "bar_ts", r("vol_imbalance", 6), r(F.nanvl("avg_spread_bps", F.lit(-1.0)), 6, "avg_spread_bps"))


@query(_FULL + "SELECT ticker, bar_ts, CAST(least(65535, round(sqrt(sum((ci / 16.0) * (ci / 16.0) * accepted) / sum(accepted)) * 16)) AS INT) AS avg_ci_ubp, CAST(round(sum(rejected) / (sum(accepted) + sum(rejected)) * 65535) AS INT) AS reject_rate FROM c GROUP BY ALL")
def bar_quality(spark, d):  # noqa: ANN001, ANN201
    return B.full_bars(ticks(spark, d), MIN).select("ticker", "bar_ts", "avg_ci_ubp", "reject_rate")


@query(f""", b AS (SELECT ticker, ts_ms // {H30} * {H30} AS bar_ts, arg_max(mid, (ts_ms, seq)) AS close, count(*) AS n FROM ticks GROUP BY ALL),
k AS (SELECT ticker, unnest(range(min(bar_ts), max(bar_ts) + 1, {H30})) AS bar_ts FROM b GROUP BY ticker)
SELECT k.ticker, k.bar_ts, round(last_value(b.close IGNORE NULLS) OVER (PARTITION BY k.ticker ORDER BY k.bar_ts), 8) AS close, coalesce(b.n, 0) AS tick_count, CASE WHEN b.n IS NULL THEN 64 ELSE 0 END AS flags FROM k LEFT JOIN b ON b.ticker = k.ticker AND b.bar_ts = k.bar_ts""")
def bar_flatfill(spark, d):  # noqa: ANN001, ANN201
    return B.flat_fill(B.ohlc(ticks(spark, d), H30, "ts_ms"), H30).select("ticker", "bar_ts", r("close"), "tick_count", "flags")


@query("""SELECT provider, ticker, tc_ms // 5000 * 5000 AS cycle_ts, round(arg_max(bid, (tc_ms, seq)), 8) AS bid, round(arg_max(ask, (tc_ms, seq)), 8) AS ask, CAST(sum(vbid) AS BIGINT) AS vbid, CAST(sum(vask) AS BIGINT) AS vask, count(*) AS tick_count, CAST(sum(rejected) AS BIGINT) AS rejected, 0 AS flags FROM ticks GROUP BY ALL""")
def l1_accumulate(spark, d):  # noqa: ANN001, ANN201
    return B.level1(ticks(spark, d), 5000).select("provider", "ticker", "cycle_ts", r("bid"), r("ask"), "vbid", "vask", "tick_count", "rejected", "flags")


@query("""SELECT provider, ticker, tc_ms // 5000 * 5000 AS cycle_ts, CAST(count_if(seq % 5 <> 4) AS BIGINT) AS tick_count, CASE WHEN bool_or(seq % 5 < 2) THEN 0 WHEN bool_or(seq % 5 = 2) THEN 4 ELSE 20 END AS flags FROM ticks GROUP BY ALL HAVING count_if(seq % 5 <> 4) > 0""")
def l1_flags(spark, d):  # noqa: ANN001, ANN201
    kind = F.when(F.col("seq") % 5 < 2, "tick").when(F.col("seq") % 5 == 2, "reaffirm").when(F.col("seq") % 5 == 3, "carry").otherwise("reject")
    return B.level1(ticks(spark, d).withColumn("kind", kind), 5000).select("provider", "ticker", "cycle_ts", "tick_count", "flags")


@query("SELECT ticker, tc_ms // 200 * 200 AS window_ts, max(seq) AS seq FROM ticks GROUP BY ALL")
def last_write_per_window(spark, d):  # noqa: ANN001, ANN201
    return B.last_in_window(ticks(spark, d), 200).select("ticker", "window_ts", "seq")


# folds


_O = ", o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY tc_ms, seq) AS n FROM ticks)\n"


@query(_O + """, g AS (WITH RECURSIVE g(ticker, n, mean, var, z) AS (SELECT ticker, n, mid, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM o WHERE n = 1
  UNION ALL SELECT ticker, n, mean + 0.01 * dev, 0.99 * (var + 0.01 * dev * dev), CASE WHEN n <= 10 OR sd < 1e-12 THEN 0 ELSE abs(dev) / sd END FROM (SELECT o.ticker, o.n, g.mean, g.var, o.mid - g.mean AS dev, greatest(sqrt(g.var), o.mid * 2e-4) AS sd FROM g JOIN o ON o.ticker = g.ticker AND o.n = g.n + 1)) SELECT * FROM g)
SELECT o.ticker, tc_ms AS ts, seq, round(z, 6) AS z FROM g JOIN o ON o.ticker = g.ticker AND o.n = g.n WHERE z <= 4""")
def zscore_gate(spark, d):  # noqa: ANN001, ANN201
    return Q.z_gated(ticks(spark, d)).select("ticker", "ts", "seq", r("z", 6))


_DELTA = """, o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY seq) AS n FROM ticks),
g AS (WITH RECURSIVE g(ticker, n, lb, la, lvb, lva, lci, written, seen, flag) AS (SELECT ticker, n, bid, ask, vbid, vask, ci, tc_ms, tc_ms, 0 FROM o WHERE n = 1
  UNION ALL SELECT ticker, n, CASE WHEN flag = 0 THEN bid ELSE lb END, CASE WHEN flag = 0 THEN ask ELSE la END, CASE WHEN flag = 0 THEN vbid ELSE lvb END, CASE WHEN flag = 0 THEN vask ELSE lva END, CASE WHEN flag = 0 THEN ci ELSE lci END, CASE WHEN flag IS NULL THEN written ELSE ts END, greatest(seen, ts), flag
  FROM (SELECT o.ticker, o.n, o.bid, o.ask, o.vbid, o.vask, o.ci, o.tc_ms AS ts, g.lb, g.la, g.lvb, g.lva, g.lci, g.written, g.seen, CASE WHEN o.tc_ms < g.seen THEN NULL WHEN o.bid <> g.lb OR o.ask <> g.la OR o.vbid <> g.lvb OR o.vask <> g.lva OR o.ci <> g.lci OR o.tc_ms // 86400000 <> g.written // 86400000 THEN 0 WHEN o.tc_ms - g.written >= 60000 THEN 1 END AS flag FROM g JOIN o ON o.ticker = g.ticker AND o.n = g.n + 1)) SELECT * FROM g)
SELECT o.ticker, tc_ms AS ts, seq, round(bid, 8) AS bid, round(ask, 8) AS ask, flag AS flags FROM g JOIN o ON o.ticker = g.ticker AND o.n = g.n WHERE flag IS NOT NULL"""


@query(_DELTA)
def delta_gate(spark, d):  # noqa: ANN001, ANN201
    return Q.delta_gated(ticks(spark, d), slice_rows=2_000).select("ticker", "ts", "seq", r("bid"), r("ask"), "flags")


@query(""", o AS (SELECT ticker, provider, tc_ms, seq, row_number() OVER (PARTITION BY ticker, provider ORDER BY tc_ms, seq) AS n, (tc_ms - lag(tc_ms) OVER (PARTITION BY ticker, provider ORDER BY tc_ms, seq)) / 1000.0 AS gap FROM ticks),
g AS (WITH RECURSIVE g(ticker, provider, n, e) AS (SELECT ticker, provider, n, CAST(5.0 AS DOUBLE) FROM o WHERE n = 1 UNION ALL SELECT o.ticker, o.provider, o.n, CAST(0.1 AS DOUBLE) * least(greatest(CAST(o.gap AS DOUBLE), 1e-6), 300.0) + CAST(0.9 AS DOUBLE) * g.e FROM g JOIN o ON o.ticker = g.ticker AND o.provider = g.provider AND o.n = g.n + 1) SELECT * FROM g)
SELECT o.ticker || '|' || o.provider AS leg, o.tc_ms AS ts, o.seq, round(g.e, 6) AS ema_ipi FROM o JOIN g ON g.ticker = o.ticker AND g.provider = o.provider AND g.n = o.n""")
def leg_state_ipi(spark, d):  # noqa: ANN001, ANN201
    return Q.leg_states(ticks(spark, d)).select("leg", "ts", "seq", r("ema_ipi", 6))


@query(_O + """, g AS (WITH RECURSIVE g(ticker, n, anchor, trips, ok) AS (SELECT ticker, n, mid, 0, true FROM o WHERE n = 1
  UNION ALL SELECT ticker, n, CASE WHEN ok THEN mid ELSE anchor END, CASE WHEN ok THEN 0 ELSE trips + 1 END, ok FROM (SELECT o.ticker, o.n, o.mid, g.anchor, g.trips, abs(o.mid - g.anchor) <= 0.05 * g.anchor OR g.trips + 1 >= 30 AS ok FROM g JOIN o ON o.ticker = g.ticker AND o.n = g.n + 1)) SELECT * FROM g)
SELECT o.ticker, tc_ms AS ts, seq, round(mid, 8) AS mid FROM g JOIN o ON o.ticker = g.ticker AND o.n = g.n WHERE ok""")
def jump_guard(spark, d):  # noqa: ANN001, ANN201
    return Q.jump_guarded(ticks(spark, d)).select("ticker", "ts", "seq", r("mid"))


@query(_O + """, g AS (WITH RECURSIVE g(ticker, n, mark) AS (SELECT ticker, n, mid FROM o WHERE n = 1
  UNION ALL SELECT o.ticker, o.n, CASE WHEN abs(o.mid - g.mark) / g.mark * 1e4 >= 500 THEN o.mid ELSE g.mark END FROM g JOIN o ON o.ticker = g.ticker AND o.n = g.n + 1) SELECT * FROM g)
SELECT o.ticker, tc_ms AS ts, seq, round(mark, 8) AS mark FROM g JOIN o ON o.ticker = g.ticker AND o.n = g.n""")
def emit_deadband(spark, d):  # noqa: ANN001, ANN201
    return Q.deadband(ticks(spark, d), 500.0).select("ticker", "ts", "seq", r("mark"))


@query(_O + """, g AS (WITH RECURSIVE g(ticker, n, mark, since, begun, side) AS (SELECT ticker, n, mid, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 0 FROM o WHERE n = 1
  UNION ALL SELECT ticker, n, CASE WHEN near OR past THEN mid ELSE mark END, CASE WHEN near OR past THEN NULL ELSE since END, CASE WHEN near OR past THEN NULL ELSE begun END, CASE WHEN near OR past THEN 0 ELSE side END
  FROM (SELECT *, ts - since >= 1500 OR ts - begun >= 3000 AS past FROM (SELECT ticker, n, ts, mid, mark, near, now AS side, coalesce(begun, ts) AS begun, CASE WHEN now <> side THEN ts ELSE since END AS since
    FROM (SELECT o.ticker, o.n, o.tc_ms AS ts, o.mid, g.mark, g.since, g.begun, g.side, abs((o.mid - g.mark) / g.mark * 1e4) <= 4 AS near, CASE WHEN o.mid > g.mark THEN 1 ELSE -1 END AS now FROM g JOIN o ON o.ticker = g.ticker AND o.n = g.n + 1)))) SELECT * FROM g)
SELECT o.ticker, tc_ms AS ts, seq, round(mark, 8) AS mark FROM g JOIN o ON o.ticker = g.ticker AND o.n = g.n""")
def peg_confirm(spark, d):  # noqa: ANN001, ANN201
    return Q.peg_confirmed(ticks(spark, d)).select("ticker", "ts", "seq", r("mark"))


# volatility

_B30 = f", b AS ({_ohlc_sql(H30, 'ts_ms')})\n"
_RS = "ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)"


@query(_B30 + f"SELECT ticker, bar_ts, round({_RS}, 9) AS rs, round(pow(ln(high / low), 2) / (4 * ln(2)), 9) AS parkinson, round(0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2), 9) AS gk FROM b")
def vol_bar_estimators(spark, d):  # noqa: ANN001, ANN201
    b = B.ohlc(ticks(spark, d), H30, "ts_ms")
    return b.select("ticker", "bar_ts", r(X.rs_var("open", "high", "low", "close"), 9, "rs"), r(X.parkinson_var("high", "low"), 9, "parkinson"), r(X.gk_var("open", "high", "low", "close"), 9, "gk"))


@query(_B30 + "SELECT ticker, round(sqrt(avg(pow(ln(high / low), 2) / (4 * ln(2)))), 9) AS sigma FROM b GROUP BY ticker")
def vol_parkinson(spark, d):  # noqa: ANN001, ANN201
    return V.parkinson_sigma(B.ohlc(ticks(spark, d), H30, "ts_ms")).select("ticker", r("sigma", 9))


@query(_B30 + "SELECT ticker, round(sqrt(avg(greatest(0, 0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2)))), 9) AS sigma FROM b GROUP BY ticker")
def vol_gk(spark, d):  # noqa: ANN001, ANN201
    return V.gk_sigma(B.ohlc(ticks(spark, d), H30, "ts_ms")).select("ticker", r("sigma", 9))


@query(_B30 + f""", y AS (SELECT ticker, ln(open / lag(close) OVER (PARTITION BY ticker ORDER BY bar_ts)) AS o, ln(close / open) AS c, {_RS} AS rs FROM b),
z AS (SELECT ticker, count(*) AS n, var_samp(o) AS vo, var_samp(CASE WHEN o IS NOT NULL THEN c END) AS vc, sum(rs) AS rs FROM y GROUP BY ticker)
SELECT ticker, round(sqrt(vo + 0.34 / (1.34 + (n + 1.0) / (n - 1)) * vc + (1 - 0.34 / (1.34 + (n + 1.0) / (n - 1))) * rs / n), 9) AS sigma FROM z""")
def vol_yz(spark, d):  # noqa: ANN001, ANN201
    return V.yz_sigma(B.ohlc(ticks(spark, d), H30, "ts_ms")).select("ticker", r("sigma", 9))


def _vol30(spark, d):  # noqa: ANN001, ANN202
    return V.vol_rows(B.ohlc(ticks(spark, d), H30, "ts_ms"), src_ms=H30)


_V30 = _B30 + f""", s AS (SELECT ticker, bar_ts, sqrt(greatest({_RS}, 0)) AS raw, row_number() OVER (PARTITION BY ticker ORDER BY bar_ts) AS n, max(bar_ts) OVER (PARTITION BY ticker) AS last FROM b), q AS (SELECT * FROM s WHERE bar_ts < last),
m AS (WITH RECURSIVE m(ticker, n, v) AS (SELECT ticker, n, raw FROM q WHERE n = 1 UNION ALL SELECT q.ticker, q.n, CASE WHEN q.n <= 28 THEN m.v + (q.raw - m.v) / q.n ELSE m.v + 2.0 / 29 * (q.raw - m.v) END FROM m JOIN q ON q.ticker = m.ticker AND q.n = m.n + 1) SELECT * FROM m)
"""


@query(_V30 + "SELECT q.ticker, q.bar_ts AS bin_start_ms, round(raw, 9) AS raw, round(v, 9) AS sigma FROM q JOIN m ON m.ticker = q.ticker AND m.n = q.n")
def vol_30m_ema(spark, d):  # noqa: ANN001, ANN201
    return _vol30(spark, d).select("ticker", "bin_start_ms", r("raw", 9), r("sigma", 9))


_WINDOWS = ((96, 1.0), (240, 2.0), (480, 3.0))


_BLEND = _V30 + ", x AS (SELECT q.ticker, q.bar_ts AS bin_start_ms, v AS sigma, q.n - 1 AS i FROM q JOIN m ON m.ticker = q.ticker AND m.n = q.n),\ny0 AS (SELECT * FROM x)" + "".join(
    f""", y{j + 1} AS (SELECT * EXCLUDE (lst, srt), list_avg(cut{j}) AS mean{j}, list_var_samp(cut{j}) AS var{j} FROM (SELECT *, list_transform(lst, lambda z: CASE WHEN len(lst) < 5 THEN z ELSE greatest(least(z, srt[greatest(CAST(floor(len(lst) * 0.95) AS INT) - 1, 0) + 1]), srt[CAST(floor(len(lst) * 0.05) AS INT) + 1]) END) AS cut{j}
 FROM (SELECT *, list_sort(lst) AS srt FROM (SELECT *, list(sigma) OVER (PARTITION BY ticker ORDER BY i ROWS {w} PRECEDING) AS lst FROM y{j}))))"""
    for j, (w, _) in enumerate(_WINDOWS)
) + ", z AS (SELECT ticker, bin_start_ms, i, sigma, " + " + ".join(f"CASE WHEN least(i, {w}) >= 48 AND var{j} > 0 AND mean{j} > 0 THEN {k} * mean{j} / var{j} ELSE 0 END" for j, (w, k) in enumerate(_WINDOWS)) + " AS num, " + " + ".join(f"CASE WHEN least(i, {w}) >= 48 AND var{j} > 0 AND mean{j} > 0 THEN {k} / var{j} ELSE 0 END" for j, (w, k) in enumerate(_WINDOWS)) + f" AS den FROM y{len(_WINDOWS)}), bl AS (SELECT ticker, bin_start_ms, i, sigma, CASE WHEN den > 0 THEN num / den ELSE greatest(sigma, 0.01) END AS blend FROM z)\n"


@query(_BLEND + "SELECT ticker, bin_start_ms, round(sigma, 9) AS sigma, round(blend, 9) AS blend FROM bl")
def vol_mtf_blend(spark, d):  # noqa: ANN001, ANN201
    return V.mtf_blend(_vol30(spark, d), _WINDOWS).select("ticker", "bin_start_ms", r("sigma", 9), r("blend", 9))


@query(_BLEND + f""", sp AS (SELECT *, list_filter(list(sigma) OVER (PARTITION BY ticker ORDER BY i ROWS 17 PRECEDING), lambda z: z > 0) AS lst FROM bl)
SELECT ticker, bin_start_ms, round(blend, 9) AS blend, round(greatest(blend, least(CASE WHEN len(lst) > 0 THEN list_reduce(lst, lambda a, z: a + {1 - 2 ** (-1 / 3)!r} * (z - a)) ELSE 0 END, 8 * blend)), 9) AS effective FROM sp""")
def vol_spike_floor(spark, d):  # noqa: ANN001, ANN201
    return V.spike_floor(V.mtf_blend(_vol30(spark, d), _WINDOWS)).select("ticker", "bin_start_ms", r("blend", 9), r("effective", 9))


@query("""SELECT ticker, round(sum((1 + provider) * (1.0 / (1 + seq % 3)) * mid) / sum((1 + provider) * (1.0 / (1 + seq % 3))), 6) AS sigma FROM ticks GROUP BY ticker""")
def vol_signed_blend(spark, d):  # noqa: ANN001, ANN201
    t = ticks(spark, d)
    return V.signed_blend(t.select("ticker", (1 + F.col("provider")).cast("double").alias("weight"), (1.0 / (1 + F.col("seq") % 3)).alias("quality"), F.col("mid").alias("sigma"))).select("ticker", r("sigma", 6))


# renko


def _renko_sql(k: float | str, min_pct: float, ts: str = "ts_ms", sigma: str = "", jump: float | None = None, limit: int = 30) -> str:
    """One step emits a brick of the present tick, or goes to the next one; the size of a tick's period is ready beside it.

    With jump a tick too far from the last close is skipped, and after so many in a row the series starts anew at it.
    """
    far = f"abs(x.mid - g.last) > {jump} * g.last" if jump else "false"
    join = f"LEFT JOIN ({sigma}) v ON v.ticker = ticks.ticker AND v.bin_start_ms = ticks.{ts} // {H30} * {H30}" if sigma else ""
    unit = "pow(10, floor(log10({0})) - 3)"
    snap = lambda x, u: f"CASE WHEN abs({x} - floor({x} / ({u} * 2) + 0.5) * {u} * 2) <= abs({x} - floor({x} / ({u} * 5) + 0.5) * {u} * 5) THEN floor({x} / ({u} * 2) + 0.5) * {u} * 2 ELSE floor({x} / ({u} * 5) + 0.5) * {u} * 5 END"
    return f""", o1 AS (SELECT ticks.ticker, {ts} AS ts, seq, mid, row_number() OVER (PARTITION BY ticks.ticker ORDER BY {ts}, seq) AS n, mid * greatest(CAST(CAST({k} AS FLOAT) AS DOUBLE) * {"coalesce(v.sigma, 0.01)" if sigma else "CAST(0.01 AS DOUBLE)"}, CAST(CAST({min_pct} AS FLOAT) AS DOUBLE)) AS want FROM ticks {join}),
o2 AS (SELECT *, {snap("want", unit.format("want"))} AS size FROM o1), o AS (SELECT *, {unit.format("size")} * 2 AS step FROM o2),
g AS (WITH RECURSIVE g(ticker, n, j, last, size, step, period, hi, lo, cnt, emit, op, hh, ll, tc, fl, no, trips, skipped) AS (
  SELECT ticker, n, 0, floor(mid / step + 0.5) * step, size, step, ts // {H30}, mid, mid, 1, false, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), 0, 0, CAST(0 AS BIGINT), 0, false FROM o WHERE n = 1
  UNION ALL
  SELECT ticker, CASE WHEN can THEN n ELSE n + 1 END, CASE WHEN can THEN j + 1 ELSE 0 END, CASE WHEN can THEN nc WHEN skip THEN last WHEN anew THEN floor(mid2 / step2 + 0.5) * step2 WHEN fresh THEN floor(last / step2 + 0.5) * step2 ELSE last END, CASE WHEN NOT can AND NOT skip AND (fresh OR anew) THEN size2 ELSE size END, CASE WHEN NOT can AND NOT skip AND (fresh OR anew) THEN step2 ELSE step END, CASE WHEN can OR skip THEN period ELSE ts2 // {H30} END,
   CASE WHEN NOT can AND skip THEN hi WHEN NOT can THEN greatest(hi, mid2) WHEN j = 0 THEN -1e300 ELSE hi END, CASE WHEN NOT can AND skip THEN lo WHEN NOT can THEN least(lo, mid2) WHEN j = 0 THEN 1e300 ELSE lo END, CASE WHEN NOT can AND skip THEN cnt WHEN NOT can THEN cnt + 1 WHEN j = 0 THEN 0 ELSE cnt END, can, last,
   CASE WHEN j = 0 THEN greatest(last, nc, hi) ELSE greatest(last, nc) END, CASE WHEN j = 0 THEN least(last, nc, lo) ELSE least(last, nc) END, CASE WHEN j = 0 THEN cnt ELSE 0 END, CASE WHEN j = 0 THEN 0 ELSE 4 END, CASE WHEN can THEN no + 1 ELSE no END, CASE WHEN can THEN trips WHEN skip THEN trips + 1 ELSE 0 END, NOT can AND skip
  FROM (SELECT *, coalesce(nc <> last AND j < 1000 AND NOT skipped, false) AS can FROM (SELECT g.*, coalesce({far} AND g.trips + 1 < {limit}, false) AS skip, coalesce({far} AND g.trips + 1 >= {limit}, false) AS anew, c.mid, x.mid AS mid2, x.ts AS ts2, x.size AS size2, x.step AS step2, x.ts // {H30} <> g.period AS fresh, CASE WHEN c.mid - g.last >= g.size THEN floor((g.last + g.size) / g.step + 0.5) * g.step WHEN g.last - c.mid >= g.size THEN floor((g.last - g.size) / g.step + 0.5) * g.step END AS nc
   FROM g JOIN o c ON c.ticker = g.ticker AND c.n = g.n LEFT JOIN o x ON x.ticker = g.ticker AND x.n = g.n + 1)) WHERE can OR mid2 IS NOT NULL) SELECT * FROM g),
bricks AS (SELECT g.ticker, o.ts, o.seq, g.no - 1 AS brick_no, g.op AS open, g.hh AS high, g.ll AS low, g.last AS close, g.last > g.op AS up, g.tc AS tick_count, g.fl AS flags FROM g JOIN o ON o.ticker = g.ticker AND o.n = g.n WHERE emit)
"""


_SIGMA30 = "SELECT q.ticker, q.bar_ts AS bin_start_ms, v AS sigma FROM q JOIN m ON m.ticker = q.ticker AND m.n = q.n"


@query(_V30 + _renko_sql(1.0, 0.005, sigma=_SIGMA30) + "SELECT ticker, ts, seq, brick_no, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, up, CAST(tick_count AS INT) AS tick_count, flags FROM bricks")
def renko_bricks(spark, d):  # noqa: ANN001, ANN201
    b = Q.renko(ticks(spark, d), _vol30(spark, d), k=1.0, min_pct=0.005, ts="ts_ms")
    return b.select("ticker", "ts", "seq", "brick_no", r("open"), r("high"), r("low"), r("close"), "up", "tick_count", "flags")


@query(_renko_sql(2.0, 0.0, "tc_ms") + """, ends AS (SELECT ticker, seq, ts FROM bricks WHERE flags = 0),
w AS (SELECT t.ticker, t.seq, t.tc_ms, t.mid, t.vbid, t.vask, e.seq IS NOT NULL AS ends, coalesce(sum(CASE WHEN e.seq IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY t.ticker ORDER BY t.tc_ms, t.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM ticks t LEFT JOIN ends e ON e.ticker = t.ticker AND e.seq = t.seq),
u AS (SELECT *, ln(mid / lag(mid) OVER (PARTITION BY ticker, no ORDER BY tc_ms, seq)) AS r FROM w), s AS (SELECT ticker, max(CASE WHEN ends THEN seq END) AS seq, coalesce(sum(r * r), 0) AS rv, CAST(sum(vbid) AS BIGINT) AS vbid, CAST(sum(vask) AS BIGINT) AS vask FROM u GROUP BY ticker, no)
SELECT b.ticker, b.ts, b.seq, brick_no, round(close, 8) AS close, round(CASE WHEN flags = 0 THEN rv ELSE 0 END, 8) AS realized_var, CASE WHEN flags = 0 THEN s.vbid ELSE 0 END AS vbid, CASE WHEN flags = 0 THEN s.vask ELSE 0 END AS vask FROM bricks b JOIN s ON s.ticker = b.ticker AND s.seq = b.seq""")
def renko_microstructure(spark, d):  # noqa: ANN001, ANN201
    return Q.renko_with_microstructure(ticks(spark, d), k=2.0).select("ticker", "ts", "seq", "brick_no", r("close"), r("realized_var"), "vbid", "vask")


_BRICKS = "SELECT ticker, ts, seq, brick_no, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, up, CAST(tick_count AS INT) AS tick_count, flags FROM bricks"


def _bricks(b: DataFrame) -> DataFrame:
    return b.select("ticker", "ts", "seq", "brick_no", r("open"), r("high"), r("low"), r("close"), "up", "tick_count", "flags")


@query(_renko_sql(1.0, 0.0, "tc_ms", jump=0.1, limit=4) + _BRICKS)
def renko_jump_guarded(spark, d):  # noqa: ANN001, ANN201
    """Ticks a tenth or more from the last close are skipped, until the fourth in a row."""
    return _bricks(Q.renko(ticks(spark, d), jump=0.1, jump_limit=4))


@query(_renko_sql("CASE WHEN ticks.seq // 700 % 8 = 7 THEN 0.05 ELSE 1.5 END", 0.0, "ts_ms") + _BRICKS)
def renko_hot_k(spark, d):  # noqa: ANN001, ANN201
    """k changes every so many ticks, for the next half hour on, and is never under 0.05."""
    k = F.when(F.floor(F.col("seq") / 700) % 8 == 7, 0.01).otherwise(1.5)
    return _bricks(Q.renko(ticks(spark, d).withColumn("k", k), ts="ts_ms"))


@query(_renko_sql(1.0, 0.0) + "SELECT ticker, ts // 86400000 * 86400000 AS day_ms, count(*) AS bricks FROM bricks GROUP BY ALL")
def renko_per_day(spark, d):  # noqa: ANN001, ANN201
    return Q.bricks_per_day(Q.renko(ticks(spark, d), k=1.0, ts="ts_ms"))


@query()
def renko_calibration(spark, d):  # noqa: ANN001, ANN201
    return Q.calibrate_k(ticks(spark, d), 172.0, ts="ts_ms", sigma=_vol30(spark, d))


_SNAP = "pow(10, floor(log10(mid)) - 3)"


@query(f"""SELECT seq, round(CASE WHEN abs(mid - floor(mid / ({_SNAP} * 2) + 0.5) * {_SNAP} * 2) <= abs(mid - floor(mid / ({_SNAP} * 5) + 0.5) * {_SNAP} * 5) THEN floor(mid / ({_SNAP} * 2) + 0.5) * {_SNAP} * 2 ELSE floor(mid / ({_SNAP} * 5) + 0.5) * {_SNAP} * 5 END, 6) AS snapped, round({_SNAP} * 2, 6) AS step FROM ticks""")
def renko_grid(spark, d):  # noqa: ANN001, ANN201
    return ticks(spark, d).select("seq", r(X.snap_25("mid"), 6, "snapped"), r(X.grid_step("mid"), 6, "step"))


# composite

STEP = 36_000
_LEGS = f""", q0 AS (SELECT *, lead(tc_ms) OVER (PARTITION BY ticker, provider ORDER BY tc_ms, seq) AS nxt FROM ticks),
l AS (SELECT ticker, provider, bid, ask, vbid, vask, 1 + provider * 0.5 AS weight, (bid + ask) * 0.5 AS mid, unnest(range((tc_ms // {STEP} + 1) * {STEP}, least(coalesce(nxt, 4611686018427387904), tc_ms + 60000) + 1, {STEP})) AS t FROM q0)
"""


def _legs(quotes: DataFrame, ts: str) -> DataFrame:
    legs = C.legs_at(quotes, STEP, ts=ts)
    return legs.withColumn("weight", 1 + F.col("provider") * 0.5).withColumn("mapped", F.col("provider") < 6).withColumn("mid", X.mid())


_VOL2 = X.kernel_sigma(X.KERNELS["ALT"][0]) ** 2
_IPI = """, o AS (SELECT *, row_number() OVER w AS n, (tc_ms - lag(tc_ms) OVER w) / 1000.0 AS gap, min(tc_ms) OVER (PARTITION BY ticker, provider) AS joined, lead(tc_ms) OVER w AS nxt FROM ticks WINDOW w AS (PARTITION BY ticker, provider ORDER BY tc_ms, seq)),
i AS (WITH RECURSIVE i(ticker, provider, n, ipi) AS (SELECT ticker, provider, n, CAST(5.0 AS DOUBLE) FROM o WHERE n = 1 UNION ALL SELECT o.ticker, o.provider, o.n, CAST(0.1 AS DOUBLE) * least(greatest(CAST(o.gap AS DOUBLE), 1e-6), 300.0) + CAST(0.9 AS DOUBLE) * i.ipi FROM i JOIN o ON o.ticker = i.ticker AND o.provider = i.provider AND o.n = i.n + 1) SELECT * FROM i)
"""
_COMPOSITE = _IPI + f""", l AS (SELECT o.ticker, o.provider, bid, ask, vbid, vask, tc_ms, joined, coalesce(gap, 0) AS gap, ipi, 1 + o.provider * 0.5 AS b, o.provider < 6 AS m, unnest(range((tc_ms // {STEP} + 1) * {STEP}, least(coalesce(nxt, 4611686018427387904), tc_ms + 60000) + 1, {STEP})) AS t FROM o JOIN i ON i.ticker = o.ticker AND i.provider = o.provider AND i.n = o.n),
c1 AS (SELECT *, CAST((t - tc_ms) / 1000.0 AS DOUBLE) AS tau, greatest((ask - bid) / (ask + bid), {X.KERNELS["ALT"][1] * 1e-4!r}) AS s FROM l WHERE bid > 0 AND ask >= bid AND (ask - bid) / ((ask + bid) * 0.5) * 1e4 <= 2000),
c2 AS (SELECT *, sum(b * s) OVER p / sum(b) OVER p AS sr FROM c1 WHERE tau <= 60 WINDOW p AS (PARTITION BY ticker, t)),
c3 AS (SELECT *, least(greatest(pow(4 * sr, 2) / {_VOL2!r}, 30.0), 60.0) AS ev FROM c2),
c4 AS (SELECT *, greatest(tau, least(ipi, ev / 2)) AS eff FROM c3),
c5 AS (SELECT *, least(1.0, greatest(1e-3, (t - CASE WHEN gap > ev THEN tc_ms ELSE joined END) / 1000.0 / (3 * ipi))) AS ramp, least(1.0, greatest(0.0, 2 - 2 * tau / least(60.0, ev))) AS fr FROM c4 WHERE eff <= ev),
c6 AS (SELECT *, fr * ramp AS g, b * ramp * sr * sr * (1 - eff / ev) / (s * s + {_VOL2!r} * eff) AS w0 FROM c5),
c7 AS (SELECT *, fr + 1 - max(g) OVER p AS f, w0 * (fr + 1 - max(g) OVER p) AS w FROM c6 WINDOW p AS (PARTITION BY ticker, t)),
c8 AS (SELECT *, sum(w) OVER p AS ws, sum(CASE WHEN m THEN w ELSE 0 END) OVER p AS wm, sum(CASE WHEN m THEN w * g ELSE 0 END) OVER p AS wg FROM c7 WINDOW p AS (PARTITION BY ticker, t)),
c9 AS (SELECT *, CASE WHEN m OR wm = 0 THEN least(b, 5) * g ELSE 0 END AS x, (ws - wm) / ws AS u FROM c8 WHERE ws >= 1e-12),
c10 AS (SELECT *, CASE WHEN sum(x * x) OVER p > 0 THEN pow(sum(x) OVER p, 2) / sum(x * x) OVER p ELSE 0 END AS n, wg / greatest(wm, 1e-300) * least(u, {0.4 / 1.4!r}) + (1 - wg / greatest(wm, 1e-300)) * u AS ub FROM c9 WINDOW p AS (PARTITION BY ticker, t)),
c11 AS (SELECT *, least(0.99, 0.253 + exp(-0.228 * greatest(n, 1))) AS cap, w / ws * CASE WHEN wm = 0 THEN 1 WHEN m THEN (1 - ub) / greatest(1 - u, 1e-300) WHEN u > 0 THEN ub / u ELSE 1 END AS r FROM c10),
k1 AS (SELECT ticker, t, provider, k, r, cap, CASE WHEN k = 2 THEN r WHEN m OR wm = 0 THEN r * g ELSE 0 END AS e FROM c11, (VALUES (1), (2)) AS tries(k)),
k2 AS (SELECT *, CASE WHEN e > 0 AND r < cap THEN (cap - r) / e END AS bend FROM k1),
k3 AS (SELECT *, sum(least(r, cap)) OVER p AS st, sum(CASE WHEN bend IS NULL THEN 0 ELSE e END) OVER p - coalesce(sum(CASE WHEN bend IS NULL THEN 0 ELSE e END) OVER q, 0) AS sl, coalesce(sum(CASE WHEN bend IS NULL THEN 0 ELSE e * bend END) OVER q, 0) AS gone FROM k2
  WINDOW p AS (PARTITION BY ticker, t, k), q AS (PARTITION BY ticker, t, k ORDER BY bend NULLS LAST, provider ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k4 AS (SELECT ticker, t, k, CASE WHEN max(st) >= 1 - 1e-12 THEN 0 ELSE arg_min((1 - st - gone) / sl, bend) FILTER (WHERE bend IS NOT NULL AND st + gone + bend * sl >= 1 - 1e-12) END AS lv FROM k3 GROUP BY ticker, t, k),
c12 AS (SELECT c11.*, coalesce(CASE WHEN a.lv IS NOT NULL THEN least(cap, r + a.lv * CASE WHEN m OR wm = 0 THEN r * g ELSE 0 END) END, CASE WHEN z.lv IS NOT NULL THEN least(cap, r + z.lv * r) END, r) AS fin
  FROM c11 JOIN k4 a ON a.ticker = c11.ticker AND a.t = c11.t AND a.k = 1 JOIN k4 z ON z.ticker = c11.ticker AND z.t = c11.t AND z.k = 2),
c13 AS (SELECT *, (bid + ask) / 2 AS mid, CASE WHEN fin > 1e-12 THEN fin ELSE 0 END AS sh FROM c12),
c14 AS (SELECT *, sum(sh * mid) OVER p / sum(sh) OVER p AS centre, sum(sh) OVER p AS tot FROM c13 WINDOW p AS (PARTITION BY ticker, t))
"""
_COMPOSED = _COMPOSITE + """, a AS (SELECT ticker, t, sum(sh * bid) / sum(sh) AS bid, sum(sh * ask) / sum(sh) AS ask, sum(sh * pow(mid - centre, 2)) / sum(sh) AS apart, sum(sh * pow((ask - bid) / 2 * least(sqrt(tau / greatest(ipi, 1e-6)), 3), 2)) / sum(sh) AS aged,
  count_if(sh > 0) AS accepted, count_if(g > 0 AND f >= 0.5) AS live, sum(CASE WHEN g > 0 AND f >= 0.5 THEN fin ELSE 0 END) / sum(sh) AS live_share, sum(CASE WHEN sh > 0 THEN vbid + vask ELSE 0 END) AS vol, sum(sh) * sum(sh) / sum(sh * sh) AS n_eff, max(sh) / sum(sh) AS top_share FROM c14 GROUP BY ticker, t)
SELECT ticker, t, round(CASE WHEN ask > bid THEN bid ELSE (bid + ask) / 2 - CASE WHEN ask = bid AND accepted >= 2 THEN sqrt(apart) ELSE 0 END END, 9) AS bid, round(CASE WHEN ask > bid THEN ask ELSE (bid + ask) / 2 + CASE WHEN ask = bid AND accepted >= 2 THEN sqrt(apart) ELSE 0 END END, 9) AS ask, CAST(accepted AS INT) AS accepted,
 CAST(least(65535, round(sqrt(greatest(sqrt(apart + aged), abs(ask - bid) / 2) / ((bid + ask) / 2) * 1e8) * 16)) AS INT) AS ci, CAST(least(live, 64) + CASE WHEN live_share >= 0.2 THEN 128 ELSE 0 END AS INT) AS confidence, CASE WHEN vol = 0 THEN 96 ELSE 64 END AS flags, round(n_eff, 6) AS n_eff, round(top_share, 6) AS top_share FROM a
"""


@query(_COMPOSED)
def composite_tdwap(spark, d):  # noqa: ANN001, ANN201
    c = C.composites(_legs(Q.leg_states(ticks(spark, d)), "ts"), 60.0)
    return c.select("ticker", "t", r("bid", 9), r("ask", 9), "accepted", "ci", "confidence", "flags", r("n_eff", 6), r("top_share", 6))


@query(_COMPOSITE + "SELECT ticker, t, provider, round(sh / tot, 6) AS share FROM c14 WHERE sh > 0")
def composite_weights(spark, d):  # noqa: ANN001, ANN201
    c = C.composites(_legs(Q.leg_states(ticks(spark, d)), "ts"), 60.0)
    return c.select("ticker", "t", F.inline("shares")).select("ticker", "t", "provider", r("share", 6))


@query(_LEGS + """, x AS (SELECT *, sum(weight) OVER (PARTITION BY ticker, t) AS s, sum(weight) OVER (PARTITION BY ticker, t ORDER BY mid, weight ROWS UNBOUNDED PRECEDING) AS c FROM l)
SELECT ticker, t, round(sum(mid * greatest(0, least(0.6 * s, c) - greatest(0.4 * s, c - weight))) / max(0.2 * s), 9) AS median FROM x GROUP BY ticker, t""")
def weighted_median(spark, d):  # noqa: ANN001, ANN201
    legs = _legs(ticks(spark, d), "tc_ms")
    return C.weighted_medians(legs, ["ticker", "t"]).select("ticker", "t", r("median", 9))


@query(_LEGS + """, x AS (SELECT *, sum(weight) OVER (PARTITION BY ticker, t) / 2 AS h, sum(weight) OVER (PARTITION BY ticker, t ORDER BY mid, weight ROWS UNBOUNDED PRECEDING) - weight / 2 AS c FROM l),
p AS (SELECT *, lag(c) OVER w AS pc, lag(mid) OVER w AS pm FROM x WINDOW w AS (PARTITION BY ticker, t ORDER BY mid, weight))
SELECT ticker, t, round(arg_min(CASE WHEN pc IS NULL OR pc = c THEN mid ELSE pm + (mid - pm) * (h - pc) / (c - pc) END, c), 6) AS median FROM p WHERE c >= h GROUP BY ticker, t""")
def interp_median(spark, d):  # noqa: ANN001, ANN201
    legs = _legs(ticks(spark, d), "tc_ms")
    return C.interpolated_medians(legs, ["ticker", "t"]).select("ticker", "t", r("median", 6))


@query(_LEGS + "SELECT ticker, t, round(sum(weight) * sum(weight) / sum(weight * weight), 6) AS n_eff, round(sum(weight * weight) / (sum(weight) * sum(weight)), 6) AS hhi, round(least(0.99, 0.253 + exp(-0.228 * greatest(1, sum(weight) * sum(weight) / sum(weight * weight)))), 6) AS w_max FROM l GROUP BY ticker, t")
def concentration(spark, d):  # noqa: ANN001, ANN201
    return C.concentration(_legs(ticks(spark, d), "tc_ms"), ["ticker", "t"]).select("ticker", "t", r("n_eff", 6), r("hhi", 6), r("w_max", 6))


@query(_LEGS + """, h AS (SELECT ticker, t, list((provider, bid, ask, vbid, vask) ORDER BY provider) AS legs FROM l GROUP BY ticker, t)
SELECT ticker, t, coalesce(legs <> lag(legs) OVER (PARTITION BY ticker ORDER BY t), true) AS changed FROM h""")
def composite_throttle(spark, d):  # noqa: ANN001, ANN201
    return C.unchanged_cycles(_legs(ticks(spark, d), "tc_ms")).select("ticker", "t", "changed")


@query(_LEGS + """, h AS (SELECT ticker, t, list((provider, bid, ask, vbid, vask) ORDER BY provider) AS legs, max(bid) AS best FROM l GROUP BY ticker, t),
c AS (SELECT *, coalesce(legs <> lag(legs) OVER (PARTITION BY ticker ORDER BY t), true) AS changed FROM h), k AS (SELECT *, max(CASE WHEN changed THEN t END) OVER (PARTITION BY ticker ORDER BY t) AS c FROM c)
SELECT ticker, t, changed, round(first_value(best) OVER (PARTITION BY ticker, c + (t - c) // 100000 * 100000 ORDER BY t), 8) AS best FROM k""")
def composite_replay(spark, d):  # noqa: ANN001, ANN201
    legs = _legs(ticks(spark, d), "tc_ms")
    return C.throttled(legs, 100_000, lambda due: due.groupBy("ticker", "t").agg(F.max("bid").alias("best"))).select("ticker", "t", "changed", r("best"))


@query("SELECT seq, round(1 / ask, 10) AS bid, round(1 / bid, 10) AS ask FROM ticks")
def inverted_mark(spark, d):  # noqa: ANN001, ANN201
    return C.inverted_mark(ticks(spark, d)).select("seq", r("bid", 10), r("ask", 10))


# synthetic crosses


def _pair(spark, d, tf=MIN):  # noqa: ANN001, ANN202
    t = ticks(spark, d)
    bars = B.ohlc(t, tf)
    return Y.aligned(bars.where("ticker = 'click'"), bars.where("ticker = 'view'"))


_PAIR = f""", b AS ({_ohlc_sql(MIN)}), p AS (SELECT x.bar_ts, x.open AS o1, x.high AS h1, x.low AS l1, x.close AS c1, y.open AS o2, y.high AS h2, y.low AS l2, y.close AS c2 FROM b x JOIN b y ON x.bar_ts = y.bar_ts AND x.ticker = 'click' AND y.ticker = 'view')
"""


@query(_PAIR + """, v AS (SELECT *, greatest(0, ln(h1 / c1) * ln(h1 / o1) + ln(l1 / c1) * ln(l1 / o1)) AS v1, greatest(0, ln(h2 / c2) * ln(h2 / o2) + ln(l2 / c2) * ln(l2 / o2)) AS v2, o1 / o2 AS o, c1 / c2 AS c FROM p),
w AS (SELECT *, sqrt(4 * ln(2) * greatest(v1 + v2 - 2 * 0.3 * sqrt(v1 * v2), 1e-12)) / 2 AS half FROM v)
SELECT bar_ts, round(o, 7) AS open, round(greatest(sqrt(o * c) * exp(half), o, c), 7) AS high, round(least(sqrt(o * c) * exp(-half), o, c), 7) AS low, round(c, 7) AS close FROM w""")
def synth_ohlc(spark, d):  # noqa: ANN001, ANN201
    return Y.synth_ohlc(_pair(spark, d), 0.3).select("bar_ts", r("open", 7), r("high", 7), r("low", 7), r("close", 7))


@query(_PAIR + """, x AS (SELECT bar_ts, ln(c1 / lag(c1) OVER (ORDER BY bar_ts)) AS a, ln(c2 / lag(c2) OVER (ORDER BY bar_ts)) AS b FROM p), y AS (SELECT * FROM x WHERE a IS NOT NULL),
z AS (SELECT bar_ts, row_number() OVER (ORDER BY bar_ts) AS n, corr(a, b) OVER (ORDER BY bar_ts ROWS 179 PRECEDING) AS rho FROM y)
SELECT bar_ts, round(CASE WHEN n < 2 OR isnan(rho) THEN 0 ELSE least(0.99, greatest(-0.99, rho)) END, 5) AS rho FROM z""")
def rolling_rho(spark, d):  # noqa: ANN001, ANN201
    return Y.rho_cache(_pair(spark, d)).select("bar_ts", r("rho", 5))


@query(""", u AS (SELECT *, CASE WHEN ticker = 'click' THEN tc_ms END AS bt, CASE WHEN ticker = 'view' THEN tc_ms END AS qt FROM ticks WHERE ticker IN ('click', 'view')),
k AS (SELECT tc_ms AS ts, seq, last_value(CASE WHEN ticker = 'click' THEN seq END IGNORE NULLS) OVER w AS bs, last_value(CASE WHEN ticker = 'view' THEN seq END IGNORE NULLS) OVER w AS qs FROM u WINDOW w AS (ORDER BY tc_ms, seq ROWS UNBOUNDED PRECEDING))
SELECT k.ts, k.seq, round(b.bid / q.ask, 7) AS bid, round(b.ask / q.bid, 7) AS ask, least(b.vbid, q.vbid) AS vbid, least(b.vask, q.vask) AS vask, least(b.accepted, q.accepted) AS accepted, CAST(least(65535, round(sqrt(sqrt(pow(b.ci / 16.0, 4) + pow(q.ci / 16.0, 4))) * 16)) AS INT) AS ci
FROM k JOIN ticks b ON b.seq = k.bs JOIN ticks q ON q.seq = k.qs WHERE k.ts - b.tc_ms <= 20000 AND k.ts - q.tc_ms <= 20000""")
def synth_asof(spark, d):  # noqa: ANN001, ANN201
    t = ticks(spark, d)
    return Y.asof_cross(t.where("ticker = 'click'"), t.where("ticker = 'view'"), 20_000).select("ts", "seq", r("bid", 7), r("ask", 7), "vbid", "vask", "accepted", "ci")


def _full_pair(spark, d):  # noqa: ANN001, ANN202
    bars = B.full_bars(ticks(spark, d), MIN)
    return Y.aligned(bars.where("ticker = 'click'"), bars.where("ticker = 'view'"))


_FULL_BARS = _FULL + f""", fb AS (SELECT ticker, bar_ts, arg_min(mid, (tc_ms, seq)) AS o, max(mid) AS h, min(mid) AS l, arg_max(mid, (tc_ms, seq)) AS c, CAST(sum(vbid) AS BIGINT) AS vbid, CAST(sum(vask) AS BIGINT) AS vask, count(*) AS n, coalesce(sum(r * r), 0) AS rv, coalesce(sum(abs(r) * abs(rp)) * pi() / 2, 0) AS bv, coalesce(max(abs(r)), 0) AS mr,
 CAST(least(65535, round(sqrt(sum((ci / 16.0) * (ci / 16.0) * accepted) / sum(accepted)) * 16)) AS INT) AS ci, CAST(round(sum(rejected) / (sum(accepted) + sum(rejected)) * 65535) AS INT) AS rej FROM c GROUP BY ALL),
fv AS (SELECT *, greatest(0, ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o)) AS v FROM fb)
"""
_SYNTH2 = _FULL_BARS + """, sb AS (SELECT x.bar_ts, x.o / y.o AS o, x.c / y.c AS c, sqrt(x.o / y.o * x.c / y.c) AS mid, sqrt(4 * ln(2) * greatest(x.v + y.v - 2 * 0.3 * sqrt(x.v * y.v), 1e-12)) / 2 AS half, greatest(x.rv + y.rv - 2 * 0.3 * sqrt(x.rv * y.rv), 0) AS rv, greatest(x.ci, y.ci) AS ci, CASE WHEN x.ci >= y.ci THEN x.n ELSE y.n END AS n
 FROM fv x JOIN fv y ON x.bar_ts = y.bar_ts AND x.ticker = 'click' AND y.ticker = 'view')
"""


@query(_SYNTH2 + "SELECT bar_ts, round(o, 7) AS open, round(c, 7) AS close, round(rv, 8) AS realized_var, ci AS avg_ci_ubp, n AS tick_count FROM sb")
def synth_bar(spark, d):  # noqa: ANN001, ANN201
    return Y.synth_bar(_full_pair(spark, d), 0.3).select("bar_ts", r("open", 7), r("close", 7), r("realized_var"), "avg_ci_ubp", "tick_count")


@query(_SYNTH2 + "SELECT bar_ts // 300000 * 300000 AS dst_ts, round(arg_min(o, bar_ts), 7) AS open, round(max(greatest(mid * exp(half), o, c)), 7) AS high, round(min(least(mid * exp(-half), o, c)), 7) AS low, round(arg_max(c, bar_ts), 7) AS close, round(sum(rv), 8) AS realized_var, CAST(sum(n) AS BIGINT) AS tick_count FROM sb GROUP BY ALL")
def synth_bar_rollup(spark, d):  # noqa: ANN001, ANN201
    return Y.synth_rollup(Y.synth_bar(_full_pair(spark, d), 0.3), 300_000).select("dst_ts", r("open", 7), r("high", 7), r("low", 7), r("close", 7), r("realized_var"), "tick_count")


@query(_FULL_BARS + """SELECT x.bar_ts, round(x.o / y.o, 7) AS open, round(greatest(x.o / y.o, x.c / y.c, x.h / y.h, x.l / y.l), 7) AS high, round(least(x.o / y.o, x.c / y.c, x.h / y.h, x.l / y.l), 7) AS low, round(x.c / y.c, 7) AS close, least(x.vbid, y.vbid) AS vbid, least(x.vask, y.vask) AS vask, greatest(x.n, y.n) AS tick_count,
 CAST(least(65535, round(sqrt(sqrt(pow(x.ci / 16.0, 4) + pow(y.ci / 16.0, 4))) * 16)) AS INT) AS avg_ci_ubp, 128 AS flags FROM fb x JOIN fb y ON x.bar_ts = y.bar_ts AND x.ticker = 'click' AND y.ticker = 'view'""")
def cross_bar_10s(spark, d):  # noqa: ANN001, ANN201
    return Y.cross_bar(_full_pair(spark, d)).select("bar_ts", r("open", 7), r("high", 7), r("low", 7), r("close", 7), "vbid", "vask", "tick_count", "avg_ci_ubp", "flags")


@query(""", q AS (SELECT ticker, arg_max(bid, (tc_ms, seq)) AS bid, arg_max(ask, (tc_ms, seq)) AS ask FROM ticks GROUP BY ticker)
SELECT a.ticker || '/' || b.ticker AS path, round(a.bid / b.ask, 7) AS bid, round(a.ask / b.bid, 7) AS ask FROM q a JOIN q b ON a.ticker <> b.ticker""")
def synth_tick(spark, d):  # noqa: ANN001, ANN201
    q = R.last_per_key(ticks(spark, d), "tc_ms").select(F.col("ticker").alias("sym"), "bid", "ask", "mid", F.lit(10000).alias("conf"))
    a, b = q.select(F.col("sym").alias("s1")), q.select(F.col("sym").alias("s2"))
    paths = a.join(b, F.col("s1") != F.col("s2")).select(F.concat_ws("/", "s1", "s2").alias("path"), F.array(F.struct(F.col("s1").alias("sym"), F.lit(1).alias("exp")), F.struct(F.col("s2").alias("sym"), F.lit(-1).alias("exp"))).alias("legs"))
    return Y.compose_ticks(paths, q).select("path", r("bid", 7), r("ask", 7))


_PRIMARIES = [("EUR/USD", "EUR", "USD", 1), ("USDC/USD", "USDC", "USD", 2), ("EUR/USDT", "EUR", "USDT", 3), ("USDC/USDT", "USDC", "USDT", 4), ("GER40/EUR", "GER40", "EUR", 5)]
_ROUTES = """WITH RECURSIVE p AS (SELECT sym, base, quote, id, volume FROM (VALUES ('EUR/USD', 'EUR', 'USD', 1), ('USDC/USD', 'USDC', 'USD', 2), ('EUR/USDT', 'EUR', 'USDT', 3), ('USDC/USDT', 'USDC', 'USDT', 4), ('GER40/EUR', 'GER40', 'EUR', 5)) AS s(sym, base, quote, id)
  JOIN (SELECT l_suppkey % 5 + 1 AS id, sum(l_quantity) AS volume FROM lineitem GROUP BY 1) USING (id)),
e AS (SELECT base AS src, quote AS dst, sym, volume FROM p UNION ALL SELECT quote, base, sym, volume FROM p),
w AS (SELECT src, dst, [src, dst] AS seen, [sym] AS legs, volume FROM e UNION ALL SELECT w.src, e.dst, list_append(w.seen, e.dst), list_append(w.legs, e.sym), least(w.volume, e.volume) FROM w JOIN e ON e.src = w.dst WHERE len(w.legs) < 3 AND NOT list_contains(w.seen, e.dst))
"""


def _edges(spark, d):  # noqa: ANN001, ANN202
    """Five pairs, as deep as a fifth of the suppliers each sells."""
    p = spark.createDataFrame(_PRIMARIES, "sym string, base string, quote string, ticker_id bigint")
    sold = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5 + 1).alias("ticker_id")).agg(F.sum("l_quantity").alias("volume"))
    v = p.join(sold, "ticker_id").select("sym", "volume")
    return G.edges(p.join(v.select("sym"), "sym", "left_semi"), v)


@query(_ROUTES + "SELECT src, dst, CAST(len(legs) AS INT) AS hops, volume AS bottleneck, array_to_string(legs, ' ') AS legs FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY len(legs), volume DESC, legs) AS r FROM w) WHERE r = 1", raw=True)
def cross_routes(spark, d):  # noqa: ANN001, ANN201
    return G.routes(_edges(spark, d)).select("src", "dst", "hops", "bottleneck", F.array_join(F.transform("legs", lambda x: x["sym"]), " ").alias("legs"))


@query(_ROUTES + "SELECT DISTINCT src, dst FROM w", raw=True)
def servable_pairs(spark, d):  # noqa: ANN001, ANN201
    return G.servable(_edges(spark, d))


@query("SELECT a.event_type AS base, b.event_type AS quote FROM (SELECT DISTINCT event_type FROM events) a, (SELECT DISTINCT event_type FROM events) b WHERE a.event_type <> b.event_type AND b.event_type <> 'view' AND NOT (a.event_type = 'view' AND b.event_type = 'click')", raw=True)
def cross_expand(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events")
    live = spark.createDataFrame([("view", "click")], "base string, quote string")
    return G.expanded(e.select(F.col("event_type").alias("asset")), live, "view")


# ranges


@query("SELECT seq, ticker, tc_ms, round(mid, 8) AS mid FROM ticks WHERE tc_ms BETWEEN 1704068000000 AND 1704080000000 ORDER BY tc_ms, seq LIMIT 500")
def history_range(spark, d):  # noqa: ANN001, ANN201
    return R.first_n(ticks(spark, d), "tc_ms", 500, start=1704068000000, end=1704080000000).select("seq", "ticker", "tc_ms", r("mid"))


@query("SELECT seq, ticker, tc_ms FROM ticks ORDER BY tc_ms DESC, seq DESC LIMIT 200")
def newest_n(spark, d):  # noqa: ANN001, ANN201
    return R.newest_n(ticks(spark, d), "tc_ms", 200).select("seq", "ticker", "tc_ms")


@query("SELECT ticker, max(seq) AS seq, max(tc_ms) AS tc_ms, round(arg_max(mid, (tc_ms, seq)), 8) AS mid FROM ticks GROUP BY ticker")
def last_per_ticker(spark, d):  # noqa: ANN001, ANN201
    return R.last_per_key(ticks(spark, d), "tc_ms").select("ticker", "seq", "tc_ms", r("mid"))


@query("SELECT ticker, provider, round((1704093120000 - max(tc_ms)) / 1000.0, 3) AS age_s, CASE WHEN 1704093120000 - max(tc_ms) < 30000 THEN 'fresh' WHEN 1704093120000 - max(tc_ms) < 300000 THEN 'stale' ELSE 'dead' END AS status FROM ticks GROUP BY ticker, provider")
def age_status(spark, d):  # noqa: ANN001, ANN201
    t = ticks(spark, d).withColumn("leg", F.struct("ticker", "provider"))
    return R.last_status(t, "tc_ms", 1704093120000, "leg").select("leg.ticker", "leg.provider", r("age_s", 3), "status")


@query("SELECT ticker, min(ts_ms // 86400000 * 86400000) AS first_day_ms, max(ts_ms // 86400000 * 86400000) AS last_day_ms, count(*) AS n FROM ticks GROUP BY ticker")
def coverage(spark, d):  # noqa: ANN001, ANN201
    return R.coverage(ticks(spark, d), "ts_ms")


@query("SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, count(DISTINCT provider) AS providers FROM ticks")
def counts(spark, d):  # noqa: ANN001, ANN201
    return R.counts(ticks(spark, d))


@query("SELECT seq, ticker, tc_ms FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY tc_ms DESC, seq DESC) AS n, max(tc_ms) OVER (PARTITION BY ticker) AS m FROM ticks) WHERE n <= 100 AND tc_ms >= m - 600000")
def ring_retention(spark, d):  # noqa: ANN001, ANN201
    return R.ring(ticks(spark, d), "tc_ms", 100, 600_000).select("seq", "ticker", "tc_ms")


@query("SELECT seq, isfinite(value) AND value > 0 AND value < 1e15 AS sane, bid > 0 AND ask >= bid AND (ask - bid) / ((ask + bid) * 0.5) * 1e4 <= 2000 AS tick_ok, bid > 0 AND ask > bid AND (ask - bid) / ((ask + bid) * 0.5) * 1e4 <= 2000 AS book_ok, provider NOT IN (3, 5) AS admitted FROM ticks")
def row_filters(spark, d):  # noqa: ANN001, ANN201
    return ticks(spark, d).select("seq", X.sane_px("value").alias("sane"), X.valid_tick().alias("tick_ok"), X.valid_book().alias("book_ok"), (~F.col("provider").isin(3, 5)).alias("admitted"))


@query("WITH s AS (SELECT DISTINCT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS day FROM lineitem), r AS (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY day DESC) AS n FROM s) SELECT ticker, CAST(day AS VARCHAR) AS day, n > 5000 AS drop FROM r", raw=True)
def retention(spark, d):  # noqa: ANN001, ANN201
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("day")).distinct()
    return R.retained(s, 5000).select("ticker", F.col("day").cast("string").alias("day"), "drop")


@query("WITH p AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS day, l_extendedprice / l_quantity AS px, l_orderkey, l_linenumber, l_quantity FROM lineitem) SELECT ticker, CAST(day AS VARCHAR) AS day, round(arg_min(px, (l_orderkey, l_linenumber)), 9) AS open, round(max(px), 9) AS high, round(min(px), 9) AS low, round(arg_max(px, (l_orderkey, l_linenumber)), 9) AS close, round(sum(l_quantity), 2) AS volume, count(*) AS n FROM p GROUP BY ALL", raw=True)
def daily_ohlc(spark, d):  # noqa: ANN001, ANN201
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.struct("l_orderkey", "l_linenumber").alias("at"), "l_quantity")
    bars = p.groupBy("ticker", "day").agg(r(F.min_by("px", "at"), 9, "open"), r(F.max("px"), 9, "high"), r(F.min("px"), 9, "low"), r(F.max_by("px", "at"), 9, "close"), r(F.sum("l_quantity"), 2, "volume"), F.count("*").alias("n"))
    return bars.withColumn("day", F.col("day").cast("string"))


# statistics and codecs


@query("SELECT ticker, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std_dev, round(median(value), 6) AS median, round(quantile_cont(value, 0.7), 6) AS percentile, round(mad(value), 6) AS mad FROM ticks GROUP BY ticker")
def descriptive(spark, d):  # noqa: ANN001, ANN201
    return S.describe(ticks(spark, d), "ticker", "value").select("ticker", *[r(c, 6) for c in ("mean", "std_dev", "median", "percentile", "mad")])


_LAG = ", g AS (SELECT ticker, CAST(least(15, CASE WHEN floor(value) <= 0 THEN 0 ELSE length(bin(CAST(floor(value) AS BIGINT))) END) AS INT) AS bucket, CAST(floor(value) AS BIGINT) AS ms FROM ticks), h AS (SELECT ticker, bucket, count(*) AS n, max(ms) AS worst FROM g GROUP BY ALL)\n"


@query(_LAG + "SELECT * FROM h")
def lag_hist(spark, d):  # noqa: ANN001, ANN201
    return S.lag_histogram(ticks(spark, d).withColumn("ms", F.floor("value")), "ticker", "ms")


@query(_LAG + ", c AS (SELECT *, sum(n) OVER (PARTITION BY ticker ORDER BY bucket) AS c, sum(n) OVER (PARTITION BY ticker) AS t, max(worst) OVER (PARTITION BY ticker) AS w FROM h) SELECT ticker, CAST(arg_min(least(CAST(pow(2, bucket) AS BIGINT) - 1, w), bucket) AS BIGINT) AS quantile FROM c WHERE c >= ceil(t * 0.9) GROUP BY ticker")
def lag_quantile(spark, d):  # noqa: ANN001, ANN201
    return S.lag_quantile(S.lag_histogram(ticks(spark, d).withColumn("ms", F.floor("value")), "ticker", "ms"), "ticker", 0.9)


@query("SELECT seq, CAST(least(65535, round(sqrt(value) * 16)) AS INT) AS ci_encoded, round((ci / 16.0) * (ci / 16.0), 8) AS ci_decoded, (ts_ms - 1262304000000) * 1000 // 16 AS mts, 1262304000000 + ((ts_ms - 1262304000000) * 1000 // 16) * 16 // 1000 AS back_ms FROM ticks")
def scalar_codecs(spark, d):  # noqa: ANN001, ANN201
    t = ticks(spark, d).withColumn("mts", X.ms_to_mts("ts_ms"))
    return t.select("seq", X.ci_encode("value").alias("ci_encoded"), r(X.ci_decode("ci"), 8, "ci_decoded"), "mts", X.mts_to_ms("mts").alias("back_ms"))


@query("SELECT p_partkey, (p_partkey % 7) AS itype, (p_partkey % 11) AS base_class, (p_partkey % 65536) AS base_id, (p_partkey % 5) AS quote_class, ((p_partkey * 7) % 65536) AS quote_id FROM part", raw=True)
def ticker_bits(spark, d):  # noqa: ANN001, ANN201
    k = F.col("p_partkey").cast("long")
    p = table(spark, d, "part").select(k.alias("p_partkey"), X.make_ticker(k % 7, k % 11, k % 65536, k % 5, (k * 7) % 65536).alias("id"))
    return p.withColumn("id", X.inverse_ticker(X.inverse_ticker("id"))).select("p_partkey", *[c for c in X.ticker_parts("id")][:5])


@query("WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag || CASE l_linenumber % 4 WHEN 0 THEN '/' WHEN 1 THEN '-' WHEN 2 THEN '' ELSE '_' END || l_linestatus AS symbol FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 <> 2 THEN substr(symbol, 1, 1) END AS base, CASE WHEN l_linenumber % 4 <> 2 THEN substr(symbol, 3, 1) END AS quote FROM s", raw=True)
def split_pair(spark, d):  # noqa: ANN001, ANN201
    n = F.col("l_linenumber") % 4
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.when(n == 0, "/").when(n == 1, "-").when(n == 2, "").otherwise("_"), "l_linestatus").alias("s"))
    return s.withColumn("p", N.split_pair("s")).select("l_orderkey", "l_linenumber", "p.base", "p.quote")


@query("SELECT a.n_name AS a, b.n_name AS b, round(jaro_winkler_similarity(a.n_name, b.n_name), 6) AS jw FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", raw=True)
def jaro_winkler(spark, d):  # noqa: ANN001, ANN201
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_name").alias("a"), "n_regionkey"), n.select(F.col("n_name").alias("b"), "n_regionkey")
    return N.similarities(a.join(b, "n_regionkey").select("a", "b"), "a", "b").select("a", "b", r("jw", 6))


@query("SELECT n_name, CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(n_name, ''), lambda x: CAST(ord(x) AS UHUGEINT))), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS VARCHAR) AS id FROM nation", raw=True)
def fnv_phantom_id(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "nation").select("n_name", N.fnv1a_64("n_name").cast("string").alias("id"))


@query("SELECT CAST(ascii(ticker) * 1000 + length(ticker) AS BIGINT) AS ticker, 1262304000000 + ((ts_ms - 1262304000000) * 1000 // 16) * 16 // 1000 AS ts_ms, bid, ask, vbid, vask, ci, CAST(accepted AS INT) AS accepted, CAST(rejected AS INT) AS rejected, round(mid, 8) AS mid FROM ticks")
def idx_codec_roundtrip(spark, d):  # noqa: ANN001, ANN201
    from ..sources import codec

    t = ticks(spark, d).select((F.ascii("ticker") * 1000 + F.length("ticker")).cast("long").alias("ticker"), "seq", X.ms_to_mts("ts_ms").alias("mts"), "bid", "ask", "vbid", "vask", "ci", "accepted", "rejected")
    blobs = codec.encode_rows(t.withColumn("key", F.col("ticker").cast("string")), "idx", ["key"], ["seq"])
    return codec.decoded_view(codec.decode_column(blobs, "idx", label="key")).select("ticker", "ts_ms", "bid", "ask", "vbid", "vask", "ci", "accepted", "rejected", r("mid"))


# streams, run over all that is there


@query(f"SELECT ticker, bar_ts, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, tick_count FROM ({_ohlc_sql(MIN)}) WHERE bar_ts + {MIN} <= (SELECT max(tc_ms) FROM ticks)")
def stream_ohlc(spark, d):  # noqa: ANN001, ANN201
    out = L.collected(L.stream_ohlc(stream_ticks(spark, d), 60), "tl_stream_ohlc")
    return out.select("ticker", "bar_ts", r("open"), r("high"), r("low"), r("close"), "tick_count")


@query(_DELTA)
def stream_delta_gate(spark, d):  # noqa: ANN001, ANN201
    return SF.collected(spark, [ticks(spark, d)], L.stream_delta_gate, "tl_stream_delta_gate", "seq").select("ticker", "ts", "seq", r("bid"), r("ask"), "flags")


@query("SELECT seq, provider, tc_ms FROM ticks")
def stream_dedupe(spark, d):  # noqa: ANN001, ANN201
    t = stream_ticks(spark, d)
    twice = t.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return L.collected(L.deduplicated(twice, ts="tc_ms").select("seq", "provider", "tc_ms"), "tl_stream_dedupe")


from . import catalogue, live  # noqa: E402, F401
