"""Registered queries of record files and of streams with state: what arrives in parts must give what the batch SQL gives. Importing this adds them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import bars as B
from ..operators import composite as C
from ..operators import ranges as R
from ..operators import sequential as Q
from ..operators import vol as V
from ..session import shared_dir, ticks
from ..sources import files, signatures
from ..streaming import live as L
from ..streaming import stateful as S
from . import queries as P
from .queries import H30, MIN, S10, query, r

# record files

_ID = "CAST(ascii(ticker) * 1000 + length(ticker) AS BIGINT)"
_KEPT_MS = "1262304000000 + (({0} - 1262304000000) * 1000 // 16) * 16 // 1000"


def _store(spark) -> str:  # noqa: ANN001
    return f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"


def _records(t: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """Quotes as index records of their ticker and day."""
    own = (F.ascii("ticker") * 1000 + F.length("ticker")).cast("long")
    return t.withColumns({"series": F.col("ticker"), "dt": F.to_date(F.timestamp_millis(ts)), "ticker": own, "mts": X.ms_to_mts(ts)})


_DAYS = f"SELECT {_ID} AS ticker, ticker AS series, ts_ms // 86400000 AS day, {_KEPT_MS.format('ts_ms')} AS kept_ms, ts_ms, seq, bid, ask, vbid, vask, ci, accepted, rejected FROM ticks"


def _read(df: DataFrame) -> DataFrame:
    return df.select("ticker", F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("series"), F.unix_date("dt").cast("long").alias("day"), X.mts_to_ms("mts").alias("ts_ms"), r("bid"), r("ask"), "vbid", "vask", "ci", "accepted", "rejected")


@query(f"SELECT ticker, series, day, kept_ms AS ts_ms, round(bid, 8) AS bid, round(ask, 8) AS ask, vbid, vask, ci, accepted, rejected FROM ({_DAYS})")
def record_files_idx(spark, d):  # noqa: ANN001, ANN201
    """Index files by ticker and day, written and read by ranges of some records."""
    path = _store(spark)
    files.write_records(_records(ticks(spark, d)), path, "idx", ["mts", "seq"])
    return _read(files.read_records(spark, path, "idx", range_bytes=56 * 256, strict=True))


@query(f"SELECT ticker, series, day, kept_ms AS ts_ms, round(bid, 8) AS bid, round(ask, 8) AS ask, vbid, vask, ci, accepted, rejected FROM (SELECT *, row_number() OVER (PARTITION BY series, day ORDER BY kept_ms DESC, seq DESC) AS k FROM ({_DAYS})) WHERE k <= 5")
def record_files_tail(spark, d):  # noqa: ANN001, ANN201
    """The newest five records of each file."""
    path = _store(spark)
    files.write_records(_records(ticks(spark, d)), path, "idx", ["mts", "seq"])
    return _read(files.read_records(spark, path, "idx", tail=5))


@query(f"""SELECT ticker, CAST((max(tc_ms) - 2000) // 86400000 AS BIGINT) AS day, {_KEPT_MS.format('min(tc_ms)')} AS open_ms, {_KEPT_MS.format('max(tc_ms)')} AS close_ms, round(arg_min(mid, (tc_ms, seq)), 8) AS open, round(max(mid), 8) AS high, round(min(mid), 8) AS low, round(arg_max(mid, (tc_ms, seq)), 8) AS close, CAST(sum(vbid) AS BIGINT) AS vbid, CAST(sum(vask) AS BIGINT) AS vask, count(*) AS tick_count FROM ticks GROUP BY ticker, tc_ms // {S10}""")
def record_files_bars(spark, d):  # noqa: ANN001, ANN201
    """Full bars to the .s10 file of the day that their kind routes them to."""
    b = R.routed_days(B.full_bars(ticks(spark, d), S10), "s10", "close_ts")
    path = _store(spark)
    files.write_records(b.withColumns({"series": F.col("ticker"), "open_mts": X.ms_to_mts("open_ts"), "close_mts": X.ms_to_mts("close_ts")}), path, "bar", ["open_mts"], ext="s10")
    back = files.read_records(spark, path, "bar", ext="s10", strict=True)
    return back.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("ticker"), F.unix_date("dt").cast("long").alias("day"), X.mts_to_ms("open_mts").alias("open_ms"), X.mts_to_ms("close_mts").alias("close_ms"), r("open"), r("high"), r("low"), r("close"), "vbid", "vask", "tick_count")


@query(P._V30 + f""", x AS (SELECT q.ticker, q.bar_ts // 86400000 AS day, q.bar_ts, v, row_number() OVER (PARTITION BY q.ticker, q.bar_ts // 86400000 ORDER BY q.bar_ts DESC) AS k FROM q JOIN m ON m.ticker = q.ticker AND m.n = q.n)
SELECT ticker, CAST(day AS BIGINT) AS day, {_KEPT_MS.format('bar_ts')} AS ms, round(v, 12) AS sigma FROM x WHERE k <= 10""")
def record_files_vol(spark, d):  # noqa: ANN001, ANN201
    """Volatility files, appended to in two goes and trimmed to the newest ten rows of each."""
    v = P._vol30(spark, d).select("ticker", "bin_start_ms", "sigma", F.col("ticker").alias("series"), F.to_date(F.timestamp_millis("bin_start_ms")).alias("dt"), X.ms_to_mts("bin_start_ms").alias("mts"))
    path, early = _store(spark), F.pmod(F.floor(F.col("bin_start_ms") / H30), F.lit(48)) < 24
    for part in (v.where(early), v.where(~early)):
        files.write_records(part, path, "vol", ["mts"], keep=10)
    back = files.read_records(spark, path, "vol")
    return back.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("ticker"), F.unix_date("dt").cast("long").alias("day"), X.mts_to_ms("mts").alias("ms"), r("sigma", 12))


@query(P._DELTA.replace("SELECT o.ticker, tc_ms AS ts, seq, round(bid, 8) AS bid, round(ask, 8) AS ask, flag AS flags FROM g JOIN", f"SELECT o.ticker, {_KEPT_MS.format('tc_ms')} AS ts_ms, round(bid, 8) AS bid, round(ask, 8) AS ask, CAST(flag AS BIGINT) AS flags FROM g JOIN"))
def record_files_gated(spark, d):  # noqa: ANN001, ANN201
    """What the delta gate writes, as index files."""
    g = Q.delta_gated(ticks(spark, d), slice_rows=2_000)
    path = _store(spark)
    files.write_records(_records(g, "ts"), path, "idx", ["mts", "seq"])
    back = files.read_records(spark, path, "idx")
    return back.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("ticker"), X.mts_to_ms("mts").alias("ts_ms"), r("bid"), r("ask"), "flags")


@query(f"SELECT ticker, kept_ms AS ts_ms, round(bid, 8) AS bid, count(*) AS n FROM ({_DAYS}) GROUP BY ALL")
def record_files_tailed(spark, d):  # noqa: ANN001, ANN201
    """Index files that grow between a stream's runs: each record once."""
    t, path = ticks(spark, d), _store(spark)
    out = f"{path}-tailed"
    late = F.pmod("ts_ms", F.lit(86_400_000)) >= 43_200_000
    for part in (t.where(~late), t.where(late)):
        files.write_records(_records(part), path, "idx", ["mts", "seq"])
        stream = files.tail_records(spark, path, "idx", range_bytes=56 * 256)
        q = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    back = spark.read.schema(stream.schema).parquet(f"{out}/rows")
    return back.groupBy("ticker", X.mts_to_ms("mts").alias("ts_ms"), r("bid")).agg(F.count("*").alias("n"))


# envelopes

_KEY = bytes(range(32))
_PADS = [bytes(b ^ x for b in _KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]


@query(f""", h AS (SELECT seq, from_hex('454e5631' || '0100' || '0007' || lpad(to_hex(seq), 16, '0') || lpad(to_hex(ts_ms), 16, '0') || '0020' || sha256(CAST(seq AS VARCHAR))) AS head FROM ticks)
SELECT seq, lower(sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || head)))) AS tag, CASE WHEN seq % 15 = 1 THEN 'key' WHEN seq % 10 = 0 THEN 'tag' ELSE 'ok' END AS verdict, CASE WHEN seq % 15 <> 1 AND seq % 10 <> 0 THEN sha256(CAST(seq AS VARCHAR)) END AS payload FROM h""")
def hmac_envelopes(spark, d):  # noqa: ANN001, ANN201
    """Envelopes sealed, some of them altered on their way, and opened."""
    t = ticks(spark, d).select("seq", "ts_ms", F.unhex(F.sha2(F.col("seq").cast("string").cast("binary"), 256)).alias("body"))
    t = t.withColumn("sent", signatures.sealed(b"ENV1", 7, _KEY, F.col("seq"), F.col("ts_ms"), F.col("body")))
    sent = F.hex("sent")
    altered = F.when(F.col("seq") % 15 == 1, F.concat(F.substring(sent, 1, 14), F.lit("09"), F.substring(sent, 17, 1 << 20))).when(F.col("seq") % 10 == 0, F.concat(F.substring(sent, 1, 60), F.when(F.substring(sent, 61, 1) == "0", "1").otherwise("0"), F.substring(sent, 62, 1 << 20))).otherwise(sent)
    out = signatures.opened(t.withColumn("frame", F.unhex(altered)), b"ENV1", {7: _KEY})
    return out.select("seq", F.lower(F.substring(sent, -64, 64)).alias("tag"), "verdict", F.lower(F.hex("payload")).alias("payload"))


# quiet times

_BEATS = """, n AS (SELECT *, lead(tc_ms) OVER (PARTITION BY ticker ORDER BY tc_ms, seq) AS nxt FROM ticks)
SELECT ticker, beat AS ts, seq, round(bid, 8) AS bid, round(ask, 8) AS ask, CAST(beat > tc_ms AS INT) AS flags FROM (SELECT *, unnest(range(tc_ms, greatest(tc_ms + 1, least(coalesce(nxt, 4611686018427387904), tc_ms + 30001)), 5000)) AS beat FROM n)"""


@query(_BEATS)
def heartbeats(spark, d):  # noqa: ANN001, ANN201
    return R.heartbeats(ticks(spark, d), 5_000, 30_000).select("ticker", "ts", "seq", r("bid"), r("ask"), "flags")


_SESSIONS = """, g AS (SELECT *, coalesce(tc_ms - lag(tc_ms) OVER (PARTITION BY ticker, provider ORDER BY tc_ms, seq) >= 120000, true) AS new FROM ticks),
s AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY ticker, provider ORDER BY tc_ms, seq ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT ticker, provider, min(tc_ms) AS start, max(tc_ms) AS last, count(*) AS n FROM s GROUP BY ticker, provider, k"""


@query(_SESSIONS)
def sessions(spark, d):  # noqa: ANN001, ANN201
    return R.sessions(ticks(spark, d), 120_000, ["ticker", "provider"])


# streams

LATE = "15 minutes"
#: Ticker of the row that closes a stream: it comes hours after all others, so the watermark passes them.
CLOSING = "~"


def _parts(t: DataFrame) -> list[DataFrame]:
    """The quotes up to the middle of their time but for some late ones, then the others, then a closing row."""
    ends = t.agg(F.percentile_approx("tc_ms", 0.5, 1000).alias("cut"), F.max("tc_ms").alias("end")).first()
    if ends["cut"] is None:
        return [t]
    late = (F.col("tc_ms") > ends["cut"] - 600_000) & (F.col("seq") % 7 == 0)
    first = (F.col("tc_ms") <= ends["cut"]) & ~late
    closing = t.where(F.col("tc_ms") == ends["end"]).limit(1).withColumns({"tc_ms": F.lit(ends["end"] + 7_200_000), "ticker": F.lit(CLOSING), "seq": F.lit(-1).cast("long")})
    return [t.where(first), t.where(~first), closing]


def _run(spark, d: str, make, name: str) -> DataFrame:  # noqa: ANN001
    return S.collected(spark, _parts(ticks(spark, d)), make, f"tl_{name}", "tc_ms")


@query(_BEATS)
def stream_heartbeats(spark, d):  # noqa: ANN001, ANN201
    out = _run(spark, d, lambda s: S.heartbeats(s, 5_000, 30_000, LATE), "beats")
    return out.where(F.col("ticker") != CLOSING).select("ticker", "ts", "seq", r("bid"), r("ask"), "flags")


@query(_SESSIONS)
def stream_sessions(spark, d):  # noqa: ANN001, ANN201
    out = _run(spark, d, lambda s: R.sessions(S.timed(s, LATE), 120_000, ["ticker", "provider"]), "sessions")
    return out.where(F.col("ticker") != CLOSING)


@query(f"{P._GUARD}, k AS (SELECT t.* FROM g JOIN o ON o.ticker = g.ticker AND o.n = g.n JOIN ticks t ON t.seq = o.seq WHERE g.ok)\nSELECT ticker, tc_ms // {MIN} * {MIN} AS bar_ts, round(arg_min(value, (tc_ms, seq)), 8) AS open, round(max(value), 8) AS high, round(min(value), 8) AS low, round(arg_max(value, (tc_ms, seq)), 8) AS close, count(*) AS tick_count FROM k GROUP BY ALL")
def stream_ohlc_guarded(spark, d):  # noqa: ANN001, ANN201
    """Guard, then bars: two stateful operators in one stream."""
    out = _run(spark, d, lambda s: S.guarded_ohlc(s, 60, LATE, "value"), "guarded_bars")
    return out.where(F.col("ticker") != CLOSING).select("ticker", "bar_ts", r("open"), r("high"), r("low"), r("close"), "tick_count")


@query(P.ORACLE["synth_asof"], raw=True)
def stream_synth_asof(spark, d):  # noqa: ANN001, ANN201
    none = F.lit(None).cast("double")

    def make(s: DataFrame) -> DataFrame:
        closing = F.col("ticker") == CLOSING
        base = s.where((F.col("ticker") == "click") | closing).withColumns({c: F.when(closing, none).otherwise(F.col(c)) for c in ("bid", "ask")})
        return S.asof_cross(base, s.where("ticker = 'view'"), "click/view", 20_000, LATE)

    return _run(spark, d, make, "asof").select("ts", "seq", r("bid", 7), r("ask", 7), "vbid", "vask", "accepted", "ci")


def _market(provider: int) -> tuple[float, bool]:
    return 1 + provider * 0.5, provider < 6


def _quotes(c: DataFrame, *more: str) -> DataFrame:
    return c.select("ticker", "t", *more, r("bid", 9), r("ask", 9), "accepted", "ci", "confidence", "flags", r("n_eff", 6), r("top_share", 6))


@query(P._COMPOSED)
def stream_composite(spark, d):  # noqa: ANN001, ANN201
    """Tick to quote, live: legs in keyed state, a quote at each instant that the watermark has reached."""
    out = _run(spark, d, lambda s: S.composites(s, P.STEP, _market, 60.0, late=LATE), "composite")
    return _quotes(out.where(F.col("ticker") != CLOSING))


_CLASSES = {"click": "MAJOR", "view": "PEGGED", "purchase": "FX_METAL"}
_REACH_MS = 900_000
_FLOOR, _BASE = X.KERNELS["ALT"][1] * 1e-4, X.kernel_sigma(X.KERNELS["ALT"][0])


def _mixed_sql() -> str:
    """The composite's SQL with each ticker's own kernel (kn, least spread fl, horizon hz) and the sigma of its last closed half hour (v2 is its square)."""
    rows = ", ".join(f"('{t}', '{k}', {X.KERNELS[k][1] * 1e-4!r}::DOUBLE, {X.KERNELS[k][2]!r}::DOUBLE, {X.kernel_sigma(X.KERNELS[k][0])!r}::DOUBLE)" for t, k in _CLASSES.items())
    own = f"""lk AS (SELECT l.*, coalesce(kn, 'ALT') AS kn, coalesce(fl, {_FLOOR!r}) AS fl, coalesce(hz, 60.0) AS hz, pow(least(greatest(coalesce(sg.sigma, coalesce(bs, {_BASE!r})), coalesce(bs, {_BASE!r})), 10 * coalesce(bs, {_BASE!r})), 2) AS v2
 FROM l LEFT JOIN (VALUES {rows}) AS kt(tk, kn, fl, hz, bs) ON kt.tk = l.ticker LEFT JOIN (SELECT q.ticker AS tk, q.bar_ts AS bin, v AS sigma FROM q JOIN m ON m.ticker = q.ticker AND m.n = q.n) AS sg ON sg.tk = l.ticker AND sg.bin = l.t // {H30} * {H30} - {H30}),\n"""
    text = P._COMPOSED
    for old, new in (
        ("tc_ms + 60000) + 1", f"tc_ms + {_REACH_MS}) + 1"),
        ("c1 AS (SELECT *,", own + "c1 AS (SELECT *,"),
        ("FROM l WHERE bid > 0", "FROM lk WHERE bid > 0"),
        (f"(ask + bid), {_FLOOR!r})", "(ask + bid), fl)"),
        ("WHERE tau <= 60 ", "WHERE tau <= hz "),
        (f"/ {P._VOL2!r}, 30.0), 60.0)", "/ v2, 30.0), hz)"),
        (f"+ {P._VOL2!r} * eff", "+ v2 * eff"),
        ("END, 9) AS bid", "END) AS bid"),
        ("END, 9) AS ask", "END) AS ask"),
    ):
        assert old in text, old
        text = text.replace(old, new, 1)
    median = """
w AS (SELECT ticker, t, mid, sh, sum(sh) OVER (PARTITION BY ticker, t) AS s, sum(sh) OVER (PARTITION BY ticker, t ORDER BY mid, sh ROWS UNBOUNDED PRECEDING) AS c FROM c14 WHERE kn = 'PEGGED' AND sh > 0),
md AS (SELECT ticker, t, sum(mid * greatest(0, least(0.6 * s, c) - greatest(0.4 * s, c - sh))) / max(0.2 * s) AS median FROM w GROUP BY ticker, t),
z AS (SELECT ticker, t, (CASE"""
    text = text.replace("\nSELECT ticker, t, round(CASE", "," + median).replace("round(CASE WHEN ask > bid THEN ask", "(CASE WHEN ask > bid THEN ask")
    shift = "coalesce(median - (z.bid + z.ask) / 2, 0)"
    return P._V30.replace("ts_ms", "tc_ms") + text + f""")
SELECT z.ticker, z.t, round(z.bid + {shift}, 9) AS bid, round(z.ask + {shift}, 9) AS ask, accepted, ci, confidence, flags, n_eff, top_share FROM z LEFT JOIN md ON md.ticker = z.ticker AND md.t = z.t"""


@query(_mixed_sql())
def composite_mixed(spark, d):  # noqa: ANN001, ANN201
    """Composites with the kernel of each ticker's class and its own measured sigma."""
    t = ticks(spark, d)
    legs = C.legs_at(Q.leg_states(t), P.STEP, _REACH_MS, ts="ts")
    legs = legs.withColumn("weight", 1 + F.col("provider") * 0.5).withColumn("mapped", F.col("provider") < 6)
    sigma = V.vol_rows(B.ohlc(t, H30), src_ms=H30)
    classes = t.select("ticker").distinct().withColumn("kernel", F.when(F.col("ticker") == "click", "MAJOR").when(F.col("ticker") == "view", "PEGGED").when(F.col("ticker") == "purchase", "FX_METAL"))
    return _quotes(C.composites(C.kernels_at(legs, classes, sigma), 60.0))


REFRESH_MS = 5 * P.STEP
_THROTTLED = P._COMPOSED.replace("\nSELECT ticker, t, round(CASE", ",\nz AS (SELECT ticker, t, round(CASE") + f"""),
h AS (SELECT ticker, t, list((provider, bid, ask, vbid, vask) ORDER BY provider) AS legs FROM l GROUP BY ticker, t), c AS (SELECT *, coalesce(legs <> lag(legs) OVER (PARTITION BY ticker ORDER BY t), true) AS changed FROM h),
k AS (SELECT *, max(CASE WHEN changed THEN t END) OVER (PARTITION BY ticker ORDER BY t) AS c FROM c), due AS (SELECT *, min(t) OVER (PARTITION BY ticker, c + (t - c) // {REFRESH_MS} * {REFRESH_MS}) AS f FROM k)
SELECT due.ticker, due.t, due.t = f AS computed, z.* EXCLUDE (ticker, t) FROM due JOIN z ON z.ticker = due.ticker AND z.t = due.f"""


@query(_THROTTLED)
def composite_throttled(spark, d):  # noqa: ANN001, ANN201
    """Composites of instants whose legs changed or are due; the others repeat them."""
    legs = P._legs(Q.leg_states(ticks(spark, d)), "ts")
    out = C.throttled(legs, REFRESH_MS, lambda due: C.composites(due, 60.0).withColumn("at", F.col("t")))
    return _quotes(out.withColumn("computed", F.col("t") == F.col("at")), "computed")


@query(_THROTTLED)
def stream_composite_throttled(spark, d):  # noqa: ANN001, ANN201
    out = _run(spark, d, lambda s: S.composites(s, P.STEP, _market, 60.0, refresh_ms=REFRESH_MS, late=LATE), "throttled")
    return _quotes(out.where(F.col("ticker") != CLOSING), "computed")


@query(P._renko_sql(2.0, 0.0, "tc_ms") + "SELECT ticker, ts, seq, round(open, 8) AS open, round(close, 8) AS close, flags FROM bricks")
def stream_renko(spark, d):  # noqa: ANN001, ANN201
    """Bricks of a stream whose parts follow each other in time, as a fold that doesn't wait needs them."""
    t = ticks(spark, d)
    cut = t.agg(F.percentile_approx("tc_ms", 0.5, 1000)).first()[0] or 0
    out = S.collected(spark, [t.where(F.col("tc_ms") <= cut), t.where(F.col("tc_ms") > cut)], lambda s: L.stream_renko(s, 2.0, 0.01), "tl_renko", "tc_ms")
    return out.select("ticker", "ts", "seq", r("open"), r("close"), "flags")


@query(P._V30 + "SELECT q.ticker, q.bar_ts AS bin_start_ms, round(raw, 9) AS raw, round(v, 9) AS sigma FROM q JOIN m ON m.ticker = q.ticker AND m.n = q.n")
def stream_vol_rows(spark, d):  # noqa: ANN001, ANN201
    """Smoothed sigma of closed bins that arrive a half of the days after the other."""
    bins = P._vol30(spark, d).select("ticker", "bin_start_ms", "raw")
    cut = bins.agg(F.percentile_approx("bin_start_ms", 0.5, 1000)).first()[0] or 0
    out = S.collected(spark, [bins.where(F.col("bin_start_ms") <= cut), bins.where(F.col("bin_start_ms") > cut)], L.stream_vol_rows, "tl_vol_rows", "bin_start_ms")
    return out.select("ticker", "bin_start_ms", r("raw", 9), r("sigma", 9))
