"""Spark operators on small tables: golden numbers, batch against stream, and the API."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.api import Market, register
from tickloom.functions import exprs as X
from tickloom.operators import bars as B
from tickloom.operators import composite as C
from tickloom.operators import graph as G
from tickloom.operators import ranges as R
from tickloom.operators import resolve as N
from tickloom.operators import sequential as Q
from tickloom.operators import stats as S
from tickloom.operators import synth as Y
from tickloom.operators import vol as V
from tickloom.sources import codec
from tickloom.streaming import live


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def tick_rows(spark, mids, step=10_000, ticker="T"):
    rows = [(i, ticker, 0, i * step, m * 0.9999, m * 1.0001, float(m), 10 + i, 20, 16 * (i % 3), 2, 1) for i, m in enumerate(mids)]
    return spark.createDataFrame(rows, "seq bigint, ticker string, provider bigint, tc_ms bigint, bid double, ask double, mid double, vbid bigint, vask bigint, ci int, accepted bigint, rejected bigint")


def test_volatility_golden(spark):
    p = [F.lit(float(x)) for x in (100, 105, 98, 102)]
    got = one(spark, X.rs_var(*p), X.rs_sigma(*p), X.parkinson_var(p[1], p[2]), X.gk_var(*p), X.rs_var(F.lit(0.0), *p[1:]))
    assert list(got) == pytest.approx([0.00222252274925343, 0.0471436395418664, 0.00171681298341635, 0.002228525123583498, 0.0], rel=1e-9)
    bars = spark.createDataFrame([("T", i, *map(float, r)) for i, r in enumerate([(100, 105, 98, 102), (101, 104, 99, 100), (103, 106, 101, 105)])], "ticker string, bar_ts bigint, open double, high double, low double, close double")
    assert V.yz_sigma(bars).first()["sigma"] > 0 and V.yz_sigma(bars.limit(1)).first()["sigma"] == 0


def test_scalars(spark):
    got = one(spark, X.snap_25(F.lit(174.38)), X.snap_25(F.lit(84234.0)), X.w_max(F.lit(2)), X.ci_encode(F.lit(300.0)), X.bucket(F.lit(-1), 10), X.round_sig(F.lit(12345.0), 2), X.ms_to_mts(F.lit(0)), X.lag_bucket(F.lit(900)), X.mts_to_ms(X.ms_to_mts(F.lit(1704067200000))))
    assert list(got) == pytest.approx([174.4, 84240, 0.8868, 277, -10, 12000, 0, 10, 1704067200000], abs=1e-3)
    ids = one(spark, X.make_ticker(0, 6, 2701, 6, 18501), X.inverse_ticker(X.inverse_ticker(X.make_ticker(9, 6, 2701, 3, 1))) == X.make_ticker(9, 6, 2701, 3, 1))
    assert ids[1] and one(spark, X.ticker_field(F.lit(ids[0]), 40, 16), X.ticker_field(F.lit(ids[0]), 20, 16))[:] == (2701, 18501)


def test_percentiles(spark):
    df = spark.createDataFrame([("k", float(x)) for x in (1, 2, 3, 4)], "k string, x double")
    r = S.describe(df, "k", "x").first()
    assert r["percentile"] == pytest.approx(3.1) and r["mad"] == 1.0
    lat = spark.createDataFrame([("k", x) for x in (1, 2, 3, 5, 5, 6, 9, 40, 100, 900)], "k string, ms bigint")
    h = S.lag_histogram(lat, "k", "ms")
    assert [S.lag_quantile(h, "k", q).first()["quantile"] for q in (0.5, 0.99)] == [7, 900]


def test_ohlc_and_rollup(spark):
    t = tick_rows(spark, [100, 101, 99, 102, 98, 100, 103])
    b = sorted(map(tuple, B.ohlc(t, 60_000).select("bar_ts", "open", "high", "low", "close", "tick_count").collect()))
    assert b == [(0, 100.0, 102.0, 98.0, 100.0, 6), (60_000, 103.0, 103.0, 103.0, 103.0, 1)]
    r = sorted(map(tuple, B.rollup(B.ohlc(t, 10_000), 10_000, 60_000).select("dst_ts", "open", "high", "low", "close", "tick_count").collect()))
    assert r == b
    late = spark.createDataFrame([(7, "T", 0, 5_000, 1.0, 1.0, 500.0, 1, 1, 0, 1, 0)], t.schema)
    assert B.ohlc_late_dropped(t.unionByName(late), 60_000).agg(F.max("high")).first()[0] == 103
    with pytest.raises(ValueError, match="multiple"):
        B.rollup(t, 10_000, 15_000)


def test_straddling_bar_touches_both_buckets(spark):
    bars = spark.createDataFrame([("T", 50_000, 60_000, 1.0, 3.0, 0.5, 2.0, 5, 6, 7, 0)], "ticker string, bar_ts bigint, close_ts bigint, open double, high double, low double, close double, vbid bigint, vask bigint, tick_count bigint, avg_ci int")
    got = sorted(map(tuple, B.rollup(bars, 10_000, 60_000).select("dst_ts", "open", "high", "low", "close", "vbid").collect()))
    assert got == [(0, 1.0, 3.0, 0.5, 2.0, 5), (60_000, 1.0, 2.0, 1.0, 2.0, 5)]


def test_full_bar(spark):
    t = tick_rows(spark, [100, 101, 100, 102])
    r = B.full_bars(t, 60_000).first()
    x = [math.log(b / a) for a, b in ((100, 101), (101, 100), (100, 102))]
    assert r["realized_var"] == pytest.approx(sum(v * v for v in x))
    assert r["bipower_var"] == pytest.approx(math.pi / 2 * (abs(x[0] * x[1]) + abs(x[1] * x[2])))
    assert r["max_abs_return"] == pytest.approx(max(map(abs, x))) and r["reject_rate"] == round(4 / 12 * 65535)
    flat = B.full_bars(tick_rows(spark, [5.0]).withColumn("ask", F.col("bid")), 60_000).first()
    assert math.isnan(flat["avg_spread_bps"]) and flat["drift"] == 0


def test_flat_fill(spark):
    t = tick_rows(spark, [100, 101], step=30_000)
    got = sorted(map(tuple, B.flat_fill(B.ohlc(t, 10_000), 10_000).select("bar_ts", "close", "flags").collect()))
    assert got == [(0, 100.0, 0), (10_000, 100.0, 64), (20_000, 100.0, 64), (30_000, 101.0, 0)]


def test_guard_and_gate(spark):
    t = tick_rows(spark, [100, 250, 199, 90, 100])
    assert [r["mid"] for r in Q.sane_mids(t).orderBy("seq").collect()] == [100, 199, 100]
    assert Q.delta_gated(tick_rows(spark, [100, 101])).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    t = tick_rows(spark, [100 + (i * 37 % 11) for i in range(60)], step=4_000)
    t.coalesce(1).write.parquet(f"{tmp_path}/t")
    stream = live.table_stream(spark, f"{tmp_path}/t", t.schema)
    got = live.collected(live.stream_ohlc(stream, 60), "bars_live")
    batch = {(r["bar_ts"], r["open"], r["high"], r["low"], r["close"], r["tick_count"]) for r in B.ohlc(t, 60_000).collect()}
    live_rows = {(r["bar_ts"], r["open"], r["high"], r["low"], r["close"], r["tick_count"]) for r in got.collect()}
    assert live_rows <= batch and len(live_rows) >= len(batch) - 1
    gate = live.collected(live.stream_delta_gate(live.table_stream(spark, f"{tmp_path}/t", t.schema)), "gate_live")
    same = lambda df: sorted((r["ts"], r["bid"], r["flags"]) for r in df.collect())
    assert same(gate) == same(Q.delta_gated(t))


def test_synthetic(spark):
    q = spark.createDataFrame([("A", 10.0, 10.2, 10.1, 9000), ("B", 2.0, 2.1, 2.05, 8000)], "sym string, bid double, ask double, mid double, conf int")
    paths = spark.createDataFrame([("A/B", [("A", 1), ("B", -1)]), ("A/C", [("A", 1), ("C", -1)])], "path string, legs array<struct<sym: string, exp: int>>")
    r = Y.compose_ticks(paths, q).collect()
    assert len(r) == 1 and r[0]["bid"] == pytest.approx(10 / 2.1) and r[0]["ask"] == pytest.approx(10.2 / 2) and r[0]["conf"] == 8000
    a, b = tick_rows(spark, [100, 101, 102]), tick_rows(spark, [50, 51, 52]).withColumn("seq", F.col("seq") + 10).withColumn("tc_ms", F.col("tc_ms") + 1)
    assert Y.asof_cross(a, b).count() == 3
    pairs = spark.createDataFrame([(i, float(i), float(2 * i)) for i in range(10)], "bar_ts bigint, a double, b double")
    assert [r["rho"] for r in Y.rolling_corr(pairs, 5).orderBy("bar_ts").collect()][:2] == [0.0, 0.99]


def test_routes(spark):
    p = spark.createDataFrame([("EUR/USD", "EUR", "USD", 1), ("USDC/USD", "USDC", "USD", 2), ("GER40/EUR", "GER40", "EUR", 3), ("X/X", "X", "X", 4)], "sym string, base string, quote string, ticker_id bigint")
    r = {(x["src"], x["dst"]): [leg["sym"] for leg in x["legs"]] for x in G.routes(G.edges(p)).collect()}
    assert r["GER40", "USDC"] == ["GER40/EUR", "EUR/USD", "USDC/USD"] and r["EUR", "USD"] == ["EUR/USD"] and ("X", "X") not in r
    barred = spark.createDataFrame([("EUR", "USD", 1)], "src string, dst string, ticker_id bigint")
    assert ("EUR", "USD") not in {(x["src"], x["dst"]) for x in G.routes(G.edges(p), barred).collect()}


def test_resolver(spark):
    s = spark.createDataFrame([(x,) for x in ("btc", "#ETH", "EURC_", "nothing")], "symbol string")
    assert {r["symbol"]: r["asset_id"] for r in N.resolved(s, N.seed_registry(spark)).collect()} == {"btc": 2701, "#ETH": 5801, "EURC_": 6251}
    assert N.collisions(N.seed_registry(spark)).count() == 0
    got = one(spark, N.fnv1a_64(F.lit("a")).cast("string"), N.fnv1a_64(F.lit("")).cast("string"), N.split_pair(F.lit("A/B"))["quote"], N.split_pair(F.lit("A/B/C")), N.normalized(F.lit(" The Acme Co Inc. ")))
    assert list(got) == [str(0xAF63DC4C8601EC8C), str(0xCBF29CE484222325), "B", None, "acmeco"]


NAMES = ("Acme LLC", "The Acme Co", "ETH+", " Foo Group.", "BRK-B", "Bar, Inc", "x", "", "the the company", "Ünï Limited!")
SYMBOLS = ("ABC.x", "_BTC", "goldusx", "BRK-B", "CVX.US", "^GSPC", "EURUSD.m", "btc_usdt-", "abc.us.m", "cash", "miniMICRO", "A-", "-", "", "x.y.us")


def test_symbol_forms_are_alike_in_columns_and_in_lookups(spark):
    rows = spark.createDataFrame([(x,) for x in NAMES + SYMBOLS], "s string").select("s", N.normalized("s"), N.stripped("s")).collect()
    for s, n, t in rows:
        assert (n, t) == (N.plain_normalized(s), N.plain_stripped(s)), s
    assert [N.plain_normalized(x) for x in NAMES[:5]] == ["acme", "acmeco", "eth+", "foo", "brk-b"]
    assert [N.plain_stripped(x) for x in SYMBOLS[:5]] == ["abc.x", "btc", "gold", "brk", "cvx"]


def test_upper_bound_never_cuts_a_similarity():
    import random

    rng = random.Random(6)
    for _ in range(3000):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 9))) for _ in range(2))
        assert N.jaro_winkler(a, b) <= N.upper_bound(a, b) + 1e-9


def test_tickers(spark):
    """Crypto quotes force crypto bases, then other classes; pins; currency order; six letters; honest failures; perpetuals."""
    reg = [("US Dollar", ["USD"], "FX", 3, 5001), ("Euro", ["EUR"], "FX", 3, 1301), ("Yen", ["JPY"], "FX", 3, 2001), ("Baht", ["THB"], "FX", 3, 4501), ("Tether", ["USDT"], "CR", 6, 17001), ("Bitcoin", ["BTC"], "CR", 6, 2701), ("Ethereum", ["ETH"], "CR", 6, 5801),
           ("Ethereum Index", ["ETH"], "IP", 10, 2101), ("Sui", ["SUI"], "CR", 6, 20301), ("Sun Communities", ["SUI"], "EQ", 0, 13131), ("Solana", ["SOL"], "CR", 6, 14701), ("Gold", ["XAU"], "CM", 4, 161), ("Berkshire", ["BRK-B"], "EQ", 0, 1521), ("Brent", ["BR"], "CM", 4, 77)]
    registry = spark.createDataFrame(reg, N.ASSET)
    known = N.Registry(reg)
    of = lambda s: (lambda m: m and (m[0][2:4], m[1][2:4]))(known.ticker(s))
    assert of("SUI/USDT") == of("SUIUSDT") == ((6, 20301), (6, 17001)) and of("SUI/USD") == ((6, 20301), (3, 5001)) and of("SUI.US") == ((0, 13131), (3, 5001))
    assert of("EUR/USDT") == ((3, 1301), (6, 17001)) and of("XAU/BTC") == ((4, 161), (6, 2701)) and of("USDT/THB") == ((6, 17001), (3, 4501))
    assert of("USDJPY") == of("USD/JPY") == ((3, 5001), (3, 2001)) and of("SOL/ETH") == ((6, 14701), (6, 5801)) and of("BRK-B/USD") == ((0, 1521), (3, 5001))
    assert of("ALGO/USD") is None and of("SOLV/USDT") is None and of("SOL") == ((6, 14701), (3, 5001)) and of("") is None
    s = spark.createDataFrame([("SOL/USDT",), ("SOL/USDT:perp",), ("ALGO/USD",), (None,), ("SOL/USDT",)], "symbol string")
    ids = {r["symbol"]: (r["ticker_id"], r["phantom"]) for r in N.ticker_ids(s, registry).collect()}
    assert len(ids) == 3 and ids["ALGO/USD"][1] and ids["SOL/USDT:perp"][0] - ids["SOL/USDT"][0] == 1 << 60
    back = {r["ticker_id"]: (r["base"], r["quote"], r["itype"]) for r in N.named_tickers(N.ticker_ids(s, registry).select("ticker_id"), registry).collect()}
    assert back[ids["SOL/USDT"][0]] == ("SOLANA", "TETHER", 0) and back[ids["ALGO/USD"][0]][:2] == (f"0x{ids['ALGO/USD'][0] % (1 << 64):016x}", "")
    clash = N.unpinned_clashes(spark.createDataFrame([("SUI",), ("ETH",), ("Sun",)], "symbol string"), spark.createDataFrame([*reg, ("Sun", [], "CR", 6, 9), ("Sun", [], "EQ", 0, 9)], N.ASSET)).collect()
    assert [(r["symbol"], r["class"]) for r in clash] == [("Sun", "EQ")]
    with pytest.raises(ValueError, match="share"):
        N.checked(spark.createDataFrame([("A", ["X"], "CR", 6, 1), ("B", ["x"], "CR", 6, 2)], N.ASSET))


def test_ranges(spark):
    t = tick_rows(spark, range(100, 140))
    m = Market(spark, {"idx": t})
    assert [r["seq"] for r in m.get().history().limit(3).pair("T", "USD").idx().start(20_000).cursor(30_000).fetch().collect()] == [4, 5, 6]
    assert [r["seq"] for r in R.newest_n(t, "tc_ms", 2).collect()] == [38, 39] and m.last(["T"]).first()["seq"] == 39
    assert R.ring(t, "tc_ms", 10, 50_000).count() == 6
    with pytest.raises(ValueError, match="limit"):
        R.idents(t, list(range(1001)))
    days = spark.createDataFrame([("T", i) for i in range(10)], "ticker string, day int")
    assert R.retained(days, 8).where("drop").count() == 2 and R.retained(days, 2).where("drop").count() == 0


def test_composite_rows(spark):
    legs = C.legs_at(tick_rows(spark, [100, 101, 102], step=20_000), 60_000, ts="tc_ms")
    got = sorted(C.composites(legs, 60.0).collect(), key=lambda r: r["t"])
    assert [(r["accepted"], round(r["bid"], 4)) for r in got] == [(1, round(102 * 0.9999, 4))]


def test_files(spark, tmp_path):
    import pandas as pd

    data = codec.encode("idx", pd.DataFrame({"mts": [1, 2], "ticker": [5, 5], "bid": [1.0, 2.0], "ask": [1.5, 2.5], "ci": [16, 32]}))
    (tmp_path / "2024-01-02.idx").write_bytes(data + b"torn")
    (tmp_path / "notes.idx.tmp").write_bytes(b"zzz")
    got = codec.decoded_view(codec.read_files(spark, str(tmp_path), "idx")).orderBy("mts").collect()
    assert [(str(r["dt"]), r["bid"], r["ci_ubp"], r["tick_count"]) for r in got] == [("2024-01-02", 1.0, 1.0, 1), ("2024-01-02", 2.0, 4.0, 1)]
    assert [r["ext"] for r in codec.inventory(spark, str(tmp_path)).collect()] == ["idx"]


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT tl_jaro_winkler('MARTHA', 'MARHTA')").first()[0] == pytest.approx(0.961111, abs=1e-6)


def test_entry_without_the_corpus_package():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_resolver_holds_all_names_against_a_symbol(spark):
    """A wrong first letter, and a suffix of five letters."""
    r = spark.createDataFrame([("bitcoincash", "CR", 6, 1), ("abcdefghijklmnop", "CR", 6, 2), ("other", "CR", 6, 3)], "name string, class string, class_id int, asset_id int")
    s = spark.createDataFrame([("xbitcoincsh",), ("abcdefghijklmnopqrstu",), ("nothing",)], "symbol string")
    assert {x["symbol"]: x["asset_id"] for x in N.resolved(s, r).collect()} == {"xbitcoincsh": 1, "abcdefghijklmnopqrstu": 2}


def test_calibration_meets_the_target(spark):
    """Between two k of the grid, beyond its end, and on the ticker's own sigma."""
    import random

    rng = random.Random(2)
    mids = [100.0]
    for _ in range(4000):
        mids.append(mids[-1] * math.exp(rng.choice((-1, 1)) * 0.0005 * rng.uniform(0.5, 1.5)))
    ticks = tick_rows(spark, mids)
    sigma = ticks.select("ticker", (F.col("tc_ms") - F.pmod("tc_ms", F.lit(X.BIN_MS))).alias("bin_start_ms")).distinct().withColumn("sigma", F.lit(0.0004))
    for own in (None, sigma):
        (r,) = Q.calibrate_k(ticks, 80.0, sigma=own).collect()
        assert abs(r["median"] / 80 - 1) <= 0.05 and (own is None or r["k"] > 5)


def test_record_files_by_ranges(spark, tmp_path):
    import warnings

    import pandas as pd

    from tickloom.sources import files

    n = 500
    data = codec.encode("vol", pd.DataFrame({"mts": range(n), "sigma": [i / 7 for i in range(n)]}))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "2024-01-01.vol").write_bytes(data + b"torn")
    (tmp_path / "t" / "2024-01-02.vol").write_bytes(data[: 14 * 30])
    (tmp_path / "t" / "notes.vol").write_bytes(b"zzz")
    (tmp_path / "t" / "2024-01-03.vol").write_bytes(b"")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        df = files.read_records(spark, str(tmp_path), "vol", range_bytes=14 * 64)
        assert df.rdd.getNumPartitions() == 9 and sorted(r["mts"] for r in df.where("dt = '2024-01-01'").collect()) == list(range(n)) and df.count() == n + 30
        tail = files.read_records(spark, str(tmp_path), "vol", tail=5)
        assert sorted((str(r["dt"]), r["mts"]) for r in tail.collect()) == [*(("2024-01-01", i) for i in range(n - 5, n)), *(("2024-01-02", i) for i in range(25, 30))]
        with pytest.raises(Exception, match="not whole"):
            files.read_records(spark, str(tmp_path), "vol", strict=True).count()


def test_frames_as_columns(spark):
    import numpy as np
    import pandas as pd

    ws = codec.encode_ws(pd.DataFrame([[1, 2, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]], columns=list(codec.FRAMES[1])))
    rest = codec.rest_frames(3, np.arange(14.0).reshape(2, 7))
    with pytest.raises(ValueError, match="65535"):
        codec.encode_rest(3, np.zeros((65_536, 7)))
    assert [len(codec.decode_rest(x)[1]) for x in codec.rest_frames(3, np.zeros((65_536, 7)))] == [65_535, 1]
    blobs = spark.createDataFrame([("a", bytearray(ws)), ("b", None), ("c", bytearray(b"short"))], "path string, content binary")
    got = codec.decoded_frames(blobs, "ws", strict=False).collect()
    assert len(got) == 1 and (got[0]["path"], got[0]["ticker"], got[0]["rejected"]) == ("a", 2, 9.0)
    r = codec.decoded_frames(spark.createDataFrame([("a", bytearray(rest[0]))], "path string, content binary"), "rest").collect()
    assert [(x["kind"], x["row"], x["values"][0]) for x in r] == [(3, 0, 0.0), (3, 1, 7.0)]
    import gzip

    t = codec.texts(spark.createDataFrame([(bytearray(gzip.compress(b"hi")),), (bytearray(b"no"),), (None,)], "content binary")).collect()
    assert [x["text"] for x in t] == ["hi", None, None]


def test_manifest_keeps_the_last_entry(spark):
    files = spark.createDataFrame([("p", bytearray(b"old"), 1), ("p", bytearray(b"newer"), 2)], "path string, content binary, entry int")
    records = spark.createDataFrame([("p", 5), ("p", 9)], "path string, ts_ms bigint")
    assert [(r["bytes"], r["first_ts"], r["last_ts"], r["n"]) for r in codec.manifest(records, files).collect()] == [(5, 5, 9, 2)]
    old = spark.createDataFrame([("d1", 1), ("d2", 2)], "dt string, n int")
    new = spark.createDataFrame([("d2", 7, 1), ("d2", 8, 2), ("d3", 9, 1)], "dt string, n int, entry int")
    assert sorted(map(tuple, codec.upserted(old, new).collect())) == [("d1", 1), ("d2", 8), ("d3", 9)]


def test_stores_gate_and_route(spark, tmp_path):
    t = tick_rows(spark, [100, 100, 101], step=10_000).withColumn("bid", F.lit(1.0)).withColumn("ask", F.lit(2.0)).withColumn("vbid", F.lit(1)).withColumn("ci", F.lit(1)).withColumn("vask", F.when(F.col("seq") < 2, 1).otherwise(2))
    codec.write_gated(t, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 2
    bars = spark.createDataFrame([("T", 86_400_000 + 1_000, 1.0), ("T", 86_400_000 + 3_000, 1.0)], "ticker string, close_ts bigint, close double")
    codec.write_bars(bars, str(tmp_path / "b"), "s10")
    assert sorted(str(r["dt"]) for r in spark.read.parquet(str(tmp_path / "b")).collect()) == ["1970-01-01", "1970-01-02"]


def test_guard_in_candles(spark):
    """A doubled price is out until it is near again; still tickers aren't folded, and both give the same."""
    mids = [100.0, 110.0, 500.0, 105.0, float("nan"), None, -1.0, 108.0]
    rows = [(i, "T", i * 1000, m) for i, m in enumerate(mids)] + [(i, "U", i * 1000, 50.0 + i) for i in range(8)]
    t = spark.createDataFrame(rows, "seq bigint, ticker string, tc_ms bigint, mid double").withColumns({"vbid": F.lit(1), "vask": F.lit(1), "ci": F.lit(16)})
    got = {r["ticker"]: (r["high"], r["tick_count"]) for r in B.ohlc(t, 60_000).collect()}
    assert got == {"T": (110.0, 4), "U": (57.0, 8)} and B.ohlc(t.limit(0), 1000).count() == 0


def test_renko_guard_resumes_and_takes_a_new_k(spark):
    half = 1_800_000
    t = tick_rows(spark, [100, 101, 150, 102, 103], step=1000)
    plain, held = (Q.renko(t, k=1.0, jump=j).collect() for j in (None, 0.05))
    assert max(b["close"] for b in plain) > 140 and max(b["close"] for b in held) < 104
    again = Q.renko(tick_rows(spark, [103, 103.5], step=1000), k=1.0, closes={"T": 100.0}).collect()
    assert again and again[0]["open"] == pytest.approx(100.0)
    moved = t.unionByName(tick_rows(spark, [104, 106, 108], step=1000).withColumn("tc_ms", F.col("tc_ms") + half).withColumn("seq", F.col("seq") + 9))
    hot = moved.withColumn("k", F.when(F.col("tc_ms") < half, 1.0).otherwise(0.2))
    sizes = {b["brick"] for b in Q.renko(hot, jump=0.05).where(F.col("ts") >= half).collect()}
    assert sizes and max(sizes) < 0.3


def test_parity_regime(spark):
    rows = [("x", m, 100.0 * (1.0 if m < 60 else 1.01), 100.0) for m in range(90)]
    got = {r["minute"]: (r["basis"], r["regime"]) for r in C.parity_basis(spark.createDataFrame(rows, "ticker string, minute bigint, leg_mid double, ref_mid double"), 80).collect()}
    assert got[59] == (0.0, False) and got[85][1] and got[85][0] == pytest.approx(0.00995, abs=1e-4)


def test_near_names_by_index_are_those_of_a_full_scan(spark):
    rng = random.Random(4)
    name = lambda n: "".join(rng.choice("abcdeghinorstz19é") for _ in range(n))
    keys = sorted({name(rng.randint(1, 14)) for _ in range(250)} | {"", "a", "aa", "zzzzzz", "the same"})

    def bent(s):
        s = list(s)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(s) + 1)
            kind = rng.random()
            s[i : i + (kind > 0.5)] = [] if 0.5 < kind < 0.75 else [rng.choice("abcz")]
        if len(s) > 3 and rng.random() < 0.3:
            i = rng.randrange(len(s) - 1)
            s[i], s[i + 1] = s[i + 1], s[i]
        return "".join(s)

    queries = sorted({bent(rng.choice(keys)) for _ in range(300)} | {"", "q", "abc" * 20})
    for least in (0.8, 0.9):
        want = {(q, k) for q in queries for k in keys if q and k and N.jaro_winkler(q, k) >= least}
        got = N.similar_names(spark.createDataFrame([(q, least) for q in queries], "q string, need double"), spark.createDataFrame([(k,) for k in keys], "key string"), least).collect()
        assert {(r["q"], r["key"]) for r in got} == want and len(got) == len(want) > 50
        assert all(r["jw"] == N.jaro_winkler(r["q"], r["key"]) for r in got)
    registry = spark.createDataFrame([(k, [bent(k)] if i % 3 == 0 else None, "CR" if i % 2 else "EQ", 6 if i % 2 else 0, i) for i, k in enumerate(keys)], N.ASSET)
    known = N.Registry(N._rows(registry))
    want = {}
    for s in queries:
        m = known.find(s, 0.95 if len(N.plain_normalized(N.plain_stripped(s))) <= 4 else 0.9)
        if m:
            want[s] = (m[0][0], m[0][3], round(m[1], 12))
    assert {r["symbol"]: (r["name"], r["asset_id"], round(r["jw"], 12)) for r in N.resolved(spark.createDataFrame([(s,) for s in [*queries, None]], "symbol string"), registry).collect()} == want


def test_parameters_are_read(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"k": {"a": 1.5}, "names": ["x", "y"]}')
    assert codec.read_params(spark, str(tmp_path / "p.json")).first().asDict(recursive=True) == {"k": {"a": 1.5}, "names": ["x", "y"]}
    pytest.importorskip("yaml")
    (tmp_path / "p.yml").write_text("k:\n  a: 1.5\nnames: [x, y]\n")
    (tmp_path / "q.yml").write_text("m: 2\n")
    rows = [r.asDict(recursive=True) for r in codec.read_params(spark, str(tmp_path / "[pq].yml")).collect()]
    assert {"k": {"a": 1.5}, "names": ["x", "y"], "m": None} in rows and {"k": None, "names": None, "m": 2} in rows


def _near_names(spark):
    """A share whose symbol is near that of a token, which the classes of a crypto quote have first."""
    return spark.createDataFrame([("Token 1", ["ABCDEF12"], "CR", 6, 1), ("Share 2", ["ABCDEF21"], "EQ", 0, 2), ("Tether", ["USDT"], "CR", 6, 9)], N.ASSET)


def test_a_spelling_in_a_later_class_goes_before_a_near_name_in_an_earlier_one(spark):
    s = spark.createDataFrame([("ABCDEF21/USDT",), ("ABCDEF12/USDT",), ("ABCDEF13/USDT",)], "symbol string")
    got = {r["symbol"]: (r["base"], r["jw"] == 1.0) for r in N.resolved_tickers(s, _near_names(spark)).collect()}
    assert got == {"ABCDEF21/USDT": ("Share 2", True), "ABCDEF12/USDT": ("Token 1", True), "ABCDEF13/USDT": ("Token 1", False)}


def test_a_share_against_a_crypto_quote_has_its_own_name_back(spark):
    s = spark.createDataFrame([("ABCDEF21_USDT:PERP",)], "symbol string")
    back = N.named_tickers(N.resolved_tickers(s, _near_names(spark)).select("ticker_id"), _near_names(spark)).collect()
    assert [(r["base"], r["quote"], r["itype"]) for r in back] == [("SHARE 2", "TETHER", 1)]


def test_tickers_whose_id_several_assets_share_have_each_name_once(spark, tmp_path):
    from tickloom.plans import catalogue

    keys = [1, 4, 7, 65_001, 65_004, 130_001]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    got = catalogue.reverse_tickers(spark, str(tmp_path)).collect()
    assert sorted(r["base"] for r in got) == sorted(f"TOKEN {k}" for k in keys)
    ids = {r["base"]: r["ticker_id"] for r in got}
    assert ids["TOKEN 1"] == ids["TOKEN 65001"] == ids["TOKEN 130001"] != ids["TOKEN 7"] and ids["TOKEN 4"] == ids["TOKEN 65004"]
