"""Event-time operators: rows that come out of order within the delay, rows that come after it, nulls, ties, and queries that go on from their checkpoint."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import ranges as R
from tickloom.streaming import stateful as S

COLUMNS = "ticker string, tc_ms bigint, seq bigint, provider bigint, mid double, bid double, ask double, vbid bigint, vask bigint, ci int, accepted bigint"


def tick(ticker, ts, seq, mid, provider=1):
    return (ticker, ts, seq, provider, mid, mid and mid - 0.1, mid and mid + 0.1, 1, 2, 16, 1)


def frames(spark, *parts):
    return [spark.createDataFrame(p, COLUMNS) for p in parts]


END = tick("~", 10_000_000, 10**6, 1.0)


def test_bars_wait_for_late_rows_and_drop_those_that_are_too_late(spark):
    rng = random.Random(2)
    rows = [tick(t, 1_000 + i * 700, i, 100 + rng.gauss(0, 1) if i % 9 != 4 else 500.0) for i in range(200) for t in ("a", "b")]
    early, late = [r for r in rows if r[2] % 5 or r[1] < 100_000], [r for r in rows if not r[2] % 5 and r[1] >= 100_000]
    rng.shuffle(early)
    nulls = [tick(None, 5_000, 900, 100.0), tick("a", None, 901, 100.0), tick("a", 6_000, 902, None)]
    too_late = [tick("a", 2_000, 903, 100.0)]
    # the first part moves the watermark to 20 s before its end: the last one's row is behind it
    got = S.collected(spark, frames(spark, early, late + nulls[1:], [END], too_late), lambda s: S.guarded_ohlc(s, 10, "40 seconds"), "bars").where("ticker <> '~'")
    want = B.ohlc(spark.createDataFrame(rows, COLUMNS), 10_000).select("ticker", "bar_ts", "open", "high", "low", "close", "tick_count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert max(r["high"] for r in got.collect()) < 150


def test_heartbeats_go_on_from_the_checkpoint(spark):
    parts = [[tick("a", 1_000, 1, 5.0), tick("b", 1_500, 2, 6.0)], [tick("a", 9_500, 3, 7.0), tick("a", 9_500, 4, 8.0), tick(None, 9_600, 5, 9.0)], [END]]
    got = S.collected(spark, frames(spark, *parts), lambda s: S.heartbeats(s, 2_000, 5_000, "1 second"), "beats").where("ticker <> '~'").select("ticker", "ts", "seq", "flags")
    want = R.heartbeats(spark.createDataFrame(parts[0] + parts[1], COLUMNS), 2_000, 5_000).select("ticker", "ts", "seq", "flags")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert [tuple(r) for r in want.where("ticker = 'a'").orderBy("ts", "seq").collect()] == [("a", 1_000, 1, 0), ("a", 3_000, 1, 1), ("a", 5_000, 1, 1), ("a", 9_500, 3, 0), ("a", 9_500, 4, 0), ("a", 11_500, 4, 1), ("a", 13_500, 4, 1)]


@pytest.mark.parametrize("refresh", [0, 3_000])
def test_composites_are_computed_where_legs_change_or_are_due(spark, refresh):
    rows = [tick("a", 500, 1, 100.0), tick("a", 2_500, 2, 101.0, 2), tick("b", 600, 3, 50.0)]
    got = S.collected(spark, frames(spark, rows, [END]), lambda s: S.composites(s, 1_000, lambda p: (float(p), True), 60.0, horizon_ms=8_000, refresh_ms=refresh, late="1 second"), "live").where("ticker = 'a'").orderBy("t").collect()
    assert [r["t"] for r in got] == list(range(1_000, 11_000, 1_000)) and [r["accepted"] for r in got] == [1, 1, *[2] * 6, 1, 1]
    due = {1_000, 3_000, 6_000, 9_000}  # one leg leaves at 9 s
    assert {r["t"] for r in got if r["computed"]} == (due if refresh else {r["t"] for r in got})
    assert 100 < (got[2]["bid"] + got[2]["ask"]) / 2 < 101


def test_a_cross_needs_both_legs_within_their_time(spark):
    base, quote = [tick("x", 1_000, 1, 10.0), tick("x", 9_000, 3, 12.0)], [tick("y", 2_000, 2, 2.0), tick("y", 9_000, 4, 4.0), tick("y", 9_500, 5, None)]

    def make(s):
        none = F.lit(None).cast("double")
        closing = F.col("ticker") == "~"
        b = s.where((F.col("ticker") == "x") | closing).withColumns({c: F.when(closing, none).otherwise(F.col(c)) for c in ("bid", "ask")})
        return S.asof_cross(b, s.where("ticker = 'y'"), "x/y", 3_000, "5 seconds")

    got = S.collected(spark, frames(spark, quote[:1], base + quote[1:], [END]), make, "cross").orderBy("seq").collect()
    assert [(r["ts"], r["seq"], round(r["bid"], 6), round(r["ask"], 6)) for r in got] == [(2_000, 2, round(9.9 / 2.1, 6), round(10.1 / 1.9, 6)), (9_000, 4, round(11.9 / 4.1, 6), round(12.1 / 3.9, 6))]


def test_a_large_part_arrives_in_bounded_batches_in_order(spark, tmp_path):
    """Folds that don't wait and those that do give over many batches what they give over one; no batch has many more rows than allowed."""
    from tickloom.streaming import live as L

    rng = random.Random(5)
    rows = [tick(t, 1_000 + i // 3 * 900, 2 * i + j, 100 * 1.3 ** rng.gauss(0, 1)) for i in range(300) for j, t in enumerate("ab")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5).cache()
    one, many = (S.collected(spark, [df], L.stream_sane_mids, "sane", "tc_ms", n) for n in (10_000, 100))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and 10 < one.count() < 600
    gates = [S.collected(spark, [df], L.stream_delta_gate, "gate", "seq", n) for n in (10_000, 100)]
    assert sorted(map(tuple, gates[0].collect())) == sorted(map(tuple, gates[1].collect()))
    beats = [S.collected(spark, [df, spark.createDataFrame([END], COLUMNS)], lambda s: S.heartbeats(s, 200, 600, "20 seconds"), "beats", "tc_ms", n).where("ticker <> '~'") for n in (10_000, 100)]
    assert sorted(map(tuple, beats[0].collect())) == sorted(map(tuple, beats[1].collect()))
    quotes = [S.collected(spark, [df, spark.createDataFrame([END], COLUMNS)], lambda s: S.composites(s, 1_000, lambda p: (1.0, True), 60.0, late="20 seconds"), "live", "tc_ms", n) for n in (10_000, 100)]
    assert sorted(map(tuple, quotes[0].collect())) == sorted(map(tuple, quotes[1].collect()))
    parts = S._slices(df, "tc_ms", 100, str(tmp_path / "slices"))
    sizes, ends = [p.count() for p in parts], [p.agg(F.min("tc_ms"), F.max("tc_ms")).first() for p in parts]
    assert sum(sizes) == 600 and len(parts) > 4 and max(sizes) < 150
    assert all(a[1] < b[0] for a, b in zip(ends[:-1], ends[1:], strict=True))


@pytest.mark.parametrize("ids", [(550, 1_600), (1_600, 550)])
def test_frames_of_one_instant_go_by_seq_however_their_rows_lie(spark, tmp_path, ids):
    """Both second copies come at 6,001; by seq the window takes 550 before it moves on to 1,600."""
    from tickloom.plans import catalogue

    rows = spark.createDataFrame([(n, 1, "view", 1.0) for n in ids], "event_id bigint, user_id bigint, event_type string, value double")
    rows.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.stream_replay_window(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("view", 6_001, 550), ("view", 6_001, 1_600)]
