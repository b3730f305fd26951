"""Every operator over ticks on an empty table, and on nulls, ties, repeated rows and other columns; streams that reload and re-emit."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tickloom import api
from tickloom.operators import bars as B
from tickloom.operators import composite as C
from tickloom.operators import ranges as R
from tickloom.operators import sequential as Q
from tickloom.operators import stats as S
from tickloom.operators import synth as Y
from tickloom.operators import vol as V
from tickloom.streaming import live as L

KINDS = "seq bigint, ticker string, provider bigint, tc_ms bigint, ts_ms bigint, bid double, ask double, mid double, vbid bigint, vask bigint, ci int, accepted bigint, rejected bigint, value double"
MIN = 60_000


def rows():
    out = [(i, "T", i % 2, i * 5_000, i * 5_000, 99.0 + i, 101.0 + i, 100.0 + i, 1, 2, 16, 1, 0, 5.0) for i in range(30)]
    out += [out[3], (98, "T", 0, 15_000, 15_000, 99.0, 101.0, 100.0, 1, 1, 16, 1, 0, 5.0)]  # a repeated row, and a tie in time
    return [*out, (99, "T", 0, 40_000, 40_000, *[None] * 9), (100, "U", 1, 1_000, 1_000, float("nan"), 1.0, float("nan"), 0, 0, 0, 0, 0, float("nan"))]


def full(t):
    return B.full_bars(t, MIN)


OPERATORS = {
    "ohlc": lambda t: B.ohlc(t, MIN),
    "ohlc_late_dropped": lambda t: B.ohlc_late_dropped(t, MIN),
    "rollup": lambda t: B.rollup(B.ohlc(t, 10_000), 10_000, MIN),
    "full_bars": full,
    "grid_stamped": lambda t: B.grid_stamped(full(t), MIN),
    "bar_to_ohlc": lambda t: B.bar_to_ohlc(full(t)),
    "flat_fill": lambda t: B.flat_fill(B.ohlc(t, 10_000), 10_000),
    "level1": lambda t: B.level1(t, 5_000),
    "last_in_window": lambda t: B.last_in_window(t, 5_000),
    "sane_mids": Q.sane_mids,
    "zscores": Q.zscores,
    "z_gated": Q.z_gated,
    "jump_guarded": lambda t: Q.jump_guarded(t.where("mid IS NOT NULL")),
    "deadband": lambda t: Q.deadband(t.where("mid IS NOT NULL"), 5.0),
    "peg_confirmed": lambda t: Q.peg_confirmed(t.where("mid IS NOT NULL")),
    "delta_gated": Q.delta_gated,
    "time_bounded": lambda t: Q.time_bounded(t.withColumn("flags", F.lit(0)), 10**12),
    "leg_states": Q.leg_states,
    "renko": lambda t: Q.renko(t, k=0.5),
    "renko_with_microstructure": lambda t: Q.renko_with_microstructure(t, k=0.5),
    "bricks_per_day": lambda t: Q.bricks_per_day(Q.renko(t, k=0.5)),
    "legs_at": lambda t: C.legs_at(t, 10_000, ts="tc_ms"),
    "composites": lambda t: C.composites(C.legs_at(Q.leg_states(t), 10_000)),
    "unchanged_cycles": lambda t: C.unchanged_cycles(C.legs_at(t, 10_000, ts="tc_ms")),
    "inverted_mark": C.inverted_mark,
    "parkinson_sigma": lambda t: V.parkinson_sigma(B.ohlc(t, MIN)),
    "gk_sigma": lambda t: V.gk_sigma(B.ohlc(t, MIN)),
    "yz_sigma": lambda t: V.yz_sigma(B.ohlc(t, MIN)),
    "rolling_sigma": lambda t: V.rolling_sigma(B.ohlc(t, MIN), 5),
    "spike_floor": lambda t: V.spike_floor(V.mtf_blend(V.vol_rows(B.ohlc(t, 10_000)), ((4, 1.0),), 2)),
    "asof_cross": lambda t: Y.asof_cross(t.where("ticker = 'T'"), t.where("ticker = 'U'")),
    "synth_bar": lambda t: Y.synth_bar(Y.aligned_legs(full(t), ["T", "T"])),
    "cross_bar": lambda t: Y.cross_bar(Y.aligned_legs(full(t), ["T", "T", "T"]), (1, 1, -1)),
    "rho_cache": lambda t: Y.rho_cache(Y.aligned_legs(full(t), ["T", "T"]), 5),
    "first_n": lambda t: R.first_n(t, "tc_ms", 5, start=0, end=10**12, cursor=5_000),
    "newest_n": lambda t: R.newest_n(t, "tc_ms", 5),
    "ring": lambda t: R.ring(t, "tc_ms", 5, 10_000),
    "last_per_key": lambda t: R.last_per_key(t, "tc_ms"),
    "last_status": lambda t: R.last_status(t, "tc_ms", 10**6),
    "coverage": lambda t: R.coverage(t, "tc_ms"),
    "markets": R.markets,
    "describe": lambda t: S.describe(t, "ticker", "value"),
    "lag_quantile": lambda t: S.lag_quantile(S.lag_histogram(t.withColumn("ms", F.floor("value")), "ticker", "ms"), "ticker", 0.9),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_null_and_repeated_rows(spark, name):
    """No rows make no rows; nulls, ties and repeats make the same rows whatever the partitions; other columns do no harm."""
    make = OPERATORS[name]
    t = spark.createDataFrame(rows(), KINDS).withColumns({"_b": F.lit("x"), "r": F.lit(1), "open": F.lit(None).cast("double")})
    assert make(t.limit(0)).count() == 0
    one, two = ([tuple(map(str, r)) for r in make(t.repartition(n)).select(F.struct("*").cast("string")).collect()] for n in (1, 3))
    assert one and sorted(one) == sorted(two) or name in ("asof_cross", "spike_floor") and not one


def test_parameters_are_read_anew_when_they_change(spark, tmp_path):
    """Each batch has the parameters of its time; the same bytes again are no reload."""
    (tmp_path / "in").mkdir()
    seen = []
    for v in (1, 2):
        (tmp_path / "params.json").write_text(json.dumps({"k": v}))
        spark.range(3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
        q = L.reloaded(stream, str(tmp_path / "params.json"), lambda df, p: df.withColumn("k", F.lit(p["k"])), lambda df, _: seen.extend(r["k"] for r in df.collect()))
        q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [1] * 3 + [2] * 3


def test_a_quiet_ticker_is_sent_again(spark, tmp_path):
    spark.createDataFrame([("T", 5, 1, 10.0, 11.0)], "ticker string, tc_ms bigint, seq bigint, bid double, ask double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ticker string, tc_ms bigint, seq bigint, bid double, ask double").parquet(str(tmp_path / "in"))
    q = L.stream_last(stream).writeStream.format("memory").queryName("tl_beat").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    for _ in range(40):
        time.sleep(0.5)
        got = spark.table("tl_beat").collect()
        if len(got) > 1:
            break
    q.stop()
    assert {r["flags"] for r in got} == {0, 1} and {(r["ts"], r["bid"]) for r in got} == {(5, 10.0)}


def test_subscriptions_say_what_they_reject(spark):
    t = spark.createDataFrame([("A",), ("B",), (None,)], "ticker string")
    assert L.acknowledged(["B", "X"], t) == {"subscribed": ["B"], "rejected": ["X"]} and L.acknowledged([], t) == {"subscribed": [], "rejected": []}
    assert L.subscribed(t, ["A", "X"]).count() == 1 and L.subscribed(t, []).count() == 0


def test_attested_beats():
    from tickloom.functions.folds import AttestState

    s = AttestState()
    assert [s.judge(*x) for x in ((1, 1, 10), (1, 1, 10), (1, 2, 9), (1, 2, 11), (1, 1, 12), (2, 1, 11), (2, 1, 12))] == ["valid", "duplicate", "regression", "valid", "regression", "regression", "valid"]


def test_functions_for_sql(spark):
    import pandas as pd

    from tickloom.sources import codec

    api.register(spark)
    data = codec.encode("vol", pd.DataFrame({"mts": [1, 2], "sigma": [0.5, 0.25]})).hex()
    assert [tuple(r) for r in spark.sql(f"SELECT * FROM tl_vol_records(X'{data}00')").collect()] == [(1, 0.5), (2, 0.25)]
    assert spark.sql("SELECT tl_jaro_winkler('MARTHA', 'MARHTA') AS x").first()["x"] == pytest.approx(0.961111, abs=1e-6)
