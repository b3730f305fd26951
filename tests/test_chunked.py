"""Folds by slices against the same folds in one go, on series that forget quickly, slowly and never."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.functions import folds
from tickloom.operators import chunked as C
from tickloom.operators import sequential as Q

COLUMNS = "ticker string, tc_ms bigint, seq bigint, mid double, bid double, ask double, vbid bigint, vask bigint, ci int"


def series(seed, n=700, jump=0.03, tickers=("a", "b", None)):
    rng = random.Random(seed)
    out, seq = [], 0
    for t in tickers:
        x, ts = 100.0, 1_000_000
        for _ in range(n if t else n // 3):
            seq += 1
            ts += rng.choice([0, 1, 5, 40, 400]) if rng.random() < 0.98 else 60_000
            x = max(1.0, x + rng.choice([-1.0, -0.25, 0.0, 0.0, 0.25, 1.0]))
            p = x * rng.choice([3.0, 0.2, 1.4]) if rng.random() < jump else x
            out.append((t, ts, seq, None if rng.random() < 0.01 else p, x - 0.5, x + 0.5, 1, 2, 3))
    return out


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return series(request.param)


def plain(rows, make, step, order=("tc_ms", "seq"), needs_mid=True):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    made = [dict(zip(names, r, strict=True)) for r in rows if not needs_mid or r[3] is not None]
    out, states = [], {}
    for r in sorted(made, key=lambda r: tuple(r[c] for c in order)):
        s = states.setdefault(r["ticker"], make())
        out += step(s, r)
    return out


def same(got, want, digits=None):
    cut = lambda r: tuple(round(v, digits) if digits and isinstance(v, float) else v for v in r)
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(cut, map(tuple, got)), key=key) == sorted(map(cut, want), key=key)


@pytest.mark.parametrize("width", [150, 4_000, 10**9])
def test_guards_and_bands_by_slices(spark, rows, width):
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    keep = lambda r: (r["ticker"], r["tc_ms"], r["seq"])
    same(Q.jump_guarded(df, limit=5, slice_ms=width).collect(), plain(rows, lambda: folds.JumpGuard(0.05, 5), lambda s, r: [(*keep(r), r["mid"])] if s.accept(r["mid"]) else []))
    same(Q.sane_mids(df, slice_ms=width).collect(), plain(rows, folds.SaneMid, lambda s, r: [(*keep(r), r["mid"])] if s.accept(r["mid"]) else []))
    if width != 4_000:
        same(Q.deadband(df, 60.0, slice_ms=width).collect(), plain(rows, lambda: folds.Deadband(60.0), lambda s, r: [(*keep(r), s.next(r["mid"]))]))
        same(Q.peg_confirmed(df, slice_ms=width).collect(), plain(rows, folds.PegConfirm, lambda s, r: [(*keep(r), s.next(r["tc_ms"], r["mid"]))]))


def test_delta_gate_by_slices(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)

    def step(s, r):
        flag = s.next(r["tc_ms"], (r["bid"], r["ask"], r["vbid"], r["vask"], r["ci"]))
        return [] if flag is None else [(r["ticker"], r["tc_ms"], r["seq"], r["bid"], r["ask"], flag)]

    want = plain(rows, folds.DeltaGate, step, ("seq",), False)
    assert any(w[-1] for w in want)
    for slice_rows in (7, 400):
        same(Q.delta_gated(df, slice_rows=slice_rows).collect(), want)


@pytest.mark.parametrize("width", [100, 20_000])
def test_scores_compose(spark, rows, width):
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    want = plain(rows, folds.RunningStats, lambda s, r: [(r["ticker"], r["tc_ms"], r["seq"], s.score(r["mid"], r["mid"] * 2e-4))])
    same(Q.zscores(df, floor_bps=2.0, slice_ms=width).collect(), want, 8)


def test_a_fold_that_never_forgets_is_right_in_few_rounds(spark):
    """A series that locks its guard out: every slice guesses wrong, and units of slices double until one is the series."""
    rows = [("a", i * 10, i, 100.0 if i == 0 else 500.0, 1.0, 2.0, 1, 1, 1) for i in range(300)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert [r["seq"] for r in Q.sane_mids(df, slice_ms=100).collect()] == [0]
    kind = StructType.fromDDL("ticker string, seq bigint, n bigint")

    def step(s, r):
        s.next(1.0)
        return [(r.ticker, r.seq, s.n)]

    out = C.speculated(df.select("ticker", "tc_ms", "seq"), "ticker", ["tc_ms", "seq"], kind, folds.VolEma, C.by_row(C.arrow(kind), step), 100, most_rounds=8)
    assert [tuple(r)[1:] for r in out.orderBy("seq").collect()] == [(i, i + 1) for i in range(300)]


def test_slices_are_dealt_out(spark):
    """No task has a hot ticker: its slices go to all partitions."""
    df = spark.createDataFrame(series(3, 400, tickers=("a",)), COLUMNS).select("ticker", "tc_ms", "seq", "mid").where("mid IS NOT NULL")
    kind = StructType.fromDDL("ticker string, seq bigint")
    out = C._from_guesses(df, "ticker", ["tc_ms", "seq"], kind, folds.SaneMid, C.by_row(C.arrow(kind), lambda s, r: [(r.ticker, r.seq)]), 500, 100)
    counts = out.where("_state IS NULL").groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) == 4 and max(r["count"] for r in counts) < 300


def test_no_rows(spark):
    df = spark.createDataFrame([], COLUMNS)
    assert Q.zscores(df).count() == Q.jump_guarded(df).count() == Q.delta_gated(df).count() == Q.sane_mids(df).count() == 0


def test_null_tickers_are_guarded(spark):
    rows = [(t, i, i, p, 1.0, 2.0, 1, 1, 1) for t in (None, "a") for i, p in enumerate([1.0, 1.1, 100.0, 1.2])]
    df = spark.createDataFrame(rows, COLUMNS)
    for parallel in (False, True):
        got = Q.guarded(df, parallel=parallel).select("ticker", "mid").collect()
        same(got, [(t, p) for t in (None, "a") for p in (1.0, 1.1, 1.2)])


def test_means_in_blocks_are_means_one_by_one():
    rng = np.random.default_rng(1)
    x = rng.normal(100, 3, 5000)
    for rate in (0.01, 0.1, 2 / 29, 0.9):
        before, end = folds.ema(x, rate, 50.0)
        m, want = 50.0, []
        for v in x:
            want.append(m)
            m += rate * (v - m)
        assert np.allclose(before, want, rtol=1e-12) and abs(end - m) < 1e-9


def test_legs_that_only_tick_have_the_states_of_the_fold(spark):
    rng = random.Random(11)
    rows = [(rng.choice("ab"), rng.randint(0, 2), rng.randint(0, 10**6), i, rng.random(), None, 1, 2) for i in range(900)]
    df = spark.createDataFrame(rows, "ticker string, provider int, tc_ms bigint, seq bigint, bid double, ask double, vbid bigint, vask bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r["seq"]: r for r in Q.leg_states(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    states = {}
    for t, p, ts, seq, bid, ask, vbid, vask in sorted(rows, key=lambda r: (r[2], r[3])):
        s = states.setdefault((t, p), folds.LegState())
        s.update(ts, bid, ask, vbid, vask)
        r = got[seq]
        assert (r["bid"], r["ask"], r["last_update"], r["live_at"], r["joined"], r["injected"]) == (bid, ask, ts, ts, s.joined, False)
        assert abs(r["ema_ipi"] - s.ema_ipi) < 1e-9 and abs(r["last_gap"] - s.last_gap) < 1e-9
    assert len(got) == 900
