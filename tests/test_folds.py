"""Golden numbers and properties of the pure-Python parts."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.functions import folds, tdwap
from tickloom.operators.resolve import jaro_winkler
from tickloom.sources import codec


def test_w_max():
    assert [round(tdwap.w_max(n), 3) for n in (1, 2, 8, 16)] == [0.99, 0.887, 0.414, 0.279]
    assert tdwap.valid_curve()


def test_water_fill():
    assert tdwap.water_fill([0.8, 0.1, 0.1], [0.8, 0.1, 0.1], 0.6) == pytest.approx([0.6, 0.2, 0.2])
    assert tdwap.water_fill([0.9, 0.1], [0.9, 0.0], 0.5) is None


@given(st.lists(st.floats(0.01, 10), min_size=2, max_size=12), st.floats(0.2, 0.95))
@settings(max_examples=60, deadline=None)
def test_water_fill_sums_to_one_under_the_cap(raw, cap):
    share = [x / sum(raw) for x in raw]
    out = tdwap.water_fill(share, share, cap)
    if cap * len(raw) > 1.0001:
        assert sum(out) == pytest.approx(1) and max(out) <= cap + 1e-12
    else:
        assert out is None or sum(out) == pytest.approx(1, abs=1e-3)


def test_medians():
    assert tdwap.weighted_median([1, 2, 3], [0, 0, 0]) == 2
    assert tdwap.weighted_median([1, 2, 3], [1, 1, 1]) == pytest.approx(2)
    assert tdwap.interpolated_median([1, 3], [1, 1]) == pytest.approx(2)


def test_composite_stays_inside_the_legs():
    legs = [tdwap.Leg(p, b, b + 0.02, 99.0 - p * 0.1, 5, 5, 1 + p) for p, b in enumerate((99.9, 100.1, 100.0))]
    c = tdwap.composite(legs, 100.0)
    assert 99.9 <= c["bid"] <= c["ask"] <= 100.13 and c["accepted"] == 3 and sum(s for _, s in c["shares"]) == pytest.approx(1)
    assert c["flags"] == 64 and c["confidence"] & 127 == 3 and c["confidence"] & 128
    assert tdwap.composite([tdwap.Leg(0, 0.0, 1.0, 99.0)], 100.0) is None
    assert tdwap.composite(legs, 1e6) is None
    empty = tdwap.composite([tdwap.Leg(0, 100.0, 100.0, 99.9), tdwap.Leg(1, 101.0, 101.0, 99.9)], 100.0)
    assert empty["flags"] == 96 and empty["bid"] < empty["ask"]


def test_snap():
    for x, want in ((174.38, 174.4), (347.83, 347.8), (84234, 84240), (7.531, 7.53)):
        assert folds.snap_25(x) == pytest.approx(want)
    assert folds.snap_25(-1.0) == -1.0


def test_renko_bodies_are_continuous_within_a_period():
    f, out = folds.Renko(k=1.0), []
    for i in range(4000):
        out += f.feed(i * 100, 100 * (1 + 0.05 * math.sin(i / 300)), 0.002)
    assert len(out) > 50 and all(a["close"] == pytest.approx(b["open"]) for a, b in zip(out, out[1:], strict=False))
    assert all(b["low"] <= min(b["open"], b["close"]) and b["high"] >= max(b["open"], b["close"]) for b in out)


def test_renko_flags_the_further_bricks_of_a_tick():
    f = folds.Renko(k=1.0)
    assert f.feed(0, 100.0, 0.001) == []
    out = f.feed(1, 101.0, 0.001)
    assert len(out) > 3 and out[0]["flags"] == 0 and out[0]["tick_count"] == 2
    assert all(b["flags"] == 4 and b["tick_count"] == 0 and b["high"] == max(b["open"], b["close"]) for b in out[1:])
    assert folds.Renko(k=0.01).feed(0, 100.0, 0.1) == []


def test_sane_mid_keeps_its_anchor():
    f = folds.SaneMid()
    assert [f.accept(x) for x in (100.0, 250.0, 199.0, 90.0, math.nan, -1.0, 100.0)] == [True, False, True, False, False, False, True]


def test_running_stats():
    f = folds.RunningStats()
    z = [f.score(100.0, 0.02) for _ in range(30)]
    assert max(z) == 0 and f.score(100.2, 0.02) == pytest.approx(10)


def test_delta_gate():
    f = folds.DeltaGate(60_000)
    q = (1.0, 2.0, 3, 4, 5)
    assert [f.next(t, q) for t in (0, 1000, 60_000, 61_000)] == [0, None, 1, None]
    assert f.next(61_500, (1.0, 2.1, 3, 4, 5)) == 0 and f.next(100, q) is None
    assert f.next(86_400_000, (1.0, 2.1, 3, 4, 5)) == 0


def test_vol_ema_seeds_with_a_mean():
    f = folds.VolEma(2)
    assert [f.next(x) for x in (1.0, 3.0, 5.0)] == pytest.approx([1, 2, 4])


def test_guards_and_gates():
    j = folds.JumpGuard(0.05, 3)
    assert [j.accept(x) for x in (100.0, 110.0, 110.0, 110.0, 111.0)] == [True, False, False, True, True]
    b = folds.BasisGate(2)
    assert [b.next(x) for x in (True, False, True, True, False, False)] == [True, True, True, False, False, True]
    d = folds.Deadband(100.0)
    assert [d.next(x) for x in (100.0, 100.5, 101.0)] == [100.0, 100.0, 101.0]
    p = folds.PegConfirm()
    assert [p.next(t, x) for t, x in ((0, 1.0), (100, 1.001), (1000, 1.001), (1700, 1.001))] == [1.0, 1.0, 1.0, 1.001]
    w = folds.ReplayWindow(4)
    assert [w.accept(0, s) for s in (1, 1, 9, 5, 6, 9)] == [True, False, True, False, True, False]


@pytest.mark.parametrize("kind", ["idx", "bar", "tick", "vol"])
def test_records_round_trip(kind):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({n: rng.random(7) if t[0] == "f" else rng.integers(0, min(1 << (8 * int(t[1:])), 1 << 48), 7) for n, t, _ in codec.LAYOUTS[kind][1]})
    rows = rows.astype({n: "float32" for n, t, _ in codec.LAYOUTS[kind][1] if t == "f4"})
    data = codec.encode(kind, rows)
    assert len(data) == 7 * codec.LAYOUTS[kind][0]
    pd.testing.assert_frame_equal(codec.decode(kind, data), rows, check_dtype=False)
    with pytest.raises(ValueError, match="whole"):
        codec.decode(kind, data + b"x")
    assert len(codec.decode(kind, data + b"torn", strict=False)) == 7


def test_frames():
    rows = pd.DataFrame({c: [1.0, 2.0] for c in codec.FRAMES[1]})
    got = codec.decode_ws(codec.encode_ws(rows))
    assert len(got) == 2 and list(got.columns) == list(codec.FRAMES[1])
    with pytest.raises(ValueError, match="frame"):
        codec.decode_ws(b"\1\0\2\0\0\0\0\0")
    assert codec.decode_ws(b"", strict=False).empty
    kind, a = codec.decode_rest(codec.encode_rest(3, np.arange(14.0).reshape(2, 7)))
    assert kind == 3 and a.shape == (2, 7)
    assert codec.decode_ids(np.array([1, 1 << 63], "<u8").tobytes()).tolist() == [1, 1 << 63]
    assert codec.b64_price(12345 << 12 | 2 << 7 | 64) == pytest.approx(123.45)
    blob = b"\1" + (1700000000000).to_bytes(6, "big") + b"\0" + (7).to_bytes(8, "big") + (5 << 12 | 64).to_bytes(8, "big") + (9).to_bytes(4, "big") + (3).to_bytes(2, "big")
    assert codec.decode_signed(blob).iloc[0].tolist() == [1700000000000, 7, 5.0, 9, 3]
    assert codec.text_of(b"junk") is None


def test_jaro_winkler():
    assert jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.813333, abs=1e-6)
    assert jaro_winkler("", "A") == 0 and jaro_winkler("A", "A") == 1


def test_bricks_by_day_are_those_of_the_fold():
    rng = np.random.default_rng(5)
    for n, sd in ((400, 0.1), (3000, 0.02), (50, 30.0)):
        ts = np.cumsum(rng.integers(0, 900_000, n))
        price, sigma = np.abs(100 + np.cumsum(rng.normal(0, sd, n))) + 1, rng.uniform(0.001, 0.02, n)
        for k in (0.01, 0.05, 0.3, 1.0, 4.0):
            fold, days = folds.Renko(k), {}
            for t, p, s in zip(ts.tolist(), price.tolist(), sigma.tolist(), strict=True):
                made = len(fold.feed(t, p, s))
                if made:
                    days[t // 86_400_000] = days.get(t // 86_400_000, 0) + made
            assert sorted(folds.bricks_by_day(ts, price, sigma, k)) == sorted(days.values())


def test_search_of_k_beats_a_fine_grid():
    rng = np.random.default_rng(6)
    ts = np.arange(20_000) * 60_000
    price, sigma = 100 + np.cumsum(rng.normal(0, 0.05, 20_000)), np.full(20_000, 0.004)
    count = lambda k: folds.bricks_by_day(ts, price, sigma, k)
    for target in (3.0, 60.0, 500.0):
        k, median = folds.search_k(count, target, (0.05, 0.2, 1.0, 5.0), 0.05, 12)
        assert median == np.median(count(k))
        fine = min(abs(np.log(np.median(d) / target)) for x in np.geomspace(0.05, 8, 120) if (d := count(x)))
        assert abs(median / target - 1) <= 0.05 or abs(np.log(median / target)) <= fine + 0.05
    assert folds.search_k(lambda k: [], 5.0, (1.0,), 0.05, 3) is None


def test_a_tick_beyond_its_bricks_says_so():
    fold = folds.Renko(1.0, most=3)
    fold.feed(0, 100.0, 0.01)
    out = fold.feed(1, 106.0, 0.01)
    assert [b["flags"] for b in out] == [0, 4, 4 | folds.CAPPED] and len(fold.feed(2, 106.0, 0.01)) == 3
    assert [b["flags"] for b in fold.feed(3, 107.0, 0.01)] == [0]
