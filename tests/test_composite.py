"""Composites as windows against the plain computation of one instant, over legs of every kind."""

import random

import pytest

from tickloom.functions import tdwap
from tickloom.operators import composite as C
from tickloom.operators import sequential as Q

LEG = "ticker string, t bigint, provider bigint, bid double, ask double, vbid double, vask double, last_update bigint, live_at bigint, joined bigint, ema_ipi double, last_gap double, injected boolean, mapped boolean, weight double, resid double, secs double, tol double, zero double, min_peers int, lone double"
NOW = 1_700_000_100_000


def random_leg(rng, group, provider):
    mid, half = 100 + rng.gauss(0, 0.05), rng.choice([0.0, 0.001, 0.01, 0.05])
    at = NOW - rng.randrange(0, 70_000)
    carried = rng.random() < 0.3
    bad = rng.random() < 0.05
    return (f"g{group}", NOW, provider, -1.0 if bad else mid - half, mid + half, float(rng.choice([0, 5])), float(rng.choice([0, 7])), at, at + (rng.randrange(1, 3000) if carried else 0), rng.choice([None, at - rng.randrange(0, 30_000)]), rng.choice([0.2, 5.0, 20.0]),
            rng.choice([0.0, 0.5, 100.0]), rng.random() < 0.15, rng.random() < 0.7, rng.choice([0.5, 1.0, 3.0, 9.0]), rng.choice([0.0, 1e-9]), rng.choice([40.0, 120.0]) if carried else 0.0, 0.0002, 0.002, rng.choice([1, 2, 3]), 20.0)


def as_leg(r):
    carry = tdwap.Carry(r[16], r[17], r[18], r[19], r[20])
    return tdwap.Leg(r[2], r[3], r[4], r[7] / 1000, r[5], r[6], r[14], r[13], r[12], r[10], None if r[9] is None else r[9] / 1000, r[11], r[8] / 1000, carry, r[15])


@pytest.mark.parametrize(("kernel", "share_cap", "sigma"), [("ALT", 1.0, None), ("PEGGED", 0.6, None), ("FX_METAL", 0.8, 0.001)])
def test_composites_are_those_of_the_plain_computation(spark, kernel, share_cap, sigma):
    rng = random.Random(3)
    rows = [random_leg(rng, g, p) for g in range(60) for p in range(rng.randint(1, 9))]
    got = {r["ticker"]: r for r in C.composites(spark.createDataFrame(rows, LEG), 10.0, kernel, share_cap=share_cap, sigma=sigma).collect()}
    some = 0
    for g in range(60):
        want = tdwap.composite([as_leg(r) for r in rows if r[0] == f"g{g}"], NOW / 1000, 10.0, kernel, sigma, share_cap)
        assert (want is None) == (f"g{g}" not in got)
        if want is None:
            continue
        some += 1
        r = got[f"g{g}"]
        for c in ("bid", "ask", "vbid", "vask", "n_eff", "top_share", "dispersion"):
            assert r[c] == pytest.approx(want[c], rel=1e-6, abs=1e-9), (g, c)
        assert (r["accepted"], r["rejected"], r["confidence"], r["flags"]) == (want["accepted"], want["rejected"], want["confidence"], want["flags"])
        assert abs(r["ci"] - want["ci"]) <= 1
        assert {x["provider"]: round(x["share"], 6) for x in r["shares"]} == {p: round(s, 6) for p, s in want["shares"]}
    assert some > 25


def test_kernels_and_sigmas_of_legs_stand_for_those_of_all(spark):
    rng = random.Random(9)
    rows = [random_leg(rng, g, p) for g in range(40) for p in range(rng.randint(1, 6))]
    names = ["ALT", "PEGGED", "FX_METAL", "MAJOR", None]
    own = [(f"g{g}", names[g % 5], [None, 0.0005, float("nan"), 1.0][g % 4]) for g in range(40)]
    legs = spark.createDataFrame(rows, LEG).join(spark.createDataFrame(own, "ticker string, kernel string, sigma double"), "ticker")
    got = {r["ticker"]: r for r in C.composites(legs, 10.0, "ALT").collect()}
    for ticker, kernel, sigma in own:
        want = tdwap.composite([as_leg(r) for r in rows if r[0] == ticker], NOW / 1000, 10.0, kernel or "ALT", None if sigma is None or sigma != sigma else sigma)
        assert (want is None) == (ticker not in got)
        if want:
            assert (got[ticker]["bid"], got[ticker]["n_eff"]) == (pytest.approx(want["bid"], rel=1e-6), pytest.approx(want["n_eff"], rel=1e-6)), (ticker, kernel)


def test_legs_stand_until_the_next_quote_or_the_horizon(spark):
    rows = [("a", 1, 500, 1), ("a", 2, 1_500, 2), ("a", 1, 2_500, 3), ("a", 3, None, 4), ("b", 1, 1_000, 5)]
    q = spark.createDataFrame(rows, "ticker string, provider bigint, ts bigint, seq bigint")
    got = sorted((r["ticker"], r["t"], r["provider"], r["seq"]) for r in C.legs_at(q, 1_000, 3_000).collect())
    assert got == [("a", 1_000, 1, 1), ("a", 2_000, 1, 1), ("a", 2_000, 2, 2), ("a", 3_000, 1, 3), ("a", 3_000, 2, 2), ("a", 4_000, 1, 3), ("a", 4_000, 2, 2), ("a", 5_000, 1, 3), ("b", 2_000, 1, 5), ("b", 3_000, 1, 5), ("b", 4_000, 1, 5)]
    assert C.legs_at(q.limit(0), 1_000).count() == 0


def test_a_carried_leg_loses_its_weight_when_its_peers_refute_it(spark):
    """Two live peers agree on 100; a carried leg at 100.5 is out, one at 100 stays."""
    base = dict(vbid=1.0, vask=1.0, joined=None, ema_ipi=1.0, last_gap=0.0, injected=False, mapped=True, weight=1.0, resid=0.0)
    carry = dict(secs=60.0, tol=0.001, zero=0.004, min_peers=2, lone=5.0)
    none = dict(secs=0.0, tol=0.0, zero=0.0, min_peers=0, lone=0.0)
    for at, share in ((100.0, True), (100.5, False)):
        legs = [dict(ticker="x", t=NOW, provider=p, bid=99.99, ask=100.01, last_update=NOW - 500, live_at=NOW - 500, **base, **none) for p in (1, 2)]
        legs.append(dict(ticker="x", t=NOW, provider=3, bid=at - 0.01, ask=at + 0.01, last_update=NOW - 8_000, live_at=NOW - 100, **base, **carry))
        rows = spark.createDataFrame([tuple(x[f.split()[0]] for f in LEG.split(", ")) for x in legs], LEG)
        shares = {x["provider"] for x in C.composites(rows, 10.0, "MAJOR").first()["shares"]}
        assert (3 in shares) == share


def test_leg_states_know_carries_and_injections(spark):
    rows = [("a", 1, 0, 1, 10.0, "tick"), ("a", 1, 1_000, 2, 10.5, "carry"), ("a", 1, 3_000, 3, 11.0, "tick"), ("a", 1, 4_000, 4, 12.0, "inject"), ("a", 1, 5_000, 5, 13.0, None)]
    q = spark.createDataFrame([(t, p, ts, s, b, b + 1, 1.0, 1.0, k) for t, p, ts, s, b, k in rows], "ticker string, provider bigint, tc_ms bigint, seq bigint, bid double, ask double, vbid double, vask double, kind string")
    got = sorted(Q.leg_states(q).collect(), key=lambda r: r["seq"])
    assert [(r["bid"], r["last_update"], r["live_at"], r["last_gap"], r["injected"]) for r in got] == [(10.0, 0, 0, 0.0, False), (10.0, 0, 1_000, 0.0, False), (11.0, 3_000, 3_000, 2.0, False), (12.0, 4_000, 4_000, 2.0, True), (13.0, 5_000, 5_000, 1.0, False)]
    e = 5.0
    for gap in (1.0, 2.0, 1.0, 1.0):
        e = 0.1 * gap + 0.9 * e
    assert got[-1]["ema_ipi"] == pytest.approx(e) and got[0]["joined"] == got[-1]["joined"] == 0
