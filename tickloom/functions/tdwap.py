"""The cross-provider composite of one ticker at one instant: time-decayed, spread-weighted, with bounded shares."""

from __future__ import annotations

import math
from dataclasses import dataclass

from .exprs import KERNELS, kernel_sigma

TINY = 1e-12
#: A carried leg keeps its full weight for this part of its ceiling.
CARRY_FLAT = 0.85


@dataclass(frozen=True)
class Carry:
    """How a leg may be held after its last real frame: a ceiling in seconds, the distance from its peers (part of mid) up to which it
    keeps its weight and at which it has none, how many peers may judge it, and the seconds it has where too few do."""

    secs: float = 0.0
    tol: float = 0.0
    zero: float = 0.0
    min_peers: int = 0
    lone: float = 0.0

    def divergence(self, part: float) -> float:
        return min(1.0, max(0.0, (self.zero - part) / max(self.zero - self.tol, 1e-300)))

    def time(self, age: float, peers: bool) -> float:
        left = (1 - age / max(self.secs, 1e-300)) / (1 - CARRY_FLAT) if peers else 2 * (1 - age / max(self.lone, 1e-300))
        return min(1.0, max(0.0, left))


@dataclass
class Leg:
    provider: int
    bid: float
    ask: float
    last_update: float
    vbid: float = 0.0
    vask: float = 0.0
    weight: float = 1.0
    mapped: bool = True
    injected: bool = False
    ema_ipi: float = 5.0
    joined: float | None = None
    last_gap: float = 0.0
    live_at: float | None = None
    carry: Carry = Carry()
    resid: float = 0.0

    @property
    def carried(self) -> bool:
        return self.carry.secs > 0 and self.live_at is not None and self.live_at > self.last_update

    @property
    def mid(self) -> float:
        return (self.bid + self.ask) / 2


def w_max(n: float) -> float:
    return min(0.99, 0.253 + math.exp(-0.228 * max(n, 1.0)))


def valid_curve() -> bool:
    return all(w_max(n) >= 1 / n for n in range(2, 65))


def freshness(age: float, window: float) -> float:
    return min(1.0, max(0.0, 2 - 2 * age / window)) if window > 0 else 0.0


def water_fill(raw: list[float], eligible: list[float], cap: float | list[float]) -> list[float] | None:
    """min(cap, raw + level * eligible) with the level at which they sum to 1, or none where no level does.

    The sum rises with the level in straight pieces that bend where a leg meets its cap, so the bends are walked in order.
    """
    caps = cap if isinstance(cap, list) else [cap] * len(raw)
    start = sum(min(c, r) for r, c in zip(raw, caps, strict=True))
    if start >= 1 - TINY:
        return [min(c, r) for r, c in zip(raw, caps, strict=True)]
    bends = sorted((max(0.0, (c - r) / e), e) for r, e, c in zip(raw, eligible, caps, strict=True) if e > 0 and r < c)
    slope, level, total = sum(e for _, e in bends), 0.0, start
    for at, e in bends:
        gain = slope * (at - level)
        if total + gain >= 1 - TINY:
            level += (1 - total) / slope
            return [min(c, r + level * x) for r, x, c in zip(raw, eligible, caps, strict=True)]
        total, level, slope = total + gain, at, slope - e
    return None


def weighted_median(values: list[float], weights: list[float]) -> float:
    """Mean of the quantile function over the middle fifth of the mass; without mass the middle value."""
    pairs = sorted(zip(values, weights, strict=True))
    total = sum(weights)
    if not total > 0 or math.isnan(total):
        return sorted(values)[len(values) // 2]
    lo, hi, at, acc = 0.4 * total, 0.6 * total, 0.0, 0.0
    for v, w in pairs:
        acc += v * max(0.0, min(hi, at + w) - max(lo, at))
        at += w
    return acc / (hi - lo)


def interpolated_median(values: list[float], weights: list[float]) -> float:
    """Between the centres of mass of neighbouring values."""
    pairs = sorted(zip(values, weights, strict=True))
    total = sum(weights)
    if not total > 0 or math.isnan(total):
        return pairs[len(pairs) // 2][0]
    half, at, last = total / 2, 0.0, None
    for v, w in pairs:
        centre = at + w / 2
        if centre >= half:
            if last is None or centre == last[0]:
                return v
            return last[1] + (v - last[1]) * (half - last[0]) / (centre - last[0])
        last, at = (centre, v), at + w
    return pairs[-1][0]


def n_eff(weights: list[float]) -> float:
    s2 = sum(w * w for w in weights)
    return sum(weights) ** 2 / s2 if s2 > 0 else 0.0


def _valid(leg: Leg) -> bool:
    return math.isfinite(leg.bid) and math.isfinite(leg.ask) and leg.bid > 0 and leg.ask >= leg.bid and (leg.ask - leg.bid) / ((leg.ask + leg.bid) / 2) * 1e4 <= 2000


def judged(q: Leg, legs: list[Leg], now: float, stale: float) -> tuple[float, bool]:
    """(what is left of a carried leg for its distance from its peers, whether enough live ones hold a newer price)."""
    newer = [x for x in legs if not x.injected and x.last_update > q.last_update]
    live = [x for x in newer if not x.carried and now - x.last_update <= stale]
    need = max(q.carry.min_peers, 1)
    held = len(live) >= need
    peers = live if held else newer
    if len(peers) < need:
        return 1.0, held
    at = weighted_median([x.mid for x in peers], [max(x.weight, 1e-300) for x in peers])
    return q.carry.divergence(abs(q.mid - at) / max(at, 1e-300)), held


def composite(legs: list[Leg], now: float, stale: float = 10.0, kernel: str = "ALT", sigma: float | None = None, share_cap: float = 1.0, anomaly: float = 5.0, bloc: float = 0.40, k_disp: float = 1.0) -> dict | None:
    """The blended quote with its confidence and the legs' shares, or none if no leg is admitted. In plain Python, for one instant."""
    bp, floor_bp, horizon = KERNELS[kernel]
    base = kernel_sigma(bp)
    vol = min(max(sigma, base), 10 * base) if sigma is not None else base
    refused = sum(not _valid(x) for x in legs)
    legs = [x for x in legs if _valid(x) and now - x.last_update <= horizon]
    mass = sum(x.weight for x in legs)
    if not mass > 0:
        return None
    spread = [max((x.ask - x.bid) / (x.ask + x.bid), floor_bp * 1e-4) for x in legs]
    s_ref = sum(x.weight * s for x, s in zip(legs, spread, strict=True)) / mass
    kept, w, g, f, ages = [], [], [], [], []
    for x, s in zip(legs, spread, strict=True):
        age = now - x.last_update
        evict = min(max(x.carry.secs, stale / 2) if x.carried else max((4 * s_ref) ** 2 / vol**2, stale / 2), horizon)
        eff = max(age, min(x.ema_ipi, evict / 2))
        if eff > evict:
            continue
        near, held = judged(x, legs, now, stale) if x.carried else (1.0, False)
        taper = x.carry.time(eff, held) * near if x.carried else 1 - eff / evict
        joined = x.last_update if x.last_gap > evict else x.joined
        ramp = 1.0 if joined is None else min(1.0, max(1e-3, (now - joined) / max(3 * x.ema_ipi, 1e-300)))
        presence = freshness(now - x.live_at, min(stale, evict)) * x.carry.time(age, held) * near if x.carried else freshness(age, min(stale, evict))
        kept.append(x)
        ages.append(age)
        w.append(x.weight * ramp * s_ref**2 * taper / (s * s + (0.0 if x.carried and held else vol * vol * eff) + x.resid))
        g.append(presence * ramp)
        f.append(presence)
    best = max((p for p, x in zip(g, kept, strict=True) if not x.injected), default=0.0)
    f = [p + 1 - best for p in f]
    w = [a * b for a, b in zip(w, f, strict=True)]
    total = sum(w)
    if total < TINY:
        return None
    mapped = sum(a for a, x in zip(w, kept, strict=True) if x.mapped)
    some = mapped > 0
    evidence = [not x.injected and (x.mapped or not some) for x in kept]
    n = n_eff([min(x.weight, anomaly) * p for x, p, e in zip(kept, g, evidence, strict=True) if e])
    share = [a / total for a in w]
    if some:  # legs without a market mapping are a bloc that evidence may outweigh
        other = (total - mapped) / total
        seen = sum(a * p for a, p, x in zip(w, g, kept, strict=True) if x.mapped) / mapped
        bound = seen * min(other, bloc / (1 + bloc)) + (1 - seen) * other
        share = [a * ((1 - bound) / max(1 - other, 1e-300) if x.mapped else bound / other if other > 0 else 1.0) for a, x in zip(share, kept, strict=True)]
    lift = [a * p if x.mapped or not some else 0.0 for a, p, x in zip(share, g, kept, strict=True)]
    caps = [w_max(n)] * len(kept)
    top = sorted((p for p, e in zip(g, evidence, strict=True) if e), reverse=True) + [0.0, 0.0]
    pegged = [min(c, 1 - (1 - share_cap) * min(top[1] if not e or p >= top[0] else top[0], 1.0)) for c, p, e in zip(caps, g, evidence, strict=True)]
    final = water_fill(share, lift, pegged)
    if final is None and share_cap < 1:
        pegged, final = caps, water_fill(share, lift, caps)
    final = final or water_fill(share, share, pegged) or share
    use = [i for i, s in enumerate(final) if s > TINY]
    total = sum(final[i] for i in use)
    if total < TINY:
        return None
    mean = lambda v: sum(final[i] * v(i) for i in use) / total
    bid, ask, centre = mean(lambda i: kept[i].bid), mean(lambda i: kept[i].ask), mean(lambda i: kept[i].mid)
    apart = mean(lambda i: (kept[i].mid - centre) ** 2)
    aged = mean(lambda i: ((kept[i].ask - kept[i].bid) / 2 * min(math.sqrt(ages[i] / max(kept[i].ema_ipi, 1e-6)), 3.0)) ** 2)
    active = [i for i in range(len(kept)) if g[i] > 0 and f[i] >= 0.5 and not kept[i].injected]
    vbid, vask = sum(kept[i].vbid for i in use), sum(kept[i].vask for i in use)
    mid = (bid + ask) / 2
    ci = max(math.sqrt(apart + aged), abs(ask - bid) / 2) / mid * 1e8
    shift = weighted_median([kept[i].mid for i in use], [final[i] for i in use]) - mid if kernel == "PEGGED" else 0.0
    if bid > ask:
        bid = ask = mid
    elif bid == ask:
        half = k_disp * math.sqrt(apart) if len(use) >= 2 else 0.0
        bid, ask = mid - half, mid + half
    return {
        "bid": bid + shift, "ask": ask + shift, "vbid": vbid, "vask": vask, "accepted": len(use), "rejected": refused,
        "ci": max(0, min(65535, math.floor(math.sqrt(ci) * 16 + 0.5))),
        "confidence": min(len(active), 64) | (128 if sum(final[i] for i in active) / total >= 0.20 else 0), "flags": 64 | (32 if vbid + vask == 0 else 0),
        "n_eff": n_eff([final[i] for i in use]), "top_share": max(final[i] for i in use) / total, "dispersion": math.sqrt(apart) / mid,
        "shares": [(kept[i].provider, final[i] / total) for i in use],
    }
