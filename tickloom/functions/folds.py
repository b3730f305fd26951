"""Sequential state machines, each written once as a Python class and shared by the batch and the streaming operators.

They depend on their own past output (the last accepted, written or emitted row), so no window function can express them.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np


@dataclass
class SaneMid:
    """Accepts a mid that is positive, below 1e15 and within a factor of two of the last accepted one."""

    last: float | None = None

    def accept(self, mid: float) -> bool:
        if not (math.isfinite(mid) and 0 < mid < 1e15):
            return False
        if self.last is not None and not 0.5 <= mid / self.last <= 2.0:
            return False
        self.last = mid
        return True

    def accepts(self, mids: np.ndarray) -> np.ndarray:
        """accept() of each in order; where no two neighbours are too far apart all are accepted at once."""
        mids = np.asarray(mids, float)
        before = np.r_[mids[:1] if self.last is None else self.last, mids[:-1]]
        with np.errstate(all="ignore"):
            still = (mids > 0) & (mids < 1e15) & (mids / before >= 0.5) & (mids / before <= 2.0)
        if still.all():
            self.last = float(mids[-1]) if len(mids) else self.last
            return still
        return np.array([self.accept(float(x)) for x in mids], bool)


@dataclass
class RunningStats:
    """Exponential mean and variance; score() gives the z of a value against the state before it, then takes it in."""

    alpha: float = 0.01
    warm: int = 10
    mean: float = 0.0
    var: float = 0.0
    count: int = 0

    def score(self, x: float, least_sd: float = 0.0) -> float:
        if self.count == 0:
            self.mean, self.count = x, 1
            return 0.0
        d = x - self.mean
        sd = max(math.sqrt(self.var), least_sd)
        z = 0.0 if self.count < self.warm or sd < 1e-12 else abs(d) / sd
        self.mean += self.alpha * d
        self.var = (1 - self.alpha) * (self.var + self.alpha * d * d)
        self.count += 1
        return z

    def scores(self, x: np.ndarray, least_sd: np.ndarray) -> np.ndarray:
        """score() of each in order."""
        if not len(x):
            return np.zeros(0)
        if self.count == 0:
            self.mean = float(x[0])
        means, self.mean = ema(x, self.alpha, self.mean)
        d = x - means
        vars_, self.var = ema((1 - self.alpha) * d * d, self.alpha, self.var)
        sd = np.maximum(np.sqrt(vars_), least_sd)
        with np.errstate(all="ignore"):
            z = np.where((self.count + np.arange(len(x)) < self.warm) | (sd < 1e-12), 0.0, np.abs(d) / sd)
        self.count += len(x)
        return z


def ema(x: np.ndarray, rate: float, start: float) -> tuple[np.ndarray, float]:
    """The exponential mean before each value, and the one after the last; in blocks, so that powers stay small."""
    before, keep = np.empty(len(x)), 1 - rate
    block = max(1, int(math.log(1e3) / -math.log(keep))) if 0 < keep < 1 else 1
    w = keep ** np.arange(1, block + 1)
    for i in range(0, len(x), block):
        part = x[i : i + block]
        after = w[: len(part)] * (start + rate * np.cumsum(part / w[: len(part)]))
        before[i], before[i + 1 : i + len(part)] = start, after[:-1]
        start = float(after[-1])
    return before, start


@dataclass
class ScoreMap:
    """What a run of values does to RunningStats: mean -> a mean + b, var -> v var + c0 + c1 mean + c2 mean^2."""

    alpha: float = 0.01
    n: int = 0
    a: float = 1.0
    b: float = 0.0
    v: float = 1.0
    c0: float = 0.0
    c1: float = 0.0
    c2: float = 0.0
    first: float | None = None

    def add(self, x: np.ndarray) -> None:
        if len(x) and self.first is None:
            self.first = float(x[0])
        keep = 1 - self.alpha
        b, self.b = ema(x, self.alpha, self.b)
        a = self.a * keep ** np.arange(len(x))
        p = x - b
        self.c0, self.c1, self.c2 = (ema(keep * u, self.alpha, c)[1] for u, c in ((p * p, self.c0), (-2 * p * a, self.c1), (a * a, self.c2)))
        self.a, self.v, self.n = self.a * keep ** len(x), self.v * keep ** len(x), self.n + len(x)

    def apply(self, s: RunningStats) -> RunningStats:
        """The state after; a fresh state takes the first value as its mean, which that value then leaves as it is."""
        m = self.first if s.count == 0 else s.mean
        return RunningStats(s.alpha, s.warm, self.a * m + self.b, max(0.0, self.v * s.var + self.c0 + self.c1 * m + self.c2 * m * m), s.count + self.n)


@dataclass
class JumpGuard:
    """Skips a price more than frac off the last close; after so many in a row it starts anew there."""

    frac: float = 0.05
    limit: int = 30
    anchor: float | None = None
    trips: int = 0

    def accept(self, price: float) -> bool:
        if self.anchor is None or abs(price - self.anchor) <= self.frac * self.anchor:
            self.anchor, self.trips = price, 0
            return True
        self.trips += 1
        if self.trips >= self.limit:
            self.anchor, self.trips = price, 0
            return True
        return False


@dataclass
class Deadband:
    """Holds the last emitted value until a new one is at least eps basis points away."""

    eps_bps: float
    emitted: float | None = None

    def next(self, x: float) -> float:
        if self.emitted is None or abs(x - self.emitted) / self.emitted * 1e4 >= self.eps_bps:
            self.emitted = x
        return self.emitted


@dataclass
class PegConfirm:
    """Holds a move of more than bps until all samples of hold_ms stay on its side, at most max_ms."""

    bps: float = 4.0
    hold_ms: int = 1500
    max_ms: int = 3000
    out: float | None = None
    since: int | None = None
    begun: int | None = None
    side: int = 0

    def next(self, ts: int, x: float) -> float:
        if self.out is None:
            self.out = x
            return x
        move = (x - self.out) / self.out * 1e4
        if abs(move) <= self.bps:
            self.out, self.since, self.begun, self.side = x, None, None, 0
            return x
        side = 1 if move > 0 else -1
        if self.begun is None:
            self.begun = ts
        if side != self.side:
            self.side, self.since = side, ts
        if ts - self.since >= self.hold_ms or ts - self.begun >= self.max_ms:
            self.out, self.since, self.begun, self.side = x, None, None, 0
        return self.out


@dataclass
class BasisGate:
    """Excludes after so many consecutive breaches of a band, and admits again after as many inside it."""

    minutes: int
    out: bool = False
    run: int = 0

    def next(self, breach: bool) -> bool:
        self.run = self.run + 1 if breach != self.out else 0
        if self.run >= self.minutes:
            self.out, self.run = not self.out, 0
        return not self.out


@dataclass
class DeltaGate:
    """Writes the first row, a changed row, the first of a day, and a copy flagged 1 where nothing was written for sentinel_ms."""

    sentinel_ms: int = 60_000
    last: tuple | None = None
    written: int = 0
    seen: int = 0

    def next(self, ts: int, row: tuple) -> int | None:
        """Flag of the row to write, or none. Rows older than the newest one are dropped."""
        if self.last is None:
            self.last, self.written, self.seen = row, ts, ts
            return 0
        if ts < self.seen:
            return None
        new_day = ts // 86_400_000 != self.written // 86_400_000
        self.seen = ts
        if row != self.last or new_day:
            self.last, self.written = row, ts
            return 0
        if ts - self.written >= self.sentinel_ms:
            self.written = ts
            return 1
        return None


@dataclass
class LegState:
    """What the composite knows of one provider's quote. Times are in milliseconds, gaps in seconds.

    Cadence and the gap before a join are those of confirmations: real frames and carries, which say that a book still stands.
    """

    bid: float = 0.0
    ask: float = 0.0
    vbid: float = 0.0
    vask: float = 0.0
    last_update: int | None = None
    live_at: int | None = None
    joined: int | None = None
    ema_ipi: float = 5.0
    last_gap: float = 0.0
    injected: bool = False

    def _confirm(self, gap: float) -> None:
        self.ema_ipi = 0.1 * min(max(gap, 1e-6), 300.0) + 0.9 * self.ema_ipi

    def update(self, now: int, bid: float, ask: float, vbid: float = 0.0, vask: float = 0.0, kind: str = "tick") -> None:
        """kind: tick, carry (liveness only) or inject (a value from elsewhere, until the next real frame)."""
        if self.last_update is None:
            self.joined = now
        elif kind == "inject":
            self._confirm((now - self.last_update) / 1000.0)
        else:
            gap = max(now - self.live_at, 0) / 1000.0
            self._confirm(gap)
            if kind == "carry":
                self.live_at = max(self.live_at, now)
                return
            self.last_gap = gap
        self.bid, self.ask, self.vbid, self.vask, self.last_update, self.live_at, self.injected = bid, ask, vbid, vask, now, now, kind == "inject"


def snap_25(x: float) -> float:
    if not x > 0:
        return x
    unit = 10.0 ** (math.floor(math.log10(x)) - 3)
    two, five = (math.floor(x / (unit * m) + 0.5) * unit * m for m in (2, 5))
    return two if abs(x - two) <= abs(x - five) else five


def single(x: float) -> float:
    import struct

    return struct.unpack("<f", struct.pack("<f", x))[0]


#: Flag of the last of ``most`` bricks of a tick that should have made more.
CAPPED = 256


@dataclass
class Renko:
    """Price-move bars. The size is set for each 30-minute period from its sigma; the anchor is snapped to the size's grid.

    A tick makes ``most`` bricks at most. What it should have made beyond is left to the next tick, if the price is still there.
    """

    k: float = 1.0
    min_pct: float = 0.0
    brick: float = 0.0
    step: float = 1.0
    last_close: float | None = None
    period: int | None = None
    high: float = -math.inf
    low: float = math.inf
    ticks: int = 0
    most: int = 1000

    def _resize(self, price: float, sigma: float) -> None:
        k, least = single(self.k), single(self.min_pct)
        self.brick = 0.0 if k < 0.05 else snap_25(price * max(k * sigma, least))
        self.step = 10.0 ** (math.floor(math.log10(self.brick)) - 3) * 2 if self.brick > 0 and math.isfinite(self.brick) else 1.0

    def _snap(self, x: float) -> float:
        return math.floor(x / self.step + 0.5) * self.step

    def retune(self, k: float) -> None:
        """A new k, never under 0.05; it takes effect when the size is next set, at a 30-minute boundary."""
        if k != self.k:
            self.k = max(k, 0.05)

    def resume(self, close: float, ts: int, price: float, sigma: float) -> None:
        """Goes on from the last close of an earlier run, with an empty wick."""
        self.period = ts // 1_800_000
        self._resize(price, sigma)
        self.last_close = self._snap(close)

    def feed(self, ts: int, price: float, sigma: float) -> list[dict]:
        """The bricks that a price completes, the first with the wick and the ticks since the last brick."""
        self.high, self.low, self.ticks = max(self.high, price), min(self.low, price), self.ticks + 1
        period = ts // 1_800_000
        if self.last_close is None:
            self.period = period
            self._resize(price, sigma)
            self.last_close = self._snap(price)
            return []
        if period != self.period:
            self.period = period
            self._resize(price, sigma)
            self.last_close = self._snap(self.last_close)
        out: list[dict] = []
        if self.brick <= 0:
            return out
        while len(out) < self.most:
            move = price - self.last_close
            if move >= self.brick:
                close = self._snap(self.last_close + self.brick)
            elif -move >= self.brick:
                close = self._snap(self.last_close - self.brick)
            else:
                break
            if close == self.last_close:
                break
            first, opened = not out, self.last_close
            top, bottom = max(opened, close), min(opened, close)
            out.append({"ts": ts, "open": opened, "high": max(top, self.high) if first else top, "low": min(bottom, self.low) if first else bottom, "close": close, "up": close > opened, "tick_count": self.ticks if first else 0, "flags": 0 if first else 4, "brick": self.brick})
            self.last_close = close
            if first:
                self.high, self.low, self.ticks = -math.inf, math.inf, 0
        if len(out) == self.most and abs(price - self.last_close) >= self.brick:
            out[-1]["flags"] |= CAPPED
        return out


def bricks_by_day(ts: np.ndarray, price: np.ndarray, sigma: np.ndarray, k: float, most: int = 1000) -> list[int]:
    """How many bricks Renko makes of a series on each day that has any; runs of prices that complete none cost two comparisons each."""
    days: dict[int, int] = {}
    fold = Renko(k, most=most)
    cuts = [0, *(np.flatnonzero(np.diff(ts // 1_800_000)) + 1).tolist(), len(ts)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        made = len(fold.feed(int(ts[a]), float(price[a]), float(sigma[a])))
        if made:
            day = int(ts[a]) // 86_400_000
            days[day] = days.get(day, 0) + made
        last, brick = fold.last_close, fold.brick
        if brick <= 0:
            continue
        for i, p in enumerate(price[a + 1 : b].tolist(), a + 1):
            if -brick < p - last < brick:
                continue
            made = 0
            while made < most:
                move = p - last
                close = fold._snap(last + brick) if move >= brick else fold._snap(last - brick) if -move >= brick else last
                if close == last:
                    break
                last, made = close, made + 1
            if made:
                day = int(ts[i]) // 86_400_000
                days[day] = days.get(day, 0) + made
        fold.last_close = last
    return list(days.values())


def search_k(count: Callable[[float], list[int]], target: float, grid: tuple[float, ...], tolerance: float, steps: int) -> tuple[float, float] | None:
    """(k, median of count(k)): within tolerance of target if any is found, else the nearest; none without bricks.

    After the grid log k is halved between its brackets, doubled where none brackets from above and halved where none does from below.
    """
    had: dict[float, float] = {}

    def take(k: float) -> bool:
        days = count(k)
        had[k] = float(np.median(days)) if days else 0.0
        return abs(had[k] / target - 1) <= tolerance

    if not any([take(float(k)) for k in grid]):
        for _ in range(steps):
            lo = max((k for k, m in had.items() if m > target), default=None)
            hi = min((k for k, m in had.items() if m < target and (lo is None or k > lo)), default=None)
            k = lo * 2 if hi is None else hi / 2 if lo is None else (lo * hi) ** 0.5
            if k in had or take(k):
                break
    some = [(abs(math.log(m / target)), k, m) for k, m in had.items() if m > 0]
    return min(some)[1:] if some else None


@dataclass
class VolEma:
    """Smoothed sigma of a bin: the mean so far for the first `period` bins, then an exponential mean."""

    period: int = 28
    value: float = 0.0
    n: int = 0

    def next(self, sigma: float) -> float:
        self.n += 1
        self.value = self.value + (sigma - self.value) / self.n if self.n <= self.period else self.value + 2 / (self.period + 1) * (sigma - self.value)
        return self.value


@dataclass
class ReplayWindow:
    """Accepts each sequence number of a peer once, within `size` of the newest; silence for idle_ms forgets it."""

    size: int = 1024
    idle_ms: int = 60_000
    top: int | None = None
    at: int = 0
    seen: set = field(default_factory=set)

    def accept(self, ts: int, seq: int) -> bool:
        if self.top is None or ts - self.at > self.idle_ms:
            self.top, self.seen = seq, {seq}
            self.at = ts
            return True
        if seq <= self.top - self.size or seq in self.seen:
            return False
        self.at = ts
        self.seen.add(seq)
        self.top = max(self.top, seq)
        self.seen = {s for s in self.seen if s > self.top - self.size}
        return True


class MtfBlend:
    """Winsorised means of a series over several windows that look back, blended by weight over variance.

    Each window is kept sorted, so that a row costs one insertion and one removal in each, and no list is sorted anew.
    """

    def __init__(self, windows: tuple[tuple[int, float], ...], least: int, floor: float, few: int = 5, cut: float = 0.05) -> None:
        self.windows, self.least, self.floor, self.few, self.cut = windows, least, floor, few, cut
        self.held = [np.zeros(0) for _ in windows]
        self.recent: deque[float] = deque(maxlen=max(w for w, _ in windows) + 1)
        self.n = 0

    def _summary(self, v: np.ndarray) -> tuple[float, float]:
        n = len(v)
        if n >= self.few:
            lo, hi = v[math.floor(n * self.cut)], v[min(max(math.floor(n * (1 - self.cut)) - 1, 0), n - 1)]
            v = np.clip(v, lo, hi)
        return float(v.mean()), float(v.var(ddof=1)) if n > 1 else 0.0

    def next(self, sigma: float) -> float:
        num = den = 0.0
        for j, (w, weight) in enumerate(self.windows):
            v = self.held[j]
            if len(v) > w:  # the row itself and w before it
                v = np.delete(v, np.searchsorted(v, self.recent[-(w + 1)]))
            v = self.held[j] = np.insert(v, np.searchsorted(v, sigma), sigma)
            mean, var = self._summary(v)
            if min(self.n, w) >= self.least and var > 0 and mean > 0:
                num, den = num + weight * mean / var, den + weight / var
        self.recent.append(sigma)
        self.n += 1
        return num / den if den > 0 else max(sigma, self.floor)


@dataclass
class AsOfPair:
    """The last quotes of two legs; each tick of either gives their cross if neither is older than ttl_ms."""

    ttl_ms: int = 5000
    base: tuple | None = None
    quote: tuple | None = None

    def next(self, ts: int, seq: int, side: int, bid: float, ask: float, vbid: int, vask: int, ci: int, accepted: int) -> tuple | None:
        row = (ts, bid, ask, vbid, vask, ci, accepted)
        if side == 0:
            self.base = row
        else:
            self.quote = row
        b, q = self.base, self.quote
        if b is None or q is None or ts - b[0] > self.ttl_ms or ts - q[0] > self.ttl_ms or None in b or None in q or not (q[1] and q[2]):
            return None
        low, high = b[1] / q[2], b[2] / q[1]
        if not all(math.isfinite(x) and 0 < x < 1e15 for x in (low, high)):
            return None
        wide = math.sqrt((b[5] / 16) ** 4 + (q[5] / 16) ** 4)
        return ts, seq, low, high, min(b[3], q[3]), min(b[4], q[4]), min(b[6], q[6]), max(0, min(65535, math.floor(math.sqrt(wide) * 16 + 0.5)))


@dataclass
class AttestState:
    """What a signed beat is to the newest one accepted. Within a boot the sequence and the time go on; a new boot must be later."""

    newest: tuple[int, int, int] | None = None

    def judge(self, boot: int, seq: int, ts: int) -> str:
        """valid, duplicate or regression; only a valid beat becomes the newest."""
        if self.newest is not None:
            b, s, t = self.newest
            if (boot, seq) == (b, s):
                return "duplicate"
            if (seq < s or ts < t) if boot == b else ts <= t:
                return "regression"
        self.newest = (boot, seq, ts)
        return "valid"


def state_of(fold) -> dict:  # noqa: ANN001
    return asdict(fold)
