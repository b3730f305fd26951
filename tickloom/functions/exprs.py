"""Scalar expressions of the market model; every one is a Catalyst expression and stays in generated code.

NaN marks absence only at the codec boundary; inside tables it is null unless a docstring says otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
EPOCH_2010_MS = 1262304000000
TIMEFRAMES_S = (10, 20, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 14400, 28800, 43200, 86400, 259200)
EXCLUDED_PROVIDERS = (71, 361, 371)
INDEX_FLAGS = {"HEARTBEAT_SENTINEL": 1, "HISTORICAL_BACKFILL": 2, "REAFFIRM": 4, "CONF_FRESHNESS": 8, "CARRY": 16, "NO_BOOK": 32, "CONF_ACTIVE": 64, "COMPOSED": 128}
BAR_FLAGS = {"RENKO_SYNTHETIC": 4, "NO_BOOK": 32, "S10_FLAT_FILL": 64, "COMPOSED": 128}
CLASS_FLOORS = {"FX": 0.00025, "EQ": 0.0015, "CM": 0.0014, "CR": 0.0008, "STABLE": 0.0002}
KERNELS = {  # name: (sigma in bp per square-root minute, least spread in bp, horizon in s)
    "PEGGED": (1.5, 1.0, 900.0),
    "MAJOR": (6.0, 0.5, 60.0),
    "ALT": (20.0, 2.0, 60.0),
    "FX_METAL": (2.0, 0.5, 300.0),
}
ANY_MAX_PRICE = 1e15
BIN_MS = 1_800_000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mid(bid: Column | str = "bid", ask: Column | str = "ask") -> Column:
    return (_c(bid) + _c(ask)) * 0.5


def finite(x: Column | str) -> Column:
    x = _c(x)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def sane_px(x: Column | str) -> Column:
    """Finite, positive and below the ceiling."""
    return finite(x) & (_c(x) > 0) & (_c(x) < ANY_MAX_PRICE)


def valid_tick(bid: Column | str = "bid", ask: Column | str = "ask", max_bps: float = 2000.0) -> Column:
    """Finite, positive, not crossed, and no wider than max_bps; a locked book passes."""
    b, a = _c(bid), _c(ask)
    return finite(b) & finite(a) & (b > 0) & (a >= b) & ((a - b) / ((a + b) * 0.5) * 1e4 <= max_bps)


def valid_book(bid: Column | str = "bid", ask: Column | str = "ask") -> Column:
    return valid_tick(bid, ask) & (_c(ask) > _c(bid))


def spread_bps(bid: Column | str = "bid", ask: Column | str = "ask") -> Column:
    return (_c(ask) - _c(bid)) / mid(bid, ask) * 1e4


def bucket(ts_ms: Column | str, tf_ms: int) -> Column:
    """Start of the epoch-aligned bucket; floors before the epoch too."""
    return (_c(ts_ms) - F.pmod(_c(ts_ms), F.lit(tf_ms))).cast("long")


def ci_encode(ubp: Column | str) -> Column:
    return F.least(F.lit(65535), F.greatest(F.lit(0), F.round(F.sqrt(F.greatest(_c(ubp), F.lit(0.0))) * 16))).cast("int")


def ci_decode(ci: Column | str) -> Column:
    return F.pow(_c(ci) / 16.0, F.lit(2.0))


def mts_to_ms(mts: Column | str) -> Column:
    """16-microsecond ticks since 2010 to epoch milliseconds."""
    return (F.lit(EPOCH_2010_MS) + F.floor(_c(mts) * 16 / 1000)).cast("long")


def ms_to_mts(ms: Column | str) -> Column:
    """Before 2010 it is 0."""
    return F.greatest(F.lit(0), F.floor((_c(ms) - EPOCH_2010_MS) * 1000 / 16)).cast("long")


def saturate(x: Column | str, bits: int) -> Column:
    return F.least(F.greatest(_c(x), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")


def has_flag(flags: Column | str, bit: int) -> Column:
    return _c(flags).bitwiseAND(F.lit(bit)) != 0


def confidence_count(confidence: Column | str, flags: Column | str) -> Column:
    """Live count of a packed or legacy byte; null under the freshness scheme."""
    c = _c(confidence)
    return F.when(has_flag(flags, 64), c.bitwiseAND(F.lit(127))).when(has_flag(flags, 8), F.lit(None)).otherwise(c).cast("int")


def confidence_bps(confidence: Column | str, flags: Column | str) -> Column:
    c = _c(confidence)
    return F.when(has_flag(flags, 64), F.when(c.bitwiseAND(F.lit(128)) != 0, 10000).otherwise(0)).when(has_flag(flags, 8), F.floor(c * 10000 / 255)).otherwise(0).cast("int")


def round_half_away(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def round_sig(x: Column | str, digits: int) -> Column:
    x = _c(x)
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, x).otherwise(round_half_away(x * scale) / scale)


# volatility of one bar


def rs_var(o, h, l, c) -> Column:  # noqa: ANN001, E741
    """Rogers-Satchell; 0 on a price that is not positive or not finite."""
    o, h, l, c = map(_c, (o, h, l, c))  # noqa: E741
    ok = sane_any(o) & sane_any(h) & sane_any(l) & sane_any(c)
    return F.when(ok, F.log(h / c) * F.log(h / o) + F.log(l / c) * F.log(l / o)).otherwise(0.0)


def sane_any(x: Column) -> Column:
    return finite(x) & (x > 0)


def rs_sigma(o, h, l, c) -> Column:  # noqa: ANN001, E741
    return F.sqrt(F.greatest(rs_var(o, h, l, c), F.lit(0.0)))


def parkinson_var(h, l) -> Column:  # noqa: ANN001, E741
    h, l = _c(h), _c(l)  # noqa: E741
    return F.when(sane_any(h) & sane_any(l), F.pow(F.log(h / l), F.lit(2.0)) / (4 * math.log(2))).otherwise(0.0)


def gk_var(o, h, l, c) -> Column:  # noqa: ANN001, E741
    o, h, l, c = map(_c, (o, h, l, c))  # noqa: E741
    ok = sane_any(o) & sane_any(h) & sane_any(l) & sane_any(c)
    return F.when(ok, 0.5 * F.pow(F.log(h / l), F.lit(2.0)) - (2 * math.log(2) - 1) * F.pow(F.log(c / o), F.lit(2.0))).otherwise(0.0)


def class_floor(kind: Column | str) -> Column:
    out = F.lit(None).cast("double")
    for k, v in CLASS_FLOORS.items():
        out = F.when(_c(kind) == k, v).otherwise(out)
    return out


def kernel_sigma(bp: float) -> float:
    """Basis points per square-root minute to a fraction per square-root second."""
    return bp * 1e-4 * 0.1290994


# grids


def snap_25(x: Column | str) -> Column:
    """To the nearer of the multiples of 2 and of 5 units, a unit being 1/1000 of x's decade; ties go to 2. Not positive: as is."""
    x = _c(x)
    unit = F.pow(F.lit(10.0), F.floor(F.log10(x)) - 3)
    two, five = round_half_away(x / (unit * 2)) * unit * 2, round_half_away(x / (unit * 5)) * unit * 5
    return F.when(~(x > 0), x).otherwise(F.when(F.abs(x - two) <= F.abs(x - five), two).otherwise(five))


def grid_step(brick: Column | str) -> Column:
    x = _c(brick)
    return F.when(sane_any(x), F.pow(F.lit(10.0), F.floor(F.log10(x)) - 3) * 2).otherwise(1.0)


def snap_to(x: Column | str, step: Column | str) -> Column:
    return round_half_away(_c(x) / _c(step)) * _c(step)


def brick_size(price: Column | str, sigma: Column | str, k: float, min_pct: float = 0.0) -> Column:
    """k and min_pct are single precision, as stored; a k below 0.05 makes no bricks."""
    kf, mf = F.lit(k).cast("float").cast("double"), F.lit(min_pct).cast("float").cast("double")
    return F.when(kf < 0.05, F.lit(0.0)).otherwise(snap_25(_c(price) * F.greatest(kf * _c(sigma), mf)))


# composite helpers


def w_max(n: Column | str) -> Column:
    """Largest share of one of n legs."""
    return F.least(F.lit(0.99), 0.253 + F.exp(-0.228 * F.greatest(_c(n), F.lit(1))))


def freshness(age: Column | str, window: Column | str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 - 2 * _c(age) / _c(window)))


def refresh_ms(stale_s: float, cycle_ms: int = 200) -> float:
    return max(stale_s * 1000 / 5, 3 * cycle_ms)


# ids and bits


def ticker_field(ticker_id: Column | str, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(_c(ticker_id), shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("long")


def ticker_parts(ticker_id: Column | str) -> list[Column]:
    return [ticker_field(ticker_id, s, b).alias(n) for n, s, b in (("itype", 60, 4), ("base_class", 56, 4), ("base_id", 40, 16), ("quote_class", 36, 4), ("quote_id", 20, 16), ("sub_type", 0, 20))]


def make_ticker(itype, base_class, base_id, quote_class, quote_id, sub_type=0) -> Column:  # noqa: ANN001
    put = lambda v, s: F.shiftleft((v if isinstance(v, Column) else F.lit(v)).cast("long"), s)
    out = put(itype, 60)
    for v, s in ((base_class, 56), (base_id, 40), (quote_class, 36), (quote_id, 20), (sub_type, 0)):
        out = out.bitwiseOR(put(v, s))
    return out


def inverse_ticker(ticker_id: Column | str) -> Column:
    f = lambda s, b: ticker_field(ticker_id, s, b)
    return make_ticker(f(60, 4), f(36, 4), f(20, 16), f(56, 4), f(40, 16), f(0, 20))


def asset_key(cls: Column | str, class_id: Column | str) -> Column:
    return F.shiftleft(_c(cls).cast("long"), 16).bitwiseOR(_c(class_id).cast("long"))


# status


def freshness_status(age_s: Column | str) -> Column:
    a = _c(age_s)
    return F.when(a.isNull(), "no-data").when(a < 30, "fresh").when(a < 300, "stale").otherwise("dead")


def shard_status(last_day: Column | str, today: Column) -> Column:
    return F.when(_c(last_day).isNull(), "absent").when(F.datediff(today, _c(last_day)) > 3, "stale").otherwise("live")


def lag_bucket(ms: Column | str) -> Column:
    """Bit length of a latency, at most 15."""
    m = _c(ms).cast("long")
    return F.least(F.lit(15), F.when(m <= 0, 0).otherwise(F.length(F.bin(m)))).cast("int")


#: Class numbers that the rules below name.
FX, COMMODITY, CRYPTO = 3, 4, 6


def _legs(ticker_id: Column | str) -> tuple[Column, Column]:
    return ticker_field(ticker_id, 56, 4), ticker_field(ticker_id, 36, 4)


def bucket_class(ticker_id: Column | str, base: Column | str = "base", quote: Column | str = "quote", majors: tuple[str, ...] = ("BTC", "ETH"), stables: tuple[str, ...] = ("USDT", "USDC", "DAI"), fx_majors: tuple[str, ...] = ("USD", "EUR", "JPY", "GBP", "CHF", "CAD", "AUD", "NZD")) -> Column:
    """Calibration class of a ticker, from the classes of its legs and whether its symbols, whatever their case, are in the lists."""
    b, q = _legs(ticker_id)
    within = lambda c, names: F.upper(_c(c)).isin([n.upper() for n in names])
    crypto = F.when(within(base, stables) & within(quote, stables), "crypto_stable").when(~within(quote, stables), "crypto_cross").when(within(base, majors), "crypto_major").otherwise("crypto_alt")
    fiat = F.when((b == FX) & (q == FX) & within(base, fx_majors) & within(quote, fx_majors), "fx_major").otherwise("fx_cross")
    return F.when((b == FX) | (q == FX), fiat).when((b == CRYPTO) & (q == CRYPTO), crypto).otherwise("default")


def sigma_floor(ticker_id: Column | str, peg: Column | str | None = None, commodities: tuple[int, ...] = (COMMODITY,)) -> Column:
    """Least 30-minute sigma of a ticker by its legs' classes; a peg (same_numeraire, cross_fiat) is better information and wins.

    Metals are a class of their own whose number isn't published: it goes into commodities.
    """
    b, q = _legs(ticker_id)
    own = F.when((b == FX) & (q == FX), CLASS_FLOORS["FX"]).when(b.isin(*commodities) | q.isin(*commodities), CLASS_FLOORS["CM"]).when((b == CRYPTO) | (q == CRYPTO), CLASS_FLOORS["CR"]).otherwise(CLASS_FLOORS["EQ"])
    if peg is None:
        return own
    return F.when(_c(peg) == "same_numeraire", CLASS_FLOORS["STABLE"]).when(_c(peg) == "cross_fiat", CLASS_FLOORS["FX"]).otherwise(own)


def wire_kernel(ticker_id: Column | str) -> Column:
    """Kernel by the id alone: a crypto leg ages as ALT, all else as FX_METAL."""
    b, q = _legs(ticker_id)
    return F.when((b == CRYPTO) | (q == CRYPTO), "ALT").otherwise("FX_METAL")


def clamped_sigma(realised: Column | str, kernel: str) -> Column:
    """A measured sigma within once and ten times the kernel's own; one that isn't finite doesn't count."""
    own = kernel_sigma(KERNELS[kernel][0])
    return F.when(finite(realised), F.least(F.greatest(_c(realised), F.lit(own)), F.lit(10 * own))).otherwise(own)
