"""Composite prices over providers, and the statistics around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import tdwap

#: What a leg is where its columns don't say.
DEFAULTS = {"weight": "1.0D", "mapped": "true", "injected": "false", "ema_ipi": "5.0D", "last_gap": "0.0D", "joined": "CAST(NULL AS BIGINT)", "resid": "0.0D", "vbid": "0.0D", "vask": "0.0D"}
CARRY = ("secs", "tol", "zero", "min_peers", "lone")


def legs_at(quotes: DataFrame, step_ms: int, horizon_ms: int = 60_000, ts: str = "ts") -> DataFrame:
    """For each ticker and instant the last quote of every provider before it, if it is no older than the horizon.

    A quote stands from its own time to that of the provider's next one, so it is written out for the instants of that span: no
    join, no search, and a ticker is split by its providers. Ties in time go by seq. With the columns of ``leg_states`` each
    leg has its state; quotes without them may still be old. Null times give no leg.
    """
    w = Window.partitionBy("ticker", "provider").orderBy(ts, "seq")
    until = F.least(F.coalesce(F.lead(ts).over(w), F.lit(1 << 62)), F.col(ts) + horizon_ms)
    first = X.bucket(ts, step_ms) + step_ms
    q = quotes.where(F.col(ts).isNotNull()).withColumn("_until", until).withColumn("_first", first).where("_first <= _until")
    q = q.withColumn("t", F.explode(F.sequence("_first", "_until", F.lit(step_ms).cast("long")))).drop("_until", "_first")
    return q if "last_update" in q.columns else q.withColumn("last_update", F.col(ts))


def _median_of(peers: Column) -> Column:
    """Mean of the quantile function over the middle fifth of the mass of an array of (mid, weight)."""
    total = F.aggregate(peers, F.lit(0.0), lambda a, x: a + x["weight"])

    def step(a: Column, x: Column) -> Column:
        inside = F.greatest(F.lit(0.0), F.least(0.6 * a["total"], a["at"] + x["weight"]) - F.greatest(0.4 * a["total"], a["at"]))
        return F.struct((a["at"] + x["weight"]).alias("at"), (a["sum"] + x["mid"] * inside).alias("sum"), a["total"].alias("total"))

    start = F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("sum"), total.alias("total"))
    return F.aggregate(F.array_sort(peers), start, step, lambda a: a["sum"] / (0.2 * a["total"]))


def _judged(rows: DataFrame, group, stale: float) -> DataFrame:  # noqa: ANN001
    """Adds near and held of carried legs: what their distance from their peers leaves them, and whether enough live peers hold a price."""
    own = F.struct(X.mid().alias("mid"), F.greatest("weight", F.lit(1e-300)).alias("weight"), "last_update", "carried", "tau")
    rows = rows.withColumn("_peers", F.collect_list(F.when(~F.col("injected"), own)).over(group))
    newer = F.when(F.col("carried"), F.filter("_peers", lambda x: x["last_update"] > F.col("last_update")))
    rows = rows.withColumn("_newer", newer).withColumn("_live", F.filter("_newer", lambda x: ~x["carried"] & (x["tau"] <= stale)))
    rows = rows.withColumn("_need", F.greatest("min_peers", F.lit(1))).withColumn("held", F.coalesce(F.size("_live") >= F.col("_need"), F.lit(False)))
    rows = rows.withColumn("_who", F.when(F.col("held"), F.col("_live")).otherwise(F.col("_newer")))
    at = _median_of(F.transform("_who", lambda x: F.struct(x["mid"].alias("mid"), x["weight"].alias("weight"))))
    rows = rows.withColumn("_at", F.when(F.size("_who") >= F.col("_need"), at))
    left = (F.col("zero") - F.abs(X.mid() - F.col("_at")) / F.col("_at")) / F.greatest(F.col("zero") - F.col("tol"), F.lit(1e-300))
    near = F.when(F.col("_at").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), left)))
    return rows.withColumn("near", near).drop("_peers", "_newer", "_live", "_need", "_who", "_at")


def _filled(rows: DataFrame, group, cap: str, lift: str, name: str) -> DataFrame:  # noqa: ANN001
    """Adds the shares of a water-filling of share under cap by lift, null for a group where no level fills it.

    The sum rises with the level in straight pieces that bend where a leg meets its cap; running sums over the bends in order
    give the sum at each, and the first that reaches 1 has the level.
    """
    c, e = F.col(cap), F.col(lift)
    bends = (e > 0) & (F.col("share") < c)
    rows = rows.withColumn("_at", F.when(bends, (c - F.col("share")) / e)).withColumn("_e", F.when(bends, e).otherwise(0.0))
    before = group.orderBy(F.col("_at").asc_nulls_last(), "provider").rowsBetween(Window.unboundedPreceding, -1)
    gone = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0.0))
    rows = rows.withColumn("_start", F.sum(F.least("share", c)).over(group)).withColumn("_slope", F.sum("_e").over(group) - gone("_e")).withColumn("_full", F.col("_start") + gone(F.col("_e") * F.coalesce("_at", F.lit(0.0))))
    reached = F.col("_at").isNotNull() & (F.col("_full") + F.col("_at") * F.col("_slope") >= 1 - tdwap.TINY)
    level = F.min(F.when(reached, F.struct("_at", ((1 - F.col("_full")) / F.col("_slope")).alias("level")))).over(group)["level"]
    level = F.when(F.col("_start") >= 1 - tdwap.TINY, 0.0).otherwise(level)
    return rows.withColumn("_level", level).withColumn(name, F.when(F.col("_level").isNotNull(), F.least(c, F.col("share") + F.col("_level") * e))).drop("_at", "_e", "_start", "_slope", "_full", "_level")


def kernels_at(legs: DataFrame, classes: DataFrame, sigma: DataFrame | None = None, lag_ms: int = X.BIN_MS) -> DataFrame:
    """legs with the kernel of their ticker (ticker, kernel), and of sigma (ticker, bin_start_ms, sigma) that of the last bin closed before t.

    Tickers without a class have a null kernel and instants without a bin a null sigma: what weighed() is told stands for those.
    """
    out = legs.join(classes.select("ticker", "kernel"), "ticker", "left")
    if sigma is None:
        return out
    s = sigma.select(F.col("ticker").alias("_t"), F.col("bin_start_ms").alias("_b"), "sigma")
    return out.join(s, (F.col("ticker") == F.col("_t")) & (X.bucket("t", X.BIN_MS) - lag_ms == F.col("_b")), "left").drop("_t", "_b")


def weighed(legs: DataFrame, stale: float = 10.0, kernel: str = "ALT", sigma: float | None = None, share_cap: float = 1.0, anomaly: float = 5.0, bloc: float = 0.40) -> DataFrame:
    """The legs that stand, with their weights and final shares; all in windows over (ticker, t), so nothing leaves generated code.

    Times are in milliseconds. A leg with a positive ``secs`` and a live_at after its last_update is carried. Columns ``kernel`` and
    ``sigma``, where legs have them, stand for the kernel and sigma of all; a sigma counts within once and ten times its kernel's.
    """
    of = F.coalesce("kernel", F.lit(kernel)) if "kernel" in legs.columns else F.lit(kernel)

    def its(value: Callable[[tuple], float]) -> Column:
        out = F.lit(value(X.KERNELS[kernel]))
        for name, k in X.KERNELS.items():
            out = F.when(F.col("_kernel") == name, F.lit(value(k))).otherwise(out)
        return out

    legs = legs.withColumn("_kernel", of)
    base, floor, horizon = its(lambda k: X.kernel_sigma(k[0])), its(lambda k: k[1] * 1e-4), its(lambda k: k[2])
    real = F.coalesce(F.when(X.finite("sigma"), F.col("sigma")), F.lit(sigma).cast("double")) if "sigma" in legs.columns else F.lit(sigma).cast("double")
    legs = legs.withColumn("_vol2", F.pow(F.coalesce(F.least(F.greatest(real, base), 10 * base), base), F.lit(2.0)))
    vol2 = F.col("_vol2")
    for c, value in DEFAULTS.items():
        legs = legs.withColumn(c, F.coalesce(F.col(c), F.expr(value)) if c in legs.columns else F.expr(value))
    carries = set(CARRY) <= set(legs.columns)
    group = Window.partitionBy("ticker", "t")
    clamp = lambda x, lo=0.0: F.least(F.lit(1.0), F.greatest(F.lit(lo), x))
    rows = legs.withColumn("tau", (F.col("t") - F.col("last_update")) / 1000.0).withColumn("_ok", X.valid_tick())
    rows = rows.withColumn("rejected", F.sum((~F.col("_ok")).cast("int")).over(group)).where(F.col("_ok") & (F.col("tau") <= horizon))
    rows = rows.withColumn("s", F.greatest((F.col("ask") - F.col("bid")) / (F.col("ask") + F.col("bid")), floor))
    rows = rows.withColumn("s_ref", F.sum(F.col("weight") * F.col("s")).over(group) / F.sum("weight").over(group)).where("s_ref > 0")
    evict = F.greatest(F.pow(4 * F.col("s_ref"), F.lit(2.0)) / vol2, F.lit(stale / 2))
    if carries:
        rows = rows.withColumn("carried", F.coalesce((F.col("secs") > 0) & (F.col("live_at") > F.col("last_update")), F.lit(False)))
        rows = _judged(rows, group, stale)
        evict = F.when(F.col("carried"), F.greatest("secs", F.lit(stale / 2))).otherwise(evict)
    carried = F.col("carried") if carries else F.lit(False)
    rows = rows.withColumn("evict", F.least(evict, horizon)).withColumn("eff", F.greatest("tau", F.least("ema_ipi", F.col("evict") / 2))).where("eff <= evict")
    taper, presence, diffused = 1 - F.col("eff") / F.col("evict"), X.freshness("tau", F.least(F.lit(stale), "evict")), F.col("eff")
    if carries:
        left = lambda age: clamp(F.when(F.col("held"), (1 - F.col(age) / F.greatest("secs", F.lit(1e-300))) / (1 - tdwap.CARRY_FLAT)).otherwise(2 * (1 - F.col(age) / F.greatest("lone", F.lit(1e-300)))))
        taper = F.when(carried, left("eff") * F.col("near")).otherwise(taper)
        presence = F.when(carried, X.freshness((F.col("t") - F.col("live_at")) / 1000.0, F.least(F.lit(stale), "evict")) * left("tau") * F.col("near")).otherwise(presence)
        diffused = F.when(carried & F.col("held"), 0.0).otherwise(diffused)
    joined = F.when(F.col("last_gap") > F.col("evict"), F.col("last_update")).otherwise(F.col("joined"))
    rows = rows.withColumn("ramp", F.when(joined.isNull(), 1.0).otherwise(clamp((F.col("t") - joined) / 1000.0 / F.greatest(3 * F.col("ema_ipi"), F.lit(1e-300)), 1e-3)))
    rows = rows.withColumn("f", presence).withColumn("g", F.col("f") * F.col("ramp")).withColumn("w", F.col("weight") * F.col("ramp") * F.col("s_ref") * F.col("s_ref") * taper / (F.col("s") * F.col("s") + vol2 * diffused + F.col("resid")))
    rows = rows.withColumn("f", F.col("f") + 1 - F.coalesce(F.max(F.when(~F.col("injected"), F.col("g"))).over(group), F.lit(0.0))).withColumn("w", F.col("w") * F.col("f"))
    rows = rows.withColumn("_w", F.sum("w").over(group)).withColumn("_m", F.sum(F.when(F.col("mapped"), F.col("w")).otherwise(0.0)).over(group)).where(F.col("_w") >= tdwap.TINY)
    some = F.col("_m") > 0
    rows = rows.withColumn("evidence", ~F.col("injected") & (F.col("mapped") | ~some))
    x = F.when(F.col("evidence"), F.least("weight", F.lit(anomaly)) * F.col("g")).otherwise(0.0)
    rows = rows.withColumn("_x", F.sum(x).over(group)).withColumn("_x2", F.sum(x * x).over(group)).withColumn("cap", X.w_max(F.when(F.col("_x2") > 0, F.col("_x") * F.col("_x") / F.col("_x2")).otherwise(0.0)))
    rows = rows.withColumn("_other", (F.col("_w") - F.col("_m")) / F.col("_w")).withColumn("_seen", F.sum(F.when(F.col("mapped"), F.col("w") * F.col("g")).otherwise(0.0)).over(group) / F.greatest("_m", F.lit(1e-300)))
    bound = F.col("_seen") * F.least("_other", F.lit(bloc / (1 + bloc))) + (1 - F.col("_seen")) * F.col("_other")
    scale = F.when(~some, 1.0).when(F.col("mapped"), (1 - bound) / F.greatest(1 - F.col("_other"), F.lit(1e-300))).when(F.col("_other") > 0, bound / F.col("_other")).otherwise(1.0)
    rows = rows.withColumn("share", F.col("w") / F.col("_w") * scale).withColumn("lift", F.when(F.col("mapped") | ~some, F.col("share") * F.col("g")).otherwise(0.0))
    if share_cap < 1:
        first = F.row_number().over(group.orderBy(F.col("evidence").desc(), F.col("g").desc(), "provider"))
        rows = rows.withColumn("_n", first).withColumn("_g1", F.max(F.when(F.col("evidence"), F.col("g"))).over(group)).withColumn("_g2", F.max(F.when(F.col("evidence") & (F.col("_n") == 2), F.col("g"))).over(group))
        other = F.when(~F.col("evidence") | (F.col("g") >= F.col("_g1")), F.coalesce("_g2", F.lit(0.0))).otherwise(F.coalesce("_g1", F.lit(0.0)))
        rows = rows.withColumn("pegged", F.least("cap", 1 - (1 - share_cap) * F.least(other, F.lit(1.0))))
        rows = _filled(rows, group, "pegged", "lift", "_f1")
    rows = _filled(rows, group, "cap", "lift", "_f2")
    rows = _filled(rows, group, "cap", "share", "_f3")
    tries = (["_f1"] if share_cap < 1 else []) + ["_f2", "_f3", "share"]
    return rows.withColumn("final", F.coalesce(*tries))


def composites(legs: DataFrame, stale: float = 10.0, kernel: str = "ALT", k_disp: float = 1.0, **options) -> DataFrame:  # noqa: ANN003
    """One quote for each (ticker, t) that has a leg, with its confidence and its legs' shares.

    Ticker and instant are the key throughout: one shuffle, and no task holds more than an instant's legs at a time. Crossed, null and
    non-finite legs are counted as rejected. Ties among legs go by provider. No legs, no row.
    """
    group = Window.partitionBy("ticker", "t")
    rows = weighed(legs, stale, kernel, **options).withColumn("mid", X.mid()).withColumn("used", F.col("final") > tdwap.TINY)
    rows = rows.withColumn("u", F.when(F.col("used"), F.col("final")).otherwise(0.0)).withColumn("centre", F.sum(F.col("u") * F.col("mid")).over(group) / F.sum("u").over(group))
    apart = F.col("mid") - F.col("centre")
    aged = (F.col("ask") - F.col("bid")) / 2 * F.least(F.sqrt(F.col("tau") / F.greatest("ema_ipi", F.lit(1e-6))), F.lit(3.0))
    active = (F.col("g") > 0) & (F.col("f") >= 0.5) & ~F.col("injected")
    used = lambda x: F.sum(F.when(F.col("used"), x).otherwise(0.0))
    mixed = "kernel" in legs.columns
    pair = F.when(F.col("used") & (F.col("_kernel") == "PEGGED"), F.struct("mid", F.col("u").alias("weight")))
    g = rows.groupBy("ticker", "t").agg(
        F.sum("u").alias("total"), used(F.col("u") * F.col("bid")).alias("bid"), used(F.col("u") * F.col("ask")).alias("ask"), used(F.col("u") * apart * apart).alias("apart"), used(F.col("u") * aged * aged).alias("aged"),
        used(F.col("vbid").cast("double")).alias("vbid"), used(F.col("vask").cast("double")).alias("vask"), F.count_if("used").cast("int").alias("accepted"), F.max("rejected").cast("int").alias("rejected"),
        F.count_if(active).alias("live"), F.sum(F.when(active, F.col("final")).otherwise(0.0)).alias("live_share"), F.sum(F.col("u") * F.col("u")).alias("u2"), F.max("u").alias("top"),
        F.sort_array(F.collect_list(F.when(F.col("used"), F.struct("provider", F.col("u").alias("share"))))).alias("raw"),
        *([F.collect_list(pair).alias("mids")] if mixed or kernel == "PEGGED" else []),
    ).where(F.col("total") >= tdwap.TINY)
    total = F.col("total")
    g = g.withColumns({"bid": F.col("bid") / total, "ask": F.col("ask") / total, "apart": F.col("apart") / total}).withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    ci = F.greatest(F.sqrt(F.col("apart") + F.col("aged") / total), F.abs(F.col("ask") - F.col("bid")) / 2) / F.col("mid") * 1e8
    shift = F.when(F.size("mids") > 0, _median_of(F.col("mids")) - F.col("mid")).otherwise(0.0) if mixed or kernel == "PEGGED" else F.lit(0.0)
    half = F.when((F.col("ask") == F.col("bid")) & (F.col("accepted") >= 2), k_disp * F.sqrt("apart")).otherwise(0.0)
    real = F.col("ask") > F.col("bid")
    return g.select(
        "ticker", "t", (F.when(real, F.col("bid")).otherwise(F.col("mid") - half) + shift).alias("bid"), (F.when(real, F.col("ask")).otherwise(F.col("mid") + half) + shift).alias("ask"), "vbid", "vask", "accepted", "rejected", X.ci_encode(ci).alias("ci"),
        F.least(F.col("live"), F.lit(64)).cast("int").bitwiseOR(F.when(F.col("live_share") / total >= 0.20, 128).otherwise(0)).alias("confidence"), F.when(F.col("vbid") + F.col("vask") == 0, 96).otherwise(64).alias("flags"),
        (total * total / F.col("u2")).alias("n_eff"), (F.col("top") / total).alias("top_share"), (F.sqrt("apart") / F.col("mid")).alias("dispersion"),
        F.transform("raw", lambda x: F.struct(x["provider"].alias("provider"), (x["share"] / total).alias("share"))).alias("shares"),
    )


def throttled(legs: DataFrame, refresh_ms: float, compose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(ticker, t, changed, what compose gives): composites of cycles whose legs changed or refresh_ms after that, and copies of them elsewhere.

    The interval counts from the last change, whatever was refreshed since: a row refreshes at each multiple of refresh_ms behind it.
    Only the legs of cycles that are due go to compose; the others' are hashed and summed, no more.
    """
    w = Window.partitionBy("ticker").orderBy("t")
    f = unchanged_cycles(legs).withColumn("_c", F.last(F.when(F.col("changed"), F.col("t")), ignorenulls=True).over(w))
    f = f.withColumn("_r", F.col("_c") + F.floor((F.col("t") - F.col("_c")) / refresh_ms) * int(refresh_ms))
    f = f.withColumn("_due", F.min("t").over(Window.partitionBy("ticker", "_r"))).select("ticker", "t", "changed", "_due")
    due = compose(legs.join(f.where("t = _due").select("ticker", "t"), ["ticker", "t"], "left_semi"))
    columns = [c for c in due.columns if c not in ("ticker", "t")]
    return f.join(due.withColumnRenamed("t", "_due"), ["ticker", "_due"]).select("ticker", "t", "changed", *columns)


def weighted_medians(rows: DataFrame, keys: list[str], value: str = "mid", weight: str = "weight") -> DataFrame:
    """Mean of the quantile function over the middle fifth of each group's mass, by a running sum."""
    w = Window.partitionBy(*keys)
    r = rows.withColumn("_t", F.sum(weight).over(w)).withColumn("_e", F.sum(weight).over(w.orderBy(value, weight).rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.greatest(F.lit(0.0), F.least(0.6 * F.col("_t"), F.col("_e")) - F.greatest(0.4 * F.col("_t"), F.col("_e") - F.col(weight)))
    return r.groupBy(*keys).agg((F.sum(F.col(value) * inside) / F.max(0.2 * F.col("_t"))).alias("median"))


def interpolated_medians(rows: DataFrame, keys: list[str], value: str = "mid", weight: str = "weight") -> DataFrame:
    """Between the centres of mass next to the middle."""
    w = Window.partitionBy(*keys)
    o = w.orderBy(value, weight)
    r = rows.withColumn("_h", F.sum(weight).over(w) / 2).withColumn("_c", F.sum(weight).over(o.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight) / 2)
    r = r.withColumn("_pc", F.lag("_c").over(o)).withColumn("_pv", F.lag(value).over(o)).where("_c >= _h")
    cut = F.when(F.col("_pc").isNull() | (F.col("_pc") == F.col("_c")), F.col(value)).otherwise(F.col("_pv") + (F.col(value) - F.col("_pv")) * (F.col("_h") - F.col("_pc")) / (F.col("_c") - F.col("_pc")))
    return r.withColumn("_m", cut).groupBy(*keys).agg(F.min_by("_m", "_c").alias("median"))


def concentration(rows: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """n_eff, Herfindahl index and the share ceiling of each group."""
    g = rows.groupBy(*keys).agg(F.sum(weight).alias("_s"), F.sum(F.col(weight) * F.col(weight)).alias("_s2"))
    n = F.when(F.col("_s2") > 0, F.col("_s") * F.col("_s") / F.col("_s2")).otherwise(0.0)
    return g.select(*keys, n.alias("n_eff"), F.when(F.col("_s2") > 0, F.col("_s2") / (F.col("_s") * F.col("_s"))).otherwise(1.0).alias("hhi"), X.w_max(n).alias("w_max"))


def rss(*columns: str) -> Column:
    """Root of the sum of squares."""
    total = F.lit(0.0)
    for c in columns:
        total += F.col(c) * F.col(c)
    return F.sqrt(total)


def unchanged_cycles(legs: DataFrame) -> DataFrame:
    """(ticker, t, fingerprint, changed): a sum of row hashes tells, whatever the order, whether a composite must be computed anew."""
    g = legs.groupBy("ticker", "t").agg(F.sum(F.xxhash64("provider", "bid", "ask", "vbid", "vask").cast("decimal(38,0)")).alias("fingerprint"))
    before = F.lag("fingerprint").over(Window.partitionBy("ticker").orderBy("t"))
    return g.withColumn("changed", ~F.coalesce(F.col("fingerprint") == before, F.lit(False)))


def inverted_mark(rows: DataFrame) -> DataFrame:
    """The quote of the inverse pair: sides swap, sigma and ci stay."""
    return rows.withColumn("_b", 1 / F.col("ask")).withColumn("ask", 1 / F.col("bid")).withColumn("bid", F.col("_b")).drop("_b")


def mark_grid_bps(sigma_bps: Column | str, k: float, ceiling: float) -> Column:
    s = F.col(sigma_bps) if isinstance(sigma_bps, str) else sigma_bps
    return F.least(F.lit(ceiling), F.greatest(F.lit(0.0), s / k))


def multi_market(rows: DataFrame, keys: list[str], gain: float = 0.5, cap: float = 2.0, max_bps: float = 25.0, least: float = 0.1) -> DataFrame:
    """The deepest market of a provider; others near it in price and not negligible add a part of their volume, up to a cap."""
    w = Window.partitionBy(*keys)
    top = F.max_by("mid", "volume").over(w)
    r = rows.withColumn("_d", F.max("volume").over(w)).withColumn("_m", top)
    near = (F.abs(F.col("mid") / F.col("_m") - 1) * 1e4 <= max_bps) & (F.col("volume") >= least * F.col("_d"))
    g = r.groupBy(*keys).agg(F.max("_d").alias("_d"), F.max("_m").alias("mid"), F.sum(F.when(near, F.col("volume")).otherwise(0.0)).alias("_n"))
    return g.select(*keys, "mid", F.least(F.col("_d") + gain * (F.col("_n") - F.col("_d")), cap * F.col("_d")).alias("volume"))


def _middle(values: Column) -> Column:
    """Median of an array, null if it is empty."""
    v, n = F.array_sort(values), F.size(values)
    return (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2


def parity_basis(legs: DataFrame, minutes: int = 30, cap_bps: float = 200.0, recent: int = 30, most: int = 20, reset_bps: float = 25.0) -> DataFrame:
    """(ticker, minute, leg_mid, ref_mid), a row for each common minute, with basis: the median log ratio of the last minutes, held in a cap.

    Adds regime: ``most`` of the common minutes in the last ``recent`` are further from the basis than reset_bps and than three
    times the median deviation; the basis is then that of those recent minutes alone. Minutes without a row don't count.
    """
    w = lambda n: Window.partitionBy("ticker").orderBy("minute").rangeBetween(-(n - 1), 0)
    rows = legs.withColumn("_x", F.log(F.col("leg_mid") / F.col("ref_mid"))).withColumn("_v", F.collect_list("_x").over(w(minutes))).withColumn("_m", _middle(F.col("_v")))
    rows = rows.withColumn("_d", F.greatest(3 * _middle(F.transform("_v", lambda x: F.abs(x - F.col("_m")))), F.lit(reset_bps * 1e-4))).withColumn("_r", F.collect_list("_x").over(w(recent)))
    rows = rows.withColumn("regime", F.size(F.filter("_r", lambda x: F.abs(x - F.col("_m")) > F.col("_d"))) >= most)
    b, lim = F.when(F.col("regime"), _middle(F.col("_r"))).otherwise(F.col("_m")), cap_bps * 1e-4
    return rows.withColumn("basis", F.least(F.greatest(b, F.lit(-lim)), F.lit(lim))).drop("_x", "_v", "_m", "_d", "_r")


def fallback(rows: DataFrame, key: str, order: str, primary: str, spare: str) -> DataFrame:
    """primary, else spare moved by the last known ratio of the two."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ratio = F.last(F.col(primary) / F.col(spare), ignorenulls=True).over(w)
    return rows.withColumn("price", F.coalesce(F.col(primary), F.col(spare) * ratio))
