"""Range reads, last values, retention, coverage and row admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def in_range(df: DataFrame, ts: str, start: int | None = None, end: int | None = None, cursor: int | None = None) -> DataFrame:
    """Inclusive bounds; cursor is an exclusive lower bound. A dt partition column, where there is one, is bounded as well."""
    for cond, v in ((">=", start), ("<=", end), (">", cursor)):
        if v is not None:
            df = df.where(f"{ts} {cond} {int(v)}")
            if "dt" in df.columns:
                day = F.to_date(F.timestamp_millis(F.lit(int(v))))
                df = df.where(F.col("dt") >= day if cond != "<=" else F.col("dt") <= day)
    return df


def first_n(df: DataFrame, ts: str, n: int, **bounds) -> DataFrame:  # noqa: ANN003
    return in_range(df, ts, **bounds).orderBy(ts, "seq").limit(n)


def newest_n(df: DataFrame, ts: str, n: int, **bounds) -> DataFrame:  # noqa: ANN003
    """The newest n, oldest first."""
    return in_range(df, ts, **bounds).orderBy(F.desc(ts), F.desc("seq")).limit(n).orderBy(ts, "seq")


def ring(df: DataFrame, ts: str, cap: int, window_ms: int | None = None, key: str = "ticker") -> DataFrame:
    """What a ring keeps for each key: the newest cap rows, none older than window_ms behind the newest."""
    w = Window.partitionBy(key)
    out = df.withColumn("_r", F.row_number().over(w.orderBy(F.desc(ts), F.desc("seq")))).withColumn("_m", F.max(ts).over(w)).where(F.col("_r") <= cap)
    if window_ms is not None:
        out = out.where(F.col(ts) >= F.col("_m") - window_ms)
    return out.drop("_r", "_m")


def last_per_key(df: DataFrame, ts: str, key: str = "ticker") -> DataFrame:
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(ts, "seq")).alias("r")).select(key, "r.*")


def last_status(df: DataFrame, ts: str, now_ms: int, key: str = "ticker", max_age_ms: int | None = None) -> DataFrame:
    """Last row of each key with its age and status; older than max_age_ms is refused."""
    out = last_per_key(df, ts, key).withColumn("age_s", (F.lit(now_ms) - F.col(ts)) / 1000.0).withColumn("status", X.freshness_status("age_s"))
    return out if max_age_ms is None else out.where(F.col("age_s") * 1000 <= max_age_ms)


def idents(df: DataFrame, wanted: list, key: str = "ticker", most: int = 1000) -> DataFrame:
    """Rows of listed keys; a list over the limit is an error, never cut."""
    if len(wanted) > most:
        raise ValueError(f"{len(wanted)} idents; the limit is {most}")
    return df.where(F.col(key).isin(wanted))


def coverage(df: DataFrame, ts: str, key: str = "ticker") -> DataFrame:
    day = F.col(ts) - F.pmod(ts, F.lit(86_400_000))
    return df.groupBy(key).agg(F.min(day).alias("first_day_ms"), F.max(day).alias("last_day_ms"), F.count("*").alias("n"))


def counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("provider").alias("providers"))


def markets(df: DataFrame, most: int = 100) -> DataFrame:
    """Providers of each ticker, the list cut at `most`, the total not."""
    g = df.groupBy("ticker").agg(F.sort_array(F.collect_set("provider")).alias("all"))
    return g.select("ticker", F.slice("all", 1, most).alias("providers"), F.size("all").alias("total"))


def days_of(rows: DataFrame, ts: str = "ts_ms", key: str = "ticker") -> DataFrame:
    """(key, day): every UTC day from each key's first row to its last, whether it has rows or not. Null times don't count."""
    day = F.to_date(F.timestamp_millis(ts))
    ends = rows.groupBy(key).agg(F.min(day).alias("_a"), F.max(day).alias("_z")).where("_a IS NOT NULL")
    return ends.select(key, F.explode(F.sequence("_a", "_z")).alias("day"))


def days(first: str, last: str, spark) -> DataFrame:  # noqa: ANN001
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def heartbeats(ticks: DataFrame, every_ms: int, most_ms: int, ts: str = "tc_ms") -> DataFrame:
    """(ticker, ts, seq, bid, ask, flags): each quote, and in quiet times its copies flagged 1 each every_ms behind it, up to most_ms.

    A copy stands before the next quote, not at it. Ties in time go by seq; null times and tickers are left out.
    """
    rows = ticks.where(F.col(ts).isNotNull() & F.col("ticker").isNotNull())
    until = F.least(F.coalesce(F.lead(ts).over(Window.partitionBy("ticker").orderBy(ts, "seq")) - 1, F.lit(1 << 62)), F.col(ts) + most_ms)
    out = rows.select("ticker", F.col(ts).alias("_ts"), F.greatest(until, F.col(ts)).alias("_until"), "seq", "bid", "ask")
    out = out.withColumn("ts", F.explode(F.sequence("_ts", "_until", F.lit(every_ms).cast("long"))))
    return out.select("ticker", "ts", "seq", "bid", "ask", (F.col("ts") > F.col("_ts")).cast("int").alias("flags"))


def sessions(rows: DataFrame, gap_ms: int, keys: list[str], ts: str = "tc_ms") -> DataFrame:
    """(keys, start, last, n): runs of rows of which none follows the one before it by gap_ms or more; of a batch or of a stream with a watermark on ``at``."""
    at = "at" if "at" in rows.columns else F.timestamp_millis(ts)
    g = rows.groupBy(*keys, F.session_window(at, f"{gap_ms} milliseconds").alias("_w")).agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n"))
    return g.select(*keys, "start", "last", "n")


def retained(shards: DataFrame, keep_days: int, day: str = "day", key: str = "ticker", refuse: float = 0.25) -> DataFrame:
    """Shards with ``drop``: older than the newest keep_days. All are kept where that would drop more than a share of them."""
    r = shards.withColumn("_old", F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc(day))) > keep_days)
    share = r.agg(F.coalesce(F.avg(F.col("_old").cast("double")), F.lit(0.0)).alias("_s"))  # one row
    return r.withColumn("_one", F.lit(1)).join(F.broadcast(share.withColumn("_one", F.lit(1))), "_one").withColumn("drop", F.col("_old") & (F.col("_s") <= refuse)).drop("_old", "_s", "_one")


def trimmed(rows: DataFrame, n: int, ts: str = "bin_start_ms", key: str = "ticker") -> DataFrame:
    """The newest n rows of each key, whatever their values."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts)))).where(F.col("_r") <= n).drop("_r")


def vol_tail(rows: DataFrame, n: int, ts: str = "bin_start_ms", key: str = "ticker") -> DataFrame:
    """The newest n rows of each key, of which those with a bad sigma are dropped after the cut."""
    return trimmed(rows, n, ts, key).where(X.finite("sigma") & (F.col("sigma") >= 0))


def vol_appended(stored: DataFrame, new: DataFrame, keep: int | None = None, ts: str = "bin_start_ms", key: str = "ticker") -> DataFrame:
    """stored with the new rows that are later than its last one of their key; with keep only the newest so many of each."""
    last = stored.groupBy(key).agg(F.max(ts).alias("_l"))
    late = new.join(last, key, "left").where(F.col("_l").isNull() | (F.col(ts) > F.col("_l"))).select(*stored.columns)
    out = stored.unionByName(late)
    return out if keep is None else trimmed(out, keep, ts, key)


def last_in_quote(last: DataFrame, routes: DataFrame, storage: DataFrame, quote: str) -> DataFrame:
    """Last price of each asset in its storage quote (asset, quote, price), and in another quote by way of a route's rate.

    storage (asset, quote, ticker): where an asset's price is kept; routes (src, dst, rate). An asset without a route has no price there.
    """
    own = storage.join(last.select("ticker", F.col("mid").alias("price")), "ticker").select("asset", F.col("quote").alias("own_quote"), "price")
    r = routes.where(F.col("dst") == quote).select(F.col("src").alias("own_quote"), "rate")
    both = own.join(r, "own_quote", "left").withColumn("rate", F.when(F.col("own_quote") == quote, 1.0).otherwise(F.col("rate")))
    return both.select("asset", "own_quote", "price", F.lit(quote).alias("quote"), (F.col("price") * F.col("rate")).alias("quote_price"))


def admissible(tickers: DataFrame, assets: DataFrame, classes: tuple[int, ...] = tuple(range(16))) -> DataFrame:
    """Why a ticker is refused: shape (not spot, a sub-type, a class that isn't one of classes), base or quote; null if it is admitted.

    assets (asset_key, blacklisted). Which class numbers are defined isn't published in full, so they are a parameter.
    """
    t = tickers.withColumn("_b", X.asset_key(X.ticker_field("ticker_id", 56, 4), X.ticker_field("ticker_id", 40, 16))).withColumn("_q", X.asset_key(X.ticker_field("ticker_id", 36, 4), X.ticker_field("ticker_id", 20, 16)))
    a = assets.where("NOT blacklisted").select("asset_key")
    j = t.join(a.withColumnRenamed("asset_key", "_ba"), F.col("_b") == F.col("_ba"), "left").join(a.withColumnRenamed("asset_key", "_qa"), F.col("_q") == F.col("_qa"), "left")
    kinds = list(classes)
    shape = (X.ticker_field("ticker_id", 60, 4) != 0) | (X.ticker_field("ticker_id", 0, 20) != 0)
    shape = shape | ~X.ticker_field("ticker_id", 56, 4).isin(kinds) | ~X.ticker_field("ticker_id", 36, 4).isin(kinds)
    return j.withColumn("refusal", F.when(shape, "shape").when(F.col("_ba").isNull(), "base").when(F.col("_qa").isNull(), "quote")).drop("_b", "_q", "_ba", "_qa")


def blacklisted(assets: DataFrame, names: list[str]) -> DataFrame:
    """Adds blacklisted: a listed name, alias or id, whatever the case."""
    low = [n.lower() for n in names]
    hit = F.lower("name").isin(low) | F.exists("aliases", lambda x: F.lower(x).isin(low)) | F.col("asset_id").cast("string").isin(low)
    return assets.withColumn("blacklisted", F.coalesce(hit, F.lit(False)))


def orientation(pairs: DataFrame, storage_quote: dict[str, str], default: str = "USDT", fiats: tuple[str, ...] = ("EUR", "GBP", "AUD", "NZD")) -> DataFrame:
    """stored: true if the pair's quote is its base's storage quote, false for a dollar base against a fiat, null for a cross."""
    quote = F.lit(default)
    for b, q in storage_quote.items():
        quote = F.when(F.col("base") == b, q).otherwise(quote)
    return pairs.withColumn("stored", F.when(F.col("quote") == quote, True).when((F.col("base") == "USD") & ~F.col("quote").isin(*fiats), False))


def without_excluded(df: DataFrame, providers: tuple[int, ...] = X.EXCLUDED_PROVIDERS) -> DataFrame:
    return df.where(~F.col("provider").isin(*providers))


def pegged_pairs(pairs: DataFrame, pegged: tuple[str, ...]) -> DataFrame:
    """Adds pegged: both legs are in the list, whatever the case. Null legs aren't."""
    low = [x.lower() for x in pegged]
    return pairs.withColumn("pegged", F.coalesce(F.lower("base").isin(low) & F.lower("quote").isin(low), F.lit(False)))


def routed_days(bars: DataFrame, kind: str, ts: str = "close_ts") -> DataFrame:
    """Bars with the day they are stored under: s10 bars by 2 s before their time, renko by 4 s, others by their own."""
    shift = {"s10": 2_000, "renko": 4_000}.get(kind, 0)
    return bars.withColumn("dt", F.to_date(F.timestamp_millis(F.col(ts) - shift)))


def without_synthetic(bricks: DataFrame) -> DataFrame:
    """Bricks that a tick completed, without those that only filled up a move."""
    return bricks.where(~X.has_flag("flags", X.BAR_FLAGS["RENKO_SYNTHETIC"]))
