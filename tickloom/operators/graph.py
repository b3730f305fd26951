"""Cross-rate routes over the graph of live pairs: hop-wise joins, never more than three."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

MAX_HOPS = 3


def edges(primaries: DataFrame, volumes: DataFrame | None = None) -> DataFrame:
    """primaries (sym, base, quote, ticker_id) to directed edges (src, dst, sym, exp, ticker_id, volume); self-pairs are dropped."""
    p = primaries if volumes is None else primaries.join(volumes, "sym", "left")
    v = F.coalesce(F.col("volume"), F.lit(0.0)) if volumes is not None else F.lit(0.0)
    p = p.where("base <> quote")
    one = p.select(F.col("base").alias("src"), F.col("quote").alias("dst"), "sym", F.lit(1).alias("exp"), "ticker_id", v.alias("volume"))
    return one.unionByName(p.select(F.col("quote").alias("src"), F.col("base").alias("dst"), "sym", F.lit(-1).alias("exp"), "ticker_id", v.alias("volume")))


def pegged(e: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Edges between underlyings: wrapped assets are replaced by what they wrap."""
    if aliases is None:
        return e
    a = aliases.select(F.col("wrapped").alias("_w"), F.col("underlying").alias("_u"))
    for c in ("src", "dst"):
        e = e.join(a, F.col(c) == F.col("_w"), "left").withColumn(c, F.coalesce("_u", c)).drop("_w", "_u")
    return e.where("src <> dst")


def routes(e: DataFrame, barred: DataFrame | None = None, hops: int = MAX_HOPS) -> DataFrame:
    """(src, dst, hops, bottleneck, legs): for each ordered pair the fewest legs, then the deepest bottleneck, then the least symbols.

    barred (src, dst, ticker_id): a pair's own ticker must not serve it. Fewest legs come first, so a pair that is served is
    out of the later hops: the last hop writes out only paths to pairs that nothing shorter serves.
    """
    step = e.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.struct("sym", "exp", "ticker_id").alias("_leg"), F.col("volume").alias("_v"))
    path = e.select("src", "dst", F.array("src", "dst").alias("seen"), F.array(F.struct("sym", "exp", "ticker_id")).alias("legs"), F.col("volume").alias("bottleneck"))
    name = F.transform("legs", lambda x: x["sym"])
    best = Window.partitionBy("src", "dst").orderBy(F.desc("bottleneck"), name)
    served = None
    for hop in range(1, hops + 1):
        if hop > 1:
            more = path.join(step, F.col("dst") == F.col("_s")).where(~F.array_contains("seen", F.col("_d")))
            path = more.select("src", F.col("_d").alias("dst"), F.concat("seen", F.array("_d")).alias("seen"), F.concat("legs", F.array("_leg")).alias("legs"), F.least("bottleneck", "_v").alias("bottleneck"))
        new = path if served is None else path.join(served.select("src", "dst"), ["src", "dst"], "left_anti")
        if barred is not None:
            b = barred.select(F.col("src").alias("_bs"), F.col("dst").alias("_bd"), F.col("ticker_id").alias("_bt"))
            new = new.join(b, (F.col("src") == F.col("_bs")) & (F.col("dst") == F.col("_bd")), "left").where(F.col("_bt").isNull() | ~F.exists("legs", lambda x: x["ticker_id"] == F.col("_bt"))).drop("_bs", "_bd", "_bt")
        new = new.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("src", "dst", F.size("legs").alias("hops"), "bottleneck", "legs")
        served = new if served is None else served.unionByName(new)
    return served


def servable(e: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """All ordered pairs within so many hops."""
    reach = e.select("src", "dst").distinct()
    step = reach.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
    now = reach
    for _ in range(hops - 1):
        now = now.join(step, F.col("dst") == F.col("_s")).where("src <> _d").select("src", F.col("_d").alias("dst")).distinct()
        reach = reach.unionByName(now)
    return reach.distinct()


def expanded(assets: DataFrame, primaries: DataFrame, storage_quote: str = "USD", known: DataFrame | None = None) -> DataFrame:
    """Directed pairs (base, quote) of an asset list that are neither live themselves nor quoted in the storage quote.

    known (asset): with it, assets that can't be resolved are left out. The list is small: its square is the result.
    """
    a = assets.select(F.col("asset").alias("base")).distinct()
    a = a if known is None else a.join(known.select(F.col("asset").alias("base")), "base", "left_semi")
    both = a.join(a.select(F.col("base").alias("quote")), F.col("base") != F.col("quote")).where(F.col("quote") != storage_quote)
    return both.join(primaries.select("base", "quote"), ["base", "quote"], "left_anti")


def composed(paths: DataFrame, quotes: DataFrame) -> DataFrame:
    """Confidence axes of a route's quote: oldest age (null if unknown), root-sum-square ci (0 if any is 0), least accepted, all fresh."""
    legs = paths.select("src", "dst", F.explode("legs").alias("leg")).select("src", "dst", "leg.sym", "leg.exp")
    g = legs.join(quotes, "sym").groupBy("src", "dst").agg(
        F.when(F.count("age") == F.count("*"), F.max("age")).alias("age"),
        F.when(F.min("ci") == 0, 0).otherwise(X.ci_encode(F.sqrt(F.sum(F.pow(X.ci_decode("ci"), F.lit(2.0)))))).alias("ci"),
        F.min("accepted").alias("accepted"),
        F.bool_and("fresh").alias("fresh"),
    )
    return g


def token_assets(primaries: DataFrame, registry: DataFrame) -> DataFrame:
    """token to asset: a registered spelling first, then the asset with most edges, then the least id."""
    uses = primaries.select(F.explode(F.array(F.struct(F.col("base").alias("token"), F.col("base_asset").alias("asset")), F.struct(F.col("quote").alias("token"), F.col("quote_asset").alias("asset")))).alias("u")).select("u.*")
    n = uses.groupBy("token", "asset").agg(F.count("*").alias("n")).join(registry.select("token", "asset", F.lit(1).alias("own")), ["token", "asset"], "left")
    best = Window.partitionBy("token").orderBy(F.col("own").isNull(), F.desc("n"), "asset")
    return n.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("token", "asset")


def rebased(tickers: DataFrame, aliases: DataFrame) -> DataFrame:
    """tickers (ticker_id) with wrapped bases replaced, their quotes kept: adds alias_id; aliases (wrapped, underlying) hold asset keys."""
    key = X.asset_key(X.ticker_field("ticker_id", 56, 4), X.ticker_field("ticker_id", 40, 16))
    j = tickers.withColumn("_k", key).join(aliases, F.col("_k") == F.col("wrapped"), "left")
    u = F.coalesce("underlying", "_k")
    new = X.make_ticker(X.ticker_field("ticker_id", 60, 4), F.shiftright(u, 16), u.bitwiseAND(F.lit(65535)), X.ticker_field("ticker_id", 36, 4), X.ticker_field("ticker_id", 20, 16), X.ticker_field("ticker_id", 0, 20))
    return j.withColumn("alias_id", new).drop("_k", "wrapped", "underlying")
