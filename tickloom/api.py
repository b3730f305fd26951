"""The fluent range API, and the domain functions for SQL users.

    Market(spark, {"idx": ticks, "kline": bars}).get().history().pair("BTC/USDT").idx().start(t0).end(t1).limit(100).fetch()

Setters can come in any order; fetch() builds one lazy DataFrame. cursor is an exclusive lower bound on time, for paging.
"""

from __future__ import annotations

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .functions import exprs as X
from .operators import ranges as R

KINDS = ("idx", "kline", "renko", "ohlc")
TIME = {"idx": "ts_ms", "kline": "bar_ts", "renko": "ts", "ohlc": "bar_ts"}


@dataclass(frozen=True)
class History:
    market: Market
    symbol: str | None = None
    kind: str = "renko"
    quote: str = "USDT"
    lo: int | None = None
    hi: int | None = None
    after: int | None = None
    most: int | None = None

    def pair(self, symbol: str, quote: str | None = None) -> History:
        """A/B, A-B, A_B or a bare base; a quote that is given wins."""
        for sep in "/_-":
            if symbol.count(sep) == 1:
                base, own = symbol.split(sep)
                return replace(self, symbol=base, quote=quote or own)
        return replace(self, symbol=symbol, quote=quote or self.quote)

    def idx(self) -> History:
        return replace(self, kind="idx")

    def kline(self) -> History:
        return replace(self, kind="kline")

    def renko(self) -> History:
        return replace(self, kind="renko")

    def ohlc(self) -> History:
        return replace(self, kind="ohlc")

    def start(self, ms: int) -> History:
        return replace(self, lo=ms)

    def end(self, ms: int) -> History:
        return replace(self, hi=ms)

    def cursor(self, ms: int) -> History:
        return replace(self, after=ms)

    def limit(self, n: int) -> History:
        return replace(self, most=n)

    def fetch(self) -> DataFrame:
        df, ts = self.market.tables[self.kind], TIME[self.kind]
        ts = ts if ts in df.columns else "tc_ms"
        if self.symbol is not None:
            names = [f"{self.symbol}/{self.quote}", self.symbol]
            df = df.where(F.col("ticker").isin(names))
        df = R.in_range(df, ts, self.lo, self.hi, self.after).orderBy(ts, *(["seq"] if "seq" in df.columns else []))
        return df if self.most is None else df.limit(self.most)


class Market:
    """Named tables of a store: idx, kline, renko, ohlc."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]) -> None:
        self.spark, self.tables = spark, tables

    def get(self) -> Market:
        return self

    def history(self) -> History:
        return History(self)

    def last(self, tickers: list[str] | None = None) -> DataFrame:
        df = self.tables["idx"]
        ts = "ts_ms" if "ts_ms" in df.columns else "tc_ms"
        return R.last_per_key(df if tickers is None else R.idents(df, tickers), ts)

    def coverage(self, kind: str = "idx") -> DataFrame:
        return R.coverage(self.tables[kind], TIME[kind])


def register(spark: SparkSession) -> None:
    """SQL names: tl_jaro_winkler, and the table functions tl_idx_records, tl_bar_records, tl_tick_records and tl_vol_records of bytes.

    A null or torn blob gives its whole records.
    """
    from .operators.resolve import jaro_winkler
    from .sources import codec

    @F.pandas_udf("double")
    def jw(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)])

    def records(kind: str):  # noqa: ANN202
        class Records:
            def eval(self, data: bytes):  # noqa: ANN202
                for row in codec.decode(kind, bytes(data or b""), strict=False).itertuples(index=False):
                    yield tuple(v.item() if hasattr(v, "item") else v for v in row)

        return udtf(Records, returnType=codec.schema(kind))

    spark.udf.register("tl_jaro_winkler", jw)
    for kind in codec.LAYOUTS:
        spark.udtf.register(f"tl_{kind}_records", records(kind))


__all__ = ["History", "Market", "X", "register"]
