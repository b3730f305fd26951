"""Descriptive statistics and the latency histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def describe(df: DataFrame, key: str, value: str, q: float = 0.7) -> DataFrame:
    """mean, sample deviation, median, a percentile and the median absolute deviation, exact; 0 where undefined."""
    m = df.groupBy(key).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_dev"), F.median(value).alias("median"), F.percentile(value, F.lit(min(max(q, 0.0), 1.0))).alias("percentile"))
    d = df.select(F.col(key).alias("_k"), F.col(value).alias("_x")).join(m.select(F.col(key).alias("_k"), F.col("median").alias("_m")), "_k").groupBy("_k").agg(F.median(F.abs(F.col("_x") - F.col("_m"))).alias("mad"))
    return m.join(d, F.col(key) == F.col("_k")).drop("_k")


def lag_histogram(df: DataFrame, key: str, ms: str) -> DataFrame:
    """(key, bucket, n, worst) in sixteen power-of-two buckets."""
    return df.groupBy(key, X.lag_bucket(ms).alias("bucket")).agg(F.count("*").alias("n"), F.max(ms).alias("worst"))


def merged(*histograms: DataFrame) -> DataFrame:
    out = histograms[0]
    for h in histograms[1:]:
        out = out.unionByName(h)
    key = histograms[0].columns[0]
    return out.groupBy(key, "bucket").agg(F.sum("n").alias("n"), F.max("worst").alias("worst"))


def since(now: Column, before: Column) -> Column:
    """Growth of an array of counts; if any shrank the counter began anew and all of it is new."""
    shrunk = F.exists(F.zip_with(now, before, lambda a, b: a < b), lambda x: x)
    return F.when(shrunk, now).otherwise(F.zip_with(now, before, lambda a, b: a - b))


def lag_quantile(histogram: DataFrame, key: str, q: float) -> DataFrame:
    """Upper edge of the bucket that holds the q-th latency, at most the worst one seen."""
    w = Window.partitionBy(key)
    h = histogram.withColumn("_c", F.sum("n").over(w.orderBy("bucket"))).withColumn("_t", F.sum("n").over(w)).withColumn("_w", F.max("worst").over(w))
    hit = h.where(F.col("_c") >= F.ceil(F.col("_t") * q))
    edge = F.least(F.pow(F.lit(2.0), F.col("bucket")).cast("long") - 1, F.col("_w"))
    return hit.groupBy(key).agg(F.min_by(edge, "bucket").alias("quantile"))


