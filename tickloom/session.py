"""Session settings, table access and the worker path."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "tickloom", **conf: str) -> SparkSession:
    """A session as this library likes it: UTC, adaptive execution, Arrow. Cluster sizes are left to spark-submit."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local master, whose executors are the driver, gets one made where none is named."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tickloom-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and a lost executor costs a re-read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by the hash of keys in as many partitions as shuffles have, however few bytes they hold: what works on them is Python, and slow."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where only the driver has it on its path (local runs, tests)."""
    here = str(Path(__file__).resolve().parents[1])
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (here, path)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_of(table(spark, sf_dir, "events"))


def stream_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same quotes as a stream over the table's file."""
    kind = table(spark, sf_dir, "events").schema
    return ticks_of(spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def ticks_of(events: DataFrame) -> DataFrame:
    """An events table as quotes: five tickers, eight providers, a clock pressed together a hundredfold in tc_ms."""
    ms = F.expr("unix_date(to_date(ts)) * 86400000L + hour(ts) * 3600000L + minute(ts) * 60000L + cast(floor(extract(SECOND FROM ts) * 1000) AS BIGINT)")
    e = events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("ticker"), (F.col("user_id") % 8).alias("provider"), ms.alias("ts_ms"), "value")
    base, h = 100 + F.col("value") / 10, (F.col("seq") % 7) * 0.00005
    return e.select(
        "seq",
        "ticker",
        "provider",
        "ts_ms",
        (F.lit(1704067200000) + F.floor((F.col("ts_ms") - 1704067200000) / 100)).alias("tc_ms"),
        (base * (1 - h)).alias("bid"),
        (base * (1 + h)).alias("ask"),
        ((base * (1 - h) + base * (1 + h)) * 0.5).alias("mid"),
        F.floor("value").cast("long").alias("vbid"),
        (F.col("seq") % 97).alias("vask"),
        (F.col("seq") % 512).cast("int").alias("ci"),
        (1 + F.col("seq") % 4).alias("accepted"),
        F.when(F.col("seq") % 11 == 0, 1).otherwise(0).cast("long").alias("rejected"),
        "value",
    )


#: The same view for DuckDB; queries put their own text behind it.
TICKS_SQL = """WITH e AS (SELECT event_id AS seq, event_type AS ticker, user_id % 8 AS provider, epoch_us(ts) // 1000 AS ts_ms, value, 100 + value / 10 AS base, (event_id % 7) * 0.00005 AS h FROM events),
ticks AS (SELECT seq, ticker, provider, ts_ms, 1704067200000 + (ts_ms - 1704067200000) // 100 AS tc_ms, base * (1 - h) AS bid, base * (1 + h) AS ask, (base * (1 - h) + base * (1 + h)) * 0.5 AS mid,
  CAST(floor(value) AS BIGINT) AS vbid, seq % 97 AS vask, seq % 512 AS ci, 1 + seq % 4 AS accepted, CASE WHEN seq % 11 = 0 THEN 1 ELSE 0 END AS rejected, value FROM e)"""
