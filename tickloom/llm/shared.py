"""What the corpus operators share: the tables' words as SQL expressions, and tables cut from their lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship, table

#: White space as every operator here sees it: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def trimmed(text: Column) -> Column:
    """text without white space at its ends; a null text is empty."""
    return F.trim(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACE))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for a null or blank text."""
    inner = trimmed(text)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RE))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else, whatever the locale or script."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Narrow rows in a file of a table whose size is known beforehand, about.
FILE_ROWS = 1_000_000


def written(df: DataFrame, name: str, rows: int | None = None, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs a re-read.

    rows: how many it has at most, about. Few rows then make few files, however many partitions a shuffle has: on a local file
    system an executor starts three processes for each file it writes (chmod).
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.repartition(1 + rows // FILE_ROWS)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, n: int, key: str) -> DataFrame:
    """df as written, in n buckets by key: tables bucketed alike are joined where they are."""
    spark = df.sparkSession
    table = f"tickloom_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n, key).option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def let_go(*tables: DataFrame) -> None:
    """Removes tables that nothing reads any more, and shuffles that nobody refers to."""
    spark = tables[0].sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = shared_dir(spark)
    for df in tables:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for name in {f.rsplit("/", 1)[1] for f in folders}:
            if name.startswith("tickloom_"):
                spark.sql(f"DROP TABLE IF EXISTS `{name}`")
            path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
            path.getFileSystem(conf).delete(path, True)
    jvm.System.gc()


#: A key that this part of all rows or more have is a hot one; there are at most so many.
HOT_PARTS = 20_000
#: Longer keys than this many bytes aren't sent to every executor, so hot ones take 5 MB at most besides the columns beside them.
HOT_KEY_BYTES = 255


def looked_up(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows with the other columns of table, whose key is unique and in which weight is how many of the total rows have it.

    Rows of hot keys meet a broadcast of at most HOT_PARTS rows where they are; only the others are dealt out by key. Nulls match
    nulls; a row whose key the table hasn't goes.
    """
    hot = (F.col(weight) * HOT_PARTS >= total) & F.coalesce(F.octet_length(F.col(key).cast("string")) <= HOT_KEY_BYTES, F.lit(True))
    names = [c for c in table.columns if c not in (key, weight)]
    few, many = (table.where(c).select(F.col(key).alias("_key"), *names) for c in (hot, ~hot))
    same = F.col(key).eqNullSafe(F.col("_key"))
    columns = [*rows.columns, *names]
    near = rows.join(F.broadcast(few), same).select(columns)
    far = rows.join(F.broadcast(few.select("_key")), same, "left_anti").join(many, same).select(columns)
    return near.unionByName(far)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many rows for Python workers, where a row is some MB; jobs that run inside are bound by it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


__all__ = ["SPACE", "SPACE_RE", "arrow_batches", "bucketed", "let_go", "looked_up", "lower_ascii", "partitions", "shared_dir", "ship", "table", "trimmed", "words", "written"]
