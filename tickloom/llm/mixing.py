"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

A source's target is its weight's part of the total, but at most MAX_EPOCHS times its size; what a capped source can't take
goes to the others by weight until none is above. That fixed point is min(level * weight, cap) for one level, found from the
sources sorted by cap / weight. A source is then taken whole as often as its target holds it, and the rest is the beginning
of its documents in a seeded random order, as long as each next document brings the taken size nearer to the target.

No source is sorted in one task: documents fall into BUCKETS slices of the random order, a slice's size is summed, and only
the one slice of each source in which the target ends is ordered document by document.

Defined results: size is the number of words; a null or blank text has size 0 and is never needed for a target. Null is a
source of its own, after all others. The order is by md5 of seed and id, then id, then size, so reruns agree; repeated rows
share a place and are taken one after another. Other columns are carried, whatever their names. An empty table gives an
empty mix; a source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE_RE, trimmed, written

WEIGHTS = (5, 2, 1)
TOTAL_PERCENT = 150
MAX_EPOCHS = 2
SEED = "mix-1"
BUCKETS = 4096
#: Up to so many rows of a plan go to every executor (41 MB at the 164 bytes a row that were measured); beyond that it is joined by shuffle.
BROADCAST_ROWS = 250_000


def n_words(text) -> F.Column:  # noqa: ANN001
    """Words in a text: one more than the runs of white space inside it."""
    inner = trimmed(text)
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACE_RE))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, percent: float = TOTAL_PERCENT, epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, so these windows are small."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cut = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("weight", F.get(cut, (F.row_number().over(order) - 1) % len(weights))).withColumn("cap", F.col("source_size") * float(epochs))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = (
        w.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("goal", F.sum("source_size").over(everything) * percent / 100)
        .withColumn("level", (F.col("goal") - F.col("capped")) / F.col("open"))
    )
    # the first source that the level of those from it on doesn't fill; none: every source is at its cap
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"]
    return w.withColumn("at", free).select("source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))


def mixed(docs: DataFrame, source: str = "source", text: str = "text", id_col: str = "doc_id", seed: str = SEED, weights: tuple[float, ...] = WEIGHTS, percent: float = TOTAL_PERCENT, epochs: float = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, h, size, source_size, target, repeats, taken) of every row of docs; h is a hash of the text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(F.col(text).cast("string")).alias("h"), n_words(F.col(text)).alias("size"))
    rows = rows.withColumn("place", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    rows = rows.withColumn("slice", F.conv(F.substring("place", 1, 8), 16, 10).cast("long") % BUCKETS)
    rows = written(rows, "sizes")
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    sizes = slices.groupBy("source").agg(F.sum("n").alias("source_size"))
    aims = targets(sizes, weights, percent, epochs)
    aims = aims.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    aims = written(aims, "aims")
    # at most BUCKETS rows a source
    run = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    begun = slices.withColumn("begun", F.coalesce(F.sum("n").over(run), F.lit(0)))
    a, b = begun.alias("a"), aims.alias("b")
    plan = written(a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "slice", "begun", "n", "source_size", "target", "whole", "rest"), "plan")
    r, p = rows.alias("r"), plan.alias("p")
    both = r.join(p, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.slice") == F.col("p.slice"))).select("r.doc_id", "r.source", "r.h", "size", "place", "begun", "n", "source_size", "target", "whole", "rest")
    edge = (F.col("begun") < F.col("rest")) & (F.col("begun") + F.col("n") > F.col("rest"))
    inside = both.where(~edge).withColumn("more", (F.col("begun") + F.col("n") <= F.col("rest")).cast("long"))
    upto = Window.partitionBy("source").orderBy("place", "doc_id", "size", "h").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.where(edge).withColumn("before", F.col("begun") + F.coalesce(F.sum("size").over(upto), F.lit(0))).withColumn("more", (F.col("before") + F.col("size") / 2 <= F.col("rest")).cast("long")).drop("before")
    out = inside.unionByName(ends).withColumn("repeats", F.when(F.col("source_size") > 0, F.col("whole") + F.col("more")).otherwise(0))
    return out.select("doc_id", "source", "h", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def repeated(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The mix itself: each document as often as it is taken, with docs' own columns whatever their names.

    Rows that agree in id, source and text are numbered, and take the places that the plan has for them in its order.
    """
    same = Window.partitionBy("doc_id", "source", "h")
    plan = written(mixed(docs, **options).select("doc_id", "source", "h", "repeats"), "repeats")
    each = plan.groupBy("doc_id", "source", "h").agg(F.count("*").alias("rows"), F.sum("repeats").alias("n")).where("n > 0")
    each = written(each, "taken")
    # docs' columns travel as one, so that none of their names can clash
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("i"), F.col("source").alias("s"), F.xxhash64(F.col("text").cast("string")).alias("x")).alias("d")
    side = F.broadcast(each) if each.count() <= BROADCAST_ROWS else each
    p = side.alias("p")
    both = d.join(p, F.col("d.i").eqNullSafe(F.col("p.doc_id")) & F.col("d.s").eqNullSafe(F.col("p.source")) & (F.col("d.x") == F.col("p.h"))).select("d.row", "p.rows", "p.n", "p.doc_id", "p.source", "p.h")
    if each.where("rows > 1").isEmpty():
        taken = both
    else:
        # n copies are dealt out over that many equal rows: the first n % rows of them take one more
        nth = F.row_number().over(same.orderBy(F.to_json("row")))
        many = both.where("rows > 1").withColumn("n", F.floor(F.col("n") / F.col("rows")) + (nth <= F.col("n") % F.col("rows")).cast("long"))
        taken = both.where("rows = 1").unionByName(many.where("n > 0"))
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k")).select("row.*")


def query(spark, sf_dir):  # noqa: ANN001, ANN201
    from .shared import table

    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
k AS (SELECT source, source_size, 2.0 * source_size AS cap, CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open, sum(source_size) OVER () * 1.5 AS goal FROM k),
v AS (SELECT *, (goal - capped) / open AS level FROM o),
f AS (SELECT arg_min(level, cap / weight) AS lvl FROM v WHERE level * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN lvl IS NULL THEN cap ELSE least(lvl * weight, cap) END AS target FROM v, f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, CAST(r.source_size AS BIGINT) AS source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY CAST(('0x' || substr(d.place, 1, 8)) AS BIGINT) % 4096, d.place, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(d.size) OVER (PARTITION BY d.source, CAST(('0x' || substr(d.place, 1, 8)) AS BIGINT) % 4096) AS n,
  CAST(('0x' || substr(d.place, 1, 8)) AS BIGINT) % 4096 AS slice, d.source FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
b AS (SELECT *, min(before) OVER (PARTITION BY source, slice) AS begun FROM c)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size > 0 THEN size * (whole + CASE WHEN begun < rest AND begun + n > rest THEN (before + size / 2.0 <= rest)::INT ELSE (begun + n <= rest)::INT END) ELSE 0 END AS BIGINT) AS taken FROM b
"""
