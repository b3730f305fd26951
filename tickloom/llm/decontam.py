"""Benchmark decontamination in DataFrame operations only: SimHash windows, multi-index Hamming blocks, exact confirmation.

A document's windows are as long as the item they are held against. Window and item are multisets of K-word shingles, lower
case; their similarity is the weighted Jaccard index, a shingle's weight being how often it stands there.

1. At similarity t a window of a shingles and an item of b share at least t / (1 + t) * (a + b), wherever they stand. So document
   shingles are looked up among the items', and every window that holds so many of one item's shingles is proposed, in
   whatever order they stand. Nothing that can reach the threshold is left out.
2. Each proposed window and each item gets a 64-bit SimHash. Within RADIUS bits, one of the five blocks differs in at most
   RADIUS // 5 bits, so items are indexed under every such variant of every block and windows look up their own blocks:
   all fingerprints within the radius are found. Some 378 of 8,192 values of a block are an item's. At similarity 0.8 to 0.86
   fingerprints of two texts are further apart than RADIUS in 2 of 21,000 trials (tests/llm measures it).
3. Candidates are confirmed by their exact similarity, at a cost linear in their length.

Defined results: a null or blank text or item has no windows. An item of fewer than K words is one shingle, its whole
sequence. A document shorter than an item is one window. Repeated rows give equal results once; ties go to the earliest
window. Null ids are kept. Other columns are not read. Empty tables give no rows. Words are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import words, written

K = 5
PERCENT = 80
RADIUS = 19
WIDTHS = (13, 13, 13, 13, 12)
#: Up to so many rows or windows of some 40 to 100 bytes go to every executor whole (50 MB); beyond that tables are joined by shuffle.
BROADCAST_ROWS = 500_000

FLIPS = [0] + [sum(1 << b for b in c) for n in range(1, RADIUS // len(WIDTHS) + 1) for c in combinations(range(max(WIDTHS)), n)]
SIMHASH = "aggregate(sequence(0, 63), 0L, (a, b) -> a | shiftleft(if(2 * size(filter(s, x -> getbit(x, b) = 1)) > size(s), 1L, 0L), b))"
#: What stands more than once in a sorted array, and the shingles in common, each as often as both have it.
TWICE = "array_distinct(filter({0}, (x, i) -> x = get({0}, i - 1)))"
COMMON = "size(array_intersect(s, t)) + aggregate(array_intersect(s2, t2), 0, (a, v) -> a - 1 + least(size(filter(s, x -> x = v)), size(filter(t, x -> x = v))))"


def _shingles(w: str, n: str, k: int) -> Column:
    """Hashes of the k-word shingles of an array of words, in order."""
    at = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
    return F.when(F.col(n) < k, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.col(n) - k), at))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _blocks(df: DataFrame, flips: list[int]) -> DataFrame:
    """df once for each block and variant of its fingerprint f."""
    begins = [sum(WIDTHS[:b]) for b in range(len(WIDTHS))]
    keys = F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned("f", at).bitwiseAND(F.lit((1 << w) - 1)).alias("value"), F.lit(1 << w).alias("values")) for b, (at, w) in enumerate(zip(begins, WIDTHS, strict=True))])
    df = df.select("*", F.inline(keys))
    if len(flips) > 1:
        df = df.withColumn("flip", F.explode(F.array(*[F.lit(v).cast("long") for v in flips]))).where("flip < values").withColumn("value", F.col("value").bitwiseXOR(F.col("flip"))).drop("flip")
    return df.drop("values")


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text", with_hash: bool = False) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words, distance): each document and item with the best window at or above the threshold."""
    items = benchmark.select("item_id", words(F.lower(F.col("text").cast("string"))).alias("w"))
    # a table of its own, so that the filters below don't split the texts again
    items = written(items.select("item_id", "w", F.size("w").alias("n"), F.least(F.lit(k), F.size("w")).alias("k")), "words").where("n > 0")
    widths = sorted(r["k"] for r in items.select("k").distinct().collect())  # k values at most
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    out = None
    for width in widths:
        found = _leaks(docs, items.where(F.col("k") == width), width, percent, with_hash)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.select("doc_id", *["h"][: int(with_hash)], F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.lit(0).alias("distance")).limit(0)
    return out


def _leaks(docs: DataFrame, items: DataFrame, k: int, percent: int, with_hash: bool) -> DataFrame:
    items = written(items.withColumn("s", _shingles("w", "n", k)).withColumn("f", F.expr(SIMHASH)).select("item_id", "n", "s", "f"), "items")
    anchors = written(items.select("item_id", F.xxhash64("s").alias("item_h"), F.explode("s").alias("g"), F.col("n").alias("len")).distinct(), "anchors")

    tokens = docs.withColumn("w", words(F.lower("text"))).withColumn("n", F.size("w"))
    # outer: else a filter on the array's size is pushed below, which would split the text again for every shingle
    places = tokens.withColumn("s", _shingles("w", "n", k)).select("doc_id", "h", "n", F.posexplode_outer("s").alias("pos", "g"))
    hits = places.join(_small(anchors, anchors.count()), "g").groupBy("doc_id", "h", "item_id", "item_h", "len", "n").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    # shingles of the item, of a window, and the least that they share at the threshold
    hits = hits.withColumn("b", F.col("len") - (k - 1)).withColumn("a", F.least("b", F.col("n") - (k - 1)))
    hits = hits.withColumn("need", F.ceil((F.col("a") + F.col("b")) * percent / (100 + percent) - 1e-9).cast("int")).where(F.size("p") >= F.col("need"))
    # a window with so many of the positions has some p[i] first and p[i + need - 1] in it as well
    runs = F.expr("transform(slice(p, 1, size(p) - need + 1), (x, i) -> struct(greatest(0, p[i + need - 1] - a + 1) as lo, least(x, greatest(0, n - len)) as hi))")
    runs = hits.select("doc_id", "h", "len", F.inline(runs)).where("lo <= hi").distinct()
    starts = runs.select("doc_id", "h", "len", F.explode(F.sequence("lo", "hi")).alias("start"))
    starts = written(starts.groupBy("doc_id", "h").agg(F.collect_set(F.struct("len", "start")).alias("windows")), "windows")

    rows = starts.agg(F.coalesce(F.sum(F.size("windows") + 2), F.lit(0))).first()[0]
    d, s = docs.alias("d"), _small(starts, rows).alias("s")
    texts = d.join(s, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.h") == F.col("s.h"))).select("d.doc_id", "d.h", "text", "windows")
    texts = texts.withColumn("w", words(F.lower("text"))).withColumn("n", F.size("w")).withColumn("all", _shingles("w", "n", k)).select("doc_id", "h", "all", F.inline("windows"))
    windows = texts.select("doc_id", "h", "len", "start", F.slice("all", F.col("start") + 1, F.col("len") - (k - 1)).alias("s"))
    windows = written(windows.withColumn("f", F.expr(SIMHASH)).distinct(), "fingerprints")

    left = _blocks(windows.select("doc_id", "h", "len", "start", "f"), [0])
    right = _blocks(items.select("item_id", F.col("n").alias("len"), F.col("f")), FLIPS).withColumnRenamed("f", "item_f")
    pairs = left.join(written(right, "index"), ["len", "block", "value"])
    distance = F.bit_count(F.col("f").bitwiseXOR(F.col("item_f"))).cast("int")
    pairs = pairs.select("doc_id", "h", "len", "start", "item_id", distance.alias("distance")).where(F.col("distance") <= RADIUS).distinct()
    p, w = pairs.alias("p"), windows.alias("w")
    same = F.col("p.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("p.h") == F.col("w.h")) & (F.col("p.len") == F.col("w.len")) & (F.col("p.start") == F.col("w.start"))
    both = p.join(w, same).select("p.*", "w.s")
    i = items.select(F.col("item_id").alias("i"), F.col("s").alias("t")).alias("i")
    both = both.join(i, F.col("item_id").eqNullSafe(F.col("i")))
    both = both.withColumns({"s1": F.sort_array("s"), "t1": F.sort_array("t")}).withColumns({"s2": F.expr(TWICE.format("s1")), "t2": F.expr(TWICE.format("t1"))}).withColumn("common", F.expr(COMMON))
    total = F.size("s") + F.size("t") - F.col("common")
    good = both.where(100 * F.col("common") >= percent * total).withColumn("similarity", F.col("common") / total)
    who = ["doc_id", "h", "item_id"] if with_hash else ["doc_id", "item_id"]
    best = good.groupBy(*who).agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"), "len", "distance")).alias("b"))
    return best.select(*who, "b.similarity", (-F.col("b.start")).alias("start_word"), F.col("b.len").alias("n_words"), "b.distance")


def clean(docs: DataFrame, benchmark: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """The documents without a leaked item, with docs' own columns whatever their names. A leak takes rows of its id and text only."""
    bad = written(leaks(docs, benchmark, k, percent, with_hash=True).select("doc_id", "h").distinct(), "leaked")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("i"), F.xxhash64(F.col("text").cast("string")).alias("x")).alias("d")
    b = _small(bad, bad.count()).alias("b")
    return d.join(b, F.col("d.i").eqNullSafe(F.col("b.doc_id")) & (F.col("d.x") == F.col("b.h")), "left_anti").select("row.*")


def query(spark, sf_dir):  # noqa: ANN001, ANN201
    from .shared import table

    rows = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "item_id", F.round("similarity", 9).alias("similarity"), "start_word", "n_words")


ORACLE = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
bs AS (SELECT item_id, len(w) AS n, o, array_to_string(w[o + 1:o + 5], ' ') AS g FROM (SELECT item_id, w, unnest(range(0, len(w) - 4)) AS o FROM b)),
ds AS (SELECT doc_id, len(w) AS n, p, array_to_string(w[p + 1:p + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS p FROM d)),
h AS (SELECT DISTINCT ds.doc_id, bs.item_id, bs.n AS len, ds.n, p - o AS base FROM ds JOIN bs USING (g)),
s AS (SELECT DISTINCT doc_id, item_id, len, greatest(0, least(base + e, n - len)) AS start FROM h, (SELECT unnest(range(-60, 61)) AS e) AS shifts),
wc AS (SELECT s.doc_id, s.item_id, s.len, s.start, ds.g, count(*) AS c FROM s JOIN ds ON ds.doc_id = s.doc_id AND ds.p BETWEEN s.start AND s.start + s.len - 5 GROUP BY ALL),
wt AS (SELECT doc_id, item_id, len, start, sum(c) AS total FROM wc GROUP BY ALL),
bc AS (SELECT item_id, n, g, count(*) AS c FROM bs GROUP BY ALL),
j AS (SELECT wc.doc_id, wc.item_id, wc.len, wc.start, sum(least(wc.c, bc.c)) AS common FROM wc JOIN bc ON bc.item_id = wc.item_id AND bc.g = wc.g GROUP BY ALL),
v AS (SELECT j.doc_id, j.item_id, j.len, j.start, common, wt.total + j.len - 4 - common AS total FROM j JOIN wt ON wt.doc_id = j.doc_id AND wt.item_id = j.item_id AND wt.start = j.start),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common / total DESC, start) AS r FROM v WHERE 100 * common >= 80 * total)
SELECT doc_id, item_id, round(common / total, 9) AS similarity, CAST(start AS INT) AS start_word, CAST(len AS INT) AS n_words FROM g WHERE r = 1
"""
