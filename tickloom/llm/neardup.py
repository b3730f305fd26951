"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

1. Each text becomes its set of k-word shingles. The set is hashed once into BINS bins; an empty bin borrows from the first
   full bin in its own fixed random order (optimal densification), which keeps a bin's chance of agreeing at the Jaccard
   similarity. BANDS bands of ROWS bins give bucket keys: at similarity 0.8 a pair misses every bucket with chance 3e-7.
2. Texts with equal sets are one class from here on. Buckets with one class are dropped.
3. In each bucket one class, that which meets most others over all its buckets, is the centre; the edges of this star are
   confirmed on full sets and joined to components. That settles the large groups at a cost linear in their size.
4. A bucket that still holds different components may hide a link that no centre had part in. Its members' full sets meet in one
   task, or, by blocks of BLOCK_BYTES, in as many as it has pairs of blocks; buckets of the same members meet once. There
   members of different components are compared by what is rare: two sets that are similar enough share one of their rarest
   n - ceil(n * percent / 100) + 1 shingles, so nothing else need be looked at, and nothing is left out. A pair found joins its
   components at once, so a task writes at most one link less than it has members, however many pairs are similar.
So every pair that shares a bucket is confirmed, refuted, or already in one component.

Defined results: texts are whole. A null or blank text has an empty set, links with nothing and is its own component. Equal
texts, repeated rows and repeated ids fall in one class; component_id is the least doc_id reachable (null ids count only
where nothing else is there). Columns beside the id and the text are not read. An empty table gives no rows. Of a group without
any id one row stays in ``deduplicated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .shared import arrow_batches, let_go, looked_up, written

ROWS = 7
BANDS = 64
BINS = ROWS * BANDS
#: Up to so many (id, hash) rows of about 100 bytes go to every executor (50 MB); beyond that they are joined by shuffle.
BROADCAST_ROWS = 500_000
#: A task compares the members of two blocks of a bucket at most, each of about so many bytes of sets.
BLOCK_BYTES = 8 << 20
#: Texts, or pairs with both their sets, in an Arrow batch at most.
BATCH_ROWS = 1000


@lru_cache(maxsize=1)
def probe_order() -> np.ndarray:
    """[i, b]: when bin i, empty, tries bin b. The same for every text."""
    rng = np.random.Generator(np.random.PCG64(20240607))
    return np.argsort(np.argsort(rng.random((BINS, BINS)), axis=1), axis=1).astype(np.uint16)


def signature(shingles: np.ndarray) -> np.ndarray:
    """BINS minima of a sorted set of hashes: the high bits choose the bin, so a bin's first member is its least."""
    bins = ((shingles >> K.U(32)) * K.U(BINS)) >> K.U(32)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    full = bins[first].astype(np.int64)
    sig = np.zeros(BINS, K.U)
    sig[full] = shingles[first]
    if len(full) < BINS:
        hole = np.ones(BINS, bool)
        hole[full] = False
        empty = np.flatnonzero(hole)
        sig[empty] = sig[full[probe_order()[np.ix_(empty, full)].argmin(axis=1)]]
    return sig


def band_keys(sigs: np.ndarray) -> np.ndarray:
    rows = sigs.reshape(-1, BANDS, ROWS)
    key = np.zeros(rows.shape[:2], K.U)
    for j in range(ROWS):
        key += K.mix(rows[:, :, j]) * K.PLACE[j]
    return K.mix(key + np.arange(BANDS, dtype=K.U) * K.U(K.GOLD)).view(np.int64)


def _signed(k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column(1)):
                sets = K.shingles(*K.word_hashes(data, offsets), k)
                some = [n for n, s in enumerate(sets) if len(s)]
                digest = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
                keys = band_keys(np.array([signature(sets[n]) for n in some])) if some else np.zeros((0, BANDS), np.int64)
                at = np.zeros(j - i + 1, np.int32)
                at[1:][some] = BANDS
                empty = np.array([not len(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(2)[i:j], pa.array(digest[:, 0], mask=empty), pa.array(digest[:, 1], mask=empty), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(np.cumsum(at, dtype=np.int32), keys.ravel())],
                    ["doc_id", "h", "d1", "d2", "n_shingles", "bands"],
                )

    return run


def _packed(k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column(1)):
                sets = K.shingles(*K.word_hashes(data, offsets), k)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "shingles"])

    return run


def _confirmed(percent: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), K.U) for v in (x, y))
                both = np.concatenate((a, b))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column(0), batch.column(1))], ["a", "b"])

    return run


def _sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(cid, shingles) of each node: the packed set of one of its texts."""
    n = nodes.count()
    reps = written(rows.select("uid", "doc_id", "h").join(nodes.select("cid"), F.col("uid") == F.col("cid")).select("cid", F.col("doc_id").alias("rep"), F.col("h").alias("rep_h")), "reps", n)
    # a few tens of MB at most go to every executor; beyond that the texts are shuffled to their keys
    side = F.broadcast(reps) if n <= BROADCAST_ROWS else reps
    texts = docs.join(side, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("rep_h"))).select("cid", "text")
    sets = written(texts.mapInArrow(_packed(k), "cid bigint, shingles binary"), "sets", compression="none")
    if sets.count() != n:  # rows that are repeated as a whole
        sets = written(sets.dropDuplicates(["cid"]), "sets")
    let_go(reps)
    return sets


def spanning(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links (positions) that join all components which similar sets connect; with side only between its two values."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, comp = size[order], np.unique(label, return_inverse=True)[1][order]
    side = None if side is None else side[order]
    owner, begin = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    _, token, count = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    token = rank[token]
    token = token[np.lexsort((token, owner))]  # of each set the rarest first
    prefix = size - (percent * size + 99) // 100 + 1
    first = np.arange(len(token)) - begin[owner] < prefix[owner]
    listed = np.lexsort((owner[first], token[first]))
    posted, at = owner[first][listed], np.searchsorted(token[first][listed], np.arange(len(count) + 1))
    mark, out = np.zeros(len(count), bool), []
    for x in range(len(size)):
        t = token[begin[x] : begin[x] + prefix[x]]
        n = at[t + 1] - at[t]
        y = np.unique(posted[np.repeat(at[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        y = y[(y > x) & (100 * size[x] >= percent * size[y])]
        y = y if side is None else y[side[y] != side[x]]
        mine = token[begin[x] : begin[x] + size[x]]
        mark[mine] = True
        while len(y := y[comp[y] != comp[x]]):
            now, y = y[:64], y[64:]
            length = size[now]
            ends = np.cumsum(length) - length
            common = np.add.reduceat(mark[token[np.repeat(begin[now] - ends, length) + np.arange(length.sum())]].astype(np.int64), ends)
            for v in now[100 * common >= percent * (size[x] + length - common)]:
                if comp[v] != comp[x]:
                    comp[comp == comp[v]] = comp[x]
                    out.append((int(order[x]), int(order[v])))
        mark[mine] = False
    return out


def _spanned(percent: int):  # noqa: ANN202
    """Of two blocks of a bucket, the links that similar sets of different components need."""

    def run(table: pa.Table) -> pa.Table:
        cid, label, own = (table[c].to_numpy() for c in ("cid", "label", "own"))
        across = table["i"][0].as_py() != table["j"][0].as_py()
        links = spanning([np.frombuffer(v.as_buffer(), K.U) for v in table["shingles"]], label, own if across else None, percent)
        a, b = (cid[[x[i] for x in links]] if links else np.zeros(0, np.int64) for i in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """The pairs (a, b), n at most, whose full sets are similar enough."""
    pairs = pairs.distinct()
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return written(both.mapInArrow(_confirmed(percent), "a bigint, b bigint"), "links", n)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", with_hash: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: links at 100 * intersection >= percent * union."""
    out, _ = _found(docs, k, percent, id_col, text)
    return out if with_hash else out.drop("h", "uid", "label")


def _found(docs: DataFrame, k: int, percent: int, id_col: str, text: str) -> tuple[DataFrame, int]:
    """What near_duplicates gives, with the texts' hashes, and its number of rows."""
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        return _labelled(docs, k, percent, id_col, text)


def _labelled(docs: DataFrame, k: int, percent: int, id_col: str, text: str) -> tuple[DataFrame, int]:
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(_signed(k), f"doc_id {kind}, h bigint, d1 bigint, d2 bigint, n_shingles bigint, bands array<bigint>")
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "signed")
    total = rows.count()
    classes = rows.where("d1 IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("root"), F.min("uid").alias("cid"), F.max("n_shingles").alias("n"))

    # buckets that more than one class falls in
    banded = rows.select("uid", "d1", "d2", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.min("d2").alias("lo2"), F.max("d2").alias("hi2")).where("lo < hi OR lo2 < hi2").select("band")
    met = written(banded.join(shared, "band").groupBy("band", "d1", "d2").agg(F.min("uid").alias("uid")), "met", total * BANDS)
    n_met = met.count()
    nodes = written(met.select("d1", "d2").distinct().join(classes, ["d1", "d2"]).select("cid", "d1", "d2", "n"), "nodes", n_met)
    sizes = met.groupBy("band").agg(F.count("*").alias("size"))
    weight = met.join(sizes, "band").groupBy("d1", "d2").agg(F.sum("size").alias("weight"))
    members = written(met.join(nodes.join(weight, ["d1", "d2"]), ["d1", "d2"]).select("band", "cid", "n", "weight"), "members", n_met)

    sets = _sets(docs, rows, nodes, k)
    let_go(met, nodes)

    # a star in each bucket
    hubs = members.groupBy("band").agg(F.max(F.struct("weight", "cid", "n")).alias("c")).select("band", F.col("c.cid").alias("hub"), F.col("c.n").alias("hub_n"))
    fits = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    hubs = written(hubs, "hubs", n_met)
    edges = members.join(hubs, "band").where((F.col("cid") != F.col("hub")) & fits).select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b"))
    links = _confirm(edges, sets, percent, n_met)
    labels = written(components(links, "a", "b"), "labels")

    # what the stars left: buckets that still hold different components; of buckets with the same members one is enough
    tagged = members.join(labels, members["cid"] == labels["node"], "left").select("band", "cid", "n", F.coalesce("label", "cid").alias("label"))
    tagged = written(tagged, "tagged", n_met)
    alike = F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64(F.col("cid") * 31 + 7)).alias("y"), F.count("*").alias("size")
    mixed = tagged.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n").alias("n"), *alike).where("lo < hi")
    mixed = mixed.groupBy("x", "y", "size").agg(F.min("band").alias("band"), F.max(F.ceil(F.col("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    # a bucket of many blocks is dealt out as pairs of blocks, so that no task holds more than two
    left = tagged.join(mixed.select("band", "blocks"), "band").withColumn("own", own).select("band", "cid", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    left = left.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cid", "label", "own").join(sets, "cid")
    more = written(left.groupBy("band", "i", "j").applyInArrow(_spanned(percent), "a bigint, b bigint"), "more", n_met)
    let_go(tagged)
    labels = written(components(links.union(more), "a", "b"), "labels")
    let_go(members, hubs, links, more, sets)

    named = classes.join(labels, classes["cid"] == labels["node"], "left").select("d1", "d2", "root", F.coalesce("label", "cid").alias("label"))
    named = written(named, "named", total)
    # a component may hold a large part of all classes: those meet its least id where they are
    least = written(named.groupBy("label").agg(F.min("root").alias("component_id"), F.count("*").alias("n_classes")), "least", total)
    n_named = least.agg(F.sum("n_classes")).first()[0] or 0
    named = looked_up(named, least, "label", "n_classes", n_named).select("d1", "d2", "component_id", "label")
    out = rows.select("doc_id", "h", "n_shingles", "d1", "d2", "uid").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("d1").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "h", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "uid", F.coalesce("label", "uid").alias("label"))
    return out, total


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with docs' own columns whatever their names; of rows repeated as a whole one stays."""
    found, total = _found(docs, k, percent, "doc_id", "text")
    found = written(found, "kept", total)
    # a group without any id: the first of its rows
    firsts = found.where("kept AND doc_id IS NULL").groupBy("label").agg(F.min("uid").alias("first"))
    found = found.join(firsts, "label", "left").withColumn("stays", F.col("kept") & (F.col("doc_id").isNotNull() | F.col("uid").eqNullSafe(F.col("first"))))
    each = written(found.groupBy("doc_id", "h").agg(F.max("stays").alias("stays"), F.count("*").alias("n")), "each", total)
    gone = each.where(~F.col("stays")).select("doc_id", "h")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    # docs' columns travel as one, so that none of their names can clash
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("x")).alias("d")
    out = d.join(side.alias("g"), F.col("d.id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.x") == F.col("g.h")), "left_anti")
    if not each.where("stays AND n > 1").isEmpty():
        out = out.dropDuplicates(["id", "x"])
    return out.select("row.*")


def query(spark, sf_dir):  # noqa: ANN001, ANN201
    from .shared import table

    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = p.a JOIN n AS y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reach FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
