"""Record files: written in two phases, appended, trimmed, tailed while they grow, and refused where they are torn."""

import datetime as dt
import glob
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.sources import codec, files

COLUMNS = "series string, dt date, mts bigint, sigma double"


def rows(n, start=0, series=("a", "b"), days=(1, 2)):
    return [(s, dt.date(2024, 1, d), start + i, i + d / 10) for s in series for d in days for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, COLUMNS).repartition(5)


def found(root, ext="vol"):
    return {os.path.relpath(f, root): codec.decode("vol", open(f, "rb").read())["mts"].tolist() for f in glob.glob(f"{root}/*/*.{ext}")}


def leftovers(root):
    return glob.glob(f"{root}/_temporary/*")


def test_write_append_trim(spark, tmp_path):
    root = str(tmp_path)
    files.write_records(frame(spark, rows(10)), root, "vol", ["mts"])
    assert found(root) == {f"{s}/2024-01-0{d}.vol": list(range(10)) for s in "ab" for d in (1, 2)} and not leftovers(root)
    files.write_records(frame(spark, rows(5, 100, days=(2, 3))), root, "vol", ["mts"])
    got = found(root)
    assert got["a/2024-01-02.vol"] == [*range(10), *range(100, 105)] and got["b/2024-01-03.vol"] == list(range(100, 105)) and got["a/2024-01-01.vol"] == list(range(10))
    files.write_records(frame(spark, rows(3, 200, series=("a",), days=(2,))), root, "vol", ["mts"], keep=4)
    assert found(root)["a/2024-01-02.vol"] == [104, 200, 201, 202]
    files.write_records(frame(spark, rows(2, 300, series=("b",), days=(1,))), root, "vol", ["mts"], mode="overwrite")
    assert found(root)["b/2024-01-01.vol"] == [300, 301] and len(found(root)) == 6
    files.write_records(frame(spark, []), root, "vol", ["mts"])
    assert len(found(root)) == 6 and not leftovers(root)
    back = files.read_records(spark, root, "vol")
    assert back.count() == sum(len(v) for v in found(root).values()) and back.where("dt IS NULL").count() == 0


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    root = str(tmp_path)
    files.write_records(frame(spark, rows(4)), root, "vol", ["mts"])
    before = found(root)
    with open(f"{root}/a/2024-01-01.vol", "ab") as f:
        f.write(b"torn")
    with pytest.raises(Exception, match="not whole vol records"):
        files.write_records(frame(spark, rows(4, 50)), root, "vol", ["mts"])
    os.truncate(f"{root}/a/2024-01-01.vol", 4 * 14)
    assert found(root) == before and not leftovers(root)
    for bad in ([(None, dt.date(2024, 1, 1), 1, 1.0)], [("../x", dt.date(2024, 1, 1), 1, 1.0)], [("a", None, 1, 1.0)]):
        with pytest.raises(Exception, match="no file of their own"):
            files.write_records(frame(spark, [*rows(3, 70), *bad]), root, "vol", ["mts"])
    spark.dataSource.register(files.RecordFiles)
    with pytest.raises(Exception, match="two tasks|stand together"):
        frame(spark, rows(50, series=("c",), days=(1,))).write.format("tl_records").mode("append").options(path=root, kind="vol").save()
    assert found(root) == before and not leftovers(root)


def test_tail_gives_each_record_once(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(f"{root}/a")

    def grow(name, data):
        with open(f"{root}/a/{name}", "ab") as f:
            f.write(data)

    def run():
        q = files.tail_records(spark, root, "vol", range_bytes=14 * 3).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["mts"] for r in spark.read.parquet(out).collect())

    record = lambda i: codec.encode("vol", pd.DataFrame({"mts": [i], "sigma": [1.0]}))
    grow("2024-01-01.vol", b"".join(map(record, range(10))) + record(10)[:5])
    grow("notes.txt", b"x")
    assert run() == list(range(10))
    grow("2024-01-01.vol", record(10)[5:] + record(11))
    grow("2024-01-02.vol", record(12))
    assert run() == list(range(13))
    assert run() == list(range(13))
    os.truncate(f"{root}/a/2024-01-01.vol", 14)
    with pytest.raises(Exception, match="fewer records"):
        run()


def test_stream_writes_each_batch_once(spark, tmp_path):
    root, src = str(tmp_path / "store"), str(tmp_path / "src")
    for start in (0, 20):
        frame(spark, rows(4, start)).write.mode("append").parquet(src)
        stream = spark.readStream.schema(COLUMNS).parquet(src)
        q = files.stream_records(stream, root, "vol", str(tmp_path / "state"), ["mts"]).trigger(availableNow=True).start()
        q.awaitTermination()
    want = [*range(4), *range(20, 24)]
    assert set(map(tuple, found(root).values())) == {tuple(want)} and not leftovers(root)
    # the last batch again, after a crash between renaming and the checkpoint: one file had been renamed, one not
    os.truncate(f"{root}/a/2024-01-01.vol", 4 * 14)
    w = files.RecordStreamWriter({"kind": "vol", "path": root}, False)
    batch = frame(spark, rows(4, 20)).coalesce(1).sortWithinPartitions("series", "dt", "mts").toArrow().to_batches()
    w.commit([w.write(iter(batch))], 1)
    assert set(map(tuple, found(root).values())) == {tuple(want)} and not leftovers(root)
    w = files.RecordStreamWriter({"kind": "vol", "path": root}, False)
    w.commit([w.write(iter(batch))], 0)
    assert set(map(tuple, found(root).values())) == {tuple(want)}


def test_bars_and_index_records_come_back(spark, tmp_path):
    t = spark.range(300).select(F.lit("s").alias("series"), F.to_date(F.lit("2024-03-01")).alias("dt"), (F.col("id") * 7).alias("mts"), F.col("id").alias("ticker"), (F.col("id") / 3).alias("bid"), (F.col("id") / 2).alias("ask"), (F.col("id") % 5).alias("sequence"))
    files.write_records(t, str(tmp_path), "idx", ["mts"])
    back = files.read_records(spark, str(tmp_path), "idx", range_bytes=56 * 64)
    assert back.rdd.getNumPartitions() == 5
    assert [tuple(r) for r in back.orderBy("mts").select("mts", "ticker", "bid", "ask", "sequence", "accepted", "dt").collect()] == [(i * 7, i, i / 3, i / 2, i % 5, 1, dt.date(2024, 3, 1)) for i in range(300)]
    assert [r["ticker"] for r in files.read_records(spark, str(tmp_path), "idx", tail=3).orderBy("mts").collect()] == [297, 298, 299]


def test_tasks_do_not_grow_with_records_where_ranges_are_small():
    """Neighbours are joined, and every record is still in one range."""
    tail = files.RecordTail({"path": "/none", "kind": "idx", "range_bytes": 56 * 4})
    end = {f"f{i}": 100_000 + i for i in range(10)}
    got = tail.partitions({"f3": 40}, end)
    assert len(got) <= files.MOST_RANGES + len(end)
    for path, n in end.items():
        at = 40 if path == "f3" else 0
        for r in [r for r in got if r.path == path]:
            assert r.start == at * 56
            at += r.records
        assert at == n
