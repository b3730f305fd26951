"""Record files: read by byte ranges, tailed as a stream while they grow, and written in two phases.

A Python data source over the stores that Arrow's file systems open (local and shared folders, HDFS, S3, GCS), for files of any
size. Whole files never stand in memory: a partition is a range, and a refill of it is one Arrow batch.

Reading. A torn tail is left out with a warning, and strict makes it, or an empty file, an error. tail=n reads the newest
n whole records of each file, seeking past all others. Files whose name isn't a date and the extension are ignored. A folder
without files has no rows.

Tailing. An offset is how many whole records of each file were read (so it is as large as the list of files); a batch has what came since. A
torn tail waits for its rest; a file that has become shorter is an error.

Writing. Rows go to <path>/<series>/<day>.<extension>, in the order they come in. A task writes what the file shall be (with append what
is there, then its rows) to a folder of the job; the driver renames when all tasks are done, and removes the folder whether they
are or not. So a failed task or job leaves no file and no part of one; a driver that ends while it renames leaves some files
as they were, each of them whole. Append refuses a file that isn't whole records; overwrite replaces the days that are written; keep=n leaves
the newest n records. A stream's batch is written once, though it be tried again: what a batch makes of its files is noted before they are
renamed. Rows without series or day, and two tasks with one file, are errors.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..session import dealt
from . import codec

REFILL = 4096
RANGE_BYTES = 64 << 20
#: Ranges beyond so many are joined with their neighbours, up to RANGE_BYTES: a task for each would cost more than its records.
MOST_RANGES = 256
#: Below a store's root: files of jobs that aren't done, and what a stream's last batch makes of its files.
PENDING, BATCHES = "_temporary", "_batches"


def _store(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    records: int


class RecordFiles(DataSource):
    """Options: path, kind (idx, bar, tick, vol), ext; strict, tail, range_bytes to read; keep to write."""

    @classmethod
    def name(cls) -> str:
        return "tl_records"

    def schema(self) -> str:
        return f"path string, {codec.schema(self.options['kind'])}"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return RecordReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return RecordTail(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ANN001
        return RecordWriter(dict(self.options), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: ANN001, N802
        return RecordStreamWriter(dict(self.options), overwrite)


class _Ranges:
    def __init__(self, options: dict) -> None:
        self.kind, self.root = options["kind"], options["path"]
        self.ext = options.get("ext", self.kind)
        self.strict, self.tail = str(options.get("strict", "false")).lower() == "true", int(options.get("tail", 0))
        self.size = codec.LAYOUTS[self.kind][0]
        self.per = max(1, int(options.get("range_bytes", RANGE_BYTES)) // self.size)

    def files(self) -> Iterator[pafs.FileInfo]:
        fs, root = _store(self.root)
        for f in sorted(fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)), key=lambda f: f.path):
            if f.is_file and f"/{PENDING}/" not in f.path and re.search(rf"(^|/)\d{{4}}-\d{{2}}-\d{{2}}\.{re.escape(self.ext)}$", f.path):
                yield f

    def ranges(self, spans: list[tuple[str, int, int]]) -> list[Range]:
        """The records first to end of each (path, first, end)."""
        n = sum(math.ceil((end - first) / self.per) for _, first, end in spans)
        per = self.per * max(1, min(math.ceil(n / MOST_RANGES), RANGE_BYTES // (self.per * self.size)))
        return [Range(path, i * self.size, min(per, end - i)) for path, first, end in spans for i in range(first, end, per)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = _store(self.root)
        with fs.open_input_file(partition.path) as f:
            f.seek(partition.start)
            left = partition.records
            while left:
                n = min(left, REFILL)
                rows = codec.decode(self.kind, f.read(n * self.size))
                rows.insert(0, "path", partition.path)
                yield pa.RecordBatch.from_pandas(rows, preserve_index=False)
                left -= n


class RecordReader(_Ranges, DataSourceReader):
    def partitions(self) -> list[Range]:
        out = []
        for f in self.files():
            n, torn = divmod(f.size, self.size)
            if self.strict and (torn or not n):
                raise ValueError(f"{f.path} has {f.size} bytes, which are not whole {self.kind} records of {self.size}")
            if torn:
                warnings.warn(f"{f.path}: a torn tail of {torn} bytes is left out", stacklevel=2)
            out.append((f.path, max(0, n - self.tail) if self.tail else 0, n))
        return self.ranges(out)


class RecordTail(_Ranges, DataSourceStreamReader):
    """Whole records of growing files, each once."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {f.path: f.size // self.size for f in self.files()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        short = [p for p, n in start.items() if end.get(p, 0) < n]
        if short:
            raise ValueError(f"{short[0]} has fewer records than were read from it")
        return self.ranges([(p, start.get(p, 0), n) for p, n in sorted(end.items())])

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    """What a task has ready: (file as written, file it shall be, bytes)."""

    files: list[tuple[str, str, int]] = field(default_factory=list)


class RecordWriter(DataSourceArrowWriter):
    #: Whether the job's folder is made anew for each batch.
    again = False

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.kind, self.root, self.overwrite = options["kind"], options["path"], overwrite
        self.ext, self.keep = options.get("ext", self.kind), int(options.get("keep", 0))
        self.size = codec.LAYOUTS[self.kind][0]
        self.job = uuid.uuid4().hex
        self._begin()

    def _begin(self) -> None:
        """A task only writes below a job's folder that is there: one that outlives a failed job can't make it again."""
        fs, root = _store(self.root)
        fs.create_dir(f"{root}/{PENDING}/{self.job}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _store(self.root)
        place = f"{root}/{PENDING}/{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(place, recursive=self.again)
        done, now, out = Written(), None, None
        seen: set[tuple] = set()
        for batch in iterator:
            rows = batch.to_pandas()
            for key, part in rows.groupby(["series", "dt"], sort=False, dropna=False):
                if key != now:
                    if out:
                        done.files.append(self._closed(fs, out, f"{place}/{len(seen)}", root, now))
                    if key in seen or not (isinstance(key[0], str) and re.fullmatch(r"[\w.=-]+", key[0])) or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", str(key[1])):
                        raise ValueError(f"rows of {key} have no file of their own, or don't stand together")
                    seen.add(key)
                    now, out = key, self._opened(fs, f"{place}/{len(seen)}", f"{root}/{key[0]}/{key[1]}.{self.ext}")
                out.write(codec.encode(self.kind, part))
        if out:
            done.files.append(self._closed(fs, out, f"{place}/{len(seen)}", root, now))
        return done

    def _opened(self, fs: pafs.FileSystem, path: str, final: str) -> pa.NativeFile:
        was = fs.get_file_info(final)
        out = fs.open_output_stream(path)
        if was.is_file and not self.overwrite:
            if was.size % self.size:
                raise ValueError(f"{final} has {was.size} bytes, which are not whole {self.kind} records of {self.size}")
            self._copy(fs, final, out, 0)
        return out

    @staticmethod
    def _copy(fs: pafs.FileSystem, path: str, out: pa.NativeFile, start: int) -> None:
        with fs.open_input_file(path) as f:
            f.seek(start)
            while part := f.read(RANGE_BYTES // 8):
                out.write(part)

    def _closed(self, fs: pafs.FileSystem, out: pa.NativeFile, path: str, root: str, key: tuple) -> tuple[str, str, int]:
        n = out.tell()
        out.close()
        if self.keep and n > self.keep * self.size:
            start, n = n - self.keep * self.size, self.keep * self.size
            with fs.open_output_stream(f"{path}.kept") as kept:
                self._copy(fs, path, kept, start)
            path += ".kept"
        return path, f"{root}/{key[0]}/{key[1]}.{self.ext}", n

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _store(self.root)
        self._rename(fs, self._all(messages))
        self._clear(fs, root)

    def _all(self, messages: list[Written | None]) -> list[tuple[str, str, int]]:
        files = [f for m in messages if m for f in m.files]
        if len({final for _, final, _ in files}) < len(files):
            raise ValueError("two tasks have written one file: deal rows out by series and day (write_records does)")
        return files

    @staticmethod
    def _rename(fs: pafs.FileSystem, files: list[tuple[str, str, int]]) -> None:
        for path, final, _ in files:
            fs.create_dir(final.rsplit("/", 1)[0], recursive=True)
            if fs.type_name != "local" and fs.get_file_info(final).is_file:
                fs.delete_file(final)
            fs.move(path, final)

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        place = f"{root}/{PENDING}/{self.job}"
        for last in (False, False, True):  # a task that goes on may add a file meanwhile
            try:
                if fs.get_file_info(place).type == pafs.FileType.Directory:
                    fs.delete_dir(place)
                return
            except OSError:
                if last:
                    raise

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_store(self.root))


class RecordStreamWriter(RecordWriter, DataSourceStreamArrowWriter):
    """The same for each batch of a stream, once: a batch that comes again leaves alone the files that it has been through with."""

    again = True

    def __init__(self, options: dict, overwrite: bool) -> None:
        super().__init__(options, overwrite)
        # the tasks' writer and the one that commits are made apart
        stream = next((v for k, v in options.items() if k.lower() == "checkpointlocation"), "")
        self.job = hashlib.sha256(f"{self.ext}:{stream}".encode()).hexdigest()[:32]
        self.order = [c for c in options.get("order", "").split(",") if c]

    def _begin(self) -> None:
        pass

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Streams can't be sorted before a sink, so a task sorts its part of the batch."""
        batches = list(iterator)
        if not batches:
            return Written()
        rows = pa.Table.from_batches(batches).sort_by([(c, "ascending") for c in ("series", "dt", *self.order)])
        return super().write(iter(rows.combine_chunks().to_batches()))

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        fs, root = _store(self.root)
        files, note = self._all(messages), f"{root}/{BATCHES}/{self.ext}.json"
        noted = {"batch": -1, "files": {}}
        if fs.get_file_info(note).is_file:
            with fs.open_input_file(note) as f:
                noted = json.loads(f.read())
        if batchId >= noted["batch"]:
            if batchId == noted["batch"]:
                files = [x for x in files if fs.get_file_info(x[1]).size != noted["files"].get(x[1])]
            else:
                fs.create_dir(f"{root}/{BATCHES}", recursive=True)
                with fs.open_output_stream(f"{note}.new") as f:
                    f.write(json.dumps({"batch": batchId, "files": {final: n for _, final, n in files}}).encode())
                self._rename(fs, [(f"{note}.new", note, 0)])
            self._rename(fs, files)
        self._clear(fs, root)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._clear(*_store(self.root))


def read_records(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:  # noqa: ANN003
    """(path, dt, record columns) of all record files below a folder."""
    spark.dataSource.register(RecordFiles)
    df = spark.read.format("tl_records").options(path=path, kind=kind, **{k: str(v) for k, v in options.items()}).load()
    return df.withColumn("dt", F.to_date(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})\.[^/]*$", 1), "yyyy-MM-dd"))


def tail_records(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:  # noqa: ANN003
    """The same as a stream: what is there and what is appended, each record once."""
    spark.dataSource.register(RecordFiles)
    return spark.readStream.format("tl_records").options(path=path, kind=kind, **{k: str(v) for k, v in options.items()}).load()


def write_records(rows: DataFrame, path: str, kind: str, order: list[str], mode: str = "append", **options) -> None:  # noqa: ANN003
    """rows (series, dt, record columns) to their files, sorted within them; a file is one task's work. Missing record columns take their defaults."""
    spark = rows.sparkSession
    spark.dataSource.register(RecordFiles)
    names = ["series", "dt", *[n for n, _, _ in codec.LAYOUTS[kind][1] if n in rows.columns]]
    out = dealt(rows, "series", "dt").sortWithinPartitions("series", "dt", *order).select(names)
    out.write.format("tl_records").mode(mode).options(path=path, kind=kind, **{k: str(v) for k, v in options.items()}).save()


def stream_records(rows: DataFrame, path: str, kind: str, checkpoint: str, order: list[str], **options):  # noqa: ANN003, ANN201
    """A stream writer of rows (series, dt, record columns), each batch appended to its files."""
    rows.sparkSession.dataSource.register(RecordFiles)
    names = ["series", "dt", *[n for n, _, _ in codec.LAYOUTS[kind][1] if n in rows.columns]]
    out = dealt(rows, "series", "dt").select(names)
    return out.writeStream.format("tl_records").options(path=path, kind=kind, checkpointLocation=checkpoint, order=",".join(order), **{k: str(v) for k, v in options.items()})
