"""Packed little-endian records to and from rows: index, bar, tick and volatility files, frames, id lists and signed blobs.

``read_files`` reads whole files by Spark's binaryFile source, from any store that Spark reads, one row a file and 2 GB at most;
``sources.files`` reads byte ranges of larger ones. Bytes are decoded in Arrow batches with a NumPy view; a torn tail is left
out unless strict. A null blob has no rows. Offsets, magic and strides below are fixed values of the formats.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed record layouts: (field, NumPy type, offset); u6 is an unsigned 48-bit number.
LAYOUTS = {
    "idx": (56, [("type_provider", "u2", 0), ("mts", "u6", 2), ("count", "u1", 8), ("hflags", "u1", 9), ("sequence", "u2", 10), ("ticker", "u8", 16), ("bid", "f8", 24), ("ask", "f8", 32), ("vbid", "u4", 40), ("vask", "u4", 44), ("ci", "u2", 48), ("tick_count", "u2", 50), ("confidence", "u1", 52), ("accepted", "u1", 53), ("rejected", "u1", 54), ("flags", "u1", 55)]),
    "bar": (96, [("open_mts", "u6", 0), ("close_mts", "u6", 6), ("open", "f8", 12), ("high", "f8", 20), ("low", "f8", 28), ("close", "f8", 36), ("vbid", "u4", 44), ("vask", "u4", 48), ("tick_count", "u4", 52), ("realized_var", "f4", 64), ("bipower_var", "f4", 68), ("drift", "f4", 72), ("vol_imbalance", "f4", 76), ("avg_spread_bps", "f4", 80), ("max_abs_return", "f4", 84), ("avg_ci_ubp", "u2", 88), ("reject_rate", "u2", 90), ("kind", "u1", 92), ("flags", "u1", 93)]),
    "tick": (32, [("ticker", "u8", 0), ("bid", "f8", 8), ("ask", "f8", 16), ("vbid", "u4", 24), ("vask", "u4", 28)]),
    "vol": (14, [("mts", "u6", 0), ("sigma", "f8", 6)]),
}
REST_MAGIC = b"NXRF"
FRAMES = {1: ("epoch_ms", "ticker", "mid", "bid", "ask", "ci_ubp", "confidence", "accepted", "rejected"), 2: ("epoch_ms", "ticker", "mid", "bid", "ask", "ci_ubp", "confidence", "accepted", "rejected", "flags")}
TICK_FRAME = ("epoch_ms", "ticker", "provider", "bid", "ask", "accepted")
REST_STRIDES = {1: 11, 2: 20, 3: 7}


def _dtype(kind: str) -> np.dtype:
    size, fields = LAYOUTS[kind]
    names, formats, offsets = [], [], []
    for name, t, at in fields:
        if t == "u6":
            names += [f"{name}_lo", f"{name}_hi"]
            formats += ["<u4", "<u2"]
            offsets += [at, at + 4]
        else:
            names.append(name)
            formats.append(f"<{t}")
            offsets.append(at)
    return np.dtype({"names": names, "formats": formats, "offsets": offsets, "itemsize": size})


def schema(kind: str) -> str:
    spark_type = lambda t: {"f8": "double", "f4": "float"}.get(t, "bigint")
    return ", ".join(f"{n} {spark_type(t)}" for n, t, _ in LAYOUTS[kind][1])


def decode(kind: str, data: bytes, strict: bool = True) -> pd.DataFrame:
    """Records as columns. Strict: a length that isn't whole records is an error; else the torn tail is left out."""
    size, fields = LAYOUTS[kind]
    if len(data) % size:
        if strict:
            raise ValueError(f"{len(data)} bytes are not whole {kind} records of {size}")
        data = data[: len(data) // size * size]
    a = np.frombuffer(data, _dtype(kind))
    cols = {}
    for name, t, _ in fields:
        if t == "u6":
            cols[name] = a[f"{name}_lo"].astype(np.int64) | a[f"{name}_hi"].astype(np.int64) << 32
        else:
            cols[name] = a[name].astype({"f8": np.float64, "f4": np.float32}.get(t, np.uint64)).view(np.int64) if t == "u8" else a[name].astype({"f8": np.float64, "f4": np.float32}.get(t, np.int64))
    return pd.DataFrame(cols)


DEFAULTS = {"idx": {"tick_count": 1, "confidence": 1, "accepted": 1, "type_provider": ord("i") & 15, "count": 1}, "bar": {}, "tick": {}, "vol": {}}


def encode(kind: str, rows: pd.DataFrame) -> bytes:
    """Columns to records; a missing column takes its default, else 0."""
    _, fields = LAYOUTS[kind]
    a = np.zeros(len(rows), _dtype(kind))
    for name, t, _ in fields:
        v = rows[name].to_numpy() if name in rows else np.full(len(rows), DEFAULTS[kind].get(name, 0))
        if t == "u6":
            v = v.astype(np.int64)
            a[f"{name}_lo"], a[f"{name}_hi"] = v & 0xFFFFFFFF, v >> 32
        elif t == "u8":
            a[name] = v.astype(np.int64).view(np.uint64)
        else:
            a[name] = v
    return a.tobytes()


def read_files(spark: SparkSession, path: str, kind: str, strict: bool = False, glob: str | None = None) -> DataFrame:
    """Rows of all record files below a folder, with the file's path and its date where its name is one."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return decode_column(reader.option("pathGlobFilter", glob or f"*.{ {'idx': 'idx', 'bar': '*', 'tick': 'tick', 'vol': 'vol'}[kind]}").load(path).select("path", "content"), kind, strict).withColumn("dt", F.to_date(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})\.[^/]*$", 1), "yyyy-MM-dd"))


def decode_column(blobs: DataFrame, kind: str, strict: bool = True, label: str = "path", content: str = "content") -> DataFrame:
    """(label, record columns) from a binary column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf[label], pdf[content], strict=True):
                if data is not None:
                    out = decode(kind, bytes(data), strict)
                    out.insert(0, label, name)
                    yield out

    return blobs.select(label, content).mapInPandas(run, f"{label} string, {schema(kind)}")


def encode_rows(rows: DataFrame, kind: str, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, seq, content): records in order, a blob for each run of a key within a batch, numbered."""
    names = [n for n, _, _ in LAYOUTS[kind][1] if n in rows.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict = {}
        for pdf in batches:
            for key, g in pdf.groupby(keys, sort=False):
                n[key] = n.get(key, -1) + 1
                yield pd.DataFrame([(*key, n[key], encode(kind, g))], columns=[*keys, "blob", "content"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *names).mapInPandas(run, f"{kinds}, blob int, content binary")


def decoded_view(idx: DataFrame) -> DataFrame:
    """Adds time, mid and decoded ci to index rows."""
    from ..functions import exprs as X

    return idx.withColumn("ts_ms", X.mts_to_ms("mts")).withColumn("mid", X.mid()).withColumn("ci_ubp", F.rint(X.ci_decode("ci"))).withColumn("provider", F.shiftright("type_provider", 4))


def bar_view(bars: DataFrame) -> DataFrame:
    from ..functions import exprs as X

    return bars.withColumn("open_ms", X.mts_to_ms("open_mts")).withColumn("close_ms", X.mts_to_ms("close_mts"))


def decode_ws(data: bytes, ticks: bool = False, strict: bool = True) -> pd.DataFrame:
    """A stream frame: type, pad, count u16, 4 pad bytes, then float64 rows. Type 2 is the wider index frame unless ticks."""
    kind, _, count = struct.unpack_from("<BBH", data) if len(data) >= 8 else (0, 0, 0)
    names = TICK_FRAME if ticks else FRAMES.get(kind)
    if names is None or len(data) != 8 + count * len(names) * 8:
        if strict:
            raise ValueError("not a whole frame")
        return pd.DataFrame(columns=names or FRAMES[1])
    out = pd.DataFrame(np.frombuffer(data, "<f8", offset=8).reshape(count, len(names)), columns=names)
    return out.astype({"epoch_ms": "int64", "ticker": "int64"})


def encode_ws(rows: pd.DataFrame, kind: int = 1) -> bytes:
    return struct.pack("<BBHI", kind, 0, len(rows), 0) + rows[list(FRAMES[kind])].to_numpy("<f8").tobytes()


def encode_rest(kind: int, rows: np.ndarray) -> bytes:
    """One frame; its count is 16 bits wide, so more rows are an error (see rest_frames)."""
    if len(rows) > 65535:
        raise ValueError(f"{len(rows)} rows in one frame; it counts to 65535")
    return REST_MAGIC + struct.pack("<BBH", kind, rows.shape[1], len(rows)) + rows.astype("<f8").tobytes()


def rest_frames(kind: int, rows: np.ndarray) -> list[bytes]:
    """As many frames as the rows need, one at least."""
    return [encode_rest(kind, rows[i : i + 65535]) for i in range(0, max(len(rows), 1), 65535)]


def decode_rest(data: bytes) -> tuple[int, np.ndarray]:
    if data[:4] != REST_MAGIC:
        raise ValueError("bad magic")
    kind, stride, count = struct.unpack_from("<BBH", data, 4)
    return kind, np.frombuffer(data, "<f8", count * stride, 8).reshape(count, stride)


def decoded_frames(blobs: DataFrame, form: str, label: str = "path", content: str = "content", strict: bool = True) -> DataFrame:
    """(label, rows) of a binary column of stream frames (ws, ws_ticks), REST frames (rest), id lists (ids) or signed quotes (signed).

    Not strict: a malformed stream frame has no rows. REST rows are (kind, row, values). A null blob has no rows.
    """
    wide = lambda names: ", ".join(f"{n} {'bigint' if n in ('epoch_ms', 'ticker') else 'double'}" for n in names)
    kinds = {"ws": wide(FRAMES[2]), "ws_ticks": wide(TICK_FRAME), "rest": "kind int, row int, values array<double>", "ids": "id bigint", "signed": "source_ts bigint, ticker bigint, price double, sigma bigint, conf int"}[form]

    def one(data: bytes) -> pd.DataFrame:
        if form in ("ws", "ws_ticks"):
            out = decode_ws(data, form == "ws_ticks", strict)
            return out if form == "ws_ticks" or "flags" in out else out.assign(flags=np.nan)
        if form == "rest":
            kind, rows = decode_rest(data)
            return pd.DataFrame({"kind": kind, "row": np.arange(len(rows)), "values": list(rows)})
        if form == "ids":
            return pd.DataFrame({"id": decode_ids(data).view(np.int64)})
        out = decode_signed(data)
        return out.assign(ticker=out["ticker"].astype("uint64").to_numpy().view(np.int64)) if len(out) else out

    names = [c.split()[0] for c in kinds.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf[label], pdf[content], strict=True):
                if data is not None:
                    out = one(bytes(data))[names]
                    out.insert(0, label, name)
                    yield out

    return blobs.select(label, content).mapInPandas(run, f"{label} string, {kinds}")


def texts(blobs: DataFrame, content: str = "content") -> DataFrame:
    """Adds text: a gzip or zlib column unpacked, null for anything else."""

    @F.pandas_udf("string")
    def unpacked(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else text_of(bytes(x)))

    return blobs.withColumn("text", unpacked(content))


def decode_ids(data: bytes) -> np.ndarray:
    if len(data) % 8:
        raise ValueError("not whole ids")
    return np.frombuffer(data, "<u8")


def b64_price(p: int) -> float:
    """Mantissa of 52 bits and a decimal exponent."""
    return (p >> 12) * 10.0 ** ((p & 127) - 64 - (p >> 7 & 31))


def b64_price_column(p: Column) -> Column:
    return F.shiftrightunsigned(p, 12).cast("double") * F.pow(F.lit(10.0), (p.bitwiseAND(F.lit(127)) - 64 - F.shiftrightunsigned(p, 7).bitwiseAND(F.lit(31))).cast("double"))


def decode_signed(data: bytes) -> pd.DataFrame:
    """Big-endian signed quotes: version, time, reserved, then records of 22 bytes."""
    if not data or data[0] != 1:
        raise ValueError("unknown version")
    if data[7] != 0 or (len(data) - 8) % 22:
        raise ValueError("malformed blob")
    ts = int.from_bytes(data[1:7], "big")
    rows = [struct.unpack_from(">QQIH", data, at) for at in range(8, len(data), 22)]
    return pd.DataFrame([(ts, t, b64_price(p), s, c) for t, p, s, c in rows], columns=["source_ts", "ticker", "price", "sigma", "conf"])


def text_of(data: bytes) -> str | None:
    """gzip or zlib text, none for anything else."""
    for unpack in (gzip.decompress, zlib.decompress):
        try:
            return unpack(data).decode()
        except (OSError, zlib.error, EOFError, UnicodeDecodeError):
            continue
    return None


def manifest(records: DataFrame, files: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """One row a file: first and last time, rows, bytes and digest. Of several entries for a path the last one (by ``entry``) wins."""
    stats = records.groupBy("path").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))
    own = files.select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), (F.col("entry") if "entry" in files.columns else F.lit(0)).alias("entry"))
    last = own.groupBy("path").agg(F.max_by(F.struct("bytes", "sha256"), "entry").alias("f")).select("path", "f.*")
    return last.join(stats, "path", "left")


def upserted(entries: DataFrame, new: DataFrame, key: str = "dt") -> DataFrame:
    """A manifest with new entries in place of those of the same key; of several new ones the last (by ``entry``) wins."""
    cols = [c for c in entries.columns if c != key]
    newest = new.groupBy(key).agg(F.max_by(F.struct(*cols), "entry").alias("r")).select(key, "r.*")
    return entries.join(newest.select(key), key, "left_anti").select(key, *cols).unionByName(newest)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, ext, dt, bytes) of every dated file below a folder; other names are ignored. Contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    p = r"(\d{4}-\d{2}-\d{2})\.([A-Za-z0-9]+)$"
    return f.select("path", F.regexp_extract("path", p, 2).alias("ext"), F.to_date(F.nullif(F.regexp_extract("path", p, 1), F.lit("")), "yyyy-MM-dd").alias("dt"), F.col("length").alias("bytes")).where("dt IS NOT NULL")


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """Parameters in JSON, or in YAML (one document a file) where a YAML parser is installed."""
    if not path.endswith((".yml", ".yaml")):
        return spark.read.option("multiLine", "true").json(path)
    import json

    import yaml

    out = None
    for r in spark.read.text(path, wholetext=True).collect():  # parameter files: a few small ones
        text = json.dumps(yaml.safe_load(r["value"]))
        one = spark.createDataFrame([(text,)], "value string").select(F.from_json("value", F.schema_of_json(F.lit(text))).alias("p")).select("p.*")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """A store of kind, ticker and day partitions; overwriting replaces only the days written."""
    cols = [c for c in ("kind", "ticker", "dt") if c in df.columns]
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*cols).parquet(path)


def write_gated(rows: DataFrame, path: str, sentinel_ms: int = 60_000, ts: str = "tc_ms") -> None:
    """A delta-gated store: only what the gate writes, by ticker and day, appended."""
    from ..operators.sequential import delta_gated

    out = delta_gated(rows, sentinel_ms, ts)
    write_table(out.withColumn("dt", F.to_date(F.timestamp_millis("ts"))), path)


def write_bars(bars: DataFrame, path: str, kind: str, ts: str = "close_ts") -> None:
    """Bars by kind, ticker and the day that their kind routes them to."""
    from ..operators.ranges import routed_days

    write_table(routed_days(bars, kind, ts).withColumn("kind", F.lit(kind)), path)
