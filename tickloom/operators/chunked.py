"""Folds of long series in many tasks: a series is cut into slices of its order, and every slice is a task's work.

Two ways to know the state that a slice begins with, both exact:

* ``speculated``: a slice first runs over the end of the slice before it (the halo), from a fresh state. Guards, gates and deadbands
  forget where they came from as soon as they accept, write or emit, so the state is nearly always right by then. Every slice
  tells the state it began and ended with; one that began otherwise than the slice before it ended is run again from
  there, in units of twice as many slices each round. The first slice is right, each round makes at least the next one right, and
  after log2(slices) rounds a series is one unit: a fold that never forgets costs what it would in one task, no other more than it must.
* ``composed``: exponential means are affine maps, which compose. A slice tells the map that it is; the maps of a series are applied
  one after another, a row a slice, and every slice runs from the state so found.

Rows come to Python in Arrow batches, sorted by Spark; a task holds a batch and a state. What a round finds is a table in the shared folder,
so a lost executor costs a slice. Slices are dealt out by (key, slice): no task has a whole series, whichever key is hot. Null keys
are a series; rows with a null order come first.
"""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Callable, Iterator
from dataclasses import is_dataclass
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import dealt, written

#: What slices tell beside their rows: the state before and after (as text that is equal where they are), and after (to go on from).
TOLD = "_slice bigint, _before string, _after string, _state binary"
#: Moves a state on over consecutive rows of one series, and gives their output rows.
Advance = Callable[[Any, pa.RecordBatch], pa.RecordBatch]


def sign(state: Any) -> str:  # noqa: ANN401
    return repr(state) if is_dataclass(state) else pickle.dumps(state).hex()


@lru_cache
def _row(names: tuple[str, ...]) -> Callable:
    return namedtuple("Row", names)._make


def by_row(schema: pa.Schema, step: Callable[[Any, Any], list[tuple]]) -> Advance:
    """advance() from a step for single rows, which come as named tuples."""

    def advance(state: Any, rows: pa.RecordBatch) -> pa.RecordBatch:  # noqa: ANN401
        make = _row(tuple(rows.schema.names))
        out = [o for values in zip(*(c.to_pylist() for c in rows.columns), strict=True) for o in step(state, make(values))]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return advance


def segments(batch: pa.RecordBatch, columns: list[int]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(values, rows) of runs of rows that agree in the columns."""
    n = batch.num_rows
    if not n:
        return
    new = np.zeros(n, bool)
    new[0] = True
    lists = [batch.column(c).to_pylist() for c in columns]
    for v in lists:
        new[1:] |= np.fromiter((a != b for a, b in zip(v[1:], v[:-1], strict=True)), bool, n - 1)
    cuts = [*np.flatnonzero(new).tolist(), n]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield tuple(v[a] for v in lists), batch.slice(a, b - a)


def _slice(order: str, width: int) -> F.Column:
    return F.coalesce(F.floor(F.col(order) / F.lit(width)), F.lit(-(1 << 62))).cast("long")


def _out(rows: pa.RecordBatch, at: int) -> pa.RecordBatch:
    """Output rows with their slice, and nothing told."""
    n = rows.num_rows
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(n, at, np.int64)), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())], names=[*rows.schema.names, "_slice", "_before", "_after", "_state"])


def _told(schema: pa.Schema, key: str, name: Any, at: int, before: str, state: Any) -> pa.RecordBatch:  # noqa: ANN401
    own = [pa.array([name], f.type) if f.name == key else pa.nulls(1, f.type) for f in schema]
    return pa.RecordBatch.from_arrays([*own, pa.array([at], pa.int64()), pa.array([before]), pa.array([sign(state)]), pa.array([pickle.dumps(state)])], names=[*schema.names, "_slice", "_before", "_after", "_state"])


def _with_halo(df: DataFrame, order: str, width: int, halo: int) -> DataFrame:
    """df with _slice and _halo; rows of the last halo of a slice stand before the next one as well."""
    own = _slice(order, width)
    part = lambda at, halo: F.struct(at.alias("at"), F.lit(halo).alias("halo"))
    both = F.when(F.pmod(F.col(order), F.lit(width)) >= width - halo, F.array(part(own, False), part(own + 1, True))).otherwise(F.array(part(own, False)))
    return df.withColumn("_p", F.explode(both)).select(*df.columns, F.col("_p.at").alias("_slice"), F.col("_p.halo").alias("_halo"))


def _from_guesses(df: DataFrame, key: str, order: list[str], schema: StructType, make: Callable, advance: Advance, width: int, halo: int) -> DataFrame:
    kind = arrow(schema)
    k, n = df.columns.index(key), len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, before = None, None, None
        for batch in batches:
            for (name, at, ahead), rows in segments(batch, [k, n, n + 1]):
                if now != (name, at):
                    if before is not None:
                        yield _told(kind, key, *now, before, state)
                    now, state, before = (name, at), make(), None
                own = rows.select(range(n))
                if ahead:
                    advance(state, own)
                else:
                    before = sign(state) if before is None else before
                    yield _out(advance(state, own), at)
        if before is not None:
            yield _told(kind, key, *now, before, state)

    rows = _with_halo(df, order[0], width, halo)
    return dealt(rows, key, "_slice").sortWithinPartitions(key, "_slice", F.col("_halo").desc(), *order).mapInArrow(run, _spark(schema))


def _from_states(df: DataFrame, seeds: DataFrame, key: str, order: list[str], schema: StructType, advance: Advance, width: int) -> DataFrame:
    """The slices of seeds (key, _slice, _unit, _seed), a unit's from the state of its first slice on (where _seed is not null)."""
    kind = arrow(schema)
    k, n = df.columns.index(key), len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, before = None, None, None
        for batch in batches:
            for (name, unit, at, seeded), rows in segments(batch, [k, n, n + 1, n + 2]):
                if now is not None and now != (name, unit, at) and before is not None:
                    yield _told(kind, key, now[0], now[2], before, state)
                    before = None
                now = name, unit, at
                if seeded:
                    state = pickle.loads(rows.column(n + 3)[0].as_py())
                else:
                    before = sign(state) if before is None else before
                    yield _out(advance(state, rows.select(range(n))), at)
        if before is not None:
            yield _told(kind, key, now[0], now[2], before, state)

    r = df.withColumn("_slice", _slice(order[0], width)).alias("r")
    s = seeds.select(F.col(key).alias("_key"), F.col("_slice").alias("_at"), "_unit").alias("s")
    rows = r.join(s, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_at"))).select(*[f"r.{c}" for c in df.columns], "_unit", "_slice", F.lit(False).alias("_seeded"), F.lit(None).cast("binary").alias("_seed"))
    empty = [F.col(f.name) if f.name == key else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
    heads = seeds.where("_seed IS NOT NULL").select(*empty, "_unit", "_slice", F.lit(True).alias("_seeded"), "_seed")
    both = rows.unionByName(heads)
    return dealt(both, key, "_unit").sortWithinPartitions(key, "_unit", "_slice", F.col("_seeded").desc(), *order).mapInArrow(run, _spark(schema))


def _spark(schema: StructType) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), TOLD])


def arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _checked(found: DataFrame, key: str, fresh: str, size: int) -> DataFrame:
    """(key, _slice, _unit, _seed) of what must run again: of each unit of so many slices the first wrong one and all behind it."""
    w = Window.partitionBy(key).orderBy("_slice")
    told = found.where("_state IS NOT NULL").select(key, "_slice", "_before", "_after", "_state")
    told = told.withColumn("_seed", F.lag("_state").over(w)).withColumn("_wrong", F.col("_before") != F.coalesce(F.lag("_after").over(w), F.lit(fresh)))
    told = told.withColumn("_unit", F.floor((F.row_number().over(w) - 1) / size))
    unit = Window.partitionBy(key, "_unit").orderBy("_slice")
    told = told.withColumn("_begun", F.max(F.col("_wrong").cast("int")).over(unit)).where("_begun = 1")
    return told.withColumn("_seed", F.when(F.row_number().over(unit) == 1, F.col("_seed"))).select(key, "_slice", "_unit", "_seed")


def speculated(df: DataFrame, key: str, order: list[str], schema: StructType, make: Callable, advance: Advance, width: int, halo: int | None = None, most_rounds: int = 64) -> DataFrame:
    """What one task would give that ran advance() over each series from make(), by slices of order[0] that are width wide. key is an output column."""
    found = written(_from_guesses(df, key, order, schema, make, advance, width, width // 4 if halo is None else halo), "slices")
    for k in range(1, most_rounds):
        again = written(_checked(found, key, sign(make()), 1 << k), "wrong_slices")
        if again.isEmpty():
            break
        new = written(_from_states(df, again, key, order, schema, advance, width), "slices")
        a = again.select(F.col(key).alias("_key"), F.col("_slice").alias("_at"))
        found = found.join(a, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_at")), "left_anti").unionByName(new)
    else:
        raise RuntimeError("slices still begin otherwise than those before them end")
    return found.where("_state IS NULL").select(*[f"`{f.name}`" for f in schema])


def composed(df: DataFrame, key: str, order: list[str], schema: StructType, make: Callable, summary: Callable, advance: Advance, width: int) -> DataFrame:
    """The same where a slice is a map: summary() gives one with add(rows) and apply(state), which gives the state after."""
    k, n = df.columns.index(key), len(df.columns)
    name_type = df.schema[key].dataType.simpleString()

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([now[1]], pa.int64()), pa.array([pickle.dumps(made)])], [key, "_slice", "_map"])

        for batch in batches:
            kind = batch.schema.field(k).type
            for at, rows in segments(batch, [k, n]):
                if at != now:
                    if now is not None:
                        yield row()
                    now, made = at, summary()
                made.add(rows.select(range(n)))
        if now is not None:
            yield row()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            seeds = []
            for name, m in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name != now:
                    now, state = name, make()
                seeds.append(pickle.dumps(state))
                state = pickle.loads(m).apply(state)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(1), pa.array(seeds, pa.binary())], [key, "_slice", "_unit", "_seed"])

    rows = df.withColumn("_slice", _slice(order[0], width))
    found = dealt(rows, key, "_slice").sortWithinPartitions(key, "_slice", *order).mapInArrow(maps, f"`{key}` {name_type}, _slice bigint, _map binary")
    seeds = written(dealt(found, key).sortWithinPartitions(key, "_slice").mapInArrow(chain, f"`{key}` {name_type}, _slice bigint, _unit bigint, _seed binary"), "slice_states")
    out = _from_states(df, seeds, key, order, schema, advance, width)
    return out.where("_state IS NULL").select(*[f"`{f.name}`" for f in schema])
