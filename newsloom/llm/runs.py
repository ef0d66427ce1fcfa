"""Pairs within groups, without holding a group in one task.

A group of members that met under one key becomes one *run* if it is small.  A
larger one is cut into parts of about ``limit`` members by a hash of the id, and
every two parts form a block of their own, so that the work of one hot key
spreads over as many tasks as it has blocks.  No member is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocked(met: DataFrame, limit: int, keep: list[str]) -> DataFrame:
    """(key, block, is_left, is_right, *keep) from (key, id, members, ...).

    In block (i, i) all members are on both sides; in block (i, j), part i is on
    the left and part j on the right.  Two members meet in exactly one block.
    """
    parts = F.ceil(F.col("members") / limit).cast("int")
    part = F.pmod(F.xxhash64("id", F.lit(17)), parts).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    return (
        met.select("key", *keep, parts.alias("parts"), part.alias("part"))
        .select("key", *keep, "parts", "part", F.explode(others).alias("b"))
        .select("key", *keep, (F.col("b.i") * F.col("parts") + F.col("b.j")).alias("block"), (F.col("part") == F.col("b.i")).alias("is_left"), (F.col("part") == F.col("b.j")).alias("is_right"))
    )


def over_runs(columns: list[str], handle: Callable[[list[tuple]], list[tuple]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function for rows sorted by (key, block): ``handle`` gets each run of two or more."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        parts = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(parts, schema, strict=True)], schema=schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in it:
            found: list[tuple] = []
            keys = zip(batch.column("key").to_pylist(), batch.column("block").to_pylist(), strict=True)
            for key, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
                if key != current:
                    if len(rows) > 1:
                        found += handle(rows)
                    current, rows = key, []
                rows.append(row)
            yield emit(found)
        yield emit(handle(rows) if len(rows) > 1 else [])

    return run
