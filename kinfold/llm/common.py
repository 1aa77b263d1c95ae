"""Shared helpers: intermediate tables, word rules, bindings inside expressions."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.sources.storage import materialize, shared_dir

__all__ = ["SPACE", "let", "looked_up", "materialize", "only_keys", "shared_dir", "sliced", "small_batches", "words"]

#: ASCII white space that separates words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"

#: Rows of a key table that may be broadcast (some 32 MB); larger tables are joined by shuffle.
BROADCAST_ROWS = 1_000_000

#: Bytes of an Arrow batch that goes to Python. Spark's 64 MB are held several times over: buffers of the JVM that grow by
#: doubling, which its allocator keeps afterwards, and the worker's copy.
BATCH_BYTES = 4 << 20


def only_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` whose key ``on`` is in ``keys``. A small table of keys filters in place, so that texts which a following
    shuffle would move for nothing stay where they are."""
    distinct = materialize(keys.select(*on).distinct())
    return rows.join(F.broadcast(distinct) if distinct.count() <= BROADCAST_ROWS else distinct, on, "left_semi")


def looked_up(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Left join of wide ``rows`` with a written table ``found`` that has one row per key. If few keys are in it, the
    other rows aren't shuffled; if it is large, it is a plain join."""
    if found.count() > BROADCAST_ROWS:
        return rows.join(found, on, "left")
    keys = F.broadcast(found.select(*on))
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields if f.name not in on]
    return rows.join(keys, on, "left_semi").join(found, on).unionByName(rows.join(keys, on, "left_anti").select("*", *rest))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``: lambdas inside would else evaluate an inlined expression for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small_batches(spark: SparkSession) -> None:
    """From now on batches for Python hold BATCH_BYTES and a row at most, in this session; a smaller limit stays. Results
    don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release_memory() -> None:
    """Give free memory back to the system: a Python worker lives on, idle, while other stages run."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def sliced(parts: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices: what a task holds as Python objects at once stays small, however large batches are."""
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)
    release_memory()
