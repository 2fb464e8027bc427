"""Helpers that several text operators use: tables, staging, size-checked joins."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.sources import staging
from wardline.sources.staging import scratch_dir  # noqa: F401  for the operators

#: A side is broadcast only if it was counted and has at most so many (narrow) rows.
BROADCAST_ROWS = 250_000


#: Texts are long: batches between the JVM and Python hold so many bytes, or one row, whatever the session allows.
ARROW_BYTES = 4 << 20


def _bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, in batches of ``ARROW_BYTES`` where Python is used."""
    _bound_batches(df.sparkSession)
    return staging.staged(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a staged table is known to fit a broadcast (one count, no rows fetched)."""
    return df.count() <= limit


def hinted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a count; a larger table joins by shuffle."""
    return F.broadcast(df) if small(df, limit) else df


_kept: dict = {}


def trim() -> None:
    """Return freed pages to the system, without looking for garbage: cheap enough between the batches of a task."""
    pa.default_memory_pool().release_unused()
    of_libc = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if of_libc is not None:
        of_libc(0)


def give_back() -> None:
    """Return what a worker process has freed to the system: allocators hold on to it, and its neighbours need it."""
    gc.collect()
    trim()


def kept(key: object, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task: one large object, which makes room for that of other work."""
    if key not in _kept:
        _kept.clear()
        give_back()
        _kept[key] = make()
    return _kept[key]


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression: ``body`` gets it as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def free_prefix(columns: list[str]) -> str:
    """What no column's name begins with, in whatever case: for columns that are added on the way."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def without_rows(docs: DataFrame, dropped: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``docs`` less the rows whose key expressions equal a row of ``dropped`` (nulls equal nulls).

    ``dropped`` is a staged narrow table with the columns named in ``keys``. Columns of ``docs`` may have any names.
    """
    own, theirs = (f"{free_prefix(docs.columns)}{x}_" for x in ("own", "drop"))
    side = hinted(dropped.select(*[F.col(k).alias(f"{theirs}{k}") for k in keys]))
    marked = docs.withColumns({f"{own}{k}": e for k, e in keys.items()})
    on = [F.col(f"{own}{k}").eqNullSafe(F.col(f"{theirs}{k}")) for k in keys]
    return marked.join(side, on, "left_anti").drop(*[f"{own}{k}" for k in keys])
