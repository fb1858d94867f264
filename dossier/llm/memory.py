"""Memory of Python workers: caches of one owner at a time, and freed memory goes back to the system."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_state: dict[str, object] = {"owner": None, "libc": None, "caches": []}


def cache(drop: Callable[[], None]) -> None:
    """Register what empties a cache of this process; it is called when another owner's work begins."""
    _state["caches"].append(drop)


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    libc = _state["libc"]
    if libc is not None:
        libc.malloc_trim(0)


def _enter(owner: str) -> None:
    if _state["libc"] is None:
        try:
            libc = ctypes.CDLL("libc.so.6")
            libc.malloc_trim(0)
            _state["libc"] = libc
        except (OSError, AttributeError):  # another C library: it gives memory back in its own way
            pass
        pa.set_memory_pool(pa.system_memory_pool())
    if _state["owner"] != owner:
        for drop in _state["caches"]:
            drop()
        _state["owner"] = owner
        _trim()


def lean(owner: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow: caches of other owners are dropped before it, freed memory is returned after it.

    Spark reuses its workers, so what one operator keeps for its next task would lie beside the next
    operator's memory. Caches live as long as tasks of one owner follow each other.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _enter(owner)
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapped


def release(spark: SparkSession) -> None:
    """Garbage of the driver's and the executors' JVMs is collected and its pages go back to the system.

    A JVM keeps the heap that an earlier stage's shuffles made it take. Beside Python workers with caches of
    their own that is memory twice. One short task for each core; a result depends on none of them.
    """
    sc = spark.sparkContext
    sc._jvm.System.gc()
    n = sc.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()
