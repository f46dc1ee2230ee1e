"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.session import delete, partitions, shared_dir, ship_package, stash

__all__ = ["cache_share", "claim", "delete", "documents", "join_counted", "lean", "map_texts", "partitions", "remembers", "shared_dir", "ship_package", "stash", "trim", "utf8"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_TABLES: dict[str, Callable[[], None]] = {}
_OWNER: list[str] = [""]


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """owner keeps tables in the worker process, which outlives a stage; forget empties them."""
    _TABLES[owner] = forget


def claim(owner: str) -> None:
    """From now on this worker process works for owner: the tables of all others are emptied."""
    if _OWNER[0] != owner:
        _OWNER[0] = owner
        for name, forget in _TABLES.items():
            if name != owner:
                forget()
        trim()


@lru_cache(1)
def c_library():
    found = ctypes.util.find_library("c")
    return ctypes.CDLL(found) if found and hasattr(ctypes.CDLL(found), "malloc_trim") else None


def trim() -> None:
    """Give memory that is free back to the system: a worker that waits for its next task should not hold it."""
    pa.default_memory_pool().release_unused()
    if c_library():
        c_library().malloc_trim(0)


def lean(work: Callable) -> Callable:
    """A function of one group, or of two that belong together, that leaves no free memory behind."""

    def one(group: pa.Table) -> pa.Table:
        out = work(group)
        trim()
        return out

    def two(group: pa.Table, other: pa.Table) -> pa.Table:
        out = work(group, other)
        trim()
        return out

    return two if work.__code__.co_argcount == 2 else one


def join_counted(left: DataFrame, right: DataFrame, on: str, size: str) -> DataFrame:
    """left joined with right, which has one row for each key and says in `size` how many rows of left have it.

    Keys that hold more than a quarter of a task's fair share of left, of which there are four a task at most, are
    broadcast; the rows of all others are merged. So no task gets more than its share, whatever one key holds.
    """
    share = 4 * partitions(left.sparkSession)
    total = right.agg(F.sum(size)).first()[0] or 0
    hot = F.broadcast(right.where(F.col(size) * share > total))
    rest = left.join(hot.select(on), on, "left_anti").join(right.hint("merge"), on)
    return left.join(hot, on).unionByName(rest)


def cache_share(spark: SparkSession, total: int) -> int:
    """Bytes that one Python worker may remember, so that the workers of an executor remember `total` together."""
    sc = spark.sparkContext
    tasks = sc.defaultParallelism if sc.master.startswith("local[") or sc.master == "local" else int(sc.getConf().get("spark.executor.cores", "4"))
    return total // max(1, tasks // int(sc.getConf().get("spark.task.cpus", "1")))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column, null as None."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def map_texts(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable], schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows of (id, text, extra...) through make()(record batch) -> record batches; other columns are not read.

    make runs once in each Python worker's task, so that tables it needs are loaded there.
    """
    ship_package(df.sparkSession)
    frame = df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].cast("string").alias("text"), *[df[c] for c in extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return frame.mapInArrow(run, schema)
