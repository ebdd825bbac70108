"""What the operators share: intermediate tables in the cluster's shared folder, row keys, free column names."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session where that is unset gets a temporary one; a cluster must set it, as
    its machines don't share their own folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _file(spark: SparkSession, path: str) -> tuple:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run within are deleted when it is done; the session's setting comes back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, and a lost executor costs
    a read, not a recomputation. The shuffle files of what led to it go at once; the table goes with the scratch() it was made in,
    or else with the session."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill-{uuid.uuid4().hex}-{name}"
    with _shuffles_go(spark):
        df.write.parquet(path)
    files, found = _file(spark, path)
    files.deleteOnExit(found)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafmill_table = path
    if stack := getattr(_scopes, "stack", None):
        stack[-1].append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables made by cut(); frames that read them can't be used any more."""
    for table in tables:
        files, found = _file(table.sparkSession, table._leafmill_table)
        files.delete(found, True)


@contextmanager
def scratch() -> Iterator[Callable[..., DataFrame]]:
    """A scope for tables: those that cut() makes within are deleted at its end, but for those given to the function that it yields.
    These pass to the scope around it, if there is one."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    kept: list[DataFrame] = []

    def keep(*tables: DataFrame) -> DataFrame:
        kept.extend(tables)
        return tables[0]

    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        mine = stack.pop()
        release(*(x for x in mine if not any(x is k for k in kept)))
        if stack:
            stack[-1].extend(kept)


#: A table of fewer bytes than this for each core lies in fewer pieces than there are cores, as Spark splits no further.
SMALL = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it is that small (by the planner's size); larger tables stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL * cores else df


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema); a worker gives back what it has freed after each partition. mapInArrow can't read columns
    with dots or backticks in their names, so these are numbered on the way."""
    names = df.columns
    odd = any(c in name for name in names for c in ".`")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batch.rename_columns(names) for batch in batches) if odd else run(batches)
        give_back()

    return (df.toDF(*(f"c{i}" for i in range(len(names)))) if odd else df).mapInArrow(bounded, schema)


def give_back() -> None:
    """Freed memory goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores behind those that are taken (in upper or lower case)."""
    known, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        out.append(name)
        known.add(name.lower())
    return out


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_keys(*columns: Column, names: tuple[str, str] = ("_k1", "_k2")) -> dict[str, Column]:
    """A 128-bit key of a row's values, never null: two 64-bit hashes with different seeds. Rows get the same
    key when they are repeated, and then any per-row result is the same for both."""
    return {names[0]: F.xxhash64(*columns), names[1]: F.xxhash64(F.lit(0x5DEECE66D), *columns)}


def partitions_for(rows: int, per_partition: int, least: int = 1) -> int:
    return max(least, -(-rows // per_partition))
