"""Scratch tables in the shared folder, batching and small helpers of the operators in this subpackage."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id in join keys, which never match on null.
NULL_ID = -(2**63)
#: Rows and bytes of one Arrow batch; a batch ends with the row that reaches either.
ARROW_ROWS, ARROW_BYTES = 512, 2_000_000


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, one in /tmp is set in local mode, and
    on a cluster that is an error, as executors couldn't see the folder."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lakeloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/lakeloom/{name}-{uuid.uuid4().hex[:12]}"


_scopes: list[list[str]] = []


def cut(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends here and survives lost executors. Within ``temporary``
    the table goes when that ends; ``outer`` leaves it to what is around."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if len(_scopes) > outer:
        _scopes[-1 - outer].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut`` writes within are deleted at the end: what is used later must be stored with ``outer``."""
    _scopes.append([])
    try:
        yield
    finally:
        for name in _scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def prepare_workers(spark: SparkSession) -> None:
    """Ship this package to the executors once, and keep the Arrow batches that reach Python workers small, whatever the
    lengths of the texts. Plans run after their operator has returned, so the session keeps both settings."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    sc = spark.sparkContext
    if not getattr(sc, "_lakeloom_shipped", False):
        package = Path(__file__).resolve().parents[1]
        to = Path(os.path.realpath(tempfile.mkdtemp(prefix="lakeloom-"))) / "lakeloom.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(to))
        sc._lakeloom_shipped = True


_held: dict = {}


def held(name: tuple, make: Callable):
    """A worker's table or model, made on first use. A worker holds one at a time: workers serve all stages of a job."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def task(function):
    """A function of batches whose worker gives memory that is free back to the system when it has ended."""

    @functools.wraps(function)
    def run(*args):
        yield from function(*args)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A number of each row, unlike an id never null and never repeated, and its type.
ROW, ROW_TYPE = "__row", "decimal(38,0)"


def scanned(docs: DataFrame) -> bool:
    """Whether ``docs`` is a table of files read as it is, so that file and place in it tell rows apart."""
    plan = docs._jdf.queryExecution().analyzed()
    return plan.getClass().getSimpleName() == "LogicalRelation" and bool(docs.inputFiles()) and "_metadata" not in docs.columns


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with the column ROW: a hash of the file, and the place in it. So a table is numbered without a copy, and alike in all
    passes, whatever tasks read it; only rows that come from elsewhere are stored first, as are those of two files of one hash."""
    file = F.xxhash64(F.col("_metadata.file_path"))
    if scanned(docs):
        files = docs.select(F.col("_metadata.file_path").alias("f"), file.alias("h")).distinct().agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("m")).first()
    if not scanned(docs) or files["n"] != files["m"]:
        return cut(docs.withColumn(ROW, F.monotonically_increasing_id().cast(ROW_TYPE)), "rows", outer=True)
    place = file.cast("decimal(20,0)") * F.lit(2**40).cast("decimal(13,0)") + F.col("_metadata.row_index").cast("decimal(13,0)")
    return docs.withColumn(ROW, place.cast(ROW_TYPE))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` (from ``numbered``) whose ROW isn't in ``gone`` (stored), without ROW."""
    return docs.join(bounded_broadcast(gone.select(ROW)), ROW, "left_anti").drop(ROW)


def key(col) -> F.Column:
    """A join key for an id that may be null."""
    return F.coalesce(col.cast("long"), F.lit(NULL_ID))


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one, its first row aside, have at most ``most`` bytes."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in col]
        start = held = 0
        for i, n in enumerate(sizes):
            if held + n > most and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


#: Keys of a side that is broadcast at most; a larger side is joined by a shuffle.
BROADCAST_KEYS = 200_000


def bounded_broadcast(side: DataFrame) -> DataFrame:
    """``side`` (stored, of short rows), marked for broadcast if it has BROADCAST_KEYS rows at most."""
    return F.broadcast(side) if side.count() <= BROADCAST_KEYS else side
