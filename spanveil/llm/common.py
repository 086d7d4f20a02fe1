"""Helpers that the training-data operators share: the folder that all executors see, and written tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, as a whole URI of the file system that Hadoop finds it in.

    Where it is unset, a temporary one of our own if all runs on this machine, as in tests; on a cluster an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        held = sc._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="spanveil-shared-")
        sc.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    path = sc._jvm.org.apache.hadoop.fs.Path(named)
    whole = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString().rstrip("/")
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/spanveil/{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, kind: str) -> DataFrame:
    """Cut the lineage: write a Parquet table to the shared folder and read it back, so that a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Remove a table made by written() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        target = jvm.org.apache.hadoop.fs.Path(name).getParent()
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of a batch that goes to a Python worker (a single row may be longer). Spark's own bound is 256 MB.
BATCH_BYTES = 8 << 20


def _release() -> None:
    """Give freed memory back to the system: Spark keeps its Python workers, and with them what earlier stages took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over batches of bounded bytes; a worker returns its memory when a task ends."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = df.sparkSession.conf.get(name, None)
    if held is None or not held.isdigit() or int(held) > BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(bounded, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(wanted: str, taken: list[str]) -> str:
    """`wanted`, with underscores behind it until no column has that name (Spark doesn't tell upper from lower case)."""
    held = {c.lower() for c in taken}
    while wanted.lower() in held:
        wanted += "_"
    return wanted


def lower_ascii(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """Rows kept from every fit: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
