"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of about so many bytes are worked on at a time inside one Arrow batch.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows under one key are dealt over so many tasks where a key may hold most rows.
SALT = 8
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir or the context's checkpoint folder.

    Where neither is set, a session within one process (local master) gets a folder of its own; a cluster fails.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quernstone-"))
        named = sc.getCheckpointDir()
    return named


#: Tables that have been written and not deleted, in order.
_settled: list[DataFrame] = []


def settle(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write are given back when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    _settled.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete settled tables that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _settled[:] = [x for x in _settled if x is not df]


def mark() -> int:
    """How many tables there are; for release()."""
    return len(_settled)


def release(since: int, keep: DataFrame) -> None:
    """Delete the tables written since a mark, but one: its own plan reads nothing else any more."""
    drop(*(x for x in _settled[since:] if x is not keep))


def lookup(df: DataFrame, found: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """df joined with found by key; rows of a hot key in df are dealt over SALT tasks by the column by, and found goes to each of them."""
    salt = "__salt"
    many = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return df.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int")).join(many.hint("merge"), [key, salt], how).drop(salt)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: it goes to them as a zip, once for each application.

    Arrow batches of the session get a bound of SLICE_BYTES, if it has none that is
    lower: executor and worker each hold a batch whole, 64 MB by Spark's default.
    """
    sc = spark.sparkContext
    if not 0 < sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) <= SLICE_BYTES:
        spark.conf.set(_BATCH, SLICE_BYTES)
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(sc._temp_dir, "quernstone.zip")  # the driver serves it to executors
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def pack_numbers(numbers: np.ndarray) -> bytes:
    """64-bit numbers by planes of equal bytes, so that bytes without content take no room."""
    planes = np.ascontiguousarray(numbers.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def steps(ascending: np.ndarray) -> np.ndarray:
    """The first number and each one's distance from the one before."""
    return np.diff(ascending, prepend=np.zeros(1, np.uint64))


def give_back() -> None:
    """Return what this worker has freed to the system, as it stays alive for the next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function on batches that ends with give_back()."""

    @functools.wraps(run)
    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each part take about size bytes; a longer single text stays whole.

    Ends with give_back().
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        total = max(1, batch.column(column).get_total_buffer_size())
        step = max(1, batch.num_rows * size // total)
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
        del batch  # before the next one comes
    give_back()


def default_tokenizer() -> str:
    """Place of the public byte-level vocabulary; every operator takes it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
