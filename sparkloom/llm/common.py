"""Helpers shared by the corpus operators: shared storage, sampling, memos.

Conventions of every operator here
----------------------------------
* Input columns are named by parameters and selected first, so extra columns,
  whatever their names, never clash with internal ones.
* Rows whose id is null take no part and are not returned.
* A null text counts as the empty text.
* Rows that repeat an id are each processed and each returned.
* An empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Resolution of the hash that draws bounded samples.
SAMPLE_STEPS = 1 << 30
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset (local runs, tests) a temporary folder of this machine is
    used, which is enough because all tasks then run on it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:  # with its scheme, so that a path means the same to Spark and to other readers
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="sparkloom-"))
    return _own[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    The lineage ends at files that survive the loss of any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete what ``materialize`` and ``scratch_path`` left in the shared folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sparkloom")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def draw(key: Column, share: Column | float, salt: str) -> Column:
    """True for about ``share`` of the keys, the same ones on every run."""
    step = F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(SAMPLE_STEPS))
    return step < (F.lit(share) if isinstance(share, float) else share) * SAMPLE_STEPS


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_held: dict = {}


def held(key, make):
    """What ``make`` gives, kept in this worker process until another key is asked for.

    Processes outlast tasks and stages, so only one model stays in memory at a time.
    """
    if key not in _held:
        forget()
        _held[key] = make()
    return _held[key]


def forget() -> None:
    """Drop what this worker process holds, before work that needs no model, and give free memory back to the system."""
    _held.clear()
    trim()


def trim() -> None:
    """Give memory that is free but still this process's back to the system.

    Workers outlast stages; what a stage has freed would else stay with them beside what the next one needs.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library: nothing to do
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch: pa.RecordBatch, column: int, size: int = 2 << 20):
    """The batch in parts of about ``size`` bytes of a text column, at least a row each, so that a part's Python objects stay few."""
    if batch.num_rows == 0:
        yield batch
        return
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


class Memo(dict):
    """A dict that fills itself from ``make`` and holds two generations of at most ``limit`` / 2 keys.

    Once the newer one is full it becomes the older one, from which keys that come up
    again return; so what recurs stays and memory is bounded.
    """

    __slots__ = ("half", "make", "old")

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.half, self.old = make, max(1, limit // 2), {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
