"""Files as DataFrames: the walk, and reading with errors kept per file."""

from __future__ import annotations

import datetime
import os

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SearchError
from .ignore import Rules, ignored
from .kinds import detect_kind, kind, language
from .parsers import parse

WALK = "path string, kind string, language string, mtime timestamp, size long"
READ = "path string, file_hash long, text string, title string, error string"


def walk(root: str) -> list[tuple]:
    """(path, kind, language, mtime, size) of the files below root that are of a known kind.

    Hidden names and what ignore files name are left out; entries that can't be read are skipped.
    """
    out = []

    def visit(folder: str, chain: list[Rules]) -> None:
        chain = [*chain, Rules.of(folder)]
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            try:
                is_dir = e.is_dir(follow_symlinks=False)
                if e.name.startswith(".") or ignored(e.path, is_dir, chain):
                    continue
                if is_dir:
                    visit(e.path, chain)
                elif e.is_file() and detect_kind(e.path)[0] != "unknown":
                    stat = e.stat()
                    out.append((e.path, *detect_kind(e.path), datetime.datetime.fromtimestamp(stat.st_mtime, datetime.UTC), stat.st_size))
            except OSError:
                continue

    if os.path.isfile(root):
        stat = os.stat(root)
        if detect_kind(root)[0] != "unknown":
            out.append((root, *detect_kind(root), datetime.datetime.fromtimestamp(stat.st_mtime, datetime.UTC), stat.st_size))
    else:
        visit(os.path.abspath(root), [])
    return out


def walk_frame(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame(walk(root), WALK)


def binary_frame(spark: SparkSession, root: str) -> DataFrame:
    """The walk's columns from Spark's binary file source, for stores that the driver can't list as folders.

    Only names and sizes are read. Names with a leading dot or underscore are hidden there; ignore files don't count.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select("path", kind(F.col("path")).alias("kind"), language(F.col("path")).alias("language"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return rows.where("kind != 'unknown'")


def qualified(spark: SparkSession, root: str) -> str:
    """An address as Spark's file sources write it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def read_store(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """The same as ``read`` for files of any store that Spark reads; an error of parsing is kept in its row."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(kind(F.col("path")) != "unknown")
    return parse_contents(every.join(paths.select("path"), "path", "left_semi"))


def _parse(rows):
    out = {c: [] for c in ("path", "file_hash", "text", "title", "error")}
    for path, data, error in rows:
        text = title = None
        if data is not None:
            try:
                text, title = parse(path, data)
            except SearchError as e:
                error = f"{type(e).__name__}: {e}"
        h = None if data is None else xxhash.xxh64_intdigest(data)
        for c, v in zip(out, (path, None if h is None else h - (1 << 64) * (h >> 63), text, title, error), strict=True):
            out[c].append(v)
    return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64() if c == "file_hash" else pa.string()) for c, v in out.items()})


def _load(paths):
    for path in paths:
        try:
            with open(path, "rb") as f:
                yield path, f.read(), None
        except OSError as e:
            yield path, None, f"{type(e).__name__}: {e}"


def read(paths: DataFrame, batch: int = 64) -> DataFrame:
    """(path, file_hash, text, title, error) of files that executors see under the same path; an error is kept in its row."""

    def run(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            for i in range(0, len(names), batch):
                yield _parse(_load(names[i : i + batch]))

    return paths.select("path").mapInArrow(run, READ)


def parse_contents(files: DataFrame) -> DataFrame:
    """The same for rows with path and content, such as those of the binary file source."""

    def run(batches):
        for b in batches:
            yield _parse((p, c, None) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))

    return files.select("path", "content").mapInArrow(run, READ)
