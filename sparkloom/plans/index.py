"""The index: the documents table and segments of postings, both Parquet, in parts that are never changed.

Update N writes ``docs/v=N``, the rows that came, after ``gone/v=N``, the paths that they replace or that were removed, and
``ids/v=N``, the last id given. A part counts once its ``_SUCCESS`` mark is there. The documents are the rows of all parts
whose path isn't gone in a later one. So an update costs what came, not what is there; once the parts since the last whole
table ``full/v=N`` have half as many rows as it, or are many, all live rows are written as the next one.
Postings go to ``postings/segment=N``; entries of documents that were replaced find no live document and so drop out of
every answer. ``compact`` writes those of live documents as ``merged/segment=N``. What is superseded stays for requests
that still read it, until ``vacuum``.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import CorruptIndex, IndexNotFound
from ..functions.text import under
from ..operators import postings as post
from ..sources import corpus, files

FOLDER = ".sparkloom"
DOCS = (
    "doc_id long, path string, kind string, language string, mtime timestamp, size long, file_hash long, title string, text string, norm string, snippet string, doc_type string, "
    "dates array<date>, amounts array<double>, emails array<string>, entities array<string>, simhash long, segment int"
)
NAMES = [c.split(" ")[0] for c in DOCS.split(", ")]
#: Segments beyond which ``compact`` is worth while.
MANY_SEGMENTS = 8
#: Parts of the documents since the last whole table beyond which the next one is written, whatever their size.
MANY_PARTS = 256


@dataclass(frozen=True)
class IndexStats:
    added: int
    skipped: int
    removed: int
    errors: int


def resolve_index(given: str | None = None, start: str | None = None, must_exist: bool = True) -> str:
    """The folder given, else the nearest one above the start, else one at home."""
    if given is None:
        here = os.path.abspath(start or os.getcwd())
        while given is None:
            if os.path.isdir(os.path.join(here, FOLDER)):
                given = os.path.join(here, FOLDER)
            elif os.path.dirname(here) == here:
                given = os.path.join(os.path.expanduser("~"), FOLDER)
            here = os.path.dirname(here)
    if must_exist and "://" not in given and not os.path.isdir(given):
        raise IndexNotFound(given)
    return given


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    folder: str
    with_postings: bool = field(default=True)

    def _list(self, name: str) -> list[tuple[str, bool]]:
        """(name, whether it is complete) of a folder's entries, in any store that Spark reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        return [(s.getPath().getName(), fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))) for s in fs.listStatus(path)]

    def _numbers(self, name: str, prefix: str) -> list[int]:
        return sorted(int(n.removeprefix(prefix)) for n, whole in self._list(name) if whole and n.startswith(prefix) and n.removeprefix(prefix).isdigit())

    def _live(self, whole: str, parts: str, prefix: str) -> tuple[int | None, list[int]]:
        """(the last whole table's number, the numbers of the parts after it)."""
        base = max(self._numbers(whole, prefix), default=None)
        return base, [n for n in self._numbers(parts, prefix) if base is None or n > base]

    def _parts(self, name: str, numbers: list[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/v={n}" for n in numbers])

    def version(self) -> int:
        base, later = self._live("full", "docs", "v=")
        return max([base or 0, *later])

    def segments(self) -> list[int]:
        base, later = self._live("merged", "postings", "segment=")
        return ([] if base is None else [base]) + later

    def docs(self) -> DataFrame:
        base, later = self._live("full", "docs", "v=")
        found = [self._parts("full", [base])] if base is not None else []
        found += [self._parts("docs", later)] if later else []
        if not found:
            return self.spark.createDataFrame([], DOCS)
        for part in found:
            if missing := set(NAMES) - set(part.columns):
                raise CorruptIndex(f"{self.folder}: the documents lack {sorted(missing)}")
        rows = reduce(DataFrame.union, [part.select(*NAMES, "v") for part in found])
        if not later:
            return rows.select(NAMES)
        gone = self._parts("gone", later).groupBy("path").agg(F.max("v").alias("until"))
        return rows.join(gone, (rows["path"] == gone["path"]) & (rows["v"] < gone["until"]), "left_anti").select(NAMES)

    def postings(self) -> DataFrame | None:
        base, later = self._live("merged", "postings", "segment=")
        own = [] if base is None else [f"{self.folder}/merged/segment={base}"]
        own += [f"{self.folder}/postings/segment={n}" for n in later]
        return self.spark.read.schema(post.SCHEMA).parquet(*own) if own else None

    def doc(self, doc_id: int) -> DataFrame:
        return self.docs().where(F.col("doc_id") == doc_id)

    def doc_id_for_path(self, path: str) -> DataFrame:
        return self.docs().where(F.col("path") == path).select("doc_id")

    def all_docs(self) -> DataFrame:
        return self.docs().orderBy("path")

    def doc_count(self) -> int:
        return self.docs().count()

    def needs_compaction(self) -> bool:
        return len(self.segments()) > MANY_SEGMENTS

    def diff(self, walked: DataFrame, root: str, full: bool = False, only_walked: bool = False) -> DataFrame:
        """(path, status) with status new, changed (perhaps), same, removed or elsewhere; the last two not with ``only_walked``."""
        w = walked.select("path", F.col("mtime").alias("w_mtime"), F.lit(True).alias("walked"))
        d = self.docs().select("path", F.col("mtime").alias("d_mtime"), F.lit(True).alias("stored"))
        if only_walked:
            d = d.join(w.select("path"), "path", "left_semi")
        status = (
            F.when(F.col("stored").isNull(), "new")
            .when(F.col("walked").isNull(), F.when(under(F.col("path"), root), "removed").otherwise("elsewhere"))
            .when(F.lit(full) | (F.col("w_mtime") != F.col("d_mtime")), "changed")
            .otherwise("same")
        )
        return w.join(d, "path", "full_outer").select("path", status.alias("status"))

    def update(self, root: str, full: bool = False) -> IndexStats:
        """Bring the index up to date with the files below a root, a folder or an address with a scheme; other roots' documents stay.

        A file of the same time is skipped unread, one with the same bytes after
        reading, unless ``full``. A file that fails to parse keeps its old record.
        """
        if "://" in root:  # a store: listed and read by Spark, on the executors
            root = files.qualified(self.spark, root)
            walked = files.binary_frame(self.spark, root)
            diff = self.diff(walked, root, full)
            return self.apply(walked, diff, files.read_store(self.spark, root, diff.where("status in ('new', 'changed')")), full)
        root = os.path.abspath(root)
        walked = files.walk_frame(self.spark, root)
        diff = self.diff(walked, root, full)
        return self.apply(walked, diff, files.read(diff.where("status in ('new', 'changed')")), full)

    def apply(self, walked: DataFrame, diff: DataFrame, parsed: DataFrame, full: bool = False) -> IndexStats:
        """Write the next part from a diff and the parsed files; no file may be parsed twice, so they are staged."""
        version, segment = self.version() + 1, max(self.segments(), default=-1) + 1
        staged_path = f"{self.folder}/staged/v={version}"
        read = diff.where("status in ('new', 'changed')").select("path")
        known = self.docs().select("path", F.col("file_hash").alias("old_hash")).join(read, "path", "left_semi")
        state = F.when(F.col("error").isNotNull(), "error").when(F.lit(not full) & F.coalesce(F.col("file_hash") == F.col("old_hash"), F.lit(False)), "same").otherwise("added")
        staged = parsed.join(known, "path", "left").withColumn("state", state).repartitionByRange("path").withColumn("part", F.spark_partition_id())
        staged.write.mode("overwrite").parquet(staged_path)
        staged = self.spark.read.schema(staged.schema).parquet(staged_path)
        counts = {r["state"]: r["count"] for r in staged.groupBy("state").count().collect()}
        statuses = {r["status"]: r["count"] for r in diff.groupBy("status").count().collect()}
        stats = IndexStats(counts.get("added", 0), statuses.get("same", 0) + counts.get("same", 0), statuses.get("removed", 0), counts.get("error", 0))
        if not stats.added and not stats.removed:
            return stats
        # ids are never given again: entries of removed documents stay in the postings
        given = self._parts("ids", [version - 1]).first()["last"] if version > 1 else -1
        added = staged.where("state = 'added'")
        # ids ascend with the path: a rank in each range part, shifted by the parts before
        sizes = added.groupBy("part").count()
        base = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("base"))
        rank = F.row_number().over(Window.partitionBy("part").orderBy("path"))
        numbered = added.withColumn("rank", rank).join(F.broadcast(base), "part").withColumn("doc_id", (F.col("base") + F.col("rank") + F.lit(given)).cast("long"))
        fresh = corpus.analysed(numbered.join(walked, "path").withColumn("segment", F.lit(segment))).select(NAMES)
        gone = diff.where("status = 'removed'").select("path").union(added.select("path"))
        gone.write.mode("overwrite").parquet(f"{self.folder}/gone/v={version}")
        self.spark.range(1).select(F.lit(given + stats.added).cast("long").alias("last")).write.mode("overwrite").parquet(f"{self.folder}/ids/v={version}")
        fresh.write.mode("overwrite").parquet(f"{self.folder}/docs/v={version}")
        if self.with_postings and stats.added:
            now = self._parts("docs", [version])
            post.write(post.build(now), f"{self.folder}/postings/segment={segment}", "overwrite")
        self._fold()
        return stats

    def _fold(self) -> None:
        """Write all live rows as one table where the parts since the last one have half as many rows, or are many. A row that came counts with its path."""
        base, later = self._live("full", "docs", "v=")
        if len(later) < 2:
            return
        rows = self._parts("docs", later).count() + self._parts("gone", later).count()
        if len(later) > MANY_PARTS or rows >= (self._parts("full", [base]).count() if base is not None else 0):
            self.docs().write.mode("overwrite").parquet(f"{self.folder}/full/v={later[-1]}")

    def errors(self) -> DataFrame:
        """(path, error) of the latest update that read files."""
        latest = max(self._numbers("staged", "v="), default=0)
        if not latest:
            return self.spark.createDataFrame([], "path string, error string")
        return self.spark.read.parquet(f"{self.folder}/staged/v={latest}").where("error is not null").select("path", "error")

    def compact(self) -> None:
        """Write all postings of live documents as one segment, in place of those so far."""
        if old := self.segments():
            live = self.postings().join(self.docs().select("doc_id"), "doc_id", "left_semi").select("trigram", "doc_id", "positions", "tf")
            post.write(live, f"{self.folder}/merged/segment={old[-1] + 1}", "overwrite")

    def vacuum(self) -> None:
        """Delete what is superseded; only while no request reads the index."""
        jvm = self.spark.sparkContext._jvm
        base, segment = (max(self._numbers(name, prefix), default=0) for name, prefix in (("full", "v="), ("merged", "segment=")))
        dead = [f"{name}/v={n}" for name, upto in (("docs", base), ("gone", base), ("full", base - 1), ("ids", self.version() - 1), ("staged", self.version() - 1)) for n in self._numbers(name, "v=") if n <= upto]
        dead += [f"{name}/segment={n}" for name, upto in (("postings", segment), ("merged", segment - 1)) for n in self._numbers(name, "segment=") if segment and n <= upto]
        for name in dead:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
