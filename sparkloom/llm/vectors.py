"""What the vector searches share: usable rows, shard files, the deal of queries to shards, the merge.

Rows are dealt by a hash of id and vector to shards of about ``shard_rows``. A task builds a shard's
index and puts it as one file into the shared folder, under its own name and then
renamed, so a repeated attempt leaves one whole file. The queries are put there in the same way, in blocks.
A block meets all shards (the stated query set against all rows): a row of the search is the number of a block and a group of
shards, whose files its task reads, so no vector is shuffled for a shard. Only the best of each group go on to the merge.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path

#: Queries of a block, about, and shards that a block meets in one go.
QUERIES = 128
GROUP = 8


def usable(vectors: DataFrame, id_col: str, vec_col: str, more: str = "true") -> DataFrame:
    """(vec_id, v) with v an array of doubles.

    Rows take no part if the id or vector is null, a component is null or not
    finite, the vector is empty or is not of the most frequent length (ties: the longer).
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and v is not null and size(v) > 0").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(more)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["d"] if lengths else 0))


def at_most(rows: DataFrame, k: int) -> DataFrame:
    """The rows, without those of more than k equal ones: no more can be among the k best. So an id that a third of all rows have fills no shard."""
    ids = materialize(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where(F.col("n") > k).select("vec_id"), "repeated")
    if ids.isEmpty():
        return rows
    few = rows.join(ids, "vec_id", "left_semi").groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    return rows.join(ids, "vec_id", "left_anti").union(few.select("vec_id", F.explode(F.array_repeat("v", F.col("n"))).alias("v")))


def lengths_of(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths, also where squares would leave the range of doubles."""
    largest = np.abs(rows).max(1, initial=0)
    return largest * np.linalg.norm(rows / np.where(largest > 0, largest, 1)[:, None], axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def put_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    data = io.BytesIO()
    np.savez(data, **arrays)
    own = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(data.getbuffer())
    store.move(own, f"{path}/{name}")
    return f"{folder}/{name}"


def get_arrays(uri: str) -> dict[str, np.ndarray]:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f, np.load(io.BytesIO(f.read())) as z:
        return {k: z[k] for k in z.files}


def build_shards(rows: DataFrame, shard_rows: int, build: Callable[..., dict[str, np.ndarray]], name: str, more: tuple[str, ...] = ()) -> tuple[str, int]:
    """Write the index files; (folder, number of shards). ``build`` makes a shard's arrays of ids, rows and the columns ``more``."""
    spark = rows.sparkSession
    folder = scratch_path(spark, name)
    shards = max(1, -(-rows.count() // shard_rows))

    def run(table: pa.Table) -> pa.Table:
        shard, ids = table.column("shard")[0].as_py(), np.asarray(table.column("vec_id"))
        order = np.argsort(ids, kind="stable")
        put_arrays(folder, f"shard-{shard:08d}.npz", build(ids[order], matrix(table.column("v"))[order], *(np.asarray(table.column(c))[order] for c in more)))
        return pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([len(ids)], pa.int64())})

    dealt = rows.select("vec_id", "v", *more, F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("long").alias("shard"))
    there = materialize(dealt.groupBy("shard").applyInArrow(run, "shard long, n long"), f"{name}-list")
    if there.count() < shards:  # a hash left a shard empty: rare, and only in small tables
        have = {r["shard"] for r in there.select("shard").collect()}
        width = rows.select(F.size("v").alias("d")).limit(1).collect()
        empty = build(np.empty(0, np.int64), np.empty((0, width[0]["d"] if width else 0)), *(np.empty(0, np.int64) for _ in more))
        for shard in set(range(shards)) - have:
            put_arrays(folder, f"shard-{shard:08d}.npz", empty)
    return folder, shards


def query_rows(rows: DataFrame, every: int) -> DataFrame:
    """(query_id, v) of the ids divisible by ``every``; an id that repeats is asked once, with its least vector."""
    return rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))


def put_queries(queries: DataFrame, lowest: float | int) -> tuple[str, int]:
    """Write the blocks of (query_id, v) and, if there is one, ``bound``; a null bound is ``lowest``, which all scores reach."""
    if "bound" not in queries.columns:
        return build_shards(queries.withColumnRenamed("query_id", "vec_id"), QUERIES, lambda ids, v: {"ids": ids, "rows": v, "bound": np.full(len(ids), lowest)}, "queries")
    filled = queries.select(F.col("query_id").alias("vec_id"), "v", F.coalesce("bound", F.lit(lowest)).alias("bound"))
    return build_shards(filled, QUERIES, lambda ids, v, bound: {"ids": ids, "rows": v, "bound": bound}, "queries", ("bound",))


def search(spark: SparkSession, asked: tuple[str, int], index: tuple[str, int], opened: Callable, k: int, integer: bool, home: bool | None = None) -> DataFrame:
    """(query_id, vec_id, score) of the blocks ``asked`` over the shards of ``index``: k a query and group of shards at most.

    Both are a folder and a number of files. ``opened(arrays)`` gives a function of (query_id, v, bound) to (ids, scores); the bound is the
    query's, or the kth score of the group so far. With ``home`` a block meets only one shard, its home; with False, all others.
    """
    (queries, blocks), (folder, shards) = asked, index
    kind = "long" if integer else "double"
    rows = blocks if home else blocks * -(-shards // GROUP)
    pairs = spark.range(0, rows, 1, min(rows, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def met(row: int) -> tuple[int, list[int]]:
        group, block = divmod(row, blocks)
        if home:
            return block, [block % shards]
        return block, [s for s in range(group * GROUP, min(shards, (group + 1) * GROUP)) if home is None or s != block % shards]

    def run(batches):
        shard, find = None, None
        for row in (x for batch in batches for x in batch.column(0).to_pylist()):
            block, own = met(row)
            if not own:
                continue
            q = get_arrays(f"{queries}/shard-{block:08d}.npz")
            bounds, found = q["bound"].tolist(), [(np.empty(0, np.int64), np.empty(0, np.int64 if integer else np.float64))] * len(q["ids"])
            for s in own:
                if s != shard:
                    shard, find = s, opened(get_arrays(f"{folder}/shard-{s:08d}.npz"))
                for i, (query_id, v) in enumerate(zip(q["ids"].tolist(), q["rows"], strict=True)):
                    ids, scores = find(query_id, v, bounds[i])
                    if len(ids):
                        found[i] = top_of(np.concatenate([found[i][0], ids]), np.concatenate([found[i][1], scores]), k)
                        if len(found[i][0]) == k:
                            bounds[i] = max(bounds[i], found[i][1][-1].item())
            if found:
                owner = np.repeat(q["ids"], [len(ids) for ids, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(owner), *(pa.array(np.concatenate([x[c] for x in found])) for c in (0, 1))], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, f"query_id long, vec_id long, score {kind}")


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]
