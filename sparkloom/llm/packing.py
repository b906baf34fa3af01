"""Best-fit packing by minimum bin slack.

Documents are tokenised, ended with ``end_id`` and cut into pieces of at most
``capacity`` tokens. Which pieces share a sequence depends on their lengths alone,
so the packing is found on the histogram of lengths: at most ``capacity`` rows,
whatever the corpus. For each bin, a bitset subset-sum dynamic program over the
lengths still available finds the fullest combination that fits beside the longest
piece left; the combination is removed as often as the counts allow, which uses up
at least one length, so there are at most ``capacity`` programs to solve.

A piece then finds its place by its rank among the pieces of its length. Ranks are
taken within (bucket, length) groups and shifted by the counts of the buckets
before, so a length that a third of all pieces have is still spread over all tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize, slices
from .tokens import encoder_of


#: Words whose ids a worker remembers; the dict of so many doesn't grow to its next size.
MEMORY = 650_000


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """A multiset of available lengths with the largest sum that is at most ``room``, longer ones first.

    reach[i] has bit s set if the first i chunks can sum to s; chunks hold 1, 2, 4, ... copies of a length.
    """
    mask, bits, chunks, reach = (1 << (room + 1)) - 1, 1, [], [1]
    for length in lengths:
        if length > room:
            continue
        left, k = min(counts[length], room // length), 1
        while left:
            take = min(k, left)
            bits |= (bits << (length * take)) & mask
            chunks.append((length, take))
            reach.append(bits)
            left, k = left - take, 2 * k
        if bits >> room & 1:
            break
    total, out = bits.bit_length() - 1, []
    for i in range(len(chunks), 0, -1):
        if not reach[i - 1] >> total & 1:
            length, take = chunks[i - 1]
            out += [length] * take
            total -= length * take
    return out


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places of all pieces: (length, first rank, last rank + 1, copies a bin, first bin, offset in the bin).

    The piece of rank r is copy (r - first) % copies of bin first_bin + (r - first) // copies.
    """
    counts = {k: n for k, n in histogram.items() if n}
    used, places, first_bin = dict.fromkeys(counts, 0), [], 0
    lengths = sorted(counts, reverse=True)
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        bin_ = [seed, *fullest(lengths, counts, capacity - seed)]
        counts[seed] += 1
        need = {x: bin_.count(x) for x in dict.fromkeys(bin_)}
        times, offset = min(counts[x] // n for x, n in need.items()), 0
        for x, n in need.items():
            places.append((x, used[x], used[x] + times * n, n, first_bin, offset))
            used[x] += times * n
            counts[x] -= times * n
            offset += n * x
        first_bin += times
        lengths = [x for x in lengths if counts[x]]
    return places


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, copy, piece, start, length, ids_crc32); ``copy`` tells rows with one id and several texts apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")

    def run(batches):
        encode = encoder_of(tokenizer, MEMORY).encode
        for batch in (part for whole in batches for part in slices(whole, 1)):
            out = {c: [] for c in ("doc_id", "copy", "piece", "start", "length", "ids_crc32")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text).astype("<u4"), np.uint32(end_id)).astype("<u4")
                copy = zlib.crc32(text.encode("utf-8", "surrogatepass"))
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for c, v in zip(out, (doc, copy, k, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32() if c == "piece" else pa.int64()) for c, v in out.items()})

    return rows.mapInArrow(run, "doc_id long, copy long, piece int, start long, length long, ids_crc32 long")


def place(found: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces."""
    spark = found.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").count()
    base = counts.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("base"))
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    places = solve(histogram, capacity)
    by_length: dict[int, tuple] = {x: tuple(np.array(c, np.int64) for c in zip(*[p[1:] for p in places if p[0] == x], strict=True)) for x in histogram}
    shared = spark.sparkContext.broadcast(by_length)  # capacity programs, each with under sqrt(2 * capacity) lengths
    ranked = dealt.join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "copy", "ids_crc32")) - 1)

    def run(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, _, copies, first_bin, offset = shared.value[int(x)]
                k = np.searchsorted(first, rank[at], "right") - 1
                i = rank[at] - first[k]
                bins[at], offsets[at] = first_bin[k] + i // copies[k], offset[k] + i % copies[k] * x
            own = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(bins), pa.array(offsets)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts have the end id alone. Rows that repeat an id are packed each.
    """
    return place(materialize(pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces"), capacity)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
