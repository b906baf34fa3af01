"""Token-id files with Elias-Fano document boundaries.

A shard file is, in little-endian order::

    8 bytes   magic "SLTOKEN2"
    u64 x 4   documents n, ids m, bytes an id, select step
    i64, u64  the first document id, how far the last one is from it
    ids       m ids of 2 or 4 bytes, all documents concatenated
    EF        every document's end offset, up to m
    EF        every document's id less the first one
    u32       crc32 of all before

EF is a non-decreasing sequence of n numbers up to a bound u by Elias and Fano, in about 2 + log2(u / n) bits each::

    low       n * l bits: the low bits of every number, l the whole part of log2(u / n)
    high      n + (u >> l) + 1 bits: unary-coded high parts
    u64 x k   select samples: the bit position of every step-th one in ``high``

``Sequence.__getitem__`` answers select queries in place: a sample leads near the wanted one bit, a popcount scan
finds it. No table of offsets is unpacked, neither here nor by ``read_documents``.

Documents are range-partitioned by id, a task tokenises its range, and writes
one file for every ``shard_ids`` ids into a folder of any store that pyarrow can
open. A file is written under a name of its own attempt, then renamed, so repeated
attempts of a task leave one whole file. Spark's ``binaryFile`` source reads them.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize, scratch_path, slices
from .tokens import encoder_of

MAGIC = b"SLTOKEN2"
HEAD = struct.Struct("<8s4QqQ")
STEP = 64
SHARD_IDS = 8_000_000
_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def low_bits(n: int, bound: int) -> int:
    return max(0, (bound // n).bit_length() - 1) if n else 0


def elias_fano(values: np.ndarray, bound: int) -> bytes:
    """The bytes of a non-decreasing sequence up to bound."""
    n, width = len(values), low_bits(len(values), bound)
    values = values.astype(np.uint64)
    shifts = np.arange(width, dtype=np.uint64)
    low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
    ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    high = np.zeros(n + (bound >> width) + 1, np.uint8)
    high[ones] = 1
    return low + np.packbits(high, bitorder="little").tobytes() + ones[::STEP].astype("<u8").tobytes()


class Sequence:
    """Reads numbers of an Elias-Fano sequence in place."""

    def __init__(self, data: memoryview, at: int, n: int, bound: int, step: int):
        self.n, self.width, self.step = n, low_bits(n, bound), step
        sizes = [-(-n * self.width // 8), -(-(n + (bound >> self.width) + 1) // 8), 8 * -(-n // step)]
        self.low = np.frombuffer(data, np.uint8, sizes[0], at)
        self.high = np.frombuffer(data, np.uint8, sizes[1], at + sizes[0])
        self.samples = np.frombuffer(data, "<u8", sizes[2] // 8, at + sizes[0] + sizes[1])
        self.end = at + sum(sizes)

    def _low(self, i: int) -> int:
        first, last = i * self.width, (i + 1) * self.width
        word = int.from_bytes(self.low[first // 8 : -(-last // 8)].tobytes(), "little")
        return word >> (first % 8) & ((1 << self.width) - 1)

    def _select(self, i: int) -> int:
        """Position of the i-th one (from 0) in the high part."""
        at = int(self.samples[i // self.step])
        left, byte = i % self.step, at // 8
        left += int(_ONES[self.high[byte] & ((1 << (at % 8)) - 1)])
        while True:
            part = np.cumsum(_ONES[self.high[byte : byte + 64]])
            if part[-1] > left:
                k = int(np.searchsorted(part, left, "right"))
                left -= int(part[k - 1]) if k else 0
                bits = np.flatnonzero(np.unpackbits(self.high[byte + k : byte + k + 1], bitorder="little"))
                return 8 * (byte + k) + int(bits[left])
            left -= int(part[-1])
            byte += 64

    def __getitem__(self, i: int) -> int:
        return (self._select(i) - i) << self.width | self._low(i)


def pack_shard(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a shard file; doc_ids ascend."""
    first, last = (int(doc_ids[0]), int(doc_ids[-1])) if len(doc_ids) else (0, 0)
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), ids.itemsize, STEP, first, last - first)
    far = doc_ids.astype(np.int64).view(np.uint64) - np.uint64(first % (1 << 64))  # wraps to the true difference
    body = head + ids.astype(f"<u{ids.itemsize}").tobytes() + elias_fano(ends, len(ids)) + elias_fano(far, last - first)
    return body + struct.pack("<I", zlib.crc32(body))


class ShardReader:
    """Reads a shard from any buffer, such as a memory-mapped file, without unpacking its boundaries or document ids."""

    def __init__(self, data):
        data = memoryview(data)
        magic, self.n, self.m, width, step, self.first, span = HEAD.unpack_from(data)
        if magic != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole token shard")
        self.ids = np.frombuffer(data, f"<u{width}", self.m, HEAD.size)
        self._ends = Sequence(data, HEAD.size + width * self.m, self.n, self.m, step)
        self._ids = Sequence(data, self._ends.end, self.n, span, step)

    def end(self, i: int) -> int:
        """Offset after document i's ids."""
        return self._ends[i]

    def doc_id(self, i: int) -> int:
        return self.first + self._ids[i]

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.end(i - 1) if i else 0 : self.end(i)]


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, data: bytes) -> None:
    store, path = _store(folder)
    own = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(data)
    store.move(own, f"{path}/{name}")


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, partitions: int | None = None) -> DataFrame:
    """Tokenise whole texts (null: empty), append ``end_id``, write shards in ascending id order.

    Returns (part, shard, n_docs, n_ids) of each file ``part-<part>-<shard>.tok``; parts and
    the shards in them ascend with the ids. Repeated ids stay separate documents,
    in order of their text, side by side.
    """
    spark = docs.sparkSession
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def run(batches):
        encode = encoder_of(tokenizer).encode
        end = np.array([end_id], encoder_of(tokenizer).dtype)
        held, ids, size, shard, part = [], [], 0, 0, 0

        def flush():
            ends = np.cumsum([len(x) for x in ids[::2]]) + np.arange(1, len(held) + 1)
            _put(folder, f"part-{part:06d}-{shard:06d}.tok", pack_shard(np.array(held, np.int64), ends, np.concatenate(ids)))
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "n_docs": [len(held)], "n_ids": [int(ends[-1])]}, schema=pa.schema([(c, pa.int64()) for c in ("part", "shard", "n_docs", "n_ids")]))

        for batch in (piece for whole in batches for piece in slices(whole, 1)):
            for doc, text, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):  # noqa: B007
                held.append(doc)
                ids += [encode(text), end]
                size += len(ids[-2]) + 1
                if size >= shard_ids:
                    yield flush()
                    held, ids, size, shard = [], [], 0, shard + 1
        if held:
            yield flush()

    return placed.mapInArrow(run, "part long, shard long, n_docs long, n_ids long")


def with_starts(shards: DataFrame) -> DataFrame:
    """Adds ``start``: ids in all shards before. A row a file: few next to the documents, summed by part first."""
    per_part = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = per_part.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("base"))
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    return shards.join(before, "part").select("part", "shard", (F.col("base") + own).alias("start"))


def read_documents(spark, folder: str, starts: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    name = F.regexp_extract("path", r"part-(\d+)-(\d+)\.tok$", 1), F.regexp_extract("path", r"part-(\d+)-(\d+)\.tok$", 2)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tok").load(folder).select(name[0].cast("long").alias("part"), name[1].cast("long").alias("shard"), "path")
    placed = files.join(starts, ["part", "shard"]).select("path", "start")

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = _store(path)
                with store.open_input_file(at) as f:
                    shard = ShardReader(f.read())
                for lo in range(0, shard.n, 4096):
                    rows, begin = [], shard.end(lo - 1) if lo else 0
                    for i in range(lo, min(lo + 4096, shard.n)):
                        end = shard.end(i)
                        rows.append((shard.doc_id(i), start + begin, end - begin, zlib.crc32(shard.ids[begin:end].astype("<u4").tobytes())))
                        begin = end
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    shards = materialize(write_shards(documents(spark, sf_dir), folder, "byte_bpe_50k.json", 0), "token-shards")
    return read_documents(spark, folder, with_starts(shards))
