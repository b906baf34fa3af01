"""Supervised subword embeddings for document quality.

Every whitespace-delimited token and every character n-gram of it (with its
edges marked by a space) is hashed into one of 2**bits vectors. A document is
the mean of the vectors of all its features; a softmax layer over the classes
follows. A token that repeats the one before it adds one more feature, the same
for all tokens: the only word pair that is seen, as it carries over to new words. Vectors and layer are learned by stochastic gradient descent in numpy,
one document a step.

Learning uses a bounded sample: about ``docs_per_class`` documents of each class,
by a hash of the id; whole texts are read. Scoring covers all rows.

Texts longer than ``SEGMENT`` characters are taken in segments that end at
white space where there is any, so memory stays bounded; every feature counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, documents, draw, held, slices, trim
from .langid import share_model

NGRAMS = (3, 4, 5)
#: Binary logarithm of the number of vectors.
BITS = 18
SEGMENT = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.uint64(32)


def segments(text: str):
    """The text in pieces of at most SEGMENT characters, cut at white space if possible."""
    start = 0
    while len(text) - start > SEGMENT:
        end = start + SEGMENT
        cut = max(text.rfind(" ", start + 1, end), text.rfind("\n", start + 1, end))
        end = cut if cut > start else end
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts joined by single spaces, white space as a space; the end of each text."""
    joined = " " + " ".join(texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    white = (codes <= 32) & (codes >= 9) | (codes == 0x85) | (codes == 0xA0) | (codes >= 0x2000) & (codes <= 0x200A) | (codes == 0x2028) | (codes == 0x2029) | (codes == 0x202F) | (codes == 0x205F) | (codes == 0x3000)
    codes[white] = _SPACE
    return codes, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)


def features(codes: np.ndarray, ends: np.ndarray, bits: int):
    """Yields (start position, bucket) arrays: for the tokens, the repeats, and each n-gram length."""
    shift = np.uint64(64 - bits)
    white = codes == _SPACE
    edge = np.flatnonzero(white)
    # tokens: differences of a running polynomial, brought back to a common power
    powers = np.full(len(codes), _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(len(codes), np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    running = np.concatenate([[np.uint64(0)], np.cumsum((codes + np.uint64(1)) * inverse, dtype=np.uint64)])
    first, last = edge[:-1] + 1, edge[1:]
    some = last > first
    first, last = first[some], last[some]
    token = (running[last] - running[first]) * powers[first]
    yield first, (((token ^ (token >> np.uint64(31))) * _MIX) >> shift).astype(np.int64)
    owner = np.searchsorted(ends, first, "right")
    again = first[1:][(token[1:] == token[:-1]) & (owner[1:] == owner[:-1])]
    yield again, np.full(len(again), (1 << bits) - 1, np.int64)
    whites = np.concatenate([[0], np.cumsum(white)])
    for n in NGRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint64(n), np.uint64)
        for k in range(n):
            h *= _BASE
            h += codes[k : k + m]
        h ^= h >> np.uint64(31)
        h *= _MIX
        inner = np.flatnonzero(whites[n - 1 : n - 1 + m] == whites[1 : 1 + m])
        yield inner, (h[inner] >> shift).astype(np.int64)


def bag(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and how often each occurs."""
    found = [np.empty(0, np.int64)]
    for piece in segments(text):
        found += [b for _, b in features(*code_points([piece]), bits)]
    return np.unique(np.concatenate(found), return_counts=True)


@dataclass
class SubwordModel:
    """classes; vectors of the buckets; the softmax layer."""

    classes: list[int]
    bits: int
    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def bucket_logits(self) -> np.ndarray:
        """What a bucket adds to each class before the mean is taken."""
        return (self.vectors @ self.layer).astype(np.float32)


def train(found: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: list[int], bits: int = BITS, dim: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 0) -> SubwordModel:
    """Stochastic gradient descent on the softmax loss over bags, with a linearly falling rate.

    A document's vectors take a step of the gradient's direction so long that the mean moves as the rate says, however many
    features the document has; plain steps would hardly move those of long texts.
    """
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << bits, dim), np.float32) - 0.5) / dim).astype(np.float32)
    layer, bias = np.zeros((dim, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    bags = [(at, (reps / max(1, reps.sum())).astype(np.float32)) for at, reps in found]
    steps, step = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            at, weight = bags[i]
            lr = rate * (1 - step / steps)
            step += 1
            rows = vectors[at]
            mean = weight @ rows
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[classes.index(labels[i])] -= 1
            back = layer @ p
            layer -= lr * np.outer(mean, p)
            bias -= 0.05 * lr * p
            if len(at):  # along the gradient, so far that the mean moves by lr * back
                vectors[at] = rows - (lr / float(weight @ weight)) * weight[:, None] * back
    return SubwordModel(classes, bits, vectors, layer, bias)


class Scorer:
    """Class probabilities of whole texts."""

    def __init__(self, model: SubwordModel):
        self.model, self.logits = model, model.bucket_logits()

    def _totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the bucket logits and numbers of features of each short text."""
        codes, ends = code_points(texts)
        starts = np.concatenate([[0], ends])
        totals, sizes = np.zeros((len(texts), self.logits.shape[1])), np.zeros(len(texts))
        for at, bucket in features(codes, ends, self.model.bits):
            cut = np.searchsorted(at, starts)
            sums = np.zeros((len(at) + 1, self.logits.shape[1]))
            np.cumsum(self.logits[bucket], axis=0, dtype=np.float64, out=sums[1:])
            totals += sums[cut[1:]] - sums[cut[:-1]]
            sizes += np.diff(cut)
        return totals, sizes

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        owner, pieces = [], []
        totals, sizes = np.zeros((len(texts), self.logits.shape[1])), np.zeros(len(texts))

        def flush():
            if pieces:
                t, n = self._totals(pieces)
                np.add.at(totals, owner, t)
                np.add.at(sizes, owner, n)
            owner.clear(), pieces.clear()

        held = 0
        for i, text in enumerate(texts):
            for piece in segments(text or ""):
                if held + len(piece) > SEGMENT:
                    flush()
                    held = 0
                owner.append(i)
                pieces.append(piece)
                held += len(piece) + 1
        flush()
        z = totals / np.maximum(sizes, 1)[:, None] + self.model.bias
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", docs_per_class: int = 2000) -> SubwordModel:
    """Learn classes 0 and 1 from the labelled rows of docs, about ``docs_per_class`` of each.

    Rows with a null id or label, with another label, or with labels that
    contradict each other are not learned from; a null text counts as empty.
    With no usable label every score is 0.5.
    """
    marks = (
        labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y"))
        .where("i is not null and y in (0, 1)")
        .groupBy("i")
        .agg(F.min("y").alias("y"), F.max("y").alias("z"))
        .where("y = z")
    )
    sizes = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, docs_per_class / n))).otherwise(share)
    # bounded by docs_per_class for each of two classes, so it may be broadcast
    drawn = marks.where(draw(F.col("i"), share, "quality")).select("i", "y")
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    rows = texts.join(F.broadcast(drawn), "i").select("i", "y", "t").mapInArrow(_bags, "i long, y int, t string, at binary, reps binary, print binary").collect()
    rows.sort(key=lambda r: (r["i"], r["print"]))
    bags = [bag(r["t"], BITS) if r["at"] is None else (np.frombuffer(r["at"], np.int32), np.frombuffer(r["reps"], np.int32)) for r in rows]
    model = train([(at.astype(np.int32), reps.astype(np.int32)) for at, reps in bags], [r["y"] for r in rows], [0, 1])
    del rows, bags
    trim()
    return model


def _bags(batches):
    """What the driver gets of each text: its bag of at most 2**bits numbers, or the text itself where that is shorter."""
    for batch in (part for whole in batches for part in slices(whole, 2)):
        out = []
        for t in batch.column(2).to_pylist():
            raw = (t or "").encode("utf-8", "surrogatepass")
            at, reps = (x.astype(np.int32).tobytes() for x in bag(t or "", BITS))
            small = len(raw) <= len(at) + len(reps)
            out.append((t or "", None, None, xxhash.xxh3_128_digest(raw)) if small else (None, at, reps, xxhash.xxh3_128_digest(raw)))
        columns = [pa.array([x[k] for x in out], pa.string() if k == 0 else pa.binary()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["i", "y", "t", "at", "reps", "print"])


def scorer_of(shared) -> Scorer:
    """One scorer a worker process and broadcast model."""
    return held(shared.key, lambda: Scorer(shared.model.value))


def score(docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text: the probability of class 1. Empty texts get the layer's bias alone."""
    shared = share_model(docs.sparkSession, model)

    def run(batches):
        scorer = scorer_of(shared)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            p = scorer.probabilities(batch.column(1).to_pylist())[:, 1] if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: SubwordModel, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score at least ``min_score``."""
    shared = share_model(docs.sparkSession, model)
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = scorer_of(shared)
        for batch in (part for whole in batches for part in slices(whole, at)):
            if batch.num_rows:
                p = scorer.probabilities(batch.column(at).to_pylist())[:, 1]
                batch = batch.filter(pa.array(p >= min_score))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def fit_on_documents(docs: DataFrame, sf_dir: str) -> SubwordModel:
    """The query's training split: labels of rows whose crc32(doc_id as text) mod 3 is not 1."""
    labels = docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(docs, labels.where(crc_mod(F.col("doc_id"), 3) != 1))


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, fit_on_documents(docs, sf_dir))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
