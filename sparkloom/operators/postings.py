"""Trigram postings: build, store, look up; minimum spans."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, utf8

SCHEMA = "trigram int, doc_id long, positions array<int>, tf int"


def code(trigram: bytes) -> int:
    """Three bytes as one integer, the first highest."""
    return int.from_bytes(trigram, "big")


def _windows(batches):
    for batch in batches:
        codes, docs, ends, places = [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = np.frombuffer((text or "").encode(), np.uint8).astype(np.int32)
            if len(data) < 3:
                continue
            window = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
            order = np.argsort(window, kind="stable")
            head = np.flatnonzero(np.append(True, np.diff(window[order]) != 0))
            codes.append(window[order][head])
            docs.append(np.full(len(head), doc))
            ends.append(np.diff(np.append(head, len(order))))
            places.append(order.astype(np.int32))
        if codes:
            tf = np.concatenate(ends).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(tf)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, np.concatenate(places))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes)), pa.array(np.concatenate(docs), pa.int64()), lists, pa.array(tf)], ["trigram", "doc_id", "positions", "tf"])


def build(docs: DataFrame) -> DataFrame:
    """(trigram, doc_id, positions, tf) of the bytes of ``norm``; positions are byte offsets, ascending."""
    return docs.select("doc_id", "norm").mapInArrow(_windows, SCHEMA)


def _codes(text: str | None) -> np.ndarray:
    """The byte trigrams of a text in order, as integers."""
    data = np.frombuffer((text or "").encode(), np.uint8).astype(np.int32)
    return data[:-2] << 16 | data[1:-1] << 8 | data[2:] if len(data) > 2 else np.empty(0, np.int32)


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_trigrams, n_positions): distinct trigrams of ``norm`` and all."""

    def run(batches):
        for batch in batches:
            found = [_codes(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(np.unique(x)) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64())], ["doc_id", "n_trigrams", "n_positions"])

    return docs.select("doc_id", "norm").mapInArrow(run, "doc_id long, n_trigrams long, n_positions long")


def hits(text: Column, wanted: list[bytes]) -> Column:
    """struct(m, p): how many of the trigrams a text has, and how often they occur in all, overlaps too."""
    asked = np.sort(np.array([code(t) for t in wanted], np.int32))

    def count(own: str) -> tuple[int, int]:
        codes = _codes(own)
        at = np.minimum(np.searchsorted(asked, codes), len(asked) - 1)
        found = at[asked[at] == codes]
        return len(np.unique(found)), len(found)

    @F.pandas_udf("m int, p int")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count(t) for t in texts] if len(asked) else [(0, 0)] * len(texts), columns=["m", "p"])

    return run(text)


def write(postings: DataFrame, path: str, mode: str = "append") -> None:
    """Sorted by trigram over the whole table, so that a lookup reads few row groups."""
    postings.repartitionByRange("trigram").sortWithinPartitions("trigram", "doc_id").write.mode(mode).parquet(path)


def lookup(postings: DataFrame, trigrams: list[bytes]) -> DataFrame:
    """Entries of the trigrams; the filter reaches the scan."""
    return postings.where(F.col("trigram").isin([code(t) for t in trigrams]))


def candidates(postings: DataFrame, words: list[list[bytes]]) -> DataFrame:
    """doc_id of documents that have all trigrams of any word."""
    wanted = [(i, code(t)) for i, word in enumerate(words) for t in word]
    spark = postings.sparkSession
    asked = spark.createDataFrame(wanted or [(0, -1)], "word int, trigram int")  # as long as the query
    sizes = spark.createDataFrame([(i, len(w)) for i, w in enumerate(words)] or [(0, 1)], "word int, n long")
    found = lookup(postings, [t for w in words for t in w]).select("trigram", "doc_id").join(F.broadcast(asked), "trigram").groupBy("doc_id", "word").agg(F.countDistinct("trigram").alias("n"))
    return found.join(F.broadcast(sizes), ["word", "n"]).select("doc_id").distinct()


def term_frequencies(postings: DataFrame, trigrams: list[bytes]) -> DataFrame:
    """(doc_id, matched, positions): how many of the trigrams a document has, and how often."""
    return lookup(postings, trigrams).groupBy("doc_id").agg(F.countDistinct("trigram").cast("int").alias("matched"), F.sum("tf").cast("int").alias("positions"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("trigram").agg(F.countDistinct("doc_id").alias("df"), F.sum("tf").alias("tf"))


def occurrences(text: Column, word: str) -> Column:
    """Byte offsets at which the word's bytes occur in the text, ascending."""
    n = len(word.encode())

    def places(d: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.octet_length(d) - n + 1, F.lit(1)))
        return F.transform(F.filter(at, lambda i: F.substring(d, i, F.lit(n)) == F.lit(word.encode())), lambda i: i - 1)

    return let(utf8(text), places)


def span_of(lists: list[Column]) -> Column:
    """The smallest distance between the ends of a window with one position of each list.

    0 for one list, null if any is empty. For each position as the right end, each list's last position
    at or before it is the best left; the window reaches to the least of those.
    """
    every = F.array_sort(F.flatten(F.array(*lists)))

    def reach(right: Column) -> Column:
        lasts = [F.array_max(F.filter(own, lambda p: p <= right)) for own in lists]
        whole = lasts[0].isNotNull()
        for x in lasts[1:]:
            whole = whole & x.isNotNull()
        return F.when(whole, right - (F.least(*lasts) if len(lasts) > 1 else lasts[0]))

    spans = F.filter(F.transform(every, reach), lambda s: s.isNotNull())
    full = F.lit(True)
    for own in lists:
        full = full & (F.size(own) > 0)
    if len(lists) == 1:
        return F.when(full, F.lit(0))
    return F.when(full, F.array_min(spans))


def min_span(text: Column, words: list[str]) -> Column:
    """Minimum span of the words' occurrences in a text; null without words."""
    words = list(dict.fromkeys(w for w in words if w))
    return span_of([occurrences(text, w) for w in words]) if words else F.lit(None).cast("int")


def min_span_of_postings(postings: DataFrame, trigrams: list[bytes]) -> DataFrame:
    """(doc_id, span) over the positions of several trigrams, for documents that have them all."""
    names = {t: f"p{i}" for i, t in enumerate(dict.fromkeys(trigrams))}
    grouped = lookup(postings, list(names)).groupBy("doc_id").agg(*[F.first(F.when(F.col("trigram") == code(t), F.col("positions")), ignorenulls=True).alias(c) for t, c in names.items()])
    return grouped.dropna().select("doc_id", span_of([F.col(c) for c in names.values()]).alias("span"))
