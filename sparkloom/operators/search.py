"""The six requests over a documents table, as lazy DataFrames.

A documents table has doc_id, path, kind, mtime, title, text, snippet, norm (the normalised
text), simhash, doc_type, dates, amounts, emails, entities; see ``plans.index``. Retrieval
either scans ``norm`` for the query's byte trigrams or reads them from a postings table;
both give the same candidates. All ranks break ties by path.
"""

from __future__ import annotations

import datetime
import math
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fingerprint, score
from ..functions.text import contextual_snippet, full_content, let, query_trigrams, split_words, under, utf8
from . import dsl, postings as post

RESULT = ["path", "score", "type", "snippet", "content"]
EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)


def word_trigrams(text: str) -> list[list[bytes]]:
    """The trigrams of each word that can be looked up: words of three bytes or more."""
    return [t for t in (query_trigrams(w) for w in split_words(text) if len(w.encode()) >= 3) if t]


def all_trigrams(text: str) -> list[bytes]:
    """Distinct trigrams of all words of a query, none across words."""
    return list(dict.fromkeys(t for w in split_words(text) for t in query_trigrams(w)))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions, F.lit(False))


def scan_candidates(docs: DataFrame, text: str) -> DataFrame:
    """Documents that have all trigrams of any word, found by scanning ``norm``."""
    asked = word_trigrams(text)
    has = let(utf8(F.col("norm")), lambda d: _any([reduce(lambda x, y: x & y, [F.contains(d, F.lit(t)) for t in word]) for word in asked]))
    return docs.where(has if asked else F.lit(False))


def scan_features(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``matched`` (query trigrams that occur) and ``positions`` (how often, overlaps too)."""
    found = docs.withColumn("_hits", post.hits(F.col("norm"), all_trigrams(text)))
    return found.withColumns({"matched": F.col("_hits.m"), "positions": F.col("_hits.p")}).drop("_hits")


def overlap_candidates(docs: DataFrame, text: str, share: float) -> DataFrame:
    """Documents that have at least this share of the trigrams of any word: misspelt words find theirs."""
    enough = []
    for word in word_trigrams(text):
        enough.append(post.hits(F.col("norm"), word)["m"] >= share * len(word))
    return docs.where(_any(enough) if enough else F.lit(False))


def holds_phrases(node: dsl.Node) -> Column:
    """Whether the normalised text has every phrase of a tree as it is written; those under NOT and in a branch of OR aside."""
    match node:
        case dsl.Phrase(text) if text.strip():
            return F.contains(F.col("norm"), F.lit(" ".join(split_words(text.lower()))))
        case dsl.And(left, right):
            return holds_phrases(left) & holds_phrases(right)
    return F.lit(True)


@dataclass(frozen=True)
class Engine:
    """Requests over documents at a moment, which makes results repeatable."""

    docs: DataFrame
    as_of: datetime.datetime | None = None
    postings: DataFrame | None = None
    weights: score.Weights = field(default_factory=score.Weights)

    @property
    def now(self) -> datetime.datetime:
        now = self.as_of or datetime.datetime.now(datetime.UTC)
        return now if now.tzinfo else now.replace(tzinfo=datetime.UTC)

    @property
    def seconds(self) -> int:
        return int((self.now - EPOCH).total_seconds())

    def candidates(self, text: str) -> DataFrame:
        if self.postings is None:
            return scan_candidates(self.docs, text)
        return self.docs.join(post.candidates(self.postings, word_trigrams(text)), "doc_id", "left_semi")

    def _featured(self, docs: DataFrame, text: str) -> DataFrame:
        if self.postings is None:
            return scan_features(docs, text)
        found = post.term_frequencies(self.postings, all_trigrams(text))
        return docs.join(found, "doc_id", "left").withColumns({"matched": F.coalesce("matched", F.lit(0)), "positions": F.coalesce("positions", F.lit(0))})

    def scored(self, docs: DataFrame, text: str, node: dsl.Node | None = None, proximity: bool = False) -> DataFrame:
        """Adds ``score`` to candidates. The proximity signal is off by default: no request uses it."""
        total = len(all_trigrams(text))
        out = self._featured(docs, text)
        trigram = score.trigram_score(F.col("matched") / F.lit(float(total)), F.col("positions")) if total else F.lit(0.0)
        span = post.min_span(F.col("norm"), split_words(text.lower())) if proximity else F.lit(None).cast("int")
        now = F.timestamp_micros(F.lit(int((self.now - EPOCH) / datetime.timedelta(microseconds=1))))
        structural = dsl.structural_score(node, self.seconds) if node is not None else F.lit(0.0)
        return out.withColumn("score", score.composite(self.weights, trigram, score.proximity_score(span), score.recency_score(F.col("mtime"), now), structural, score.title_boost(F.col("title"), text)))

    @staticmethod
    def top(scored: DataFrame, limit: int) -> DataFrame:
        return scored.orderBy(F.desc("score"), "path").limit(limit)

    def search(self, text: str, limit: int = 10, context: int = 150, full: bool = False, min_overlap: float | None = None) -> DataFrame:
        """Documents with all trigrams of any word, best first; none if no word has a trigram.

        With ``min_overlap``, that share of a word's trigrams is enough; the texts are scanned then.
        """
        found = self.candidates(text) if min_overlap is None else overlap_candidates(self.docs, text, min_overlap)
        best = self.top(self.scored(found, text).where("score > 0"), limit)
        content = full_content(F.col("text")) if full else F.lit(None).cast("string")
        return best.select("path", "score", F.col("doc_type").alias("type"), contextual_snippet(F.col("text"), text, F.col("snippet"), context).alias("snippet"), content.alias("content")).orderBy(F.desc("score"), "path")

    def query(self, expression: str, limit: int = 10, strict_phrase: bool = False) -> DataFrame:
        """Documents that pass the filter; its words retrieve as in ``search``, without any all documents are taken.

        With ``strict_phrase``, phrases also have to occur as they are written, up to case and white space.
        """
        node = dsl.parse_query(expression)
        text = dsl.text_of(node)
        found = self.candidates(text) if all_trigrams(text) else self.docs
        if strict_phrase:
            found = found.where(holds_phrases(node))
        best = self.top(self.scored(found.where(dsl.predicate(node, self.seconds)), text, node), limit)
        return best.select("path", "score", F.col("doc_type").alias("type"), "snippet", F.lit(None).cast("string").alias("content")).orderBy(F.desc("score"), "path")

    def similar(self, path: str | None = None, text: str | None = None, threshold: int | None = None, limit: int = 10) -> DataFrame:
        """Nearest documents by SimHash to an indexed one or to a text, the document itself left out."""
        if text is not None:
            needle = self.docs.sparkSession.createDataFrame([(text,)], "t string").select(fingerprint.simhash(F.col("t")).alias("needle"))
        else:
            needle = self.docs.where(F.col("path") == path).select(F.col("simhash").alias("needle")).limit(1)
        found = self.docs.where("simhash != 0").crossJoin(F.broadcast(needle.limit(1)))  # one row
        found = found.withColumn("distance", fingerprint.hamming(F.col("simhash"), F.col("needle")))
        if path is not None:
            found = found.where(F.col("path") != path)
        if threshold is not None:
            found = found.where(F.col("distance") <= threshold)
        nearest = found.orderBy("distance", "path").limit(limit).withColumn("score", fingerprint.similarity(F.col("distance")))
        note = F.format_string("similarity: %.0f%%  (hamming distance: %d)", F.col("score") * 100, F.col("distance"))
        return nearest.select("path", "score", F.col("doc_type").alias("type"), note.alias("snippet"), F.lit(None).cast("string").alias("content")).orderBy(F.desc("score"), "path")

    def recent(self, since: str = "7d", limit: int = 20) -> DataFrame:
        """Documents modified since a duration ago or an ISO date, newest first; anything else means all.

        The score is the time of modification over the largest one listed.
        """
        cutoff = dsl.duration_cutoff(since, self.seconds)
        if cutoff is None:
            try:
                cutoff = int((datetime.datetime.combine(datetime.date.fromisoformat(since), datetime.time(), datetime.UTC) - EPOCH).total_seconds())
            except ValueError:
                cutoff = 0
        found = self.docs.where(F.unix_micros("mtime") >= 0).withColumn("_s", F.unix_seconds("mtime")).where(F.col("_s") >= cutoff)
        page = found.orderBy(F.desc("_s"), "path").limit(limit)
        most = F.max("_s").over(Window.partitionBy())  # over the page, limit rows
        return page.withColumn("score", F.when(most > 0, F.col("_s") / most).otherwise(0.0)).select("path", "score", F.col("doc_type").alias("type"), "snippet", F.lit(None).cast("string").alias("content")).orderBy(F.desc("score"), "path")

    def clusters(self, bands: int = 4, under_path: str | None = None, limit: int | None = 20, shown: int | None = 5) -> DataFrame:
        """Sets of two or more documents that share a band of their SimHash, largest first.

        (size, members, more): the first ``shown`` paths and how many are left out.
        A document may be in several sets; equal sets count once.
        """
        live = self.docs.where("simhash != 0")
        if under_path is not None:
            live = live.where(under(F.col("path"), under_path))
        posted, sets = lsh_sets(live.select("path", "simhash"), bands, "path")
        sets = sets.orderBy(F.desc("size"), "first", "last", "set")
        sets = sets if limit is None else sets.limit(limit)
        members = posted.join(sets, "b").select("set", "size", "first", "id")
        if shown is not None:
            rank = F.row_number().over(Window.partitionBy("set").orderBy("id"))
            members = members.withColumn("_k", rank).where(F.col("_k") <= shown)
        lists = members.groupBy("size", "first", "set").agg(F.sort_array(F.collect_list("id")).alias("members"))
        more = F.col("size") - F.size("members")
        return lists.orderBy(F.desc("size"), "first", "set").select(F.col("size").cast("int").alias("size"), "members", more.cast("int").alias("more"))


def lsh_sets(docs: DataFrame, bands: int, id_col: str = "doc_id", hash_col: str = "simhash") -> tuple[DataFrame, DataFrame]:
    """(postings, sets): (id, b) of every document and bucket; (b, set, size, first, last) of the distinct sets of two or more.

    Equal sets are told by their size and two sums of hashes of their members, which
    combine before the shuffle, so no set is gathered; ``b`` is one of its buckets.
    """
    posted = docs.where(F.col(hash_col) != 0).select(F.col(id_col).alias("id"), F.explode(fingerprint.bands(F.col(hash_col), bands)).alias("b"))
    mark = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    buckets = posted.groupBy("b").agg(F.count("*").alias("size"), mark.alias("set"), F.min("id").alias("first"), F.max("id").alias("last")).where("size > 1")
    return posted, buckets.groupBy("set", "size", "first", "last").agg(F.min("b").alias("b"))


def lsh_clusters(docs: DataFrame, bands: int, id_col: str = "doc_id", hash_col: str = "simhash") -> DataFrame:
    """(set, size, id): a row a member of each distinct set of documents that share a bucket."""
    posted, sets = lsh_sets(docs, bands, id_col, hash_col)
    return posted.join(sets.select("b", "set", "size"), "b").select("set", "size", "id")


def _agreeing(h: Column, threshold: int) -> Column:
    """Keys of which two fingerprints that differ in at most ``threshold`` bits share one.

    The bits are cut into threshold + more blocks, of which such a pair has ``more`` in common: a key is a choice of so many
    blocks with their bits, long enough that few other pairs share it. There are 64 choices at most, else one block is a key.
    """
    more = next((m for m in (3, 2) if math.comb(threshold + m, m) <= 64), 1)
    cuts = [fingerprint.BITS * i // (threshold + more) for i in range(threshold + more + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(blocks, more)]
    signed = [m - (1 << fingerprint.BITS) if m >> (fingerprint.BITS - 1) else m for m in masks]
    return F.array(*[F.struct(F.lit(k).alias("band"), h.bitwiseAND(F.lit(m).cast("long")).alias("value")) for k, m in enumerate(signed)])


def hamming_pairs(docs: DataFrame, bands: int, threshold: int, id_col: str = "doc_id", hash_col: str = "simhash") -> DataFrame:
    """(a, b, distance, n_a, n_b): fingerprints that share a band and differ in at most ``threshold`` bits.

    A fingerprint goes by the smallest id that has it, with the number of its
    documents, so copies make no pairs. With more bands than ``threshold`` every such pair shares
    a band, so they are found by keys of more bits, of which fewer others share one. Spark's estimate
    of a table's size leaves out that ``explode`` multiplies the rows, so the join is told not to broadcast.
    """
    values = docs.where(F.col(hash_col) != 0).groupBy(F.col(hash_col).alias("h")).agg(F.min(id_col).alias("id"), F.count("*").alias("n"))
    every = fingerprint.check_bands(bands) > threshold
    keys = _agreeing(F.col("h"), threshold) if every else fingerprint.bands(F.col("h"), bands)
    posted = values.select("id", "n", "h", F.explode(keys).alias("b"))
    pairs = posted.alias("x").join(posted.alias("y").hint("merge"), "b").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), fingerprint.hamming(F.col("x.h"), F.col("y.h")).alias("distance"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))
    return pairs.where(F.col("distance") <= threshold).distinct()
