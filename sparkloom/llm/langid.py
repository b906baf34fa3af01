"""Language identification by word-first backoff.

A model holds, for every learned language, log frequencies of its words and of
the character n-grams (length 5 down to 1, with word-edge marks) of its word
types. A word of the vocabulary is scored by its word frequencies alone. A word
that was never seen backs off: the longest n-gram length at which at least one
of its n-grams is known decides, with the mean of the known ones. A document is
scored by the sum over its words.

Learning may use a bounded sample: ``docs_per_lang`` documents of each language
(about, by a hash of the id); whole texts are read. Everything else covers all rows.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, documents, draw, held, slices, trim

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
MAX_N = 5
#: A document's mean word score counts as so many words at most in its confidence.
CONFIDENT_WORDS = 40


def words_of(text: str) -> list[str]:
    """Maximal runs of letters, characters of a Unicode category L, of the lower-cased text."""
    found = WORD.findall(text.lower())
    if text.isascii() or "".join(found).isalpha():
        return found
    # of alphanumeric characters that are no decimal digits, some are other numbers, such as circled ones
    letters = ("".join(c if c.isalpha() else " " for c in w).split(" ") for w in found)
    return [w for own in letters for w in own if w]


def grams(word: str, n: int) -> list[str]:
    edged = f"\x02{word}\x03" if n > 1 else word  # an edge alone tells nothing
    return [edged[i : i + n] for i in range(len(edged) - n + 1)]


@dataclass
class Table:
    """Log frequencies of keys by language, as sparse rows: what a language's score for any key is, and what is added for a key in the languages that have it.

    Row i is ``langs`` and ``more`` from ``starts[i]`` to ``starts[i + 1]``; its size follows the languages that have the
    key, however many languages there are.
    """

    keys: dict[str, int]
    base: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    more: np.ndarray


def log_frequencies(keys: dict[str, int], rows: array, weights: array, n_langs: int) -> Table:
    """Add-half smoothed log frequencies; ``rows`` has key * n_langs + language of each count in ``weights``."""
    cells, own = np.unique(np.frombuffer(rows, np.int64) if rows else np.empty(0, np.int64), return_inverse=True)
    values = np.bincount(own, np.frombuffer(weights, np.float64) if weights else np.empty(0), len(cells))
    langs = cells % max(1, n_langs)
    base = math.log(0.5) - np.log(np.bincount(langs, values, n_langs) + 0.5 * max(1, len(keys)))
    starts = np.searchsorted(cells, np.arange(len(keys) + 1) * n_langs)
    return Table(keys, base, starts, langs.astype(np.int32), np.log(2 * values + 1).astype(np.float32))


@dataclass
class LanguageModel:
    """langs in order; the tables of the words and of the n-grams from the longest on."""

    langs: list[str]
    tables: list[Table]

    @property
    def words(self) -> dict[str, int]:
        return self.tables[0].keys

    def unseen(self, words: list[str]) -> Table:
        """Rows of words that were never seen: back off through shorter n-grams; ``base`` has each row's table, -1 where none is known and the word says nothing."""
        tables, n_langs = np.full(len(words), -1, np.int64), len(self.langs)
        owners: list[list[int]] = [[] for _ in self.tables]
        rows: list[list[int]] = [[] for _ in self.tables]
        for i, word in enumerate(words):
            for k, n in enumerate(range(MAX_N, 0, -1), 1):
                keys = self.tables[k].keys
                known = [keys[g] for g in grams(word, n) if g in keys]
                if known:
                    tables[i] = k
                    rows[k] += known
                    owners[k] += [i] * len(known)
                    break
        total = np.zeros(len(words) * n_langs)
        for table, own, row in zip(self.tables, owners, rows, strict=True):
            if own:
                own, row = np.array(own), np.array(row)
                share = 1 / np.bincount(own, minlength=len(words))[own]
                first = table.starts[row]
                size = table.starts[row + 1] - first
                place = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
                total += np.bincount(np.repeat(own * n_langs, size) + table.langs[place], table.more[place] * np.repeat(share, size), len(total))
        there = np.flatnonzero(total)
        starts = np.searchsorted(there, np.arange(len(words) + 1) * n_langs)
        return Table({w: i for i, w in enumerate(words)}, tables, starts, (there % n_langs).astype(np.int32), total[there].astype(np.float32))


def build_model(rows: list[tuple[str, str, int]], min_count: int = 2) -> LanguageModel:
    """rows: (language, word, count). Words below min_count only feed the n-grams."""
    langs = sorted({lang for lang, _, _ in rows})
    at, totals = {lang: i for i, lang in enumerate(langs)}, Counter()
    for _, word, n in rows:
        totals[word] += n
    known = {w: i for i, w in enumerate(w for w, n in totals.items() if n >= min_count)}
    cells, weights = array("q"), array("d")
    for lang, word, n in rows:
        if word in known:
            cells.append(known[word] * len(langs) + at[lang])
            weights.append(n)
    tables = [log_frequencies(known, cells, weights, len(langs))]
    for size in range(MAX_N, 0, -1):
        keys: dict[str, int] = {}
        cells, weights = array("q"), array("d")
        for lang, word, n in rows:
            weight = 1 + math.log(n)
            for g in grams(word, size):
                cells.append(keys.setdefault(g, len(keys)) * len(langs) + at[lang])
                weights.append(weight)
        tables.append(log_frequencies(keys, cells, weights, len(langs)))
    return LanguageModel(langs, tables)


def _count_words(batches):
    for batch in (part for whole in batches for part in slices(whole, 1, 16 << 20)):
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word, n in Counter(words_of(text)).items():
                counts[lang, word] += n
        yield pa.RecordBatch.from_pydict(
            {"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())},
            schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]),
        )


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 1000) -> LanguageModel:
    """Learn from rows with text and language, about ``docs_per_lang`` of each language, however many there are.

    Rows with a null id, text or language are not learned from. Without any row
    the model knows no language and calls every document ``und``.
    """
    rows = train.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t")).where("i is not null and lang is not null and t is not null")
    sizes = [(r["lang"], min(1.0, docs_per_lang / r["count"])) for r in rows.groupBy("lang").count().collect()]  # as many as there are languages
    if not sizes:
        return build_model([])
    shares = train.sparkSession.createDataFrame(sizes, "lang string, share double")
    rows = rows.join(F.broadcast(shares), "lang").where(draw(F.col("i"), F.col("share"), "langid"))
    counted = (
        rows.select("lang", "t").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )
    found = counted.toArrow()  # bounded by the sample
    model = build_model(sorted(zip(*(found.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True)))
    del found
    trim()
    return model


class Predictor:
    """Scores texts with a model; what unseen words add is remembered for up to ``limit`` words and ``room`` numbers."""

    def __init__(self, model: LanguageModel, limit: int = 200_000, room: int = 4_000_000):
        self.model, words = model, model.tables[0]
        self.bases = np.vstack([*(t.base for t in model.tables), np.zeros(len(model.langs))])
        self.n_words, self.n_numbers = len(words.keys), len(words.langs)
        self.starts = np.concatenate([words.starts, np.empty(limit, np.int64)])
        self.table = np.concatenate([np.zeros(self.n_words, np.int64), np.empty(limit, np.int64)])
        self.langs, self.more = (np.concatenate([x, np.empty(room, x.dtype)]) for x in (words.langs, words.more))
        self.rows = dict(words.keys)

    def learn(self, words: list[str]) -> None:
        """Remember the rows of words that aren't known, as far as there's room."""
        step = max(1, (1 << 20) // len(self.model.langs))
        for a in range(0, len(words), step):
            found = self.model.unseen(words[a : a + step])
            at = len(self.rows)
            b, c = at + len(found.base), self.starts[at] + len(found.langs)
            if b > len(self.table) or c > len(self.langs):
                return
            self.starts[at : b + 1] = found.starts + self.starts[at]
            self.table[at:b], self.langs[c - len(found.langs) : c], self.more[c - len(found.langs) : c] = found.base, found.langs, found.more
            self.rows.update(zip(found.keys, range(at, b), strict=True))

    def totals(self, owner: np.ndarray, words: list[str], reps: np.ndarray, n_docs: int) -> np.ndarray:
        """For each document and language the sum of the scores of its words, which occur so often."""
        new = [w for w in dict.fromkeys(words) if w not in self.rows]
        if len(self.rows) + len(new) > len(self.table):
            self.rows = dict(self.model.words)
            new = [w for w in dict.fromkeys(words) if w not in self.rows]
        self.learn(new)
        at = np.array([self.rows.get(w, -1) for w in words], np.int64)
        out = self._sum(owner, at, reps, n_docs, self.table, self)
        left = np.flatnonzero(at < 0)
        step = max(1, (1 << 20) // len(self.model.langs))
        for a in range(0, len(left), step):  # beyond the room: looked up once
            part = left[a : a + step]
            found = self.model.unseen(list(dict.fromkeys(words[k] for k in part.tolist())))
            out += self._sum(owner[part], np.array([found.keys[words[k]] for k in part.tolist()]), reps[part], n_docs, found.base, found)
        if len(left):
            self.rows = dict(self.model.words)
        return out

    def _sum(self, owner: np.ndarray, at: np.ndarray, reps: np.ndarray, n_docs: int, table: np.ndarray, rows) -> np.ndarray:
        n_langs, good = len(self.model.langs), at >= 0
        own, n, doc = at[good], reps[good], owner[good]
        first = rows.starts[own]
        size = rows.starts[own + 1] - first
        place = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        base = np.bincount(doc * len(self.bases) + table[own] % len(self.bases), n, n_docs * len(self.bases))
        out = base.reshape(n_docs, -1) @ self.bases
        out += np.bincount(np.repeat(doc * n_langs, size) + rows.langs[place], rows.more[place] * np.repeat(n, size), n_docs * n_langs).reshape(n_docs, -1)
        return out

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, confidence) of each text; ``und`` and 0 for null, letterless texts or an empty model. Ties go to the first language in order of name."""
        counts = [Counter(words_of(t or "")) for t in texts]
        words, reps = [w for c in counts for w in c], np.array([n for c in counts for n in c.values()], np.float64)
        if not words or not self.model.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in counts])
        n = np.bincount(owner, reps, len(texts))
        logit = self.totals(owner, words, reps, len(texts)) * (np.minimum(n, CONFIDENT_WORDS) / np.maximum(n, 1))[:, None]
        p = np.exp(logit - logit.max(1, keepdims=True))
        best = p.argmax(1)
        score = p[np.arange(len(p)), best] / p.sum(1)
        return [(self.model.langs[k], s) if c else (UNKNOWN, 0.0) for k, s, c in zip(best.tolist(), score.tolist(), counts, strict=True)]

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


class Shared:
    """A broadcast model and its key, which a worker can compare before it loads the model."""

    def __init__(self, spark, model):
        self.key, self.model = uuid.uuid4().hex, spark.sparkContext.broadcast(model)


def predictor_of(shared: Shared) -> Predictor:
    """One predictor a worker process and broadcast model; what the process held before goes first."""
    return held(shared.key, lambda: Predictor(shared.model.value))


def share_model(spark, model) -> Shared:
    """Broadcast a model; its size is bounded by its training sample."""
    return Shared(spark, model)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text with a non-null id."""
    shared = share_model(docs.sparkSession, model)

    def run(batches):
        predict = predictor_of(shared).predict_all
        for batch in (part for whole in batches for part in slices(whole, 1, 1 << 19)):
            out = predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose language is found with at least ``min_score``.

    Null and letterless texts go.
    """
    shared = share_model(docs.sparkSession, model)
    at = docs.columns.index(text_col)

    def run(batches):
        predict = predictor_of(shared).predict_all
        for batch in (part for whole in batches for part in slices(whole, at, 1 << 19)):
            found = predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fit_on_documents(docs: DataFrame) -> LanguageModel:
    """The query's training split: crc32(doc_id as text) mod 5 is not 0."""
    return fit(docs.where(crc_mod(F.col("doc_id"), 5) != 0))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, fit_on_documents(docs))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
