"""The five signals of a result's score and their weighted sum."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import split_words

DECAY_SECONDS = 180.0 * 86_400


@dataclass(frozen=True)
class Weights:
    # The default weights.
    trigram: float = 0.45
    proximity: float = 0.20
    recency: float = 0.10
    structural: float = 0.20
    title: float = 0.05


def trigram_score(coverage: Column, positions: Column) -> Column:
    """0.7 times the coverage, 0.3 times a boost that grows with the logarithm of the number of positions."""
    log = F.lit(1.0) + F.ln(positions.cast("double"))
    return coverage * F.lit(0.7) + F.when(positions > 0, log / (log + F.lit(1.0))).otherwise(F.lit(0.0)) * F.lit(0.3)


def proximity_score(span: Column) -> Column:
    """0 without a span, 1 for span 0, falling with its logarithm."""
    return F.when(span.isNull(), 0.0).when(span == 0, 1.0).otherwise(1 / (1 + F.greatest(F.ln(span.cast("double")), F.lit(0.0))))


def recency_score(mtime: Column, as_of: Column) -> Column:
    """exp(-age / 180 days), in fractional seconds; files from the future count as new."""
    age = (F.unix_micros(as_of) - F.greatest(F.unix_micros(mtime), F.lit(0).cast("long"))) / F.lit(1e6)
    return F.exp(-F.greatest(age, F.lit(0.0)) / F.lit(DECAY_SECONDS))


def title_boost(title: Column, query: str) -> Column:
    """1 if any word of the query is within the title, whatever the word's length."""
    lower = F.lower(title)
    hit = reduce(lambda x, y: x | y, [F.contains(lower, F.lit(w.lower())) for w in split_words(query)], F.lit(False))
    return F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)


def composite(weights: Weights, trigram: Column, proximity: Column, recency: Column, structural: Column, title: Column) -> Column:
    return F.lit(weights.trigram) * trigram + F.lit(weights.proximity) * proximity + F.lit(weights.recency) * recency + F.lit(weights.structural) * structural + F.lit(weights.title) * title
