"""XXH64, SimHash and LSH bands; 64-bit values are BIGINT bit patterns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .text import let, words

#: xxhash64 chains its columns, each the seed of the next, from seed 42. This long hashes to 0, so what follows has seed 0.
SEED_ZERO = -365884300664092260
BITS = 64


def xxh64(data: Column) -> Column:
    """XXH64 with seed 0 of a string or binary column."""
    return F.xxhash64(F.lit(SEED_ZERO).cast("long"), data)


def shingle_hashes(text: Column) -> Column:
    """Hashes of the word pairs; of the words if there are fewer than three."""

    def shingles(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda x, y: F.concat_ws(" ", x, y))
        return F.when(F.size(w) >= 3, pairs).otherwise(w)

    return F.transform(let(words(text), shingles), lambda s: xxh64(s))


@F.pandas_udf(LongType())
def bit_vote(hashes: pd.Series) -> pd.Series:
    """The majority of each bit over an array of hashes; a tie is 0, and so is an empty array."""

    def fold(own) -> int:
        own = np.asarray(own if own is not None else [], np.int64)
        if not len(own):
            return 0
        votes = np.unpackbits(own.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        return int(np.packbits(2 * votes > len(own), bitorder="little").view("<i8")[0])

    return hashes.map(fold)


def simhash(text: Column) -> Column:
    """0 for null and empty texts."""
    return bit_vote(F.coalesce(shingle_hashes(text), F.array().cast("array<long>")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(distance: Column) -> Column:
    return 1 - distance / F.lit(float(BITS))


def check_bands(n: int) -> int:
    if not 2 <= n <= BITS:
        raise ValueError(f"the number of bands is from 2 to {BITS}")
    return n


def bands(fingerprint: Column, n: int) -> Column:
    """struct(band, value) for each of n bands of 64 // n bits from the lowest on; bits left over are unused."""
    width = BITS // check_bands(n)
    mask = (1 << width) - 1
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(fingerprint, i * width).bitwiseAND(F.lit(mask).cast("long")).alias("value")) for i in range(n)])
