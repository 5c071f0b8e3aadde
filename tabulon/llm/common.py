"""What several operators share: white space, word counts, and a filter of fixed size for rows of a second scan."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
# 2^23 bits: the filter is 1 MB in 256 rows, however many keys it marks.
FILTER_BITS = 1 << 23


def normalised(text: Column) -> Column:
    """Null is empty; each run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(bits)) + 1


def key_filter(keys: DataFrame, key: Column, bits: int = FILTER_BITS) -> DataFrame:
    """Bitmaps of the hashed keys, at most `bits` / 8 bytes in all, so that broadcasting them is safe at any size.

    The filter only saves work: a key that is in always passes, and one that isn't may pass. Beyond about `bits` keys it
    lets most rows through, and what follows has to be exact anyway.
    """
    bit = _bit(key, bits)
    return keys.groupBy(F.bitmap_bucket_number(bit).alias("_slot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_marks"))


def with_filter(df: DataFrame, key: Column, marks: DataFrame, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """`df` with a boolean `name`: whether the filter lets the row's key through. No shuffle."""
    df = df.withColumn("_bit", _bit(key, bits)).withColumn("_slot", F.bitmap_bucket_number("_bit"))
    byte = F.conv(F.hex(F.expr("substring(_marks, cast(bitmap_bit_position(_bit) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr("cast(shiftleft(1, cast(bitmap_bit_position(_bit) % 8 as int)) as int)")) != 0, F.lit(False))
    return df.join(F.broadcast(marks), "_slot", "left").withColumn(name, hit).drop("_bit", "_slot", "_marks")


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task of a Python worker, which at its end gives freed memory back: workers live on and serve other tasks."""
    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
            if trim:
                trim(0)

    return run
