"""Bloom filters made by an aggregate and asked inside the row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hearsay.session import cut_lineage

HASHES = 6


@dataclass(frozen=True)
class Bloom:
    """`words`: one row whose array of longs holds `bits` bits."""

    words: DataFrame
    bits: int

    def might_hold(self, value: str | Column) -> Column:
        """False for most values that aren't in the filter, true for all that are, null for null."""
        value = F.col(value) if isinstance(value, str) else value
        words = self.words.scalar()
        sure = F.lit(True)
        for at in _places(value, self.bits):
            sure = sure & (F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return F.when(value.isNotNull(), sure)


def _places(value: Column, bits: int) -> list[Column]:
    """Positions from two halves of one 64-bit hash."""
    hashed = F.xxhash64(value)
    low, high = hashed.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(hashed, 32)
    return [(low + high * i).bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)]


def bloom_filter(keys: DataFrame, col: str, bits_per_key: int = 10, most_bits: int = 1 << 26) -> Bloom:
    """A filter of a column's values; null values are no members.

    The keys are counted when called. The filter takes the next power of two
    above `bits_per_key` bits a key (about one false hit in a hundred), at most
    `most_bits`, 8 MB: with more keys it lets more through and stays right. Bits
    are combined before the shuffle, so it moves at most its own size per task.
    """
    spark = keys.sparkSession
    n = keys.where(F.col(col).isNotNull()).count()
    bits = 64
    while bits < min(n * bits_per_key, most_bits):
        bits *= 2
    at = F.explode(F.array(*_places(F.col(col), bits)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_at").bitwiseAND(F.lit(63)).cast("int"))
    set_bits = keys.where(F.col(col).isNotNull()).select(at.alias("_at")).select(F.shiftright("_at", 6).alias("_word"), bit.alias("_bits"))
    blank = spark.range(bits // 64).select(F.col("id").alias("_word"), F.lit(0).cast("long").alias("_bits"))
    words = set_bits.unionAll(blank).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    whole = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("_word", "_bits"))), lambda w: w["_bits"]).alias("words"))
    return Bloom(cut_lineage(whole), bits)
