"""Filters by membership in a set of keys, as a bitmap of a fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


_WORDS = 512  # of 64 bits, in a value of bitmap_construct_agg


def _flagged(df: DataFrame, key: Column, keys: DataFrame, n_bits: int) -> tuple[DataFrame, str]:
    """df with a column that is false only for keys that surely aren't among keys."""
    flag, row, bits = (fresh(df, stem) for stem in ("filter_bit", "filter_row", "filter_words"))
    one = keys.select(F.pmod(F.xxhash64(F.col(f"`{keys.columns[0]}`")), F.lit(n_bits)).alias("bit")).select(F.bitmap_bucket_number("bit").alias(row), F.bitmap_bit_position("bit").alias("pos"))
    maps = one.groupBy(row).agg(F.bitmap_construct_agg("pos").alias("m"))
    # as numbers of 64 bits, the first byte highest
    words = F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), lambda i: F.conv(F.hex(F.substring(F.col("m"), i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    maps = maps.select(row, words.alias(bits))
    mine = df.withColumn(flag, F.pmod(F.xxhash64(key), F.lit(n_bits)))
    joined = mine.join(F.broadcast(maps), F.bitmap_bucket_number(F.col(flag)) == maps[row], "left")
    pos = F.bitmap_bit_position(F.col(flag)).cast("int")
    held = F.get(F.col(bits), F.shiftright(pos, 6))
    hit = F.coalesce(F.bit_get(held, 56 - pos.bitwiseAND(56) + pos.bitwiseAND(7)) == 1, F.lit(False))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], hit.alias(flag)), flag


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, n_bits: int = 1 << 26) -> DataFrame:
    """Rows of df whose key may be among the (one-column) keys: a bitmap filter without false
    negatives. Only the bitmap is broadcast, n_bits / 8 bytes however many keys there are; with many more keys than
    bits it lets most rows pass, so that a join that follows does all of the work."""
    flagged, flag = _flagged(df, key, keys, n_bits)
    return flagged.where(F.col(flag)).drop(flag)
