"""A bitmap of hashed keys with a fixed size, broadcast to drop rows before an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap and of one of its pages (Spark's bitmap functions have pages of 4 KB): 8 MB at most are broadcast.
BITS, PAGE = 1 << 26, 1 << 15


def marked(df: DataFrame, key: Column, keys: DataFrame, flag: str, most: int = BITS) -> DataFrame:
    """df with a boolean column flag: false if the row's key is surely not among keys (one long column).

    The bitmap has 16 bits for each key, and never more than most: with very many keys it marks more
    rows, which costs work and changes no result, as an exact join follows. A null key is marked.
    """
    name = keys.columns[0]
    bits = min(most, max(PAGE, 1 << (16 * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(F.lit("bitmap"), key.cast("long")), F.lit(bits))
    at = F.pmod(F.xxhash64(F.lit("bitmap"), F.col(f"`{name}`").cast("long")), F.lit(bits))
    # Page and bit by division: the bits of a page lie from the lowest of its first byte on.
    pages = keys.select(at.alias("_at")).groupBy(F.expr(f"_at div {PAGE}").alias("_page")).agg(F.bitmap_construct_agg(F.expr(f"_at % {PAGE}")).alias("_bits"))
    spots = df.withColumn("_null", key.isNull()).withColumn("_at", place).withColumn("_p", F.expr(f"_at div {PAGE}"))
    found = spots.join(F.broadcast(pages), F.col("_p") == F.col("_page"), "left")
    byte = F.conv(F.hex(F.substring("_bits", F.expr(f"cast((_at % {PAGE}) div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, F.expr("cast(_at % 8 as int)")) % 2 == 1
    return found.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_null") | F.coalesce(hit, F.lit(False))).alias(flag))


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, most: int = BITS) -> DataFrame:
    """The rows of df whose key may be among keys: all that are, and few others."""
    return marked(df, key, keys, "_maybe", most).where("_maybe").drop("_maybe")
