"""A filter of constant size in front of a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Bits of the filter: a constant size, whatever the number of keys.
FILTER_BITS = 1 << 22


def likely(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose ``on`` may be among ``keys``: a bitmap of constant size, so it can go to all tasks.

    All rows whose ``on`` is among the keys are kept, and few others as long as
    the keys are fewer than the bits; a join on ``on`` makes it exact.
    """
    h = F.pmod(F.xxhash64(on), F.lit(FILTER_BITS))
    bits = keys.select(h.alias("_h")).groupBy(F.bitmap_bucket_number("_h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))
    e = rows.withColumn("_h", h).withColumn("_bucket", F.bitmap_bucket_number("_h")).join(F.broadcast(bits), "_bucket")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(bitmap_bit_position(_h) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    return e.where(F.call_function("getbit", byte, (F.bitmap_bit_position("_h") % 8).cast("int")) == 1).select(*rows.columns)
