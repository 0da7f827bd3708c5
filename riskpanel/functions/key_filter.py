"""Bit tables of keys: which rows of a large table can meet a smaller one at all.

A key is hashed to one bit. The table is made by an aggregate in parts of 4 KB,
and every row looks up its own part in a broadcast join of a checked size. Rows
whose bit is not set have no partner for certain, so they need no shuffle; the
others go on to the join that decides. With more keys than bits more rows pass,
and results stay the same.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the largest table: 16 MiB, whatever the number of keys.
MOST_BITS = 27
#: Bits of one part, as Spark's bitmap aggregates lay them out.
PART_BITS = 15


def bits_for(keys: int, share: int = 16) -> int:
    """Bits of the table (as a power of two): `share` for each key, MOST_BITS at most."""
    return min(MOST_BITS, max(PART_BITS, math.ceil(math.log2(share * max(keys, 1)))))


def place(on: Sequence[str | Column], bits: int) -> Column:
    """Where a key falls, from 1. A NULL in the key hashes like any value."""
    # Spark's hash leaves NULLs out, so their places are hashed as well
    values = [F.col(k) if isinstance(k, str) else k for k in on]
    nulls = F.concat(*[F.when(v.isNull(), "1").otherwise("0") for v in values])
    return F.xxhash64(*values, nulls).bitwiseAND(F.lit((1 << bits) - 1)) + 1


def bit_parts(keys: DataFrame, on: Sequence[str | Column], bits: int) -> DataFrame:
    """``(_part, _bits)``: the bit table of the keys, ``2 ** (bits - 15)`` rows of 4 KB at most."""
    at = keys.select(place(on, bits).alias("_place"))
    return at.groupBy(F.bitmap_bucket_number("_place").alias("_part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits")
    )


def with_may_match(df: DataFrame, parts: DataFrame, on: Sequence[str | Column], bits: int, name: str = "_may_match") -> DataFrame:
    """Add whether the key of a row may be in the table; rows stay where they are."""
    columns = [F.col(f"_kept_row.`{c}`").alias(c) for c in df.columns]
    row = df.select(F.struct(*[df[c] for c in df.columns]).alias("_kept_row"), place(on, bits).alias("_place"))
    held = row.join(F.broadcast(parts), F.bitmap_bucket_number("_place") == F.col("_part"), "left")
    # the byte of the key in its part, and the bit in that byte
    position = "bitmap_bit_position(_place)"
    found = F.expr(f"(CAST(conv(hex(substring(_bits, CAST({position} DIV 8 AS INT) + 1, 1)), 16, 10) AS INT) & shiftleft(1, CAST({position} % 8 AS INT))) != 0")
    return held.select(*columns, F.coalesce(found, F.lit(False)).alias(name))
