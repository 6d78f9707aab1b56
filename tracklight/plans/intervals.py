"""Point-in-interval joins as equi-joins.

An interval of whole numbers is cut into aligned power-of-two pieces, at most two per level; a
point lies in exactly one aligned piece per level. Joining on (level, piece) yields each pair of a
point and an interval around it once, and no other pair, so a key with many intervals and many
points costs what its result costs. The levels are exploded first, so all arithmetic is compiled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL, PIECE = "_level", "_piece"


def _right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def with_point_pieces(df: DataFrame, point: Column, levels: Column) -> DataFrame:
    """One row per level of the array `levels` with the piece that holds the point (>= 0).

    The levels that intervals use are enough, all from 0 to that of the whole range always are.
    """
    return df.select("*", F.explode(levels).alias(LEVEL)).withColumn(
        PIECE, _right(point, F.col(LEVEL))
    )


def with_interval_pieces(df: DataFrame, start: Column, end: Column, levels: Column) -> DataFrame:
    """One row per piece of [start, end) within 0..2^levels; an empty interval has none."""
    one = F.lit(1).cast("long")
    odd = lambda x: x.bitwiseAND(one) == 1
    round_up = F.call_function("shiftleft", one, F.col(LEVEL)) - 1
    low, high = F.col("_low"), F.col("_high")
    # On each level the piece at either end that does not fit a piece of the next level.
    ends = F.array(F.when(odd(low), low), F.when(odd(high), high - 1))
    return (
        df.select("*", start.alias("_start"), end.alias("_end"))
        .select("*", F.explode(F.sequence(F.lit(0), levels)).alias(LEVEL))
        .withColumn("_low", _right(F.col("_start") + round_up, F.col(LEVEL)))
        .withColumn("_high", _right(F.col("_end"), F.col(LEVEL)))
        .filter((low < high) & (odd(low) | odd(high)))
        .select(*df.columns, LEVEL, F.explode(ends).alias(PIECE))
        .filter(F.col(PIECE).isNotNull())
    )
