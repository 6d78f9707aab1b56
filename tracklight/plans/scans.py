"""Running values and row numbers that never put a whole key into one task.

A plain `Window.partitionBy(key).orderBy(seq)` sorts every row of a key in one task, and a window
without a partition sorts everything in one. Here the ordered positions are cut into blocks of
65,536: each block is summarised by a partial aggregate, the running value over the (few) blocks
of a key gives the start of each block, and the rows are then scanned block by block.

`seq` is a non-negative, unique batch position. Gaps do no harm: an id made by
`monotonically_increasing_id` has two blocks more for each input partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 16
BLOCK, GROUP = "_block", "_group"
RANK_BUCKET_DIGITS = 3  # hex digits of the tie-breaking hash: 4,096 buckets

_AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by all of `keys`.

    Spark settles for rows that are dealt by some of the keys it needs, such as a client alone
    where client and block are asked for. Then a hot client would be one task; this keeps it apart.
    """
    return df.repartition(*[F.col(k) for k in keys])


def with_blocks(df: DataFrame, seq: str) -> DataFrame:
    """Add the block of each row as column `_block`."""
    return df.withColumn(BLOCK, F.shiftright(F.col(seq), BLOCK_BITS))


def _combine(how: str, first: Column, second: Column) -> Column:
    if how == "sum":
        return F.coalesce(first, F.lit(0)) + F.coalesce(second, F.lit(0))
    return F.least(first, second) if how == "min" else F.greatest(first, second)


def _totals(df: DataFrame, by: list[str], hows: dict[str, str], old: str, new: str) -> DataFrame:
    """The total `{new}{name}` of the values `{old}{name}` of each of `by`."""
    return df.groupBy(*by).agg(
        *[_AGGREGATES[how](f"{old}{name}").alias(f"{new}{name}") for name, how in hows.items()]
    )


def _earlier(hows: dict[str, str], value: str, keys: list[str], order: str) -> dict[str, Column]:
    """The running values of `{value}{name}` over the earlier rows of the keys."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return {name: _AGGREGATES[how](f"{value}{name}").over(window) for name, how in hows.items()}


def _block_starts(staged: DataFrame, keys: list[str], hows: dict[str, str]) -> DataFrame:
    """The running value `_s_{name}` before each block, from the values `_v_{name}` of its rows.

    The blocks of a key are scanned by one task. Without keys that would be all blocks, so these
    are put together to groups of 65,536 in their turn: one task scans the blocks of one group, or
    all groups, of which there is one for each 2^32 positions.
    """
    blocks = _totals(staged, [*keys, BLOCK], hows, "_v_", "_t_")
    if keys:
        starts = _earlier(hows, "_t_", keys, BLOCK)
    else:
        blocks = blocks.withColumn(GROUP, F.shiftright(F.col(BLOCK), BLOCK_BITS))
        groups = _totals(blocks, [GROUP], hows, "_t_", "_u_")
        before = _earlier(hows, "_u_", [], GROUP)
        blocks = blocks.join(
            groups.select(GROUP, *[start.alias(f"_g_{name}") for name, start in before.items()]), GROUP
        )
        starts = {
            name: _combine(hows[name], F.col(f"_g_{name}"), start)
            for name, start in _earlier(hows, "_t_", [GROUP], BLOCK).items()
        }
    return blocks.select(*keys, BLOCK, *[start.alias(f"_s_{name}") for name, start in starts.items()])


def running(
    df: DataFrame,
    keys: list[str],
    seq: str,
    values: dict[str, tuple[str, Column]],
    inclusive: bool = False,
) -> DataFrame:
    """Add for each `name: (how, value)` the sum, min or max over the earlier rows of the key.

    `inclusive` takes the row itself in. Sums start at 0, min and max at NULL. Keys must not be NULL.
    Of several scans in a row, the first input made by `with_blocks` saves shuffling again.
    """
    staged = df if BLOCK in df.columns else with_blocks(df, seq)
    staged = staged.withColumns({f"_v_{name}": value for name, (_, value) in values.items()})
    hows = {name: how for name, (how, _) in values.items()}
    starts = _block_starts(staged, keys, hows)
    inside = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(seq)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    # Both sides by all keys, and the window over what that join leaves in place.
    staged, starts = (spread(side, *keys, BLOCK) for side in (staged, starts))
    return staged.join(starts, [*keys, BLOCK]).select(
        *df.columns,
        *[
            _combine(how, F.col(f"_s_{name}"), _AGGREGATES[how](f"_v_{name}").over(inside)).alias(name)
            for name, (how, _) in values.items()
        ],
    )


def row_numbers(df: DataFrame, seq: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Add `name` = 1, 2, 3, .. in the order of `seq`, within the keys if given."""
    return running(df, keys or [], seq, {name: ("sum", F.lit(1))}, inclusive=True)


def ranked_by_count(df: DataFrame, keys: list[str], count: str, text: str, name: str) -> DataFrame:
    """Add the row number by `count` descending within the keys; ties go by the hash of `text`.

    Three steps, none of which sees a whole key: the distinct counts of a key (n rows of total
    weight w have at most sqrt(2w) distinct counts), the hash buckets of one count (4,096), and
    the rows of one bucket.
    """
    hashed = df.withColumn("_hash", F.md5(F.col(text).cast("binary"))).withColumn(
        "_bucket", F.substring("_hash", 1, RANK_BUCKET_DIGITS)
    )
    buckets = hashed.groupBy(*keys, count, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = buckets.groupBy(*keys, count).agg(F.sum("_n").alias("_n"))
    before_count = (
        Window.partitionBy(*keys)
        .orderBy(F.desc(count))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before_bucket = (
        Window.partitionBy(*keys, count)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = counts.select(
        *keys, count, F.coalesce(F.sum("_n").over(before_count), F.lit(0)).alias("_above")
    )
    starts = spread(buckets, *keys, count).join(spread(counts, *keys, count), [*keys, count]).select(
        *keys,
        count,
        "_bucket",
        (F.col("_above") + F.coalesce(F.sum("_n").over(before_bucket), F.lit(0))).alias("_start"),
    )
    inside = Window.partitionBy(*keys, count, "_bucket").orderBy("_hash", text)
    hashed, starts = (spread(side, *keys, count, "_bucket") for side in (hashed, starts))
    return hashed.join(starts, [*keys, count, "_bucket"]).select(
        *df.columns, (F.col("_start") + F.row_number().over(inside)).alias(name)
    )
