"""For each of many strings the least of others that is not below it, without a window over all.

Both sides are cut into ranges together. Within a range the next string is a running value from the
end; a range without one at its end takes the first of the ranges after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def with_next(keys: DataFrame, column: str, others: DataFrame, name: str) -> DataFrame:
    """Distinct strings of `column` with `name`: the least string of `others` that is not below.

    `others` has one column. Strings compare as UTF-8 bytes. NULL keys are left out, and `name` is
    NULL where all others are below. Each side is shuffled once by range, each string once, and
    ranges come from a sample, so a common beginning does no harm.
    """
    ensure_checkpoint_dir(keys.sparkSession)
    at, sought = F.col("_at"), F.col("_sought")
    marks = others.select(F.col(others.columns[0]).alias("_at"))
    both = keys.select(F.col(column).alias("_at"), F.lit(True).alias("_sought")).unionByName(
        marks.withColumn("_sought", F.lit(False))
    )
    # One row for each string: whether it is a key, and whether it is another.
    both = both.filter(at.isNotNull()).groupBy("_at").agg(
        F.max("_sought").alias("_sought"), F.min("_sought").alias("_only")
    )
    both = both.select("_at", "_sought", F.when(~F.col("_only"), at).alias("_mark"))
    # Ranges are drawn from a sample, so they are fixed before two steps read them.
    ranged = both.repartitionByRange("_at").withColumn("_range", F.spark_partition_id()).checkpoint()
    from_end = Window.partitionBy("_range").orderBy(F.desc("_at"))
    found = ranged.withColumn("_next", F.last("_mark", ignorenulls=True).over(from_end)).filter(sought)
    firsts = ranged.groupBy("_range").agg(F.min("_mark").alias("_first"))
    later = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("_range", F.last("_first", ignorenulls=True).over(later).alias("_later"))
    return found.join(firsts, "_range").select(
        at.alias(column), F.coalesce("_next", "_later").alias(name)
    )
