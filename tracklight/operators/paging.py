"""Deep pages of the issue list by a directory of its order.

A page far behind the first would count through all rows before it. The directory cuts the order
into ranges of about the same size and keeps the ends and the number of rows of each, so a page is
found in the few ranges that hold it. It is made once for a list and stored beside it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .listing import after_row, list_order


def _field(order: str | None, field: str | None) -> str:
    if order and order not in ("ascend", "descend"):
        raise ValueError("a list without an order has no directory")
    return field if order else "createdate"


#: About as many rows has a range of the directory.
RANGE_ROWS = 100_000


def page_directory(
    rows: DataFrame, order: str | None = None, field: str | None = None, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """(range, n, first, last): the ranges of `rows` in the order of `list_order`.

    `rows` have the sort field and issue_idx, which is unique. `first` and `last` are the sort value
    and issue_idx of the ends. A value that many rows share is cut by issue_idx. `range` rises along
    the order. Small ranges share a task, so their number does not make more tasks.
    """
    name = _field(order, field)
    rising = order == "ascend"
    tasks = max(1, math.ceil(rows.count() / max(range_rows, RANGE_ROWS)))
    ordered = [F.col("value").asc_nulls_last() if rising else F.col("value").desc_nulls_first(), F.col("issue_idx").asc()]
    ranged = rows.select(F.col(name).alias("value"), "issue_idx").repartitionByRange(tasks, *ordered)
    # The place within its task is in the lower bits of this id, the task in those above.
    placed = ranged.sortWithinPartitions(*ordered).withColumn("_at", F.monotonically_increasing_id())
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # The key rises along a rising order and falls along a falling one; ties always go by rising id.
    idx = F.col("issue_idx") if rising else -F.col("issue_idx")
    key = F.struct(F.col("value").isNull().alias("missing"), "value", idx.alias("idx"))
    ends = placed.groupBy((F.col("_at") - inside % range_rows).alias("range")).agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("_low"), F.max(key).alias("_high")
    )
    end = lambda c: F.struct(F.col(f"{c}.value").alias("value"), F.abs(f"{c}.idx").alias("issue_idx"))
    first, last = ("_low", "_high") if rising else ("_high", "_low")
    return ends.select("range", "n", end(first).alias("first"), end(last).alias("last"))


def _at(row, name: str) -> Column:
    return F.col(name).eqNullSafe(F.lit(row["value"])) & (F.col("issue_idx") == row["issue_idx"])


def directory_page(
    rows: DataFrame,
    directory: DataFrame,
    order: str | None = None,
    field: str | None = None,
    page: int = 1,
    size: int = 100,
) -> DataFrame:
    """The page of `rows` that `orderBy(list_order).offset(..).limit(..)` gives.

    The ranges that hold the page, at most two if they are not smaller than a page, come to the
    driver; rows outside them are filtered by the sort field, which reaches the scan.
    """
    name, offset = _field(order, field), (page - 1) * size
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = directory.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    hit = placed.filter((F.col("start") < offset + size) & (F.col("start") + F.col("n") > offset))
    held = hit.agg(
        F.min("start").alias("start"), F.min_by("first", "range").alias("first"), F.max_by("last", "range").alias("last")
    ).first()
    if held["start"] is None:
        return rows.limit(0)
    first, last = held["first"], held["last"]
    behind = lambda end: F.coalesce(after_row((end["value"], end["issue_idx"]), order, field), F.lit(False))
    inside = (behind(first) | _at(first, name)) & ~behind(last)
    # The same in terms that a scan can use.
    values = sorted((v for v in (first["value"], last["value"]) if v is not None))
    if first["value"] is not None and last["value"] is not None:
        inside &= F.col(name).between(*[F.lit(v) for v in values])
    return rows.filter(inside).orderBy(*list_order(order, field)).offset(offset - held["start"]).limit(size)
