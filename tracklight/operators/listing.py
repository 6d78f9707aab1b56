"""The issue list: filter, order, page, nest; and the small ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ISSUES, WORKFLOW
from .filters import IssueFilter, filter_issues
from .stages import nest_workflow, with_current_stage

ISSUE_COLUMNS = (
    "issue_idx",
    "issue_color",
    "issue_tag",
    "issue_number",
    "issue_subject",
    "issue_status",
    "issue_assigned_to",
    "memo",
    "progress_idx",
    "product_idx",
    "category_idx",
    "priority_idx",
    "delaycount",
    "is_updated",
    "syncdate",
    "createdate",
    "issue_created_on",
    "status_idx",
    "startdate",
    "completedate",
)

ISSUE_TYPES = {f.name: f.dataType for schema in (ISSUES, WORKFLOW) for f in schema}

# A page up to this size is sent to all executors to look up its workflow rows.
BROADCAST_PAGE_ROWS = 10_000


def list_order(order: str | None, field: str | None) -> list[Column]:
    """Sort columns. Missing values come last ascending and first descending.

    Ties go by issue_idx, so pages neither overlap nor leave gaps. An order other than `ascend`
    and `descend` means no order; none given means the newest first.
    """
    if not order:
        return [F.col("createdate").desc_nulls_first(), F.col("issue_idx").asc()]
    if order not in ("ascend", "descend"):
        return []
    if field not in ISSUE_COLUMNS:
        raise ValueError(f"cannot order by {field!r}")
    key = F.col(field).asc_nulls_last() if order == "ascend" else F.col(field).desc_nulls_first()
    return [key, F.col("issue_idx").asc()]


def after_row(last: tuple, order: str | None, field: str | None) -> Column:
    """Rows that come after the one with sort value and issue_idx `last`, in `list_order`."""
    value, idx = last
    if order and order not in ("ascend", "descend"):
        return F.col("issue_idx") > idx
    key, rising = F.col(field if order else "createdate"), order == "ascend"
    later = F.col("issue_idx") > idx
    if value is None:
        return (key.isNull() & later) | (F.lit(not rising) & key.isNotNull())
    value = F.lit(value).cast(ISSUE_TYPES[field if order else "createdate"])
    further = (key > value) | key.isNull() if rising else key < value
    return further | ((key == value) & later)


def listed_issues(
    issues: DataFrame,
    workflow: DataFrame,
    wanted: IssueFilter | None = None,
    order: str | None = None,
    field: str | None = None,
    page: int = 1,
    size: int | None = None,
    after: tuple | None = None,
) -> DataFrame:
    """The 20 scalar columns of the issue list, ordered and paged.

    `after`, the sort value and issue_idx of the last row seen, starts behind that row: it gives
    the next page without counting through all earlier ones.
    """
    rows = filter_issues(with_current_stage(issues, workflow), wanted).select(*ISSUE_COLUMNS)
    if after is not None:
        list_order(order, field)  # checks the field
        rows = rows.filter(after_row(after, order, field))
    keys = list_order(order, field)
    if size and not keys:
        keys = [F.col("issue_idx").asc()]  # any order will do, but pages must fit together
    if keys:
        rows = rows.orderBy(*keys)
    if size:
        rows = rows.offset((page - 1) * size).limit(size)
    return rows


def issue_list(
    issues: DataFrame,
    workflow: DataFrame,
    wanted: IssueFilter | None = None,
    order: str | None = None,
    field: str | None = None,
    page: int = 1,
    size: int | None = None,
    after: tuple | None = None,
) -> DataFrame:
    """The issue list with the nested workflow of each issue.

    A page is cut first, and once: its rows, broadcast to the workflow scan if the page is small and
    joined by shuffle otherwise, carry their columns along, and their stages are grouped after the
    join. A page far behind the first still counts through all rows before it, in one task; `after`
    does not.
    """
    rows = listed_issues(issues, workflow, wanted, order, field, page, size, after)
    # Every listed issue has at least the row of its current stage, so none is lost.
    if not size:
        nested = rows.join(nest_workflow(workflow), "issue_idx")
    else:
        cut = rows.select("issue_idx", F.struct(*ISSUE_COLUMNS).alias("_row"))
        if size <= BROADCAST_PAGE_ROWS:
            cut = F.broadcast(cut)
        nested = nest_workflow(workflow.join(cut, "issue_idx"), F.first("_row").alias("_row"))
        nested = nested.select("_row.*", "workflow")
    ordering = list_order(order, field)
    nested = nested.select(*ISSUE_COLUMNS, "workflow")
    return nested.orderBy(*ordering) if ordering else nested


def saved_filter_list(saved_filters: DataFrame) -> DataFrame:
    return saved_filters.select(
        "filter_idx", "filter_name", "filter_content", "isdefaultfilter"
    ).orderBy("filter_idx")


def category_list(categories: DataFrame) -> DataFrame:
    return categories.orderBy("category_idx").select("category_name")
