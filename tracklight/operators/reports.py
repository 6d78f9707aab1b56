"""Issue reports: status pivots, trends, ageing, lead times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import (
    SUMMARY_TYPES,
    calendar,
    days_before,
    months_before,
    ntz,
    period_label,
    whole_days,
)
from ..functions.text import tag_label
from .filters import (
    WINDOW_MONTHS,
    IssueFilter,
    filter_issues,
    live,
    report_filter,
    reportable,
    with_priorities,
)
from .stages import (
    DEVELOPED_STAGE,
    DONE,
    QA_STAGE,
    RELEASED_STAGE,
    STAGES,
    with_current_stage,
    with_stage,
)

# Age limits of the ageing reports, and stages that do not age.
AGED_MONTHS = 12
STALLED_DAYS = 90
NOT_AGEING_STAGES = (1, 6, 7)


# What the summary counts, and by which columns.
SUMMARY_KEYS = ("category_idx", "progress_idx", "priority_idx")


def summary_measures() -> dict[str, Column | None]:
    """The condition of each count of the summary; None counts all rows."""
    status = F.col("status_idx")
    return {"count": None, "waiting": (status == 0) | (status == 1), "in_progress": status == 2, "done": status == DONE}


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def report_summary(
    issues: DataFrame,
    workflow: DataFrame,
    priorities,
    date_type: str = "all",
    start=None,
    end=None,
    as_of=None,
    bucketed: bool = False,
) -> DataFrame:
    """Waiting, running and done issues by category, current stage and priority.

    `bucketed`: see `with_current_stage`.
    """
    status = F.col("status_idx")
    chosen = report_filter(reportable(issues), priorities, date_type, start, end, as_of)
    return (
        with_current_stage(
            chosen.select("issue_idx", "category_idx", "progress_idx", "priority_idx"),
            workflow.select("issue_idx", "progress_idx", "status_idx"),
            bucketed,
        )
        .groupBy("category_idx", "progress_idx", "priority_idx")
        .agg(
            F.count(F.lit(1)).alias("count"),
            _count_if((status == 0) | (status == 1)).alias("waiting"),
            _count_if(status == 2).alias("in_progress"),
            _count_if(status == DONE).alias("done"),
        )
        .orderBy(
            *[F.col(c).asc_nulls_last() for c in ("category_idx", "progress_idx", "priority_idx")]
        )
    )


def stage_counts(
    issues: DataFrame, workflow: DataFrame, wanted: IssueFilter | None = None, bucketed: bool = False
) -> DataFrame:
    """One row: number of listed issues, in all and per current stage; NULLs if there are none."""
    listed = filter_issues(with_current_stage(issues, workflow, bucketed), wanted)
    per_stage = [
        F.sum(F.when(F.col("progress_idx") == stage, 1).otherwise(0)).alias(str(stage))
        for stage in STAGES
    ]
    return listed.agg(F.sum(F.lit(1)).alias("totalcount"), *per_stage)


def _check_trend(date_type: str, summary_type: str, start, end) -> str:
    date_type = str(date_type)
    if summary_type not in SUMMARY_TYPES:
        raise ValueError(f"summary_type must be one of {SUMMARY_TYPES}, not {summary_type!r}")
    if date_type not in ("all", "custom", *WINDOW_MONTHS):
        raise ValueError(f"unknown date_type {date_type!r}")
    if date_type == "custom" and (start in (None, "") or end in (None, "")):
        raise ValueError("a custom window needs both ends")
    return date_type


def first_created(issues: DataFrame) -> Column:
    """Creation of the oldest issue past stage 1, deleted and temporary ones included."""
    past_first = issues.filter(F.col("progress_idx") != 1)
    return past_first.agg(F.min("issue_created_on").alias("first")).scalar()


def fill_calendar(periods: DataFrame, counts: DataFrame) -> DataFrame:
    """Every period of the calendar in order, with its count or 0."""
    return (
        periods.join(counts, "period", "left")
        .select("period", F.coalesce("count", F.lit(0)).alias("count"))
        .orderBy("period")
    )


def _trend(
    events: DataFrame, moment: str, issues: DataFrame, date_type, summary_type, start, end, as_of
) -> DataFrame:
    when = F.col(moment)
    if date_type == "custom":
        low, high = ntz(start), ntz(end)
        events = events.filter(when.between(low, high))
    elif date_type == "all":
        low, high = first_created(issues), ntz(as_of)
    else:
        low, high = months_before(as_of, WINDOW_MONTHS[date_type]), ntz(as_of)
        events = events.filter(when >= low)
    counts = events.groupBy(period_label(when, summary_type).alias("period")).count()
    periods = calendar(issues.sparkSession, low, high, summary_type)
    return fill_calendar(periods, counts)


def created_trend(
    issues: DataFrame,
    priorities,
    date_type: str = "all",
    summary_type: str = "month",
    start=None,
    end=None,
    as_of=None,
) -> DataFrame:
    """Issues created per month, quarter or year, with the empty periods."""
    date_type = _check_trend(date_type, summary_type, start, end)
    events = with_priorities(reportable(issues), priorities)
    return _trend(
        events, "issue_created_on", issues, date_type, summary_type, start, end, as_of
    )


def completed_trend(
    issues: DataFrame,
    workflow: DataFrame,
    priorities,
    date_type: str = "all",
    summary_type: str = "month",
    complete_type: str = "dev",
    start=None,
    end=None,
    as_of=None,
) -> DataFrame:
    """Issues developed (`dev`) or released (anything else) per period, with the empty periods."""
    date_type = _check_trend(date_type, summary_type, start, end)
    stage = DEVELOPED_STAGE if complete_type == "dev" else RELEASED_STAGE
    chosen = with_priorities(reportable(issues, skip_stage_1=False), priorities)
    events = with_stage(chosen.select("issue_idx"), workflow, stage)
    return _trend(events, "completedate", issues, date_type, summary_type, start, end, as_of)


def aged_open_issues(issues: DataFrame, priorities, as_of) -> DataFrame:
    """Open issues created 12 months ago or earlier."""
    return (
        with_priorities(reportable(issues, skip_stage_1=False), priorities)
        .filter(F.col("issue_created_on") <= months_before(as_of, AGED_MONTHS))
        .filter(~F.col("progress_idx").isin(*NOT_AGEING_STAGES))
        .select(
            "issue_idx",
            "issue_number",
            "issue_subject",
            "progress_idx",
            "priority_idx",
            "issue_created_on",
        )
    )


def stalled_by_stage(
    issues: DataFrame, workflow: DataFrame, priorities, as_of, bucketed: bool = False
) -> DataFrame:
    """Unfinished issues per stage that never started or started 90 days ago or earlier."""
    started = F.col("startdate")
    stalled = workflow.filter(
        (started.isNull() | (started <= days_before(as_of, STALLED_DAYS)))
        & F.col("completedate").isNull()
        & (F.col("status_idx") != DONE)
    ).select("issue_idx", "progress_idx")
    chosen = with_priorities(reportable(issues), priorities).select("issue_idx", "progress_idx")
    return (
        with_current_stage(chosen, stalled, bucketed)
        .groupBy("progress_idx")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("progress_idx")
    )


def lead_time(issues: DataFrame, workflow: DataFrame, priorities) -> DataFrame:
    """One row of whole days: creation to end of development, QA start to release.

    The three stages of an issue are folded to one row first, so the workflow is read and
    joined once. Means round half away from zero, medians half to even.
    """
    stage, done = F.col("progress_idx"), F.col("status_idx") == DONE
    dates = (
        workflow.filter(stage.isin(DEVELOPED_STAGE, QA_STAGE, RELEASED_STAGE))
        .groupBy("issue_idx")
        .agg(
            F.max(F.when((stage == DEVELOPED_STAGE) & done, F.col("completedate"))).alias("developed"),
            F.max(F.when(stage == QA_STAGE, F.col("startdate"))).alias("qa_started"),
            F.max(F.when((stage == RELEASED_STAGE) & done, F.col("completedate"))).alias("released"),
        )
    )
    chosen = with_priorities(reportable(issues, skip_stage_1=False), priorities)
    spans = chosen.select("issue_idx", "issue_created_on").join(dates, "issue_idx").select(
        whole_days(F.col("developed"), F.col("issue_created_on")).alias("dev"),
        whole_days(F.col("released"), F.col("qa_started")).alias("release"),
    )
    columns = []
    for name in ("dev", "release"):
        mean = F.round(F.avg(name)).cast("int")
        median = F.bround(F.percentile(name, 0.5)).cast("int")
        columns += [mean.alias(f"{name}_average"), median.alias(f"{name}_median")]
    return spans.agg(*columns)


def tag_counts(issues: DataFrame) -> DataFrame:
    """Live issues per non-empty tag, with the label shown in tag filters."""
    tag = F.col("issue_tag")
    return (
        issues.filter(live() & (tag != ""))
        .groupBy("issue_tag")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(tag_label(tag, F.col("count")).alias("label"), tag.alias("value"), "count")
    )
