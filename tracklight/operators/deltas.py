"""Reports kept up to date by what a batch of changes takes away and brings.

A report that counts rows by keys is the sum over its rows, so its next state is the stored one less
the rows of the touched issues before the changes, plus those after. Only these issues are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import IssueFilter, filter_issues, live, reportable, with_priorities
from .reports import SUMMARY_KEYS, summary_measures
from .stages import with_current_stage

SIGN = "_sign"


def touched_rows(rows: DataFrame, touched: DataFrame) -> DataFrame:
    """The rows of the touched issues {issue_idx}."""
    return rows.join(touched.select("issue_idx").distinct(), "issue_idx", "left_semi")


def count_delta(before: DataFrame, after: DataFrame, keys: list[str], measures: dict) -> DataFrame:
    """What each measure, a condition or None for all rows, gains by key: `after` counts +1, `before` -1."""
    signed = before.withColumn(SIGN, F.lit(-1).cast("long")).unionByName(after.withColumn(SIGN, F.lit(1).cast("long")))
    sums = {n: F.col(SIGN) if c is None else F.when(c, F.col(SIGN)).otherwise(0) for n, c in measures.items()}
    return signed.groupBy(*keys).agg(*[F.sum(s).cast("long").alias(n) for n, s in sums.items()])


def merged_counts(stored: DataFrame, delta: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    """The stored report with a delta added; keys that have no rows left go."""
    measures = [c for c in stored.columns if c not in keys]
    both = stored.select(*keys, *measures).unionByName(delta.select(*keys, *measures))
    return both.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures]).filter(F.col(count) != 0)


def _summary_rows(issues: DataFrame, workflow: DataFrame, priorities) -> DataFrame:
    chosen = with_priorities(reportable(issues), priorities).select("issue_idx", *SUMMARY_KEYS)
    return with_current_stage(chosen, workflow.select("issue_idx", "progress_idx", "status_idx"))


def refresh_summary(
    stored: DataFrame, before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], priorities
) -> DataFrame:
    """D1 over all time after changes: `before` and `after` are issues and workflow of the touched issues."""
    keys = list(SUMMARY_KEYS)
    delta = count_delta(_summary_rows(*before, priorities), _summary_rows(*after, priorities), keys, summary_measures())
    return merged_counts(stored, delta, keys)


def refresh_tags(stored: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Live issues per tag (value, count) after changes of the touched issues."""
    tagged = lambda rows: rows.filter(live() & (F.col("issue_tag") != "")).select(F.col("issue_tag").alias("value"))
    delta = count_delta(tagged(before), tagged(after), ["value"], {"count": None})
    return merged_counts(stored, delta, ["value"])


def refresh_stages(
    stored: DataFrame,
    before: tuple[DataFrame, DataFrame],
    after: tuple[DataFrame, DataFrame],
    wanted: IssueFilter | None = None,
) -> DataFrame:
    """Listed issues per current stage (progress_idx, count) after changes, from which D2 is made."""
    listed = lambda pair: filter_issues(with_current_stage(*pair), wanted).select("progress_idx")
    delta = count_delta(listed(before), listed(after), ["progress_idx"], {"count": None})
    return merged_counts(stored, delta, ["progress_idx"])
