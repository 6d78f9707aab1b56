"""Joins of issues with their workflow stages.

The workflow table holds at most one row per (issue_idx, progress_idx), so no join key here can
be hot; `repeated_stages` finds violations. With both tables bucketed by issue_idx none of these
joins shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DONE = 3
DEVELOPED_STAGE, QA_STAGE, RELEASED_STAGE = 5, 6, 7
STAGES = range(1, 8)
STAGE_FIELDS = ("issue_idx", "progress_idx", "status_idx", "startdate", "completedate")


def repeated_stages(workflow: DataFrame) -> DataFrame:
    """Keys that occur more than once; empty for valid data."""
    return workflow.groupBy("issue_idx", "progress_idx").count().filter(F.col("count") > 1)


def with_current_stage(issues: DataFrame, workflow: DataFrame, bucketed: bool = False) -> DataFrame:
    """Each issue with the status and dates of the stage it is in; issues without it drop out.

    `bucketed` is for tables that are both bucketed by issue_idx: they are joined where they lie,
    by issue_idx alone, and the stage is compared within an issue. Spark would shuffle them for a
    join on both keys.
    """
    if not bucketed:
        return issues.join(workflow, ["issue_idx", "progress_idx"], "inner")
    stage, at = F.col("progress_idx"), F.col("_at")
    named = workflow.withColumnRenamed("progress_idx", "_at")
    # Two bounds, since an equality would become a key of the join.
    meets = (issues["issue_idx"] == named["issue_idx"]) & (at <= stage) & (at >= stage)
    return issues.join(named, meets, "inner").drop(named["issue_idx"]).drop("_at")


def finished_stage(workflow: DataFrame, stage: int, status: int = DONE) -> DataFrame:
    return workflow.filter(
        (F.col("progress_idx") == stage)
        & (F.col("status_idx") == status)
        & F.col("completedate").isNotNull()
    )


def with_stage(issues: DataFrame, workflow: DataFrame, stage: int, status: int = DONE) -> DataFrame:
    """Issues that have finished one stage, with its dates as startdate and completedate."""
    stage_rows = finished_stage(workflow, stage, status).select(
        "issue_idx", "startdate", "completedate"
    )
    return issues.join(stage_rows, "issue_idx", "inner")


def with_qa_start(df: DataFrame, workflow: DataFrame) -> DataFrame:
    """Add the start of the QA stage of the same issue, NULL if there is none."""
    qa = workflow.filter(F.col("progress_idx") == QA_STAGE).select(
        "issue_idx", F.col("startdate").alias("qa_startdate")
    )
    return df.join(qa, "issue_idx", "left")


def nest_workflow(workflow: DataFrame, *others: Column) -> DataFrame:
    """Per issue the array of its stages in stage order (at most seven, by the key).

    `others` are more aggregates of an issue's rows.
    """
    stage = F.struct(
        "progress_idx", *[field for field in STAGE_FIELDS if field != "progress_idx"]
    )
    ordered = F.array_sort(F.collect_list(stage))
    fields = lambda s: F.struct(*[s[field].alias(field) for field in STAGE_FIELDS])
    return workflow.groupBy("issue_idx").agg(
        F.transform(ordered, fields).alias("workflow"), *others
    )


def with_workflow(issues: DataFrame, workflow: DataFrame) -> DataFrame:
    """Add the nested workflow; an issue without stages gets an empty array."""
    nested = nest_workflow(workflow)
    kind = nested.schema["workflow"].dataType
    return issues.join(nested, "issue_idx", "left").withColumn(
        "workflow", F.coalesce("workflow", F.array().cast(kind))
    )
