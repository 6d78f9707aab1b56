"""Applying batches of changes: tables in, next snapshot out.

A batch may hold several changes per key. They are folded to one row per key first, by partial
aggregates (`max_by`, `min_by`), so a key with most of the changes is reduced before the shuffle.
`seq` is the position of a change in the batch: dense, not negative, unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import ntz
from ..plans.scans import row_numbers
from ..session import ensure_checkpoint_dir
from .filters import TEMPORARY_NUMBER
from .stages import STAGES

CHANGEABLE = (
    "issue_color",
    "issue_tag",
    "issue_number",
    "issue_subject",
    "issue_status",
    "issue_assigned_to",
    "product_idx",
    "category_idx",
    "priority_idx",
    "progress_idx",
    "delaycount",
    "memo",
)

# Column defaults of new rows: a new issue is in stage 1, its stages are waiting.
NEW_ISSUE_STAGE = 1
NEW_STAGE_STATUS = 0

# Text that clears a date, and the flag of a filter that is not the default.
CLEAR = "null"
NOT_DEFAULT = "0"


# -- ids --------------------------------------------------------------------------------------


def max_id(df: DataFrame, key: str) -> Column:
    """The highest key in use, 0 for an empty table (so the first id is 1)."""
    return df.agg(F.coalesce(F.max(key), F.lit(0)).alias(key)).scalar()


def next_id(df: DataFrame, key: str) -> DataFrame:
    """The id the next row would get."""
    return df.agg((F.coalesce(F.max(key), F.lit(0)) + 1).alias("next_id"))


def _with_new_ids(batch: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    numbered = row_numbers(batch, "seq", "_n")
    kind = existing.schema[key].dataType
    return numbered.withColumn(key, (max_id(existing, key) + F.col("_n")).cast(kind)).drop("_n")


def _append(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows that have some of the columns; the others become NULL."""
    given = set(rows.columns)
    aligned = rows.select(
        *[
            (F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in existing.schema
        ]
    )
    return existing.unionByName(aligned)


# -- issues -----------------------------------------------------------------------------------


def only_new(candidates: DataFrame, issues: DataFrame) -> DataFrame:
    """Candidates whose issue_number is not in use, be it by a deleted issue.

    The numbers are made distinct before the join: most issues may share the temporary number.
    Candidates without a number are new, and stay out of the join, where they would be one key.
    """
    number = F.col("issue_number")
    used = issues.filter(number.isNotNull()).select("issue_number").distinct()
    numbered = candidates.filter(number.isNotNull()).join(used, "issue_number", "left_anti")
    return numbered.select(*candidates.columns).unionByName(candidates.filter(number.isNull()))


def seed_workflow(issue_ids: DataFrame, status: int | None = NEW_STAGE_STATUS) -> DataFrame:
    """The seven stage rows of each new issue."""
    return issue_ids.select(
        "issue_idx",
        F.explode(F.lit(list(STAGES))).alias("progress_idx"),
        F.lit(status).cast("int").alias("status_idx"),
        F.lit(None).cast("timestamp_ntz").alias("startdate"),
        F.lit(None).cast("timestamp_ntz").alias("completedate"),
    )


def new_issues(issues: DataFrame, batch: DataFrame, as_of) -> DataFrame:
    """The issue rows to insert for a batch {seq, issue_number, issue_subject, issue_status,
    issue_assigned_to, issue_created_on}.

    Without a number: a temporary issue with a subject only. With a number: inserted unless the
    number is in use or came earlier in the batch.
    """
    number = F.col("issue_number")
    unnumbered = number.isNull() | (number == "")
    fields = ("issue_subject", "issue_status", "issue_assigned_to", "issue_created_on")
    temporary = batch.filter(unnumbered).select(
        "seq", F.lit(TEMPORARY_NUMBER).alias("issue_number"), "issue_subject"
    )
    first = (
        batch.filter(~unnumbered)
        .groupBy("issue_number")
        .agg(F.min("seq").alias("seq"), F.min_by(F.struct(*fields), "seq").alias("f"))
        .select("seq", "issue_number", "f.*")
    )
    ensure_checkpoint_dir(issues.sparkSession)
    # The numbering reads them twice, and both results of a registration number them.
    accepted = only_new(first, issues).unionByName(temporary, allowMissingColumns=True).checkpoint()
    return _with_new_ids(accepted, issues, "issue_idx").select(
        "issue_idx",
        "issue_number",
        *fields,
        F.lit(NEW_ISSUE_STAGE).alias("progress_idx"),
        F.lit(False).alias("is_updated"),
        ntz(as_of).alias("createdate"),
    )


def register_issues(
    issues: DataFrame, workflow: DataFrame, batch: DataFrame, as_of
) -> tuple[DataFrame, DataFrame]:
    """Next issues and workflow after registering a batch."""
    added = new_issues(issues, batch, as_of)
    return _append(issues, added), workflow.unionByName(
        seed_workflow(added.select("issue_idx")).select(*workflow.columns)
    )


def update_issues(issues: DataFrame, changes: DataFrame, as_of) -> DataFrame:
    """Next issues after partial updates {issue_idx, seq, <changeable columns>, is_updated,
    is_syncdate_update}.

    An absent or NULL column keeps its value. Every change stamps updatedate; is_updated becomes
    what the last change says, false if it says nothing.
    """
    seq, given = F.col("seq"), set(changes.columns)
    columns = [c for c in CHANGEABLE if c in given]
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in given else F.lit(False)
    folded = changes.groupBy("issue_idx").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), seq)).alias(f"_{c}") for c in columns],
        F.max_by(flag("is_updated"), seq).alias("_is_updated"),
        F.max(flag("is_syncdate_update")).alias("_sync"),
        F.lit(True).alias("_hit"),
    )
    now = ntz(as_of)
    new = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}
    new["is_updated"] = F.when(F.col("_hit"), F.col("_is_updated")).otherwise(F.col("is_updated"))
    new["syncdate"] = F.when(F.col("_sync"), now).otherwise(F.col("syncdate"))
    new["updatedate"] = F.when(F.col("_hit"), now).otherwise(F.col("updatedate"))
    return issues.join(folded, "issue_idx", "left").select(
        *[new.get(c, F.col(c)).alias(c) for c in issues.columns]
    )


def update_workflow(
    workflow: DataFrame, issues: DataFrame, changes: DataFrame, as_of
) -> tuple[DataFrame, DataFrame]:
    """Next workflow and issues after changes {issue_idx, progress_idx, seq, field, value}.

    `field` is status_idx, startdate or completedate, `value` its text; NULL or `null` clears.
    The issue is stamped as changed and not updated even if it has no such stage.
    """
    fields = {"status_idx": "int", "startdate": "timestamp_ntz", "completedate": "timestamp_ntz"}
    value = F.when(F.col("value") != CLEAR, F.col("value"))
    # The struct is not NULL even if the value is, so a clear wins over an earlier value.
    folded = changes.groupBy("issue_idx", "progress_idx").agg(
        *[
            F.max_by(F.struct(value.alias("v")), F.when(F.col("field") == f, F.col("seq"))).alias(
                f"_{f}"
            )
            for f in fields
        ]
    )
    new = {
        f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}")["v"].cast(kind)).otherwise(F.col(f))
        for f, kind in fields.items()
    }
    stages = workflow.join(folded, ["issue_idx", "progress_idx"], "left").select(
        *[new.get(c, F.col(c)).alias(c) for c in workflow.columns]
    )
    touched = folded.select("issue_idx").distinct().withColumn("_hit", F.lit(True))
    hit = F.col("_hit")
    stamps = {
        "updatedate": F.when(hit, ntz(as_of)).otherwise(F.col("updatedate")),
        "is_updated": F.when(hit, F.lit(False)).otherwise(F.col("is_updated")),
    }
    stamped = issues.join(touched, "issue_idx", "left").select(
        *[stamps.get(c, F.col(c)).alias(c) for c in issues.columns]
    )
    return stages, stamped


def soft_delete(issues: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """Next issues with deletedate set for the given ids, also if it was set before."""
    gone = ids.select("issue_idx").distinct().withColumn("_hit", F.lit(True))
    deleted = F.when(F.col("_hit"), ntz(as_of)).otherwise(F.col("deletedate"))
    return issues.join(gone, "issue_idx", "left").select(
        *[deleted.alias(c) if c == "deletedate" else F.col(c) for c in issues.columns]
    )


# -- categories and saved filters -------------------------------------------------------------


def add_category(categories: DataFrame, batch: DataFrame) -> DataFrame:
    """Append categories {seq, category_name} with the next ids."""
    return _append(categories, _with_new_ids(batch, categories, "category_idx"))


def rename_category(categories: DataFrame, changes: DataFrame) -> DataFrame:
    """Rename by {category_idx, seq, category_name}; the last change of a key wins."""
    last = changes.groupBy("category_idx").agg(
        F.max_by(F.struct(F.col("category_name").alias("v")), "seq").alias("_new")
    )
    name = F.when(F.col("_new").isNotNull(), F.col("_new")["v"]).otherwise(F.col("category_name"))
    return categories.join(last, "category_idx", "left").select(
        "category_idx", name.alias("category_name")
    )


def add_filter(saved_filters: DataFrame, batch: DataFrame) -> DataFrame:
    """Append filters {seq, filter_name, filter_content}; none of them is the default."""
    rows = _with_new_ids(batch, saved_filters, "filter_idx")
    return _append(saved_filters, rows.withColumn("isdefaultfilter", F.lit(NOT_DEFAULT)))


def delete_filter(saved_filters: DataFrame, ids: DataFrame) -> DataFrame:
    return saved_filters.join(ids.select("filter_idx").distinct(), "filter_idx", "left_anti")


def set_default_filter(saved_filters: DataFrame, filter_idx: int, flag: str = "1") -> DataFrame:
    """Flag one filter and clear all others; an unknown id clears all."""
    chosen = F.when(F.col("filter_idx") == filter_idx, F.lit(flag)).otherwise(F.lit(NOT_DEFAULT))
    return saved_filters.withColumn("isdefaultfilter", chosen)
