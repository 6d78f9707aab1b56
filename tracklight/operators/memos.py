"""Memos: a keyed collection with expiry, in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import ntz
from ..plans.scans import row_numbers, running, with_blocks
from ..session import ensure_checkpoint_dir
from .usage import MEMO_ACTION

ADD, EDIT, DELETE = "add", "edit", "delete"

# Fixed value: hours an auto-delete memo lives.
LIFETIME_HOURS = 3

NO_SUCH_EDIT = "no data to change"
NO_SUCH_DELETE = "no data to delete"


def change_kind(is_edit, is_delete):
    """The kind of a change request; delete wins over edit, neither means add."""
    return (
        F.when(F.coalesce(is_delete, F.lit(False)), F.lit(DELETE))
        .when(F.coalesce(is_edit, F.lit(False)), F.lit(EDIT))
        .otherwise(F.lit(ADD))
    )


def _judged(memos: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes with `_before`, the memos of the key at that point, and `_gone`, those deleted.

    With A adds and D deletes so far the number present is `c0 + A - D` as long as no delete
    finds nothing; each time the running sum reaches a new low below zero, one delete did. So
    it is `sum + max(c0, -lowest sum)`.
    """
    initial = memos.groupBy("key").agg(F.count(F.lit(1)).alias("_c0"))
    kind = F.col("kind")
    step = F.when(kind == ADD, 1).when(kind == DELETE, -1).otherwise(0)
    staged = running(
        with_blocks(changes.withColumn("_step", step), "seq"),
        ["key"],
        "seq",
        {
            "_sum": ("sum", F.col("_step")),
            "_adds": ("sum", F.when(kind == ADD, 1).otherwise(0)),
        },
    )
    staged = running(
        staged, ["key"], "seq", {"_low": ("min", F.col("_sum") + F.col("_step"))}
    ).join(initial, "key", "left")
    start = F.coalesce("_c0", F.lit(0))
    before = F.col("_sum") + F.greatest(start, -F.coalesce(F.col("_low"), F.lit(0)))
    return staged.withColumn("_before", before).withColumn(
        "_gone", start + F.col("_adds") - F.col("_before")
    )


def apply_memo_changes(memos: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply {seq, kind, key, title, contents, datetime, autoDelete} in the order of `seq`.

    Returns the next memos, and the rejected changes with `reason`. Keys may repeat: edit and
    delete act on the first memo of the key in file order (`pos`), and fail if there is none. An
    edit replaces the whole record in its place. The result is that of applying the changes one
    by one. `pos` of the memos and `seq` are dense, unique and not negative; keys are not NULL.
    """
    fields = ("title", "contents", "datetime", "autoDelete")
    ensure_checkpoint_dir(memos.sparkSession)
    # Judged without the contents, and once for both results.
    judged = _judged(memos, changes.select("seq", "kind", "key")).checkpoint()
    kind, before = F.col("kind"), F.col("_before")
    refused = (kind != ADD) & (before <= 0)
    reason = F.when(kind == DELETE, F.lit(NO_SUCH_DELETE)).otherwise(F.lit(NO_SUCH_EDIT))
    rejected = judged.filter(refused).select("seq", "kind", "key", reason.alias("reason"))

    # The memos of a key form a queue: adds join its end, deletes take its head, edits rewrite its
    # head. `_at` numbers the queue from 0, so the first `_deleted` numbers are gone, and only
    # edits made after the last delete concern the head that is left.
    accepted = judged.filter(~refused)
    per_key = accepted.groupBy("key").agg(
        F.sum(F.when(kind == DELETE, 1).otherwise(0)).alias("_deleted"),
        F.max_by(F.struct("seq", "_gone"), F.when(kind == EDIT, F.col("seq"))).alias("_edit"),
    )
    gone = F.coalesce("_deleted", F.lit(0))
    edited = (F.col("_at") == gone) & (F.col("_edit._gone") == gone)
    last_pos = memos.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("pos")).scalar()
    stored = row_numbers(memos, "pos", "_at", ["key"]).withColumn("_at", F.col("_at") - 1)
    added = accepted.filter(kind == ADD).select(
        (last_pos + 1 + F.col("seq")).alias("pos"),
        "key",
        F.col("seq").alias("_source"),
        (F.coalesce("_c0", F.lit(0)) + F.col("_adds")).alias("_at"),
    )
    left = (
        stored.unionByName(added, allowMissingColumns=True)
        .join(per_key, "key", "left")
        .filter(F.col("_at") >= gone)
        .withColumn("_source", F.when(edited, F.col("_edit.seq")).otherwise(F.col("_source")))
    )
    kept = left.filter(F.col("_source").isNull()).select("pos", "key", *fields)
    written = left.filter(F.col("_source").isNotNull()).select("pos", "key", "_source")
    contents = changes.select(F.col("seq").alias("_source"), *fields)
    return kept.unionByName(written.join(contents, "_source").drop("_source")), rejected


def memo_usage(changes: DataFrame, rejected: DataFrame) -> DataFrame:
    """The usage events {ip, action, url, ts} of saved memos: each success but a delete counts."""
    saved = changes.filter(F.col("kind") != DELETE).join(rejected.select("seq"), "seq", "left_anti")
    return saved.select(
        "ip", F.lit(MEMO_ACTION).alias("action"), F.lit(None).cast("string").alias("url"), "ts"
    )


def expire_memos(memos: DataFrame, as_of, hours: int = LIFETIME_HOURS) -> DataFrame:
    """Drop auto-delete memos older than `hours`, or with an unreadable time."""
    age = F.make_dt_interval(F.lit(0), F.lit(hours))
    young = F.coalesce(F.col("datetime") + age >= ntz(as_of), F.lit(False))
    return memos.filter(young | ~F.coalesce("autoDelete", F.lit(False)))


def memo_list(memos: DataFrame, as_of) -> DataFrame:
    """Memos that are left, newest first, ties by key and place in the file."""
    return expire_memos(memos, as_of).orderBy(F.col("datetime").desc_nulls_last(), "key", "pos")
