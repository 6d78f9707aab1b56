"""Predicates over issues: the optional list filters and the report filters."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import months_before, ntz

# Fixed value: the number of an issue that is not registered yet ("temporary").
TEMPORARY_NUMBER = "임시"

# Report windows in months.
WINDOW_MONTHS = {"3": 3, "6": 6, "12": 12}


@dataclass(frozen=True)
class IssueFilter:
    """Optional predicates of an issue list; one that is not set adds nothing.

    Not set means None, empty text, an empty list, the bare number 0 or False. To filter on the
    code 0, give `[0]`.
    """

    product_idx: Any = None
    category_idx: Any = None
    priority_idx: Any = None
    progress_idx: Any = None
    status_idx: Any = None
    issue_status: Any = None
    text: str | None = None
    issue_number: str | None = None
    created_after: Any = None
    created_before: Any = None
    only_updated: Any = None
    issue_tag: Any = None
    only_registered: Any = None


def is_set(value: Any) -> bool:
    if isinstance(value, (list, tuple, set, frozenset)):
        items = list(value)
        return len(items) > 1 or (len(items) == 1 and items[0] not in (None, ""))
    return value is not None and value != "" and value != 0


def _is_true(value: Any) -> bool:
    return value is True or value == 1 or value == "1"


def _members(column: str, value: Any) -> Column:
    values = list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]
    return F.col(column).isin(values)


def _containing(text: str) -> str:
    # `%`, `_` and the backslash keep their LIKE meaning; a backslash before any other character
    # means that character.
    plain = re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], text, flags=re.DOTALL)
    return f"%{plain}%"


def predicates(wanted: IssueFilter) -> list[Column]:
    """The set predicates as boolean columns."""
    found = []
    for column in (
        "product_idx",
        "category_idx",
        "priority_idx",
        "progress_idx",
        "status_idx",
        "issue_status",
        "issue_tag",
    ):
        value = getattr(wanted, column)
        if is_set(value):
            found.append(_members(column, value))
    if is_set(wanted.text):
        pattern = F.lit(_containing(wanted.text))
        found.append(
            F.ilike(F.col("issue_subject"), pattern) | F.ilike(F.col("issue_assigned_to"), pattern)
        )
    if is_set(wanted.issue_number):
        found.append(F.like(F.col("issue_number"), F.lit(_containing(wanted.issue_number))))
    if is_set(wanted.created_after):
        found.append(F.col("issue_created_on") > ntz(wanted.created_after))
    if is_set(wanted.created_before):
        found.append(F.col("issue_created_on") < ntz(wanted.created_before))
    if _is_true(wanted.only_updated):
        found.append(F.col("is_updated"))
    if _is_true(wanted.only_registered):
        found.append(registered())
    return found


def registered() -> Column:
    """Has a real number; a missing number does not count as one."""
    return F.col("issue_number") != TEMPORARY_NUMBER


def live() -> Column:
    return F.col("deletedate").isNull()


def filter_issues(df: DataFrame, wanted: IssueFilter | None = None) -> DataFrame:
    """Live issues that meet all set predicates. `status_idx` needs the current stage joined."""
    df = df.filter(live())
    for predicate in predicates(wanted or IssueFilter()):
        df = df.filter(predicate)
    return df


def with_priorities(df: DataFrame, priorities) -> DataFrame:
    """Reports always filter by priority: none given means no rows."""
    return df.filter(F.col("priority_idx").isin(list(priorities or [])))


def report_filter(
    df: DataFrame, priorities, date_type: str = "all", start=None, end=None, as_of=None
) -> DataFrame:
    """Priority set and creation window of the summary report.

    `3`, `6`, `12`: that many months back from `as_of`; `custom`: from `start` to `end`, both
    included, unless one is empty text (an end without a time of day is its midnight); any other
    value: no window.
    """
    df = with_priorities(df, priorities)
    created = F.col("issue_created_on")
    if str(date_type) in WINDOW_MONTHS:
        return df.filter(created >= months_before(as_of, WINDOW_MONTHS[str(date_type)]))
    if date_type == "custom" and start != "" and end != "":
        return df.filter(created.between(ntz(start), ntz(end)))
    return df


def reportable(df: DataFrame, skip_stage_1: bool = True) -> DataFrame:
    """Live, registered issues, by default without those still in stage 1."""
    df = df.filter(live() & registered())
    return df.filter(F.col("progress_idx") != 1) if skip_stage_1 else df
