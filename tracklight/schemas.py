"""Declared schemas of all tables and documents; nothing is inferred at read."""

from __future__ import annotations

from pyspark.sql import types as T

_LONG, _INT, _STR, _BOOL, _TS = (
    T.LongType(),
    T.IntegerType(),
    T.StringType(),
    T.BooleanType(),
    T.TimestampNTZType(),
)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


ISSUES = _schema(
    ("issue_idx", _LONG),
    ("issue_color", _STR),
    ("issue_tag", _STR),
    ("issue_number", _STR),
    ("issue_subject", _STR),
    ("issue_status", _STR),
    ("issue_assigned_to", _STR),
    ("memo", _STR),
    ("progress_idx", _INT),
    ("product_idx", _INT),
    ("category_idx", _LONG),
    ("priority_idx", _INT),
    ("delaycount", _INT),
    ("is_updated", _BOOL),
    ("syncdate", _TS),
    ("createdate", _TS),
    ("updatedate", _TS),
    ("deletedate", _TS),
    ("issue_created_on", _TS),
)

WORKFLOW = _schema(
    ("issue_idx", _LONG),
    ("progress_idx", _INT),
    ("status_idx", _INT),
    ("startdate", _TS),
    ("completedate", _TS),
)

CATEGORIES = _schema(("category_idx", _LONG), ("category_name", _STR))

SAVED_FILTERS = _schema(
    ("filter_idx", _LONG),
    ("filter_name", _STR),
    ("filter_content", _STR),
    ("isdefaultfilter", _STR),
)

VISITS = _schema(("date", _STR), ("ip", _STR), ("cnt", _LONG))
ACTIONS = _schema(("date", _STR), ("ip", _STR), ("action", _STR), ("cnt", _LONG))
URL_HITS = _schema(("date", _STR), ("ip", _STR), ("url", _STR), ("cnt", _LONG))
WEIGHTS = _schema(("action", _STR), ("time", _LONG), ("typing", _LONG))

NOTIFICATIONS = _schema(
    ("id", _LONG),
    ("target_ip", _STR),
    ("type", _STR),
    ("title", _STR),
    ("message", _STR),
    ("action_url", _STR),
    ("is_read", _BOOL),
    ("created_at", _TS),
)

CONNECTIONS = _schema(("id", _LONG), ("ip", _STR), ("connected_at", _TS), ("closed_at", _TS))
PUSHES = _schema(("push_id", _LONG), ("target_ip", _STR), ("sent_at", _TS))

# Link records are read without the stored login name and password, so no output can show them.
LINKS = _schema(
    ("pos", _LONG),
    ("url", _STR),
    ("category", _STR),
    ("description", _STR),
    ("linkimage", _STR),
)
MEMOS = _schema(
    ("pos", _LONG),
    ("key", _STR),
    ("title", _STR),
    ("contents", _STR),
    ("datetime", _TS),
    ("autoDelete", _BOOL),
)
ATTACHMENTS = _schema(("path", _STR), ("name", _STR), ("issue_idx", _LONG))

USAGE_EVENTS = _schema(("ip", _STR), ("action", _STR), ("url", _STR), ("ts", _TS))

CONFIG = T.StructType(
    [
        T.StructField(
            "statistics",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("action", _STR),
                        T.StructField(
                            "value",
                            T.StructType(
                                [T.StructField("time", _LONG), T.StructField("typing", _LONG)]
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)

TABLES = {
    "issues": ISSUES,
    "workflow": WORKFLOW,
    "categories": CATEGORIES,
    "saved_filters": SAVED_FILTERS,
    "visits": VISITS,
    "actions": ACTIONS,
    "url_hits": URL_HITS,
    "notifications": NOTIFICATIONS,
    "connections": CONNECTIONS,
    "pushes": PUSHES,
    "links": LINKS,
    "memos": MEMOS,
    "attachments": ATTACHMENTS,
}
