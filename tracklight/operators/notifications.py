"""Notifications: storing, delivering, listing, reading, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.dates import ntz, wall_micros, wall_minutes
from ..plans.intervals import LEVEL, PIECE, with_interval_pieces, with_point_pieces
from ..plans.scans import BLOCK, row_numbers, running, spread
from ..schemas import NOTIFICATIONS

# Fixed value: length of an inbox.
INBOX_ROWS = 100

_STORED = T.StructType(NOTIFICATIONS.fields + [T.StructField("seq", T.LongType())])
_BATCHED = T.StructType(_STORED.fields + [T.StructField("batch", T.LongType())])

INBOX_COLUMNS = ("id", "type", "title", "message", "action_url", "is_read", "created_at")


def next_notifications(messages: DataFrame, stored: DataFrame, as_of, keep_seq: bool = False) -> DataFrame:
    """Rows to append for new messages {seq, target_ip, type, title, message, action_url}.

    Ids go on from the highest stored one in the order of `seq`, which `keep_seq` keeps.
    """
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).scalar()
    return row_numbers(messages, "seq", "_n").select(
        (last + F.col("_n")).alias("id"),
        "target_ip",
        text.stored_type(F.col("type")).alias("type"),
        "title",
        "message",
        text.stored_url(F.col("action_url")).alias("action_url"),
        F.lit(False).alias("is_read"),
        ntz(as_of).alias("created_at"),
        *(["seq"] if keep_seq else []),
    )


def append_notifications(messages: DataFrame, stored: DataFrame, path: str, as_of) -> None:
    """Append new messages to the notification table at `path`."""
    next_notifications(messages, stored, as_of).write.mode("append").parquet(path)


def store_messages(messages: DataFrame, path: str, batch_id: int, as_of) -> DataFrame:
    """Store a batch of messages in the notification table at `path`; returns them with ids and `seq`.

    Each batch has a folder. Its ids go on from the highest of the batches before it, which do not
    change any more, so a repeated batch replaces its messages by the same ones with the same ids.
    """
    spark = messages.sparkSession
    folder = f"{path}/batch={batch_id}"
    earlier = stored_messages(spark, path, batch_id - 1)
    numbered = next_notifications(messages, earlier, as_of, keep_seq=True)
    numbered.write.mode("overwrite").parquet(folder)
    return spark.read.schema(_STORED).parquet(folder)


def stored_messages(spark: SparkSession, path: str, upto: int) -> DataFrame:
    """The notification table of the batches 0 to `upto`, all of which must be there."""
    if upto < 0:
        return spark.createDataFrame([], NOTIFICATIONS)
    batches = spark.read.schema(_BATCHED).parquet(path)
    return batches.filter(F.col("batch") <= upto).select(*NOTIFICATIONS.names)


def send_pushes(
    messages: DataFrame, connections: DataFrame, path: str, batch_id: int, as_of
) -> tuple[DataFrame, DataFrame]:
    """Send messages {seq, target_ip, type, title, message, action_url, sent_at}.

    A message whose client has open connections at `sent_at` is stored, once, and goes to each of
    them: the first result is (connection_id, id, target_ip, payload), the payload naming the id
    under which the message is stored. The others fail and are not stored: the second result is
    their `seq`. `seq` is unique within the batch; a batch may be repeated.
    """
    spark = messages.sparkSession
    pushes = messages.select(F.col("seq").alias("push_id"), "target_ip", "sent_at")
    folder = f"{path}-sent/batch={batch_id}"
    # Who gets a message is settled before its id is, and both are read back.
    deliverable(pushes, connections).select(F.col("push_id").alias("seq"), "connection_id").write.mode("overwrite").parquet(folder)
    reached = spark.read.parquet(folder)
    heard = messages.join(reached.select("seq").distinct(), "seq", "left_semi")
    stored = store_messages(heard, path, batch_id, as_of)
    payload = text.push_payload(*[F.col(c) for c in ("id", "type", "title", "message", "target_ip")])
    sent = reached.join(stored, "seq").select("connection_id", "id", "target_ip", payload.alias("payload"))
    return sent, messages.select("seq").join(reached.select("seq").distinct(), "seq", "left_anti")


def inbox(notifications: DataFrame, ip: str | None = None, n: int = INBOX_ROWS) -> DataFrame:
    """The newest n messages of one client, or of every client; ties go by id.

    For all clients Spark keeps n rows per client in each input partition before it shuffles, so
    a client with most of the messages costs no more than the others.
    """
    newest = [F.desc("created_at"), F.desc("id")]
    if ip is not None:
        mine = notifications.filter(F.col("target_ip") == ip)
        return mine.orderBy(*newest).limit(n).select(*INBOX_COLUMNS)
    rank = F.row_number().over(Window.partitionBy("target_ip").orderBy(*newest))
    return (
        notifications.select("target_ip", *INBOX_COLUMNS, rank.alias("_n"))
        .filter(F.col("_n") <= n)
        .drop("_n")
    )


def notification_by_id(notifications: DataFrame, id: int, ip: str) -> DataFrame:
    """One message, if it belongs to the client."""
    return notifications.filter((F.col("id") == id) & (F.col("target_ip") == ip)).select(
        *INBOX_COLUMNS
    )


def mark_read(notifications: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set is_read for the given (id, ip) pairs.

    Returns the next notification table, and the distinct pairs with `updated`: whether the
    message exists and belongs to the client.
    """
    wanted = pairs.select("id", F.col("ip").alias("target_ip")).distinct()
    after = (
        notifications.join(wanted.withColumn("_hit", F.lit(True)), ["id", "target_ip"], "left")
        .withColumn("is_read", F.when(F.col("_hit"), F.lit(True)).otherwise(F.col("is_read")))
        .select(*notifications.columns)
    )
    known = notifications.select("id", "target_ip").withColumn("_hit", F.lit(True))
    updated = wanted.join(known, ["id", "target_ip"], "left").select(
        "id", F.col("target_ip").alias("ip"), F.coalesce("_hit", F.lit(False)).alias("updated")
    )
    return after, updated


def _open_at(pushed: str) -> Column:
    sent = F.col(pushed)
    return (F.col("connected_at") <= sent) & (
        F.col("closed_at").isNull() | (sent < F.col("closed_at"))
    )


def _pieces(pushes: DataFrame, connections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pushes and connections by client and piece of time, in minutes from the first push.

    Only the time from the first to the last push counts, so a short batch has few pieces and an
    open end costs no more than any other. A push has one piece for each level, about 22 for ten
    years; neither side is read again to find out which of them are used.
    """
    minute = wall_minutes(F.col("sent_at"))
    bounds = pushes.agg(
        F.struct(
            F.coalesce(F.min(minute), F.lit(0)).alias("first"),
            F.coalesce(F.max(minute), F.lit(0)).alias("last"),
        ).alias("bounds")
    ).scalar()
    first, last = F.col("_bounds.first"), F.col("_bounds.last")
    levels = F.ceil(F.log2((last - first + 1).cast("double"))).cast("int")
    start = F.greatest(wall_minutes(F.col("connected_at")), first) - first
    end = F.least(F.coalesce(wall_minutes(F.col("closed_at")), last), last) + 1 - first
    renamed = connections.select(
        F.col("id").alias("connection_id"),
        F.col("ip").alias("target_ip"),
        "connected_at",
        "closed_at",
    ).withColumn("_bounds", bounds)
    stays = with_interval_pieces(renamed, start, end, levels).drop("_bounds")
    points = with_point_pieces(
        pushes.withColumn("_bounds", bounds), minute - first, F.sequence(F.lit(0), levels)
    )
    return points.drop("_bounds"), stays


def deliverable(pushes: DataFrame, connections: DataFrame) -> DataFrame:
    """Each push with each connection of its client that is open when it is sent.

    A connection is open from `connected_at` until just before `closed_at`. The join is on the
    client and a piece of time, so pairs that are not in the result are (but for those within one
    minute of an end) never formed, and one busy client spreads over many join keys.
    """
    keys = ["target_ip", LEVEL, PIECE]
    points, stays = (spread(side, *keys) for side in _pieces(pushes, connections))
    pairs = points.join(stays, keys)
    return pairs.filter(_open_at("sent_at")).select(*pushes.columns, "connection_id")


def undeliverable(pushes: DataFrame, connections: DataFrame) -> DataFrame:
    """Pushes whose client has no open connection; they fail and are not stored.

    A sweep over the time of each client counts the connections: one more where one begins, one
    less where it ends. No push meets a connection. The running counts go over minutes and within
    them, so a busy client spreads over the tasks.
    """
    moments = connections.filter(F.coalesce(F.col("closed_at") > F.col("connected_at"), F.col("closed_at").isNull()))
    none = F.lit(None).cast(pushes.schema)
    begins, ends = (
        moments.filter(F.col(c).isNotNull()).select(
            F.col("ip").alias("_client"), F.col(c).alias("_ts"), F.lit(step).alias("_step"), none.alias("_push")
        )
        for c, step in (("connected_at", 1), ("closed_at", -1))
    )
    asked = pushes.select(
        F.col("target_ip").alias("_client"), F.col("sent_at").alias("_ts"), F.lit(0).alias("_step"), F.struct("*").alias("_push")
    )
    # What begins or ends at the moment of a push counts for it.
    place = wall_micros(F.col("_ts")) * 2 + F.when(F.col("_push").isNull(), 0).otherwise(1)
    swept = asked.unionByName(begins).unionByName(ends).select("*", place.alias("_place"), wall_minutes(F.col("_ts")).alias(BLOCK))
    known = swept.filter(F.col("_client").isNotNull() & F.col("_ts").isNotNull())
    counted = running(known, ["_client"], "_place", {"_open": ("sum", F.col("_step"))})
    alone = counted.filter(F.col("_push").isNotNull() & (F.col("_open") == 0)).select("_push.*")
    unknown = pushes.filter(F.col("target_ip").isNull() | F.col("sent_at").isNull())
    return alone.unionByName(unknown)


def with_template(notifications: DataFrame, templates: DataFrame) -> DataFrame:
    """Add the `template` of the message type; an unknown type gets the default template.

    A type has one template. Without a default template, messages of unknown types are an error.
    """
    default = (
        templates.filter(F.col("type") == text.DEFAULT_TYPE)
        .agg(F.first("template").alias("template"))
        .scalar()
    )
    own = templates.select("type", F.col("template").alias("_own"))
    missing = F.raise_error(F.lit(f"no template of type {text.DEFAULT_TYPE!r}")).cast("string")
    return (
        notifications.join(own, "type", "left")
        .withColumn("template", F.coalesce("_own", default, missing))
        .drop("_own")
    )


def rendered(notifications: DataFrame, templates: DataFrame) -> DataFrame:
    """What a client sees of each message: labels, summary, filled template, action flag."""
    title, message, read = F.col("title"), F.col("message"), F.col("is_read")
    return with_template(notifications, templates).select(
        "id",
        "target_ip",
        text.type_label(F.col("type")).alias("type_label"),
        "title",
        text.summary(message).alias("summary"),
        text.read_label(read).alias("read_label"),
        text.read_class(read).alias("read_class"),
        text.has_action(F.col("action_url")).alias("has_action"),
        text.popup_url(F.col("target_ip"), F.col("id")).alias("popup_url"),
        text.rendered(F.col("template"), title, message).alias("body"),
    )
