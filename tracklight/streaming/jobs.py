"""Structured Streaming jobs for the live counters, connections, deliveries and memos.

All state lives in tables below `path`, which must be a folder that all executors reach. Each
micro-batch writes folders of its own in overwrite mode, so a batch that is repeated after a
failure replaces its first result. Connections, pushes, deliveries and memos are kept as runs
(`RunLog`): a batch adds its rows to them and never writes all that is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions.dates import month_key, ntz, wall_seconds
from ..operators.memos import LIFETIME_HOURS, expire_memos
from ..operators.notifications import deliverable
from ..operators.usage import LINK_ACTION
from .runs import RunLog, Scratch

CONNECT, CLOSE, PUSH = "connect", "close", "push"

USAGE_KEYS = ("ip", "action", "url")
_DAILY = T.StructType(
    [T.StructField("day", T.DateType())]
    + [T.StructField(k, T.StringType()) for k in USAGE_KEYS]
    + [T.StructField("cnt", T.LongType())]
)

# Events of the notification service: {kind, ip, connection_id, push_id, ts}.
SERVICE_EVENTS = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("connection_id", T.LongType()),
        T.StructField("push_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
    ]
)

_DELIVERED = T.StructType(schemas.PUSHES.fields + [T.StructField("connection_id", T.LongType())])
_SIGNED = T.StructType(_DELIVERED.fields + [T.StructField("times", T.LongType())])
_FINISHED = T.StructType(
    [T.StructField("finished", T.LongType()), T.StructField("clock", T.TimestampNTZType())]
)
_OPEN = [f for f in schemas.CONNECTIONS.names if f != "closed_at"]
_EXPIRING = T.StructType(schemas.MEMOS.fields + [T.StructField("expires", T.StringType())])


def _batch_dir(path: str, table: str, batch_id: int) -> str:
    return f"{path}/{table}/batch={batch_id}"


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _with_column(schema: T.StructType, name: str) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(name, T.LongType())])


def _commit(spark: SparkSession, path: str, batch_id: int, clock=None) -> None:
    """Mark a batch as finished, after all its tables are written."""
    done = spark.range(1).select(
        F.lit(batch_id).cast("long").alias("finished"), ntz(clock).alias("clock")
    )
    done.write.mode("overwrite").parquet(_batch_dir(path, "finished", batch_id))


def last_batch(spark: SparkSession, path: str) -> int:
    """Id of the last finished batch, -1 if there is none."""
    done = _read_or_empty(spark, f"{path}/finished", _FINISHED)
    latest = done.agg(F.max("finished")).first()[0]
    return -1 if latest is None else latest


def _start(
    stream: DataFrame,
    mode: str,
    path: str,
    on_batch: Callable[[DataFrame, int], None],
    available_now: bool,
) -> StreamingQuery:
    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/progress")
        .foreachBatch(on_batch)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


# -- usage counters ---------------------------------------------------------------------------


def stream_usage_counts(
    events: DataFrame, path: str, available_now: bool = False
) -> StreamingQuery:
    """Keep daily counts per client, action and URL from a stream {ip, action, url, ts}.

    Windows of a month do not exist, so days are counted and `usage_counts` rolls them up. Each
    batch writes the counts of its own events and readers add them up, so events count whenever
    they come, and there is no state. URLs of other actions than `link` are not kept. Days are
    those of the timestamps as written, whatever the time zone of the session.
    """
    day = F.date_from_unix_date(F.floor(wall_seconds(F.col("ts")) / 86400).cast("int"))
    days = events.select(
        day.alias("day"),
        "ip",
        "action",
        F.when(F.col("action") == LINK_ACTION, F.col("url")).alias("url"),
    )

    def keep(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("day", *USAGE_KEYS).agg(F.count(F.lit(1)).alias("cnt"))
        counts.write.mode("overwrite").parquet(_batch_dir(path, "daily", batch_id))
        _commit(batch.sparkSession, path, batch_id)

    return _start(days, "append", path, keep, available_now)


def _daily_counts(spark: SparkSession, path: str, last: int) -> DataFrame:
    """The count of each day and key after batch `last`.

    The counts of all batches add up. Batches before the last compaction are not read.
    """
    compacted = _read_or_empty(spark, f"{path}/compacted", _with_column(_DAILY, "upto"))
    upto = compacted.agg(F.coalesce(F.max("upto"), F.lit(-1)).alias("upto")).scalar()
    written = _read_or_empty(spark, f"{path}/daily", _with_column(_DAILY, "batch"))
    rows = compacted.filter(F.col("upto") == upto).withColumnRenamed("upto", "batch").unionByName(
        written.filter((F.col("batch") > upto) & (F.col("batch") <= last))
    )
    return rows.groupBy("day", *USAGE_KEYS).agg(F.sum("cnt").alias("cnt"))


def _is_compacted(spark: SparkSession, path: str, last: int) -> bool:
    done = _read_or_empty(spark, f"{path}/compacted", _with_column(_DAILY, "upto"))
    return not done.filter(F.col("upto") == last).isEmpty()


def compact_usage(spark: SparkSession, path: str) -> None:
    """Fold the finished batches of a `stream_usage_counts` job into one table.

    Run it now and then, while the job runs or not: it only adds a folder, so a failed run
    changes nothing. Older `daily` and `compacted` folders may be removed afterwards.
    """
    last = last_batch(spark, path)
    if last >= 0 and not _is_compacted(spark, path, last):
        counts = _daily_counts(spark, path, last)
        counts.write.mode("overwrite").parquet(f"{path}/compacted/upto={last}")


def usage_counts(spark: SparkSession, path: str) -> DataFrame:
    """Monthly counts {date, ip, action, url, cnt} of the finished batches of a job."""
    return (
        _daily_counts(spark, path, last_batch(spark, path))
        .withColumn("date", month_key(F.col("day")))
        .groupBy("date", *USAGE_KEYS)
        .agg(F.sum("cnt").alias("cnt"))
    )


# -- connections and deliveries ---------------------------------------------------------------


def _intervals(made: DataFrame, ended: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Connections of (id, ip, ts) and (id, ts), and the closes that come before any of them."""
    made = made.filter(F.col("ts").isNotNull() & F.col("id").isNotNull())
    first = made.groupBy("id").agg(F.min(F.struct("ts", "ip")).alias("_made")).select(
        "id", F.col("_made.ip").alias("ip"), F.col("_made.ts").alias("connected_at")
    )
    closes = ended.join(first.select("id", "connected_at"), "id", "left")
    meets = F.coalesce(F.col("ts") >= F.col("connected_at"), F.lit(False))
    last = closes.filter(meets).groupBy("id").agg(F.min("ts").alias("closed_at"))
    return first.join(last, "id", "left"), closes.filter(~meets).select("id", "ts").distinct()


def _made_and_ended(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    kind, named = F.col("kind"), F.col("connection_id").alias("id")
    return (
        events.filter(kind == CONNECT).select(named, "ip", "ts"),
        events.filter(kind == CLOSE).select(named, "ts"),
    )


def connection_intervals(events: DataFrame) -> DataFrame:
    """Connect and close events as connections.

    A connection ends with its first close from the moment it was made; earlier closes are
    ignored, as are those of unknown connections. A close needs no ip.
    """
    return _intervals(*_made_and_ended(events))[0]


def _as_rows(connections: DataFrame, early: DataFrame) -> DataFrame:
    """Connections, and closes that may yet find one, as rows without a moment of connection."""
    waiting = early.select(
        "id",
        F.lit(None).cast("string").alias("ip"),
        F.lit(None).cast("timestamp_ntz").alias("connected_at"),
        F.col("ts").alias("closed_at"),
    )
    return connections.select(*schemas.CONNECTIONS.names).unionByName(waiting)


def _fold_connections(rows: DataFrame) -> DataFrame:
    """Rows of several runs as one row for each connection, and closes that wait for theirs.

    The moment of connection can only move back, so of the closes after it only the first counts.
    """
    made = rows.filter(F.col("connected_at").isNotNull()).select("id", "ip", F.col("connected_at").alias("ts"))
    ended = rows.filter(F.col("closed_at").isNotNull()).select("id", F.col("closed_at").alias("ts"))
    return _as_rows(*_intervals(made, ended))


def _connection_log(spark: SparkSession, path: str) -> RunLog:
    return RunLog(spark, path, "connections", schemas.CONNECTIONS, _fold_connections)


def _push_log(spark: SparkSession, path: str) -> RunLog:
    return RunLog(spark, path, "pushes", schemas.PUSHES)


def _fold_pairs(pairs: DataFrame) -> DataFrame:
    summed = pairs.groupBy(*_DELIVERED.names).agg(F.sum("times").alias("times"))
    return summed.filter(F.col("times") != 0)


def _pair_log(spark: SparkSession, path: str) -> RunLog:
    return RunLog(spark, path, "pairs", _SIGNED, _fold_pairs)


def stream_connections(
    events: DataFrame, path: str, available_now: bool = False
) -> StreamingQuery:
    """Keep the open connections of a stream of connect and close events.

    Events may come in any order, however late. A batch writes what its own events say of their
    connections; readers and merges put that together.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = _connection_log(spark, path)
        log.write(_as_rows(*_intervals(*_made_and_ended(batch))), batch_id)
        _commit(spark, path, batch_id)

    return _start(events, "append", path, handle, available_now)


def _known(log: RunLog, events: DataFrame, batch_id: int) -> DataFrame:
    """What the runs before a batch hold of the connections that its events are about.

    Ids that grow with time lie close together, so their bounds let the scan pass over most files.
    """
    ids = events.select(F.col("connection_id").alias("id")).filter("id IS NOT NULL")
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    rows = log.rows(batch_id - 1)
    if low is None:
        return rows.limit(0)
    return rows.filter(F.col("id").between(low, high)).join(ids.distinct(), "id", "left_semi")


def _settled(old: DataFrame, new: DataFrame, pushes: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Deliveries of earlier pushes that changed connections add (times 1) and take back (-1)."""
    fields = ("ip", "connected_at", "closed_at")
    was = old.select("id", *[F.col(c).alias(f"_{c}") for c in fields])
    same = F.lit(True)
    for c in fields:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    changed = scratch.keep(new.join(was, "id", "left").filter(~same), "changed")
    moved = ~(F.col("ip").eqNullSafe(F.col("_ip")) & F.col("connected_at").eqNullSafe(F.col("_connected_at")))
    begins = F.when(moved, F.col("connected_at")).otherwise(F.least("closed_at", "_closed_at"))
    start = changed.agg(F.min(begins)).first()[0]
    if start is None:
        return None
    clients = changed.select(F.explode(F.array("ip", "_ip")).alias("target_ip")).distinct()
    late = pushes.filter(F.col("sent_at") >= F.lit(start)).join(clients, "target_ip", "left_semi")
    late = scratch.keep(late.select(*schemas.PUSHES.names), "late")
    if late.isEmpty():
        return None
    now = deliverable(late, changed.select("id", *fields)).withColumn("times", F.lit(1).cast("long"))
    before = changed.filter(F.col("_connected_at").isNotNull()).select("id", *[F.col(f"_{c}").alias(c) for c in fields])
    then = deliverable(late, before).withColumn("times", F.lit(-1).cast("long"))
    return _fold_pairs(now.unionByName(then))


def stream_delivery(
    events: DataFrame, path: str, available_now: bool = False
) -> StreamingQuery:
    """Deliver each push of a service event stream to the connections open at that moment.

    After any batch `delivered` and `failed` are what `deliverable` and `undeliverable` give for
    all events so far, in whatever order and batches they came and however late. A batch joins its
    pushes to the connections known by then. Where its events make or move a connection, earlier
    pushes from the moment on that it touches are settled anew: `pairs` says with a sign what comes
    and what is taken back. In a feed without delay there are none. A client with most of the
    connections is spread over the tasks by the join of `deliverable`.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        connections, pushes, pairs = (make(spark, path) for make in (_connection_log, _push_log, _pair_log))
        batch.persist()
        try:
            with Scratch(spark, path, batch_id) as scratch:
                sent = batch.filter(F.col("kind") == PUSH).select(
                    "push_id", F.col("ip").alias("target_ip"), F.col("ts").alias("sent_at")
                )
                own = scratch.keep(_as_rows(*_intervals(*_made_and_ended(batch))), "own")
                connections.write(own, batch_id)
                is_made = F.col("connected_at").isNotNull()
                open_then, settled = own.filter(is_made), None
                if batch_id > 0:
                    known = _known(connections, batch.filter(F.col("kind") != PUSH), batch_id)
                    old = scratch.keep(_fold_connections(known), "old")
                    new = scratch.keep(_fold_connections(own.unionByName(old)), "new")
                    settled = _settled(old.filter(is_made), new.filter(is_made), pushes.read(batch_id - 1), scratch)
                    others = _others(connections.rows(batch_id - 1), new, sent)
                    open_then = scratch.keep(new.unionByName(others).filter(is_made), "open")
                made = deliverable(sent, open_then).withColumn("times", F.lit(1).cast("long"))
                pairs.write(made if settled is None else made.unionByName(settled), batch_id)
                pushes.write(sent, batch_id)
                _commit(spark, path, batch_id)
        finally:
            batch.unpersist()

    return _start(events, "append", path, handle, available_now)


def _others(rows: DataFrame, touched: DataFrame, sent: DataFrame) -> DataFrame:
    """Connections that a batch does not touch but may deliver to: those of its pushes' clients."""
    rows = rows.join(touched.select("id"), "id", "left_anti")
    clients = sent.select(F.col("target_ip").alias("ip")).distinct()
    met = rows.join(clients, "ip", "left_semi").select("id").distinct()
    known = _fold_connections(rows.join(met, "id", "left_semi"))
    # An end is never taken back, so what had closed before the first push stays out.
    first = sent.agg(F.min("sent_at")).scalar()
    still_open = F.col("closed_at").isNull() | (F.col("closed_at") > first)
    return known.filter(still_open).select(*touched.columns)


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """Pushes with the connections that they reach, by the events of all finished batches."""
    pairs = _pair_log(spark, path).read(last_batch(spark, path))
    return pairs.select(*_DELIVERED.names, F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("col")


def failed(spark: SparkSession, path: str) -> DataFrame:
    """Pushes that meet no connection, by the events of all finished batches."""
    last = last_batch(spark, path)
    reached = _pair_log(spark, path).read(last).select("push_id").distinct()
    return _push_log(spark, path).read(last).join(reached, "push_id", "left_anti")


def open_connections(spark: SparkSession, path: str) -> DataFrame:
    """The connections left open after the last finished batch of a job."""
    known = _connection_log(spark, path).read(last_batch(spark, path))
    is_open = F.col("connected_at").isNotNull() & F.col("closed_at").isNull()
    return known.filter(is_open).select(*_OPEN)


def connected_clients(spark: SparkSession, path: str) -> DataFrame:
    """Clients with open connections: ip, connections."""
    return open_connections(spark, path).groupBy("ip").agg(
        F.count(F.lit(1)).alias("connections")
    )


def tidy(spark: SparkSession, path: str) -> int:
    """Remove the runs of a job that later ones have taken up; returns how many. The job must be stopped."""
    last = last_batch(spark, path)
    logs = (_connection_log, _push_log, _pair_log, _memo_log)
    return sum(make(spark, path).tidy(last) for make in logs)


# -- memos ------------------------------------------------------------------------------------

_NEVER, _HOUR = "never", "yyyyMMddHH"


def _memo_log(spark: SparkSession, path: str, clock=None) -> RunLog:
    """Memos in the order in which they expire; merges leave out what has expired at `clock`."""

    def left(rows: DataFrame) -> DataFrame:
        return rows if clock is None else _live(rows, clock)

    return RunLog(spark, path, "memos", _EXPIRING, left, order_by=("expires", "pos"))


def _expires(hours: int) -> Column:
    """The hour in which a memo expires, by which it is stored."""
    ends = F.col("datetime") + F.make_dt_interval(F.lit(0), F.lit(hours))
    hour = F.coalesce(F.date_format(ends, _HOUR), F.lit("0"))
    return F.when(F.coalesce("autoDelete", F.lit(False)), hour).otherwise(F.lit(_NEVER))


def _live(rows: DataFrame, clock) -> DataFrame:
    """Rows not expired; what is stored of past hours is passed over."""
    return expire_memos(rows.filter(F.col("expires") >= F.date_format(ntz(clock), _HOUR)), clock)


def stream_memo_expiry(
    memos: DataFrame, path: str, clock: Callable[[int], object], available_now: bool = False
) -> StreamingQuery:
    """Keep the memos that have not expired from a stream of new ones, and write those that have.

    `clock` gives the time of a batch by its id, so that a repeated batch sees the same time; a
    clock that goes back is taken to stand still. Memos lie in the order of the hours in which they
    expire, in as many files as their size asks for. A batch writes its own memos and, as `expired`,
    those whose time has come since the batch before: of the runs it reads the parts of these hours.
    Merged runs have no expired memos.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now, before = clock(batch_id), _clock(spark, path, batch_id - 1)
        if before is not None:
            now = spark.range(1).select(F.greatest(ntz(now), ntz(before))).first()[0]
        new = batch.select(*schemas.MEMOS.names).withColumn("expires", _expires(LIFETIME_HOURS)).persist()
        try:
            _write_expired(spark, path, new, now, before, batch_id)
            _memo_log(spark, path, now).write(new, batch_id)
            _commit(spark, path, batch_id, now)
        finally:
            new.unpersist()

    return _start(memos, "append", path, handle, available_now)


def _write_expired(spark: SparkSession, path: str, new: DataFrame, now, before, batch_id: int) -> None:
    hour = F.date_format(ntz(now), _HOUR)
    ended = new.filter(F.col("expires") <= hour)
    if before is not None:
        since = F.date_format(ntz(before), _HOUR)
        kept = _memo_log(spark, path).rows(batch_id - 1).filter(F.col("expires").between(since, hour))
        ended = expire_memos(kept, before).unionByName(ended)
    gone = ended.filter(~F.coalesce(F.col("datetime") + F.make_dt_interval(F.lit(0), F.lit(LIFETIME_HOURS)) >= ntz(now), F.lit(False)))
    gone.select(*schemas.MEMOS.names).write.mode("overwrite").parquet(_batch_dir(path, "expired", batch_id))


def _clock(spark: SparkSession, path: str, batch_id: int):
    if batch_id < 0:
        return None
    return spark.read.schema(_FINISHED).parquet(_batch_dir(path, "finished", batch_id)).first()["clock"]


def live_memos(spark: SparkSession, path: str) -> DataFrame:
    """The memos left after the last finished batch of a `stream_memo_expiry` job."""
    last = last_batch(spark, path)
    if last < 0:
        return spark.createDataFrame([], schemas.MEMOS)
    rows = _memo_log(spark, path).rows(last)
    return _live(rows, _clock(spark, path, last)).select(*schemas.MEMOS.names)


def expired_memos(spark: SparkSession, path: str) -> DataFrame:
    """All memos that a `stream_memo_expiry` job has let go."""
    return _read_or_empty(spark, f"{path}/expired", schemas.MEMOS)
