"""Inputs of the registered queries: the tables of this package derived from the given ones.

Everything is derived by Spark from whole tables, so the queries grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import usage
from ..operators.memos import ADD, DELETE, EDIT

AS_OF = "2001-08-02 12:00:00"
MEMO_CLOCK = "2024-01-01 06:00:00"
PRIORITIES = (0, 1, 2, 3)
LAST_SEEN = ("1998-06-01 00:00:00", 0)  # sort value and issue_idx of a row of the issue list

TEMPLATES = {
    "default": "<div>{{title}}<p>{{message}}</p></div>",
    "hook": "<div>Hook: {{title}}<p>{{message}}</p></div>",
    "jenkins": "<div>Build: {{title}}<p>{{message}}</p></div>",
    "mr": "<div>Merge: {{title}}<p>{{message}}</p></div>",
}

# The configuration lists `link` twice; the later entry counts.
CONFIG_JSON = (
    '{"statistics": ['
    '{"action": "link", "value": {"time": 99, "typing": 99}},'
    '{"action": "link", "value": {"time": 3, "typing": 20}},'
    '{"action": "auth", "value": {"time": 5, "typing": 30}},'
    '{"action": "prop", "value": {"time": 2, "typing": 10}},'
    '{"action": "otp", "value": {"time": 4, "typing": 6}},'
    '{"action": "memo", "value": {"time": 6, "typing": 50}}]}'
)


# Declared, so that building a query starts no job to read a schema.
GIVEN = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def given_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(GIVEN[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(GIVEN[name]).parquet(f"{sf_dir}/{name}.parquet")


def _hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def _minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = "int(substring(o_orderpriority, 1, 1)) - 1"
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS issue_idx",
        "CAST(NULL AS string) AS issue_color",
        "CASE WHEN o_custkey % 5 = 0 THEN '' WHEN o_custkey % 7 <> 0 "
        "THEN concat('tag', o_custkey % 12) END AS issue_tag",
        "CASE WHEN o_orderkey % 29 = 0 THEN '임시' WHEN o_orderkey % 37 <> 0 "
        "THEN string(o_orderkey + 100000) END AS issue_number",
        "concat(o_orderpriority, ' order ', o_orderkey) AS issue_subject",
        "o_orderstatus AS issue_status",
        "concat('user', o_custkey % 40) AS issue_assigned_to",
        "CAST(NULL AS string) AS memo",
        "int(o_orderkey % 7 + 1) AS progress_idx",
        "int(o_custkey % 4) AS product_idx",
        "o_custkey % 6 AS category_idx",
        f"CASE WHEN {priority} < 4 THEN {priority} END AS priority_idx",
        "CAST(NULL AS int) AS delaycount",
        "o_orderkey % 4 = 0 AS is_updated",
        "CAST(NULL AS timestamp_ntz) AS syncdate",
        "o_orderdate AS createdate",
        "CAST(NULL AS timestamp_ntz) AS updatedate",
        "CASE WHEN o_orderkey % 31 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS deletedate",
        "o_orderdate + make_dt_interval(0, int(o_orderkey % 24)) AS issue_created_on",
    )


def workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Stage skeleton and order lines go through one aggregate instead of a join of the two.
    skeleton = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS issue_idx",
        "explode(sequence(1, 7)) AS progress_idx",
        "CAST(NULL AS timestamp_ntz) AS sd",
        "CAST(NULL AS double) AS qty",
        "true AS known",
    )
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS issue_idx",
        "l_linenumber AS progress_idx",
        "l_shipdate AS sd",
        "l_quantity AS qty",
        "false AS known",
    )
    staged = (
        skeleton.unionByName(lines)
        .groupBy("issue_idx", "progress_idx")
        .agg(F.min("sd").alias("sd"), F.min("qty").alias("qty"), F.max("known").alias("known"))
        .filter("known")
    )
    return staged.selectExpr(
        "issue_idx",
        "progress_idx",
        "CASE WHEN sd IS NULL THEN 0 WHEN qty = 7 THEN NULL WHEN qty < 12 THEN 1 "
        "WHEN qty < 25 THEN 2 ELSE 3 END AS status_idx",
        "sd",
        "qty",
    ).selectExpr(
        "issue_idx",
        "progress_idx",
        "status_idx",
        "CASE WHEN status_idx = 1 THEN NULL ELSE sd END AS startdate",
        "CASE WHEN status_idx = 3 AND issue_idx % 11 <> 0 THEN sd + make_dt_interval(int(qty)) END "
        "AS completedate",
    )


def issue_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three changes per issue: even ones set the tag, odd ones the status."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.floor(n / 3).alias("issue_idx"),
        n.alias("seq"),
        F.when(n % 2 == 0, _text("new", F.col("user_id"))).alias("issue_tag"),
        F.when(n % 2 == 1, F.col("event_type")).alias("issue_status"),
        F.when(n % 5 == 0, F.col("user_id").cast("int")).alias("delaycount"),
        (F.col("event_type") == "click").alias("is_updated"),
        (F.col("event_type") == "view").alias("is_syncdate_update"),
    )


def workflow_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field per change; every seventh change of a date clears it. Stage 8 does not exist."""
    n = F.col("event_id")
    field = (
        F.when(n % 3 == 0, F.lit("status_idx"))
        .when(n % 3 == 1, F.lit("startdate"))
        .otherwise(F.lit("completedate"))
    )
    moment = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    value = (
        F.when(n % 3 == 0, (F.col("user_id") % 4).cast("string"))
        .when(n % 7 == 0, F.lit("null"))
        .otherwise(moment)
    )
    return table(spark, sf_dir, "events").select(
        F.floor(n / 4).alias("issue_idx"),
        (F.col("user_id") % 8 + 1).cast("int").alias("progress_idx"),
        n.alias("seq"),
        field.alias("field"),
        value.alias("value"),
    )


def issue_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations: known numbers (also of deleted issues), new ones, repeated ones, none."""
    n = F.col("event_id")
    number = F.when(F.col("event_type") != "error", _text(F.floor(n / 2) * 7 + 100000))
    return table(spark, sf_dir, "events").select(
        n.alias("seq"),
        number.alias("issue_number"),
        _text("event ", n).alias("issue_subject"),
        F.col("event_type").alias("issue_status"),
        _text("user", F.col("user_id")).alias("issue_assigned_to"),
        F.col("ts").alias("issue_created_on"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("category_idx"), F.col("s_name").alias("category_name")
    )


def category_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"), F.col("p_name").alias("category_name")
    )


def category_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several renames per category, some of categories that do not exist."""
    return table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 10).alias("category_idx"),
        F.col("p_partkey").alias("seq"),
        F.col("p_brand").alias("category_name"),
    )


def saved_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("filter_idx"),
        F.col("p_name").alias("filter_name"),
        _text('{"priority_idx":[', F.col("p_size") % 4, "]}").alias("filter_content"),
        F.when(key == 3, F.lit("1")).otherwise(F.lit("0")).alias("isdefaultfilter"),
    )


def filter_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("seq"),
        F.col("s_name").alias("filter_name"),
        _text('{"text":"', F.col("s_name"), '"}').alias("filter_content"),
    )


def filter_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated ids, and ids that do not exist."""
    return table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") * 3).alias("filter_idx")
    ).unionByName(
        table(spark, sf_dir, "supplier").select(
            (F.col("s_suppkey") * 3).alias("filter_idx")
        )
    )


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "substring(o_orderpriority, 1, 1)"
    return table(spark, sf_dir, "orders").selectExpr(
        "concat(CASE WHEN o_custkey % 2 = 0 THEN '::ffff:10.0.0.' ELSE '10.0.0.' END, "
        "o_custkey % 200) AS ip",
        f"CASE {kind} WHEN '1' THEN 'auth' WHEN '2' THEN 'link' WHEN '3' THEN 'prop' "
        "WHEN '4' THEN 'otp' ELSE 'memo' END AS action",
        f"CASE WHEN {kind} = '2' THEN concat('https://h', o_custkey % 9, '.example.com/p', "
        "o_orderkey % 40) END AS url",
        "o_orderdate + make_dt_interval(0, int(o_orderkey % 24)) AS ts",
        "o_orderkey % 3 = 0 AS is_visit",
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.count_visits(usage_events(spark, sf_dir).filter("is_visit"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.count_actions(usage_events(spark, sf_dir))


def url_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.count_url_hits(usage_events(spark, sf_dir))


def config(spark: SparkSession) -> DataFrame:
    entries = "statistics array<struct<action string, value struct<time bigint, typing bigint>>>"
    return spark.range(1).select(F.from_json(F.lit(CONFIG_JSON), entries).alias("c")).select("c.*")


def weights(spark: SparkSession) -> DataFrame:
    return usage.weights_from_config(config(spark))


def _stream_actions(column: str) -> Column:
    kind = F.col(column)
    return (
        F.when(kind == "click", F.lit("link"))
        .when(kind == "view", F.lit("memo"))
        .when(kind == "signup", F.lit("auth"))
        .when(kind == "purchase", F.lit("prop"))
        .otherwise(F.lit("otp"))
    )


def usage_feed(events: DataFrame) -> DataFrame:
    """The `events` table, batch or stream, as a usage feed."""
    action = _stream_actions("event_type")
    k = F.get_json_object("props", "$.k")
    return events.select(
        _text("10.0.0.", F.col("user_id")).alias("ip"),
        action.alias("action"),
        F.when(action == "link", _text("/k", k)).alias("url"),
        "ts",
    )


def service_events(events: DataFrame) -> DataFrame:
    """The `events` table, batch or stream, as events of the notification service.

    A signup or view connects, an error closes the connection 40 events before, the others push.
    """
    n, kind = F.col("event_id"), F.col("event_type")
    connects = kind.isin("signup", "view")
    return events.select(
        F.when(connects, F.lit("connect"))
        .when(kind == "error", F.lit("close"))
        .otherwise(F.lit("push"))
        .alias("kind"),
        F.when(kind != "error", _text("10.0.0.", F.col("user_id"))).alias("ip"),
        F.when(connects, n).when(kind == "error", n - 40).alias("connection_id"),
        F.when(~connects & (kind != "error"), n).alias("push_id"),
        "ts",
    )


def _conversation_id() -> Column:
    return F.col("conv_id") * 8 + F.col("turn")


def _written_at() -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + _minutes(
        F.col("conv_id") * 7 + F.col("turn")
    )


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    kind = (
        F.when(role == "system", F.lit("jenkins"))
        .when(role == "user", F.lit("hook"))
        .when(turn % 3 == 0, F.lit("mr"))
        .otherwise(F.lit("custom"))
    )
    url = (
        F.when(turn % 4 == 1, F.lit(""))
        .when(turn % 4 == 2, F.lit("null"))
        .when(turn % 4 == 3, F.lit("https://example.com/a"))
    )
    return table(spark, sf_dir, "conversations").select(
        _conversation_id().alias("id"),
        _text("10.0.0.", conv % 3).alias("target_ip"),
        kind.alias("type"),
        _text("conv ", conv).alias("title"),
        F.col("text").alias("message"),
        url.alias("action_url"),
        ((conv + turn) % 3 == 0).alias("is_read"),
        _written_at().alias("created_at"),
    )


def read_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read receipts, some for messages of other clients or that do not exist, some repeated."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.floor(n / 2).alias("id"), _text("10.0.0.", F.col("user_id") % 3).alias("ip")
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", F.lit("")).when(
        F.col("event_type") != "view", F.col("event_type")
    )
    return table(spark, sf_dir, "events").select(
        n.alias("seq"),
        _text("10.0.0.", F.col("user_id")).alias("target_ip"),
        kind.alias("type"),
        _text("event ", n).alias("title"),
        F.col("props").alias("message"),
        F.when(n % 2 == 0, F.lit("")).otherwise(_text("/e/", n)).alias("action_url"),
    )


def timed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the moment they are sent, those of purchases in a later batch."""
    events = table(spark, sf_dir, "events")
    sent = events.select(
        F.col("event_id").alias("seq"), F.col("ts").alias("sent_at"), (F.col("event_type") == "purchase").alias("is_later")
    )
    return messages(spark, sf_dir).join(sent, "seq")


def memo_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who made each memo change, and when."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), _text("10.0.0.", F.col("user_id")).alias("ip"), "ts"
    )


def memo_clock(batch_id: int) -> str:
    """The clock of a memo stream: an hour before `MEMO_CLOCK` at first, then that."""
    return "2024-01-01 05:00:00" if batch_id == 0 else MEMO_CLOCK


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "view"))
    return events.select(
        n.alias("id"),
        _text("10.0.0.", F.col("user_id")).alias("ip"),
        F.col("ts").alias("connected_at"),
        F.when(n % 13 != 0, F.col("ts") + _hours(n % 72)).alias("closed_at"),
    )


def pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "click"))
    return events.select(
        F.col("event_id").alias("push_id"),
        _text("10.0.0.", F.col("user_id")).alias("target_ip"),
        F.col("ts").alias("sent_at"),
    )


def _link_url(n: Column) -> Column:
    tail = (
        F.when(n % 6 == 0, _text("/loginPortalForm.sms?u=", n))
        .when(n % 6 == 1, _text("/DLPCenterEDR/x", n))
        .when(n % 6 == 2, _text("/DLPCenter/y", n))
        .when(n % 6 == 3, _text("/cm/z", n))
        .when(n % 6 == 4, _text("/p", n))
        .otherwise(_text("/p", n, "/q"))
    )
    return _text("http://h", n % 211, ".example.com", tail)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made URL for each page, and the URLs of the pages themselves."""
    n = F.col("page_id")
    pages = table(spark, sf_dir, "pages")
    made = pages.select(
        (n * 2).alias("pos"),
        _link_url(n * 3).alias("url"),
        _text("c", n % 4).alias("category"),
        _text("page ", n).alias("description"),
        F.lit(None).cast("string").alias("linkimage"),
    )
    own = pages.filter("url IS NOT NULL").groupBy("url").agg(F.min(n).alias("page_id"))
    return made.unionByName(
        own.select(
            (n * 2 + 1).alias("pos"),
            "url",
            F.lit("own").alias("category"),
            _text("page ", n).alias("description"),
            F.lit(None).cast("string").alias("linkimage"),
        )
    )


def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made URLs, and of the URLs of pages what stands before the last slash, or some that go on."""
    n, page = F.col("doc_id"), F.col("page_id")
    above = F.regexp_replace("url", "/[^/]*$", "")
    return table(spark, sf_dir, "documents").select(
        (n * 2).alias("pos"), _link_url(n).alias("url"), F.col("source").alias("category")
    ).unionByName(
        table(spark, sf_dir, "pages").select(
            (page * 2 + 1).alias("pos"),
            F.when(page % 2 == 0, above).otherwise(F.concat("url", F.lit("/more"))).alias("url"),
            F.lit("page").alias("category"),
        )
    )


def link_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds, edits and deletes that meet each other: URLs repeat about every hundred changes."""
    n = F.col("doc_id")
    kind = (
        F.when(n % 10 == 7, F.lit(EDIT))
        .when(n % 10 >= 8, F.lit(DELETE))
        .otherwise(F.lit(ADD))
    )
    return table(spark, sf_dir, "documents").select(
        n.alias("seq"),
        kind.alias("kind"),
        _link_url(F.floor(n / 4) * 3 + F.col("n_chars") % 2).alias("url"),
        F.col("lang").alias("category"),
        F.col("source").alias("description"),
        F.lit(None).cast("string").alias("linkimage"),
    )


def as_memos(turns: DataFrame) -> DataFrame:
    """The `conversations` table, batch or stream, as memos; up to five share a key."""
    conv, turn = F.col("conv_id"), F.col("turn")
    return turns.select(
        _conversation_id().alias("pos"),
        _text("k", F.floor(_conversation_id() / 5)).alias("key"),
        _text("conv ", conv).alias("title"),
        F.col("text").alias("contents"),
        _written_at().alias("datetime"),
        F.when(turn % 5 != 0, turn % 2 == 0).alias("autoDelete"),
    )


def memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_memos(table(spark, sf_dir, "conversations"))


def memo_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    kind = (
        F.when(F.col("event_type").isin("click", "view"), F.lit(ADD))
        .when(F.col("event_type") == "purchase", F.lit(EDIT))
        .otherwise(F.lit(DELETE))
    )
    return table(spark, sf_dir, "events").select(
        n.alias("seq"),
        kind.alias("kind"),
        _text("k", F.floor(n / 7)).alias("key"),
        _text("event ", n).alias("title"),
        F.col("props").alias("contents"),
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("datetime"),
        (F.col("user_id") % 2 == 0).alias("autoDelete"),
    )


def attachment_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    extension = F.get(
        F.array(*[F.lit(e) for e in ("jpg", "JPEG", "png", "gif", "webp", "webp2", "txt")]),
        (n % 8).cast("int"),
    )
    name = F.when(n % 8 == 7, F.lit(".emptyFolderPlaceholder")).otherwise(
        _text(F.col("source"), "_", n, ".", extension)
    )
    return table(spark, sf_dir, "documents").select(
        _text("issues/", n % 50, "/", name).alias("path")
    )


def templates(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(t).alias("type"), F.lit(b).alias("template")) for t, b in TEMPLATES.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))
