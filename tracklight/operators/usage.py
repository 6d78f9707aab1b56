"""Monthly usage counters, weighted savings, URL rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_key, month_key_label
from ..plans.scans import ranked_by_count

# The actions that save time, and the one that opens a link.
SAVING_ACTIONS = ("auth", "link", "prop", "otp", "memo")
LINK_ACTION = "link"
MEMO_ACTION = "memo"
TREND_MONTHS = 6

VISIT_KEYS = ("date", "ip")
ACTION_KEYS = ("date", "ip", "action")
URL_KEYS = ("date", "ip", "url")


# -- counters ---------------------------------------------------------------------------------


def _monthly(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return (
        events.withColumn("date", month_key(F.col("ts")))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def count_visits(visits: DataFrame) -> DataFrame:
    """Visits {ip, ts} per month and client."""
    return _monthly(visits, VISIT_KEYS)


def count_actions(events: DataFrame) -> DataFrame:
    """Usage events {ip, action, url, ts} per month, client and action."""
    return _monthly(events, ACTION_KEYS)


def count_url_hits(events: DataFrame) -> DataFrame:
    """Opened links per month, client and URL; other actions have no URL."""
    return _monthly(events.filter(F.col("action") == LINK_ACTION), URL_KEYS)


def count_clients(events: DataFrame) -> DataFrame:
    """The clients {date, ip} of each month, once each: a state that can be merged and rolled up."""
    return events.select(month_key(F.col("ts")).alias("date"), "ip").distinct()


def merge_clients(current: DataFrame, delta: DataFrame) -> DataFrame:
    """Clients of months with those of new events."""
    return current.unionByName(delta).distinct()


def active_clients(clients: DataFrame, months: int = 3) -> DataFrame:
    """Distinct clients of each period of `months` months, by its first and last month.

    Clients are made distinct by period before they are counted, so both steps combine in each
    task, and a period that most clients fall into is not one task's work.
    """
    place = F.col("date").substr(1, 4).cast("int") * 12 + F.col("date").substr(5, 2).cast("int") - 1
    period = F.floor(place / months) * months
    label = lambda m: F.concat(F.lpad(F.floor(m / 12).cast("string"), 4, "0"), F.lpad((m % 12 + 1).cast("string"), 2, "0"))
    counted = clients.select(period.alias("_period"), "ip").distinct().groupBy("_period").agg(F.count("ip").alias("active_cnt"))
    return counted.select(
        label(F.col("_period")).alias("first"), label(F.col("_period") + months - 1).alias("last"), "active_cnt"
    )


#: Registers of a client sketch, as a power of two: a standard error of about 1.04 / 2^(n/2), 1.6 %.
SKETCH_BITS = 12


def sketch_clients(clients: DataFrame) -> DataFrame:
    """One sketch {date, sketch} of a few kilobytes for the clients of each month."""
    return clients.groupBy("date").agg(F.hll_sketch_agg("ip", SKETCH_BITS).alias("sketch"))


def estimated_clients(sketches: DataFrame, first: str, last: str) -> DataFrame:
    """About how many distinct clients the months from `first` to `last` have, from their sketches."""
    within = sketches.filter(F.col("date").between(first, last))
    return within.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("active_cnt"))


def merge_counts(current: DataFrame, delta: DataFrame) -> DataFrame:
    """Add new counts to a counter table of any of the three kinds."""
    keys = [c for c in current.columns if c != "cnt"]
    return current.unionByName(delta).groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


def merge_touched(current: DataFrame, delta: DataFrame) -> DataFrame:
    """The months of a counter table that new counts change, merged.

    With the table partitioned by `date`, only these partitions are read, and writing the
    result with `write_table(.., partition_by="date")` replaces only them.
    """
    months = delta.select("date").distinct()
    return merge_counts(current.join(months, "date", "left_semi"), delta)


# -- weights ----------------------------------------------------------------------------------


def weights_from_config(config: DataFrame) -> DataFrame:
    """Weights per action from the configuration document; of repeated entries the last counts."""
    entries = config.select(F.posexplode("statistics").alias("pos", "entry"))
    return (
        entries.select("pos", "entry.action", "entry.value")
        .filter(F.col("action").isin(*SAVING_ACTIONS))
        .groupBy("action")
        .agg(F.max_by(F.struct("value.time", "value.typing"), "pos").alias("value"))
        .select("action", "value.time", "value.typing")
    )


def _weight_map(weights: DataFrame, kind: str) -> Column:
    # One entry per known action, so at most five.
    known = weights.filter(F.col("action").isin(*SAVING_ACTIONS))
    entries = F.collect_list(F.struct(F.col("action"), F.col(kind)))
    return known.agg(F.map_from_entries(entries).alias(kind)).scalar()


def with_weights(actions: DataFrame, weights: DataFrame) -> DataFrame:
    """Add the time and typing weight of each row's action, NULL if it has none."""
    return actions.withColumns(
        {
            kind: F.try_element_at(_weight_map(weights, kind), F.col("action"))
            for kind in ("time", "typing")
        }
    )


# -- reports ----------------------------------------------------------------------------------


def _scope(counters: DataFrame, date: str | None = None, ip: str | None = None) -> DataFrame:
    if date is not None:
        counters = counters.filter(F.col("date") == date)
    if ip is not None:
        counters = counters.filter(F.col("ip") == ip)
    return counters


def _totals() -> list[Column]:
    return [
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("visit_cnt"),
        F.count(F.lit(1)).alias("active_cnt"),
    ]


def usage_totals(
    visits: DataFrame, date: str, ip: str | None = None, my_ip: str | None = None
) -> DataFrame:
    """One row: visits and distinct clients of a month, of one client or of all."""
    myip = F.lit(my_ip if my_ip is not None else ip).cast("string").alias("myip")
    return _scope(visits, date, ip).agg(*_totals()).select(myip, "visit_cnt", "active_cnt")


def usage_totals_by(visits: DataFrame, *keys: str) -> DataFrame:
    """The same totals for all months (`date`), or all months and clients (`date`, `ip`)."""
    return visits.groupBy(*(keys or ("date",))).agg(*_totals())


def _counts_per_action() -> list[Column]:
    return [
        F.coalesce(F.sum(F.when(F.col("action") == action, F.col("cnt"))), F.lit(0)).alias(action)
        for action in SAVING_ACTIONS
    ]


def _weight_action(kind: str, action: str, swapped_otp: bool) -> str:
    return "prop" if swapped_otp and kind == "typing" and action == "otp" else action


def _weighted(weights: DataFrame, kind: str, swapped_otp: bool = False) -> dict[str, Column]:
    by_action = _weight_map(weights, kind)
    return {
        action: F.col(action)
        * F.try_element_at(by_action, F.lit(_weight_action(kind, action, swapped_otp)))
        for action in SAVING_ACTIONS
    }


def savings_wide(
    actions: DataFrame,
    weights: DataFrame,
    date: str,
    ip: str | None = None,
    compat: bool = False,
) -> DataFrame:
    """One row: time_cnt_<action> and typing_cnt_<action> of a month; NULL without a weight.

    `compat` weights the typing of `otp` like `prop` in the report of one client.
    """
    swapped = compat and ip is not None
    counts = _scope(actions, date, ip).agg(*_counts_per_action())
    return counts.select(
        *[c.alias(f"time_cnt_{a}") for a, c in _weighted(weights, "time").items()],
        *[c.alias(f"typing_cnt_{a}") for a, c in _weighted(weights, "typing", swapped).items()],
    )


def savings_by_action(
    actions: DataFrame,
    weights: DataFrame,
    date: str,
    ip: str | None = None,
    compat: bool = False,
) -> DataFrame:
    """The same as one row per action: action, time_cnt, typing_cnt."""
    wide = savings_wide(actions, weights, date, ip, compat)
    rows = [
        F.struct(
            F.lit(a).alias("action"),
            F.col(f"time_cnt_{a}").alias("time_cnt"),
            F.col(f"typing_cnt_{a}").alias("typing_cnt"),
        )
        for a in SAVING_ACTIONS
    ]
    return wide.select(F.inline(F.array(*rows)))


def savings_by_month(
    actions: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("date",)
) -> DataFrame:
    """Weighted sums per month (and client); NULL as soon as one weight is missing."""
    counts = actions.groupBy(*keys).agg(*_counts_per_action())
    columns = []
    for kind in ("time", "typing"):
        total = None
        for part in _weighted(weights, kind).values():
            total = part if total is None else total + part
        columns.append(total.alias(f"{kind}_cnt"))
    return counts.select(*keys, *columns)


def latest_months(df: DataFrame, n: int = TREND_MONTHS, by: tuple[str, ...] = ("ip",)) -> DataFrame:
    """The latest n months of each client. Rows per client are its months, so few."""
    newest = Window.partitionBy(*by).orderBy(F.desc("date"))
    return df.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).drop("_n")


def savings_trend_rows(
    actions: DataFrame,
    weights: DataFrame,
    date: str,
    ip: str | None = None,
    n: int = TREND_MONTHS,
) -> DataFrame:
    """The latest n months with data up to `date`, oldest first, one row each."""
    until = _scope(actions, ip=ip).filter(F.col("date") <= date)
    months = savings_by_month(until, weights).orderBy(F.desc("date")).limit(n)
    return months.orderBy("date").select(
        month_key_label(F.col("date")).alias("date"), "time_cnt", "typing_cnt"
    )


def savings_trend(
    actions: DataFrame,
    weights: DataFrame,
    date: str,
    ip: str | None = None,
    n: int = TREND_MONTHS,
) -> DataFrame:
    """The trend as one row of three parallel arrays date, time, typing; NULL arrays if empty."""
    until = _scope(actions, ip=ip).filter(F.col("date") <= date)
    months = savings_by_month(until, weights).orderBy(F.desc("date")).limit(n)
    points = months.agg(
        F.array_sort(F.collect_list(F.struct("date", "time_cnt", "typing_cnt"))).alias("p")
    ).select(F.when(F.size("p") > 0, F.col("p")).alias("p"))
    return points.select(
        F.transform("p", lambda m: month_key_label(m["date"])).alias("date"),
        F.transform("p", lambda m: m["time_cnt"]).alias("time"),
        F.transform("p", lambda m: m["typing_cnt"]).alias("typing"),
    )


def savings_trend_all_clients(
    actions: DataFrame, weights: DataFrame, date: str, n: int = TREND_MONTHS
) -> DataFrame:
    """The trend of every client at once: ip, date label, time_cnt, typing_cnt."""
    until = actions.filter(F.col("date") <= date)
    months = latest_months(savings_by_month(until, weights, ("ip", "date")), n)
    return months.select(
        "ip", month_key_label(F.col("date")).alias("date"), "time_cnt", "typing_cnt"
    )


def top_urls(url_hits: DataFrame, date: str | None = None, ip: str | None = None) -> DataFrame:
    """All URLs of a month (of every month if none is given) ranked by hits: date, seq, url, cnt."""
    hits = _scope(url_hits, date, ip).groupBy("date", "url").agg(F.sum("cnt").alias("cnt"))
    return ranked_by_count(hits, ["date"], "cnt", "url", "seq").select("date", "seq", "url", "cnt")


def top_urls_all_clients(url_hits: DataFrame) -> DataFrame:
    """The ranking of every month and client at once. Counter rows are unique by key already."""
    ranked = ranked_by_count(url_hits, ["date", "ip"], "cnt", "url", "seq")
    return ranked.select("date", "ip", "seq", "url", "cnt")


def statistics(
    visits: DataFrame,
    actions: DataFrame,
    weights: DataFrame,
    date: str,
    my_ip: str,
    report_type: str = "private",
    compat: bool = False,
) -> DataFrame:
    """The usage report of a month as one row: totals, savings per action, six-month trend.

    `private` covers the client `my_ip`, any other type all clients. The URL ranking of the
    report has as many entries as there are URLs, so it is not packed into this row: take
    `top_urls(url_hits, date, ip)`, or `statistics_rows` for the whole report as rows.
    """
    ip = my_ip if report_type == "private" else None
    totals = usage_totals(visits, date, ip, my_ip)
    savings = savings_wide(actions, weights, date, ip, compat)
    trend = savings_trend(actions, weights, date, ip)
    trend_value = trend.select(F.struct("date", "time", "typing").alias("trend")).scalar()
    packed = savings.select(F.struct(*savings.columns).alias("s")).scalar()
    return (
        totals.withColumn("s", packed)
        .select("myip", "visit_cnt", "active_cnt", "s.*")
        .withColumn("trend", trend_value)
    )


def statistics_rows(
    visits: DataFrame,
    actions: DataFrame,
    url_hits: DataFrame,
    weights: DataFrame,
    date: str,
    my_ip: str,
    report_type: str = "private",
    compat: bool = False,
) -> DataFrame:
    """The whole usage report with its URL ranking as rows: section, seq, name, cnt, time, typing.

    Sections are `totals` (visit_cnt and active_cnt), `action`, `trend` (oldest month first) and
    `url`. Only the first three have a bounded number of rows; none is collected.
    """
    ip = my_ip if report_type == "private" else None
    none = F.lit(None).cast("long")

    def section(name, rows, seq, label, cnt=none, time=none, typing=none):
        return rows.select(
            F.lit(name).alias("section"),
            seq.cast("long").alias("seq"),
            label.alias("name"),
            cnt.cast("long").alias("cnt"),
            time.cast("long").alias("time"),
            typing.cast("long").alias("typing"),
        )

    totals = usage_totals(visits, date, ip, my_ip).select(
        F.posexplode(F.array("visit_cnt", "active_cnt")).alias("pos", "cnt")
    )
    total_name = F.when(F.col("pos") == 0, F.lit("visit_cnt")).otherwise(F.lit("active_cnt"))
    trend = savings_trend(actions, weights, date, ip).select(
        F.posexplode(F.arrays_zip("date", "time", "typing")).alias("pos", "m")
    )
    savings = savings_by_action(actions, weights, date, ip, compat)
    place = F.array_position(F.array(*[F.lit(a) for a in SAVING_ACTIONS]), F.col("action"))
    time, typing = F.col("time_cnt"), F.col("typing_cnt")
    next_pos = F.col("pos") + 1
    return (
        section("totals", totals, next_pos, total_name, F.col("cnt"))
        .unionByName(section("action", savings, place, F.col("action"), none, time, typing))
        .unionByName(
            section("trend", trend, next_pos, F.col("m.date"), none, F.col("m.time"), F.col("m.typing"))
        )
        .unionByName(
            section("url", top_urls(url_hits, date, ip), F.col("seq"), F.col("url"), F.col("cnt"))
        )
    )
