import random
from datetime import datetime as dt
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tracklight import schemas
from tracklight.operators import notifications, usage
from tracklight.operators.memos import expire_memos
from tracklight.registry import queries
from tracklight.registry import views as v
from tracklight.sources.tables import read_usage_stream
from tracklight.streaming import jobs, runs
from tracklight.streaming.runs import RunLog


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def feed(spark, tmp_path):
    """Write each list of rows as one file; a stream reads one file per batch, in order."""

    def make(schema, *batches):
        path = tmp_path / "feed"
        for i, batch in enumerate(batches):
            part = str(path / f"part={i}")
            spark.createDataFrame(batch, schema).coalesce(1).write.parquet(part)
        wide = read_usage_stream(spark, f"{path}/*", schema=schema, max_files=1)
        return wide, spark.createDataFrame([r for b in batches for r in b], schema)

    return make


def run(query):
    query.awaitTermination()


def test_usage_counts_over_batches(spark, feed, tmp_path):
    random.seed(5)
    start = dt(2024, 1, 30)
    batches = [
        [
            (f"ip{random.randint(0, 3)}", random.choice(["link", "memo"]), f"u{random.randint(0, 2)}",
             start + timedelta(hours=10 * b + random.randint(0, 9)))
            for _ in range(40)
        ]
        for b in range(5)
    ]
    stream, events = feed(schemas.USAGE_EVENTS, *batches)
    path = str(tmp_path / "job")
    run(jobs.stream_usage_counts(stream, path, available_now=True))
    got = jobs.usage_counts(spark, path)
    actions = got.groupBy("date", "ip", "action").agg(F.sum("cnt").alias("cnt"))
    assert rows(actions) == rows(usage.count_actions(events))
    urls = got.filter("action = 'link'").select("date", "ip", "url", "cnt")
    assert rows(urls) == rows(usage.count_url_hits(events))
    jobs.compact_usage(spark, path)
    assert rows(jobs.usage_counts(spark, path)) == rows(got)
    # A second run finds nothing new and changes nothing.
    run(jobs.stream_usage_counts(stream, path, available_now=True))
    assert rows(jobs.usage_counts(spark, path)) == rows(got)


def test_counts_after_a_compaction(spark, feed, tmp_path):
    event = lambda day, url: ("a", "link", url, dt(2024, 1, day, 5))
    first, second = [event(1, "u"), event(1, "u"), event(2, "x")], [event(1, "u"), event(3, "y")]
    stream, events = feed(schemas.USAGE_EVENTS, first)
    path = str(tmp_path / "job")
    run(jobs.stream_usage_counts(stream, path, available_now=True))
    jobs.compact_usage(spark, path)
    more = spark.createDataFrame(second, schemas.USAGE_EVENTS)
    more.coalesce(1).write.parquet(str(tmp_path / "feed" / "part=1"))
    run(jobs.stream_usage_counts(stream, path, available_now=True))
    want = usage.count_url_hits(events.unionByName(more))
    for _ in range(2):
        got = jobs.usage_counts(spark, path).select("date", "ip", "url", "cnt")
        assert rows(got) == rows(want)
        jobs.compact_usage(spark, path)


def test_delivery_over_batches_is_the_batch_result(spark, feed, tmp_path):
    random.seed(9)
    batches, opened, when, push = [], {}, dt(2024, 1, 1), 0
    for _ in range(4):
        batch = []
        for _ in range(40):
            when += timedelta(seconds=random.randint(0, 90))
            roll = random.random()
            if roll < 0.4:
                opened[len(opened)] = ip = random.choice("aab")
                batch.append(("connect", ip, len(opened) - 1, None, when))
            elif roll < 0.65:
                batch.append(("close", None, random.randint(0, len(opened) + 3), None, when))
            else:
                push += 1
                batch.append(("push", random.choice("aabc"), None, push, when))
        batches.append(batch)
    stream, events = feed(jobs.SERVICE_EVENTS, *batches)
    connections = jobs.connection_intervals(events)
    pushes = events.filter("kind = 'push'").select(
        "push_id", F.col("ip").alias("target_ip"), F.col("ts").alias("sent_at")
    )
    path = str(tmp_path / "job")
    run(jobs.stream_delivery(stream, path, available_now=True))
    pick = ("push_id", "connection_id")
    want = notifications.deliverable(pushes, connections)
    assert want.count() > 20
    assert rows(jobs.delivered(spark, path).select(*pick)) == rows(want.select(*pick))
    missed = notifications.undeliverable(pushes, connections).select("push_id")
    assert rows(jobs.failed(spark, path).select("push_id")) == rows(missed)
    still = connections.filter("closed_at IS NULL")
    assert rows(jobs.open_connections(spark, path).select("id", "ip")) == rows(still.select("id", "ip"))
    assert jobs.last_batch(spark, path) == 3


def test_connections_of_all_closed(spark, feed, tmp_path):
    at = dt(2024, 1, 1)
    stream, _ = feed(
        jobs.SERVICE_EVENTS,
        [("connect", "a", 1, None, at), ("connect", "a", 2, None, at), ("close", None, 9, None, at)],
        [("close", None, 1, None, at + timedelta(hours=1))],
        [("close", None, 2, None, at + timedelta(hours=2))],
    )
    path = str(tmp_path / "job")
    run(jobs.stream_connections(stream, path, available_now=True))
    assert rows(jobs.connected_clients(spark, path)) == []
    assert jobs.last_batch(spark, path) == 2
    assert jobs.last_batch(spark, str(tmp_path / "none")) == -1


def test_memo_expiry_over_batches(spark, feed, tmp_path):
    memo = lambda pos, hour, auto: (pos, f"k{pos}", "t", "c", dt(2024, 1, 1, hour), auto)
    stream, _ = feed(
        schemas.MEMOS, [memo(0, 0, True), memo(1, 0, None)], [memo(2, 2, True)], [memo(3, 5, True)]
    )
    path = str(tmp_path / "job")
    clock = lambda batch: dt(2024, 1, 1, 2 * batch + 1)
    run(jobs.stream_memo_expiry(stream, path, clock, available_now=True))
    assert [r[0] for r in rows(jobs.live_memos(spark, path))] == [1, 2, 3]


def test_given_events_as_feed(spark):
    events = v.table(spark, "/root/testdata/sf0.001", "events")
    assert v.usage_feed(events).count() == v.service_events(events).count() == 1000


def test_late_events_count(spark, feed, tmp_path):
    days = [10, 20, 11, 12]
    stream, _ = feed(schemas.USAGE_EVENTS, *[[("a", "memo", None, dt(2024, 1, d, 5))] for d in days])
    path = str(tmp_path / "job")
    run(jobs.stream_usage_counts(stream, path, available_now=True))
    assert [r.cnt for r in jobs.usage_counts(spark, path).collect()] == [4]


def test_a_late_push_meets_a_closed_connection(spark, feed, tmp_path):
    event = lambda **x: tuple(x.get(f) for f in jobs.SERVICE_EVENTS.names)
    first = [
        event(kind=jobs.CONNECT, ip="a", connection_id=1, ts=dt(2024, 1, 1, 1)),
        event(kind=jobs.CLOSE, ip="a", connection_id=1, ts=dt(2024, 1, 1, 3)),
    ]
    second = [event(kind=jobs.PUSH, ip="a", push_id=7, ts=dt(2024, 1, 1, 2))]
    stream, _ = feed(jobs.SERVICE_EVENTS, first, second)
    path = str(tmp_path / "job")
    run(jobs.stream_delivery(stream, path, available_now=True))
    assert [r.push_id for r in jobs.delivered(spark, path).collect()] == [7]
    assert jobs.failed(spark, path).isEmpty() and jobs.open_connections(spark, path).isEmpty()


def test_a_missing_run_is_an_error(spark, tmp_path):
    log = RunLog(spark, str(tmp_path), "t", schemas.PUSHES)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        log.read(3).count()
    assert log.read(-1).count() == 0


def test_runs_hold_all_rows_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "TOP", 2)
    schema = schemas.PUSHES
    log = RunLog(spark, str(tmp_path), "t", schema)
    for batch in range(11):
        for _ in range(2 if batch in (0, 3) else 1):  # a batch may be repeated
            log.write(spark.createDataFrame([(batch, "a", dt(2024, 1, 1))], schema), batch)
        if batch in (1, 2, 7, 10):
            assert sorted(r.push_id for r in log.read(batch).collect()) == list(range(batch + 1))
    assert runs._ends(11) == [(2, 3), (2, 7), (1, 9), (0, 10)]
    assert log.tidy(10) > 0 and log.tidy(10) == 0
    assert sorted(r.push_id for r in log.read(10).collect()) == list(range(11))
    log.write(spark.createDataFrame([(10, "a", dt(2024, 1, 1))], schema), 10)  # still repeatable
    log.write(spark.createDataFrame([(11, "a", dt(2024, 1, 1))], schema), 11)
    assert log.read(11).count() == 12


def service_feed(seed, n, clients="aabc"):
    """Connects, closes and pushes, with repeated ids, closes before connects and unknown ones."""
    rng, at, out = random.Random(seed), dt(2024, 1, 1), []
    for push in range(n):
        at += timedelta(seconds=rng.randint(0, 90))
        roll = rng.random()
        if roll < 0.35:
            out.append(("connect", rng.choice(clients), rng.randint(0, n // 3), None, at))
        elif roll < 0.6:
            out.append(("close", None, rng.randint(0, n // 3 + 2), None, at))
        else:
            out.append(("push", rng.choice(clients), None, push, at))
    return out


@pytest.mark.parametrize("seed,cuts", [(2, 3), (3, 4)])
def test_any_order_of_the_feed_gives_the_batch_result(spark, feed, tmp_path, seed, cuts):
    events = service_feed(seed, 160)
    random.Random(seed).shuffle(events)
    stream, whole = feed(jobs.SERVICE_EVENTS, *[events[i::cuts] for i in range(cuts)])
    connections = jobs.connection_intervals(whole)
    pushes = whole.filter("kind = 'push'").select(
        "push_id", F.col("ip").alias("target_ip"), F.col("ts").alias("sent_at")
    )
    path, other = str(tmp_path / "job"), str(tmp_path / "other")
    run(jobs.stream_delivery(stream, path, available_now=True))
    assert jobs.last_batch(spark, path) == cuts - 1
    want = rows(notifications.deliverable(pushes, connections))
    assert len(want) > 20 and rows(jobs.delivered(spark, path)) == want
    assert rows(jobs.failed(spark, path)) == rows(notifications.undeliverable(pushes, connections))
    still = rows(connections.filter("closed_at IS NULL").select("id", "ip", "connected_at"))
    assert rows(jobs.open_connections(spark, path)) == still
    run(jobs.stream_connections(stream, other, available_now=True))
    assert rows(jobs.open_connections(spark, other)) == still
    jobs.tidy(spark, path)
    assert rows(jobs.delivered(spark, path)) == want and rows(jobs.open_connections(spark, path)) == still


def test_a_batch_writes_its_own_connections(spark, feed, tmp_path):
    at = dt(2024, 1, 1)
    first = [("connect", "a", i, None, at) for i in range(500)]
    later = [[("close", None, i, None, at + timedelta(hours=i))] for i in range(1, 3)]
    stream, _ = feed(jobs.SERVICE_EVENTS, first, [("connect", "b", 900, None, at)], *later)
    path = str(tmp_path / "job")
    run(jobs.stream_connections(stream, path, available_now=True))
    written = spark.read.parquet(f"{path}/connections/level=0/run=2")
    assert rows(written) == [(1, None, None, at + timedelta(hours=1))]
    assert {(r.ip, r.connections) for r in jobs.connected_clients(spark, path).collect()} == {("a", 498), ("b", 1)}


def test_what_a_late_close_takes_back(spark, feed, tmp_path):
    hour = lambda h: dt(2024, 1, 1, h)
    stream, _ = feed(
        jobs.SERVICE_EVENTS,
        [("connect", "a", 1, None, hour(1)), ("push", "a", None, 5, hour(4)), ("push", "a", None, 6, hour(2))],
        [("close", None, 1, None, hour(3))],
        [("connect", "a", 2, None, hour(0))],
    )
    path = str(tmp_path / "job")
    run(jobs.stream_delivery(stream, path, available_now=True))
    got = {(r.push_id, r.connection_id) for r in jobs.delivered(spark, path).collect()}
    assert got == {(5, 2), (6, 1), (6, 2)}
    taken = spark.read.parquet(f"{path}/pairs/level=1/run=1")
    assert [(r.push_id, r.connection_id) for r in taken.collect()] == [(6, 1)]


def test_memos_that_expire_are_written_once(spark, feed, tmp_path):
    memo = lambda pos, hour, auto: (pos, f"k{pos}", "t", "c", hour and dt(2024, 1, 1, hour, 30), auto)
    stream, _ = feed(
        schemas.MEMOS, [memo(0, 1, True), memo(1, 1, None), memo(2, None, True), memo(3, None, False)],
        [memo(4, 2, True)], [memo(5, 1, True), memo(6, 6, True)], [memo(7, 1, False)],
    )
    path = str(tmp_path / "job")
    clock = lambda batch: dt(2024, 1, 1, (2, 5, 6, 4)[batch], 20)
    run(jobs.stream_memo_expiry(stream, path, clock, available_now=True))
    by_batch = [
        sorted(r.pos for r in spark.read.schema(schemas.MEMOS).parquet(f"{path}/expired/batch={b}").collect()) for b in range(4)
    ]
    assert by_batch == [[2], [0], [4, 5], []]
    assert [r[0] for r in rows(jobs.live_memos(spark, path))] == [1, 3, 6, 7]
    assert sorted(r.pos for r in jobs.expired_memos(spark, path).collect()) == [0, 2, 4, 5]
    assert jobs.live_memos(spark, str(tmp_path / "none")).isEmpty()


def test_memos_of_many_hours_are_few_files(spark, feed, tmp_path):
    """The files of a run follow its size, not the number of hours in which its memos expire."""
    start = dt(2024, 1, 1, 0)
    memos = [(i, f"k{i}", "t", "c", start + timedelta(hours=i), i % 4 > 0) for i in range(300)]
    stream, events = feed(schemas.MEMOS, memos[::2], memos[1::2])
    path, now = tmp_path / "job", start + timedelta(hours=100)
    run(jobs.stream_memo_expiry(stream, str(path), lambda _: now, available_now=True))
    live = expire_memos(events, now).select(*schemas.MEMOS.names)
    assert rows(jobs.live_memos(spark, str(path))) == rows(live)
    assert rows(jobs.expired_memos(spark, str(path))) == rows(events.select(*schemas.MEMOS.names).exceptAll(live))
    assert len(list((path / "memos").rglob("*.parquet"))) <= 2 * 8


def test_feeds_of_files_use_all_cores(spark, tmp_path):
    seen = []
    feed = queries._files(spark, "/root/testdata/sf0.001", "events", "event_id", 2).select(F.input_file_name().alias("file"))
    keep = lambda batch, _: seen.append((batch.distinct().count(), batch.count()))
    writer = feed.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "progress"))
    run(writer.trigger(availableNow=True).start())
    assert len(seen) == 2 and sum(n for _, n in seen) == 1000
    assert all(files == spark.sparkContext.defaultParallelism / 2 for files, _ in seen)
