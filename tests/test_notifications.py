import json
import random
from datetime import datetime as dt
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tracklight import schemas
from tracklight.functions import text
from tracklight.operators import notifications as n


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def value(spark, expression, x):
    df = spark.createDataFrame([(x,)], "x string")
    return df.select(expression(F.col("x")).alias("y")).first().y


def note(i, ip="a", **fields):
    return {"id": i, "target_ip": ip, "type": "hook", "title": f"t{i}", "message": "m", "is_read": False,
            "created_at": dt(2024, 1, 1)} | fields


@pytest.mark.parametrize(
    "expression, x, want",
    [
        (text.client_ip, "::ffff:10.0.0.1", "10.0.0.1"),
        (text.client_ip, "10.0.0.1", "10.0.0.1"),
        (text.client_ip, "10.0.0.1, 10.0.0.2", "10.0.0.1, 10.0.0.2"),
        (text.client_ip, "x::ffff:a::ffff:b", "a"),
        (text.mime_type, "a.b.JPeG", "image/jpeg"),
        (text.mime_type, "a.webp2", "image/webp"),
        (text.mime_type, "png", "image/png"),
        (text.mime_type, "a.txt", "application/octet-stream"),
        (text.mime_type, "a.", "application/octet-stream"),
        (text.summary, None, ""),
        (text.summary, "x" * 50, "x" * 50),
        (text.summary, "x" * 51, "x" * 50 + "..."),
        (text.summary, "🔔" * 51, "🔔" * 50 + "..."),
        (text.type_label, None, "DEFAULT"),
        (text.type_label, "", "DEFAULT"),
        (text.type_label, "mr", "MR"),
        (text.has_action, None, False),
        (text.has_action, "", False),
        (text.has_action, "null", False),
        (text.has_action, "undefined", False),
        (text.has_action, "/x", True),
        (text.link_key, "http://h/loginPortalForm.sms?u=1", "http://h/loginPortalForm.sms"),
        (text.link_key, "http://h/cm/DLPCenterEDR/x", "http://h/cm/DLPCenterEDR"),
        (text.link_key, "http://h/cm/DLPCenter/x", "http://h/cm/DLPCenter"),
        (text.link_key, "http://h/cmd/x", "http://h/cm"),
        (text.link_key, "http://h/x", "http://h/x"),
    ],
)
def test_text(spark, expression, x, want):
    assert value(spark, expression, x) == want


def test_read_labels(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "r boolean")
    out = df.select(text.read_label(F.col("r")), text.read_class(F.col("r"))).collect()
    assert [tuple(r) for r in out] == [("읽음", "read"), ("안읽음", "unread"), ("안읽음", "unread")]


def test_rendering(spark, frame):
    templates = spark.createDataFrame(
        [("default", "D {{title}}/{{message}}"), ("hook", "{{title}}{{title}} {{message}}")],
        "type string, template string",
    )
    notes = frame(
        schemas.NOTIFICATIONS,
        [
            note(1, title="$&", message=r"\1"),
            note(2, title="x{{message}}", message="m"),
            note(3, type="unknown", title=None),
        ],
    )
    bodies = {r.id: r.body for r in n.rendered(notes, templates).collect()}
    assert bodies == {1: r"$&{{title}} \1", 2: "xm{{title}} {{message}}", 3: "D null/m"}


def test_payload_leaves_out_missing_texts(spark):
    df = spark.createDataFrame([(7, None, "t", None, "a")], "i long, k string, t string, m string, ip string")
    out = df.select(text.push_payload(*[F.col(c) for c in ("i", "k", "t", "m", "ip")]).alias("p")).first().p
    assert json.loads(out) == {
        "id": 7, "type": "default", "title": "t", "url": "/push-popup?ip=a&newPushId=7",
    }


def test_storing(spark, frame, tmp_path, small_blocks):
    messages = spark.createDataFrame(
        [(i, "a", k, "t", "m", u) for i, (k, u) in enumerate([("", ""), (None, None), ("mr", "/x")] * 5)],
        "seq long, target_ip string, type string, title string, message string, action_url string",
    )
    path = str(tmp_path / "notes")
    n.append_notifications(messages, frame(schemas.NOTIFICATIONS, []), path, "2024-01-01")
    stored = spark.read.parquet(path)
    n.append_notifications(messages.limit(1), stored.select("*"), path + "2", "2024-01-02")
    got = rows(stored.select("id", "type", "action_url"))
    assert [r[0] for r in sorted(got)] == list(range(1, 16))
    assert sorted(got)[:3] == [(1, "default", None), (2, "default", None), (3, "mr", "/x")]
    assert spark.read.parquet(path + "2").first().id == 16


def test_inbox(frame):
    notes = frame(
        schemas.NOTIFICATIONS,
        [note(i, "a", created_at=dt(2024, 1, 1) + timedelta(minutes=i // 2)) for i in range(5)]
        + [note(9, "b")],
    )
    assert [r.id for r in n.inbox(notes, "a", 3).collect()] == [4, 3, 2]
    assert rows(n.inbox(notes, n=2).select("target_ip", "id")) == [("a", 3), ("a", 4), ("b", 9)]
    assert n.notification_by_id(notes, 9, "a").count() == 0
    assert n.notification_by_id(notes, 9, "b").count() == 1


def test_inbox_of_all_clients_limits_before_the_shuffle(frame):
    plan = n.inbox(frame(schemas.NOTIFICATIONS, [note(1)]))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_mark_read(spark, frame):
    notes = frame(schemas.NOTIFICATIONS, [note(1), note(2, "b"), note(3, is_read=True)])
    pairs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (8, "a")], "id long, ip string")
    after, answers = n.mark_read(notes, pairs)
    assert rows(after.select("id", "is_read")) == [(1, True), (2, False), (3, True)]
    assert rows(answers) == [(1, "a", True), (2, "a", False), (8, "a", False)]
    assert after.columns == notes.columns


def test_delivery_edges(spark, frame):
    at = lambda *a: dt(2024, 1, 1, *a)
    connections = frame(
        schemas.CONNECTIONS,
        [
            {"id": 1, "ip": "a", "connected_at": at(10, 0, 30), "closed_at": at(11, 0, 30)},
            {"id": 2, "ip": "a", "connected_at": at(10, 0, 30), "closed_at": None},
            {"id": 3, "ip": "b", "connected_at": at(10), "closed_at": at(10)},
        ],
    )
    pushes = frame(
        schemas.PUSHES,
        [
            {"push_id": 1, "target_ip": "a", "sent_at": at(10, 0, 29)},
            {"push_id": 2, "target_ip": "a", "sent_at": at(10, 0, 30)},  # as it connects
            {"push_id": 3, "target_ip": "a", "sent_at": at(11, 0, 30)},  # as it closes
            {"push_id": 4, "target_ip": "b", "sent_at": at(10)},
            {"push_id": 5, "target_ip": "c", "sent_at": at(10)},
        ],
    )
    pairs = n.deliverable(pushes, connections).select("push_id", "connection_id")
    assert rows(pairs) == [(2, 1), (2, 2), (3, 2)]
    assert rows(n.undeliverable(pushes, connections).select("push_id")) == [(1,), (4,), (5,)]
    assert n.deliverable(pushes.limit(0), connections).count() == 0
    assert n.undeliverable(pushes, connections.limit(0)).count() == 5


def test_delivery_against_all_pairs(spark, frame):
    random.seed(11)
    start = dt(2023, 12, 30)
    moment = lambda: start + timedelta(seconds=random.randint(0, 400_000))
    connections = []
    for i in range(300):
        opened = moment()
        closed = opened + timedelta(seconds=random.choice([0, 5, 60, 5000, 90_000]))
        connections.append({"id": i, "ip": random.choice("aaab"), "connected_at": opened,
                            "closed_at": random.choice([closed, closed, None])})
    pushes = [{"push_id": i, "target_ip": random.choice("aaabc"), "sent_at": moment()} for i in range(200)]
    want = {
        (p["push_id"], c["id"])
        for p in pushes
        for c in connections
        if c["ip"] == p["target_ip"] and c["connected_at"] <= p["sent_at"]
        and (c["closed_at"] is None or p["sent_at"] < c["closed_at"])
    }
    pushed, connected = frame(schemas.PUSHES, pushes), frame(schemas.CONNECTIONS, connections)
    got = [(r.push_id, r.connection_id) for r in n.deliverable(pushed, connected).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    missed = {r.push_id for r in n.undeliverable(pushed, connected).collect()}
    assert missed == {p["push_id"] for p in pushes} - {p for p, _ in want}


def test_unknown_types_need_a_default_template(spark):
    messages = spark.createDataFrame([("a",), ("b",)], "type string")
    templates = spark.createDataFrame([("a", "A"), ("default", "D")], "type string, template string")
    assert {(r.type, r.template) for r in n.with_template(messages, templates).collect()} == {("a", "A"), ("b", "D")}
    only = templates.filter("type = 'a'")
    assert [r.template for r in n.with_template(messages.filter("type = 'a'"), only).collect()] == ["A"]
    with pytest.raises(Exception, match="no template of type"):
        n.with_template(messages, only).collect()
