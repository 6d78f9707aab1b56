"""Successors over ranges and the sweep over connections, against plain Python."""

import random
from datetime import datetime as dt
from datetime import timedelta

import pytest

from tracklight import schemas
from tracklight.operators import links, notifications
from tracklight.plans.successors import with_next


@pytest.mark.parametrize("parts", [1, 7])
def test_next_string_over_ranges(spark, monkeypatch, parts):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rng = random.Random(parts)
        word = lambda: "".join(rng.choice("abé\U0001f514") for _ in range(rng.randint(0, 4)))
        for n_keys, n_others in ((40, 30), (40, 1), (5, 0), (0, 5)):
            keys, others = [word() for _ in range(n_keys)] + [None], [word() for _ in range(n_others)] + [None]
            frames = [spark.createDataFrame([(w,) for w in ws], f"{c} string") for ws, c in ((keys, "k"), (others, "o"))]
            got = {r.k: r.next for r in with_next(frames[0], "k", frames[1], "next").collect()}
            raw = sorted(o.encode() for o in others if o is not None)
            want = {k: next((o.decode() for o in raw if o >= k.encode()), None) for k in keys if k is not None}
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_duplicates_of_short_and_login_keys(spark):
    markers = ["/loginPortalForm.sms?u=1", "/DLPCenterEDR/x", "/DLPCenter/y", "/cm/z", "/p", ""]
    rng = random.Random(3)
    url = lambda: f"http://h{rng.randint(1, 12)}{rng.choice(markers)}{rng.choice(['', 'q', '?a'])}"
    stored, asked = [url() for _ in range(12)], [url() for _ in range(60)] + [None]
    key = lambda u: next((u[: u.find(m) + len(m)] for m in ("loginPortalForm.sms", "DLPCenterEDR", "DLPCenter", "/cm") if m in u), u)
    taken = {
        u for u in asked if u
        if any(key(s) == key(u) if "loginPortalForm.sms" in s else s.startswith(key(u)) for s in stored)
    }
    candidates = spark.createDataFrame(list(enumerate(asked)), "pos long, url string")
    known = spark.createDataFrame([(u,) for u in stored], "url string")
    assert {r.url for r in links.duplicate_links(candidates, known).collect()} == taken
    assert {r.url for r in links.acceptable_links(candidates, known).collect()} == set(asked) - taken
    assert 0 < len(taken) < 50


def test_pushes_that_meet_nobody(spark):
    rng, start = random.Random(6), dt(2024, 1, 1)
    at = lambda: start + timedelta(minutes=rng.randint(0, 40), microseconds=rng.choice([0, 0, 1]))
    connections = [(i, rng.choice("abc"), at(), rng.choice([None, at(), at()])) for i in range(30)]
    pushes = [(i, rng.choice("abcd"), at()) for i in range(200)] + [(900, None, at()), (901, "a", None)]
    want = {
        p for p, ip, t in pushes
        if not any(ip == c and t and s <= t and (e is None or t < e) for _, c, s, e in connections)
    }
    frames = spark.createDataFrame(pushes, schemas.PUSHES), spark.createDataFrame(connections, schemas.CONNECTIONS)
    got = notifications.undeliverable(*frames)
    assert {r.push_id for r in got.collect()} == want and 2 < len(want) < 200
    assert got.columns == schemas.PUSHES.names
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "connection_id" not in plan and "LeftAnti" not in plan
    assert notifications.undeliverable(frames[0], frames[1].limit(0)).count() == len(pushes)
