import random
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracklight import schemas
from tracklight.operators import usage
from tracklight.plans import scans

WEIGHTS = [
    {"action": a, "time": t, "typing": k}
    for a, t, k in [("link", 3, 20), ("auth", 5, 30), ("prop", 2, 10), ("otp", 4, 6), ("memo", 6, 50)]
]


@pytest.fixture
def weights(frame):
    return frame(schemas.WEIGHTS, WEIGHTS)


def hits(date, ip, action, cnt):
    return {"date": date, "ip": ip, "action": action, "cnt": cnt}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_counters(frame):
    events = frame(
        schemas.USAGE_EVENTS,
        [
            {"ip": "a", "action": "link", "url": "u", "ts": dt(2024, 1, 31, 23, 59)},
            {"ip": "a", "action": "link", "url": "u", "ts": dt(2024, 2, 1)},
            {"ip": "a", "action": "memo", "url": "u", "ts": dt(2024, 2, 1)},
        ],
    )
    assert rows(usage.count_actions(events)) == [
        ("202401", "a", "link", 1), ("202402", "a", "link", 1), ("202402", "a", "memo", 1),
    ]
    assert rows(usage.count_url_hits(events)) == [("202401", "a", "u", 1), ("202402", "a", "u", 1)]
    assert rows(usage.count_visits(events)) == [("202401", "a", 1), ("202402", "a", 2)]
    a, b = usage.count_actions(events), usage.count_actions(events.filter("action = 'link'"))
    assert rows(usage.merge_counts(a, b)) == rows(usage.merge_counts(b, a))
    assert rows(usage.merge_counts(a, b))[0] == ("202401", "a", "link", 2)


def test_merge_rewrites_only_touched_months(spark, frame, tmp_path):
    from tracklight.sources import tables

    path = str(tmp_path / "actions")
    old = [hits(f"20240{m}", "a", "link", m) for m in (1, 2, 3)]
    tables.write_table(frame(schemas.ACTIONS, old), path, "date")
    stored = tables.read_table(spark, "actions", path)
    merged = usage.merge_touched(stored, frame(schemas.ACTIONS, [hits("202402", "a", "link", 5)]))
    assert rows(merged) == [("202402", "a", "link", 7)]
    tables.write_table(merged, path, "date")
    after = tables.read_table(spark, "actions", path).select("date", "ip", "action", "cnt")
    assert [r[3] for r in rows(after)] == [1, 7, 3]


def test_totals(frame):
    visits = frame(
        schemas.VISITS,
        [{"date": "202401", "ip": "a", "cnt": 3}, {"date": "202401", "ip": "b", "cnt": 4}],
    )
    assert rows(usage.usage_totals(visits, "202401", my_ip="z")) == [("z", 7, 2)]
    assert rows(usage.usage_totals(visits, "202401", "a")) == [("a", 3, 1)]
    assert rows(usage.usage_totals(visits, "202402", "a")) == [("a", 0, 0)]


def test_weights_of_the_config(spark):
    doc = """[{"statistics": [
      {"action": "link", "value": {"time": 1, "typing": 1}},
      {"action": "auth", "value": {"time": 5, "typing": 30}},
      {"action": "link", "value": {"time": 3}},
      {"action": "unknown", "value": {"time": 9, "typing": 9}}]}]"""
    config = spark.range(1).select(
        F.explode(F.from_json(F.lit(doc), f"array<{schemas.CONFIG.simpleString()}>")).alias("c")
    ).select("c.*")
    assert rows(usage.weights_from_config(config)) == [("auth", 5, 30), ("link", 3, None)]


def test_savings(frame, weights):
    actions = frame(
        schemas.ACTIONS,
        [hits("202401", "a", "otp", 2), hits("202401", "b", "link", 3), hits("202402", "a", "link", 1)],
    )
    by_action = lambda *a, **k: {
        r.action: (r.time_cnt, r.typing_cnt)
        for r in usage.savings_by_action(actions, *a, **k).collect()
    }
    assert by_action(weights, "202401") == {
        "auth": (0, 0), "link": (9, 60), "prop": (0, 0), "otp": (8, 12), "memo": (0, 0),
    }
    assert by_action(weights, "202401", "a")["otp"] == (8, 12)
    assert by_action(weights, "202401", "a", compat=True)["otp"] == (8, 20)  # weight of prop
    assert by_action(weights, "202401", compat=True)["otp"] == (8, 12)
    some = weights.filter("action <> 'link'")
    assert by_action(some, "202401")["link"] == (None, None)
    assert rows(usage.savings_trend_rows(actions, some, "202402")) == [
        ("2024년01월", None, None), ("2024년02월", None, None),
    ]


def test_trend_takes_months_with_data(frame, weights):
    months = ["202201", "202301", "202302", "202306", "202401", "202402", "202403", "202404"]
    actions = frame(schemas.ACTIONS, [hits(m, "a", "link", i) for i, m in enumerate(months)])
    row = usage.savings_trend(actions, weights, "202403").first()
    assert row.date == [
        "2023년01월", "2023년02월", "2023년06월", "2024년01월", "2024년02월", "2024년03월",
    ]
    assert row.time == [3, 6, 9, 12, 15, 18]
    empty = usage.savings_trend(actions, weights, "202403", "nobody").first()
    assert (empty.date, empty.time, empty.typing) == (None, None, None)
    per_client = usage.savings_trend_all_clients(actions, weights, "202403")
    assert [r.time_cnt for r in per_client.orderBy("date").collect()] == row.time


def test_statistics(frame, weights):
    visits = frame(schemas.VISITS, [{"date": "202401", "ip": "a", "cnt": 3}])
    actions = frame(schemas.ACTIONS, [hits("202401", "a", "otp", 2), hits("202401", "b", "otp", 1)])
    run = lambda *a, **k: usage.statistics(visits, actions, weights, "202401", *a, **k).first()
    private, everyone = run("b", compat=True), run("b", "anything")
    assert (private.myip, private.visit_cnt, private.active_cnt) == ("b", 0, 0)
    assert (private.time_cnt_otp, private.typing_cnt_otp) == (4, 10)
    assert (everyone.myip, everyone.visit_cnt, everyone.typing_cnt_otp) == ("b", 3, 18)
    assert everyone.trend.date == ["2024년01월"] and everyone.trend.time == [12]


def test_url_ranking(spark, frame):
    random.seed(7)
    data = [
        {"date": d, "ip": ip, "url": f"u{n}", "cnt": random.choice([1, 1, 1, 2, 50])}
        for d in ("202401", "202402")
        for ip in ("a", "b")
        for n in range(40)
    ]
    url_hits = frame(schemas.URL_HITS, data)
    ranked = usage.top_urls(url_hits).collect()
    for month in ("202401", "202402"):
        month_rows = sorted((r for r in ranked if r.date == month), key=lambda r: r.seq)
        assert [r.seq for r in month_rows] == list(range(1, 41))
        counts = [r.cnt for r in month_rows]
        assert counts == sorted(counts, reverse=True)
    one = usage.top_urls(url_hits, "202401", "a").collect()
    assert len(one) == 40 and {r.seq for r in one} == set(range(1, 41))
    assert len(usage.top_urls_all_clients(url_hits).collect()) == 160


def test_running_values(spark, small_blocks):
    random.seed(3)
    data = [(random.choice("aaab"), n, random.randint(-5, 5)) for n in range(60)]
    df = spark.createDataFrame(data, "k string, seq long, x long")
    out = scans.running(
        df, ["k"], "seq", {"s": ("sum", F.col("x")), "low": ("min", F.col("x")), "top": ("max", F.col("x"))}
    )
    seen = {}
    want = []
    for k, seq, x in data:
        before = seen.setdefault(k, [])
        want.append((k, seq, x, sum(before), min(before, default=None), max(before, default=None)))
        before.append(x)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    numbered = scans.row_numbers(df.filter("x > 0"), "seq", "n").orderBy("seq").collect()
    assert [r.n for r in numbered] == list(range(1, len(numbered) + 1))


def exchanges(df):
    """The hash partitionings of the executed plan, without expression ids."""
    import re

    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    found = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)
    return [re.sub(r"#\d+L?", "", keys) for keys in found], plan


def without_broadcasts(spark, run):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_of_a_hot_key_are_shuffled_by_bucket(spark, frame):
    url_hits = frame(
        schemas.URL_HITS, [{"date": "202401", "ip": "a", "url": f"u{n}", "cnt": 1} for n in range(50)]
    )
    keys, _ = without_broadcasts(spark, lambda: exchanges(usage.top_urls(url_hits)))
    assert "date, cnt, _bucket" in keys
    # By the month alone only the distinct counts are shuffled.
    assert keys.count("date") == 1


def test_rows_of_a_hot_key_are_shuffled_by_block(spark):
    df = spark.createDataFrame([("hot", n) for n in range(50)], "k string, seq long")
    out = scans.running(df, ["k"], "seq", {"n": ("sum", F.lit(1))})
    keys, _ = without_broadcasts(spark, lambda: exchanges(out))
    assert keys.count("k, _block") >= 2 and keys.count("k") == 1
    # Also if the rows come partitioned by the key alone.
    again = scans.running(df.repartition(4, "k"), ["k"], "seq", {"n": ("sum", F.lit(1))})
    keys, _ = without_broadcasts(spark, lambda: exchanges(again))
    assert keys.count("k, _block") >= 2
