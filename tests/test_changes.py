import random
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracklight import schemas
from tracklight.operators import changes, links, memos

NOW = dt(2024, 5, 1, 9)
BATCH = (
    "seq long, issue_number string, issue_subject string, issue_status string, "
    "issue_assigned_to string, issue_created_on timestamp_ntz"
)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- issues -----------------------------------------------------------------------------------


def register(spark, frame, issues, numbers):
    batch = spark.createDataFrame(
        [(i, x, f"s{i}", "new", "kim", dt(2024, 1, 1)) for i, x in enumerate(numbers)], BATCH
    )
    issues = frame(schemas.ISSUES, issues)
    return changes.register_issues(issues, frame(schemas.WORKFLOW, []), batch, NOW)


def test_register(spark, frame, small_blocks):
    old = [
        {"issue_idx": 7, "issue_number": "A", "deletedate": dt(2024, 1, 1)},
        {"issue_idx": 5, "issue_number": "임시"},
    ]
    issues, flow = register(spark, frame, old, ["B", None, "A", "B", "", "C"])
    got = {r.issue_idx: r for r in issues.filter(F.col("createdate").isNotNull()).collect()}
    assert {i: (r.issue_number, r.issue_subject, r.issue_status) for i, r in got.items()} == {
        8: ("B", "s0", "new"),
        9: ("임시", "s1", None),
        10: ("임시", "s4", None),
        11: ("C", "s5", "new"),
    }
    assert issues.count() == 6
    assert sorted((r.issue_idx, r.progress_idx) for r in flow.collect()) == [
        (i, p) for i in range(8, 12) for p in range(1, 8)
    ]


def test_register_into_an_empty_table(spark, frame):
    issues, flow = register(spark, frame, [], ["A", "A", "B"])
    assert rows(issues.select("issue_idx", "issue_number")) == [(1, "A"), (2, "B")]
    assert flow.count() == 14
    assert changes.next_id(frame(schemas.ISSUES, []), "issue_idx").first().next_id == 1


def test_update_issues(spark, frame):
    issues = frame(
        schemas.ISSUES,
        [{"issue_idx": i, "issue_tag": "t", "memo": "m", "is_updated": True} for i in (1, 2, 3)],
    )
    batch = spark.createDataFrame(
        [
            (1, 0, "a", None, True, False),
            (1, 1, None, "n", None, True),  # no flag: back to false; NULL tag keeps "a"
            (2, 2, "", None, True, False),
            (9, 3, "x", None, True, False),
        ],
        "issue_idx long, seq long, issue_tag string, memo string, is_updated boolean, "
        "is_syncdate_update boolean",
    )
    after = changes.update_issues(issues, batch, NOW)
    assert after.schema.names == issues.schema.names
    assert rows(after.select("issue_idx", "issue_tag", "memo", "is_updated", "syncdate", "updatedate")) == [
        (1, "a", "n", False, NOW, NOW),
        (2, "", "m", True, None, NOW),
        (3, "t", "m", True, None, None),
    ]


def test_update_workflow(spark, frame):
    flow = frame(
        schemas.WORKFLOW,
        [{"issue_idx": 1, "progress_idx": p, "status_idx": 1, "startdate": NOW} for p in (1, 2)],
    )
    issues = frame(schemas.ISSUES, [{"issue_idx": i, "is_updated": True} for i in (1, 2, 3)])
    batch = spark.createDataFrame(
        [
            (1, 1, 0, "status_idx", "3"),
            (1, 1, 1, "startdate", "2024-01-02"),
            (1, 1, 2, "startdate", "null"),
            (1, 2, 3, "completedate", "2024-01-03 10:00:00"),
            (2, 5, 4, "status_idx", "2"),  # no such stage: the issue is stamped all the same
        ],
        "issue_idx long, progress_idx int, seq long, field string, value string",
    )
    stages, stamped = changes.update_workflow(flow, issues, batch, NOW)
    assert rows(stages) == [(1, 1, 3, None, None), (1, 2, 1, NOW, dt(2024, 1, 3, 10))]
    assert rows(stamped.select("issue_idx", "is_updated", "updatedate")) == [
        (1, False, NOW), (2, False, NOW), (3, True, None),
    ]


def test_soft_delete(spark, frame):
    issues = frame(schemas.ISSUES, [{"issue_idx": 1, "deletedate": dt(2020, 1, 1)}, {"issue_idx": 2}])
    gone = spark.createDataFrame([(1,), (1,), (5,)], "issue_idx long")
    after = changes.soft_delete(issues, gone, NOW)
    assert rows(after.select("issue_idx", "deletedate")) == [(1, NOW), (2, None)]


def test_categories_and_filters(spark, frame):
    categories = frame(schemas.CATEGORIES, [{"category_idx": 4, "category_name": "x"}])
    batch = spark.createDataFrame([(0, "a"), (1, "b")], "seq long, category_name string")
    more = changes.add_category(categories, batch)
    assert rows(more) == [(4, "x"), (5, "a"), (6, "b")]
    renames = spark.createDataFrame(
        [(5, 0, "c"), (5, 1, "d"), (9, 2, "e")], "category_idx int, seq long, category_name string"
    )
    assert rows(changes.rename_category(more, renames)) == [(4, "x"), (5, "d"), (6, "b")]
    new = spark.createDataFrame([(0, "f", "{}")], "seq long, filter_name string, filter_content string")
    saved = changes.add_filter(frame(schemas.SAVED_FILTERS, []), new)
    assert rows(saved) == [(1, "f", "{}", "0")]
    chosen = changes.set_default_filter(saved, 1)
    assert rows(chosen)[0][3] == "1"
    assert rows(changes.set_default_filter(chosen, 99))[0][3] == "0"
    assert changes.delete_filter(saved, saved.union(saved)).count() == 0


def test_row_numbers_over_groups_of_blocks(spark, small_blocks):
    from tracklight.plans.scans import row_numbers

    positions = [k * k for k in range(200)]  # with gaps
    df = spark.createDataFrame([(p,) for p in positions], "seq long")
    numbered = row_numbers(df, "seq", "n").orderBy("seq").collect()
    assert [tuple(r) for r in numbered] == [(p, k + 1) for k, p in enumerate(positions)]


# -- links ------------------------------------------------------------------------------------

LINK_CHANGES = "seq long, kind string, url string, category string, description string, linkimage string"
MARKERS = ("loginPortalForm.sms", "DLPCenterEDR", "DLPCenter", "/cm")


def key_of(url):
    for marker in MARKERS:
        if marker in url:
            return url.split(marker)[0] + marker
    return url


def is_duplicate(url, present):
    key = key_of(url)
    return any(
        key_of(u) == key if MARKERS[0] in u else u.startswith(key) for u in present
    )


def replay_links(stored, batch):
    """The changes one by one, as a list in file order."""
    file, refused = [dict(x) for x in stored], []
    for change in batch:
        at = next((i for i, x in enumerate(file) if x["url"] == change["url"]), None)
        record = {k: change[k] for k in ("url", "category")}
        if change["kind"] == "add":
            if is_duplicate(change["url"], [x["url"] for x in file]):
                refused.append((change["seq"], "url duplicated"))
            else:
                file.append(record)
        elif at is None:
            refused.append((change["seq"], f"no data to {'delete' if change['kind'] == 'delete' else 'change'}"))
        elif change["kind"] == "edit":
            file[at] = record
        else:
            del file[at]
    return [(x["url"], x["category"]) for x in file], sorted(refused)


def run_links(spark, frame, stored, batch):
    table = frame(schemas.LINKS, [x | {"pos": i} for i, x in enumerate(stored)])
    rows_ = [(c["seq"], c["kind"], c["url"], c["category"], None, None) for c in batch]
    after, refused = links.apply_link_changes(table, spark.createDataFrame(rows_, LINK_CHANGES))
    return (
        [(r.url, r.category) for r in after.orderBy("pos").collect()],
        sorted((r.seq, r.reason) for r in refused.collect()),
    )


def change(seq, kind, url):
    return {"seq": seq, "kind": kind, "url": url, "category": f"c{seq}"}


def test_duplicates(spark, frame):
    stored = ["http://a/cm/1", "http://b/x/y", "http://c/loginPortalForm.sms?u=1", "http://d/DLPCenterEDR"]
    wanted = {
        "http://a/cm/2": True,
        "http://a/cmd": True,
        "http://a/cm/DLPCenter": False,
        "http://b/x": True,  # shorter after longer
        "http://b/x/y/z": False,  # longer after shorter
        "http://c/loginPortalForm.sms": True,
        "http://c/": False,  # login links are compared by their own key
        "http://d/DLPCenter/z": True,
        "http://d/DLPCenterEDR/z": True,
        "http": True,
    }
    table = frame(schemas.LINKS, [{"url": u} for u in stored])
    asked = frame(schemas.LINKS, [{"url": u} for u in wanted])
    found = {r.url for r in links.duplicate_links(asked, table).collect()}
    assert found == {u for u, yes in wanted.items() if yes}
    assert all(is_duplicate(u, stored) == yes for u, yes in wanted.items())
    assert {r.url for r in links.acceptable_links(asked, table).collect()} == set(wanted) - found


def test_link_changes_in_one_batch(spark, frame):
    stored = [{"url": "http://a/cm/1", "category": "old"}, {"url": "http://b", "category": "old"}]
    batch = [
        change(0, "add", "http://a/cm/2"),  # refused: same system as the stored one
        change(1, "delete", "http://a/cm/1"),
        change(2, "add", "http://a/cm/3"),
        change(3, "edit", "http://a/cm/3"),
        change(4, "add", "http://a/cm/4"),  # refused
        change(5, "delete", "http://a/cm/3"),
        change(6, "edit", "http://a/cm/3"),  # refused: gone
        change(7, "add", "http://a/cm/4"),
        change(8, "edit", "http://b"),
        change(9, "delete", "http://zzz"),  # refused
    ]
    want = replay_links(stored, batch)
    assert want[0] == [("http://b", "c8"), ("http://a/cm/4", "c7")]
    assert run_links(spark, frame, stored, batch) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_link_changes_against_replay(spark, frame, small_blocks, seed):
    random.seed(seed)
    tails = ["", "/cm", "/cm/1", "/cm/DLPCenter", "/DLPCenterEDR/x", "/DLPCenter/y", "/q", "/q/r",
             "/loginPortalForm.sms?u=1", "/loginPortalForm.sms?u=2"]
    urls = [f"http://h{h}.x{t}" for h in range(12) for t in tails]
    stored = [{"url": u, "category": "old"} for u in random.sample(urls, 15)]
    kinds = ["add"] * 5 + ["delete"] * 3 + ["edit"]
    batch = [change(i, random.choice(kinds), random.choice(urls)) for i in range(400)]
    assert run_links(spark, frame, stored, batch) == replay_links(stored, batch)


def chain(n):
    """Adds of one key, refused and accepted in turn: each answer depends on the one before."""
    kinds = ("add", "add", "delete")
    urls = [f"http://a/cm/{k}" for k in range(3)]
    batch, present = [], None
    for i in range(n):
        kind = kinds[i % 3]
        url = present if kind == "delete" else urls[(i // 3 + i) % 3]
        if kind == "add" and present is None:
            present = url
        if kind == "delete":
            present = None
        batch.append(change(i, kind, url))
    return batch


def test_link_changes_of_one_key(spark, frame):
    batch = chain(600)
    assert run_links(spark, frame, [], batch) == replay_links([], batch)


def test_rounds_of_link_changes_grow_with_the_logarithm(spark, frame, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    made, real = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda df, *a: made.append(1) or real(df, *a))
    batch = chain(30_000)
    after, refused = run_links(spark, frame, [], batch)
    assert len(made) <= 2 * 15 + 10
    assert len(after) == 0 and refused == [(i, "url duplicated") for i in range(1, 30_000, 3)]


def test_changes_without_a_url(spark, frame):
    batch = [change(0, "add", "http://a"), change(1, "add", "http://a/b"), change(2, "add", "http://a")]
    want = replay_links([], batch)
    after, refused = run_links(spark, frame, [], batch + [change(3, "edit", None)])
    assert after == want[0] and refused[:2] == want[1]


def test_links_without_changes(spark, frame):
    stored = [{"url": "http://b", "category": "old"}]
    assert run_links(spark, frame, stored, []) == replay_links(stored, [])


# -- memos ------------------------------------------------------------------------------------

MEMO_CHANGES = (
    "seq long, kind string, key string, title string, contents string, datetime timestamp_ntz, "
    "autoDelete boolean"
)


def replay_memos(stored, batch):
    file, refused = list(stored), []
    for seq, kind, key in batch:
        at = next((i for i, x in enumerate(file) if x[0] == key), None)
        if kind == "add":
            file.append((key, f"c{seq}"))
        elif at is None:
            refused.append(seq)
        elif kind == "edit":
            file[at] = (key, f"c{seq}")
        else:
            del file[at]
    return file, refused


@pytest.mark.parametrize("seed, keys", [(1, "abcdefgh"), (2, "aaaaaab")])
def test_memo_changes_against_replay(spark, frame, small_blocks, seed, keys):
    random.seed(seed)
    stored = [(random.choice(keys), f"s{i}") for i in range(20)]
    kinds = ["add"] * 4 + ["delete"] * 5 + ["edit"] * 2
    batch = [(i, random.choice(kinds), random.choice(keys + "zy")) for i in range(200)]
    table = frame(
        schemas.MEMOS, [{"pos": i, "key": k, "title": t} for i, (k, t) in enumerate(stored)]
    )
    asked = spark.createDataFrame(
        [(i, kind, k, f"c{i}", None, None, None) for i, kind, k in batch], MEMO_CHANGES
    )
    after, refused = memos.apply_memo_changes(table, asked)
    got = [(r.key, r.title) for r in after.orderBy("pos").collect()]
    want = replay_memos(stored, batch)
    assert got == want[0]
    assert sorted(r.seq for r in refused.collect()) == want[1]
    used = memos.memo_usage(
        asked.withColumns({"ip": F.lit("a"), "ts": F.lit(NOW).cast("timestamp_ntz")}), refused
    )
    assert used.count() == sum(k != "delete" for s, k, _ in batch if s not in set(want[1]))


def test_change_kinds(spark):
    df = spark.createDataFrame(
        [(True, True), (True, None), (None, True), (None, None)], "e boolean, d boolean"
    )
    kinds = df.select(memos.change_kind(F.col("e"), F.col("d")).alias("k")).collect()
    assert [r.k for r in kinds] == ["delete", "edit", "delete", "add"]


def test_memo_expiry(frame):
    table = frame(
        schemas.MEMOS,
        [
            {"key": "exact", "datetime": dt(2024, 5, 1, 6), "autoDelete": True},
            {"key": "old", "datetime": dt(2024, 5, 1, 5, 59, 59), "autoDelete": True},
            {"key": "kept", "datetime": dt(2020, 1, 1), "autoDelete": False},
            {"key": "unset", "datetime": dt(2020, 1, 2)},
            {"key": "unreadable", "autoDelete": True},
            {"key": "unreadable, kept"},
        ],
    )
    assert [r.key for r in memos.memo_list(table, NOW).collect()] == [
        "exact", "unset", "kept", "unreadable, kept",
    ]
