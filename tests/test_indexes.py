"""Page directory, trigram search, incremental reports, snapshots, sent pushes and distinct clients."""

import random
import re
from datetime import datetime as dt
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tracklight import schemas
from tracklight.operators import changes, deltas, filters, listing, notifications, paging, reports, search, usage
from tracklight.operators.filters import IssueFilter
from tracklight.registry import views as v
from tracklight.sources import tables
from tracklight.sources.snapshots import SnapshotConflict, Snapshots

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def staged(spark):
    return v.issues(spark, SMALL).cache(), v.workflow(spark, SMALL).cache()


@pytest.mark.parametrize(
    "order,field", [(None, None), ("ascend", "priority_idx"), ("descend", "priority_idx"), ("descend", "issue_tag"), ("ascend", "issue_created_on")]
)
def test_directory_pages_are_the_pages(spark, staged, order, field):
    columns = {"issue_idx", "createdate", "priority_idx", "issue_tag", "issue_created_on"}
    listed = listing.listed_issues(*staged, None, order, field).select(*columns)
    directory = paging.page_directory(listed, order, field, range_rows=100).cache()
    assert directory.count() > 5
    assert directory.agg(F.sum("n")).first()[0] == listed.count()
    whole = [r.issue_idx for r in listed.collect()]
    for page, size in ((1, 50), (7, 50), (3, 333), (29, 50), (2, 100_000), (500, 50)):
        got = paging.directory_page(listed, directory, order, field, page, size).collect()
        assert [r.issue_idx for r in got] == whole[(page - 1) * size : page * size]


def test_a_directory_page_reads_its_ranges_only(spark, staged, tmp_path):
    staged[0].write.parquet(str(tmp_path / "issues"))
    issues = spark.read.parquet(str(tmp_path / "issues"))
    directory = paging.page_directory(issues, "ascend", "issue_created_on", range_rows=100)
    page = paging.directory_page(issues, directory, "ascend", "issue_created_on", 20, 50)
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"issue_created_on#\d+ >= ", plan) and re.search(r"issue_created_on#\d+ <= ", plan)
    assert not re.search(r"[Oo]ffset[ =]950", plan)
    with pytest.raises(ValueError):
        paging.page_directory(issues, "none")
    assert paging.directory_page(issues.limit(0), directory.limit(0)).count() == 0


def test_trigram_search_is_the_scan(spark, staged, tmp_path):
    issues, rng = staged[0], random.Random(4)
    more = [{"issue_idx": 10**6 + i, "issue_subject": s, "issue_assigned_to": a, "issue_number": n} for i, (s, a, n) in enumerate([
        ("Ünïcode WORD", None, None), (None, "word-smith", "x_y%z"), ("a\\b%c_d", "", ""), ("İstanbul wORd", "ıİ", "ABC"), ("ab", "abc", "abC"),
    ])]
    extra = spark.createDataFrame([tuple(m.get(f.name) for f in schemas.ISSUES) for m in more], schemas.ISSUES)
    issues = issues.unionByName(extra).cache()
    path = str(tmp_path / "index")
    search.write_index(issues, path)
    texts = ["order 12", "URGENT", "urg", "o%r 1_2", "nothing like it", "ab", "word", "Word", "wor", "b%c", "\\%c", "r\\1", "ïcode w", "İst", "user3"]
    texts += ["".join(rng.choice("order 123%_") for _ in range(rng.randint(1, 6))) for _ in range(12)]
    for text in texts:
        want = filters.filter_issues(issues, IssueFilter(text=text)).select("issue_idx")
        assert rows(search.search_issues(issues, path, text).select("issue_idx")) == rows(want), text
    for number in ("77", "1003", "abC", "ABC", "x_y", "zzz"):
        want = filters.filter_issues(issues, IssueFilter(issue_number=number, text="o")).select("issue_idx")
        assert rows(search.search_issues(issues, path, "o", number).select("issue_idx")) == rows(want)


def test_a_search_reads_the_postings_asked_for(spark, staged, tmp_path):
    search.write_index(staged[0], str(tmp_path / "index"))
    plan = search.search_issues(staged[0], str(tmp_path / "index"), "order 77")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"trigram#\d+ IN |trigram#\d+ = ", plan)
    assert search.plain_trigrams("ab%cde_\\%fgh", True) == {"cde", "fgh"} and search.plain_trigrams("ABCD", True) == {"abc", "bcd"}


def test_reports_after_changes_are_those_made_anew(spark, staged):
    issues, workflow = staged
    moved = v.workflow_changes(spark, SMALL)
    after_workflow, after_issues = changes.update_workflow(workflow, issues, moved, v.AS_OF)
    edits = v.issue_changes(spark, SMALL)
    after_issues = changes.update_issues(after_issues, edits, v.AS_OF)
    gone = issues.filter("issue_idx % 5 = 0").select("issue_idx")
    after_issues = changes.soft_delete(after_issues, gone, v.AS_OF)
    touched = moved.select("issue_idx").union(edits.select("issue_idx")).union(gone)
    pick = lambda pair: tuple(deltas.touched_rows(t, touched) for t in pair)
    before, after = pick((issues, workflow)), pick((after_issues, after_workflow))
    for priorities in ([0, 2], [1], []):
        stored = reports.report_summary(issues, workflow, priorities)
        got = deltas.refresh_summary(stored, before, after, priorities)
        want = reports.report_summary(after_issues, after_workflow, priorities)
        assert rows(got.select(*want.columns)) == rows(want)
    tags = reports.tag_counts(issues).select("value", "count")
    assert rows(deltas.refresh_tags(tags, before[0], after[0])) == rows(reports.tag_counts(after_issues).select("value", "count"))
    by_stage = lambda i, w: filters.filter_issues(i.join(w, ["issue_idx", "progress_idx"])).groupBy("progress_idx").count()
    got = deltas.refresh_stages(by_stage(issues, workflow), before, after)
    assert rows(got) == rows(by_stage(after_issues, after_workflow))


def test_snapshots_are_published_whole_or_not(spark, tmp_path):
    schema = schemas.MEMOS
    at = dt(2024, 1, 1, 1, 2, 3, 456789)
    memo = lambda i: (i, f"k{i}", "t", None, at, None)
    for fmt in ("json", "parquet"):
        shelf = Snapshots(spark, str(tmp_path / fmt), schema, fmt)
        assert shelf.read().count() == 0 and shelf.versions() == []
        assert shelf.replace(spark.createDataFrame([memo(1)], schema)) == 1
        draft = shelf.write(spark.createDataFrame([memo(2)], schema))
        assert rows(shelf.read()) == [memo(1)]  # a writer that dies here changes nothing
        assert shelf.publish(draft, 2) == 2 and rows(shelf.read()) == [memo(2)] and rows(shelf.read(1)) == [memo(1)]
        late = shelf.write(spark.createDataFrame([memo(3)], schema))
        with pytest.raises(SnapshotConflict):
            shelf.publish(late, 2)
        with pytest.raises(SnapshotConflict):
            shelf.replace(shelf.read(), based_on=1)
        assert rows(shelf.read()) == [memo(2)]
        assert shelf.expire(1) == 3 and shelf.versions() == [2] and rows(shelf.read()) == [memo(2)]
    with pytest.raises(ValueError):
        Snapshots(spark, "x", schema, "csv")


def test_two_writers_of_a_version(spark, tmp_path):
    shelf = Snapshots(spark, str(tmp_path), schemas.MEMOS)
    names = [shelf.write(spark.createDataFrame([], schemas.MEMOS)) for _ in range(2)]
    shelf._markers = dict  # both have looked before either published
    shelf.publish(names[0], 1)
    with pytest.raises(SnapshotConflict):
        shelf.publish(names[1], 1)
    del shelf._markers
    assert shelf._markers() == {1: names[0]}


def test_sent_pushes_are_stored_once(spark, tmp_path):
    at, path = dt(2024, 1, 1), str(tmp_path / "notifications")
    kinds = "seq long, target_ip string, type string, title string, message string, action_url string, sent_at timestamp_ntz"
    connections = spark.createDataFrame(
        [(1, "a", at, None), (2, "a", at, at + timedelta(hours=2)), (3, "b", at, at + timedelta(hours=1))], schemas.CONNECTIONS
    )
    message = lambda seq, ip, hour: (seq, ip, "", f"t{seq}", None, "", at + timedelta(hours=hour))
    batches = [[message(1, "a", 1), message(2, "b", 1), message(3, "c", 0)], [message(1, "b", 0), message(2, "a", 3)]]
    for batch, messages in enumerate(batches):
        for _ in range(2):  # the second time after a failure
            sent, failed = notifications.send_pushes(spark.createDataFrame(messages, kinds), connections, path, batch, at)
            got = sorted((r.connection_id, r.id) for r in sent.collect())
            assert got == ([(1, 1), (2, 1)], [(1, 3), (3, 2)])[batch]
            assert rows(failed) == ([(2,), (3,)], [])[batch]
            assert all(f'"id":{r.id},' in r.payload for r in sent.collect())
    stored = notifications.stored_messages(spark, path, 1).orderBy("id").collect()
    assert [(r.id, r.target_ip, r.type, r.title, r.action_url) for r in stored] == [
        (1, "a", "default", "t1", None), (2, "b", "default", "t1", None), (3, "a", "default", "t2", None)
    ]
    assert notifications.stored_messages(spark, path, -1).count() == 0


def test_distinct_clients_of_periods(spark):
    rng = random.Random(8)
    events = [(f"ip{rng.randint(0, 400)}", dt(2023, 11, 15) + timedelta(hours=rng.randint(0, 5000))) for _ in range(3000)]
    frame = spark.createDataFrame(events, "ip string, ts timestamp_ntz")
    first, second = frame.filter("hash(ip, ts) % 2 = 0"), frame.filter("hash(ip, ts) % 2 <> 0")
    clients = usage.merge_clients(usage.count_clients(first), usage.count_clients(second)).cache()
    for months in (1, 3, 6, 12):
        want = {}
        for ip, ts in events:
            want.setdefault((ts.year * 12 + ts.month - 1) // months * months, set()).add(ip)
        label = lambda m: f"{m // 12:04d}{m % 12 + 1:02d}"
        assert rows(usage.active_clients(clients, months)) == sorted((label(p), label(p + months - 1), len(s)) for p, s in want.items())
    about = usage.estimated_clients(usage.sketch_clients(clients), "202311", "202406").first()[0]
    assert abs(about - len({ip for ip, _ in events})) < 0.06 * len({ip for ip, _ in events})
    assert usage.estimated_clients(usage.sketch_clients(clients), "190001", "190012").first()[0] == 0


def test_nested_rows_as_json(spark, staged):
    nested = listing.issue_list(*staged, None, "ascend", "issue_created_on", 2, 5).select("issue_idx", "createdate", "workflow")
    one = tables.to_json_rows(nested).first().json
    assert '"workflow":[{"issue_idx":' in one and '"createdate":"' in one and one.count('"progress_idx"') == 7


def test_small_ranges_share_tasks(spark, monkeypatch):
    monkeypatch.setattr(paging, "RANGE_ROWS", 500)
    issues = v.issues(spark, "/root/testdata/sf0.001")
    directory = paging.page_directory(issues, "ascend", "issue_created_on", range_rows=10)
    assert ", 3), REPARTITION_BY_NUM" in directory._jdf.queryExecution().executedPlan().toString()
    got, n = directory.orderBy("range").collect(), issues.count()
    assert n == 1500 and sum(r.n for r in got) == n and max(r.n for r in got) == 10 and 150 <= len(got) <= 153
    ends = [tuple(e) for r in got for e in (r["first"], r["last"])]
    assert ends == sorted(ends)
