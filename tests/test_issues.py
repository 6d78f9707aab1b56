from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracklight import schemas
from tracklight.operators import filters, listing, reports, stages
from tracklight.operators.filters import IssueFilter

AS_OF = "2024-05-31 12:00:00"


def issue(n, **fields):
    row = {
        "issue_idx": n,
        "issue_number": str(1000 + n),
        "issue_subject": f"Subject {n}",
        "issue_assigned_to": "kim",
        "progress_idx": 2,
        "priority_idx": 1,
        "category_idx": 0,
        "product_idx": 0,
        "is_updated": False,
        "createdate": dt(2024, 1, n % 28 + 1),
        "issue_created_on": dt(2024, 1, 1),
    }
    return row | fields


def stage(n, progress=2, status=2, start=None, done=None):
    return {
        "issue_idx": n,
        "progress_idx": progress,
        "status_idx": status,
        "startdate": start,
        "completedate": done,
    }


def ids(df):
    return sorted(r.issue_idx for r in df.select("issue_idx").collect())


# -- filters ----------------------------------------------------------------------------------


@pytest.mark.parametrize("value", [None, "", [], 0, False, [""], [None]])
def test_unset_filters_add_nothing(value):
    for name in IssueFilter.__dataclass_fields__:
        assert filters.predicates(IssueFilter(**{name: value})) == []


def test_zero_in_a_list_filters(spark, frame):
    df = frame(schemas.ISSUES, [issue(1, product_idx=0), issue(2, product_idx=3)])
    assert ids(filters.filter_issues(df, IssueFilter(product_idx=[0]))) == [1]


def test_text_filters(spark, frame):
    df = frame(
        schemas.ISSUES,
        [
            issue(1, issue_subject="A Crash", issue_assigned_to="lee"),
            issue(2, issue_subject="other", issue_assigned_to="CRASHer"),
            issue(3, issue_subject="100% done", issue_number="AB-7"),
            issue(4, issue_subject=None, issue_assigned_to="crash", deletedate=dt(2024, 1, 1)),
            issue(5, issue_subject=r"c:\data", issue_number="ab-7"),
        ],
    )
    find = lambda **f: ids(filters.filter_issues(df, IssueFilter(**f)))
    assert find(text="crash") == [1, 2]
    assert find(text="1_0%d") == [3]  # wildcards stay wildcards
    assert find(text=r"100\%") == [3]
    assert find(text=r"c:\\d") == [5]
    assert find(text=r"\d\one") == [3]  # a backslash before a plain character is that character
    assert find(issue_number="AB") == [3]  # case counts in numbers
    assert find() == [1, 2, 3, 5]


def test_window_and_flag_filters(spark, frame):
    df = frame(
        schemas.ISSUES,
        [
            issue(1, issue_created_on=dt(2024, 1, 1), is_updated=True),
            issue(2, issue_created_on=dt(2024, 1, 2), issue_number="임시"),
            issue(3, issue_created_on=dt(2024, 1, 3), issue_number=None, is_updated=None),
        ],
    )
    find = lambda **f: ids(filters.filter_issues(df, IssueFilter(**f)))
    assert find(created_after="2024-01-01") == [2, 3]
    assert find(created_before=dt(2024, 1, 3)) == [1, 2]
    assert find(only_updated=True) == [1]
    assert find(only_updated="true") == [1, 2, 3]  # not the value true
    assert find(only_registered=True) == [1]  # a missing number is not registered


def test_report_filter(spark, frame):
    df = frame(
        schemas.ISSUES,
        [
            issue(1, issue_created_on=dt(2024, 2, 29, 12)),
            issue(2, issue_created_on=dt(2024, 2, 29, 11, 59)),
            issue(3, issue_created_on=dt(2024, 5, 10, 9), priority_idx=None),
            issue(4, issue_created_on=dt(2024, 5, 10, 9)),
            issue(5, issue_created_on=dt(2025, 1, 1)),
        ],
    )
    find = lambda p, *a: ids(filters.report_filter(df, p, *a, as_of=AS_OF))
    assert find([1], "3") == [1, 4, 5]  # 31 May less 3 months is 29 February; no upper bound
    assert find([1], "custom", "2024-02-29 11:59:00", "2024-05-10") == [1, 2]  # end is midnight
    assert find([1], "custom", "", "2024-05-10") == [1, 2, 4, 5]
    assert find([1], "whatever") == [1, 2, 4, 5]
    assert find([]) == [] and find(None) == []


# -- stages and lists -------------------------------------------------------------------------


def test_current_stage_and_nesting(spark, frame):
    issues = frame(schemas.ISSUES, [issue(1, progress_idx=3), issue(2), issue(3)])
    flow = frame(
        schemas.WORKFLOW,
        [stage(1, 3, 1), stage(1, 1, 3, dt(2024, 1, 1), dt(2024, 1, 2)), stage(2, 1, 3), stage(3)],
    )
    assert ids(stages.with_current_stage(issues, flow)) == [1, 3]
    nested = {
        r.issue_idx: r.workflow
        for r in stages.with_workflow(issues.filter("issue_idx < 3"), flow).collect()
    }
    assert [s.progress_idx for s in nested[1]] == [1, 3]
    assert nested[1][1].startdate is None
    none = stages.with_workflow(issues, flow.filter("issue_idx = 9")).collect()
    assert [r.workflow for r in none] == [[], [], []]
    assert stages.repeated_stages(flow.union(flow)).count() == 4
    qa = stages.with_qa_start(issues, frame(schemas.WORKFLOW, [stage(1, 6, 2, dt(2024, 2, 2))]))
    assert {r.issue_idx: r.qa_startdate for r in qa.collect()} == {1: dt(2024, 2, 2), 2: None, 3: None}


@pytest.fixture
def listed(frame):
    issues = [issue(n, delaycount=d) for n, d in enumerate([5, None, 3, 5, 1], 1)]
    return frame(schemas.ISSUES, issues), frame(schemas.WORKFLOW, [stage(n) for n in range(1, 6)])


def test_list_order_and_pages(listed):
    def order(*args, **page):
        rows = listing.issue_list(*listed, None, *args, **page).collect()
        return [r.issue_idx for r in rows]

    assert order("ascend", "delaycount") == [5, 3, 1, 4, 2]  # missing last, ties by id
    assert order("descend", "delaycount") == [2, 1, 4, 3, 5]  # missing first
    assert order() == [5, 4, 3, 2, 1]  # newest first
    assert order("ascend", "delaycount", page=2, size=2) == [1, 4]
    assert order("ascend", "delaycount", page=3, size=2) == [2]
    assert order("ascend", "delaycount", page=4, size=2) == []
    assert sorted(order("sideways", "delaycount")) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        order("ascend", "issue_idx; drop table")


@pytest.mark.parametrize("order", ["ascend", "descend", None, "sideways"])
def test_pages_after_a_row_fit_together(listed, order):
    key = "delaycount" if order else "createdate"
    whole = [r.issue_idx for r in listing.listed_issues(*listed, None, order, key, size=9).collect()]
    seen, last = [], None
    while page := listing.listed_issues(*listed, None, order, key, size=2, after=last).collect():
        seen += [r.issue_idx for r in page]
        last = (page[-1][key], page[-1].issue_idx)
    assert seen == whole and len(whole) == 5


def test_list_columns(listed):
    df = listing.issue_list(*listed, size=1)
    assert df.columns == [*listing.ISSUE_COLUMNS, "workflow"]
    assert len(df.first().workflow) == 1


def test_page_is_a_top_k(listed):
    plan = listing.listed_issues(*listed, page=2, size=2)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_nested_page_is_cut_once(listed):
    plan = listing.issue_list(*listed, page=2, size=2)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 1


# -- reports ----------------------------------------------------------------------------------


def test_summary(spark, frame):
    issues = frame(
        schemas.ISSUES,
        [issue(1), issue(2), issue(3, progress_idx=1), issue(4, issue_number="임시"), issue(5)],
    )
    flow = frame(
        schemas.WORKFLOW,
        [stage(1, status=0), stage(2, status=None), stage(3, 1), stage(4), stage(5, status=3)],
    )
    row = reports.report_summary(issues, flow, [1]).collect()
    assert [tuple(r) for r in row] == [(0, 2, 1, 3, 1, 0, 1)]


def test_stage_counts(spark, frame):
    issues = frame(schemas.ISSUES, [issue(1), issue(2), issue(3, progress_idx=7)])
    flow = frame(schemas.WORKFLOW, [stage(1), stage(2), stage(3, 7)])
    assert tuple(reports.stage_counts(issues, flow).first()) == (3, 0, 2, 0, 0, 0, 0, 1)
    nothing = reports.stage_counts(issues, flow, IssueFilter(product_idx=[99]))
    assert tuple(nothing.first()) == (None,) * 8


def trend(df):
    return [tuple(r) for r in df.collect()]


def test_created_trend_fills_gaps(spark, frame):
    issues = frame(
        schemas.ISSUES,
        [
            issue(1, issue_created_on=dt(2024, 1, 31, 18)),
            issue(2, issue_created_on=dt(2024, 3, 5)),
            issue(3, issue_created_on=dt(2023, 12, 31), issue_number="임시"),
            issue(4, issue_created_on=dt(2023, 11, 30), progress_idx=1),
            issue(5, issue_created_on=dt(2024, 6, 2)),
        ],
    )
    # Starts at the oldest issue past stage 1, though that is temporary; 5 lies past the end.
    assert trend(reports.created_trend(issues, [1], as_of=AS_OF)) == [
        ("2023 12월", 0), ("2024 01월", 1), ("2024 02월", 0), ("2024 03월", 1), ("2024 04월", 0),
        ("2024 05월", 0),
    ]
    assert trend(reports.created_trend(issues, [1], "all", "quarter", as_of=AS_OF)) == [
        ("2023 4Q", 0), ("2024 1Q", 2), ("2024 2Q", 1),
    ]
    assert trend(reports.created_trend(issues, [1], "all", "year", as_of=AS_OF)) == [
        ("2023년", 0), ("2024년", 3),
    ]
    assert trend(reports.created_trend(issues, [], "all", "year", as_of=AS_OF)) == [
        ("2023년", 0), ("2024년", 0),
    ]


def test_trend_edges(spark, frame):
    issues = frame(
        schemas.ISSUES,
        [
            issue(1, issue_created_on=dt(2024, 3, 31, 15)),
            issue(2, issue_created_on=dt(2024, 5, 1, 8)),
        ],
    )
    # Steps keep 15:00, so at 12:00 on the first of a month its bucket is missing.
    months = trend(reports.created_trend(issues, [1], as_of="2024-05-01 12:00:00"))
    assert months == [("2024 03월", 1), ("2024 04월", 0)]
    custom = lambda a, b: trend(
        reports.created_trend(issues, [1], "custom", "month", a, b, AS_OF)
    )
    assert custom("2024-04-30", "2024-05-01") == [("2024 04월", 0), ("2024 05월", 0)]  # midnight
    assert custom("2024-05-02", "2024-05-01") == []
    assert trend(reports.created_trend(issues.limit(0), [1], as_of=AS_OF)) == []
    for bad in (("week", "all"), ("month", "9"), ("month", "custom")):
        with pytest.raises(ValueError):
            reports.created_trend(issues, [1], bad[1], bad[0], "", "", AS_OF)


def test_completed_trend(spark, frame):
    issues = frame(schemas.ISSUES, [issue(1, progress_idx=1), issue(2), issue(3)])
    flow = frame(
        schemas.WORKFLOW,
        [
            stage(1, 5, 3, done=dt(2024, 2, 3)),  # counts although its issue is in stage 1
            stage(2, 5, 2, done=dt(2024, 2, 3)),
            stage(3, 5, 3),
            stage(3, 7, 3, done=dt(2024, 3, 1)),
        ],
    )
    run = lambda kind: trend(
        reports.completed_trend(issues, flow, [1], "all", "quarter", kind, as_of=AS_OF)
    )
    assert run("dev") == [("2024 1Q", 1), ("2024 2Q", 0)]
    assert run("qa") == [("2024 1Q", 1), ("2024 2Q", 0)]
    months = reports.completed_trend(issues, flow, [1], "3", "month", "x", as_of=AS_OF)
    assert trend(months)[:2] == [("2024 02월", 0), ("2024 03월", 1)]


def test_ageing(spark, frame):
    issues = frame(
        schemas.ISSUES,
        [
            issue(1, issue_created_on=dt(2023, 5, 31, 12)),
            issue(2, issue_created_on=dt(2023, 5, 31, 13)),
            issue(3, issue_created_on=dt(2020, 1, 1), progress_idx=6),
            issue(4, issue_created_on=dt(2020, 1, 1), progress_idx=3),
        ],
    )
    assert ids(reports.aged_open_issues(issues, [1], AS_OF)) == [1, 4]
    flow = frame(
        schemas.WORKFLOW,
        [
            stage(1, status=2),  # never started
            stage(2, status=None),  # no status: not counted
            stage(3, 6, 2, dt(2024, 3, 2, 12)),  # exactly 90 days
            stage(4, 3, 1, dt(2024, 3, 2, 13)),
        ],
    )
    assert trend(reports.stalled_by_stage(issues, flow, [1], AS_OF)) == [(2, 1), (6, 1)]


def lead(frame, dev, release=()):
    issues, flow = [], []
    for n, days in enumerate(dev):
        issues.append(issue(n, issue_created_on=dt(2024, 1, 10, 23)))
        flow.append(stage(n, 5, 3, done=dt(2024, 1, 10 + days, 1)))
    for n, (start, end) in enumerate(release, 100):
        issues.append(issue(n))
        flow += [stage(n, 7, 3, done=end), stage(n, 6, 1, start)]
    rows = reports.lead_time(frame(schemas.ISSUES, issues), frame(schemas.WORKFLOW, flow), [1])
    return tuple(rows.first())


def test_lead_time_rounding(frame):
    assert lead(frame, [2, 3]) == (3, 2, None, None)  # mean half up, median half to even
    assert lead(frame, [3, 4]) == (4, 4, None, None)
    assert lead(frame, [-2, -3]) == (-3, -2, None, None)  # negative spans count
    assert lead(frame, []) == (None,) * 4
    released = [(dt(2024, 2, 1, 23), dt(2024, 2, 2, 1)), (None, dt(2024, 2, 9))]
    assert lead(frame, [0], released) == (0, 0, 1, 1)  # midnights; no QA start is left out


def test_tags(spark, frame):
    issues = frame(
        schemas.ISSUES,
        [issue(n, issue_tag=t) for n, t in enumerate(["a", "a", "b", "", None])]
        + [issue(9, issue_tag="b", deletedate=dt(2024, 1, 1))],
    )
    assert sorted(trend(reports.tag_counts(issues))) == [("a(2)", "a", 2), ("b(1)", "b", 1)]


def test_invariants_on_given_tables(spark):
    from tracklight.registry import views as v

    d = "/root/testdata/sf0.001"
    issues, flow = v.issues(spark, d), v.workflow(spark, d)
    row = reports.stage_counts(issues, flow).first()
    assert row.totalcount == sum(row[1:])
    total = sum(r["count"] for r in reports.created_trend(issues, [0, 1, 2, 3], as_of=v.AS_OF).collect())
    kept = filters.with_priorities(filters.reportable(issues), [0, 1, 2, 3])
    assert total == kept.filter(F.col("issue_created_on") < "2001-08-03").count()
