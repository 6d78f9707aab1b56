"""Every registered query against its SQL answer, and the known answers at sf0.01."""

import pytest

import __spark_entry__ as contract
from oracle_check import compare, connect
from tracklight.registry.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_contract():
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SMALL, name) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:3] == ["category_idx", "progress_idx", "priority_idx"]
    assert df.count() > 0


def test_known_answers(spark):
    q, d = contract.queries(), "/root/testdata/sf0.01"
    summary = q["report_summary"](spark, d).collect()
    assert len(summary) == 144 and tuple(summary[0]) == (0, 2, 0, 57, 34, 11, 12)
    stalled = {r.progress_idx: r["count"] for r in q["stalled_by_stage"](spark, d).collect()}
    assert len(stalled) == 6 and (stalled[2], stalled[3]) == (1226, 1251)
    assert tuple(q["lead_time"](spark, d).first()) == (44, 41, 53, 16)
    assert tuple(q["stage_counts"](spark, d).first()) == (14516, 2073, *[2074] * 5, 2073)
    months = q["created_trend_month"](spark, d).collect()
    assert len(months) == 80 and tuple(months[0]) == ("1995 01월", 111)
    assert [tuple(r) for r in q["completed_trend_custom"](spark, d).collect()] == [
        ("1999 1Q", 60), ("1999 2Q", 27),
    ]
    savings = {r.action: tuple(r)[1:] for r in q["savings_by_action"](spark, d).collect()}
    assert savings["auth"] == (180, 1080) and savings["link"] == (90, 600)
    sizes = {
        "aged_open_issues": 5321, "savings_trend_all_clients": 1200, "top_urls": 2857,
        "count_actions": 13650, "count_url_hits": 3002, "count_visits": 4286, "expire_memos": 496,
        "tag_counts": 12, "inbox_top100": 300, "deliverable": 8921, "undeliverable": 532,
    }
    assert {k: q[k](spark, d).count() for k in sizes} == sizes
