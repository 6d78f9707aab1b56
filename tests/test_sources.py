import json
from datetime import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracklight import schemas
from tracklight.operators import reports, stages
from tracklight.registry import views as v
from tracklight.session import shared_dir
from tracklight.sources import attachments, tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_documents(spark, tmp_path):
    assert tables.read_documents(spark, str(tmp_path / "none.json"), schemas.LINKS).count() == 0
    path = tmp_path / "links.json"
    records = [{"url": "u1", "account": "me", "password": "x"}, {"url": "u2", "category": "c"}]
    path.write_text(json.dumps(records, indent=2))
    df = tables.read_documents(spark, str(path), schemas.LINKS)
    assert "password" not in df.columns
    assert sorted(r.url for r in df.collect()) == ["u1", "u2"]
    snapshot = str(tmp_path / "v1")
    tables.write_documents(df, snapshot)
    again = tables.read_documents(spark, snapshot, schemas.LINKS, layout="lines")
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    with pytest.raises(PySparkException):
        tables.write_documents(df, snapshot)
    with pytest.raises(ValueError):
        tables.read_documents(spark, snapshot, schemas.LINKS, layout="csv")


def test_memo_times(spark, frame, tmp_path):
    path = tmp_path / "memos.json"
    path.write_text('[{"key": "a", "datetime": "2024-01-02T03:04:05.678"}, {"key": "b", "datetime": "?"}]')
    df = tables.read_documents(spark, str(path), schemas.MEMOS)
    assert {r.key: r.datetime for r in df.collect()} == {"a": dt(2024, 1, 2, 3, 4, 5, 678000), "b": None}


def test_tables(spark, frame, tmp_path):
    path = str(tmp_path / "visits")
    january = frame(schemas.VISITS, [{"date": "202401", "ip": "a", "cnt": 1}])
    tables.write_table(january.withColumn("date", F.lit("202402")), path, "date")
    tables.write_table(january, path, "date")
    tables.write_table(january.withColumn("cnt", F.lit(5).cast("long")), path, "date")
    df = tables.read_table(spark, "visits", path)
    assert sorted((r.date, r.cnt) for r in df.collect()) == [("202401", 5), ("202402", 1)]
    assert dict(df.dtypes) == {"date": "string", "ip": "string", "cnt": "bigint"}
    plan = df.filter("date = '202401'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_scan_reads_what_is_needed(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    from tracklight.registry import views as v
    from tracklight.operators import reports

    plan = reports.tag_counts(v.issues(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan
    assert df.columns


def test_bucketed_tables_need_no_shuffle(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    plain = v.issues(spark, data), v.workflow(spark, data)
    for name, df in zip(("bucketed_issues", "bucketed_workflow"), plain):
        tables.write_bucketed(df, name, str(tmp_path / name), 4)
    stored = spark.table("bucketed_issues"), spark.table("bucketed_workflow")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        below = lambda df: str(df._jdf.queryExecution().executedPlan()).split("Join", 1)[-1]
        joined = stages.with_current_stage(*stored, bucketed=True)
        nested = stages.nest_workflow(stored[1])
        for df in (joined, nested, reports.report_summary(*stored, [0, 1], bucketed=True)):
            assert "Exchange" not in below(df) or df is nested
        assert "Exchange" not in str(nested._jdf.queryExecution().executedPlan())
        assert rows(joined.select("issue_idx", "status_idx")) == rows(stages.with_current_stage(*plain).select("issue_idx", "status_idx"))
        for report, more in ((reports.report_summary, ([0, 1, 2, 3],)), (reports.stage_counts, ()), (reports.stalled_by_stage, ([0, 1], v.AS_OF))):
            assert rows(report(*stored, *more, bucketed=True)) == rows(report(*plain, *more))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_issues")
        spark.sql("DROP TABLE bucketed_workflow")



def test_attachments(spark, tmp_path):
    assert attachments.read_attachments(spark, str(tmp_path / "none")).count() == 0
    for name in ("issues/5/a.png", "issues/5/.emptyFolderPlaceholder", "issues/6/b.JPG", "other/c.txt"):
        file = tmp_path / "files" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"x")
    manifest = attachments.read_attachments(spark, str(tmp_path / "files"))
    listed = attachments.with_mime_type(attachments.list_attachments(manifest))
    assert sorted(map(tuple, listed.collect())) == [(5, "a.png", "image/png"), (6, "b.JPG", "image/jpeg")]
    assert [r.name for r in attachments.list_attachments(manifest, 6).collect()] == ["b.JPG"]


def test_json_rows_keep_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert tables.to_json_rows(df).first().json == '{"a":1,"b":null}'


class Session:
    """Stands for a session: `shared_dir` only asks for one setting and the master."""

    def __init__(self, setting, master):
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}
        self.sparkContext = type("Context", (), {"master": master})


def test_shared_folder_follows_the_session():
    found = shared_dir(Session("hdfs://cluster/shared/", "yarn"), "x")
    assert found.startswith("hdfs://cluster/shared/x-")
    with pytest.raises(ValueError):
        shared_dir(Session(None, "yarn"), "x")
    assert "/x-" in shared_dir(Session(None, "local[2]"), "x")
