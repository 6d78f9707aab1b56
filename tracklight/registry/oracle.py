"""Answers of the registered queries in DuckDB SQL, written independently of the Spark code.

Each answer is one statement: the derived tables it needs as common table expressions, then the
query. Keys whose streams or steps cannot be said in SQL have no entry.
"""

from __future__ import annotations

from .views import AS_OF, MEMO_CLOCK, TEMPLATES

P = "(0, 1, 2, 3)"
MONTH, LAST_MONTH, CLIENT = "200001", "200003", "10.0.0.57"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "issues": (
        (),
        """
        SELECT o_orderkey AS issue_idx, NULL::VARCHAR AS issue_color,
          CASE WHEN o_custkey % 5 = 0 THEN '' WHEN o_custkey % 7 = 0 THEN NULL
               ELSE 'tag' || (o_custkey % 12) END AS issue_tag,
          CASE WHEN o_orderkey % 29 = 0 THEN '임시' WHEN o_orderkey % 37 = 0 THEN NULL
               ELSE (100000 + o_orderkey)::VARCHAR END AS issue_number,
          o_orderpriority || ' order ' || o_orderkey AS issue_subject,
          o_orderstatus AS issue_status, 'user' || (o_custkey % 40) AS issue_assigned_to,
          NULL::VARCHAR AS memo,
          (1 + o_orderkey % 7)::INT AS progress_idx, (o_custkey % 4)::INT AS product_idx,
          o_custkey % 6 AS category_idx,
          CASE WHEN o_orderpriority[1] < '5' THEN o_orderpriority[1]::INT - 1 END AS priority_idx,
          NULL::INT AS delaycount, o_orderkey % 4 = 0 AS is_updated,
          NULL::TIMESTAMP AS syncdate, o_orderdate AS createdate, NULL::TIMESTAMP AS updatedate,
          CASE WHEN o_orderkey % 31 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS deletedate,
          o_orderdate + to_hours(o_orderkey % 24) AS issue_created_on
        FROM orders""",
    ),
    "workflow": (
        (),
        """
        SELECT k AS issue_idx, s::INT AS progress_idx, status_idx::INT AS status_idx,
          CASE WHEN status_idx = 1 THEN NULL ELSE sd END AS startdate,
          CASE WHEN status_idx = 3 AND k % 11 <> 0 THEN sd + to_days(qty::INT) END AS completedate
        FROM (
          SELECT o.o_orderkey AS k, g.s, l.sd, l.qty,
            CASE WHEN l.sd IS NULL THEN 0 WHEN l.qty = 7 THEN NULL WHEN l.qty < 12 THEN 1
                 WHEN l.qty < 25 THEN 2 ELSE 3 END AS status_idx
          FROM orders o CROSS JOIN (SELECT unnest(range(1, 8)) AS s) g
          LEFT JOIN (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS sd, min(l_quantity) AS qty
                     FROM lineitem GROUP BY ALL) l
          ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = g.s)""",
    ),
    "staged": (
        ("issues", "workflow"),
        """
        SELECT i.*, w.status_idx, w.startdate, w.completedate
        FROM issues i JOIN workflow w USING (issue_idx, progress_idx)""",
    ),
    "usage": (
        (),
        """
        SELECT CASE WHEN o_custkey % 2 = 0 THEN '::ffff:10.0.0.' ELSE '10.0.0.' END
            || (o_custkey % 200) AS ip,
          CASE o_orderpriority[1] WHEN '1' THEN 'auth' WHEN '2' THEN 'link' WHEN '3' THEN 'prop'
               WHEN '4' THEN 'otp' ELSE 'memo' END AS action,
          'https://h' || (o_custkey % 9) || '.example.com/p' || (o_orderkey % 40) AS url,
          strftime(o_orderdate + to_hours(o_orderkey % 24), '%Y%m') AS date,
          o_orderkey % 3 = 0 AS is_visit
        FROM orders""",
    ),
    "visits": (
        ("usage",),
        "SELECT date, ip, count(*) AS cnt FROM usage WHERE is_visit GROUP BY date, ip",
    ),
    "actions": (
        ("usage",),
        "SELECT date, ip, action, count(*) AS cnt FROM usage GROUP BY date, ip, action",
    ),
    "url_hits": (
        ("usage",),
        """SELECT date, ip, url, count(*) AS cnt FROM usage WHERE action = 'link'
        GROUP BY date, ip, url""",
    ),
    "weights": (
        (),
        """
        SELECT * FROM (VALUES ('link', 3, 20), ('auth', 5, 30), ('prop', 2, 10), ('otp', 4, 6),
          ('memo', 6, 50)) t(action, "time", typing)""",
    ),
    "feed": (
        (),
        """
        SELECT '10.0.0.' || user_id AS ip,
          CASE event_type WHEN 'click' THEN 'link' WHEN 'view' THEN 'memo'
               WHEN 'signup' THEN 'auth' WHEN 'purchase' THEN 'prop' ELSE 'otp' END AS action,
          CASE WHEN event_type = 'click' THEN '/k' || (props->>'$.k') END AS url,
          strftime(ts, '%Y%m') AS date
        FROM events""",
    ),
    "notifications": (
        (),
        """
        SELECT conv_id * 8 + turn AS id, '10.0.0.' || (conv_id % 3) AS target_ip,
          CASE WHEN role = 'system' THEN 'jenkins' WHEN role = 'user' THEN 'hook'
               WHEN turn % 3 = 0 THEN 'mr' ELSE 'custom' END AS type,
          'conv ' || conv_id AS title, text AS message,
          CASE turn % 4 WHEN 1 THEN '' WHEN 2 THEN 'null' WHEN 3 THEN 'https://example.com/a'
               END AS action_url,
          (conv_id + turn) % 3 = 0 AS is_read,
          TIMESTAMP '2024-01-01' + to_minutes(7 * conv_id + turn) AS created_at
        FROM conversations""",
    ),
    "connections": (
        (),
        """
        SELECT event_id AS id, '10.0.0.' || user_id AS ip, ts AS connected_at,
          CASE WHEN event_id % 13 <> 0 THEN ts + to_hours(event_id % 72) END AS closed_at
        FROM events WHERE event_type IN ('signup', 'view')""",
    ),
    "pushes": (
        (),
        """
        SELECT event_id AS push_id, '10.0.0.' || user_id AS target_ip, ts AS sent_at
        FROM events WHERE event_type IN ('purchase', 'click')""",
    ),
    "messages": (
        (),
        """
        SELECT event_id AS seq, '10.0.0.' || user_id AS target_ip,
          CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN NULL ELSE event_type END AS type,
          'event ' || event_id AS title, props AS message,
          CASE WHEN event_id % 2 = 0 THEN '' ELSE '/e/' || event_id END AS action_url
        FROM events""",
    ),
    "issue_batch": (
        (),
        """
        SELECT event_id AS seq,
          CASE WHEN event_type <> 'error' THEN (100000 + event_id // 2 * 7)::VARCHAR END
            AS issue_number,
          'event ' || event_id AS issue_subject, event_type AS issue_status,
          'user' || user_id AS issue_assigned_to, ts AS issue_created_on
        FROM events""",
    ),
    "new_issues": (
        ("issues", "issue_batch"),
        """
        SELECT (SELECT max(issue_idx) FROM issues) + row_number() OVER (ORDER BY seq) AS issue_idx,
          coalesce(issue_number, '임시') AS issue_number, issue_subject,
          CASE WHEN issue_number IS NOT NULL THEN issue_status END AS issue_status,
          CASE WHEN issue_number IS NOT NULL THEN issue_assigned_to END AS issue_assigned_to,
          CASE WHEN issue_number IS NOT NULL THEN issue_created_on END AS issue_created_on
        FROM issue_batch b
        WHERE issue_number IS NULL
          OR (NOT EXISTS (SELECT 1 FROM issues i WHERE i.issue_number = b.issue_number)
              AND NOT EXISTS (SELECT 1 FROM issue_batch e
                              WHERE e.issue_number = b.issue_number AND e.seq < b.seq))""",
    ),
    "issue_changes": (
        (),
        """
        SELECT event_id // 3 AS issue_idx, event_id AS seq,
          CASE WHEN event_id % 2 = 0 THEN 'new' || user_id END AS issue_tag,
          CASE WHEN event_id % 2 = 1 THEN event_type END AS issue_status,
          CASE WHEN event_id % 5 = 0 THEN user_id::INT END AS delaycount,
          event_type = 'click' AS is_updated, event_type = 'view' AS is_syncdate_update
        FROM events""",
    ),
    "workflow_changes": (
        (),
        """
        SELECT event_id // 4 AS issue_idx, (user_id % 8 + 1)::INT AS progress_idx,
          event_id AS seq,
          CASE event_id % 3 WHEN 0 THEN 'status_idx' WHEN 1 THEN 'startdate'
               ELSE 'completedate' END AS field,
          CASE WHEN event_id % 3 = 0 THEN (user_id % 4)::INT END AS status,
          CASE WHEN event_id % 3 <> 0 AND event_id % 7 <> 0 THEN date_trunc('second', ts) END AS moment
        FROM events""",
    ),
    "links": (
        ("link_urls",),
        """
        SELECT page_id * 2 AS pos, url, 'c' || (page_id % 4) AS category,
          'page ' || page_id AS description, NULL::VARCHAR AS linkimage
        FROM (SELECT page_id, page_id * 3 AS n FROM pages) JOIN link_urls USING (n)
        UNION ALL
        SELECT min(page_id) * 2 + 1, url, 'own', 'page ' || min(page_id), NULL
        FROM pages WHERE url IS NOT NULL GROUP BY url""",
    ),
    # The URL made from a number, for all numbers in use.
    "link_urls": (
        (),
        """
        SELECT n, 'http://h' || (n % 211) || '.example.com' ||
          CASE n % 6 WHEN 0 THEN '/loginPortalForm.sms?u=' || n WHEN 1 THEN '/DLPCenterEDR/x' || n
               WHEN 2 THEN '/DLPCenter/y' || n WHEN 3 THEN '/cm/z' || n
               WHEN 4 THEN '/p' || n ELSE '/p' || n || '/q' END AS url
        FROM (SELECT page_id * 3 AS n FROM pages UNION SELECT doc_id FROM documents
              UNION SELECT doc_id // 4 * 3 + n_chars % 2 FROM documents)""",
    ),
    "candidates": (
        ("link_urls",),
        """
        SELECT *, {key} AS key FROM (
          SELECT doc_id * 2 AS pos, url, source AS category FROM documents JOIN link_urls ON n = doc_id
          UNION ALL
          SELECT page_id * 2 + 1, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '/[^/]*$', '')
            ELSE url || '/more' END, 'page' FROM pages)""",
    ),
    "link_changes": (
        ("link_urls",),
        """
        SELECT doc_id AS seq, CASE WHEN doc_id % 10 = 7 THEN 'edit' WHEN doc_id % 10 >= 8
          THEN 'delete' ELSE 'add' END AS kind, url, {key} AS key, lang AS category,
          source AS description
        FROM documents JOIN link_urls ON n = doc_id // 4 * 3 + n_chars % 2""",
    ),
    # One step per change, carrying the list of present URLs: the one-by-one result.
    "replay": (
        ("links", "link_changes"),
        """
        SELECT -1::BIGINT AS seq, (SELECT list(url) FROM links) AS present, false AS done
        UNION ALL
        SELECT c.seq,
          CASE WHEN c.kind = 'add' AND {free} THEN list_append(r.present, c.url)
               WHEN c.kind = 'delete' THEN list_filter(r.present, lambda u: u <> c.url)
               ELSE r.present END,
          CASE WHEN c.kind = 'add' THEN {free} ELSE list_contains(r.present, c.url) END
        FROM replay r JOIN link_changes c ON c.seq = r.seq + 1""",
    ),
    "link_log": (
        ("replay", "link_changes"),
        """
        SELECT c.*, r.done FROM link_changes c JOIN replay r USING (seq)""",
    ),
    "memos": (
        (),
        """
        SELECT conv_id * 8 + turn AS pos, 'k' || ((conv_id * 8 + turn) // 5) AS key,
          'conv ' || conv_id AS title, text AS contents,
          TIMESTAMP '2024-01-01' + to_minutes(7 * conv_id + turn) AS datetime,
          CASE WHEN turn % 5 <> 0 THEN turn % 2 = 0 END AS "autoDelete"
        FROM conversations""",
    ),
    "memo_changes": (
        (),
        """
        SELECT event_id AS seq, 'k' || (event_id // 7) AS key,
          CASE WHEN event_type IN ('click', 'view') THEN 'add' WHEN event_type = 'purchase'
               THEN 'edit' ELSE 'delete' END AS kind,
          'event ' || event_id AS title, props AS contents, date_trunc('second', ts) AS datetime,
          user_id % 2 = 0 AS "autoDelete"
        FROM events""",
    ),
    # One step per change of each key, carrying its queue of memos: the one-by-one result.
    "memo_steps": (
        ("memos", "memo_changes"),
        """
        SELECT k.key, 0::BIGINT AS step, -1::BIGINT AS seq, '' AS kind, true AS done,
          coalesce(m.queue, []) AS queue
        FROM (SELECT key FROM memos UNION SELECT key FROM memo_changes) k
        LEFT JOIN (SELECT key, list({{'pos': pos, 'title': title, 'contents': contents,
            'datetime': datetime, 'auto': "autoDelete"}} ORDER BY pos) AS queue
          FROM memos GROUP BY key) m USING (key)
        UNION ALL
        SELECT s.key, c.step, c.seq, c.kind, c.kind = 'add' OR len(s.queue) > 0,
          CASE WHEN c.kind = 'add' THEN list_append(s.queue, {{'pos': (SELECT max(pos) FROM memos)
              + 1 + c.seq, 'title': c.title, 'contents': c.contents, 'datetime': c.datetime,
              'auto': c."autoDelete"}})
            WHEN len(s.queue) = 0 THEN s.queue
            WHEN c.kind = 'delete' THEN s.queue[2:]
            ELSE list_concat([{{'pos': s.queue[1].pos, 'title': c.title, 'contents': c.contents,
              'datetime': c.datetime, 'auto': c."autoDelete"}}], s.queue[2:]) END
        FROM memo_steps s JOIN (
          SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS step FROM memo_changes) c
        ON c.key = s.key AND c.step = s.step + 1""",
    ),
    "attachments": (
        (),
        """
        SELECT 'issues/' || (doc_id % 50) || '/' || name AS path, name,
          doc_id % 50 AS issue_idx FROM (
          SELECT doc_id, CASE WHEN doc_id % 8 = 7 THEN '.emptyFolderPlaceholder' ELSE
            source || '_' || doc_id || '.' ||
            ['jpg', 'JPEG', 'png', 'gif', 'webp', 'webp2', 'txt'][1 + doc_id % 8] END AS name
          FROM documents)""",
    ),
}

_KEY = """CASE
  WHEN contains(url, 'loginPortalForm.sms')
    THEN split_part(url, 'loginPortalForm.sms', 1) || 'loginPortalForm.sms'
  WHEN contains(url, 'DLPCenterEDR') THEN split_part(url, 'DLPCenterEDR', 1) || 'DLPCenterEDR'
  WHEN contains(url, 'DLPCenter') THEN split_part(url, 'DLPCenter', 1) || 'DLPCenter'
  WHEN contains(url, '/cm') THEN split_part(url, '/cm', 1) || '/cm' ELSE url END"""

_LOGIN_KEY = "split_part({0}, 'loginPortalForm.sms', 1) || 'loginPortalForm.sms'"
_DUPLICATE = (
    "CASE WHEN contains({u}, 'loginPortalForm.sms') THEN "
    + _LOGIN_KEY.format("{u}")
    + " = c.key ELSE starts_with({u}, c.key) END"
)
_FREE = "len(list_filter(r.present, lambda u: " + _DUPLICATE.format(u="u") + ")) = 0"

RECURSIVE = {"replay", "memo_steps"}


def _needed(names: tuple[str, ...], found: list[str]) -> list[str]:
    for name in names:
        if name not in found:
            _needed(VIEWS[name][0], found)
            found.append(name)
    return found


def _sql(names: str, query: str) -> str:
    parts = []
    for name in _needed(tuple(names.split()), []):
        body = VIEWS[name][1]
        if "{" in body:
            body = body.format(key=_KEY, free=_FREE)
        parts.append(f"{name} AS ({body})")
    recursive = "RECURSIVE " if any(f"{n} AS (" in p for n in RECURSIVE for p in parts) else ""
    return (f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else "") + query


ORACLE: dict[str, str] = {}

# -- issues and reports -----------------------------------------------------------------------

_REPORTABLE = "deletedate IS NULL AND issue_number <> '임시' AND progress_idx <> 1"


def _summary(where: str) -> str:
    return _sql(
        "staged",
        f"""SELECT category_idx, progress_idx, priority_idx, count(*) AS count,
          count(*) FILTER (status_idx IN (0, 1)) AS waiting,
          count(*) FILTER (status_idx = 2) AS in_progress,
          count(*) FILTER (status_idx = 3) AS done
        FROM staged WHERE {_REPORTABLE} AND {where} GROUP BY ALL""",
    )


ORACLE["report_summary"] = _summary(f"priority_idx IN {P}")
ORACLE["report_summary_3m"] = _summary(
    f"priority_idx IN {P} AND issue_created_on >= TIMESTAMP '{AS_OF}' - INTERVAL 3 MONTH"
)
ORACLE["report_summary_custom"] = _summary(
    "priority_idx IN (0, 2) AND issue_created_on "
    "BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1999-06-30'"
)

_PER_STAGE = ", ".join(
    f'sum(CASE WHEN progress_idx = {k} THEN n ELSE 0 END)::BIGINT AS "{k}"' for k in range(1, 8)
)


def _stage_counts(where: str) -> str:
    return _sql(
        "staged",
        f"""SELECT sum(n)::BIGINT AS totalcount, {_PER_STAGE} FROM (
          SELECT progress_idx, count(*) AS n FROM staged
          WHERE deletedate IS NULL AND {where} GROUP BY progress_idx)""",
    )


ORACLE["stage_counts"] = _stage_counts("true")
ORACLE["stage_counts_none"] = _stage_counts("issue_subject LIKE '%no such text%'")

for _name, _where in {
    "product": "product_idx IN (1, 3)",
    "category": "category_idx = 0",
    "priority": "priority_idx IN (0, 2)",
    "progress": "progress_idx IN (2, 5, 7)",
    "status": "status_idx IN (1, 2)",
    "issue_status": "issue_status IN ('O', 'P')",
    "text": "(issue_subject ILIKE '%urgent%' OR issue_assigned_to ILIKE '%urgent%')",
    "number": "issue_number LIKE '%77%'",
    "created_after": "issue_created_on > TIMESTAMP '1999-05-05 07:00:00'",
    "created_before": "issue_created_on < TIMESTAMP '1999-05-05 07:00:00'",
    "updated": "is_updated",
    "tag": "issue_tag IN ('tag1', 'tag8')",
    "registered": "issue_number <> '임시'",
}.items():
    ORACLE[f"issue_filter_{_name}"] = _sql(
        "staged",
        f"""SELECT issue_idx, issue_number, progress_idx, status_idx, issue_created_on
        FROM staged WHERE deletedate IS NULL AND {_where}""",
    )

ORACLE["issue_list_page"] = _sql(
    "staged",
    """SELECT issue_idx, issue_color, issue_tag, issue_number, issue_subject, issue_status,
      issue_assigned_to, memo, progress_idx, product_idx, category_idx, priority_idx, delaycount,
      is_updated, syncdate, createdate, issue_created_on, status_idx, startdate, completedate
    FROM staged WHERE deletedate IS NULL AND issue_number <> '임시'
    ORDER BY priority_idx DESC NULLS FIRST, issue_idx LIMIT 50 OFFSET 150""",
)
ORACLE["issue_list_nested"] = _sql(
    "issues workflow",
    """SELECT issue_idx, createdate, progress_idx, status_idx, startdate, completedate
    FROM (SELECT i.issue_idx, i.createdate, w.progress_idx, w.status_idx, w.startdate, w.completedate,
            dense_rank() OVER (ORDER BY i.createdate DESC NULLS FIRST, i.issue_idx) AS place
          FROM issues i JOIN workflow w ON w.issue_idx = i.issue_idx WHERE i.deletedate IS NULL)
    WHERE place BETWEEN 101 AND 200""",
)
ORACLE["issue_list_ascending"] = _sql(
    "staged",
    """SELECT row_number() OVER (ORDER BY issue_created_on NULLS LAST, issue_idx) - 1 AS position,
      issue_idx, issue_created_on
    FROM (SELECT issue_idx, issue_created_on FROM staged WHERE deletedate IS NULL
          ORDER BY issue_created_on NULLS LAST, issue_idx LIMIT 500 OFFSET 1000)""",
)
ORACLE["issue_list_after"] = _sql(
    "staged",
    """SELECT row_number() OVER (ORDER BY createdate DESC, issue_idx) - 1 AS position, issue_idx,
      createdate
    FROM (SELECT issue_idx, createdate FROM staged
          WHERE deletedate IS NULL AND createdate <= TIMESTAMP '1998-06-01 00:00:00'
          ORDER BY createdate DESC, issue_idx LIMIT 1000)""",
)
ORACLE["issue_list_all"] = _sql(
    "staged workflow",
    """SELECT issue_idx, s.issue_subject, (row_number() OVER (PARTITION BY issue_idx
      ORDER BY w.progress_idx) - 1)::INT AS pos, w.progress_idx, w.status_idx, w.startdate,
      w.completedate
    FROM workflow w JOIN (SELECT issue_idx, issue_subject FROM staged WHERE deletedate IS NULL) s
      USING (issue_idx)""",
)
ORACLE["nested_workflow"] = _sql(
    "workflow",
    """SELECT issue_idx, (row_number() OVER (PARTITION BY issue_idx ORDER BY progress_idx) - 1)::INT
      AS pos, progress_idx, status_idx, startdate, completedate FROM workflow""",
)
_RELEASED = "progress_idx = 7 AND status_idx = 3 AND completedate IS NOT NULL"
ORACLE["qa_start"] = _sql(
    "workflow",
    f"""SELECT issue_idx, max(startdate) FILTER ({_RELEASED}) AS startdate,
      max(completedate) FILTER ({_RELEASED}) AS completedate,
      max(startdate) FILTER (progress_idx = 6) AS qa_startdate
    FROM workflow GROUP BY issue_idx HAVING count(*) FILTER ({_RELEASED}) > 0""",
)
ORACLE["issue_json_rows"] = _sql(
    "issues",
    """SELECT json_object('issue_idx', issue_idx, 'issue_number', issue_number, 'issue_subject',
      issue_subject, 'issue_tag', issue_tag, 'progress_idx', progress_idx)::VARCHAR AS json
    FROM issues""",
)
ORACLE["tag_counts"] = _sql(
    "issues",
    """SELECT DISTINCT issue_tag || '(' || count(*) || ')' AS label, issue_tag AS value,
      count(*) AS count FROM issues
    WHERE issue_tag <> '' AND deletedate IS NULL GROUP BY issue_tag""",
)
ORACLE["aged_open_issues"] = _sql(
    "issues",
    f"""SELECT issue_idx, issue_number, issue_subject, progress_idx, priority_idx, issue_created_on
    FROM issues WHERE issue_created_on <= TIMESTAMP '{AS_OF}' - INTERVAL 12 MONTH
      AND progress_idx NOT IN (1, 6, 7) AND deletedate IS NULL AND issue_number <> '임시'
      AND priority_idx IN {P}""",
)
ORACLE["stalled_by_stage"] = _sql(
    "staged",
    f"""SELECT progress_idx, count(*) AS count FROM staged
    WHERE {_REPORTABLE} AND priority_idx IN {P} AND completedate IS NULL AND status_idx <> 3
      AND (startdate IS NULL OR startdate <= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY)
    GROUP BY progress_idx""",
)

_LABEL = {
    "month": "strftime({0}, '%Y %m월')",
    "quarter": "strftime({0}, '%Y ') || quarter({0}) || 'Q'",
    "year": "strftime({0}, '%Y년')",
}


def _trend(kind: str, low: str, high: str, moment: str, rows: str, window: str) -> str:
    return f"""SELECT s.period, coalesce(c.count, 0) AS count FROM (
      SELECT DISTINCT {_LABEL[kind].format('t')} AS period
      FROM (SELECT unnest(generate_series({low}, {high}, INTERVAL 1 DAY)) AS t)) s
    LEFT JOIN (SELECT {_LABEL[kind].format(moment)} AS period, count(*) AS count
      FROM {rows} AND priority_idx IN {P} {window} GROUP BY 1) c USING (period)"""


_FIRST = "(SELECT min(issue_created_on) FROM issues WHERE progress_idx <> 1)"
_NOW = f"TIMESTAMP '{AS_OF}'"
_CREATED = f"issues WHERE {_REPORTABLE}"


def _done(stage: int) -> str:
    return f"""issues i JOIN workflow w USING (issue_idx) WHERE i.deletedate IS NULL
      AND i.issue_number <> '임시' AND w.progress_idx = {stage} AND w.status_idx = 3
      AND w.completedate IS NOT NULL"""


for _kind in _LABEL:
    ORACLE[f"created_trend_{_kind}"] = _sql(
        "issues", _trend(_kind, _FIRST, _NOW, "issue_created_on", _CREATED, "")
    )
ORACLE["created_trend_6m"] = _sql(
    "issues",
    _trend(
        "month",
        f"{_NOW} - INTERVAL 6 MONTH",
        _NOW,
        "issue_created_on",
        _CREATED,
        f"AND issue_created_on >= {_NOW} - INTERVAL 6 MONTH",
    ),
)
_LOW, _HIGH = "TIMESTAMP '1998-01-15 10:00:00'", "TIMESTAMP '1999-02-20'"
ORACLE["created_trend_custom"] = _sql(
    "issues",
    _trend(
        "month", _LOW, _HIGH, "issue_created_on", _CREATED,
        f"AND issue_created_on BETWEEN {_LOW} AND {_HIGH}",
    ),
)
for _name, _stage in (("dev", 5), ("release", 7)):
    ORACLE[f"completed_trend_{_name}"] = _sql(
        "issues workflow", _trend("month", _FIRST, _NOW, "w.completedate", _done(_stage), "")
    )
_LOW, _HIGH = "TIMESTAMP '1999-01-15'", "TIMESTAMP '1999-04-30'"
ORACLE["completed_trend_custom"] = _sql(
    "issues workflow",
    _trend(
        "quarter", _LOW, _HIGH, "w.completedate", _done(5),
        f"AND w.completedate BETWEEN {_LOW} AND {_HIGH}",
    ),
)
ORACLE["lead_time"] = _sql(
    "issues workflow",
    f"""SELECT d.a AS dev_average, d.m AS dev_median, r.a AS release_average, r.m AS release_median
    FROM (SELECT round(avg(n))::INT AS a, round_even(percentile_cont(0.5) WITHIN GROUP (ORDER BY n),
        0)::INT AS m
      FROM (SELECT w.completedate::DATE - i.issue_created_on::DATE AS n
        FROM {_done(5)} AND priority_idx IN {P})) d,
    (SELECT round(avg(n))::INT AS a, round_even(percentile_cont(0.5) WITHIN GROUP (ORDER BY n),
        0)::INT AS m
      FROM (SELECT w.completedate::DATE - (SELECT q.startdate FROM workflow q
          WHERE q.issue_idx = w.issue_idx AND q.progress_idx = 6)::DATE AS n
        FROM {_done(7)} AND priority_idx IN {P})) r""",
)

# -- usage ------------------------------------------------------------------------------------

for _name in ("visits", "actions", "url_hits"):
    ORACLE[f"count_{_name}"] = _sql(_name, f"SELECT * FROM {_name}")
ORACLE["merge_counts"] = _sql(
    "actions feed",
    """SELECT date, ip, action, sum(cnt)::BIGINT AS cnt FROM (
      SELECT date, ip, action, cnt FROM actions
      UNION ALL SELECT date, ip, action, 1 FROM feed) GROUP BY ALL""",
)
ORACLE["action_weights"] = _sql(
    "actions weights",
    """SELECT a.date, a.ip, a.action, a.cnt, w."time"::BIGINT AS "time", w.typing::BIGINT AS typing
    FROM actions a LEFT JOIN weights w USING (action)""",
)
_TOTALS = "coalesce(sum(cnt), 0)::BIGINT AS visit_cnt, count(*) AS active_cnt"
ORACLE["usage_totals"] = _sql(
    "visits", f"SELECT '{CLIENT}' AS myip, {_TOTALS} FROM visits WHERE date = '{MONTH}'"
)
ORACLE["usage_totals_by_month"] = _sql(
    "visits", f"SELECT date, {_TOTALS} FROM visits GROUP BY date"
)
ORACLE["usage_totals_all_clients"] = _sql(
    "visits", f"SELECT date, ip, {_TOTALS} FROM visits GROUP BY date, ip"
)


def _savings(where: str, typing: str) -> str:
    return _sql(
        "actions weights",
        f"""SELECT w.action, (coalesce(n, 0) * "time")::BIGINT AS time_cnt,
          (coalesce(n, 0) * {typing})::BIGINT AS typing_cnt
        FROM weights w LEFT JOIN (SELECT action, sum(cnt) AS n FROM actions
          WHERE date = '{MONTH}' {where} GROUP BY action) a USING (action)""",
    )


ORACLE["savings_by_action"] = _savings("", "typing")
ORACLE["savings_by_action_private"] = _savings(
    f"AND ip = '{CLIENT}'",
    "CASE WHEN w.action = 'otp' THEN (SELECT p.typing FROM weights p WHERE p.action = 'prop')"
    " ELSE typing END",
)
_BY_MONTH = f"""SELECT date {{0}}, sum(cnt * "time")::BIGINT AS time_cnt,
  sum(cnt * typing)::BIGINT AS typing_cnt
FROM actions JOIN weights USING (action) WHERE date <= '{LAST_MONTH}' {{1}} GROUP BY ALL"""
_MONTH_LABEL = "date[1:4] || '년' || date[5:6] || '월'"
ORACLE["savings_trend"] = _sql(
    "actions weights",
    f"""SELECT {_MONTH_LABEL} AS date, time_cnt, typing_cnt
    FROM ({_BY_MONTH.format('', '')} ORDER BY date DESC LIMIT 6)""",
)
ORACLE["savings_trend_all_clients"] = _sql(
    "actions weights",
    f"""SELECT ip, {_MONTH_LABEL} AS date, time_cnt, typing_cnt FROM (
      SELECT *, row_number() OVER (PARTITION BY ip ORDER BY date DESC) AS n
      FROM ({_BY_MONTH.format(', ip', '')})) WHERE n <= 6""",
)
ORACLE["top_urls"] = _sql(
    "url_hits",
    """SELECT date, row_number() OVER (PARTITION BY date ORDER BY cnt DESC, md5(url), url) AS seq,
      url, cnt
    FROM (SELECT date, url, sum(cnt)::BIGINT AS cnt FROM url_hits GROUP BY date, url)""",
)
ORACLE["top_urls_all_clients"] = _sql(
    "url_hits",
    """SELECT date, ip, row_number() OVER (PARTITION BY date, ip
      ORDER BY cnt DESC, md5(url), url) AS seq, url, cnt FROM url_hits""",
)


def _statistics(where: str) -> str:
    per_action = ", ".join(
        f"""(SELECT coalesce(sum(cnt), 0) FROM actions WHERE date = '{MONTH}' AND action = '{a}'
          {where})::BIGINT * (SELECT "{kind}" FROM weights WHERE action = '{a}') AS {kind}_cnt_{a}"""
        for kind in ("time", "typing")
        for a in ("auth", "link", "prop", "otp", "memo")
    )
    months = _BY_MONTH.format("", where).replace(LAST_MONTH, MONTH)
    trend = ", ".join(
        f"(SELECT string_agg({value}, ',' ORDER BY date) FROM trend) AS trend_{name}"
        for name, value in (
            ("date", _MONTH_LABEL), ("time", "time_cnt::VARCHAR"), ("typing", "typing_cnt::VARCHAR")
        )
    )
    with_trend = f", trend AS (SELECT * FROM ({months} ORDER BY date DESC LIMIT 6))"
    body = _sql("visits actions weights", "")
    return f"""{body.rstrip()}{with_trend}
    SELECT '{CLIENT}' AS myip,
      (SELECT coalesce(sum(cnt), 0) FROM visits WHERE date = '{MONTH}' {where})::BIGINT AS visit_cnt,
      (SELECT count(*) FROM visits WHERE date = '{MONTH}' {where}) AS active_cnt,
      {per_action}, {trend}"""


ORACLE["statistics"] = _statistics("")
ORACLE["statistics_private"] = _statistics(f"AND ip = '{CLIENT}'")

_N = "NULL::BIGINT"
_PLACE = "list_position(['auth', 'link', 'prop', 'otp', 'memo'], action)::BIGINT"
_TREND = _BY_MONTH.format("", "").replace(LAST_MONTH, MONTH)
ORACLE["statistics_rows"] = _sql(
    "visits actions url_hits weights",
    f"""SELECT 'totals' AS section, 1::BIGINT AS seq, 'visit_cnt' AS name, sum(cnt)::BIGINT AS cnt,
      {_N} AS "time", {_N} AS typing FROM visits WHERE date = '{MONTH}'
    UNION ALL SELECT 'totals', 2, 'active_cnt', count(*), NULL, NULL FROM visits
      WHERE date = '{MONTH}'
    UNION ALL SELECT 'action', {_PLACE}, action, NULL, sum(coalesce(cnt, 0) * "time")::BIGINT,
      sum(coalesce(cnt, 0) * typing)::BIGINT
      FROM weights LEFT JOIN (SELECT * FROM actions WHERE date = '{MONTH}') USING (action)
      GROUP BY action
    UNION ALL SELECT 'trend', row_number() OVER (ORDER BY date), {_MONTH_LABEL}, NULL, time_cnt,
      typing_cnt FROM ({_TREND} ORDER BY date DESC LIMIT 6)
    UNION ALL SELECT 'url', row_number() OVER (ORDER BY n DESC, md5(url), url), url, n, NULL, NULL
      FROM (SELECT url, sum(cnt)::BIGINT AS n FROM url_hits WHERE date = '{MONTH}' GROUP BY url)""",
)

# -- notifications ----------------------------------------------------------------------------

_INBOX = "id, type, title, message, action_url, is_read, created_at"
ORACLE["inbox_top100"] = _sql(
    "notifications",
    f"""SELECT target_ip, {_INBOX} FROM (SELECT *, row_number() OVER (PARTITION BY target_ip
      ORDER BY created_at DESC, id DESC) AS n FROM notifications) WHERE n <= 100""",
)
ORACLE["inbox_one_client"] = _sql(
    "notifications",
    f"""SELECT {_INBOX} FROM notifications WHERE target_ip = '10.0.0.1'
    ORDER BY created_at DESC, id DESC LIMIT 100""",
)
ORACLE["notification_by_id"] = _sql(
    "notifications",
    f"SELECT {_INBOX} FROM notifications WHERE id = 8 AND target_ip = '10.0.0.1'",
)
ORACLE["append_notifications"] = _sql(
    "notifications messages",
    f"""SELECT (SELECT max(id) FROM notifications) + row_number() OVER (ORDER BY seq) AS id,
      target_ip, coalesce(nullif(type, ''), 'default') AS type, title, message,
      nullif(action_url, '') AS action_url, false AS is_read, {_NOW} AS created_at
    FROM messages""",
)
_IS_OPEN = """c.ip = p.target_ip AND c.connected_at <= p.sent_at
  AND (c.closed_at IS NULL OR p.sent_at < c.closed_at)"""
ORACLE["deliverable"] = _sql(
    "pushes connections",
    f"""SELECT p.push_id, p.target_ip, p.sent_at, c.id AS connection_id
    FROM pushes p JOIN connections c ON {_IS_OPEN}""",
)
ORACLE["undeliverable"] = _sql(
    "pushes connections",
    f"SELECT * FROM pushes p WHERE NOT EXISTS (SELECT 1 FROM connections c WHERE {_IS_OPEN})",
)
_PAIRS = "SELECT DISTINCT event_id // 2 AS id, '10.0.0.' || (user_id % 3) AS ip FROM events"
ORACLE["mark_read"] = _sql(
    "notifications",
    f"""SELECT id, target_ip, is_read OR (id, target_ip) IN ({_PAIRS}) AS is_read
    FROM notifications""",
)
ORACLE["mark_read_answers"] = _sql(
    "notifications",
    f"""SELECT id, ip, EXISTS (SELECT 1 FROM notifications n WHERE n.id = p.id
      AND n.target_ip = p.ip) AS updated FROM ({_PAIRS}) p""",
)
_CASES = " ".join(f"WHEN '{t}' THEN '{b}'" for t, b in TEMPLATES.items())


def _first(source: str, marker: str, value: str) -> str:
    at = f"strpos({source}, '{marker}')"
    return (
        f"CASE WHEN {at} > 0 THEN {source}[:{at} - 1] || {value}"
        f" || {source}[{at} + {len(marker)}:] ELSE {source} END"
    )


ORACLE["render_notifications"] = _sql(
    "notifications",
    f"""SELECT id, target_ip, upper(type) AS type_label, title,
      CASE WHEN length(message) > 50 THEN message[:50] || '...' ELSE message END AS summary,
      CASE WHEN is_read THEN '읽음' ELSE '안읽음' END AS read_label,
      CASE WHEN is_read THEN 'read' ELSE 'unread' END AS read_class,
      coalesce(action_url NOT IN ('', 'null', 'undefined'), false) AS has_action,
      '/push-popup?ip=' || target_ip || '&newPushId=' || id AS popup_url,
      {_first('titled', '{{message}}', 'message')} AS body
    FROM (SELECT *, {_first('template', '{{title}}', 'title')} AS titled
      FROM (SELECT *, CASE type {_CASES} ELSE '{TEMPLATES["default"]}' END AS template
        FROM notifications))""",
)
ORACLE["push_payloads"] = _sql(
    "messages",
    """SELECT seq AS id, json_object('id', seq, 'type', coalesce(nullif(type, ''), 'default'),
      'title', title, 'message', message, 'url',
      '/push-popup?ip=' || target_ip || '&newPushId=' || seq)::VARCHAR AS payload FROM messages""",
)
ORACLE["client_ip"] = _sql(
    "actions",
    """SELECT date, ip, action, CASE WHEN contains(ip, '::ffff:') THEN split_part(ip, '::ffff:', 2)
      ELSE ip END AS client_ip FROM actions""",
)

# -- changes ----------------------------------------------------------------------------------

ORACLE["only_new"] = _sql(
    "issues issue_batch",
    """SELECT seq, issue_number FROM issue_batch b
    WHERE NOT EXISTS (SELECT 1 FROM issues i WHERE i.issue_number = b.issue_number)""",
)
ORACLE["register_issues"] = _sql(
    "new_issues",
    f"""SELECT issue_idx, issue_number, issue_subject, issue_status, issue_assigned_to,
      issue_created_on, progress_idx, is_updated, createdate FROM issues
    UNION ALL SELECT issue_idx, issue_number, issue_subject, issue_status, issue_assigned_to,
      issue_created_on, 1, false, {_NOW} FROM new_issues""",
)
ORACLE["seed_workflow"] = _sql(
    "workflow new_issues",
    """SELECT * FROM workflow UNION ALL
    SELECT issue_idx, unnest(range(1, 8))::INT, 0, NULL, NULL FROM new_issues""",
)
ORACLE["update_issues"] = _sql(
    "issues issue_changes",
    f"""SELECT i.issue_idx, coalesce(c.tag, i.issue_tag) AS issue_tag,
      coalesce(c.status, i.issue_status) AS issue_status, i.issue_subject,
      coalesce(c.delay, i.delaycount) AS delaycount,
      CASE WHEN c.k IS NULL THEN i.is_updated ELSE c.updated END AS is_updated,
      CASE WHEN c.sync THEN {_NOW} ELSE i.syncdate END AS syncdate,
      CASE WHEN c.k IS NOT NULL THEN {_NOW} ELSE i.updatedate END AS updatedate
    FROM issues i LEFT JOIN (
      SELECT issue_idx AS k, max_by(issue_tag, seq) FILTER (issue_tag IS NOT NULL) AS tag,
        max_by(issue_status, seq) FILTER (issue_status IS NOT NULL) AS status,
        max_by(delaycount, seq) FILTER (delaycount IS NOT NULL) AS delay,
        max_by(is_updated, seq) AS updated, bool_or(is_syncdate_update) AS sync
      FROM issue_changes GROUP BY issue_idx) c ON c.k = i.issue_idx""",
)
_LATEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issue_idx, progress_idx, field
  ORDER BY seq DESC) AS n FROM workflow_changes) WHERE n = 1 AND field = '{0}'"""
ORACLE["update_workflow"] = _sql(
    "workflow workflow_changes",
    f"""SELECT w.issue_idx, w.progress_idx,
      CASE WHEN a.seq IS NULL THEN w.status_idx ELSE a.status END AS status_idx,
      CASE WHEN b.seq IS NULL THEN w.startdate ELSE b.moment END AS startdate,
      CASE WHEN c.seq IS NULL THEN w.completedate ELSE c.moment END AS completedate
    FROM workflow w
    LEFT JOIN ({_LATEST.format('status_idx')}) a USING (issue_idx, progress_idx)
    LEFT JOIN ({_LATEST.format('startdate')}) b USING (issue_idx, progress_idx)
    LEFT JOIN ({_LATEST.format('completedate')}) c USING (issue_idx, progress_idx)""",
)
_CHANGED = "issue_idx IN (SELECT issue_idx FROM workflow_changes)"
ORACLE["update_workflow_stamps"] = _sql(
    "issues workflow_changes",
    f"""SELECT issue_idx, CASE WHEN {_CHANGED} THEN false ELSE is_updated END AS is_updated,
      CASE WHEN {_CHANGED} THEN {_NOW} ELSE updatedate END AS updatedate FROM issues""",
)
ORACLE["soft_delete"] = _sql(
    "issues",
    f"""SELECT issue_idx, CASE WHEN issue_idx IN (SELECT l_orderkey FROM lineitem
      WHERE l_returnflag = 'R') THEN {_NOW} ELSE deletedate END AS deletedate FROM issues""",
)
ORACLE["next_id"] = "SELECT max(o_orderkey) + 1 AS next_id FROM orders"
_CATEGORIES = "SELECT s_suppkey AS category_idx, s_name AS category_name FROM supplier"
ORACLE["add_category"] = f"""{_CATEGORIES} UNION ALL
SELECT ((SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY p_partkey)), p_name
FROM part"""
ORACLE["rename_category"] = f"""SELECT category_idx, coalesce(new, category_name) AS category_name
FROM ({_CATEGORIES}) LEFT JOIN (SELECT p_partkey // 10 AS k, max_by(p_brand, p_partkey) AS new
  FROM part GROUP BY 1) ON k = category_idx"""
ORACLE["category_list"] = "SELECT s_name AS category_name FROM supplier"
_SAVED = """SELECT p_partkey AS filter_idx, p_name AS filter_name,
  '{"priority_idx":[' || (p_size % 4) || ']}' AS filter_content,
  CASE WHEN p_partkey = 3 THEN '1' ELSE '0' END AS isdefaultfilter FROM part"""
ORACLE["saved_filter_list"] = _SAVED
ORACLE["add_filter"] = f"""{_SAVED} UNION ALL
SELECT ((SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY s_suppkey)), s_name,
  '{{"text":"' || s_name || '"}}', '0' FROM supplier"""
ORACLE["delete_filter"] = f"""SELECT * FROM ({_SAVED}) WHERE filter_idx NOT IN (
  SELECT c_custkey * 3 FROM customer UNION SELECT s_suppkey * 3 FROM supplier)"""
ORACLE["set_default_filter"] = f"""SELECT filter_idx, filter_name, filter_content,
  CASE WHEN filter_idx = 5 THEN '1' ELSE '0' END AS isdefaultfilter FROM ({_SAVED})"""

# -- links, memos, attachments ----------------------------------------------------------------

ORACLE["link_key"] = _sql("candidates", "SELECT pos, url, key FROM candidates")
_TAKEN = f"EXISTS (SELECT 1 FROM links l WHERE {_DUPLICATE.format(u='l.url')})"
ORACLE["duplicate_links"] = _sql(
    "links candidates", f"SELECT pos, url, category FROM candidates c WHERE {_TAKEN}"
)
ORACLE["acceptable_links"] = _sql(
    "links candidates", f"SELECT pos, url, category FROM candidates c WHERE NOT {_TAKEN}"
)
ORACLE["rejected_link_changes"] = _sql(
    "link_log",
    """SELECT seq, kind, url, CASE kind WHEN 'add' THEN 'url duplicated' WHEN 'delete'
      THEN 'no data to delete' ELSE 'no data to change' END AS reason
    FROM link_log WHERE NOT done""",
)
ORACLE["apply_link_changes"] = _sql(
    "links link_log",
    """SELECT coalesce((SELECT max(pos) FROM links) + 1 + a.seq, l.pos) AS pos, u.url,
      CASE WHEN e.seq IS NOT NULL THEN e.category WHEN a.seq IS NOT NULL THEN a.category
           ELSE l.category END AS category,
      CASE WHEN e.seq IS NOT NULL THEN e.description WHEN a.seq IS NOT NULL THEN a.description
           ELSE l.description END AS description, NULL::VARCHAR AS linkimage
    FROM (SELECT unnest(present) AS url FROM replay ORDER BY seq DESC
          LIMIT (SELECT len(present) FROM replay ORDER BY seq DESC LIMIT 1)) u
    LEFT JOIN links l USING (url)
    LEFT JOIN (SELECT url, max(seq) AS seq, max_by(category, seq) AS category,
        max_by(description, seq) AS description FROM link_log
      WHERE kind = 'add' AND done GROUP BY url) a USING (url)
    LEFT JOIN (SELECT url, max(seq) AS seq, max_by(category, seq) AS category,
        max_by(description, seq) AS description FROM link_log
      WHERE kind = 'edit' AND done GROUP BY url) e
      ON e.url = u.url AND e.seq > coalesce(a.seq, -1)""",
)
ORACLE["apply_memo_changes"] = _sql(
    "memo_steps",
    """SELECT m.pos AS pos, key, m.title AS title, m.contents AS contents,
      m.datetime AS datetime, m.auto AS "autoDelete"
    FROM (SELECT key, unnest(queue) AS m FROM (
      SELECT key, max_by(queue, step) AS queue FROM memo_steps GROUP BY key))""",
)
ORACLE["rejected_memo_changes"] = _sql(
    "memo_steps",
    """SELECT seq, kind, key, CASE kind WHEN 'delete' THEN 'no data to delete'
      ELSE 'no data to change' END AS reason FROM memo_steps WHERE NOT done""",
)
_EXPIRED = f"""NOT (coalesce(datetime + INTERVAL 3 HOUR < TIMESTAMP '{MEMO_CLOCK}', true)
  AND coalesce("autoDelete", false))"""
ORACLE["expire_memos"] = _sql("memos", f"SELECT * FROM memos WHERE {_EXPIRED}")
ORACLE["memo_list"] = _sql("memos", f"SELECT key, title, datetime FROM memos WHERE {_EXPIRED}")
ORACLE["list_attachments"] = _sql(
    "attachments",
    "SELECT issue_idx, name FROM attachments WHERE name <> '.emptyFolderPlaceholder'",
)
ORACLE["attachment_types"] = _sql(
    "attachments",
    """SELECT path, name, CASE lower(split_part(name, '.', -1)) WHEN 'jpg' THEN 'image/jpeg'
      WHEN 'jpeg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'gif' THEN 'image/gif'
      WHEN 'webp' THEN 'image/webp' WHEN 'webp2' THEN 'image/webp'
      ELSE 'application/octet-stream' END AS mime_type FROM attachments""",
)

# -- streams ----------------------------------------------------------------------------------

ORACLE["stream_usage_counts"] = _sql(
    "feed", "SELECT date, ip, action, url, count(*) AS cnt FROM feed GROUP BY ALL"
)
_SERVICE = """WITH service AS (
  SELECT event_id, ts, event_type IN ('signup', 'view') AS connects, event_type = 'error' AS closes,
    '10.0.0.' || user_id AS ip
  FROM events),
live AS (
  SELECT c.event_id AS id, c.ip, c.ts AS connected_at, x.ts AS closed_at FROM service c
  LEFT JOIN service x ON x.closes AND x.event_id - 40 = c.event_id WHERE c.connects)
"""
ORACLE["stream_delivery"] = f"""{_SERVICE}
SELECT p.event_id AS push_id, p.ip AS target_ip, p.ts AS sent_at, c.id AS connection_id
FROM service p JOIN live c ON c.ip = p.ip AND c.connected_at <= p.ts
  AND (c.closed_at IS NULL OR p.ts < c.closed_at)
WHERE NOT p.connects AND NOT p.closes"""
ORACLE["stream_connections"] = f"""{_SERVICE}
SELECT ip, count(*) AS connections FROM live WHERE closed_at IS NULL GROUP BY ip"""
ORACLE["stream_memo_expiry"] = _sql(
    "memos", f'SELECT pos, key, title, datetime, "autoDelete" FROM memos WHERE {_EXPIRED}'
)

_FAILED = f"""SELECT p.event_id AS push_id, p.ip AS target_ip, p.ts AS sent_at
FROM service p WHERE NOT p.connects AND NOT p.closes AND NOT EXISTS (SELECT 1 FROM live c
  WHERE c.ip = p.ip AND c.connected_at <= p.ts AND (c.closed_at IS NULL OR p.ts < c.closed_at))"""
for _name in ("stream_usage_counts", "stream_delivery", "stream_connections", "stream_memo_expiry"):
    ORACLE[f"{_name}_files"] = ORACLE[_name]
ORACLE["stream_delivery_files"] += f""" UNION ALL
SELECT *, NULL FROM ({_FAILED})"""
ORACLE["stream_expired_memos_files"] = _sql(
    "memos", f'SELECT pos, key, title, datetime, "autoDelete" FROM memos WHERE NOT {_EXPIRED}'
)

# -- stored indexes and snapshots --------------------------------------------------------------

ORACLE["issue_list_deep_page"] = _sql(
    "staged",
    """SELECT row_number() OVER (ORDER BY issue_tag DESC NULLS FIRST, issue_idx) - 1 AS position,
      issue_idx, issue_tag
    FROM (SELECT issue_idx, issue_tag FROM staged WHERE deletedate IS NULL
          ORDER BY issue_tag DESC NULLS FIRST, issue_idx LIMIT 50 OFFSET 1200)""",
)
for _name, _where in {
    "search_subject": "(issue_subject ILIKE '%LOW order 1%' OR issue_assigned_to ILIKE '%LOW order 1%')",
    "search_wildcards": "(issue_subject ILIKE '%t order 1_%7%' OR issue_assigned_to ILIKE '%t order 1_%7%')",
    "search_number": "(issue_subject ILIKE '%user3%' OR issue_assigned_to ILIKE '%user3%') AND issue_number LIKE '%10%'",
}.items():
    ORACLE[_name] = _sql(
        "issues",
        f"""SELECT issue_idx, issue_number, issue_subject, issue_assigned_to FROM issues
        WHERE deletedate IS NULL AND {_where}""",
    )
_AFTER = ORACLE["update_workflow"]
ORACLE["report_summary_refreshed"] = f"""WITH moved AS ({_AFTER}),
current AS ({_sql("issues", "SELECT * FROM issues")})
SELECT i.category_idx, i.progress_idx, i.priority_idx, count(*) AS count,
  count(*) FILTER (w.status_idx IN (0, 1)) AS waiting, count(*) FILTER (w.status_idx = 2) AS in_progress,
  count(*) FILTER (w.status_idx = 3) AS done
FROM current i JOIN moved w USING (issue_idx, progress_idx)
WHERE i.deletedate IS NULL AND i.issue_number <> '임시' AND i.progress_idx <> 1 AND i.priority_idx IN {P}
GROUP BY ALL"""
ORACLE["tag_counts_refreshed"] = f"""WITH changed AS ({ORACLE["update_issues"]}),
current AS ({_sql("issues", "SELECT issue_idx, deletedate FROM issues")})
SELECT issue_tag AS value, count(*) AS count FROM changed JOIN current USING (issue_idx)
WHERE deletedate IS NULL AND issue_tag <> '' GROUP BY issue_tag"""
for _name in ("report_summary", "stage_counts"):
    ORACLE[f"{_name}_bucketed"] = ORACLE[_name]
ORACLE["memo_snapshots"] = ORACLE["apply_memo_changes"]
ORACLE["documents_round_trip"] = _sql("links", "SELECT * FROM links")
ORACLE["table_round_trip"] = _sql("workflow", "SELECT * FROM workflow")


def _moment(column: str) -> str:
    """A moment as JSON writes it, or null."""
    return f"""coalesce('"' || strftime({column}, '%Y-%m-%dT%H:%M:%S.%g') || '"', 'null')"""


ORACLE["issue_json_nested"] = _sql(
    "issues workflow",
    f"""SELECT '{{"issue_idx":' || issue_idx || ',"issue_subject":"' || i.issue_subject || '","createdate":'
      || {_moment("i.createdate")} || ',"workflow":[' || string_agg('{{"issue_idx":' || issue_idx
      || ',"progress_idx":' || w.progress_idx || ',"status_idx":' || coalesce(w.status_idx::VARCHAR, 'null')
      || ',"startdate":' || {_moment("w.startdate")} || ',"completedate":' || {_moment("w.completedate")}
      || '}}', ',' ORDER BY w.progress_idx) || ']}}' AS json
    FROM issues i JOIN workflow w USING (issue_idx) GROUP BY issue_idx, i.issue_subject, i.createdate""",
)
ORACLE["send_pushes"] = _sql(
    "messages connections",
    f"""SELECT connection_id, id, target_ip, json_object('id', id, 'type', coalesce(nullif(type, ''), 'default'),
      'title', title, 'message', message, 'url',
      '/push-popup?ip=' || target_ip || '&newPushId=' || id)::VARCHAR AS payload
    FROM (SELECT p.*, c.id AS connection_id, dense_rank() OVER (ORDER BY event_type = 'purchase', seq) AS id
      FROM (SELECT m.*, e.ts AS sent_at, e.event_type FROM messages m JOIN events e ON e.event_id = m.seq) p
      JOIN connections c ON {_IS_OPEN})""",
)
ORACLE["active_clients"] = _sql(
    "usage",
    """SELECT strftime(q, '%Y%m') AS first, strftime(q + INTERVAL 2 MONTH, '%Y%m') AS last, active_cnt
    FROM (SELECT date_trunc('quarter', strptime(date, '%Y%m'))::TIMESTAMP AS q, count(DISTINCT ip) AS active_cnt
      FROM usage GROUP BY 1)""",
)
ORACLE["memo_usage_counts"] = f"""WITH refused AS ({ORACLE["rejected_memo_changes"]}),
used AS ({_sql("actions", "SELECT * FROM actions")}),
saved AS (
  SELECT strftime(ts, '%Y%m') AS date, '10.0.0.' || user_id AS ip, 'memo' AS action FROM events
  WHERE event_type IN ('click', 'view', 'purchase') AND event_id NOT IN (SELECT seq FROM refused))
SELECT date, ip, action, sum(cnt)::BIGINT AS cnt FROM (
  SELECT date, ip, action, cnt FROM used
  UNION ALL SELECT date, ip, action, count(*) FROM saved GROUP BY ALL) GROUP BY ALL"""
