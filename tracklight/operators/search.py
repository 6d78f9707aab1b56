"""Text search over issues by postings of trigrams.

`ilike '%word%'` reads every row. The postings list, for each three characters in a row, the issues
that have them; a search reads those of the rarest trigrams of the asked text, keeps the issues
that have them all, and checks these with the predicate itself. So the result is that of the scan
for any pattern; one without three plain characters in a row is a scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import IssueFilter, filter_issues

#: Trigrams of a text that are looked up, the rarest first. More would seldom leave fewer issues.
MOST_LOOKED_UP = 3

_SUBJECT, _ASSIGNEE, _NUMBER = "issue_subject", "issue_assigned_to", "issue_number"


def _trigrams(text: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1)))
    cut = F.transform(starts, lambda i: F.substring(text, i, F.lit(3)))
    return F.array_distinct(F.filter(cut, lambda t: F.length(t) == 3))


def trigram_postings(issues: DataFrame) -> DataFrame:
    """(field, trigram, issue_idx) of the searched fields; the case of numbers counts."""
    fields = [(_SUBJECT, F.lower(_SUBJECT)), (_ASSIGNEE, F.lower(_ASSIGNEE)), (_NUMBER, F.col(_NUMBER))]
    found = [
        issues.filter(F.col(name).isNotNull()).select(F.lit(name).alias("field"), F.explode(_trigrams(text)).alias("trigram"), "issue_idx")
        for name, text in fields
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


def write_index(issues: DataFrame, path: str) -> None:
    """Write the postings, in the order of trigrams, and how many issues each trigram has.

    Ranges end within a trigram where most issues have it, and files hold few trigrams, so a scan
    passes over those that are not asked for.
    """
    keys = ["field", "trigram", "issue_idx"]
    trigram_postings(issues).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/postings")
    postings = issues.sparkSession.read.parquet(f"{path}/postings")
    counts = postings.groupBy("field", "trigram").agg(F.count(F.lit(1)).alias("n"))
    counts.write.mode("overwrite").parquet(f"{path}/counts")


def plain_trigrams(text: str, lower: bool) -> set[str]:
    """Trigrams that every match of the LIKE pattern `%text%` has.

    Wildcards, escapes and letters beyond ASCII, whose case is a matter of the engine, part them.
    """
    parts = re.split(r"\\.|[%_\\]|[^\x00-\x7f]", text, flags=re.DOTALL)
    parts = [p.lower() if lower else p for p in parts]
    return {p[i : i + 3] for p in parts for i in range(len(p) - 2)}


def _having(spark: SparkSession, path: str, field: str, trigrams: set[str]) -> DataFrame:
    """issue_idx of the issues whose field has the rarest of the trigrams."""
    of_field = F.col("field") == field
    counts = spark.read.parquet(f"{path}/counts").filter(of_field & F.col("trigram").isin(*trigrams))
    rarest = [r.trigram for r in counts.orderBy("n", "trigram").limit(MOST_LOOKED_UP).collect()]
    known = counts.count() == len(trigrams)
    postings = spark.read.parquet(f"{path}/postings")
    if not known:  # a trigram that no issue has
        return postings.select("issue_idx").limit(0)
    asked = postings.filter(of_field & F.col("trigram").isin(*rarest))
    if len(rarest) == 1:
        return asked.select("issue_idx")
    return asked.groupBy("issue_idx").count().filter(F.col("count") == len(rarest)).select("issue_idx")


def search_issues(issues: DataFrame, path: str, text: str | None = None, number: str | None = None) -> DataFrame:
    """The issues whose subject or assignee contains `text`, and whose number contains `number`.

    `path` holds the index that `write_index` made of these issues. The rows are those of
    `filter_issues` with these two predicates.
    """
    spark, wanted = issues.sparkSession, IssueFilter(text=text, issue_number=number)
    rows = issues
    for field, asked, lower in (("text", text, True), ("issue_number", number, False)):
        trigrams = plain_trigrams(asked or "", lower)
        if trigrams:
            having = [_having(spark, path, f, trigrams) for f in ((_SUBJECT, _ASSIGNEE) if field == "text" else (_NUMBER,))]
            hits = having[0].unionByName(having[1]).distinct() if len(having) > 1 else having[0]
            rows = rows.join(hits, "issue_idx", "left_semi")
    return filter_issues(rows, wanted)
