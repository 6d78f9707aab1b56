"""The registered queries of this subpackage, and their DuckDB answers where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.llm import (
    decontaminate,
    lm_scoring,
    mixing,
    multiset_hash,
    pii,
    quality_gam,
    secret_scan,
    simhash,
    suffix_dedup,
    token_files,
    token_links,
    toxicity,
    whitening,
)
from tracklight.llm.common import in_fold, table
from tracklight.session import shared_dir


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("spans")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.fingerprints(table(spark, sf_dir, "documents"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data."""
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of benchmark items, by document and item."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_gam.score_documents(docs, model)
    return scored.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearness to the documents labelled good and not toxic, against all documents."""
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    scored = lm_scoring.score_documents(table(spark, sf_dir, "documents"), good)
    rounded = ("target_loss", "background_loss", "difference")
    return scored.withColumns({c: F.round(c, 4) for c in rounded})


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, from the files of ids that were written."""
    folder = shared_dir(spark, "ids")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_corpus(table(spark, sf_dir, "documents"), folder, tokenizer)
    return token_files.digests(spark, folder)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of two tokenizers by document, with how common their pairs are."""
    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return token_links.link_documents(table(spark, sf_dir, "documents"), *files)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_mix,
        op3_suffix_dedup,
        op4_fingerprints,
        op5_surrogates,
        op6_near_groups,
        op7_secrets,
        op8_leaks,
        op9_quality,
        op10_lm_scores,
        op11_token_files,
        op12_whitening,
        op13_token_links,
    )
}

#: Targets: the level is the first at which no source that is still open stands above its stop.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM {docs}
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
    WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM sources
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY 2 * source_size / w, source) AS i FROM ranked
), levels AS (
  SELECT i, w, source_size,
    (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0))::DOUBLE
      / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
  FROM ordered
  WINDOW before AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (
  SELECT coalesce(min_by(level, i), 0) AS level FROM levels WHERE level * w <= 2 * source_size
), targets AS (
  SELECT source, source_size, least(level * w, 2 * source_size)::DOUBLE AS target
  FROM ranked CROSS JOIN chosen
), placed AS (
  SELECT s.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM placed
)
SELECT doc_id, size, source_size, target,
  CAST(size * whole + greatest(0, least(size, budget - whole * source_size - before)) AS BIGINT) AS taken
FROM epochs
"""

SUFFIX_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM words WHERE len(w) >= 20
), windows AS (
  SELECT doc_id, s, row_number() OVER (
    PARTITION BY md5(array_to_string(w[s:s + 19], ' ')) ORDER BY doc_id, s) AS nth
  FROM starts
), covered AS (
  SELECT doc_id, list(DISTINCT i) AS gone
  FROM (SELECT doc_id, unnest(range(s, s + 20)) AS i FROM windows WHERE nth > 1)
  GROUP BY doc_id
), places AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), gone AS (
  SELECT doc_id, unnest(gone) AS i FROM covered
), kept AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS text, count(*) AS n
  FROM places p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i
  WHERE g.i IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words d LEFT JOIN kept k USING (doc_id)
"""

#: Losses are rounded, since sums of doubles depend on their order.
LM_SQL = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM low
), vocabulary AS (
  SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS v
  FROM words GROUP BY word QUALIFY v <= 2047
), numbered AS (
  SELECT doc_id, i, word, coalesce(v, 0) AS v FROM words LEFT JOIN vocabulary USING (word)
), good AS (
  SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0
), rare AS (
  SELECT word, count(*) AS b, count(*) FILTER (doc_id IN (SELECT doc_id FROM good)) AS t
  FROM numbered WHERE v = 0 GROUP BY word
), shares AS (
  SELECT word, ln((sum(b) OVER () + count(*) OVER ())::DOUBLE / (b + 1)) AS b,
    ln((sum(t) OVER () + count(*) OVER ())::DOUBLE / (t + 1)) AS t
  FROM rare
), bigrams AS (
  SELECT doc_id, word, v, coalesce(lag(v) OVER (PARTITION BY doc_id ORDER BY i), 0) AS h FROM numbered
), counts AS (
  SELECT h, v, 'b' AS model, count(*) AS n FROM bigrams GROUP BY h, v
  UNION ALL
  SELECT h, v, 't', count(*) FROM bigrams WHERE doc_id IN (SELECT doc_id FROM good) GROUP BY h, v
), models AS (
  SELECT unnest(['b', 't']) AS model
), unigrams AS (
  SELECT m.model, x.v, (coalesce(u.n, 0) + 1.0::DOUBLE) / (coalesce(t.n, 0) + 2048) AS p
  FROM models m CROSS JOIN (SELECT unnest(range(0, 2048)) AS v) x
  LEFT JOIN (SELECT model, v, sum(n) AS n FROM counts GROUP BY model, v) u
    ON u.model = m.model AND u.v = x.v
  LEFT JOIN (SELECT model, sum(n) AS n FROM counts GROUP BY model) t ON t.model = m.model
), contexts AS (
  SELECT model, h, sum(n) AS n, count(*) AS kinds FROM counts GROUP BY model, h
), scored AS (
  SELECT g.doc_id, m.model, -ln((coalesce(c.n, 0) + greatest(coalesce(x.kinds, 0), 1) * u.p)
    / (coalesce(x.n, 0) + greatest(coalesce(x.kinds, 0), 1)))
    + CASE WHEN g.v > 0 THEN 0 WHEN m.model = 'b' THEN s.b ELSE s.t END AS loss
  FROM bigrams g CROSS JOIN models m
  LEFT JOIN shares s ON s.word = g.word AND g.v = 0
  JOIN unigrams u ON u.model = m.model AND u.v = g.v
  LEFT JOIN counts c ON c.model = m.model AND c.h = g.h AND c.v = g.v
  LEFT JOIN contexts x ON x.model = m.model AND x.h = g.h
), losses AS (
  SELECT doc_id, avg(loss) FILTER (model = 't') AS t, avg(loss) FILTER (model = 'b') AS b
  FROM scored GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(t, 0), 4) AS target_loss,
  round(coalesce(b, 0), 4) AS background_loss, round(coalesce(t - b, 0), 4) AS difference
FROM low d LEFT JOIN losses USING (doc_id)
"""

ORACLE = {
    "op2_mix": MIX_SQL.format(docs="documents"),
    "op3_suffix_dedup": SUFFIX_SQL,
    "op10_lm_scores": LM_SQL,
}
