"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

Every paragraph (line) has a wide vector: `STRONG` lanes of 60 bits from its own hash, a lane with
the number of its pieces of up to four words, and `LANES` counting lanes, in which each piece adds
one where a bit of its hash is set. The fingerprint is the sum of the vectors, modulo 2^60. So the order of paragraphs does
not matter, a paragraph comes in by an addition and goes by a subtraction (`combined`), and the
counting lanes of two fingerprints have an inner product that tells how many pieces they share.

Everything here is built-in functions on columns: no Python runs on executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = r"[^\x20\x09-\x0D]+(?:[\x20\x09]+[^\x20\x09-\x0D]+){0,3}"
STRONG = 4
#: Sums stay below this power of two, so that no addition overflows.
MODULUS = 1 << 60
#: A long holds three counting lanes of 20 bits, so lanes stay apart up to a million pieces; beyond,
#: they carry into each other, which blurs the likeness but not the equality of fingerprints.
FIELD_BITS, FIELDS = 20, 3
LANE_MASK = sum(1 << (FIELD_BITS * i) for i in range(FIELDS))
SEEDS = 2
LANES = SEEDS * FIELD_BITS * FIELDS


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sum vector of column `text` as an array of longs; NULL is an empty text.

    Texts of equal paragraphs have equal vectors, whatever the order. A text without words has no
    pieces, so only its strong lanes tell it from others.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    pieces = F.regexp_extract_all(whole, F.lit(PIECE), F.lit(0))
    # The hashes are columns of their own, since every lane reads them.
    hashes = [f"_{name}_{s}" for s in range(SEEDS)]
    df = df.withColumns({f"_{name}_lines": F.split(whole, "\n"), f"_{name}_pieces": pieces})
    df = df.withColumns(
        {h: _hashes(f"_{name}_pieces", STRONG + s) for s, h in enumerate(hashes)}
    )
    strong = [_sum(_hashes(f"_{name}_lines", s)) for s in range(STRONG)]
    counting = [_sum(F.col(h), i) for h in hashes for i in range(FIELD_BITS)]
    vector = F.array(*strong, F.size(f"_{name}_pieces").cast("long"), *counting)
    return df.withColumn(name, vector).drop(f"_{name}_lines", f"_{name}_pieces", *hashes)


def _hashes(strings: str, seed: int) -> Column:
    return F.transform(strings, lambda x: F.xxhash64(x, F.lit(seed)))


def _sum(longs: Column, shift: int | None = None) -> Column:
    """The sum of longs, or of their fields of one bit from bit `shift` on."""

    def add(total: Column, x: Column) -> Column:
        if shift is None:
            return _modulo(total + _modulo(x))
        return _modulo(total + F.shiftrightunsigned(x, shift).bitwiseAND(LANE_MASK))

    return F.aggregate(longs, F.lit(0).cast("long"), add)


def combined(first: Column, second: Column, sign: int = 1) -> Column:
    """The vector of both texts' paragraphs together, or (sign -1) of the first without the second's."""
    return F.zip_with(first, second, lambda a, b: _modulo(a + sign * b))


def _modulo(x: Column) -> Column:
    return x.bitwiseAND(MODULUS - 1)


def as_hex(vector: Column) -> Column:
    return F.concat_ws("", F.transform(vector, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))))


def centred(vector: Column) -> Column:
    """The counting lanes as sums of plus and minus one: twice the count, less the pieces."""
    pieces = F.element_at(vector, STRONG + 1)
    longs = F.slice(vector, STRONG + 2, SEEDS * FIELD_BITS)
    field = F.lit((1 << FIELD_BITS) - 1)

    def lanes(i: int) -> Column:
        def lane(x: Column) -> Column:
            count = F.shiftrightunsigned(x, FIELD_BITS * i).bitwiseAND(field)
            return (2 * count - pieces).cast("double")

        return F.transform(longs, lane)

    return F.concat(*[lanes(i) for i in range(FIELDS)])


def inner(first: Column, second: Column) -> Column:
    zero = F.lit(0.0)
    return F.aggregate(F.zip_with(first, second, lambda a, b: a * b), zero, lambda a, x: a + x)


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Add `next_<c>` for each column carried: that of the next row by doc_id, then text, in a ring.

    A NULL id stands before all others. Rows are cut by id into ranges, up to 256 by quantiles of
    the ids and evenly within those; the first row of each range is sent to the range before as
    well. There are at most about 256 and twice the root of the number of rows of such ranges, so
    the broadcast list of their first ids has that bound, and a range has no more rows than that
    unless ids cluster.
    """
    n, low, high, cuts = docs.agg(
        F.count(F.lit(1)),
        F.min("doc_id"),
        F.max("doc_id"),
        F.percentile_approx("doc_id", [i / 256 for i in range(1, 256)]),
    ).first()
    edges = [low or 0, *sorted(set(cuts or [])), (high or 0) + 1]
    inside = max(1, math.ceil(n / (256 * max(256, math.isqrt(n)))))
    at = F.size(F.filter(F.lit(edges[1:-1]) if edges[1:-1] else F.array().cast("array<bigint>"),
                         lambda c: c <= F.col("doc_id")))
    start, end = (F.element_at(F.lit(edges), at + 1 + i) for i in (0, 1))
    width = F.greatest(end - start, F.lit(1))
    part = F.least(F.floor((F.col("doc_id") - start) * inside / width), F.lit(inside - 1))
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(at * inside + part).cast("long")
    placed = docs.withColumn("_bucket", bucket)

    firsts = placed.groupBy("_bucket").agg(F.min(F.struct("doc_id")).alias("_first"))
    ring = Window.orderBy("_bucket")
    firsts = firsts.select(
        F.col("_first.doc_id").alias("_id"),
        F.lag("_bucket").over(ring).alias("_lag"),
        F.max("_bucket").over(Window.partitionBy()).alias("_top"),
    ).select("_id", F.coalesce("_lag", "_top").alias("_before"), F.lit(True).alias("_is_first"))
    sent = placed.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    here = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("copy"))
    there = F.struct(F.col("_before").alias("b"), F.lit(1).alias("copy"))
    sent = sent.withColumn(
        "_to", F.explode(F.when(F.col("_is_first"), F.array(here, there)).otherwise(F.array(here)))
    )
    order = Window.partitionBy("_to.b").orderBy("_to.copy", "doc_id", "text")
    return (
        sent.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
        .where("_to.copy = 0")
        .select(*docs.columns, *[f"next_{c}" for c in carried])
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts.

    The edited text has its last quarter of code points (rounded down) replaced by the first as many
    of the next document's. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint
    (hex), near_edited and near_next: the cosine of the centred counting lanes, cut off at 0, and 1
    for equal fingerprints. Only doc_id and text of `docs` are read. NULL texts are empty. Rows with
    the same id follow each other by text; a single row is its own next one. No rows give no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(rows, "text", "print"), ["text", "print"])
    n_chars = F.length("text").cast("long")
    moved = F.floor(n_chars / 4).cast("int")
    kept = F.substring("text", F.lit(1), (n_chars - moved).cast("int"))
    edited = F.concat(kept, F.substring("next_text", F.lit(1), moved))
    rows = rows.select("doc_id", n_chars.alias("n_chars"), "print", "next_print", edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_print")
    rows = rows.withColumns({f"_{c}": centred(F.col(c)) for c in ("print", "edited_print", "next_print")})
    rows = rows.withColumns(
        {f"_n_{c}": F.sqrt(inner(F.col(f"_{c}"), F.col(f"_{c}"))) for c in ("print", "edited_print", "next_print")}
    )

    def near(other: str) -> Column:
        cosine = F.try_divide(
            inner(F.col("_print"), F.col(f"_{other}")), F.col("_n_print") * F.col(f"_n_{other}")
        )
        clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0))))
        return F.when(F.col("print") == F.col(other), 1.0).otherwise(clipped)

    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_hex(F.col("print")).alias("fingerprint"),
        as_hex(F.col("edited_print")).alias("edited_fingerprint"),
        near("edited_print").alias("near_edited"),
        near("next_print").alias("near_next"),
    )
