"""Mixing sources to target weights: hash order, distributed prefix sums, exact budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklight.llm.common import WORD, checkpointed, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix"
#: A table of this many sources, with names of this many characters in all, goes to all executors.
MOST_SENT = (50_000, 5_000_000)


def numbered_by_range(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add `name` = 0, 1, 2, .. in the order of `column`, NULL last, without one task for all rows.

    Rows are range-partitioned and kept so; each partition then counts on from those before it.
    """
    ordered = F.col(column).asc_nulls_last()
    ranged = checkpointed(
        df.repartitionByRange(ordered).withColumn("_range", F.spark_partition_id())
    )
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_range").orderBy(ordered)
    return (
        ranged.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(starts, "_range")
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop("_range", "_start", "_inside")
    )


def source_targets(
    sources: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_epochs: int = MOST_EPOCHS,
) -> DataFrame:
    """Add `target` to (source, source_size): `share` of all sizes, dealt by weight.

    Weights go round the sources in code point order, NULL last. A target stops at `most_epochs`
    times its source's size; what is over goes to the others by weight, until none is above. Each
    round is one sum over the sources, of which only three numbers come to the driver; rounds end
    since every round but the last stops at least one more source, in practice a handful at once.
    """
    ranked = numbered_by_range(sources, "source", "_rank")
    weight = F.element_at(F.lit(list(weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = checkpointed(ranked.withColumn("_weight", weight.cast("long")))
    cap = most_epochs * F.col("source_size")
    level, stopped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("_weight") * F.lit(level) > cap
        size, at_cap, open_weight, n = ranked.agg(
            F.sum("source_size"),
            F.sum(F.when(over, cap)),
            F.sum(F.when(~over, F.col("_weight"))),
            F.count_if(over),
        ).first()
        if not open_weight or n == stopped:
            break
        level, stopped = (share * size - (at_cap or 0)) / open_weight, n
    target = F.least(F.lit(float(level or 0)) * F.col("_weight"), cap.cast("double"))
    return ranked.withColumn("target", target).drop("_rank", "_weight")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_epochs: int = MOST_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """How many words of each document a mix takes: (doc_id, source, size, source_size, target, taken).

    `docs` needs doc_id, text and source; its other columns are not read. The documents of a source
    stand in the order of a keyed hash of their id. Epochs go through all of them as often as the
    target asks, the last one up to the word at which the source has taken floor(target): its last
    document is taken in part. NULL and empty texts have size 0 and give nothing; a NULL source is a
    source; rows with the same id stand next to each other and each counts; no rows give no rows.

    Prefix sums take two steps: sums of hash ranges of a source, about as many as the root of the
    number of rows, then the rows of one range. So no task holds a whole source.
    """
    rows = docs.select("doc_id", "source", word_count("text").alias("size"))
    return _placed(rows, weights, share, most_epochs, seed).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * F.col("_epochs") + F.col("_partly")).cast("long").alias("taken"),
    )


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_epochs: int = MOST_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """The mixed data: `docs` with one row for each epoch that takes a document, as `mix` decides.

    All columns of `docs` stay; epoch counts from 1, and taken (long) is the number of words of the row.
    The last document of a source is cut behind its last word that is taken. Documents of which nothing
    is taken are not in it. Columns of `docs` named epoch or taken, in any case, give way; others
    may have any name. `docs` is read for the sizes and again for the rows, and so must give the same
    rows; no copy of its texts is kept between. Of rows alike in id, source and size, among which the
    last epoch ends, those first by a hash of their text are taken.

    The sizes decide where the last epoch of each source ends; a row is then compared with that place
    alone. So texts stay in the task that reads them, unless there are too many sources to send to all.
    """
    kept = [c for c in docs.columns if c.lower() not in ("epoch", "taken")]
    sizes = docs.select("doc_id", "source", word_count("text").alias("size"))
    ends = _ends(_placed(sizes, weights, share, most_epochs, seed))
    doc = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc")
    placed = _by_ends(
        docs.select("doc_id", "source", word_count("text").alias("size"), _place(seed), doc), ends
    )
    last = F.when(F.col("_partly") > 0, F.array(F.struct((F.col("_epochs") + 1).alias("epoch"), F.col("_partly").alias("taken"))))
    whole = F.when(
        (F.col("_epochs") > 0) & (F.col("size") > 0),
        F.transform(F.sequence(F.lit(1).cast("long"), F.col("_epochs")), lambda e: F.struct(e.alias("epoch"), F.col("size").alias("taken"))),
    )
    none = F.array().cast("array<struct<epoch: bigint, taken: bigint>>")
    rows = placed.select("_doc", "size", F.inline(F.concat(F.coalesce(whole, none), F.coalesce(last, none))))
    heads = F.regexp_extract_all("_doc.text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(heads, F.lit(1), F.col("taken").cast("int")), "")
    text = F.when(F.col("taken") < F.col("size"), cut).otherwise(F.col("_doc.text"))
    return rows.select(
        *[(text if c == "text" else F.col(f"_doc.`{c}`")).alias(c) for c in kept], "epoch", "taken"
    )


def taken_words(docs: DataFrame, corpus: DataFrame) -> DataFrame:
    """(doc_id, source, size, epochs, taken): words of `docs` and what of them is in their mix.

    Documents without an id count together for each source.
    """
    keys = ["doc_id", "source"]
    before = docs.groupBy(*keys).agg(F.sum(word_count("text")).alias("size"))
    after = corpus.groupBy(*keys).agg(F.max("epoch").alias("epochs"), F.sum("taken").alias("taken"))
    after = after.withColumnsRenamed({c: f"_{c}" for c in keys})
    joined = before.join(after, [before[c].eqNullSafe(after[f"_{c}"]) for c in keys], "left")
    return joined.select(*keys, "size", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("epochs", "taken")])


def _placed(
    sizes: DataFrame, weights: tuple[int, ...], share: float, most_epochs: int, seed: str
) -> DataFrame:
    """Rows with doc_id, source and size, and how often each is taken whole (_epochs) and in part (_partly).

    A source is gone through by _place, doc_id and size; _nth counts rows alike in these, from 0, and
    _alike is their number.
    """
    sized = checkpointed(sizes.select("doc_id", "source", "size", _place(seed)))
    sources = checkpointed(
        sized.groupBy("source").agg(
            F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")
        )
    )
    rows = sources.agg(F.sum("_rows")).first()[0] or 0
    ranges = max(1, math.isqrt(rows))
    key_start = F.conv(F.substring("_place", 1, 8), 16, 10).cast("long")
    ranged = sized.withColumn("_range", F.shiftright(key_start * ranges, 32))

    same = [F.col("source"), F.col("_range")]
    before = [Window.unboundedPreceding, -1]
    starts = ranged.groupBy(*same).agg(F.sum("size").alias("_sum"))
    over_ranges = Window.partitionBy("source").orderBy("_range").rowsBetween(*before)
    starts = starts.select(*same, _sum_before("_sum", over_ranges).alias("_start"))
    targets = source_targets(sources.drop("_rows"), weights, share, most_epochs)
    starts = _join_source(starts, targets)

    order = ["_place", "doc_id", "size"]
    inside = Window.partitionBy(*same).orderBy(*order)
    counted = ranged.select(
        "*",
        _sum_before("size", inside.rowsBetween(*before)).alias("_inside"),
        (F.row_number().over(inside) - F.rank().over(inside)).alias("_nth"),
        F.count(F.lit(1)).over(Window.partitionBy(*same, *order)).alias("_alike"),
    )
    placed = _join_source(counted, starts, "_range").withColumn(
        "_before", F.col("_start") + F.col("_inside")
    )
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    partly = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return placed.select("*", epochs.cast("long").alias("_epochs"), partly.cast("long").alias("_partly"))


def _ends(placed: DataFrame) -> DataFrame:
    """(source, _epochs, _end): the last row of each source that is taken in part, NULL if none is."""
    end = F.struct("_place", "doc_id", "size", "_nth", "_partly", "_alike")
    return checkpointed(
        placed.groupBy("source").agg(
            F.max("_epochs").alias("_epochs"), F.max(F.when(F.col("_partly") > 0, end)).alias("_end")
        )
    )


def _by_ends(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Add _epochs and _partly to rows with doc_id, source, size, _place and _doc."""
    n, letters, tied = ends.agg(
        F.count(F.lit(1)), F.sum(F.length("source")), F.count_if(F.col("_end._alike") > 1)
    ).first()
    few = n <= MOST_SENT[0] and (letters or 0) <= MOST_SENT[1]
    rows = _join_source(rows, F.broadcast(ends) if few else ends)
    here = F.struct("_place", "doc_id", "size")
    end = F.struct(*[F.col(f"_end.{c}").alias(c) for c in ("_place", "doc_id", "size")])
    at_end = F.col("_end").isNotNull() & (here == end)
    if tied:
        # Only rows alike in all by which they are placed have to meet to be counted.
        met = F.coalesce(at_end & (F.col("_end._alike") > 1), F.lit(False))
        inside = Window.partitionBy("source").orderBy(F.xxhash64("_doc.text"))
        alike = rows.filter(met).withColumn("_nth", F.row_number().over(inside) - 1)
        rows = rows.filter(~met).withColumn("_nth", F.lit(0)).unionByName(alike)
    else:
        rows = rows.withColumn("_nth", F.lit(0))
    last = at_end & (F.col("_nth") == F.col("_end._nth"))
    taken = (here < end) | (at_end & (F.col("_nth") < F.col("_end._nth")))
    partly = F.when(last, F.col("_end._partly")).when(F.col("_end").isNotNull() & taken, F.col("size"))
    return rows.withColumn("_partly", F.coalesce(partly, F.lit(0)).cast("long"))


def _place(seed: str) -> Column:
    """Where a document stands in its source: a keyed hash of its id."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.md5(key.cast("binary")).alias("_place")


def _sum_before(value: str, window) -> Column:
    return F.coalesce(F.sum(value).over(window), F.lit(0)).cast("long")


def _join_source(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    """Join by source, NULL like any other, and by `more`."""
    right = right.withColumnRenamed("source", "_s").withColumnsRenamed({c: f"_r{c}" for c in more})
    on = F.col("source").eqNullSafe(F.col("_s"))
    for c in more:
        on &= F.col(c) == F.col(f"_r{c}")
    return left.join(right, on).drop("_s", *[f"_r{c}" for c in more])
