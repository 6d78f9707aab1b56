"""Links: a collection keyed by URL, with duplicate detection by URL prefix.

A candidate is a duplicate if a stored URL starts with the key of the candidate. A stored login
link is compared by its own key instead, which must equal that of the candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_login_link, link_key
from ..plans.intervals import LEVEL, PIECE, with_interval_pieces, with_point_pieces
from ..plans.scans import running, spread
from ..plans.successors import with_next
from ..session import ensure_checkpoint_dir
from .memos import ADD, DELETE, EDIT, NO_SUCH_DELETE, NO_SUCH_EDIT

DUPLICATED = "url duplicated"

_FIELDS = ("category", "description", "linkimage")


def _with_cuts(urls: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `urls` once per key {key} they could make a duplicate, as column `key`.

    A stored URL is cut to each key length in use, so the prefix test is an equi-join. There are
    at most as many lengths as characters in the longest key.
    """
    lengths = keys.agg(F.collect_set(F.length("key")).alias("lengths")).scalar()
    url = F.col("url")
    short_enough = F.filter("_lengths", lambda n: n <= F.length(url))
    cuts = F.transform(short_enough, lambda n: F.substring(url, F.lit(1), n))
    candidates = F.when(is_login_link(url), F.array(link_key(url))).otherwise(cuts)
    return urls.withColumn("_lengths", lengths).select(*urls.columns, F.explode(candidates).alias("key"))


def _duplicate_keys(candidates: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates with their key, and the keys that are taken.

    A key is the beginning of some stored URL exactly if the least URL that is not below it starts
    with it, so each key and each URL is shuffled once, whatever their lengths. Login links are
    compared by their own keys apart from that.
    """
    keyed = candidates.withColumn("key", link_key(F.col("url")))
    keys = keyed.select("key").distinct()
    is_login = F.coalesce(is_login_link(F.col("url")), F.lit(False))
    own = links.filter(is_login).select(link_key(F.col("url")).alias("key")).distinct()
    above = with_next(keys, "key", links.filter(~is_login).select("url"), "_url")
    begins = above.filter(F.startswith("_url", "key")).select("key")
    return keyed, begins.unionByName(keys.join(own, "key", "left_semi"))


def duplicate_links(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Candidates that duplicate a stored link."""
    keyed, taken = _duplicate_keys(candidates, links)
    return keyed.join(taken, "key", "left_semi").select(*candidates.columns)


def acceptable_links(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Candidates that do not duplicate a stored link."""
    keyed, taken = _duplicate_keys(candidates, links)
    return keyed.join(taken, "key", "left_anti").select(*candidates.columns)


def _reached(succ: DataFrame, roots: DataFrame) -> DataFrame:
    """`seq` of all that the chains {seq, succ} pass when they start at `roots`.

    Pointer doubling: each round doubles the length of the jumps, so a chain of n links takes
    about log2(n) rounds.
    """
    jumps = succ.checkpoint()
    reached = roots.checkpoint()
    while not jumps.isEmpty():
        landed = reached.join(jumps, "seq").select(F.col("succ").alias("seq"))
        reached = reached.unionByName(landed).distinct().checkpoint()
        onward = jumps.select(F.col("seq").alias("succ"), F.col("succ").alias("_beyond"))
        jumps = jumps.join(onward, "succ").select("seq", F.col("_beyond").alias("succ")).checkpoint()
    return reached


def _judge_adds(links: DataFrame, changes: DataFrame) -> DataFrame:
    """`seq` of the adds that are accepted when the changes are applied one by one.

    A URL is present from the change that adds it up to the next one that deletes it. An add is
    refused if a present URL has its key, be it as prefix or as its own key. All URLs with the
    same own key refuse each other, and a URL with another own key refuses an add only if that
    other key extends the key of the add: markers are tried in a fixed order, so a URL that holds
    a key has that key or one found by an earlier marker, which lies further on. So keys are
    settled from the longest to the shortest of each line of nested keys, one round for each
    depth. Within a key the adds that no other key refuses form a chain: the first is accepted,
    then the first one after its delete, and so on; `_reached` follows all chains at once.

    The rounds are bounded by the nesting of keys within one URL and the logarithm of the
    changes of one key, whatever the number of changes. Changes without a URL do nothing.
    """
    spark = links.sparkSession
    ensure_checkpoint_dir(spark)
    last = changes.agg(F.max("seq")).first()[0] or 0
    levels = (last + 1).bit_length()
    never = F.lit(1 << levels).cast("long")
    seq = F.col("seq")

    # The delete that ends each stay: the next one after it, found by scanning backwards.
    deleted = F.when(F.col("kind") == DELETE, seq)
    known = changes.filter(F.col("url").isNotNull())
    moves = known.filter(F.col("kind").isin(ADD, DELETE)).select("seq", "kind", "url")
    moves = moves.withColumns({"own": link_key(F.col("url")), "_back": F.lit(last) - seq})
    until = F.coalesce(F.col("_next") + 1, never)
    moves = running(moves, ["url"], "_back", {"_next": ("min", deleted)})
    moves = moves.withColumn("until", until).drop("_next").checkpoint()
    adds = moves.filter(F.col("kind") == ADD)

    # The depth of a key: how many keys in use it extends.
    keys = adds.select(F.col("own").alias("key")).distinct()
    nested = _with_cuts(keys.select(F.col("key").alias("url")), keys)
    nested = nested.filter(F.col("key") != F.col("url"))
    depths = nested.join(keys, "key", "left_semi").groupBy(F.col("url").alias("own")).agg(
        F.count(F.lit(1)).alias("depth")
    )
    depth = F.coalesce("depth", F.lit(0)).alias("depth")
    moves = moves.join(depths, "own", "left").select(*moves.columns, depth).checkpoint()
    adds = moves.filter(F.col("kind") == ADD)

    # The stays of URLs that were stored, and of those to be added, by each other key they hold.
    first_delete = known.groupBy("url").agg(F.min(deleted).alias("_next"))
    stored = (
        links.select("url")
        .distinct()
        .join(first_delete, "url", "left")
        .select(
            F.lit(-1).cast("long").alias("seq"),
            F.lit(None).cast("string").alias("own"),
            "url",
            F.lit(0).cast("long").alias("since"),
            until.alias("until"),
        )
    )
    added = adds.select("seq", "own", "url", (seq + 1).alias("since"), "until")
    stays = _with_cuts(stored.unionByName(added), keys).filter(~F.col("own").eqNullSafe(F.col("key")))
    stays = with_interval_pieces(
        stays.join(keys, "key", "left_semi").select("seq", "key", "since", "until"),
        F.col("since"),
        F.col("until"),
        F.lit(levels),
    )
    stays = stays.select("seq", "key", LEVEL, PIECE).checkpoint()

    accepted = spark.createDataFrame([], "seq long")
    for d in range(adds.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0], -1, -1):
        present = stays.join(accepted.unionByName(spark.range(-1, 0).toDF("seq")), "seq", "left_semi")
        asked = adds.filter(F.col("depth") == d)
        facing = asked.select("seq", F.col("own").alias("key")).join(
            present.select("key").distinct(), "key", "left_semi"
        )
        pieces = ["key", LEVEL, PIECE]
        points = spread(with_point_pieces(facing, seq, F.sequence(F.lit(0), F.lit(levels))), *pieces)
        met = points.join(spread(present.select(*pieces), *pieces), pieces, "left_semi")
        free = asked.join(met.select("seq").distinct(), "seq", "left_anti").checkpoint()

        # The first free add of the key after each delete; a stay ends just after its delete.
        ends = moves.filter((F.col("depth") == d) & (F.col("kind") == DELETE))
        ends = ends.join(free.select("own").distinct(), "own", "left_semi")
        line = free.select("seq", "kind", "own", "_back").unionByName(
            ends.select("seq", "kind", "own", "_back")
        )
        free_add = F.when(F.col("kind") == ADD, seq)
        turns = running(line, ["own"], "_back", {"succ": ("min", free_add)})
        turns = turns.filter((F.col("kind") == DELETE) & F.col("succ").isNotNull())
        turns = turns.select((seq + 1).alias("until"), "succ")
        succ = free.join(turns, "until").select("seq", "succ")
        roots = free.groupBy("own").agg(F.min("seq").alias("seq")).select("seq")
        accepted = accepted.unionByName(_reached(succ, roots)).checkpoint()
    return accepted


def apply_link_changes(links: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply {seq, kind, url, category, description, linkimage} in the order of `seq`.

    Returns the next links, and the rejected changes with `reason`. Delete and edit need the URL
    to be present, an edit replaces the whole record in its place, an add must not be a
    duplicate and goes to the end. The result is that of applying the changes one by one. URLs
    of `links` are unique; `seq` is dense, unique and not negative.
    """
    accepted = _judge_adds(links, changes).withColumn("_added", F.lit(True))
    kind, seq = F.col("kind"), F.col("seq")
    known = links.select("url").withColumn("_known", F.lit(True))
    staged = changes.join(accepted, "seq", "left")
    staged = running(
        staged,
        ["url"],
        "seq",
        {
            "_last_add": ("max", F.when(F.col("_added"), seq)),
            "_last_delete": ("max", F.when(kind == DELETE, seq)),
        },
    ).join(known, "url", "left")
    since = F.coalesce("_last_add", F.when(F.col("_known"), F.lit(-1)), F.lit(-2))
    present = since > F.coalesce("_last_delete", F.lit(-2))
    done = F.when(kind == ADD, F.coalesce("_added", F.lit(False))).otherwise(present)
    reason = (
        F.when(kind == ADD, F.lit(DUPLICATED))
        .when(kind == DELETE, F.lit(NO_SUCH_DELETE))
        .otherwise(F.lit(NO_SUCH_EDIT))
    )
    rejected = staged.filter(~done).select("seq", "kind", "url", reason.alias("reason"))

    at = lambda wanted: F.when(done & (kind == wanted), seq)
    record = F.struct(*_FIELDS)
    folded = staged.groupBy("url").agg(
        F.max(at(ADD)).alias("_add"),
        F.max_by(record, at(ADD)).alias("_added"),
        F.max(at(DELETE)).alias("_delete"),
        F.max(at(EDIT)).alias("_edit"),
        F.max_by(record, at(EDIT)).alias("_edited"),
    )
    last_pos = links.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("pos")).scalar()
    start = F.coalesce("_add", F.when(F.col("pos").isNotNull(), F.lit(-1)), F.lit(-2))
    merged = (
        links.withColumn("_stored", record)
        .select("pos", "url", "_stored")
        .join(folded, "url", "full")
        .withColumn("_start", start)
        .filter(F.col("_start") > F.coalesce("_delete", F.lit(-2)))
    )
    latest = (
        F.when(F.col("_edit") > F.col("_start"), F.col("_edited"))
        .when(F.col("_start") >= 0, F.col("_added"))
        .otherwise(F.col("_stored"))
    )
    place = F.when(F.col("_start") >= 0, last_pos + 1 + F.col("_start")).otherwise(F.col("pos"))
    after = merged.withColumn("_latest", latest).select(
        place.alias("pos"), "url", *[F.col("_latest")[f].alias(f) for f in _FIELDS]
    )
    return after, rejected
