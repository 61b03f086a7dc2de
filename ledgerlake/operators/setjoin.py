"""Exact similarity join of sets at low thresholds, where a prefix alone keeps nearly every element.

Elements are ordered from rare to common. `after` is how many elements of a set lie at or after one in that order; where
two sets meet first, the lesser `after` bounds what they share. So a posting (element, set) is told apart by what it may
still find:

- positions: a meeting counts only if the bound reaches the threshold for the sizes of both sets; the smaller set of a
  pair keeps a shorter prefix than the larger one, since the union holds the larger.
- sizes: a set's bucket is the logarithm of its size to a base above 1 / least, so that partners lie in its own bucket
  or the next; the larger set looks into both, and others never meet.
- hot elements: holders in a bucket are dealt as pairs of blocks of about `cell` postings, so that no task holds them all.

Every pair with a first meeting that passes is compared whole. Nothing is lost: the first common element of a pair that
is similar enough passes all three.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.sources.sinks import stored

CELL, SALTS, MARGIN = 2000, 64, 1.01
MODES = ("jaccard", "shared")


def _enough(shared: Column, n_a: Column, n_b: Column, least: float, mode: str) -> Column:
    """Whether so many shared elements suffice; rises with them, so that a bound may stand for them."""
    return shared >= F.lit(least) * (n_a + n_b - shared) if mode == "jaccard" else shared >= F.lit(least)


def postings(sets: DataFrame, least: float, mode: str) -> DataFrame:
    """(unit, elements) to (g, unit, n, after, bucket, short), the postings that may be a first meeting.

    `short` tells those that may be one for the smaller set of a pair. Frequencies are counted by element and salt, and
    meet the postings by both, so that a frequent element is nowhere one task's.
    """
    salt = F.pmod(F.xxhash64("unit"), F.lit(SALTS)).cast("int")
    each = sets.select("unit", F.size("elements").alias("n"), F.explode("elements").alias("g")).withColumn("salt", salt)
    counted = each.groupBy("g", "salt").agg(F.count("*").alias("c"))
    common = counted.withColumn("df", F.expr("sum(c) over (partition by g)")).where("df > 1").drop("c")
    placed = each.join(common, ["g", "salt"]).withColumn("after", F.expr("row_number() over (partition by unit order by df desc, g)"))
    n, after = F.col("n"), F.col("after")
    bucket = F.floor(F.ln("n") / log(MARGIN / least)).cast("int") if mode == "jaccard" else F.lit(0)
    kept = placed.where(after >= F.lit(least) * (n if mode == "jaccard" else 1))
    return kept.select("g", "unit", "n", "after", bucket.alias("bucket"), _enough(after, n, n, least, mode).alias("short"))


def dealt(posts: DataFrame, mode: str, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """Postings of smaller and of larger sets by (g, bucket, i, j), where each two that should meet do so once."""
    look = F.array("bucket", F.col("bucket") - 1) if mode == "jaccard" else F.array("bucket")
    short = posts.where("short").select("g", "bucket", "unit", "n", "after")
    long = posts.select("g", F.explode(look).alias("bucket"), "unit", "n", "after")
    tally = short.select("g", "bucket", F.lit(1).alias("s"), F.lit(0).alias("l")).unionByName(long.select("g", "bucket", F.lit(0).alias("s"), F.lit(1).alias("l")))
    tally = tally.groupBy("g", "bucket").agg(F.sum("s").alias("s"), F.sum("l").alias("l")).where(F.greatest("s", "l") > cell)
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / cell).cast("int"), F.lit(1))  # noqa: E731  # a side without postings leaves the other in blocks
    hot = tally.select("g", "bucket", blocks("s").alias("rows"), blocks("l").alias("columns"))
    hot = stored(hot.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "hot")
    one = F.lit(1)

    def spread(side: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        met = side.withColumn("salt", F.pmod(F.xxhash64("unit"), F.lit(SALTS)).cast("int")).join(hot, ["g", "bucket", "salt"], "left")
        mine = F.pmod(F.xxhash64(F.lit(7), "unit"), F.coalesce(own, one)).cast("int")
        return met.select("g", "bucket", mine.alias(names[0]), F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1)).alias(names[1]), "unit", "n", "after")

    return spread(short, "rows", "columns", ("i", "j")), spread(long, "columns", "rows", ("j", "i"))


def candidates(sets: DataFrame, least: float, mode: str, cell: int = CELL) -> DataFrame:
    """(unit, elements) to distinct pairs (x, y), the smaller set first, that may be similar enough."""
    short, long = dealt(stored(postings(sets, least, mode), "postings"), mode, cell)
    x = short.select("g", "bucket", "i", "j", F.col("unit").alias("x"), F.col("n").alias("nx"), F.col("after").alias("ax"))
    y = long.select("g", "bucket", "i", "j", F.col("unit").alias("y"), F.col("n").alias("ny"), F.col("after").alias("ay"))
    smaller = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    passes = _enough(F.least("ax", "ay"), F.col("nx"), F.col("ny"), least, mode)
    return x.join(y, ["g", "bucket", "i", "j"]).where(smaller & passes).select("x", "y").distinct()


def similar_sets(sets: DataFrame, least: float, mode: str = "jaccard", cell: int = CELL) -> DataFrame:
    """(unit, elements) to (a, b, shared, score), a < b: all pairs whose Jaccard similarity, or in mode shared the number of shared elements, is at least so much.

    Units are distinct, elements of a set too. Null units, null and empty sets are in no pair; null elements count as
    none; an empty table gives no pairs.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}")
    if not (0 < least <= 1 if mode == "jaccard" else least >= 1):
        raise ValueError(f"least {least!r}: pairs that share nothing are not listed")
    sets = sets.select("unit", F.array_compact("elements").alias("elements")).where("unit is not null and size(elements) > 0")
    found = candidates(sets, least, mode, cell).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    whole = lambda name: sets.select(F.col("unit").alias(name), F.col("elements").alias(f"of_{name}"))
    p = found.join(whole("a"), "a").join(whole("b"), "b").select("a", "b", F.size("of_a").alias("na"), F.size("of_b").alias("nb"), F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("shared"))
    score = F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 9) if mode == "jaccard" else F.col("shared").cast("double")
    return p.where(_enough(F.col("shared"), F.col("na"), F.col("nb"), least, mode)).select("a", "b", "shared", score.alias("score"))
