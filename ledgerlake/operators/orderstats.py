"""Exact ranks without a task that sorts a whole group.

Values fall into ranges by a rule that keeps their order; a task sorts one range, and counts of the ranges before it, which
are few, tell what to add.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.sources.sinks import stored

#: Values of a group that one task may hold, ranges that a pass cuts a larger group's into, groups that are broadcast at most.
LOCAL, CELLS, BROADCAST_GROUPS = 1 << 16, 1024, 100_000


def average_ranks(rows: DataFrame, value: str, out: str) -> DataFrame:
    """(value, out): the rank of each distinct value among all rows, ties sharing their mean; nulls have none.

    Ranges are cut at sampled quantiles of the distinct values, so that no outlier spoils them, and written with their
    number, so that a task that is run again cannot number them otherwise.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    placed = stored(n.repartitionByRange(parts, value).withColumn("_r", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("_r").agg(F.sum("_n").alias("_m"))
    counts = counts.select("_r", (F.sum("_m").over(Window.orderBy("_r")) - F.col("_m")).alias("_before"))  # a row a range
    upto = F.sum("_n").over(Window.partitionBy("_r").orderBy(value)) + F.col("_before")
    return placed.join(F.broadcast(counts), "_r").select(value, (upto - (F.col("_n") - 1) / 2).alias(out))


def digest_order(rows: DataFrame, by: list[str], digest: Column, tie: str) -> DataFrame:
    """rows with _i, their place from 0 in the order of a hex digest within the group, and the group's size _n.

    The digest's first two digits are the range: they are as good as uniform.
    """
    keyed = rows.withColumn("_d", digest).withColumn("_r", F.substring("_d", 1, 2))
    within = Window.partitionBy(by)
    counts = keyed.groupBy(*by, "_r").agg(F.count("*").alias("_m"))
    counts = counts.select(*by, "_r", F.sum("_m").over(within).alias("_n"), (F.sum("_m").over(within.orderBy("_r")) - F.col("_m")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*by, "_r").orderBy("_d", tie)) - 1 + F.col("_before")
    return keyed.join(counts, [*by, "_r"]).select(*rows.columns, place.alias("_i"), "_n")


def places(rows: DataFrame, *order: Column | str, out: str = "_i") -> DataFrame:
    """rows with their place from 0 in the order, which should tell all rows apart.

    Ranges of the order are sorted each in its task and written with monotonically_increasing_id(), which holds range and
    place; a count a range reaches the driver.
    """
    spark = rows.sparkSession
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "places")
    n, before = 0, []
    for r, m in sorted(tuple(x) for x in placed.groupBy(F.shiftright("_at", 33)).count().collect()):
        before.append((r, n))
        n += m
    before = F.broadcast(spark.createDataFrame(before, "_r long, _before long"))
    return placed.join(before, F.shiftright("_at", 33) == F.col("_r")).select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(out))


def _matched(rows: DataFrame, groups: DataFrame, by: list[str], n: int, how: str = "inner") -> DataFrame:
    """rows joined with a few groups, null keys included."""
    keyed = groups.withColumnsRenamed({c: f"_by_{c}" for c in by})  # by name: both sides may stem from one table
    on = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return rows.join(F.broadcast(keyed) if n <= BROADCAST_GROUPS else keyed, on, how).drop(*[f"_by_{c}" for c in by])


def narrowed(rows: DataFrame, by: list[str], targets: DataFrame, local: int) -> DataFrame:
    """targets (*by, t, k, low, high, n): the k-th least of n values between low and high; to ranges of local values or one.

    A pass counts, for the groups whose ranges are still too wide, the values of CELLS parts of each range, partially in
    every task, and goes on with the part that holds the k-th. Ends of a part are values that occur in it, so every pass
    leaves a part with fewer distinct values, whatever their distribution.
    """
    while True:
        wide = (F.col("n") > local) & (F.col("low") < F.col("high"))
        n_open = targets.where(wide).select(by).distinct().count()
        if not n_open:
            return targets
        inside = _matched(rows, targets.where(wide), by, n_open).where(F.col("_v").between(F.col("low"), F.col("high")))
        cell = F.least(F.floor((F.col("_v") - F.col("low")) / (F.col("high") - F.col("low")) * CELLS), F.lit(CELLS - 1))
        parts = inside.groupBy(*by, "t", "k", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        parts = parts.withColumn("upto", F.sum("n").over(Window.partitionBy(*by, "t").orderBy("cell")))  # CELLS rows at most
        hit = parts.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
        hit = hit.select(*by, "t", (F.col("k") - F.col("upto") + F.col("n")).alias("k"), "low", "high", "n")
        targets = stored(targets.where(~wide).unionByName(hit), "targets")


def finite(value: str) -> Column:
    v = F.col(value).cast("double")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(odd, F.raise_error(F.lit("quantiles of values that are not finite")).cast("double")).otherwise(v)


def medians(rows: DataFrame, by: list[str], values: dict[str, str], local: int | None = None) -> DataFrame:
    """(*by, *values): the medians of several columns, named by values; as quantiles() has them, in one pass where no group is large."""
    most = rows.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    if most <= (LOCAL if local is None else local):
        return rows.groupBy(by).agg(*[F.percentile(finite(v), F.lit(0.5)).alias(k) for k, v in values.items()])
    each = [quantiles(rows, by, v, [0.5], k, local).withColumn(k, F.col(k)[0]) for k, v in values.items()]
    out = each[0]
    for more in each[1:]:
        right = more.withColumnsRenamed({c: f"_by_{c}" for c in by})
        out = out.join(right, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]).drop(*[f"_by_{c}" for c in by])
    return out


def quantiles(rows: DataFrame, by: list[str], value: str, probs: list[float], out: str = "q", local: int | None = None) -> DataFrame:
    """(*by, out): interpolated quantiles of each group's values as an array, null where it has none.

    Groups of at most local values finish in a task; larger ones, however few hold all rows, narrow a range for each rank
    they need, and only a range's values meet in a task. Null values take no part, values that are not finite are refused.
    """
    local = LOCAL if local is None else local
    held = rows.select(*by, finite(value).alias("_v"))
    counts = held.groupBy(by).agg(F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    large = stored(counts.where(F.col("n") > local), "large")
    n_large = large.count()
    exact = F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias(out)
    if not n_large:
        return held.groupBy(by).agg(exact)
    small = _matched(held, large.select(by), by, n_large, "left_anti").groupBy(by).agg(exact)
    rows_of = _matched(held.where("_v is not null"), large.select(by), by, n_large)
    place = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ranks = F.array(*[F.struct(F.lit(2 * i + j).alias("t"), (f(x) + 1).alias("k")) for i, x in enumerate(place) for j, f in enumerate((F.floor, F.ceil))])
    targets = stored(large.select(*by, "low", "high", "n", F.explode(ranks).alias("r")).select(*by, "r.t", "r.k", "low", "high", "n"), "targets")
    targets = narrowed(rows_of, by, targets, local)
    inside = _matched(rows_of, targets.where("low < high"), by, n_large).where(F.col("_v").between(F.col("low"), F.col("high")))
    nth = inside.withColumn("i", F.row_number().over(Window.partitionBy(*by, "t").orderBy("_v"))).where("i = k").select(*by, "t", "_v")
    found = nth.unionByName(targets.where("low = high").select(*by, "t", F.col("low").alias("_v")))
    found = found.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("t", "_v"))).alias("_at"))
    found = _matched(found, large.select(*by, "n"), by, n_large)
    between = [F.when(F.floor(x) == F.ceil(x), F.col("_at")[2 * i]).otherwise((F.ceil(x) - x) * F.col("_at")[2 * i] + (x - F.floor(x)) * F.col("_at")[2 * i + 1]) for i, x in enumerate(place)]
    return small.unionByName(found.select(*by, F.array(*between).alias(out)))
