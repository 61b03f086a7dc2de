"""Isotonic regression of any number of points: the fit's corners are found by Spark, segments between them are fitted in tasks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.operators.statistics import pava
from ledgerlake.plans.registry import query
from ledgerlake.sources.sinks import stored
from ledgerlake.sources.tables import LEDGER_SQL, ledger

#: Segments of up to so many points are fitted in one task.
LOCAL = 65_536


def placed(points: DataFrame) -> DataFrame:
    """points with cn and ct, the sums of n and t up to each x of its group, and the part of the sorted order that holds it.

    Parts are ranges of (g, x), so that a group which holds most points lies in many; only their totals meet in a window.
    """
    d = stored(points.repartitionByRange("g", "x").withColumn("part", F.spark_partition_id()), "points")
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy("g", "part").agg(F.sum("n").alias("pn"), F.sum("t").alias("pt"))
    totals = totals.select("g", "part", F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("pt").over(before), F.lit(0)).alias("t0"))
    within = Window.partitionBy("g", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.join(totals, ["g", "part"])
    return d.select("g", "part", "x", "n", "t", (F.col("n0") + F.sum("n").over(within)).alias("cn"), (F.col("t0") + F.sum("t").over(within)).alias("ct"))


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("x")
    t, n = pdf["t"].to_numpy(np.float64), pdf["n"].to_numpy(np.float64)
    return pdf[["g", "x"]].assign(fit=pava(t / n, n, t))


def isotonic(points: DataFrame, group: str, local: int = LOCAL) -> DataFrame:
    """(group, x, fit) for points (group, x, n, t): the weighted least-squares fit to the means t / n that never falls in x.

    n and t are whole numbers (long), x occurs once in a group. The fit is the slope of the greatest convex curve below the
    running sums (cn, ct). Of a segment with more than local points, the point that lies deepest under the chord is a corner
    of that curve, and the segment is cut there; if none lies under it, the segment is one block. What is left is fitted by
    pooling, one segment a task. Each round cuts all long segments at once, in sums of whole numbers, so the fit is exact.
    Points with a null x or without weight take no part; a null group is a group like others.
    """
    kind, keep = points.schema[group].dataType.simpleString(), ["g", "part", "x", "n", "t", "cn", "ct"]
    rows = points.select(F.struct(F.col(group).alias("k")).alias("g"), "x", F.col("n").cast("long").alias("n"), F.col("t").cast("long").alias("t")).where("x is not null and n > 0")
    x, rows = points.schema["x"].dataType.simpleString(), stored(rows, "rows")
    form = f"g struct<k:{kind}>, x {x}, fit double"
    if (rows.groupBy("g").count().agg(F.max("count")).first()[0] or 0) <= local:  # no group is long
        return rows.groupBy("g").applyInPandas(_fit, form).select(F.col("g.k").alias(group), "x", "fit")
    d, done, blocks = stored(placed(rows).withColumn("seg", F.lit(0).cast("long")), "placed"), [], []
    big, key = lambda c: c.cast("decimal(20,0)"), ["g", "seg", "part"]
    whole = Window.partitionBy("g", "seg")
    while True:
        pieces = d.groupBy(*key).agg(F.count("*").alias("rows"), F.sum("n").alias("n1"), F.sum("t").alias("t1"), F.min(F.struct((F.col("cn") - F.col("n")).alias("cn"), (F.col("ct") - F.col("t")).alias("ct"))).alias("start"))
        pieces = pieces.select(*key, F.sum("rows").over(whole).alias("rows"), F.sum("n1").over(whole).alias("n1"), F.sum("t1").over(whole).alias("t1"), F.min("start").over(whole).alias("start"))
        sized = d.join(pieces, key)
        done.append(sized.where(F.col("rows") <= local).select(*keep, "seg"))
        long = sized.where(F.col("rows") > local)
        depth = big(F.col("ct") - F.col("start.ct")) * big(F.col("n1")) - big(F.col("t1")) * big(F.col("cn") - F.col("start.cn"))
        long = stored(long.select(*keep, "seg", "n1", "t1", depth.alias("depth")), "long")
        if long.isEmpty():
            break
        deepest = long.groupBy(*key).agg(F.min(F.struct("depth", "cn")).alias("low"))
        cut = long.join(deepest.select(*key, F.min("low").over(whole).alias("low")), key)
        under = F.col("low.depth") < 0
        blocks.append(cut.where(~under).select("g", "x", (F.col("t1").cast("double") / F.col("n1")).alias("fit")))
        d = stored(cut.where(under).select(*keep, F.when(F.col("cn") > F.col("low.cn"), F.col("low.cn")).otherwise(F.col("seg")).alias("seg")), "cut")
    short = reduce(DataFrame.unionAll, done).select("g", "seg", "x", "n", "t")
    out = reduce(DataFrame.unionAll, blocks, short.groupBy("g", "seg").applyInPandas(_fit, form))
    return out.select(F.col("g.k").alias(group), "x", "fit")


@query()
def isotonic_labels(spark, sf_dir):
    """M4: isotonic regression of the feature on the label, whose values are nearly all distinct, by half of the accessions; no SQL, since its form is quadratic in them."""
    d = ledger(spark, sf_dir).where("label is not null and feature is not null").select(F.expr("accession % 2").alias("side"), F.round(F.col("label") * 1e7).cast("long").alias("x"), F.round(F.col("feature") * 50).cast("long").alias("v"))
    return isotonic(d.groupBy("side", "x").agg(F.count("*").alias("n"), F.sum("v").alias("t")), "side")


@query(f"""WITH {LEDGER_SQL},
g AS (SELECT chain, feature AS f, count(*) AS n, CAST(sum(CAST(round(label * 10000000) AS BIGINT)) AS BIGINT) AS t FROM ledger GROUP BY ALL),
u AS (SELECT chain, f, sum(n) OVER w AS n, sum(t) OVER w AS t, sum(n) OVER w - n AS n0, sum(t) OVER w - t AS t0 FROM g WINDOW w AS (PARTITION BY chain ORDER BY f ROWS UNBOUNDED PRECEDING)),
m AS (SELECT a.chain, a.f AS a, b.f AS b, CAST(b.t - a.t0 AS DOUBLE) / CAST(b.n - a.n0 AS DOUBLE) AS v FROM u a JOIN u b ON a.chain = b.chain AND a.f <= b.f),
k AS (SELECT m.chain, a, g.f, min(v) AS v FROM m JOIN g ON g.chain = m.chain AND a <= g.f AND g.f <= b GROUP BY ALL)
SELECT chain, f AS feature, round(max(v) / 1e7, 9) AS fit FROM k GROUP BY ALL""")
def isotonic_fit(spark, sf_dir):
    """M4: isotonic regression of the label on the feature, by chain."""
    d = ledger(spark, sf_dir)
    points = d.groupBy("chain", F.col("feature").alias("x")).agg(F.sum(F.round(F.col("label") * 10_000_000).cast("long")).alias("t"), F.count("*").alias("n"))
    return isotonic(points, "chain").select("chain", F.col("x").alias("feature"), F.round(F.col("fit") / 1e7, 9).alias("fit"))
