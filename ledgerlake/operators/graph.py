"""Connected components over edges, by stars that contract in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.alignment import aligned_edges
from ledgerlake.operators.joins import _PAIRS, _ROSTER, JACCARD, roster, similar
from ledgerlake.plans.registry import query
from ledgerlake.sources.sinks import stored


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, root): root is the least node that can be reached; nodes without an edge to another don't occur.

    Large and small stars alternate until nothing changes. Minima are partial aggregates, and a hub's edges are joined
    to its minimum, never gathered. Each round is written, so that plans don't grow.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen, now = None, mark(e)
    while now != seen:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.withColumnRenamed("m", "b")).distinct()
        e = stored(e, "edges")
        seen, now = now, mark(e)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


@query(f"""WITH RECURSIVE {_ROSTER}, {_PAIRS},
e AS (SELECT a, b FROM p JOIN n x ON x.unit = a JOIN n y ON y.unit = b WHERE shared >= CAST({JACCARD} AS DOUBLE) * (x.n + y.n - shared)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, root) AS (SELECT unit, unit FROM ro UNION SELECT e2.b, r.root FROM r JOIN e2 ON e2.a = r.node)
SELECT node AS unit, min(root) AS group_id FROM r GROUP BY node""")
def homology_groups(spark, sf_dir):
    """Groups of units that a local alignment links; the id is the least member, a unit without a partner is its own group.

    Only similar pairs are aligned, and a pair too large for the rule stops the query. The SQL has no alignment and takes
    every similar pair for an edge: it finds the same groups only where all of them align over 100 columns, as at sf0.001
    and sf0.01. At sf0.1 it joins units 104 and 116, which align over 47; tests hold groups_of() against alignments by hand.
    """
    return groups_of(roster(spark, sf_dir))


def groups_of(units: DataFrame, oversized: str = "refuse") -> DataFrame:
    """(unit, seq) to (unit, group_id); with oversized "tell" also refused, how many alignments of the unit were too large to be made."""
    seq = lambda n: units.select(F.col("unit").alias(n), F.col("seq").alias(f"seq_{n}"))
    pairs = stored(similar(units).select("a", "b").join(seq("a"), "a").join(seq("b"), "b").repartition("a", "b"), "pairs")
    edges = stored(aligned_edges(pairs, oversized), "aligned")
    found = components(edges.where("edge").select("a", "b"))
    out = units.join(found.withColumnRenamed("node", "unit"), "unit", "left").select("unit", F.coalesce("root", "unit").alias("group_id"))
    if oversized == "tell":
        large = edges.where("too_large").select(F.explode(F.array("a", "b")).alias("unit")).groupBy("unit").agg(F.count("*").alias("refused"))
        out = out.join(large, "unit", "left").fillna(0, ["refused"])
    return out
