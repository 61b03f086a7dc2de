"""Connected components by random contraction: a few rounds of joins, no group ever gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) bigint pairs to (node, label): one label a component; nodes without an edge don't occur.

    Each round draws a priority for every node from its hash and the round's number; a node moves to its neighbour of
    least priority, if that is less than its own. Edges follow their ends; the number of nodes shrinks by a constant
    factor a round in expectation, whatever the shape (chains and stars alike). The minimum is a partial aggregate and
    joins split skewed keys, so a node with very many neighbours is no hot task.
    """
    rank = lambda c, n: F.xxhash64(c, F.lit(n))
    tidy = lambda e: e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, moves, n = written(tidy(edges), "edges"), [], 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(rank("b", n).alias("rank"), F.col("b").alias("to"))).alias("m"))
        move = written(best.select("node", F.when(F.col("m.rank") < rank("node", n), F.col("m.to")).otherwise(F.col("node")).alias("to")), "moves")
        ends = edges.join(move.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").join(move.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        after = written(tidy(ends.select(F.col("a2").alias("a"), F.col("b2").alias("b"))), "edges")
        discard(edges)
        edges, n = after, n + 1
        moves.append(move)
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = moves[0].select("node", F.col("to").alias("label"))
    for m in moves[1:]:
        out = out.join(m.select(F.col("node").alias("label"), F.col("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    out = written(out, "labels")
    for m in moves:
        discard(m)
    return out
