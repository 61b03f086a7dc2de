"""Ranking, argument minima, first and last wins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators.orderstats import average_ranks, digest_order
from ledgerlake.plans.registry import query
from ledgerlake.sources.tables import load


@query("""SELECT conv_id, arg_min(role, turn) AS first_role, CAST(min(turn) AS BIGINT) AS first_turn, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id""")
def select_record(spark, sf_dir):
    """The earliest and the latest record of a key, as one aggregate instead of a sort."""
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.min("turn").alias("first_turn"), F.max_by("role", "turn").alias("last_role"))


@query("""SELECT c_custkey, sha256('seed' || c_custkey) AS h FROM customer ORDER BY h LIMIT 600""")
def hash_top_n(spark, sf_dir):
    """A deterministic pool of 600 by hash order (the cap is the feature)."""
    return load(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.concat(F.lit("seed"), F.col("c_custkey")), 256).alias("h")).orderBy("h").limit(600)


@query("""SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'A' WHEN s_nationkey < 10 THEN 'B' ELSE 'P' END AS class,
CAST((row_number() OVER (PARTITION BY CASE WHEN s_nationkey < 5 THEN 'A' WHEN s_nationkey < 10 THEN 'B' ELSE 'P' END ORDER BY sha256('' || s_suppkey)) - 1) % 5 AS BIGINT) AS fold FROM supplier""")
def assign_folds(spark, sf_dir):
    """fold = rank in hash order within a class, modulo 5."""
    c = F.when(F.col("s_nationkey") < 5, "A").when(F.col("s_nationkey") < 10, "B").otherwise("P")
    units = load(spark, sf_dir, "supplier").select("s_suppkey", c.alias("class"))
    ranked = digest_order(units, ["class"], F.sha2(F.col("s_suppkey").cast("string"), 256), "s_suppkey")
    return ranked.select("s_suppkey", "class", (F.col("_i") % 5).cast("long").alias("fold"))


@query("""WITH r AS (SELECT s_suppkey, rank() OVER (ORDER BY s_nationkey) + (count(*) OVER (PARTITION BY s_nationkey) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_acctbal) - 1) / 2.0::DOUBLE AS b FROM supplier)
SELECT round(corr(a, b), 9) AS spearman, count(*) AS n FROM r""")
def spearman(spark, sf_dir):
    """Pearson correlation of average ranks, which come from counts of ranges, so that no task sorts all values."""
    s = load(spark, sf_dir, "supplier").select("s_nationkey", "s_acctbal")
    return s.join(average_ranks(s, "s_nationkey", "a"), "s_nationkey").join(average_ranks(s, "s_acctbal", "b"), "s_acctbal").agg(F.round(F.corr("a", "b"), 9).alias("spearman"), F.count("*").alias("n"))


@query("""SELECT user_id, CAST(min(event_id) AS BIGINT) AS first_event, count(DISTINCT props) > 1 AS conflict FROM events GROUP BY user_id""")
def first_wins(spark, sf_dir):
    """The first record of a key stays; records that differ from each other are told."""
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("first_event"), (F.count_distinct("props") > 1).alias("conflict"))


@query("""WITH a AS (SELECT c_custkey AS k, c_acctbal AS v, 0 AS p FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 1 FROM supplier) SELECT k, arg_max(v, p) AS v FROM a GROUP BY k""")
def last_wins(spark, sf_dir):
    """Of two maps, the later one's value wins."""
    a = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(0).alias("p"))
    return a.unionByName(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"), F.lit(1).alias("p"))).groupBy("k").agg(F.max_by("v", "p").alias("v"))


@query("""SELECT user_id, coalesce(arg_min(event_type, event_id) FILTER (event_type IN ('purchase', 'signup')), 'AT_CLOSE') AS bound, coalesce(CAST(min(event_id) FILTER (event_type IN ('purchase', 'signup')) AS BIGINT), -1) AS at FROM events GROUP BY user_id""")
def first_binding(spark, sf_dir):
    """The earliest outcome that isn't deferred binds, else the outcome at the close."""
    binds = F.col("event_type").isin("purchase", "signup")
    g = load(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.when(binds, F.struct("event_id", "event_type"))).alias("m"))
    return g.select("user_id", F.coalesce("m.event_type", F.lit("AT_CLOSE")).alias("bound"), F.coalesce("m.event_id", F.lit(-1)).alias("at"))
