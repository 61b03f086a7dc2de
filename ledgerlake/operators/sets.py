"""Set and multiset operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.plans.registry import query
from ledgerlake.sources.tables import load


@query("""SELECT 'union_all' AS op, (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS n
UNION ALL SELECT 'union', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)
UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'duplicates', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'multiset_difference', count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer)""")
def roster_sets(spark, sf_dir):
    """Rosters of customers as sets and as multisets, all in one pass of counts by key."""
    a = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    g = a.unionByName(b).groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b = F.col("a"), F.col("b")
    found = {"union_all": F.sum(a + b), "union": F.count("*"), "intersect": F.count_if((a > 0) & (b > 0)), "except": F.count_if((a == 0) & (b > 0)), "duplicates": F.count_if(a > 1), "multiset_difference": F.sum(F.greatest(a - b, F.lit(0)))}
    return g.agg(*[v.alias(k) for k, v in found.items()]).select(F.explode(F.array(*[F.struct(F.lit(k).alias("op"), F.col(k).alias("n")) for k in found])).alias("x")).select("x.op", "x.n")


def refuse_duplicates(rows, key: str):
    """Rows as they are, or an error that names a key that occurs more than once; a duplicate is never made distinct in silence."""
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    bad = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate key: "), F.col(key).cast("string"))))
    return rows.join(n.select(key, F.coalesce(bad.cast("string"), F.lit("")).alias("_ok")), key).where("_ok = ''").drop("_ok")


@query("SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY c_nationkey")
def canonical_keys(spark, sf_dir):
    """A roster whose keys must be distinct, checked before it is counted."""
    return refuse_duplicates(load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
