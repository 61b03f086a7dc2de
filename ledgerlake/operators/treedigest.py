"""Tree digests: two versions of a table are compared by reading only the ranges of keys that differ.

Keys are hashed, and a range is a run of hashes, so that any keys fall evenly and both versions are cut alike without a
word between them. The rows lie in a directory a range. A range's digest is the number of its rows and the sum of their
60 bits, partial in every task; a node's is the SHA-256 of its sixteen children in order. A comparison goes down from the
root, where it looks only below nodes that differ, and then reads the directories of the leaves it arrives at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerlake.plans.registry import query
from ledgerlake.sources.checkpoints import DIFFERS, CheckpointError, row_bits, write_once
from ledgerlake.sources.sinks import shared_path
from ledgerlake.sources.tables import load

RANGES, FAN = 4096, 4  # directories; bits a level
NODES = "level int, node int, n long, digest string"
RANGE = "key_range"


def depth(ranges: int) -> int:
    levels = ((ranges - 1).bit_length() + FAN - 1) // FAN
    if ranges != 1 << FAN * levels or ranges > RANGES:
        raise ValueError(f"{ranges} ranges: a power of {1 << FAN}, {RANGES} at most")
    return levels


def range_of(keys: list[str], ranges: int) -> Column:
    """The range of a row's key: equal keys share one, nulls among them are keys too."""
    return (row_bits(keys) % ranges).cast("int")


def leaves(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with their range to (node, n, digest), a row a range."""
    g = rows.select(RANGE, row_bits(columns).alias("bits")).groupBy(F.col(RANGE).alias("node")).agg(F.count("*").alias("n"), F.sum("bits").alias("total"))
    return g.select("node", "n", F.concat_ws(":", F.col("n"), F.col("total")).alias("digest"))


def write_tree(df: DataFrame, keys: list[str], path: str, ranges: int = RANGES) -> str:
    """Write rows and nodes, both once; returns the root's digest. Rows of one range may take several tasks, unless they are equal."""
    spark, levels, columns = df.sparkSession, depth(ranges), df.columns
    if RANGE in columns:
        raise ValueError(f"a column is named {RANGE}")
    rows = df.withColumn(RANGE, range_of(keys, ranges)).repartitionByRange(RANGE, F.xxhash64(*[F.col(f"`{c}`") for c in columns])).sortWithinPartitions(RANGE)
    write_once(rows, f"{path}/rows", [RANGE])
    level = leaves(read_ranges(spark, path, df.schema), columns).withColumn("level", F.lit(0)).select("level", "node", "n", "digest")
    tree = level
    for k in range(1, levels + 1):
        children = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: F.concat_ws("=", c["node"], c["digest"]))
        level = level.groupBy(F.shiftright("node", FAN).alias("node")).agg(F.sum("n").alias("n"), F.sha2(F.concat_ws(",", children), 256).alias("digest"))
        level = level.select(F.lit(k).alias("level"), "node", "n", "digest")
        tree = tree.unionByName(level)
    write_once(tree.coalesce(1), f"{path}/nodes")
    return root(spark, path)


def nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODES).parquet(f"{path}/nodes")


def root(spark: SparkSession, path: str) -> str:
    """The digest of the whole table; that of an empty one is empty."""
    top = nodes(spark, path).orderBy(F.desc("level")).select("digest").first()
    return top.digest if top else ""


def read_ranges(spark: SparkSession, path: str, schema: StructType, only: list[int] | None = None) -> DataFrame:
    """Rows with their range; of some ranges only, where named: the other directories are pruned."""
    rows = spark.read.schema(StructType([*schema.fields, StructField(RANGE, IntegerType())])).parquet(f"{path}/rows")
    return rows if only is None else rows.where(F.col(RANGE).isin(only))


def differing(spark: SparkSession, a: str, b: str, ranges: int = RANGES) -> list[int]:
    """The ranges whose digests differ, RANGES at most, found from the root downwards."""
    suspects: list[int] | None = None
    for k in range(depth(ranges), -1, -1):
        x, y = (nodes(spark, p).where(F.col("level") == k).select("node", F.col("digest").alias(n)) for p, n in ((a, "x"), (b, "y")))
        both = x.join(y, "node", "full_outer")
        if suspects is not None:
            both = both.where(F.shiftright("node", FAN).isin(suspects))
        suspects = sorted(r.node for r in both.where("not (x <=> y)").select("node").collect())
        if not suspects:
            return []
    return suspects


def changes(spark: SparkSession, a: str, b: str, keys: list[str], schema: StructType, ranges: int = RANGES) -> DataFrame:
    """(*keys, kind) of the keys whose rows differ: only_a, only_b or changed; rows of a key are compared as a multiset."""
    only = differing(spark, a, b, ranges)
    side = lambda p, s: read_ranges(spark, p, schema, only).select(*keys, F.lit(s).alias("side"), row_bits(schema.names).alias("bits"))
    of = lambda s: F.sum(F.when(F.col("side") == s, F.col("bits")))
    n = lambda s: F.count_if(F.col("side") == s)
    g = side(a, "a").unionByName(side(b, "b")).groupBy(*keys).agg(n("a").alias("na"), n("b").alias("nb"), of("a").alias("xa"), of("b").alias("xb"))
    kind = F.when(F.col("nb") == 0, "only_a").when(F.col("na") == 0, "only_b").otherwise("changed")
    return g.where((F.col("na") != F.col("nb")) | ~F.col("xa").eqNullSafe(F.col("xb"))).select(*keys, kind.alias("kind"))


def verified(spark: SparkSession, path: str, schema: StructType, only: list[int] | None = None) -> DataFrame:
    """Q1: the rows, of some ranges where named, once their digests agree with the nodes; else a typed refusal that names ranges."""
    rows = read_ranges(spark, path, schema, only)
    told = nodes(spark, path).where("level = 0").select("node", F.col("digest").alias("told"))
    told = told if only is None else told.where(F.col("node").isin(only))
    wrong = leaves(rows, schema.names).join(told, "node", "full_outer").where("not (digest <=> told)").select("node").collect()
    if wrong:
        raise CheckpointError(DIFFERS, f"{path}: ranges {sorted(r.node for r in wrong)}")
    return rows.drop(RANGE)


_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


@query(f"""WITH a AS (SELECT l_orderkey, l_linenumber, {_CENTS} AS cents, count(*) AS n FROM lineitem GROUP BY ALL),
b AS (SELECT CASE WHEN l_orderkey % 997 = 5 THEN -l_orderkey ELSE l_orderkey END AS l_orderkey, l_linenumber, {_CENTS} + CASE WHEN l_orderkey % 499 = 7 THEN 1 ELSE 0 END AS cents, count(*) AS n FROM lineitem WHERE l_orderkey % 701 <> 3 GROUP BY ALL),
d AS (SELECT l_orderkey, l_linenumber FROM a FULL JOIN b USING (l_orderkey, l_linenumber, cents) WHERE a.n IS DISTINCT FROM b.n)
SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM b) THEN 'only_a' WHEN (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM a) THEN 'only_b' ELSE 'changed' END AS kind FROM d""")
def tree_changes(spark, sf_dir):
    """Lines of an old and a new transform, written as trees; what differs is found by their nodes and read by range."""
    old = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    order = F.col("l_orderkey")
    new = old.where(order % 701 != 3).withColumn("cents", F.col("cents") + F.when(order % 499 == 7, 1).otherwise(0)).withColumn("l_orderkey", F.when(order % 997 == 5, -order).otherwise(order))
    keys, a, b = ["l_orderkey", "l_linenumber"], shared_path(spark, "old"), shared_path(spark, "new")
    write_tree(old, keys, a, 256)
    write_tree(new.select(old.columns), keys, b, 256)
    return changes(spark, a, b, keys, old.schema, 256)
