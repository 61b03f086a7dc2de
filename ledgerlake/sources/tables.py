"""Tables, and the ledger that the evaluation operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six bins of the feature, half-open, and its top edge.
BINS = ((0.0, 50.0), (50.0, 60.0), (60.0, 70.0), (70.0, 80.0), (80.0, 90.0), (90.0, 100.01))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PART = 1_000_000  # rows of a part, about


def parts_of(df: DataFrame) -> int:
    """As many parts as keep all cores busy, each of bounded size; a number that is given to repartition is not coalesced."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(accession, entry, chain, pos, feature, label, channel_a, channel_b), a row a residue-like measurement."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("accession"), F.col("l_orderkey").alias("entry"), F.col("l_returnflag").alias("chain"), F.col("l_linenumber").alias("pos"),
        (F.col("l_quantity") * 2).alias("feature"), (F.col("l_extendedprice") / 100000).alias("label"), F.col("l_tax").alias("channel_a"), F.col("l_discount").alias("channel_b"),
    )


def bins(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *b) for i, b in enumerate(BINS)], "bin int, lo double, hi double")


#: The ledger and the bins for oracle SQL, to follow WITH.
LEDGER_SQL = "ledger AS (SELECT l_suppkey AS accession, l_orderkey AS entry, l_returnflag AS chain, l_linenumber AS pos, l_quantity * 2 AS feature, l_extendedprice / 100000 AS label, l_tax AS channel_a, l_discount AS channel_b FROM lineitem)"
BINS_SQL = "bins(bin, lo, hi) AS (VALUES " + ", ".join(f"({i}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for i, (a, b) in enumerate(BINS)) + ")"
