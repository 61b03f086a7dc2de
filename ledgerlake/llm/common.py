"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side is broadcast only if a count made beforehand puts it under this many bytes.
BROADCAST_BYTES = 32 << 20
#: Rows of one key that a shuffled join leaves in one task.
HOT = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in local mode, where that may be unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-ledgerlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie; cleanup() deletes it as a whole."""
    return f"{shared_dir(spark)}/intermediate-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete what written() made, once nothing reads it any more."""
    if path := getattr(df, "written_path", None):
        _delete(df.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are stored elsewhere."""
    _delete(spark, run_dir(spark))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more; it does so when the driver's JVM collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def sized(df: DataFrame, n_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if n_bytes, measured by the caller, is under the limit; else Spark shuffles and splits skew."""
    return F.broadcast(df) if n_bytes <= limit else df


def skewed_left(rows: DataFrame, side: DataFrame, key: str, side_bytes: int, hot: int = HOT) -> DataFrame:
    """rows left join side, which has one row a key; a key may hold any share of rows, equal ones too.

    A side of a measured size under the limit is broadcast. Else keys with more than hot rows are counted first (there
    are at most rows / hot of them); their rows are dealt over as many tasks as they need by their place in the input, and the side's row goes to each.
    """
    if side_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(side), key, "left")
    many = written(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot), "hot")
    if not (n := many.count()):
        return rows.join(side, key, "left")
    pieces = F.coalesce(F.ceil(F.col("_n") / hot).cast("int"), F.lit(1))
    many = sized(many, n * 96)
    dealt = rows.withColumn("_nth", F.monotonically_increasing_id()).join(many, key, "left")
    dealt = dealt.withColumn("_salt", F.when(pieces > 1, F.pmod("_nth", pieces)).otherwise(0).cast("int")).drop("_nth")
    each = side.join(many, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return dealt.drop("_n").join(each.drop("_n"), [key, "_salt"], "left").drop("_salt")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; lower() is the same, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
