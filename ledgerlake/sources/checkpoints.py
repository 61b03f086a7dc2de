"""Batch checkpoints: write-once tables with a digest of their content, read again in batch order and verified."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: The codes of a refusal.
EXISTS, MISSING, DIFFERS, OPEN, NOT_FROZEN = "E422_CHECKPOINT_EXISTS", "E422_CHECKPOINT_MISSING", "E422_CHECKPOINT_DIGEST_MISMATCH", "E422_WINDOW_OPEN", "E422_FREEZE_MISSING"
RECEIPT = "batch_index int, n_rows long, digest string"


class CheckpointError(ValueError):
    """A typed refusal: code and detail."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code, self.detail = code, detail


def row_bits(columns: list[str]) -> Column:
    """60 bits of the SHA-256 of a row, over columns sorted by name."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")


def content_digest(df: DataFrame) -> str:
    """A digest of the rows, whatever their order: their number and the sum of 60 bits of each row's SHA-256, over columns sorted by name."""
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(row_bits(df.columns)), F.lit(0).cast("decimal(38,0)"))).first()
    return f"{n}:{int(total):x}"


def write_once(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """K1, K2: a new table, committed as a whole, in directories by columns where named; one that is there is never replaced."""
    try:
        df.write.mode("errorifexists").parquet(path, partitionBy=by)
    except AnalysisException as e:
        if e.getCondition() == "PATH_ALREADY_EXISTS":
            raise CheckpointError(EXISTS, path) from e
        raise


def write_batch(rows: DataFrame, root: str, batch: int, exclusions: DataFrame | None = None) -> str:
    """K2: rows and exclusions of a batch, then its receipt; a batch without a receipt counts as not written."""
    spark = rows.sparkSession
    write_once(rows, f"{root}/rows/batch_index={batch}")
    if exclusions is not None:
        write_once(exclusions, f"{root}/exclusions/batch_index={batch}")
    stored = spark.read.schema(rows.schema).parquet(f"{root}/rows/batch_index={batch}")
    digest = content_digest(stored)
    write_once(spark.createDataFrame([(batch, int(digest.partition(":")[0]), digest)], RECEIPT), f"{root}/receipts/batch_index={batch}")
    return digest


def receipts(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(RECEIPT).parquet(f"{root}/receipts")


def cumulative(spark: SparkSession, root: str, through: int, schema: StructType) -> DataFrame:
    """Rows of batches 1 to through, each checked against its receipt; a batch that is missing or differs is an error, never an empty part."""
    told = {r.batch_index: r.digest for r in receipts(spark, root).where(F.col("batch_index") <= through).collect()}
    if missing := [k for k in range(1, through + 1) if k not in told]:
        raise CheckpointError(MISSING, f"batches {missing}")
    for k in range(1, through + 1):
        if content_digest(spark.read.schema(schema).parquet(f"{root}/rows/batch_index={k}")) != told[k]:
            raise CheckpointError(DIFFERS, f"batch {k}")
    with_batch = StructType([*schema.fields, StructField("batch_index", IntegerType())])
    return spark.read.schema(with_batch).parquet(f"{root}/rows").where(F.col("batch_index") <= through)


def close_window(now: str, close: str, batch: int) -> None:
    """A batch is refused before its window closes; there is no path for late rows."""
    if now <= close:
        raise CheckpointError(OPEN, f"batch {batch} closes at {close}")


def freeze(df: DataFrame, root: str, name: str) -> str:
    """K3, H3: a table and the digest that later steps demand."""
    spark, digest = df.sparkSession, content_digest(df)
    write_once(df, f"{root}/frozen/{name}/table")
    write_once(spark.createDataFrame([(name, digest)], "name string, digest string"), f"{root}/frozen/{name}/receipt")
    return digest


def frozen(spark: SparkSession, root: str, name: str, schema: StructType) -> DataFrame:
    """The frozen table, if its receipt is there and its content has not changed: what must precede labels, precedes them."""
    try:
        told = spark.read.schema("name string, digest string").parquet(f"{root}/frozen/{name}/receipt").first()
    except AnalysisException as e:
        raise CheckpointError(NOT_FROZEN, name) from e
    table = spark.read.schema(schema).parquet(f"{root}/frozen/{name}/table")
    if told is None or content_digest(table) != told.digest:
        raise CheckpointError(DIFFERS, name)
    return table


def accepted(old: DataFrame, stored: DataFrame, new: DataFrame) -> DataFrame:
    """The new result, once the old transform has reproduced what is stored."""
    if content_digest(old) != content_digest(stored):
        raise CheckpointError(DIFFERS, "the old transform does not reproduce the stored result")
    return new
