"""The corpus pipeline: five stages from raw documents to token ids, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. Rows whose id and text agree share their fate.

Cases, for every stage: null ids and texts are values like any other; extra columns of any name are kept as they are; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import decontaminate, nearcopies, pieces, quality, secrets
from ledgerlake.llm.common import discard, sized, skewed_left, table, written


def _packed(docs: DataFrame, *keys: Column) -> DataFrame:
    """All columns of a row as one, so that no name of theirs meets one of ours."""
    return docs.select(F.struct("*").alias("_row"), *keys)


def _matching(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join of documents with (doc_id, text_hash)."""
    keys = written(keys.select(F.col("doc_id").cast("long").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "keys")
    rows = _packed(docs, F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_text"))
    on = rows["_doc"].eqNullSafe(keys["_id"]) & (rows["_text"] == keys["_hash"])
    return rows.join(sized(keys, keys.count() * 40), on, how).select("_row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside the importance resample go."""
    return _matching(docs, quality.resample(docs, table(spark, sf_dir, "labels")).where("keep"), "left_semi")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of a five-word similarity of 0.8 or more are linked. One row of each component stays: that of least id (null last), then of least text hash."""
    mine = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("component_hash"))
    stay = nearcopies.near_copies(docs.select("doc_id", "text")).where(mine).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    stay = written(stay, "stay")
    again = stay.where("n > 1")
    if again.isEmpty():
        return _matching(docs, stay, "left_semi")
    # rows of equal id and text: one stays, least by its columns as text
    twins = _packed(_matching(docs, again, "left_semi"), F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    once = twins.groupBy("_doc", "_text").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*")
    return _matching(docs, stay.where("n = 1"), "left_semi").unionByName(once)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return _matching(docs, decontaminate.find(docs, table(spark, sf_dir, "benchmark")), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mark; the ledger is that of operator 9, so a blob it has scanned isn't scanned again."""
    rows = docs.select("text").withColumn("path", F.lit(None).cast("string"))
    found = written(secrets.findings(secrets.scanned(rows)), "findings")
    size = found.agg(F.sum(F.size("spans") * 56 + 96)).first()[0] or 0
    rows = _packed(docs, secrets.address(F.col("text")).alias("blob"))
    rows = skewed_left(rows, found, "blob", size)
    text = F.when(F.col("spans").isNotNull(), secrets.redacted(F.col("_row.text"), F.col("spans"))).otherwise(F.col("_row.text"))
    rows = rows.select(F.col("_row").withField("text", text).alias("_row"))
    if "n_chars" in docs.columns:
        rows = rows.select(F.col("_row").withField("n_chars", F.char_length("_row.text").cast(docs.schema["n_chars"].dataType)).alias("_row"))
    return rows.select("_row.*")


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digest of what they decode to."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding", sentencepiece_encoding),
]

#: SQL can't express the sampling draw, the fingerprints or the pieces; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir), "stage")
        discard(docs)  # the table before it; the input itself was not written here
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
