"""File sources: nested JSON documents, CSV with a header, FASTA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A record a file, gzip included; a malformed file or a missing path is an error, never an empty table."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns by position under a header that must name them; quoted fields may hold commas."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def fasta_sequence(body, status):
    """The sequence of a FASTA body without header and white space; null unless the status is 200 and it starts with >."""
    whole = F.regexp_replace(F.regexp_replace(body, r"^>[^\n]*(\n|$)", ""), r"\s", "")
    return F.when((status == 200) & F.startswith(body, F.lit(">")), whole)
