import gzip
import json

import pytest
from pyspark.sql import functions as F

from ledgerlake.sources.files import csv_table, fasta_sequence, json_documents


def test_json_documents_are_strict(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"k": 1, "rows": [{"x": 1.5}]}, indent=1))
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(b'{"k": 2, "rows": []}'))
    got = json_documents(spark, str(tmp_path), "k int, rows array<struct<x:double>>").orderBy("k").collect()
    assert [(r.k, len(r.rows)) for r in got] == [(1, 1), (2, 0)]
    (tmp_path / "c.json").write_text('{"k": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        json_documents(spark, str(tmp_path), "k int, rows array<struct<x:double>>").collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        json_documents(spark, str(tmp_path / "none"), "k int")


def test_csv_header_must_match(spark, tmp_path):
    (tmp_path / "t.csv").write_text('name,seqres\n1abc_A,"M,K"\n')
    assert csv_table(spark, str(tmp_path), "name string, seqres string").first().seqres == "M,K"
    with pytest.raises(Exception):
        csv_table(spark, str(tmp_path), "name string, other string").collect()


def test_fasta(spark):
    rows = [(">x\nMK\nL V\n", 200), (">x\nMK", 404), ("MK", 200), (None, 200), (">x", 200)]
    got = spark.createDataFrame(rows, "body string, status int").select(fasta_sequence(F.col("body"), F.col("status"))).collect()
    assert [r[0] for r in got] == ["MKLV", None, None, None, ""]
