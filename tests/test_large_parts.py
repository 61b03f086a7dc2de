"""What tasks hold does not grow with the tables: parts of joins, rows of long texts, digests of trees."""

import pyarrow as pa
import pytest

from ledgerlake.operators import evidence, records, treedigest
from ledgerlake.sources import cif, tables
from tests.oracle import SF


def test_scopes_are_dealt_over_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(tables, "PART", 10)
    rows = spark.range(200).selectExpr("id % 50 as scope", "id as ordinal", "cast(id div 50 as int) as number", "false as gap", "array(2D, 2D, 2D) as values", "array('0') as flags")
    intervals = spark.range(50).selectExpr("id as scope", "0 as first", "2 as last", "10 as start")
    states, scopes = evidence.profile_evidence(rows, intervals)
    assert states.rdd.getNumPartitions() == scopes.rdd.getNumPartitions() == 20
    assert sorted((r.state, r["count"]) for r in states.groupBy("state").count().collect()) == [("U", 50), ("flexible", 150)]


def test_segments_are_dealt_by_entry_once(spark, monkeypatch):
    monkeypatch.setattr(tables, "PART", 100)
    n = tables.load(spark, SF, "lineitem").count()
    assert records.mapping_segments(spark, SF).rdd.getNumPartitions() == -(-n // 100)


def test_a_tree_hashes_a_row_once_to_be_dealt_and_once_to_be_digested(spark, monkeypatch, tmp_path):
    calls, plain = [], treedigest.row_bits
    monkeypatch.setattr(treedigest, "row_bits", lambda columns: calls.append(columns) or plain(columns))
    treedigest.write_tree(spark.range(100).selectExpr("id", "id as v"), ["id"], str(tmp_path / "t"), 16)
    assert calls == [["id"], ["id", "v"]]


def test_rows_of_a_text_are_handed_on_before_its_end(monkeypatch):
    with pytest.raises(cif.CifError, match="3 values do not fill rows of 2"):
        rows = cif.categories("data_x\nloop_\n_a.x\n_a.y\n1 2\n3\n")
        assert next(rows) == ("_a", 0, {"x": "1", "y": "2"})
        next(rows)
    monkeypatch.setattr(cif, "LONG", 100)
    monkeypatch.setattr(cif, "ROWS", 10)
    text = "data_x\nloop_\n_a.x\n_a.y\n" + "1 2\n" * 95
    batch = pa.RecordBatch.from_arrays([pa.array(["good", "bad", "short"]), pa.array([text, text + "3\n", "_b.z 4\n"])], ["path", "text"])
    got = list(cif._rows([batch], None))
    assert max(b.num_rows for b in got) == 10
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["path"] for r in rows] == ["good"] * 95 + ["bad", "short"]
    assert rows[95]["error"] == "191 values do not fill rows of 2" and rows[95]["item"] is None
    assert [r["row_no"] for r in rows[:95]] == list(range(95))
