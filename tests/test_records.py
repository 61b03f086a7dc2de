"""Archives, checkpoints and contracts: what they refuse, and with which code."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import floors, records
from ledgerlake.sources import archives, checkpoints
from ledgerlake.sources.tables import BINS


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "."), text)
    return out.getvalue()


def archive(spark, raw):
    return spark.createDataFrame([("a", raw)], "path string, content binary")


def test_rosters_refuse_repeats_forms_and_other_bytes(spark):
    lines = lambda text, **pins: archives.roster(archives.member_lines(archive(spark, zipped(l__txt=text)), "l.txt", **pins))
    assert {r.line for r in lines("1abc_A\n2xyz_B7").collect()} == {"1abc_A", "2xyz_B7"}
    for text, why in (("1abc_A\n1abc_A", "repeated"), ("1abc-A", "malformed")):
        with pytest.raises(Exception, match=why):
            lines(text).collect()
    with pytest.raises(Exception, match="SHA-256"):
        lines("1abc_A", archive_sha256="0" * 64).collect()
    with pytest.raises(Exception, match="no item named"):
        archives.member_lines(archive(spark, zipped(x="y")), "l.txt").collect()


def test_paired_members_refuse_other_headers_empty_cells_and_lengths(spark):
    def rows(a, b):
        return archives.paired_tsv(archive(spark, zipped(a__tsv=a, b__tsv=b)), "a.tsv", ("x", "y"), "b.tsv", ("z",)).collect()

    assert [(r.ordinal, r.first, r.second) for r in rows("x\ty\n1\t2", "z\n3")] == [(1, ["1", "2"], ["3"])]
    for a, b, why in (("x\tq\n1\t2", "z\n3", "header"), ("x\ty\n1\t", "z\n3", "empty"), ("x\ty\n1\t2", "z\n3\n4", "partner")):
        with pytest.raises(Exception, match=why):
            rows(a, b)


def test_checkpoints_are_written_once_verified_and_read_in_order(spark, tmp_path):
    root = str(tmp_path / "ledger")
    for k in (1, 2):
        checkpoints.write_batch(spark.createDataFrame([(k, "x"), (k, None)], "a int, b string"), root, k)
    schema = spark.createDataFrame([], "a int, b string").schema
    assert checkpoints.cumulative(spark, root, 2, schema).groupBy("batch_index").count().count() == 2
    assert schema.names == ["a", "b"]
    for act, code in (
        (lambda: checkpoints.write_batch(spark.createDataFrame([(1, "x")], "a int, b string"), root, 1), checkpoints.EXISTS),
        (lambda: checkpoints.cumulative(spark, root, 3, schema), checkpoints.MISSING),
        (lambda: checkpoints.close_window("2026-01-01", "2026-01-02", 4), checkpoints.OPEN),
        (lambda: checkpoints.frozen(spark, root, "pool", schema), checkpoints.NOT_FROZEN),
    ):
        with pytest.raises(checkpoints.CheckpointError) as e:
            act()
        assert e.value.code == code
    spark.createDataFrame([(9, "y")], "a int, b string").write.mode("append").parquet(f"{root}/rows/batch_index=1")
    with pytest.raises(checkpoints.CheckpointError, match=checkpoints.DIFFERS):
        checkpoints.cumulative(spark, root, 1, schema)


def test_a_replay_must_reproduce_what_is_stored_and_a_pool_stays_frozen(spark, tmp_path):
    a, b = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([(2,), (1,)], "a int")
    assert checkpoints.accepted(a, b, b.limit(1)).count() == 1  # in any order
    with pytest.raises(checkpoints.CheckpointError):
        checkpoints.accepted(a, b.limit(1), b)
    digest = checkpoints.freeze(a, str(tmp_path), "pool")
    assert checkpoints.content_digest(checkpoints.frozen(spark, str(tmp_path), "pool", a.schema)) == digest
    assert checkpoints.content_digest(a.limit(0)).startswith("0:")


def test_grids_and_strict_bins(spark):
    assert records.grid_failures(list(BINS)) == []
    assert records.grid_failures([(0.0, 50.0), (60.0, 100.01)]) == ["not_contiguous"]
    assert records.grid_failures([(0.0, 100.0)]) == ["top_edge"] and records.grid_failures([]) == ["empty"]
    assert records.grid_failures([(0.0, float("inf"))]) == ["not_finite", "top_edge"]
    d = spark.createDataFrame([(0.0,), (59.9,), (100.0,)], "x double")
    assert [r[0] for r in d.select(records.strict_bin(F.col("x"))).collect()] == [0, 1, 5]
    assert [r[0] for r in d.select(records.strict_bin(F.col("x"), BINS[1:], restricted=True)).collect()] == [-1, 0, 4]
    with pytest.raises(Exception, match="outside the grid"):
        spark.createDataFrame([(100.01,)], "x double").select(records.strict_bin(F.col("x"))).collect()


def test_reconciliation_knows_null_nan_and_its_own_number(spark):
    rows = [("a", 1.0, 1.0 + 1e-13, 1e-12), ("b", 1.0, 1.1, 1e-12), ("c", None, None, 0.0), ("d", float("nan"), float("nan"), 0.0), ("e", 1.0, None, 9.0)]
    got = {r.name: r.ok for r in records.reconciled(spark.createDataFrame(rows, "name string, expected double, actual double, tolerance double"), 4).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": True, "e": False, "number_of_checks": False}


def test_schemas_of_contracts():
    doc = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "object", "properties": {"c": {"type": "boolean"}}}}, "gone": {"type": "string", "x-sunset": True}}}
    assert records.struct_of(doc).simpleString() == "struct<a:bigint,b:array<struct<c:boolean>>>"
    assert not records.struct_of(doc)["a"].nullable
    with pytest.raises(ValueError):
        records.struct_of({"type": "string"})


def test_verdicts(spark):
    ok, bad = (spark.createDataFrame([("a", True), ("b", b)], "name string, ok boolean") for b in (True, False))
    assert [floors.verdict(ok).first().verdict, floors.verdict(bad, True).first().verdict, floors.verdict(bad).first().verdict] == [floors.PASS, floors.UNDERPOWERED, floors.INFEASIBLE]


def test_proteins_and_groups_resolve(spark):
    rows = [("p", i, "A") for i in range(10)] + [("q", i, "A") for i in range(9)] + [("r", i, c) for i in range(10) for c in "AB"] + [("p", 50, "U")]
    p, g = floors.resolved(spark.createDataFrame(rows, "protein string, num int, cell string"), spark.createDataFrame([("p", "g1"), ("q", "g2"), ("r", "g3"), ("s", "g1"), ("p2", "g4")], "protein string, grp string"))
    assert {r.protein: r.status for r in p.collect()} == {"p": "resolved", "q": "unresolved", "r": "protein_ambiguous", "s": "unresolved", "p2": "unresolved"}
    assert all(r.cell is None for r in g.collect())  # a member without a cell leaves the group without one
