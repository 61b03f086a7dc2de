"""Members of zip files as tables: lists of lines, pairs of TSV members, cells of a workbook. Bytes come from binaryFile or a column."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The form of a roster line, and the name spaces of a workbook.
ROSTER_LINE = "[0-9A-Za-z]{4}_[A-Za-z0-9]+"
SHEETS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "p": "http://schemas.openxmlformats.org/package/2006/relationships"}


class ArchiveError(ValueError):
    """The archive is not the one pinned, or its members are not of the form demanded."""


def checked(raw: bytes, sha256: str | None, what: str) -> bytes:
    if sha256 and hashlib.sha256(raw).hexdigest() != sha256:
        raise ArchiveError(f"{what}: SHA-256 differs")
    return raw


def _members(raw: bytes, name: str) -> bytes:
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            return z.read(name)
    except (KeyError, zipfile.BadZipFile) as e:
        raise ArchiveError(f"{name}: {e}") from e


def member_lines(archives: DataFrame, name: str, archive_sha256: str | None = None, member_sha256: str | None = None) -> DataFrame:
    """(path, content) to (path, line_no, line) of an ASCII member."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                text = checked(_members(checked(bytes(raw), archive_sha256, path), name), member_sha256, name).decode("ascii").splitlines()
                yield pd.DataFrame({"path": path, "line_no": range(len(text)), "line": text})

    return archives.select("path", "content").mapInPandas(lines, "path string, line_no long, line string")


def roster(lines: DataFrame) -> DataFrame:
    """S3: the distinct lines, each of the roster's form; a repeated or malformed line is an error."""
    bad = F.when(~F.col("line").rlike(f"^{ROSTER_LINE}$"), F.raise_error(F.concat(F.lit("malformed roster line: "), "line")))
    twice = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated roster line: "), "line")))
    return lines.groupBy("line").agg(F.count("*").alias("n")).select(F.coalesce(bad.cast("string"), twice.cast("string"), F.col("line")).alias("line"))


def tsv(lines: DataFrame, header: tuple[str, ...]) -> DataFrame:
    """(path, ordinal, cells): rows of a TSV member under an exact header, without empty cells."""
    cells = F.split("line", "\t", -1)
    is_head = F.col("line_no") == 0
    wrong = F.when(is_head & (F.col("line") != "\t".join(header)), F.raise_error(F.lit("header differs")))
    empty = F.when(~is_head & ((F.size("cells") != len(header)) | F.exists("cells", lambda c: c == "")), F.raise_error(F.concat(F.lit("row of other length, or an empty cell: "), "line")))
    rows = lines.withColumn("cells", cells).withColumn("_ok", F.coalesce(wrong.cast("string"), empty.cast("string"), F.lit("")))
    return rows.where("_ok = '' and line_no > 0").select("path", F.col("line_no").alias("ordinal"), "cells")


def paired_tsv(archives: DataFrame, first: str, first_header: tuple[str, ...], second: str, second_header: tuple[str, ...]) -> DataFrame:
    """Row i of one member beside row i of the other; members of unequal length are an error."""
    a = tsv(member_lines(archives, first), first_header).withColumnRenamed("cells", "first")
    b = tsv(member_lines(archives, second), second_header).withColumnRenamed("cells", "second")
    lone = F.when(F.col("first").isNull() | F.col("second").isNull(), F.raise_error(F.concat(F.lit("row without its partner: "), F.col("path"), F.lit(" "), F.col("ordinal").cast("string"))))
    both = a.join(b, ["path", "ordinal"], "full").withColumn("_lone", F.coalesce(lone.cast("string"), F.lit("")))
    return both.where("_lone = ''").drop("_lone")


def cells(raw: bytes, sheet: str) -> Iterator[tuple[str, int, str]]:
    """(column, row, value) of a sheet's cells that hold a value; shared strings are looked up."""
    book = ElementTree.fromstring(_members(raw, "xl/workbook.xml"))
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(_members(raw, "xl/_rels/workbook.xml.rels")).findall("p:Relationship", SHEETS)}
    target = next((rels[s.get(f"{{{SHEETS['r']}}}id")] for s in book.findall("m:sheets/m:sheet", SHEETS) if s.get("name") == sheet), None)
    if target is None:
        raise ArchiveError(f"no sheet {sheet}")
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        has_shared = "xl/sharedStrings.xml" in z.namelist()
    shared = ["".join(t.text or "" for t in si.iter(f"{{{SHEETS['m']}}}t")) for si in ElementTree.fromstring(_members(raw, "xl/sharedStrings.xml")).findall("m:si", SHEETS)] if has_shared else []
    for c in ElementTree.fromstring(_members(raw, "xl/" + target.removeprefix("/xl/"))).iter(f"{{{SHEETS['m']}}}c"):
        column, row = re.fullmatch("([A-Z]+)([0-9]+)", c.get("r")).groups()
        v = c.find("m:v", SHEETS)
        if c.get("t") == "inlineStr":
            yield column, int(row), "".join(t.text or "" for t in c.iter(f"{{{SHEETS['m']}}}t"))
        elif v is not None and v.text is not None:
            yield column, int(row), shared[int(v.text)] if c.get("t") == "s" else v.text


def workbook(archives: DataFrame, sheet: str, ranges: tuple[tuple[str, int, int], ...]) -> DataFrame:
    """(path, column, row, value) of the cells of a sheet within ranges of (column, first row, last row)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(path, c, r, v) for c, r, v in cells(bytes(raw), sheet) if any(c == k and a <= r <= b for k, a, b in ranges)]
                yield pd.DataFrame(rows, columns=["path", "column", "row", "value"])

    return archives.select("path", "content").mapInPandas(read, "path string, column string, row int, value string")
