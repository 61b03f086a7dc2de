"""Tables that went through archives: zip members and workbook cells, packed a group an archive and read again."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.plans.registry import query
from ledgerlake.sources.archives import member_lines, paired_tsv, roster, workbook
from ledgerlake.sources.sinks import stored
from ledgerlake.sources.tables import load

SPREADSHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def packed(members: DataFrame) -> DataFrame:
    """(path, name, text) to written archives (path, content): a path's members are one small archive."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in sorted(zip(pdf["name"], pdf["text"], strict=True)):
                z.writestr(zipfile.ZipInfo(name), text)
        return pd.DataFrame({"path": pdf["path"].iloc[:1], "content": [out.getvalue()]})

    return stored(members.groupBy("path").applyInPandas(pack, "path string, content binary"), "archives")


def _lines(rows: DataFrame, key: str, line) -> DataFrame:
    """(path, text): lines of a group, in the order of a key."""
    return rows.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key), line.alias("l")))), lambda r: r["l"]), "\n").alias("text"))


@query("SELECT lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '_' || (c_custkey // 10000) || 'S' AS line FROM customer")
def archived_roster(spark, sf_dir):
    """S3: lists of names in zip members, an archive a nation; together a roster without repeats."""
    c = load(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("path"), "c_custkey")
    name = F.concat(F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("_"), F.expr("cast(c_custkey div 10000 as string)"), F.lit("S"))
    archives = packed(_lines(c, "c_custkey", name).withColumn("name", F.lit("list.txt")))
    return roster(member_lines(archives, "list.txt"))


@query("SELECT 'n' || s_nationkey AS path, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS ordinal, CAST(s_suppkey AS VARCHAR) AS a, s_name AS b FROM supplier")
def archived_pairs(spark, sf_dir):
    """Two TSV members of an archive, joined row by row by their place."""
    s = load(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("path"), "s_suppkey", "s_name")
    key = lambda header, c: _lines(s, "s_suppkey", c).withColumn("text", F.concat(F.lit(header + "\n"), "text"))
    a = key("id\tone", F.concat(F.col("s_suppkey").cast("string"), F.lit("\t1"))).withColumn("name", F.lit("a.tsv"))
    b = key("label", F.col("s_name")).withColumn("name", F.lit("b.tsv"))
    pairs = paired_tsv(packed(a.unionByName(b)), "a.tsv", ("id", "one"), "b.tsv", ("label",))
    return pairs.select("path", "ordinal", F.get("first", F.lit(0)).alias("a"), F.get("second", F.lit(0)).alias("b"))


@query("""WITH s AS (SELECT 'n' || s_nationkey AS path, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r, s_suppkey, s_name FROM supplier)
SELECT path, 'A' AS "column", CAST(r AS INT) AS "row", CAST(s_suppkey AS VARCHAR) AS value FROM s WHERE r BETWEEN 2 AND 1048576 UNION ALL SELECT path, 'C', CAST(r AS INT), s_name FROM s WHERE r <= 3""")
def workbook_cells(spark, sf_dir):
    """Cells of a workbook within ranges of two columns, numbers in place and texts through the shared strings."""
    s = load(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("path"), "s_suppkey", "s_name")
    g = s.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("r"))
    row = lambda r, i: F.concat(F.lit("<row>"), F.lit('<c r="A'), (i + 1).cast("string"), F.lit('"><v>'), r["s_suppkey"].cast("string"), F.lit('</v></c><c r="C'), (i + 1).cast("string"), F.lit('" t="s"><v>'), i.cast("string"), F.lit("</v></c></row>"))
    sheet = F.concat(F.lit(f'<worksheet xmlns="{SPREADSHEET}"><sheetData>'), F.array_join(F.transform("r", row), ""), F.lit("</sheetData></worksheet>"))
    strings = F.concat(F.lit(f'<sst xmlns="{SPREADSHEET}">'), F.array_join(F.transform("r", lambda r: F.concat(F.lit("<si><t>"), r["s_name"], F.lit("</t></si>"))), ""), F.lit("</sst>"))
    book = F.lit(f'<workbook xmlns="{SPREADSHEET}" xmlns:r="{RELATIONS}"><sheets><sheet name="T" r:id="x1"/></sheets></workbook>')
    rels = F.lit('<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="x1" Target="worksheets/sheet1.xml"/></Relationships>')
    members = F.create_map(*[x for k, v in {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": strings}.items() for x in (F.lit(k), v)])
    return workbook(packed(g.select("path", F.explode(members).alias("name", "text"))), "T", (("A", 2, 1_048_576), ("C", 1, 3)))


@query("""SELECT p_partkey, '{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}' AS artifact FROM part""")
def derived_artifact(spark, sf_dir):
    """K7, K4: named fields of a record as canonical JSON, in the order of a fixed key when written."""
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))).alias("artifact"))
