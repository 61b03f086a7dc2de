"""Deep comparison of nested records: trees of values as rows of (path, value), joined null-safe, with tolerances by path."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.plans.registry import query
from ledgerlake.sources.sinks import stored
from ledgerlake.sources.tables import load

#: Depth beyond which a tree is refused.
DEEPEST = 100


def kind_of(t: Column) -> Column:
    """object, array, boolean, integer, number (with a fraction or exponent), string or null, of the schema of a variant."""
    starts = lambda *names: reduce(lambda a, b: a | b, [t.startswith(n) for n in names])
    fraction = starts("DECIMAL", "DOUBLE", "FLOAT")
    return F.when(starts("OBJECT"), "object").when(starts("ARRAY"), "array").when(t == "BOOLEAN", "boolean").when(t == "BIGINT", "integer").when(fraction, "number").when(t == "VOID", "null").otherwise("string")


def _nodes(level: DataFrame, by: list[str], kept: Callable[[DataFrame], DataFrame], opened: Column) -> DataFrame:
    """(*by, path, kind, text, number) of trees (*by, path, v): a level of all trees is opened at a time, so there are as many steps as the deepest tree has levels, each distributed by rows."""
    spark = level.sparkSession
    done = []
    for _ in range(DEEPEST + 1):
        level = level.withColumn("_schema", F.schema_of_variant("v")).withColumn("kind", kind_of(F.col("_schema")))
        level = stored(kept(level).drop("_schema"), "level")
        done.append(level)
        open_ = level.where(F.col("kind").isin("object", "array") & opened)
        if open_.isEmpty():
            break
        parts = spark.tvf.variant_explode(F.col("v").outer())
        step = F.when(F.col("kind") == "array", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        level = open_.lateralJoin(parts).select(*by, F.concat("path", step).alias("path"), F.col("value").alias("v"))
    else:
        raise ValueError(f"a tree of more than {DEEPEST} levels")
    rows = reduce(DataFrame.unionByName, done)
    plain = ~F.col("kind").isin("object", "array", "null")
    number = F.when(F.col("kind").isin("integer", "number"), F.try_variant_get("v", "$", "double"))
    return rows.select(*by, "path", "kind", F.when(plain, F.try_variant_get("v", "$", "string")).alias("text"), number.alias("number"))


def tree_rows(records: DataFrame, ids: list[str], column: str) -> DataFrame:
    """(*ids, path, kind, text, number): a row for every node of a column of type variant; paths are $, $.key, $.key[0] and so on."""
    return _nodes(records.select(*ids, F.lit("$").alias("path"), F.col(column).alias("v")).where("v is not null"), ids, lambda level: level, F.lit(True))


def differing_rows(a: DataFrame, b: DataFrame, ids: list[str], column: str) -> DataFrame:
    """(side, *ids, path, kind, text, number): the nodes of two columns of type variant at whose path the sides may differ.

    Where all values of a path, on both sides, are the same to the letter (numbers that are not finite never are),
    neither they nor what lies below is looked at again; nor is what lies below a path that one side lacks.
    """
    sides = [d.select(F.lit(side).alias("side"), *ids, F.lit("$").alias("path"), F.col(column).alias("v")) for side, d in (("a", a), ("b", b))]
    place = W.partitionBy(*ids, "path")

    def unlike(level: DataFrame) -> DataFrame:
        level = level.withColumn("_text", F.to_json("v")).withColumn("_all", F.sha2(F.concat_ws("|", "_schema", "_text"), 256)).withColumn("_odd", F.col("_text").rlike("NaN|Infinity")).drop("_text")
        level = level.withColumn("_both", F.min("side").over(place) != F.max("side").over(place))
        same = F.col("_both") & (F.min("_all").over(place) == F.max("_all").over(place)) & ~F.max("_odd").over(place)
        return level.withColumn("_same", same).where(~F.col("_same")).drop("_all", "_odd", "_same")

    return _nodes(sides[0].unionByName(sides[1]).where("v is not null"), ["side", *ids], unlike, F.col("_both"))


def tolerance_of(path: Column, tolerances: dict[str, float], default: float) -> Column:
    """The tolerance of a path; places in arrays are written [*] in the table."""
    plain = F.regexp_replace(path, r"\[\d+\]", "[*]")
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in tolerances.items() for x in kv]), plain), F.lit(default)) if tolerances else F.lit(default)


def deep_diff(stored_: DataFrame, recomputed: DataFrame, ids: list[str], tolerances: dict[str, float] | None = None, default: float = 1e-12) -> DataFrame:
    """(*ids, path, reason) of all nodes that differ between two columns named doc, of type variant.

    Reasons: missing_stored, missing_recomputed (a null is no missing value), kind, value. Two integers must be equal;
    where one number has a fraction both must be finite and within the path's tolerance; booleans are no numbers. What
    lies below a node that is missing or of another kind is not told again.
    """
    rows = stored(differing_rows(stored_, recomputed, ids, "doc"), "nodes")
    a, b = (rows.where(F.col("side") == side).drop("side") for side in "ab")
    a, b = (d.withColumnsRenamed({c: f"{c}_{s}" for c in ("kind", "text", "number")}) for d, s in ((a, "a"), (b, "b")))
    both = a.join(b.withColumnsRenamed({c: f"_by_{c}" for c in [*ids, "path"]}), [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in [*ids, "path"]], "full")
    both = both.select(*[F.coalesce(c, f"_by_{c}").alias(c) for c in [*ids, "path"]], *[f"{c}_{s}" for s in "ab" for c in ("kind", "text", "number")])
    numeric = lambda s: F.col(f"kind_{s}").isin("integer", "number")
    whole = (F.col("kind_a") == "integer") & (F.col("kind_b") == "integer")
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    near = finite(F.col("number_a")) & finite(F.col("number_b")) & (F.abs(F.col("number_a") - F.col("number_b")) <= tolerance_of(F.col("path"), tolerances or {}, default))
    same = F.when(whole, F.col("text_a") == F.col("text_b")).when(numeric("a"), near).otherwise(F.col("text_a").eqNullSafe(F.col("text_b")))
    other = (F.col("kind_a") != F.col("kind_b")) & ~(numeric("a") & numeric("b"))
    reason = F.when(F.col("kind_a").isNull(), "missing_stored").when(F.col("kind_b").isNull(), "missing_recomputed").when(other, "kind").when(~same, "value")
    found = both.select(*ids, "path", reason.alias("reason")).where("reason is not null")
    # below a node that is told as missing or of another kind: its parent's path is told too
    parent = F.regexp_replace("path", r"(\.[^.\[\]]*|\[\d+\])$", "")
    told = found.where("reason <> 'value'").select(*[F.col(c).alias(f"_by_{c}") for c in ids], F.col("path").alias("_parent"))
    on = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in ids] + [(F.col("path") != "$") & (parent == F.col("_parent"))]
    return found.join(told, on, "left_anti")


_LINE = """'{{"n":' || l_linenumber || ',"price":' || CAST({price} AS VARCHAR) || ',"flag":' || {flag} || '}}'"""
_DOC = """'{{"key":' || o_orderkey || {status} || ',"total":' || CAST({total} AS VARCHAR) || ',"deep":{{"lines":[' || coalesce(lines, '') || ']}}' || {none} || '}}'"""
_WHOLE = {"price": "l_extendedprice", "flag": """'"' || l_returnflag || '"'"""}
_OTHER = {
    "price": "CASE WHEN l_orderkey % 23 = 0 THEN l_extendedprice + 0.004 WHEN l_orderkey % 29 = 0 THEN l_extendedprice + 0.5 ELSE l_extendedprice END",
    "flag": """CASE WHEN l_orderkey % 19 = 0 AND l_linenumber = 1 THEN '7' WHEN l_orderkey % 31 = 0 THEN '["' || l_returnflag || '"]' ELSE '"' || l_returnflag || '"' END""",
}
_STATUS = """',"status":"' || o_orderstatus || '"'"""
_A = _DOC.format(status=_STATUS, total="o_totalprice", none="""',"none":null'""")
_B = _DOC.format(
    status=f"CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE {_STATUS} END", total="CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 0.5 WHEN o_orderkey % 7 = 1 THEN o_totalprice + 1e-6 ELSE o_totalprice END",
    none="""CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 37 = 0 THEN ',"none":false' ELSE ',"none":null' END""",
)
TOLERANCES = {"$.total": 0.001, "$.deep.lines[*].price": 0.01}
_SIDE = """{name}l AS (SELECT l_orderkey, string_agg({line}, ',' ORDER BY l_linenumber, l_partkey, l_extendedprice) AS lines FROM lineitem {where} GROUP BY l_orderkey),
{name}j AS (SELECT o_orderkey, {doc} AS j FROM orders LEFT JOIN {name}l ON l_orderkey = o_orderkey),
{name} AS MATERIALIZED (SELECT o_orderkey, t.fullkey AS path, CASE WHEN t.type IN ('UBIGINT', 'BIGINT') THEN 'integer' WHEN t.type = 'DOUBLE' THEN 'number' ELSE t.type END AS kind, t.atom AS text FROM {name}j, LATERAL (SELECT * FROM json_tree(j)) t)"""


@query(f"""WITH {_SIDE.format(name="a", line=_LINE.format(**_WHOLE), doc=_A, where="")},
{_SIDE.format(name="b", line=_LINE.format(**_OTHER), doc=_B, where="WHERE NOT (l_orderkey % 11 = 0 AND l_linenumber > 2)")},
d AS MATERIALIZED (SELECT o_orderkey, path, CASE WHEN a.kind IS NULL THEN 'missing_stored' WHEN b.kind IS NULL THEN 'missing_recomputed'
  WHEN a.kind <> b.kind AND NOT (a.kind IN ('integer', 'number') AND b.kind IN ('integer', 'number')) THEN 'kind'
  WHEN a.kind IN ('integer', 'number') THEN CASE WHEN a.kind = 'integer' AND b.kind = 'integer' AND a.text <> b.text THEN 'value'
    WHEN (a.kind = 'number' OR b.kind = 'number') AND abs(CAST(a.text AS DOUBLE) - CAST(b.text AS DOUBLE)) > CASE WHEN path = '$.total' THEN 0.001 WHEN regexp_matches(path, 'price$') THEN 0.01 ELSE 1e-12 END THEN 'value' END
  WHEN a.text IS DISTINCT FROM b.text THEN 'value' END AS reason FROM a FULL JOIN b USING (o_orderkey, path))
SELECT o_orderkey, path, reason FROM d WHERE reason IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM d p WHERE d.path <> '$' AND p.o_orderkey = d.o_orderkey AND p.reason <> 'value' AND p.path = regexp_replace(d.path, '(\\.[^.\\[\\]]*|\\[\\d+\\])$', ''))""")
def deep_reconciliation(spark, sf_dir):
    """Q4: nested records stored and recomputed, compared node by node; differences are named by path."""
    load(spark, sf_dir, "orders").createOrReplaceTempView("deep_orders")
    load(spark, sf_dir, "lineitem").createOrReplaceTempView("deep_lineitem")

    def side(line: dict, doc: str, where: str) -> DataFrame:
        entry = f"struct(l_linenumber, l_partkey, l_extendedprice, {_LINE.format(**line)} AS line)"
        sql = f"""WITH l AS (SELECT l_orderkey, array_join(array_sort(collect_list({entry})).line, ',') AS lines FROM deep_lineitem {where} GROUP BY l_orderkey)
        SELECT o_orderkey, parse_json({doc}) AS doc FROM deep_orders LEFT JOIN l ON l_orderkey = o_orderkey"""
        return spark.sql(sql.replace("VARCHAR", "STRING"))

    a, b = side(_WHOLE, _A, ""), side(_OTHER, _B, "WHERE NOT (l_orderkey % 11 = 0 AND l_linenumber > 2)")
    return deep_diff(a, b, ["o_orderkey"], TOLERANCES)
