"""Contracts of records, envelopes, reconciliation, cached requests, batch checkpoints and their schedule."""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

from ledgerlake.plans.registry import query
from ledgerlake.sources import checkpoints
from ledgerlake.sources.sinks import shared_path, stored
from ledgerlake.sources.tables import BINS, LEDGER_SQL, ledger, load, parts_of

TOP_EDGE = 100.01


def grid_failures(grid: list[tuple[float, float]]) -> list[str]:
    """what keeps a list of (low, high) from being a grid: sorted, contiguous, finite, not empty, its top edge exactly 100.01."""
    if not grid:
        return ["empty"]
    checks = {
        "not_finite": all(math.isfinite(x) for b in grid for x in b), "inverted": all(a < b for a, b in grid),
        "not_contiguous": all(b == c for (_, b), (c, _) in zip(grid, grid[1:], strict=False)), "top_edge": grid[-1][1] == TOP_EDGE,
    }
    return [name for name, ok in checks.items() if not ok]


def strict_bin(x: Column, grid=BINS, restricted: bool = False) -> Column:
    """the bin of a value; outside the grid an error, or -1 below a restricted grid."""
    out = reduce(lambda acc, b: acc.when((x >= b[1][0]) & (x < b[1][1]), b[0]), enumerate(grid), F.when(F.lit(False), -1))
    if restricted:
        out = out.when(x < grid[0][0], -1)
    return out.otherwise(F.raise_error(F.concat(F.lit("outside the grid: "), F.coalesce(x.cast("string"), F.lit("null")))).cast("int"))


#: A contract: item, type, least, greatest. Every failure of a record is told.
EVENT_CONTRACT = (("k", "INTEGER", 0, 89),)
_SPOILT_SQL = """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN replace(props, '}', ', "z": 1}') WHEN event_id % 19 = 0 THEN replace(props, '"k"', '"q"')
  WHEN event_id % 23 = 0 THEN replace(replace(props, ': ', ': "'), '}', '"}') WHEN event_id % 29 = 0 THEN replace(props, '}', '') ELSE props END AS props FROM events"""


def contract_failures(parsed: str, contract=EVENT_CONTRACT) -> Column:
    """Q2: sorted codes of what a variant column (null: no JSON) breaks: missing or unexpected items, another type, out of bounds."""
    keys = F.expr(f"map_keys(cast({parsed} as map<string, variant>))")
    codes = [F.when(~F.forall(keys, lambda k: k.isin([c[0] for c in contract])), "UNEXPECTED_ITEM")]
    for name, kind, low, high in contract:
        there = F.array_contains(keys, name)
        item = F.try_variant_get(parsed, f"$.{name}", "string")
        number = item.try_cast("double")
        typed = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant")).isin("BIGINT", "INTEGER") if kind == "INTEGER" else F.lit(True)
        codes += [F.when(~there, f"MISSING_{name.upper()}"), F.when(there & ~typed, f"TYPE_{name.upper()}"), F.when(there & typed & ((number < low) | (number > high)), f"BOUND_{name.upper()}")]
    return F.when(F.col(parsed).isNull(), F.array(F.lit("NOT_AN_OBJECT"))).otherwise(F.array_sort(F.array_compact(F.array(*codes))))


@query(f"""WITH p AS ({_SPOILT_SQL}), j AS (SELECT event_id, TRY_CAST(props AS JSON) AS j FROM p)
SELECT event_id, CASE WHEN j IS NULL THEN ['NOT_AN_OBJECT'] ELSE list_sort(list_filter([CASE WHEN len(list_filter(json_keys(j), lambda k: k <> 'k')) > 0 THEN 'UNEXPECTED_ITEM' END, CASE WHEN NOT list_contains(json_keys(j), 'k') THEN 'MISSING_K' END,
  CASE WHEN list_contains(json_keys(j), 'k') AND json_type(j, '$.k') NOT IN ('BIGINT', 'UBIGINT') THEN 'TYPE_K' END,
  CASE WHEN json_type(j, '$.k') IN ('BIGINT', 'UBIGINT') AND TRY_CAST(json_extract_string(j, '$.k') AS BIGINT) NOT BETWEEN 0 AND 89 THEN 'BOUND_K' END], lambda x: x IS NOT NULL)) END AS failures FROM j""")
def schema_contract(spark, sf_dir):
    """Q2, Q8: failures of each record as data. Some records are spoilt on the way: an item too many, another name, another type, no JSON."""
    id_, props = F.col("event_id"), F.col("props")
    swap = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    spoilt = (
        F.when(id_ % 17 == 0, swap(props, "}", ', "z": 1}')).when(id_ % 19 == 0, swap(props, '"k"', '"q"'))
        .when(id_ % 23 == 0, swap(swap(props, ": ", ': "'), "}", '"}')).when(id_ % 29 == 0, swap(props, "}", "")).otherwise(props)
    )
    e = load(spark, sf_dir, "events").select("event_id", F.try_parse_json(spoilt).alias("_v"))
    return e.select("event_id", contract_failures("_v").alias("failures"))


def struct_of(contract: str | dict) -> StructType:
    """Q9: a Spark schema from a JSON-schema document; items marked as sunset are left out, required ones are not nullable."""
    doc = json.loads(contract) if isinstance(contract, str) else contract
    plain: dict[str, DataType] = {"integer": LongType(), "number": DoubleType(), "string": StringType(), "boolean": BooleanType()}

    def of(node: dict) -> DataType:
        if node["type"] == "object":
            return StructType([StructField(k, of(v), k not in node.get("required", ())) for k, v in node["properties"].items() if not v.get("x-sunset")])
        return ArrayType(of(node["items"])) if node["type"] == "array" else plain[node["type"]]

    out = of(doc)
    if not isinstance(out, StructType):
        raise ValueError("a contract describes an object")
    return out


_EVENT_SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}, "old": {"type": "string", "x-sunset": True}}}


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(CAST(props AS JSON), '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def contract_schema(spark, sf_dir):
    """Q9: records read by the schema that a contract document describes."""
    e = load(spark, sf_dir, "events").select("event_type", F.from_json("props", struct_of(_EVENT_SCHEMA)).alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("total"))


@query("""SELECT page_id, sha256(html) AS raw_sha256, sha256('{"page_id":' || page_id || ',"url":"' || url || '"}') AS projection_sha256,
sha256(sha256(html) || ':' || sha256('{"page_id":' || page_id || ',"url":"' || url || '"}') || ':primary') AS envelope_sha256, octet_length(encode(html)) AS raw_bytes FROM pages""")
def provenance_envelope(spark, sf_dir):
    """Q3: three hashes of a record: its bytes, its canonical projection, and both with the role they came in."""
    p = load(spark, sf_dir, "pages")
    raw, projection = F.sha2("html", 256), F.sha2(F.to_json(F.struct("page_id", "url")), 256)
    return p.select("page_id", raw.alias("raw_sha256"), projection.alias("projection_sha256"), F.sha2(F.concat_ws(":", raw, projection, F.lit("primary")), 256).alias("envelope_sha256"), F.octet_length("html").cast("long").alias("raw_bytes"))


def close(expected: Column, actual: Column, tolerance: Column) -> Column:
    """Equal within a tolerance; null and NaN equal only themselves."""
    return F.coalesce(expected.eqNullSafe(actual) | (F.abs(expected - actual) <= tolerance), F.lit(False))


def reconciled(checks: DataFrame, expected_count: int) -> DataFrame:
    """Q4: checks (name, expected, actual, tolerance) with ok, and one more that their number is the one expected."""
    gate = checks.agg(F.lit("number_of_checks").alias("name"), F.lit(float(expected_count)).alias("expected"), F.count("*").cast("double").alias("actual"), F.lit(0.0).alias("tolerance"))
    return checks.unionByName(gate).withColumn("ok", close(F.col("expected"), F.col("actual"), F.col("tolerance")))


_CHECKS = """SELECT 'orders_have_customers' AS name, CAST((SELECT count(*) FROM orders) AS DOUBLE) AS expected, CAST((SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS DOUBLE) AS actual, CAST(0 AS DOUBLE) AS tolerance
UNION ALL SELECT 'lines_have_orders', CAST((SELECT count(*) FROM lineitem) AS DOUBLE), CAST((SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS DOUBLE), 0
UNION ALL SELECT 'nations_in_regions', 25, CAST((SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey) AS DOUBLE), 0
UNION ALL SELECT 'mean_discount', 0.05, (SELECT avg(l_discount) FROM lineitem), 0.001
UNION ALL SELECT 'labels_have_documents', CAST((SELECT count(*) FROM labels) AS DOUBLE), CAST((SELECT count(*) FROM labels JOIN documents USING (doc_id)) AS DOUBLE), 0"""


@query(f"""WITH c AS ({_CHECKS}), a AS (SELECT * FROM c UNION ALL SELECT 'number_of_checks', 5, CAST((SELECT count(*) FROM c) AS DOUBLE), 0)
SELECT name, expected, round(actual, 9) AS actual, tolerance, abs(expected - actual) <= tolerance AS ok FROM a""")
def reconciliation(spark, sf_dir):
    """Q4: stored against recomputed figures, as a table of checks with tolerances."""
    t = lambda name: load(spark, sf_dir, name)

    def check(name: str, expected: DataFrame | float, actual: DataFrame, tolerance: float = 0.0) -> DataFrame:
        known = actual.select(F.lit(name).alias("name"), F.col("v").cast("double").alias("actual"), F.lit(tolerance).alias("tolerance"))
        if isinstance(expected, float):
            return known.withColumn("expected", F.lit(expected))
        return known.join(F.broadcast(expected.select(F.col("v").cast("double").alias("expected"))))  # one row each

    n = lambda df: df.agg(F.count("*").alias("v"))
    parts = [
        check("orders_have_customers", n(t("orders")), n(t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")))),
        check("lines_have_orders", n(t("lineitem")), n(t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")))),
        check("nations_in_regions", 25.0, n(t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")))),
        check("mean_discount", 0.05, t("lineitem").agg(F.avg("l_discount").alias("v")), 0.001),
        check("labels_have_documents", n(t("labels")), n(t("labels").join(t("documents").select("doc_id"), "doc_id"))),
    ]
    return reconciled(reduce(DataFrame.unionByName, parts), 5).select("name", "expected", F.round("actual", 9).alias("actual"), "tolerance", "ok")


def request_key(method: Column, url: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("\n", method, url, F.coalesce(body, F.lit(""))), 256)


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (method, url, body) with status and body of their cache entry; a miss is null, and an entry whose body no longer has its hash is told."""
    keyed = requests.withColumn("key", request_key(F.col("method"), F.col("url"), F.col("body")))
    hits = cache.select("key", "status", F.col("response").alias("response"), (F.sha2("response", 256) == F.col("response_sha256")).alias("intact"))
    return keyed.join(hits, "key", "left")


@query("""WITH c AS (SELECT sha256('GET' || chr(10) || url || chr(10)) AS key, 200 AS status, html AS response, sha256(CASE WHEN page_id % 11 = 0 THEN html || '!' ELSE html END) AS h FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS k FROM pages) WHERE k = 1),
r AS (SELECT page_id, sha256('GET' || chr(10) || CASE WHEN page_id % 7 = 0 THEN url || '#' ELSE url END || chr(10)) AS key FROM pages)
SELECT page_id, status, sha256(response) = h AS intact, octet_length(encode(response)) AS bytes FROM r LEFT JOIN c USING (key)""")
def request_cache(spark, sf_dir):
    """Requests served from a cache by the digest of method, url and body; some ask for what it lacks, some entries are damaged."""
    p = load(spark, sf_dir, "pages").where("url is not null")
    first = p.groupBy("url").agg(F.min_by(F.struct("page_id", "html"), "page_id").alias("f")).select("url", "f.*")
    spoilt = F.when(F.col("page_id") % 11 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    cache = first.select(request_key(F.lit("GET"), F.col("url"), F.lit(None)).alias("key"), F.lit(200).alias("status"), F.col("html").alias("response"), F.sha2(spoilt, 256).alias("response_sha256"))
    url = F.when(F.col("page_id") % 7 == 0, F.concat("url", F.lit("#"))).otherwise(F.col("url"))
    requests = load(spark, sf_dir, "pages").select("page_id", F.lit("GET").alias("method"), url.alias("url"), F.lit(None).cast("string").alias("body"))
    return cached(requests, cache).select("page_id", "status", "intact", F.octet_length("response").cast("long").alias("bytes"))


def conjunction(tree: dict) -> Column:
    """A search tree of and-groups and terminals (attribute, operator, value) as a predicate that Spark pushes to the scan."""
    if "all" in tree:
        return reduce(lambda a, b: a & b, map(conjunction, tree["all"]), F.lit(True))
    c, v = F.col(tree["attribute"]), tree["value"]
    return {"exact_match": c == v, "less_or_equal": c <= v, "greater": c > v, "in": c.isin(v) if isinstance(v, list) else c == v}[tree["operator"]]


_SEARCH = {"all": [{"attribute": "o_orderstatus", "operator": "exact_match", "value": "F"}, {"all": [{"attribute": "o_totalprice", "operator": "greater", "value": 200000.0}, {"attribute": "o_custkey", "operator": "less_or_equal", "value": 500}]}]}


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 AND o_custkey <= 500")
def conjunction_search(spark, sf_dir):
    """A remote search's conjunction, answered by the table; the filters reach the scan."""
    return load(spark, sf_dir, "orders").where(conjunction(_SEARCH)).select("o_orderkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 100 = 7 THEN 'targeted' ELSE 'sampled' END AS why FROM customer
WHERE c_custkey % 100 = 7 OR CAST('0x' || substr(md5('7:' || c_custkey), 1, 8) AS BIGINT) < 858993459""")
def recheck_sample(spark, sf_dir):
    """Q7: what is to be checked again: targeted keys, and of the others a fifth by seeded hash (a sampling operator)."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit("7:"), F.col("c_custkey").cast("string"))), 1, 8), 16, 10).cast("long")
    targeted = F.col("c_custkey") % 100 == 7
    return load(spark, sf_dir, "customer").where(targeted | (u < (1 << 32) // 5)).select("c_custkey", F.when(targeted, "targeted").otherwise("sampled").alias("why"))


_BATCH = "least(greatest(year(l_shipdate) - 1994, 1), 12)"
_LINES = "l_orderkey long, l_linenumber int, l_suppkey long, cents long"


def _batched(spark, sf_dir) -> DataFrame:
    d = load(spark, sf_dir, "lineitem")
    return d.select("l_orderkey", "l_linenumber", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.expr(f"cast({_BATCH} as int)").alias("batch_index"))


def written_batches(spark, sf_dir) -> tuple[str, int, StructType]:
    """The ledger's rows as write-once checkpoints, a batch a year."""
    root, rows = shared_path(spark, "checkpoints"), stored(_batched(spark, sf_dir), "batches")
    last = rows.agg(F.max("batch_index")).first()[0] or 0
    schema = rows.drop("batch_index").schema
    for k in range(1, last + 1):
        checkpoints.write_batch(rows.where(F.col("batch_index") == k).drop("batch_index"), root, k)
    return root, last, schema


@query(f"""SELECT CAST({_BATCH} AS INT) AS batch_index, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(DISTINCT l_suppkey) AS accessions
FROM lineitem WHERE {_BATCH} <= 4 GROUP BY ALL""")
def cumulative_ledger(spark, sf_dir):
    """Batches written once with their digests, then batches 1 to 4 read in order, verified and summed up."""
    root, _, schema = written_batches(spark, sf_dir)
    rows = checkpoints.cumulative(spark, root, 4, schema)
    return rows.groupBy("batch_index").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.count_distinct("l_suppkey").alias("accessions"))


def _schedule_sql() -> str:
    text, before = "", "''"
    for i, k in enumerate((4, 8, 12)):
        text += f"s{i} AS (SELECT {k} AS through_batch, count(*) AS n, CAST(coalesce(sum(cents), 0) AS BIGINT) AS cents, sha256({before} || ':{k}:' || count(*) || ':' || CAST(coalesce(sum(cents), 0) AS BIGINT)) AS state FROM b WHERE batch_index <= {k}),\n"
        before = f"(SELECT state FROM s{i})"
    return text.rstrip(",\n")


@query(f"""WITH b AS (SELECT CAST({_BATCH} AS INT) AS batch_index, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem),
{_schedule_sql()} SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2""")
def evaluation_schedule(spark, sf_dir):
    """Evaluations at batches 4, 8 and 12 over all rows so far; each state's digest holds the one before it."""
    b = _batched(spark, sf_dir)
    upto = [F.struct(F.count_if(F.col("batch_index") <= k).alias("n"), F.coalesce(F.sum(F.when(F.col("batch_index") <= k, F.col("cents"))), F.lit(0)).alias("cents")).alias(f"s{k}") for k in (4, 8, 12)]
    row, state = b.agg(*upto), F.lit("")
    out = []
    for k in (4, 8, 12):
        state = F.sha2(F.concat(state, F.lit(f":{k}:"), F.col(f"s{k}.n").cast("string"), F.lit(":"), F.col(f"s{k}.cents").cast("string")), 256)
        out.append(F.struct(F.lit(k).alias("through_batch"), F.col(f"s{k}.n").alias("n"), F.col(f"s{k}.cents").alias("cents"), state.alias("state")))
    return row.select(F.explode(F.array(*out)).alias("s")).select("s.*")


@query("""WITH l AS (SELECT l_orderkey, bool_and(l_linestatus = 'F') AS all_f, bool_and(l_linestatus = 'O') AS all_o FROM lineitem GROUP BY l_orderkey)
SELECT coalesce(o_orderstatus, 'absent') AS old_status, CASE WHEN l.l_orderkey IS NULL THEN 'absent' WHEN all_f THEN 'F' WHEN all_o THEN 'O' ELSE 'P' END AS new_status, count(*) AS n FROM orders FULL JOIN l ON l_orderkey = o_orderkey GROUP BY ALL""")
def status_transitions(spark, sf_dir):
    """Stored statuses against recomputed ones, as a matrix of counts."""
    l = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_linestatus") == "F").alias("f"), F.bool_and(F.col("l_linestatus") == "O").alias("o"))
    new = F.when(F.col("f").isNull(), "absent").when(F.col("f"), "F").when(F.col("o"), "O").otherwise("P")
    both = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(l, "o_orderkey", "full")
    return both.groupBy(F.coalesce("o_orderstatus", F.lit("absent")).alias("old_status"), new.alias("new_status")).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT l_suppkey, date_diff('day', o_orderdate, l_shipdate) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT CAST(least(greatest(floor(days / CAST(30 AS DOUBLE)), -1), 12) AS BIGINT) AS months, count(*) AS n, count(DISTINCT l_suppkey) AS accessions, count(*) FILTER (days = 0) AS unmoved FROM o GROUP BY ALL""")
def offset_prevalence(spark, sf_dir):
    """How often rows are moved and by how much: a distribution of offsets with the keys that have it."""
    l = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_shipdate")
    o = l.join(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").withColumn("days", F.date_diff("l_shipdate", "o_orderdate"))
    months = F.least(F.greatest(F.floor(F.col("days") / 30), F.lit(-1)), F.lit(12)).cast("long")
    return o.groupBy(months.alias("months")).agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("accessions"), F.count_if(F.col("days") == 0).alias("unmoved"))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, length(html) > 5000 AS large FROM pages)
SELECT host, large, count(*) AS n, min(page_id) AS first FROM h GROUP BY ALL""")
def receipt_summary(spark, sf_dir):
    """A manifest's receipts as a multiset of (host, kind)."""
    p = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), (F.char_length("html") > 5000).alias("large"))
    return p.groupBy("host", "large").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


@query(f"""WITH b AS (SELECT CAST({_BATCH} AS INT) AS batch_index, l_suppkey, l_orderkey, l_returnflag FROM lineitem)
SELECT batch_index, count(*) AS admitted, count(*) FILTER (l_returnflag = 'R') AS excluded, count(DISTINCT l_suppkey) AS accessions, count(DISTINCT (l_suppkey, l_orderkey)) AS pairs FROM b GROUP BY ALL""")
def census_flow(spark, sf_dir):
    """Flow of a census across batches, with distinct pairs."""
    b = load(spark, sf_dir, "lineitem").select(F.expr(f"cast({_BATCH} as int)").alias("batch_index"), "l_suppkey", "l_orderkey", "l_returnflag")
    return b.groupBy("batch_index").agg(F.count("*").alias("admitted"), F.count_if(F.col("l_returnflag") == "R").alias("excluded"), F.count_distinct("l_suppkey").alias("accessions"), F.count_distinct("l_suppkey", "l_orderkey").alias("pairs"))


@query(f"""WITH {LEDGER_SQL}, n AS (SELECT entry, pos, CASE WHEN channel_b = 0 THEN NULL ELSE chain END AS chain, CASE WHEN channel_a = 0 THEN NULL ELSE accession END AS accession FROM ledger)
SELECT entry, pos, chain, accession, row_number() OVER (PARTITION BY entry ORDER BY coalesce(chain, ''), coalesce(accession, -1), pos) AS place FROM n""")
def mixed_key_order(spark, sf_dir):
    """A total order of an entry's rows on keys that may be null; null sorts as the empty text, or as -1."""
    d = ledger(spark, sf_dir).select("entry", "pos", F.when(F.col("channel_b") != 0, F.col("chain")).alias("chain"), F.when(F.col("channel_a") != 0, F.col("accession")).alias("accession"))
    return d.withColumn("place", F.expr("row_number() over (partition by entry order by coalesce(chain, ''), coalesce(accession, -1), pos)"))


@query(f"""WITH {LEDGER_SQL} SELECT entry, CASE WHEN bool_or(channel_b > CAST(0.09 AS DOUBLE)) THEN NULL ELSE min(pos) FILTER (chain = 'R') END AS first_match, bool_or(channel_b > CAST(0.09 AS DOUBLE)) AS failed FROM ledger GROUP BY entry""")
def first_child(spark, sf_dir):
    """The first child, in numeric order, of the kind that is sought; any failed lookup leaves none."""
    failed = F.bool_or(F.col("channel_b") > 0.09)
    return ledger(spark, sf_dir).groupBy("entry").agg(F.when(~failed, F.min(F.when(F.col("chain") == "R", F.col("pos")))).alias("first_match"), failed.alias("failed"))


@query("""SELECT l_orderkey, count(*) AS segments, count(DISTINCT l_partkey) AS accessions, CAST(sum(CASE WHEN l_quantity <> round(l_quantity / 5) * 5 THEN 1 ELSE 0 END) AS BIGINT) AS needing_alignment FROM lineitem GROUP BY l_orderkey""")
def mapping_segments(spark, sf_dir):
    """Entries as JSON of maps within maps, flattened again to a row a segment; unequal spans need an alignment."""
    from ledgerlake.operators.scalar import flatten_mappings

    l = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = parts_of(l)
    l = l.repartition(parts, "l_orderkey")  # once, and before rows grow to segments
    bound = lambda c: F.struct(F.lit(None).cast("int").alias("author_residue_number"), c.cast("int").alias("residue_number"))
    span = F.round(F.col("l_quantity") / 5) * 5
    seg = F.struct(F.lit("A").alias("chain_id"), F.lit(100).alias("unp_start"), (100 + span).cast("int").alias("unp_end"), bound(F.lit(1)).alias("start"), bound(F.col("l_quantity") + 1).alias("end"))
    accs = l.groupBy("l_orderkey", "l_partkey").agg(F.collect_list(seg).alias("mappings"))
    maps = accs.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_partkey").cast("string"), F.struct("mappings")))).alias("UniProt"))
    payload = maps.select(F.to_json(F.create_map(F.col("l_orderkey").cast("string"), F.struct("UniProt"))).alias("payload"))
    rows = flatten_mappings(payload).withColumn("l_orderkey", F.col("entry").cast("long")).repartition(parts, "l_orderkey")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("segments"), F.count_distinct("accession").alias("accessions"), F.count_if("needs_alignment").alias("needing_alignment"))


#: Exposure classes by stratum.
STRATA = (("SAME_ACCESSION", "close"), ("SEQ95", "close"), ("SEQ30", "not"), ("NOVEL", "not"))


def stratum(cls: Column) -> Column:
    """Close, not, or unresolved for any other class."""
    return reduce(lambda acc, s: acc.when(cls == s[0], s[1]), STRATA, F.when(F.lit(False), "")).otherwise("unresolved")


@query("""WITH o AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'SAME_ACCESSION' WHEN '2-HIGH' THEN 'SEQ95' WHEN '3-MEDIUM' THEN 'SEQ30' WHEN '5-LOW' THEN 'NOVEL' ELSE 'QUERY_FAILED' END AS class, o_totalprice FROM orders)
SELECT CASE WHEN class IN ('SAME_ACCESSION', 'SEQ95') THEN 'close' WHEN class IN ('SEQ30', 'NOVEL') THEN 'not' ELSE 'unresolved' END AS stratum, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price FROM o GROUP BY ALL""")
def exposure_strata(spark, sf_dir):
    """Classes fold to strata."""
    p = F.col("o_orderpriority")
    cls = F.when(p == "1-URGENT", "SAME_ACCESSION").when(p == "2-HIGH", "SEQ95").when(p == "3-MEDIUM", "SEQ30").when(p == "5-LOW", "NOVEL").otherwise("QUERY_FAILED")
    return load(spark, sf_dir, "orders").groupBy(stratum(cls).alias("stratum")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean_price"))
