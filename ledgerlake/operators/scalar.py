"""Filters, typed states and scalar projections, all in expressions that stay in whole-stage code."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ledgerlake.functions.text import ascii_upper
from ledgerlake.plans.registry import query
from ledgerlake.sources.tables import LEDGER_SQL, ledger, load

#: The vocabulary of row states, each with the table that records it.
STATUSES = (("correct", "ledger"), ("error", "ledger"), ("U", "ledger"), ("flexible", "profile"), ("ordered", "profile"))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def e_state(label: Column, distance: Column, nan_is_error: bool = False) -> Column:
    """correct: label >= 0.6 and distance <= 4; error: both the other way; else U. A NaN label is U, or taken as -1."""
    y = F.when(F.isnan(label), -1.0).otherwise(label) if nan_is_error else label
    known = finite(y) & finite(distance)
    return F.when(known & (y >= 0.6) & (distance <= 4.0), "correct").when(known & (y < 0.6) & (distance > 4.0), "error").otherwise("U")


def f_state(mean: Column) -> Column:
    return F.when(mean >= 1.5, "flexible").when(mean <= 1.0, "ordered").otherwise("U")


_STATES = "CASE WHEN label >= CAST(0.6 AS DOUBLE) AND channel_b * 100 <= 4 THEN 'correct' WHEN label < CAST(0.6 AS DOUBLE) AND channel_b * 100 > 4 THEN 'error' ELSE 'U' END"


@query(f"""WITH {LEDGER_SQL}, s AS (SELECT {_STATES} AS e_state, CASE WHEN pos >= 5 THEN 'flexible' WHEN pos <= 2 THEN 'ordered' ELSE 'U' END AS f_state,
CASE WHEN feature <= 20 THEN 0 WHEN feature < 80 THEN 1 ELSE 2 END AS band FROM ledger)
SELECT e_state, f_state, band, count(*) AS n FROM s GROUP BY ALL""")
def residue_states(spark, sf_dir):
    """states of both channels and the band, with closed outer edges."""
    d = ledger(spark, sf_dir).select(e_state(F.col("label"), F.col("channel_b") * 100).alias("e_state"), F.when(F.col("pos") >= 5, 2.0).when(F.col("pos") <= 2, 0.5).otherwise(1.2).alias("m"), "feature")
    band = F.when(F.col("feature") <= 20, 0).when(F.col("feature") < 80, 1).otherwise(2)
    return d.select("e_state", f_state(F.col("m")).alias("f_state"), band.alias("band")).groupBy("e_state", "f_state", "band").agg(F.count("*").alias("n"))


@query(f"""WITH {LEDGER_SQL}, g AS (SELECT entry, count(*) AS total, count(*) FILTER (chain = 'N') AS unmapped, bool_and(label >= CAST(0.05 AS DOUBLE) AND channel_a <= CAST(0.07 AS DOUBLE)) AS thresholds FROM ledger GROUP BY entry)
SELECT CASE WHEN total = 0 OR 5 * unmapped > total THEN 'gap_share' WHEN NOT thresholds THEN 'threshold' ELSE 'ok' END AS status, count(*) AS entries, CAST(sum(total) AS BIGINT) AS n FROM g GROUP BY status""")
def entry_gates(spark, sf_dir):
    """An integer ratio gate (equality passes), then thresholds over all rows of an entry."""
    g = ledger(spark, sf_dir).groupBy("entry").agg(F.count("*").alias("total"), F.count_if(F.col("chain") == "N").alias("unmapped"), F.bool_and((F.col("label") >= 0.05) & (F.col("channel_a") <= 0.07)).alias("ok"))
    status = F.when((F.col("total") == 0) | (5 * F.col("unmapped") > F.col("total")), "gap_share").when(~F.col("ok"), "threshold").otherwise("ok")
    return g.groupBy(status.alias("status")).agg(F.count("*").alias("entries"), F.sum("total").alias("n"))


@query("""SELECT year(o_orderdate) AS y, count(*) FILTER (CAST(o_orderdate AS DATE) < DATE '1997-06-01') AS admitted, count(*) FILTER (strftime(o_orderdate, '%Y-%m-%d') <= '1996-04-30') AS before_cut,
count(*) FILTER (strftime(o_orderdate, '%Y-%m-%d') > '1998-02-15') AS after_cut, min(strftime(o_orderdate, '%Y-%m-%d')) FILTER (o_orderstatus = 'F') AS first_f, max(strftime(o_orderdate, '%Y-%m-%d')) FILTER (o_orderstatus = 'none') AS last_none FROM orders GROUP BY y""")
def date_admission(spark, sf_dir):
    """Admission strictly before a day, cut-offs on ISO dates, extremes of a subset (null where it is empty)."""
    day = F.to_date("o_orderdate")
    count = lambda c, name: F.count_if(c).alias(name)
    return load(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(
        count(day < F.lit("1997-06-01").cast("date"), "admitted"), count(day <= F.lit("1996-04-30").cast("date"), "before_cut"), count(day > F.lit("1998-02-15").cast("date"), "after_cut"),
        F.min(F.when(F.col("o_orderstatus") == "F", day.cast("string"))).alias("first_f"), F.max(F.when(F.col("o_orderstatus") == "none", day.cast("string"))).alias("last_none"))


@query("""WITH t AS (SELECT c_custkey, ' ' || lower(c_name) || '-' || CAST(c_nationkey AS VARCHAR) || ' ' AS raw FROM customer)
SELECT c_custkey, regexp_replace(upper(trim(raw)), '-[0-9]+$', '') AS base, split_part(trim(raw), '#', 1) AS stem, split_part(trim(raw), '#', 1) = 'customer' AS same, regexp_matches(upper(regexp_replace(raw, '\\s', '', 'g')), '^[A-Z]+$') AS letters_only,
substr(raw, 1, 10) AS clipped, 'https://host/' || trim(raw) || '/v6.cif' AS url, TRY_CAST(split_part(trim(raw), '-', 2) AS INTEGER) AS version FROM t""")
def identifiers(spark, sf_dir):
    """Identifier normalisation, tolerant equality, clipping, templates, safe integers."""
    raw = F.concat(F.lit(" "), F.lower("c_name"), F.lit("-"), F.col("c_nationkey").cast("string"), F.lit(" "))
    t = load(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))
    trimmed, stem = F.trim("raw"), F.substring_index(F.trim("raw"), "#", 1)
    return t.select(
        "c_custkey", F.regexp_replace(F.upper(trimmed), "-[0-9]+$", "").alias("base"), stem.alias("stem"), (stem == "customer").alias("same"), F.upper(F.regexp_replace("raw", r"\s", "")).rlike("^[A-Z]+$").alias("letters_only"),
        F.substring(F.coalesce("raw", F.lit("")), 1, 10).alias("clipped"), F.format_string("https://host/%s/v6.cif", trimmed).alias("url"), F.split_part(trimmed, F.lit("-"), F.lit(2)).try_cast("int").alias("version"))


@query(f"""WITH {LEDGER_SQL} SELECT sha256(accession || '|' || entry || '|' || chain || '|' || pos) AS row_key, sha256('salt' || entry) AS order_key, pos, round(1 - feature / 101, 9) AS score_low, round(feature / 101, 9) AS score_high FROM ledger""")
def surrogate_keys(spark, sf_dir):
    """Digest keys, salted order keys, per-class scores."""
    return ledger(spark, sf_dir).select(F.sha2(F.concat_ws("|", "accession", "entry", "chain", "pos"), 256).alias("row_key"), F.sha2(F.concat(F.lit("salt"), F.col("entry")), 256).alias("order_key"), "pos",
                                        F.round(1 - F.col("feature") / 101, 9).alias("score_low"), F.round(F.col("feature") / 101, 9).alias("score_high"))


@query("""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'no date at all' ELSE 'modelCreatedDate=' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || ' !< release=' || strftime(o_orderdate - INTERVAL 30 DAY, '%Y-%m-%d') END AS detail FROM orders)
SELECT coalesce(nullif(regexp_extract(detail, 'modelCreatedDate=(\\d{4})-', 1), ''), 'undated') AS model_year, nullif(regexp_extract(detail, 'release=(\\d{4}-\\d{2})', 1), '') AS release_month, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM orders), 1) AS pct FROM d GROUP BY ALL""")
def dates_in_text(spark, sf_dir):
    """Dates out of free text; rows without one are listed as undated; shares in percent."""
    when = F.col("o_orderdate").cast("timestamp")
    text = F.concat(F.lit("modelCreatedDate="), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" !< release="), F.date_format(F.date_sub(F.to_date(when), 30), "yyyy-MM-dd"))
    d = load(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 7 == 0, "no date at all").otherwise(text).alias("detail"))
    found = lambda p: F.nullif(F.regexp_extract("detail", p, 1), F.lit(""))
    g = d.groupBy(F.coalesce(found(r"modelCreatedDate=(\d{4})-"), F.lit("undated")).alias("model_year"), found(r"release=(\d{4}-\d{2})").alias("release_month")).agg(F.count("*").alias("n"))
    total = F.broadcast(d.agg(F.count("*").alias("total")))  # one row
    return g.join(total).select("model_year", "release_month", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))


@query("""WITH w AS (SELECT k, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CASE WHEN k = 1 THEN 0 ELSE 2 + 7 * (k - 2) END AS a, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (2 + 7 * (k - 1)) AS b FROM (SELECT unnest(range(1, 13)) AS k))
SELECT CAST(k AS INTEGER) AS batch_index, strftime(a, '%Y-%m-%dT%H:%M:%S') AS opens, strftime(b, '%Y-%m-%dT%H:%M:%S') AS closes, count(event_id) AS n FROM w LEFT JOIN events ON ts > a AND ts <= b GROUP BY ALL""")
def batch_windows(spark, sf_dir):
    """Windows (start, close] by event time; the first is of two days, the others of seven; empty windows stay.

    The index of an event's window is arithmetic, so that the join is on equality.
    """
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp")
    days = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(t0)) / 86_400_000_000
    k = F.when(days > 0, F.when(days <= 2, 1).otherwise(F.ceil((days - 2) / 7) + 1)).cast("int")
    n = load(spark, sf_dir, "events").groupBy(k.alias("batch_index")).agg(F.count("*").alias("n"))
    w = spark.range(1, 13).select(F.col("id").cast("int").alias("batch_index"))
    at = lambda d: F.date_format(F.timestamp_add("DAY", d, t0), "yyyy-MM-dd'T'HH:mm:ss")
    w = w.select("batch_index", at(F.when(F.col("batch_index") == 1, 0).otherwise(2 + 7 * (F.col("batch_index") - 2))).alias("opens"), at(2 + 7 * (F.col("batch_index") - 1)).alias("closes"))
    return w.join(F.broadcast(n.where("batch_index between 1 and 12")), "batch_index", "left").select("batch_index", "opens", "closes", F.coalesce("n", F.lit(0)).alias("n"))  # twelve rows


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN json_type(props, '$.missing') IS NULL THEN 'MISSING' WHEN json_type(props, '$.missing') = 'NULL' THEN 'NULL' ELSE 'VALUE' END AS missing_state, CASE WHEN json_type(props, '$.k') IS NULL THEN 'MISSING' WHEN json_type(props, '$.k') = 'NULL' THEN 'NULL' ELSE 'VALUE' END AS k_state FROM events""")
def json_paths(spark, sf_dir):
    """Paths into JSON, where a missing key and a null are two states."""
    e = load(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))

    def state(path: str) -> Column:
        there = F.array_contains(F.expr("map_keys(cast(v as map<string, variant>))"), path)
        value = F.try_variant_get("v", f"$.{path}", "string")
        return F.when(~there, "MISSING").when(value.isNull(), "NULL").otherwise("VALUE")

    return e.select("event_id", F.try_variant_get("v", "$.k", "int").alias("k"), state("missing").alias("missing_state"), state("k").alias("k_state"))


def flatten_mappings(payloads: DataFrame) -> DataFrame:
    """(payload) JSON text {entry: {UniProt: {accession: {mappings: [...]}}}} to a row a segment; author numbers may be null."""
    schema = "map<string,struct<UniProt:map<string,struct<mappings:array<struct<chain_id:string,unp_start:int,unp_end:int,start:struct<author_residue_number:int,residue_number:int>,end:struct<author_residue_number:int,residue_number:int>>>>>>>"
    entries = payloads.select(F.explode(F.from_json("payload", schema)).alias("entry", "e"))
    accs = entries.select("entry", F.explode("e.UniProt").alias("accession", "a"))
    rows = accs.select("entry", "accession", F.posexplode("a.mappings").alias("segment", "m"))
    same = F.col("m.end.residue_number") - F.col("m.start.residue_number") == F.col("m.unp_end") - F.col("m.unp_start")
    return rows.select("entry", "accession", "segment", F.col("m.chain_id").alias("chain"), F.col("m.start.residue_number").alias("first"), F.col("m.end.residue_number").alias("last"), F.col("m.unp_start").alias("unp_start"), F.col("m.start.author_residue_number").alias("author_first"), (~F.coalesce(same, F.lit(False))).alias("needs_alignment"))


@query("""WITH s AS (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS b, min(l_suppkey) AS off FROM lineitem GROUP BY l_orderkey),
m AS (SELECT l_orderkey, unnest(range(a, b + 1)) AS pos, off, a FROM s)
SELECT m.l_orderkey, count(*) AS mapped, CAST(sum(off + pos - a) AS BIGINT) AS unp_sum, count(DISTINCT off - a) = 1 AS constant_offset, CAST(min_by(off + pos - a, pos) AS BIGINT) AS first_unp FROM m GROUP BY m.l_orderkey""")
def offset_map(spark, sf_dir):
    """Segments as ranges, exploded to positions with their offset."""
    s = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"), F.min("l_suppkey").alias("off"))
    m = s.select("l_orderkey", "off", "a", F.explode(F.sequence("a", "b")).alias("pos")).withColumn("unp", F.col("off") + F.col("pos") - F.col("a"))
    return m.groupBy("l_orderkey").agg(F.count("*").alias("mapped"), F.sum("unp").alias("unp_sum"), (F.count_distinct(F.col("off") - F.col("a")) == 1).alias("constant_offset"), F.min_by("unp", "pos").alias("first_unp"))


@query("""WITH b AS (SELECT item_id, translate(regexp_replace(coalesce(text, ''), '\\s', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS s FROM benchmark), k AS (SELECT unnest([1, 2, 3, 7]) AS shift),
m AS (SELECT item_id, shift, substr(s, CAST(i AS BIGINT), 1) = substr(s, CAST(i + shift AS BIGINT), 1) AS same FROM (SELECT item_id, s, shift, unnest(range(1, length(s) - shift + 1)) AS i FROM b, k WHERE length(s) > shift))
SELECT item_id, CAST(shift AS INTEGER) AS shift, count(*) AS compared, round(avg(CAST(same AS INT)), 9) AS identity FROM m GROUP BY ALL""")
def self_shift_identity(spark, sf_dir):
    """Share of positions equal to the one so many places on; counted inside the row, without exploding."""
    chars = F.split(ascii_upper(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")), "")
    b = load(spark, sf_dir, "benchmark").select("item_id", F.array_remove(chars, "").alias("s")).select("item_id", "s", F.explode(F.array(*map(F.lit, (1, 2, 3, 7)))).alias("shift")).where("size(s) > shift")
    n = F.size("s") - F.col("shift")
    same = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + (F.get("s", i) == F.get("s", i + F.col("shift"))).cast("int"))
    return b.select("item_id", "shift", n.cast("long").alias("compared"), F.round(same / n, 9).alias("identity"))


@query(f"""WITH {LEDGER_SQL}, s AS (SELECT {_STATES} AS state FROM ledger), v(state, recorded) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in STATUSES)})
SELECT v.state, recorded, count(s.state) AS n FROM v LEFT JOIN s USING (state) GROUP BY ALL""")
def status_vocabulary(spark, sf_dir):
    """Every status of the vocabulary has a row, used or not."""
    used = ledger(spark, sf_dir).groupBy(e_state(F.col("label"), F.col("channel_b") * 100).alias("state")).agg(F.count("*").alias("n"))
    return spark.createDataFrame(STATUSES, "state string, recorded string").join(F.broadcast(used), "state", "left").select("state", "recorded", F.coalesce("n", F.lit(0)).alias("n"))  # a row a status


@F.arrow_udf(StringType())
def canonical_json(values: pa.Array) -> pa.Array:
    """Sorted keys, no spaces, ASCII, of a map."""
    out = [None if v is None else json.dumps(dict(v), sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False) for v in values.to_pylist()]
    return pa.array(out, pa.string())


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":"' || p_size || '"}') AS digest, sha256('{"name":"' || p_name || '"}') AS self_digest FROM part""")
def canonical_digest(spark, sf_dir):
    """Digest of the canonical JSON of a record; a self digest leaves out keys."""
    p = load(spark, sf_dir, "part")
    whole = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    return p.select("p_partkey", F.sha2(canonical_json(whole), 256).alias("digest"), F.sha2(canonical_json(F.map_filter(whole, lambda k, v: k == "name")), 256).alias("self_digest"))


@F.arrow_udf(DoubleType())
def round_half_even(x: pa.Array) -> pa.Array:
    """Rounding to four decimals on the binary value, ties to even; NaN and null stay what they are, which pandas would mix up."""
    return pa.array([None if v is None else round(v, 4) for v in x.to_pylist()], pa.float64())


@query(f"WITH {LEDGER_SQL} SELECT accession, entry, pos, round_even(label * CAST(1.00005 AS DOUBLE), 4) AS label4 FROM ledger")
def rounded_labels(spark, sf_dir):
    """E6 over the ledger; SQL's rounding differs on values within a bit of a half, of which these tables have none, so a test compares with Python's round as well."""
    return ledger(spark, sf_dir).select("accession", "entry", "pos", round_half_even(F.col("label") * 1.00005).alias("label4"))
