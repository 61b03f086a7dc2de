"""Admission of models, profiles of flexibility, resolution of chains, and the vocabulary of statuses that they record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.plans.registry import query
from ledgerlake.sources.tables import load, parts_of

#: The statuses, each with the kind of table that records it.
VOCABULARY = (
    ("FIT_FAILURE", "evaluation"), ("UNDER_SUPPORTED_STRATUM", "evaluation"), ("DEFERRED_INSUFFICIENT_SUPPORT", "evaluation"), ("DEFERRED_INSUFFICIENT_SUPPORT_AT_CLOSE", "close report"),
    ("E422_PRE_SNAPSHOT_RELEASE", "exclusions"), ("E422_MODEL_CREATED_DATE_MISSING", "receipts"), ("E422_MODEL_CREATED_DATE_MISMATCH", "receipts"), ("E422_AFDB_VERSION_MISMATCH", "receipts"), ("E422_CHILD_URL_NOT_V6", "receipts"),
    ("E422_ABSENT_FROM_SNAPSHOT", "exclusions"), ("E422_SOURCE_CONTRACT_FAILURE", "receipts"), ("E422_MANIFEST_DIGEST_MISMATCH", "manifest"), ("E422_MANIFEST_SCHEMA_INVALID", "manifest"),
    ("HOLD", "evaluation"), ("FAIL", "evaluation"), ("REPLICATE", "evaluation"), ("FALSIFY", "evaluation"), ("WIN", "evaluation"), ("MIRRORED_WIN", "evaluation"), ("NO_DECISION", "evaluation"),
)
MISSING_DATE, TOO_LATE, ABSENT = "E422_MODEL_CREATED_DATE_MISSING", "E422_PRE_SNAPSHOT_RELEASE", "E422_ABSENT_FROM_SNAPSHOT"
#: Flags of a profile row, and its outer edges.
FLAGS, FLEXIBLE, ORDERED = ("gap", "hetatm", "corrected", "no_fullbb", "no_ca"), 1.5, 1.0


def instant(text: Column) -> Column:
    """An ISO instant in UTC; with Z or an offset as it says, without one taken as UTC. The session's time zone is UTC."""
    return F.trim(text).try_cast("timestamp")


def created_day(text: Column) -> Column:
    """The day of a creation date; null where the first ten characters are no date."""
    day = F.substring(F.trim(text), 1, 10)
    return F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day.try_cast("date"))


def temporal_status(created: Column, t0: Column) -> Column:
    """null if the UTC day of creation lies strictly before that of t0, else the code of the failure; the same day is refused."""
    day = created_day(created)
    return F.when(day.isNull(), MISSING_DATE).when(day >= instant(t0).cast("date"), TOO_LATE)


def selected_models(models: DataFrame) -> DataFrame:
    """(accession, created, entity) of the earliest record, then the least entity; records without a date that parses are skipped."""
    fine = models.where(created_day(F.col("created")).isNotNull())
    best = fine.groupBy("accession").agg(F.min(F.struct(F.trim("created").alias("created"), F.coalesce("entity", F.lit("")).alias("entity"))).alias("m"))
    return models.select("accession").distinct().join(best, "accession", "left").select("accession", "m.created", "m.entity")


_MODELS_SQL = """m AS (SELECT o_custkey AS accession, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' WHEN o_orderkey % 7 = 0 THEN NULL ELSE ' ' || strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' END AS created, o_orderpriority AS entity FROM orders),
s AS (SELECT accession, min({'created': trim(created), 'entity': entity}) FILTER (TRY_CAST(substr(trim(created), 1, 10) AS DATE) IS NOT NULL) AS b FROM m GROUP BY accession)"""


@query(f"""WITH {_MODELS_SQL} SELECT accession, b.created AS created, b.entity AS entity, CASE WHEN b IS NULL THEN '{MISSING_DATE}' WHEN TRY_CAST(substr(b.created, 1, 10) AS DATE) >= DATE '1996-06-01' THEN '{TOO_LATE}' END AS failure FROM s""")
def model_admission(spark, sf_dir):
    """The record of each accession that is selected, and why it may not be admitted."""
    o = load(spark, sf_dir, "orders")
    created = F.when(F.col("o_orderkey") % 5 == 0, "unknown").when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.concat(F.lit(" "), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd"), F.lit("T00:00:00Z")))
    models = o.select(F.col("o_custkey").alias("accession"), created.alias("created"), F.col("o_orderpriority").alias("entity"))
    return selected_models(models).withColumn("failure", temporal_status(F.col("created"), F.lit("1996-06-01T12:00:00Z")))


def profile_state(values: Column, flags: Column) -> Column:
    """(state, reason) of exactly three replicates (array of double) and the five flags (array of text, null: not given)."""
    bad = lambda ok, why: F.when(ok, F.struct(F.lit("U").alias("state"), F.lit(why).alias("reason")))
    literal = lambda i: F.trim(F.get(flags, F.lit(i)))
    checks = [
        bad(values.isNull() | (F.size(values) != 3), "u_replicates_not_three"), bad(F.exists(values, lambda v: v.isNull()), "u_replicate_type_invalid"),
        bad(F.exists(values, lambda v: F.isnan(v) | (F.abs(v) == float("inf"))), "u_replicate_nonfinite"), bad(F.exists(values, lambda v: v < 0), "u_replicate_negative"),
    ]
    for i, name in enumerate(FLAGS):
        checks += [bad(literal(i).isNotNull() & ~literal(i).isin("0", "1"), f"u_flag_literal_invalid:{name}"), bad(literal(i) == "1", f"u_nonzero_flag:{name}")]
    mean = (F.get(values, F.lit(0)) + F.get(values, F.lit(1)) + F.get(values, F.lit(2))) / 3
    state = F.when(mean >= FLEXIBLE, "flexible").when(mean <= ORDERED, "ordered").otherwise("U")
    return F.coalesce(*checks, F.struct(state.alias("state"), F.when(state == "U", "u_rmsf_ambiguous_interval").otherwise("").alias("reason")))


def profile_evidence(rows: DataFrame, intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (scope, ordinal, number, gap, values, flags) and intervals (scope, first, last, start) to states by position, and by scope what was not mapped.

    A number that lies in one interval is mapped, in several ambiguous. A scope of which more than a fifth is not mapped is rejected.
    Scopes are dealt over parts of bounded size, once for all joins; a row takes its state along, not what the state is told by.
    """
    parts = parts_of(rows)
    rows = rows.withColumn("s", profile_state(F.col("values"), F.col("flags"))).drop("values", "flags").repartition(parts, "scope")
    intervals = intervals.repartition(parts, "scope")
    hit = rows.join(intervals, "scope").where((~F.col("gap")) & F.col("number").between(F.col("first"), F.col("last")))
    mapped = hit.groupBy("scope", "ordinal").agg(F.count("*").alias("hits"), F.first(F.col("start") + F.col("number") - F.col("first")).alias("position"))
    each = rows.join(mapped, ["scope", "ordinal"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    reason = F.when(F.col("gap"), "atlas_gap").when(F.col("hits") != 1, "missing_atlas_join").otherwise(F.col("s.reason"))
    states = each.select("scope", "ordinal", F.when(F.col("hits") == 1, F.col("position")).alias("position"), F.when(F.col("hits") == 1, F.col("s.state")).otherwise("U").alias("state"), reason.alias("reason"))
    t = each.groupBy("scope").agg(F.count("*").alias("n"), F.count_if(F.col("hits") != 1).alias("unmapped"), F.count_if("gap").alias("gaps"), F.count_if(F.col("hits") > 1).alias("ambiguous"))
    return states, t.withColumn("accepted", 5 * F.col("unmapped") <= F.col("n"))


_PROFILE_SQL = """r AS (SELECT l_orderkey AS scope, l_linenumber AS number, l_quantity = 7 AS gap, l_tax * 25 AS v, CASE WHEN l_discount = 0 THEN '1' WHEN l_discount = CAST(0.01 AS DOUBLE) THEN 'x' ELSE '0' END AS flag, l_partkey % 29 = 0 AS two FROM lineitem),
i AS (SELECT o_orderkey AS scope, 1 AS a, 4 AS b, 100 AS start FROM orders UNION ALL SELECT o_orderkey, 4, 9, 200 FROM orders WHERE o_custkey % 3 = 0 UNION ALL SELECT o_orderkey, 5, 6, 300 FROM orders WHERE o_custkey % 3 <> 0),
m AS (SELECT scope, number, count(*) AS hits FROM (SELECT DISTINCT scope, number FROM r) JOIN i USING (scope) WHERE number BETWEEN a AND b GROUP BY ALL),
e AS (SELECT r.*, CASE WHEN gap THEN 0 ELSE coalesce(hits, 0) END AS hits FROM r LEFT JOIN m USING (scope, number))"""


@query(f"""WITH {_PROFILE_SQL}, s AS (SELECT *, CASE WHEN gap THEN 'atlas_gap' WHEN hits <> 1 THEN 'missing_atlas_join' WHEN two THEN 'u_replicates_not_three' WHEN flag = 'x' THEN 'u_flag_literal_invalid:gap' WHEN flag = '1' THEN 'u_nonzero_flag:gap'
  WHEN (v + v + v) / 3 >= 1.5 OR (v + v + v) / 3 <= 1 THEN '' ELSE 'u_rmsf_ambiguous_interval' END AS reason FROM e)
SELECT reason, CASE WHEN reason = '' THEN CASE WHEN (v + v + v) / 3 >= 1.5 THEN 'flexible' ELSE 'ordered' END ELSE 'U' END AS state, count(*) AS n FROM s GROUP BY ALL""")
def profile_states(spark, sf_dir):
    """States of replicates with flags, mapped through intervals; every reason is counted."""
    return profile_evidence(*_profiles(spark, sf_dir))[0].groupBy("reason", "state").agg(F.count("*").alias("n"))


@query(f"WITH {_PROFILE_SQL} SELECT count(*) AS scopes, count(*) FILTER (accepted) AS accepted, CAST(sum(unmapped) AS BIGINT) AS unmapped, CAST(sum(gaps) AS BIGINT) AS gaps, CAST(sum(ambiguous) AS BIGINT) AS ambiguous FROM (SELECT scope, 5 * count(*) FILTER (hits <> 1) <= count(*) AS accepted, count(*) FILTER (hits <> 1) AS unmapped, count(*) FILTER (gap) AS gaps, count(*) FILTER (hits > 1) AS ambiguous FROM e GROUP BY scope)")
def profile_gaps(spark, sf_dir):
    """What was not mapped, by scope, and how many scopes pass the integer gate."""
    t = profile_evidence(*_profiles(spark, sf_dir))[1]
    return t.agg(F.count("*").alias("scopes"), F.count_if("accepted").alias("accepted"), F.sum("unmapped").alias("unmapped"), F.sum("gaps").alias("gaps"), F.sum("ambiguous").alias("ambiguous"))


def _profiles(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    l, v = load(spark, sf_dir, "lineitem"), F.col("l_tax") * 25
    flag = F.when(F.col("l_discount") == 0, "1").when(F.col("l_discount") == 0.01, "x").otherwise("0")
    values = F.when(F.col("l_partkey") % 29 == 0, F.array(v, v)).otherwise(F.array(v, v, v))
    # lines of an order may share a number: the ordinal tells rows apart
    rows = l.select(F.col("l_orderkey").alias("scope"), F.xxhash64("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("ordinal"), F.col("l_linenumber").alias("number"), (F.col("l_quantity") == 7).alias("gap"), values.alias("values"), F.array(flag, F.lit("0")).alias("flags"))
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scope"), (F.col("o_custkey") % 3 == 0).alias("third"))
    part = lambda first, last, start: F.struct(F.lit(first).alias("first"), F.lit(last).alias("last"), F.lit(start).alias("start"))
    return rows, o.select("scope", F.explode(F.when(F.col("third"), F.array(part(1, 4, 100), part(4, 9, 200))).otherwise(F.array(part(1, 4, 100), part(5, 6, 300)))).alias("i")).select("scope", "i.*")


@query("""WITH m AS (SELECT l_orderkey AS entry, l_returnflag AS chain, count(DISTINCT l_suppkey) AS accs, min(l_suppkey) AS acc, min(1 - l_discount) AS identity FROM lineitem GROUP BY ALL),
w AS (SELECT o_orderkey AS entry, unnest(['A', 'N', 'R']) AS chain FROM orders)
SELECT CASE WHEN m.entry IS NULL THEN 'CHAIN_UNRESOLVED' WHEN accs > 1 THEN 'CHAIN_AMBIGUOUS' WHEN identity < CAST(0.92 AS DOUBLE) THEN 'SEGMENT_THRESHOLD_FAILURE' WHEN s.s_suppkey IS NULL OR s.s_nationkey = 3 THEN 'PRIMARY_FAILURE' WHEN s.s_acctbal < 0 THEN 'METADATA_FAILURE' ELSE 'available' END AS status, count(*) AS n
FROM w LEFT JOIN m USING (entry, chain) LEFT JOIN supplier s ON s.s_suppkey = acc GROUP BY ALL""")
def chain_availability(spark, sf_dir):
    """Q5: every chain asked for ends in one status: resolved to one accession, over the threshold, with its record and metadata; none is lost."""
    m = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("entry"), F.col("l_returnflag").alias("chain")).agg(F.count_distinct("l_suppkey").alias("accs"), F.min("l_suppkey").alias("s_suppkey"), F.min(1 - F.col("l_discount")).alias("identity"))
    asked = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), F.explode(F.array(*map(F.lit, "ANR"))).alias("chain"))
    all_ = asked.join(m, ["entry", "chain"], "left").join(load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_suppkey", "left")
    status = (
        F.when(F.col("accs").isNull(), "CHAIN_UNRESOLVED").when(F.col("accs") > 1, "CHAIN_AMBIGUOUS").when(F.col("identity") < 0.92, "SEGMENT_THRESHOLD_FAILURE")
        .when(F.col("s_nationkey").isNull() | (F.col("s_nationkey") == 3), "PRIMARY_FAILURE").when(F.col("s_acctbal") < 0, "METADATA_FAILURE").otherwise("available")
    )
    return all_.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(f"""WITH {_MODELS_SQL}, v(status, recorded) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in VOCABULARY)}),
f AS (SELECT CASE WHEN b IS NULL THEN '{MISSING_DATE}' WHEN TRY_CAST(substr(b.created, 1, 10) AS DATE) >= DATE '1996-06-01' THEN '{TOO_LATE}' END AS status FROM s
      UNION ALL SELECT '{ABSENT}' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
SELECT v.status, recorded, count(f.status) AS n FROM v LEFT JOIN f USING (status) GROUP BY ALL""")
def status_registry(spark, sf_dir):
    """All twenty statuses, each with its one recording place and how often it was given; one that is unknown is an error."""
    absent = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("accession")).join(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("accession")), "accession", "left_anti")
    given = model_admission(spark, sf_dir).where("failure is not null").select(F.col("failure").alias("status")).unionByName(absent.select(F.lit(ABSENT).alias("status")))
    known = spark.createDataFrame(VOCABULARY, "status string, recorded string")
    n = given.groupBy("status").agg(F.count("*").alias("n"))
    both = F.broadcast(known).join(n, "status", "full")  # twenty rows against as many
    unknown = F.when(F.col("recorded").isNull(), F.raise_error(F.concat(F.lit("unknown status: "), "status")))
    return both.select("status", F.coalesce("recorded", unknown.cast("string")).alias("recorded"), F.coalesce("n", F.lit(0)).alias("n"))


def truncated_map(segments: DataFrame) -> DataFrame:
    """(*, number, unp) of segments (first, last, unp_start, unp_end): offsets from the start, cut off where unp_end is reached."""
    last = F.least(F.col("last"), F.col("first") + F.col("unp_end") - F.col("unp_start"))
    whole = segments.where(F.col("first") <= last).withColumn("number", F.explode(F.sequence(F.col("first"), last)))
    return whole.withColumn("unp", F.col("unp_start") + F.col("number") - F.col("first"))


@query("""WITH s AS (SELECT o_orderkey, 1 AS a, CAST(o_custkey % 7 AS INT) AS b, 10 AS u, 10 + CAST(o_orderkey % 5 AS INT) AS v FROM orders)
SELECT o_orderkey, count(*) AS mapped, CAST(min(u + n - a) AS BIGINT) AS least, CAST(max(u + n - a) AS BIGINT) AS greatest FROM (SELECT *, unnest(range(a, least(b, a + v - u) + 1)) AS n FROM s) GROUP BY o_orderkey""")
def truncated_offsets(spark, sf_dir):
    """Offset maps of unequal spans, cut off at the shorter."""
    s = load(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("first"), (F.col("o_custkey") % 7).cast("int").alias("last"), F.lit(10).alias("unp_start"), (10 + F.col("o_orderkey") % 5).cast("int").alias("unp_end"))
    return truncated_map(s).groupBy("o_orderkey").agg(F.count("*").alias("mapped"), F.min("unp").cast("long").alias("least"), F.max("unp").cast("long").alias("greatest"))
