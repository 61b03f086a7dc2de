"""Aggregations over the ledger and over labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators.orderstats import medians, quantiles
from ledgerlake.plans.registry import query
from ledgerlake.sources.tables import LEDGER_SQL, ledger, load

REASONS = ("null_label", "nonfinite_label", "null_feature", "nonfinite_feature", "feature_out_of_grid", "null_descriptive_channel")


@query(f"""WITH {LEDGER_SQL},
d AS (SELECT CASE WHEN pos = 7 THEN NULL ELSE label END AS label, CASE WHEN pos = 6 AND chain = 'A' THEN CAST('nan' AS DOUBLE) WHEN pos = 5 AND chain = 'R' THEN NULL ELSE feature + CASE WHEN chain = 'N' AND pos = 1 THEN 60 ELSE 0 END END AS feature, CASE WHEN channel_b = 0 THEN NULL ELSE channel_b END AS b FROM ledger),
r AS (SELECT CASE WHEN label IS NULL THEN 'null_label' WHEN NOT isfinite(label) THEN 'nonfinite_label' WHEN feature IS NULL THEN 'null_feature' WHEN NOT isfinite(feature) THEN 'nonfinite_feature'
                  WHEN feature < 0 OR feature >= CAST(100.01 AS DOUBLE) THEN 'feature_out_of_grid' WHEN b IS NULL THEN 'null_descriptive_channel' END AS reason FROM d)
SELECT reason, count(k) AS n FROM (VALUES {", ".join(f"('{x}')" for x in REASONS)}) AS t(reason) LEFT JOIN (SELECT reason, 1 AS k FROM r) USING (reason) GROUP BY reason""")
def eligibility_tally(spark, sf_dir):
    """typed exclusion, first match wins; every reason has a count, zero included."""
    d = ledger(spark, sf_dir)
    feature = F.when((F.col("pos") == 6) & (F.col("chain") == "A"), float("nan")).when((F.col("pos") == 5) & (F.col("chain") == "R"), None).otherwise(F.col("feature") + F.when((F.col("chain") == "N") & (F.col("pos") == 1), 60).otherwise(0))
    d = d.select(F.when(F.col("pos") != 7, F.col("label")).alias("label"), feature.alias("feature"), F.when(F.col("channel_b") != 0, F.col("channel_b")).alias("b"))
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    reason = F.when(F.col("label").isNull(), REASONS[0]).when(~finite("label"), REASONS[1]).when(F.col("feature").isNull(), REASONS[2]).when(~finite("feature"), REASONS[3])
    reason = reason.when((F.col("feature") < 0) | (F.col("feature") >= 100.01), REASONS[4]).when(F.col("b").isNull(), REASONS[5])
    tally = d.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(r,) for r in REASONS], "reason string").join(F.broadcast(tally), "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {LEDGER_SQL} SELECT accession, chain, count(*) AS n, round(quantile_cont(label, 0.5), 9) AS median_label, round(min(label), 9) AS least, round(max(label), 9) AS most, round(quantile_cont(feature, 0.5), 9) AS median_feature,
count(*) >= 30 AND quantile_cont(feature, 0.5) >= 50 AND quantile_cont(label, 0.5) < CAST(0.4 AS DOUBLE) AS suspect FROM ledger GROUP BY accession, chain""")
def segment_medians(spark, sf_dir):
    """Exact medians by segment and the suspect screen."""
    d, by = ledger(spark, sf_dir), ["accession", "chain"]
    g = d.groupBy(by).agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b"))
    g = g.join(medians(d, by, {"m": "label", "f": "feature"}), by)
    return g.select("accession", "chain", "n", F.round("m", 9).alias("median_label"), F.round("a", 9).alias("least"), F.round("b", 9).alias("most"), F.round("f", 9).alias("median_feature"), ((F.col("n") >= 30) & (F.col("f") >= 50) & (F.col("m") < 0.4)).alias("suspect"))


@query(f"""WITH {LEDGER_SQL}, q AS (SELECT accession, quantile_cont(label, 0.5) AS m, quantile_cont(label, 0.25) AS a, quantile_cont(label, 0.75) AS b FROM ledger GROUP BY accession)
SELECT accession, entry, pos, round((label - m) / CASE WHEN b - a = 0 THEN 1 ELSE b - a END, 6) AS z FROM ledger JOIN q USING (accession)""")
def robust_z(spark, sf_dir):
    """A2: (x - median) / interquartile range within a group, range 0 taken as 1."""
    d = ledger(spark, sf_dir)
    q = quantiles(d, ["accession"], "label", [0.25, 0.5, 0.75])
    iqr = F.col("q")[2] - F.col("q")[0]
    return d.join(q, "accession").select("accession", "entry", "pos", F.round((F.col("label") - F.col("q")[1]) / F.when(iqr == 0, 1.0).otherwise(iqr), 6).alias("z"))


_CELL = "CASE WHEN quality = 1 AND toxic = 0 THEN 'OC' WHEN quality = 1 THEN 'O' WHEN toxic = 0 THEN 'A' ELSE 'B' END"


@query(f"""WITH c AS (SELECT source, doc_id, lang, {_CELL} AS cell FROM labels JOIN documents USING (doc_id))
SELECT source, count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) FILTER (cell = 'A') AS n_a, count(*) FILTER (cell = 'B') AS n_b, count(*) FILTER (cell = 'O') AS n_o, count(*) FILTER (cell = 'OC') AS n_oc,
CASE WHEN count(DISTINCT cell) FILTER (true) = 1 THEN min(cell) ELSE 'MIXED' END AS verdict FROM c GROUP BY source""")
def four_cell_census(spark, sf_dir):
    """Cell counts, distinct ids and a verdict by group."""
    cell = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "OC").when(F.col("quality") == 1, "O").when(F.col("toxic") == 0, "A").otherwise("B")
    c = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("source", "doc_id", cell.alias("cell"))
    count = lambda x: F.count_if(F.col("cell") == x).alias(f"n_{x.lower()}")
    g = c.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), *[count(x) for x in ("A", "B", "O", "OC")], F.min("cell").alias("lo"), F.max("cell").alias("hi"))
    return g.withColumn("verdict", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("MIXED")).drop("lo", "hi")


@query("""WITH o AS (SELECT o_custkey, bool_and(o_orderdate < TIMESTAMP '1997-01-01') AS all_before, count(*) AS n, quantile_cont(CAST(year(o_orderdate) AS DOUBLE), 0.5) AS median_year FROM orders GROUP BY o_custkey)
SELECT all_before, count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders, round(avg(median_year), 9) AS mean_median_year FROM o GROUP BY all_before""")
def universal_quantifier(spark, sf_dir):
    """Groups all of whose dates lie before a cut-off."""
    o = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_and(F.expr("o_orderdate < timestamp_ntz'1997-01-01'")).alias("all_before"), F.count("*").alias("n"), F.expr("percentile(year(o_orderdate), 0.5D)").alias("y"))
    return o.groupBy("all_before").agg(F.count("*").alias("customers"), F.sum("n").alias("orders"), F.round(F.avg("y"), 9).alias("mean_median_year"))


@query(f"""WITH {LEDGER_SQL}, a AS (SELECT chain, accession, avg(label) AS m, avg(CAST(label < CAST(0.3 AS DOUBLE) AS INT)) AS low, quantile_cont(label, 0.5) AS med FROM ledger GROUP BY ALL)
SELECT chain, count(*) AS units, round(avg(m), 9) AS macro_mean, (SELECT round(avg(label), 9) FROM ledger l WHERE l.chain = a.chain) AS micro_mean, round(avg(low), 9) AS mean_low_share, round(quantile_cont(med, 0.5), 9) AS median_median FROM a GROUP BY chain""")
def macro_micro(spark, sf_dir):
    """Means of unit means against row means, by stratum."""
    d = ledger(spark, sf_dir)
    a = d.groupBy("chain", "accession").agg(F.avg("label").alias("m"), F.avg((F.col("label") < 0.3).cast("double")).alias("low"), F.sum("label").alias("s"), F.count("*").alias("n"))
    each = medians(d, ["chain", "accession"], {"med": "label"})
    middle = medians(each, ["chain"], {"m": "med"}).select("chain", F.round("m", 9).alias("median_median"))
    units = a.groupBy("chain").agg(F.count("*").alias("units"), F.round(F.avg("m"), 9).alias("macro_mean"), F.round(F.sum("s") / F.sum("n"), 9).alias("micro_mean"), F.round(F.avg("low"), 9).alias("mean_low_share"))
    return units.join(middle, "chain")


@query(f"""WITH {LEDGER_SQL}, m AS (SELECT accession, entry, chain, quantile_cont(label, 0.5) AS m FROM ledger GROUP BY ALL)
SELECT accession, entry, count(*) AS chains, round(max(m) - min(m), 9) AS spread FROM m GROUP BY ALL HAVING count(*) >= 2 AND max(m) - min(m) >= CAST(0.4 AS DOUBLE)""")
def chain_extremes(spark, sf_dir):
    """Units whose chains differ by 0.4 or more in the median."""
    m = medians(ledger(spark, sf_dir), ["accession", "entry", "chain"], {"m": "label"})
    g = m.groupBy("accession", "entry").agg(F.count("*").alias("chains"), (F.max("m") - F.min("m")).alias("d"))
    return g.where("chains >= 2 and d >= 0.4D").select("accession", "entry", "chains", F.round("d", 9).alias("spread"))


@query("""WITH s AS (SELECT user_id, event_id, epoch_us(ts) AS a, epoch_us(ts) + CAST(value * 1000000 AS BIGINT) AS b FROM events)
SELECT x.user_id, count(*) AS overlaps FROM s x JOIN s y ON x.user_id = y.user_id AND x.event_id < y.event_id AND x.a <= y.b AND y.a <= x.b GROUP BY x.user_id""")
def interval_overlaps(spark, sf_dir):
    """Overlapping pairs of intervals within a key, counted without making them: all pairs less those where one ends before the other starts.

    Ends before each start are a running count: whole days from counts by day, the rest within the day, so that a task
    sorts a key's day and not the key.
    """
    day = 86_400_000_000
    s = load(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("a"), F.round(F.col("value") * 1000000).cast("long").alias("len"))
    at = F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(0).alias("end")), F.struct((F.col("a") + F.col("len")).alias("t"), F.lit(1).alias("end"))))  # at one time, starts come first
    p = s.select("user_id", at.alias("p")).select("user_id", "p.t", "p.end", F.expr(f"p.t div {day}").alias("day"))
    days = p.groupBy("user_id", "day").agg(F.sum("end").alias("ends")).withColumn("before", F.expr("sum(ends) over (partition by user_id order by day) - ends")).drop("ends")
    within = F.expr("sum(end) over (partition by user_id, day order by t, end rows unbounded preceding)")
    apart = p.withColumn("within", within).where("end = 0").join(days, ["user_id", "day"]).groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("within") + F.col("before")).alias("apart"))
    return apart.select("user_id", (F.expr("n * (n - 1) div 2") - F.col("apart")).alias("overlaps")).where("overlaps > 0")


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, CAST(min(length(props)) AS INT) AS least, CAST(max(length(props)) AS INT) AS most, round(avg(length(props)), 9) AS mean_size FROM events GROUP BY event_type""")
def counters(spark, sf_dir):
    """Class counts with distinct keys and size ranges."""
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min(F.length("props")).alias("least"), F.max(F.length("props")).alias("most"), F.round(F.avg(F.length("props")), 9).alias("mean_size"))


@query("""WITH r AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS returned, bool_or(l_linestatus = 'O') AS still_open, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT CASE WHEN returned THEN 'modified' WHEN still_open THEN 'alt_only' ELSE 'keep' END AS kind, count(*) AS entries, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY kind""")
def residue_audit(spark, sf_dir):
    """Classify units by what any of their rows shows."""
    r = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_linestatus") == "O").alias("o"), F.count("*").alias("n"))
    return r.groupBy(F.when(F.col("r"), "modified").when(F.col("o"), "alt_only").otherwise("keep").alias("kind")).agg(F.count("*").alias("entries"), F.sum("n").alias("n"))
