"""Joins of ledgers, versions, dimensions and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.text import ascii_upper
from ledgerlake.operators.orderstats import medians
from ledgerlake.operators.setjoin import similar_sets
from ledgerlake.plans.registry import query
from ledgerlake.sources.tables import LEDGER_SQL, ledger, load


@query("""WITH r AS (SELECT l_orderkey AS k, l_linenumber AS pos, l_partkey AS ref, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber, l_partkey) AS nth FROM lineitem),
m AS (SELECT l_orderkey AS k, l_linenumber AS pos, l_partkey % 25 AS aa FROM lineitem)
SELECT r.k, count(*) AS aligned, count(*) FILTER (r.ref % 25 = aa) AS identical FROM r JOIN m USING (k, pos) WHERE nth = 1 GROUP BY r.k""")
def first_match(spark, sf_dir):
    """Reference to map to model by position; the first reference row of a target wins."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("part"))
    first = rows.groupBy("k", (F.col("pos") % 3).alias("target")).agg(F.min(F.struct("pos", "part")).alias("r")).select("k", F.col("r.pos").alias("pos"), F.col("r.part").alias("ref"))
    model = rows.select("k", "pos", (F.col("part") % 25).alias("aa"))
    return first.join(model, ["k", "pos"]).groupBy("k").agg(F.count("*").alias("aligned"), F.count_if(F.col("ref") % 25 == F.col("aa")).alias("identical"))


@query("""WITH seg AS (SELECT c_nationkey AS k, c_custkey AS id, CAST(floor(c_acctbal) AS BIGINT) AS a, CAST(floor(c_acctbal) AS BIGINT) + 40 AS b FROM customer),
p AS (SELECT s_suppkey, s_nationkey AS k, CAST(floor(s_acctbal) AS BIGINT) AS x FROM supplier)
SELECT s_suppkey, count(id) AS hits, CASE WHEN count(DISTINCT x - a) = 1 THEN 'mapped' WHEN count(id) = 0 THEN 'unmapped' ELSE 'ambiguous' END AS status FROM p LEFT JOIN seg ON p.k = seg.k AND x BETWEEN a AND b GROUP BY s_suppkey""")
def point_in_interval(spark, sf_dir):
    """Points against closed intervals of their key by dyadic nodes; statuses typed."""
    seg = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.floor("c_acctbal").alias("a"), (F.floor("c_acctbal") + 40).alias("b"))
    p = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.floor("s_acctbal").alias("x"))
    g = interval_hits(p, seg, ["s_suppkey"])
    status = F.when(F.col("hits") == 0, "unmapped").when(F.col("least") == F.col("most"), "mapped").otherwise("ambiguous")
    return g.select("s_suppkey", "hits", status.alias("status"))


def dyadic_nodes(a: Column, b: Column, depth: int) -> Column:
    """The nodes (level, place) of a binary tree over the integers that make up a closed interval: two a level at most.

    Node (l, i) covers 2^l numbers from i * 2^l; depth must reach the logarithm of the longest interval.
    """
    levels = []
    for n in range(depth + 1):
        first, end = -F.shiftright(-a, n), F.shiftright(b + 1, n)
        for inside, place in ((F.pmod(first, F.lit(2)) == 1, first), (F.pmod(end, F.lit(2)) == 1, end - 1)):
            levels.append(F.when((first < end) & inside, F.struct(F.lit(n).alias("level"), place.alias("place"))))
    return F.array_compact(F.array(*levels))


def interval_hits(points: DataFrame, segments: DataFrame, ids: list[str]) -> DataFrame:
    """points (*ids, k, x), segments (k, a, b) of integers; to (*ids, hits, least, most): how many segments hold the point, and the least and greatest of their starts.

    A segment is cut into nodes of a binary tree, a node keeps the number and the ends of the starts of its segments (partial in every task), and a
    point meets its ancestors, one a level: no pair of a point and a segment is ever made, however many hold a point.
    Segments that end before they start, or have a null, hold nothing.
    """
    whole = segments.select("k", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <= b")
    longest = whole.agg(F.max(F.col("b") - F.col("a") + 1)).first()[0] or 1
    depth = int(longest).bit_length()
    nodes = whole.select("k", "a", F.explode(dyadic_nodes(F.col("a"), F.col("b"), depth)).alias("n"))
    nodes = nodes.groupBy("k", "n.level", "n.place").agg(F.count("*").alias("hits"), F.min("a").alias("least"), F.max("a").alias("most"))
    above = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(F.col("x").cast("long"), n).alias("place")) for n in range(depth + 1)])
    met = points.select(*ids, "k", F.explode(above).alias("n")).select(*ids, "k", "n.level", "n.place").join(nodes, ["k", "level", "place"], "left")
    return met.groupBy(ids).agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.min("least").alias("least"), F.max("most").alias("most"))


@query("""WITH a AS (SELECT o_custkey, min(o_orderdate) AS d FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, min(o_orderdate) AS d FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT c_custkey, CASE WHEN a.d IS NOT NULL THEN 'first' WHEN b.d IS NOT NULL THEN 'second' ELSE 'none' END AS source, strftime(coalesce(a.d, b.d), '%Y-%m-%d') AS d, a.d IS NOT NULL AND b.d IS NOT NULL AND a.d <> b.d AS conflict FROM customer LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN b ON b.o_custkey = c_custkey""")
def precedence_lookup(spark, sf_dir):
    """Each key is looked up once a source, the first source that has it wins, a conflict is told."""
    o = load(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')")
    d = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate"))).alias("a"), F.min(F.when(F.col("o_orderstatus") == "O", F.to_date("o_orderdate"))).alias("b"))
    out = load(spark, sf_dir, "customer").select("c_custkey").join(d, "c_custkey", "left")
    source = F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").otherwise("none")
    return out.select("c_custkey", source.alias("source"), F.coalesce("a", "b").cast("string").alias("d"), F.coalesce(F.col("a") != F.col("b"), F.lit(False)).alias("conflict"))


def corrected(d: DataFrame) -> DataFrame:
    """A second version of the ledger: some accessions lose rows, gain shifted ones, or change their label."""
    label = F.when(F.col("accession") % 5 == 0, F.col("label") + 0.25).otherwise(F.col("label"))
    entry = F.when(F.col("accession") % 11 == 0, F.col("entry") + 1_000_000_000).otherwise(F.col("entry"))
    return d.where("accession % 7 <> 0").withColumns({"label": label, "entry": entry})


_CORRECTED = "corrected AS (SELECT accession, CASE WHEN accession % 11 = 0 THEN entry + 1000000000 ELSE entry END AS entry, chain, pos, feature, CASE WHEN accession % 5 = 0 THEN label + CAST(0.25 AS DOUBLE) ELSE label END AS label, channel_a, channel_b FROM ledger WHERE accession % 7 <> 0)"


@query(f"""WITH {LEDGER_SQL}, {_CORRECTED}, a AS (SELECT accession, chain, quantile_cont(label, 0.5) AS m, count(*) AS n FROM ledger GROUP BY ALL), b AS (SELECT accession, chain, quantile_cont(label, 0.5) AS m, count(*) AS n FROM corrected GROUP BY ALL)
SELECT accession, chain, CASE WHEN b.m IS NULL THEN 'only_original' WHEN a.m IS NULL THEN 'only_corrected' WHEN abs(a.m - b.m) > CAST(0.2 AS DOUBLE) THEN 'moved' ELSE 'kept' END AS outcome, a.n AS n_original, b.n AS n_corrected FROM a FULL JOIN b USING (accession, chain)""")
def version_comparison(spark, sf_dir):
    """Both, only left, only right; a median moves if it differs by over 0.2."""
    d = ledger(spark, sf_dir)
    by = ["accession", "chain"]
    med = lambda x, s: x.groupBy(by).agg(F.count("*").alias(f"n_{s}")).join(medians(x, by, {f"m{s}": "label"}), by)
    both = med(d, "original").join(med(corrected(d), "corrected"), ["accession", "chain"], "full_outer")
    outcome = F.when(F.col("mcorrected").isNull(), "only_original").when(F.col("moriginal").isNull(), "only_corrected").when(F.abs(F.col("moriginal") - F.col("mcorrected")) > 0.2, "moved").otherwise("kept")
    return both.select("accession", "chain", outcome.alias("outcome"), "n_original", "n_corrected")


@query(f"""WITH {LEDGER_SQL}, {_CORRECTED}
SELECT CASE WHEN b.accession IS NULL THEN 'only_original' WHEN a.accession IS NULL THEN 'only_corrected' WHEN abs(a.label - b.label) > 1e-12 THEN 'changed' ELSE 'same' END AS kind, count(*) AS n, round(max(abs(a.label - b.label)), 9) AS largest
FROM (SELECT accession, entry, pos, max(label) AS label FROM ledger GROUP BY ALL) a FULL JOIN (SELECT accession, entry, pos, max(label) AS label FROM corrected GROUP BY ALL) b ON a.accession = b.accession AND a.entry = b.entry AND a.pos = b.pos GROUP BY kind""")
def row_key_diff(spark, sf_dir):
    """Keys of one version only (rows that share a key count as one, with the largest label), and the change of those of both, in one shuffle: a union grouped by key, not two joins."""
    d = ledger(spark, sf_dir)
    each = d.select("accession", "entry", "pos", F.col("label").alias("a"), F.lit(None).cast("double").alias("b")).unionByName(corrected(d).select("accession", "entry", "pos", F.lit(None).cast("double").alias("a"), F.col("label").alias("b")))
    g = each.groupBy("accession", "entry", "pos").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    change = F.abs(F.col("a") - F.col("b"))
    kind = F.when(F.col("b").isNull(), "only_original").when(F.col("a").isNull(), "only_corrected").when(change > 1e-12, "changed").otherwise("same")
    return g.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.max(change), 9).alias("largest"))


@query("""SELECT r_name, c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS negative FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def crosstab(spark, sf_dir):
    """Two classifications against each other; facts are aggregated before the dimensions join."""
    c = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("neg"))
    dim = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return c.join(dim, "n_nationkey").groupBy("r_name", "c_mktsegment").agg(F.sum("n").alias("n"), F.sum("neg").alias("negative"))


_SPLIT = "CASE WHEN l_orderkey % 10 < 8 THEN 'train' ELSE 'test' END"


@query(f"""WITH s AS (SELECT DISTINCT l_orderkey, {_SPLIT} AS role, l_partkey, l_suppkey FROM lineitem),
t AS (SELECT l_orderkey, l_partkey, l_suppkey FROM s WHERE role = 'test'),
p AS (SELECT DISTINCT l_partkey, l_suppkey FROM s WHERE role = 'train'), q AS (SELECT DISTINCT l_partkey FROM s WHERE role = 'train')
SELECT l_orderkey, count(*) FILTER (p.l_partkey IS NOT NULL) AS same_pair, count(*) FILTER (q.l_partkey IS NOT NULL) AS same_part, CASE WHEN bool_or(p.l_partkey IS NOT NULL) THEN 'SAME_ACCESSION' WHEN bool_or(q.l_partkey IS NOT NULL) THEN 'SEQ95' ELSE 'NOVEL' END AS class
FROM t LEFT JOIN p ON p.l_partkey = t.l_partkey AND p.l_suppkey = t.l_suppkey LEFT JOIN q ON q.l_partkey = t.l_partkey GROUP BY l_orderkey""")
def leakage(spark, sf_dir):
    """Exposure of test units to the training set, as a ladder of classes; a class that holds early holds later."""
    s = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    train, test = s.where("l_orderkey % 10 < 8"), s.where("l_orderkey % 10 >= 8")
    pairs = train.select("l_partkey", "l_suppkey").distinct().withColumn("pair", F.lit(True))
    parts = pairs.select("l_partkey").distinct().withColumn("part", F.lit(True))
    hit = test.join(pairs, ["l_partkey", "l_suppkey"], "left").join(parts, "l_partkey", "left")
    g = hit.groupBy("l_orderkey").agg(F.count("pair").alias("same_pair"), F.count("part").alias("same_part"))
    return g.withColumn("class", F.when(F.col("same_pair") > 0, "SAME_ACCESSION").when(F.col("same_part") > 0, "SEQ95").otherwise("NOVEL"))


def sequence_units(items: DataFrame) -> DataFrame:
    """H2: one unit a distinct sequence, with its sorted members."""
    seq = ascii_upper(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", ""))
    return items.select(seq.alias("seq"), "item_id").groupBy("seq").agg(F.sort_array(F.collect_set("item_id")).alias("members"))


K, JACCARD, LEAST_LENGTH = 6, 0.10, 100
_UNITS = "u AS (SELECT seq, min(item_id) AS unit, count(DISTINCT item_id) AS n FROM (SELECT translate(regexp_replace(coalesce(text, ''), '\\s', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS seq, item_id FROM benchmark) GROUP BY seq)"


@query(f"WITH {_UNITS} SELECT unit, n AS n_members, length(seq) AS n_chars, md5(seq) AS md5 FROM u")
def sequence_collapse(spark, sf_dir):
    """Exact copies collapse to units."""
    u = sequence_units(load(spark, sf_dir, "benchmark"))
    return u.select(F.get("members", F.lit(0)).alias("unit"), F.size("members").cast("long").alias("n_members"), F.char_length("seq").cast("long").alias("n_chars"), F.md5("seq").alias("md5"))


#: The roster: every unit, and a copy of it with each 37th residue changed, so that there are pairs to find.
_ROSTER = f"""{_UNITS}, ro AS (SELECT CAST(unit AS VARCHAR) AS unit, seq FROM u UNION ALL SELECT unit || '~', regexp_replace(seq, '(.{{36}}).', '\\1#', 'g') FROM u)"""
_PAIRS = f"""k AS (SELECT DISTINCT unit, substr(seq, CAST(i AS BIGINT), {K}) AS g FROM (SELECT unit, seq, unnest(range(1, length(seq) - {K - 2})) AS i FROM ro WHERE length(seq) >= {LEAST_LENGTH})),
n AS (SELECT unit, count(*) AS n FROM k GROUP BY unit), p AS (SELECT a.unit AS a, b.unit AS b, count(*) AS shared FROM k a JOIN k b ON a.g = b.g AND a.unit < b.unit GROUP BY ALL)"""


def roster(spark, sf_dir):
    u = sequence_units(load(spark, sf_dir, "benchmark")).select(F.get("members", F.lit(0)).cast("string").alias("unit"), "seq")
    return u.unionByName(u.select(F.concat("unit", F.lit("~")).alias("unit"), F.regexp_replace("seq", "(.{36}).", "$1#").alias("seq")))


def similar(units, least: float = JACCARD, mode: str = "jaccard"):
    """(a, b, shared, score) of pairs a < b of sequences of 100 or more that share enough 6-grams: a Jaccard similarity, or, in mode shared_kmer, a number of them.

    (The mode without a filter, all pairs, is not built: nothing bounds it.)
    """
    if mode not in ("jaccard", "shared_kmer"):
        raise ValueError(f"mode {mode!r}")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("seq") - K + 1), lambda i: F.substring("seq", i, F.lit(K))))
    sets = units.where(F.char_length("seq") >= LEAST_LENGTH).select("unit", grams.alias("elements"))
    return similar_sets(sets, least, "jaccard" if mode == "jaccard" else "shared")


@query(f"""WITH {_ROSTER}, {_PAIRS}
SELECT a, b, shared, round(shared / CAST(x.n + y.n - shared AS DOUBLE), 9) AS jaccard FROM p JOIN n x ON x.unit = a JOIN n y ON y.unit = b WHERE shared >= CAST({JACCARD} AS DOUBLE) * (x.n + y.n - shared)""")
def similar_units(spark, sf_dir):
    """Pairs of the roster whose 6-gram sets have Jaccard 0.1 or more."""
    return similar(roster(spark, sf_dir)).withColumnRenamed("score", "jaccard")


@query(f"WITH {_ROSTER}, {_PAIRS} SELECT a, b, shared, CAST(shared AS DOUBLE) AS score FROM p WHERE shared >= 20")
def sharing_units(spark, sf_dir):
    """Pairs of the roster that share 20 or more 6-grams."""
    return similar(roster(spark, sf_dir), 20, "shared_kmer")


@query("""WITH e AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'correct' ELSE 'error' END AS e FROM labels), f AS (SELECT doc_id, CASE WHEN n_chars >= 1000 THEN 'flexible' ELSE 'ordered' END AS f FROM documents)
SELECT doc_id, coalesce(e, 'U') AS e, coalesce(f, 'U') AS f, CASE WHEN e IS NULL THEN 'missing_e_match' WHEN f IS NULL THEN 'missing_f_profile_position' END AS reason FROM e FULL JOIN f USING (doc_id)""")
def outer_state_join(spark, sf_dir):
    """Two channels by position, each from a whole table; a missing side is U with a reason."""
    e = load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "correct").otherwise("error").alias("e"))
    f = load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") >= 1000, "flexible").otherwise("ordered").alias("f"))
    reason = F.when(F.col("e").isNull(), "missing_e_match").when(F.col("f").isNull(), "missing_f_profile_position")
    return e.join(f, "doc_id", "full_outer").select("doc_id", F.coalesce("e", F.lit("U")).alias("e"), F.coalesce("f", F.lit("U")).alias("f"), reason.alias("reason"))


@query("""SELECT c_custkey, CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'admitted_without_rows' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate < TIMESTAMP '1996-01-01') THEN 'prior_pool' ELSE 'new' END AS status FROM customer""")
def completeness(spark, sf_dir):
    """Members without rows, members of a prior pool, new members."""
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.expr("o_orderdate < timestamp_ntz'1996-01-01'")).alias("prior"))
    out = load(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return out.select("c_custkey", F.when(F.col("prior").isNull(), "admitted_without_rows").when(F.col("prior"), "prior_pool").otherwise("new").alias("status"))


@query("""WITH b AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_nationkey END AS s_nationkey, CASE WHEN s_suppkey % 15 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier)
SELECT a.s_suppkey, list_filter([CASE WHEN a.s_name IS DISTINCT FROM b.s_name THEN 's_name' END, CASE WHEN a.s_nationkey IS DISTINCT FROM b.s_nationkey THEN 's_nationkey' END, CASE WHEN a.s_acctbal IS DISTINCT FROM b.s_acctbal THEN 's_acctbal' END], lambda x: x IS NOT NULL) AS failing FROM supplier a LEFT JOIN b USING (s_suppkey)""")
def pinned_record_check(spark, sf_dir):
    """A record against its pinned form, null-safe, with the names of the fields that differ."""
    a = load(spark, sf_dir, "supplier")
    fields = ("s_name", "s_nationkey", "s_acctbal")
    pinned = a.select("s_suppkey", F.col("s_name").alias("p_s_name"), F.when(F.col("s_suppkey") % 10 != 0, F.col("s_nationkey")).alias("p_s_nationkey"), F.when(F.col("s_suppkey") % 15 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")).alias("p_s_acctbal"))
    failing = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"p_{c}")), c) for c in fields]), lambda x: x.isNotNull())
    return a.join(pinned, "s_suppkey", "left").select("s_suppkey", failing.alias("failing"))


@query("""WITH l AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('signup', 'error', 'purchase'))
SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'QUERY_FAILED' WHEN bool_or(event_type = 'purchase') THEN 'SAME_ACC' WHEN bool_or(event_type = 'signup') THEN 'OTHER' ELSE 'NONE' END AS class FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN l USING (user_id) GROUP BY user_id""")
def template_class(spark, sf_dir):
    """Class ladder from hits of several kinds; a failed lookup outranks all."""
    had = lambda t: F.bool_or(F.col("event_type") == t)
    g = load(spark, sf_dir, "events").groupBy("user_id").agg(had("error").alias("e"), had("purchase").alias("p"), had("signup").alias("s"))
    return g.select("user_id", F.when(F.col("e"), "QUERY_FAILED").when(F.col("p"), "SAME_ACC").when(F.col("s"), "OTHER").otherwise("NONE").alias("class"))
