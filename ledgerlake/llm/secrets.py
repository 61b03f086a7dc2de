r"""Secret scans by an incremental blob ledger.

Every version of a text is content-addressed (SHA-256 of its UTF-8). The ledger says which (blob, rule, rule version)
triples were scanned; a run scans only those that the ledger lacks, once a blob however many documents carry it, adds
them to the ledger, a table in the shared folder that the next run or batch takes up, and joins the findings back to all
paths. Which folder, the session's setting ledgerlake.secret_ledger says; without it a run starts from an empty ledger, so
that its figures are those of a whole scan.

A rule finds its matches leftmost and non-overlapping over the whole text and then drops those that are too short;
positions are code points, end exclusive. Matching runs in the JVM: the pieces between matches, from split(), and the
matches, from regexp_extract_all(), give every position.

Cases: a null text is the empty blob; repeated rows and ties keep a row each; an empty table gives no rows; a null path
is kept; other columns are ignored (and cannot clash, since only path and text are read).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, run_dir, skewed_left, table, written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # without capturing groups other than the measured one
    group: int  # what must reach least characters; 0: the match
    least: int
    version: int = 1


#: Kinds and patterns of the base rules, in the order in which ties are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)

SPANS = "array<struct<kind:string,start:int,end:int>>"
ENTRY = f"blob string, kind string, version int, spans {SPANS}"
CHUNK = 64  # matches whose spans are gathered at once
#: Names the folder of a ledger that outlives the run; without it a run starts an empty one of its own.
LEDGER_CONF = "ledgerlake.secret_ledger"
BATCHES = 2  # in which op9 brings versions to the ledger


def matches(text: Column, rule: Rule) -> Column:
    """Spans of a rule in a text: array of (kind, start, end)."""
    if rule.kind == "hex":  # a run shorter than the least is no match of this pattern and hides no other: it ends before the next run starts
        pattern, short = f"[0-9a-f]{{{rule.least},}}", None
    elif rule.kind == "access":  # the same: a rest of a run that is too short is shorter still
        pattern, short = f"AKIA[A-Z0-9]{{{rule.least - 4},}}", None
    else:
        pattern, short = rule.pattern, rule.least
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(F.char_length(b).alias("gap"), F.char_length(m).alias("len"), m.alias("match")))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.array(F.struct(F.lit(rule.kind).alias("kind"), begin.alias("start"), (begin + x["len"]).alias("end")))
        kept = F.concat(acc["spans"], span)
        if short is not None:
            kept = F.when(F.char_length(F.regexp_extract(x["match"], pattern, rule.group)) >= short, kept).otherwise(acc["spans"])
        return F.struct((begin + x["len"]).alias("at"), kept.alias("spans"), acc["done"].alias("done"))

    # in chunks, since a growing array is copied at every step
    nothing = F.array().cast(SPANS)
    chunks = F.transform(F.sequence(F.lit(0), F.size(sizes), F.lit(CHUNK)), lambda i: F.slice(sizes, i + 1, F.lit(CHUNK)))
    start = F.struct(F.lit(0).alias("at"), nothing.alias("spans"), F.array().cast(f"array<{SPANS}>").alias("done"))
    merged = lambda acc: F.struct(acc["at"].alias("at"), nothing.alias("spans"), F.concat(acc["done"], F.array(acc["spans"])).alias("done"))
    spans = F.aggregate(chunks, start, lambda acc, chunk: F.aggregate(chunk, acc, step, merged), lambda acc: F.flatten(acc["done"]))
    return F.when(text.rlike(pattern), spans).otherwise(nothing)


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def ledger_path(spark: SparkSession) -> str:
    return spark.conf.get(LEDGER_CONF, None) or f"{run_dir(spark)}/ledger-{uuid.uuid4().hex}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All entries so far; none where no run has written any."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(path)


def unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, todo): the blobs that the ledger lacks for a rule version, and these as kind:version. No text is shuffled for it."""
    mine = [f"{r.kind}:{r.version}" for r in rules]
    have = ledger.select("blob", F.concat_ws(":", "kind", "version").alias("rule")).where(F.col("rule").isin(mine)).groupBy("blob").agg(F.collect_set("rule").alias("have"))
    todo = F.array_except(F.array(*map(F.lit, mine)), F.coalesce("have", F.array().cast("array<string>")))
    return versions.select(address(F.col("text")).alias("blob")).distinct().join(have, "blob", "left").select("blob", todo.alias("todo")).where(F.size("todo") > 0)


def scan(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger's new entries: (blob, kind, version, spans) for each blob and rule version that it lacks."""
    spark = versions.sparkSession
    texts = versions.select(address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    todo = written(unseen(versions, spark.createDataFrame([], ENTRY) if ledger is None else ledger, rules), "unseen")
    size = todo.count() * 160
    if size <= BROADCAST_BYTES:  # then only unseen texts are shuffled
        once = texts.join(F.broadcast(todo), "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    else:
        once = texts.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")
    entry = lambda r: F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), matches(F.col("text"), r).alias("spans"))
    each = F.array(*[F.when(F.array_contains("todo", f"{r.kind}:{r.version}"), entry(r)) for r in rules])
    return once.select("blob", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("e")).select("blob", "e.kind", "e.version", "e.spans")


def scanned(versions: DataFrame, rules: tuple[Rule, ...] = RULES, path: str | None = None) -> DataFrame:
    """Bring the stored ledger up to date with these versions and return it.

    New entries are appended by one job, whose files appear when it is done. Runs that overlap may both scan a blob;
    their equal entries count once.
    """
    spark = versions.sparkSession
    path = path or ledger_path(spark)
    scan(versions, rules, read_ledger(spark, path)).write.mode("append").option("compression", "zstd").parquet(path)
    return read_ledger(spark, path)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The current rules' findings of each blob that has any: (blob, spans), by start, then kind as listed."""
    current = ledger.where(F.concat_ws(":", "kind", "version").isin([f"{r.kind}:{r.version}" for r in rules]))
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    found = current.where(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    ranked = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select("blob", F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def join_back(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of versions (path, text) as (path, blob, spans)."""
    paths = versions.select("path", address(F.col("text")).alias("blob"))
    found = written(findings(ledger, rules), "findings")
    size = found.agg(F.sum(F.size("spans") * 56 + 96)).first()[0] or 0
    return skewed_left(paths, found, "blob", size).select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span (sorted by start) replaced by a mark; overlapping spans share one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table comes to the ledger in BATCHES parts by hash of the id, as versions do over time: a later part scans only what the ledger lacks."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    path = ledger_path(spark)
    for i in range(BATCHES):
        ledger = scanned(docs.where(F.pmod(F.xxhash64("path"), F.lit(BATCHES)) == i), path=path)
    found = join_back(docs, ledger)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = found.select("path", "spans", told.alias("told"))
    return found.select(F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2("told", 256).alias("base_sha256"), F.col("told").alias("spans"))


_KINDS = "\n  UNION ALL ".join(
    f"""SELECT doc_id, '{r.kind}' AS kind, {i} AS rank, m, piece, pos, sum(length(piece)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
   FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(list_slice(regexp_split_to_array(text, '{p}'), 1, len(regexp_extract_all(text, '{p}')))) AS piece,
                unnest(range(len(regexp_extract_all(text, '{p}')))) AS pos FROM d WHERE regexp_matches(text, '{p}'))
   WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"""
    for i, r in enumerate(RULES) for p in [r.pattern.replace("'", "''")]
)
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_KINDS}),
kept AS (
  SELECT doc_id, kind, rank, start, start + length(m) AS fin FROM m
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, '{RULES[0].pattern.replace("'", "''")}', 2)) >= 6 WHEN 'access' THEN length(m) >= 20 ELSE length(m) >= 24 END),
told AS (
  SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(fin AS BIGINT), ',' ORDER BY start, rank), '') AS spans
  FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, n_assign, n_access, n_hex, sha256(spans) AS base_sha256, spans FROM told
"""
