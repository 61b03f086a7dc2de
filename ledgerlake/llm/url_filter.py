"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

Listed are canonical URLs (host + path), of which there may be very many, and rules (host, path prefix; a rule fits its
host and all subdomains), which are a few and part of the plan: the longest that fits wins. A page without a rule is
looked up in the filter (eight 64-bit words a block, one bit in each, 16 bits a key), which is broadcast, so that no page
is shuffled for it. A miss is allowed there and then; only possible hits go on to the exact join with the list, which
removes false positives. A listed URL is blocked, any other allowed.

A filter of more than BROADCAST_BYTES is broadcast in slices of that size, up to SLICES of them; beyond, the distinct keys
of the pages are shuffled to it.

Cases: a null url, or one without ``://``, has empty host and path, no rule and is on no list; repeated rows are kept, each
judged alike; ties between rules of one length go to the longer host, then to block; very long urls are keys like any
other; an empty table or list gives no rows or no hits; a null page_id is kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, LOWER, UPPER, sized, skewed_left, table, written

#: Fixed values: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
WORDS = 8
KEYS_A_BLOCK = 32  # 16 bits a key
SLICES = 8  # of the filter, that are broadcast


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (rule, verdict); null without one."""
    fitting = [
        F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    ]
    return F.coalesce(*fitting) if fitting else F.lit(None).cast("struct<rule:string,verdict:string>")


def listing(urls: DataFrame) -> DataFrame:
    """(host, path) of listed URLs to their distinct keys; a host has no blank before its end, so that a key tells both."""
    return urls.select(F.concat("host", F.lit(" "), "path").alias("key")).distinct()


def _slots(key: Column, n_blocks: int) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int"))
    return [F.when(key.isNotNull(), F.pmod(F.xxhash64(key), F.lit(n_blocks))).alias("block"), *[bit(i).alias(f"m{i}") for i in range(WORDS)]]


def bloom_blocks(listed: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """The filter as a table of blocks, and the number of blocks."""
    n_blocks = max(1, -(-n_keys // KEYS_A_BLOCK))
    keys = listed.select(*_slots(F.col("key"), n_blocks))
    return keys.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)]), n_blocks


def _hit(words: list[Column]) -> Column:
    out = F.lit(True)
    for i, w in enumerate(words):
        out = out & (F.coalesce(w, F.lit(0)).bitwiseAND(F.col(f"m{i}")) != 0)
    return out


def width_of(keys: DataFrame) -> int:
    """Bytes of a table of keys."""
    return keys.agg(F.sum(F.octet_length("key") + 32)).first()[0] or 0


def passed(rows: DataFrame, listed: DataFrame, n_keys: int) -> DataFrame:
    """rows with maybe: whether their key (null: none) passes the filter of the listed keys."""
    blocks, n_blocks = bloom_blocks(listed, n_keys)
    probes = rows.select("*", *_slots(F.col("key"), n_blocks))
    slices = -(-n_blocks * 8 * (WORDS + 1) // BROADCAST_BYTES)
    if slices > SLICES:
        keys = probes.select("key", "block", *[f"m{i}" for i in range(WORDS)]).distinct().join(blocks, "block")
        maybe = written(keys.where(_hit([F.col(f"w{i}") for i in range(WORDS)])).select("key", F.lit(True).alias("maybe")), "maybe")
        out = skewed_left(rows, maybe, "key", width_of(maybe))
        return out.select(*rows.columns, F.coalesce("maybe", F.lit(False)).alias("maybe"))
    if slices > 1:
        blocks = written(blocks, "blocks")
    for s in range(slices):
        part = blocks.where(F.pmod("block", F.lit(slices)) == s).withColumnsRenamed({f"w{i}": f"w{i}_{s}" for i in range(WORDS)})
        probes = probes.join(F.broadcast(part), "block", "left")
    words = [F.coalesce(*[F.col(f"w{i}_{s}") for s in range(slices)]) for i in range(WORDS)]
    return probes.select(*rows.columns, _hit(words).alias("maybe"))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url) to (page_id, url, host, path, rule, verdict), a row for each row. listed: from listing()."""
    listed = written(listed, "listed")
    n_keys = listed.count()
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("best"))
    key = F.when(F.col("best").isNull() & (F.col("host") != ""), F.concat("host", F.lit(" "), "path"))
    tested = passed(rows.select("*", key.alias("key")), listed, n_keys)
    hits = tested.where("maybe").drop("maybe")
    found = written(hits.select("key").distinct().join(sized(listed, width_of(listed)), "key", "left_semi").withColumn("own", F.lit("block")), "found")
    hits = skewed_left(hits, found, "key", width_of(found))
    misses = tested.where("not maybe").select(*rows.columns, F.lit(None).cast("string").alias("own"))
    out = misses.unionByName(hits.select(*rows.columns, "own"))
    return out.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", "own", F.lit("allow")).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as given; listed are the canonical URLs that more than one page of the crawl has."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_parts(F.col("url"))
    again = pages.select(host.alias("host"), path.alias("path")).where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n")).where("n > 1")
    return judge(pages, listing(again)).drop("url")


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLE = f"""
WITH r(verdict, h, p) AS (VALUES {_VALUES}),
a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
c AS (SELECT *, count(*) OVER (PARTITION BY host, path) AS n FROM b),
d AS (SELECT page_id, host, path, n, h || p AS rule, verdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
      FROM c LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict WHEN n > 1 AND host <> '' THEN 'block' ELSE 'allow' END AS verdict
FROM d WHERE k = 1
"""
