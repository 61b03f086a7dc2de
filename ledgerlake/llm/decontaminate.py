r"""Benchmark decontamination by winnowing.

Words are runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z. Every window of 10 words holds 5 hashes of
6 words; its fingerprint is the smallest. Two texts that share 10 words share that window's fingerprint, so a join of
training and test fingerprints misses no shared span. A hit is extended: the windows at the fingerprint are compared
word by word with the items' windows, and overlapping windows merge to the whole span. An item of fewer than 10 words
is one window; for these, documents are searched at each such length by the hash of all its words.

Cases: null and empty texts have no words; items without words are ignored, items with a null id mark words but are not
counted; repeated item rows count once; each document row is judged by itself (rows that agree in id and text get the
same result, one row each); empty tables give no rows, or no hits; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, sized, table, written

WINDOW, GRAM = 10, 6  # words in a window; words in a hash (the steps of fingerprints() add up to these)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"  # before lower-casing; a negated class says the same but is matched twenty times slower


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _after(array: Column, n: int) -> Column:
    """The array without its first n elements; zip_with() fills up with nulls, which neither a hash nor least() counts."""
    return F.slice(array, F.lit(n + 1), F.size(array))


def fingerprints(df: DataFrame) -> DataFrame:
    """Add prints: for each window of WINDOW words in the column words, its smallest hash of GRAM words.

    Hashes of 2, 4 and 6 words, then minima of 2, 4 and 5 hashes, each from two arrays that are shifted against each
    other: a few operations a word, where a slice a position costs thrice the time.
    """
    keep = [c for c in df.columns if c != "prints"]
    both = lambda a, b, n, f: F.zip_with(a, _after(F.col(b), n), f)
    hashed, less = lambda a, b: F.xxhash64(a, b), lambda a, b: F.least(a, b)
    df = df.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("_w"))
    df = df.select(*keep, both("_w", "_w", 1, hashed).alias("_w2"))
    df = df.select(*keep, "_w2", both("_w2", "_w2", 2, hashed).alias("_w4"))
    df = df.select(*keep, both("_w4", "_w2", 4, hashed).alias("_g"))
    df = df.select(*keep, "_g", both("_g", "_g", 1, less).alias("_m2"))
    df = df.select(*keep, "_g", both("_m2", "_m2", 2, less).alias("_m4"))
    least = both("_m4", "_g", 4, less)
    return df.select(*keep, F.slice(least, F.lit(1), F.greatest(F.size("words") - WINDOW + 1, F.lit(0))).alias("prints"))


def _span(start: Column, n: int) -> Column:
    """The text of n words from start (from 0), with its length, which tells a short item's window from the start of a long one's."""
    return F.concat(F.lit(f"{n}:"), F.array_join(F.slice("words", start + 1, n), " "))


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, text) to (print, span, n, items): every distinct window with its fingerprint and the ids of its items."""
    told = fingerprints(items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0))
    long = told.where(F.size("words") >= WINDOW)
    long = long.select("item", F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.struct(F.get("prints", i).alias("print"), _span(i, WINDOW).alias("span"), F.lit(WINDOW).alias("n")))).alias("w"))
    short = told.where(F.size("words") < WINDOW)
    whole = F.concat(F.size("words").cast("string"), F.lit(":"), F.array_join("words", " "))
    short = short.select("item", F.struct(F.xxhash64(whole).alias("print"), whole.alias("span"), F.size("words").alias("n")).alias("w"))
    return long.unionByName(short).groupBy("w").agg(F.sort_array(F.collect_set("item")).alias("items")).select("w.print", "w.span", "w.n", "items")


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text), (item_id, text) to (doc_id, text_hash, hits, items) of contaminated texts; hits: array of (start, n) in words."""
    windows = written(item_windows(items), "windows")
    stats = windows.agg(F.sum(F.octet_length("span") + 16 * F.size("items") + 64).alias("bytes"), F.collect_set(F.when(F.col("n") < WINDOW, F.col("n"))).alias("short")).first()
    size, short = stats["bytes"] or 0, sorted(stats["short"])  # at most nine lengths
    tests = windows.where(F.col("n") == WINDOW)

    def spans(df: DataFrame, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), _span(i, n).alias("span")))

    key = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    told = docs.select(*key, words(F.col("text")).alias("words"))
    # pass 1: which texts share a fingerprint with a test; explode() would have Spark infer a filter on the arrays' size and
    # push it down through fingerprints(), which then runs many times over; explode_outer() does not
    prints = fingerprints(told).select("doc_id", "text_hash", F.explode_outer(F.array_distinct("prints")).alias("print")).where("print is not null")
    maybe = prints.join(sized(tests.select("print").distinct(), size), "print", "left_semi").select("doc_id", "text_hash").distinct()
    maybe = written(maybe, "maybe")
    again = told.join(sized(maybe, maybe.count() * 32), told["doc_id"].eqNullSafe(maybe["doc_id"]) & (told["text_hash"] == maybe["text_hash"]), "left_semi")
    # pass 2: extend the hits
    at = fingerprints(again.where(F.size("words") >= WINDOW))
    at = at.select("doc_id", "text_hash", F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.struct(i.alias("start"), F.lit(WINDOW).alias("n"), F.get("prints", i).alias("print"), _span(i, WINDOW).alias("span")))).alias("s"))
    at = at.select("doc_id", "text_hash", "s.*")
    found = [at.join(sized(tests, size), ["print", "span", "n"]).select("doc_id", "text_hash", "start", "n", "items")]
    for n in short:
        at = told.where(F.size("words") >= n).select("doc_id", "text_hash", F.explode(spans(told, n)).alias("s")).select("doc_id", "text_hash", "s.*")
        found.append(at.join(sized(windows.where(F.col("n") == n), size), ["span", "n"]).select("doc_id", "text_hash", "start", "n", "items"))
    hits = reduce(DataFrame.unionByName, found)
    return hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = docs.select("doc_id", "text")
    hits = find(docs, items)
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))))
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.size(covered).cast("long").alias("n_hit"), "items")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), n_words(F.col("text")).alias("n_words"))
    out = rows.join(hits, rows["doc_id"].eqNullSafe(hits["_id"]) & (rows["text_hash"] == hits["_hash"]), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, i, i + least(len(w), {WINDOW}) - 1), ' ') AS span
       FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS span
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, span)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
