r"""Importance resampling towards a target distribution, over partition-local word tries.

Features are runs of 1 to ``order`` consecutive words. A task keeps a trie of the words it meets: a node is a feature,
with its count and its CRC state, so that a longer feature goes on from its prefix's state and no feature is ever joined
to a string. A task's nodes are added up by bucket (CRC modulo ``buckets``); what leaves it is at most one row a bucket,
merged by Spark. Gains of all buckets (a bounded table) then go to the tasks that score: a node gets its bucket's gain
when it is first met, and a document's weight is the sum along the trie paths of its words.

A gain is floor(1000 * ln of (target share / share in all documents)), smoothed by one a bucket; the score is the weight
plus a Gumbel draw by doc_id. Of the documents with at least ``least`` words the given percentage with the highest scores
is drawn; places come from ranges of the order (ordered.numbered), so nothing is sorted in one task.

A trie that outgrows NODES is added up and begun anew; texts are walked in slices of SLICE bytes, so that memory is
bounded for texts and vocabularies of any size.

Cases: null and empty texts have no feature, weight 0 and no rank; a null doc_id is drawn by the digest of `2024:` alone
and comes last in ties; rows that repeat a doc_id share its draw and keep a row each; equal scores go to the smaller
doc_id, then to fewer features; an empty documents table gives no rows, an empty target counts as zero everywhere; other columns are
ignored.
"""

from __future__ import annotations

import math
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .ordered import numbered

ORDER, BUCKETS, PERCENT, LEAST, SEED = 1, 10_000, 10, 20, "2024"
NODES, SLICE = 200_000, 1 << 20  # nodes of a trie before it is begun anew, bytes of a text walked at once
WORD = bytes(c if c >= 0x80 or chr(c).isdigit() or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def slices(text: bytes):
    """Lists of words, in order; a slice ends between words."""
    text = text.translate(WORD)
    a = 0
    while len(text) - a > SLICE:
        b = text.find(b" ", a + SLICE)
        if b < 0:
            break
        yield text[a:b].split()
        a = b
    yield text[a:].split()


class _Roots(dict):
    """Nodes of single words, made when first met."""

    def __init__(self, trie: Trie):
        self.trie = trie

    def __missing__(self, word: bytes) -> int:
        self[word] = node = self.trie.add(crc32(word))
        return node


class _Children(dict):
    """Nodes by (parent, word); the CRC goes on from the parent's."""

    def __init__(self, trie: Trie):
        self.trie = trie

    def __missing__(self, key: tuple[int, bytes]) -> int:
        self[key] = node = self.trie.add(crc32(key[1], crc32(b" ", self.trie.crc[key[0]])))
        return node


class Trie:
    """Words as edges, features as nodes."""

    def __init__(self, order: int, buckets: int, gains: np.ndarray | None = None):
        self.order, self.buckets, self.gains = order, buckets, gains
        self.added = np.zeros(buckets, np.int64)
        self.begin()

    def begin(self) -> None:
        self.crc, self.gain = array("L"), array("q")
        self.roots, self.children = _Roots(self), _Children(self)
        self.counts = np.zeros(0, np.int64)

    def add(self, crc: int) -> int:
        self.crc.append(crc)
        if self.gains is not None:
            self.gain.append(int(self.gains[crc % self.buckets]))
        return len(self.crc) - 1

    def paths(self, words: list[bytes]):
        """Nodes of all features that begin in these words and end in them, an array for each length."""
        nodes = list(map(self.roots.__getitem__, words))
        for k in range(1, self.order + 1):
            if not nodes:
                return
            yield np.array(nodes, np.int64)
            if k < self.order:
                nodes = list(map(self.children.__getitem__, zip(nodes, words[k:])))  # noqa: B905

    def count(self, nodes: np.ndarray) -> None:
        if len(self.counts) < len(self.crc):
            self.counts = np.concatenate([self.counts, np.zeros(max(len(self.crc), 1024), np.int64)])
        self.counts += np.bincount(nodes, minlength=len(self.counts))

    def totals(self) -> np.ndarray:
        """Counts by bucket of all nodes so far; the trie begins anew."""
        bucket = np.array(self.crc, np.uint64)[: len(self.counts)] % np.uint64(self.buckets)
        np.add.at(self.added, bucket.astype(np.int64), self.counts[: len(bucket)])
        self.begin()
        return self.added

    def walk(self, text: bytes | None):
        """(words, nodes) of each slice and feature length; a feature across two slices belongs to the second."""
        held: list[bytes] = []
        for words in slices(text or b""):
            if len(self.crc) > NODES:
                self.totals()
            joined = held + words
            for k, nodes in enumerate(self.paths(joined)):
                # features of k + 1 words that lie within the held words were met with the slice before
                yield (len(words) if k == 0 else 0), nodes[max(0, len(held) - k) :]
            held = joined[len(joined) - self.order + 1 :] if self.order > 1 else []


def _counted(batches, order: int, buckets: int):
    trie = Trie(order, buckets)
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            for _, nodes in trie.walk(text.as_py()):
                trie.count(nodes)
    total = trie.totals()
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: a row a bucket and task is merged, a row a bucket reaches the driver."""
    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _counted(it, order, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    n, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def _scored(batches, order: int, buckets: int, gain: np.ndarray):
    trie = Trie(order, buckets, gain)
    for batch in batches:
        words, features, weights = [], [], []
        for text in batch.column(1).cast(pa.binary()):
            n_words = n = weight = 0
            for more, nodes in trie.walk(text.as_py()):
                n_words, n = n_words + more, n + len(nodes)
                weight += int(np.frombuffer(trie.gain, np.int64)[nodes].sum()) if len(nodes) else 0
            words.append(n_words)
            features.append(n)
            weights.append(weight)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weights))], ["doc_id", "n_words", "n_features", "weight"])


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, order: int = ORDER, buckets: int = BUCKETS, least: int = LEAST, seed: str = SEED) -> DataFrame:
    """docs: (doc_id, text), target: (text); to (doc_id, n_words, n_features, weight, score, rank), a row for each row of docs."""
    gain = gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(lambda it: _scored(it, order, buckets, gain), "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = written(rows.withColumn("score", score.cast("long")), "scored")
    long_enough = F.col("n_words") >= least
    fit = rows.where(long_enough)
    drawn = percent * fit.count() // 100
    fit = numbered(fit, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), name="place")
    fit = fit.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place")
    return fit.unionByName(rows.where(~long_enough).withColumn("rank", F.lit(None).cast("long")))


def op13_word_trie_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB has no CRC-32: a table of 256 entries made by the polynomial, then a fold over the bytes.
CRC_TABLE = "SELECT list(c ORDER BY i) AS c FROM (SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), [CAST(x AS UBIGINT) FOR x IN range(8)]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS c FROM range(256) r(i))"


def crc32_sql(word: str, crc_table: str = "crc.c") -> str:
    """The unsigned CRC-32 of a string's UTF-8 bytes."""
    octets = f"[CAST(CAST('0x' || hex(encode({word}))[2 * i - 1 : 2 * i] AS INTEGER) AS UBIGINT) FOR i IN range(1, strlen({word}) + 1)]"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {octets}), lambda c, b: xor(c >> 8, {crc_table}[CAST(xor(c, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT))"


def _words_sql(name: str) -> str:
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {name}"


ORACLE = f"""
WITH crc AS MATERIALIZED ({CRC_TABLE}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_words_sql("documents")}),
dw AS MATERIALIZED (SELECT r, unnest(w) AS word FROM d),
tw AS MATERIALIZED (SELECT unnest(w) AS word FROM (SELECT {_words_sql("benchmark")})),
v AS MATERIALIZED (SELECT word, {crc32_sql("word")} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM tw), crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN v USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM tw JOIN v USING (word) GROUP BY bucket),
g AS MATERIALIZED (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw)::DOUBLE + 10000) / ((s.n + 1.0::DOUBLE) * ((SELECT count(*) FROM tw)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
wt AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN v USING (word) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h FROM d LEFT JOIN wt USING (r)),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM z
"""
