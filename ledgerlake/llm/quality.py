r"""Quality classifier by importance resampling.

Two bag-of-n-gram models over hashed unigrams and bigrams: the target, counted over labelled good texts, and the raw
text, counted over all documents. A document's log weight is the sum of log(target / raw) over its n-grams; to it a
Gumbel draw is added (seeded by id and text), and the documents with the k largest sums are the sample: they are kept.
Buckets whose target count lies within SIGMA standard deviations of what the raw model expects say nothing and weigh 0.

k is the share of good texts among all labels times the number of documents, the weights' exponent is 1 / TEMPERATURE.
The target is counted over at most TARGETS labelled texts, chosen by hash; all else covers all documents. The k-th
largest sum is found exactly by refining a histogram, so nothing is gathered or sorted in one place.

Cases: null and empty texts have weight 0; documents that agree in id and text share their draw, and rows tied with
the k-th are kept; labels with a null id or value are ignored, a document with contradicting labels is no target;
without labels every document is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

BUCKETS, TARGETS, SIGMA, TEMPERATURE, SEED = 1 << 16, 50_000, 4.0, 0.25, 7
TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHED = 100_000  # words whose hash a task remembers, tens of MB


class _Hashes(dict):
    def __missing__(self, word):
        h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(self) < CACHED:
            self[word] = h
        return h


def features(text: str | None, hashes: dict) -> np.ndarray:
    """Buckets of a text's unigrams (below BUCKETS) and bigrams (from BUCKETS on)."""
    words = TOKEN.findall((text or "").lower())
    one = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    two = (one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
    return np.concatenate([one % np.uint64(BUCKETS), two % np.uint64(BUCKETS) + np.uint64(BUCKETS)]).astype(np.int64)


def _count(batches):
    hashes, counts = _Hashes(), np.zeros((2, 2 * BUCKETS), np.int64)
    for batch in batches:
        held: list[list] = [[], []]
        size = 0
        for text, target in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            f = features(text.as_py(), hashes)
            for k in range(1 + bool(target)):
                held[k].append(f)
            if (size := size + len(f)) > 1 << 20:
                for k in range(2):
                    counts[k] += np.bincount(np.concatenate([*held[k], f[:0]]), minlength=2 * BUCKETS)
                held, size = [[], []], 0
        for k in range(2):
            if held[k]:
                counts[k] += np.bincount(np.concatenate(held[k]), minlength=2 * BUCKETS)
    seen = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[0][seen]), pa.array(counts[1][seen])], ["bucket", "raw", "target"])


def good_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of labelled documents."""
    told = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return told.groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))


def fit(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket. What reaches the driver is one row a bucket."""
    chosen = good.where("good").select(F.col("doc_id").alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(TARGETS)
    marked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left")
    rows = marked.select("text", F.col("_id").isNotNull().alias("target")).mapInArrow(_count, "bucket long, raw long, target long")
    model = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    raw[model["bucket"]], target[model["bucket"]] = model["raw"], model["target"]
    out = np.zeros(2 * BUCKETS)
    for part in (slice(0, BUCKETS), slice(BUCKETS, None)):
        r, t = raw[part], target[part]
        if not r.sum() or not t.sum():
            continue
        p = r / r.sum()
        expected = p * t.sum()
        ratio = (t + BUCKETS * p) / (t.sum() + BUCKETS) / np.where(p > 0, p, 1)
        telling = (r > 0) & (np.abs(t - expected) >= SIGMA * np.sqrt(expected))
        out[part] = np.where(telling, np.log(np.where(ratio > 0, ratio, 1)), 0)
    return out


def _score(batches, model: np.ndarray):
    hashes = _Hashes()
    for batch in batches:
        out = [float(model[features(t.as_py(), hashes)].sum()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["doc_id", "text_hash", "log_weight"])


def score(docs: DataFrame, model: np.ndarray, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """(doc_id, text) to (doc_id, text_hash, log_weight, perturbed)."""
    model = model.astype(np.float32)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(lambda it: _score(it, model), "doc_id long, text_hash long, log_weight double")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return scored.withColumn("perturbed", F.col("log_weight") / temperature - F.log(-F.log(u)))


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value, exactly: a histogram of bounded size a pass, refined until the bin holds one value."""
    if k <= 0:
        return None
    low, high, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k >= n:
        return low
    above = 0
    while low < high:
        width = (high - low) / bins
        inside = values.where(F.col(column).between(low, high))
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)) if width > 0 else (F.col(column) > low).cast("long")
        rows = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
    return low


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text_hash, log_weight, perturbed, keep), a row for each row of docs."""
    good = good_labels(labels)
    share = good.agg(F.avg(F.col("good").cast("double"))).first()[0]
    scored = written(score(docs, fit(docs, good)), "scored")
    cut = kth_largest(scored, "perturbed", round((1 if share is None else share) * scored.count()))
    return scored.withColumn("keep", F.lit(False) if cut is None else F.col("perturbed") >= cut)


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "log_weight", "perturbed", "keep")
