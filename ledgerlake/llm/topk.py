"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors are dealt into shards; in a shard, list j holds the rows in the order of component j. For a query, the lists are
read in step, in blocks up to the depths of READS, each from the end that its component's sign prefers. What was read
gives every row a lower bound (unread components at their list's least contribution) and an upper bound (unread components
at the contribution last read, which for a row not met at all is the bound of unseen rows). Reading stops for a query when
no outsider's upper bound reaches the k-th best lower bound; the final scores of the rows left are then taken from the
lists, read on to where these rows stand. A query that never stops has read its lists to their end, where both bounds are
the scores. The shards' best k meet in one ranking a query; the first shard's k-th scores hold as lower bounds in the others.

What a query has read of list j depends on the sign of its component j alone. So the bounds of all rows for a block of
queries are one matrix product: positive parts of the queries with lists read from the top, negative parts with lists
read from the bottom. Where components spread evenly, bounds tell nothing until nearly everything is read: at each depth
they are first taken for PROBES queries of the block, and for the others only if these could drop most rows.

Queries against all rows go in blocks: a task gets one shard and one block of queries, both of bounded size. Vectors are
shuffled once for every QUERIES queries.

Cases: vectors that are null, or hold a null or non-finite component, take no part; vectors are compared with those of
as many components; ties go to the smaller vec_id; rows that share the query's vec_id are its own; rows that repeat are as many
candidates, but one query; rows with a null id are no candidates; an empty table gives no rows; other columns are ignored.
Scores must fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SHARD, QUERIES, TOGETHER = 8192, 1 << 16, 512  # rows of a shard, queries of a task, queries that share a matrix product
READS, PROBES = (1 / 64, 1 / 16, 1 / 4, 1 / 2), 8  # shares of a list read when bounds are taken; after the last, lists are read to their end
SCHEMA = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantized(embedding: Column) -> Column:
    """floor(256 x) of each component; null if a component is null or not finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine, F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("long")))


class Lists:
    """The sorted lists of a shard: values by place, the place of each row, and rows as far as they were read."""

    def __init__(self, rows: np.ndarray):
        n = len(rows)
        order = np.argsort(rows, axis=0, kind="stable")
        self.values = np.take_along_axis(rows, order, 0)
        self.place = np.empty_like(order, dtype=np.int32)
        np.put_along_axis(self.place, order, np.arange(n, dtype=np.int32)[:, None], 0)
        self.rows, self.known = rows, {}

    def read(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Components known after depth entries from the top, beside those from the bottom; unread ones at their least, and at most."""
        if depth not in self.known:  # the same for all blocks of queries
            n = len(self.rows)
            top, bottom = self.place >= n - depth, self.place < depth
            low = np.hstack([np.where(top, self.rows, self.values[0]), np.where(bottom, self.rows, self.values[-1])])
            high = np.hstack([np.where(top, self.rows, self.values[n - depth]), np.where(bottom, self.rows, self.values[depth - 1])])
            self.known[depth] = low, high
        return self.known[depth]

    def of(self, r: np.ndarray) -> np.ndarray:
        """The components of rows, as the lists have them at these rows' places."""
        return np.take_along_axis(self.values, self.place[r], 0)


def _contenders(signs: np.ndarray, own: np.ndarray, floor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Rows whose upper bound reaches the k-th best lower bound (or the floor, if that is more)."""
    n = low.shape[0]
    lower = signs @ low.T
    lower[own] = np.iinfo(np.int64).min
    if n > k:
        floor = np.maximum(floor, np.partition(lower, n - k, axis=1)[:, n - k])
    return (signs @ high.T >= floor[:, None]) & ~own


def _block_top(lists: Lists, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray):
    """(query, row, score) of the best k of a block of queries, flat, and the depth that each query read."""
    n = len(ids)
    signs = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])
    own = ids[None, :] == query_ids[:, None]
    reading, depths = np.arange(len(queries)), np.full(len(queries), n)
    q_out, r_out, s_out = [], [], []

    def settle(q, r, score):
        best = np.lexsort((ids[r], -score, q))
        q, r, score = q[best], r[best], score[best]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        for out, x in zip((q_out, r_out, s_out), (q, r, score), strict=True):
            out.append(x[first])

    for depth in (max(1, int(n * s)) for s in READS):
        if n <= k or not len(reading):
            break
        low, high = lists.read(depth)
        some = reading[:: -(-len(reading) // PROBES)]
        if _contenders(signs[some], own[some], floors[some], low, high, k).mean() > 1 / 4:
            continue
        left = _contenders(signs[reading], own[reading], floors[reading], low, high, k)
        stop = left.sum(axis=1) <= k
        q, r = np.nonzero(left[stop])
        q = reading[stop][q]
        settle(q, r, np.einsum("ij,ij->i", queries[q], lists.of(r)))
        depths[reading[stop]] = depth
        reading = reading[~stop]
    if len(reading):
        score = queries[reading] @ lists.rows.T  # all is read
        score[own[reading]] = np.iinfo(np.int64).min
        kth = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(reading), np.iinfo(np.int64).min, score.dtype)
        q, r = np.nonzero((score >= np.maximum(kth, floors[reading])[:, None]) & ~own[reading])
        settle(reading[q], r, score[q, r])
    q, r, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (q_out, r_out, s_out))
    order = np.argsort(q, kind="stable")
    return q[order], r[order], score[order], depths


def shard_top(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None):
    """Best k of a shard for each query: (number of the query, vec_id, score), flat, and the depth to which each query read its lists.

    floors: scores that k other rows reach.
    """
    m = rows.shape[1]
    bound = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(m, 1)
    kind = np.float64 if bound < 2**53 else np.int64  # doubles are exact here
    lists, queries = Lists(rows.astype(kind)), queries.astype(kind)
    floors = np.full(len(queries), np.iinfo(np.int64).min) if floors is None else floors
    floors = floors.astype(kind)
    found = []
    for a in range(0, len(queries), TOGETHER):
        b = slice(a, a + TOGETHER)
        q, r, score, depths = _block_top(lists, ids, query_ids[b], queries[b], k, floors[b])
        found.append((q + a, ids[r], score.astype(np.int64), depths))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _group(group: pa.Table, k: int) -> pa.Table:
    dim = group["dim"][0].as_py()
    ids, values = group["vec_id"].to_numpy(), group["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
    asked = group["query"].is_valid().to_numpy()
    if not asked.any() or asked.all() or not dim:
        return SCHEMA.empty_table()
    query, own = group["query"].filter(pa.array(asked)).to_numpy(), ids[asked]
    floors = group["floor"].filter(pa.array(asked)).fill_null(np.iinfo(np.int64).min).to_numpy()
    q, vec_id, score, _ = shard_top(ids[~asked], values[~asked], own, values[asked], k, floors)
    return pa.table([query[q], own[q], vec_id, score], schema=SCHEMA)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """vectors, queries: (vec_id, embedding); to (query_id, rank, vec_id, score)."""

    def made(df: DataFrame) -> DataFrame:
        v = df.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col("embedding")).alias("v")).where("v is not null")
        return v.withColumn("dim", F.size("v"))

    vectors, queries = written(made(vectors).withColumn("nth", F.monotonically_increasing_id()), "vectors"), written(made(queries).distinct(), "queries")
    shards, blocks = max(1, -(-vectors.count() // SHARD)), max(1, -(-queries.count() // QUERIES))
    no = lambda: F.lit(None).cast("long")
    dealt = vectors.withColumn("shard", F.pmod("nth", F.lit(shards)))  # by place, so that rows that repeat don't share a shard
    asked = queries.withColumn("query", F.xxhash64("vec_id", "v")).withColumn("block", F.pmod("query", F.lit(blocks)).cast("int"))

    def found(shard_rows: DataFrame, asked: DataFrame, first: int, last: int) -> DataFrame:
        rows = shard_rows.select("vec_id", "v", "dim", no().alias("query"), no().alias("floor"), "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        each = asked.select("vec_id", "v", "dim", "query", "floor", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("shard"), "block")
        return rows.unionByName(each).groupBy("dim", "shard", "block").applyInArrow(lambda g: _group(g, k), "query long, query_id long, vec_id long, score long")

    out = written(found(dealt.where("shard = 0"), asked.withColumn("floor", no()), 0, 0), "first")
    if shards > 1:
        floors = out.groupBy("query").agg(F.collect_list("score").alias("s")).where(F.size("s") >= k).select("query", F.array_min("s").alias("floor"))
        rest = found(dealt.where("shard > 0"), asked.join(floors, "query", "left"), 1, shards - 1)
        out = out.unionByName(rest)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.drop("query").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM (SELECT DISTINCT * FROM v) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
