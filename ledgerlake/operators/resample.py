"""Bootstrap and permutation statistics of exact size, whose replicates are drawn inside the rows' tasks.

Rows lie in chunks by their place, in an order that any engine can make. A bootstrap replicate of n rows is drawn down a
tree: its n draws fall on chunks (a count a replicate and chunk, made without touching a row), then within a chunk on its
rows. So every replicate holds exactly n rows, no row moves, and a chunk knows its part from one number a replicate. In a
permutation every row has a number of its own for each replicate, a bijection of its place; the first group are the rows
with the least numbers, as many as it has, and the number that bounds them is found from counts of ranges for all
replicates at once. All draws are integer arithmetic below 2^62, so SQL can make the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.orderstats import places
from ledgerlake.operators.splits import Chunk, select, sums
from ledgerlake.plans.registry import query
from ledgerlake.sources.sinks import stored
from ledgerlake.sources.tables import load

#: Numbers of replicates and permutations, and the least size of a group that is tested.
REPLICATES, PERMUTATIONS, LEAST_GROUP = 10_000, 10_000, 10
MASK = (1 << 32) - 1
#: Odd factors below 2^31, and keys that tell the uses of mixed() apart.
FACTORS, SECOND, ROOT, LEAF, PERMUTED = (569420461, 1935289751), 1640531527, 101, 202, 303
TOGETHER = 1 << 19  # pairs of a row, or a draw, and a replicate that are drawn at once
ROWS = 256  # rows of a chunk
DRAWS = 1 << 24  # draws that a task makes on the tree's first level


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 32 bits."""
    x = (x ^ (x >> 16)) * FACTORS[0] & MASK
    x = (x ^ (x >> 15)) * FACTORS[1] & MASK
    return x ^ (x >> 15)


def mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Another for each key."""
    return scrambled((scrambled(x ^ key) + key) & MASK)


def drawn(x: np.ndarray, key: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """Places below n for the draws x of a key; two bijections together are none, so places repeat as in any draw."""
    return ((mixed(x, key) ^ mixed(x, (key + SECOND) & MASK)) * n) >> 32


def key_of(replicate: np.ndarray, use: int, part: int | np.ndarray = 0) -> np.ndarray:
    return scrambled((replicate * 65537 + use * 7919 + part * 31) & MASK)


def _scrambled_sql(x: str, name: str) -> str:
    """Columns of scrambled(x), the last one under the name."""
    return f"xor({x}, {x} >> 16) * {FACTORS[0]} & {MASK} AS {name}_1, xor({name}_1, {name}_1 >> 15) * {FACTORS[1]} & {MASK} AS {name}_2, xor({name}_2, {name}_2 >> 15) AS {name}"


def _mixed_sql(x: str, key: str, name: str) -> str:
    return f"xor({x}, {key}) AS {name}_a, {_scrambled_sql(f'{name}_a', f'{name}_b')}, ({name}_b + {key}) & {MASK} AS {name}_c, {_scrambled_sql(f'{name}_c', name)}"


def _drawn_sql(x: str, key: str, n: str, name: str) -> str:
    return f"{_mixed_sql(x, key, f'{name}_p')}, ({key} + {SECOND}) & {MASK} AS {name}_k, {_mixed_sql(x, f'{name}_k', f'{name}_q')}, xor({name}_p, {name}_q) * {n} >> 32 AS {name}"


def _key_sql(replicate: str, use: int, part: str, name: str) -> str:
    return f"({replicate} * 65537 + {use * 7919} + {part} * 31) & {MASK} AS {name}_0, {_scrambled_sql(f'{name}_0', name)}"


_LABELLED = "SELECT doc_id, toxic AS g, quality AS q, length(text) AS v FROM labels JOIN documents USING (doc_id) WHERE text IS NOT NULL AND toxic IS NOT NULL AND quality IS NOT NULL"


def _bootstrap_sql(stratum: str) -> str:
    """CTEs: w has a row x and w, how often it occurs in replicate r; strata are drawn from on their own."""
    return f"""x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, v, g, q) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM (SELECT *, {stratum} AS s FROM ({_LABELLED}))),
st AS (SELECT DISTINCT s, n FROM x),
root AS (SELECT s, n, r, {_key_sql("r", ROOT, "s", "k")}, t, {_drawn_sql("t", "k", "n", "p")} FROM st, (SELECT unnest(range({REPLICATES})) AS r), LATERAL (SELECT unnest(range(n)) AS t)),
leaf AS MATERIALIZED (SELECT s, n, r, p // {ROWS} AS c, count(*) AS m FROM root GROUP BY ALL),
picked AS (SELECT s, r, c, {_key_sql("r", LEAF, "(c * 2 + s)", "k")}, least({ROWS}, n - c * {ROWS}) AS size, t, {_drawn_sql("t", "k", "size", "p")} FROM leaf, LATERAL (SELECT unnest(range(m)) AS t)),
pw AS (SELECT s, r, c * {ROWS} + p AS i, count(*) AS w FROM picked GROUP BY ALL),
w AS MATERIALIZED (SELECT r, x.*, w FROM pw JOIN x USING (s, i))"""


def spread(table: DataFrame, chunks: int) -> DataFrame:
    """Chunks over as many tasks as keep all cores busy: a number that is given is not coalesced."""
    return table.repartition(max(1, min(2 * chunks, 64 * table.sparkSession.sparkContext.defaultParallelism)), "stratum", "chunk")


def groups(spark, sf_dir, by_group: bool) -> DataFrame:
    """Chunks of labelled documents: x the place within the stratum, y the length, z the group (0, 1) plus twice the quality; stratum, chunk.

    The stratum is the group, or 0 for all rows.
    """
    docs = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.char_length("text").cast("double").alias("y"))
    rows = load(spark, sf_dir, "labels").where("toxic is not null and quality is not null").join(docs, "doc_id")
    rows = rows.select("doc_id", "y", (F.col("toxic") + 2 * F.col("quality")).cast("double").alias("z"), (F.col("toxic") if by_group else F.lit(0)).cast("int").alias("stratum"))
    rows = places(rows, F.asc("stratum"), F.asc("doc_id"), F.asc("y"), F.asc(F.col("z") % 2), F.asc("z"))
    first = rows.groupBy("stratum").agg(F.min("_i").alias("_first"))  # two at most
    rows = rows.join(F.broadcast(first), "stratum").withColumn("x", (F.col("_i") - F.col("_first")))
    rows = rows.withColumn("chunk", F.floor(F.col("x") / ROWS))
    packed = spread(rows, rows.count() // ROWS + 1).groupBy("stratum", "chunk").agg(F.array_sort(F.collect_list(F.struct("x", "y", "z"))).alias("r"))
    return stored(packed.select("stratum", "chunk", *[F.col(f"r.{c}").cast("array<double>").alias(c) for c in "xyz"]), "chunks")


def _fallen(batches, n_of: dict[int, int], rows: int):
    """Draws of (stratum, first replicate, first draw, replicates, draws) by chunk of so many rows."""
    for b in batches:
        for stratum, r0, t0, some, many in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n = n_of[stratum]
            chunks = -(-n // rows)
            r = np.arange(r0, r0 + some, dtype=np.int64)
            total = np.zeros((some, chunks), np.int64)
            step = max(1, TOGETHER // some)
            for t in range(t0, t0 + many, step):
                at = drawn(np.arange(t, min(t + step, t0 + many))[None, :], key_of(r, ROOT, stratum)[:, None], n) // rows
                total += np.bincount((np.arange(some)[:, None] * chunks + at).ravel(), minlength=total.size).reshape(total.shape)
            i, c = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), stratum, np.int32)), pa.array(c), pa.array(r[i]), pa.array(total[i, c])], ["stratum", "chunk", "r", "n"])


def counted_draws(table: DataFrame, replicates: int) -> DataFrame:
    """The tree's first level: (stratum, chunk, draws), the number of each replicate's draws that fall on a chunk, as bytes of 4."""
    spark = table.sparkSession
    n_of = {s: n for s, n in table.groupBy("stratum").agg(F.sum(F.size("x"))).collect()}
    if any(n > MASK for n in n_of.values()):
        raise ValueError("more rows than 32 bits can place")
    tasks, rows = [], ROWS
    for stratum, n in n_of.items():
        some = max(1, min(replicates, 64, DRAWS // n))
        tasks += [(stratum, r, t, min(some, replicates - r), min(DRAWS, n - t)) for r in range(0, replicates, some) for t in range(0, n, DRAWS)]
    each = spark.createDataFrame(tasks, "stratum int, r long, t long, some long, many long").repartition(max(1, min(len(tasks), 4 * spark.sparkContext.defaultParallelism)))
    found = each.mapInArrow(lambda it: _fallen(it, n_of, rows), "stratum int, chunk long, r long, n long").groupBy("stratum", "chunk", "r").agg(F.sum("n").alias("n"))

    def packed(group: pa.Table) -> pa.Table:
        out = np.zeros(replicates, np.int32)
        out[group["r"].to_numpy()] = group["n"].to_numpy()
        return pa.table([group["stratum"][:1], group["chunk"][:1], pa.array([out.tobytes()])], names=["stratum", "chunk", "draws"])

    return found.groupBy("stratum", "chunk").applyInArrow(packed, "stratum int, chunk long, draws binary")


def drawable(table: DataFrame, replicates: int) -> DataFrame:
    """Chunks for weights(): roles holds stratum, chunk and the draws that fall on it."""
    head = F.concat(*[F.to_binary(F.lpad(F.hex(F.col(c).cast("long")), 16, "0"), F.lit("hex")) for c in ("stratum", "chunk")])
    both = spread(table.join(counted_draws(table, replicates), ["stratum", "chunk"], "left"), table.count())
    none = F.lit(bytes(4 * replicates))
    return stored(both.select(F.concat(head, F.coalesce("draws", none)).alias("roles"), "x", "y", "z"), "drawable")


def blocks(rows: int, n: int):
    """Numbers of replicates, as many as may be drawn at once for so many rows."""
    step = max(1, TOGETHER // max(1, rows))
    for a in range(0, n, step):
        yield np.arange(a, min(n, a + step))


def weights(chunk: Chunk, r: np.ndarray) -> np.ndarray:
    """How often each row of a chunk occurs in each replicate: the tree's second level."""
    stratum, number = (int.from_bytes(chunk.raw[a : a + 8], "big") for a in (0, 8))
    draws = np.frombuffer(chunk.raw[16:], np.int32)[r].astype(np.int64)
    which = np.repeat(np.arange(len(r)), draws)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(draws) - draws, draws)
    at = drawn(nth, np.repeat(key_of(r, LEAF, number * 2 + stratum), draws), len(chunk.y))
    return np.bincount(which * len(chunk.y) + at, minlength=len(r) * len(chunk.y)).reshape(len(r), len(chunk.y))


def weighted_sums(table: DataFrame, fields: list[str], of) -> DataFrame:
    """(key, *fields): sums over the rows of each bootstrap replicate; of(chunk) gives a column for each field."""

    def part(chunk: Chunk):
        columns = np.stack(of(chunk), axis=1)
        for r in blocks(len(chunk.y), REPLICATES):
            yield r, weights(chunk, r) @ columns

    return sums(table, REPLICATES, fields, part)


def _interval(d: DataFrame, column: str):
    q = d.agg(F.count(column).alias("replicates"), F.expr(f"percentile({column}, array(0.025D, 0.975D))").alias("q"))
    return q.select("replicates", F.round(F.col("q")[0], 6).alias("lo"), F.round(F.col("q")[1], 6).alias("hi"))


@query(f"""WITH {_bootstrap_sql("g")},
s AS (SELECT r, sum(v * w) FILTER (g = 1) / CAST(sum(w) FILTER (g = 1) AS DOUBLE) - sum(v * w) FILTER (g = 0) / CAST(sum(w) FILTER (g = 0) AS DOUBLE) AS d, sum(w) FILTER (g = 1) AS n1, sum(w) FILTER (g = 0) AS n0 FROM w GROUP BY r)
SELECT count(d) AS replicates, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi, CAST(min(n1) AS BIGINT) AS n1, CAST(min(n0) AS BIGINT) AS n0, min(n1) = max(n1) AND min(n0) = max(n0) AS whole FROM s""")
def bootstrap_difference(spark, sf_dir):
    """Interval of the difference in mean length between two groups, each drawn from on its own; whole: every replicate holds each group's number of rows."""
    one = lambda c: c.z % 2
    table = drawable(groups(spark, sf_dir, True), REPLICATES)
    s = weighted_sums(table, ["w1", "v1", "w0", "v0"], lambda c: (one(c), c.y * one(c), 1 - one(c), c.y * (1 - one(c))))
    s = s.select("w1", "w0", F.expr("try_divide(v1, w1) - try_divide(v0, w0)").alias("d"))
    whole = (F.min("w1") == F.max("w1")) & (F.min("w0") == F.max("w0"))
    size = s.agg(F.min("w1").cast("long").alias("n1"), F.min("w0").cast("long").alias("n0"), whole.alias("whole"))
    return _interval(s, "d").join(F.broadcast(size))


@query(f"""WITH {_bootstrap_sql("g")}, n AS (SELECT count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n0 FROM x),
c AS (SELECT r, g, v, sum(w) OVER (PARTITION BY r, g ORDER BY v, doc_id) AS upto, sum(w) OVER (PARTITION BY r, g) AS n FROM w),
m AS (SELECT r, g, (min(v) FILTER (upto >= (n + 1) // 2) + min(v) FILTER (upto >= n // 2 + 1)) / CAST(2 AS DOUBLE) AS m FROM c GROUP BY ALL),
s AS (SELECT max(m) FILTER (g = 1) - max(m) FILTER (g = 0) AS d FROM m GROUP BY r)
SELECT n1, n0, n1 >= {LEAST_GROUP} AND n0 >= {LEAST_GROUP} AS tested, CASE WHEN n1 >= {LEAST_GROUP} AND n0 >= {LEAST_GROUP} THEN round(quantile_cont(d, 0.025), 6) END AS lo,
       CASE WHEN n1 >= {LEAST_GROUP} AND n0 >= {LEAST_GROUP} THEN round(quantile_cont(d, 0.975), 6) END AS hi FROM s, n GROUP BY n1, n0""")
def bootstrap_median(spark, sf_dir):
    """Interval of the difference in median length; not tested if a group has fewer than ten rows. The medians of all replicates come from counts of ranges."""
    rows = groups(spark, sf_dir, True)
    each = rows.select(F.explode(F.arrays_zip("y", "z")).alias("r"))
    n1, n0 = each.agg(F.count_if(F.col("r.z") % 2 == 1), F.count_if(F.col("r.z") % 2 == 0)).first()
    row = {"n1": n1, "n0": n0, "tested": min(n1, n0) >= LEAST_GROUP, "lo": None, "hi": None}
    if row["tested"]:

        def draws(chunk: Chunk):
            for r in blocks(len(chunk.y), REPLICATES):
                yield r, weights(chunk, r)

        middle = lambda n: np.stack([(n + 1) // 2, n // 2 + 1], axis=-1) * ((n > 0) & (np.arange(n.shape[1]) < 2))[..., None]  # noqa: E731  of the groups, not of the whole
        # medians of replicates lie near the sample's; lengths further off fall into the outer ranges
        off = [min(0.5, 4 / n**0.5) for n in (n0, n1)]
        near = [F.percentile_approx(F.when(F.col("r.z") % 2 == g, F.col("r.y")), [0.5 - w, 0.5 + w], 1000) for g, w in enumerate(off)]
        ends = [v for pair in each.agg(*near).first() for v in pair]
        table = drawable(rows, REPLICATES)
        two, _ = select(table, REPLICATES, draws, lambda c, s: c.y[None, :], (min(ends), max(ends)), middle, lambda c: (c.z % 2).astype(np.int64), 2)
        m = two.mean(axis=2)
        d = m[:, 1] - m[:, 0]
        row["lo"], row["hi"] = (round(float(x), 6) for x in np.percentile(d[~np.isnan(d)], [2.5, 97.5]))
    return spark.createDataFrame([tuple(row.values())], "n1 long, n0 long, tested boolean, lo double, hi double")


def numbers(chunk: Chunk, r: np.ndarray) -> np.ndarray:
    """A number for each replicate and row; no two rows of a replicate share one."""
    return mixed(chunk.x.astype(np.int64)[None, :], key_of(r, PERMUTED)[:, None])


def thresholds(table: DataFrame, first: int, permutations: int) -> np.ndarray:
    """The number below which, itself included, exactly so many rows of each permutation lie."""

    def draws(chunk: Chunk):
        for r in blocks(len(chunk.y), permutations):
            yield r, None

    ranks = lambda n: np.full((*n.shape, 1), first) * np.array([0, 1])[None, :, None]  # noqa: E731  of the whole only
    n = table.agg(F.sum(F.size("y"))).first()[0]
    share = first / n  # numbers are as good as uniform, so the bound lies near this share of them; those further off fall into the outer ranges
    width = 8 * (share * (1 - share) / n) ** 0.5
    near = tuple(float(np.clip(b, 0, 1) * MASK) for b in (share - width, share + width))
    values, _ = select(table, permutations, draws, lambda c, r: numbers(c, r).astype(float), near, ranks, lambda c: np.zeros(len(c.y), np.int64), 1)
    return values[:, 1, 0]


@query(f"""WITH x AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id, v, g, q) - 1 AS i FROM ({_LABELLED})), n AS (SELECT CAST(sum(g) AS BIGINT) AS n1 FROM x),
k AS (SELECT r, {_key_sql("r", PERMUTED, "0", "k")} FROM (SELECT unnest(range({PERMUTATIONS})) AS r)),
u AS (SELECT r, v, {_mixed_sql("i", "k", "u")} FROM x, k),
o AS (SELECT r, v, row_number() OVER (PARTITION BY r ORDER BY u) <= n1 AS one FROM u, n),
p AS (SELECT r, abs(avg(v) FILTER (one) - avg(v) FILTER (NOT one)) AS d, count(*) FILTER (one) AS n1, count(*) FILTER (NOT one) AS n0 FROM o GROUP BY r),
obs AS (SELECT abs(avg(v) FILTER (g = 1) - avg(v) FILTER (g = 0)) AS d FROM x)
SELECT count(p.d) AS permutations, count(*) FILTER (p.d >= obs.d - 1e-9) AS hits, round((count(*) FILTER (p.d >= obs.d - 1e-9) + 1) / CAST(count(p.d) + 1 AS DOUBLE), 9) AS p, min(n1) AS n1, min(n0) AS n0, min(n1) = max(n1) AND min(n0) = max(n0) AS whole FROM p, obs""")
def permutation_test(spark, sf_dir):
    """Two-sided test of the difference in means; whole: both groups keep their size in every permutation."""
    table = groups(spark, sf_dir, False).withColumn("roles", F.lit(b""))
    each = table.select(F.explode(F.arrays_zip("y", "z")).alias("r")).select(F.col("r.y").alias("v"), (F.col("r.z") % 2).alias("g"))
    first, n, obs = each.agg(F.sum("g"), F.count("*"), F.abs(F.avg(F.when(F.col("g") == 1, F.col("v"))) - F.avg(F.when(F.col("g") == 0, F.col("v"))))).first()
    bound = thresholds(table, int(first or 0), PERMUTATIONS) if first and n > first else np.full(PERMUTATIONS, -1.0 if not first else float(MASK))

    def part(chunk: Chunk):
        columns = np.stack([np.ones(len(chunk.y)), chunk.y], axis=1)
        total = columns.sum(axis=0)
        for r in blocks(len(chunk.y), PERMUTATIONS):
            a = (numbers(chunk, r) <= bound[r, None]) @ columns
            yield r, np.hstack([a, total - a])

    s = sums(table, PERMUTATIONS, ["na", "va", "nb", "vb"], part)
    d = s.select("na", "nb", F.expr("abs(try_divide(va, na) - try_divide(vb, nb))").alias("d"))
    hits = F.count_if(F.col("d") >= F.lit(obs) - 1e-9)
    whole = (F.min("na") == F.max("na")) & (F.min("nb") == F.max("nb"))
    return d.agg(F.count("d").alias("permutations"), hits.alias("hits"), F.round((hits + 1) / (F.count("d") + 1), 9).alias("p"), F.min("na").cast("long").alias("n1"), F.min("nb").cast("long").alias("n0"), whole.alias("whole"))


#: Coefficient of g in the least squares of y on (1, g, q), g and q being 0 or 1, from weighted sums.
_DET = "(w * (g * q - gq * gq) - g * (g * q - gq * q) + q * (g * gq - g * q))"
_COEF = f"(w * (gy * q - gq * qy) - y * (g * q - gq * q) + q * (g * qy - gy * q)) / {_DET}"
_SUMS = "sum(w) AS w, sum(w * g) AS g, sum(w * q) AS q, sum(w * g * q) AS gq, sum(w * y) AS y, sum(w * g * y) AS gy, sum(w * q * y) AS qy"


@query(f"""WITH {_bootstrap_sql("0")}, l AS (SELECT r, CAST(w AS DOUBLE) AS w, CAST(g AS DOUBLE) AS g, CAST(q AS DOUBLE) AS q, ln(v) AS y FROM w WHERE v > 0),
s AS (SELECT r, {_SUMS} FROM l GROUP BY r),
b AS (SELECT {_COEF} AS c FROM s WHERE abs({_DET}) > 1e-9),
o AS (SELECT {_COEF} AS c FROM (SELECT {_SUMS} FROM (SELECT CAST(1 AS DOUBLE) AS w, CAST(g AS DOUBLE) AS g, CAST(q AS DOUBLE) AS q, ln(v) AS y FROM x WHERE v > 0)))
SELECT round(any_value(o.c), 6) AS coefficient, count(b.c) AS replicates, round(quantile_cont(b.c, 0.025), 6) AS lo, round(quantile_cont(b.c, 0.975), 6) AS hi FROM b, o""")
def regression_interval(spark, sf_dir):
    """Log length on group and quality: the group's coefficient and its bootstrap interval; a replicate whose normal equations are singular is left out."""
    table = drawable(groups(spark, sf_dir, False), REPLICATES)
    names = ["w", "g", "q", "gq", "y", "gy", "qy"]

    def columns(c: Chunk):
        some = (c.y > 0).astype(np.float64)
        g, q, y = (c.z % 2) * some, (c.z // 2) * some, np.log(np.maximum(c.y, 1)) * some
        return some, g, q, g * q, y, g * y, q * y

    s = weighted_sums(table, names, columns)
    whole = sums(table, 1, names, lambda c: iter([(np.zeros(1, np.int64), np.stack(columns(c), axis=1).sum(axis=0, keepdims=True))]))
    told = _interval(s.where(f"abs({_DET}) > 1e-9").select(F.expr(_COEF).alias("c")), "c")
    return whole.select(F.round(F.expr(f"try_divide({_COEF.rpartition(' / ')[0]}, {_DET})"), 6).alias("coefficient")).join(F.broadcast(told))
