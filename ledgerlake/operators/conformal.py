"""Split-conformal evaluation: methods on the same splits, coverage over seeds, decisions.

Roles come from hash order, so that any engine draws the same split. All seeds are evaluated in a few passes over the
ledger's chunks (see splits); no row is copied for a seed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.operators.splits import CALIBRATION, TEST, TRAIN, Block, Chunk, Curves, blocks, chunks, of_role, role_bytes, select, sums
from ledgerlake.plans.registry import query
from ledgerlake.sources.tables import BINS, BINS_SQL, LEDGER_SQL, bins, ledger

#: Number of splits, nominal levels, least rows of a bin, margins and multiples of errors, and the status of too little support.
SEEDS, LEVELS, LEAST = 200, (0.9, 0.95), 30
MARGIN, HOLD_ERRORS, DEVIATION_ERRORS, PAIR_ERRORS = 0.01, 3, 5, 2
DEFERRED = "DEFERRED_INSUFFICIENT_SUPPORT"
N_BINS, N_BANDS = len(BINS), 3
WHOLE = N_BINS  # the stratum of all rows


def rank_needed(n, level: float):
    """k = ceil((n + 1)(1 - alpha)), alpha = 1 - level, in doubles."""
    return np.ceil((n + 1) * (1.0 - (1.0 - level))).astype(np.int64)


def bin_of(x: np.ndarray) -> np.ndarray:
    """Number of the half-open bin of a value within the grid."""
    return np.searchsorted(np.array([hi for _, hi in BINS]), x, "right")


def band_of(z: np.ndarray) -> np.ndarray:
    return np.where(z <= 0.02, 0, np.where(z < 0.06, 1, 2))


def _middle(n: np.ndarray) -> np.ndarray:
    return np.stack([(n + 1) // 2, n // 2 + 1], axis=-1) * (n > 0)[..., None]


def _needed(n: np.ndarray) -> np.ndarray:
    return np.stack([rank_needed(n, x) for x in LEVELS], axis=-1) * (n > 0)[..., None]


def of_whole(ranks):
    """Ranks of the last stratum alone, that of all rows."""
    return lambda n: ranks(n) * (np.arange(n.shape[1]) == n.shape[1] - 1)[None, :, None]


def of_parts(ranks):
    """Ranks of all strata but the last."""
    return lambda n: ranks(n) * (np.arange(n.shape[1]) < n.shape[1] - 1)[None, :, None]


def everything(chunk: Chunk) -> np.ndarray:
    return np.zeros(len(chunk.x), np.int64)


@dataclass
class Evaluation:
    """The ledger's chunks, its number of splits and what is known of its values."""

    table: DataFrame
    seeds: int
    bounds: tuple[float, float]
    n_accessions: int

    def centres(self) -> np.ndarray:
        """Train medians by seed."""
        return _mean_of_two(select(self.table, self.seeds, of_role(TRAIN), _label, self.bounds, of_whole(_middle), everything, 1)[0][:, -1])

    def centres_by_bin(self) -> tuple[np.ndarray, np.ndarray]:
        """Train medians and counts by seed and bin; the last is that of all bins."""
        two, n = select(self.table, self.seeds, of_role(TRAIN), _label, self.bounds, _middle, lambda c: bin_of(c.x), N_BINS)
        return _mean_of_two(two), n

    def quantiles(self, score) -> np.ndarray:
        """The needed order statistics of calibration scores by seed and level, NaN where they exceed the count."""
        return select(self.table, self.seeds, of_role(CALIBRATION), score, (0.0, self.bounds[1] - self.bounds[0]), of_whole(_needed), everything, 1)[0][:, -1]

    def quantiles_by_bin(self, score) -> tuple[np.ndarray, np.ndarray]:
        """The same by seed, bin and level, with the counts."""
        q, n = select(self.table, self.seeds, of_role(CALIBRATION), score, (0.0, self.bounds[1] - self.bounds[0]), of_parts(_needed), lambda c: bin_of(c.x), N_BINS)
        return q[:, :N_BINS], n[:, :N_BINS]


def _label(chunk: Chunk, seeds: np.ndarray) -> np.ndarray:
    return chunk.y[None, :]


def _mean_of_two(two: np.ndarray) -> np.ndarray:
    return two[..., 0] * 0.5 + two[..., 1] * 0.5


#: The interval of a chunk's rows for some seeds at a level: two arrays of seeds by rows.
Intervals = Callable[[Chunk, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def prepared(rows: DataFrame, identity: list[str], seeds: int = SEEDS) -> Evaluation:
    """rows: (accession, x, y, z, *identity), y finite and x within the grid."""
    table, bounds, n = chunks(rows, identity, seeds)
    return Evaluation(table, seeds, bounds, n)


def evaluated(spark: SparkSession, sf_dir: str) -> Evaluation:
    rows = ledger(spark, sf_dir).where("feature >= 0 and feature < 100.01 and label is not null and not isnan(label)")
    rows = rows.select("accession", F.col("feature").alias("x"), F.col("label").alias("y"), F.col("channel_a").alias("z"), "entry", "chain", "pos")
    return prepared(rows, ["entry", "chain", "pos"])


def pooled(e: Evaluation, centres: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends by seed and level. The centre is the train median, the half width the needed residual."""
    c = e.centres() if centres is None else centres
    q = e.quantiles(lambda chunk, s: np.abs(chunk.y[None, :] - c[s, None]))
    return c[:, None] - q, c[:, None] + q


def mondrian(e: Evaluation) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Lower and upper ends by seed, bin and level, which bins fell back to the pooled interval for too few rows, and that interval."""
    c, n_train = e.centres_by_bin()
    q, n_cal = e.quantiles_by_bin(lambda chunk, s: np.abs(chunk.y[None, :] - c[s][:, bin_of(chunk.x)]))
    lo, hi = pooled(e, c[:, WHOLE])
    own = ((n_train[:, :N_BINS] >= LEAST) & (n_cal >= LEAST))[:, :, None]
    mine = c[:, :N_BINS, None]
    return np.where(own, mine - q, lo[:, None]), np.where(own, mine + q, hi[:, None]), ~own[:, :, 0], (lo, hi)


class Constant:
    """Intervals with the same ends for all rows of a stratum: ends(seeds, level, stratum) gives two arrays of seeds."""

    def __init__(self, ends: Callable[[np.ndarray, int, int], tuple[np.ndarray, np.ndarray]]):
        self.ends = ends


def constant(lo: np.ndarray, hi: np.ndarray) -> Constant:
    return Constant(lambda s, level, _: (lo[s, level], hi[s, level]))


def by_bin(lo: np.ndarray, hi: np.ndarray) -> Constant:
    """For runs() by bin."""
    return Constant(lambda s, level, g: (lo[s, g, level], hi[s, g, level]))


class Beyond:
    """Intervals that reach beyond two curves in x: those widened by q, by seed and level."""

    def __init__(self, curves: Curves, q: np.ndarray):
        self.curves, self.q = curves, q

    def __call__(self, chunk: Chunk, s: np.ndarray, level: int):
        lo, hi = self.curves(chunk.x, s, level)
        return lo - self.q[s, level, None], hi + self.q[s, level, None]


def _beyond(intervals: Beyond, levels: tuple[int, ...], by_chunk):
    """Fields of runs() by bin for a block of test rows: searches by distinct x and split instead of a comparison by row and split."""

    def part(block: Block):
        if not block.few:
            for chunk in block.chunks:
                yield from by_chunk(chunk)
            return
        s = np.flatnonzero(block.of.any(axis=0))
        if not len(s):
            return
        g = bin_of(block.x)
        has, mine = np.eye(N_BINS)[g], block.of[:, s].T.astype(np.float64)
        at = block.who * N_BINS + np.repeat(g, np.diff(block.ends))
        total, low = (mine @ np.bincount(at, w, len(block.chunks) * N_BINS).reshape(-1, N_BINS) for w in (block.y, block.y < 0.6))
        first, last = block.ends[:-1, None], block.ends[1:, None]
        n = block.count(first, last, s).T
        by_bin = n @ has
        keep = by_bin > 0
        for i in levels:
            lo, hi = intervals.curves(block.x, s, i)
            lo, hi = lo - intervals.q[s, i, None], hi + intervals.q[s, i, None]
            inside = block.count(block.places(lo.T, "left"), block.places(hi.T, "right"), s).T * ~(np.isnan(lo) | np.isnan(hi))
            fields = [by_bin, inside @ has, ((hi - lo) * n) @ has, total - ((lo + hi) / 2 * n) @ has, low]
            keys = (s[:, None] * len(LEVELS) + i) * N_BINS + np.arange(N_BINS)
            yield keys[keep], np.stack([f[keep] for f in fields], axis=1)

    return part


def _covered(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How many of the sorted values lie from each lo to its hi, both included."""
    return np.maximum(np.searchsorted(values, hi, "right") - np.searchsorted(values, lo, "left"), 0) * ~(np.isnan(lo) | np.isnan(hi))


RUN_FIELDS = ["n_test", "covered", "width", "bias", "low"]


def runs(e: Evaluation, intervals: Intervals | Constant, strata: Callable[[Chunk], np.ndarray] = lambda c: bin_of(c.x), n_strata: int = N_BINS, levels: tuple[int, ...] = tuple(range(len(LEVELS)))) -> DataFrame:
    """(seed, level, stratum, n_test, cov, width, bias, low_share) of test rows; strata without rows don't occur."""

    def part(chunk: Chunk):
        s = chunk.seeds(TEST)
        if not len(s):
            return
        g = strata(chunk)
        has = np.eye(n_strata)[g]
        n, low = has.sum(axis=0), (chunk.y < 0.6) @ has
        at = np.flatnonzero(n)
        keys = lambda i: ((s[:, None] * len(LEVELS) + i) * n_strata + at[None, :]).ravel()
        if isinstance(intervals, Constant):
            parts = [np.sort(chunk.y[g == stratum]) for stratum in at.tolist()]
            for i in levels:
                out = np.empty((len(s), len(at), len(RUN_FIELDS)))
                for j, (stratum, y) in enumerate(zip(at.tolist(), parts, strict=True)):
                    lo, hi = intervals.ends(s, i, stratum)
                    for k, v in enumerate((len(y), _covered(y, lo, hi), (hi - lo) * len(y), y.sum() - (lo + hi) / 2 * len(y), low[stratum])):
                        out[:, j, k] = v
                yield keys(i), out.reshape(-1, len(RUN_FIELDS))
            return
        for i in levels:
            lo, hi = intervals(chunk, s, i)
            inside = ((lo <= chunk.y) & (chunk.y <= hi)).astype(np.float64)
            fields = [np.broadcast_to(n, (len(s), n_strata)), inside @ has, (hi - lo) @ has, (chunk.y - (lo + hi) / 2) @ has, np.broadcast_to(low, (len(s), n_strata))]
            yield keys(i), np.stack([f[:, at].ravel() for f in fields], axis=1)

    if isinstance(intervals, Beyond):
        if n_strata != N_BINS:
            raise ValueError("curves are counted by bin")
        found = sums(e.table, e.seeds * len(LEVELS) * n_strata, RUN_FIELDS, _beyond(intervals, levels, part), lambda batches: blocks(batches, TEST))
    else:
        found = sums(e.table, e.seeds * len(LEVELS) * n_strata, RUN_FIELDS, part)
    level = F.element_at(F.array(*map(F.lit, LEVELS)), F.pmod(F.expr(f"key div {n_strata}"), F.lit(len(LEVELS))).cast("int") + 1)
    mean = lambda f: F.col(f) / F.col("n_test")
    return found.select(
        F.expr(f"cast(key div {len(LEVELS) * n_strata} as int)").alias("seed"), level.alias("level"), F.pmod("key", F.lit(n_strata)).cast("int").alias("stratum"),
        F.col("n_test").cast("long").alias("n_test"), F.col("covered").cast("long").alias("covered"), mean("covered").alias("cov"), mean("width").alias("width"), mean("bias").alias("bias"), mean("low").alias("low_share"),
    )


def marginal(per_bin: DataFrame) -> DataFrame:
    """(seed, level, cov) over all test rows of a split."""
    return per_bin.groupBy("seed", "level").agg((F.sum("covered") / F.sum("n_test")).alias("cov"))


def error(column: str) -> Column:
    """Monte Carlo error of a mean over splits; null with fewer than two."""
    return F.stddev_samp(column) / F.sqrt(F.count(column))


def settled(column: str) -> Column:
    """Rounded so that a value half way between two, give or take the noise of a sum, always goes up."""
    return F.round(F.col(column) + 1e-12, 9)


def eligible(per_bin: DataFrame) -> DataFrame:
    """(level, bin, r_bin, means, mcse, status) over the splits in which the bin has LEAST test rows."""
    r = per_bin.where(F.col("n_test") >= LEAST).groupBy("level", F.col("stratum").alias("bin"))
    out = r.agg(F.count("*").alias("r_bin"), F.avg("cov").alias("cov_mean"), error("cov").alias("mcse"), F.avg("n_test").alias("n_test_mean"), F.avg("width").alias("width_mean"), F.avg("bias").alias("bias_mean"))
    return out.withColumn("status", F.when(F.col("r_bin") < 2, DEFERRED).otherwise("SUPPORTED"))


def hold(per_seed: DataFrame, deferred: bool = False) -> DataFrame:
    """(level, r_eff, mean_cov, mcse, outcome): HOLD if the mean reaches the level less three errors, DEFERRED with under two splits."""
    each = per_seed.where(F.lit(not deferred)).groupBy("level").agg(F.count("*").alias("r_eff"), F.avg("cov").alias("mean"), error("cov").alias("se"))
    levels = per_seed.sparkSession.createDataFrame([(x,) for x in LEVELS], "level double")
    enough = F.round(F.col("mean"), 9) >= F.round(F.col("level") - HOLD_ERRORS * F.col("se"), 9)
    out = levels.join(each, "level", "left").withColumn("r_eff", F.coalesce("r_eff", F.lit(0)))
    outcome = F.when((F.col("r_eff") < 2) | F.col("se").isNull(), DEFERRED).when(enough, "HOLD").otherwise("FAIL")
    return out.select("level", "r_eff", F.round("mean", 9).alias("mean_cov"), F.round("se", 9).alias("mcse"), outcome.alias("outcome"))


def deviating(per_bin: DataFrame) -> DataFrame:
    """One row: REPLICATE if at least two supported bins deviate from 0.9 by over five errors, else FALSIFY; DEFERRED with under two supported."""
    bins_at = eligible(per_bin.where("level = 0.9D"))
    supported, far = F.col("status") == "SUPPORTED", F.round(F.abs(F.col("cov_mean") - 0.9), 9) > F.round(DEVIATION_ERRORS * F.col("mcse"), 9)
    told = bins_at.agg(F.count_if(supported).alias("n_supported"), F.count_if(supported & far).alias("n_deviating"))
    outcome = F.when(F.col("n_supported") < 2, DEFERRED).when(F.col("n_deviating") >= 2, "REPLICATE").otherwise("FALSIFY")
    return told.select("n_supported", "n_deviating", outcome.alias("outcome"))


def paired(method: DataFrame, other: DataFrame) -> DataFrame:
    """One row: the greatest deviation of an eligible bin at 0.9, method less pooled, over the splits that have both."""
    worst = lambda d, name: d.where(f"level = 0.9D and n_test >= {LEAST}").groupBy("seed").agg(F.max(F.abs(F.col("cov") - 0.9)).alias(name))
    d = worst(method, "a").join(worst(other, "b"), "seed").agg(F.count("*").alias("r_eff_pair"), F.avg(F.col("a") - F.col("b")).alias("m"), F.stddev_samp(F.col("a") - F.col("b")).alias("sd"))
    half = PAIR_ERRORS * F.col("sd") / F.sqrt("r_eff_pair")
    sure = F.round(F.abs("m"), 9) > F.round(half, 9)
    outcome = F.when(F.col("r_eff_pair") < 2, DEFERRED).when((F.round("m", 9) < -MARGIN) & sure, "WIN").when((F.round("m", 9) > MARGIN) & sure, "MIRRORED_WIN").otherwise("NO_DECISION")
    return d.select("r_eff_pair", F.round("m", 9).alias("mean_d"), F.round(half, 9).alias("half_width"), outcome.alias("outcome"))


def deferred(e: Evaluation, lo: np.ndarray) -> bool:
    """Whether a split somewhere needs a rank beyond its calibration rows, or there are too few accessions to split."""
    return e.n_accessions < 4 or bool(np.isnan(lo).any())


_ROLES = f"""acc AS (SELECT DISTINCT accession FROM ledger),
r0 AS (SELECT seed, accession, row_number() OVER (PARTITION BY seed ORDER BY sha256(seed || ':' || accession), accession) - 1 AS i, count(*) OVER (PARTITION BY seed) AS n
       FROM acc, (SELECT unnest(range({SEEDS})) AS seed)),
roles AS (SELECT seed, accession, CASE WHEN i < n // 2 THEN 0 WHEN i < n // 2 + (n - n // 2) // 2 THEN 1 ELSE 2 END AS role FROM r0),
levels(level) AS (VALUES (CAST(0.9 AS DOUBLE)), (CAST(0.95 AS DOUBLE))),
x AS (SELECT * FROM ledger JOIN roles USING (accession))"""
_RANK = "CAST(ceil((n + 1) * (CAST(1 AS DOUBLE) - (CAST(1 AS DOUBLE) - level))) AS BIGINT)"
_POOLED = f"""{_ROLES},
c AS (SELECT seed, quantile_cont(label, 0.5) AS c FROM x WHERE role = 0 GROUP BY seed),
s AS (SELECT seed, c, abs(label - c) AS s, row_number() OVER (PARTITION BY seed ORDER BY abs(label - c)) AS k, count(*) OVER (PARTITION BY seed) AS n FROM x JOIN c USING (seed) WHERE role = 1),
q AS (SELECT seed, level, c - s AS lo, c + s AS hi FROM s, levels WHERE k = {_RANK})"""
_TEST = """y AS (SELECT x.*, bin FROM x JOIN bins ON feature >= bins.lo AND feature < bins.hi),
pb AS (SELECT seed, level, bin, count(*) AS n_test, avg(CAST(q.lo <= label AND label <= q.hi AS INT)) AS cov, avg(q.hi - q.lo) AS width, avg(label - (q.lo + q.hi) / 2) AS bias,
              avg(CAST(label < CAST(0.6 AS DOUBLE) AS INT)) AS low_share, count(DISTINCT accession) AS proteins FROM y JOIN q USING (seed) WHERE role = 2 GROUP BY ALL)"""
_MONDRIAN = f"""bc AS (SELECT seed, bin, quantile_cont(label, 0.5) AS c, count(*) AS nt FROM y WHERE role = 0 GROUP BY ALL),
bs AS (SELECT seed, bin, c, nt, abs(label - c) AS s, row_number() OVER (PARTITION BY seed, bin ORDER BY abs(label - c)) AS k, count(*) OVER (PARTITION BY seed, bin) AS n FROM y JOIN bc USING (seed, bin) WHERE role = 1),
bq AS (SELECT seed, bin, level, c - s AS lo, c + s AS hi FROM bs, levels WHERE nt >= {LEAST} AND n >= {LEAST} AND k = {_RANK}),
mb AS (SELECT y.seed, q.level, y.bin, count(*) AS n_test, avg(CAST(coalesce(bq.lo, q.lo) <= label AND label <= coalesce(bq.hi, q.hi) AS INT)) AS cov, avg(coalesce(bq.hi, q.hi) - coalesce(bq.lo, q.lo)) AS width,
              avg(label - (coalesce(bq.lo, q.lo) + coalesce(bq.hi, q.hi)) / 2) AS bias, bool_or(bq.lo IS NULL) AS fell_back
       FROM y JOIN q USING (seed) LEFT JOIN bq ON bq.seed = y.seed AND bq.bin = y.bin AND bq.level = q.level WHERE role = 2 GROUP BY ALL)"""
_HOLD = f"""CASE WHEN count(cov) < 2 THEN '{DEFERRED}' WHEN round(avg(cov), 9) >= round(level - {HOLD_ERRORS} * stddev_samp(cov) / sqrt(count(*)), 9) THEN 'HOLD' ELSE 'FAIL' END AS outcome"""


@query(f"""WITH {LEDGER_SQL}, {_POOLED},
p AS (SELECT seed, level, avg(CAST(lo <= label AND label <= hi AS INT)) AS cov FROM x JOIN q USING (seed) WHERE role = 2 GROUP BY seed, level)
SELECT level, count(*) AS r_eff, round(avg(cov), 9) AS mean_cov, round(stddev_samp(cov) / sqrt(count(*)), 9) AS mcse, {_HOLD} FROM p GROUP BY level""")
def pooled_conformal(spark, sf_dir):
    """Pooled intervals over 200 group splits, with the decision at both levels."""
    e = evaluated(spark, sf_dir)
    lo, hi = pooled(e)
    return hold(marginal(runs(e, constant(lo, hi))), deferred(e, lo))


@query(f"""WITH {LEDGER_SQL}, {BINS_SQL}, {_POOLED}, {_TEST}, {_MONDRIAN},
f AS (SELECT level, bin, count(*) FILTER (fell_back) AS fell_back FROM mb GROUP BY ALL)
SELECT level, bin, count(*) AS r_bin, round(avg(cov), 9) AS cov_mean, round(stddev_samp(cov) / sqrt(count(*)), 9) AS mcse, round(avg(n_test), 6) AS n_test_mean, round(avg(width) + 1e-12, 9) AS width_mean, round(avg(bias) + 1e-12, 9) AS bias_mean,
       CASE WHEN count(*) < 2 THEN '{DEFERRED}' ELSE 'SUPPORTED' END AS status, any_value(f.fell_back) AS fell_back
FROM mb JOIN f USING (level, bin) WHERE n_test >= {LEAST} GROUP BY level, bin""")
def mondrian_conformal(spark, sf_dir):
    """Intervals by bin; a bin with under 30 train or calibration rows takes the pooled interval, and fell_back counts the splits where it does."""
    e = evaluated(spark, sf_dir)
    lo, hi, back, _ = mondrian(e)
    per_bin = runs(e, by_bin(lo, hi))
    fell = spark.createDataFrame([(s, b) for s, b in np.argwhere(back).tolist()], "seed int, stratum int")
    n = per_bin.join(F.broadcast(fell), ["seed", "stratum"]).groupBy("level", F.col("stratum").alias("bin")).agg(F.count("*").alias("fell_back"))
    out = eligible(per_bin).join(F.broadcast(n), ["level", "bin"], "left")
    r = lambda c, d=9: F.round(c, d).alias(c)
    return out.select("level", "bin", "r_bin", r("cov_mean"), r("mcse"), r("n_test_mean", 6), settled("width_mean").alias("width_mean"), settled("bias_mean").alias("bias_mean"), "status", F.coalesce("fell_back", F.lit(0)).alias("fell_back"))


def _worst(table: str) -> str:
    return f"(SELECT seed, max(abs(cov - CAST(0.9 AS DOUBLE))) AS d FROM {table} WHERE level = CAST(0.9 AS DOUBLE) AND n_test >= {LEAST} GROUP BY seed)"


@query(f"""WITH {LEDGER_SQL}, {BINS_SQL}, {_POOLED}, {_TEST}, {_MONDRIAN},
h AS (SELECT level, count(*) AS r, round(avg(cov), 9) AS value, round(stddev_samp(cov) / sqrt(count(*)), 9) AS spread, {_HOLD} FROM (SELECT seed, level, sum(cov * n_test) / sum(n_test) AS cov FROM pb GROUP BY ALL) GROUP BY level),
b AS (SELECT bin, count(*) AS r, avg(cov) AS m, stddev_samp(cov) / sqrt(count(*)) AS se FROM pb WHERE level = CAST(0.9 AS DOUBLE) AND n_test >= {LEAST} GROUP BY bin),
d AS (SELECT count(*) FILTER (r >= 2) AS n, count(*) FILTER (r >= 2 AND round(abs(m - CAST(0.9 AS DOUBLE)), 9) > round({DEVIATION_ERRORS} * se, 9)) AS far FROM b),
w AS (SELECT count(*) AS r, avg(m.d - p.d) AS m, {PAIR_ERRORS} * stddev_samp(m.d - p.d) / sqrt(count(*)) AS half FROM {_worst("mb")} m JOIN {_worst("pb")} p USING (seed))
SELECT 'P5-' || CAST(CAST(round(level * 100) AS INT) AS VARCHAR) AS prediction, r AS support, value, spread, outcome FROM h
UNION ALL SELECT 'P6', n, far, NULL, CASE WHEN n < 2 THEN '{DEFERRED}' WHEN far >= 2 THEN 'REPLICATE' ELSE 'FALSIFY' END FROM d
UNION ALL SELECT 'P7a', r, round(m, 9), round(half, 9), CASE WHEN r < 2 THEN '{DEFERRED}' WHEN round(m, 9) < -{MARGIN} AND round(abs(m), 9) > round(half, 9) THEN 'WIN'
    WHEN round(m, 9) > {MARGIN} AND round(abs(m), 9) > round(half, 9) THEN 'MIRRORED_WIN' ELSE 'NO_DECISION' END FROM w""")
def evaluation_decisions(spark, sf_dir):
    """The decisions that pooled and Mondrian intervals allow on the same splits: mean coverage, deviating bins, paired greatest deviation."""
    e = evaluated(spark, sf_dir)
    lo2, hi2, _, (lo, hi) = mondrian(e)
    by_pooled = runs(e, constant(lo, hi))
    off = deferred(e, lo)
    p5 = hold(marginal(by_pooled), off).select(F.concat(F.lit("P5-"), F.round(F.col("level") * 100).cast("int").cast("string")).alias("prediction"), F.col("r_eff").alias("support"), F.col("mean_cov").alias("value"), F.col("mcse").alias("spread"), "outcome")
    p6 = deviating(by_pooled.where(F.lit(not off))).select(F.lit("P6").alias("prediction"), F.col("n_supported").alias("support"), F.col("n_deviating").cast("double").alias("value"), F.lit(None).cast("double").alias("spread"), "outcome")
    p7 = paired(runs(e, by_bin(lo2, hi2)).where(F.lit(not off)), by_pooled).select(F.lit("P7a").alias("prediction"), F.col("r_eff_pair").alias("support"), F.col("mean_d").alias("value"), F.col("half_width").alias("spread"), "outcome")
    return p5.unionByName(p6).unionByName(p7)


#: The outputs that the fourth batch leaves out, and what is told of it instead.
CONDITIONAL, FIRST_SCOPE = ("P6", "P7a", "P7b"), "BATCH4_P5_ONLY_REGISTERED_SUPPRESSION"


def scoped(decisions: DataFrame, batch: int) -> DataFrame:
    """Before the eighth batch, conditional outcomes are taken out, rows and all."""
    if batch >= 8:
        return decisions.withColumn("scope", F.lit("FULL"))
    return decisions.where(~F.col("prediction").isin(*CONDITIONAL)).withColumn("scope", F.lit(FIRST_SCOPE))


def _cells(c: Chunk) -> np.ndarray:
    return bin_of(c.x) * N_BANDS + band_of(c.z)


def proteins(spark: SparkSession, sf_dir: str, stratum: str, seeds: int = SEEDS) -> DataFrame:
    """(seed, stratum, proteins): distinct test accessions by split. An accession's strata are a set of bounded size."""
    rows = ledger(spark, sf_dir).where("feature >= 0 and feature < 100.01 and label is not null and not isnan(label)")
    each = rows.select("accession", F.expr(stratum).alias("stratum")).distinct().join(role_bytes(rows, seeds), "accession")
    held = each.select("stratum", F.posexplode(F.split(F.decode("roles", "US-ASCII"), "")).alias("seed", "role")).where(F.col("role") == str(TEST))
    return held.groupBy("seed", "stratum").agg(F.count("*").alias("proteins"))


_BIN = "CASE " + " ".join(f"WHEN feature < {hi}D THEN {i}" for i, (_, hi) in enumerate(BINS)) + " END"
_BAND = "CASE WHEN channel_a <= 0.02D THEN 0 WHEN channel_a < 0.06D THEN 1 ELSE 2 END"


@query(f"""WITH {LEDGER_SQL}, {BINS_SQL}, {_POOLED}, {_TEST},
f AS (SELECT seed, bin FROM (SELECT unnest(range({SEEDS})) AS seed), bins),
p AS (SELECT * FROM pb WHERE level = CAST(0.9 AS DOUBLE))
SELECT CAST(seed AS INT) AS seed, bin, coalesce(n_test, 0) AS n, coalesce(proteins, 0) AS proteins, round(cov, 9) AS coverage, round(width + 1e-12, 9) AS width, round(bias + 1e-12, 9) AS signed_residual, round(low_share, 9) AS low_share FROM f LEFT JOIN p USING (seed, bin)""")
def floor_table(spark, sf_dir):
    """By split and bin, test rows, distinct accessions, coverage, width, bias and low share at 0.9; empty bins stay with n = 0."""
    e = evaluated(spark, sf_dir)
    found = runs(e, constant(*pooled(e)), levels=(0,))
    frame = bins(spark).select("bin", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))).alias("seed"))
    r = lambda c, name: F.round(c, 9).alias(name)
    out = frame.join(found.withColumnRenamed("stratum", "bin"), ["seed", "bin"], "left").join(proteins(spark, sf_dir, _BIN).withColumnRenamed("stratum", "bin"), ["seed", "bin"], "left")
    return out.select("seed", "bin", F.coalesce("n_test", F.lit(0)).alias("n"), F.coalesce("proteins", F.lit(0)).alias("proteins"), r("cov", "coverage"), settled("width").alias("width"), settled("bias").alias("signed_residual"), r("low_share", "low_share"))


_GRIDS = {"SIX_BIN_GRID": [[0], [1], [2], [3], [4], [5]], "MERGED_STEP1": [[0], [1, 2], [3], [4], [5]], "MERGED_STEP2": [[0, 1, 2], [3], [4], [5]]}
_GRID_ROWS = [(i, name, j, b) for i, (name, grid) in enumerate(_GRIDS.items()) for j, cell in enumerate(grid) for b in cell]


@query(f"""WITH {LEDGER_SQL}, {BINS_SQL}, grids(step, grid, cell, bin) AS (VALUES {", ".join(f"({i}, '{n}', {j}, {b})" for i, n, j, b in _GRID_ROWS)}),
c AS (SELECT step, grid, cell, count(label) AS n, count(DISTINCT accession) AS p FROM grids JOIN bins USING (bin) LEFT JOIN ledger ON feature >= lo AND feature < hi GROUP BY ALL),
g AS (SELECT step, grid, bool_and(n >= 1000 AND p >= 20) AS ok, min(n) AS least_rows, min(p) AS least_proteins FROM c GROUP BY ALL)
SELECT coalesce((SELECT min_by(grid, step) FROM g WHERE ok), 'TOP3_RESCOPE') AS decision, (SELECT max(least_rows) FROM g) AS best_least_rows, (SELECT max(least_proteins) FROM g) AS best_least_proteins""")
def floor_decision(spark, sf_dir):
    """A4: merged-bin fold; rows add, accessions are distinct over the union; first grid whose cells all have support."""
    grids = spark.createDataFrame(_GRID_ROWS, "step int, grid string, cell int, bin int")
    by_bin = ledger(spark, sf_dir).join(F.broadcast(bins(spark)), (F.col("feature") >= F.col("lo")) & (F.col("feature") < F.col("hi"))).groupBy("bin", "accession").agg(F.count("label").alias("n"))
    cells = F.broadcast(grids).join(by_bin, "bin", "left").groupBy("step", "grid", "cell").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_distinct("accession").alias("p"))
    g = cells.groupBy("step", "grid").agg(F.bool_and((F.col("n") >= 1000) & (F.col("p") >= 20)).alias("ok"), F.min("n").alias("ln"), F.min("p").alias("lp"))
    return g.agg(F.coalesce(F.expr("min_by(grid, step) filter (where ok)"), F.lit("TOP3_RESCOPE")).alias("decision"), F.max("ln").alias("best_least_rows"), F.max("lp").alias("best_least_proteins"))


@query(f"""WITH {LEDGER_SQL}, {BINS_SQL}, {_POOLED},
t AS (SELECT seed, bin, CASE WHEN channel_a <= CAST(0.02 AS DOUBLE) THEN 0 WHEN channel_a < CAST(0.06 AS DOUBLE) THEN 1 ELSE 2 END AS band, accession, CAST(q.lo <= label AND label <= q.hi AS INT) AS hit
      FROM x JOIN q USING (seed) JOIN (SELECT bin, lo AS blo, hi AS bhi FROM bins) ON feature >= blo AND feature < bhi WHERE role = 2 AND level = CAST(0.9 AS DOUBLE)),
sc AS (SELECT seed, bin, band, count(*) AS n, count(DISTINCT accession) AS p, avg(hit) AS cov FROM t GROUP BY ALL),
f AS (SELECT seed, bin, band FROM (SELECT unnest(range({SEEDS})) AS seed), bins, (SELECT unnest(range(3)) AS band))
SELECT bin, band, round(avg(coalesce(n, 0)), 6) AS n_rows_mean, round(avg(coalesce(p, 0)), 6) AS n_prot_mean, count(*) FILTER (n >= 100 AND p >= 20) AS eligible, round(avg(cov) FILTER (n >= 100 AND p >= 20), 9) AS coverage,
       round(stddev_samp(cov) FILTER (n >= 100 AND p >= 20) / sqrt(count(*) FILTER (n >= 100 AND p >= 20)), 9) AS mcse, CASE WHEN count(*) FILTER (n >= 100 AND p >= 20) >= 2 THEN 'REPORTED' ELSE 'UNDER_SUPPORTED_STRATUM' END AS status
FROM f LEFT JOIN sc USING (seed, bin, band) GROUP BY bin, band""")
def joint_cells(spark, sf_dir):
    """Bin x band grid over splits, dense; a cell is reported if at least two splits have support for it."""
    e = evaluated(spark, sf_dir)
    found = runs(e, constant(*pooled(e)), _cells, N_BINS * N_BANDS, levels=(0,)).join(proteins(spark, sf_dir, f"({_BIN}) * {N_BANDS} + ({_BAND})"), ["seed", "stratum"])
    frame = spark.range(N_BINS * N_BANDS).select(F.col("id").cast("int").alias("stratum"), F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))).alias("seed"))
    ok = (F.col("n_test") >= 100) & (F.col("proteins") >= 20)
    seen = frame.join(found, ["seed", "stratum"], "left").withColumn("hit", F.when(ok, F.col("cov")))
    out = seen.groupBy("stratum").agg(
        F.round(F.avg(F.coalesce("n_test", F.lit(0))), 6).alias("n_rows_mean"), F.round(F.avg(F.coalesce("proteins", F.lit(0))), 6).alias("n_prot_mean"), F.count_if(ok).alias("eligible"),
        F.round(F.avg("hit"), 9).alias("coverage"), F.round(error("hit"), 9).alias("mcse"),
    )
    cell = (F.expr(f"cast(stratum div {N_BANDS} as int)").alias("bin"), F.pmod("stratum", F.lit(N_BANDS)).alias("band"))
    return out.select(*cell, "n_rows_mean", "n_prot_mean", "eligible", "coverage", "mcse", F.when(F.col("eligible") >= 2, "REPORTED").otherwise("UNDER_SUPPORTED_STRATUM").alias("status"))


@query(f"""WITH {LEDGER_SQL}, {_POOLED},
m AS (SELECT accession, count(*) AS tested, sum(1 - CAST(lo <= label AND label <= hi AS INT)) AS misses FROM x JOIN q USING (seed) WHERE role = 2 AND level = CAST(0.9 AS DOUBLE) GROUP BY accession),
r AS (SELECT *, row_number() OVER (ORDER BY misses DESC, accession) AS place, sum(misses) OVER (ORDER BY misses DESC, accession ROWS UNBOUNDED PRECEDING) AS upto, sum(misses) OVER () AS total FROM m)
SELECT accession, place, tested, CAST(misses AS BIGINT) AS misses, round(misses / tested, 9) AS miss_rate, round(upto / total, 9) AS cumulative_share FROM r WHERE place <= 10""")
def miss_concentration(spark, sf_dir):
    """Misses by accession over all splits, and the share of the worst ten."""
    import pyarrow as pa

    e = evaluated(spark, sf_dir)
    lo, hi = pooled(e)

    def count(batches):
        for b in batches:
            rows = []
            for accession, roles, y in zip(b["accession"].to_pylist(), b["roles"], b["y"], strict=True):
                s, y = np.flatnonzero(np.frombuffer(roles.as_py(), np.uint8) - ord("0") == TEST), np.sort(np.asarray(y.values))
                tested = len(s) * len(y)
                rows.append((accession, tested, tested - int(_covered(y, lo[s, 0], hi[s, 0]).sum())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["accession", "tested", "misses"])

    each = e.table.select("accession", "roles", "y").mapInArrow(count, f"accession {e.table.schema['accession'].dataType.simpleString()}, tested long, misses long")
    m = each.where("tested > 0").groupBy("accession").agg(F.sum("tested").alias("tested"), F.sum("misses").alias("misses"))
    total = F.broadcast(m.agg(F.sum("misses").alias("total")))
    top = m.orderBy(F.desc("misses"), "accession").limit(10)
    w = Window.orderBy(F.desc("misses"), "accession")  # over ten rows
    out = top.select("*", F.row_number().over(w).alias("place"), F.sum("misses").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto")).join(total)
    return out.select("accession", "place", "tested", "misses", F.round(F.col("misses") / F.col("tested"), 9).alias("miss_rate"), F.round(F.col("upto") / F.col("total"), 9).alias("cumulative_share"))
