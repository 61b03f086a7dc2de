"""Further methods on the same splits: isotonic and quantile regression with a conformal step, and classwise conformal sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators import quantreg
from ledgerlake.operators.conformal import _HOLD, _RANK, _ROLES, LEVELS, SEEDS, Beyond, Evaluation, _needed, constant, error, evaluated, hold, marginal, of_parts, paired, pooled, runs
from ledgerlake.operators.scalar import _STATES, e_state
from ledgerlake.operators.splits import CALIBRATION, TEST, TRAIN, Chunk, chunks, halves, of_role, select, select_beyond, sums
from ledgerlake.operators.statistics import pava
from ledgerlake.plans.registry import query
from ledgerlake.sources.tables import LEDGER_SQL, ledger

#: Features have two decimals within [0, 100.01), so that a table of fits has at most so many columns.
FEATURES = 10_001
UNIT = 1e7  # labels are summed as integers of this scale, so that any order gives the same mean


def isotonic(e: Evaluation) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features, and the fit at each by seed: least squares among functions that never fall, straight between train features, level beyond them."""
    xs = np.sort(np.array([r[0] for r in e.table.select(F.explode("x").alias("x")).distinct().limit(FEATURES + 1).collect()], np.float64))
    if len(xs) > FEATURES:
        raise ValueError("features must have two decimals")

    def part(chunk: Chunk):
        s = chunk.seeds(TRAIN)
        at, inverse = np.unique(np.searchsorted(xs, chunk.x), return_inverse=True)
        n, total = np.bincount(inverse), np.bincount(inverse, weights=np.rint(chunk.y * UNIT))
        yield (s[:, None] * len(xs) + at).ravel(), np.tile(np.stack([n, total], axis=1), (len(s), 1))

    def fit(group: pa.Table) -> pa.Table:
        at, n, total = (group[c].to_numpy() for c in ("x", "n", "total"))
        order = np.argsort(at)
        at, n, total = at[order], n[order], total[order]
        level = pava(total / n, n, total)
        return pa.table({"seed": group["seed"].slice(0, 1), "fit": [np.interp(xs, xs[at], level / UNIT).tolist()]}, schema=pa.schema([("seed", pa.int64()), ("fit", pa.list_(pa.float64()))]))

    points = sums(e.table, e.seeds * len(xs), ["n", "total"], part)
    points = points.select(F.expr(f"key div {len(xs)}").alias("seed"), F.pmod("key", F.lit(len(xs))).alias("x"), "n", "total")
    out = np.full((e.seeds, len(xs)), np.nan)
    for r in points.groupBy("seed").applyInArrow(fit, "seed long, fit array<double>").toLocalIterator():
        out[r.seed] = r.fit
    return xs, out


_ISOTONIC = f"""{_ROLES},
g AS (SELECT seed, feature AS f, count(*) AS n, CAST(sum(CAST(round(label * {UNIT:.0f}) AS BIGINT)) AS BIGINT) AS t FROM x WHERE role = 0 GROUP BY ALL),
u AS (SELECT seed, f, sum(n) OVER w AS n, sum(t) OVER w AS t, sum(n) OVER w - n AS n0, sum(t) OVER w - t AS t0 FROM g WINDOW w AS (PARTITION BY seed ORDER BY f ROWS UNBOUNDED PRECEDING)),
m AS (SELECT a.seed, a.f AS a, b.f AS b, CAST(b.t - a.t0 AS DOUBLE) / CAST(b.n - a.n0 AS DOUBLE) AS v FROM u a JOIN u b ON a.seed = b.seed AND a.f <= b.f),
k AS (SELECT m.seed, a, g.f, min(v) AS v FROM m JOIN g ON g.seed = m.seed AND a <= g.f AND g.f <= b GROUP BY ALL),
fit AS (SELECT seed, f AS feature, max(v) / CAST({UNIT:.0f} AS DOUBLE) AS c FROM k GROUP BY ALL)"""


@query(f"""WITH {LEDGER_SQL}, {_ISOTONIC},
s AS (SELECT seed, abs(label - c) AS s, row_number() OVER (PARTITION BY seed ORDER BY abs(label - c)) AS k, count(*) OVER (PARTITION BY seed) AS n FROM x JOIN fit USING (seed, feature) WHERE role = 1),
q AS (SELECT seed, level, s AS q FROM s, levels WHERE k = {_RANK}),
p AS (SELECT seed, level, avg(CAST(c - q <= label AND label <= c + q AS INT)) AS cov FROM x JOIN fit USING (seed, feature) JOIN q USING (seed) WHERE role = 2 GROUP BY seed, level)
SELECT level, count(*) AS r_eff, round(avg(cov), 9) AS mean_cov, round(stddev_samp(cov) / sqrt(count(*)), 9) AS mcse, {_HOLD} FROM p GROUP BY level""")
def isotonic_conformal(spark, sf_dir):
    """Intervals about an isotonic fit of the label on the feature, by split."""
    e = evaluated(spark, sf_dir)
    xs, fit = isotonic(e)

    def curves(x: np.ndarray, s: np.ndarray, level: int):
        c = fit[s][:, np.searchsorted(xs, x)]
        return c, c

    q = select_beyond(e.table, e.seeds, len(LEVELS), curves, (0.0, e.bounds[1] - e.bounds[0]), _needed)
    return hold(marginal(runs(e, Beyond(curves, q))), bool(np.isnan(q).any()))


TAUS = tuple(t for level in LEVELS for t in (1.0 - level, level))  # lower and upper tail of each level


def cqr(e: Evaluation):
    """Intervals of quantile regression on the feature and its square, and which (seed, level) have a fit."""
    n = e.table.agg(F.sum(F.size("x"))).first()[0] or 0
    beta, _ = quantreg.fit(e.table, e.seeds, TAUS, n)
    beta = beta.reshape(e.seeds, len(LEVELS), 2, 3)
    fitted = ~np.isnan(beta).any(axis=(2, 3))

    def curves(x: np.ndarray, s: np.ndarray, level: int):
        return quantreg.line(beta[s, level, 0], x), quantreg.line(beta[s, level, 1], x)

    span = 4 * (e.bounds[1] - e.bounds[0])
    q = select_beyond(e.table, e.seeds, len(LEVELS), curves, (-span, span), lambda n: _needed(n) * fitted)
    return Beyond(curves, q), fitted


def fitted_runs(spark, e: Evaluation) -> tuple[DataFrame, DataFrame]:
    """Runs of the splits whose quantile fits succeeded, and (level, fit_failures)."""
    of, fitted = cqr(e)
    failed = spark.createDataFrame([(int(s), LEVELS[i]) for s, i in np.argwhere(~fitted)], "seed int, level double")
    n = spark.createDataFrame([(x, int((~fitted[:, i]).sum())) for i, x in enumerate(LEVELS)], "level double, fit_failures int")
    return runs(e, of).join(F.broadcast(failed), ["seed", "level"], "left_anti"), n


@query()
def cqr_conformal(spark, sf_dir):
    """Conformalized quantile regression by split; a fit that fails drops its split at that level, and is counted."""
    e = evaluated(spark, sf_dir)
    found, failures = fitted_runs(spark, e)
    return hold(marginal(found)).join(F.broadcast(failures), "level")


@query()
def cqr_decision(spark, sf_dir):
    """The greatest deviation of quantile regression less that of pooled intervals, paired by split."""
    e = evaluated(spark, sf_dir)
    found, _ = fitted_runs(spark, e)
    return paired(found, runs(e, constant(*pooled(e)))).withColumn("prediction", F.lit("P7b"))


CLASSES = ("correct", "error")
SET_METRICS = ("marginal", "coverage_correct", "coverage_error", "set_size", "empty", "singleton", "doubleton")
_METRICS_SQL = {
    "marginal": "avg(CAST(CASE WHEN e = 'correct' THEN ic ELSE ie END AS INT))", "coverage_correct": "avg(CAST(ic AS INT)) FILTER (e = 'correct')", "coverage_error": "avg(CAST(ie AS INT)) FILTER (e = 'error')",
    "set_size": "avg(CAST(ic AS INT) + CAST(ie AS INT))", "empty": "avg(CAST(NOT ic AND NOT ie AS INT))", "singleton": "avg(CAST(ic <> ie AS INT))", "doubleton": "avg(CAST(ic AND ie AS INT))",
}
_ACCESSION_HALVES = f"""cl AS (SELECT accession, feature / 100 AS p, {_STATES} AS e FROM ledger WHERE feature >= 0 AND feature < 100.01 AND label IS NOT NULL AND {_STATES} <> 'U'),
acc AS (SELECT DISTINCT accession FROM cl),
r0 AS (SELECT seed, accession, row_number() OVER (PARTITION BY seed ORDER BY sha256(seed || ':' || accession), accession) - 1 AS i, count(*) OVER (PARTITION BY seed) AS n FROM acc, (SELECT unnest(range({SEEDS})) AS seed)),
x AS (SELECT cl.*, seed, i < greatest(1, CAST(round_even(n * 0.5, 0) AS BIGINT)) AS cal FROM cl JOIN r0 USING (accession)),
levels(level) AS (VALUES (CAST(0.9 AS DOUBLE)), (CAST(0.95 AS DOUBLE))),
s AS (SELECT seed, e, CASE e WHEN 'correct' THEN 1 - p ELSE p END AS s, row_number() OVER (PARTITION BY seed, e ORDER BY CASE e WHEN 'correct' THEN 1 - p ELSE p END) AS k, count(*) OVER (PARTITION BY seed, e) AS n FROM x WHERE cal),
q AS (SELECT seed, level, max(s) FILTER (e = 'correct') AS qc, max(s) FILTER (e = 'error') AS qe FROM s, levels WHERE k = CAST(ceil((n + 1) * level) AS BIGINT) GROUP BY ALL),
t AS (SELECT seed, level, e, 1 - p <= qc AS ic, p <= qe AS ie FROM x JOIN q USING (seed) WHERE NOT cal)"""


def class_chunks(spark, sf_dir: str) -> DataFrame:
    """Chunks of the rows of either class: x the feature as a share, y the class (0 correct, 1 error); half of the accessions are for calibration."""
    d = ledger(spark, sf_dir).where("feature >= 0 and feature < 100.01 and label is not null")
    d = d.withColumn("e", e_state(F.col("label"), F.col("channel_b") * 100)).where("e <> 'U'")
    rows = d.select("accession", (F.col("feature") / 100).alias("x"), (F.col("e") == "error").cast("double").alias("y"), F.lit(0.0).alias("z"), "entry", "chain", "pos")
    return chunks(rows, ["entry", "chain", "pos"], SEEDS, halves)[0]


def class_quantiles(table: DataFrame, seeds: int) -> np.ndarray:
    """The ceil((n + 1) level)-th score by seed, class and level; a class is scored by its distance from certainty. Infinite if the rank exceeds the count."""
    needed = lambda n: np.stack([np.ceil((n + 1) * x) for x in LEVELS], axis=-1).astype(np.int64)
    got, _ = select(table, seeds, of_role(CALIBRATION), lambda c, s: np.where(c.y == 0, 1 - c.x, c.x)[None, :], (0.0, 1.0), of_parts(needed), lambda c: c.y.astype(np.int64), 2)
    return np.where(np.isnan(got[:, :2]), np.inf, got[:, :2])


SHARES = 1000  # distinct x of which the driver holds counts by split, role and class


def class_counts(table: DataFrame, seeds: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct x, and the rows by role (calibration, test), seed, class and x; None where there are more than SHARES."""
    xs = np.sort(np.array([r[0] for r in table.select(F.explode("x").alias("x")).distinct().limit(SHARES + 1).collect()], np.float64))
    if len(xs) > SHARES:
        return None
    line = len(CLASSES) * len(xs)

    def part(chunk: Chunk):
        at, n = np.unique(chunk.y.astype(np.int64) * len(xs) + np.searchsorted(xs, chunk.x), return_counts=True)
        for i, role in enumerate((CALIBRATION, TEST)):
            s = chunk.seeds(role) + i * seeds
            yield (s[:, None] * line + at).ravel(), np.tile(n, len(s))[:, None]

    found = sums(table, 2 * seeds * line, ["n"], part).toPandas()
    out = np.zeros(2 * seeds * line, np.int64)
    out[found["key"].to_numpy()] = found["n"].to_numpy()
    return xs, out.reshape(2, seeds, len(CLASSES), len(xs))


def class_fields(xs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What class_quantiles and class_hits find, from counts: rows of equal x are not told apart by any rank."""
    cal, test = counts
    q = np.full((cal.shape[0], len(CLASSES), len(LEVELS)), np.inf)
    for c, scores in enumerate((1 - xs, xs)):
        order = np.argsort(scores, kind="stable")
        upto = cal[:, c, order].cumsum(axis=1)
        for i, x in enumerate(LEVELS):
            n = cal[:, c].sum(axis=1)
            k = np.ceil((n + 1) * x).astype(np.int64)
            has = (n > 0) & (k <= n)
            q[has, c, i] = scores[order][(upto[has] < k[has, None]).sum(axis=1)]
    fields = np.zeros((cal.shape[0], len(LEVELS), len(SET_FIELDS)))
    n = test.sum(axis=(1, 2))
    for i in range(len(LEVELS)):
        ic, ie = (1 - xs) <= q[:, 0, i, None], xs <= q[:, 1, i, None]
        every = test.sum(axis=1)
        for j, v in enumerate((n, test[:, 0].sum(axis=1), (test[:, 0] * ic).sum(axis=1), (test[:, 1] * ie).sum(axis=1), (every * (ic & ie)).sum(axis=1), (every * (ic ^ ie)).sum(axis=1))):
            fields[:, i, j] = v
    return q, fields


SET_FIELDS = ["n", "correct", "hit_correct", "hit_error", "both", "one"]


def class_hits(table: DataFrame, q: np.ndarray) -> DataFrame:
    """(key, *SET_FIELDS) by seed and level, from the rows."""

    def part(chunk: Chunk):
        s = chunk.seeds(TEST)
        if not len(s):
            return
        error_row = chunk.y == 1
        for i in range(len(LEVELS)):
            ic, ie = (1 - chunk.x) <= q[s, 0, i, None], chunk.x <= q[s, 1, i, None]
            n = np.full(len(s), len(chunk.x))
            fields = [n, n - error_row.sum(), (ic & ~error_row).sum(axis=1), (ie & error_row).sum(axis=1), (ic & ie).sum(axis=1), (ic ^ ie).sum(axis=1)]
            yield s * len(LEVELS) + i, np.stack(fields, axis=1)

    return sums(table, len(q) * len(LEVELS), SET_FIELDS, part)


@query(f"""WITH {LEDGER_SQL}, {_ACCESSION_HALVES},
m AS (SELECT seed, level, {", ".join(f"{v} AS {k}" for k, v in _METRICS_SQL.items())} FROM t GROUP BY ALL),
l AS (UNPIVOT m ON {", ".join(SET_METRICS)} INTO NAME metric VALUE v)
SELECT level, metric, count(*) AS r, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS sd, round(stddev_samp(v) / sqrt(count(*)), 9) AS mcse, round(min(v), 9) AS least, round(max(v), 9) AS greatest FROM l GROUP BY ALL""")
def classwise_sets(spark, sf_dir):
    """Conformal sets by class over halves of the accessions: coverage, set sizes and rates, over 200 splits."""
    table = class_chunks(spark, sf_dir)
    if counts := class_counts(table, SEEDS):
        fields = class_fields(*counts)[1].reshape(SEEDS * len(LEVELS), len(SET_FIELDS))
        rows = [(k, *map(float, v)) for k, v in enumerate(fields.tolist()) if v[0] > 0]
        f = spark.createDataFrame(rows, "key long, " + ", ".join(f"{c} double" for c in SET_FIELDS))
    else:
        f = class_hits(table, class_quantiles(table, SEEDS))
    level = F.element_at(F.array(*map(F.lit, LEVELS)), F.pmod("key", F.lit(len(LEVELS))).cast("int") + 1)
    metrics = {
        "marginal": (F.col("hit_correct") + F.col("hit_error")) / F.col("n"), "coverage_correct": F.expr("try_divide(hit_correct, correct)"), "coverage_error": F.expr("try_divide(hit_error, n - correct)"),
        "set_size": (F.col("one") + 2 * F.col("both")) / F.col("n"), "empty": 1 - (F.col("one") + F.col("both")) / F.col("n"), "singleton": F.col("one") / F.col("n"), "doubleton": F.col("both") / F.col("n"),
    }
    long = f.select(level.alias("level"), F.explode(F.create_map(*[x for k, v in metrics.items() for x in (F.lit(k), v)])).alias("metric", "v"))
    r = lambda c, name: F.round(c, 9).alias(name)
    return long.groupBy("level", "metric").agg(F.count("v").alias("r"), r(F.avg("v"), "mean"), r(F.stddev_samp("v"), "sd"), r(error("v"), "mcse"), r(F.min("v"), "least"), r(F.max("v"), "greatest"))
