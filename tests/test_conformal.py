"""Evaluation over splits: against plain NumPy on the same splits, and what is deferred."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import conformal as c
from ledgerlake.operators import methods, quantreg, resample, splits


def ledger(spark, n_accessions, rows_each, seed=3):
    draw = np.random.default_rng(seed)
    rows = [(f"a{a}", float(x), float(y), 0.0, i) for a in range(n_accessions) for i, (x, y) in enumerate(zip(draw.integers(0, 10_000, rows_each) / 100, np.round(draw.normal(0.7, 0.2, rows_each), 3), strict=True))]
    return spark.createDataFrame(rows, "accession string, x double, y double, z double, i int")


@pytest.fixture(scope="module")
def small(spark):
    rows = ledger(spark, 12, 60)
    e = c.prepared(rows, ["i"], 6)
    role = {(r.seed, r.accession): r.role for r in splits.roles(rows, 6).collect()}
    return e, rows.toPandas(), role


def of(pdf, role, seed, r):
    return pdf[[role[seed, a] == r for a in pdf.accession]]


def order_stat(s, level):
    return np.sort(s)[int(np.ceil((len(s) + 1) * (1.0 - (1.0 - level)))) - 1]


def test_roles_are_half_a_quarter_and_the_rest(small):
    _, pdf, role = small
    for s in range(6):
        assert [sum(role[s, a] == r for a in pdf.accession.unique()) for r in range(3)] == [6, 3, 3]


def test_pooled_intervals_are_those_of_numpy(small, monkeypatch):
    e, pdf, role = small
    for fetched in (splits.FETCHED, 0):  # at once, and by ranges within ranges
        monkeypatch.setattr(splits, "FETCHED", fetched)
        lo, hi = c.pooled(e)
        for s, (i, level) in itertools.product(range(6), enumerate(c.LEVELS)):
            m = np.median(of(pdf, role, s, 0).y)
            q = order_stat(np.abs(of(pdf, role, s, 1).y - m), level)
            assert (lo[s, i], hi[s, i]) == (m - q, m + q)


def test_bins_fall_back_where_rows_are_few(small):
    e, pdf, role = small
    lo, hi, back, (plo, phi) = c.mondrian(e)
    assert np.array_equal(plo, c.pooled(e)[0])
    for s, b in itertools.product(range(6), range(6)):
        tr, ca = (d[c.bin_of(d.x.to_numpy()) == b] for d in (of(pdf, role, s, 0), of(pdf, role, s, 1)))
        assert back[s, b] == (len(tr) < 30 or len(ca) < 30)
        if back[s, b]:
            assert (lo[s, b] == plo[s]).all() and (hi[s, b] == phi[s]).all()
        else:
            m = np.median(tr.y)
            assert hi[s, b, 0] == m + order_stat(np.abs(ca.y - m), 0.9)
    assert back.any() and not back.all()


def test_runs_count_covered_rows(small):
    e, pdf, role = small
    lo, hi = c.pooled(e)
    got = {(r.seed, r.level): r.cov for r in c.marginal(c.runs(e, c.constant(lo, hi))).collect()}
    for s, (i, level) in itertools.product(range(6), enumerate(c.LEVELS)):
        y = of(pdf, role, s, 2).y
        assert got[s, level] == pytest.approx(((lo[s, i] <= y) & (y <= hi[s, i])).mean(), abs=1e-12)


def test_one_split_defers_every_decision(spark):
    e = c.prepared(ledger(spark, 12, 60), ["i"], 1)
    found = c.runs(e, c.constant(*c.pooled(e)))
    assert [r.outcome for r in c.hold(c.marginal(found)).collect()] == [c.DEFERRED] * 2
    assert c.deviating(found).first().outcome == c.DEFERRED
    assert c.paired(found, found).first().outcome == c.DEFERRED


def test_a_rank_beyond_the_calibration_rows_defers_the_evaluation(spark):
    e = c.prepared(ledger(spark, 4, 5), ["i"], 3)  # five calibration rows: rank 6 of 5 at both levels
    lo, hi = c.pooled(e)
    assert c.deferred(e, lo)
    assert [r.outcome for r in c.hold(c.marginal(c.runs(e, c.constant(lo, hi))), c.deferred(e, lo)).collect()] == [c.DEFERRED] * 2
    assert c.deferred(c.Evaluation(e.table, 3, e.bounds, 3), np.zeros(1))  # too few accessions


def bins_of(spark, rows):
    return spark.createDataFrame([(s, 0.9, b, n, int(cov * n), cov, 1.0, 0.0, 0.0) for s, b, n, cov in rows], "seed int, level double, stratum int, n_test long, covered long, cov double, width double, bias double, low_share double")


def test_decisions_about_bins(spark):
    off = [(s, b, 50, 0.6 + 0.001 * s) for s in range(4) for b in (0, 1)]
    near = [(s, b, 50, 0.9 + 0.01 * (-1) ** s) for s in range(4) for b in (2, 3)]
    few = [(s, 4, 29, 0.1) for s in range(4)]
    assert c.deviating(bins_of(spark, off + near + few)).first()[:] == (4, 2, "REPLICATE")
    assert c.deviating(bins_of(spark, near + off[:1] + off[2:3])).first().outcome == "FALSIFY"
    assert c.deviating(bins_of(spark, few)).first().outcome == c.DEFERRED
    assert c.paired(bins_of(spark, near), bins_of(spark, off)).first().outcome == "WIN"
    assert c.paired(bins_of(spark, off), bins_of(spark, near)).first().outcome == "MIRRORED_WIN"
    assert c.paired(bins_of(spark, near), bins_of(spark, near)).first().outcome == "NO_DECISION"


def test_conditional_outcomes_are_taken_out_before_the_eighth_batch(spark):
    d = spark.createDataFrame([("P5-90", "HOLD"), ("P6", "REPLICATE"), ("P7a", "WIN")], "prediction string, outcome string")
    assert [tuple(r) for r in c.scoped(d, 4).collect()] == [("P5-90", "HOLD", c.FIRST_SCOPE)]
    assert c.scoped(d, 8).count() == 3


def loss(x, y, tau, beta):
    r = y - quantreg.design(x) @ beta
    return np.where(r >= 0, tau * r, (tau - 1) * r).sum()


def test_quantile_regression_has_the_least_loss_of_all_fits_through_three_rows():
    draw = np.random.default_rng(0)
    for tau in (0.05, 0.5, 0.9):
        x, y = draw.integers(0, 100, 11).astype(float), np.round(draw.normal(0, 1, 11), 3)
        best = min(loss(x, y, tau, np.linalg.solve(quantreg.design(x[list(t)]), y[list(t)])) for t in itertools.combinations(range(11), 3) if len(set(x[list(t)])) == 3)
        assert loss(x, y, tau, quantreg.solve(x, y, tau)) <= best + 1e-9
    assert quantreg.solve(np.array([1.0, 1.0, 2.0]), np.array([1.0, 2.0, 3.0]), 0.5) is None


def test_fits_on_nested_samples_are_those_on_all_rows(spark, monkeypatch):
    monkeypatch.setattr(quantreg, "START", 100)
    monkeypatch.setattr(quantreg, "STEP", 4)
    rows = ledger(spark, 12, 400)
    e = c.prepared(rows, ["i"], 3)
    beta, passes = quantreg.fit(e.table, 3, methods.TAUS, 4800)
    role, pdf = {(r.seed, r.accession): r.role for r in splits.roles(rows, 3).collect()}, rows.toPandas()
    assert passes.min() >= 3
    for s, (k, tau) in itertools.product(range(3), enumerate(methods.TAUS)):
        tr = of(pdf, role, s, 0)
        x, y = tr.x.to_numpy(), tr.y.to_numpy()
        assert loss(x, y, tau, beta[s, k]) <= loss(x, y, tau, quantreg.solve(x, y, tau)) + 1e-6


def weights_of(table, replicates):
    """(z, y, weights by replicate) of all rows, from their chunks."""
    found = []
    for c in table.toPandas().itertuples():
        chunk = splits.Chunk(c.roles, *(np.asarray(v, float) for v in (c.x, c.y, c.z)))
        found.append((chunk.z, chunk.y, resample.weights(chunk, np.arange(replicates))))
    return np.concatenate([z for z, *_ in found]), np.concatenate([y for _, y, _ in found]), np.hstack([w for *_, w in found])


@pytest.mark.parametrize("rows, draws", [(256, 1 << 24), (7, 20)])
def test_replicates_hold_as_many_rows_as_their_groups(spark, monkeypatch, rows, draws):
    """Draws fall down the tree: over one chunk a group, and over many in several tasks a replicate."""
    monkeypatch.setattr(resample, "ROWS", rows)
    monkeypatch.setattr(resample, "DRAWS", draws)
    monkeypatch.setattr(resample, "REPLICATES", 400)
    z, y, w = weights_of(resample.drawable(resample.groups(spark, "/root/testdata/sf0.001", True), 400), 400)
    for g in (0, 1):
        of = w[:, z % 2 == g]
        assert (of.sum(axis=1) == of.shape[1]).all()  # exactly n rows
        n = of.shape[1]
        assert abs((of == 0).mean() - (1 - 1 / n) ** n) < 0.02 and abs(of.var() - (1 - 1 / n)) < 0.05  # as a multinomial has it
        assert np.abs(of.mean(axis=0) - 1).max() < 0.25
    low, high = resample.bootstrap_median(spark, "/root/testdata/sf0.001").first()[3:]
    d = [np.median(np.repeat(y[z % 2 == 1], a[z % 2 == 1])) - np.median(np.repeat(y[z % 2 == 0], a[z % 2 == 0])) for a in w]
    assert (low, high) == tuple(round(float(v), 6) for v in np.percentile(d, [2.5, 97.5]))


def test_permutations_are_those_of_all_subsets(spark):
    """Eight rows, three of them the first group: each of the 56 subsets is as frequent, and p is that of all of them."""
    y = np.array([3.0, 1, 4, 1, 5, 9, 2, 6])
    lists = lambda *v: [list(map(float, x)) for x in v]
    table = spark.createDataFrame([(b"", *lists(range(4), y[:4], (1, 1, 0, 0))), (b"", *lists(range(4, 8), y[4:], (1, 0, 0, 0)))], "roles binary, x array<double>, y array<double>, z array<double>")
    bound = resample.thresholds(table, 3, 6000)
    u = resample.mixed(np.arange(8)[None, :], resample.key_of(np.arange(6000), resample.PERMUTED)[:, None])
    chosen = u <= bound[:, None]
    assert (chosen.sum(axis=1) == 3).all()
    subsets, n = np.unique(chosen @ (1 << np.arange(8)), return_counts=True)
    assert len(subsets) == 56 and ((n - 6000 / 56) ** 2 / (6000 / 56)).sum() < 100  # chi squared with 55 degrees of freedom
    d = lambda m: abs(y[m].mean() - y[~m].mean())
    obs = d(np.isin(np.arange(8), [0, 1, 4]))
    exact = np.mean([d(np.isin(np.arange(8), c)) >= obs - 1e-9 for c in itertools.combinations(range(8), 3)])
    assert abs(np.mean([d(c) >= obs - 1e-9 for c in chosen]) - exact) < 0.03


def test_draws_are_bijections_and_places(monkeypatch):
    x = np.arange(1 << 16)
    for key in resample.key_of(np.arange(3), 5):
        assert len(np.unique(resample.mixed(x, key))) == len(x) and resample.mixed(x, key).max() <= resample.MASK
        at = resample.drawn(x, key, 1000)
        assert at.min() == 0 and at.max() == 999 and np.bincount(at).std() < 12


def test_large_accessions_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(splits, "CHUNK", 16)
    rows = ledger(spark, 5, 60)
    table, bounds, n = splits.chunks(rows, ["i"], 3)
    assert n == 5 and table.count() >= 15 and table.select(F.explode("y")).count() == 300


def test_role_bytes_are_the_roles_of_ranked_digests(spark):
    rows = spark.createDataFrame([(i * 7,) for i in range(400)], "accession long")
    for share in (splits.quarters, splits.halves):
        want = {(r.seed, r.accession): r.role for r in splits.roles(rows, 5, share).collect()}
        got = {(s, r.accession): x - ord("0") for r in splits.role_bytes(rows, 5, share).collect() for s, x in enumerate(r.roles)}
        assert got == want and len(got) == 2000


def test_the_driver_looks_at_few_counters_at_once(spark, monkeypatch):
    """counters of thousands of replicates came to the driver as a whole."""
    rows = [(b"0" * 40, [0.0] * 5, [float(v) for v in range(k, 400, 80)], [0.0] * 5) for k in range(80)]
    table = spark.createDataFrame(rows, "roles binary, x array<double>, y array<double>, z array<double>")
    asked, whole = [], splits._counts

    def counts(*a):
        for block, n in whole(*a):
            asked.append(n.size)
            yield block, n

    monkeypatch.setattr(splits, "_counts", counts)
    monkeypatch.setattr(splits, "LOOKED", 5000)
    monkeypatch.setattr(splits, "FETCHED", 40)
    got, n = splits.select(table, 40, splits.of_role(0), lambda c, s: c.y[None, :] + 0 * s[:, None], (0.0, 399.0), lambda n: (n > 0)[..., None] * np.array([1, 200, 400]), lambda c: (c.y % 2).astype(int), 2)
    assert (n == [200, 200, 400]).all() and max(asked) <= 5000 and len(asked) > 2
    assert (got[:, 2] == [0, 199, 399]).all() and (got[:, 0, :2] == [0, 398]).all() and np.isnan(got[:, 0, 2]).all()


def copied(spark, n_accessions, each, copies):
    """Few values, held by many accessions."""
    draw = np.random.default_rng(5)
    rows = [(f"a{a}", float(x), float(y), float(e), a * 1000 + i) for a in range(n_accessions) for i, (x, y, e) in enumerate(zip(draw.integers(1, 6, each) * 10, np.repeat(np.round(draw.normal(0.7, 0.2, each // copies), 2), copies), draw.integers(0, 2, each), strict=True))]
    return spark.createDataFrame(rows, "accession string, x double, y double, z double, i int")


def test_equal_rows_are_sampled_on_their_own():
    chunk = splits.Chunk(b"012", np.full(4000, 2.0), np.full(4000, 0.5), np.zeros(4000))
    assert 700 < len(splits.sampled(chunk, 0.2).x) < 900
    assert splits.sampled(chunk, 1.0) is chunk


@pytest.mark.parametrize(("sample", "fetched", "few"), [(1_000_000, 1_000_000, 16), (400, 0, 16), (400, 1_000_000, 16), (400, 0, 10**9)])
def test_ranks_beyond_curves_are_those_of_numpy(spark, monkeypatch, sample, fetched, few):
    for name, v in (("SAMPLE", sample), ("FETCHED", fetched), ("FEW", few)):
        monkeypatch.setattr(splits, name, v)
    rows = copied(spark, 12, 300, 5)
    e = c.prepared(rows, ["i"], 4)
    role = {(r.seed, r.accession): r.role for r in splits.roles(rows, 4).collect()}
    pdf, shift = rows.toPandas(), np.arange(4) * 0.01

    def curves(x, s, level):
        lo = 0.5 + shift[s, None] + x[None, :] / 1000 * (level + 1)
        return lo, lo + 0.05

    q = splits.select_beyond(e.table, 4, 2, curves, (-2.0, 2.0), c._needed)
    found = {(r.seed, r.level): (r.n, r.covered) for r in c.runs(e, c.Beyond(curves, q)).groupBy("seed", "level").agg(F.sum("n_test").alias("n"), F.sum("covered").alias("covered")).collect()}
    for s, (i, level) in itertools.product(range(4), enumerate(c.LEVELS)):
        cal, test = of(pdf, role, s, 1), of(pdf, role, s, 2)
        lo, hi = (v[0] for v in curves(cal.x.to_numpy(), np.array([s]), i))
        assert q[s, i] == order_stat(np.maximum(lo - cal.y.to_numpy(), cal.y.to_numpy() - hi), level)
        lo, hi = (v[0] for v in curves(test.x.to_numpy(), np.array([s]), i))
        assert found[s, level] == (len(test), ((lo - q[s, i] <= test.y) & (test.y <= hi + q[s, i])).sum())


def test_classes_of_few_shares_are_counted_and_not_fetched(spark, monkeypatch):
    rows = copied(spark, 9, 200, 5).withColumn("x", F.col("x") / 100).withColumn("y", F.col("z"))
    table = splits.chunks(rows, ["i"], 5, splits.halves)[0]
    q, fields = methods.class_fields(*methods.class_counts(table, 5))
    assert np.array_equal(q, methods.class_quantiles(table, 5))
    hits = {r.key: tuple(r)[1:] for r in methods.class_hits(table, q).collect()}
    assert hits == {k: tuple(v) for k, v in enumerate(fields.reshape(10, -1).tolist())}
    monkeypatch.setattr(methods, "SHARES", 4)
    assert methods.class_counts(table, 5) is None
