import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.isotonic import isotonic, isotonic_labels
from ledgerlake.operators.statistics import pava
from ledgerlake.sources.tables import ledger
from tests.oracle import SF

SHAPES = {
    "rising": lambda x, r: x,
    "falling": lambda x, r: -x,
    "level": lambda x, r: np.zeros(len(x)),
    "noisy": lambda x, r: x / 50 + r.integers(-40, 40, len(x)),
    "bent": lambda x, r: np.where(x < 300, -x, x**2) + r.integers(-99, 99, len(x)),
    "steep": lambda x, r: 2 ** (x / 30),
}


def expected(x, n, t):
    o = np.argsort(x)
    return dict(zip(x[o].tolist(), pava(t[o] / n[o], n[o].astype(float), t[o].astype(float)).tolist(), strict=True))


def test_all_shapes_equal_the_serial_fit_whatever_a_task_holds(spark):
    r, rows, want = np.random.default_rng(5), [], {}
    for name, shape in SHAPES.items():
        x = r.permutation(1000)
        n = r.integers(1, 5, 1000)
        t = np.rint(shape(x.astype(float), r) * n).astype(np.int64)
        want[name] = expected(x, n, t)
        rows += [(name, float(a), int(b), int(c)) for a, b, c in zip(x, n, t, strict=True)]
    rows += [(None, 1.0, 1, 5), (None, 2.0, 1, 3), ("none", None, 1, 1), ("none", 1.0, 0, 1)]
    got = {}
    for k, x, f in isotonic(spark.createDataFrame(rows, "k string, x double, n long, t long").repartition(6), "k", 64).collect():
        assert got.setdefault(k, {}).setdefault(x, f) is f  # each point once
    assert got.pop(None) == {1.0: 4.0, 2.0: 4.0} and set(got) == set(want)
    for name in want:
        assert got[name].keys() == want[name].keys()
        assert all(got[name][x] == pytest.approx(want[name][x], rel=1e-12, abs=1e-12) for x in want[name])


def test_no_points(spark):
    assert isotonic(spark.createDataFrame([], "k string, x double, n long, t long"), "k").collect() == []


def test_many_features_of_one_group(spark):
    points = spark.range(300_000).select(F.lit("a").alias("k"), F.col("id").alias("x"), F.lit(1).alias("n"), (F.col("id") + F.pmod(F.hash("id"), F.lit(200_000))).alias("t"))
    rows = isotonic(points, "k", 20_000).toPandas().sort_values("x")
    t = points.orderBy("x").toPandas()["t"].to_numpy(np.float64)
    assert len(rows) == 300_000 and np.allclose(rows["fit"].to_numpy(), pava(t, np.ones(len(t))), rtol=1e-12)


def test_the_query_fits_all_labels(spark):
    rows = ledger(spark, SF).select("accession", "label", "feature").toPandas()
    rows["x"], rows["t"] = np.rint(rows["label"] * 1e7).astype(np.int64), np.rint(rows["feature"] * 50).astype(np.int64)
    got = {(r.side, r.x): r.fit for r in isotonic_labels(spark, SF).collect()}
    want = {}
    for side, part in rows.groupby(rows["accession"] % 2):
        g = part.groupby("x")["t"].agg(["size", "sum"])
        want |= {(side, x): v for x, v in expected(g.index.to_numpy(), g["size"].to_numpy(), g["sum"].to_numpy()).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
