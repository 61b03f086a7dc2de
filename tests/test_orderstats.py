import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import orderstats
from ledgerlake.operators.orderstats import average_ranks, digest_order, medians, places, quantiles


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = [(0, float(x)) for x in rng.normal(size=501)] + [(1, float(x)) for x in rng.integers(0, 4, 200)] + [(2, 7.0)] * 5 + [(3, float(x)) for x in rng.pareto(0.5, 300)] + [(4, -1.5), (5, None), (0, None)]
    return spark.createDataFrame(out, "g int, v double"), out


def test_average_ranks(rows):
    df, out = rows
    got = {r.v: r.a for r in average_ranks(df, "v", "a").collect()}
    vs = sorted(v for _, v in out if v is not None)
    assert got == {v: np.mean([i + 1 for i, x in enumerate(vs) if x == v]) for v in set(vs)}


def test_digest_order_and_empty(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("g"), "id")
    got = digest_order(df, ["g"], F.sha2(F.col("id").cast("string"), 256), "id").collect()
    for g in (0, 1):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r._i)
        assert [r._i for r in mine] == list(range(150)) and all(r._n == 150 for r in mine)
    empty = spark.createDataFrame([], "g int, v double")
    assert average_ranks(empty, "v", "a").count() == 0


PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("local, cells", [(1 << 16, 1024), (20, 1024), (3, 2)])
def test_quantiles_of_hot_groups(spark, rows, monkeypatch, local, cells):
    """Whole groups in a task, then large ones narrowed down, at last by halves; a group's values may all be equal, or null, and so may its key."""
    monkeypatch.setattr(orderstats, "CELLS", cells)
    df, out = rows
    out = out + [(None, float(x)) for x in range(100)]
    df = df.unionByName(spark.createDataFrame([r for r in out if r[0] is None], df.schema))
    got = {r.g: r.q for r in quantiles(df, ["g"], "v", PROBS, local=local).collect()}
    for g in {g for g, _ in out}:
        mine = [v for k, v in out if k == g and v is not None]
        if not mine:
            assert got.pop(g) is None
            continue
        assert np.allclose(got.pop(g), np.quantile(mine, PROBS), rtol=1e-12, atol=0)
    assert not got


def test_medians_of_several_columns(spark, rows):
    df, out = rows
    df = df.withColumn("w", -F.col("v"))
    one, many = ({r.g: (r.a, r.b) for r in medians(df, ["g"], {"a": "v", "b": "w"}, local).collect()} for local in (None, 20))
    assert one.keys() == many.keys() and one[5] == many[5] == (None, None)
    assert all(np.allclose(one[g], many[g], rtol=1e-12) and one[g][0] == -one[g][1] for g in one if g != 5)


def test_no_task_holds_a_hot_group(spark, monkeypatch):
    """A group with half of all rows: what meets in a task is at most LOCAL values a rank."""
    rng = np.random.default_rng(5)
    values = spark.createDataFrame([(0 if i % 2 else 1 + i % 40, float(x)) for i, x in enumerate(rng.pareto(0.3, 4000))], "g int, v double")
    held = values.select("g", F.col("v").alias("_v"))
    n = held.where("g = 0").count()
    ends = held.where("g = 0").agg(F.min("_v"), F.max("_v")).first()
    targets = spark.createDataFrame([(0, t, k, *ends, n) for t, k in enumerate((1, n // 2, n))], "g int, t int, k long, low double, high double, n long")
    done = orderstats.narrowed(held, ["g"], targets, 50).collect()
    mine = sorted(r._v for r in held.where("g = 0").collect())
    assert all(r.n <= 50 for r in done)
    for r in done:
        inside = [v for v in mine if r.low <= v <= r.high]
        assert len(inside) == r.n and inside[r.k - 1] == mine[(1, n // 2, n)[r.t] - 1]


def test_quantiles_refuse_what_is_not_finite(spark):
    with pytest.raises(Exception, match="not finite"):
        quantiles(spark.createDataFrame([(1, float("nan"))], "g int, v double"), ["g"], "v", [0.5]).collect()
    assert quantiles(spark.createDataFrame([], "g int, v double"), ["g"], "v", [0.5]).count() == 0


def test_places(spark):
    got = places(spark.range(3000).select((F.col("id") % 7).alias("k"), "id"), F.desc("k"), F.asc("id")).collect()
    assert [r._i for r in sorted(got, key=lambda r: (-r.k, r.id))] == list(range(3000))
