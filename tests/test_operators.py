import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.geometry import M, R, lddt, superpose
from ledgerlake.operators.graph import components
from ledgerlake.streaming.batches import admissions, drain, events, windows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_superposition_undoes_a_rigid_motion_and_matches_numpy(spark):
    rng = np.random.default_rng(0)
    ref = rng.normal(size=(40, 3)) * 10
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    rows = [(0, i, *map(float, r), *map(float, m)) for i, (r, m) in enumerate(zip(ref, ref @ q + [5, -3, 2], strict=True))]
    noisy = ref @ q + rng.normal(size=ref.shape)
    rows += [(1, i, *map(float, r), *map(float, m)) for i, (r, m) in enumerate(zip(ref, noisy, strict=True))]
    mirrored = ref * [1, 1, -1]
    rows += [(2, i, *map(float, r), *map(float, m)) for i, (r, m) in enumerate(zip(ref, mirrored, strict=True))] + [(3, i, *[float(i)] * 6) for i in range(2)]
    p = spark.createDataFrame(rows, "g int, id long, " + ", ".join(f"{c} double" for c in (*R, *M)))
    got = {(r.g, r.id): r.d for r in superpose(p).collect()}

    def best(mob):
        a, b = mob - mob.mean(0), ref - ref.mean(0)
        u, s, vt = np.linalg.svd(a.T @ b)
        rot = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
        return np.sqrt(((a @ rot - b) ** 2).sum(1))

    for g, mob in ((0, ref @ q + [5, -3, 2]), (1, noisy), (2, mirrored)):
        assert np.allclose([got[g, i] for i in range(40)], best(mob), atol=1e-6)
    assert max(got[0, i] for i in range(40)) < 1e-6 and got[2, 0] is not None and got[3, 0] is None


def test_lddt_at_the_edge_of_the_radius_and_alone(spark):
    p = [(0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (0, 1, 15.0, 0.0, 0.0, 15.0, 0.0, 0.0), (0, 2, 14.5, 0.0, 0.0, 13.0, 0.0, 0.0), (0, 3, -90.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    got = {r.id: (r.n_neighbours, r.lddt) for r in lddt(spark.createDataFrame(p, "g int, id long, " + ", ".join(f"{c} double" for c in (*R, *M)))).collect()}
    assert got == {0: (1, 0.5), 1: (1, 0.5), 2: (2, 0.5), 3: (0, None)}  # 15 itself is outside


def test_streams_resume_with_new_files_only(spark, tmp_path):
    rows = lambda a, b: spark.range(a, b, 1, 1).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.expr("timestamp_ntz'2024-01-05 00:00:00' + make_dt_interval(id)").alias("ts"), F.when(F.col("id") < 35, "a").otherwise("b").alias("props"), (F.col("id") / 4).alias("value"))
    src = str(tmp_path / "in")
    for a, b in ((20, 30), (0, 20)):
        rows(a, b).write.mode("append").parquet(src)
    first = {r.user_id: (r.first_event, r.conflict) for r in drain(admissions(events(spark, src, files=1)), str(tmp_path / "a")).collect()}
    assert first == {u: (u, False) for u in range(7)}
    weeks = {r.start: r.n for r in drain(windows(events(spark, src, files=1)), str(tmp_path / "w")).collect()}
    assert sum(weeks.values()) == 30
    rows(30, 40).write.mode("append").parquet(src)
    again = {r.user_id: (r.first_event, r.conflict) for r in drain(admissions(events(spark, src, files=1)), str(tmp_path / "a")).collect()}
    assert again == {u: (u, u in {0, 1, 2, 3, 4}) for u in range(7)}
    weeks2 = {r.start: r.n for r in drain(windows(events(spark, src, files=1)), str(tmp_path / "w")).collect()}
    assert sum(weeks2.values()) == 40
    # windows open on Mondays: 5, 6 and 7 January, and the 8th at midnight sharp, which closes the first
    assert min(weeks) == 1704067200 and weeks[1704067200] == 4
