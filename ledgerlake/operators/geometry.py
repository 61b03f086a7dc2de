"""Superposition and local distance scores of point sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.plans.registry import query
from ledgerlake.sources.tables import load

#: Inclusion radius and the tolerances of the local distance score.
RADIUS, TOLERANCES = 15.0, (0.5, 1.0, 2.0, 4.0)
R, M = ("rx", "ry", "rz"), ("mx", "my", "mz")


def points(spark, sf_dir) -> DataFrame:
    """(g, id, reference rx ry rz, mobile mx my mz) from the vectors: three components, and the same displaced by three others."""
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    d = load(spark, sf_dir, "embeddings").where(F.size("embedding") >= 6)
    return d.select(F.col("label").alias("g"), F.col("vec_id").alias("id"), *[(v(i) * 20).alias(R[i]) for i in range(3)], *[(v(i) * 20 + v(i + 3) * 4).alias(M[i]) for i in range(3)])


def lddt(p: DataFrame) -> DataFrame:
    """(g, id, n_neighbours, lddt): share of reference distances under RADIUS that the mobile set keeps, averaged over the tolerances; null without neighbours.

    Neighbours meet through a grid of cells as wide as the radius: each point is sent to 27 cells, so that the join is
    by equality and its pairs are those of adjacent cells, not of the whole group.
    """
    cell = [F.floor(F.col(c) / RADIUS) for c in R]
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    a = p.withColumns({f"c{i}": c for i, c in enumerate(cell)})
    b = p.select(F.col("g"), *[F.col(c).alias(f"{c}_") for c in ("id", *R, *M)], *[c.alias(f"k{i}") for i, c in enumerate(cell)])
    for i in range(3):
        b = b.withColumn("o", F.explode(near)).withColumn(f"c{i}", F.col(f"k{i}") + F.col("o")).drop("o", f"k{i}")
    square = lambda cs: sum(((F.col(c) - F.col(f"{c}_")) * (F.col(c) - F.col(f"{c}_")) for c in cs[1:]), (F.col(cs[0]) - F.col(f"{cs[0]}_")) * (F.col(cs[0]) - F.col(f"{cs[0]}_")))
    pairs = a.join(b, ["g", "c0", "c1", "c2"]).where((F.col("id") != F.col("id_")) & (square(R) < RADIUS * RADIUS))
    off = F.abs(F.sqrt(square(R)) - F.sqrt(square(M)))
    kept = pairs.groupBy("g", "id").agg(F.count("*").alias("n"), *[F.count_if(off < t).alias(f"t{i}") for i, t in enumerate(TOLERANCES)])
    hits = F.col("t0") + F.col("t1") + F.col("t2") + F.col("t3")
    return p.select("g", "id").join(kept, ["g", "id"], "left").select("g", "id", F.coalesce("n", F.lit(0)).alias("n_neighbours"), (hits / (F.col("n") * len(TOLERANCES))).alias("lddt"))


_POINTS = "p AS (SELECT label AS g, vec_id AS id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * 20 AS {R[i]}, CAST(embedding[{i + 1}] AS DOUBLE) * 20 + CAST(embedding[{i + 4}] AS DOUBLE) * 4 AS {M[i]}" for i in range(3)) + " FROM embeddings WHERE len(embedding) >= 6)"
_SQUARE = lambda cs: " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in cs)


@query(f"""WITH {_POINTS}, q AS (SELECT a.g, a.id, abs(sqrt({_SQUARE(R)}) - sqrt({_SQUARE(M)})) AS o FROM p a JOIN p b ON a.g = b.g AND a.id <> b.id AND {_SQUARE(R)} < {RADIUS * RADIUS}),
k AS (SELECT g, id, count(*) AS n, {" + ".join(f"count(*) FILTER (o < {t})" for t in TOLERANCES)} AS h FROM q GROUP BY g, id)
SELECT g, id, coalesce(n, 0) AS n_neighbours, round(h / CAST(n * {len(TOLERANCES)} AS DOUBLE), 9) AS lddt FROM p LEFT JOIN k USING (g, id)""")
def local_distance_score(spark, sf_dir):
    """Local distance difference score by point."""
    return lddt(points(spark, sf_dir)).withColumn("lddt", F.round("lddt", 9))


def superpose(p: DataFrame) -> DataFrame:
    """(g, id, d): distance of each mobile point from its reference after the best proper rotation; null for groups of under three points.

    A group's rotation depends on 16 sums, which are partial aggregates; only these reach Python, and the distances
    are expressions again. One group may thus be of any size.
    """
    sums = {"n": F.count("*")} | {c: F.avg(c) for c in (*R, *M)} | {f"{m}{r}": F.avg(F.col(m) * F.col(r)) for m in M for r in R}
    g = p.groupBy("g").agg(*[c.alias(f"s_{k}") for k, c in sums.items()])

    def rotations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cov = pdf[[f"s_{m}{r}" for m in M for r in R]].to_numpy().reshape(-1, 3, 3)
            cm, cr = pdf[[f"s_{c}" for c in M]].to_numpy(), pdf[[f"s_{c}" for c in R]].to_numpy()
            u, _, vt = np.linalg.svd(cov - cm[:, :, None] * cr[:, None, :])
            sign = np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)
            vt[:, 2] *= sign[:, None]
            rot = u @ vt  # row vectors: mobile @ rot
            yield pd.DataFrame({"g": pdf["g"], "n": pdf["s_n"], "rot": list(rot.reshape(-1, 9)), "shift": list(cr - np.einsum("ni,nij->nj", cm, rot))})

    fit = g.mapInPandas(rotations, f"g {p.schema['g'].dataType.simpleString()}, n long, rot array<double>, shift array<double>")
    moved = lambda j: sum((F.col(M[i]) * F.col("rot")[3 * i + j] for i in range(3)), F.col("shift")[j])
    d = F.sqrt(sum(((moved(j) - F.col(R[j])) * (moved(j) - F.col(R[j])) for j in range(3)), F.lit(0.0)))
    return p.join(fit, "g").select("g", "id", F.when(F.col("n") >= 3, d).alias("d"))


@query()
def superposed_distance(spark, sf_dir):
    """G1: distances after superposition, by group."""
    return superpose(points(spark, sf_dir)).withColumn("d", F.round("d", 6))
