"""Support floors: proteins resolve to a cell, groups to that of all their members, folds and cohorts have named checks, a verdict follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.orderstats import digest_order
from ledgerlake.plans.registry import query
from ledgerlake.sources.tables import load

#: Least identities of a protein or group, least proteins and groups of a cohort, groups a fold, residues of a cell; folds, cells, verdicts.
LEAST_IDS, COHORT, PER_FOLD, CELL_RESIDUES, FOLDS = 10, 20, 4, 200, 5
CELLS = ("OC", "A", "B", "O")
PASS, UNDERPOWERED, INFEASIBLE = "E420_H1_SUPPORT_PASS", "E420_UNDERPOWERED_POOL", "E420_INFEASIBLE_CURRENT_POOL"
_CELL = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'A' WHEN 'BUILDING' THEN 'B' WHEN 'FURNITURE' THEN 'O' WHEN 'MACHINERY' THEN 'OC' ELSE 'U' END"


def pool(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Label rows (protein, num, cell) and members (protein, grp), of orders and customers; some proteins show a second cell."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("protein"), F.expr(_CELL).alias("cell"), F.concat("c_mktsegment", F.pmod("c_custkey", F.lit(300)).cast("string")).alias("grp"))
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("protein"), F.col("o_orderkey").alias("num"), "o_orderstatus")
    cell = F.when((F.col("protein") % 9 == 0) & (F.col("o_orderstatus") == "P"), "B").otherwise(F.col("cell"))
    return o.join(c, "protein").select("protein", "num", cell.alias("cell")), c.select("protein", "grp")


def resolved(rows: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proteins (protein, grp, status, cell, ids) and groups (grp, cell or null, ids): counts of distinct identities, partial before the shuffle."""
    ids = rows.where("cell <> 'U'").select("protein", "cell", "num").distinct().groupBy("protein", "cell").agg(F.count("*").alias("ids"))
    p = ids.groupBy("protein").agg(F.count("*").alias("cells"), F.min("cell").alias("cell"), F.sum("ids").alias("ids"))
    status = F.when(F.col("cells") > 1, "protein_ambiguous").when(F.col("ids") >= LEAST_IDS, "resolved").otherwise("unresolved")
    p = members.join(p, "protein", "left").withColumn("status", F.coalesce(status, F.lit("unresolved"))).withColumn("cell", F.when(F.col("status") == "resolved", F.col("cell")))
    p = p.select("protein", "grp", "status", "cell", F.coalesce("ids", F.lit(0)).alias("ids"))
    g = p.groupBy("grp").agg((F.count("cell") == F.count("*")).alias("whole"), F.min("cell").alias("lo"), F.max("cell").alias("hi"), F.sum("ids").alias("ids"))
    one = F.col("whole") & (F.col("lo") == F.col("hi")) & (F.col("ids") >= LEAST_IDS)
    return p, g.select("grp", F.when(one, F.col("lo")).alias("cell"), "ids")


_SQL = f"""c AS (SELECT c_custkey AS protein, {_CELL} AS cell, c_mktsegment || (c_custkey % 300) AS grp FROM customer),
r AS (SELECT protein, o_orderkey AS num, CASE WHEN protein % 9 = 0 AND o_orderstatus = 'P' THEN 'B' ELSE cell END AS cell FROM orders JOIN c ON protein = o_custkey),
i AS (SELECT protein, cell, count(DISTINCT num) AS ids FROM r WHERE cell <> 'U' GROUP BY ALL),
q AS (SELECT protein, count(*) AS cells, min(cell) AS cell, CAST(sum(ids) AS BIGINT) AS ids FROM i GROUP BY protein),
p AS (SELECT c.protein, grp, CASE WHEN cells > 1 THEN 'protein_ambiguous' WHEN ids >= {LEAST_IDS} THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN cells = 1 AND ids >= {LEAST_IDS} THEN q.cell END AS cell, coalesce(ids, 0) AS ids FROM c LEFT JOIN q USING (protein)),
g AS (SELECT grp, CASE WHEN count(cell) = count(*) AND min(cell) = max(cell) AND sum(ids) >= {LEAST_IDS} THEN min(cell) END AS cell, CAST(sum(ids) AS BIGINT) AS ids FROM p GROUP BY grp)"""


@query(f"WITH {_SQL} SELECT grp, coalesce(cell, 'group_unresolved') AS resolved, ids FROM g")
def support_floors(spark, sf_dir):
    """A protein has a cell if it shows that one alone with ten identities, a group if all of its members have the same."""
    return resolved(*pool(spark, sf_dir))[1].select("grp", F.coalesce("cell", F.lit("group_unresolved")).alias("resolved"), "ids")


@query(f"WITH {_SQL} SELECT status, coalesce(cell, 'none') AS cell, count(*) AS n, CAST(sum(ids) AS BIGINT) AS ids FROM p GROUP BY ALL")
def protein_resolution(spark, sf_dir):
    """How proteins resolve, by cell."""
    return resolved(*pool(spark, sf_dir))[0].groupBy("status", F.coalesce("cell", F.lit("none")).alias("cell")).agg(F.count("*").alias("n"), F.sum("ids").alias("ids"))


_COHORT_SQL = " UNION ALL ".join(
    [f"SELECT 'cohort_{what}_{c}' AS name, (SELECT count(*) FROM {t} WHERE cell = '{c}') >= {COHORT} AS ok" for what, t in (("proteins", "p"), ("groups", "g")) for c in ("A", "B")]
    + ["SELECT 'per_fold_ab_support', (SELECT bool_and(a >= 4 AND b >= 4) FROM f)"]
    + [f"SELECT '{c.lower()}_presence', (SELECT count(*) FROM p WHERE cell = '{c}') >= 1 AND (SELECT count(*) FROM g WHERE cell = '{c}') >= 1" for c in ("OC", "O")]
    + [f"SELECT 'cell_residue_floor_{c}', coalesce((SELECT sum(ids) FROM p WHERE cell = '{c}'), 0) >= {CELL_RESIDUES}" for c in ("A", "B", "OC", "O")]
)


@query(f"""WITH {_SQL}, k AS (SELECT grp, cell, (row_number() OVER (PARTITION BY cell ORDER BY sha256(grp), grp) - 1) % {FOLDS} AS fold FROM g WHERE cell IN ('A', 'B')),
f AS (SELECT x.fold, count(*) FILTER (cell = 'A') AS a, count(*) FILTER (cell = 'B') AS b FROM (SELECT unnest(range({FOLDS})) AS fold) x LEFT JOIN k USING (fold) GROUP BY x.fold),
n AS ({_COHORT_SQL})
SELECT name, ok, NULL AS verdict FROM n UNION ALL SELECT 'satisfied', bool_and(ok), CASE WHEN bool_and(ok) THEN '{PASS}' ELSE '{INFEASIBLE}' END FROM n""")
def floor_checks(spark, sf_dir):
    """The eleven named checks of a pool, and the verdict they allow."""
    p, g = resolved(*pool(spark, sf_dir))
    count = lambda df, what: df.agg(*[F.count_if(F.col("cell") == c).alias(f"{what}_{c}") for c in CELLS], *([F.coalesce(F.sum(F.when(F.col("cell") == c, F.col("ids"))), F.lit(0)).alias(f"ids_{c}") for c in CELLS] if what == "p" else []))
    ranked = digest_order(g.where("cell in ('A', 'B')").select("grp", "cell"), ["cell"], F.sha2("grp", 256), "grp")
    frame = spark.range(FOLDS).withColumnRenamed("id", "fold")
    folds = frame.join(ranked.select((F.col("_i") % FOLDS).alias("fold"), "cell"), "fold", "left").groupBy("fold").agg(F.count_if(F.col("cell") == "A").alias("a"), F.count_if(F.col("cell") == "B").alias("b"))
    row = count(p, "p").join(count(g, "g")).join(folds.agg(F.bool_and((F.col("a") >= PER_FOLD) & (F.col("b") >= PER_FOLD)).alias("folds")))  # one row each
    checks = {f"cohort_{what}_{c}": F.col(f"{k}_{c}") >= COHORT for what, k in (("proteins", "p"), ("groups", "g")) for c in ("A", "B")}
    checks |= {"per_fold_ab_support": F.col("folds")} | {f"{c.lower()}_presence": (F.col(f"p_{c}") >= 1) & (F.col(f"g_{c}") >= 1) for c in ("OC", "O")}
    checks |= {f"cell_residue_floor_{c}": F.col(f"ids_{c}") >= CELL_RESIDUES for c in ("A", "B", "OC", "O")}
    long = row.select(F.explode(F.create_map(*[x for k, v in checks.items() for x in (F.lit(k), v)])).alias("name", "ok"))
    return long.withColumn("verdict", F.lit(None).cast("string")).unionByName(verdict(long))


def verdict(checks: DataFrame, cap_bound: bool = False) -> DataFrame:
    """One row; a shortage that the cap made is told apart from one that the pool has."""
    ok = F.bool_and("ok")
    return checks.agg(F.lit("satisfied").alias("name"), ok.alias("ok"), F.when(ok, PASS).otherwise(UNDERPOWERED if cap_bound else INFEASIBLE).alias("verdict"))
