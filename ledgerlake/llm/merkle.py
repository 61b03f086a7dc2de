r"""Merkle manifest of a dataset, by Pregel-style supersteps over RDDs.

Every row is a leaf: the SHA-256 (lowercase hex) of its columns, each as `-` if null and else as byte count, colon, value.
Leaves of one language, in the order of doc_id, are a tree; the roots of these trees, in the order of language (null
first, else bytewise), are the leaves of one more tree, whose root stands for the dataset.

Vertices are keyed by (tree, place). A superstep upwards: every vertex sends its digest to its parent (place // FAN); a
parent that has heard from all its children, whose number follows from the size of the level, hashes them and is a vertex
of the next superstep. What a parent has heard, its run, is stored. Supersteps downwards: a parent sends the path to the
root, as far as it knows it, to its run; each child puts its own siblings before it. The runs of leaves end the descent:
each leaf hashes its siblings (the proof) and folds its digest, or that of a tampered row, with them back to a root.

Messages downwards go to runs, not to children, so a path crosses a shuffle once for FAN leaves. No vertex has more than
FAN messages, whatever the languages' shares. Each level is written to the shared folder before the next begins, so a lost
executor costs one superstep. The driver sees the number of leaves in the largest tree and the root.

Cases: leaves of one doc_id follow their digests (equal rows are alike); null doc_ids come first and are not tampered
with; empty texts differ from null ones; a language with one row has that leaf as its root, a dataset with one language
that language's; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, parts, run_dir, skewed_left, table, written
from .ordered import numbered
from .wordtrie import CRC_TABLE, crc32_sql

FAN, COLUMNS, TAMPERED = 8, ("doc_id", "source", "lang", "n_chars", "text"), 3
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def framed(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


def _joined(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def _stored(rdd: RDD, name: str) -> RDD:
    """Written to the shared folder and read again."""
    sc = rdd.context
    path = f"{run_dir(SparkSession.active())}/{name}-{uuid.uuid4().hex}"
    rdd.saveAsPickleFile(path)
    return sc.pickleFile(path)


def run_of(size: int, parent: int) -> int:
    """How many children a vertex has, on a level of so many."""
    return min(FAN, size - FAN * parent)


def _heard(message):
    """A parent with what its children sent: it is complete when all of them have, and hashes."""
    (tree, parent), sent = message
    size, children = 0, {}
    for place, size, digest, payload in sent:  # noqa: B007
        children[place] = digest, payload
    if len(children) != run_of(size, parent):
        raise ValueError(f"vertex {parent} of tree {tree} heard from {len(children)} of {run_of(size, parent)} children")
    run = [children[p] for p in sorted(children)]
    return (tree, parent), (size, run)


def _forward(vertex):
    (tree, place), (size, run) = vertex
    digest = run[0][0] if size == 1 else _joined([d for d, _ in run])
    return (tree, place), (-(-size // FAN), digest, None)


def climb(leaves: RDD, largest: int, n_parts: int) -> tuple[list[RDD], RDD]:
    """leaves: ((tree, place), (size of the tree, digest, payload)); to the stored runs of each level, lowest first, and the roots.

    A tree of one vertex has its root and sends it on unchanged until the largest tree has one too.
    """
    levels, level = [], leaves
    while True:
        sent = level.map(lambda v: ((v[0][0], v[0][1] // FAN), (v[0][1] % FAN, *v[1])))
        runs = _stored(sent.groupByKey(n_parts).map(_heard), "runs")
        levels.append(runs)
        level = runs.map(_forward)
        largest = -(-largest // FAN)
        if largest == 1:
            return levels, level


def step(size: int, place: int, run: list) -> tuple:
    """What a path gains below a vertex: the child's place, and the digests of its siblings as bytes."""
    return () if size == 1 else ((place, bytes.fromhex("".join(d for i, (d, _) in enumerate(run) if i != place))),)


def _to_children(vertex):
    (tree, parent), ((size, run), (note, path)) = vertex
    for place in range(len(run)):
        yield (tree, parent * FAN + place), (note, step(size, place, run) + path)


def descend(levels: list[RDD], paths: RDD, n_parts: int) -> RDD:
    """paths: ((tree, 0), (note, path above the tree's root)); to ((tree, parent), ((size, run of leaves), (note, path above the run)))."""
    for runs in reversed(levels[1:]):
        paths = _stored(runs.join(paths, n_parts).flatMap(_to_children), "paths")
    return levels[0].join(paths, n_parts)


def fold(digest: str, path: tuple) -> str:
    for place, siblings in path:
        s = siblings.hex()
        digest = _joined([s[: 64 * place], digest, s[64 * place :]])
    return digest


def _into_trees(vertex):
    """The leaves of the upper tree are the roots of the others: their paths go down into these."""
    (_, parent), ((size, run), (_, path)) = vertex
    for place, (subroot, _) in enumerate(run):
        yield (parent * FAN + place, 0), (subroot, step(size, place, run) + path)


def _verified(vertex, root: str):
    _, ((size, run), (subroot, path)) = vertex
    for place, (digest, (doc_id, tampered)) in enumerate(run):
        whole = step(size, place, run) + path
        folded = fold(tampered or digest, whole)
        yield doc_id, digest, subroot, root, _joined([s.hex() for _, s in whole]), folded, folded == root


def leaves(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(tree, place, size, leaf, doc_id, tampered), the number of trees and the size of the largest."""
    columns = [F.col(c) for c in COLUMNS]
    altered = leaf([*columns[:-1], ascii_lower(F.col("text").cast("string"))])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))  # null before all others
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), leaf(columns).alias("leaf"), F.when(chosen, altered).alias("tampered"))
    rows = written(rows.withColumn("nth", F.monotonically_increasing_id()), "leaves")  # nth tells equal rows apart, so that ranges can split them
    rows = written(numbered(rows, F.asc("lang"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("nth")), "numbered")
    trees = rows.groupBy("lang").agg(F.min("position").alias("first"), F.count("*").alias("size"))
    trees = written(numbered(trees, F.asc("lang"), name="tree"), "trees")
    n, largest, width = trees.agg(F.count("*"), F.max("size"), F.sum(F.octet_length("lang") + 64)).first()
    placed = skewed_left(rows, trees, "lang", width or 0).withColumn("place", F.col("position") - F.col("first"))
    return placed.select("tree", "place", "size", "leaf", "doc_id", "tampered"), n, largest


def manifest(docs: DataFrame) -> DataFrame:
    """docs: COLUMNS; to (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each row of docs."""
    spark, n_parts = docs.sparkSession, parts(docs.sparkSession)
    rows, n_trees, largest = leaves(docs)
    if not n_trees:
        return spark.createDataFrame([], RESULT)
    level = rows.rdd.map(lambda r: ((r[0], r[1]), (r[2], r[3], (r[4], r[5]))))
    levels, subroots = climb(level, largest, n_parts)
    uppers, crown = climb(subroots.map(lambda v: ((-1, v[0][0]), (n_trees, v[1][1], None))), n_trees, n_parts)
    root = crown.first()[1][1]
    above = descend(uppers, spark.sparkContext.parallelize([((-1, 0), (None, ()))], 1), n_parts)
    below = descend(levels, above.flatMap(_into_trees), n_parts)
    return spark.createDataFrame(below.flatMap(lambda v: _verified(v, root)), RESULT, verifySchema=False)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """CTEs of a tree's levels: (t, i, n, d), and what stands beside a vertex in its run before and after it."""
    out = [f"{name}0 AS MATERIALIZED ({leaves})"]
    for k in range(levels):
        run = "PARTITION BY t, i // 8 ORDER BY i ROWS BETWEEN"
        out.append(f"{name}s{k} AS MATERIALIZED (SELECT t, i, n, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre, coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS suf FROM {name}{k})")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT t, i // 8 AS i, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}{k} GROUP BY t, i // 8, n)")
    return ",\n".join(out)


def _fold_sql(levels: int, uppers: int) -> str:
    steps, last = [], "SELECT r, lang_rank AS t, i, '' AS proof, start AS f FROM numbered"
    for k in range(levels):
        steps.append(f"f{k} AS (SELECT x.r, x.t, x.i // 8 AS i, proof || pre || suf AS proof, CASE WHEN n = 1 THEN f ELSE sha256(pre || f || suf) END AS f FROM ({last}) x JOIN ts{k} s ON s.t = x.t AND s.i = x.i)")
        last = f"SELECT * FROM f{k}"
    last = f"SELECT r, 0 AS t, t AS i, proof, f FROM f{levels - 1}"
    for k in range(uppers):
        steps.append(f"g{k} AS (SELECT x.r, x.t, x.i // 8 AS i, proof || pre || suf AS proof, CASE WHEN n = 1 THEN f ELSE sha256(pre || f || suf) END AS f FROM ({last}) x JOIN us{k} s ON s.t = x.t AND s.i = x.i)")
        last = f"SELECT * FROM g{k}"
    return ",\n".join(steps)


_LEVELS, _UPPERS = 8, 3  # 16 million documents of a language, 512 languages
_FRAME = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
_HEAD = " || ".join(map(_FRAME, COLUMNS[:-1]))

ORACLE = f"""
WITH crc AS MATERIALIZED ({CRC_TABLE}),
raw AS MATERIALIZED (SELECT doc_id, lang, sha256({_HEAD} || {_FRAME("text")}) AS leaf,
    CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN sha256({_HEAD} || {_FRAME("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS tampered FROM documents, crc),
numbered AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, leaf, coalesce(tampered, leaf) AS start, dense_rank() OVER (ORDER BY coalesce('=' || lang, '')) - 1 AS lang_rank,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM raw),
{_tree_sql("t", "SELECT lang_rank AS t, i, n, leaf AS d FROM numbered", _LEVELS)},
{_tree_sql("u", f"SELECT 0 AS t, t AS i, count(*) OVER () AS n, d FROM t{_LEVELS}", _UPPERS)},
{_fold_sql(_LEVELS, _UPPERS)}
SELECT doc_id, leaf, t.d AS subroot, u.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = u.d AS verified
FROM g{_UPPERS - 1} JOIN numbered USING (r) JOIN t{_LEVELS} t ON t.t = lang_rank, u{_UPPERS} u
"""
