"""Deep comparison against a recursive one, and points in intervals against all pairs."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import deepdiff
from ledgerlake.operators.deepdiff import deep_diff, tree_rows
from ledgerlake.operators.joins import interval_hits


def kind(v):
    return "null" if v is None else "boolean" if isinstance(v, bool) else {int: "integer", float: "number", str: "string", dict: "object", list: "array"}[type(v)]


def diff_by_hand(a, b, tol, path="$"):
    ka, kb = kind(a), kind(b)
    numbers = {ka, kb} <= {"integer", "number"}
    if ka != kb and not numbers:
        return [(path, "kind")]
    if numbers:
        same = a == b if ka == kb == "integer" else math.isfinite(a) and math.isfinite(b) and abs(a - b) <= tol(path)
        return [] if same else [(path, "value")]
    if ka == "object":
        steps = [(f".{k}", a.get(k, ...), b.get(k, ...)) for k in a.keys() | b.keys()]
    elif ka == "array":
        steps = [(f"[{i}]", a[i] if i < len(a) else ..., b[i] if i < len(b) else ...) for i in range(max(len(a), len(b)))]
    else:
        return [] if a == b else [(path, "value")]
    out = []
    for step, x, y in steps:
        out += [(path + step, "missing_stored")] if x is ... else [(path + step, "missing_recomputed")] if y is ... else diff_by_hand(x, y, tol, path + step)
    return out


def variants(spark, docs):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in docs], "i int, j string").select("i", F.parse_json("j").alias("doc"))


def random_tree(r, depth=0):
    k = r.randrange(9 if depth < 4 else 6)
    plain = [None, True, False, r.randrange(3), r.choice([0.5, 0.5000001, 2.25]), r.choice(["x", "y", ""])]
    if k < 6:
        return plain[k]
    if k == 6:
        return [random_tree(r, depth + 1) for _ in range(r.randrange(4))]
    return {c: random_tree(r, depth + 1) for c in r.sample("abcd", r.randrange(4))}


def changed(r, t):
    if r.random() < 0.15:
        return random_tree(r, 2)
    if isinstance(t, dict):
        return {k: changed(r, v) for k, v in t.items() if r.random() > 0.1}
    return [changed(r, v) for v in t] + [1] * (r.random() < 0.1) if isinstance(t, list) else t


def test_differences_are_those_of_a_recursive_comparison(spark):
    r = random.Random(11)
    pairs = [(i, t := {"a": random_tree(r), "b": [random_tree(r), {"c": random_tree(r)}]}, changed(r, t)) for i in range(60)]
    pairs.append((None, {"a": 1}, {"a": 1.0}))
    pairs.append((99, {"a": None, "b": 10**15 + 1, "c": True}, {"b": 10**15, "c": 1}))
    tol = lambda p: 0.001 if p in ("$.a", "$.b[0]") else 1e-12
    want = sorted(((i, *d) for i, a, b in pairs for d in diff_by_hand(a, b, tol)), key=str)
    got = deep_diff(variants(spark, [(i, a) for i, a, _ in pairs]), variants(spark, [(i, b) for i, _, b in pairs]), ["i"], {"$.a": 0.001, "$.b[*]": 0.001})
    assert sorted((tuple(x) for x in got.collect()), key=str) == want
    assert {(99, "$.a", "missing_recomputed"), (99, "$.b", "value"), (99, "$.c", "kind")} <= set(want)


def test_numbers_that_are_not_finite_never_agree(spark):
    d = spark.createDataFrame([(1, (float("nan"), float("inf"), 1.0))], "i int, s struct<a:double,b:double,c:double>").select("i", F.to_variant_object("s").alias("doc"))
    assert sorted((r.path, r.reason) for r in deep_diff(d, d, ["i"]).collect()) == [("$.a", "value"), ("$.b", "value")]


def test_deep_and_missing_trees(spark, monkeypatch):
    deep = []
    for _ in range(12):
        deep = [deep]
    assert tree_rows(variants(spark, [(1, deep)]), ["i"], "doc").count() == 13
    a = variants(spark, [(1, {"x": 1}), (2, {})])
    assert [tuple(r) for r in deep_diff(a, a.where("i = 2"), ["i"]).collect()] == [(1, "$", "missing_recomputed")]
    monkeypatch.setattr(deepdiff, "DEEPEST", 5)
    with pytest.raises(ValueError, match="5 levels"):
        tree_rows(variants(spark, [(1, deep)]), ["i"], "doc")


def test_points_in_intervals_are_those_of_all_pairs(spark):
    r = random.Random(2)
    segs = [(r.randrange(3), a := r.randrange(-300, 300), a + r.choice([-1, 0, 1, 2, 7, 64, 500])) for _ in range(200)] + [(0, None, 5), (None, 0, 9)] + [(1, -50, 50)] * 40
    points = [(i, r.choice([0, 1, 2, 3, None]), r.randrange(-400, 700)) for i in range(300)] + [(999, 1, None)]
    want = {}
    for i, k, x in points:
        starts = [a for s, a, b in segs if k is not None and s == k and None not in (a, b, x) and a <= x <= b]
        want[i] = (len(starts), min(starts, default=None), max(starts, default=None))
    got = interval_hits(spark.createDataFrame(points, "i int, k int, x long"), spark.createDataFrame(segs, "k int, a long, b long"), ["i"])
    assert {x.i: (x.hits, x.least, x.most) for x in got.collect()} == want


def test_equal_parts_are_not_opened(spark):
    """all nodes of all trees were written, level by level, however few differed."""
    whole = {"same": {"x": [1, {"y": "z"}] * 20}, "other": {"k": [1, 2, {"d": 0.5}]}, "gone": {"p": {"q": 1}}}
    other = {"same": whole["same"], "other": {"k": [1, 2, {"d": 0.75}]}}
    side = lambda d: spark.createDataFrame([(i, json.dumps(whole if i else d)) for i in range(3)], "i int, j string").select("i", F.parse_json("j").alias("doc"))
    rows = deepdiff.differing_rows(side(whole), side(other), ["i"], "doc").collect()
    assert {(r.i, r.side, r.path) for r in rows} == {(0, s, p) for s in "ab" for p in ("$", "$.other", "$.other.k", "$.other.k[2]", "$.other.k[2].d")} | {(0, "a", "$.gone")}
    assert {(r.path, r.reason) for r in deepdiff.deep_diff(side(whole), side(other), ["i"]).collect()} == {("$.other.k[2].d", "value"), ("$.gone", "missing_recomputed")}
