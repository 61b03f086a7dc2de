"""The similarity join against all pairs, on thresholds low and high, and with elements that half of all sets hold."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.setjoin import SALTS, candidates, dealt, postings, similar_sets

SCHEMA = "unit string, elements array<string>"


def drawn(seed: int, n: int, hot: int = 0) -> list[tuple[str, list[str]]]:
    """Sets of 1 to 120 elements, some of them parts of others; some are copies; the first half also hold `hot` common elements."""
    r, out = random.Random(seed), []
    for k in range(n):
        own = {f"e{int(r.paretovariate(0.5)) % 3000}" for _ in range(r.choice([1, 3, 10, 40, 120]))}
        if out and r.random() < 0.5:
            base = r.choice(out)[1]
            own = set(base) if r.random() < 0.2 else own | set(r.sample(sorted(base), r.randint(1, len(base))))
        out.append((f"u{k:04d}", own | ({f"hot{i}" for i in range(hot)} if k < n // 2 else set())))
    return [(u, sorted(s)) for u, s in out]


def brute(rows, least: float, mode: str):
    for (a, x), (b, y) in itertools.combinations(sorted(rows), 2):
        shared = len(set(x) & set(y))
        union = len(x) + len(y) - shared
        if shared and (shared >= least * union if mode == "jaccard" else shared >= least):
            yield a, b, shared, round(shared / union, 9) if mode == "jaccard" else float(shared)


@pytest.mark.parametrize("least,mode,cell", [(0.1, "jaccard", 2000), (0.1, "jaccard", 7), (0.3, "jaccard", 20), (0.8, "jaccard", 20), (1.0, "jaccard", 20), (1, "shared", 15), (12, "shared", 15)])
def test_pairs_are_all_pairs(spark, least, mode, cell):
    rows = drawn(3, 150, hot=4)
    got = sorted(map(tuple, similar_sets(spark.createDataFrame(rows, SCHEMA), least, mode, cell).collect()))
    want = sorted(brute(rows, least, mode))
    assert len(want) > 9 and got == want


def test_sizes_at_the_edge_of_a_bucket(spark):
    """A set and one ten times its size that holds it are just similar enough at 0.1, whatever the power of ten."""
    rows = [(f"{n}", [f"{base}:{i}" for i in range(n)]) for base in (1, 3, 7) for n in (base * 10**k for k in range(4))]
    got = {(a, b) for a, b, *_ in similar_sets(spark.createDataFrame(rows, SCHEMA), 0.1).collect()}
    assert got == {tuple(sorted((str(b * 10**k), str(b * 10 ** (k + 1))))) for b in (1, 3, 7) for k in range(3)}


def test_no_task_holds_a_hot_element(spark):
    """Elements in half of all sets: no cell of the join holds more than a few blocks' worth, and each two postings of the rarest common element meet once (hot4: the others come later in every set, and some are pruned)."""
    cell, n = 50, 2000
    rows = [(f"u{k}", [f"own{k // 2}:{i}" for i in range(6)] + ([f"hot{i}" for i in range(5)] if k % 4 < 2 else [])) for k in range(n)]
    posts = postings(spark.createDataFrame(rows, SCHEMA), 0.1, "jaccard").cache()
    assert posts.where("g like 'hot%'").groupBy("g").count().agg(F.max("count")).first()[0] == n // 2
    short, long = dealt(posts, "jaccard", cell)
    for side in (short, long):
        assert side.groupBy("g", "bucket", "i", "j").count().agg(F.max("count")).first()[0] <= 2 * cell
    met = short.alias("s").join(long.alias("l"), ["g", "bucket", "i", "j"]).where("s.unit < l.unit and g = 'hot4'").groupBy("s.unit", "l.unit").count()
    assert met.agg(F.max("count"), F.count("*")).first() == (1, (n // 2) * (n // 2 - 1) // 2)
    salted = posts.groupBy("g", F.pmod(F.xxhash64("unit"), F.lit(SALTS))).count().agg(F.max("count")).first()[0]
    assert salted <= 4 * n // 2 // SALTS


def test_positions_spare_common_elements(spark):
    """Sets that share only the few commonest elements are no candidates."""
    rows = [(f"u{k}", [f"own{k}:{i}" for i in range(40)] + ["hot0", "hot1"]) for k in range(300)]
    assert candidates(spark.createDataFrame(rows, SCHEMA), 0.1, "jaccard").count() == 0


def test_edges(spark):
    assert similar_sets(spark.createDataFrame([], SCHEMA), 0.1).count() == 0
    rows = [("a", ["x", None, "y"]), ("b", ["x", "y"]), ("c", []), ("d", None), (None, ["x", "y"]), ("e", [None])]
    assert list(map(tuple, similar_sets(spark.createDataFrame(rows, SCHEMA), 1.0).collect())) == [("a", "b", 2, 1.0)]
    extra = spark.createDataFrame([("a", ["x"], 1, 2), ("b", ["x"], 1, 2)], SCHEMA + ", g int, bucket int")
    assert similar_sets(extra, 0.5).columns == ["a", "b", "shared", "score"]
    for least, mode in ((0, "jaccard"), (1.5, "jaccard"), (0, "shared"), (0.5, "other")):
        with pytest.raises(ValueError):
            similar_sets(spark.createDataFrame([], SCHEMA), least, mode)
