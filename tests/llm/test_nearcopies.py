"""Near copies of the pipeline's stage against exact similarity of five-word shingles."""

import random

import numpy as np

import corpus_pipeline as p
from ledgerlake.llm import nearcopies
from tests.llm.test_brute import docs


def prose(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def jaccard(a, b):
    s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(s & t) / len(s | t)


def copy_of(words, edits, seed):
    """Words changed far apart, five shingles each."""
    r, out = random.Random(seed), list(words)
    step = len(out) // edits
    for k in range(edits):
        out[k * step + r.randrange(5, step - 5)] = f"x{seed}y{k}"
    return " ".join(out)


def test_near_copies_of_all_similarities_over_the_bound_are_found_and_no_others(spark):
    rows, pairs = [], []
    for i in range(60):
        words = prose(i, 300)
        rows.append((2 * i, " ".join(words)))
        rows.append((2 * i + 1, copy_of(words, (1, 2, 3, 4, 5, 6, 8, 10, 12, 14)[i % 10], i)))
        pairs.append(jaccard(rows[-2][1], rows[-1][1]))
    assert sum(0.8 <= j < 0.95 for j in pairs) >= 24 and sum(0.6 < j < 0.8 for j in pairs) >= 12
    kept = {r.doc_id for r in dict(p.STAGES)["SimHash near-dedup"](spark, docs(spark, rows), "").collect()}
    assert kept >= {2 * i for i in range(60)}
    lost = [j for i, j in enumerate(pairs) if j >= 0.8 and 2 * i + 1 in kept]
    assert not lost
    assert all(2 * i + 1 in kept for i, j in enumerate(pairs) if j < 0.8)


def test_large_groups_are_dealt_in_chunks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "CHUNK", 8)
    monkeypatch.setattr(nearcopies, "TEXTS", 5)
    words = prose(7, 200)
    rows = [(i, copy_of(words, 2, i)) for i in range(40)] + [(50, " ".join(words)), (51, None), (52, ""), (53, " \t"), (54, "a b"), (None, "A  b")]
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs(spark, rows)).collect()}
    assert got == dict.fromkeys(range(40), 0) | {50: 0, 51: 51, 52: 51, 53: 51, 54: 54, None: 54}
    assert nearcopies.near_copies(docs(spark, [])).count() == 0


def test_rows_with_repeated_or_null_ids_are_judged_by_their_text(spark):
    one, two, three = (" ".join(prose(s, 60)) for s in (1, 2, 3))
    near = copy_of(prose(2, 60), 1, 2)  # like two, of lesser id than one of its rows
    rows = [(5, one), (5, two), (4, near), (None, three), (None, three), (None, one), (6, "a b"), (6, "a b"), (None, None), (None, "")]
    assert jaccard(two, near) >= 0.8
    got = sorted(((r.doc_id, r.text) for r in dict(p.STAGES)["SimHash near-dedup"](spark, docs(spark, rows), "").collect()), key=str)
    empty = [x for x in got if not x[1]]
    assert sorted((x for x in got if x[1]), key=str) == sorted([(5, one), (4, near), (None, three), (6, "a b")], key=str)
    assert len(empty) == 1


def test_the_stage_on_the_smallest_table_keeps_one_row_of_each_component(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets = {r.doc_id: set(nearcopies.shingles((r.text or "").encode()).tolist()) for r in d.collect()}
    label, changed = {i: i for i in sets}, True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[b] < label[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a], changed = label[b], True
    assert {r.doc_id for r in dict(p.STAGES)["SimHash near-dedup"](spark, d, "").collect()} == set(label.values())


def test_candidates_come_through_the_pivot_table(monkeypatch):
    """the pivot table of operator 8 was left out. It loses no pair within the radius, and it decides what is compared."""
    r = np.random.default_rng(5)
    x, y = (r.integers(0, 1 << 64, 60, np.uint64) for _ in range(2))
    x[30:], y[30:] = x[:30] ^ r.integers(0, 1 << 20, 30, np.uint64), y[:30] ^ r.integers(0, 1 << 20, 30, np.uint64)
    group = np.zeros(60, np.int64)
    far = lambda i, j: int(np.bitwise_count(x[i] ^ x[j])) + int(np.bitwise_count(y[i] ^ y[j]))
    found = lambda radius: {(int(a), int(b)) for i, j in nearcopies._candidates(group, x, y, radius, nearcopies.pivots()) for a, b in zip(i, j)}
    for radius in (8, 32):
        assert found(radius) == {(i, j) for i in range(60) for j in range(i + 1, 60) if far(i, j) <= radius}
    table = nearcopies.distances(x, y, nearcopies.pivots())
    assert all(abs(int(a) - int(b)) <= far(i, j) for i, j in ((0, 30), (1, 2)) for a, b in zip(table[i], table[j]))
    monkeypatch.setattr(nearcopies, "distances", lambda x, y, refs: np.arange(len(x))[:, None] * 1000)
    assert not found(32)
