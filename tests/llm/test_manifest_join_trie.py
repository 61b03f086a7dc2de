"""Operators 11 to 13 against brute force, with the cases they define."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import common, merkle, ngramjoin, wordtrie
from tests.llm.test_brute import SCHEMA, docs, prose
from tests.llm.test_edges import clashing


def leaf_by_hand(row):
    def part(v):
        raw = None if v is None else str(v).encode()
        return b"-" if raw is None else str(len(raw)).encode() + b":" + raw

    i, text, lang, source, n = row
    return hashlib.sha256(b"".join(map(part, (i, source, lang, n, text)))).hexdigest()


def tree_by_hand(digests):
    """The root, and for each leaf its path as (place, siblings)."""
    paths, members = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        up, up_members = [], []
        for a in range(0, len(digests), 8):
            run = digests[a : a + 8]
            for p in range(len(run)):
                for m in members[a + p]:
                    paths[m].append((p, run[:p] + run[p + 1 :]))
            up.append(hashlib.sha256("".join(run).encode()).hexdigest())
            up_members.append([m for x in members[a : a + 8] for m in x])
        digests, members = up, up_members
    return digests[0], paths


def manifest_by_hand(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_by_hand(r)))
        trees[lang] = mine, *tree_by_hand([leaf_by_hand(r) for r in mine])
    root, above = tree_by_hand([trees[lang][1] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        mine, subroot, paths = trees[lang]
        for r, path in zip(mine, paths, strict=True):
            whole, digest = path + above[k], leaf_by_hand(r)
            folded = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                folded = leaf_by_hand((r[0], None if r[1] is None else r[1].translate(lower), *r[2:]))
            for p, siblings in whole:
                folded = hashlib.sha256("".join([*siblings[:p], folded, *siblings[p:]]).encode()).hexdigest()
            proof = hashlib.sha256("".join(s for _, siblings in whole for s in siblings).encode()).hexdigest()
            out.append((r[0], digest, subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def manifest_rows():
    r = random.Random(4)
    rows = [(i, f"Text {i} É", r.choice(["en", "fr", "de"]), "x", i) for i in range(150)]
    rows += [(200, "Lone", "zz", None, None), (201, None, None, "x", 0), (202, "", None, "x", 0), (None, "None", "en", "x", 1), (7, "again", "en", "x", 1), (7, "again", "en", "x", 1), (203, "x" * 100_000 + "Y", "en", "x", 1)]
    rows += [(1000 + i, "T", f"l{i}", "x", 1) for i in range(70)]  # more languages than a run holds
    return rows


def test_manifest_is_that_of_brute_force(spark):
    rows = manifest_rows()
    got = merkle.manifest(clashing(spark.createDataFrame(rows, SCHEMA)))
    assert sorted((tuple(x) for x in got.collect()), key=str) == manifest_by_hand(rows)
    assert not all(x.verified for x in got.collect()) and any(x.verified for x in got.collect())


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_manifest_of_one_language(spark, n):
    rows = [(i, f"T{i}", "en", "x", 1) for i in range(n)]
    assert sorted((tuple(x) for x in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == manifest_by_hand(rows)


def test_an_incomplete_vertex_is_refused():
    with pytest.raises(ValueError, match="heard from 2 of 3"):
        merkle._heard(((0, 1), [(0, 11, "a", None), (1, 11, "b", None)]))


def test_empty_tables(spark):
    none = clashing(docs(spark, [(1, "a")])).limit(0)
    assert merkle.manifest(none).count() == 0
    assert ngramjoin.ngram_join(none).count() == 0
    assert wordtrie.resample(none, docs(spark, [(1, "a b")])).count() == 0


def join_by_hand(rows, size=5, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                x, y = sets[a], sets[b]
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    least = {k: min((i for (i, _), x in zip(rows, label, strict=True) if x == k and i is not None), default=None) for k in set(label)}
    return sorted(((i, len(s), least[k] if s else i) for (i, _), s, k in zip(rows, sets, label, strict=True)), key=str)


def near_rows():
    r = random.Random(8)
    base = [prose(k, 90).split() for k in range(4)]
    rows = []
    for i in range(90):
        w = list(base[i % 4])
        for _ in range(i % 5):
            w[r.randrange(len(w))] = f"changed{r.randrange(50)}"
        rows.append((i, " ".join(w)))
    passage = prose(50, 30)
    rows += [(200 + i, passage + " " + prose(60 + i, 20 + 4 * i)) for i in range(12)]  # share a passage, alike or not
    return rows + [(300, None), (301, ""), (302, " \t"), (303, "a b"), (304, "A  B"), (305, "a b c"), (3, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (None, "null only here"), (306, "x " * 3000)]


def test_join_is_that_of_all_pairs(spark):
    rows = near_rows()
    got = ngramjoin.ngram_join(clashing(docs(spark, rows)))
    assert sorted((tuple(x) for x in got.collect()), key=str) == join_by_hand(rows)


def test_join_in_chunks_and_without_broadcasts(spark, monkeypatch):
    rows = near_rows()
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common.sized, "__defaults__", (-1,))
    monkeypatch.setattr(common.skewed_left, "__defaults__", (2,))
    monkeypatch.setattr(ngramjoin, "GRAMS", 64)
    monkeypatch.setattr(ngramjoin, "FLUSH", 500)
    got = ngramjoin.ngram_join(docs(spark, rows), chunk=5)
    assert sorted((tuple(x) for x in got.collect()), key=str) == join_by_hand(rows)


@pytest.mark.parametrize("percent", [50, 90])
def test_join_at_other_thresholds(spark, percent):
    rows = near_rows()
    assert sorted((tuple(x) for x in ngramjoin.ngram_join(docs(spark, rows), percent=percent).collect()), key=str) == join_by_hand(rows, percent=percent)


def test_first_ones_hold_what_similar_sets_share():
    r = np.random.default_rng(1)
    for _ in range(400):
        n = int(r.integers(1, 120))
        both = r.integers(0, 1 << 60, n).astype(np.uint64)
        lost = int(r.integers(0, n // 9 + 1))
        a, b = np.unique(both), np.unique(np.concatenate([both[lost:], r.integers(0, 1 << 60, lost).astype(np.uint64)]))
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            common_first = np.intersect1d(a[: ngramjoin.first_ones(len(a))], b[: ngramjoin.first_ones(len(b))])
            assert len(common_first) >= min(ngramjoin.slack(len(a)), ngramjoin.slack(len(b)))


def trie_by_hand(rows, target, order, percent=10, least=20, buckets=10_000):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(t):
        w = word.findall((t or "").translate(lower))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(w) - k + 1)]

    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for b in features(t)[1]:
                out[b] += 1
        return out

    s, t = counts([x for _, x in rows]), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text in rows:
        n, f = features(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((x for x in out if x[0] >= least), key=lambda x: (-x[4], x[1] is None, x[1] or 0, x[2]))
    for k, x in enumerate(fit[: percent * len(fit) // 100]):
        x[5] = k + 1
    return sorted((tuple(x[1:]) for x in out), key=str)


def trie_rows():
    rows = [(i, prose(i, 15 + i % 30) + " É2 Ünï_x") for i in range(80)]
    return rows + [(100, None), (101, ""), (102, "— ;"), (None, prose(3, 25)), (5, rows[5][1]), (5, rows[5][1]), (5, prose(9, 40)), (103, "Mixed CASE 12ab " * 30)]


@pytest.mark.parametrize("order", [1, 3])
def test_resample_is_that_of_brute_force(spark, monkeypatch, order):
    rows, target = trie_rows(), [prose(500, 60), None, "Mixed case"]
    want = trie_by_hand(rows, target, order, percent=40)
    for nodes, piece in ((200_000, 1 << 20), (50, 40)):  # tries begun anew, texts in slices
        monkeypatch.setattr(wordtrie, "NODES", nodes)
        monkeypatch.setattr(wordtrie, "SLICE", piece)
        got = wordtrie.resample(clashing(docs(spark, rows)), clashing(docs(spark, [(1, t) for t in target])), percent=40, order=order)
        assert sorted((tuple(x) for x in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == want


def test_slices_and_begun_tries_give_the_same_counts(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(4000)).encode()
    whole = wordtrie.Trie(3, 1000)
    for _, nodes in whole.walk(text):
        whole.count(nodes)
    want = whole.totals().copy()
    monkeypatch.setattr(wordtrie, "NODES", 30)
    monkeypatch.setattr(wordtrie, "SLICE", 100)
    parts = wordtrie.Trie(3, 1000)
    for _, nodes in parts.walk(text):
        parts.count(nodes)
    assert (parts.totals() == want).all() and want.sum() == 4000 + 3999 + 3998


def test_a_target_without_words_and_all_rows_tied(spark):
    rows = [(i, "same words " * 12) for i in range(20)]
    got = wordtrie.resample(docs(spark, rows), docs(spark, [(1, None)])).collect()
    assert sorted(x.rank for x in got if x.rank) == [1, 2] and len({x.weight for x in got}) == 1


def test_places_cover_ties_and_hot_values(spark):
    from ledgerlake.llm.ordered import numbered

    got = numbered(spark.range(5000).select((F.col("id") % 3).alias("k")), F.asc("k")).collect()
    assert sorted(x.position for x in got) == list(range(5000))
    assert [x.k for x in sorted(got, key=lambda x: x.position)] == sorted(x.k for x in got)


def test_shared_first_shingles_travel_as_a_row_a_bucket():
    """What a fragment tells of its classes was a row a class; it is one for each bucket of them, and sums to the same."""
    import numpy as np
    import pyarrow as pa

    from ledgerlake.llm import ngramjoin as j

    r, told, want = np.random.default_rng(3), [], {}
    for _ in range(5):
        grams, owners = r.integers(0, 200, 900).astype(np.uint64), r.integers(-50, 50, 900)
        pairs = sorted(set(zip(grams.tolist(), owners.tolist())))
        for g, o in pairs:
            if sum(x == g for x, _ in pairs) > 1:
                want[o] = want.get(o, 0) + 1
        told.append(j._shared(pa.table({"grams": [grams.tobytes()], "owners": [owners.astype(np.int64).tobytes()]}), 8))
    assert all(t.num_rows <= 8 for t in told)
    rows, got = pa.concat_tables(told), {}
    for b in range(8):
        t = j._added(rows.filter(pa.array(np.asarray(rows["bucket"]) == b)))
        got |= dict(zip(t["half"].to_pylist(), t["shared"].to_pylist()))
    assert got == want
