"""Cases that every operator defines: clashing columns, empty tables, very long texts, repeated rows, and sides too large to broadcast."""

import hashlib
import math
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlake.llm import chat, common, decontaminate, nearcopies, pieces, quality, repeats, secrets, simhash, topk, url_filter, warc
from tests.llm.test_brute import docs, fingerprint_by_hand, prose, removed_by_hand

CLASHING = ("fp", "rk", "blob", "path", "words", "prints", "key", "maybe", "own", "best", "n", "hit", "group", "text_hash", "spans", "said", "len", "block", "archive", "digest", "v", "dim", "shard", "query", "ids", "_id", "anchor", "runs")


def clashing(df):
    return df.select("*", *[F.lit("z").alias(c) for c in CLASHING if c not in df.columns])


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def operators(spark, empty=False):
    """Each operator's result on a small table with clashing columns, or on its empty form."""
    cut = (lambda df: clashing(df).limit(0)) if empty else clashing
    d = cut(docs(spark, [(1, "token = abcdef1 " + prose(1, 40)), (1, "token = abcdef1 " + prose(1, 40)), (2, None), (None, prose(2, 40))]))
    p = cut(pages(spark, [(1, "http://a.net/fr/x", "x" * 200), (1, "http://a.net/fr/x", "x" * 200), (2, None, None), (None, "u", "x" * 200)]))
    return {
        1: url_filter.judge(p, url_filter.listing(spark.createDataFrame([("a.b", "/c")], "host string, path string"))),
        2: chat.summary(chat.prefix_targets(cut(turns(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 0, None, None)])))),
        3: decontaminate.report(d, cut(items(spark, [(1, prose(1, 40)), (None, prose(2, 12)), (2, None)]))),
        4: repeats.dedup(d),
        5: pieces.encode(d),
        6: warc.read_archives(warc.write_archives(p)),
        7: quality.resample(d, cut(labels(spark, [(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 1)]))),
        8: simhash.near_duplicates(d),
        9: secrets.join_back(d.select(F.col("doc_id").alias("path"), "text"), secrets.scan(d.select(F.col("doc_id").alias("path"), "text"))),
        10: topk.top_k(cut(vectors(spark, [(i, [float(i), 1.0]) for i in range(8)] + [(8, None)])), cut(vectors(spark, [(0, [0.0, 1.0])]))),
    }


def test_operators_take_columns_of_any_name_and_keep_repeated_rows(spark):
    got = {n: df.count() for n, df in operators(spark).items()}
    assert got == {1: 4, 2: 2, 3: 4, 4: 4, 5: 4, 6: 4, 7: 4, 8: 4, 9: 4, 10: 5}


def test_operators_take_empty_tables(spark):
    assert {n: df.count() for n, df in operators(spark, empty=True).items()} == dict.fromkeys(range(1, 11), 0)


def test_sides_too_large_to_broadcast_give_the_same_rows(spark, monkeypatch):
    plain = {n: sorted(map(str, df.collect())) for n, df in operators(spark).items()}
    for module in (common, url_filter, secrets):
        monkeypatch.setattr(module, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(common.sized, "__defaults__", (-1,))
    monkeypatch.setattr(common.skewed_left, "__defaults__", (1,))  # and every key is hot
    monkeypatch.setattr(url_filter, "SLICES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = {n: sorted(map(str, df.collect())) for n, df in operators(spark).items()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled == plain


LONG = 600_000


def test_very_long_texts(spark):
    r = random.Random(9)
    words = [f"w{r.randrange(10**6)}" for _ in range(LONG // 8)]
    text = " ".join(words) + " password = hunter2222 " + " ".join(words[:30])
    assert len(text) > repeats.SLICE
    d = docs(spark, [(1, text), (2, " ".join(words[:40]))])
    found = {x.doc_id: x for x in decontaminate.report(d, items(spark, [(7, " ".join(words[-15:]))])).collect()}
    assert (found[1].n_words, found[1].n_hit, found[2].n_hit) == (len(words) + 32, 15, 0)
    fp = {x.doc_id: x.fp % (1 << 64) for x in simhash.fingerprints(d).collect()}
    assert fp[1] == fingerprint_by_hand(text)
    spans = secrets.join_back(*[d.select(F.col("doc_id").alias("path"), "text")], secrets.scan(d.select(F.col("doc_id").alias("path"), "text"))).where("path = 1").first().spans
    assert [(s.kind, text[s.start : s.end]) for s in spans] == [("assign", "password = hunter2222")]
    assert all(x.round_trip for x in pieces.encode(d).collect())
    raw = [text.encode(), " ".join(words[:40]).encode()]
    tail = len(" ".join(words[:30]).encode())
    gone = {x.doc_id: x.n_removed for x in repeats.dedup(d).collect()}
    assert gone[1] >= tail and gone[2] == len(raw[1])
    page = warc.read_archives(warc.write_archives(pages(spark, [(1, "u" * 5000, "x" * (9 << 20))]))).first()
    assert (page.payload_bytes, page.url) == (9 << 20, "u" * 5000)
    said = chat.summary(chat.prefix_targets(turns(spark, [(1, 0, "assistant", text)]))).first()
    assert said.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    url = "http://h.org/" + "a" * 50_000
    assert url_filter.judge(pages(spark, [(1, url, None)]), url_filter.listing(spark.createDataFrame([("h.org", "/" + "a" * 50_000)], "host string, path string"))).first().verdict == "block"


def test_equal_cuttings_whose_hashes_lie_are_compared_by_their_bytes(spark, monkeypatch):
    """All cuttings of an anchor get one 64-bit hash: the digests differ, and the bytes decide."""
    shared = prose(5, 40)
    rows = [(1, prose(1, 30) + shared + prose(2, 30)), (2, prose(3, 30) + shared + prose(4, 30)), (3, prose(1, 30) + shared)]
    want = [sum(m) for m in removed_by_hand([t.encode() for _, t in rows])]
    honest = repeats._anchor_rows

    def lying(batches, with_key):
        for b in honest(batches, with_key):
            yield b if with_key else b.set_column(1, "cutting", repeats.pa.array([0] * b.num_rows, repeats.pa.int64()))

    monkeypatch.setattr(repeats, "_anchor_rows", lying)
    assert [r.n_removed for r in sorted(repeats.dedup(docs(spark, rows)).collect(), key=lambda r: r.doc_id)] == want


def resample_by_hand(rows, good, share):
    """The models, weights and draws of operator 7, a text at a time."""
    words = lambda t: quality.TOKEN.findall((t or "").lower())
    crc = lambda w: __import__("zlib").crc32(w.encode())

    def features(t):
        w = [crc(x) for x in words(t)]
        two = [((a * 0x9E3779B1 + b * 0x85EBCA77) % (1 << 64) >> 7) % quality.BUCKETS + quality.BUCKETS for a, b in zip(w, w[1:], strict=False)]
        return [x % quality.BUCKETS for x in w], two

    raw, target = [{}, {}], [{}, {}]
    for i, t in rows:
        for k, f in enumerate(features(t)):
            for x in f:
                raw[k][x] = raw[k].get(x, 0) + 1
                if i in good:
                    target[k][x] = target[k].get(x, 0) + 1
    weight = {}
    for k in range(2):
        r, t = sum(raw[k].values()), sum(target[k].values())
        for x, n in raw[k].items():
            p, hit = n / r, target[k].get(x, 0)
            telling = abs(hit - p * t) >= quality.SIGMA * math.sqrt(p * t)
            weight[x] = math.log((hit + quality.BUCKETS * p) / (t + quality.BUCKETS) / p) if telling else 0.0
    hashed = lambda raw_bytes, seed: xxhash.xxh64_intdigest(raw_bytes, seed)
    out = []
    for i, t in rows:
        w = sum(weight[x] for f in features(t) for x in f)
        text_hash = 42 if t is None else hashed(t.encode(), 42)
        h = 42 if i is None else hashed(struct.pack("<q", i), 42)
        h = hashed(struct.pack("<Q", text_hash), h)
        h = hashed(struct.pack("<i", quality.SEED), h)
        u = ((h >> 11) + 0.5) / (1 << 53)
        out.append((i, w, w / quality.TEMPERATURE - math.log(-math.log(u))))
    k = round(share * len(rows))
    cut = sorted((x for *_, x in out), reverse=True)[k - 1]
    return {(i, round(w, 3), round(x, 2), x >= cut) for i, w, x in out}


def test_importance_resampling_is_that_of_brute_force(spark):
    r = random.Random(2)
    fine, junk = ["river", "stone", "morning", "light", "garden"], ["buy", "now", "click", "here", "free"]
    rows = [(i, " ".join(r.choices(fine if i % 2 else junk, k=60))) for i in range(60)] + [(60, None), (61, ""), (None, "river stone"), (62, "Ünïcode — river")]
    told = labels(spark, [(i, i % 2, 0) for i in range(40)] + [(41, 1, 1), (43, None, 0), (None, 1, 0)])
    got = {(x.doc_id, round(x.log_weight, 3), round(x.perturbed, 2), x.keep) for x in quality.resample(docs(spark, rows), told).collect()}
    want = resample_by_hand(rows, {i for i in range(40) if i % 2}, 20 / 41)
    assert len(got) == len(want) and sum(a in want for a in got) >= len(want) - 2  # model weights are single precision
    assert {(a[0], a[3]) for a in got} == {(a[0], a[3]) for a in want}


def test_rows_tied_with_the_last_one_kept_stay(spark):
    rows = [(1, "a b c")] * 3 + [(i, "x y z") for i in range(2, 6)]
    out = quality.resample(docs(spark, rows), labels(spark, [(1, 1, 0), (2, 0, 0), (3, 0, 0)])).collect()
    assert len({x.keep for x in out if x.doc_id == 1}) == 1


def test_near_copies_when_nothing_is_broadcast(spark, monkeypatch):
    words = prose(7, 120)
    rows = [(i, words + f" tail{i}") for i in range(30)] + [(100, None), (101, " ")]
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common.skewed_left, "__defaults__", (4,))
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs(spark, rows)).collect()}
    assert got == dict.fromkeys(range(30), 0) | {100: 100, 101: 100}
