"""Operators that SQL cannot express, against brute force on small fixtures; edge cases of all."""

import hashlib
import random
from dataclasses import replace

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlake.llm import chat, common, decontaminate, pieces, quality, repeats, secrets, simhash, topk, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in rows], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta"]) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture
def mixed(spark):
    shared = prose(99, 40)
    rows = [(1, prose(1, 80) + shared), (2, shared + prose(2, 50)), (3, prose(1, 80) + shared), (4, None), (5, ""), (6, "ab" * 300), (7, prose(7, 30)), (8, "x " * 400), (8, "x " * 400), (None, shared), (9, prose(7, 29) + " omega")]
    return rows, docs(spark, rows)


def removed_by_hand(texts, length=100):
    seen, cover = set(), []
    for t in texts:
        mark = [False] * len(t)
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            if s in seen:
                mark[i : i + length] = [True] * length
            seen.add(s)
        cover.append(mark)
    return cover


def test_repeats_are_those_of_brute_force(spark, mixed):
    rows, df = mixed
    once = sorted({(i is None, i or 0, t or "") for i, t in rows})
    cover = removed_by_hand([t.encode() for *_, t in once])
    want = {}
    for (null, i, t), mark in zip(once, cover, strict=True):
        raw = t.encode()
        kept = bytes(b for b, m in zip(raw, mark, strict=True) if not m)
        spans = sum(m and not (k and mark[k - 1]) for k, m in enumerate(mark))
        want[None if null else i] = (len(raw), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    got = repeats.dedup(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def fingerprint_by_hand(text):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").split() if w]
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_components_are_those_of_brute_force(spark):
    rows = [(i, prose(i % 7, 60) + (" tail%d" % i if i % 3 == 0 else "")) for i in range(40)] + [(100, None), (101, " \t"), (102, "a b"), (102, "a b"), (None, "a b")]
    fp = [fingerprint_by_hand(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (fp[a] ^ fp[b]).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    least = {k: min((i for (i, _), x in zip(rows, label, strict=True) if x == k and i is not None), default=None) for k in set(label)}
    want = sorted(((i, f, least[k]) for (i, _), f, k in zip(rows, fp, label, strict=True)), key=str)
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == want


def test_hot_groups_of_fingerprints_lose_no_link(spark):
    rows = spark.range(600).select((F.col("id") * 3).alias("fp"))
    got = {tuple(r) for r in simhash.links(rows, 600, chunk=50).collect()}
    seen = {0}
    while True:
        more = {y for a, b in got for x, y in ((a, b), (b, a)) if x in seen} - seen
        if not more:
            break
        seen |= more
    assert len(seen) == 600  # numbers of few bits: all are linked by way of others


def viterbi_by_hand(text, model_pieces, byte_ids, unknown):
    s = "▁" + text.replace(" ", "▁")
    best = [(0.0, [])] + [None] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(end):
            if best[start] is None:
                continue
            p = s[start:end]
            if p in model_pieces:
                c = best[start][0] + model_pieces[p][1], best[start][1] + [model_pieces[p][0]]
            elif end - start == 1:
                c = best[start][0] + unknown, best[start][1] + [byte_ids[b] for b in p.encode()]
            else:
                continue
            if best[end] is None or c[0] > best[end][0]:
                best[end] = c
    return best[-1]


def test_pieces_are_those_of_plain_viterbi():
    listed = [("▁", -2.0), ("a", -2.5), ("b", -3.0), ("ab", -3.25), ("▁a", -3.5), ("bab", -4.125), ("▁ab", -4.0), ("é", -5.0)]
    model = pieces.build(listed + [("", 0.0)] * 256, list(range(len(listed), len(listed) + 256)))
    table = {p: (i, s) for i, (p, s) in enumerate(listed)}
    r = random.Random(3)
    for text in ["", "a", "abab b", "zß é", *("".join(r.choices("ab é z", k=r.randrange(14))) for _ in range(60))]:
        ids, offset = pieces.Encoder(model).encode([text])
        cost, want = viterbi_by_hand(text, table, list(range(len(listed), len(listed) + 256)), model.unknown)
        score = sum(listed[i][1] if i < len(listed) else 0 for i in ids.tolist())
        lone = sum(listed[i][1] if i < len(listed) else 0 for i in want)
        assert pieces.decode(ids, model) == text
        assert abs(score - lone) < 1e-9, (text, ids.tolist(), want)


def test_every_text_survives_encoding(spark, mixed):
    rows, df = mixed
    df = df.unionByName(docs(spark, [(20, "▁ literal ▁"), (21, "\n\n  two  "), (22, "日本語 🙂 \x00")]))
    got = pieces.encode(df).collect()
    assert len(got) == len(rows) + 3 and all(r.round_trip for r in got)


def test_importance_resampling_tells_good_from_bad_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.where("doc_id % 5 = 0")
    out = quality.resample(d, labels.where("doc_id % 5 <> 0")).join(quality.good_labels(held), "doc_id").groupBy("good").agg(F.avg(F.col("keep").cast("double"))).collect()
    share = dict(map(tuple, out))
    assert share[True] > share[False] + 0.4, share


def test_kth_largest_is_exact(spark):
    xs = [random.Random(i).choice([1.5, 2.5, i / 7]) for i in range(300)]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    for k in (1, 7, 150, 300):
        assert quality.kth_largest(d, "x", k, bins=8) == sorted(xs, reverse=True)[k - 1]


def test_top_k_with_ties_bad_vectors_and_several_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    r = random.Random(5)
    rows = [(i, [r.randrange(-8, 8) / 256 for _ in range(4)]) for i in range(200)] + [(300, None), (301, [1.0, None, 1.0, 1.0]), (302, [1.0, float("inf"), 0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(d, d.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()
    good = {i: [int(x * 256 // 1) for x in v] for i, v in rows[:200]}
    want = []
    for q in (0, 50, 100, 150):
        best = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert [tuple(x) for x in got] == want
    assert topk.top_k(d.limit(0), d.limit(0)).count() == 0


def test_archives_survive_and_damage_is_found(spark):
    rows = [(1, "http://a/ b\n", "x" * 200), (2, None, "x" * 200), (3, "u", None), (None, "u", "x" * 200), (4, "u", "short"), (5, "u", "short")]
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in got.items()} == {1: ("response", None, 200), 2: ("revisit", 1, 200), 3: ("response", None, 0), None: ("revisit", 1, 200), 4: ("response", None, 5), 5: ("response", None, 5)}
    assert got[1].url == "http://a/ b\n"
    one = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert len(list(warc.read_records(one[i : i + 3] for i in range(0, len(one), 3)))) == 1
    with pytest.raises(warc.WarcError):
        list(warc.read_records([one[:-9]]))


def test_a_later_scan_reads_only_unseen_blobs(spark, tmp_path):
    path = str(tmp_path / "ledger")
    v1 = spark.createDataFrame([("a", "password = hunter22"), ("b", None), ("c", "password = hunter22")], "path string, text string")
    assert secrets.scanned(v1, path=path).count() == 2 * 3  # two blobs, three rules
    more = v1.unionByName(spark.createDataFrame([("d", "AKIA" + "A" * 16)], "path string, text string"))
    todo = secrets.unseen(more, secrets.read_ledger(spark, path)).collect()
    assert len(todo) == 1 and len(todo[0].todo) == 3
    ledger = secrets.scanned(more, path=path)
    assert ledger.count() == 3 * 3 and secrets.scanned(more, path=path).count() == 3 * 3
    found = {r.path: [s.kind for s in r.spans] for r in secrets.join_back(more, ledger).collect()}
    assert found == {"a": ["assign"], "b": [], "c": ["assign"], "d": ["access"]}
    newer = (*secrets.RULES[:2], replace(secrets.RULES[2], version=2))  # one rule changes: each blob is scanned for it alone
    assert [r.todo for r in secrets.unseen(more, ledger, newer).collect()] == [["hex:2"]] * 3
    assert secrets.scanned(more, newer, path).count() == 3 * 4


def test_spans_of_a_text_with_very_many_secrets(spark):
    rows = spark.createDataFrame([("a", "é token=abcdef1 " * 700)], "path string, text string")
    got = secrets.join_back(rows, secrets.scan(rows)).first().spans
    assert [(s.start, s.end) for s in got if s.kind == "assign"] == [(16 * i + 2, 16 * i + 15) for i in range(700)]


def test_the_url_filter_drops_nearly_all_misses_before_the_exact_join(spark):
    rows = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), "id").alias("url"))
    host, path = url_filter.url_parts(F.col("url"))
    listed = url_filter.listing(rows.where("page_id < 500").select(host.alias("host"), path.alias("path")))
    for limit in (url_filter.BROADCAST_BYTES, 600, 1):  # whole, in slices, shuffled
        with pytest.MonkeyPatch.context() as m:
            for module in (url_filter, common):
                m.setattr(module, "BROADCAST_BYTES", limit)
            keyed = rows.select(F.concat(host, F.lit(" "), path).alias("key"))
            assert 500 <= url_filter.passed(keyed, listed, 500).where("maybe").count() < 1500
            got = url_filter.judge(rows, listed).groupBy("verdict").count().collect()
            assert dict(map(tuple, got)) == {"allow": 19_500, "block": 500}


def test_native_operators_take_nulls_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://WWW.Example.com/en/x"), (3, "http://WWW.Example.com/en/x"), (None, "http://a.net/fr/?q")], "page_id long, url string")
    got = sorted((str(r.page_id), r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.listing(spark.createDataFrame([], "host string, path string"))).collect())
    assert got == sorted([("1", None, "allow"), ("2", None, "allow"), ("3", "www.example.com/en/", "allow"), ("3", "www.example.com/en/", "allow"), ("None", "net/fr/", "block")])
    turns = spark.createDataFrame([(1, 0, None, None), (1, 1, "assistant", "\\s</s>[INST]"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    told = {r.conv_id: r for r in chat.summary(chat.prefix_targets(turns)).collect()}
    assert told[1].loss_sha256 == hashlib.sha256(b"\\s</s>[INST]").hexdigest() and told[None].loss_chars == 0
    items = spark.createDataFrame([(1, "one two three"), (2, None)], "item_id long, text string")
    found = {r.doc_id: r.n_hit for r in decontaminate.report(docs(spark, [(1, "zero ONE two-three four"), (2, None), (None, "")]), items).collect()}
    assert found == {1: 3, 2: 0, None: 0}
    assert decontaminate.report(docs(spark, []), items.limit(0)).count() == 0
    assert repeats.dedup(docs(spark, [])).count() == 0 and simhash.near_duplicates(docs(spark, [])).count() == 0
