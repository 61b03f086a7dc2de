"""Hot keys of equal rows, columns of any type on every path, archives of other writers, repeated vectors."""

import base64
import gzip
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import common, nearcopies, topk, url_filter, warc
from tests.llm.test_brute import docs, prose
from tests.llm.test_edges import pages, vectors


def test_equal_rows_of_a_hot_key_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common.sized, "__defaults__", (-1,))
    rows = spark.range(400).select(F.lit("same").alias("k"), F.lit(1).alias("v"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    side = spark.createDataFrame([("same", 7), ("other", 8)], "k string, w int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = common.skewed_left(rows, side, "k", 1 << 40, hot=10)
        tasks = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(tasks) == 400 and max(tasks) <= 130 and len(tasks) >= 5
    assert out.columns == ["k", "v", "m", "w"] and {r.w for r in out.collect()} == {7}


def test_secret_stage_keeps_columns_of_any_type_when_nothing_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common.skewed_left, "__defaults__", (2,))
    rows = [(i, "password = hunter2222 and more") for i in range(9)] + [(10, "clean"), (11, None)]
    d = docs(spark, rows).withColumn("m", F.create_map(F.lit("a"), F.col("doc_id"))).withColumn("text_hash", F.lit("z"))
    out = corpus_pipeline.secret_scan(spark, d, "").collect()
    assert len(out) == 11 and all(r.m == {"a": r.doc_id} for r in out)
    assert not any("hunter2222" in (r.text or "") for r in out) and {r.text for r in out if r.doc_id > 9} == {"clean", None}


def test_many_copies_of_a_text_in_near_copies(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common.skewed_left, "__defaults__", (5,))
    text = prose(3, 80)
    rows = [(i, text) for i in range(60)] + [(100 + i, text + f" end{i}") for i in range(4)] + [(200, prose(9, 80))]
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs(spark, rows)).collect()}
    assert got == {i: 0 for i, _ in rows if i < 200} | {200: 200}


def test_repeated_vectors_are_candidates_each(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 4)
    rows = [(i, [float(i % 7), 1.0 - i, 0.5]) for i in range(30)] + [(3, [3.0, -2.0, 0.5])] * 4 + [(0, [0.0, 1.0, 0.5])] + [(50, [1.0, 1.0, 1.0])] * 2
    v = vectors(spark, rows)
    got = topk.top_k(v, v.where("vec_id % 50 = 0")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({topk.ORACLE})").fetchall()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want) and len(want) == 10
    assert sum(r.vec_id == 3 for r in topk.top_k(vectors(spark, [(0, [1.0]), (3, [1.0]), (3, [1.0])]), vectors(spark, [(0, [1.0])])).collect()) == 2


def test_urls_are_broadcast_by_their_bytes(spark, monkeypatch):
    key = "h.org /" + "a" * 5000
    listed = url_filter.listing(spark.createDataFrame([("h.org", "/" + "a" * 5000)], "host string, path string"))
    assert url_filter.width_of(listed) >= len(key)
    monkeypatch.setattr(common.sized, "__defaults__", (4000,))
    assert url_filter.judge(pages(spark, [(1, "http://h.org/" + "a" * 5000, None)]), listed).first().verdict == "block"


def member(kind, headers, block):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:12345678-aaaa-bbbb-cccc-1234567890ab>", "WARC-Date: 2020-01-01T00:00:00Z", *headers, f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n")


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    body = b"<p>hello</p>"
    archive = b"".join([
        member("warcinfo", [f"WARC-Block-Digest: {sha1(b'software: x')}"], b"software: x"),
        member("request", [], b"GET / HTTP/1.1\r\n\r\n"),
        member("response", ["WARC-Target-URI: http://a.org/", f"WARC-Payload-Digest: {sha1(body)}", f"WARC-Block-Digest: {sha1(HTTP + body)}"], HTTP + body),
        member("response", ["WARC-Target-URI: http://b.org/"], HTTP + body),  # without digests
        member("response", ["WARC-Target-URI: http://c.org/", "WARC-Payload-Digest: blake9:xyz", "WARC-Block-Digest: sha256:" + hashlib.sha256(HTTP).hexdigest().upper()], HTTP),
        member("revisit", ["WARC-Target-URI: http://d.org/", f"WARC-Payload-Digest: {sha1(body)}", "WARC-Refers-To: <urn:uuid:1>"], HTTP[:-2] + b"Content-Length: 12\r\n\r\n"),
        member("metadata", [], b"x"),
    ])
    (tmp_path / "a.warc.gz").write_bytes(archive)
    got = {r.url: (r.page_id, r.payload_bytes, r.payload_digest, r.record_type) for r in warc.read_files(spark, str(tmp_path)).collect()}
    assert got == {
        "http://a.org/": (None, 12, sha1(body), "response"),
        "http://b.org/": (None, 12, None, "response"),
        "http://c.org/": (None, 0, "blake9:xyz", "response"),
        "http://d.org/": (None, 12, sha1(body), "revisit"),
    }


@pytest.mark.parametrize("header", ["WARC-Payload-Digest", "WARC-Block-Digest"])
def test_wrong_digests_are_refused(header):
    data = member("response", [f"{header}: {sha1(b'something else')}"], HTTP + b"x")
    with pytest.raises(warc.WarcError, match="digest differs"):
        [warc._page(r) for r in warc.read_records([data])]
