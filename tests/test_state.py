import pytest
from pyspark.sql import functions as F

from ledgerlake.streaming.batches import events
from ledgerlake.streaming.state import closed_windows, manifest

DAY = 86400
MONDAY = 1704067200  # 1 January 2024, the start of a window
ROWS = "id long, ts timestamp, cents long"


def put(spark, path, rows, schema=ROWS):
    d = spark.createDataFrame([(*(r[:1] if schema == ROWS else ()), *r[1 if schema == ROWS else 0 :]) for r in rows], schema.replace("timestamp", "long"))
    d.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(path)


def run(spark, home, **settings):
    got = closed_windows(events(spark, f"{home}/rows", 1), events(spark, f"{home}/totals", 1), f"{home}/out", **settings)
    return sorted((((r.start - MONDAY) // DAY, r.n, r.cents, r.total, r.status) for r in got.collect()), key=str)


def test_windows_close_once_and_are_resumed(spark, tmp_path):
    home = str(tmp_path)
    # the first window ends on day 7, its last instant included; the second has no rows and an attested total of none
    put(spark, f"{home}/rows", [(1, MONDAY + DAY, 5), (2, MONDAY + 7 * DAY, 6), (3, MONDAY + 15 * DAY, 7)])
    put(spark, f"{home}/totals", [(MONDAY + 1, 2), (MONDAY + 7 * DAY + 1, 0), (MONDAY + 14 * DAY + 1, 2), (MONDAY + 21 * DAY + 1, 1)], "ts timestamp, total long")
    first = run(spark, home)
    assert [r for r in first if r[0] == 0] == [(0, 2, 11, 2, "CLOSED")]
    assert all(r[0] < 14 for r in first)  # the window of day 15 is still open
    # late: the first window is closed, and stays as it was; the third closes as the watermark passes its end
    put(spark, f"{home}/rows", [(9, MONDAY + 2 * DAY, 100), (4, MONDAY + 16 * DAY, 1), (5, MONDAY + 30 * DAY, 1)])
    again = run(spark, home, on_failure="tell")
    assert [r for r in again if r[0] <= 14] == [(0, 2, 11, 2, "CLOSED"), (14, 2, 8, 2, "CLOSED"), (7, 0, 0, 0, "EMPTY_ATTESTED")]
    assert [r[4] for r in again if r[0] == 21] == ["TRUNCATED"]  # attested, but no row came
    assert run(spark, home) == again  # nothing new


@pytest.mark.parametrize("beyond,closed", [(0, True), (-1, False)])
def test_a_window_ends_with_the_watermark_at_its_last_instant(spark, tmp_path, beyond, closed):
    home = str(tmp_path)
    put(spark, f"{home}/rows", [(1, MONDAY + 7 * DAY, 1), (2, MONDAY + 8 * DAY + beyond, 1)])
    put(spark, f"{home}/totals", [(MONDAY + 7 * DAY, 1), (MONDAY + 70 * DAY, 1)], "ts timestamp, total long")
    assert run(spark, home) == ([(0, 1, 1, 1, "CLOSED")] if closed else [])


@pytest.mark.parametrize("rows,total,status", [([1, 2], 3, "TRUNCATED"), ([1, 2, 2], 3, "REPEATED"), ([1], None, "UNATTESTED")])
def test_windows_that_are_not_whole_stop_or_are_told(spark, tmp_path, rows, total, status):
    for home in (f"{tmp_path}/a", f"{tmp_path}/b"):
        put(spark, f"{home}/rows", [(i, MONDAY + DAY, 1) for i in rows] + [(99, MONDAY + 20 * DAY, 1)])
        put(spark, f"{home}/totals", [(MONDAY + 1, total)] if total else [(MONDAY + 60 * DAY, 0)], "ts timestamp, total long")
    told = run(spark, f"{tmp_path}/a", on_failure="tell")
    assert (0, len(rows), len(rows), total, status) in told
    with pytest.raises(Exception, match=f"{status}: window"):
        run(spark, f"{tmp_path}/b")
    with pytest.raises(Exception, match=f"{status}: window"):  # a restart does not pass it over
        run(spark, f"{tmp_path}/b")


def test_a_manifest_admits_once(spark, tmp_path):
    src, schema = f"{tmp_path}/in", "key long, id long, record string"
    put_rows = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    put_rows([(1, 5, "a"), (1, 3, "a"), (2, 1, None), (2, 2, "x"), (None, 1, "n"), (3, None, "n"), (4, 7, "d"), (4, 8, "e"), (4, 9, "d")])
    rows = lambda: sorted(tuple(r) for r in manifest(events(spark, src, 1), f"{tmp_path}/out").select("key", "id", "verdict").collect())
    first = [(1, 3, "ADMITTED"), (2, 1, "ADMITTED"), (2, 2, "CONFLICT"), (4, 7, "ADMITTED"), (4, 8, "CONFLICT")]
    assert rows() == first
    put_rows([(1, 1, "a"), (2, 9, None), (4, 2, "e"), (4, 1, "f"), (5, 1, "z")])  # an equal record with a smaller id changes nothing
    assert rows() == sorted([*first, (4, 1, "CONFLICT"), (5, 1, "ADMITTED")])
    with pytest.raises(Exception, match="CONFLICT: key"):
        manifest(events(spark, src, 1), f"{tmp_path}/strict", "stop")


def test_a_hot_key_is_folded_before_the_shuffle(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.range(0, 100_000, 1, 4).select(F.lit(1).alias("key"), "id", F.when(F.col("id") == 77_777, "b").otherwise("a").alias("record")).write.parquet(src)
    got = [tuple(r) for r in manifest(events(spark, src, 10), f"{tmp_path}/out").collect()]
    assert sorted(got) == [(1, 0, "a", "ADMITTED"), (1, 77_777, "b", "CONFLICT")]
