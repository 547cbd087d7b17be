from candor.operators.dedup import keep_first
from candor.streaming import running


def test_first_seen_agrees_with_batch(spark, tmp_path):
    rows = spark.range(200).selectExpr("id % 17 AS k", "timestamp_seconds(1700000000 + id * 60) AS ts", "CAST(id AS DOUBLE) AS v")
    rows.write.parquet(str(tmp_path / "events"))
    stream = running.read_files(spark, str(tmp_path / "events"), "*.parquet")
    got = running.run_available(running.first_seen(stream, ["k"], "ts", "1 day"))
    assert got.count() == keep_first(rows, ["k"], ["ts"]).count() == 17
    counters = running.run_available(running.running_counters(stream, ["k"], "v"), "complete")
    assert counters.selectExpr("sum(n)").collect()[0][0] == 200
    burst = running.run_available(running.bursts(stream, ["k"], "ts", "1 hour", "1 minute", 3))
    assert burst.count() > 0 and burst.filter("n < 3").count() == 0


def arrivals(spark, tmp_path, parts, run):
    """Append each part's rows as files, run the stream to its end, and return the last result."""
    folder, base = str(tmp_path / "in"), str(tmp_path / "work")
    for rows in parts:
        spark.createDataFrame(rows, "k string, t string, v bigint").selectExpr("k", "CAST(t AS TIMESTAMP) AS ts", "v").repartition(
            2).write.mode("append").parquet(folder)
        out = run(running.read_files(spark, folder, "*.parquet"), base)
    return [tuple(r) for r in out.collect()]


PARTS = [
    [("a", "2024-01-02 10:00:00", 2), ("a", "2024-01-02 09:00:00", 1), ("b", "2024-01-02 11:00:00", 3), (None, "2024-01-02 11:00:00", 4)],
    [("a", "2024-03-01 00:00:00", 5), ("c", "2024-01-02 23:00:00", 6), (None, "2024-03-01 00:00:00", 7), ("d", None, 8)],
    [("a", "2024-01-02 01:00:00", 9), ("a", "2024-01-02 02:00:00", 10), ("c", "2025-01-01 00:00:00", 11), ("d", None, 12)],
    [],
]


def test_repeats_never_pass_however_late(spark, tmp_path):
    got = arrivals(spark, tmp_path, PARTS, lambda s, base: running.first_seen_exactly(s, ["k"], ["ts", "v"], base))
    assert sorted((r[0] or "", r[2]) for r in got) == [("", 4), ("a", 1), ("b", 3), ("c", 6), ("d", 8)]


def test_a_batch_run_again_gives_the_same_rows(spark, tmp_path):
    """A driver lost after writing a batch, before noting it done: the same batch comes again and replaces its folder."""
    first = lambda s, base: running.first_seen_exactly(s, ["k"], ["ts", "v"], base)
    before = arrivals(spark, tmp_path, PARTS[:2], first)
    done = sorted((tmp_path / "work" / "state" / "commits").glob("[0-9]*"))
    done[-1].unlink()
    (done[-1].parent / f".{done[-1].name}.crc").unlink(missing_ok=True)
    again = first(running.read_files(spark, str(tmp_path / "in"), "*.parquet"), str(tmp_path / "work"))
    assert sorted(map(str, before)) == sorted(str(tuple(r)) for r in again.collect())


def test_open_and_corrected_windows(spark, tmp_path):
    got = arrivals(spark, tmp_path, PARTS, lambda s, base: running.burst_windows(s, ["k"], "ts", base, at_least=1))
    rows = sorted((r[0] or "", str(r[1])[:10], r[3], r[4], r[5]) for r in got)
    assert rows == [
        ("", "2024-01-02", 1, 0, True), ("", "2024-03-01", 1, 0, True), ("a", "2024-01-02", 4, 2, True),
        ("a", "2024-03-01", 1, 0, True), ("b", "2024-01-02", 1, 0, True), ("c", "2024-01-02", 1, 0, True),
        ("c", "2025-01-01", 1, 0, False),
    ]


def test_streams_over_no_rows(spark, tmp_path):
    assert arrivals(spark, tmp_path, [[]], lambda s, base: running.first_seen_exactly(s, ["k"], ["ts", "v"], base)) == []
    (tmp_path / "x").mkdir()
    assert arrivals(spark, tmp_path / "x", [[]], lambda s, base: running.burst_windows(s, ["k"], "ts", base)) == []
