"""Split CSV files against Python's csv module."""

import csv
import functools
import io
import random

import pytest

from candor.fixed_values import METRIC_KEYS
from candor.plans import views
from candor.sources import quoted_csv, tables

COLUMNS = ["a", "b", "c"]


def make(seed, n):
    rng = random.Random(seed)
    cells = ["", "x", "two\nlines", 'say "hi"', "a,b", "\n\n", "é\n\"\n", "long " * 30, "1\n2\n3\n4\n5\n6\n7", " padded "]
    return [[f"r{i}", rng.choice(cells), rng.choice(cells)] for i in range(n)]


def text_of(rows):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
    w.writerow(COLUMNS)
    w.writerows(rows)
    return out.getvalue()


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed", [1, 2])
def test_records_of_many_ranges(small_ranges, tmp_path, seed):
    spark, rows = small_ranges, make(seed, 400)
    for k in range(2):
        (tmp_path / f"f{k}.csv").write_text(text_of(rows[k::2]), encoding="utf-8")
    df = quoted_csv.read(spark, str(tmp_path), COLUMNS, "bad")
    got = sorted((r["path"][-6:], r["line"], r["a"], r["b"], r["c"]) for r in df.collect())
    want = [[c or None for c in r] for r in rows]  # an empty cell without quotes is NULL
    for k in range(2):
        assert [list(r[2:]) for r in got if r[0] == f"f{k}.csv"] == want[k::2]
    assert df.where("bad is not null").count() == 0
    assert quoted_csv.ranges(spark, str(tmp_path)).count() > 20
    assert {r["path"][-6:]: r["n_lines"] for r in quoted_csv.line_counts(spark, str(tmp_path)).collect()} == {
        f"f{k}.csv": text_of(rows[k::2]).count("\n") for k in range(2)}


def test_a_record_over_many_ranges_and_broken_ones(small_ranges, tmp_path):
    spark = small_ranges
    long = "\n".join(f"line {i}, with a comma" for i in range(300))
    path = tmp_path / "one.csv"
    path.write_bytes(("a,b,c\r\nr0,x,y\r\n\r\nr1,\"" + long + "\",z\ntoo,few\nr2,1,2\nfour,1,2,3\nr3,\"never closed,\nr4,1,2\n").encode())
    raw = quoted_csv.read(spark, str(path), COLUMNS, "bad").orderBy("line").collect()
    assert [r["a"] for r in raw if r["bad"] is None] == ["r0", "r1", "r2"]
    assert [r["b"] for r in raw if r["a"] == "r1"] == [long] and raw[0]["c"] == "y"
    assert [r["bad"] for r in raw if r["bad"] is not None] == ["too,few", "four,1,2,3", "r3,\"never closed,\nr4,1,2"]
    good = tables.good_rows(tables.read_raw_reviews(spark, str(path), COLUMNS))
    assert [r["row_pos"] for r in good.orderBy("row_pos").collect()] == [1, 3, 304]
    assert {r["n_rejected"] for r in tables.reject_counts(tables.read_raw_reviews(spark, str(path), COLUMNS)).collect()} == {3}


def test_empty_file_and_no_header(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bare.csv").write_text("1,2,3\n")
    got = quoted_csv.read(spark, str(tmp_path), COLUMNS, "bad").collect()
    assert [(r["a"], r["line"]) for r in got] == [("1", 0)]


def test_bytes_that_are_no_text_and_small_batches(small_ranges, tmp_path):
    spark = small_ranges
    body = b"a,b,c\n" + b"".join(b"r%d,\"one\n\xff two\r\n\",x\xfe\r\n" % i for i in range(80)) + b"open,\"\xff\n\nend"
    (tmp_path / "one.csv").write_bytes(body)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = quoted_csv.read(spark, str(tmp_path), COLUMNS, "bad").orderBy("line").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r["a"], r["b"], r["c"], r["line"], r["n_lines"]) for r in got[:-1]] == [
        (f"r{i}", "one\n� two\r\n", "x�", 1 + 3 * i, 3) for i in range(80)]
    assert (got[-1]["bad"], got[-1]["line"], got[-1]["n_lines"]) == ("open,\"�\n\nend", 241, 3)


def test_a_file_is_read_three_times_and_its_ranges_counted_once(small_ranges, tmp_path):
    (tmp_path / "one.csv").write_text(text_of(make(3, 200)), encoding="utf-8")
    counts = tables.reject_counts(tables.read_raw_reviews(small_ranges, str(tmp_path), COLUMNS))
    counts.collect()
    plan = counts._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan"):plan.index("Initial Plan")]
    assert final.count("FileScan text") == 3 and "ReusedExchange" in final


def test_the_metric_texts_of_stored_lines(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    lines = views.stored_lines(spark, d, str(tmp_path / "lines"))
    stored = views.raw_reviews(spark, d, lines)
    assert "Join" not in stored._jdf.queryExecution().optimizedPlan().toString()
    plain, own = views.raw_reviews(spark, d), stored
    assert plain.exceptAll(own).count() == 0 and own.exceptAll(plain).count() == 0
    cells = [views._metric_text(k).eqNullSafe(views.metric(k).cast("string")) for k in METRIC_KEYS]
    assert lines.where(~functools.reduce(lambda a, b: a & b, cells)).count() == 0 and lines.count() > 0


def test_good_rows_are_parsed_once(spark, tmp_path):
    (tmp_path / "one.csv").write_text(text_of(make(4, 20)), encoding="utf-8")
    good = tables.good_rows(tables.read_raw_reviews(spark, str(tmp_path), COLUMNS))
    plan = good.select("a", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv(") == 1
    assert good.count() == 20
