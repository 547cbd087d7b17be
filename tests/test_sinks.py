from pyspark.sql import functions as F

from candor.sources import sinks


def test_observed_write_reports_what_was_written(spark, tmp_path):
    rows = spark.range(1000).repartition(7).selectExpr("id", "IF(id % 4 = 0, NULL, 'x') AS `a.b`", "id % 10 AS k")
    figures = sinks.write_observed(rows, str(tmp_path / "t"), {"tens": F.col("k") == 0, "unknown": F.col("`a.b`").isNull() & (F.col("k") > 4)})
    got = {(r["kind"], r["name"]): r for r in figures.collect()}
    back = spark.read.parquet(str(tmp_path / "t"))
    assert got["rows", "written"]["n"] == back.count() == 1000 and got["rows", "written"]["seconds"] > 0
    assert [(c, got["column", c]["type"], got["column", c]["n"]) for c in back.columns] == [("id", "bigint", 0), ("a.b", "string", 250), ("k", "bigint", 0)]
    assert got["issue", "tens"]["n"] == 100
    assert got["issue", "unknown"]["n"] == back.filter("`a.b` IS NULL AND k > 4").count()


def test_observed_write_of_no_rows(spark, tmp_path):
    figures = sinks.write_observed(spark.range(0), str(tmp_path / "t"), {"any": F.col("id") > 0})
    assert {(r["kind"], r["n"]) for r in figures.collect()} == {("rows", 0), ("column", 0), ("issue", 0)}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 0
