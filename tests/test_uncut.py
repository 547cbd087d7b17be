"""Nothing is cut: long lists, deep payloads, long titles, and products without an id."""

import json
import sys
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from candor.functions.skew import attach_by_key
from candor.operators import audit, dedup, eda, near_copies, pages, payloads, products


def live(spark, product_id):
    texts = ["good value and quick delivery, would buy it again", "Good value and quick delivery, would buy it again",
             "good value and quick delivery, would buy it again!", "bad", "came broken after two days", "average thing"]
    rows = [("amazon", product_id, f"r{i}", f"u{i}", float(1 + i % 5), None, t, 1, False, f"2024-01-0{i + 1}") for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "platform string, product_id string, review_id string, reviewer_id string, rating double, title string, "
        "text string, helpful_votes int, verified_purchase boolean, review_date string").withColumn("review_date", F.to_timestamp("review_date"))


def test_products_without_an_id_are_a_product(spark):
    got = []
    for product_id in ("P1", None):
        rows = products.prepare(live(spark, product_id))
        signals = products.product_signals(rows)
        matches = near_copies.near_texts(rows)
        flags = products.review_flags(rows, signals).drop("product_id").orderBy("review_id").collect()
        spread = products.rating_deviation(rows, signals).collect()[0]["mean_abs_rating_deviation"]
        near = near_copies.with_near_flag(rows, matches).filter("near").count()
        pairs = near_copies.near_pairs(rows, matches).collect()[0]["near_duplicate_pairs"]
        got.append((flags, spread, near, pairs))
    assert got[0] == got[1]
    assert got[0][1] is not None and got[0][2] == 3 and got[0][3] == 3


def test_products_without_near_copies_show_zero(spark):
    rows = products.prepare(live(spark, "P1").filter("review_id IN ('r3', 'r4')").unionByName(live(spark, "P2")))
    got = {r["product_id"]: r["near_duplicate_pairs"] for r in near_copies.near_pairs(rows, near_copies.near_texts(rows)).collect()}
    assert got == {"P1": 0, "P2": 3}


def test_hot_rows_without_ids_reach_many_tasks(spark):
    rows = spark.range(4000, numPartitions=16).select(
        F.lit("amazon").alias("platform"), F.lit(None).cast("string").alias("product_id"), F.lit(None).cast("string").alias("review_id"))
    stats = spark.createDataFrame([("amazon", None, 4000, 1.5)], "platform string, product_id string, n long, mean double")
    for hot in (1, 10**6):
        out = attach_by_key(rows, stats, ["platform", "product_id"], "n", ["review_id"], null_safe=["platform", "product_id"], hot_rows=hot)
        assert out.filter("mean = 1.5").count() == 4000
    plain = attach_by_key(rows, stats, ["platform", "product_id"], "n", ["review_id"])
    assert plain.filter("mean IS NULL").count() == 4000


def test_long_and_deep_payloads(spark):
    many = [{"text": f"review {i}", "position": i} for i in range(300)]
    deep = {"reviews": [{"text": "at the bottom"}]}
    for _ in range(30):
        deep = {"inner": [0] * 100 + [deep]}
    odd = [{"title": ""}, {"rating": 4}, {"rating": 4, "author": "A"}, {"rating": 3, "date": ""}, {"snippet": 7}, "text", {"text": ["x"]}]
    body = json.dumps({"a": [{"n": i} for i in range(90)] + [{"reviews": many}], "reviews": odd, "z": deep})
    df = spark.createDataFrame([(1, "P", body), (2, "P", "no json"), (3, "P", None)], "id long, asin string, payload string")
    got = [r["text"] for r in payloads.nested_reviews(df, ["id"], "asin").collect()]
    assert len(got) == 300 + 1 + 1 and "at the bottom" in got and None in got


def test_reviews_of_a_payload_deeper_than_the_python_stack(caplog):
    n = sys.getrecursionlimit() + 200
    body = '{"reviews": [{"text": "first"}], "z": ' + '{"inner": [0, ' * n + '{"reviews": [{"text": "last"}]}' + "]}" * n + "}"
    assert [json.loads(x)["text"] for x in payloads._objects(body)] == ["first", "last"]
    assert payloads._objects("no json") == payloads._objects(None) == []
    assert payloads._objects("[" * 10**6 + "]" * 10**6) == [] and "nested too deep" in caplog.text


def test_long_page_lists_and_titles(spark):
    nodes = {"@type": "Product", "name": "x", "review": [
        {"@type": "Review", "reviewBody": f"long enough body number {i}", "author": "A"} for i in range(120)]}
    title = "Word " * 200
    html = f"<title>{title}</title><script type=\"application/ld+json\">{json.dumps(nodes)}</script>"
    df = spark.createDataFrame([(1, html, "http://x/")], "id long, html string, url string")
    assert pages.jsonld_reviews(pages.jsonld_nodes(df, ["id"]), ["id"]).count() == 120
    assert df.select(pages.title_tag(F.col("html")).alias("t")).collect()[0]["t"] == title.strip()


def test_all_values_and_pairs_are_counted(spark):
    df = spark.range(200).select(F.lit("f").alias("source_file"), F.col("id").cast("string").alias("a"), (F.col("id") * 2).cast("string").alias("b"))
    assert audit.value_counts(df, ["a"]).count() == 200
    assert audit.cross_tabs(df, [("a", "b")]).count() == 200


def test_spearman_ranks_all_rows(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 != 0, F.pow(F.col("id") % 97, 3.0)).alias("x"), (F.col("id") * 7919 % 1009).cast("double").alias("y"),
        F.lit(1.0).alias("one"))
    pdf = df.toPandas()
    got = {(r["a"], r["b"]): (r["n"], r["r"]) for r in eda.spearman(df, ["x", "y", "one"]).collect()}
    own = pdf[["x", "y"]].dropna().rank().corr().iloc[0, 1]
    assert got["x", "y"][0] == 2700 and abs(got["x", "y"][1] - own) < 1e-9 and got["x", "one"][1] is None


def test_spearman_ranks_by_null_mask(spark):
    rng = np.random.default_rng(5)
    table = [tuple(None if rng.random() < p else float(rng.integers(0, 9)) for p in (0, 0, 0.3, 0.5, 1)) for _ in range(200)]
    df = spark.createDataFrame(table, "a double, b double, c double, d double, e double")
    got = {(r["a"], r["b"]): (r["n"], r["r"]) for r in eda.spearman(df, list("abcde")).collect()}
    frame = pd.DataFrame(table, columns=list("abcde"), dtype="float64")
    want = {}
    for a, b in combinations("abcd", 2):
        both = frame[[a, b]].dropna().rank()
        want[a, b] = (len(both), both[a].corr(both[b]))
    assert set(got) == set(want)
    assert all(got[k][0] == n and abs(got[k][1] - r) < 1e-9 for k, (n, r) in want.items())
    plan = eda.spearman(df.select("a", "b"), ["a", "b"])._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "Cartesian" not in plan


def test_rows_of_hot_keys_and_null_keys_are_shuffled_to_many_tasks(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 4 == 1, F.col("id").cast("string")).alias("k"), "id")
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k IS NOT NULL")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = attach_by_key(rows, stats, ["k"], "n", ["id"], hot_rows=100)
        placed = out.withColumn("part", F.spark_partition_id()).groupBy("k", "n").agg(F.countDistinct("part").alias("parts"), F.count("*").alias("m"))
        found = {r["k"]: (r["n"], r["parts"], r["m"]) for r in placed.filter("k IS NULL OR k = 'hot'").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found["hot"][0] == found["hot"][2] == 2000 and found[None][0] is None and found[None][2] == 1000
    assert found["hot"][1] > 1 and found[None][1] > 1


def test_top_rows_of_a_group_are_limited_before_the_shuffle(spark):
    rows = spark.range(10000).select((F.col("id") % 3).alias("g"), "id")
    top = dedup.first_rows(rows, ["g"], ["id"], 1500)
    assert top.count() == 4500 and "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_metric_cells_are_parsed_once(spark):
    cells = {"{'a': None, 'b': True}": "ok", " {'a': 1} ": "ok", "{}": "ok", "[1, None]": "wrong_type", "False": "wrong_type", "3": "wrong_type",
             "{'a': oops": "unparseable", "oops": "unparseable", "{'Nonesuch': 1}": "ok", " NaN ": "missing", "": "missing", None: "missing"}
    raw = spark.createDataFrame([(c,) for c in cells], "c string").withColumn("source_file", F.col("c"))
    out = audit.metric_status(raw, "c")
    assert {r.source_file: r.status for r in out.collect()} == cells
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_line_delta_reads_the_records_once(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    with open(path, "w") as f:
        f.write('a,b\n1,"x\ny"\n\n2,z\ncut off,1,2\n"3",""""\n')
    out = audit.line_delta(spark, path, ["a", "b"])
    assert [tuple(r) for r in out.collect()] == [(6, 3)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") <= 3
