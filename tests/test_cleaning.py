import math

from candor.fixed_values import RAW_COLUMNS
from candor.operators import audit, dedup, labels
from candor.operators.cleaning import clean_labelled, clean_reviews, enforce_schema
from candor.sources import sinks, tables

RAW = "source_file string, _id string, reviewerID string, asin string, helpful string, reviewText string, overall string, " \
      "summary string, unixReviewTime string, class string, BehaviouralFeatureResult string, label string"


def raw(spark, **cells):
    base = dict(source_file="a", _id=None, reviewerID="r", asin="p", helpful="[0, 0]", reviewText="fine text", overall="5",
                summary="s", unixReviewTime="1388534400", BehaviouralFeatureResult="", label="")
    base["class"] = ""
    base.update(cells)
    names = [c.split()[0] for c in RAW.split(", ")]
    return spark.createDataFrame([tuple(base[n] for n in names)], RAW)


def one(df):
    return df.collect()[0].asDict()


def test_ids_pairs_and_numbers(spark):
    r = one(clean_reviews(raw(spark, _id="{'$oid': '5a1b2c'}", helpful="[2, 3]", overall="4.5")))
    assert r["mongo_id"] == "5a1b2c" and (r["helpful_votes"], r["helpful_total"]) == (2.0, 3.0)
    assert math.isclose(r["helpful_ratio"], 2 / 3) and r["overall"] == 4.5 and r["rating_polarity"] == 1.0
    assert str(r["review_datetime_utc"]).startswith("2014-01-01")


def test_bad_cells_become_null_never_zero(spark):
    r = one(clean_reviews(raw(spark, _id="plain", helpful="[1]", overall="x", unixReviewTime="", **{"class": ""})))
    assert [r[c] for c in ("mongo_id", "helpful_votes", "overall", "rating_polarity", "unixReviewTime", "class_raw")] == [None] * 6
    assert r["class_missing"] == 1
    assert one(clean_reviews(raw(spark, helpful="[0, 0]")))["helpful_ratio"] is None
    assert one(clean_reviews(raw(spark, overall="nan")))["overall"] is None


def test_missing_text_words(spark):
    for text in (None, "", "  ", "\t", " NaN ", "None", "null", "  "):
        r = one(clean_reviews(raw(spark, reviewText=text)))
        assert (r["text_missing"], r["text_length"], r["reviewText"], r["text_very_short"]) == (1, 0, None, 0), repr(text)
    r = one(clean_reviews(raw(spark, reviewText=" ok ")))
    assert (r["text_length"], r["text_very_short"], r["reviewText"]) == (4, 1, " ok ")
    assert one(clean_reviews(raw(spark, reviewText="nothing")))["text_missing"] == 0


def test_metrics_need_quoted_keys(spark):
    r = one(clean_labelled(raw(spark, BehaviouralFeatureResult="{'CS': 0.3, 'MNR': 1.0, 'PC': 1e-3}", label="1.0")))
    assert (r["bfr_CS"], r["bfr_MNR"], r["bfr_NR"], r["bfr_PC"], r["candidate_label"]) == (0.3, 1.0, None, 0.001, 1.0)


def test_schema_is_enforced(spark):
    df = enforce_schema(clean_reviews(raw(spark)))
    assert dict(df.dtypes)["text_length"] == "int" and len(df.columns) == 22


def test_keep_first_is_exact_with_hot_key(spark):
    rows = spark.range(5000).selectExpr("IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS k", "id % 2 AS source_rank", "id AS pos")
    kept = dedup.keep_first(rows, ["k"], ["source_rank", "pos"])
    assert kept.count() == rows.select("k").distinct().count()
    hot = kept.filter("k = 'hot'").collect()[0]
    assert (hot.source_rank, hot.pos) == (0, 0)
    assert "WindowGroupLimit" in kept._jdf.queryExecution().toString()


def test_uniform_sample_has_the_asked_size(spark):
    sample = dedup.uniform_sample(spark.range(20000), 1000, ["id"])
    assert sample.count() == 1000 and sample.distinct().count() == 1000
    mean = sample.selectExpr("avg(id)").collect()[0][0]
    assert abs(mean - 10000) < 1000


def test_auc_counts_ties_half(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (1.0, 1.0), (2.0, 1.0), (0.5, 0.0)], "s double, candidate_label double")
    assert one(labels.rank_auc(rows, ["s"]))["auc"] == 0.875
    assert one(labels.rank_auc(rows.filter("candidate_label = 1"), ["s"]))["auc"] is None


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "A.csv"
    header = ",".join(RAW_COLUMNS)
    path.write_text(
        header + "\n" + "{'$oid': 'ab'},r1,p1,n,\"[1, 2]\",\"two\nlines, \"\"quoted\"\"\",5,s,1388534400,\"01 1, 2014\",c,1\n"
        + "x,r2,p2,n,,,4,s,,,c,\n", encoding="utf-8")
    raw_rows = tables.read_raw_reviews(spark, str(path))
    good = tables.good_rows(raw_rows)
    rows = clean_reviews(good).orderBy("reviewerID").collect()
    assert [r.reviewText for r in rows] == ['two\nlines, "quoted"', None]
    assert rows[0].source_file == "A.csv" and rows[0].helpful_ratio == 0.5
    assert one(audit.line_delta(spark, str(path), RAW_COLUMNS))["delta"] == 1
    ordered = tables.read_in_order(spark, [str(path), str(path)])
    assert ordered.select("source_rank").distinct().count() == 2
    out = str(tmp_path / "by_category")
    sinks.write_by_category(clean_reviews(good), out)
    assert spark.read.parquet(out).filter("category = 'c'").count() == 2
    sinks.write_csv_sample(good.select("source_file", "reviewerID", "row_pos"), str(tmp_path / "s"), ["source_file"], ["row_pos"], 1)
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).collect()[0].reviewerID == "r1"
    presence = audit.schema_presence(spark, {"a": good, "b": good.drop("class")})
    assert presence.filter("column = 'class' AND NOT present").count() == 1


def test_missing_columns_of_a_file_family(spark):
    r = one(clean_reviews(raw(spark).drop("_id", "summary", "class")))
    assert (r["mongo_id"], r["summary"], r["summary_missing"], r["class_missing"], r["category"]) == (None, None, 1, 1, None)


def test_wide_projections_stay_small_enough_to_be_compiled(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
