import itertools
import random
import re
from datetime import datetime, timedelta
from difflib import SequenceMatcher

from pyspark.sql import functions as F

import numpy as np
from candor import session
from candor.fixed_values import RISK_FEATURES
from candor.functions.similarity import Block
from candor.functions.skew import attach_by_key
from candor.operators import additive, features, near_copies, products, scoring
from candor.plans import views

LIVE = "platform string, product_id string, review_id string, reviewer_id string, reviewer_name string, rating double, title string, " \
       "text string, helpful_votes int, review_date timestamp, verified_purchase boolean"
DAY0 = datetime(2024, 1, 1)


def live(spark, rows):
    full = []
    for i, r in enumerate(rows):
        base = dict(platform="t", product_id="p", review_id=str(i), reviewer_id=None, reviewer_name=None, rating=None, title=None,
                    text=None, helpful_votes=None, review_date=None, verified_purchase=None)
        base.update(r)
        full.append(tuple(base.values()))
    return products.prepare(spark.createDataFrame(full, LIVE))


def scores(rows):
    t = scoring.score_reviews(rows)
    p = t["products"].collect()[0]
    a = additive.additive_score(t["signals"], products.review_flags(rows, products.product_signals(rows))).collect()[0]
    return t, p, a


def test_golden_components(spark):
    # 8 reviews, six five-star, one four, one two... published: entropy 0.7356, five-star 0.75, mean 4.625, length 509.375
    stars = [5, 5, 5, 5, 5, 5, 4, 3]
    rows = live(spark, [dict(rating=float(s), text=f"{i} " + chr(97 + i) * 507 + "x" * (3 if i < 3 else 0), review_date=DAY0 + timedelta(days=30 * i))
                        for i, s in enumerate(stars)])
    s = products.product_signals(rows).collect()[0]
    assert s.n_reviews == 8 and s.avg_rating == 4.625 and abs(s.rating_std - 0.696) < 1e-3
    assert s.five_star_ratio == 0.75 and abs(s.rating_entropy - 0.7356) < 1e-4
    _, p, _ = scores(rows)
    assert p.review_quality == 100.0 and p.reviewer_reliability is None and p.suspicious_review_risk == 100.0
    assert abs(p.rating_consistency - 54.6367) < 1e-4 and abs(p.review_diversity_activity - 55.8831) < 1e-4
    assert p.product_trust_score == 80 and p.trust_level == "High"


def test_duplicates_give_reasons_and_explanations(spark):
    dup = "This exact template is copied onto many listings for no reason at all."
    rows = live(spark, [dict(rating=5.0, text=dup, reviewer_id="u1"), dict(rating=5.0, text=dup, reviewer_id="u2"),
                        dict(rating=4.0, text="Totally different wording about battery life and fit.", reviewer_id="u3")])
    t, p, _ = scores(rows)
    reasons = [r.reasons for r in t["reviews"].orderBy("review_id").collect()]
    assert reasons == [["unusually repetitive text"], ["unusually repetitive text"], []]
    assert p.product_trust_score is not None and p.explanations


def test_no_reviewer_ids_are_not_invented(spark):
    rows = live(spark, [dict(rating=5.0, text="Long enough unique review about materials and shipping one."),
                        dict(rating=4.0, text="Long enough unique review about materials and shipping two.")])
    t, p, _ = scores(rows)
    assert t["reviewers"].count() == 0 and p.reviewer_reliability is None
    assert t["signals"].collect()[0].near_duplicate_pairs == 1
    assert [r.suspicion_risk for r in t["reviews"].collect()] == [20, 20]


def test_clones_score_below_varied(spark):
    clones = live(spark, [dict(rating=5.0, reviewer_id="same", text="This is the exact same template review used many times for this listing.")] * 10)
    varied = live(spark, [dict(rating=float(i % 5 + 1), reviewer_id=f"u{i}", text=f"Unique opinion number {i} about battery, fit, and price.") for i in range(10)])
    assert scores(clones)[2].score_additive < scores(varied)[2].score_additive


def test_missing_fields_stay_null(spark):
    rows = live(spark, [dict(rating=5.0, text="ok enough text here"), dict(rating=4.0, text="also enough text here")])
    s = products.product_signals(rows).collect()[0]
    assert s.reviewer_diversity is None and s.verified_purchase_share is None and s.review_span_days is None
    lists = products.feature_lists(products.product_signals(rows)).collect()[0]
    assert "review_span_days" not in lists.features_used and any("reviewer_id" in x for x in lists.features_skipped)


def test_platform_does_not_matter(spark):
    rows = [dict(rating=5.0, reviewer_id="u1", text="Unique review text about quality and delivery one."),
            dict(rating=4.0, reviewer_id="u2", text="Unique review text about quality and delivery two.")]
    assert scores(live(spark, [dict(r, platform="a") for r in rows]))[1].product_trust_score == \
        scores(live(spark, [dict(r, platform="b") for r in rows]))[1].product_trust_score


def test_sentiment_is_not_the_rating(spark):
    rows = live(spark, [dict(rating=1.0, text="This product is excellent and I love the quality."), dict(text=None), dict(text="plain words")])
    got = [(r.sentiment_label, r.sentiment_score) for r in scoring.with_sentiment(rows).orderBy("review_id").collect()]
    assert got == [("positive", 1.0), (None, None), ("neutral", 0.0)]


def _texts():
    base = [
        "The stitching is strong and the fabric feels comfortable for daily wear at home",
        "the stitching is strong and the fabric feels comfortable for daily wear at home",
        "The stitching is strong and the fabric feels comfy for daily wear at home",
        "Colour matched the listing and delivery was reasonably quick overall, no complaints",
        "Colour matched the listing and delivery was reasonably quick overall, some complaints",
        "short", "shorts", "short text", "abcdefghijkl", "abcdefghijkm",
    ]
    long = " ".join(f"word{i % 17}{chr(97 + i % 26)}" for i in range(60))
    base += [long, long + " end", long.replace("word3", "lord3", 1), long[20:], "Q " + long]
    return [base[(i * 7) % len(base)] for i in range(45)]


def _brute(texts):
    pairs, near = 0, set()
    for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2):
        if a != b and SequenceMatcher(None, a.lower(), b.lower()).ratio() >= 0.92:
            pairs += 1
            near |= {i, j}
    return pairs, near


def test_near_copies_equal_brute_force(spark):
    texts = _texts()
    pairs, near = _brute(texts)
    assert pairs > 20
    rows = live(spark, [dict(review_id=f"{i:03d}", text=t, review_date=DAY0 + timedelta(hours=i // 3)) for i, t in enumerate(texts)])
    for tile in (256, 3, 1):
        matches = near_copies.near_texts(rows, tile=tile, hot_rows=5)
        assert near_copies.near_pairs(rows, matches).collect()[0].near_duplicate_pairs == pairs, tile
        got = near_copies.with_near_flag(rows, matches, hot_rows=2).filter("near").collect()
        assert {int(r.review_id) for r in got} == near, tile


def test_only_texts_that_may_have_a_near_copy_reach_a_block(spark):
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("etaoinshrdlucmfwyp  jq"), 300)) for _ in range(60)]
    texts[11] = texts[11][:150] + "0123456789" + texts[11][160:]
    texts.append(texts[11][1:-9] + "yes")
    rows = live(spark, [dict(review_id=f"{i:03d}", text=t, review_date=DAY0 + timedelta(hours=i)) for i, t in enumerate(texts)])
    folded = near_copies.distinct_texts(rows).cache()
    for tile in (4, 1):
        sent = near_copies.blocks(folded, 0.92, tile).collect()
        assert {r.text for r in sent} == {texts[11].strip(), texts[60].strip()} and len(sent) == 2, tile
    assert near_copies.near_pairs(rows, near_copies.near_texts(rows, tile=4)).collect()[0].near_duplicate_pairs == 1


def test_the_ratio_is_settled_as_difflib_does(spark):
    rng = random.Random(4)
    texts = _texts() + ["".join(rng.choice("etaoinshrd lu  jqz") for _ in range(n)) for n in (199, 200, 230, 900)]
    texts += [t[:k] + rng.choice("ejq") * rng.randrange(9) + t[k + 5:] for t in texts[-4:] for k in rng.sample(range(190), 9)]
    for autojunk in (True, False):
        block = Block(texts, 0.92, autojunk)
        for i, j in rng.sample(list(itertools.permutations(range(len(texts)), 2)), 400) + [(k, k + 1) for k in range(len(texts) - 36, len(texts) - 1)]:
            want = SequenceMatcher(None, texts[i].lower(), texts[j].lower(), autojunk).ratio() >= 0.92
            assert block.near(i, j) == want
            assert not want or block.share_pieces(np.array([i]), np.array([j]))[0]


def test_one_way_pairs_are_counted_by_order(spark):
    matches = spark.createDataFrame([("t", "p", "a", "b")], "platform string, product_id string, ta string, tb string")
    rows = live(spark, [dict(review_id=f"{i:02d}", text="ab"[i % 2 if i < 6 else 0], review_date=DAY0 + timedelta(hours=8 * i)) for i in range(8)])
    key = lambda c: F.unhex(F.sha2(F.col(c), 256))
    one_way = matches.select("platform", "product_id", key("ta").alias("text_id"), key("tb").alias("other"))
    assert near_copies._ordered_pairs(rows, one_way).collect()[0].pairs == 1 + 2 + 3


def test_hot_keys_give_the_same_join(spark):
    rows = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 'hot', IF(id % 7 = 0, NULL, CAST(id % 50 AS STRING))) AS k")
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    plain = {tuple(r) for r in rows.join(stats, "k", "left").select("id", "k", "n", "s").collect()}
    for hot in (1, 100, 10**9):
        got = attach_by_key(rows, stats, ["k"], "n", ["id"], hot_rows=hot).select("id", "k", "n", "s").collect()
        assert len(got) == 3000 and {tuple(r) for r in got} == plain


def test_feature_tables_do_not_depend_on_the_hot_limit(spark):
    r = views.reviews(spark, "/root/testdata/sf0.001")
    for build in (features.review_features, features.product_features):
        a, b = build(r), build(r, hot_rows=3)
        rounded = lambda df: df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
        assert rounded(a).exceptAll(rounded(b)).count() == 0 and a.count() == b.count()


def test_feature_rows_are_shuffled_once_by_their_number(spark):
    r = views.reviews(spark, "/root/testdata/sf0.001")
    plan = features.review_features(r)._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"Join \w+, \((\w+)#", plan) == ["_row"] * 3 and "Aggregate" not in plan
    few = features.review_features(r, columns=["rating", "review_hour"])
    assert few.columns == ["rating", "review_hour"] and few.exceptAll(features.review_features(r).select("rating", "review_hour")).isEmpty()


def test_shuffle_files_go_with_the_job(spark):
    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = held()
    table = session.stored(session.tune(spark).range(5000).repartition(7, "id"), "numbers")
    assert table.count() == 5000
    assert not held() - before


def test_texts_that_match_only_out_of_order_are_no_candidates():
    words = ["grind", "plate", "mouse", "cable", "short", "light", "brown", "stand", "chair", "clock"] * 30
    a, b = " ".join(words), " ".join(words[150:] + words[:150][::-1])
    block = Block([a, b, a + "!"], 0.92)
    assert block.candidates(0, np.array([1, 2])).tolist() == [2] and block.near(0, 2)
    assert not block.near(0, 1)


def test_review_risk_shuffles_the_reviews_once(spark):
    texts = ["good value, would buy again", "Good value, would buy again", "good value, would buy again!", "bad", None, ""]
    rows = products.prepare(spark.createDataFrame(
        [("amazon", f"P{i % 2}" if i % 3 else None, f"r{i}", f"u{i % 4}", float(1 + i % 5), None, texts[i % 6], i % 7, False, "2024-01-02")
         for i in range(60)], "platform string, product_id string, review_id string, reviewer_id string, rating double, title string, "
        "text string, helpful_votes int, verified_purchase boolean, review_date string"))
    matches = near_copies.near_texts(rows)
    risk = scoring.review_risk(rows, matches=matches)
    step = near_copies.with_near_flag(products.with_copies(rows), matches)
    want = {r["review_id"]: (r["copies"], r["near"]) for r in step.collect()}
    got = risk.select("review_id", *[F.array_contains(F.col("explanations.feature"), RISK_FEATURES[k]).alias(k) for k in ("exact", "near")]).collect()
    assert len(got) == 60
    for r in got:
        copies, near = want[r["review_id"]]
        assert (r["exact"], r["near"]) == ((copies or 0) > 1, near)
    flat = scoring.review_risk(rows, matches=matches.limit(0))._jdf.queryExecution().optimizedPlan().toString()
    with_ids = [line for line in flat.splitlines() if "Join LeftOuter" in line and "_place" in line and "text_id" in line]
    assert len(with_ids) == 1


def test_small_products_are_compared_together_and_once(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "RUN_TEXTS", 20)
    texts = ["note on a thing that works well, grade a", "note on a thing that works well, grade b", "note on a thing that works well, grade A",
             "too short", "quite another text of some length here", None]
    rows = products.prepare(spark.range(1200, numPartitions=8).select(
        F.lit("t").alias("platform"), F.concat(F.lit("p"), F.col("id") % 150).alias("product_id"), F.col("id").cast("string").alias("review_id"),
        F.lit(None).cast("string").alias("reviewer_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("helpful_votes"),
        F.lit(None).cast("double").alias("rating"), F.lit(None).cast("boolean").alias("verified_purchase"),
        F.element_at(F.array(*[F.lit(t) for t in texts]), (F.xxhash64("id") % 6 + 6).cast("int") % 6 + 1).alias("text"),
        F.timestamp_seconds(F.col("id") % 7).alias("review_date")))
    want = {}
    for r in rows.collect():
        n = want.setdefault(r.product_id, {})
        n[r.text] = n.get(r.text, 0) + 1
    notes = lambda n: [n.get(t, 0) for t in texts[:3]]
    pairs = {p: (sum(notes(n)) ** 2 - sum(k * k for k in notes(n))) // 2 for p, n in want.items()}
    matches = near_copies.near_texts(rows)
    got = near_copies.near_pairs(rows, matches)
    assert {r.product_id: r.near_duplicate_pairs for r in got.collect()} == pairs
    assert "MapInPandas" not in got._jdf.queryExecution().toString()  # matched once, not again by every use
