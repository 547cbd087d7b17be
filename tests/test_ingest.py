import json

from pyspark.sql import functions as F

from candor.operators import history, pages, payloads, urls


def detect(spark, *items):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(items)], "i int, url string")
    return [r.asDict() for r in urls.detect(df).orderBy("i").collect()]


def test_stores_and_ids(spark):
    cases = [
        ("https://www.amazon.in/dp/B0EXAMPLE0", "amazon", "B0EXAMPLE0"),
        ("https://www.myntra.com/kurtas/aurelia/x/33517605/buy", "myntra", "33517605"),
        ("https://www.nykaa.com/m-a-c-powder-kiss-lipstick/p/377929", "nykaa", "377929"),
        ("https://www.meesho.com/pretty-kurti/p/1k2abc", "meesho", "1k2abc"),
        ("https://www.ajio.com/brand-kurta/p/410376049_navy", "ajio", "410376049_navy"),
        ("https://www.croma.com/honeywell-suono-p300/p/311779", "croma", "311779"),
        ("https://www.reliancedigital.in/product/samsung-mc8rpk-9267083", "reliance_digital", "9267083"),
        ("https://www.tatacliq.com/product/p-mp0000000123", "tata_cliq", "mp0000000123"),
        ("https://www.flipkart.com/x/p/itmabc?pid=SWDHGYBKHHHB47PM", "flipkart", "SWDHGYBKHHHB47PM"),
        ("https://www.flipkart.com/camera/p/itm123?pid=B00004Y2MM", "flipkart", "B00004Y2MM"),
        ("https://example.com/x", "unsupported", None),
    ]
    for (url, platform, pid), got in zip(cases, detect(spark, *[c[0] for c in cases])):
        assert (got["platform"], got["catalog_product_id"]) == (platform, pid), url


def test_listings_and_cleaning(spark):
    listing = ["https://www.amazon.in/gp/cart/view.html", "https://www.amazon.com/b?node=172282", "https://www.amazon.com/s/ref=nb?k=shoes",
               "https://www.reliancedigital.in/c/audio", "https://www.amazon.com/gp/offer-listing/B0EXAMPLE0", "https://www.ajio.com/"]
    assert all(r["listing_page"] for r in detect(spark, *listing))
    product = ["https://www.amazon.com/gp/product/B0EXAMPLE0?th=1#customerReviews", "https://dl.flipkart.com/s/oAztvHuuuN",
               "https://www.amazon.in/mh/?_encoding=UTF8&ref_=nav&s=B0EXAMPLE0"]
    got = detect(spark, *product, "not a url", "")
    assert not any(r["listing_page"] for r in got[:3])
    assert got[2]["normalized_url"] == "https://www.amazon.in/dp/B0EXAMPLE0"
    assert [r["valid_url"] for r in got[3:]] == [False, False]
    kept = spark.sql("SELECT 'https://www.x.com/a b?q=1 2&utm_source=z&e=%E2%82%B9*~&blank' AS u").select(urls.normalize(F.col("u"))).collect()[0][0]
    assert kept == "https://www.x.com/a b?q=1+2&e=%E2%82%B9%2A~&blank="


def test_jsonld_page(spark):
    html = """<html><script type="application/ld+json">{"@graph":[{"@type":["Thing","http://schema.org/Product"],"name":"Cotton Kurta Set",
     "brand":"Demo","offers":{"price":"799","priceCurrency":"INR"},"image":["http://i/1"],"aggregateRating":{"ratingValue":"4.2","ratingCount":"12"},
     "review":{"@type":"Review","reviewBody":"The fabric feels comfortable and neat.","reviewRating":{"ratingValue":5},"author":"Asha"}}]}</script>
     <script type="application/ld+json">{broken</script></html>"""
    nodes = pages.jsonld_nodes(spark.createDataFrame([(1, html)], "id int, html string"), ["id"])
    p = pages.jsonld_products(nodes, ["id"]).collect()[0]
    assert (p.title, p.brand, p.price, p.currency, p.rating, p.rating_count, p.image_url) == \
        ("Cotton Kurta Set", "Demo", 799.0, "INR", 4.2, 12, "http://i/1")
    r = pages.jsonld_reviews(nodes, ["id"]).collect()
    assert [(x.rating, x.reviewer_name) for x in r] == [(5.0, "Asha")]


def test_slugs_of_any_form(spark):
    want = {
        "https://www.reliancedigital.in/product/samsung-soundbar-mc8rpk-100013": ("Samsung Soundbar Mc8Rpk 100013", None),
        "https://www.amazon.com/some-title/dp/B000000001/ref=sr_1_1": ("Ref=Sr 1 1", "Some Title"),
        "https://www.amazon.in/dp/B000000001?utm_source=x": (None, None), "not a url 100018": (None, None),
        "  http://shop1.example.org/a/?x=1  ": (None, None), "https://www.meesho.com/women-kurtis/pl/3j100015": ("3J100015", "Women Kurtis"),
    }
    df = spark.createDataFrame([(u,) for u in want], "url string")
    got = df.select("url", urls.slug_title(F.col("url")).alias("t"), urls.slug_category(F.col("url")).alias("c")).collect()
    assert {r["url"]: (r["t"], r["c"]) for r in got} == want


def test_titles(spark):
    cases = {"Buy  Red Shoe | Store": "Red Shoe", "Shop X1 Price in India - Y": "X1", "Access Denied": None, "": None, "Kurta Online": "Kurta"}
    for text, want in cases.items():
        assert spark.range(1).select(pages.clean_title(F.lit(text))).collect()[0][0] == want
    s = spark.range(1).select(pages.split_store_title(F.lit("Lipstick by Mac Cosmetics | Nykaa")).alias("s")).collect()[0].s
    assert (s.title, s.brand) == ("Lipstick", "Mac Cosmetics")


def _value(spark, column):
    return spark.range(1).select(column).collect()[0][0]


def test_small_parsers(spark):
    days = {"2024-01-05": "2024-01-05", "2024-01-05T06:07:08Z": "2024-01-05", "January 5, 2024": "2024-01-05",
            "Reviewed in India on 5": None, "Reviewed in India on January 5, 2024": "2024-01-05", "Jan 5, 2024": "2024-01-05"}
    for text, want in days.items():
        got = _value(spark, payloads.parse_date(F.lit(text)))
        assert (str(got)[:10] if got else None) == want, text
    assert _value(spark, payloads.votes_in(F.lit("1,234 people"))) == 1234
    assert _value(spark, payloads.currency_in(F.lit("₹ 5"))) == "INR" and _value(spark, payloads.currency_in(F.lit("5"))) is None


def test_currency_is_not_guessed(spark):
    load = json.dumps({"product_results": {"title": "No currency", "asin": "B0NOCURR01", "extracted_price": 12.5}})
    df = spark.createDataFrame([(load,)], "payload string").select(
        payloads.search_product(F.col("payload"), F.lit("B0NOCURR01"), F.lit("u"), F.lit("m")).alias("p")).collect()[0].p
    assert df.price == 12.5 and df.currency is None
    other = spark.createDataFrame([(load,)], "payload string").select(
        payloads.search_product(F.col("payload"), F.lit("B0OTHER001"), F.lit("u"), F.lit("m")).alias("p")).collect()[0].p
    assert other is None


def test_statuses_and_identity(spark):
    rows = [(True, "amazon", False, 2, 40, True, False, "LIVE_AND_HISTORICAL"), (True, "amazon", False, 0, 4, False, True, "HISTORICAL"),
            (True, "nykaa", False, 0, 0, False, True, "DATA_ACCESS_UNAVAILABLE"), (True, "nykaa", False, 0, 0, True, True, "CATALOG_ONLY"),
            (True, "ajio", True, 3, 0, True, False, "INVALID_URL"), (False, "unsupported", False, 0, 0, False, False, "INVALID_URL"),
            (True, "unsupported", False, 0, 0, False, False, "UNSUPPORTED_PLATFORM")]
    df = spark.createDataFrame(rows, "valid_url boolean, platform string, listing_page boolean, n_live int, n_historical int, "
                                     "has_title boolean, fetch_error boolean, want string")
    assert history.resolve_status(df).filter("data_status <> want").count() == 0
    req = spark.createDataFrame([(1, "B01")], "request_id int, catalog_product_id string")
    got = spark.createDataFrame([(1, "b01"), (1, None), (1, "B02"), (2, "B01")], "request_id int, product_id string")
    assert history.matching_reviews(req, got).count() == 2


def test_secrets_are_removed(spark):
    m = F.create_map(F.lit("token"), F.lit("x"), F.lit("note"), F.lit("see serpapi docs"), F.lit("ok"), F.lit("fine"))
    assert _value(spark, payloads.redact_map(m)) == {"note": "[redacted]", "ok": "fine"}


def test_results_of_the_requested_marketplace_product(spark):
    ids = F.struct(F.lit("MOBXYZ123").alias("pid"), F.lit("itmabc99").alias("item_id"), F.lit("acme-phone").alias("slug"))
    said = "I bought this two months ago and the battery still lasts two days."
    cases = [
        ("https://www.flipkart.com/other/p/itm1?pid=MOBXYZ123", None, said, True),
        ("https://www.flipkart.com/acme-phone/product-reviews/itmabc99", None, said, True),
        ("https://example.com", "www.flipkart.com/p/?pid=mobxyz123", said, True),
        ("https://www.flipkart.com/acme-phone/p/itmzzz", None, said, False),
        ("https://www.flipkart.com/x/p/itmabc99", None, said, False),
        ("https://www.amazon.in/acme-phone/p/itmabc99?pid=MOBXYZ123", None, said, False),
        ("https://www.flipkart.com/search?pid=MOBXYZ123&x=/p/", None, said, False),
        ("https://www.flipkart.com/x?pid=MOBXYZ123", None, said, False),
        ("https://www.flipkart.com/x?pid=MOBXYZ123", None, said + " Certified Buyer", True),
        (None, None, said, False), ("https://www.flipkart.com/other/p/itm1?pid=MOBXYZ123", None, "short", False),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, link string, displayed_link string, snippet string, ok boolean")
    row = F.try_parse_json(F.to_json(F.struct("link", "displayed_link", "snippet")))
    got = df.select("i", "ok", payloads.market_snippet_review(row, ids).isNotNull().alias("got")).collect()
    assert [r["i"] for r in got if r["ok"] != r["got"]] == []
    none = F.struct(F.lit(None).cast("string").alias("pid"), F.lit("").alias("item_id"), F.lit("").alias("slug"))
    assert df.where(payloads.market_snippet_review(row, none).isNotNull()).count() == 0
