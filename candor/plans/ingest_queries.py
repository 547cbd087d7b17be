"""Queries of the ingestion column jobs and the historical lookup.

URLs, pages and payloads are built by Spark from the given tables, one per part or document, so the
jobs run on whole tables; the SQL states the expected result straight from the same tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from candor.operators import features, history, pages, payloads, products, urls
from candor.plans.batch_queries import PRODUCT_FEATURES_SQL, REVIEW_FEATURES_SQL
from candor.plans.catalog import big, r6, register
from candor.plans.views import LIVE_SQL, REVIEWS_SQL, live_reviews, reviews, table

# ---- URLs ---------------------------------------------------------------------------------------
# (url, platform, listing page, product id, normalized url); {a} is the part's 10-character id and {n}
# a number made from its key. None stands for NULL.
_SAME = object()
FORMS = [
    ("https://www.amazon.in/dp/{a}?utm_source=x&tag=store&pid=KEEP", "amazon", False, "{a}", "https://www.amazon.in/dp/{a}"),
    ("https://www.amazon.com/some-title/dp/{a}/ref=sr_1_1", "amazon", False, "{a}", "https://www.amazon.com/dp/{a}"),
    ("https://m.amazon.in/gp/aw/d/{a}", "amazon", False, "{a}", "https://www.amazon.in/dp/{a}"),
    ("https://www.amazon.in/mh/?_encoding=UTF8&ref_=nav&s={a}", "amazon", False, "{a}", "https://www.amazon.in/dp/{a}"),
    ("https://www.amazon.com/s?k=coffee+{n}", "amazon", True, None, _SAME),
    ("https://www.amazon.com/gp/offer-listing/{a}", "amazon", True, None, _SAME),
    ("https://www.flipkart.com/foo-bar-set/p/itm{n}abcd?pid=swd{n}&ref=x", "flipkart", False, "SWD{n}",
     "https://www.flipkart.com/foo-bar-set/p/itm{n}abcd?pid=swd{n}"),
    ("https://dl.flipkart.com/s/oAzt{n}", "flipkart", False, None, _SAME),
    ("https://www.myntra.com/kurtas/brand/name/{n}/buy", "myntra", False, "{n}", _SAME),
    ("https://www.nykaa.com/lipstick/p/{n}", "nykaa", False, "{n}", _SAME),
    ("https://www.meesho.com/pretty-kurti/p/1k{n}", "meesho", False, "1k{n}", _SAME),
    ("https://www.ajio.com/brand-kurta/p/{n}049_navy", "ajio", False, "{n}049_navy", _SAME),
    ("https://www.croma.com/speaker/p/{n}", "croma", False, "{n}", _SAME),
    ("https://www.reliancedigital.in/product/samsung-soundbar-mc8rpk-{n}", "reliance_digital", False, "{n}", _SAME),
    ("https://www.tatacliq.com/kurti/p-mp000{n}", "tata_cliq", False, "mp000{n}", _SAME),
    ("https://www.meesho.com/women-kurtis/pl/3j{n}", "meesho", True, None, _SAME),
    ("https://www.ajio.com/find/Green-Kurta-{n}", "ajio", True, None, _SAME),
    ("https://www.reliancedigital.in/c/audio-{n}", "reliance_digital", True, "{n}", _SAME),
    ("not a url {n}", "unsupported", False, None, None),
    ("example.com/x/{n}#frag", "unsupported", False, None, "https://example.com/x/{n}"),
    ("  http://shop{n}.example.org/a/?utm_medium=q&x=1&fbclid=z  ", "unsupported", False, None, "http://shop{n}.example.org/a/?x=1"),
    ("https://www.amazon.in/ap/signin?x={n}", "amazon", True, None, _SAME),
    ("https://www.nykaafashion.com/dress/p/{n}?gclid=1", "nykaa", False, "{n}", "https://www.nykaafashion.com/dress/p/{n}"),
    ("https://www.amazon.in/foo?pd_rd_i={a}", "amazon", False, "{a}", "https://www.amazon.in/dp/{a}"),
]


def _choose(values):
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, t in enumerate(values):
        out = out.when(F.col("form") == i, F.replace(F.replace(F.lit(t), F.lit("{a}"), F.col("a")), F.lit("{n}"), F.col("n")))
    return out


def url_requests(spark, d):
    """One URL per part, in 24 shapes."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    keyed = p.select(
        k.alias("request_id"), (k % len(FORMS)).alias("form"), (k + 100000).cast("string").alias("n"),
        F.concat(F.lit("B"), F.lpad(k.cast("string"), 9, "0")).alias("a"),
    )
    return keyed.withColumn("url", _choose([f[0] for f in FORMS])).select("request_id", "url")


def _case(values):
    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return f"replace(replace('{v}', '{{a}}', a), '{{n}}', n)"

    return "CASE form " + " ".join(f"WHEN {i} THEN {one(v)}" for i, v in enumerate(values)) + " END"


REQUESTS_SQL = f"""keyed AS (SELECT p_partkey AS request_id, p_partkey % {len(FORMS)} AS form, (p_partkey + 100000)::VARCHAR AS n,
  'B' || lpad(p_partkey::VARCHAR, 9, '0') AS a FROM part),
detected AS (SELECT request_id, {_case([f[0] for f in FORMS])} AS url, {_case([f[1] for f in FORMS])} AS platform,
  {_case([f[2] for f in FORMS])} AS listing_page, {_case([f[3] for f in FORMS])} AS catalog_product_id,
  {_case([f[0] if f[4] is _SAME else f[4] for f in FORMS])} AS normalized_url FROM keyed)"""


@register(
    "url_detection",
    f"""WITH {REQUESTS_SQL} SELECT request_id, url, platform, listing_page, catalog_product_id, normalized_url,
 normalized_url IS NOT NULL AS valid_url FROM detected""",
)
def _(spark, d):
    return urls.detect(url_requests(spark, d)).drop("host")


_BASE = "regexp_replace(url, '#.*$', '')"


@register(
    "page_url_normalization",
    f"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_BASE}, '([?&])(ref=x|utm_source=feed)', '\\1'),
  '[?&]+$', ''), '&+', '&', 'g'), '[?]&', '?') AS normalized_url,
 regexp_replace(regexp_replace(regexp_extract(lower(url), '://([^/?#]*)', 1), '^www[.]', ''), '^m[.]', '') AS host,
 'unsupported' AS platform FROM pages""",
)
def _(spark, d):
    p = urls.detect(table(spark, d, "pages").select("page_id", "url"))
    return p.select("page_id", "normalized_url", "host", "platform")


@register(
    "marketplace_ids",
    f"""WITH {REQUESTS_SQL}, f AS (SELECT keyed.*, url FROM keyed JOIN detected USING (request_id) WHERE platform = 'flipkart')
 SELECT request_id, CASE form WHEN 6 THEN 'SWD' || n END AS pid, CASE form WHEN 6 THEN 'itm' || n || 'abcd' END AS item_id,
 CASE form WHEN 6 THEN 'Foo Bar Set' END AS title, CASE form WHEN 6 THEN 'foo-bar-set' END AS slug, form = 7 AS share_link FROM f""",
)
def _(spark, d):
    flip = urls.detect(url_requests(spark, d)).filter("platform = 'flipkart'")
    return flip.select("request_id", urls.market_ids(F.col("url")).alias("m")).select("request_id", "m.*")


_SLUGS = {
    6: ("Foo Bar Set", "Foo Bar Set"), 8: ("Name", "Kurtas"), 9: ("Lipstick", "Lipstick"), 10: ("Pretty Kurti", "Pretty Kurti"),
    11: ("Brand Kurta", "Brand Kurta"), 12: ("Speaker", "Speaker"),
}


@register(
    "url_slugs",
    f"""WITH {REQUESTS_SQL} SELECT request_id, CASE form {" ".join(f"WHEN {k} THEN '{v[0]}'" for k, v in _SLUGS.items())} END AS title,
 CASE form {" ".join(f"WHEN {k} THEN '{v[1]}'" for k, v in _SLUGS.items())} END AS category
 FROM keyed WHERE form IN ({", ".join(map(str, _SLUGS))})""",
)
def _(spark, d):
    u = url_requests(spark, d).filter((F.col("request_id") % len(FORMS)).isin(list(_SLUGS)))
    return u.select("request_id", urls.slug_title(F.col("url")).alias("title"), urls.slug_category(F.col("url")).alias("category"))


#: Title and category of the other forms as SQL; a piece of ten letters and digits is no title.
_OTHER_SLUGS = {
    1: ("'Ref=Sr 1 1'", "'Some Title'"), 5: ("'Offer Listing'", "NULL"), 7: ("CASE WHEN length(n) <> 6 THEN 'Oazt' || n END", "NULL"),
    13: ("'Samsung Soundbar Mc8Rpk ' || n", "NULL"), 14: ("'P Mp000' || n", "'Kurti'"),
    15: ("CASE WHEN length(n) = 8 THEN 'Women Kurtis' ELSE '3J' || n END", "'Women Kurtis'"),
    16: ("'Green Kurta ' || n", "'Find'"), 17: ("'Audio ' || n", "NULL"), 21: ("'Signin'", "NULL"), 22: ("'Dress'", "'Dress'"),
    23: ("NULL", "'Foo'"),
}
_ALL_SLUGS = {k: tuple(f"'{x}'" for x in v) for k, v in _SLUGS.items()} | _OTHER_SLUGS


@register(
    "url_slugs_all_forms",
    f"""WITH {REQUESTS_SQL} SELECT request_id, CASE form {" ".join(f"WHEN {k} THEN {v[0]}" for k, v in _ALL_SLUGS.items())} END AS title,
 CASE form {" ".join(f"WHEN {k} THEN {v[1]}" for k, v in _ALL_SLUGS.items())} END AS category FROM keyed""",
)
def _(spark, d):
    return url_requests(spark, d).select(
        "request_id", urls.slug_title(F.col("url")).alias("title"), urls.slug_category(F.col("url")).alias("category"))


# ---- Pages --------------------------------------------------------------------------------------


@register(
    "page_titles",
    """WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g'),
  '\\s+', ' ', 'g')) AS t FROM pages)
 SELECT page_id, nullif(trim(regexp_replace(t, '(\\s+\\|\\s+| Price in India| - Buy | Online$).*', '')), '') AS title FROM t""",
)
def _(spark, d):
    return table(spark, d, "pages").select("page_id", pages.title_tag(F.col("html")).alias("title"))


def document_pages(spark, d):
    """A product page per document: meta tags, microdata and a JSON-LD block with the text as a review."""
    doc = table(spark, d, "documents")
    i, body = F.col("doc_id").cast("string"), F.regexp_replace("text", "[<>]", " ")
    review = lambda text, stars, name: F.struct(
        F.lit("Review").alias("@type"), text.alias("reviewBody"), F.struct(stars.alias("ratingValue")).alias("reviewRating"),
        F.struct(name.alias("name")).alias("author"))
    node = F.to_json(F.struct(
        F.lit("http://schema.org/Product").alias("@type"), F.concat(F.lit("Buy Item  "), i, F.lit(" | Shop")).alias("name"),
        F.concat(F.lit("SKU"), i).alias("sku"), F.struct(F.concat(F.lit("Brand "), "lang").alias("name")).alias("brand"),
        F.array(F.struct(F.col("n_chars").cast("string").alias("price"), F.lit("inr").alias("priceCurrency"))).alias("offers"),
        F.struct(F.lit("4.5").alias("ratingValue"), F.col("n_chars").alias("reviewCount")).alias("aggregateRating"),
        F.array(review(body, F.col("n_chars") % 5 + 1, F.concat(F.lit("user "), i)),
                review(F.lit("too short"), F.lit(1).cast("bigint"), F.lit("x"))).alias("review"),
    ))
    html = F.concat(
        F.lit("<html><head><title>Shop Item "), i, F.lit(" Online</title><meta property=\"og:image\" content=\"http://img/"), i,
        F.lit("\"><meta name='product:price:currency' content='Rs.'><meta content=\""), i,
        F.lit("\" property=\"product:price:amount\"><script type=\"application/ld+json\"><!-- x -->"), node,
        F.lit("</script></head><body><span itemprop=\"price\" content=\""), i, F.lit(".5\"></span>"
              "<span content=\"usd\" itemprop=\"priceCurrency\"></span>"
              "<div id=\"customer_review-1\"><a data-hook=\"review-title\"><span>5.0 out of 5 stars</span><span>Title "), i,
        F.lit("</span></a><span data-hook=\"review-body\"><span>"), body, F.lit("</span></span> 4.0 out of 5 stars</div></body></html>"),
    )
    return doc.select("doc_id", F.concat(F.lit("https://www.nykaa.com/item-"), i, F.lit("/p/"), i).alias("url"), html.alias("html"))


_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_TRIMMED = f"trim(text, {_WS})"
_BODY = f"trim(regexp_replace(text, '[<>]', ' ', 'g'), {_WS})"


@register(
    "jsonld_products",
    f"""SELECT doc_id, 'SKU' || doc_id AS product_id, 'Item ' || doc_id AS title, 'Brand ' || lang AS brand, {r6('n_chars', 'price')},
 'INR' AS currency, {r6('4.5', 'rating')}, {big('n_chars', 'review_count')} FROM documents""",
)
def _(spark, d):
    nodes = pages.jsonld_nodes(document_pages(spark, d), ["doc_id"])
    return pages.jsonld_products(nodes, ["doc_id"]).select(
        "doc_id", "product_id", "title", "brand", "price", "currency", "rating", "review_count")


@register(
    "jsonld_reviews",
    f"""SELECT doc_id, 'user ' || doc_id AS reviewer_name, {r6('n_chars % 5 + 1', 'rating')}, {_BODY} AS text FROM documents
 WHERE length({_BODY}) >= 20""",
)
def _(spark, d):
    nodes = pages.jsonld_nodes(document_pages(spark, d), ["doc_id"])
    return pages.jsonld_reviews(nodes, ["doc_id"]).select("doc_id", "reviewer_name", "rating", "text")


@register(
    "page_meta",
    f"""SELECT doc_id, 'http://img/' || doc_id AS image_url, {r6('doc_id', 'price')}, 'INR' AS currency, {r6('doc_id + 0.5', 'micro_price')},
 'USD' AS micro_currency, 'Item ' || doc_id AS title_tag FROM documents""",
)
def _(spark, d):
    html, url = F.col("html"), F.col("url")
    p = document_pages(spark, d).select(
        "doc_id", pages.from_meta(pages.meta_map(html), url).alias("m"), pages.from_microdata(html, url).alias("x"),
        pages.title_tag(html).alias("title_tag"))
    return p.select("doc_id", "m.image_url", "m.price", "m.currency", F.col("x.price").alias("micro_price"),
                    F.col("x.currency").alias("micro_currency"), "title_tag")


_PLAIN = f"trim(regexp_replace(regexp_replace({{0}}, '<[^>]+>', ' ', 'g'), '[\\s\\x0b]+', ' ', 'g'), {_WS})"


@register(
    "review_cards",
    f"""WITH b AS (SELECT doc_id, {_PLAIN.format("regexp_replace(text, '[<>]', ' ', 'g')")} AS text FROM documents)
 SELECT doc_id, text, 'Title ' || doc_id AS title, {r6('5', 'rating')} FROM b WHERE length(text) > 20""",
)
def _(spark, d):
    return pages.review_cards(document_pages(spark, d), ["doc_id"]).select("doc_id", "text", "title", "rating")


@register(
    "product_overlay",
    f"""SELECT doc_id, 'SKU' || doc_id AS product_id, 'Item ' || doc_id AS title, 'Brand ' || lang AS brand, {r6('n_chars', 'price')},
 'http://img/' || doc_id AS image_url, 'jsonld,open_graph,html_title,microdata,url_slug' AS sources FROM documents""",
)
def _(spark, d):
    src = document_pages(spark, d)
    html, url = F.col("html"), F.col("url")
    ld = pages.jsonld_products(pages.jsonld_nodes(src, ["doc_id"]), ["doc_id"])
    packed = ld.select("doc_id", F.struct(*pages.PRODUCT).alias("ld"))
    joined = src.join(packed, "doc_id", "left").select(
        "doc_id", "ld", pages.from_meta(pages.meta_map(html), url).alias("og"),
        pages.product_record(url=url, title=pages.title_tag(html)).alias("tag"), pages.from_microdata(html, url).alias("micro"),
        pages.product_record(url=url, title=urls.slug_title(url), category=urls.slug_category(url)).alias("slug"))
    merged = joined.select("doc_id", pages.overlay([
        ("jsonld", F.col("ld")), ("open_graph", F.col("og")), ("html_title", F.col("tag")), ("microdata", F.col("micro")),
        ("url_slug", F.col("slug"))]).alias("p"))
    return merged.select("doc_id", "p.product_id", "p.title", "p.brand", "p.price", "p.image_url", "p.sources")


# ---- Payloads -----------------------------------------------------------------------------------


def document_payloads(spark, d):
    """A nested search payload and an affiliate payload per document."""
    doc = table(spark, d, "documents")
    i = F.col("doc_id").cast("string")
    asin = F.concat(F.lit("D"), F.lpad(i, 9, "0"))
    first = F.struct(
        F.lit(1).alias("position"), F.col("text"), (F.col("n_chars") % 5 + 1).alias("rating"), F.lit("1,234 people found this").alias("helpful_votes"),
        F.lit("Reviewed in India on January 5, 2024").alias("date"), F.lit(True).alias("verified_purchase"), F.lit("Asha").alias("author"))
    again = F.struct(F.lit(2).alias("position"), F.col("text"), F.lit(1).alias("rating"))
    third = F.struct(F.lit(3).alias("position"), F.lit("").alias("text"), F.concat(F.lit("<b>Only</b> title "), i).alias("title"),
                     F.concat(F.lit("https://x/customer-reviews/R"), i, F.lit("?ref=1")).alias("link"))
    search = F.to_json(F.struct(
        F.struct(F.concat(F.lit("Product "), i).alias("title"), F.when(F.col("doc_id") % 7 == 0, F.lit("OTHER00000")).otherwise(asin).alias("asin"),
                 F.concat(F.lit("Visit the Brand "), "lang", F.lit(" Store")).alias("brand"),
                 F.struct(F.concat(F.lit("₹"), i).alias("raw"), F.col("n_chars").alias("extracted_value")).alias("price")).alias("product_results"),
        F.struct(F.struct(F.struct((F.col("n_chars") % 7 + 1).alias("5 star"), F.lit(2).alias("1 star")).alias("customer_reviews")).alias("summary"),
                 F.struct(F.array(F.struct(F.array(first).alias("top_reviews"))).alias("deep"), F.array(again, again).alias("authors_reviews")
                          ).alias("nested"), F.array(third).alias("reviews")).alias("reviews_information"),
    ))
    affiliate = F.to_json(F.struct(F.struct(
        F.concat(F.lit("PID"), i).alias("productId"), F.concat(F.lit("Thing "), i).alias("title"),
        F.when(F.col("doc_id") % 2 == 0, F.struct(F.col("n_chars").alias("amount"), F.lit("Rs.").alias("currency"))).alias("flipkartSpecialPrice"),
        F.struct((F.col("n_chars") + 10).alias("amount"), F.lit("usd").alias("currency")).alias("maximumRetailPrice"),
        F.concat(F.lit("http://dl.flipkart.com/p/"), i).alias("productUrl"),
        F.struct(F.lit("http://i/2").alias("200x200"), F.lit("http://i/8").alias("800x800")).alias("imageUrls")).alias("productBaseInfoV1")))
    feed = F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("F"), i).alias("id"), F.struct(F.concat(F.lit("u"), i).alias("id"), F.lit("Ravi").alias("name")).alias("profile"),
        (F.col("n_chars") % 5 + 1).alias("rating"), F.col("lang").alias("title"), F.col("text").alias("body"),
        F.struct(F.lit("2024-02-03T04:05:06.000Z").alias("utc")).alias("date"), F.lit(False).alias("verified_purchase"))).alias("reviews")))
    return doc.select("doc_id", asin.alias("asin"), search.alias("payload"), affiliate.alias("affiliate"), feed.alias("feed"))


_DOC_ASIN = "'D' || lpad(doc_id::VARCHAR, 9, '0')"


@register(
    "payload_reviews",
    f"""WITH b AS (SELECT *, nullif({_PLAIN.format('text')}, '') AS t, {_DOC_ASIN} AS asin FROM documents)
 SELECT doc_id, t AS text, NULL::VARCHAR AS title, {r6('n_chars % 5 + 1', 'rating')}, asin || '-1' AS review_id, 'Asha' AS reviewer_name,
  1234::BIGINT AS helpful_votes, TIMESTAMP '2024-01-05' AS review_date, TRUE AS verified_purchase FROM b
 UNION ALL SELECT doc_id, NULL, 'Only title ' || doc_id, NULL::DOUBLE, 'R' || doc_id, NULL, NULL, NULL, NULL FROM b""",
)
def _(spark, d):
    return payloads.nested_reviews(document_payloads(spark, d), ["doc_id"], "asin").drop("product_id")


@register(
    "payload_products",
    f"""SELECT doc_id, {_DOC_ASIN} AS product_id, 'Product ' || doc_id AS title, 'Brand ' || lang AS brand, {r6('n_chars', 'price')}, 'INR' AS currency,
 {r6('round((5 * (n_chars % 7 + 1) + 2)::DOUBLE / (n_chars % 7 + 3), 2)', 'rating')}, {big('n_chars % 7 + 3', 'rating_count')}
 FROM documents WHERE doc_id % 7 <> 0""",
)
def _(spark, d):
    p = document_payloads(spark, d).select(
        "doc_id", payloads.search_product(F.col("payload"), F.col("asin"), F.lit("u"), F.lit("amazon.in")).alias("p")).filter("p IS NOT NULL")
    return p.select("doc_id", *[f"p.{c}" for c in ("product_id", "title", "brand", "price", "currency", "rating", "rating_count")])


@register(
    "feed_reviews",
    f"""SELECT doc_id, 'F' || doc_id AS review_id, 'u' || doc_id AS reviewer_id, 'Ravi' AS reviewer_name, {r6('n_chars % 5 + 1', 'rating')}, lang AS title,
 text, TIMESTAMP '2024-02-03 04:05:06' AS review_date, FALSE AS verified_purchase FROM documents""",
)
def _(spark, d):
    return payloads.feed_reviews(document_payloads(spark, d), ["doc_id"], "feed").drop("helpful_votes")


@register(
    "affiliate_products",
    f"""SELECT doc_id, 'PID' || doc_id AS product_id, 'Thing ' || doc_id AS title,
 {r6('CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE n_chars + 10 END', 'price')}, CASE WHEN doc_id % 2 = 0 THEN 'INR' ELSE 'USD' END AS currency,
 'https://www.flipkart.com/p/' || doc_id AS url, 'http://i/2' AS image_url FROM documents""",
)
def _(spark, d):
    p = document_payloads(spark, d).select("doc_id", payloads.affiliate_product(F.col("affiliate"), F.lit("x"), F.lit("u")).alias("p"))
    return p.select("doc_id", "p.product_id", "p.title", "p.price", "p.currency", "p.url", "p.image_url")


def document_searches(spark, d):
    """A saved search per document: a review page, a product page, a deal and another store's page."""
    doc = table(spark, d, "documents")
    i, pid = F.col("doc_id").cast("string"), (F.col("doc_id") + 100000).cast("string")
    row = lambda link, title, snippet, ext: F.struct(
        link.alias("link"), title.alias("title"), snippet.alias("snippet"), F.struct(F.struct(ext.alias("detected_extensions")).alias("top")).alias("rich_snippet"))
    ext = lambda rating, reviews, price: F.struct(rating.cast("double").alias("rating"), reviews.cast("bigint").alias("reviews"),
                                                  price.cast("double").alias("price_from"), F.lit("₹").alias("currency"))
    none = F.lit(None)
    word = F.lit("The fabric feels comfortable and my order arrived in ")
    rows = F.array(
        row(F.concat(F.lit("https://www.nykaa.com/item/reviews/"), pid), F.lit("Reviews"), F.concat(word, i, F.lit(" days, worth the wait")), ext(none, none, none)),
        row(F.concat(F.lit("https://www.nykaa.com/item/p/"), pid), F.concat(F.lit("Item "), i, F.lit(" by Brand X | Nykaa")), F.lit("Short."),
            ext(F.col("n_chars") % 5, F.lit(300000), F.col("n_chars"))),
        row(F.concat(F.lit("https://www.nykaa.com/item/p/"), pid, F.lit("?x=1")), F.lit("Deal"), F.lit("Hot deal today, free delivery and 60% OFF on everything you need"), ext(none, F.lit(7), none)),
        row(F.concat(F.lit("https://www.other.com/p/"), pid), F.lit("Elsewhere"), F.concat(word, i), ext(none, none, none)),
    )
    return doc.select("doc_id", pid.alias("pid"), F.concat(F.lit("https://www.nykaa.com/item/p/"), pid).alias("url"),
                      F.to_json(F.struct(rows.alias("organic_results"))).alias("payload"))


def _matched(spark, d):
    rows = payloads.search_rows(document_searches(spark, d), ["doc_id", "pid", "url"])
    return rows.filter(payloads.matches_product(F.col("row"), F.lit("nykaa"), F.col("pid"), F.col("url")))


@register(
    "search_reviews",
    """SELECT doc_id, 'The fabric feels comfortable and my order arrived in ' || doc_id || ' days, worth the wait' AS text,
 'https://www.nykaa.com/item/reviews/' || (doc_id + 100000) AS link FROM documents""",
)
def _(spark, d):
    r = _matched(spark, d).select("doc_id", payloads.snippet_review(F.col("row")).alias("text"), "link")
    return r.filter("text IS NOT NULL")


_MARKED = " OR ".join(f"contains(lower({_TRIMMED}), '{m}')" for m in payloads.MARKET_DEAL_WORDS + payloads.JUNK_SNIPPETS)


#: Links of results, by kind: the pid, slug with item id, pid shown elsewhere; then another product, host, half an identity, junk.
_MARKET_LINKS = [
    "https://www.flipkart.com/other-name/p/itm0?pid=PID{n}X", "https://www.flipkart.com/soft-lamp-{n}-x/product-reviews/itm{n}abcd",
    "https://example.com/r", "https://www.flipkart.com/soft-lamp-{m}-x/p/itm{m}abcd?pid=PID{m}X", "https://www.amazon.in/soft-lamp-{n}-x/p/itm{n}abcd?pid=PID{n}X",
    "https://www.flipkart.com/soft-lamp-{n}-x/p/itm{m}abcd", "https://www.flipkart.com/rv/sizechart/p/x?pid=PID{n}X", "https://www.flipkart.com/x/y?pid=PID{n}X",
]
_SHOWN = "www.flipkart.com/p/x?pid=pid{n}x"  # the displayed link of the third kind


def _market_results(spark, d):
    """A requested product page per document, and one saved result that may or may not name the product."""
    doc = table(spark, d, "documents").withColumn("n", (F.col("doc_id") + 100000).cast("string")).withColumn(
        "m", (F.col("doc_id") + 100001).cast("string"))
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{n}"), F.col("n")), F.lit("{m}"), F.col("m"))
    kind = (F.col("doc_id") % len(_MARKET_LINKS)).cast("int")
    link = F.element_at(F.array(*[fill(t) for t in _MARKET_LINKS]), kind + 1)
    page = F.concat(F.lit("https://www.flipkart.com/soft-lamp-"), "n", F.lit("-x/p/itm"), "n", F.lit("abcd?pid=PID"), "n", F.lit("X"))
    requests = doc.select("doc_id", urls.market_ids(page).alias("ids"))
    row = F.try_parse_json(F.to_json(F.struct(
        link.alias("link"), F.when(kind == 2, fill(_SHOWN)).alias("displayed_link"), F.col("text").alias("snippet"))))
    return doc.select("doc_id", row.alias("row")), requests


@register("market_search_matches", f"SELECT doc_id FROM documents WHERE doc_id % {len(_MARKET_LINKS)} IN (0, 1, 2, 6, 7)")
def _(spark, d):
    return payloads.requested_results(*_market_results(spark, d), ["doc_id"]).select("doc_id")


@register(
    "market_search_reviews",
    f"""SELECT doc_id, {_TRIMMED} AS text FROM documents WHERE (doc_id % {len(_MARKET_LINKS)} IN (0, 1, 2)
  OR doc_id % {len(_MARKET_LINKS)} = 7 AND contains(lower(text), 'certified buyer'))
 AND length({_TRIMMED}) >= 40 AND NOT ({_MARKED}) AND NOT starts_with({_TRIMMED}, 'http')""",
)
def _(spark, d):
    met = payloads.requested_results(*_market_results(spark, d), ["doc_id"])
    return met.select("doc_id", payloads.market_snippet_review(F.col("row"), F.col("ids")).alias("text")).filter("text IS NOT NULL")


@register(
    "search_products",
    f"""SELECT doc_id, 'https://www.nykaa.com/item/p/' || (doc_id + 100000) AS url, 'Item ' || doc_id AS title, 'Brand X' AS brand,
 {r6('n_chars', 'price')}, 'INR' AS currency, {r6('n_chars % 5', 'rating')}, 7::BIGINT AS review_count FROM documents""",
)
def _(spark, d):
    return payloads.best_results(_matched(spark, d), ["doc_id"], F.col("url")).drop("image_url")


@register(
    "redacted_documents",
    """SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'serpapi|rainforest|pa-api|paapi|api_key|apikey') THEN '[redacted]' ELSE text END AS text,
 2::BIGINT AS n_keys FROM documents""",
)
def _(spark, d):
    m = F.create_map(F.lit("token"), F.lit("x"), F.lit("my_api_key_id"), F.lit("y"), F.lit("text"), F.col("text"), F.lit("lang"), F.col("lang"))
    r = table(spark, d, "documents").select("doc_id", payloads.redact_map(m).alias("m"))
    return r.select("doc_id", F.col("m")["text"].alias("text"), F.size("m").alias("n_keys"))


@register(
    "preferred_source",
    f"""WITH {LIVE_SQL}, s AS (SELECT product_id, review_id, CASE WHEN verified_purchase THEN 0 WHEN verified_purchase IS NULL THEN 2 ELSE 1 END AS pr FROM live)
 SELECT product_id, review_id FROM s QUALIFY pr = min(pr) OVER (PARTITION BY product_id)""",
)
def _(spark, d):
    v = F.col("verified_purchase")
    r = live_reviews(spark, d).withColumn("source_priority", F.when(v, 0).when(v.isNull(), 2).otherwise(1))
    return payloads.best_source(r, ["platform", "product_id"]).select("product_id", "review_id")


@register(
    "distinct_product_texts",
    f"""WITH {LIVE_SQL} SELECT product_id, text, min(review_id) AS review_id FROM live WHERE text IS NOT NULL GROUP BY ALL""",
)
def _(spark, d):
    from candor.operators.dedup import keep_first

    r = live_reviews(spark, d).filter("text IS NOT NULL").select("product_id", "text", "review_id")
    return keep_first(r, ["product_id", "text"], ["review_id"])


# ---- History and status -------------------------------------------------------------------------


def _requests(spark, d):
    return urls.detect(url_requests(spark, d))


_WANTED = f"""{REQUESTS_SQL}, wanted AS (SELECT DISTINCT catalog_product_id AS id FROM detected WHERE platform = 'amazon' AND catalog_product_id IS NOT NULL)"""


@register(
    "historical_products",
    f"""WITH {REVIEWS_SQL}, {PRODUCT_FEATURES_SQL}, {_WANTED} SELECT asin, {big('review_count', 'review_count')}, {r6('avg_rating', 'avg_rating')}
 FROM pf JOIN wanted ON asin = id""",
)
def _(spark, d):
    found = history.historical_products(_requests(spark, d), features.product_features(reviews(spark, d)))
    return found.select("asin", "review_count", "avg_rating")


@register(
    "historical_review_stats",
    f"""WITH {REVIEWS_SQL}, {REVIEW_FEATURES_SQL}, {_WANTED} SELECT asin, count(*)::BIGINT AS n, {r6('median(rating)', 'median_rating')},
 {r6('avg(review_length_chars)', 'avg_review_length_chars')}, {r6('avg(helpful_votes)', 'avg_helpful_votes')},
 {r6('avg(CASE WHEN is_exact_duplicate_text THEN 1.0::DOUBLE ELSE 0 END)', 'exact_duplicate_share')},
 count(*) FILTER (WHERE text_available)::BIGINT AS n_with_text FROM rf JOIN wanted ON asin = id GROUP BY asin""",
)
def _(spark, d):
    columns = ["asin", "rating", "review_length_chars", "helpful_votes", "is_exact_duplicate_text", "text_available"]
    return history.historical_review_stats(_requests(spark, d), features.review_features(reviews(spark, d), columns=columns))


@register(
    "historical_reviews",
    f"""WITH {REVIEWS_SQL}, {_WANTED} SELECT asin AS product_id, mongo_id AS review_id, "reviewerID" AS reviewer_id, "reviewText" AS text, summary AS title,
 {big('helpful_votes', 'helpful_votes')}, review_datetime_utc AS review_date FROM reviews JOIN wanted ON asin = id""",
)
def _(spark, d):
    return history.historical_reviews(_requests(spark, d), reviews(spark, d)).select(
        "product_id", "review_id", "reviewer_id", "text", "title", "helpful_votes", "review_date")


def _fetched(spark, d):
    """Reviews fetched for each request: every third carries another product's id, every fifth none."""
    r = live_reviews(spark, d)
    k = F.col("product_id").substr(2, 9).cast("bigint")
    last = F.crc32(F.col("review_id").cast("binary"))
    return r.select(k.alias("request_id"), "review_id", F.when(last % 5 == 0, F.lit(None)).when(last % 3 == 0, F.lit("B999999999"))
                    .otherwise(F.lower("product_id")).alias("product_id"))


@register("matching_reviews")
def _(spark, d):
    req = _requests(spark, d).filter("platform = 'amazon' AND catalog_product_id IS NOT NULL")
    return history.matching_reviews(req, _fetched(spark, d))


_STATUS_FLAGS = """CASE WHEN request_id % 2 = 0 THEN 3 ELSE 0 END AS n_live, request_id % 5 = 0 AS fetch_error, request_id % 3 = 0 AS has_title"""


@register(
    "request_status",
    f"""WITH {_WANTED}, st AS (SELECT *, {_STATUS_FLAGS}, platform = 'amazon' AND catalog_product_id IS NOT NULL AND request_id IN
  (SELECT l_partkey FROM lineitem) AS past FROM detected)
 SELECT request_id, CASE WHEN normalized_url IS NULL THEN 'INVALID_URL' WHEN platform = 'unsupported' THEN 'UNSUPPORTED_PLATFORM'
  WHEN listing_page THEN 'INVALID_URL' WHEN n_live > 0 AND past THEN 'LIVE_AND_HISTORICAL' WHEN n_live > 0 THEN 'LIVE' WHEN past THEN 'HISTORICAL'
  WHEN fetch_error AND NOT has_title THEN 'DATA_ACCESS_UNAVAILABLE' ELSE 'CATALOG_ONLY' END AS data_status FROM st""",
)
def _(spark, d):
    req = _requests(spark, d)
    past = reviews(spark, d).groupBy("asin").agg(F.count(F.lit(1)).alias("n_historical"))
    amazon = F.when(F.col("platform") == "amazon", F.col("catalog_product_id"))
    k = F.col("request_id")
    joined = req.withColumn("_asin", amazon).join(past, F.col("_asin") == past["asin"], "left").withColumns({
        "n_historical": F.coalesce("n_historical", F.lit(0)), "n_live": F.when(k % 2 == 0, 3).otherwise(0),
        "fetch_error": k % 5 == 0, "has_title": k % 3 == 0})
    return history.resolve_status(joined).select("request_id", "data_status")


@register(
    "live_and_historical_signals",
    f"""WITH {LIVE_SQL} SELECT product_id, source_kind, count(*)::BIGINT AS n_reviews, count(*)::BIGINT AS n_retrieved
 FROM (SELECT product_id, 'live' AS source_kind FROM live UNION ALL SELECT product_id, 'historical' FROM live) GROUP BY ALL""",
)
def _(spark, d):
    live = history.enrich(products.product_signals(products.prepare(live_reviews(spark, d))), "live")
    past = history.enrich(products.product_signals(products.prepare(history.to_canonical(reviews(spark, d)))), "historical")
    keep = ["product_id", "source_kind", "n_reviews", "n_retrieved"]
    return live.select(*keep).unionByName(past.select(*keep))
