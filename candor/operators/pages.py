"""Product records and reviews from saved HTML pages: title, meta tags, JSON-LD, microdata, review cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.fixed_values import (
    CARD_BODY_PATTERN,
    CARD_START_PATTERN,
    CARD_TITLE_PATTERN,
    CURRENCY_PATTERNS,
    GENERIC_TITLES,
    JSONLD_PATTERN,
    META_ATTRIBUTE_PATTERN,
    META_PATTERN,
    MIN_PAGE_REVIEW_CHARS,
    PRICE_PATTERNS,
    RUPEE_WORDS,
    STARS_PATTERN,
    STORE_TITLE_CUTS,
    TITLE_CUTS,
    TITLE_PATTERN,
)
from candor.functions.columns import blank_to_null, extract, let, to_number, to_whole
from candor.functions.columns import strip_once as strip
from candor.operators.dedup import first_rows

PRODUCT = ["product_id", "url", "title", "brand", "category", "price", "currency", "rating", "rating_count",
           "review_count", "image_url"]


def plain(c: Column) -> Column:
    """Text without tags, white space collapsed; NULL when nothing is left."""
    return blank_to_null(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"(?U)\s+", " "))


def is_generic_title(c: Column) -> Column:
    generic = let(
        F.lower(strip(F.regexp_replace(c, r"(?U)\s+", " "))),
        lambda low: (low == "") | low.isin(GENERIC_TITLES) | low.contains("online electronic shopping")
        | low.contains("online electronics shopping") | low.endswith(" reviews online"),
    )
    return F.coalesce(generic, F.lit(True))


def clean_title(c: Column) -> Column:
    text = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    text = F.regexp_replace(text, r"(?i)^(?:Buy|Shop)\s+", "")
    text = strip(F.get(F.split(text, TITLE_CUTS, 2), F.lit(0)))
    return let(text, lambda t: F.when(~is_generic_title(t), t))


def split_store_title(c: Column) -> Column:
    """(title, brand): a short ` by X` ending is the brand."""
    text = F.regexp_replace(strip(F.regexp_replace(c, r"(?U)\s+", " ")), r"(?i)^(?:Buy|Shop)\s+", "")
    return let(strip(F.get(F.split(text, STORE_TITLE_CUTS, 2), F.lit(0))), _title_and_brand)


def _title_and_brand(text: Column) -> Column:
    halves = F.split(text, r"(?i)\s+by\s+", 2)
    right = F.get(halves, F.lit(1))
    named = F.lower(text).contains(" by ") & (right != "") & (F.size(F.split(strip(right), r"\s+")) <= 4)
    title = F.when(named, strip(F.get(halves, F.lit(0)))).otherwise(text)
    return F.struct(
        F.nullif(title, F.lit("")).alias("title"),
        F.when(named, F.btrim(right, F.lit(" .|-"))).alias("brand"),
    )


def title_tag(html: Column) -> Column:
    return clean_title(F.regexp_replace(extract(html, TITLE_PATTERN), "<[^>]+>", ""))


def meta_map(html: Column) -> Column:
    """Lower-case property or name -> content; the last tag of a name wins."""
    def entry(raw: Column) -> Column:
        keys = F.transform(F.regexp_extract_all(raw, F.lit(META_ATTRIBUTE_PATTERN), F.lit(1)), F.lower)
        values = F.regexp_extract_all(raw, F.lit(META_ATTRIBUTE_PATTERN), F.lit(2))
        value = lambda k: F.get(values, (F.array_position(keys, k) - 1).cast("int"))
        name = F.coalesce(F.nullif(value("property"), F.lit("")), value("name"))
        return F.struct(F.lower(name).alias("key"), strip(value("content")).alias("value"))

    tags = F.transform(F.regexp_extract_all(html, F.lit(META_PATTERN), F.lit(1)), entry)
    return let(F.filter(tags, lambda t: (t["key"] != "") & (t["value"] != "")), _last_by_key)


def _last_by_key(good: Column) -> Column:
    last = F.transform(
        F.array_distinct(F.transform(good, lambda t: t["key"])),
        lambda k: F.struct(k, F.element_at(F.filter(good, lambda t: t["key"] == k), -1)["value"]),
    )
    return F.map_from_entries(last)


def _currency(c: Column) -> Column:
    return F.when(F.upper(c).isin(RUPEE_WORDS), "INR").otherwise(F.upper(c))


def from_meta(metas: Column, url: Column) -> Column:
    """Product record of the Open Graph tags, NULL without title, brand, price and image."""
    return let(F.struct(metas.alias("metas"), url.alias("url")), lambda s: _from_meta(s["metas"], s["url"]))


def _from_meta(metas: Column, url: Column) -> Column:
    pick = lambda *keys: F.coalesce(*[F.nullif(F.try_element_at(metas, F.lit(k)), F.lit("")) for k in keys])
    title, image = clean_title(pick("og:title", "twitter:title", "title")), pick("og:image", "twitter:image")
    brand, price = pick("product:brand", "og:brand"), to_number(pick("product:price:amount", "og:price:amount"))
    record = product_record(
        url=F.coalesce(pick("og:url"), url), title=title, brand=brand, price=price,
        currency=_currency(pick("product:price:currency", "og:price:currency")), image_url=F.when(image.startswith("http"), image),
    )
    return F.when(F.coalesce(title, brand, image).isNotNull() | (price != 0), record)


def product_record(**fields: Column) -> Column:
    types = {"price": "double", "rating": "double", "rating_count": "bigint", "review_count": "bigint"}
    return F.struct(
        *[F.coalesce(fields.get(f, F.lit(None)), F.lit(None)).cast(types.get(f, "string")).alias(f) for f in PRODUCT]
    )


def from_microdata(html: Column, url: Column) -> Column:
    price = to_number(F.coalesce(*[extract(html, p) for p in PRICE_PATTERNS]))
    currency = _currency(F.coalesce(*[extract(html, p) for p in CURRENCY_PATTERNS]))
    return F.when(price.isNotNull() | currency.isNotNull(), product_record(url=url, price=price, currency=currency))


# ---- JSON-LD ------------------------------------------------------------------------------------


def _get(node: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(node, path, kind)


def _types(node: Column) -> Column:
    many = _get(node, "$['@type']", "array<string>")
    one = _get(node, "$['@type']")
    names = F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
    return F.transform(names, lambda t: F.when(t.contains("://"), F.substring_index(t, "/", -1)).otherwise(t))


def jsonld_nodes(pages: DataFrame, key: list[str], html: str = "html") -> DataFrame:
    """(key…, place, node): every object of every JSON-LD block, `@graph` members before their parent."""
    blocks = pages.select(*key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(JSONLD_PATTERN), F.lit(1))).alias("b", "block"))
    parsed = blocks.select(*key, "b", F.try_parse_json(strip(F.regexp_replace("block", "(?s)<!--.*?-->", ""))).alias("v")).filter("v IS NOT NULL")
    v = F.col("v")
    roots = parsed.select(*key, "b", F.posexplode(F.coalesce(_get(v, "$", "array<variant>"), F.array(v))).alias("r", "root"))
    graph = F.coalesce(
        _get(F.col("root"), "$['@graph']", "array<variant>"),
        F.when(_get(F.col("root"), "$['@graph']", "variant").isNotNull(), F.array(_get(F.col("root"), "$['@graph']", "variant"))),
        F.array().cast("array<variant>"),
    )
    nodes = roots.select(*key, "b", "r", F.posexplode(F.concat(graph, F.array("root"))).alias("g", "node"))
    return nodes.filter(F.schema_of_variant("node").startswith("OBJECT")).select(
        *key, F.struct("b", "r", "g").alias("place"), "node", _types(F.col("node")).alias("types"))


def jsonld_products(nodes: DataFrame, key: list[str]) -> DataFrame:
    """The first Product node of each page as a product record."""
    n = F.col("node")
    text = lambda *paths: F.coalesce(*[blank_to_null(_get(n, p)) for p in paths])
    whole = lambda p: F.coalesce(to_whole(_get(n, p)), _get(n, p, "bigint"))
    record = product_record(
        product_id=text("$.sku", "$.productID", "$.mpn"), url=text("$.url"), title=clean_title(_get(n, "$.name")),
        brand=F.coalesce(_get(n, "$.brand.name"), _string(n, "$.brand")), category=_string(n, "$.category"),
        price=to_number(F.coalesce(_get(n, "$.offers[0].price"), _get(n, "$.offers.price"))),
        currency=F.upper(F.coalesce(_get(n, "$.offers[0].priceCurrency"), _get(n, "$.offers.priceCurrency"))),
        rating=to_number(_get(n, "$.aggregateRating.ratingValue")), rating_count=whole("$.aggregateRating.ratingCount"),
        review_count=whole("$.aggregateRating.reviewCount"),
        image_url=F.coalesce(_get(n, "$.image[0].url"), _string(n, "$.image[0]"), _get(n, "$.image.url"), _string(n, "$.image")),
    )
    found = nodes.filter(F.array_contains("types", "Product")).select(*key, "place", record.alias("p"))
    return first_rows(found, key, ["place"], 1).select(*key, "p.*")


def _string(node: Column, path: str) -> Column:
    """The value only where it is a JSON string."""
    v = _get(node, path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", _get(node, path))


def jsonld_reviews(nodes: DataFrame, key: list[str]) -> DataFrame:
    """All published reviews of the pages."""
    n = F.col("node")
    inner = F.coalesce(
        _get(n, "$.review", "array<variant>"),
        F.when(_get(n, "$.review", "variant").isNotNull(), F.array(_get(n, "$.review", "variant"))), F.array().cast("array<variant>"))
    own = F.when(F.array_contains("types", "Review"), F.array(n)).otherwise(F.array().cast("array<variant>"))
    items = nodes.select(*key, "place", F.posexplode(F.concat(own, inner)).alias("i", "r"))
    r = F.col("r")
    body = strip(F.coalesce(F.nullif(_string(r, "$.reviewBody"), F.lit("")), _string(r, "$.description")))
    is_review = F.array_contains(_types(r), "Review") | (F.coalesce(_get(r, "$.reviewBody"), F.lit("")) != "")
    rows = items.filter(is_review & (F.length(body) >= MIN_PAGE_REVIEW_CHARS)).select(
        *key, F.struct("place", "i").alias("place"),
        F.coalesce(blank_to_null(_get(r, "$['@id']")), blank_to_null(_get(r, "$.sku"))).alias("review_id"),
        F.coalesce(_string(r, "$.author.name"), _string(r, "$.author")).alias("reviewer_name"),
        to_number(_get(r, "$.reviewRating.ratingValue")).alias("rating"), _string(r, "$.name").alias("title"), body.alias("text"),
    )
    return rows.drop("place")


# ---- Review cards -------------------------------------------------------------------------------


def review_cards(pages: DataFrame, key: list[str], html: str = "html") -> DataFrame:
    """Reviews of saved review-card HTML: one per distinct body longer than 20 characters."""
    cards = F.split(F.col(html), CARD_START_PATTERN)
    started = F.filter(cards, lambda c: c.rlike('(?i)^(id="customer_review-|data-hook="review")'))
    blocks = pages.select(*key, F.posexplode(F.when(F.size(started) > 0, started).otherwise(F.array(html))).alias("i", "card"))
    bodies = F.transform(F.regexp_extract_all("card", F.lit(CARD_BODY_PATTERN), F.lit(1)), plain)
    titles = F.transform(F.regexp_extract_all("card", F.lit(CARD_TITLE_PATTERN), F.lit(1)), plain)
    rows = blocks.select(
        *key, "i", F.get(F.filter(bodies, lambda b: F.length(b) > 20), F.lit(0)).alias("text"),
        F.get(F.filter(titles, lambda t: ~F.lower(t).contains("out of 5")), F.lit(0)).alias("title"),
        to_number(extract(F.col("card"), STARS_PATTERN)).alias("rating"),
    ).filter("text IS NOT NULL")
    return first_rows(rows, [*key, "text"], ["i"], 1)


# ---- Merging records ----------------------------------------------------------------------------


def overlay(records: list[tuple[str, Column]]) -> Column:
    """Merge product records in priority order: each field from the first record that has it.

    A title that was only guessed from the URL, or is a generic store title, gives way to a later one.
    """
    packed = F.struct(*[r.alias(name) for name, r in records])
    return let(packed, lambda s: _overlay([(name, s[name]) for name, _ in records]))


def _overlay(records: list[tuple[str, Column]]) -> Column:
    def filled(c: Column) -> Column:
        return F.when(c.cast("string") != "", c)

    def title() -> Column:
        real = [
            F.when(~is_generic_title(r["title"]), r["title"]) for name, r in records if name != "url_slug"
        ]
        return F.coalesce(*real, *[filled(r["title"]) for _, r in records])

    fields = {f: F.coalesce(*[filled(r[f]) for _, r in records]) for f in PRODUCT}
    fields["title"] = title()
    guessed = split_store_title(fields["title"])["brand"]
    fields["brand"] = F.coalesce(fields["brand"], guessed)
    sources = F.concat_ws(",", *[F.when(r.isNotNull(), F.lit(name)) for name, r in records])
    return F.struct(*[fields[f].alias(f) for f in PRODUCT], sources.alias("sources"))
