"""URL columns: normalise, detect the store, tell product pages from listings, read product ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.fixed_values import (
    ASIN_PATH_PATTERN,
    ASIN_QUERY_KEYS,
    GENERIC_SEGMENTS,
    GENERIC_SLUGS,
    HOST_FRAGMENTS,
    NON_PRODUCT_PATHS,
    STORE_ID_PATTERNS,
    TRACKING_KEYS,
    TRACKING_PREFIXES,
)
from candor.functions.columns import extract, let
from candor.functions.columns import strip_once as strip

PARTS = r"^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _with_scheme(url: Column) -> Column:
    return let(url, lambda u: F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u)))


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(_with_scheme(url), PARTS, group)


def path_of(url: Column) -> Column:
    return _part(url, 3)


def path_parts(url: Column) -> Column:
    return F.filter(F.split(path_of(url), "/"), lambda p: p != "")


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def query_pairs(url: Column) -> Column:
    """Decoded (key, value) pairs of the query, in order, blank values kept."""
    pieces = F.filter(F.split(_part(url, 4), "&"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            _decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("key"), _decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("value")
        ),
    )


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _clean_query(url: Column) -> Column:
    """The query without tracking parameters, encoded again."""
    kept = F.filter(
        query_pairs(url),
        lambda p: ~let(F.lower(p["key"]), lambda k: k.isin(TRACKING_KEYS) | _any([k.startswith(x) for x in TRACKING_PREFIXES])),
    )
    return F.concat_ws("&", F.transform(kept, lambda p: F.concat(_encode(p["key"]), F.lit("="), _encode(p["value"]))))


def _rebuild(full: Column) -> Column:
    path = F.coalesce(F.nullif(F.regexp_extract(full, PARTS, 3), F.lit("")), F.lit("/"))
    query = let(_clean_query(full), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    host = strip(F.regexp_extract(full, PARTS, 2))
    return F.when(
        host.contains("."), F.concat(F.regexp_extract(full, PARTS, 1), F.lit("://"), host, path, query)
    )


def normalize(url: Column) -> Column:
    """Cleaned URL without fragment and tracking parameters; NULL when it is not a web address."""

    def from_text(text: Column) -> Column:
        known = text.startswith("http://") | text.startswith("https://")
        full = F.when(known, text).otherwise(F.concat(F.lit("https://"), F.regexp_replace(text, "^/+", "")))
        return F.when((text != "") & (known | ~text.contains(" ")), let(full, _rebuild))

    return let(strip(F.regexp_replace(url, "[\\r\\n]", "")), from_text)


def host_of(url: Column) -> Column:
    """Lower-case host without `www.` and a mobile `m.`."""
    return let(
        F.regexp_replace(F.lower(_part(url, 2)), r"^www\.", ""),
        lambda h: F.when(h.startswith("m.") & (F.regexp_count(h, F.lit(r"\.")) >= 2), F.substr(h, F.lit(3))).otherwise(h),
    )


def platform_of(host: Column) -> Column:
    """The store of a host: the first rule whose fragment it contains."""
    rules = F.array(*[F.struct(F.lit(f).alias("part"), F.lit(p).alias("platform")) for f, p in HOST_FRAGMENTS])
    found = let(host, lambda h: F.get(F.filter(rules, lambda r: h.contains(r["part"])), F.lit(0))["platform"])
    return F.when(host.isNotNull(), F.coalesce(found, F.lit("unsupported")))


def _clean_path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(path_of(url)), "/+$", ""), F.lit("")), F.lit("/"))


def _under(path: Column, roots: list[str]) -> Column:
    return _any([(path == r) | path.startswith(r + "/") for r in roots])


def is_listing(url: Column) -> Column:
    """Search, category, home, cart and login pages."""
    parts = F.struct(_clean_path(url).alias("path"), F.lower(_part(url, 4)).alias("query"), F.lower(_part(url, 2)).alias("host"))
    return let(parts, lambda p: _listing(p["path"], p["query"], p["host"]))


def _listing(path: Column, query: Column, host: Column) -> Column:
    share = host.contains("flipkart.com") & path.rlike("/s/[a-z0-9]{5,}$")
    listing = _any(
        [
            path == "/", _under(path, NON_PRODUCT_PATHS), path == "/s", path.startswith("/s/ref"),
            _under(path, ["/search", "/b", "/stores", "/mh"]), path.startswith("/gp/search"), path.startswith("/gp/bestsellers"),
            path.startswith("/gp/new-releases"), path.startswith("/catalog/search"), path.contains("/clp/"),
            path.contains("/pl/"), path.contains("/find/"), path.rlike(r"/s/[a-z0-9-]+-\d+"), path.startswith("/c/"),
            path.startswith("/collection/"),
            (query.contains("k=") | query.contains("field-keywords=")) & ~path.contains("/dp/") & ~path.contains("/p/"),
        ]
    )
    return ~share & listing


def looks_like_asin(c: Column) -> Column:
    return strip(c).rlike("^[A-Za-z0-9]{10}$")


def _query_asin(url: Column, keys: list[str]) -> Column:
    hits = F.filter(query_pairs(url), lambda p: looks_like_asin(p["value"]) & F.lower(p["key"]).isin(keys))
    return F.upper(strip(F.get(hits, F.lit(0))["value"]))


def asin_of(url: Column) -> Column:
    return let(strip(url), _asin)


def _asin(text: Column) -> Column:
    searching = let(_clean_path(text), lambda path: (path == "/s") | path.startswith("/s/"))
    return F.coalesce(
        F.upper(extract(text, ASIN_PATH_PATTERN)), _query_asin(text, ASIN_QUERY_KEYS),
        F.when(~searching, _query_asin(text, ["s"])),
        F.upper(extract(text, r"(?i)[?&]asin=([A-Z0-9]{10})(?:[&#]|$)")),
    )


def marketplace(url: Column) -> Column:
    return let(
        host_of(url),
        lambda h: F.when(h.startswith("amazon."), h).when(h.endswith(".amazon.com"), "amazon.com").when(h != "", h)
        .otherwise("amazon.com"),
    )


def canonical_url(url: Column) -> Column:
    return F.concat(F.lit("https://www."), marketplace(url), F.lit("/dp/"), asin_of(url))


def store_product_id(platform: Column, url: Column) -> Column:
    """The store's own product id, by its URL shape."""
    seen = F.struct(platform.alias("platform"), url.alias("url"), path_of(url).alias("path"), path_parts(url).alias("parts"))
    return let(seen, lambda s: _store_id(s["platform"], s["url"], s["path"], s["parts"]))


def _store_id(platform: Column, url: Column, path: Column, parts: Column) -> Column:
    p = STORE_ID_PATTERNS
    find = lambda name: extract(path, p[name])
    last = F.try_element_at(parts, F.lit(-1))
    digits = F.try_element_at(F.filter(parts, lambda x: x.rlike(r"^\d{5,}$")), F.lit(-1))
    by_query = F.get(
        F.filter(query_pairs(url), lambda q: F.lower(q["key"]).isin("productid", "pid", "sku") & (q["value"] != "")), F.lit(0)
    )["value"]
    electronics = F.coalesce(
        find("p_number"), extract(last, p["dashed_number"]),
        F.when(F.lower(F.get(parts, F.lit(0))) == "product", last), find("p_token"),
    )
    return (
        F.when(platform == "amazon", asin_of(url))
        .when(platform == "flipkart", F.upper(extract(url, p["query_pid"])))
        .when(platform == "myntra", F.coalesce(find("myntra_buy"), digits))
        .when(platform == "nykaa", find("p_number"))
        .when(platform == "meesho", find("meesho"))
        .when(platform == "ajio", F.coalesce(find("ajio_style"), find("p_token")))
        .when(platform.isin("croma", "reliance_digital"), electronics)
        .when(platform == "tata_cliq", F.coalesce(F.concat(F.lit("mp"), find("tata")), by_query, find("p_token")))
    )


def detect(df: DataFrame, url: str = "url") -> DataFrame:
    """Add normalized_url, host, platform, listing_page and product_id to a table of URLs."""
    raw = F.col(url)
    df = df.withColumn("_normal", normalize(raw))
    df = df.withColumn("host", host_of(F.col("_normal"))).withColumn("platform", F.coalesce(platform_of(F.col("host")), F.lit("unsupported")))
    amazon = F.col("platform") == "amazon"
    df = df.withColumn("_asin", F.when(amazon, F.coalesce(asin_of(raw), asin_of(F.col("_normal")))))
    supported = F.col("platform") != "unsupported"
    product_page = F.col("_asin").isNotNull() & ~_under(F.lower(path_of(F.col("_normal"))), NON_PRODUCT_PATHS)
    canonical = F.concat(F.lit("https://www."), marketplace(raw), F.lit("/dp/"), F.col("_asin"))
    return df.withColumns(
        {
            "valid_url": F.col("_normal").isNotNull(),
            "listing_page": supported & is_listing(F.col("_normal")) & ~product_page,
            "normalized_url": F.when(product_page, canonical).otherwise(F.col("_normal")),
            "catalog_product_id": F.coalesce(
                F.col("_asin"), F.when(supported & ~amazon, F.coalesce(
                    store_product_id(F.col("platform"), raw), store_product_id(F.col("platform"), F.col("_normal"))))),
        }
    ).drop("_normal", "_asin")


def market_ids(url: Column) -> Column:
    """(pid, item_id, title guess, slug, share link) of a marketplace URL."""
    return let(F.struct(url.alias("url"), path_parts(url).alias("parts")), lambda s: _market(s["url"], s["parts"]))


def _market(url: Column, parts: Column) -> Column:
    p = STORE_ID_PATTERNS
    n = F.size(parts)
    pid, item = F.upper(extract(url, p["query_pid"])), F.lower(extract(url, p["item"]))
    before_p = F.when((n >= 2) & (F.try_element_at(parts, F.lit(-2)) == "p"),
                      F.coalesce(F.try_element_at(parts, F.lit(-3)), F.get(parts, F.lit(0))))
    title = F.when(~F.lower(before_p).isin(GENERIC_SLUGS), F.nullif(F.initcap(strip(F.replace(before_p, F.lit("-"), F.lit(" ")))), F.lit("")))

    def before(word: str) -> Column:
        at = F.array_position(parts, word)
        return F.lower(F.when(at >= 2, F.get(parts, (at - 2).cast("int"))))

    def good(c: Column) -> Column:
        return F.when(~c.isin(GENERIC_SLUGS) & (F.length(c) > 4), c)

    share = (
        F.lower(_part(url, 2)).contains("flipkart.com") & pid.isNull() & item.isNull() & path_of(url).rlike(p["share"])
    )
    return F.struct(
        pid.alias("pid"), item.alias("item_id"), title.alias("title"),
        F.coalesce(good(before("p")), good(before("product-reviews"))).alias("slug"), share.alias("share_link"),
    )


def _title_case(text: Column) -> Column:
    """A capital at the start of every run of letters, also after digits and signs, and small letters elsewhere."""
    runs = F.split(text, r"(?<=[^\p{Lu}\p{Ll}\p{Lt}])(?=[\p{Lu}\p{Ll}\p{Lt}])")
    return F.array_join(F.transform(runs, F.initcap), "")


def slug_title(url: Column) -> Column:
    """Title guessed from the last meaningful path segment."""
    return let(path_parts(url), _slug_title)


def _slug_title(parts: Column) -> Column:
    n = F.size(parts)
    tail_is_id = (n >= 2) & F.lower(F.try_element_at(parts, F.lit(-2))).isin("p", "buy")
    usable = F.when(tail_is_id, F.slice(parts, 1, F.greatest(n - 1, F.lit(0)))).otherwise(parts)
    good = F.filter(
        usable,
        lambda s: ~(
            F.lower(s).isin(GENERIC_SEGMENTS) | F.lower(s).startswith("itm") | F.lower(s).rlike("^[a-z0-9]{10}$")
            | s.rlike(r"^\d+$") | (F.length(s) < 4)
        ),
    )
    return F.nullif(_title_case(strip(F.regexp_replace(F.try_element_at(good, F.lit(-1)), "[-_]", " "))), F.lit(""))


def slug_category(url: Column) -> Column:
    """Category guessed from the first path segment."""
    head = F.get(path_parts(url), F.lit(0))
    words = strip(F.replace(head, F.lit("-"), F.lit(" ")))
    ok = ~F.lower(words).isin(GENERIC_SEGMENTS) & ~head.rlike(r"^\d+$") & (F.length(words) >= 3)
    return F.when(ok, _title_case(words))
