"""Word lists, key lists, weights, thresholds and texts that results depend on.

Everything here is data, not logic. The operators read these names; changing one changes results.
"""

# ---- Fixed values: raw review files -------------------------------------------------------------

RAW_COLUMNS = [
    "_id", "reviewerID", "asin", "reviewerName", "helpful", "reviewText", "overall", "summary",
    "unixReviewTime", "reviewTime", "category", "class",
]
METRIC_COLUMN = "BehaviouralFeatureResult"
LABEL_COLUMN = "label"
METRIC_KEYS = ["CS", "MNR", "RB", "RC", "PR", "NR", "FR", "RSP", "AW", "RD", "RL", "ER", "PC"]
MISSING_WORDS = ["", "nan", "none", "null"]
OID_PATTERN = r"\$oid['\"]?\s*:\s*['\"]([0-9a-fA-F]+)['\"]"
HELPFUL_PATTERN = r"^\[\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\]$"
METRIC_VALUE_PATTERN = r"\s*:\s*([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
VERY_SHORT_BATCH = 5
EARLIEST_UNIX = 788918400
LATEST_UNIX = 1577836800
VERY_LONG_TEXT = 5000
SAMPLE_ROWS_PER_SOURCE = 1500
LABEL_SAMPLE_ROWS = 4000

ANALYSIS_COLUMNS = [
    "source_file", "reviewerID", "asin", "helpful_votes", "helpful_total", "helpful_ratio",
    "reviewText", "text_length", "text_missing", "text_very_short", "summary", "summary_missing",
    "overall", "rating_polarity", "unixReviewTime", "review_datetime_utc", "category", "class_raw",
    "class_missing", "candidate_label",
] + [f"bfr_{k}" for k in METRIC_KEYS]

ML_COLUMNS = [
    "reviewerID", "asin", "category", "overall", "helpful_votes", "helpful_total", "helpful_ratio",
    "reviewText", "text_length", "text_missing", "text_very_short", "summary", "unixReviewTime",
    "review_datetime_utc", "candidate_label",
]

# ---- Fixed values: profiled columns -------------------------------------------------------------

REVIEW_NUMERIC = [
    "rating", "review_length_chars", "review_length_words", "summary_length", "helpful_votes",
    "helpful_total", "helpful_ratio", "product_rating_deviation", "reviewer_rating_deviation",
    "exact_text_copy_count", "review_year", "review_month", "review_day_of_week",
]
REVIEWER_NUMERIC = [
    "review_count", "unique_products", "unique_categories", "avg_rating", "rating_std",
    "rating_range", "review_text_count", "avg_review_length", "median_review_length",
    "helpful_votes_total", "review_span_days", "reviews_per_active_day", "products_per_category",
    "rating_entropy", "extreme_rating_ratio", "five_star_ratio", "one_star_ratio",
    "rating_variance", "average_helpfulness_per_review",
]
PRODUCT_NUMERIC = [
    "review_count", "unique_reviewers", "avg_rating", "rating_std", "rating_range",
    "five_star_ratio", "four_star_ratio", "three_star_ratio", "two_star_ratio", "one_star_ratio",
    "rating_entropy", "avg_helpful_votes", "review_text_coverage", "review_velocity",
    "avg_reviewer_review_count", "avg_reviewer_product_diversity",
    "avg_reviewer_rating_variability",
]
REVIEWER_RANKED = [
    "review_count", "unique_products", "avg_rating", "five_star_ratio", "one_star_ratio",
    "rating_entropy", "extreme_rating_ratio", "reviews_per_active_day", "avg_review_length",
    "average_helpfulness_per_review",
]
PRODUCT_RANKED = [
    "review_count", "unique_reviewers", "avg_rating", "five_star_ratio", "one_star_ratio",
    "rating_entropy", "review_velocity", "avg_helpful_votes", "avg_reviewer_review_count",
    "avg_reviewer_product_diversity",
]
LABEL_MEAN_COLUMNS = [
    "overall", "text_length", "helpful_votes", "bfr_CS", "bfr_MNR", "bfr_RB", "bfr_NR", "class_raw",
]
PROFILE_PROBABILITIES = [0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99]
HIGH_CORRELATION = 0.80

FINITE_CHECK_COLUMNS = {
    "review": ["rating", "helpful_ratio", "product_rating_deviation", "reviewer_rating_deviation"],
    "reviewer": ["avg_rating", "rating_variance", "reviews_per_active_day", "rating_entropy"],
    "product": ["avg_rating", "review_velocity", "rating_entropy", "avg_reviewer_rating_variability"],
}

# ---- Fixed values: review and product scoring ---------------------------------------------------

SHORT_TEXT_CHARS = 20
RATING_DEVIATION = 2.5
MIN_RATED_FOR_DEVIATION = 5
NEAR_DUPLICATE_RATIO = 0.92
MAX_REVIEWS = 50

RISK_POINTS = {"exact": 35, "near": 20, "short": 15, "rating": 15, "helpful": 10}
RISK_REASONS = {
    "exact": "unusually repetitive text",
    "near": "near-duplicate text",
    "short": "very short review text",
    "rating": "abnormal rating behavior",
    "helpful": "excessive helpfulness anomaly",
}
RISK_FEATURES = {
    "exact": "exact_duplicate_text",
    "near": "near_duplicate_text",
    "short": "review_length_chars",
    "rating": "product_rating_deviation",
    "helpful": "helpful_votes",
}
RISK_INTERPRETATIONS = {
    "exact": "Same text hash appears more than once in this live sample.",
    "near": "Sequence similarity ≥ 0.92 with another live review.",
    "short": "Text shorter than 20 characters.",
    "rating": "Rating differs from live product mean by ≥ 2.5 stars.",
    "helpful": "Helpful votes exceed live-sample mean + 2 SD. Exposure-biased; not proof of manipulation.",
}

REVIEWER_REASONS = {
    "five_star": "rating concentration (almost all 5-star in this sample)",
    "burst": "unusual activity pattern (several reviews in under one day in this sample)",
    "volume": "product/reviewer concentration in this listing sample",
}
REVIEWER_MISSING = {
    "rating": "rating",
    "product": "product_id",
    "span": "review_date span (need ≥2 timestamps)",
}

COMPONENT_WEIGHTS = {
    "review_quality": 0.20,
    "rating_consistency": 0.20,
    "reviewer_reliability": 0.20,
    "suspicious_review_risk": 0.25,
    "review_diversity_activity": 0.15,
}
COMPONENT_TITLES = {
    "review_quality": "Review quality",
    "rating_consistency": "Rating consistency",
    "reviewer_reliability": "Reviewer reliability",
    "suspicious_review_risk": "Behavioral consistency",
    "review_diversity_activity": "Review activity",
}
# (score >= 55, score < 45, in between)
COMPONENT_SENTENCES = {
    "review_quality": (
        "Written reviews were detailed enough to support the trust score.",
        "Limited or very short review text reduced the trust score.",
        "Review text quality had a modest effect on the trust score.",
    ),
    "rating_consistency": (
        "Ratings are relatively consistent across the analyzed reviews.",
        "A one-sided or unusually tight rating mix reduced the trust score.",
        "Star-rating mix had a modest effect on the trust score.",
    ),
    "reviewer_reliability": (
        "Reviews came from a varied set of reviewers, which supported trust.",
        "Reviewer patterns in this sample reduced the trust score.",
        "Reviewer patterns had a modest effect on the trust score.",
    ),
    "suspicious_review_risk": (
        "Few behavioral risk indicators were found, which supported the trust score.",
        "Behavioral risk indicators reduced the trust score.",
        "Behavioral risk indicators had a modest effect on the trust score.",
    ),
    "review_diversity_activity": (
        "The number of live reviews was large enough to support the trust score.",
        "A small or tightly clustered review sample reduced the trust score.",
        "Review volume had a modest effect on the trust score.",
    ),
}
SUMMARY_SENTENCES = {
    "repeated": "Several reviews share the same wording, which is a risk indicator.",
    "not_repeated": "Review wording in this sample is not repeated.",
    "varied": "Different reviewers wrote these reviews, which supports reliability.",
    "not_varied": "Fewer distinct reviewers appear in this sample than expected.",
    "no_reviewers": "Reviewer-level evidence was unavailable from this source.",
    "short": "Several reviews show short-text risk indicators.",
    "high": "Several reviews show elevated suspicion-risk indicators.",
    "not_high": "Few reviews in this sample show high suspicion-risk indicators.",
    "positive": "Review sentiment is predominantly positive.",
    "negative": "Review sentiment is predominantly negative.",
    "mixed": "Review sentiment is mixed across the analyzed reviews.",
}

SUMMARY_TITLES = {
    "repeated": "Repeated review text",
    "variety": "Reviewer variety",
    "no_reviewers": "Reviewer evidence",
    "short": "Short-text risk indicators",
    "high": "High suspicion-risk reviews",
    "sentiment": "Review sentiment",
}
SENTIMENT_HEADLINES = {
    "positive": "Overall sentiment: predominantly positive.",
    "negative": "Overall sentiment: predominantly negative.",
    "mixed": "Overall sentiment: mixed.",
}

# (label, detail template) of the additive score's factors
FACTOR_TEXTS = {
    "sample": (
        "Live sample size",
        "%d live review(s) used. Larger samples increase confidence in the pattern summary.",
    ),
    "diversity": ("Reviewer diversity", "Unique reviewers / reviews = %.2f (live sample only)."),
    "no_diversity": (
        "Reviewer diversity unavailable",
        "reviewer_id was not provided by the data source, so concentration was not scored.",
    ),
    "duplicates": (
        "Exact duplicate-text ratio",
        "Share of reviews whose text hash appears more than once: %.2f.",
    ),
    "near": ("Near-duplicate text pairs", "%d pair(s) with sequence similarity ≥ 0.92 (live sample)."),
    "no_near": (
        "Near-duplicate text pairs",
        "No near-duplicate pairs at similarity ≥ 0.92 in the live sample.",
    ),
    "five_star": (
        "High concentration of 5-star reviews",
        "%.0f%% of rated live reviews are 5-star. Common on many stores; treated as a pattern, "
        "not proof of abuse.",
    ),
    "no_five_star": (
        "5-star concentration not extreme",
        "5-star share is %.0f%% in the live rated sample.",
    ),
    "entropy": (
        "Low rating-distribution entropy",
        "Entropy %.2f (normalized %.2f). Ratings are concentrated on few stars.",
    ),
    "no_entropy": (
        "Rating distribution not collapsed",
        "Entropy %.2f (normalized %.2f) over 1–5 stars.",
    ),
    "short": ("Very short average review text", "Mean length %.0f characters."),
    "long": ("Review text length", "Mean length %.0f characters."),
    "burst": (
        "High-risk temporal concentration",
        "%d reviews spanning %.1f days (%.1f per inclusive active day). Potentially coordinated timing "
        "— not proof.",
    ),
    "one_reviewer": (
        "Review concentration on few reviewers",
        "One reviewer accounts for %d of %d live reviews.",
    ),
}

POSITIVE_WORDS = [
    "excellent", "amazing", "great", "good", "love", "loved", "awesome", "perfect",
    "happy", "best", "wonderful", "fantastic", "quality", "recommend", "worth",
    "smooth", "easy", "reliable", "satisfied", "nice", "beautiful", "fast",
    "comfortable", "useful", "impressive", "pleased", "enjoy",
]
NEGATIVE_WORDS = [
    "bad", "poor", "terrible", "awful", "hate", "worst", "broken", "waste",
    "useless", "disappointing", "disappointed", "defect", "defective", "slow",
    "fake", "fraud", "scam", "refund", "return", "cheap", "flimsy", "late",
    "horrible", "issue", "problem", "fail", "failed", "never", "wrong",
]
TOKEN_PATTERN = "([a-z']+)"

SKIPPED_FEATURES = {
    "rating": "rating-based metrics (no ratings on live reviews)",
    "rating_std": "rating_std (need ≥2 ratings)",
    "text": "text/duplicate metrics (no review text)",
    "reviewer": "reviewer diversity / concentration (no reviewer_id)",
    "helpful": "helpful_votes metrics (field unavailable)",
    "verified": "verified_purchase metrics (field unavailable)",
    "dates": "temporal burst metrics (no review_date)",
}

PRODUCT_FIELDS = [
    "platform", "product_id", "url", "title", "brand", "category", "price", "rating",
    "rating_count", "review_count", "image_url",
]
REVIEW_FIELDS = [
    "platform", "product_id", "review_id", "reviewer_id", "reviewer_name", "rating", "title",
    "text", "helpful_votes", "review_date", "verified_purchase",
]

# ---- Fixed values: stores and URLs --------------------------------------------------------------

# Ordered: the first fragment found in the host decides.
HOST_FRAGMENTS = [
    ("amazon.", "amazon"),
    ("amzn.to", "amazon"),
    ("amzn.in", "amazon"),
    ("flipkart.com", "flipkart"),
    ("dl.flipkart.com", "flipkart"),
    ("myntra.com", "myntra"),
    ("nykaa.com", "nykaa"),
    ("nykaafashion.com", "nykaa"),
    ("meesho.com", "meesho"),
    ("ajio.com", "ajio"),
    ("croma.com", "croma"),
    ("reliancedigital.in", "reliance_digital"),
    ("tatacliq.com", "tata_cliq"),
]
TRACKING_KEYS = [
    "ref", "ref_", "tag", "gclid", "fbclid", "mc_cid", "mc_eid", "ie", "qid", "sr", "sprefix",
    "crid", "keywords", "linkcode", "linkid", "camp", "creative", "creativeasin", "ascsubtag",
]
TRACKING_PREFIXES = ["utm_", "pd_rd_", "pf_rd_", "ns_", "spia"]
NON_PRODUCT_PATHS = [
    "/cart", "/gp/cart", "/checkout", "/gp/buy", "/ap/signin", "/login", "/account", "/gp/css",
    "/wishlist", "/gp/registry", "/gp/your-account", "/seller", "/gp/help", "/gp/bestsellers",
    "/gp/new-releases", "/gp/offer-listing", "/gp/aag",
]
ASIN_PATH_PATTERN = (
    r"(?i)(?:/dp/|/gp/product/|/gp/aw/d/|/product-reviews/|/exec/obidos/ASIN/)"
    r"([A-Z0-9]{10})(?:[/?#]|$)"
)
ASIN_QUERY_KEYS = ["asin", "pd_rd_i", "creativeasin"]
STORE_ID_PATTERNS = {
    "query_pid": r"(?i)[?&]pid=([A-Z0-9]+)",
    "myntra_buy": r"(?i)/(\d{5,})/buy(?:/|$|\?)",
    "p_number": r"(?i)/p/(\d{3,})(?:/|$|\?)",
    "p_token": r"(?i)/p/([A-Za-z0-9_-]{4,})(?:/|$|\?)",
    "ajio_style": r"(?i)/p/([0-9]{6,}(?:_[a-z0-9]+)?)",
    "tata": r"(?i)/(?:p-mp|c-mp)([a-z0-9-]+)",
    "meesho": r"(?i)/p/([a-z0-9]{4,})",
    "item": r"(?i)/p/(itm[0-9a-z]{10,})",
    "share": r"(?i)/s/([A-Za-z0-9]{5,})/?$",
    "dashed_number": r"-(\d{5,})$",
}
GENERIC_SLUGS = ["product", "p", "item", "itme", "dl", "rv"]
GENERIC_SEGMENTS = [
    "p", "product", "products", "item", "itme", "dp", "gp", "buy", "www", "en-in", "in", "search",
    "catalog",
]
GENERIC_TITLES = [
    "online shopping site", "flipkart.com", "online electronics shopping", "reliance digital",
    "croma", "ajio", "myntra", "nykaa", "meesho", "tata cliq", "access denied", "page not found",
]
TITLE_CUTS = r"\s+\|\s+| Price in India| - Buy | Online$"
STORE_TITLE_CUTS = (
    r"(?i)\s+\|\s+| Price in India| - Buy |"
    r"\s+[-–]\s+(?:Myntra|Nykaa|Meesho|Ajio|Croma|Reliance Digital|Tata CLiQ)\b"
)
STORE_HOSTS = {
    "myntra": ["myntra.com"],
    "nykaa": ["nykaa.com", "nykaafashion.com"],
    "meesho": ["meesho.com"],
    "ajio": ["ajio.com"],
    "croma": ["croma.com"],
    "reliance_digital": ["reliancedigital.in"],
    "tata_cliq": ["tatacliq.com"],
    "flipkart": ["flipkart.com"],
}
STORE_NAMES = {
    "myntra": ["myntra"],
    "nykaa": ["nykaa"],
    "meesho": ["meesho"],
    "ajio": ["ajio"],
    "croma": ["croma"],
    "reliance_digital": ["reliance digital", "reliancedigital"],
    "tata_cliq": ["tata cliq", "tatacliq"],
    "flipkart": ["flipkart"],
}

# ---- Fixed values: saved pages and payloads -----------------------------------------------------

JSONLD_PATTERN = r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
TITLE_PATTERN = r"(?is)<title[^>]*>(.*?)</title>"
META_PATTERN = r"(?i)<meta\b([^>]+)>"
META_ATTRIBUTE_PATTERN = r"(?i)([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*[\"']([^\"']*)[\"']"
PRICE_PATTERNS = [
    r"(?i)itemprop=[\"']price[\"'][^>]*content=[\"']([^\"']+)[\"']",
    r"(?i)content=[\"']([^\"']+)[\"'][^>]*itemprop=[\"']price[\"']",
]
CURRENCY_PATTERNS = [
    r"(?i)itemprop=[\"']priceCurrency[\"'][^>]*content=[\"']([^\"']+)[\"']",
    r"(?i)content=[\"']([^\"']+)[\"'][^>]*itemprop=[\"']priceCurrency[\"']",
]
RUPEE_WORDS = ["₹", "RS", "RS."]
RUPEE_LABELS = ["₹", "INR", "Rs", "Rs."]
SYMBOL_CURRENCIES = {"$": "USD", "₹": "INR", "£": "GBP", "€": "EUR"}
REVIEW_LIST_KEYS = [
    "authors_reviews", "other_countries_reviews", "top_reviews", "top_positive_reviews",
    "top_critical_reviews", "reviews", "customer_reviews",
]
CARD_START_PATTERN = r"(?i)(?=id=\"customer_review-|data-hook=\"review\")"
CARD_BODY_PATTERN = r"(?is)data-hook=\"review-body\"[^>]*>\s*<span[^>]*>(.*?)</span>"
CARD_TITLE_PATTERN = (
    r"(?is)data-hook=\"review-title\"[^>]*>\s*(?:<span[^>]*>.*?out of 5 stars</span>)?"
    r"\s*<span[^>]*>(.*?)</span>"
)
STARS_PATTERN = r"(?i)(\d(?:\.\d)?)\s+out of\s+5"
SNIPPET_STARS_PATTERN = r"(?i)\b(\d(?:\.\d)?)\s*(?:out of 5|stars?|★)"
INR_PATTERN = r"(?i)(?:₹|Rs\.?|INR)\s*([\d,]+(?:\.\d{1,2})?)"
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "MMMM d, yyyy", "MMM d, yyyy"]
EMBEDDED_DATE_PATTERN = r"([A-Za-z]+ \d{1,2}, \d{4})"
MIN_PAGE_REVIEW_CHARS = 20
MIN_SNIPPET_CHARS = 40
MAX_SNIPPET_REVIEWS = 200_000
DEAL_WORDS = [
    "% off", "hot deal", "free delivery", "in stock", "flash sale", "shop now", "buy now",
]
REVIEW_WORDS = [
    "certified buyer", "i bought", "i purchased", "i used", "my order", "quality is", "fabric",
    "fitting", "delivery", "worth the", "not as shown", "as described", "customer review",
]
MARKET_DEAL_WORDS = ["% off", "₹", "rs.", "hot deal", "free delivery", "in stock"]
JUNK_SNIPPETS = [
    "no information is available", "page not found", "something went wrong", "access denied",
]
MARKET_HOST = "flipkart.com"
MARKET_PRODUCT_PARTS = ["/p/", "/product-reviews/"]
MARKET_NON_PRODUCT = ["/rv/", "sizechart", "/search", "/login", "/account", "/help/"]
PRODUCT_LINK_PARTS = ["/p/", "/buy", "/product/", "/dp/"]
AFFILIATE_IMAGE_SIZES = ["400x400", "200x200", "800x800", "unknown"]
SECRET_KEYS = ["api_key", "apikey", "access_key", "secret_key", "secret", "token", "password"]
SECRET_MARKERS = ["serpapi", "rainforest", "pa-api", "paapi", "api_key", "apikey"]
REDACTED = "[redacted]"
