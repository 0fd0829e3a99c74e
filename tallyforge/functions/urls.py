"""Address functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path segments of product pages, of pages to leave out, and file endings.
PRODUCT_SEGMENTS = ["product", "machine", "equipment", "item", "listing", "catalog", "catalogue", "inventory", "shop", "store", "used", "new", "stock", "maschine", "produkt", "macchina", "maquina", "produit", "apparaat"]
SKIP_SEGMENTS = ["cart", "checkout", "account", "login", "register", "signin", "signup", "password", "reset", "admin", "api", "wp-admin", "wp-json", "contact", "about", "privacy", "terms", "faq", "help", "support", "blog", "news", "press", "media", "events", "jobs", "careers", "sitemap", "feed", "rss", "tag", "author", "search"]
SKIP_ENDINGS = ["pdf", "jpg", "jpeg", "png", "gif", "svg", "css", "js", "xml", "zip", "webp", "ico"]
SITEMAP_SEGMENTS = ["product", "machine", "equipment", "maschine", "produit", "prodotto", "maquina", "produkt", "apparaat", "listing", "item", "detail", "used", "gebraucht"]
SITEMAP_EXCLUDED = ["category", "categorie", "tag", "author", "page", "search", "blog", "news", "about", "contact", "cart", "checkout", "account", "login", "register"]

PRODUCT_PATTERN = "(?i)/(" + "|".join(PRODUCT_SEGMENTS) + ")s?"
SKIP_PATTERN = "(?i)/(" + "|".join(SKIP_SEGMENTS) + r")|\.(" + "|".join(SKIP_ENDINGS) + r")(\?|$)"
ENGLISH_PATTERN = r"(?i)(/en/|/en$|\blang=en\b|[?&]language=en)"
SITEMAP_PRODUCT_PATTERN = "(?i)/(" + "|".join(SITEMAP_SEGMENTS) + ")s?/"
SITEMAP_EXCLUDED_PATTERN = "(?i)/(" + "|".join(SITEMAP_EXCLUDED) + ")/"


def cleaned(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def authority(url: Column) -> Column:
    """Host with port, lower case; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def host_key(host: Column) -> Column:
    """Host without a leading www. or m."""
    return F.regexp_replace(F.lower(F.trim(host)), r"^(www\.|m\.)", "")


def path(url: Column) -> Column:
    """The path, empty where there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_pattern(url: Column) -> Column:
    """The path with {slug} for segments that hold a digit or a hyphen or are long."""
    trimmed = F.regexp_replace(path(url), "/+$", "")
    slugged = F.transform(F.split(trimmed, "/"), lambda s: F.when(s.rlike("[0-9-]") | (F.length(s) > 20), "{slug}").otherwise(s))
    return F.array_join(slugged, "/")


def is_product(url: Column, pattern: str = PRODUCT_PATTERN) -> Column:
    return path(url).rlike(pattern)


def page_address(current: Column, number: Column) -> Column:
    """The address of another page of a listing: its page parameter or segment changed, or a parameter added."""
    n = number.cast("string")
    asked, stepped = current.rlike("[?&]page="), current.rlike("/page/[0-9]+")
    as_asked = F.concat(F.regexp_extract(current, "^(.*?[?&]page=)", 1), n, F.regexp_extract(current, "[?&]page=[^&#]*(.*)$", 1))
    as_stepped = F.concat(F.regexp_extract(current, "^(.*?/page/)", 1), n, F.regexp_extract(current, "/page/[0-9]+(.*)$", 1))
    added = F.concat(current, F.when(current.contains("?"), "&page=").otherwise("?page="), n)
    return F.when(asked, as_asked).when(stepped, as_stepped).otherwise(added)


def is_skipped(url: Column) -> Column:
    return path(url).rlike(SKIP_PATTERN)


def is_english(url: Column) -> Column:
    return url.rlike(ENGLISH_PATTERN)


def is_sitemap_product(url: Column) -> Column:
    """What a sitemap lists as a product page; exclusion goes first."""
    return ~url.rlike(SITEMAP_EXCLUDED_PATTERN) & url.rlike(SITEMAP_PRODUCT_PATTERN)


def link_score(url: Column, base: Column) -> Column:
    """0 for pages to leave out and other hosts, else 1, with 10 for product paths and 5 for English ones."""
    same = host_key(authority(url)) == host_key(authority(base))
    score = 1 + F.when(is_product(url), 10).otherwise(0) + F.when(is_english(url), 5).otherwise(0)
    return F.when(is_skipped(url) | ~F.coalesce(same, F.lit(False)), 0).otherwise(score)


def site_name(url: Column) -> Column:
    """A display name from an address: the host's first label with its hyphens as spaces, in title case."""
    from .text import title_case

    label = F.element_at(F.split(F.trim(host_key(authority(url))), r"\."), 1)
    return title_case(F.regexp_replace(label, "[-_]+", " "))


def absolute(href: Column, base: Column) -> Column:
    """An http(s) address of a link on a page, without fragment; null for anchors, mail, scripts and the like."""
    h = F.regexp_replace(F.trim(href), r"#.*$", "")
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"[^/]*$", "")
    folder = F.when(F.length(folder) <= F.length(origin), F.concat(origin, F.lit("/"))).otherwise(folder)
    joined = (
        F.when(h.rlike("(?i)^https?://"), h)
        .when(h.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z]+:)", 1), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), h))
        .when((h == "") | h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(folder, h))
    )
    for _ in range(4):
        joined = F.regexp_replace(F.regexp_replace(joined, r"/\./", "/"), r"(?<![:/])/[^/]+/\.\./", "/")
    return joined
