"""Semi-structured payloads: paths, item arrays, totals, candidate fields, depth-first search."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys that hold the items, the total, and the fields of an item, in order of preference.
ITEM_KEYS = ["data", "results", "items", "products", "machines", "listings", "equipment", "records", "entries"]
TOTAL_KEYS = ["total", "totalCount", "total_count", "count", "totalItems", "total_items", "totalResults", "total_results", "num_found", "numFound", "productCount", "machineCount", "pagination.total", "meta.total"]
FIELD_KEYS = {
    "machine_name": ["title", "name", "machine_name", "product_name", "label"],
    "brand": ["brand", "make", "manufacturer", "hersteller", "marque"],
    "model": ["model", "model_number", "modell", "modelo", "modele"],
    "machine_type": ["type", "category", "machine_type", "typ", "categorie"],
    "price": ["price", "preis", "prix", "prezzo", "precio"],
    "description": ["description", "desc", "details", "beschreibung"],
    "stock_number": ["stock_number", "ref", "sku", "reference", "stock_no"],
    "condition": ["condition", "zustand", "etat", "stato"],
    "year": ["year", "baujahr", "annee", "anno"],
}
URL_KEYS = ["url", "link", "href", "product_url", "machine_url", "permalink", "canonical_url", "page_url", "detail_url"]
SLUG_KEYS = ["slug", "handle", "url_key", "url_slug", "path"]
ID_KEYS = ["id", "ID", "productId", "product_id", "machineId", "machine_id", "sku"]
IMAGE_KEYS = ["images", "photos", "gallery", "bilder", "fotos"]
SPEC_KEYS = ["specs", "specifications", "attributes", "features"]
# How a page's scripts name an endpoint.
ENDPOINT_PATTERNS = [
    r"""(?:fetch|axios\.get|\.get|\.post)\s*\(\s*["'`]([^"'`\s]{5,})["'`]""",
    r"""(?:url|endpoint|apiUrl|baseUrl)\s*[=:]\s*["'`]([^"'`\s]{5,})["'`]""",
    r"""["'`]([^"'`\s]+\.json(?:\?[^"'`\s]*)?)["'`]""",
]
ENDPOINT_NOT = r"(?i)\.(css|png|jpg|svg|ico)"
PRODUCT_KEYS = ["brand", "make", "manufacturer", "model", "price", "machine_name", "title"]


def at(payload: Column, path: str) -> Column:
    """The text at a dotted path, null where there is none or the payload is no JSON."""
    return F.get_json_object(payload, "$." + path)


def items(payload: Column) -> Column:
    """The items of a payload as an array of JSON texts: the payload itself where it is a list, else the first non-empty list under a known key."""
    def rows(x: Column) -> Column:
        variant = F.try_parse_json(x)
        parsed = F.try_variant_get(variant, "$", "array<variant>")
        return F.when(F.size(parsed) > 0, F.transform(parsed, lambda v: F.to_json(v)))
    return F.coalesce(rows(payload), *[rows(F.get_json_object(payload, f"$.{k}")) for k in ITEM_KEYS])


def total(payload: Column) -> Column:
    """The number of items a payload claims, 0 where it claims none."""
    found = F.coalesce(*[F.when(at(payload, k).try_cast("bigint") > 0, at(payload, k).try_cast("bigint")) for k in TOTAL_KEYS])
    return F.coalesce(found, F.lit(0).cast("bigint"))


def field(item: Column, name: str) -> Column:
    """A canonical field of an item: the first candidate key it has."""
    return F.coalesce(*[at(item, k) for k in FIELD_KEYS[name]])


def images(item: Column) -> Column:
    """Picture addresses of an item, given as texts or as objects with url or src; a single address counts as a list of one."""
    def of(key: str) -> Column:
        raw = F.get_json_object(item, f"$.{key}")
        each = F.transform(F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>"), lambda v: F.to_json(v))
        picked = F.transform(each, lambda x: F.coalesce(F.get_json_object(x, "$.url"), F.get_json_object(x, "$.src"), F.when(x.startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), x, F.lit("}")), "$.x"))))
        return F.when(raw.startswith("["), F.filter(picked, lambda x: x.isNotNull())).when(raw.startswith("http"), F.array(raw))
    return F.coalesce(*[of(k) for k in IMAGE_KEYS], F.array().cast("array<string>"))


def specs(item: Column) -> Column:
    """Specifications of an item as a map, given as an object or as a list of name and value."""
    def of(key: str) -> Column:
        raw = F.get_json_object(item, f"$.{key}")
        listed = F.from_json(raw, "array<struct<name string, value string>>")
        named = F.filter(listed, lambda x: x["name"].isNotNull())
        distinct = F.filter(named, lambda x: F.size(F.filter(named, lambda y: y["name"] == x["name"])) == 1)
        return F.when(raw.startswith("{"), F.from_json(raw, "map<string,string>")).when(raw.startswith("["), F.map_from_arrays(F.transform(distinct, lambda x: x["name"]), F.transform(distinct, lambda x: x["value"])))
    return F.coalesce(*[of(k) for k in SPEC_KEYS], F.create_map().cast("map<string,string>"))


def endpoints(source: Column) -> Column:
    """Distinct endpoints that a page's scripts name."""
    found = F.concat(*[F.regexp_extract_all(source, F.lit(p), F.lit(1)) for p in ENDPOINT_PATTERNS])
    return F.filter(F.array_distinct(found), lambda x: ~x.rlike(ENDPOINT_NOT))


def shop_kind(payload: Column) -> Column:
    """Which shop system a payload is from: a list of products under ``products`` with variants, or a bare list with permalinks or categories."""
    wrapped = F.get_json_object(payload, "$.products[0].variants").isNotNull()
    bare = F.get_json_object(payload, "$[0].categories").isNotNull() | F.get_json_object(payload, "$[0].permalink").isNotNull()
    return F.when(wrapped, "products").when(bare, "list").otherwise("none")


def configured(rules: Column, defaults: dict[str, str]) -> Column:
    """Settings of a JSON text over their defaults, as a map; a text that is no object changes nothing."""
    stated = F.coalesce(F.from_json(rules, "map<string,string>"), F.create_map().cast("map<string,string>"))
    named = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.coalesce(F.nullif(F.try_element_at(stated, F.lit(k)), F.lit("")), F.lit(v)))])
    return named


def mapped(item: Column, field_map: dict[str, str], name: str) -> Column:
    """A canonical field by the caller's path for it, else by the known keys."""
    own = [at(item, field_map[name])] if name in field_map else []
    return F.coalesce(*own, field(item, name))


def product_url(item: Column, origin: Column) -> Column:
    """The address of an item: a stated one, one from its slug, one from its id, else empty."""
    stated = [F.when(at(item, k).startswith("http"), at(item, k)).when(at(item, k).startswith("/"), F.concat(origin, at(item, k))) for k in URL_KEYS]
    slug = F.concat(origin, F.lit("/products/"), F.coalesce(*[at(item, k) for k in SLUG_KEYS]))
    by_id = F.concat(origin, F.lit("/products/"), F.coalesce(*[at(item, k) for k in ID_KEYS]))
    return F.coalesce(*stated, slug, by_id, F.lit(""))


def find_products(data: Any, depth: int = 8) -> list[dict]:
    """Depth-first: the first list, two of whose first three entries look like products."""
    if depth < 0:
        return []
    if isinstance(data, list):
        head = [x for x in data[:3] if isinstance(x, dict)]
        if sum(any(k in x for k in PRODUCT_KEYS) for x in head) >= min(2, len(data)) and head:
            return [x for x in data if isinstance(x, dict)]
        children = data
    elif isinstance(data, dict):
        children = list(data.values())
    else:
        return []
    for child in children:
        if got := find_products(child, depth - 1):
            return got
    return []


def find_count(data: Any, depth: int = 6) -> int:
    """Depth-first: the greatest number above 5 that a payload claims under a total key or shows as a list's length."""
    if depth < 0:
        return 0
    best = 0
    if isinstance(data, dict):
        for k, v in data.items():
            if k in TOTAL_KEYS and isinstance(v, int) and not isinstance(v, bool) and v > 5:
                best = max(best, v)
            best = max(best, find_count(v, depth - 1))
    elif isinstance(data, list):
        if len(data) > 5:
            best = len(data)
        for v in data:
            best = max(best, find_count(v, depth - 1))
    return best


def _load(text: str | None) -> Any:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


@F.pandas_udf(T.StructType([T.StructField("n_products", T.IntegerType()), T.StructField("claimed", T.LongType())]))
def search_payload(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Recursive search has no built-in; one Arrow pass."""
    for s in batches:
        data = [_load(x) for x in s]
        yield pd.DataFrame({"n_products": [len(find_products(x)) for x in data], "claimed": [find_count(x) for x in data]})
