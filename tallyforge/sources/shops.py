"""Product pages of two common shop systems, as landed payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import price, strip_corporate

PICTURES = 8
SHOP_A = "products array<struct<title string, vendor string, product_type string, handle string, body_html string, variants array<struct<price string, sku string>>, images array<struct<src string>>>>"
SHOP_B = "array<struct<name string, slug string, sku string, price string, regular_price string, description string, permalink string, brands array<struct<name string>>, categories array<struct<name string>>, images array<struct<src string>>>>"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _pictures(images: Column) -> Column:
    found = F.filter(F.transform(images, lambda i: i["src"]), lambda s: s.isNotNull() & (s != ""))
    return F.slice(F.coalesce(found, F.array().cast("array<string>")), 1, PICTURES)


def products_json(payloads: DataFrame, payload: str, origin: Column) -> DataFrame:
    """Records of ``{"products": [...]}`` pages: price and stock number of the first variant."""
    p = F.col("p")
    first = F.get(p["variants"], F.lit(0))
    items = payloads.select("*", F.explode(F.from_json(payload, SHOP_A)["products"]).alias("p"))
    return items.select(
        F.coalesce(F.nullif(p["title"], F.lit("")), p["handle"], F.lit("")).alias("machine_name"), strip_corporate(_text(p["vendor"])).alias("brand"), F.coalesce(F.nullif(p["handle"], F.lit("")), p["title"], F.lit("")).alias("model"),
        _text(p["product_type"]).alias("machine_type"), first["price"].try_cast("double").alias("price"), F.lit("USD").alias("currency"), _text(first["sku"]).alias("stock_number"), _pictures(p["images"]).alias("images"),
        F.concat(origin, F.lit("/products/"), _text(p["handle"])).alias("source_url"),
    )


def product_list(payloads: DataFrame, payload: str, origin: Column) -> DataFrame:
    """Records of pages that are lists of products with categories and brands."""
    p = F.col("p")
    items = payloads.select("*", F.explode(F.from_json(payload, SHOP_B)).alias("p"))
    amount = F.coalesce(F.nullif(p["price"], F.lit("")), p["regular_price"])
    return items.select(
        _text(p["name"]).alias("machine_name"), strip_corporate(_text(F.get(p["brands"], F.lit(0))["name"])).alias("brand"), F.coalesce(F.nullif(p["sku"], F.lit("")), p["slug"], F.lit("")).alias("model"),
        _text(F.get(p["categories"], F.lit(0))["name"]).alias("machine_type"), price(amount).alias("price"), _text(p["sku"]).alias("stock_number"), _pictures(p["images"]).alias("images"),
        F.coalesce(F.nullif(p["permalink"], F.lit("")), F.concat(origin, F.lit("/product/"), _text(p["slug"]))).alias("source_url"),
    )
