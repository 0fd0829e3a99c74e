"""Sitemaps: addresses of pages and of further sitemaps."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


def locations(xml: str | None) -> list[tuple[str, bool]]:
    """(address, whether it is a further sitemap); nothing for XML that is broken or declares entities."""
    if not xml or "<!ENTITY" in xml:
        return []
    try:
        root = ElementTree.fromstring(xml.strip().encode())
    except ElementTree.ParseError:
        return []
    out = []
    for element in root:
        kind = element.tag.rpartition("}")[2]
        for child in element:
            if child.tag.rpartition("}")[2] == "loc" and child.text and child.text.strip():
                out.append((child.text.strip(), kind == "sitemap"))
    return out


def parse(files: DataFrame) -> DataFrame:
    """(source, loc, is_sitemap) of files given as (url, xml)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(u, loc, deep) for u, x in zip(b["url"].array, b["xml"].array) for loc, deep in locations(x)]
            yield pd.DataFrame(out, columns=["source", "loc", "is_sitemap"])

    return files.select("url", "xml").where("url is not null").mapInPandas(run, "source string, loc string, is_sitemap boolean")


def collect_urls(files: DataFrame, roots: DataFrame, depth: int = 4) -> DataFrame:
    """(loc) of all pages reached from root sitemaps over at most ``depth`` levels, each once; cycles end by themselves."""
    parsed = cut(parse(files))
    level = roots.select(F.col("url").alias("source")).distinct()
    seen, pages = cut(level), None
    for _ in range(depth + 1):
        here = parsed.join(level, "source")
        found = here.where("not is_sitemap").select("loc")
        pages = found if pages is None else pages.unionByName(found)
        level = cut(here.where("is_sitemap").select(F.col("loc").alias("source")).distinct().join(seen, "source", "left_anti"))
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level))
    return pages.distinct()
