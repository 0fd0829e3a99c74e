"""Search over listings: facets, keyword match with synonyms, ordering, paging."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean

KEYWORD_COLUMNS = ("brand", "model", "machine_type", "description", "brand_normalized", "model_normalized", "type_normalized")


@dataclass
class Request:
    """A search request; empty parts do not restrict."""

    query: str = ""
    machine_type: str | None = None
    brand: str | None = None
    location: str | None = None
    price_min: float | None = None
    price_max: float | None = None
    sort_by: str = "relevance"
    page: int = 1
    limit: int = 20
    synonyms: list[str] = field(default_factory=list)


def contains(column: str, text: str) -> Column:
    """Substring match without case; null matches nothing."""
    return F.contains(F.lower(F.col(column)), F.lit(text.lower()))


def facets(r: Request) -> list[Column]:
    out = [F.col("is_active")]
    for column, value in (("type_normalized", r.machine_type), ("brand_normalized", r.brand), ("location", r.location)):
        if value:
            out.append(contains(column, value))
    if r.price_min is not None:
        out.append(F.col("price") >= r.price_min)
    if r.price_max is not None:
        out.append(F.col("price") <= r.price_max)
    return out


def text_tokens(*columns: str) -> Column:
    """Distinct words of some columns, folded, for token search."""
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    return F.array_distinct(F.filter(F.split(clean(joined), "[^a-z0-9]+"), lambda t: t != ""))


def any_phrase(tokens: Column, phrases: list[str]) -> Column:
    """Whether all words of one of the phrases are among the tokens."""
    tests = [F.size(F.array_except(F.array(*[F.lit(w) for w in p.lower().split()]), tokens)) == 0 for p in phrases if p.split()]
    return reduce(or_, tests) if tests else F.lit(False)


def keyword(r: Request) -> Column | None:
    """Substring match of the query in any keyword column, or of a synonym in brand or type."""
    if not r.query.strip():
        return None
    tests = [contains(c, r.query) for c in KEYWORD_COLUMNS]
    tests += [contains(c, s) for s in r.synonyms for c in ("brand", "machine_type")]
    return reduce(or_, [F.coalesce(t, F.lit(False)) for t in tests])


def matches(machines: DataFrame, r: Request) -> DataFrame:
    tests = facets(r)
    if (k := keyword(r)) is not None:
        tests.append(k)
    return machines.where(reduce(and_, tests))


def order(r: Request) -> list[Column]:
    """Ordering with an explicit place for nulls and the id as the last key."""
    if r.sort_by == "price_asc":
        first = F.asc_nulls_last("price")
    elif r.sort_by == "price_desc":
        first = F.desc_nulls_first("price")
    else:
        first = F.desc_nulls_first("created_at")
    return [first, F.asc("id")]


def page(found: DataFrame, r: Request) -> DataFrame:
    """One page; page and limit below one count as one."""
    limit = max(1, r.limit)
    return found.orderBy(*order(r)).offset((max(1, r.page) - 1) * limit).limit(limit)


def total(found: DataFrame, r: Request) -> DataFrame:
    """(total, pages) of a result."""
    limit = max(1, r.limit)
    return found.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / limit).alias("pages"))


def expand(query: str, reference: list[tuple[str, list[str]]]) -> list[str]:
    """Canonical names one of whose synonyms is in the query or has the query in it; an empty query expands to nothing."""
    low = " ".join(query.lower().split())
    if not low:
        return []
    out = [name for name, synonyms in reference if name.lower() not in low and any(s.lower() in low or low in s.lower() for s in synonyms)]
    return list(dict.fromkeys(out))
