"""Search queries over machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from ..runtime import table
from . import sqltext as Q

HIT = ["id", "brand", "model", "machine_type", "price", "currency", "location", "thumbnail_url", "created_at"]
_HIT_SQL = ", ".join(HIT)
_KEYWORDS = S.KEYWORD_COLUMNS


def _m(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "machines")


def _like(columns: tuple[str, ...], text: str) -> str:
    return " or ".join(f"coalesce(contains(lower({c}), '{text.lower()}'), false)" for c in columns)


SEARCH = S.Request(query="press", brand="a", price_min=2000, price_max=60000, limit=50)
FACETS = S.Request(machine_type="saw", location="e", price_min=500)
ASC = S.Request(query="lathe", sort_by="price_asc", limit=100)
DESC = S.Request(query="lathe", sort_by="price_desc", limit=100)
PAGE = S.Request(query="grind", sort_by="newest", page=3, limit=25)
TOTAL = S.Request(query="grind", limit=25)
PHRASES = ["work lamp", "steady rest", "spannsatz"]


def q_search(spark, d):
    return S.page(S.matches(_m(spark, d), SEARCH), SEARCH).select(*HIT)


def q_search_facets(spark, d):
    return S.matches(_m(spark, d), FACETS).select("id", "type_normalized", "location", "price")


def q_search_total(spark, d):
    return S.total(S.matches(_m(spark, d), TOTAL), TOTAL)


def q_search_synonym(spark, d):
    reference = [(r[0], (r[1] or "").split(";")) for r in table(spark, d, "type_ref").select("type_name", "synonyms").orderBy("type_id").collect()]
    request = S.Request(query="bandsaw", synonyms=S.expand("bandsaw", reference))
    return S.matches(_m(spark, d), request).select("id", "brand", "machine_type")


def q_price_range(spark, d):
    return _m(spark, d).where(F.col("price").between(1000, 20000)).select("id", "price")


def q_sort_price_asc(spark, d):
    return S.page(S.matches(_m(spark, d), ASC), ASC).select("id", "price")


def q_sort_price_desc(spark, d):
    return S.page(S.matches(_m(spark, d), DESC), DESC).select("id", "price")


def q_page(spark, d):
    return S.page(S.matches(_m(spark, d), PAGE), PAGE).select("id", "created_at")


def q_fulltext(spark, d):
    return _m(spark, d).where(S.any_phrase(S.text_tokens("brand", "model", "machine_type", "description"), PHRASES)).select("id")


def q_facets(spark, d):
    """The most frequent facet values, a top-k report."""
    named = _m(spark, d).where("is_active and type_normalized <> ''").groupBy("type_normalized").agg(F.count("*").alias("n"))
    return named.orderBy(F.desc("n"), "type_normalized").limit(30)


def q_natural_sort(spark, d):
    """All rows by stock number in natural order."""
    rows = _m(spark, d).where("stock_number is not null").select("id", "stock_number", T.natural_key(F.col("stock_number")).alias("sort_key"))
    return rows.orderBy("sort_key", "id")


_EXPANDED = "contains(lower(type_synonyms), 'x')"
_FOLD_TEXT = "concat_ws(' ',coalesce(brand,''),coalesce(model,''),coalesce(machine_type,''),coalesce(description,''))"
_TOKENS = f"string_split_regex({Q.clean(_FOLD_TEXT)},'[^a-z0-9]+')"
_PHRASE_SQL = " or ".join("(" + " and ".join(f"list_contains(tk,'{w}')" for w in p.split()) + ")" for p in PHRASES)
_NATURAL = "array_to_string(list_transform(regexp_extract_all(lower(coalesce(stock_number,'')),'([0-9]+|[^0-9]+)',1), lambda p: case when regexp_matches(p,'^[0-9]') then lpad(p,12,'0') else p end),'')"

QUERIES = {f.__name__: f for f in (q_search, q_search_facets, q_search_total, q_search_synonym, q_price_range, q_sort_price_asc, q_sort_price_desc, q_page, q_fulltext, q_facets, q_natural_sort)}
ORACLE_SQL = {
    "q_search": f"select {_HIT_SQL} from machines where is_active and contains(lower(brand_normalized),'a') and price>=2000 and price<=60000 and ({_like(_KEYWORDS, 'press')}) order by created_at desc nulls first, id limit 50",
    "q_search_facets": "select id, type_normalized, location, price from machines where is_active and contains(lower(type_normalized),'saw') and contains(lower(location),'e') and price>=500",
    "q_search_total": f"select count(*) as total, cast(ceil(count(*)/25.0) as bigint) as pages from machines where is_active and ({_like(_KEYWORDS, 'grind')})",
    "q_search_synonym": f"""with names as (select type_name from type_ref, unnest(string_split(coalesce(synonyms,''),';')) as u(s) where (contains('bandsaw',lower(s)) or contains(lower(s),'bandsaw')) and not contains('bandsaw',lower(type_name)))
        select id, brand, machine_type from machines where is_active and ({_like(_KEYWORDS, 'bandsaw')} or exists (select 1 from names where contains(lower(brand),lower(type_name)) or contains(lower(machine_type),lower(type_name))))""",
    "q_price_range": "select id, price from machines where price between 1000 and 20000",
    "q_sort_price_asc": f"select id, price from machines where is_active and ({_like(_KEYWORDS, 'lathe')}) order by price asc nulls last, id limit 100",
    "q_sort_price_desc": f"select id, price from machines where is_active and ({_like(_KEYWORDS, 'lathe')}) order by price desc nulls first, id limit 100",
    "q_page": f"select id, created_at from machines where is_active and ({_like(_KEYWORDS, 'grind')}) order by created_at desc nulls first, id limit 25 offset 50",
    "q_fulltext": f"select id from (select id, {_TOKENS} as tk from machines) where {_PHRASE_SQL}",
    "q_facets": "select type_normalized, count(*) as n from machines where is_active and type_normalized <> '' group by type_normalized order by n desc, type_normalized limit 30",
    "q_natural_sort": f"select id, stock_number, {_NATURAL} as sort_key from machines where stock_number is not null order by sort_key, id",
}
