"""Text, price and identity functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..runtime import table
from . import sqltext as Q

YEAR_NOW = 2026


def _m(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "machines")


def q_clean_text(spark, d):
    return _m(spark, d).select("id", T.clean(F.col("machine_type")).alias("clean_type"), T.clean(F.col("brand")).alias("clean_brand"))


def q_slug(spark, d):
    return _m(spark, d).select("id", T.slug(F.col("model")).alias("model_slug"), T.slug(F.col("machine_type")).alias("type_slug"))


def q_corp_suffix(spark, d):
    return _m(spark, d).select("id", T.strip_corporate(F.col("brand")).alias("bare_brand"))


def q_normalize_brand(spark, d):
    """Exact alias of the brand list, else the brand in title case. The list is a fixed table of 60 rows, broadcast."""
    names = table(spark, d, "brand_ref").select("brand_name", F.explode(F.concat(F.array("brand_name"), F.split(F.coalesce("aliases", F.lit("")), ";"))).alias("alias"))
    names = names.where("alias <> ''").groupBy(T.clean(F.col("alias")).alias("key")).agg(F.min("brand_name").alias("canonical"))
    rows = _m(spark, d).where("brand is not null").select("id", "brand", T.clean(F.col("brand")).alias("key"))
    return rows.join(F.broadcast(names), "key", "left").select("id", F.coalesce("canonical", T.title_case(T.outer(F.col("brand")))).alias("brand"))


def q_normalize_model(spark, d):
    return _m(spark, d).select("id", T.normal_model(F.col("model")).alias("model"))


def q_parse_price(spark, d):
    """Amount and currency of every price line of the descriptions."""
    lines = _m(spark, d).where("description is not null").select("id", F.explode(F.split("description", "\n")).alias("line")).where(F.col("line").rlike(r"(?i)^(asking price|price:|preis|prix|precio|se pide)"))
    return lines.select("id", "line", T.price(F.col("line")).alias("amount"))


def q_currency(spark, d):
    rows = _m(spark, d).where("currency is not null")
    return rows.groupBy("currency").agg(F.count("*").alias("n")).select("currency", T.currency(F.col("currency")).alias("code"), "n")


def q_extract_year(spark, d):
    return _m(spark, d).where("description is not null").select("id", T.year(F.col("description"), YEAR_NOW).alias("year"))


def q_condition(spark, d):
    return _m(spark, d).select("id", T.condition(F.concat_ws(" ", "condition", "machine_type", "description")).alias("condition"))


def q_model_number(spark, d):
    return _m(spark, d).where("model is not null").select("id", T.model_number(F.col("model")).alias("number"))


def q_stock_number(spark, d):
    return _m(spark, d).select("id", T.stock_number(F.concat_ws(" ", F.lit("Ref"), "stock_number")).alias("stock"))


def q_content_hash(spark, d):
    return _m(spark, d).select("id", T.content_hash(F.col("brand"), F.col("model"), F.col("machine_url")).alias("hash"))


def q_dedup_key(spark, d):
    return _m(spark, d).select("id", T.dedup_key(F.col("brand"), F.col("model"), F.col("stock_number")).alias("dedup"))


def q_title_similarity(spark, d):
    """Names of copies that are alike without being the same.

    For each distinct token set of a dedup_key: how many rows have it, and the
    rows of the same key whose set is another one and at least 0.8 like it.
    Sets are matched over shared tokens, so sets that share none are not paired,
    and copies of one set count by their number.  Keys built from nothing stand for no offer.
    """
    rows = _m(spark, d).where("dedup_key is not null and machine_name is not null").where(~F.array_contains(T.unknown_keys(), F.col("dedup_key")))
    sets = rows.select("dedup_key", F.array_sort(T.title_tokens(F.col("machine_name"))).alias("tokens")).groupBy("dedup_key", "tokens").agg(F.count("*").alias("n_rows"))
    # two sets 0.8 alike agree on one of the first tokens of each, as many as may differ and one more
    first = F.slice("tokens", 1, F.size("tokens") - F.ceil(F.lit(0.8) * F.size("tokens")) + 1)
    keyed = sets.where(F.size("tokens") > 0).select("dedup_key", "tokens", "n_rows", F.explode(first.cast("array<string>")).alias("token"))
    other = keyed.select("dedup_key", "token", F.col("tokens").alias("other"), F.col("n_rows").alias("n_other"))
    alike = keyed.join(other, ["dedup_key", "token"]).where((F.col("tokens") != F.col("other")) & (T.jaccard(F.col("tokens"), F.col("other")) >= 0.8)).select("dedup_key", "tokens", "other", "n_other").distinct()
    counted = alike.groupBy("dedup_key", "tokens").agg(F.sum("n_other").alias("n_alike"))
    return sets.join(counted, ["dedup_key", "tokens"], "left").select("dedup_key", F.array_join("tokens", " ").alias("name"), "n_rows", F.coalesce("n_alike", F.lit(0)).alias("n_alike"))


def q_trigram(spark, d):
    """How many brands share each trigram."""
    brands = _m(spark, d).where("brand is not null").select(T.clean(F.col("brand")).alias("b")).distinct()
    return brands.select(F.explode(T.trigrams(F.col("b"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def q_fix_names(spark, d):
    """Sites whose name is empty or an address get one from their address."""
    broken = F.col("name").isNull() | (F.trim("name") == "") | F.col("name").rlike("(?i)^https?://")
    return table(spark, d, "websites").select("id", F.when(broken, U.site_name(F.col("url"))).otherwise(F.col("name")).alias("name"))


def q_backoff(spark, d):
    """Waiting time before each retry, by the errors of a run."""
    return table(spark, d, "crawl_logs").select("id", F.col("errors_count").alias("n"), F.least(F.lit(2.0) * F.pow(F.lit(2.0), F.col("errors_count")), F.lit(60.0)).alias("wait_s")).distinct()


def q_canonical(spark, d):
    """Offers of one identity across sites: the first id and how many more there are."""
    key = F.sha2(F.concat_ws("|", T.slug(F.coalesce("brand", F.lit(""))), T.slug(F.coalesce("model", F.lit(""))), F.coalesce(F.col("year").cast("string"), F.lit("")), F.coalesce("condition", F.lit(""))), 256)
    rows = _m(spark, d).where("brand is not null and model is not null").select("id", key.alias("key"))
    groups = rows.groupBy("key").agg(F.min("id").alias("canonical_id"), (F.count("*") - 1).alias("more"))  # aggregated before the shuffle, so that a hot key is no single task
    return rows.join(groups, "key").select("id", "canonical_id", "more")


def q_price_currency(spark, d):
    """Amount and currency of price lines, as one record."""
    lines = _m(spark, d).where("description is not null").select("id", F.explode(F.split("description", "\n")).alias("line")).where(F.col("line").rlike(r"(?i)^(asking price|price:|preis|prix|precio|se pide)"))
    return lines.select("id", T.price(F.col("line")).alias("amount"), F.when(F.col("line").rlike(T.CODE_PATTERN), F.upper(F.regexp_extract("line", T.CODE_PATTERN, 1))).alias("code"))


def q_price_display(spark, d):
    """What a price is shown as: whole units with thousands apart, or that it is on request."""
    shown = F.concat(F.coalesce(F.nullif(F.trim("currency"), F.lit("")), F.lit("USD")), F.lit(" "), F.format_number(F.floor(F.col("price").cast("decimal(38,2)") + F.lit("0.5").cast("decimal(2,1)")), 0))
    return _m(spark, d).select("id", F.when(F.col("price").isNull() | (F.col("price") == 0), "Price on request").otherwise(shown).alias("shown"))


def q_raw_hash(spark, d):
    """Digest of what a page says, whatever its address."""
    return _m(spark, d).select("id", F.sha2(F.concat_ws("|", F.coalesce("machine_name", F.lit("")), F.coalesce("description", F.lit(""))), 256).alias("hash"))


def q_duration(spark, d):
    """Minutes of each run to one place, half to even, and its text; a run without an end is running."""
    seconds = F.timestamp_diff("SECOND", F.col("started_at"), F.col("finished_at"))
    return table(spark, d, "crawl_logs").select("id", "started_at", "finished_at", F.bround(seconds.cast("decimal(20,4)") / 60, 1).cast("double").alias("minutes"), F.when(F.col("finished_at").isNull(), "Running...").otherwise(F.concat(seconds.cast("string"), F.lit("s"))).alias("shown")).distinct()


def q_site_address(spark, d):
    """Addresses of sites with a scheme and without a slash at the end."""
    u = F.trim("url")
    return table(spark, d, "websites").select("id", F.regexp_replace(F.when(u.rlike("(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u)), "/+$", "").alias("address"))


def q_usable(spark, d):
    """Records that state at least one of maker, model, name or type."""
    stated = [F.coalesce(F.trim(c) != "", F.lit(False)) for c in ("brand", "model", "machine_name", "machine_type")]
    return _m(spark, d).where(stated[0] | stated[1] | stated[2] | stated[3]).select("id")


_ALIAS = f"(select {Q.clean('alias')} as key, min(brand_name) as canonical from (select brand_name, unnest(list_concat([brand_name], string_split(coalesce(aliases,''),';'))) as alias from brand_ref) where alias <> '' group by 1)"
_TOKENS = f"list_distinct(list_filter(string_split_regex(regexp_replace(lower({Q.fold('machine_name')}),'\\b(the|a|an|used|gebraucht|usato|occasion|cnc|for|sale)\\b',' ','g'),'[^a-z0-9]+'), lambda t: length(t)>=3))"
_PAD = "'  '||lower(b)||' '"
_HOST = f"string_split({Q.host_key(Q.authority('url'))},'.')[1]"

QUERIES = {f.__name__: f for f in (q_clean_text, q_slug, q_corp_suffix, q_normalize_brand, q_normalize_model, q_parse_price, q_currency, q_extract_year, q_condition, q_model_number, q_stock_number, q_content_hash, q_dedup_key, q_title_similarity, q_trigram, q_fix_names, q_backoff, q_canonical, q_price_currency, q_price_display, q_raw_hash, q_duration, q_site_address, q_usable)}
ORACLE_SQL = {
    "q_clean_text": f"select id, {Q.clean('machine_type')} as clean_type, {Q.clean('brand')} as clean_brand from machines",
    "q_slug": f"select id, {Q.slug('model')} as model_slug, {Q.slug('machine_type')} as type_slug from machines",
    "q_corp_suffix": f"select id, {Q.strip_corporate('brand')} as bare_brand from machines",
    "q_normalize_brand": f"select id, coalesce(canonical, {Q.title_case(Q.outer('m.brand'))}) as brand from (select id, brand, {Q.clean('brand')} as key from machines where brand is not null) m left join {_ALIAS} a using (key)",
    "q_normalize_model": f"select id, {Q.normal_model('model')} as model from machines",
    "q_parse_price": f"select id, line, {Q.price('line')} as amount from (select id, unnest(string_split(description, chr(10))) as line from machines where description is not null) where regexp_matches(line,'(?i)^(asking price|price:|preis|prix|precio|se pide)')",
    "q_extract_year": f"select id, list_filter(list_transform(regexp_extract_all(description,'\\b(19[5-9][0-9]|20[0-2][0-9]|2030)\\b',1), lambda y: cast(y as integer)), lambda y: y<={YEAR_NOW})[1] as year from machines where description is not null",
    "q_condition": f"select id, case when regexp_matches(t,{Q.q(T.USED_PATTERN)}) then 'used' when regexp_matches(t,{Q.q(T.NEW_PATTERN)}) then 'new' else '' end as condition from (select id, concat_ws(' ',condition,machine_type,description) as t from machines)",
    "q_model_number": f"select id, nullif(regexp_extract(model,{Q.q(T.MODEL_PATTERN)},1),'') as number from machines where model is not null",
    "q_content_hash": f"select id, sha256(concat_ws('|',{Q.slug(chr(99)+'oalesce(brand,'+chr(39)*2+')')},{Q.slug('coalesce(model,'+chr(39)*2+')')},coalesce(machine_url,''))) as hash from machines",
    "q_dedup_key": "select id, sha256(concat_ws('|',{},{},{})) as dedup from machines".format(*[Q.slug(f"coalesce({c},'')") for c in ("brand", "model", "stock_number")]),
    "q_title_similarity": f"""with s as (select dedup_key, list_sort({_TOKENS}) as tokens, count(*) as n_rows from machines where dedup_key is not null and machine_name is not null and dedup_key not in (select sha256(x) from (values ('||'),('|'),(''),('||none'),('none|none|none')) v(x)) group by 1,2)
        select a.dedup_key, array_to_string(a.tokens,' ') as name, a.n_rows, cast(coalesce(sum(b.n_rows),0) as bigint) as n_alike from s a left join s b on a.dedup_key=b.dedup_key and a.tokens<>b.tokens and len(a.tokens)>0 and len(b.tokens)>0 and len(list_intersect(a.tokens,b.tokens))>=0.8*len(list_distinct(list_concat(a.tokens,b.tokens)))
        group by 1,2,3""",
    "q_trigram": f"select gram, count(*) as n from (select unnest(list_distinct(list_transform(range(1, length({_PAD})-1), lambda k: substr({_PAD},k,3)))) as gram from (select distinct {Q.clean('brand')} as b from machines where brand is not null)) group by 1",
    "q_fix_names": "select id, case when name is null or trim(name)='' or regexp_matches(name,'(?i)^https?://') then {} else name end as name from websites".format(Q.title_case(f"regexp_replace({_HOST},'[-_]+',' ','g')")),
    "q_backoff": "select distinct id, errors_count as n, least(2.0*pow(2.0,errors_count),60.0) as wait_s from crawl_logs",
    "q_canonical": "select id, min(id) over (partition by key) as canonical_id, count(*) over (partition by key)-1 as more from (select id, sha256(concat_ws('|',{},{},coalesce(cast(year as varchar),''),coalesce(condition,''))) as key from machines where brand is not null and model is not null)".format(Q.slug("coalesce(brand,'')"), Q.slug("coalesce(model,'')")),
    "q_currency": "select currency, case when code<>'' and (sign='' or strpos(upper(currency),upper(code))<=strpos(lower(currency),lower(sign))) then upper(code) when sign='' then 'USD' when lower(sign)='kr' then case when sign='kr' then 'SEK' else upper(sign) end when sign='$' then 'USD' when sign='€' then 'EUR' when sign='£' then 'GBP' when sign='¥' then 'JPY' end as code, n from (select currency, regexp_extract(currency,{},1) as code, regexp_extract(currency,{},1) as sign, count(*) as n from machines where currency is not null group by 1)".format(Q.q(T.CODE_PATTERN), Q.q(T.SIGN_PATTERN)),
    "q_price_currency": f"select id, {Q.price('line')} as amount, case when regexp_matches(line,{Q.q(T.CODE_PATTERN)}) then upper(regexp_extract(line,{Q.q(T.CODE_PATTERN)},1)) end as code from (select id, unnest(string_split(description, chr(10))) as line from machines where description is not null) where regexp_matches(line,'(?i)^(asking price|price:|preis|prix|precio|se pide)')",
    "q_price_display": "select id, case when price is null or price=0 then 'Price on request' else coalesce(nullif(trim(currency),''),'USD')||' '||format('{:,}', cast(floor(cast(price as decimal(38,2))+0.5) as bigint)) end as shown from machines",
    "q_raw_hash": "select id, sha256(concat_ws('|',coalesce(machine_name,''),coalesce(description,''))) as hash from machines",
    "q_duration": "select distinct id, started_at, finished_at, cast(round_even(cast(s as decimal(20,4))/60,1) as double) as minutes, case when finished_at is null then 'Running...' else s||'s' end as shown from (select *, cast(trunc((epoch_us(finished_at)-epoch_us(started_at))/1000000.0) as bigint) as s from crawl_logs)",
    "q_site_address": "select id, regexp_replace(case when regexp_matches(trim(url),'(?i)^https?://') then trim(url) else 'https://'||trim(url) end,'/+$','') as address from websites",
    "q_usable": "select id from machines where coalesce(trim(brand)<>'',false) or coalesce(trim(model)<>'',false) or coalesce(trim(machine_name)<>'',false) or coalesce(trim(machine_type)<>'',false)",
}
