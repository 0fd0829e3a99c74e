"""Address and link queries over the addresses in the listing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import links as L
from ..operators import mutations as M
from ..runtime import table
from . import sqltext as Q


def _urls(spark: SparkSession, d: str) -> DataFrame:
    """(id, site, url, base) of every address of a listing: page, thumbnail and images, with the site's own."""
    m = table(spark, d, "machines")
    pages = m.select("id", "website_id", F.explode(F.array("machine_url", "thumbnail_url")).alias("url"))
    images = table(spark, d, "machine_images").join(m.select(F.col("id").alias("machine_id"), "website_id"), "machine_id").select(F.col("id"), "website_id", F.col("image_url").alias("url"))
    sites = table(spark, d, "websites").select(F.col("id").alias("website_id"), F.col("url").alias("base"))
    return pages.unionByName(images).where("url is not null").join(sites, "website_id")


def q_clean_url(spark, d):
    return _urls(spark, d).select("id", "url", U.cleaned(F.col("url")).alias("clean"))


def q_host_counts(spark, d):
    return _urls(spark, d).groupBy(U.authority(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.countDistinct("website_id").alias("n_sites"))


def q_url_classify(spark, d):
    u = F.col("url")
    return _urls(spark, d).select("id", "url", U.is_product(u).alias("product"), U.is_skipped(u).alias("skipped"), U.is_english(u).alias("english"), U.is_sitemap_product(u).alias("in_sitemap"))


def q_path_pattern_freq(spark, d):
    return _urls(spark, d).groupBy("website_id", U.path_pattern(F.col("url")).alias("pattern")).agg(F.count("*").alias("n"))


def q_url_type(spark, d):
    """The path segment after a product segment."""
    segments = F.filter(F.split(U.path(F.col("url")), "/"), lambda s: (s != "") & ~s.rlike("[0-9]") & (F.length(s) > 3))
    return _urls(spark, d).select("id", "url", F.get(segments, F.lit(0)).alias("segment"))


def q_link_filter(spark, d):
    same = U.host_key(U.authority(F.col("url"))) == U.host_key(U.authority(F.col("base")))
    return _urls(spark, d).where(same & ~U.is_skipped(F.col("url"))).select("id", "url")


def q_distinct_urls(spark, d):
    """Distinct addresses in all and per site, counted in two steps."""
    return _urls(spark, d).groupBy("website_id").agg(F.countDistinct(U.cleaned(F.col("url"))).alias("n_urls"))


def q_dedupe_first(spark, d):
    """The first row of each cleaned address."""
    rows = _urls(spark, d).withColumn("clean", U.cleaned(F.col("url")))
    return rows.groupBy("website_id", "clean").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


def q_union_urls(spark, d):
    """Pages and thumbnails put together, pages first, each address once."""
    m = table(spark, d, "machines")
    bag = m.select(F.col("machine_url").alias("url"), F.lit(0).alias("part"), "id").unionByName(m.select(F.col("thumbnail_url").alias("url"), F.lit(1).alias("part"), "id")).where("url is not null")
    return bag.groupBy("url").agg(F.min(F.struct("part", "id")).alias("f")).select("url", F.col("f.part").alias("part"), F.col("f.id").alias("id"))


def q_queue_push(spark, d):
    """Addresses of newer listings that the queue of each site has not seen."""
    rows = table(spark, d, "machines").where("machine_url is not null and created_at is not null").select("website_id", U.cleaned(F.col("machine_url")).alias("url"), "created_at")
    return M.push_new(rows.where("created_at < timestamp_ntz'2023-01-01'"), rows.where("created_at >= timestamp_ntz'2023-01-01'"), "website_id", "url")


def q_link_scores(spark, d):
    return L.link_scores(_urls(spark, d), "website_id", "url", "base")


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    zone = F.when(F.col("url").rlike("[13579]$"), "nav").when(F.col("url").endswith("2"), "footer").otherwise("page")
    return _urls(spark, d).withColumn("zone", zone)


def q_category_urls(spark, d):
    return L.category_scores(_anchors(spark, d), "website_id", "url", "zone", "base")


def q_product_urls(spark, d):
    """The best forty links of each site, one per cleaned address: a top-k report."""
    return L.top_links(L.category_scores(_anchors(spark, d), "website_id", "url", "zone", "base"), "website_id", "url").withColumn("place", F.col("place").cast("bigint"))


def q_abs_links(spark, d):
    """Image addresses resolved against their site."""
    return _urls(spark, d).select("id", "url", U.absolute(F.col("url"), F.col("base")).alias("absolute"))


def q_listing_pages(spark, d):
    """Path patterns with many links and products."""
    u = F.col("url")
    grouped = _urls(spark, d).groupBy("website_id", U.path_pattern(u).alias("pattern")).agg(F.count("*").alias("n_links"), F.count_if(U.is_product(u)).alias("n_products"))
    return grouped.where("n_links >= 8 and n_products >= 3")


def q_best_candidate(spark, d):
    """The best entry of each site by three keys, the first id winning ties."""
    rows = table(spark, d, "machines").where("website_id is not null").select("id", "website_id", F.col("price").isNotNull().alias("has_price"), F.coalesce(F.length("description"), F.lit(0)).alias("n_text"), F.coalesce("year", F.lit(0)).alias("year"))
    return L.best_candidates(rows, "website_id", ["has_price", "n_text", "year"], "id").select("website_id", "id", F.col("n_text").cast("bigint").alias("n_text"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).unionByName(
        li.where("l_linenumber = 1").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("o"), F.col("l_orderkey") + 1).alias("dst")))


def q_bfs(spark, d):
    """Nodes within four steps of one order in the graph of orders and parts."""
    seeds = table(spark, d, "orders").agg(F.min("o_orderkey").alias("k")).select(F.concat(F.lit("o"), "k").alias("node"))
    return L.breadth_first(_edges(spark, d), seeds, 4)


def q_custom_product(spark, d):
    """Products by a pattern of the caller's in place of the usual segments."""
    return _urls(spark, d).select("id", "url", U.is_product(F.col("url"), "/(offer|lot)-?[0-9]+").alias("product"))


def q_english_first(spark, d):
    """The best forty addresses of each site, English ones before the others: a top-k report."""
    scored = L.link_scores(_urls(spark, d), "website_id", "url", "base")
    w = W.partitionBy("website_id").orderBy(F.when(U.is_english(F.col("url")), 0).otherwise(1), F.desc("score"), "url")
    return scored.withColumn("place", F.row_number().over(w).cast("bigint")).where("place <= 40").select("website_id", "place", "url", "score")


def q_page_addresses(spark, d):
    """Addresses of the pages after the first of a listing, as each site writes them."""
    sites = table(spark, d, "websites").where("url is not null").select("id", F.regexp_replace("url", "/+$", "").alias("url"))
    forms = F.array(F.concat("url", F.lit("/list")), F.concat("url", F.lit("/list?sort=new")), F.concat("url", F.lit("/list?page=1&x=2")), F.concat("url", F.lit("/list/page/1")))
    listed = sites.select("id", F.explode(forms).alias("current"), (F.col("id") % 5 + 1).cast("int").alias("pages")).where("pages > 1")
    return listed.select("id", F.explode(F.transform(F.sequence(F.lit(2), F.col("pages")), lambda k: U.page_address(F.col("current"), k))).alias("url"))


def q_status_filter(spark, d):
    """Addresses whose last answer was neither 404 nor 410; the answer stands for what a crawl brought home."""
    status = F.when(F.col("id") % 11 == 0, 404).when(F.col("id") % 13 == 0, 410).otherwise(200)
    return table(spark, d, "machine_images").where(F.col("image_url").isNotNull()).withColumn("status", status).where(~F.col("status").isin(404, 410)).select("id", "image_url")


def q_queue_info(spark, d):
    """Size of each site's queue and of its set of seen addresses."""
    rows = table(spark, d, "machines").where("machine_url is not null and website_id is not null").select("website_id", U.cleaned(F.col("machine_url")).alias("url"), F.col("last_crawled_at").isNull().alias("waiting"))
    return rows.groupBy("website_id").agg(F.count_if("waiting").alias("size"), F.countDistinct("url").alias("seen"), (F.count_if("waiting") == 0).alias("is_empty"))


_URLS = """(select u.id, u.website_id, u.url, w.url as base from (select id, website_id, unnest([machine_url, thumbnail_url]) as url from machines
  union all select i.id, m.website_id, i.image_url from machine_images i join machines m on m.id=i.machine_id) u join websites w on w.id=u.website_id where u.url is not null)"""
_SAME = f"{Q.host_key(Q.authority('url'))} = {Q.host_key(Q.authority('base'))}"
_SCORE = f"case when {Q.is_skipped('url')} or not coalesce({_SAME},false) then 0 else 1 + case when {Q.is_product('url')} then 10 else 0 end + case when {Q.is_english('url')} then 5 else 0 end end"
_ZONE = "case when regexp_matches(url,'[13579]$') then 4 when url like '%2' then 2 else 1 end"
_CAT = f"""(with s as (select website_id, url, sum({_ZONE} + case when {Q.is_product('url')} then 5 else 0 end) as score0 from {_URLS} where {_SAME} and not {Q.is_skipped('url')} and regexp_replace(url,'/$','')<>regexp_replace(base,'/$','') group by 1,2),
  p as (select *, {Q.path_pattern('url')} as pattern from s), f as (select *, count(*) over (partition by website_id, pattern) as freq from p)
  select website_id, url, cast(score0 + case when freq>=2 then 2*freq else 0 end as bigint) as score from f where score0 + case when freq>=2 then 2*freq else 0 end >= 2)"""
_EDGES = "(select distinct src, dst from (select 'o'||l_orderkey as src, 'p'||l_partkey as dst from lineitem union all select 'p'||l_partkey, 'o'||(l_orderkey+1) from lineitem where l_linenumber=1))"

QUERIES = {f.__name__: f for f in (q_clean_url, q_host_counts, q_url_classify, q_path_pattern_freq, q_url_type, q_link_filter, q_distinct_urls, q_dedupe_first, q_union_urls, q_queue_push, q_link_scores, q_category_urls, q_product_urls, q_abs_links, q_listing_pages, q_best_candidate, q_bfs, q_custom_product, q_english_first, q_page_addresses, q_status_filter, q_queue_info)}
ORACLE_SQL = {
    "q_clean_url": f"select id, url, regexp_replace(url,'[?#].*$','') as clean from {_URLS}",
    "q_host_counts": f"select {Q.authority('url')} as host, count(*) as n, count(distinct website_id) as n_sites from {_URLS} group by 1",
    "q_url_classify": f"select id, url, {Q.is_product('url')} as product, {Q.is_skipped('url')} as skipped, {Q.is_english('url')} as english, not regexp_matches(url,{Q.q(U.SITEMAP_EXCLUDED_PATTERN)}) and regexp_matches(url,{Q.q(U.SITEMAP_PRODUCT_PATTERN)}) as in_sitemap from {_URLS}",
    "q_path_pattern_freq": f"select website_id, {Q.path_pattern('url')} as pattern, count(*) as n from {_URLS} group by 1,2",
    "q_url_type": f"select id, url, list_filter(string_split({Q.path('url')},'/'), lambda s: s<>'' and not regexp_matches(s,'[0-9]') and length(s)>3)[1] as segment from {_URLS}",
    "q_link_filter": f"select id, url from {_URLS} where {_SAME} and not {Q.is_skipped('url')}",
    "q_distinct_urls": f"select website_id, count(distinct regexp_replace(url,'[?#].*$','')) as n_urls from {_URLS} group by 1",
    "q_dedupe_first": f"select website_id, regexp_replace(url,'[?#].*$','') as clean, min(id) as first_id, count(*) as n from {_URLS} group by 1,2",
    "q_union_urls": "select url, part, id from (select url, part, id, row_number() over (partition by url order by part, id) as k from (select machine_url as url, 0 as part, id from machines union all select thumbnail_url, 1, id from machines) where url is not null) where k=1",
    "q_queue_push": "with r as (select website_id, regexp_replace(machine_url,'[?#].*$','') as url, created_at from machines where machine_url is not null and created_at is not null) select distinct website_id, url from r where created_at>=timestamp '2023-01-01' and not exists (select 1 from r o where o.created_at<timestamp '2023-01-01' and o.website_id=r.website_id and o.url=r.url)",
    "q_link_scores": f"select website_id, clean as url, max(score) as score from (select website_id, regexp_replace(url,'[?#].*$','') as clean, {_SCORE} as score from {_URLS}) where score>0 group by 1,2",
    "q_category_urls": f"select website_id, url, score from {_CAT}",
    "q_product_urls": f"select website_id, url, score, place from (select *, row_number() over (partition by website_id, regexp_replace(url,'[?#].*$','') order by place) as k from (select *, row_number() over (partition by website_id order by score desc, url) as place from {_CAT}) where place<=40) where k=1",
    "q_abs_links": f"""select id, url, case when regexp_matches(h,'(?i)^https?://') then h when h like '//%' then regexp_extract(base,'^([A-Za-z]+:)',1)||h when h like '/%' then {Q.origin('base')}||h when h='' or regexp_matches(h,'^[A-Za-z][A-Za-z0-9+.-]*:') then null
        when h like '?%' then regexp_replace(base,'[?#].*$','')||h else {Q.origin('base')}||'/'||h end as absolute from (select *, regexp_replace(trim(url),'#.*$','') as h from {_URLS}) """,
    "q_listing_pages": f"select website_id, {Q.path_pattern('url')} as pattern, count(*) as n_links, count(*) filter (where {Q.is_product('url')}) as n_products from {_URLS} group by 1,2 having count(*)>=8 and count(*) filter (where {Q.is_product('url')})>=3",
    "q_best_candidate": "select website_id, id, n_text from (select id, website_id, coalesce(length(description),0) as n_text, row_number() over (partition by website_id order by price is not null desc, coalesce(length(description),0) desc, coalesce(year,0) desc, id) as k from machines where website_id is not null) where k=1",
    "q_bfs": f"""with recursive e as (select * from {_EDGES}), r(node, level) as (select 'o'||min(o_orderkey), 0 from orders union select e.dst, r.level+1 from r join e on e.src=r.node where r.level<4) select node, min(level) as level from r group by 1""",
    "q_custom_product": f"select id, url, regexp_matches({Q.path('url')},'/(offer|lot)-?[0-9]+') as product from {_URLS}",
    "q_english_first": f"select website_id, place, url, score from (select *, row_number() over (partition by website_id order by case when {Q.is_english('url')} then 0 else 1 end, score desc, url) as place from (select website_id, clean as url, max(score) as score from (select website_id, regexp_replace(url,'[?#].*$','') as clean, {_SCORE} as score from {_URLS}) where score>0 group by 1,2)) where place<=40",
    "q_page_addresses": "with s as (select id, regexp_replace(url,'/+$','') as u, cast(id%5+1 as integer) as pages from websites where url is not null), p as (select id, u, unnest(range(2, pages+1)) as k from s) select id, unnest([u||'/list?page='||k, u||'/list?sort=new&page='||k, u||'/list?page='||k||'&x=2', u||'/list/page/'||k]) as url from p",
    "q_status_filter": "select id, image_url from machine_images where image_url is not null and id%11<>0 and id%13<>0",
    "q_queue_info": "select website_id, count(*) filter (where last_crawled_at is null) as size, count(distinct regexp_replace(machine_url,'[?#].*$','')) as seen, count(*) filter (where last_crawled_at is null)=0 as is_empty from machines where machine_url is not null and website_id is not null group by 1",
}
