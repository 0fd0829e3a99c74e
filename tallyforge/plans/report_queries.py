"""Reports, joins, nesting, schedules and table changes over the listing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import mutations as M
from ..operators.rolling import look_back
from ..runtime import table

NOW = "2026-06-01 00:00:00"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs once each: the table has rows delivered twice under one id."""
    rows = table(spark, d, "crawl_logs")
    return M.latest(rows, "id", ["started_at", "finished_at", "status"]).withColumn("status", F.lower("status"))


def q_dashboard(spark, d):
    """Four counts in one row, each from its own table."""
    def n(name, cond="true"):
        return table(spark, d, name).where(cond).agg(F.count("*").alias(name))
    out = n("machines").crossJoin(n("websites")).crossJoin(n("machine_images")).crossJoin(n("machine_specs"))  # single rows
    return out


def q_recent_crawls(spark, d):
    """The last 200 runs with their site, a top-k report."""
    sites = table(spark, d, "websites").select(F.col("id").alias("website_id"), "name")
    runs = _runs(spark, d).orderBy(F.desc_nulls_last("started_at"), F.desc("id")).limit(200)
    name = F.coalesce("name", F.concat(F.lit("Website #"), F.coalesce(F.col("website_id").cast("string"), F.lit("?"))))
    return runs.join(sites, "website_id", "left").select("id", name.alias("site"), "status", "started_at")


def q_crawl_report(spark, d):
    sites = table(spark, d, "websites").select(F.col("id").alias("website_id"), "name")
    seconds = F.timestamp_diff("SECOND", F.col("started_at"), F.col("finished_at"))
    return _runs(spark, d).join(sites, "website_id", "left").select("id", F.coalesce("name", F.lit("-")).alias("site"), "status", seconds.alias("seconds"), "machines_found")


def q_latest_run(spark, d):
    """The last run of each site."""
    runs = _runs(spark, d).where("website_id is not null and started_at is not null")
    return runs.groupBy("website_id").agg(F.max_by("id", F.struct("started_at", "id")).alias("run_id"), F.max("started_at").alias("started_at"))


def q_status_counts(spark, d):
    return _runs(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.sum("machines_found").alias("found"), F.sum(F.coalesce("errors_count", F.lit(0))).alias("errors"))


def q_crawl_health(spark, d):
    """Runs below 80 % of what their site found before, and third errors in a row."""
    runs = _runs(spark, d).where("website_id is not null and started_at is not null").select("id", "website_id", "started_at", "machines_found", (F.col("status") == "error").cast("int").alias("failed"))
    seen = look_back(runs, "website_id", ["started_at", "id"], F.trunc("started_at", "month"), F.struct("machines_found", "failed"), 2)
    three = F.concat(F.array("failed"), F.transform("before", lambda x: x["failed"]))
    known = F.filter(three, lambda x: x.isNotNull())
    failed3 = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("bigint"), lambda a, x: a + x))
    out = seen.select("id", "website_id", "machines_found", F.get("before", F.lit(0))["machines_found"].alias("before"), failed3.alias("failed3"))
    return out.where("machines_found < 0.8 * before or failed3 = 3").select("id", "website_id", "machines_found", "before", "failed3")


def q_deviation(spark, d):
    """Sites whose stored counter is off by more than a fifth."""
    real = table(spark, d, "machines").groupBy("website_id").agg(F.count("*").alias("n"))
    sites = table(spark, d, "websites").select(F.col("id").alias("website_id"), "machine_count")
    ratio = F.abs(F.col("machine_count") - F.col("n")) / F.col("n")
    return sites.join(real, "website_id").where("n > 0 and machine_count is not null").select("website_id", "machine_count", "n", F.round(ratio, 6).alias("off")).where("off > 0.2")


def q_recount(spark, d):
    """Machines per site, all and active, zero where there are none."""
    n = table(spark, d, "machines").groupBy("website_id").agg(F.count("*").alias("n_all"), F.count_if(F.col("is_active")).alias("n_active"))
    sites = table(spark, d, "websites").select(F.col("id").alias("website_id"))
    return sites.join(n, "website_id", "left").select("website_id", F.coalesce("n_all", F.lit(0)).alias("n_all"), F.coalesce("n_active", F.lit(0)).alias("n_active"))


def q_schedule(spark, d):
    """Sites spread over a day, those never crawled first."""
    sites = table(spark, d, "websites").where("is_active and crawl_enabled")
    n = sites.agg(F.count("*").alias("n"))  # one row
    placed = sites.withColumn("place", F.row_number().over(W.orderBy(F.asc_nulls_first("last_crawled_at"), "id")) - 1).crossJoin(n)
    step = F.floor(F.lit(86400) / F.col("n"))
    return placed.select("id", F.col("place").cast("bigint").alias("place"), (F.col("place") * step).cast("bigint").alias("offset_s"))


def q_admin_list(spark, d):
    rows = table(spark, d, "machines").where(F.lower("machine_type").contains("press") & F.coalesce("is_active", F.lit(True)))
    return rows.select("id", "website_id", "brand", "model", "price", "is_active", "created_at")


def q_point_lookup(spark, d):
    """Rows by their unique key: the listings that images name as their primary picture's owner, looked up by equality."""
    keys = table(spark, d, "machine_images").where("is_primary and machine_id is not null").select(F.col("machine_id").alias("id")).distinct()
    return table(spark, d, "machines").join(keys, "id").select("id", "content_hash")


def q_export(spark, d):
    """Renamed columns with times as text."""
    return table(spark, d, "machines").select(F.col("id").alias("ID"), F.col("brand").alias("Brand"), F.col("model").alias("Model"), F.col("price").cast("double").alias("Price"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("Created"))


def q_machine_detail(spark, d):
    """Machines with their images and specs nested, counted and with the primary image first."""
    images = table(spark, d, "machine_images").groupBy("machine_id").agg(F.sort_array(F.collect_list(F.struct((~F.coalesce("is_primary", F.lit(False))).alias("rest"), "id", "image_url"))).alias("images"))
    specs = table(spark, d, "machine_specs").groupBy("machine_id").agg(F.count("*").alias("n_specs"))
    m = table(spark, d, "machines").select("id", "thumbnail_url")
    joined = m.join(images, F.col("id") == images.machine_id, "left").drop("machine_id").join(specs, F.col("id") == specs.machine_id, "left")
    return joined.select("id", F.coalesce(F.get("images", F.lit(0))["image_url"], "thumbnail_url").alias("picture"), F.coalesce(F.size("images"), F.lit(0)).cast("bigint").alias("n_images"), F.coalesce("n_specs", F.lit(0)).alias("n_specs"))


def q_topk_per_group(spark, d):
    """The first five images of each machine."""
    w = W.partitionBy("machine_id").orderBy("id")
    rows = table(spark, d, "machine_images").where("machine_id is not null").withColumn("place", F.row_number().over(w)).where("place <= 5")
    return rows.select("machine_id", "id", F.col("place").cast("bigint").alias("place"), (F.col("place") == 1).alias("is_first"))


def q_top_specs(spark, d):
    """The first fifty specifications of each machine, labels and values cut to the length of their fields."""
    w = W.partitionBy("machine_id").orderBy("id", "spec_key", "spec_value")
    rows = table(spark, d, "machine_specs").where("machine_id is not null").select("machine_id", "id", "spec_key", "spec_value").distinct()
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 50").select("machine_id", "id", F.left("spec_key", F.lit(100)).alias("spec_key"), F.left("spec_value", F.lit(500)).alias("spec_value"))


def q_detail_specs(spark, d):
    """Machines with their specifications nested, in the order of their ids."""
    specs = table(spark, d, "machine_specs").where("spec_key is not null").groupBy("machine_id").agg(F.sort_array(F.collect_list(F.struct("id", "spec_key", "spec_value"))).alias("specs"))
    m = table(spark, d, "machines").select("id")
    joined = m.join(specs, F.col("id") == specs.machine_id, "left")
    return joined.select("id", F.coalesce(F.array_join(F.transform("specs", lambda x: F.concat(x["spec_key"], F.lit("="), F.coalesce(x["spec_value"], F.lit("")))), ";"), F.lit("")).alias("specs"))


def q_admin_filter(spark, d):
    """The administration's list with every filter and column: site, type, maker, words in three columns, active or not."""
    rows = table(spark, d, "machines")
    words = F.lit(False)
    for c in ("brand", "model", "machine_type"):
        words = words | F.coalesce(F.contains(F.lower(F.col(c)), F.lit("an")), F.lit(False))
    kept = rows.where((F.col("website_id") <= 40) & F.contains(F.lower("machine_type"), F.lit("e")) & F.contains(F.lower("brand"), F.lit("o")) & words & (F.col("is_active") == F.lit(True)))
    return kept.select("id", "website_id", "machine_type", "brand", "model", "stock_number", "price", "currency", "location", "condition", "year", "machine_url", "is_active", "created_at", "last_crawled_at")


def q_migrate(spark, d):
    """A table under a newer schema: new columns are null in old rows, old ones stay."""
    old = table(spark, d, "websites").select("id", "name")
    new = table(spark, d, "websites").where("is_active").select((F.col("id") + 1000).alias("id"), "url", F.lit(0).alias("discovered"))
    return old.unionByName(new, allowMissingColumns=True)


def q_crawl_totals(spark, d):
    """Counts of all runs in one row."""
    r = _runs(spark, d)
    return r.agg(F.count("*").alias("runs"), F.sum("machines_found").alias("found"), F.sum(F.coalesce("machines_new", F.lit(0)) + F.coalesce("machines_updated", F.lit(0))).alias("kept"), F.sum("errors_count").alias("errors"))


def q_saved_list(spark, d):
    """What each user saved, row by row, newest first for each: orders stand for saved lists."""
    o, li, p = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part")
    saved = li.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")).distinct()
    rows = o.select("o_orderkey", "o_custkey", "o_orderdate").join(saved, "o_orderkey").join(p.select("p_partkey", "p_name"), "p_partkey")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey", "p_partkey")).cast("bigint")).select("o_custkey", "place", "o_orderkey", "p_partkey", "p_name")


def q_saved(spark, d):
    """Saved rows of each user with what they saved, newest first: orders stand for saved lists."""
    o, li, p = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part")
    saved = li.select("l_orderkey", "l_partkey").distinct()
    return o.join(saved, o.o_orderkey == saved.l_orderkey).join(p, saved.l_partkey == p.p_partkey).groupBy("o_custkey").agg(F.countDistinct("p_partkey").alias("n_saved"), F.max("o_orderdate").alias("newest"))


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    """A later delivery of the listings: every second one again with a new price, and those of other ids under new keys."""
    m = table(spark, d, "machines")
    again = m.where("id % 2 = 0").select("content_hash", (F.col("price") * 2).cast("decimal(14,2)").alias("price"), F.when(F.col("id") % 4 == 0, F.lit("")).otherwise(F.col("description")).alias("description"), F.lit(NOW).cast("timestamp_ntz").alias("last_crawled_at"), "id", "brand")
    fresh = m.where("id % 5 = 1").select(F.concat(F.lit("new-"), "content_hash").alias("content_hash"), "price", "description", F.lit(NOW).cast("timestamp_ntz").alias("last_crawled_at"), (F.col("id") + 100_000_000).alias("id"), "brand")
    return again.unionByName(fresh).unionByName(fresh)


def _upserted(spark, d, modes):
    m = table(spark, d, "machines").select("content_hash", "id", "brand", "price", "description", "last_crawled_at")
    return M.upsert(m, _incoming(spark, d), "content_hash", modes, ["last_crawled_at", "id"])


def q_upsert(spark, d):
    out = _upserted(spark, d, {"price": "coalesce", "description": "coalesce", "last_crawled_at": "overwrite"})
    return out.select("content_hash", "id", "price", F.length("description").cast("bigint").alias("n_text"), "last_crawled_at", "change")


def q_upsert_touch(spark, d):
    return _upserted(spark, d, {"last_crawled_at": "overwrite"}).select("content_hash", "price", "last_crawled_at")


def q_upsert_counts(spark, d):
    return _upserted(spark, d, {"price": "overwrite"}).groupBy("change").agg(F.count("*").alias("n"))


def q_patch(spark, d):
    m = table(spark, d, "machines").select("id", "brand", "location", "price")
    patches = m.where("id % 10 = 3").select("id", F.lit("Patched").alias("brand"), F.lit(True).alias("has_brand"), F.lit(None).cast("string").alias("location"), (F.col("id") % 20 == 3).alias("has_location"))
    return M.patch(m, patches, "id", ["brand", "location"])


def q_delete_cascade(spark, d):
    m = table(spark, d, "machines").select("id", "website_id")
    doomed = m.where("website_id % 7 = 0").select("id")
    out = M.delete_cascade(m, {"images": (table(spark, d, "machine_images"), "machine_id"), "specs": (table(spark, d, "machine_specs"), "machine_id")}, doomed, "id")
    parts = [out[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("kept"), "n") for k in ("parent", "images", "specs")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_insert_absent(spark, d):
    sites = table(spark, d, "websites").select("id", "url")
    offered = table(spark, d, "machines").where("website_source is not null").select((F.col("website_id") + 1000).alias("id"), F.concat(F.lit("https://"), F.lower("website_source")).alias("url"))
    return M.insert_absent(sites, offered, "url", ["id"])


def q_reset_stuck(spark, d):
    """Runs that never ended are closed as failed."""
    stuck = (F.col("status") == "running") & F.col("finished_at").isNull()
    return _runs(spark, d).select("id", F.when(stuck, "error").otherwise(F.col("status")).alias("status"), F.when(stuck, F.lit(NOW).cast("timestamp_ntz")).otherwise(F.col("finished_at")).alias("finished_at"))


def q_sitemap_diff(spark, d):
    """Addresses of the last quarter of ids that earlier ones lack."""
    urls = table(spark, d, "machines").select("id", F.lower(F.regexp_replace("thumbnail_url", r"[?#].*$", "")).alias("url")).where("url is not null")
    return urls.where("id % 4 = 0").select("url").distinct().join(urls.where("id % 4 <> 0").select("url"), "url", "left_anti")


_RUNS = "(select id, lower(status) as status, website_id, machines_found, machines_new, machines_updated, errors_count, started_at, finished_at from (select *, row_number() over (partition by id order by started_at desc nulls last, finished_at desc nulls last, status desc nulls last) as rn from crawl_logs where id is not null) where rn=1)"
_IN = f"""(select content_hash, cast(price*2 as decimal(14,2)) as price, case when id%4=0 then '' else description end as description, timestamp '{NOW}' as last_crawled_at, id, brand from machines where id%2=0
  union all select 'new-'||content_hash, price, description, timestamp '{NOW}', id+100000000, brand from machines where id%5=1)"""
_NAMES = "(select id as website_id, name from websites)"

QUERIES = {f.__name__: f for f in (q_dashboard, q_recent_crawls, q_crawl_report, q_latest_run, q_status_counts, q_crawl_health, q_deviation, q_recount, q_schedule, q_admin_list, q_point_lookup, q_export, q_machine_detail, q_topk_per_group, q_top_specs, q_detail_specs, q_admin_filter, q_migrate, q_crawl_totals, q_saved_list, q_saved, q_upsert, q_upsert_touch, q_upsert_counts, q_patch, q_delete_cascade, q_insert_absent, q_reset_stuck, q_sitemap_diff)}
ORACLE_SQL = {
    "q_dashboard": "select (select count(*) from machines) as machines, (select count(*) from websites) as websites, (select count(*) from machine_images) as machine_images, (select count(*) from machine_specs) as machine_specs",
    "q_recent_crawls": f"select id, coalesce(name,'Website #'||coalesce(cast(website_id as varchar),'?')) as site, status, started_at from (select * from {_RUNS} order by started_at desc nulls last, id desc limit 200) r left join {_NAMES} n using (website_id)",
    "q_crawl_report": f"select id, coalesce(name,'-') as site, status, cast(trunc((epoch_us(finished_at)-epoch_us(started_at))/1000000.0) as bigint) as seconds, machines_found from {_RUNS} r left join {_NAMES} n using (website_id)",
    "q_latest_run": f"select website_id, id as run_id, started_at from (select *, row_number() over (partition by website_id order by started_at desc, id desc) as k from {_RUNS} where website_id is not null and started_at is not null) where k=1",
    "q_status_counts": f"select status, count(*) as n, cast(sum(machines_found) as bigint) as found, cast(sum(coalesce(errors_count,0)) as bigint) as errors from {_RUNS} group by status",
    "q_crawl_health": f"select id, website_id, machines_found, before, failed3 from (select id, website_id, machines_found, lag(machines_found) over w as before, cast(sum(case when status='error' then 1 when status is null then null else 0 end) over (partition by website_id order by started_at, id rows between 2 preceding and current row) as bigint) as failed3 from {_RUNS} where website_id is not null and started_at is not null window w as (partition by website_id order by started_at, id)) where machines_found < 0.8*before or failed3=3",
    "q_deviation": "select website_id, machine_count, n, round(abs(machine_count-n)/cast(n as double),6) as off from (select id as website_id, machine_count from websites) s join (select website_id, count(*) as n from machines group by 1) r using (website_id) where n>0 and machine_count is not null and round(abs(machine_count-n)/cast(n as double),6)>0.2",
    "q_recount": "select s.id as website_id, count(m.id) as n_all, count(m.id) filter (where m.is_active) as n_active from websites s left join machines m on m.website_id=s.id group by s.id",
    "q_schedule": "select id, place, cast(place*floor(86400/n) as bigint) as offset_s from (select id, row_number() over (order by last_crawled_at asc nulls first, id)-1 as place, count(*) over () as n from websites where is_active and crawl_enabled)",
    "q_admin_list": "select id, website_id, brand, model, price, is_active, created_at from machines where contains(lower(machine_type),'press') and coalesce(is_active,true)",
    "q_point_lookup": "select id, content_hash from machines where id in (select machine_id from machine_images where is_primary)",
    "q_export": "select id as ID, brand as Brand, model as Model, cast(price as double) as Price, strftime(created_at,'%Y-%m-%d %H:%M:%S') as Created from machines",
    "q_machine_detail": """select m.id, coalesce(i.url, m.thumbnail_url) as picture, coalesce(i.n,0) as n_images, coalesce(s.n,0) as n_specs from machines m
        left join (select machine_id, count(*) as n, arg_min(struct_pack(u:=image_url), row_no).u as url from (select *, row_number() over (partition by machine_id order by not coalesce(is_primary,false), id, image_url nulls first) as row_no from machine_images) group by 1) i on i.machine_id=m.id
        left join (select machine_id, count(*) as n from machine_specs group by 1) s on s.machine_id=m.id""",
    "q_topk_per_group": "select machine_id, id, place, place=1 as is_first from (select machine_id, id, row_number() over (partition by machine_id order by id) as place from machine_images where machine_id is not null) where place<=5",
    "q_saved": "select o_custkey, count(distinct l_partkey) as n_saved, max(o_orderdate) as newest from orders join lineitem on l_orderkey=o_orderkey join part on p_partkey=l_partkey group by 1",
    "q_upsert": f"""select coalesce(t.content_hash,s.content_hash) as content_hash, case when t.content_hash is null then s.id else t.id end as id, case when t.content_hash is null then s.price when s.content_hash is not null then coalesce(s.price,t.price) else t.price end as price,
        length(case when t.content_hash is null then s.description when s.content_hash is not null then coalesce(nullif(s.description,''),t.description) else t.description end) as n_text,
        case when s.content_hash is not null then s.last_crawled_at else t.last_crawled_at end as last_crawled_at,
        case when t.content_hash is null then 'inserted' when s.content_hash is not null then 'updated' else 'kept' end as change from (select * from machines where content_hash is not null) t full join {_IN} s on s.content_hash=t.content_hash""",
    "q_upsert_touch": f"select coalesce(t.content_hash,s.content_hash) as content_hash, case when t.content_hash is null then s.price else t.price end as price, case when s.content_hash is not null then s.last_crawled_at else t.last_crawled_at end as last_crawled_at from (select * from machines where content_hash is not null) t full join {_IN} s on s.content_hash=t.content_hash",
    "q_upsert_counts": f"select case when t.content_hash is null then 'inserted' when s.content_hash is not null then 'updated' else 'kept' end as change, count(*) as n from (select * from machines where content_hash is not null) t full join {_IN} s on s.content_hash=t.content_hash group by 1",
    "q_patch": "select id, case when id%10=3 then 'Patched' else brand end as brand, case when id%20=3 then null else location end as location, price from machines",
    "q_delete_cascade": """with doomed as (select id from machines where website_id%7=0)
        select 'parent' as kept, count(*) as n from machines where id not in (select id from doomed) union all select 'images', count(*) from machine_images i where not exists (select 1 from doomed where doomed.id=i.machine_id)
        union all select 'specs', count(*) from machine_specs s where not exists (select 1 from doomed where doomed.id=s.machine_id)""",
    "q_insert_absent": "select id, url from websites union all select max(id) as id, url from (select website_id+1000 as id, 'https://'||lower(website_source) as url from machines where website_source is not null) where url not in (select url from websites where url is not null) group by url",
    "q_reset_stuck": f"select id, case when status='running' and finished_at is null then 'error' else status end as status, case when status='running' and finished_at is null then timestamp '{NOW}' else finished_at end as finished_at from {_RUNS}",
    "q_sitemap_diff": "with u as (select id, lower(regexp_replace(thumbnail_url,'[?#].*$','')) as url from machines where thumbnail_url is not null) select distinct url from u where id%4=0 and url not in (select url from u where id%4<>0)",
    "q_top_specs": "select machine_id, id, left(spec_key,100) as spec_key, left(spec_value,500) as spec_value from (select *, row_number() over (partition by machine_id order by id, spec_key nulls first, spec_value nulls first) as place from (select distinct machine_id, id, spec_key, spec_value from machine_specs where machine_id is not null)) where place<=50",
    "q_detail_specs": "select m.id, coalesce(s.specs,'') as specs from machines m left join (select machine_id, string_agg(spec_key||'='||coalesce(spec_value,''),';' order by id, spec_key, spec_value nulls first) as specs from machine_specs where spec_key is not null group by 1) s on s.machine_id=m.id",
    "q_admin_filter": "select id, website_id, machine_type, brand, model, stock_number, price, currency, location, condition, year, machine_url, is_active, created_at, last_crawled_at from machines where website_id<=40 and contains(lower(machine_type),'e') and contains(lower(brand),'o') and (coalesce(contains(lower(brand),'an'),false) or coalesce(contains(lower(model),'an'),false) or coalesce(contains(lower(machine_type),'an'),false)) and is_active",
    "q_migrate": "select id, name, cast(null as varchar) as url, cast(null as integer) as discovered from websites union all select id+1000, null, url, 0 from websites where is_active",
    "q_crawl_totals": f"select count(*) as runs, cast(sum(machines_found) as bigint) as found, cast(sum(coalesce(machines_new,0)+coalesce(machines_updated,0)) as bigint) as kept, cast(sum(errors_count) as bigint) as errors from {_RUNS}",
    "q_saved_list": "select o_custkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey, p_partkey) as place, o_orderkey, p_partkey, p_name from (select distinct l_orderkey, l_partkey from lineitem) join orders on o_orderkey=l_orderkey join part on p_partkey=l_partkey",
}
