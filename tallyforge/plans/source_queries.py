"""Dictionary, JSON, HTML, sitemap, API and streaming queries.

The listing tables hold no raw pages, so pages and payloads are first written
out of the tables' own rows, in several shapes, and read back by the operators:
the tables then say exactly what has to come out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_ops as J
from ..functions import text as T
from ..functions import urls as U
from ..operators import dictionary as D
from ..runtime import shared_dir, table
from ..sources import api_pages, html, shops, sinks, sitemap
from ..streaming import incremental
from . import sqltext as Q


def _m(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "machines")


def _types(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    return D.terms(table(spark, d, "type_ref"), "type_name", "synonyms")


def q_normalize_type(spark, d):
    return _m(spark, d).select("id", D.canonical(F.col("machine_type"), _types(spark, d)).alias("type"))


def q_fill_types(spark, d):
    """Missing types from the maker's most frequent known type, else from the name."""
    dictionary = _types(spark, d)
    typed = _m(spark, d).select("id", F.col("brand"), F.nullif(F.trim("machine_type"), F.lit("")).alias("machine_type"), "machine_name")
    usual = typed.where("machine_type is not null and brand is not null").select("brand", D.known(F.col("machine_type"), dictionary).alias("t")).where("t is not null")
    usual = usual.groupBy("brand", "t").agg(F.count("*").alias("n")).groupBy("brand").agg(F.max_by("t", F.struct("n", "t")).alias("usual"))
    filled = F.coalesce("machine_type", "usual", D.known(F.col("machine_name"), dictionary))
    return typed.join(usual, "brand", "left").select("id", filled.alias("type"))


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """API pages of at most 100 items by id; the key of the items and of the total and the fields' names vary by page."""
    k = F.col("id") % 3
    name = F.coalesce("machine_name", F.lit("?"))
    item = F.when(k == 0, F.to_json(F.struct("id", name.alias("title"), F.col("brand").alias("make"), F.col("price").cast("double").alias("preis"), F.col("machine_url").alias("url")))).when(
        k == 1, F.to_json(F.struct("id", name.alias("name"), F.col("brand").alias("manufacturer"), F.col("price").cast("double").alias("price"), F.concat(F.lit("s-"), F.col("id").cast("string")).alias("slug")))
    ).otherwise(F.to_json(F.struct(F.col("id"), name.alias("label"), F.col("brand").alias("brand"), F.col("price").cast("double").alias("prix"))))
    rows = _m(spark, d).select("id", F.floor(F.col("id") / 100).alias("page"), item.alias("item"))
    pages = rows.groupBy("page").agg(F.count("*").alias("n"), F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "item"))), lambda x: x["item"]), ","), F.lit("]")).alias("list"))
    payload = F.when(F.col("page") % 3 == 0, F.format_string('{"pagination":{"total":%d},"data":%s}', "n", "list")).when(F.col("page") % 3 == 1, F.format_string('{"totalCount":%d,"results":%s}', "n", "list")).otherwise(F.col("list"))
    return pages.select("page", payload.alias("payload"))


def q_json_path(spark, d):
    return _payloads(spark, d).select("page", J.at(F.col("payload"), "pagination.total").cast("bigint").alias("total"), J.at(F.col("payload"), "data[0].id").cast("bigint").alias("first_id"))


def q_json_total(spark, d):
    return _payloads(spark, d).select("page", J.total(F.col("payload")).alias("total"))


def _items(spark, d):
    return _payloads(spark, d).select("page", F.explode(J.items(F.col("payload"))).alias("item"))


def q_json_items(spark, d):
    return _items(spark, d).select("page", J.at(F.col("item"), "id").cast("bigint").alias("id"))


def q_api_items(spark, d):
    item = F.col("item")
    return _items(spark, d).select(J.at(item, "id").cast("bigint").alias("id"), J.field(item, "machine_name").alias("name"), J.field(item, "brand").alias("brand"), J.field(item, "price").try_cast("double").alias("price"))


def q_product_url(spark, d):
    return _items(spark, d).select(J.at(F.col("item"), "id").cast("bigint").alias("id"), J.product_url(F.col("item"), F.lit("https://shop.example")).alias("url"))


def q_json_config(spark, d):
    props = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return table(spark, d, "events").select("event_id", F.try_element_at(props, F.lit("k")).cast("bigint").alias("k"))


def q_json_products(spark, d):
    """Products found at any depth of a nested payload."""
    nested = F.concat(F.lit('{"props":{"page":{"state":{"listing":'), "payload", F.lit("}}}}"))
    return _payloads(spark, d).select("page", J.search_payload(nested).alias("s")).select("page", "s.n_products")


def q_json_count(spark, d):
    return _payloads(spark, d).select("page", J.search_payload(F.col("payload")).alias("s")).select("page", "s.claimed")


def q_api_pages(spark, d):
    """Payloads landed and read again by item."""
    folder = f"{shared_dir(spark).rstrip('/')}/landed/{uuid.uuid4().hex}"
    api_pages.land(_payloads(spark, d), folder)
    return api_pages.read_items(spark, folder).select("page", "ord", J.at(F.col("item"), "id").cast("bigint").alias("id"))


def q_api_scan(spark, d):
    """Where a scan of each site's pages ends: sites are the hundreds of pages, a page of fewer than 100 items ends them."""
    rows = _payloads(spark, d).withColumn("site", F.floor(F.col("page") / 10))
    return api_pages.until_end(rows, "site", "page", "payload", 100).select("site", "page")


def q_api_cursor(spark, d):
    """Pages in the order of their cursors."""
    chain = table(spark, d, "websites").select(F.concat(F.lit("c"), "id").alias("cursor"), F.concat(F.lit("c"), F.col("id") % 60 + 1).alias("following"))
    return api_pages.by_cursor(chain.where("cursor in ('c1','c2','c3','c4','c5','c6','c7','c8')"), "cursor", "following", "c1")


def q_api_records(spark, d):
    """Items as whole records: fields by a map of the caller's or by the known keys, with year, condition, currency and model from the words where they are not stated."""
    item = F.col("item")
    name, text = J.mapped(item, {}, "machine_name"), F.coalesce(J.mapped(item, {"description": "long_text"}, "description"), F.lit(""))
    words = F.concat_ws(" ", name, text)
    year = F.coalesce(J.field(item, "year").try_cast("int"), T.year(words, 2026))
    rows = _m(spark, d).select(F.to_json(F.struct("id", F.coalesce("machine_name", F.lit("?")).alias("title"), F.col("brand").alias("marque"), F.col("machine_type").alias("category"), F.concat(F.lit("EUR "), F.col("price").cast("string")).alias("prix"), F.col("description").alias("long_text"), F.when(F.col("id") % 2 == 0, F.col("year")).alias("baujahr"), F.col("stock_number").alias("sku"))).alias("item"))
    return rows.select(
        J.at(item, "id").cast("bigint").alias("id"), name.alias("name"), F.coalesce(J.field(item, "brand"), F.lit("")).alias("brand"), F.coalesce(J.field(item, "machine_type"), F.lit("")).alias("machine_type"),
        T.price(J.field(item, "price")).alias("price"), T.currency(F.coalesce(J.field(item, "price"), F.lit(""))).alias("currency"), F.coalesce(J.field(item, "stock_number"), F.lit("")).alias("stock_number"),
        F.coalesce(J.field(item, "model"), T.model_number(T.fold(name)), F.lit("")).alias("model"), year.alias("year"), T.condition(words).alias("condition"),
    )


def q_embedded_json(spark, d):
    """Items and claimed numbers of JSON that pages carry in their scripts."""
    carried = F.when(F.col("page") % 2 == 0, F.concat(F.lit('<html><script id="state" type="application/json">'), "payload", F.lit("</script></html>"))).otherwise(F.concat(F.lit("<html><script>window.data = "), "payload", F.lit(";</script></html>")))
    rows = _payloads(spark, d).select("page", F.replace("payload", F.lit("<"), F.lit("(")).alias("payload")).select("page", F.explode(html.embedded(carried)).alias("json"))
    return rows.select("page", J.search_payload(F.col("json")).alias("s")).select("page", "s.n_products")


def q_shop_kind(spark, d):
    """Which shop system a landed payload is from."""
    every = _shop_pages(spark, d, "a").unionByName(_shop_pages(spark, d, "b")).unionByName(_payloads(spark, d).select("payload"))
    return every.groupBy(J.shop_kind(F.col("payload")).alias("kind")).agg(F.count("*").alias("n"))


def q_api_settings(spark, d):
    """Settings of each site over their defaults."""
    rules = F.when(F.col("id") % 3 == 0, F.format_string('{"page_size":"%d","path":""}', "id")).when(F.col("id") % 3 == 1, "no json")
    return table(spark, d, "websites").select("id", J.configured(rules, {"page_size": "100", "path": "/api"}).alias("s")).select("id", F.element_at("s", "page_size").alias("page_size"), F.element_at("s", "path").alias("path"))


def q_log_files(spark, d):
    """Log rows appended with their long texts cut, and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/logs/{uuid.uuid4().hex}"
    sinks.append_log(table(spark, d, "crawl_logs").select("id", "error_details", "log_output"), folder)
    return spark.read.parquet(folder)


def q_export_files(spark, d):
    """The export's columns as text files with a head, and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/exports/{uuid.uuid4().hex}"
    sinks.export_csv(_m(spark, d), folder, {"id": "ID", "website_id": "Site", "price": "Price"})
    return spark.read.option("header", "true").schema("ID long, Site long, Price decimal(14,2)").csv(folder)


def q_json_files(spark, d):
    """Results as JSON lines, and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/results/{uuid.uuid4().hex}"
    sinks.export_json(_m(spark, d).select("id", "brand"), folder)
    return spark.read.schema("id long, brand string").json(folder)


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """(id, url, html): a page for each listing. By id, its data stand in JSON-LD, OpenGraph, marked elements or only in headings."""
    name, brand = F.coalesce("machine_name", F.lit("Untitled")), F.coalesce(F.nullif(F.trim("brand"), F.lit("")), F.lit("Unbranded"))
    price = F.coalesce(F.col("price").cast("string"), F.lit("0.00"))
    data = F.to_json(F.struct(F.lit("Product").alias("@type"), name.alias("name"), F.struct(brand.alias("name")).alias("brand"), F.array(F.struct(price.alias("price"), F.lit("EUR").alias("priceCurrency"))).alias("offers")))
    k = F.col("id") % 4
    head = F.when(k == 0, F.concat(F.lit('<script type="application/ld+json">'), F.replace(data, F.lit("</"), F.lit("<\\/")), F.lit("</script>"))).when(
        k == 1, F.concat(F.lit('<meta property="og:title" content="'), F.replace(_escaped(name), F.lit('"'), F.lit("&quot;")), F.lit('"><meta property="product:brand" content="'), F.replace(_escaped(brand), F.lit('"'), F.lit("&quot;")), F.lit('">'))).otherwise("")
    body = F.when(k == 2, F.concat(F.lit('<span itemprop="brand">'), _escaped(brand), F.lit('</span><div class="price">'), price, F.lit("</div>"))).otherwise("")
    nav = F.concat(F.lit('<nav><ul><li><a href="/en/machines/'), F.col("id").cast("string"), F.lit('">M</a><a href="/cart">Cart</a></li></ul></nav>'))
    more = F.when(F.col("id") % 2 == 0, F.concat(F.lit('<a rel="next" href="?page='), (F.col("id") % 7 + 2).cast("string"), F.lit('">Weiter</a>'))).otherwise(F.lit('<a href="mailto:a@b.example">Mail</a><a href="#top">Top</a>'))
    specs = F.concat(F.lit("<table><tr><th>Id</th><td>"), F.col("id").cast("string"), F.lit("</td></tr></table><dl><dt>Site</dt><dd>"), F.coalesce(F.col("website_id").cast("string"), F.lit("0")), F.lit("</dd><dt>Typ</dt><dd>T1</dd><dt>Baujahr</dt><dd>"), (F.col("id") % 70 + 1950).cast("string"), F.lit("</dd></dl>"))
    page = F.concat(F.lit("<html><head><title>T</title><style>p{}</style>"), head, F.lit("</head><body>"), nav, F.lit("<h1>"), _escaped(name), F.lit("</h1><!-- x -->"), body, specs, F.lit('<img src="/p.jpg"><img src="/i.png" width="16">'), more, F.lit("</body></html>"))
    return _m(spark, d).select("id", F.concat(F.lit("https://site.example/list/"), F.col("id").cast("string")).alias("url"), page.alias("html"))


def q_extract_pages(spark, d):
    r = html.records(_pages(spark, d), "id", "html")
    spec = F.element_at(F.map_from_arrays("spec_keys", "spec_values"), "Id").cast("bigint")
    return r.select("id", "name", "brand", "price", "currency", F.size("images").alias("n_images"), F.size("spec_keys").alias("n_specs"), spec.alias("spec_id"), "type", "year")


def q_internal_links(spark, d):
    links = html.anchors(_pages(spark, d), "id", "html", "url")
    resolved = links.select("id", "zone", U.absolute(F.col("href"), F.col("url")).alias("link"), "url")
    same = U.host_key(U.authority(F.col("link"))) == U.host_key(U.authority(F.col("url")))
    return resolved.where(same & ~U.is_skipped(F.col("link"))).select("id", "zone", "link")


def q_next_page(spark, d):
    return html.next_links(html.anchors(_pages(spark, d), "id", "html"))


def q_pagination(spark, d):
    """Addresses of all pages after the first."""
    n = html.last_page(html.anchors(_pages(spark, d), "id", "html")).where("pages > 1")
    return n.select("id", F.explode(F.sequence(F.lit(2), F.col("pages"))).alias("page"))


def q_jsonld(spark, d):
    """Only the JSON-LD layer: the product's name and maker, straight from the script by built-ins."""
    script = F.regexp_extract("html", r'(?s)<script type="application/ld\+json">(.*?)</script>', 1)
    rows = _pages(spark, d).select("id", F.replace(script, F.lit("<\\/"), F.lit("</")).alias("j")).where("j <> ''")
    return rows.where(F.get_json_object("j", "$.@type") == "Product").select("id", F.get_json_object("j", "$.name").alias("name"), F.get_json_object("j", "$.brand.name").alias("brand"))


def q_og_meta(spark, d):
    """Only the OpenGraph layer."""
    pages = _pages(spark, d).select("id", F.regexp_extract("html", '<meta property="og:title" content="([^"]*)"', 1).alias("title"))
    return pages.where("title <> ''").select("id", F.replace(F.replace(F.replace(F.replace("title", F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")).alias("title"))


def _shop_pages(spark, d, kind):
    m = _m(spark, d).select("id", "brand", F.coalesce("machine_name", F.lit("")).alias("name"), "machine_type", F.col("price").cast("string").alias("price"), "stock_number", "thumbnail_url")
    picture = F.array(F.struct(F.col("thumbnail_url").alias("src")))
    slug = F.concat(F.lit("m-"), F.col("id").cast("string"))
    if kind == "a":
        item = F.struct(F.col("name").alias("title"), F.col("brand").alias("vendor"), F.col("machine_type").alias("product_type"), slug.alias("handle"), F.array(F.struct("price", F.col("stock_number").alias("sku"))).alias("variants"), picture.alias("images"))
    else:
        item = F.struct("name", slug.alias("slug"), F.col("stock_number").alias("sku"), "price", F.array(F.struct(F.col("brand").alias("name"))).alias("brands"), F.array(F.struct(F.col("machine_type").alias("name"))).alias("categories"), picture.alias("images"))
    listed = m.select(F.floor(F.col("id") / 100).alias("page"), item.alias("item")).groupBy("page").agg(F.collect_list("item").alias("products"))  # pages of at most 100 items
    return listed.select(F.to_json(F.struct("products") if kind == "a" else F.col("products")).alias("payload"))


def q_shop_products(spark, d):
    out = shops.products_json(_shop_pages(spark, d, "a"), "payload", F.lit("https://a.example"))
    return out.select("machine_name", "brand", "model", "machine_type", "price", "stock_number", F.size("images").alias("n_images"), "source_url")


def q_shop_list(spark, d):
    out = shops.product_list(_shop_pages(spark, d, "b"), "payload", F.lit("https://b.example"))
    return out.select("machine_name", "brand", "model", "machine_type", "price", F.size("images").alias("n_images"), "source_url")


def q_api_details(spark, d):
    """Pictures and specifications of items, in each of the shapes they come in."""
    k = F.col("id") % 3
    u = F.coalesce("thumbnail_url", F.lit("http://none"))
    item = F.when(k == 0, F.to_json(F.struct(F.col("id"), F.array(F.struct(u.alias("src")), F.struct(u.alias("src"))).alias("photos"), F.struct(F.col("year").cast("string").alias("Year"), F.lit("5").alias("kW")).alias("specs")))).when(
        k == 1, F.to_json(F.struct(F.col("id"), F.array(u).alias("images"), F.array(F.struct(F.lit("kW").alias("name"), F.lit("7").alias("value"))).alias("attributes")))).otherwise(F.to_json(F.struct(F.col("id"), u.alias("gallery"))))
    rows = _m(spark, d).select(item.alias("item"))
    return rows.select(J.at(F.col("item"), "id").cast("bigint").alias("id"), F.size(J.images(F.col("item"))).alias("n_images"), F.get(J.images(F.col("item")), F.lit(0)).alias("first_image"), F.try_element_at(J.specs(F.col("item")), F.lit("kW")).alias("kw"))


def q_page_text(spark, d):
    return _pages(spark, d).select("id", html.visible_text(F.col("html")).alias("text"))


def q_js_rendered(spark, d):
    return _pages(spark, d).select("id", html.needs_rendering(F.col("html"), 3).alias("needs_script"))


def q_api_endpoints(spark, d):
    """Endpoints named in page scripts."""
    source = F.concat(F.lit("<script>fetch('/api/v1/machines/"), F.col("id").cast("string"), F.lit("');var apiUrl = \"https://x.example/rest/items\";load('/data/list.json?p=1')</script>"))
    rows = _m(spark, d).select("id", source.alias("s"))
    return rows.select("id", F.explode(J.endpoints(F.col("s"))).alias("endpoint"))


def q_rsc_hrefs(spark, d):
    """Links in a streamed page state, split into product pages and the rest."""
    source = F.concat(F.lit('1:["$","a",{"href":"/machines/'), F.col("id").cast("string"), F.lit('"}]2:{"href":"/about"}'))
    rows = _m(spark, d).select("id", F.explode(F.regexp_extract_all(source, F.lit('"href":"([^"]+)"'), F.lit(1))).alias("href"))
    return rows.select("id", "href", F.col("href").rlike(U.PRODUCT_PATTERN).alias("product"))


def _sitemaps(spark: SparkSession, d: str) -> DataFrame:
    """Files of at most 200 addresses; every tenth is cut off, and one index names all."""
    rows = _m(spark, d).where("machine_url is not null").select(F.floor(F.col("id") / 200).alias("k"), "machine_url")
    body = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.transform(F.sort_array(F.collect_list("machine_url")), lambda u: F.concat(F.lit("<url><loc> "), _escaped(u), F.lit(" </loc></url>"))), ""), F.lit("</urlset>"))
    files = rows.groupBy("k").agg(body.alias("xml")).select(F.concat(F.lit("https://s.example/sm-"), F.col("k").cast("string"), F.lit(".xml")).alias("url"), F.when(F.col("k") % 10 == 9, F.expr("left(xml, length(xml) - 5)")).otherwise(F.col("xml")).alias("xml"))
    return files


def q_sitemap_parse(spark, d):
    return sitemap.parse(_sitemaps(spark, d)).select("source", "loc", U.is_sitemap_product(F.col("loc")).alias("product"))


def q_sitemap_urls(spark, d):
    """Pages reached from one index over its sitemaps; the index also names itself."""
    files = _sitemaps(spark, d)
    names = files.select(F.regexp_replace("url", r"[0-9]+\.xml$", "").alias("p"), "url")
    # an index of the files: one per 200 addresses, grouped by their last digit into ten indexes below one root
    part = F.regexp_extract("url", r"([0-9])\.xml$", 1)
    index = names.groupBy(part.alias("part")).agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform(F.sort_array(F.collect_list("url")), lambda u: F.concat(F.lit("<sitemap><loc>"), u, F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("xml"))
    indexes = index.select(F.concat(F.lit("https://s.example/index-"), "part", F.lit(".xml")).alias("url"), "xml")
    loops = "".join(f"<sitemap><loc>https://s.example/{n}.xml</loc></sitemap>" for n in ("root", *[f"index-{k}" for k in range(10)]))
    root = spark.createDataFrame([("https://s.example/root.xml", f"<sitemapindex>{loops}</sitemapindex>")], "url string, xml string")
    return sitemap.collect_urls(files.unionByName(indexes).unionByName(root), root)


def q_stream_dedupe(spark, d):
    stream = incremental.read_files(spark, f"{d}/crawl_logs.parquet")
    return spark.read.parquet(incremental.run_to_table(incremental.deduplicated(stream, "id", "started_at").select("id"), "dedupe"))


def q_stream_upsert(spark, d):
    path = incremental.upsert_stream(incremental.read_files(spark, f"{d}/machines.parquet", 2), "content_hash", "last_crawled_at", ["id", "price"])
    return spark.read.parquet(path)


_TERMS = f"(select term, min(name) as canonical from (select {Q.clean('x')} as term, type_name as name from (select type_name, unnest(list_concat([type_name], string_split(coalesce(synonyms,''),';'))) as x from type_ref)) where term<>'' group by 1)"
_ITEM_NAME = "coalesce(machine_name,'?')"
_PRICE = "cast(price as double)"
_NAME, _BRAND = "coalesce(machine_name,'Untitled')", "coalesce(nullif(regexp_replace(brand,'^ +| +$','','g'),''),'Unbranded')"
_SPACE = "regexp_replace(regexp_replace({},'\\s+',' ','g'),'^ +| +$','','g')"
_SQUEEZED = "trim(regexp_replace({},'[\\s ]+',' ','g'))"
_FILE = "'https://s.example/sm-'||cast(floor(id/200) as bigint)||'.xml'"

QUERIES = {f.__name__: f for f in (q_normalize_type, q_fill_types, q_json_path, q_json_total, q_json_items, q_api_items, q_product_url, q_json_config, q_json_products, q_json_count, q_api_pages, q_api_scan, q_api_cursor, q_api_records, q_embedded_json, q_shop_kind, q_api_settings, q_log_files, q_export_files, q_json_files, q_extract_pages, q_internal_links, q_next_page, q_pagination, q_page_text, q_jsonld, q_og_meta, q_shop_products, q_shop_list, q_api_details, q_js_rendered, q_api_endpoints, q_rsc_hrefs, q_sitemap_parse, q_sitemap_urls, q_stream_dedupe, q_stream_upsert)}
ORACLE_SQL = {
    "q_normalize_type": f"""with t as {_TERMS}, m as (select id, machine_type, {Q.clean('machine_type')} as key from machines), best as (select m.id, arg_max(canonical, struct_pack(e:=(term=key)::int, n:=length(term), o:=-rn)) as c from m join (select *, row_number() over (order by term) as rn from t) t on contains(m.key, t.term) where m.key<>'' group by 1)
        select id, case when key<>'' then coalesce(c, {Q.title_case(Q.outer('machine_type'))}) end as type from m left join best using (id)""",
    "q_fill_types": f"""with t as (select *, row_number() over (order by term) as rn from {_TERMS}), m as (select id, brand, nullif(trim(machine_type),'') as mt, machine_name from machines),
        kn as (select m.id, arg_max(canonical, struct_pack(n:=length(term), o:=-rn)) as c from m join t on contains({Q.clean('m.mt')}, t.term) group by 1),
        nn as (select m.id, arg_max(canonical, struct_pack(n:=length(term), o:=-rn)) as c from m join t on contains({Q.clean('m.machine_name')}, t.term) group by 1),
        u as (select brand, arg_max(c, struct_pack(n:=n, c:=c)) as usual from (select brand, c, count(*) as n from m join kn using (id) where brand is not null group by 1,2) group by 1)
        select m.id, coalesce(mt, usual, nn.c) as type from m left join u on u.brand=m.brand left join nn on nn.id=m.id""",
    "q_json_path": "select page, case when page%3=0 then n end as total, case when page%3=0 then lo end as first_id from (select cast(floor(id/100) as bigint) as page, count(*) as n, min(id) as lo from machines group by 1)",
    "q_json_total": "select page, case when page%3<2 then n else 0 end as total from (select cast(floor(id/100) as bigint) as page, count(*) as n from machines group by 1)",
    "q_json_items": "select cast(floor(id/100) as bigint) as page, id from machines",
    "q_api_items": f"select id, {_ITEM_NAME} as name, brand, {_PRICE} as price from machines",
    "q_product_url": "select id, case when id%3=0 and machine_url like 'http%' then machine_url when id%3=1 then 'https://shop.example/products/s-'||id else 'https://shop.example/products/'||id end as url from machines",
    "q_json_config": "select event_id, cast(json_extract_string(props,'$.k') as bigint) as k from events",
    "q_json_products": "select cast(floor(id/100) as bigint) as page, cast(count(*) as integer) as n_products from machines group by 1",
    "q_json_count": "select page, case when n>5 then n else 0 end as claimed from (select cast(floor(id/100) as bigint) as page, count(*) as n from machines group by 1)",
    "q_api_pages": "select page, cast(row_number() over (partition by page order by id)-1 as integer) as ord, id from (select cast(floor(id/100) as bigint) as page, id from machines)",
    "q_extract_pages": f"select id, case when id%4=0 then {_NAME} when id%4=1 then {_NAME} else {_SQUEEZED.format(_NAME)} end as name, case id%4 when 0 then {_BRAND} when 1 then {_BRAND} when 2 then {_SQUEEZED.format(_BRAND)} else '' end as brand, case when id%4 in (0,2) then coalesce({_PRICE},0.0) end as price, case when id%4=0 then 'EUR' else '' end as currency, 1 as n_images, 4 as n_specs, id as spec_id, 'T1' as type, cast(id%70+1950 as integer) as year from machines",
    "q_internal_links": "select id, 'nav' as zone, 'https://site.example/en/machines/'||id as link from machines union all select id, 'page', 'https://site.example/list/'||id||'?page='||(id%7+2) from machines where id%2=0",
    "q_next_page": "select id, '?page='||(id%7+2) as href from machines where id%2=0",
    "q_pagination": "select id, cast(unnest(range(2, id%7+3)) as integer) as page from machines where id%2=0",
    "q_page_text": "select id, " + _SPACE.format("'T M Cart '||" + _NAME + "||' '||case when id%4=2 then " + _BRAND + "||' '||coalesce(cast(price as varchar),'0.00')||' ' else '' end||'Id '||id||' Site '||coalesce(cast(website_id as varchar),'0')||' Typ T1 Baujahr '||(id%70+1950)||' '||case when id%2=0 then 'Weiter' else 'Mail Top' end") + " as text from machines",
    "q_jsonld": f"select id, {_NAME} as name, {_BRAND} as brand from machines where id%4=0",
    "q_og_meta": f"select id, {_NAME} as title from machines where id%4=1 and {_NAME}<>''",
    "q_shop_products": f"select case when coalesce(machine_name,'')='' then 'm-'||id else machine_name end as machine_name, {Q.strip_corporate('brand')} as brand, 'm-'||id as model, coalesce(machine_type,'') as machine_type, {_PRICE} as price, coalesce(stock_number,'') as stock_number, cast(coalesce(thumbnail_url,'')<>'' as integer) as n_images, 'https://a.example/products/m-'||id as source_url from machines",
    "q_shop_list": f"select coalesce(machine_name,'') as machine_name, {Q.strip_corporate('brand')} as brand, case when coalesce(stock_number,'')='' then 'm-'||id else stock_number end as model, coalesce(machine_type,'') as machine_type, {_PRICE} as price, cast(coalesce(thumbnail_url,'')<>'' as integer) as n_images, 'https://b.example/product/m-'||id as source_url from machines",
    "q_api_details": "select id, cast(case when id%3=0 then 2 else 1 end as integer) as n_images, coalesce(thumbnail_url,'http://none') as first_image, case id%3 when 0 then '5' when 1 then '7' end as kw from machines",
    "q_js_rendered": "select id, id%2=0 as needs_script from machines",
    "q_api_endpoints": "select id, unnest(['/api/v1/machines/'||id, 'https://x.example/rest/items', '/data/list.json?p=1']) as endpoint from machines",
    "q_rsc_hrefs": "select id, unnest(['/machines/'||id, '/about']) as href, unnest([true,false]) as product from machines",
    "q_sitemap_parse": f"select {_FILE} as source, trim(machine_url) as loc, not regexp_matches(trim(machine_url),{Q.q(U.SITEMAP_EXCLUDED_PATTERN)}) and regexp_matches(trim(machine_url),{Q.q(U.SITEMAP_PRODUCT_PATTERN)}) as product from machines where machine_url is not null and floor(id/200)%10<>9",
    "q_sitemap_urls": "select distinct trim(machine_url) as loc from machines where machine_url is not null and floor(id/200)%10<>9",
    "q_stream_dedupe": "select distinct id from crawl_logs where started_at is not null and id is not null",
    "q_stream_upsert": "select content_hash, last_crawled_at, id, price from machines where content_hash is not null",
    "q_api_scan": "with c as (select cast(floor(id/100) as bigint) as page, count(*) as n from machines group by 1), e as (select cast(floor(page/10) as bigint) as site, min(page) filter (where n<100) as last from c group by 1) select site, page from c join e on e.site=floor(c.page/10) where last is null or page<=last",
    "q_api_cursor": "select 'c'||(k+1) as cursor, cast(k as integer) as step from range(0,9) t(k)",
    "q_api_records": f"""select id, {_ITEM_NAME} as name, coalesce(brand,'') as brand, coalesce(machine_type,'') as machine_type, cast(price as double) as price, case when price is null then 'USD' else 'EUR' end as currency, coalesce(stock_number,'') as stock_number, coalesce(nullif(regexp_extract({Q.fold(_ITEM_NAME)},{Q.q(T.MODEL_PATTERN)},1),''),'') as model,
        coalesce(case when id%2=0 then year end, list_filter(list_transform(regexp_extract_all(t,'\\b(19[5-9][0-9]|20[0-2][0-9]|2030)\\b',1), lambda y: cast(y as integer)), lambda y: y<=2026)[1]) as year,
        case when regexp_matches(t,{Q.q(T.USED_PATTERN)}) then 'used' when regexp_matches(t,{Q.q(T.NEW_PATTERN)}) then 'new' else '' end as condition from (select *, concat_ws(' ',{_ITEM_NAME},coalesce(description,'')) as t from machines)""",
    "q_embedded_json": "select cast(floor(id/100) as bigint) as page, cast(count(*) as integer) as n_products from machines group by 1",
    "q_shop_kind": "with p as (select floor(id/100) as page from machines group by 1) select 'products' as kind, count(*) as n from p union all select 'list', count(*) from p union all select 'none', count(*) from p",
    "q_api_settings": "select id, case when id%3=0 then cast(id as varchar) else '100' end as page_size, '/api' as path from websites",
    "q_log_files": "select id, left(error_details,5000) as error_details, left(log_output,10000) as log_output from crawl_logs",
    "q_export_files": "select id as ID, website_id as Site, price as Price from machines",
    "q_json_files": "select id, brand from machines",
}
