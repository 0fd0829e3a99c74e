import re
from collections import defaultdict

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions import urls as U
from tallyforge.operators import links, mutations
from tallyforge.plans import training
from tallyforge.sources import html, sitemap

from .conftest import at, money


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_wide_tables_against_brute_force(spark, data):
    specs = []
    for k in range(240):
        label, value = [("Number of axes", str(k % 6 + 1)), ("CE mark", ["yes", "no", "?"][k % 3]), ("CONTROL", f"Unit  {k % 4}"), ("Colour", "red"), ("Weight", f"{k} kg"), ("number-of-axes", "n/a")][k % 6]
        specs.append((k, (k * 7) % 13, label, value, None))
    specs += [(1000 + k, 99, "CE mark", "yes", None) for k in range(500)]  # a hot entity
    specs += [(None, 1, "CE mark", "no", None), (2000, None, "CE mark", "no", None), (2001, 2, None, "no", None), (2002, 2, "CE mark", None, None)]
    d = data.put("machine_specs", specs, "attr_name string, text string, signature string").rest()
    best = {}
    names = {"numberofaxes": "axis_count", "cemark": "ce_marked", "control": "control_unit"}
    for i, m, label, value, _ in specs:
        if i is None or m is None or label is None or value is None:
            continue
        a = names.get(re.sub("[^a-z]", "", label.lower()))
        v = {"yes": "true", "no": "false"}.get(value) if a == "ce_marked" else " ".join(value.split())
        if a and v and value not in ("?", "n/a") and (m, a) not in best or a and v and value not in ("?", "n/a") and best[m, a][0] < i:
            best[m, a] = (i, v)
    assert rows(training.p1_found(spark, d)) == sorted((m, a, v) for (m, a), (_, v) in best.items())
    wide = training.p1_wide(spark, d)
    assert wide.columns == ["machine_id", "axis_count", "ce_marked", "control_unit", "weight"] and dict(wide.dtypes)["weight"] == "double"
    assert wide.where("machine_id = 99").count() == 1


def test_wide_tables_of_nothing(spark, data):
    d = data.rest()
    assert training.p1_found(spark, d).count() == 0 and training.p1_wide(spark, d).count() == 0
    data.put("spec_attributes", [])
    assert training.p1_found(spark, d).count() == 0


def test_units_and_prices(spark, data):
    d = (data.put("machine_specs", [(1, 1, "Weight", "2.5 t", "kg"), (2, 1, "Gewicht (lb)", "1,000", None), (3, 1, "Weight", "12", None), (4, 1, "Weight", "x" * 50_000, "kg"), (5, 1, None, None, None), (6, None, "Weight", "3 kg", None)], "number string")
         .put("machines", [{"id": 1, "price": money(10), "currency": "GBP"}, {"id": 2, "price": money("7.50"), "currency": " ", "description": "T\nPrice: 7,50 EUR"}, {"id": 3, "price": money(5), "currency": "??"}, {"id": 4}, {"id": 5, "price": money(9), "description": "no"}]).rest())
    assert rows(training.p7_found(spark, d)) == [("price", 1, 12), ("price", 2, 8), ("spec", 1, 2500), ("spec", 2, 454), ("spec", 6, 3)]


def test_large_amounts_are_not_rounded_twice(spark, data):
    amounts = {1: "1000000000", 2: "600000000", 3: "999999999999.50", 4: "0.49", 5: "0.50"}
    d = data.put("machines", [{"id": k, "price": money(v), "currency": "EUR"} for k, v in amounts.items()]).rest()
    assert rows(training.p7_found(spark, d)) == [("price", 1, 1_000_000_000), ("price", 2, 600_000_000), ("price", 3, 1_000_000_000_000), ("price", 4, 0), ("price", 5, 1)]


def test_text_goldens(spark):
    one = spark.range(1)
    check = {
        "fras maschine": T.clean(F.lit("  Fräs  Maschine ")), "dmgmori": T.slug(F.lit("DMG Mori")), "Reble": T.strip_corporate(F.lit("Reble GmbH")), "Acme": T.strip_corporate(F.lit("Acme Co. Ltd")),
        "QT-28 N": T.normal_model(F.lit("qt – 28  n")), "Acme-Tools O'Neil": T.title_case(F.lit("acme-tools o'neil")), "used": T.condition(F.lit("new, formerly used")),
        "AB-1234": T.stock_number(F.lit("Stock No: AB-1234")), "12345": T.stock_number(F.lit("Ref #12345")), "ST-1024": T.stock_number(F.lit("MAZAK QT28 (ST-1024)")), "AVAILABLE": T.stock_number(F.lit("Stock available")),
        "/machines/{slug}": U.path_pattern(F.lit("https://h/machines/used-volvo-2022")), "https://h/a": U.cleaned(F.lit("https://h/a?x=1#f")), "https://h/c": U.absolute(F.lit("../c"), F.lit("https://h/a/b")),
        "https://x/y": U.absolute(F.lit("//x/y"), F.lit("https://h/a/b")), "Reble Machinery": U.site_name(F.lit("https://reble-machinery.de/")),
    }
    got = one.select(*[c.cast("string").alias(f"c{k}") for k, c in enumerate(check.values())]).first()
    assert list(got) == list(check)
    prices = {"€ 1.234,56": 1234.56, "$1,234.56": 1234.56, "1.234": 1.234, "1,234": 1234.0, "5,00": 5.0, "1,234,56": None, "1.234.567": None, "POA": None, "": None}
    assert [r[0] for r in spark.createDataFrame([(k,) for k in prices], "s string").select(T.price(F.col("s"))).collect()] == list(prices.values())
    scores = spark.createDataFrame([("https://h/en/product/1",), ("https://h/x",), ("https://h/cart",), ("https://o/x",)], "u string")
    assert [r[0] for r in scores.select(U.link_score(F.col("u"), F.lit("https://h/"))).collect()] == [16, 1, 0, 0]
    assert one.select(T.year(F.lit("built 1949, 1998, 2030"), 2026)).first()[0] == 1998
    assert one.select(U.absolute(F.lit("mailto:z"), F.lit("https://h/"))).first()[0] is None


def test_upsert_is_idempotent_and_keeps_old_values(spark):
    t = spark.createDataFrame([("a", 1.0, "old", at(1)), ("b", 2.0, "kept", at(1))], "k string, p double, d string, t timestamp_ntz")
    s = spark.createDataFrame([("a", None, "", at(2)), ("c", 3.0, "new", at(2)), ("c", 4.0, "newer", at(3)), (None, 9.0, "x", at(3))], "k string, p double, d string, t timestamp_ntz")
    modes = {"p": "coalesce", "d": "coalesce", "t": "overwrite"}
    once = mutations.upsert(t, s, "k", modes, ["t"])
    assert rows(once) == [("a", 1.0, "old", at(2), "updated"), ("b", 2.0, "kept", at(1), "kept"), ("c", 4.0, "newer", at(3), "inserted")]
    assert rows(mutations.upsert(once.drop("change"), s, "k", modes, ["t"]).drop("change")) == rows(once.drop("change"))


def test_breadth_first_against_brute_force(spark):
    pairs = [(f"n{k}", f"n{(k * k + 3) % 31}") for k in range(40)] + [("n1", "n1"), (None, "n2"), ("n3", None)]
    got = dict((r.node, r.level) for r in links.breadth_first(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([("n5",), ("n5",)], "node string"), 5).collect())
    out, graph, front = {"n5": 0}, defaultdict(set), {"n5"}
    for a, b in pairs:
        graph[a].add(b)
    for level in range(1, 6):
        front = {b for a in front for b in graph[a] if b} - out.keys()
        out |= dict.fromkeys(front, level)
    assert got == out


PAGE = """<script type="application/ld+json">{"@type":"Product","name":"A","brand":{"name":"Acme"},"mpn":"X-200","sku":"S1","offers":[{"price":"1200","priceCurrency":"EUR"}],"image":"https://h/i.jpg","additionalProperty":[{"name":"Power","value":"5kW"}]}</script>
<meta property="og:title" content="B"><h1>C</h1><div class="price">€ 9.999,00</div><table class="specs"><tr><th>Weight</th><td>2t</td></tr></table><dl><dt>Axis</dt><dd>3</dd></dl>
<div class="gallery"><img src="/a.jpg"><img src="/icon.png" width="16"></div><a rel="next" href="?page=2">Weiter</a>"""


def test_layers_of_a_page(spark):
    r = html.record(PAGE)
    assert (r["name"], r["brand"], r["model"], r["stock"], r["price"], r["currency"], r["images"], r["spec_keys"]) == ("A", "Acme", "X-200", "S1", 1200.0, "EUR", ["https://h/i.jpg"], ["Power"])
    plain = html.record(PAGE[PAGE.index("<meta"):])
    assert (plain["name"], plain["price"], plain["spec_keys"], plain["images"]) == ("B", 9999.0, ["Weight", "Axis"], ["/a.jpg"])
    assert html.record(None)["name"] == "" and html.record("<div " * 1000 + "<!" + "x" * 9)["price"] is None
    links_ = html.anchors(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id long, html string"), "id", "html")
    assert rows(html.next_links(links_)) == [(1, "?page=2")]


FOREIGN = """<!doctype html><html><head><title>Offer</title>
<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"WebPage","name":"x"},{"@type":["Product","Thing"],"name":"Used lathe QT-28","brand":"Acme","offers":{"price":"4.500,00","priceCurrency":"EUR"}}]}</script></head>
<body><nav class="main-menu"><a href="/a">A</a></nav><h1>Lathe</h1><table><tr><td>Baujahr:</td><td>ca. 1998</td></tr><tr><td>Zustand</td><td>gebraucht</td></tr><tr><td>Typ</td><td>Lathe</td></tr></table></body></html>"""


def test_foreign_pages(spark):
    r = html.record(FOREIGN)
    assert (r["name"], r["brand"], r["price"], r["currency"], r["model"], r["type"], r["year"], r["condition"]) == ("Used lathe QT-28", "Acme", 4500.0, "EUR", "QT-28", "Lathe", 1998, "gebraucht")
    plain = html.record("<h1>New press AB 1200, built 2011</h1>")
    assert (plain["model"], plain["year"], plain["condition"], plain["price"]) == ("AB 1200", 2011, "new", None)
    nested = '<script type="application/ld+json">[{"@graph":[{"@graph":[{"@type":"Product","name":"Deep"}]}]}]</script>'
    assert html.record(nested)["name"] == "Deep"
    carried = spark.createDataFrame([('<script type="application/json"> {"a":[1]} </script><script>var x = [1,2];</script><script>var y = [1,;</script><script type="application/json">{"b":</script>',), ("",), (None,)], "h string")
    assert [r[0] for r in carried.select(html.embedded(F.col("h"))).collect()] == [['{"a":[1]}', "[1,2]"], [], None]


def test_scans_stop(spark):
    from tallyforge.sources import api_pages

    pages = [("a", 0, "[1,2]"), ("a", 1, "[1]"), ("a", 2, "[1,2]"), ("b", 0, "[1,2]"), ("b", 1, "[]"), ("b", 2, "no"), ("b", 3, "[1,2]"), ("c", 0, None), ("c", 1, "[1,2]"), ("c", None, "[1]")]
    got = api_pages.until_end(spark.createDataFrame(pages, "s string, p int, x string"), "s", "p", "x", 2).select("s", "p")
    assert rows(got) == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("b", 2), ("c", 0), ("c", 1)]
    ring = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x"), ("q", "x")], "cursor string, following string")
    assert rows(api_pages.by_cursor(ring, "cursor", "following", "x")) == [("x", 0), ("y", 1), ("z", 2)]


def test_sitemaps(spark):
    good = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://h/machine/1/ </loc></url></urlset>'
    assert sitemap.locations(good) == [("https://h/machine/1/", False)]
    assert sitemap.locations(good[:-4]) == [] and sitemap.locations(None) == [] and sitemap.locations('<!DOCTYPE x [<!ENTITY a "b">]><x/>') == []
    index = "<sitemapindex><sitemap><loc>r</loc></sitemap><sitemap><loc>s</loc></sitemap></sitemapindex>"
    files = spark.createDataFrame([("r", index), ("s", good), ("t", good)], "url string, xml string")
    assert rows(sitemap.collect_urls(files, spark.createDataFrame([("r",)], "url string"))) == [("https://h/machine/1/",)]


def test_looking_back_across_buckets(spark):
    from tallyforge.operators.rolling import look_back

    data = [("k" if n % 3 else "h", (n * 7) % 50, n) for n in range(120)] + [("solo", 1, 1)]
    df = spark.createDataFrame(data, "k string, t long, id long")
    got = {r.id if r.k != "solo" else -1: list(r.before) for r in look_back(df, "k", ["t", "id"], F.floor(F.col("t") / 9), F.col("t") * 1000 + F.col("id"), 3).collect()}
    for key in ("k", "h", "solo"):
        own = sorted((t, i) for k, t, i in data if k == key)
        for p, (_, i) in enumerate(own):
            assert got[-1 if key == "solo" else i] == [a * 1000 + b for a, b in reversed(own[max(0, p - 3): p])]
