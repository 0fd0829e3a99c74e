"""The registered queries on small tables: nulls everywhere, ties, repeats, long texts, clashing columns, nothing at all."""

from collections import Counter

import pytest

from tallyforge.llm.queries import QUERIES

from ..conftest import at, money

CLASH = "tokens string, rank string, key string, code string, n string, line string, block string, salt string, weight string, grp string, p string"
LONG = "word " * 40_000


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    from ..conftest import Data

    return Data(spark, tmp_path_factory.mktemp("empty")).rest()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    from ..conftest import Data

    none = {}
    machines = [none, none, {"id": 1}, {"id": 1}, {"id": 2, "description": LONG, "brand": LONG, "model": LONG, "machine_type": LONG, "dedup_key": "k", "website_id": 1}, {"id": 3, "description": "", "brand": " ", "dedup_key": "k", "price": money(5)},
                {"id": 4, "description": "\n\n", "model": "QX 4410", "website_id": None}, {"id": 5, "model": "QX 4410", "website_id": 2}, {"id": 5, "model": "QX 4410", "website_id": 2}, {"description": "no id", "dedup_key": "k"}]
    docs = [none, (1, None, None, None, None, None, None), (2, "", "en", "a", 0, None, None), (3, LONG, "en", "a", 1, None, None), (4, "one two three", "en", "b", 1, None, None), (4, "one two three", "en", "b", 1, None, None), (None, "x y z", "en", "a", 1, None, None)]
    return Data(spark, tmp_path_factory.mktemp("odd")).put("machines", machines, CLASH).put("documents", docs, CLASH).rest(CLASH)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    df = QUERIES[name](spark, empty)
    assert df.count() == (3 if name == "p9_shares" else 0)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, odd, name):
    assert QUERIES[name](spark, odd).count() >= 0


def test_survivors(spark, data):
    title = "Norvikson QX 4410 Panel Saw\n"
    d = data.put("machines", [
        {"id": 1, "dedup_key": "k", "price": money(100), "last_crawled_at": at(1), "description": title + "Built in 2001, commissioned a few months later in Norbury."},
        {"id": 2, "dedup_key": "k", "price": money(1), "last_crawled_at": at(9), "description": title + "Built in 2001, commiss..."},
        {"id": 3, "dedup_key": "k", "price": money(90), "last_crawled_at": None, "description": None},
        {"id": 4, "dedup_key": "k", "price": money(80), "last_crawled_at": at(5), "description": title + "Imprint | Privacy | Terms of use\nOpening hours: Mon-Fri 9:00-17:00\nFollow us: Feed / Video / Mail\nBack to top"},
        {"id": 5, "dedup_key": "alone", "price": money(80)}, {"id": 6, "dedup_key": None, "price": money(80)}, {"id": 7, "dedup_key": "none", "price": None}, {"id": 8, "dedup_key": "none", "price": money(9999999)},
        {"id": 9, "dedup_key": "565d240f5343e625ae579a4d45a770f1f02c6368b5ed4d06da4fbe6f47c28866", "price": money(5)}, {"id": 10, "dedup_key": "565d240f5343e625ae579a4d45a770f1f02c6368b5ed4d06da4fbe6f47c28866", "price": money(5)},
    ], CLASH).rest()
    assert rows(QUERIES["p5_found"](spark, d)) == [("k", "description", 1), ("k", "price", 4)]


def test_products_against_brute_force(spark, data):
    makers = ["Norvikson", "NORVIKSON GmbH", "Norviksno", "Haller & Sons", None, "Fjordqvist", "Fjordqvits"]
    machines, truth = [], {}
    for k in range(300):
        maker = makers[k % 7]
        number, suffix = 1000 + (k * k) % 9, ["", "XL"][k % 2]
        group = {"N": "N", "n": "N"}.get((maker or "?")[0], (maker or "?")[0])
        series = {"N": "QA", "H": "QB", "F": "QC", "?": "QA"}[group]
        machines.append({"id": k, "website_id": k % 5, "brand": maker, "model": f"{series}-{number} {suffix}".strip(), "machine_type": ["Panel Saw", "beam saw", "", None][k % 4]})
        truth[k] = (series, number, suffix)
    machines += [{"id": 1000 + k, "website_id": k % 3, "brand": "Norvikson", "model": "HOT 7777"} for k in range(60)]  # a hot product
    truth |= {1000 + k: ("HOT", 7777, "") for k in range(60)}
    machines += [{"id": 2000, "website_id": 9, "description": "Haller & Sons QB 1000 Panel Saw\nTooling also fits the Norvikson QA 1001."}, {"id": 2001, "website_id": 8, "description": "Details follow."}]
    truth[2000] = ("QB", 1000, "")
    d = data.put("machines", machines, CLASH).rest()
    site = {m["id"]: m["website_id"] for m in machines}
    want = sorted((a, b) for a in truth for b in truth if a < b and truth[a] == truth[b] and site[a] != site[b])
    assert rows(QUERIES["p6_found"](spark, d)) == want
    degree = Counter(x for pair in want for x in pair)
    assert {r.id: r.n_links for r in QUERIES["p6_classes"](spark, d).collect()} == {k: degree[k] for k in truth}


def test_packing_places_every_token(spark, data):
    texts = [(k, "word " * (k % 40) + "end", "en", "a", 1, None, None) for k in range(200)] + [(900 + k, "same length text", "en", "b", 1, None, None) for k in range(150)] + [(5000, "long " * 500, "en", "a", 1, None, None), (5001, "", "en", "a", 0, None, None)]
    d = data.put("documents", texts, CLASH).rest()
    got = [r.asDict() for r in QUERIES["p8_assignments"](spark, d).collect()]
    load, sizes, caps = Counter(), {}, {"tiny": 16, "small": 64}
    for r in got:
        if r["container_no"] is not None:
            load[r["container_name"], r["container_no"]] += r["tokens"]
        sizes.setdefault((r["container_name"], r["doc_id"]), []).append(r["tokens"])
    assert all(n <= caps[name] for (name, _), n in load.items())
    assert {k[1] for k in sizes} == {t[0] for t in texts}
    for (name, doc), parts in sizes.items():
        assert len(parts) == max(1, -(-sum(parts) // caps[name]))  # split only beyond the capacity
        assert sum(parts) == sum(sizes["small", doc])
    assert rows(QUERIES["p8_fill"](spark, d))[0][-1] > 0.9


def test_mix_reaches_its_shares(spark, data):
    texts = [(k, f"text number {k} of some words", "en", "ab"[k % 3 == 0], 1, None, None) for k in range(600)] + [(9000 + k, "other source", "en", "zz", 1, None, None) for k in range(50)]
    d = data.put("documents", texts, CLASH).rest()
    shares = {r.source: r for r in QUERIES["p9_shares"](spark, d).collect()}
    assert shares["gone"].tokens == 0 and abs(shares["a"].share - 0.6 / 0.9) < 0.01 and abs(shares["b"].share - 0.3 / 0.9) < 0.01
    mix = QUERIES["p9_mix"](spark, d).collect()
    assert all(r.times <= {"a": 2, "b": 1}[r.source] for r in mix) and len({r.doc_id for r in mix}) == len(mix)
    assert sum(r.tokens * r.times for r in mix) == shares["a"].tokens + shares["b"].tokens


def test_abuse_scores_every_document(spark, data):
    texts = [(1, LONG + "You worthless piece of shit, drop dead. " + LONG, "en", "a", 1, None, None), (2, LONG, "en", "a", 1, None, None), (3, None, "en", "b", 1, None, None), (4, "", "en", "b", 0, None, None), (2, LONG, "en", "a", 1, None, None)]
    d = data.put("documents", texts, CLASH).rest()
    assert rows(QUERIES["p10_found"](spark, d)) == [(1,)]
    assert QUERIES["p10_scores"](spark, d).count() == 5
    assert {r.source: (r.n_docs, r.n_found) for r in QUERIES["p10_rates"](spark, d).collect()} == {"a": (3, 1), "b": (2, 0)}
