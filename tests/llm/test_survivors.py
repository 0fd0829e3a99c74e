"""Survivors whose bundles depend on each other."""

import itertools
import random

from tallyforge.llm import survivors
from tallyforge.llm.queries import QUERIES

from ..conftest import at, money

BODY = "Built in 2001, commissioned a few months later in Norbury."


def test_pages_and_identities_of_another_model_give_way(spark, data):
    """Row 3 has the latest page and row 2 the fullest identity, but both are of another model than the best text."""
    d = data.put("machines", [
        {"id": 1, "dedup_key": "k", "brand": "Norvikson", "model": "QX 4410", "last_crawled_at": at(1), "price": money(100), "currency": "EUR", "description": f"Norvikson QX 4410 Panel Saw\n{BODY}\n{BODY}"},
        {"id": 2, "dedup_key": "k", "brand": "Norvikson", "model": "QX 9999", "stock_number": "S1", "machine_type": "Panel Saw", "last_crawled_at": at(2), "description": f"Norvikson QX 9999 Panel Saw\n{BODY}"},
        {"id": 3, "dedup_key": "k", "brand": None, "model": "QX 9999", "last_crawled_at": at(9), "price": money(70), "currency": "GBP"},
        {"id": 4, "dedup_key": "k", "brand": "Norvikson", "model": "QX 4410", "last_crawled_at": at(3)},
        {"id": 5, "dedup_key": "single", "brand": "Norvikson", "model": "QX 1", "price": money(5)},
    ]).rest()
    got = {r.dedup_key: r for r in QUERIES["p5_survivors"](spark, d).collect()}
    assert set(got) == {"k"}
    k = got["k"]
    assert (k.offer_id, k.text_id) == (3, 1)  # their own best rows
    assert (k.identity_id, k.page_id) == (4, 4)  # not 2 and 3, which are the best of their kind
    assert sorted(tuple(r) for r in QUERIES["p5_found"](spark, d).collect()) == [("k", "description", 1), ("k", "price", 3)]


def test_tied_bundles_against_all_choices():
    rng = random.Random(2)
    moved = 0
    for _ in range(300):
        choices = {b: [(k + 1, rng.choice(["", "A", "B"]), 10 * i + k) for k in range(rng.randint(0, 3))] for i, b in enumerate(survivors.BUNDLES)}
        got, picked = survivors.branch_and_bound(choices, survivors.TIED)
        base = 1 + max((c[0] for cs in choices.values() for c in cs), default=1)
        best = 0
        for combo in itertools.product(*[choices[b] + ([None] if b in ("identity", "page") or not choices[b] else []) for b in survivors.BUNDLES]):
            codes = {c[1] for b, c in zip(survivors.BUNDLES, combo) if c and b in survivors.TIED and c[1]}
            if len(codes) <= 1:
                best = max(best, sum(c[0] * base ** survivors.PLACES[b] for b, c in zip(survivors.BUNDLES, combo) if c))
        assert max(got, 0) == best
        moved += any(picked.get(b) != max(choices[b])[2] for b in ("identity", "page") if choices[b])
    assert moved > 50
