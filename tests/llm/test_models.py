import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import abuse, boilerplate, packing, product_code, survivors, truncation
from tallyforge.llm.canonical import Matcher, Trie, fold, max_distance
from tallyforge.llm.mixing import budgets


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=8), st.text("abc", max_size=6), st.integers(0, 2))
def test_automaton_finds_what_brute_force_finds(words, query, k):
    trie = Trie()
    for i, w in enumerate(words):
        trie.add(w, i)
    want = {i: osa(w, query) for i, w in enumerate(words) if osa(w, query) <= k}
    assert trie.search(query, k) == want


MAKERS = Matcher([(1, "Norvikson", "NVK;Norvikson Werke"), (2, "Haller & Sons", None), (3, "Müllerbach", None), (4, "Petro Var Tools", None)], "brand")


@pytest.mark.parametrize(("value", "ref"), [("NORVIKSON", 1), ("Norviksno GmbH", 1), ("nvk", 1), ("nvx", -1), ("Norvikson QX 4410 L", 1), ("Fa. Norvikson®", 1), ("Haller and Sons Ltd.", 2), ("haller&sons", 2), ("Muellerbach", 3), ("Mullerbach (used)", 3),
                                             ("Tools Petro Var", 4), ("PetroVarTools,", 4), ("n/a", -1), ("???", -1), ("Completely Other", -1), ("x" * 20_000, -1)])
def test_brands(value, ref):
    assert MAKERS.match(value) == ref


def test_types():
    m = Matcher([(1, "Panel Saw", "beam saw;Plattensäge"), (2, "Horizontal Borer", None)], "type")
    for value, ref in (("Saw, Panel", 1), ("gebr. Plattensage 1997", 1), ("Panel Saws 2021", 1), ("CNC Panel Saw (reconditioned)", 1), ("Horiz. Borer", 2), ("diesel generator", -1), ("machine", -1)):
        assert m.match(value) == ref
    assert max_distance(3) == 0 and fold("Ä-ß 1") == "ass1"


def test_boilerplate_on_pages_it_was_not_fitted_on():
    wrong = total = 0
    for page in boilerplate.labelled_pages(300, seed=99):
        page = [(t, y) for t, y in page if t.strip()]
        got = boilerplate.classify(["\n".join(t for t, _ in page)])[0]
        wrong += sum(bool(y) != b for (_, y), (_, _, b) in zip(page, got))
        total += len(page)
    assert wrong / total < 0.02
    assert boilerplate.classify([None, "", "\n\n", "x" * 100_000])[:3] == [[], [], []]


def test_line_numbers_skip_empty_lines():
    lines = boilerplate.classify(["Norvikson QX 4410 Panel Saw\n\nBuilt in 2001, commissioned a few months later in Norbury.\nImprint | Privacy | Terms of use"])[0]
    assert [(k, b) for k, _, b in lines] == [(1, False), (3, False), (4, True)]


def test_truncation_on_held_out_texts():
    rng = random.Random(4)
    texts = ["\n".join(t for t, _ in p) for p in boilerplate.labelled_pages(1500, seed=5)]
    texts = [t for t in texts if len(t) > 60 and not truncation._MARK.search(t)]
    w = truncation.fit(texts[:1000], [255], n_lines=8000)
    score = lambda t: truncation.sigmoid(truncation.Rows([truncation.hashed(truncation.ending_features(truncation.last_line(t)) + truncation.length_features(len(t), [255]))]).dot(w) + w[-1])[0]
    cut = [c for t in texts[1000:1250] if (c := truncation.cut_somewhere(t, rng, [255]))]
    assert np.mean([score(c) > 0.5 for c in cut]) > 0.85
    assert np.mean([score(t) > 0.5 for t in texts[1000:1250]]) < 0.15
    assert truncation.fit([], []).shape and truncation.fit(["", " "], []).shape


@pytest.mark.parametrize(("text", "code"), [("wie neu - QX – 4410  XL Saw", "QX4410XL"), ("ES 38075 Säulenbohrer", "ES38075"), ("Mod. GP38563 L", "GP38563L"), ("PXR 15621+ (Saw)", "PXR15621PLUS"), ("toc33176l", "TOC33176L"), ("2003", ""), ("", "")])
def test_model_codes(text, code):
    assert "".join(product_code.parse(text) or ()) == code


def test_mentions_are_no_titles():
    assert product_code.title_code(["On request we also have the Haller KR 2051 in the yard."]) == ""
    assert product_code.title_code(["Haller KR 2051 Saw * used !!", "Tooling also fits the AB 999."]) == "KR2051"


def test_branch_and_bound_against_all_choices():
    rng = random.Random(1)
    for _ in range(200):
        choices = {b: [(k + 1, rng.choice(["", "A", "B"]), 10 * i + k) for k in range(rng.randint(0, 3))] for i, b in enumerate(survivors.BUNDLES)}
        got, picked = survivors.branch_and_bound(choices)
        base = 1 + max((c[0] for cs in choices.values() for c in cs), default=1)
        best = 0
        for combo in itertools.product(*[choices[b] + ([None] if b == "identity" or not choices[b] else []) for b in survivors.BUNDLES]):
            codes = {c[1] for b, c in zip(survivors.BUNDLES, combo) if c and b in ("text", "identity") and c[1]}
            if len(codes) <= 1:
                best = max(best, sum(c[0] * base ** survivors.PLACES[b] for b, c in zip(survivors.BUNDLES, combo) if c))
        assert max(got, 0) == best


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20), st.sampled_from([16, 64]))
def test_plans_place_everything_within_capacity(histogram, capacity):
    histogram = {k: n for k, n in histogram.items() if k <= capacity}
    where, n = packing.plan(histogram, capacity)
    load = np.zeros(n, dtype=int)
    for length, count in histogram.items():
        at = packing.place(where, length, np.arange(count))
        assert (at >= 0).all()
        np.add.at(load, at, length)
    assert (load <= capacity).all() and (load > 0).all() and load.sum() == sum(k * v for k, v in histogram.items())


def test_least_squares_finds_the_exact_solution():
    a = np.array([[1.0, 0, 2], [0, 1, 1], [1, 1, 0]])
    assert np.allclose(a @ packing.nnls(a, a @ np.array([3.0, 0, 5])), a @ np.array([3.0, 0, 5]), atol=1e-3)
    assert (packing.nnls(np.array([[1.0], [1.0]]), np.array([-1.0, -1.0])) == 0).all()


def test_fill_is_close_to_the_bound():
    rng = np.random.default_rng(1)
    h = {int(k): int(v) for k, v in zip(*np.unique(np.minimum(512, rng.lognormal(5, 0.8, 5000).astype(int) + 1), return_counts=True))}
    _, n = packing.plan(h, 512)
    assert sum(k * v for k, v in h.items()) / (n * 512) > 0.99


def test_budgets():
    out, total = budgets([("a", 100), ("b", 10), ("x", 5)], [("a", 0.6, 2), ("b", 0.3, 4), ("gone", 0.1, 3), (None, 0.1, 1), ("x", None, 1)])
    assert total == pytest.approx(40 / 0.3) and out["b"] == (pytest.approx(40), 4, 0.0) and out["a"][1] == 0 and out["a"][2] == pytest.approx(80)
    assert budgets([], [])[0] == {} and budgets([("a", 10)], [("a", 1.0, 2)], total=100)[0]["a"] == (20.0, 2, 0.0)


def test_abuse_on_held_out_wordings():
    model = abuse.fit([])
    p = lambda s: float(model.above(abuse.Rows([abuse.hashed(s)]))[0, 0])
    for s in ("You are a pathetic m0r0n, get lost.", "Free p o r n videos, horny girls want sex", "du dreckiger Hurensohn, verpiss dich!!!", "The dealer is a fuuuucking idiot", "Nunca contraten a los extranjeros, son ladrones de nacimiento."):
        assert p(s) > 0.5, s
    for s in ("The slave cylinder and the stripper plate were replaced.", "Naked wires must be insulated.", "The support was a disgrace and the gearbox is bad.", "", "-- ", "123"):
        assert p(s) < 0.5, s
    severe, mild = model.above(abuse.Rows([abuse.hashed("I will come to Norbury and smash your teeth in, moron."), abuse.hashed("The seller is a stupid, filthy idiot.")])).sum(axis=1)
    assert severe > mild and (np.diff(model.thresholds) > 0).all()


def test_disguises_are_undone():
    assert abuse.words("m0r0n mooooron m o r o n") == ["moron", "moron", "moron"]
