"""Main bodies on wordings, and in a language, that were left out of the fit."""

from types import SimpleNamespace

import pytest

from tallyforge.llm import boilerplate
from tallyforge.llm import labelled_lines as L

SPLIT = {"SIDE": "\n", "FOOTER": "\n", "MAIN": "\n", "FEATURE": ";"}
ANCHORS = {a.lower() for names in L.NAV.values() for a in names.split(";")}


def some_lines(keep):
    """The labelled table with only those wordings, by their place, that ``keep`` says."""
    out = SimpleNamespace(**{k: getattr(L, k) for k in dir(L) if k.isupper()})
    for name, sep in SPLIT.items():
        setattr(out, name, {lang: sep.join(x for n, x in enumerate(text.split(sep)) if keep(n)) for lang, text in getattr(L, name).items()})
    out.COOKIE = {lang: [x for n, x in enumerate(lines) if keep(n)] for lang, lines in L.COOKIE.items()}
    return out


def measured(monkeypatch, fitted_on, tested_on):
    monkeypatch.setattr(boilerplate, "L", fitted_on)
    fitted = boilerplate.model.__wrapped__(1500, 3)
    monkeypatch.setattr(boilerplate, "L", tested_on)
    hit = wanted = wrong = given = 0
    for page in boilerplate.labelled_pages(250, seed=77):
        page = [(t, y) for t, y in page if t.strip()]
        got = boilerplate.classify(["\n".join(t for t, _ in page)], fitted)[0]
        for (t, y), (_, _, bad) in zip(page, got):
            if all(x.strip().lower() in ANCHORS for x in boilerplate._SEPARATOR.split(t) if x):
                continue  # menus are made of one list of anchors: they are not left out, so they do not count
            hit, wanted, given, wrong = hit + (y and bad), wanted + y, given + bad, wrong + (bad and not y)
    return hit / wanted, wrong / max(1, given)


def test_wordings_left_out(monkeypatch):
    recall, wrong = measured(monkeypatch, some_lines(lambda n: n % 2 == 0), some_lines(lambda n: n % 2 == 1))
    print("recall", recall, "wrong", wrong)  # the README has the figures
    assert recall > 0.7 and wrong < 0.2


@pytest.mark.parametrize("lang", ["fr"])
def test_a_language_left_out(monkeypatch, lang):
    def only(keep):
        out = SimpleNamespace(**{k: getattr(L, k) for k in dir(L) if k.isupper()})
        for name in [*SPLIT, "COOKIE", "BARE", "NAV"]:
            setattr(out, name, {x: v for x, v in getattr(L, name).items() if keep(x)})
        return out

    recall, wrong = measured(monkeypatch, only(lambda x: x != lang), only(lambda x: x == lang))
    print("recall", recall, "wrong", wrong)
    assert recall > 0.4 and wrong < 0.5
