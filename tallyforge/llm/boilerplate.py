"""Main body of page texts without menus, notices, side boxes and footers.

A page is a run of flat text blocks, one per line.  Each block gets its word
count and its link density - the weight of its words as anchor and notice
words, as the markup itself is gone - together with those of the neighbouring
blocks and a few marks of form (separators, bullet, closing point, digits).
Decision trees decide; words' weights and trees are fitted on the small
labelled table in ``labelled_lines``, on pages put together from it.  Scoring
is one Arrow pass without a shuffle.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from . import labelled_lines as L

_WORD = re.compile(r"[^\W\d_]+")
_SEPARATOR = re.compile(r"\s[|/>·»•–]\s|\s::\s|\s{3,}")
_OFFER_TAIL = re.compile(r"\s-\s[\d.,'’\s]+\S{0,5}\s*$")
_CODE = re.compile(r"\b[A-Z]{2,4}[-. ]?0{2,6}")
FEATURES = ("words", "density", "anchors", "first_anchor", "separators", "bullet", "closed", "digits", "colon", "known", "copyright", "code",
            "prev_words", "prev_density", "next_words", "next_density", "from_start", "to_end")


def _words(text: str) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if len(w) > 1]


class Lexicon:
    """Weights of words as boilerplate words, and the anchor texts of menus, from labelled lines."""

    def __init__(self, lines: list[tuple[str, int]], anchors: set[str]):
        seen = (Counter(), Counter())
        for text, label in lines:
            seen[label].update(set(_words(text)))
        total = [sum(c.values()) + 50 for c in seen]
        self.weight = {}
        for w in seen[0] | seen[1]:
            x = math.log((seen[1][w] + 0.1) / total[1]) - math.log((seen[0][w] + 0.1) / total[0])
            self.weight[w] = max(-3.0, min(3.0, x))
        self.anchors = anchors
        self.features = lru_cache(maxsize=400_000)(self._features)

    def __getstate__(self):
        return self.weight, self.anchors

    def __setstate__(self, state):
        self.weight, self.anchors = state
        self.features = lru_cache(maxsize=400_000)(self._features)

    def _features(self, shape: str) -> tuple[float, ...]:
        """Line features; ``shape`` is the line with its digits as 0."""
        words = _words(_CODE.sub(" ", shape))  # the letters of a model code are no words
        if len(words) <= 12 and _CODE.search(shape):  # the short words of a title's names join words everywhere
            words = [w for w in words if len(w) > 3]
        n = len(words)
        weights = [self.weight.get(w, 0.0) for w in words]
        parts = [p.strip().lower() for p in _SEPARATOR.split(shape) if p and p.strip()]
        known = sum(w in self.weight for w in words)
        anchored = [p in self.anchors for p in parts]
        stripped = shape.rstrip()
        return (
            float(n),
            sum(weights) / n if n else 0.0,
            sum(anchored) / len(parts) if parts else 0.0,
            float(bool(anchored) and anchored[0] and len(parts) > 1),
            float(len(parts) - 1 if parts else 0),
            float(shape[:1] in "-*•" and shape[1:2] == " "),
            float(stripped[-1:] in ".!"),
            sum(c == "0" for c in shape) / max(1, len(shape)),
            float(":" in shape) + 2.0 * bool(_OFFER_TAIL.search(shape)),
            known / n if n else 0.0,
            float("©" in shape),
            float(bool(_CODE.search(shape))),
        )


_DIGIT = re.compile(r"\d")
_EMPTY = (0.0,) * 12


def page_features(lexicon: Lexicon, lines: list[str]) -> list[tuple[float, ...]]:
    """The features of a page's non-empty lines, in order."""
    own = [lexicon.features(_DIGIT.sub("0", s.strip())) for s in lines]
    n = len(own)
    out = []
    for k, f in enumerate(own):
        p, q = own[k - 1] if k else _EMPTY, own[k + 1] if k + 1 < n else _EMPTY
        out.append((*f, p[0], p[1], q[0], q[1], min(k, 12.0), min(n - 1 - k, 12.0)))
    return out


class Tree:
    """A binary decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 4):
        self.rules: list[tuple] = []
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        at = len(self.rules)
        self.rules.append(("leaf", float(y.mean())))
        if depth == 0 or len(y) < 2 * least or y.min() == y.max():
            return at
        best = None
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, t = x[order, j], y[order]
            ones = np.cumsum(t)
            k = np.flatnonzero(v[1:] > v[:-1]) + 1
            k = k[(k >= least) & (k <= len(y) - least)]
            if not len(k):
                continue
            left, right = ones[k - 1] / k, (ones[-1] - ones[k - 1]) / (len(y) - k)
            impurity = k * left * (1 - left) + (len(y) - k) * right * (1 - right)
            b = int(np.argmin(impurity))
            if best is None or impurity[b] < best[0] - 1e-9:
                best = (impurity[b], j, float(v[k[b] - 1]))
        if best is None:
            return at
        _, j, cut = best
        goes = x[:, j] <= cut
        a = self._grow(x[goes], y[goes], depth - 1, least)
        b = self._grow(x[~goes], y[~goes], depth - 1, least)
        self.rules[at] = ("split", j, cut, a, b)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        stack = [(0, np.arange(len(x)))]
        while stack:
            at, rows = stack.pop()
            rule = self.rules[at]
            if rule[0] == "leaf" or not len(rows):
                out[rows] = rule[1] if rule[0] == "leaf" else 0.0
                continue
            goes = x[rows, rule[1]] <= rule[2]
            stack += [(rule[3], rows[goes]), (rule[4], rows[~goes])]
        return out


class Trees:
    """Decision trees on different halves of the pages, averaged: one tree's borders hang on single pages."""

    def __init__(self, trees: list[Tree]):
        self.trees = trees

    def score(self, x: np.ndarray) -> np.ndarray:
        return sum(t.score(x) for t in self.trees) / len(self.trees)


def _bare(text: str, rng: random.Random) -> str:
    """A labelled line for the lexicon: the fillers say nothing about its class, but for the trade words of dealers."""
    return re.sub(r"\{[A-Z]\}", " ", text.replace("{C}", rng.choice(L.DEALERS).split(" ", 1)[1]))


def _fill(text: str, rng: random.Random) -> str:
    number = lambda: str(rng.choice([rng.randint(2, 99), rng.randint(100, 999), rng.randint(1000, 99999)]))
    if "{" not in text:
        return text
    letters = lambda n: "".join(rng.choice("ABCDEFGHKLMNOPRSTUVWXZ") for _ in range(n))
    join = rng.choice([" ", " ", "-", ""])
    model = lambda: letters(rng.choice([2, 2, 3])) + join + str(rng.choice([rng.randint(100, 9999), rng.randint(1000, 49999)])) + rng.choice(["", "", join + rng.choice(["S", "L", "XL", "II", "Plus"])])
    name = lambda n: "".join(rng.choice("bdfgklmnprstvz") + rng.choice(["a", "e", "i", "o", "u", "en", "or", "al"]) for _ in range(n)).capitalize()
    brand = lambda: rng.choice([name(3) + " " + rng.choice(L.MAKER_WORDS.split(";")), name(3), name(3), name(4), name(2) + " " + name(3), name(2) + "-" + name(2), rng.choice(L.BRANDS)])
    kind = lambda: rng.choice([name(5), name(3) + " Machine", name(3) + " " + name(3), name(4) + " " + name(3) + " " + name(3), name(3) + " de " + name(2) + " " + name(3), name(3) + " por " + name(3), name(4) + " par " + name(3), "Die " + name(3) + " " + name(2), rng.choice(L.TYPES), rng.choice(L.TYPES).lower()])
    place = lambda: rng.choice([name(3), name(4), name(2) + "-" + name(3), name(2) + "-le-" + name(1), rng.choice(L.PLACES)])
    dealer = lambda: rng.choice([rng.choice(L.DEALERS), name(3) + " " + rng.choice(L.DEALERS).split(" ", 1)[1]])
    for mark, value in (("{B}", brand), ("{M}", model), ("{T}", kind), ("{P}", place), ("{C}", dealer),
                        ("{N}", number), ("{Y}", lambda: str(rng.randint(1985, 2025))), ("{V}", lambda: f"{rng.uniform(0.2, 99):.1f}"), ("{H}", lambda: f"{rng.randint(7, 18)}:00")):
        while mark in text:
            text = text.replace(mark, value(), 1)
    return text


def _title(rng: random.Random) -> str:
    text, promise = _fill(rng.choice(L.TITLE.split(";")), rng), rng.choice(L.PROMISES.split(";"))
    text = rng.choice([text, text, f"{promise} - {text}", f"{text} ({promise})"])
    if rng.random() < 0.1:
        text += " " + " ".join(rng.choice(["*", "!!", "top", "ok", "used", "CNC", "-"]) for _ in range(rng.randint(1, 8)))
    return text


def labelled_pages(n: int, seed: int = 11) -> list[list[tuple[str, int]]]:
    """Pages put together from the labelled lines; label 1 is boilerplate."""
    rng, pages = random.Random(seed), []
    langs = list(L.NAV)
    for _ in range(n):
        lang, other = rng.choice(langs), rng.choice(langs)
        own = other if rng.random() < 0.3 else lang  # the text's language need not be the page's
        page: list[tuple[str, int]] = []
        anchors = L.NAV[lang].split(";")
        if rng.random() < 0.35:
            page.append((rng.choice(L.COOKIE[lang]), 1))
        if rng.random() < 0.6:
            picked = rng.sample(anchors, rng.randint(3, 9))
            if rng.random() < 0.5:
                page += [(a, 1) for a in picked]
            else:
                page.append((rng.choice([" | ", " · ", " > ", " / ", "   ", " » "]).join(picked), 1))
        if rng.random() < 0.4:
            sep = rng.choice([" / ", " > ", " :: ", " » ", " | "])
            page.append((_fill(sep.join([rng.choice(anchors), "{T}", "{B}"]), rng), 1))
        body: list[tuple[str, int]] = []
        if rng.random() < 0.85:
            page.append((_title(rng), 0))
            sentences = [_fill(x, rng) for x in L.MAIN[own].split("\n")]
            for _ in range(rng.randint(0, 6)):
                body.append((" ".join(rng.sample(sentences, rng.randint(1, 3))), 0))
            bullet = rng.choice(["- ", "* ", "• ", "", "- "])
            for f in rng.sample(L.FEATURE[own].split(";"), rng.randint(0, 6)):
                body.append((bullet + _fill(f, rng), 0))
            rng.shuffle(body)
        else:
            body.append((rng.choice(L.BARE[own].split(";") if rng.random() < 0.8 else [x for x in L.MAIN[own].split("\n") if "{" not in x]), 0))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            body.insert(rng.randint(0, len(body)), (_fill(rng.choice(L.SIDE[lang].split("\n")), rng), 1))
        if rng.random() < 0.15:
            body.insert(rng.randint(0, len(body)), (rng.choice(L.COOKIE[lang]), 1))
        page += body
        if rng.random() < 0.7:
            foot = L.FOOTER[lang].split("\n")
            page += [(_fill(f, rng), 1) for f in rng.sample(foot, rng.randint(1, min(5, len(foot))))]
        if page and rng.random() < 0.25:  # what comes after some line is missing
            page = page[: rng.randint(1, len(page))]
        if page and rng.random() < 0.3:  # cut off somewhere in the last line
            text, label = page[-1]
            text = text[: rng.randint(1, len(text))] + rng.choice(["", "", "...", "…", " [...]", "&nb", "<br"])
            page[-1] = (text, label)
        pages.append(page)
    return pages


@lru_cache(maxsize=1)
def model(n_pages: int = 5000, n_trees: int = 7) -> tuple[Lexicon, Trees]:
    """Lexicon and trees, each on half of the pages, fitted on the labelled table (its size is fixed, whatever the input)."""
    rng = random.Random(5)
    lines: list[tuple[str, int]] = []
    for lang in L.NAV:
        lines += [(a, 1) for a in L.NAV[lang].split(";")] + [(x, 1) for x in L.COOKIE[lang]]
        for part, label, times in ((L.SIDE, 1, 3), (L.FOOTER, 1, 3), (L.MAIN, 0, 3)):
            lines += [(_bare(x, rng), label) for x in part[lang].split("\n") for _ in range(times)]
        lines += [(_bare(x, rng), 0) for x in L.FEATURE[lang].split(";") for _ in range(3)]
        lines += [(x, 0) for x in L.BARE[lang].split(";") for _ in range(8)]
    lines += [(x, 0) for x in (L.PROMISES + ";top;ok;used;CNC").split(";") for _ in range(3)]
    lines += [(x, 0) for x in L.MAKER_WORDS.split(";") for _ in range(5)]
    lexicon = Lexicon(lines, {a.lower() for names in L.NAV.values() for a in names.split(";")})
    xs, ys, of = [], [], []
    for k, page in enumerate(labelled_pages(n_pages)):
        page = [(t, y) for t, y in page if t.strip()]
        xs += page_features(lexicon, [t for t, _ in page])
        ys += [y for _, y in page]
        of += [k] * len(page)
    x, y, of = np.array(xs), np.array(ys, dtype=float), np.array(of)
    draws = np.random.default_rng(8)
    picks = [draws.random(n_pages) < 0.5 for _ in range(n_trees)]
    return lexicon, Trees([Tree(x[p[of]], y[p[of]]) for p in picks])


def _lines(text: str) -> list[tuple[int, str]]:
    return [(k + 1, s) for k, s in enumerate(text.split("\n")) if s.strip()]


def classify(texts: list[str | None], fitted: tuple[Lexicon, Trees] | None = None) -> list[list[tuple[int, str, bool]]]:
    """(line number, line, is boilerplate) of every non-empty line of every text, by a model that was fitted before or now."""
    lexicon, tree = fitted or model()
    pages = [_lines(t) if t else [] for t in texts]
    xs = [f for page in pages for f in page_features(lexicon, [s for _, s in page])]
    flags = tree.score(np.array(xs)) >= 0.5 if xs else np.array([], dtype=bool)
    out, at = [], 0
    for page in pages:
        out.append([(k, s, bool(b)) for (k, s), b in zip(page, flags[at: at + len(page)])])
        at += len(page)
    return out


def boilerplate_lines(rows: DataFrame, id_col: str = "id", text_col: str = "description") -> DataFrame:
    """(id, line_no) of every line outside the main body.

    Null and empty texts give no row; empty lines are never given; repeated
    rows give repeated results; whole texts are read, whatever their length.
    """
    fitted = model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, numbers = [], []
            for id_, page in zip(b["id"].array, classify(list(b["text"].array), fitted)):
                for k, _, bad in page:
                    if bad:
                        ids.append(id_)
                        numbers.append(k)
            yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "line_no": pd.Series(numbers, dtype="int64")})

    source = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null and text <> ''")
    return spread(source).mapInPandas(run, "id long, line_no long")


def main_bodies(rows: DataFrame, id_col: str = "id", text_col: str = "description") -> DataFrame:
    """(id, main_text): the main body of every text; empty where nothing of it is left."""
    fitted = model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bodies = ["\n".join(s for _, s, bad in page if not bad) for page in classify(list(b["text"].array), fitted)]
            yield pd.DataFrame({"id": b["id"], "main_text": bodies})

    source = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return spread(source).mapInPandas(run, "id long, main_text string")
