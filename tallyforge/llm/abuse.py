"""Abusive, hateful or sexual content, graded.

Passages (sentences and lines) are read after undoing common disguises -
letters spaced out or repeated, digits and signs for letters - and turned into
sparse hashed word features.  A cumulative-link ordinal regression predicts the
grade: P(grade <= k) = s(threshold_k - w.x), one weight vector shared by all
ordered thresholds.  It is fitted on a small labelled table, written out with
its disguises, against that table's harmless passages and a bounded sample of
the corpus, from which passages that the first fit finds are taken out again.
A document's score is the greatest expected severity of its passages; every
passage of every document is read.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from . import labelled_passages as L
from .hashed import Rows, sigmoid

BITS, GRADES = 18, 4
WINDOW, STEP = 32, 16
_LEET = str.maketrans("013457$@!€", "oieastsaie")
_PASSAGE = re.compile(r"[.!?…;]+\s+|[\n\r]+|\s(?:[:;]-?[)(D]|lol\s)")
_TOKEN = re.compile(r"[\w$@€*!]+")
_SET_APART = re.compile(r"[^\W_](?:[_*][^\W_])+")
_EMPTY = -40.0


def passages(text: str) -> list[str]:
    """Sentences and lines of a whole text; a smiley also ends one."""
    return [p for p in _PASSAGE.split(text) if p]


@lru_cache(maxsize=200_000)
def _word(token: str) -> str:
    """A lower-case token without its disguise; empty where it has no letter or digit."""
    t = token.strip("_!")
    if _SET_APART.fullmatch(t):
        t = re.sub("[_*]", "", t)
    if any(c.isalpha() for c in t) and re.search(r"[0-9$@€!]", t):
        t = t.translate(_LEET)
    t = re.sub(r"(\w)\1{2,}", r"\1", unicodedata.normalize("NFKC", t))
    return "0" if t.isdigit() else t if any(c.isalnum() for c in t) else ""


def words(passage: str) -> list[str]:
    """Words as they are meant; three single characters or more in a row are one word."""
    out: list[str] = []
    run: list[str] = []
    for w in [*filter(None, map(_word, _TOKEN.findall(passage.lower()))), "  "]:
        if len(w) == 1 and w != "0":
            run.append(w)
            continue
        if run:
            out += ["".join(run)] if len(run) > 2 else run
            run = []
        out.append(w)
    return [_word(w) for w in out[:-1]]


class Words:
    """Codes of tokens: the word, its beginning, its mask and whether it is a single letter, each hashed once; n-grams are made of the codes by numpy."""

    MOST = 400_000

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.codes = np.zeros((1024, 4), dtype=np.uint64)

    def __add(self, token: str) -> int:
        w = _word(token)
        k = len(self.place)
        if k == len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
        self.codes[k] = (
            zlib.crc32(b"u" + w.encode()) if w else 0,
            zlib.crc32(b"p" + w[:5].encode()) if len(w) > 5 else 0,
            zlib.crc32(f"m{w[0]}{len(w)}{w[-1]}".encode()) if "*" in w and len(w) > 2 else 0,
            len(w) == 1 and w != "0",
        )
        self.place[token] = k
        return k

    def codes_of(self, tokens: list[str]) -> np.ndarray:
        """(4, tokens): word, beginning and mask of each, 0 where it has none, and 1 for a single letter."""
        if len(self.place) + len(tokens) > self.MOST:  # a table of tokens met before; none may move while these are read
            self.place.clear()
        known, add = self.place.get, self.__add
        at = [k if (k := known(t)) is not None else add(t) for t in tokens]
        return self.codes[at].T if at else np.zeros((4, 0), dtype=np.uint64)


def _mixed(kind: int, *codes: np.ndarray) -> np.ndarray:
    h = np.full(len(codes[0]), kind * 0x9E3779B97F4A7C15 % 2**64, dtype=np.uint64)
    for c in codes:
        h = (h ^ c) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)


def windows(texts: list[str], vocabulary: Words) -> tuple[Rows, np.ndarray]:
    """(rows of hashed features, the passage each belongs to): every stretch of 32 words that begins at each sixteenth word, one for a shorter passage, none where there is no word."""
    flat: list[str] = []
    sizes, owner = [], []

    def cut(k: int, ts: list[str]) -> None:
        for at in range(0, max(1, len(ts) - WINDOW + STEP), STEP):
            part = ts[at: at + WINDOW]
            if part:
                flat.extend(part)
                sizes.append(len(part))
                owner.append(k)

    for k, p in enumerate(texts):
        ts = _TOKEN.findall(p.lower())
        if len(ts) <= WINDOW:
            if ts:
                flat += ts
                sizes.append(len(ts))
                owner.append(k)
        else:
            cut(k, ts)
    codes, beginnings, masks, single = vocabulary.codes_of(flat)
    row, owners = np.repeat(np.arange(len(sizes)), sizes), np.array(owner, dtype=np.int64)
    runs = single[:-2] * single[1:-1] * single[2:] * (row[:-2] == row[2:])
    if runs.any():  # words spelled out letter by letter: these passages are read anew
        spelled = np.unique(owners[row[:-2][runs > 0]])
        anew, of = windows([" ".join(words(texts[k])) for k in spelled], vocabulary)
        gone = set(spelled.tolist())
        rest, own = windows(["" if k in gone else p for k, p in enumerate(texts)], vocabulary)
        return rest.and_(anew), np.concatenate([own, spelled[of]])
    real = codes != 0
    codes, beginnings, masks, row = codes[real], beginnings[real], masks[real], row[real]
    keys = [(row << BITS) | _mixed(1, codes)]
    for kind, extra in ((2, beginnings), (3, masks)):
        has = extra != 0
        keys.append((row[has] << BITS) | _mixed(kind, extra[has]))
    for kind, gaps in ((4, (0, 1)), (5, (0, 2)), (6, (0, 1, 2))):
        n = max(0, len(codes) - gaps[-1])
        same = row[:n] == row[gaps[-1]: gaps[-1] + n]
        keys.append((row[:n][same] << BITS) | _mixed(kind, *[codes[g: g + n][same] for g in gaps]))
    key = np.sort(np.concatenate(keys))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    starts = np.searchsorted(key, np.arange(len(sizes) + 1) << BITS)
    return Rows.of(starts, key & ((1 << BITS) - 1)), owners


def rows_of(texts: list[str]) -> Rows:
    """One row for each text, of its first stretch of words."""
    rows, owner = windows(texts, Words())
    first: dict[int, int] = {}
    for at, k in enumerate(owner.tolist()):
        first.setdefault(k, at)
    none = len(rows)
    rows = rows.and_(Rows([[]]))
    return rows.pick(np.array([first.get(k, none) for k in range(len(texts))], dtype=np.int64))


def hashed(passage: str) -> list[int]:
    """The features of one passage."""
    return rows_of([passage]).index.tolist()


def _disguise(word: str, rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.55 or len(word) < 3:
        return word
    if kind < 0.68:
        return word.translate(str.maketrans("oieas", "01345"[:1] + "13" + "4" + rng.choice("5$")))
    if kind < 0.78:
        return word[0] + "*" * (len(word) - 2) + word[-1]
    if kind < 0.86:
        return rng.choice([" ", "."]).join(word) if " " not in word else word
    if kind < 0.95:
        k = rng.randrange(1, len(word))
        return word[:k] + word[k] * rng.randint(2, 4) + word[k:] if word[k].isalpha() else word
    return word.replace(word[len(word) // 2], "*", 1)


def _filled(text: str, fillers: dict[str, list[str]], rng: random.Random) -> str:
    """A labelled line with its slots filled, some of its words disguised, some of it left out, sometimes run together with harmless words."""
    s = re.sub(r"\{(\w)\}", lambda m: _disguise(rng.choice(fillers[m[1]]), rng) if m[1] in "anx" else rng.choice(fillers[m[1]]), text)
    ws = s.split(" ")
    if rng.random() < 0.3:
        k = rng.randrange(len(ws))
        ws[k] = _disguise(ws[k], rng)
    return " ".join(ws)


def labelled(times: int = 24, seed: int = 3, table: dict[str, str] | None = None, background: list[str] | None = None) -> list[tuple[str, int]]:
    """The labelled table with its slots filled, some of them disguised; half of the lines run on into harmless words, as where a point is missing."""
    rng, out = random.Random(seed), []
    harmless = [h.rstrip(".") for h in L.HARMLESS.split("\n")] + (background or [])
    for lang, block in (table or L.ABUSE).items():
        fillers = {k: v.split(";") for k, v in L.FILLERS[lang].items()} | {"p": L.PLACES.split(";")}
        for line in block.split("\n"):
            grade, text = int(line[0]), line[2:]
            for _ in range(times if "{" in text else max(5, times // 2)):
                s = _filled(text, fillers, rng)
                if rng.random() < 0.5:
                    near = " ".join(rng.choice(harmless).split(" ")[: max(3, WINDOW - len(s.split(" ")))])
                    s = f"{near} {s}" if rng.random() < 0.5 else f"{s} {near}"
                out.append((s, grade))
    for line in L.HARMLESS.split("\n"):
        out += [(line, 0)] * 10
    # groups, roles and adjectives are harmless by themselves
    neutral = {"en": "The {r} met {g} from {p} at the sale.;We trained {g} and {w} on the new machine.;The {r} in {p} answered within 5 hours.",
               "de": "Der {r} traf {g} aus {p}.;Wir haben {g} und {w} geschult.", "fr": "Le {r} a reçu des {g} à {p}.;Les {w} et les {g} étaient à la formation.", "es": "El {r} recibió a {g} en {p}.;Las {w} y los {g} hicieron el curso."}
    for lang, block in neutral.items():
        fillers = {k: v.split(";") for k, v in L.FILLERS[lang].items()} | {"p": L.PLACES.split(";")}
        for text in block.split(";"):
            out += [(re.sub(r"\{(\w)\}", lambda m: rng.choice(fillers[m[1]]), text), 0) for _ in range(times)]
    return out


class Ordinal:
    """Cumulative-link regression on hashed features."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def raw(self, x: Rows) -> np.ndarray:
        """w.x of each row; a row without features is as harmless as can be."""
        return np.where(np.diff(x.starts) > 0, x.dot(self.weights), _EMPTY)

    def above(self, x: Rows) -> np.ndarray:
        """P(grade > k) for k = 0, 1, 2 of each row."""
        return sigmoid(self.raw(x)[:, None] - self.thresholds[None, :])

    @staticmethod
    def fit(x: Rows, y: np.ndarray, epochs: int = 8, rate: float = 0.12, l2: float = 2e-6, batch: int = 128, seed: int = 5) -> Ordinal:
        rng = np.random.default_rng(seed)
        w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
        theta, t2 = np.array([3.0, 5.0, 7.0]), np.full(GRADES - 1, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                k = order[at: at + batch]
                f, owner = x.take(k)
                s = np.bincount(owner, weights=w[f], minlength=len(k))
                edge = np.concatenate([[-40.0], theta, [40.0]])
                hi, lo = sigmoid(edge[y[k] + 1] - s), sigmoid(edge[y[k]] - s)
                p = np.maximum(hi - lo, 1e-9)
                ds = 1.0 - hi - lo
                touched, place = np.unique(f, return_inverse=True)
                g = np.bincount(place, weights=ds[owner]) / len(k) + l2 * w[touched]
                g2[touched] += g * g
                w[touched] -= rate * g / np.sqrt(g2[touched])
                dt = np.zeros(GRADES - 1)
                np.add.at(dt, y[k][y[k] < GRADES - 1], -(hi * (1 - hi) / p)[y[k] < GRADES - 1] / len(k))
                np.add.at(dt, y[k][y[k] > 0] - 1, (lo * (1 - lo) / p)[y[k] > 0] / len(k))
                t2 += dt * dt
                theta = theta - 0.05 * dt / np.sqrt(t2)
                for j in range(1, GRADES - 1):
                    theta[j] = max(theta[j], theta[j - 1] + 0.2)
        return Ordinal(w, theta)


def common(rows: Rows, least: int = 4) -> Rows:
    """The rows with the features that at least ``least`` of them have.

    The sample may hold abusive passages of a kind the table lacks; what is
    rare in it is no evidence of harmlessness.
    """
    kept = np.bincount(rows.index, minlength=1 << BITS)[rows.index] >= least
    return Rows.of(np.concatenate([[0], np.cumsum(kept)])[rows.starts], rows.index[kept])


def fit(background: list[str], table: dict[str, str] | None = None) -> Ordinal:
    """The model, from the labelled table and a sample of passages whose grade is taken for zero."""
    def marked(near: list[str]) -> tuple[Rows, np.ndarray]:
        rows = labelled(table=table, background=near)
        return rows_of([s for s, _ in rows]), np.array([g for _, g in rows])

    x, y = marked([])
    model = Ordinal.fit(x, y, epochs=4)
    b = rows_of(background)
    for most in (0.6, 0.6):  # what is found in the sample is not harmless
        kept = np.flatnonzero(model.above(b)[:, 0] < most)
        if len(kept):
            x, y = marked([background[k] for k in kept])
            model = Ordinal.fit(x.and_(common(b.pick(kept))), np.concatenate([y, np.zeros(len(kept), dtype=int)]), epochs=6)
    return model


def sample_passages(docs: DataFrame, id_col: str, text_col: str, most: int, each: int = 12) -> list[str]:
    """A bounded sample of passages: at most about ``most`` documents by a hash of the id, ``each`` passages of each."""
    n = docs.count()
    picked = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(29)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(1, n))))
    out, rng = [], random.Random(1)
    for (text,) in picked.where(F.col(text_col).isNotNull()).select(text_col).limit(2 * most).collect():
        ps = passages(text)
        out += rng.sample(ps, min(each, len(ps)))
    return out


def raw_scores(texts: list[str], weights: np.ndarray, vocabulary: Words) -> np.ndarray:
    """The greatest w.x of each text's stretches of words."""
    rows, owner = windows(texts, vocabulary)
    out = np.full(len(texts), _EMPTY)
    if len(rows):
        np.maximum.at(out, owner, np.where(np.diff(rows.starts) > 0, rows.dot(weights), _EMPTY))
    return out


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2500, group_col: str | None = None) -> DataFrame:
    """(doc_id, severity, p_any, n_found): the greatest expected severity (0..3) of a document's passages, the greatest chance that one is not harmless, and how many are more likely so than not.

    Every document gets a row: null and empty texts score 0, repeated ids give
    repeated rows.  ``sample`` bounds the documents the background is taken from.
    With ``group_col`` that column comes along as ``grp``.
    """
    model = fit(sample_passages(docs, id_col, text_col, sample))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))  # 2^18 floats

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, theta = shared.value
        vocabulary, memo = Words(), {}
        for b in batches:
            split = [passages(t) if t else [] for t in b["text"].array]
            fresh = list({p for ps in split for p in ps if p not in memo})
            if len(memo) + len(fresh) > 300_000:  # a table of passages met before, not a cap on what is read
                memo.clear()
                fresh = list({p for ps in split for p in ps})
            for at in range(0, len(fresh), 20_000):
                part = fresh[at: at + 20_000]
                memo.update(zip(part, raw_scores(part, w, vocabulary).tolist()))
            found = np.array([sum(memo[p] > theta[0] for p in ps) for ps in split], dtype=np.int64)
            best = np.array([max((memo[p] for p in ps), default=_EMPTY) for ps in split])
            above = sigmoid(best[:, None] - theta[None, :])
            yield pd.DataFrame({"doc_id": b["id"], "grp": b["grp"], "severity": above.sum(axis=1), "p_any": above[:, 0], "n_found": found})

    grp = F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), grp.alias("grp"))
    scored = spread(source).mapInPandas(run, "doc_id long, grp string, severity double, p_any double, n_found long")
    return scored if group_col else scored.drop("grp")
