"""Severity on wordings that were left out of the fit, on run-on passages and on long ones."""

import random

import numpy as np

from tallyforge.llm import abuse
from tallyforge.llm import labelled_passages as L


def part(keep):
    return {lang: "\n".join(x for n, x in enumerate(block.split("\n")) if keep(n)) for lang, block in L.ABUSE.items()}


def test_wordings_left_out_of_the_fit():
    rng, background = random.Random(2), [s for s in L.HARMLESS.split("\n") for _ in range(8)]
    found = []
    for fold in (1, 3):
        model = abuse.fit(background, table=part(lambda n: n % 5 != fold))
        held = []
        for lang, block in part(lambda n: n % 5 == fold).items():
            fillers = {k: v.split(";") for k, v in L.FILLERS[lang].items()} | {"p": L.PLACES.split(";")}
            held += [abuse._filled(line[2:], fillers, rng) for line in block.split("\n") for _ in range(4)]
        found += (model.above(abuse.rows_of(held))[:, 0] > 0.5).tolist()
    assert np.mean(found) > 0.75  # the README has the figure


def test_windows_cover_every_word_once_or_twice_at_any_length():
    v = abuse.Words()
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        rows, owner = abuse.windows([" ".join(f"w{k:x}z" for k in range(n))], v)
        whole = set(rows.index.tolist())
        for k in range(n):
            one, _ = abuse.windows([f"w{k:x}z"], v)
            assert set(one.index.tolist()) <= whole
        assert len(owner) == len(rows) == (0 if n == 0 else 1 if n <= 32 else -(-(n - 16) // 16))


def test_rows_of_many_passages_are_those_of_each():
    texts = ["You m o r o n", "", "!!! ??", "a b c d e f", "n***d and m_o_r_o_n", "word " * 90, "  Straße 12 x 13"]
    rows = abuse.rows_of(texts)
    for k, t in enumerate(texts):
        assert sorted(rows.index[rows.starts[k]: rows.starts[k + 1]].tolist()) == sorted(abuse.hashed(t))
    assert abuse.words("n***d m_o_r_o_n m*o*r*o*n") == ["n***d", "moron", "moron"]


def test_rare_words_of_the_sample_are_no_evidence():
    rows = abuse.common(abuse.Rows([[1, 2], [1, 3], [1], [1, 2], []]), 3)
    assert rows.starts.tolist() == [0, 1, 2, 3, 4, 4] and rows.index.tolist() == [1, 1, 1, 1]
