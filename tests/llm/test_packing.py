"""Plans of containers against greedy packing, and ranks of lengths that many texts share."""

import numpy as np
import pytest

from tallyforge.llm import packing, tokens


@pytest.mark.parametrize(("capacity", "scale", "seed"), [(512, 1, 1), (512, 40, 2), (2048, 1, 3), (2048, 25, 4), (64, 100, 5)])
def test_least_squares_places_most_and_needs_no_more_than_greedy(capacity, scale, seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(capacity, rng.lognormal(np.log(capacity / 7), 0.9, 3000).astype(int) + 1)
    h = {int(k): int(v) * scale for k, v in zip(*np.unique(lengths, return_counts=True))}
    left = dict(h)
    found = packing.solved(left, capacity)
    for combo, _ in found:
        assert capacity * (1 - packing.WINDOW) <= sum(k * n for k, n in combo) <= capacity
    assert sum(left.values()) < 0.3 * sum(h.values())
    assert packing.plan(h, capacity)[1] <= sum(r for _, r in packing.greedy(dict(h), capacity))


def test_ranks_of_a_length_that_many_share(spark):
    items = spark.range(3000).selectExpr("'c' as container_name", "if(id % 3 < 2, 7L, id % 50 + 1) as length", "id as doc_id", "1 as part_no")
    ranks: dict[int, list[int]] = {}
    for r in packing.ranked(items, in_range=100).collect():
        ranks.setdefault(r["length"], []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values()) and len(ranks[7]) >= 2000


def test_tokens_of_very_long_texts_are_those_of_the_whole():
    enc = tokens.encoder(tokens.DEFAULT_VOCABULARY)
    for text in ("word " * 60_000, "a\n\n  b\tc" * 30_000, "ä€ " * 50_000):
        assert tokens.count_tokens(text, tokens.DEFAULT_VOCABULARY) == len(enc.encode_ordinary(text))
    assert tokens.count_tokens(None, tokens.DEFAULT_VOCABULARY) == tokens.count_tokens("", tokens.DEFAULT_VOCABULARY) == 0
