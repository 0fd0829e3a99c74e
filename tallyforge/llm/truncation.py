"""Texts cut off by field limits or in mid-transfer.

Every line that another line follows ends where its author ended it, so the
inner lines of the texts are intact values to learn from.  Cutting them - and
whole texts - at places inside a word or a sentence makes the positives, bare
or with the marks that cutting leaves behind.  A hashed logistic regression
reads closing characters, punctuation, the words of the last line and how the
length stands to the limits: lengths far more frequent than chance, given their
neighbours over all rows.  A spike need not be a limit, as pages made of fixed
lines repeat their lengths, too: a round spike is taken for a limit unless the
texts of that length mostly end intact, any other one only where they
mostly end cut.  The model is fitted twice: on lines
first, then on whole texts that the first fit takes for intact.  Fits, limits
and scores cover every row.  Digits are alike to the features, so lines that
differ in them alone are one line with a count.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, spread, written
from .hashed import EXAMPLES, Rows, bucket, examples, fit_everywhere, fit_logistic, sigmoid

BITS = 18
_MASK = (1 << BITS) - 1
# What cutting leaves at the end of a text.
MARKS = ["...", "…", " ...", " …", " [...]", "[...]", "[…]", "�", "&nb", "&nbs", "&nbsp", "&am", "<br", "<span cla", "<p", "</di", "(more)"]
_MARK = re.compile(r"(\s?(?:\[(?:\.\.\.|…)\]|\.\.\.+|…)|�+|&[a-z]{1,6}|<[^<>\n]{0,20})$")


_LETTERS, _DIGIT, _DIGITS = re.compile(r"[a-z ]+"), re.compile(r"\d"), re.compile(r"\d+")


class _Classes(dict):
    def __missing__(self, c: str) -> str:
        self[c] = kind = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "_" if c.isspace() else c
        return kind


_of_char = _Classes().__getitem__


def _class(text: str) -> str:
    return "".join(map(_of_char, text))


def _mark(line: str) -> re.Match | None:
    """The mark at the end of a line; most ends are seen to have none without a search."""
    return _MARK.search(line) if line[-1:] in ".…]�" or "&" in line[-7:] or "<" in line[-21:] else None


def ending_features(line: str) -> list[str]:
    """What the end of a last line shows."""
    mark = _mark(line)
    kind = _LETTERS.sub("x", mark[1]) if mark else ""
    body = line[: mark.start()] if mark else line
    low = _DIGIT.sub("0", body.lower())
    short = _DIGITS.sub("0", low)
    words = short.split()
    last = words[-1] if words else ""
    tail = words[-3:]
    shape = _class(body[-6:])
    out = [
        f"k{kind}", f"c1{shape[-1:]}", f"c2{shape[-2:]}", f"c3{shape[-3:]}", f"c5{shape[-5:]}", f"k{kind}c{shape[-1:]}",
        f"w1{last}", f"w2{' '.join(tail[-2:])}", f"w3{' '.join(tail)}", f"s1{low[-1:]}", f"s2{low[-2:]}", f"s3{low[-3:]}", f"s4{low[-4:]}", f"s6{low[-6:]}", f"s9{low[-9:]}", f"s14{low[-14:]}",
        f"l{short}", f"f{' '.join(words[:2])}c{shape[-1:]}", f"f{words[0] if words else ''}n{len(words)}", f"n{min(len(words), 12)}c{shape[-1:]}", f"m{len(last)}{shape[-1:]}",
        f"k{kind}l{short}",
    ]
    if body.count("(") > body.count(")"):
        out.append("open(")
    return out


def length_features(length: int, limits: list[int]) -> list[str]:
    """How a length stands to the limits, which are in order."""
    k = bisect_left(limits, length)
    if k < len(limits):
        if limits[k] == length:
            return ["at limit", f"at {length}"]
        if limits[k] - length <= 3:
            return ["near limit"]
    return ["free"]


def hashed(names: list[str]) -> list[int]:
    """The bucket of each name; names are of one line, so all are encoded at once."""
    return [zlib.crc32(n) & _MASK for n in "\n".join(names).encode().split(b"\n")]


@lru_cache(maxsize=1 << 14)
def ending(line: str) -> list[int]:
    """The buckets of a last line; many texts end alike."""
    return hashed(ending_features(line))


def is_natural_end(text: str, at: int) -> bool:
    """Whether cutting at ``at`` leaves a whole line or sentence."""
    rest, head = text[at:], text[:at].rstrip()
    if not head or not rest.strip() or rest.lstrip(" ").startswith("\n"):
        return True
    return head[-1] in ".!?…|·>/:,;-•*" and (rest[:1].isspace() or text[at - 1:at].isspace()) and head[-1] in ".!?…"


def cut_somewhere(text: str, rng: random.Random, limits: list[int]) -> str | None:
    """An intact text cut inside a word or a sentence."""
    fitting = [x for x in limits if x < len(text)]
    for _ in range(8):
        mark = rng.choice(MARKS) if rng.random() < 0.35 else ""
        if fitting and rng.random() < 0.5:
            at = rng.choice(fitting) - len(mark)
        else:
            at = rng.randint(min(3, len(text) - 1), len(text) - 1) if len(text) > 1 else 0
        if at > 0 and not is_natural_end(text, at):
            return text[:at] + mark
    return None


def last_line(text: str) -> str:
    return text[text.rfind("\n") + 1:]


def fit_lines(texts: list[str], seed: int = 7, n_lines: int = 40_000) -> tuple[list[list[int]], list[float], np.ndarray]:
    """(features, labels, weights) of inner lines at hand, whole and cut: what an ending says whatever its length."""
    rng = random.Random(seed)
    lines = [s for t in texts for s in t.split("\n")[:-1] if s.strip()]
    rng.shuffle(lines)
    rows, y = [], []
    for s in lines[:n_lines]:
        rows.append(hashed(ending_features(s)))
        y.append(0.0)
        if (c := cut_somewhere(s, rng, [])) is not None:
            rows.append(hashed(ending_features(c)))
            y.append(1.0)
    return rows, y, fit_logistic(Rows(rows), np.array(y), BITS, epochs=4) if rows else np.zeros((1 << BITS) + 1)


def by_endings(texts: list[str], first: np.ndarray) -> np.ndarray:
    """The chance that each text was cut, by its ending alone."""
    return sigmoid(Rows([hashed(ending_features(last_line(t))) for t in texts]).dot(first) + first[-1]) if texts else np.zeros(0)


def by_share(ends: dict[int, tuple[int, int]], least: int = 3) -> tuple[list[int], list[int]]:
    """(lengths whose texts mostly end cut, lengths whose texts mostly do not) from (texts, cut ones) of each, where ``least`` texts or more have the length."""
    seen = {m: n_cut / n for m, (n, n_cut) in ends.items() if n >= least}
    return [m for m, share in seen.items() if share >= 0.5], [m for m, share in seen.items() if share < 0.5]


def borne_out(spiked: list[int], texts: list[str], p: np.ndarray, least: int = 3) -> tuple[list[int], list[int]]:
    """``by_share`` of the texts at hand."""
    n, n_cut = Counter(len(t) for t in texts), Counter(len(t) for t, q in zip(texts, p) if q > 0.5)
    return by_share({m: (n[m], n_cut[m]) for m in spiked}, least)


def fit(texts: list[str], limits: list[int], seed: int = 7, n_lines: int = 40_000, lines: tuple | None = None) -> np.ndarray:
    """Weights from texts at hand; ``lines`` is what ``fit_lines`` gave for them."""
    rows, y, first = lines or fit_lines(texts, seed, n_lines)
    rng = random.Random(seed + 1)
    whole = [t for t in texts if t.strip()]
    rows, y = [r + hashed(["free"]) for r in rows], list(y)
    for t, q in zip(whole, by_endings(whole, first)):
        if q < 0.5:
            for _ in range(2):
                rows.append(hashed(ending_features(last_line(t)) + length_features(len(t), limits)))
                y.append(0.0)
            for _ in range(2):
                if (c := cut_somewhere(t, rng, limits)) is not None:
                    rows.append(hashed(ending_features(last_line(c)) + length_features(len(c), limits)))
                    y.append(1.0)
    return fit_logistic(Rows(rows), np.array(y), BITS, epochs=5) if rows else first


def length_counts(rows: DataFrame, text_col: str) -> DataFrame:
    """(n, count): how many texts have each length."""
    return rows.where(F.col(text_col).isNotNull()).groupBy(F.length(text_col).alias("n")).count()


def spikes(counts: DataFrame, ratio: float = 3.0, sigmas: float = 10.0, window: int = 12) -> DataFrame:
    """(m) lengths met ``ratio`` times as often as their neighbours, and ``sigmas`` standard deviations of a count more often, over all rows.

    Each count is spread to its neighbours, so no window runs over all
    lengths.  A count's own chance variation is its measure, not a fixed number of texts.
    """
    near = counts.select("n", "count", F.explode(F.sequence(F.col("n") - window, F.col("n") + window)).alias("m"))
    stats = near.groupBy("m").agg(F.sum(F.when(F.col("n") != F.col("m"), F.col("count"))).alias("around"), F.sum(F.when(F.col("n") == F.col("m"), F.col("count"))).alias("own"))
    expected = F.greatest(F.coalesce("around", F.lit(0)) / (2.0 * window), F.lit(0.5))
    return stats.where((F.col("own") >= ratio * expected) & (F.col("own") - expected >= sigmas * F.sqrt(expected))).select("m")


def field_limits(rows: DataFrame, text_col: str, ratio: float = 3.0) -> list[int]:
    """The lengths of ``spikes`` that fields are usually declared with, the round ones; no number of other spikes pushes one out."""
    return sorted(r[0] for r in spikes(length_counts(rows, text_col), ratio).where("m > 0").where(is_round(F.col("m"))).collect())


def is_round(n: Column) -> Column:
    """The limits a field is declared with: multiples of 5 and powers of two, less one or not."""
    return (n % 5 == 0) | (n.bitwiseAND(n - 1) == 0) | (n.bitwiseAND(n + 1) == 0)


def line_examples(rows: DataFrame, text_col: str) -> DataFrame:
    """``examples`` of every inner line, whole and, as often as it is there, cut: what an ending says whatever its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = random.Random()
        for b in batches:
            x, y, n_met, key = [], [], [], []
            for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not s.strip():
                    continue
                rng.seed(own := zlib.crc32(s.encode()))
                x.append(hashed(ending_features(s)))
                y.append(0.0)
                n_met.append(n)
                cuts = Counter(cut_somewhere(s, rng, []) for _ in range(n))
                cuts.pop(None, None)
                x += [hashed(ending_features(c)) for c in cuts]
                y += [1.0] * len(cuts)
                n_met += cuts.values()
                key += [own] * (1 + len(cuts))
            yield examples(x, y, n_met, key)

    parts = F.split(F.regexp_replace(text_col, "[1-9]", "0"), "\n")
    inner = rows.where(F.col(text_col).contains("\n")).select(F.explode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("s"))
    return inner.where(F.trim("s") != "").groupBy("s").agg(F.count("*").alias("n")).mapInArrow(run, EXAMPLES)


def text_examples(rows: DataFrame, text_col: str, first: Callable[[list[list[int]]], np.ndarray], limits: list[int]) -> DataFrame:
    """``examples`` of every whole text that the first fit takes for intact, whole and cut, twice each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = random.Random()
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t.strip()]
            ends = [ending(last_line(t)) for t in texts]
            x, y, n_met, key = [], [], [], []
            for t, end, q in zip(texts, ends, first(ends)):
                if q < 0.5:
                    rng.seed(own := zlib.crc32(t.encode()))
                    x.append(end + hashed(length_features(len(t), limits)))
                    y.append(0.0)
                    n_met.append(2)
                    for _ in range(2):
                        if (c := cut_somewhere(t, rng, limits)) is not None:
                            x.append(hashed(ending_features(last_line(c)) + length_features(len(c), limits)))
                            y.append(1.0)
                            n_met.append(1)
                    key += [own] * (len(x) - len(key))
            yield examples(x, y, n_met, key)

    return spread(rows.where(F.col(text_col) != "").select(text_col)).mapInArrow(run, EXAMPLES)


def ends_at(rows: DataFrame, text_col: str, spiked: set[int], first: Callable[[list[list[int]]], np.ndarray]) -> dict[int, tuple[int, int]]:
    """(texts, cut ones by their endings alone) of each of some lengths, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = [(n, s) for n, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if n in spiked]
            q = first([ending(s) for _, s in some])
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in some], pa.int32()), pa.array(q > 0.5, pa.bool_())], names=["n", "ends_cut"])

    source = rows.where(F.col(text_col) != "").select(F.length(text_col).alias("n"), F.substring_index(text_col, "\n", -1).alias("s"))
    counts = source.mapInArrow(run, "n int, ends_cut boolean").groupBy("n").agg(F.count("*").alias("texts"), F.count_if("ends_cut").alias("n_cut"))
    return {r["n"]: (r["texts"], r["n_cut"]) for r in counts.collect()}


def model(rows: DataFrame, text_col: str) -> tuple[np.ndarray, list[int]]:
    """(weights, limits) from every text."""
    spark = rows.sparkSession
    lines = spark.read.parquet(written(line_examples(rows, text_col)))
    weights = fit_everywhere(lines, BITS, rounds=1)
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))  # 2^18 floats, a fixed size

    def first(ends: list[list[int]]) -> np.ndarray:
        return sigmoid(Rows(ends).dot(shared.value) + shared.value[-1])

    found = spikes(cut(length_counts(rows, text_col))).where("m > 0").select("m", is_round(F.col("m")).alias("usual")).collect()
    cut_at, whole_at = by_share(ends_at(rows, text_col, {r["m"] for r in found}, first)) if found else ([], [])
    limits = sorted({*cut_at, *(r["m"] for r in found if r["usual"])} - set(whole_at))
    texts = spark.read.parquet(written(text_examples(rows, text_col, first, limits)))
    free = F.lit(bytearray(np.int32(bucket("free", BITS)).tobytes()))
    both = lines.withColumn("x", F.concat("x", free)).unionByName(texts)
    return fit_everywhere(both, BITS, weights), limits


def score(rows: DataFrame, id_col: str = "id", text_col: str = "description", group_col: str | None = None) -> DataFrame:
    """(id, p): the probability that a text was cut off, for every row with a text.

    Null and empty texts, and texts that end with a line break, give no row
    and count as intact; with ``group_col`` that column comes along as ``grp``
    and every row has one, with p 0 for those.
    """
    weights, limits = model(rows, text_col)
    shared = rows.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2^18 floats, a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for b in batches:
            p = np.zeros(len(b))
            full = np.flatnonzero(b["full"].to_numpy())
            x = Rows([ending(s) + hashed(length_features(n, limits)) for s, n in zip(b["line"].array[full], b["n"].array[full])])
            p[full] = sigmoid(x.dot(w) + w[-1])
            yield pd.DataFrame({"id": b["id"], "grp": b["grp"], "p": p})

    line = F.substring_index(text_col, "\n", -1)
    grp = F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")
    full = F.coalesce(F.trim(line) != "", F.lit(False))
    source = rows.select(F.col(id_col).alias("id"), grp.alias("grp"), F.coalesce(line, F.lit("")).alias("line"), F.coalesce(F.length(text_col), F.lit(0)).alias("n"), full.alias("full"), F.col(text_col).isNotNull().alias("stated"))
    source = source.where("stated").drop("stated") if group_col else source.where("id is not null and full").drop("stated")
    scored = spread(source).mapInPandas(run, "id long, grp string, p double")
    return scored if group_col else scored.drop("grp")
