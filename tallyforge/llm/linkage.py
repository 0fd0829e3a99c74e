"""Listings of one product, by probabilistic record linkage.

Each listing is parsed into series letters, number and variant suffix of its
model, its maker, its type and, in canonical units, weight and drive power.
Listings with the same parsed fields form one signature.  Another suffix or
another maker of the list is another product by definition: the suffix is part
of every block, and two such makers are never linked.  There are two
kinds of blocks: listings with the same code, and listings of one maker whose
codes are one edit apart (they share what is left when a sign is taken out).
Inside a block every signature is compared with every other one.

A field's weight is log(m / u).  How often fields agree by chance, u, is
counted on random pairs; how often they agree in one product, m, and how many
pairs of one code are matches is found by expectation-maximisation over the
counts of agreement patterns.  How many codes one edit apart are mistyped is a
parameter: a maker's neighbouring codes mostly are neighbouring products, and
the few fields cannot tell by themselves how many are not.  A field that a
block is made by says nothing in it.  Links above the threshold make the
clusters, as connected components; only where one would hold two makers of the
list, because a listing without a maker or of a third one links to both, the
links count from the strongest down and those that would join the two do not.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..runtime import cut, spread
from . import boilerplate
from .canonical import Matcher, fold
from .product_code import is_title, parse

_MASS = re.compile(r"(?:weight|gewicht|poids|peso)\s*:?\s*([\d.,'’\s]+)\s*(kg|t|lb)\b", re.I)
_POWER = re.compile(r"(?:drive|antrieb|puissance|potencia)\s*:?\s*([\d.,'’\s]+)\s*(kw|w|hp|ps)\b", re.I)
_SCALE = {"kg": 1.0, "t": 1000.0, "lb": 0.453592, "w": 1.0, "kw": 1000.0, "hp": 745.699872, "ps": 735.49875}
FIELDS = ("maker", "type", "mass", "power")
BLOCKS = ("code", "near")
Entries = list[tuple[int, str, str | None]]


def _amount(pattern: re.Pattern, text: str) -> float | None:
    m = pattern.search(text)
    if not m:
        return None
    s = re.sub(r"[\s'’]", "", m[1]).strip(".,")
    if re.search(r"[.,]\d{3}$", s) or s.count(",") + s.count(".") > 1:
        s = re.sub(r"[.,](?=\d{3}\b)", "", s)
    try:
        return float(s.replace(",", ".")) * _SCALE[m[2].lower()]
    except ValueError:
        return None


def stated_codes(brands: list, models: list, texts: list, fitted=None) -> list[tuple[str, str, str] | None]:
    """The model code of each listing: of its model or brand field, else of its title. A model named elsewhere in the text is only mentioned."""
    codes = [parse(m) or parse(b) for b, m in zip(brands, models)]
    open_ = [k for k, c in enumerate(codes) if c is None and texts[k]]
    for k, page in zip(open_, boilerplate.classify([texts[k] for k in open_], fitted)):
        main = [s for _, s, bad in page if not bad]
        codes[k] = next((c for s in main if is_title(s) and (c := parse(s))), None)
    return codes


def parse_listing(code: tuple[str, str, str] | None, brand: str | None, model: str | None, kind: str | None, text: str | None, makers: Matcher, types: Matcher) -> tuple | None:
    """(letters, number, suffix, maker, type, mass, power), or None where no model is stated."""
    if code is None:
        return None
    maker = ""
    before = re.split(rf"(?i){code[0]}[\s.–-]*{code[1]}", model)[0] if parse(model) else ""
    for value in (brand, before):
        if value and re.search(r"[^\W\d_]", value):
            hit = makers.match(value)
            if hit > 0:
                maker = f"#{hit}"
                break
            # a maker outside the list keeps its name
            bare = fold(next(iter(reversed(makers._variants(value))), ""))
            if not maker and len(bare) > 3 and bare not in _NAMELESS and not parse(value):
                maker = bare
    found = types.match(kind) if kind and kind.strip() else -1
    mass = _amount(_MASS, text) if text else None
    power = _amount(_POWER, text) if text else None
    return (*code, maker, found, mass, power)


_NAMELESS = frozenset(["noname", "diverse", "divers", "various", "other", "unknown", "sonstige", "seetext", "siehetext", "misc", "standard", "other", "mod"])


def parsed(machines: DataFrame, makers: Entries, types: Entries) -> DataFrame:
    """(id, website_id, block, suffix, maker, kind, mass, power) of every listing that states a model."""

    fitted = boilerplate.model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, t = Matcher(makers, "brand"), Matcher(types, "type")
        for b in batches:
            out = []
            codes = stated_codes(*[list(b[c].array) for c in ("brand", "model", "description")], fitted)
            for code, id_, site, brand, model, kind, text in zip(codes, *[b[c].array for c in ("id", "website_id", "brand", "model", "machine_type", "description")]):
                got = parse_listing(code, brand, model, kind, text, m, t)
                if got:
                    out.append((id_, site, f"{got[0]} {got[1]}", *got[2:]))
            frame = pd.DataFrame(out, columns=["id", "website_id", "block", "suffix", "maker", "kind", "mass", "power"])
            yield frame.astype({"website_id": "Int64", "kind": "int64", "mass": "float64", "power": "float64"})

    source = machines.where("id is not null").select("id", F.col("website_id").cast("long").alias("website_id"), "brand", "model", "machine_type", "description")
    return spread(source).mapInPandas(run, "id long, website_id long, block string, suffix string, maker string, kind long, mass double, power double")


def signatures(listings: DataFrame) -> DataFrame:
    """Distinct parsed fields with their number of listings and typical amounts."""
    return listings.groupBy("block", "suffix", "maker", "kind").agg(F.count("*").alias("n"), F.percentile_approx("mass", 0.5).alias("mass"), F.percentile_approx("power", 0.5).alias("power"))


ROW = ("n", "block", "suffix", "maker", "kind", "mass", "power")


def alike(sigs: DataFrame) -> DataFrame:
    """(kind of block, a, b): every two signatures that share a block, once.

    ``code``: one code.  ``near``: one maker, codes one edit apart.  Signatures of
    one code are joined, so a code with very many spellings of makers is no single
    task; how many codes share what is left without one sign is bounded by the signs.
    """
    node = F.struct(*ROW)
    a, b = (sigs.select("block", "suffix", node.alias(s)) for s in "ab")
    same = a.join(b, ["block", "suffix"]).where("a.maker < b.maker or (a.maker = b.maker and a.kind < b.kind)").select(F.lit("code").alias("kind_of"), "a", "b")
    code = F.replace("block", F.lit(" "), F.lit(""))
    shorter = F.transform(F.sequence(F.lit(1), F.length(code)), lambda k: F.concat(F.substring(code, F.lit(1), k - 1), F.substring(code, k + 1, F.length(code))))
    keyed = sigs.where("maker <> ''").select("suffix", "maker", F.explode(F.array_distinct(F.concat(F.array(code), shorter))).alias("key"), node.alias("node"))
    groups = keyed.groupBy("suffix", "maker", "key").agg(F.collect_list("node").alias("nodes")).where("size(nodes) > 1")
    near = groups.select("nodes", F.explode("nodes").alias("a")).select("a", F.explode("nodes").alias("b")).where("a.block < b.block")
    return same.unionByName(near.distinct().select(F.lit("near").alias("kind_of"), "a", "b"))


def levels(a: str, b: str, blocked_on_maker: bool = False) -> dict:
    """Agreement level of each field of two signatures: 2 agrees, 1 says nothing, 0 differs."""
    col = lambda s, f: F.col(f"{s}.{f}")
    near = lambda f: F.when(col(a, f).isNull() | col(b, f).isNull(), 1).when(F.abs(col(a, f) - col(b, f)) <= 0.02 * F.greatest(col(a, f), col(b, f)), 2).otherwise(0)
    listed = col(a, "maker").startswith("#") & col(b, "maker").startswith("#")
    maker = (
        F.when((col(a, "maker") == "") | (col(b, "maker") == ""), 1)
        .when(col(a, "maker") == col(b, "maker"), 2)
        .when(~listed & (F.levenshtein(col(a, "maker"), col(b, "maker")) <= 3), 2)
        .otherwise(0)
    )
    kind = F.when((col(a, "kind") < 0) | (col(b, "kind") < 0), 1).when(col(a, "kind") == col(b, "kind"), 2).otherwise(0)
    return {"maker": F.lit(1) if blocked_on_maker else maker, "type": kind, "mass": near("mass"), "power": near("power")}


def chance(counts: list[tuple[tuple[int, ...], int]]) -> list[dict[int, float]]:
    """u: how often each field agrees and differs in random pairs, with one pair's weight of doubt."""
    u = [{2: 0.1, 0: 0.9} for _ in FIELDS]
    for pattern, n in counts:
        for f, level in enumerate(pattern):
            if level != 1:
                u[f][level] += n
    return [{x: v / (d[0] + d[2]) for x, v in d.items()} for d in u]


def expectation_maximisation(counts: list[tuple[str, tuple[int, ...], int]], u: list[dict[int, float]], mistyped: float = 0.001, tolerance: float = 1e-6) -> tuple[list[dict[int, float]], dict[str, float]]:
    """(weight of each level per field, log prior odds per kind of block) from counts of agreement patterns.

    ``u`` stays as counted.  The start says that a product's listings agree on
    most fields and counts as one pair; a level that says nothing has weight
    zero.  ``mistyped`` is the share of ``near`` pairs that are one product.
    It ends when no probability moves.
    """
    start = {2: 0.98, 0: 0.02}
    m = [dict(start) for _ in FIELDS]
    first = {"code": 0.9, "near": mistyped}
    prior = dict(first)
    while True:
        mm, matched, total = [dict(start) for _ in FIELDS], dict(first), dict.fromkeys(first, 1.0)
        for block, pattern, n in counts:
            odds = math.log(prior[block] / (1 - prior[block])) + sum(math.log(m[f][x] / u[f][x]) for f, x in enumerate(pattern) if x != 1)
            p = 1 / (1 + math.exp(max(-50.0, min(50.0, -odds))))
            matched[block] += p * n
            total[block] += n
            for f, level in enumerate(pattern):
                if level != 1:
                    mm[f][level] += p * n
        after = {"code": min(1 - 1e-9, max(1e-9, matched["code"] / total["code"])), "near": mistyped}
        new = [{x: v / (d[0] + d[2]) for x, v in d.items()} for d in mm]
        moved = max([abs(after[b] - prior[b]) for b in prior] + [abs(x[2] - y[2]) for x, y in zip(new, m)])
        prior, m = after, new
        if moved < tolerance:
            weights = [{1: 0.0, **{x: math.log(m[f][x] / u[f][x]) for x in (0, 2)}} for f in range(len(FIELDS))]
            return weights, {b: math.log(p / (1 - p)) for b, p in prior.items()}


def components(edges: DataFrame) -> DataFrame:
    """(name, component) of every name in ``edges`` (a, b): the least name reached.

    Least names are handed to neighbours, then to where they themselves are
    already known to belong, until nothing moves; each round is materialised.
    """
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    known = cut(both.groupBy(F.col("a").alias("name")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        lent = both.join(known, F.col("b") == F.col("name")).groupBy("a").agg(F.min("component").alias("lent"))
        nearer = known.join(lent, F.col("name") == F.col("a")).select("name", "component", F.least("component", "lent").alias("least"))
        root = known.select(F.col("name").alias("root"), F.col("component").alias("of_root"))
        new = cut(nearer.join(root, F.col("least") == F.col("root"), "left").select("name", F.col("component").alias("before"), F.least("least", "of_root").alias("component")))
        if new.where("component <> before").isEmpty():
            return new.select("name", "component")
        known = new.drop("before")


def parted(edges: pd.DataFrame) -> pd.DataFrame:
    """(name, part) for the links of one component: taken from the strongest down, without those that would join two makers of the list."""
    boss: dict[str, str] = {}
    maker: dict[str, str] = {}

    def find(x: str) -> str:
        while boss[x] != x:
            boss[x] = x = boss[boss[x]]
        return x

    for e in edges.itertuples():
        for x, m in ((e.a, e.maker_a), (e.b, e.maker_b)):
            boss.setdefault(x, x)
            maker.setdefault(x, m if m.startswith("#") else "")
    for e in edges.sort_values(["weight", "n", "a", "b"], ascending=[False, False, True, True]).itertuples():
        x, y = sorted((find(e.a), find(e.b)))
        if x != y and (not maker[x] or not maker[y] or maker[x] == maker[y]):
            boss[y], maker[x] = x, maker[x] or maker[y]
    return pd.DataFrame([(x, find(x)) for x in boss], columns=["name", "part"])


def clusters(edges: DataFrame) -> DataFrame:
    """(name, component) of every name in ``edges`` (a, b, maker_a, maker_b, weight, n), none with two makers of the list."""
    found = components(edges.select("a", "b"))
    within = edges.join(found, F.col("a") == F.col("name")).drop("name")
    listed = within.select("component", F.explode(F.array("maker_a", "maker_b")).alias("maker")).where(F.col("maker").startswith("#"))
    mixed = cut(listed.groupBy("component").agg(F.min("maker").alias("least"), F.max("maker").alias("most")).where("least <> most").select("component"))
    if mixed.isEmpty():
        return found
    parts = within.join(mixed, "component").groupBy("component").applyInPandas(lambda e: parted(e), "name string, part string")
    return found.join(parts, "name", "left").select("name", F.coalesce("part", "component").alias("component"))


def random_pairs(sigs: DataFrame) -> DataFrame:
    """Each signature beside the one before it in the order of a hash, as ``a`` and ``b``."""
    h = F.xxhash64("block", "suffix", "maker", "kind", F.lit(41))
    place = sigs.select(F.struct(*ROW).alias("a"), h.alias("h"), F.pmod(h, F.lit(1024)).alias("part"))
    return place.withColumn("b", F.lag("a").over(W.partitionBy("part").orderBy("h"))).where("b is not null")


def products(listings: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(id, website_id, product_id): the cluster of every listing with a stated model."""
    listings = cut(listings)
    sigs = cut(signatures(listings))
    pairs = cut(alike(sigs))
    patterns = pairs.select("kind_of", *[F.when(F.col("kind_of") == "near", by_maker).otherwise(c).alias(f) for (f, c), by_maker in zip(levels("a", "b").items(), levels("a", "b", True).values())])
    by_chance = random_pairs(sigs).select(F.lit("chance").alias("kind_of"), *[c.alias(f) for f, c in levels("a", "b").items()])
    # at most 3 x 3^4 rows
    counts = sorted((r["kind_of"], tuple(r[f] for f in FIELDS), r["n"]) for r in patterns.unionByName(by_chance).groupBy("kind_of", *FIELDS).agg(F.count("*").alias("n")).collect())
    weights, prior = expectation_maximisation([c for c in counts if c[0] != "chance"], chance([c[1:] for c in counts if c[0] == "chance"]))

    def weight(kind_of: str) -> Column:
        total = F.lit(prior[kind_of])
        for f, level in enumerate(levels("a", "b", kind_of == "near").values()):
            total = total + F.when(level == 2, weights[f][2]).when(level == 0, weights[f][0]).otherwise(0.0)
        return total

    name = lambda at: F.concat_ws("|", *[F.col(f"{at}{c}") for c in ("block", "suffix", "maker", "kind")])
    makers = [F.col(f"{s}.maker") for s in "ab"]
    two = makers[0].startswith("#") & makers[1].startswith("#") & (makers[0] != makers[1])
    weighed = pairs.where(~two).withColumn("weight", F.when(F.col("kind_of") == "near", weight("near")).otherwise(weight("code")))
    edges = cut(weighed.where(F.col("weight") > threshold).select(name("a.").alias("a"), name("b.").alias("b"), makers[0].alias("maker_a"), makers[1].alias("maker_b"), "weight", F.greatest("a.n", "b.n").alias("n")))
    named = sigs.select("block", "suffix", "maker", "kind", name("").alias("name"))
    if not edges.isEmpty():
        named = named.join(clusters(edges), "name", "left").withColumn("name", F.coalesce("component", "name")).drop("component")
    ids = named.select("block", "suffix", "maker", "kind", F.sha2("name", 256).alias("product_id"))
    return listings.join(ids, ["block", "suffix", "maker", "kind"]).select("id", "website_id", "product_id")


def links(members: DataFrame) -> DataFrame:
    """(id_a, id_b): every pair of listings of one product at different sites."""
    a = members.where("website_id is not null").select("product_id", F.col("id").alias("id_a"), F.col("website_id").alias("site_a"))
    b = members.where("website_id is not null").select("product_id", F.col("id").alias("id_b"), F.col("website_id").alias("site_b"))
    return a.join(b, "product_id").where("id_a < id_b and site_a <> site_b").select("id_a", "id_b")


def classes(members: DataFrame) -> DataFrame:
    """(id, product_id, n_links): one row per listing that has a product, with the number of listings it pairs with in ``links``.

    Counted from class and site sizes; no pair is made.  A listing without a stated site has no pairs and is in none of another.
    """
    by_site = members.where("website_id is not null").groupBy("product_id", "website_id").agg(F.count("*").alias("here"))
    totals = by_site.withColumn("total", F.sum("here").over(W.partitionBy("product_id")))
    return members.join(totals, ["product_id", "website_id"], "left").select("id", "product_id", F.coalesce(F.col("total") - F.col("here"), F.lit(0)).alias("n_links"))
