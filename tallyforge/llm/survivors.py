"""The best representative of each group of copies, field by field.

Fields that depend on each other travel together as bundles: an offer (price,
currency), a text (description), an identity (brand, model, stock number, type)
and a page (url, source).  Each bundle of a survivor comes whole from one row,
so the dependencies inside a bundle hold (a price keeps its currency); across
bundles the model a text is about must be the model of the identity and of the
page that is linked.  Within those constraints branch and bound picks the
bundles with the greatest trust: a later page or a fuller identity of another
model gives way.  An offer depends on no other bundle, and the text comes
before what has to agree with it, so these two are always their own best rows;
that is what the problem asks of price and description.

Copies are first reduced to the best bundle of each kind per (key, model
number) by plain aggregates, with partial aggregation before the shuffle: a key
that holds a third of all rows shrinks to its few model numbers in every task.
A bundle that is beaten by another with the same model number can be in no
best choice, so nothing is lost by that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from . import boilerplate
from .product_code import title_code
from .truncation import MARKS

_TAIL = re.compile("(?:" + "|".join(re.escape(m) for m in sorted(MARKS, key=len, reverse=True)) + r")\s*$")
BUNDLES = ("offer", "text", "identity", "page")
TIED = ("text", "identity", "page")
#: Places of the kinds of bundle in the order of importance: no gain of a lower place outweighs a loss of a higher one.
PLACES = {"offer": 3, "text": 2, "identity": 1, "page": 0}


def real_amount(price: Column) -> Column:
    """Placeholders are not amounts: nothing, up to one, or a run of nines."""
    digits = F.floor(price.cast("decimal(38,2)")).cast("string")
    return price.isNotNull() & ~F.isnan(price.cast("double")) & (price > 1) & ~digits.rlike("^(9{5,}|1{5,}|12345(6(7(89?)?)?)?)$")


def unknown_keys() -> Column:
    """Keys built from nothing but empty parts."""
    return F.array(*[F.sha2(F.lit(raw), 256) for raw in ("||", "|", "", "||none", "none|none|none")])


def completeness(pages: list[str | None], fitted=None) -> list[tuple[int, str]]:
    """(size of the main body, model number of the title) of each page; a mark left by cutting does not count."""
    out = []
    for page in boilerplate.classify(pages, fitted):
        main = [s for _, s, bad in page if not bad]
        body = _TAIL.sub("", "\n".join(main))
        out.append((len(re.sub(r"\s+", "", body)), title_code(main)))
    return out


def branch_and_bound(choices: dict[str, list[tuple[int, str, int]]], tied: tuple[str, ...] = ("text", "identity")) -> tuple[int, dict[str, int]]:
    """The row for each bundle that maximises weighted trust.

    ``choices`` lists (trust as a rank from 1, model number, row) per bundle.  The
    ``tied`` bundles must agree on the model number where they have one.  A bundle
    without a choice stays open, and so does a tied one behind the text that agrees in no row.
    """
    order = [b for b in BUNDLES if choices.get(b)]
    lists = [sorted(choices[b], key=lambda c: (-c[0], c[2])) for b in order]
    base = 1 + max((c[0] for cs in lists for c in cs), default=1)
    weights = {b: base ** PLACES[b] for b in order}
    bound = [0] * (len(order) + 1)
    for k in range(len(order) - 1, -1, -1):
        bound[k] = bound[k + 1] + weights[order[k]] * lists[k][0][0]
    best: tuple[int, dict[str, int]] = (-1, {})

    def descend(k: int, got: int, model: str, picked: dict[str, int]) -> None:
        nonlocal best
        if got + bound[k] <= best[0]:
            return
        if k == len(order):
            best = (got, dict(picked))
            return
        name = order[k]
        for trust, code, row in lists[k]:
            if name in tied and code and model and code != model:
                continue
            picked[name] = row
            descend(k + 1, got + weights[name] * trust, (model or code) if name in tied else model, picked)
            del picked[name]
        if name in tied and name != "text":
            descend(k + 1, got, model, picked)

    descend(0, 0, "", {})
    return best


def candidates(machines: DataFrame) -> DataFrame:
    """(dedup_key, id, crawled, real, filled, size, text_code, row_code) of every row whose key stands for something known; a description leaves its task as its size and model number."""
    rows = machines.where(F.col("dedup_key").isNotNull() & ~F.array_contains(unknown_keys(), F.col("dedup_key")) & F.col("id").isNotNull())
    known = [F.coalesce(F.trim(c) != "", F.lit(False)).cast("int") for c in ("brand", "model", "stock_number", "machine_type")]
    picked = rows.select(
        "dedup_key", "id", F.col("last_crawled_at").cast("timestamp_ntz").alias("crawled"), real_amount(F.col("price")).alias("real"),
        sum(known[1:], known[0]).alias("filled"), F.upper(F.coalesce("model", F.lit(""))).alias("model"), "description",
    )

    fitted = boilerplate.model()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sized = completeness(list(b["description"].array), fitted)
            yield b.drop(columns=["description", "model"]).assign(size=[s for s, _ in sized], text_code=[c for _, c in sized], row_code=[title_code([m], strict=False) for m in b["model"].array])

    return spread(picked).mapInPandas(read, "dedup_key string, id long, crawled timestamp_ntz, real boolean, filled int, size long, text_code string, row_code string")


def best_bundles(rows: DataFrame) -> DataFrame:
    """One row per (dedup_key, model number) with the best row of each bundle."""
    old = F.lit("0001-01-01").cast("timestamp_ntz")
    when = F.coalesce("crawled", old)
    tie = -F.col("id")
    code = F.when(F.col("text_code") != "", F.col("text_code")).otherwise(F.col("row_code"))
    return rows.groupBy("dedup_key", code.alias("code")).agg(
        F.count("*").alias("rows"),
        F.max(F.when(F.col("real"), F.struct(when.alias("at"), tie.alias("tie")))).alias("offer"),
        F.max(F.when(F.col("size") > 0, F.struct("size", when.alias("at"), tie.alias("tie")))).alias("text"),
        F.max(F.when(F.col("filled") > 0, F.struct("filled", when.alias("at"), tie.alias("tie")))).alias("identity"),
        F.max(F.struct(when.alias("at"), tie.alias("tie"))).alias("page"),
    )


def survivors(machines: DataFrame) -> DataFrame:
    """(dedup_key, offer_id, text_id, identity_id, page_id): the machines.id that provides each bundle.

    Keys that stand for nothing known, null keys and keys of one row give no
    row.  A bundle is null where no copy has a usable value.  Rows without
    last_crawled_at rank as oldest; ties go to the later crawl, then to the
    smaller id; repeated rows change nothing.
    """
    kinds = {"offer": [("at", "timestamp_ntz")], "text": [("size", "long"), ("at", "timestamp_ntz")], "identity": [("filled", "int"), ("at", "timestamp_ntz")], "page": [("at", "timestamp_ntz")]}
    best = best_bundles(candidates(machines))
    # distinct model numbers of a key, not its rows
    grouped = best.groupBy("dedup_key").agg(F.sum("rows").alias("copies"), F.collect_list(F.struct("code", *[F.struct(*[F.col(f"{b}.{f}").cast("string" if t.startswith("time") else t).alias(f) for f, t in fs], F.col(f"{b}.tie").alias("tie")).alias(b) for b, fs in kinds.items()])).alias("found")).where("copies > 1").drop("copies")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, found in zip(b["dedup_key"].array, b["found"].array):
                choices = {}
                for name, fields in kinds.items():
                    have = [(tuple(f[name][x] for x, _ in fields), f[name]["tie"], f["code"]) for f in found if f[name] is not None and f[name]["tie"] is not None]
                    ranks = {v: k + 1 for k, v in enumerate(sorted({(h[0], h[1]) for h in have}))}
                    choices[name] = [(ranks[(v, tie)], code, -int(tie)) for v, tie, code in have]
                _, row = branch_and_bound(choices, TIED)
                out.append((key, *[row.get(name) for name in BUNDLES]))
            yield pd.DataFrame(out, columns=["dedup_key", "offer_id", "text_id", "identity_id", "page_id"]).astype({f"{n}_id": "Int64" for n in BUNDLES})

    return grouped.mapInPandas(choose, "dedup_key string, offer_id long, text_id long, identity_id long, page_id long")


def found(machines: DataFrame) -> DataFrame:
    """(dedup_key, field, id) for price and description."""
    fields = F.array(F.struct(F.lit("price").alias("field"), F.col("offer_id").alias("id")), F.struct(F.lit("description").alias("field"), F.col("text_id").alias("id")))
    return survivors(machines).select("dedup_key", F.explode(fields).alias("f")).select("dedup_key", "f.field", "f.id").where("id is not null")
