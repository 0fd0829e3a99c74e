"""Quantities recorded in different units, and amounts recorded in different currencies."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantities import NUMBER, half_up, to_number
from ..runtime import spread, table
from .eav import attribute_list, reader, unit_rows

# How currencies are written. Minor units count a hundredth.
CURRENCY_WORDS = {
    "EUR": "eur € euro euros",
    "USD": "usd us$ $ usdollar usdollars dollar dollars",
    "GBP": "gbp £ ukp poundsterling pounds sterling",
    "CHF": "chf sfr fr franken francs schweizerfranken",
    "PLN": "pln zł zloty złoty zlotys",
    "SEK": "sek kr swedishkrona swedishkronor kronor krona",
    "JPY": "jpy ¥ yen 円",
}
MINOR_WORDS = {"EUR": "ct cent cents eurocent eurocents eurcents eurcent", "GBP": "pence penny gbx p", "USD": "usc uscents uscent", "CHF": "rappen rp", "PLN": "gr grosz", "SEK": "öre"}
_WORDS = {w: (c, 1.0) for c, ws in CURRENCY_WORDS.items() for w in ws.split()} | {w: (c, 0.01) for c, ws in MINOR_WORDS.items() for w in ws.split()}


def parse_currency(text: str | None) -> tuple[str, float] | None:
    """(ISO code, scale) of a currency expression: ``kGBP``, ``T€``, ``EUR x1000``, ``USD '000``, ``tys. PLN``, ``pence``."""
    if text is None:
        return None
    s = re.sub(r"[\s.]+", "", text)
    scale = 1.0
    for pattern in (r"(.+?)(?:[x×*]1000|'000|’000)", r"(?:tys|tsd|mille|thousand)(.+)"):
        if m := re.fullmatch(pattern, s, re.I):
            s, scale = m[1], 1000.0
    low = s.lower()
    if low in _WORDS:
        code, unit = _WORDS[low]
        return code, unit * scale
    if m := re.fullmatch(r"[kKT](.+)", s):
        if m[1].lower() in _WORDS:
            code, unit = _WORDS[m[1].lower()]
            return code, unit * 1000.0 * scale
    if m := re.fullmatch(r"(.+)k", s):
        if m[1].lower() in _WORDS:
            code, unit = _WORDS[m[1].lower()]
            return code, unit * 1000.0 * scale
    return None


_NAMES = sorted({"Swedish krona", "Swedish kronor", "Pound Sterling", "US Dollar", "US Dollars", "EUR cents", "US cents", "SFr.", "Fr."}
                | {w for w in _WORDS if len(w) > 1 and w.isalpha()} | {"€", "$", "£", "¥", "zł", "US$", "k€", "T€", "£k"}
                | {p + c for p in "kT" for c in CURRENCY_WORDS}, key=lambda w: (-len(w), w))
_CUR = "(?:" + "|".join(re.escape(n) for n in _NAMES) + ")"
_STATED = re.compile(rf"(?<![\w])(?P<a>{_CUR})\s*(?P<n>{NUMBER})(?![\w])|(?<![\d.,'’])(?P<m>{NUMBER})\s*(?P<b>{_CUR})(?![\w])", re.I)


def stated_currency(price: Decimal | float, description: str | None) -> tuple[str, float] | None:
    """The currency beside the same amount in a description.

    Lines that offer something else (a name, a dash, an amount) belong to the
    page around the offer and are passed over.
    """
    if not description:
        return None
    for line in description.split("\n"):
        if not re.search(r"\d", line) or re.search(r"\s[-–—]\s*\S*\s*[\d.,'’\s]+\S*\s*$", line):
            continue
        for m in _STATED.finditer(line):
            number, word = (m["n"], m["a"]) if m["a"] else (m["m"], m["b"])
            if abs(to_number(number) - Decimal(price)) <= Decimal("0.005") and (found := parse_currency(word)):
                return found
    return None


def spec_values(specs: DataFrame, attributes: list[tuple], units: list[tuple]) -> DataFrame:
    """(id, base_value) of every measured row that can be read, in the base unit."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader(attributes, units, ("decimal",))
        for b in batches:
            ids, values = [], []
            for id_, label, value, unit in zip(*[c.to_pylist() for c in b.columns]):
                got = read(label, value, unit)
                if got is not None:
                    ids.append(id_)
                    values.append(half_up(got[1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.int64())], ["id", "base_value"])

    source = specs.where("spec_key is not null and id is not null and spec_value is not null").select("id", "spec_key", "spec_value", "spec_unit")
    return spread(source).mapInArrow(convert, "id long, base_value long")


def prices_in_eur(machines: DataFrame, rates: dict[str, float]) -> DataFrame:
    """(id, base_value) of every price whose currency is known, in EUR.

    The currency column is read first; the description only where that column
    is null or blank, so its text is not moved for the other rows.
    """

    exact = {code: Decimal(repr(float(rate))) for code, rate in rates.items() if code is not None and rate is not None}

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[str, Decimal] | None] = {}
        for b in batches:
            ids, values = [], []
            for id_, price, currency, text in zip(*[c.to_pylist() for c in b.columns]):
                if currency is None:
                    found = stated_currency(price, text)
                else:
                    if currency not in memo:
                        memo[currency] = parse_currency(currency)
                    found = memo[currency]
                if found and found[0] in exact:
                    ids.append(id_)
                    values.append(half_up(price * Decimal(repr(found[1])) * exact[found[0]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.int64())], ["id", "base_value"])

    blank = F.coalesce(F.trim(F.regexp_replace("currency", r"[\s\u00a0]+", "")), F.lit("")) == ""
    source = machines.where("price is not null and id is not null").select(
        "id", F.col("price").cast("decimal(38,6)").alias("price"), F.when(~blank, F.col("currency")).alias("currency"), F.when(blank, F.col("description")).alias("description")
    )
    return spread(source.where("price is not null")).mapInArrow(convert, "id long, base_value long")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, id, base_value): every measured row and every price in common units, rounded half up.

    Defined results: nulls, blank or unreadable values and unknown units give
    no row; a row of the input that is there twice gives its row twice.
    Amounts are decimals throughout, so no size of amount is rounded twice.
    """
    attributes, units = attribute_list(table(spark, sf_dir, "spec_attributes")), unit_rows(table(spark, sf_dir, "unit_ref"))
    rates = {r[0]: r[1] for r in table(spark, sf_dir, "exchange_rates").select("currency_code", "eur_per_unit").collect()}
    specs = spec_values(table(spark, sf_dir, "machine_specs"), attributes, units).select(F.lit("spec").alias("kind"), "id", "base_value")
    prices = prices_in_eur(table(spark, sf_dir, "machines"), rates).select(F.lit("price").alias("kind"), "id", "base_value")
    return specs.unionByName(prices)
