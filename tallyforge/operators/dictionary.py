"""Free text against a dictionary of terms: exact, then the longest term contained, then the text itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, outer, title_case


def terms(reference: DataFrame, name: str, synonyms: str) -> list[tuple[str, str]]:
    """(cleaned term, canonical name), longest first, then in alphabetical order. The dictionary is a small fixed table."""
    split = F.concat(F.array(name), F.split(F.coalesce(synonyms, F.lit("")), ";"))
    rows = reference.select(name, F.explode(split).alias("term")).select(clean(F.col("term")).alias("term"), F.col(name).alias("canonical")).where("term <> ''")
    rows = rows.groupBy("term").agg(F.min("canonical").alias("canonical")).collect()
    return sorted([(r["term"], r["canonical"]) for r in rows], key=lambda t: (-len(t[0]), t[0]))


def canonical(text: Column, dictionary: list[tuple[str, str]]) -> Column:
    """Canonical name of a text; the title-cased text where no term is in it; null for nothing."""
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(c).alias("c")) for t, c in dictionary])

    def look_up(key: Column) -> Column:
        exact = F.get(F.filter(table, lambda x: x["t"] == key), F.lit(0))["c"]
        within = F.get(F.filter(table, lambda x: F.contains(key, x["t"])), F.lit(0))["c"]
        return F.when(key != "", F.coalesce(exact, within))

    # the key is bound once per row, not cleaned again for every term
    found = F.get(F.transform(F.array(clean(text)), look_up), F.lit(0))
    return F.when(clean(text) != "", F.coalesce(found, title_case(outer(text))))


def known(text: Column, dictionary: list[tuple[str, str]]) -> Column:
    """Canonical name of the longest term in a text, null where there is none."""
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(c).alias("c")) for t, c in dictionary])
    first = lambda key: F.get(F.filter(table, lambda x: F.contains(key, x["t"])), F.lit(0))["c"]
    return F.get(F.transform(F.array(clean(text)), first), F.lit(0))
