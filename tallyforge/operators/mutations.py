"""Upserts and other changes of tables, as whole-table rewrites.

Parquet has no row-level merge, so a change is a plan from the old table to the
new one; the caller writes it beside the old table and swaps.  Source rows are
reduced to one per key first, with partial aggregation, so a key that arrives a
million times costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(source: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the last by ``order``. Null keys are left out."""
    columns = source.columns
    picked = source.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r"))
    return picked.select("r.*")


def merged(kind: str, old: Column, new: Column, is_text: bool) -> Column:
    """coalesce keeps the old value where the new one is empty, overwrite takes the new one, touch keeps the old one."""
    if kind == "overwrite":
        return new
    if kind == "touch":
        return old
    return F.coalesce(F.nullif(new, F.lit("")) if is_text else new, old)


def upsert(target: DataFrame, source: DataFrame, key: str, modes: dict[str, str], order: list[str]) -> DataFrame:
    """The target after inserting new keys and merging known ones.

    ``modes`` gives the merge of each column (coalesce, overwrite or touch);
    columns without one are touched only on insert.  The result has one row
    per key; ``change`` says inserted, updated or kept.
    """
    s = latest(source, key, order)
    t = target.where(F.col(key).isNotNull())
    kinds = dict(target.dtypes)
    joined = t.alias("t").join(s.alias("s"), F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")
    is_new, is_known = F.col(f"t.{key}").isNull(), F.col(f"s.{key}").isNotNull()
    out = []
    for c in target.columns:
        if c not in source.columns:
            out.append(F.col(f"t.{c}").alias(c))
            continue
        old, new = F.col(f"t.{c}"), F.col(f"s.{c}").cast(kinds[c])
        out.append(F.when(is_new, new).when(is_known & F.lit(c in modes), merged(modes.get(c, "touch"), old, new, kinds[c] == "string")).otherwise(old).alias(c))
    return joined.select(*out, F.when(is_new, "inserted").when(is_known, "updated").otherwise("kept").alias("change"))


def patch(target: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Only the provided fields change; a patch has ``has_<field>`` beside each field, so that a null can be set."""
    p = patches.groupBy(key).agg(*[F.max_by(F.struct(F.col(f), F.col(f"has_{f}")), F.struct(F.lit(1))).alias(f) for f in fields])
    joined = target.alias("t").join(p.alias("p"), key, "left")
    changed = {f: F.when(F.col(f"p.{f}.has_{f}"), F.col(f"p.{f}.{f}")).otherwise(F.col(f"t.{f}")) for f in fields}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c if c == key else f"t.{c}") for c in target.columns])


def delete_cascade(parent: DataFrame, children: dict[str, tuple[DataFrame, str]], doomed: DataFrame, key: str) -> dict[str, DataFrame]:
    """Parent and children without the rows of the doomed keys."""
    out = {"parent": parent.join(doomed, key, "left_anti")}
    for name, (child, foreign) in children.items():
        out[name] = child.join(doomed.withColumnRenamed(key, foreign), foreign, "left_anti")
    return out


def insert_absent(target: DataFrame, source: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The target with the source rows whose key it lacks."""
    fresh = latest(source, key, order).join(target.select(key), key, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def push_new(seen: DataFrame, urls: DataFrame, group: str, url: str) -> DataFrame:
    """Addresses not seen before, once each."""
    return urls.select(group, url).distinct().join(seen.select(group, url).distinct(), [group, url], "left_anti")
