"""Attribute-value rows into wide tables, by characteristic sets.

An entity's *characteristic set* is the exact set of attributes it states, its
signature.  Rows are read, the latest cell of each entity and attribute is
kept, and an entity's cells make one dense row under its signature: the table
of a set holds the columns of that set and no others.  The rows are written
once, in the order of their signatures, so a set lies together.  The most
frequent sets are then branches with their own columns, the rest are laid out
by each row's own signature, and ``unionByName(allowMissingColumns=True)``
puts the tables together.  No set is merged with another and none is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attributes import Labels, read_value
from ..functions.quantities import UnitTable
from ..runtime import spread, table, written

SQL_TYPES = {"int": "bigint", "boolean": "boolean", "text": "string", "decimal": "double"}


def attribute_list(attributes: DataFrame) -> list[tuple[str, str, str | None, str | None]]:
    """The attribute list (a small reference table whose columns become the plan's columns)."""
    rows = attributes.select("attr_name", "data_type", "quantity", "labels").where("attr_name is not null").orderBy("attr_name").collect()
    return [tuple(r) for r in rows]


def unit_rows(units: DataFrame) -> list[tuple[str, str, float, float]]:
    return [tuple(r) for r in units.select("unit_name", "quantity", "factor", "offset_value").where("unit_name is not null").collect()]


def reader(attributes: list[tuple], units: list[tuple], types: tuple[str, ...] = ("int", "boolean", "text", "decimal")) -> Callable[[str, str, str | None], tuple[int, str | Decimal] | None]:
    """What a row states, as (place of its attribute in the list, text or number); None where the label is outside the list or the value states nothing that can be read."""
    table_ = UnitTable(units)
    labels = Labels(attributes, table_)
    place = {name: k for k, (name, *_) in enumerate(attributes)}
    own: dict[str, tuple | None] = {}  # by label: its attribute's place, the attribute, the label's unit, and the values met before
    met: dict[tuple, dict] = {}

    def labelled(label: str) -> tuple | None:
        if len(own) > 50_000:
            own.clear()
        hit = labels.find(label)
        own[label] = None if hit is None or hit[0].data_type not in types else (place[hit[0].name], *hit, met.setdefault(hit, {}))
        return own[label]

    def read(label: str, value: str, unit: str | None) -> tuple[int, str | Decimal] | None:
        known = own[label] if label in own else labelled(label)
        if known is None:
            return None
        k, attribute, in_label, before = known
        key = (value, unit)
        if key in before:
            return before[key]
        got = read_value(attribute, value, unit, in_label, table_)
        out = None if got is None else (k, got)
        if len(value) < 100:  # what is read does not depend on it
            if len(before) > 20_000:
                before.clear()
            before[key] = out
        return out

    return read


def read_batch(b: pa.RecordBatch, understood: Callable) -> tuple[np.ndarray, ...]:
    """(place of the attribute or -1, text, number) of each row of a batch; equal rows are read once."""
    codes, words = np.zeros(b.num_rows, dtype=np.int64), []
    for name in ("spec_key", "spec_value", "spec_unit"):
        c = b.column(name).dictionary_encode()
        words.append([*c.dictionary.to_pylist(), None])
        at = c.indices.fill_null(len(c.dictionary)).to_numpy(zero_copy_only=False)
        codes = codes * len(words[-1]) + at
    distinct, back = np.unique(codes, return_inverse=True)
    labels, values, units = words
    attrs, texts, numbers = np.full(len(distinct), -1, dtype=np.int64), np.full(len(distinct), None, dtype=object), np.full(len(distinct), np.nan)
    for k, code in enumerate(distinct.tolist()):
        code, u = divmod(code, len(units))
        code, v = divmod(code, len(values))
        got = understood(labels[code], values[v], units[u])
        if got is not None:
            attrs[k] = got[0]
            if isinstance(got[1], str):
                texts[k] = got[1]
            else:
                numbers[k] = float(got[1])
    return attrs[back], texts[back], numbers[back]


def read_cells(specs: DataFrame, attributes: list[tuple], units: list[tuple], most: int = 100_000) -> DataFrame:
    """Readable rows as (machine_id, attr, id, text, number), the latest of each task's rows per entity and attribute.

    ``attr`` is the place in the attribute list.  ``text`` holds int, boolean
    and text readings, ``number`` the base value of decimal ones.  A task hands
    its cells on when it has ``most`` rows of them, so an entity with a third
    of all rows leaves a task as a few cells; the last word is ``latest_cells``'.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        understood = reader(attributes, units)
        held: list[tuple[np.ndarray, ...]] = []

        def latest() -> tuple[np.ndarray, ...]:
            machine, attr, id_, text, number = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((id_, attr, machine))
            machine, attr = machine[order], attr[order]
            last = np.append((machine[1:] != machine[:-1]) | (attr[1:] != attr[:-1]), True)
            # rows that share the greatest id stay side by side for the aggregate to choose from
            same = np.append((machine[1:] == machine[:-1]) & (attr[1:] == attr[:-1]) & (id_[order][1:] == id_[order][:-1]), False)
            for _ in range(int(same.any())):
                for k in np.flatnonzero(same)[::-1]:
                    last[k] |= last[k + 1]
            kept = order[last]
            return machine[last], attr[last], id_[kept], text[kept], number[kept]

        def out(cells: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            machine, attr, id_, text, number = cells
            columns = [pa.array(machine), pa.array(attr.astype(np.int32)), pa.array(id_), pa.array(text, pa.string()), pa.array(number, mask=np.isnan(number))]
            return pa.RecordBatch.from_arrays(columns, ["machine_id", "attr", "id", "text", "number"])

        rows = 0
        for b in batches:
            attr, text, number = read_batch(b, understood)
            seen = attr >= 0
            machine, id_ = b.column("machine_id").to_numpy(zero_copy_only=False), b.column("id").to_numpy(zero_copy_only=False)
            held.append((machine[seen], attr[seen], id_[seen], text[seen], number[seen]))
            rows += int(seen.sum())
            if rows > most:
                held = [latest()]
                rows = len(held[0][0])
                if rows > most // 2:
                    yield out(held[0])
                    held, rows = [], 0
        if held:
            yield out(latest())

    source = specs.where("spec_key is not null and id is not null and spec_value is not null and machine_id is not null").select("id", "machine_id", "spec_key", "spec_value", "spec_unit")
    return spread(source).mapInArrow(read, "machine_id long, attr int, id long, text string, number double")


def latest_cells(rows: DataFrame, attributes: list[tuple]) -> DataFrame:
    """(machine_id, attr_name, cell): the row with the greatest id of each entity and attribute; moved once, to the place of the entity."""
    names = F.array(*[F.lit(n) for n, *_ in attributes]) if attributes else F.array(F.lit(""))
    best = rows.repartition("machine_id").groupBy("machine_id", "attr").agg(F.max(F.struct("id", "text", "number")).alias("r"))
    return best.select("machine_id", F.get(names, F.col("attr")).alias("attr_name"), F.struct("r.text", "r.number").alias("cell"))


def entity_cells(cells: DataFrame, attributes: list[tuple]) -> DataFrame:
    """(machine_id, signature, cells) with one row per entity: the places of its attributes in the list, in order, and its cells by place."""
    place = F.create_map(*[x for k, (name, *_) in enumerate(attributes) for x in (F.lit(name), F.lit(k))]) if attributes else F.create_map().cast("map<string,int>")
    stated = F.array_sort(F.collect_list(F.struct(F.try_element_at(place, F.col("attr_name")).alias("k"), F.col("cell").alias("v"))))
    entities = cells.groupBy("machine_id").agg(F.map_from_entries(stated).alias("cells"))
    return entities.select("machine_id", F.array_join(F.transform(F.map_keys("cells"), lambda k: k.cast("string")), ",").alias("signature"), "cells")


def typed(cell: Column, kind: str) -> Column:
    return cell["number"] if kind == "decimal" else cell["text"].try_cast(SQL_TYPES[kind])


def pivot(spark: SparkSession, sf_dir: str, max_classes: int = 6) -> DataFrame:
    """One row per machine with a typed column for each attribute of ``spec_attributes``.

    Defined results: machines without a readable row are absent; repeated rows
    count once; of contradicting rows the one with the greatest id counts;
    empty input gives an empty table with all columns.  Extra columns of the
    input are ignored.
    """
    attributes = attribute_list(table(spark, sf_dir, "spec_attributes"))
    rows = read_cells(table(spark, sf_dir, "machine_specs"), attributes, unit_rows(table(spark, sf_dir, "unit_ref")))
    return characteristic_sets(entity_cells(latest_cells(rows, attributes), attributes), attributes, max_classes)


def characteristic_sets(entities: DataFrame, attributes: list[tuple], max_classes: int = 6) -> DataFrame:
    """The dense tables of the exact sets, put together by name.

    The ``max_classes`` - 1 most frequent sets are branches of the plan with
    their own columns only.  Every other entity's dense row is laid out by its
    own set, row by row: the number of sets has no bound that a plan could hold.
    """
    spark, names = entities.sparkSession, [a[0] for a in attributes]
    stored = spark.read.schema(entities.schema).parquet(written(entities.sortWithinPartitions("signature")))
    counts = stored.groupBy("signature").agg(F.count("*").alias("n"))
    frequent = [r["signature"] for r in counts.orderBy(F.desc("n"), "signature").limit(max(0, max_classes - 1)).collect()]
    cell = lambda k, kind: typed(F.try_element_at(F.col("cells"), F.lit(k)), kind)
    rest = stored.where(~F.col("signature").isin(frequent)) if frequent else stored
    out = rest.select("machine_id", *[cell(k, kind).alias(n) for k, (n, kind, *_) in enumerate(attributes)])
    for signature in frequent:
        own = [int(k) for k in signature.split(",") if k]
        dense = stored.where(F.col("signature") == signature).select("machine_id", *[cell(k, attributes[k][1]).alias(names[k]) for k in own])
        out = out.unionByName(dense, allowMissingColumns=True)
    return out.select("machine_id", *names)


def cells_of(wide: DataFrame, attributes: list[tuple], types: tuple[str, ...]) -> DataFrame:
    """The filled cells of a wide table as (machine_id, attr_name, attr_value)."""
    picked = [(n, k) for n, k, *_ in attributes if k in types]
    if not picked:
        return wide.select("machine_id", F.lit("").alias("attr_name"), F.lit("").alias("attr_value")).where("false")
    pairs = F.array(*[F.struct(F.lit(n).alias("attr_name"), F.col(n).cast("string").alias("attr_value")) for n, _ in picked])
    return wide.select("machine_id", F.explode(pairs).alias("c")).select("machine_id", "c.attr_name", "c.attr_value").where("attr_value is not null")
