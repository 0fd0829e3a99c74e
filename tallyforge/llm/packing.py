"""Fixed-capacity containers filled with texts of varying length.

Only the histogram of lengths is planned, in one task per capacity: it has at
most as many entries as the capacity has tokens, however many texts there are.
Shallow combinations of lengths that fill a window below the capacity are
enumerated against what the histogram still holds, non-negative least squares
solves how often each is repeated to use the histogram up, and the repeats are
rounded to whole numbers as far as the lengths last.  That is done again on
what is left as long as it places a good part of it; the rest is packed
greedily.  Greedy packing of everything is the yardstick: while the plan needs
more containers, combinations that fill worst are taken back and the
rest is packed anew.

Texts get their place by rank: their number among the texts of their length.
Ranks are counted in the order of hashes: texts fall into as many hash ranges
as keep a range small, so that a length shared by a third of all texts is many
tasks.  A text longer than the capacity is split into full containers and a
rest that is packed like any other text.
"""

from __future__ import annotations

import math
import pickle
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..runtime import cut

WINDOW = 0.004
Combo = tuple[tuple[int, int], ...]


def combinations(left: dict[int, int], capacity: int, depth: int = 8) -> list[Combo]:
    """Shallow combinations ((length, times), ...) of lengths that are there, whose sum lies in the window below the capacity.

    Each begins with copies of one length, goes on with the greatest other
    lengths that fit a chosen number of times into the room, and is closed by
    one length or two that fill it exactly where there are such.
    """
    sizes = sorted(left)
    there = np.zeros(capacity + 1, dtype=np.int64)
    there[sizes] = [left[k] for k in sizes]
    low, top = capacity * (1 - WINDOW), sizes[-1] if sizes else 0
    pairs: dict[int, tuple[int, int] | None] = {}

    def pair(room: int) -> tuple[int, int] | None:
        """The two lengths with the most copies that add up to the room."""
        if room not in pairs:
            half = np.arange(1, room // 2 + 1)
            few = np.minimum(there[half], there[room - half])
            few[half * 2 == room] //= 2
            k = int(np.argmax(few)) if len(few) else 0
            pairs[room] = (k + 1, room - k - 1) if len(few) and few[k] > 0 else None
        return pairs[room]

    out: dict[Combo, None] = {}
    for size in sizes:
        for first in sorted({1, min(left[size], capacity // size), min(left[size], max(1, capacity // (2 * size)))}):
            for often in (1, 2, 3, 5, 8):
                parts, room = {size: first}, capacity - first * size
                while room > 0 and len(parts) < depth:
                    if there[room] > parts.get(room, 0):
                        parts[room] = parts.get(room, 0) + 1
                        room = 0
                        break
                    if room <= 2 * top and (ends := pair(room)) and all(there[x] > parts.get(x, 0) + (ends[0] == ends[1]) for x in ends):
                        for x in ends:
                            parts[x] = parts.get(x, 0) + 1
                        room = 0
                        break
                    at = bisect_right(sizes, max(1, room // often)) - 1
                    while at >= 0 and sizes[at] in parts:
                        at -= 1
                    if at < 0:
                        break
                    n = min(left[sizes[at]], room // sizes[at], often)
                    if n <= 0:
                        break
                    parts[sizes[at]] = n
                    room -= n * sizes[at]
                if capacity - room >= low:
                    out.setdefault(tuple(sorted(parts.items())))
    return list(out)


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-7) -> np.ndarray:
    """min |a x - b| with x >= 0 for a small dense matrix."""
    rows, columns = np.nonzero(a)
    return sparse_nnls(rows, columns, a[rows, columns].astype(float), b.astype(float), a.shape[1], tolerance)


def sparse_nnls(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, b: np.ndarray, n: int, tolerance: float = 1e-4) -> np.ndarray:
    """min |a x - b| with x >= 0, by projected gradients with momentum that starts anew where the error rises, until a hundred steps change nothing that counts."""
    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=values * x[columns], minlength=len(b))

    def backward(r: np.ndarray) -> np.ndarray:
        return np.bincount(columns, weights=values * r[rows], minlength=n)

    if not len(rows):
        return np.zeros(n)
    v = np.ones(n)
    for _ in range(30):  # the greatest eigenvalue bounds the step
        v = backward(forward(v))
        size = float(np.linalg.norm(v))
        v = v / size if size else v
    step = 1.0 / (1.05 * size) if size else 1.0
    x = y = np.zeros(n)
    t, error, before, k = 1.0, np.inf, np.inf, 0
    while True:
        r = forward(y) - b
        new = np.maximum(0.0, y - step * backward(r))
        got = float(np.linalg.norm(forward(new) - b))
        if got > error:
            y, t = x, 1.0
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t, error, k = new, t2, got, k + 1
        if k % 100 == 0:
            if error <= tolerance * (1 + float(np.linalg.norm(b))) or before - error <= tolerance * max(1.0, before):
                return x
            before = error


def greedy(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths with their times, repeats): the longest length first, then always the longest that still fits."""
    plan = []
    sizes = sorted(k for k, n in left.items() if n > 0)
    left = {k: left[k] for k in sizes}
    while sizes:
        combo, rest = {}, capacity
        at = len(sizes)
        while rest > 0:
            at = min(at, bisect_right(sizes, rest))
            if at == 0:
                break
            size = sizes[at - 1]
            times = min(rest // size, left[size])
            combo[size] = times
            rest -= times * size
            at -= 1
        repeats = min(left[s] // t for s, t in combo.items())
        for s, t in combo.items():
            left[s] -= t * repeats
            if left[s] == 0:
                sizes.remove(s)
        plan.append((combo, repeats))
    return plan


def solved(left: dict[int, int], capacity: int) -> list[tuple[Combo, int]]:
    """(combination, repeats) by least squares on what is left; ``left`` keeps what they do not use."""
    out: list[tuple[Combo, int]] = []
    while left:
        combos = combinations(left, capacity)
        if not combos:
            return out
        sizes = {k: i for i, k in enumerate(left)}
        rows = np.array([sizes[k] for c in combos for k, _ in c])
        columns = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
        values = np.array([n for c in combos for _, n in c], dtype=float)
        have = np.array([left[k] for k in sizes], dtype=float)
        scale = 1 / np.sqrt(have)  # relative errors count, not those of the fullest lengths
        times = sparse_nnls(rows, columns, values * scale[rows], have * scale, len(combos))
        before, items = len(out), sum(left.values())
        for k in np.argsort(-times, kind="stable"):
            repeats = min([max(1, round(float(times[k]))), *(left.get(x, 0) // n for x, n in combos[k])])
            if times[k] < 1e-3 or repeats <= 0:
                continue
            out.append((combos[k], repeats))
            for x, n in combos[k]:
                left[x] -= n * repeats
                if not left[x]:
                    del left[x]
        if len(out) == before or items - sum(left.values()) < 0.1 * items:
            return out
    return out


def plan(histogram: dict[int, int], capacity: int) -> tuple[dict, int]:
    """({length: (ranks at which its places begin, places per container, first container)}, number of containers)."""
    whole = {int(k): int(n) for k, n in histogram.items() if n > 0 and 0 < k <= capacity}
    left = dict(whole)
    found = solved(left, capacity)
    found.sort(key=lambda c: (sum(k * n for k, n in c[0]) != capacity, -c[1]))
    most = sum(r for _, r in greedy(dict(whole), capacity))
    back = 1
    while True:
        rest = greedy(dict(left), capacity)
        if not found or sum(r for _, r in found) + sum(r for _, r in rest) <= most:
            break
        for combo, repeats in found[-back:]:
            for k, n in combo:
                left[k] = left.get(k, 0) + n * repeats
        del found[-back:]
        back *= 2
    places: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    containers = 0
    for combo, repeats in [*found, *((tuple(c.items()), r) for c, r in rest)]:
        for k, n in combo:
            places.setdefault(k, []).append((taken.get(k, 0), n, containers))
            taken[k] = taken.get(k, 0) + n * repeats
        containers += repeats
    return {k: tuple(np.array(x) for x in zip(*v)) for k, v in places.items()}, containers


def place(where: dict, length: int, ranks: np.ndarray) -> np.ndarray:
    """Container of each rank of one length."""
    starts, per, first = where[length]
    at = np.searchsorted(starts, ranks, side="right") - 1
    return first[at] + (ranks - starts[at]) // per[at]


def ranked(items: DataFrame, in_range: int = 100_000) -> DataFrame:
    """``items`` (container_name, length, ...) with ``rank``, the number of each among those of its container_name and length, from 0.

    Each group is cut into ranges of about ``in_range`` texts by a hash, ranked
    inside them, and the sizes of the ranges before are added.  There are as
    many ranges as the group's size asks for, and they are joined, not broadcast.
    """
    group = ["container_name", "length"]
    ranges = items.groupBy(*group).agg(F.count("*").alias("n")).select(*group, F.ceil(F.col("n") / in_range).alias("ranges"))
    h = F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(1 << 30))
    # one row for each length of a container: bounded by the capacities, not by the texts
    salted = items.join(F.broadcast(ranges), group).withColumn("salt", F.floor(h * F.col("ranges") / (1 << 30)))
    sizes = salted.groupBy(*group, "salt").agg(F.count("*").alias("n"))
    offsets = sizes.select(*group, "salt", (F.sum("n").over(W.partitionBy(*group).orderBy("salt")) - F.col("n")).alias("offset"))
    inner = salted.withColumn("r", F.row_number().over(W.partitionBy(*group, "salt").orderBy("doc_id", "part_no")) - 1)
    return inner.join(offsets, [*group, "salt"]).withColumn("rank", F.col("r") + F.col("offset")).drop("r", "offset", "salt", "ranges")


def pack(sized: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """(container_name, container_no, doc_id, part_no, tokens): every text in a container of every capacity.

    ``sized`` has doc_id and tokens.  Texts within the capacity have one part;
    longer ones are cut into full parts and a rest.  Texts without tokens get
    part 1 with container_no null, as they take no room.  Capacities below one
    are left out; repeated ids stay apart as repeated rows.
    """
    spark = sized.sparkSession
    capacities = sorted({(str(n), int(c)) for n, c in capacities if n is not None and c is not None and c > 0})
    if not capacities:
        return spark.createDataFrame([], "container_name string, container_no long, doc_id long, part_no int, tokens long")
    sized = cut(sized.select("doc_id", "tokens"))
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("container_name"), F.lit(c).cast("long").alias("capacity")) for n, c in capacities]))
    each = sized.select("doc_id", "tokens", names.alias("c")).select("doc_id", "tokens", "c.*")
    parts = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity"))).cast("int")
    pieces = each.select("container_name", "capacity", "doc_id", "tokens", F.explode(F.sequence(F.lit(1), parts)).alias("part_no"))
    pieces = pieces.withColumn("length", F.least(F.col("capacity"), F.col("tokens") - (F.col("part_no") - 1) * F.col("capacity")))
    # at most one row per capacity and length
    counted = pieces.where("length > 0").groupBy("container_name", "capacity", "length").agg(F.count("*").alias("n"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (name, capacity), own in pd.concat([*batches, pd.DataFrame(columns=["container_name", "capacity", "length", "n"])]).groupby(["container_name", "capacity"]):
            where, _ = plan(dict(zip(own["length"].tolist(), own["n"].tolist())), int(capacity))
            yield pd.DataFrame({"name": [name], "plan": [pickle.dumps(where)]})

    # about one task per capacity
    solved = counted.repartition(4 * len(capacities), "container_name").mapInPandas(solve, "name string, plan binary")
    plans = {r["name"]: pickle.loads(r["plan"]) for r in solved.collect()}
    shared = spark.sparkContext.broadcast(plans)  # bounded by the capacities, not by the texts

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            numbers = np.zeros(len(b), dtype=np.int64)
            for (name, length), at in b.groupby(["container_name", "length"], sort=False).indices.items():
                numbers[at] = place(shared.value[name], int(length), b["rank"].to_numpy()[at])
            yield pd.DataFrame({"container_name": b["container_name"], "container_no": numbers, "doc_id": b["doc_id"], "part_no": b["part_no"], "tokens": b["length"]})

    schema = "container_name string, container_no long, doc_id long, part_no int, tokens long"
    placed = ranked(pieces.where("length > 0")).select("container_name", "length", "rank", "doc_id", "part_no").mapInPandas(assign, schema)
    empty = pieces.where("length <= 0").select("container_name", F.lit(None).cast("long").alias("container_no"), "doc_id", "part_no", F.lit(0).cast("long").alias("tokens"))
    return placed.unionByName(empty)


def fill_rates(assigned: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """(container_name, capacity_tokens, n_containers, n_parts, tokens, fill)."""
    spark = assigned.sparkSession
    caps = spark.createDataFrame([(n, int(c)) for n, c in capacities], "container_name string, capacity_tokens int")
    stats = assigned.where("container_no is not null").groupBy("container_name").agg((F.max("container_no") + 1).alias("n_containers"), F.count("*").alias("n_parts"), F.sum("tokens").alias("tokens"))
    return stats.join(F.broadcast(caps), "container_name").withColumn("fill", F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).select("container_name", "capacity_tokens", "n_containers", "n_parts", "tokens", "fill")
