"""Linear models over hashed sparse features, fitted on the driver from what it is given or by Spark on every row."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

EXAMPLES = "x binary, y double, n int, key long"  # x: the buckets as int32


def bucket(text: str, bits: int) -> int:
    return zlib.crc32(text.encode()) & ((1 << bits) - 1)


class Rows:
    """Sparse rows of hashed features, each feature with value 1."""

    def __init__(self, rows: list[list[int]]):
        self.starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.index = np.fromiter((f for r in rows for f in r), dtype=np.int64, count=int(self.starts[-1]))

    @classmethod
    def of(cls, starts: np.ndarray, index: np.ndarray) -> Rows:
        out = cls([])
        out.starts, out.index = starts.astype(np.int64), index.astype(np.int64)
        return out

    def __len__(self) -> int:
        return len(self.starts) - 1

    def pick(self, k: np.ndarray) -> Rows:
        """Some of the rows."""
        index, _ = self.take(k)
        return Rows.of(np.concatenate([[0], np.cumsum(self.starts[k + 1] - self.starts[k])]), index)

    def and_(self, other: Rows) -> Rows:
        """These rows and then the others."""
        return Rows.of(np.concatenate([self.starts, self.starts[-1] + other.starts[1:]]), np.concatenate([self.index, other.index]))

    def take(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, position in ``k``) of some rows."""
        n = self.starts[k + 1] - self.starts[k]
        owner = np.repeat(np.arange(len(k)), n)
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return self.index[np.repeat(self.starts[k], n) + offset], owner

    def dot(self, w: np.ndarray) -> np.ndarray:
        if not len(self):
            return np.zeros(0)
        owner = np.repeat(np.arange(len(self)), np.diff(self.starts))
        return np.bincount(owner, weights=w[self.index], minlength=len(self))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: Rows, y: np.ndarray, bits: int, epochs: int = 6, rate: float = 0.15, l2: float = 1e-6, batch: int = 256, seed: int = 3) -> np.ndarray:
    """Weights (the last one is the bias) by mini-batch AdaGrad."""
    rng = np.random.default_rng(seed)
    w, g2 = np.zeros((1 << bits) + 1), np.full((1 << bits) + 1, 1e-6)
    for _ in range(epochs):
        go_over(x, y, rng.permutation(len(x)), w, g2, rate, l2, batch)
    return w


def go_over(x: Rows, y: np.ndarray, order: np.ndarray, w: np.ndarray, g2: np.ndarray, rate: float = 0.15, l2: float = 1e-6, batch: int = 256) -> None:
    """Moves ``w`` and the sums of squared gradients ``g2`` by the rows of ``order``."""
    slot = np.zeros(len(w), dtype=np.int64)
    for at in range(0, len(order), batch):
        k = order[at: at + batch]
        f, owner = x.take(k)
        z = np.bincount(owner, weights=w[f], minlength=len(k)) + w[-1]
        e = sigmoid(z) - y[k]
        # each feature's last place stands for it: distinct features without a sort
        places = np.arange(len(f))
        slot[f] = places
        touched = f[slot[f] == places]
        slot[touched] = np.arange(len(touched))
        place = slot[f]
        g = np.bincount(place, weights=e[owner]) / len(k) + l2 * w[touched]
        g2[touched] += g * g
        w[touched] -= rate * g / np.sqrt(g2[touched])
        gb = e.mean()
        g2[-1] += gb * gb
        w[-1] -= rate * gb / np.sqrt(g2[-1])


def examples(rows: list[list[int]], y: list[float], n: list[int], key: list[int]) -> pa.RecordBatch:
    """Rows of buckets with labels, how often each is met and a key to order them by, as ``fit_everywhere`` takes them."""
    x = Rows(rows)
    ends, buckets = pa.py_buffer((4 * x.starts).astype(np.int32)), pa.py_buffer(x.index.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(x), [None, ends, buckets]), pa.array(y, pa.float64()), pa.array(n, pa.int32()), pa.array(key, pa.int64())], names=["x", "y", "n", "key"])


def fit_everywhere(rows: DataFrame, bits: int, start: np.ndarray | None = None, rounds: int = 2, most: int = 4_000_000, least: int = 50_000, seed: int = 3) -> np.ndarray:
    """Weights (the last one is the bias) by mini-batch AdaGrad over every row of ``examples``, each as often as it is met.

    In each round every partition goes over its own rows, from the same weights;
    they are then averaged by the squared gradients that each partition met, so a
    feature known to one of them keeps its weight.  A partition holds about
    ``most`` features at a time; fewer than ``least`` rows are gone over several times.
    """
    w, g2 = np.zeros((1 << bits) + 1) if start is None else start, np.full((1 << bits) + 1, 1e-6)
    for k in range(rounds):
        w, g2 = _one_round(rows, w, g2, most, least, seed + k)
    return w


def _one_round(rows: DataFrame, w0: np.ndarray, g0: np.ndarray, most: int, least: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    begun = rows.sparkSession.sparkContext.broadcast((w0, g0))  # twice 2^bits floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, g2 = (v.copy() for v in begun.value)
        rng = np.random.default_rng(seed)
        held: list[pa.RecordBatch] = []

        def learn() -> None:
            t = pa.Table.from_batches(held).combine_chunks().sort_by([("key", "ascending"), ("y", "ascending")])
            sizes = pc.binary_length(t["x"]).to_numpy() // 4
            x = Rows.of(np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(t["x"].to_pylist()), np.int32))
            met = np.repeat(np.arange(len(x)), t["n"].to_numpy())
            for _ in range(min(20, max(1, -(-least // len(met))))):
                go_over(x, t["y"].to_numpy(), rng.permutation(met), w, g2)
            held.clear()

        size, seen = 0, False
        for b in batches:
            if b.num_rows:
                held.append(b)
                size, seen = size + pc.sum(pc.binary_length(b.column(0))).as_py() // 4, True
                if size >= most:
                    learn()
                    size = 0
        if held:
            learn()
        if seen:
            met = g2 - begun.value[1]
            three = [[v.tobytes() for v in np.array_split(x.astype(np.float32), 16)] for x in (met * (w - begun.value[0]), met, met > 0)]
            yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), *[pa.array(v, pa.binary()) for v in three]], names=["slice", "moved", "met", "by"])

    # summed slice by slice, so the driver gets one sum of each whatever the number of partitions
    parts = rows.mapInArrow(run, "slice int, moved binary, met binary, by binary").rdd
    sums = parts.map(lambda r: (r[0], np.stack([np.frombuffer(v, np.float32) for v in r[1:]]))).reduceByKey(lambda a, b: a + b, 16).collect()
    if not sums:
        return w0, g0
    moved, met, by = np.concatenate([v for _, v in sorted(sums, key=lambda s: s[0])], axis=1).astype(np.float64)
    return tuple(v + np.divide(d, n, out=np.zeros_like(d), where=n > 0) for v, d, n in ((w0, moved, met), (g0, met, by)))
