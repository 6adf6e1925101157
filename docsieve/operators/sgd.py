"""Stochastic gradient descent for linear classifiers, averaged over blocks of rows.

A hash of its content deals each row to a block of about ``block_rows`` rows, so the number of blocks grows with the data
and they spread over any number of tasks. Each epoch every block runs plain sequential SGD on its own rows, in an order
hashed from the seed, from the current weights; the results are averaged with the blocks' row counts as weights (parallel
SGD, Zinkevich et al. 2010). Blocks and order depend on the rows alone, so the model does not depend on how the table is
partitioned.

Inside a task blocks advance together: step t takes the t-th row of every block, as one mini-batch of compressed sparse rows
in numpy, each row against the weights of its own block. A task leaves one sparse sum of weight changes; these are added up
by feature in an aggregate that combines before its shuffle. Rows move once; after that one number per feature does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from docsieve.operators.models import WeightVectorModel


# Slope of each loss in the margins z = y * score.
SLOPES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "hinge": lambda z: np.where(z <= 1, -1.0, 0.0),
    "perceptron": lambda z: np.where(z <= 0, -1.0, 0.0),
    "squared_hinge": lambda z: np.where(z < 1, -2.0 * (1 - z), 0.0),
    "log": lambda z: -1.0 / (1.0 + np.exp(np.minimum(z, 500.0))),
    "modified_huber": lambda z: np.where(z >= 1, 0.0, np.where(z >= -1, -2.0 * (1 - z), -4.0)),
}
BLOCK_ROWS = 1024
# What one task holds at a time: blocks side by side, feature values of their rows, and weights of all blocks.
LANES, HELD_VALUES, HELD_WEIGHTS = 64, 1 << 22, 1 << 23


def _rate(schedule: str, eta0: float, alpha: float, loss: str, power: float) -> Callable[[int], float]:
    """Step size for the t-th row, counted from 1."""
    if schedule == "constant":
        return lambda t: eta0
    if schedule == "invscaling":
        return lambda t: eta0 / t**power
    if schedule == "optimal":
        typical = np.sqrt(1.0 / np.sqrt(alpha))
        first = typical / max(1.0, float(SLOPES[loss](-typical)))  # the signed slope, as the public rule has it
        start = 1.0 / (first * alpha)
        return lambda t: 1.0 / (alpha * (start + t - 1))
    raise ValueError(f"unknown learning rate {schedule!r}")


class AveragedSGD(Estimator, HasFeaturesCol, HasLabelCol):
    """Linear classifier by SGD; ``n_iter`` is the number of epochs."""

    def __init__(
        self, loss: str = "hinge", penalty: str | None = "l2", alpha: float = 1e-4, l1_ratio: float = 0.15,
        eta0: float = 0.0, learning_rate: str = "optimal", power_t: float = 0.5, n_iter: int = 5,
        shuffle: bool = True, seed: int = 0, weight: str | None = "weight", warm_start: WeightVectorModel | None = None,
        blocks: int | None = None, block_rows: int = BLOCK_ROWS, features: str = "features", label: str = "label",
    ):
        super().__init__()
        if loss not in SLOPES:
            raise ValueError(f"unknown loss {loss!r}")
        self._set(featuresCol=features, labelCol=label)
        share = {None: (0.0, 0.0), "none": (0.0, 0.0), "l2": (0.0, 1.0), "l1": (1.0, 0.0),
                 "elasticnet": (l1_ratio, 1.0 - l1_ratio)}[penalty]
        self.loss, self.l1, self.l2, self.alpha = loss, share[0] * alpha, share[1] * alpha, alpha
        self.eta0, self.learning_rate, self.power_t = eta0, learning_rate, power_t
        self.n_iter, self.shuffle, self.seed, self.weight, self.warm_start = n_iter, shuffle, seed, weight, warm_start
        self.blocks, self.block_rows = blocks, block_rows

    def _fit(self, dataset: DataFrame) -> WeightVectorModel:
        vector = F.unwrap_udt(F.col(self.getFeaturesCol()))
        rows = dataset.select(
            vector["size"].alias("size"), vector["indices"].alias("indices"), vector["values"].alias("values"),
            (2.0 * F.col(self.getLabelCol()) - 1.0).alias("y"),
            (F.col(self.weight) if self.weight else F.lit(1.0)).cast("double").alias("s"),
        ).withColumn("row", F.xxhash64("indices", "values", "y", "s"))
        n = rows.count()
        blocks = self.blocks or max(1, -(-n // self.block_rows))
        rows = rows.withColumn("block", F.pmod("row", F.lit(blocks)).cast("int")).repartition("block").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._run(rows, n, max(1, n // blocks))
        finally:
            rows.unpersist()

    def _run(self, rows: DataFrame, n: int, per_block: int) -> WeightVectorModel:
        first = rows.select("size", F.size("values").alias("n")).first()
        size = first["size"] or first["n"]
        w, b = np.zeros(size), 0.0
        if self.warm_start is not None:
            w = np.array(self.warm_start.getOrDefault("coefficients"))
            b = self.warm_start.getOrDefault("intercept")
        context = rows.sparkSession.sparkContext
        for epoch in range(self.n_iter):
            start = context.broadcast((w, b))  # one number per kept term, checked when the features were fitted
            order = F.xxhash64(F.lit(self.seed + epoch if self.shuffle else self.seed), "row")
            placed = rows.sortWithinPartitions("block", order, "row").select("block", "indices", "values", "y", "s")
            parts = placed.mapInArrow(self._epoch(start, epoch * per_block), "idx long, value double")
            moved = parts.groupBy("idx").agg((F.sum("value") / F.lit(n)).alias("v")).toArrow()
            places, changes = (moved.column(c).to_numpy() for c in ("idx", "v"))
            own = places >= 0
            w = w.copy()
            w[places[own]] += changes[own]
            b += float(changes[~own].sum())
            start.destroy()
        return WeightVectorModel(self.getFeaturesCol(), w.tolist(), float(b))

    def _epoch(self, start, seen: int):
        rate = _rate(self.learning_rate, self.eta0, self.alpha, self.loss, self.power_t)
        steps = _Lanes(SLOPES[self.loss], rate, self.l1, self.l2, seen)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, b = start.value
            total, total_b = np.zeros(len(w)), 0.0
            for group in _groups(batches, len(w)):
                moved, moved_b = steps.run(group, w, b)
                total += moved
                total_b += moved_b
            kept = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(kept, -1)), pa.array(np.append(total[kept], total_b))], ["idx", "value"]
            )

        return run


class _Rows(NamedTuple):
    """Rows of whole blocks: their block, class sign and weight, and their features one after the other."""

    block: np.ndarray
    y: np.ndarray
    s: np.ndarray
    lengths: np.ndarray
    indices: np.ndarray
    values: np.ndarray

    def part(self, low: int, high: int) -> _Rows:
        ends = np.append(0, np.cumsum(self.lengths))
        own, inner = slice(low, high), slice(ends[low], ends[high])
        return _Rows(self.block[own], self.y[own], self.s[own], self.lengths[own], self.indices[inner], self.values[inner])


def _read(batch: pa.RecordBatch, size: int) -> _Rows:
    """The rows of a batch; dense rows get all their places, empty ones a zero at a place after the last."""
    lists = batch.column("values")
    ends = lists.offsets.to_numpy().astype(np.int64)
    lengths, values = np.diff(ends), lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    sparse = batch.column("indices")
    if sparse.null_count:
        indices = [np.arange(n) if place is None else np.array(place) for n, place in zip(lengths, sparse.to_pylist(), strict=True)]
        indices = np.concatenate(indices) if indices else np.zeros(0)
    else:
        places = sparse.offsets.to_numpy()
        indices = sparse.values.to_numpy(zero_copy_only=False)[places[0] : places[-1]]
    bare = np.flatnonzero(lengths == 0)
    if len(bare):
        at = np.cumsum(lengths)[bare]
        indices, values = np.insert(indices, at, size), np.insert(values, at, 0.0)
        lengths[bare] = 1
    block, y, s = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "y", "s"))
    return _Rows(block, y, s, lengths, indices.astype(np.int64), values)


def _groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[_Rows]:
    """Whole blocks together, as many as a task may hold; rows come sorted by block."""
    lanes = max(1, min(LANES, HELD_WEIGHTS // size))
    held: list[_Rows] = []

    def joined() -> _Rows:
        return _Rows(*(np.concatenate(c) for c in zip(*held)))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(_read(batch, size))
        while True:
            blocks = [h.block for h in held]
            if sum(len(h.values) for h in held) < HELD_VALUES and len(np.unique(np.concatenate(blocks))) <= lanes:
                break
            rows = joined()
            starts = np.flatnonzero(np.diff(rows.block)) + 1
            if not len(starts):
                held = [rows]
                break
            cut = starts[min(lanes, len(starts)) - 1]
            yield rows.part(0, cut)
            held = [rows.part(cut, len(rows.block))]
    if held:
        yield joined()


class _Lanes(NamedTuple):
    """SGD on several blocks at once, each with its own weights."""

    slope: Callable[[np.ndarray], np.ndarray]
    rate: Callable[[int], float]
    l1: float
    l2: float
    seen: int

    def run(self, rows: _Rows, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        """The changes of the weights and of the intercept, summed over the rows of all blocks."""
        _, starts, lane, counts = np.unique(rows.block, return_index=True, return_inverse=True, return_counts=True)
        step_of = np.arange(len(lane)) - starts[lane]
        order = np.lexsort((lane, step_of))  # step by step, one row of each block
        begins = np.append(0, np.cumsum(rows.lengths))
        lengths, lane, y, s = rows.lengths[order], lane[order], rows.y[order], rows.s[order]
        ends = np.append(0, np.cumsum(lengths))
        inner = np.arange(ends[-1]) - np.repeat(ends[:-1] - begins[:-1][order], lengths)
        start, width = np.append(w, 0.0), len(w) + 1
        x, places = rows.values[inner], rows.indices[inner] + np.repeat(lane, lengths) * width
        # The weights of a block are scale * v, so shrinking them costs one product.
        v, scale, bias = np.tile(start, len(counts)), np.ones(len(counts)), np.full(len(counts), b)
        paid, owed = (np.zeros(len(v)), 0.0) if self.l1 else (None, 0.0)
        bounds = np.searchsorted(step_of[order], np.arange(counts.max() + 1))
        for t, (low, high) in enumerate(pairwise(bounds.tolist())):
            own, inside = lane[low:high], slice(ends[low], ends[high])
            spots, xs, eta = places[inside], x[inside], self.rate(self.seen + t + 1)
            dots = np.add.reduceat(v[spots] * xs, ends[low:high] - ends[low])
            step = -eta * s[low:high] * y[low:high] * self.slope(y[low:high] * (scale[own] * dots + bias[own]))
            if self.l2:
                scale[own] *= max(0.0, 1.0 - eta * self.l2)
                for small in own[scale[own] < 1e-9]:
                    v[small * width : (small + 1) * width] *= scale[small]
                    scale[small] = 1.0
            v[spots] += np.repeat(step / scale[own], lengths[low:high]) * xs
            bias[own] += step
            if self.l1:
                owed += eta * self.l1
                shrink = np.repeat(scale[own], lengths[low:high])
                old = shrink * v[spots]
                new = np.where(old > 0, np.maximum(0.0, old - owed - paid[spots]), np.minimum(0.0, old + owed - paid[spots]))
                paid[spots] += new - old
                v[spots] = new / shrink
        final = v.reshape(len(counts), width) * scale[:, None]
        return (counts @ (final - start))[:-1], float(counts @ (bias - b))


def perceptron(n_iter: int = 5, seed: int = 0, **options: object) -> AveragedSGD:
    """Perceptron: its own loss, a constant rate of one and no penalty."""
    return AveragedSGD(
        loss="perceptron", penalty=None, eta0=1.0, learning_rate="constant", n_iter=n_iter, seed=seed, **options
    )
