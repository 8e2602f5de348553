"""Boosted trees for several classes at once, over binned features.

Rows are binned and equal rows of one label are counted together. Each stage
grows a tree for every class on what the softmax of all classes leaves unexplained; a
level of all its trees is one Spark aggregate of counts, gradients and hessians
by class, node, feature and bin, and only these histograms reach the driver.
Where the distinct rows are few (CELLS), the same steps run in one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterlight.scratch import stored

#: Stages whose trees are added to the stored margins together, and distinct rows that a task reads.
KEPT, CELLS = 10, 50_000
#: Tasks whose histograms the driver adds up; those of more are added by Spark first.
DIRECT = 16

Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Rising edges for each feature, bins - 1 at most, from approximate quantiles; a value's bin is the number of edges below it."""
    found = df.approxQuantile(list(features), [i / bins for i in range(1, bins)], 0.0005)
    return [np.unique(np.array(x, float)) for x in found]


def new_tree(depth: int) -> Tree:
    """Feature and last bin to the left by node (a feature of -1: no split), and a value by node; the children of node i are 2 i + 1 and 2 i + 2."""
    inner = 2**depth - 1
    return np.full(inner, -1), np.zeros(inner, int), np.zeros(2 * inner + 1)


def node_of(tree: Tree, binned: np.ndarray, levels: int) -> np.ndarray:
    """Node that each row of bins has reached after so many levels."""
    feature, last, _ = tree
    at = np.zeros(len(binned), int)
    for _ in range(levels):
        inner = at < len(feature)
        f = np.where(inner, feature[np.minimum(at, len(feature) - 1)], -1)
        right = binned[np.arange(len(binned)), np.maximum(f, 0)] > last[np.minimum(at, len(feature) - 1)]
        at = np.where(f >= 0, 2 * at + 1 + right, at)
    return at


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def add_stages(margins: np.ndarray, stages: Sequence[Sequence[Tree]], binned: np.ndarray, depth: int, rate: float) -> np.ndarray:
    out = margins.copy()
    for trees in stages:
        for k, tree in enumerate(trees):
            out[:, k] += rate * tree[2][node_of(tree, binned, depth)]
    return out


def _best_split(n: np.ndarray, g: np.ndarray) -> tuple[int, int] | None:
    """Feature and bin of the split with the largest gain of a node's histograms (features by bins), the first of equal ones."""
    left_n, left_g = n.cumsum(axis=1)[:, :-1], g.cumsum(axis=1)[:, :-1]
    all_n, all_g = n.sum(axis=1, keepdims=True), g.sum(axis=1, keepdims=True)
    right_n, right_g = all_n - left_n, all_g - left_g
    both = (left_n > 0) & (right_n > 0)
    apart = left_g / np.maximum(left_n, 1) - right_g / np.maximum(right_n, 1)
    gain = np.where(both, left_n * right_n / np.maximum(all_n, 1) * apart**2, 0.0)
    most = gain.max(initial=0.0)
    if most <= 1e-12:
        return None
    f, b = np.argwhere(gain >= most * (1 - 1e-9))[0]
    return int(f), int(b)


def _batch(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    n = len(batch)
    binned, margins = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for i in (0, 4))
    y, val, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
    return binned, y, val, w.astype(float), margins


def histograms_of(binned: np.ndarray, y: np.ndarray, val: np.ndarray, w: np.ndarray, p: np.ndarray, trees: Sequence[Tree], level: int, bins: int) -> np.ndarray:
    """Counts, gradients and hessians of the training rows: (classes, nodes of the level, features, bins, 3)."""
    first, nodes = 2**level - 1, 2**level
    total = np.zeros((len(trees), nodes, binned.shape[1], bins, 3))
    binned, y, w, p = binned[~val], y[~val], w[~val], p[~val]
    for c, tree in enumerate(trees):
        at = node_of(tree, binned, level) - first
        here = (at >= 0) & (at < nodes)
        g, h = w * ((y == c) - p[:, c]), w * p[:, c] * (1 - p[:, c])
        for f in range(binned.shape[1]):
            key = at[here] * bins + binned[here, f]
            for j, v in enumerate((w, g, h)):
                total[c, :, f, :, j] = np.bincount(key, v[here], nodes * bins).reshape(nodes, bins)
    return total


def loss_of(y: np.ndarray, val: np.ndarray, w: np.ndarray, p: np.ndarray) -> tuple[float, float]:
    """Sum of the validation rows' losses, and their number."""
    of = np.clip(p[np.arange(len(y)), y], 1e-15, 1)[val]
    return float(-(w[val] * np.log(of)).sum()), float(w[val].sum())


def grow_level(trees: Sequence[Tree], level: int, held: np.ndarray) -> None:
    """Splits and values of the level's nodes, and values of their children, from its histograms."""
    k = len(trees)
    step = lambda g, h: (k - 1) / k * g / h if abs(h) > 1e-150 else 0.0
    for (feature, last, value), of_class in zip(trees, held):
        for j, of_node in enumerate(of_class):
            node, (n, g, h) = 2**level - 1 + j, np.moveaxis(of_node, 2, 0)
            if n[0].sum() == 0:
                continue
            value[node] = step(g[0].sum(), h[0].sum())
            split = _best_split(n, g)
            if split:
                f, b = split
                feature[node], last[node] = f, b
                for child, side in ((2 * node + 1, slice(0, b + 1)), (2 * node + 2, slice(b + 1, None))):
                    value[child] = step(g[f, side].sum(), h[f, side].sum())


class SoftmaxTrees:
    """A fitted ensemble: stages of a tree for each class, losses of the validation rows after each, and how many stages count."""

    def __init__(self, features, edges, classes, prior, rate, depth):
        self.features, self.edges, self.classes, self.prior, self.rate, self.depth = list(features), edges, list(classes), prior, rate, depth
        self.stages: list[list[Tree]] = []
        self.losses: list[float] = []
        self.best = 0

    def binned(self, values: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, values[:, i], side="left") for i, e in enumerate(self.edges)])

    def score(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        """df with the classes' probabilities of the best number of stages; rows with a null feature go."""
        model, stages = self, self.stages[: self.best]

        @F.pandas_udf("array<double>")
        def p(*columns: pd.Series) -> pd.Series:
            values = np.column_stack([c.to_numpy(float) for c in columns])
            start = np.tile(model.prior, (len(values), 1))
            return pd.Series(list(softmax(add_stages(start, stages, model.binned(values), model.depth, model.rate))), dtype=object)

        scored = df.dropna(subset=self.features).withColumn("_p", p(*[F.col(c).cast("double") for c in self.features]))
        return scored.withColumns({name: F.col("_p")[i] for i, name in enumerate(names)}).drop("_p")


def boosted_softmax(
    train: DataFrame, val: DataFrame, features: Sequence[str], label: str, classes: Sequence[int], stages: int = 300, depth: int = 3, rate: float = 0.05, bins: int = 32, least: int = 21, gain: float = 0.001, otherwise: int = 50, cells_by_task: int = CELLS
) -> SoftmaxTrees:
    """Trees for all classes in one model, cut to the last stage, from the `least`-th on, that lowers the validation loss by more than `gain` below the lowest so taken.

    If none does, `otherwise` stages count. Rows with a null feature or a label that
    is no class go. Leaves step by (K - 1) / K of gradient over hessian for K
    classes, splits have the largest difference of the two sides' means.
    """
    edges = bin_edges(train.dropna(subset=list(features)), features, bins)
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("int")) - 1
    # bins where the rows are: the number of edges below the value
    cut = F.array(*[sum(((F.col(c) > float(e)).cast("int") for e in of), F.lit(0)) for c, of in zip(features, edges)])
    rows = train.withColumn("_val", F.lit(False)).select(*features, label, "_val").unionByName(val.withColumn("_val", F.lit(True)).select(*features, label, "_val"))
    cells = rows.dropna(subset=[*features, label]).select(cut.alias("bins"), place.cast("int").alias("y"), F.col("_val").alias("val")).filter("y >= 0").groupBy("bins", "y", "val").agg(F.count("*").alias("w"))
    cells = stored(cells, "cells").select("bins", "y", "val", "w")
    counts = {r.y: r.n for r in cells.filter("not val").groupBy("y").agg(F.sum("w").alias("n")).collect()}
    n_k = np.array([counts.get(i, 0) for i in range(len(classes))], float)
    model = SoftmaxTrees(features, edges, classes, np.log(np.maximum(n_k, 1e-9) / max(n_k.sum(), 1)), rate, depth)
    tasks = -(-cells.count() // cells_by_task) or 1
    cells = cells.withColumn("margins", F.array(*[F.lit(float(m)) for m in model.prior])).coalesce(tasks)
    grow = _in_one_task if tasks == 1 else _over_tasks
    model.stages, model.losses = grow(cells, len(classes), len(features), stages, depth, rate, bins, tasks)
    lowest = float("inf")
    for i, loss in enumerate(model.losses, 1):
        if i >= least and loss < lowest - gain:
            lowest, model.best = loss, i
    model.best = model.best or min(otherwise, len(model.stages))
    return model


def _in_one_task(cells: DataFrame, k: int, width: int, stages: int, depth: int, rate: float, bins: int, tasks: int) -> tuple[list[list[Tree]], list[float]]:
    """Stages and losses where the distinct rows are so few that one task holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_batch(b) for b in batches if len(b)]
        if not parts:
            return
        binned, y, val, w, margins = (np.concatenate(x) for x in zip(*parts))
        out, losses = [], []
        for _ in range(stages):
            p, trees = softmax(margins), [new_tree(depth) for _ in range(k)]
            for level in range(depth):
                grow_level(trees, level, histograms_of(binned, y, val, w, p, trees, level, bins))
            margins = add_stages(margins, [trees], binned, depth, rate)
            loss, n = loss_of(y, val, w, softmax(margins))
            out.append(trees)
            losses.append(loss / n if n else float("nan"))
        yield pa.RecordBatch.from_arrays([pa.array(range(stages)), pa.array(losses), pa.array([pickle.dumps(x) for x in out], pa.binary())], names=["stage", "loss", "trees"])

    rows = sorted(cells.mapInArrow(run, "stage long, loss double, trees binary").collect(), key=lambda r: r.stage)
    return [pickle.loads(bytes(r.trees)) for r in rows], [r.loss for r in rows]


def _over_tasks(cells: DataFrame, k: int, width: int, stages: int, depth: int, rate: float, bins: int, tasks: int) -> tuple[list[list[Tree]], list[float]]:
    """Stages and losses with an aggregate a level. Every KEPT stages the rows' margins are stored."""
    done: list[list[Tree]] = []
    losses: list[float] = []
    kept, cells = 0, cells.cache()

    def summed(trees: list[Tree], level: int) -> tuple[np.ndarray, float]:
        since, nodes = done[kept:], 2**level

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, loss = np.zeros((k, nodes, width, bins, 3)), np.zeros(2)
            for batch in batches:
                if len(batch):
                    binned, y, val, w, margins = _batch(batch)
                    p = softmax(add_stages(margins, since, binned, depth, rate))
                    if level == 0:
                        loss += loss_of(y, val, w, p)
                    total += histograms_of(binned, y, val, w, p, trees, level, bins)
            flat = total.reshape(-1, 3)
            some = np.flatnonzero(flat[:, 0])
            values = np.vstack([flat[some], [*loss, 0.0]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1]]), pa.int64()), *(pa.array(values[:, j]) for j in range(3))], names=["key", "n", "g", "h"])

        found = cells.mapInArrow(sums, "key long, n double, g double, h double")
        if tasks > DIRECT:
            found = found.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "g", "h")])
        met = found.toArrow()
        keys, values = met["key"].to_numpy(), np.column_stack([met[c].to_numpy() for c in ("n", "g", "h")])
        out = np.zeros((k * nodes * width * bins, 3))
        np.add.at(out, keys[keys >= 0], values[keys >= 0])
        said = values[keys < 0].sum(axis=0)
        return out.reshape(k, nodes, width, bins, 3), float(said[0] / said[1]) if said[1] else float("nan")

    for stage in range(stages + 1):
        trees = [new_tree(depth) for _ in range(k)]
        for level in range(depth if stage < stages else 1):
            held, loss = summed(trees, level)
            if level == 0 and stage:  # of the stages before
                losses.append(loss)
            grow_level(trees, level, held)
        if stage == stages:
            break
        done.append(trees)
        if len(done) - kept >= KEPT:
            more = done[kept:]

            def moved(batches: Iterator[pa.RecordBatch], more=more) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if len(batch):
                        binned, _, _, _, margins = _batch(batch)
                        new = add_stages(margins, more, binned, depth, rate)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(new) + 1) * k, pa.int32()), pa.array(new.reshape(-1)))
                        yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists], names=batch.schema.names)

            before, cells = cells, stored(cells.mapInArrow(moved, cells.schema), "margins").coalesce(tasks).cache()
            before.unpersist()
            kept = len(done)
    cells.unpersist()
    return done, losses
