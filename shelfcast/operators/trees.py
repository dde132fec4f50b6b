"""Tree ensembles as Spark jobs: bagged forests, forests of random thresholds, boosting with a penalty on leaves.

Rows are binned once and stored. Trees that don't depend on each other grow together, level by level: tasks add
up counts and sums by (tree, node, cell) over their rows, one shuffle adds up the tasks, and each node's best
split is chosen from its at most inputs x bins sums. A node with few enough rows isn't searched this way: its
rows meet in one group, which grows all that is below it; a boosted tree whose rows are all few enough needs no shuffle for that. Sums are exact, so a tree doesn't depend on which
way its nodes took, nor on partitions. Only trees, whose size the parameters bound, reach the driver.

Draws (bagging, subsamples, thresholds) are hashes of the seed and of a row's own columns, so a seed fixes the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.tree_growth import (
    Cells,
    Rules,
    Tree,
    apply,
    best_first,
    best_splits,
    cell_counts,
    cell_sums,
    edges_of,
    grow,
    grow_on,
    leaves_by_column,
    leaves_of,
    most_rows_sums,
    nodes_to_search,
    uniform,
)
from shelfcast.session import delete_path, materialize, scratch_path

#: Rows of a node that one task grows to the end.
ROWS_IN_A_TASK = 1 << 20
#: Rows that bin edges are found from, at most about so many: those with the smallest hash.
EDGE_ROWS = 200_000
#: Bytes of rows that the trees of one job send to their groups.
JOB_BYTES = 1 << 30
#: Rounds whose trees are added to the stored predictions at a time; of a small table that may stop early also the rounds of a job.
ROUNDS_STORED = 50
#: Rows of a stored part, so that small tables have few.
ROWS_OF_A_PART = 1 << 14
#: Sums of whole numbers stay below this and are exact.
EXACT = 2.0**52
FOREST, RANDOM, BOOSTING = KINDS = ("forest", "random", "boosting")


@dataclass(frozen=True)
class Sizes:
    """What one fit works with: rows, inputs, mean of the target, and the largest distance from it."""

    rows: int
    stop_rows: int
    mean: float
    farthest: float


def stored_rows(data: DataFrame, features: str, label: str, stop: str | None) -> DataFrame:
    """(id, y, x, stop): rows with the hash of their columns, which names a row whatever its place."""
    named = sorted(c.name for c in data.schema if not isinstance(c.dataType, VectorUDT) and c.name not in (label, stop))
    known = F.xxhash64(*(F.col(f"`{c}`") for c in named)) if named else F.xxhash64(vector_to_array(features))
    rows = data.select(
        known.alias("id"),
        F.col(label).cast("double").alias("y"),
        vector_to_array(features).alias("x"),
        (F.col(stop) if stop else F.lit(False)).alias("stop"),
    )
    return materialize(rows, "tree-rows")


def edges(rows: DataFrame, n: int, bins: int) -> list[np.ndarray]:
    """Bin edges of every input, from all rows or, of many, from those with the smallest hash."""
    share = int(min(1.0, EDGE_ROWS / max(n, 1)) * (1 << 32))
    sample = rows.where(~F.col("stop") & (F.pmod(F.xxhash64("id"), F.lit(1 << 32)) < share)).select("x")

    def columns(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = _matrix(batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(range(values.shape[1]), pa.int32()), pa.array([np.ascontiguousarray(v).tobytes() for v in values.T], pa.binary())], ["input", "seen"])

    def cut(table: pa.Table) -> pa.Table:
        seen = np.concatenate([np.frombuffer(v.as_py(), np.float64) for v in table.column("seen")])
        return pa.table({"input": table.column("input")[:1], "edges": pa.array([edges_of(seen, bins)], pa.list_(pa.float64()))})

    # One row for each input, of at most so many numbers as there are bins.
    found = sample.mapInArrow(columns, "input int, seen binary").groupBy("input").applyInArrow(cut, "input int, edges array<double>").collect()
    return [np.array(r.edges, np.float64) for r in sorted(found, key=lambda r: r.input)]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def binned(rows: DataFrame, n: int, cells: Cells, mean: float) -> tuple[DataFrame, str]:
    """(id, y, x, stop, margin), x as one byte for each input; stored, in parts by id."""

    def work(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = cells.bins(_matrix(batch.column(2))) if batch.num_rows else np.zeros((0, len(cells.edges)), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.tobytes() for b in bins], pa.binary()), batch.column(3)], ["id", "y", "x", "stop"])

    made = rows.mapInArrow(work, "id long, y double, x binary, stop boolean").withColumn("margin", F.lit(mean))
    return _stored(made.repartition(max(1, math.ceil(n / ROWS_OF_A_PART)), "id"))


def _stored(rows: DataFrame) -> tuple[DataFrame, str]:
    path = scratch_path(rows.sparkSession, "tree-bins")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


# Whole trees, for rows that later rounds start from: node arrays and values by node.
Grown = tuple[dict[str, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Task:
    """What the tasks of a job know: how targets are made, trees that predictions lack, and partly grown trees with the nodes to work on.

    scale: what makes targets whole numbers. farthest: bound of the targets.
    """

    kind: str
    rules: Rules
    cells: Cells
    scale: float
    loss_scale: float
    mean: float
    share: float
    pending: tuple[Grown, ...]
    partial: dict[int, dict[str, np.ndarray]]
    nodes: dict[int, list[int]]

    def margins(self, bins: np.ndarray, margin: np.ndarray) -> np.ndarray:
        for tree, values in self.pending:
            margin = margin + values[leaves_of(tree, bins)]
        return margin

    def weights(self, ids: np.ndarray, tree: int) -> np.ndarray:
        """How often a tree sees each row."""
        if self.kind == FOREST:
            return np.searchsorted(_POISSON, uniform(ids, self.rules.seed, tree), side="right").astype(np.float64)
        if self.share < 1:
            return (uniform(ids, self.rules.seed, tree) < self.share).astype(np.float64)
        return np.ones(len(ids))

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Ids, bins, targets, predictions by the trees so far, and which rows only tell when to stop."""
        bins = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        stop = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
        return batch.column(0).to_numpy(), bins, batch.column(1).to_numpy(), self.margins(bins, batch.column(4).to_numpy()), stop

    def rows(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Ids, bins and distances of the rows that trees learn from, and the distances of the others."""
        ids, bins, y, margin, stop = self.read(batch)
        rest, learn = y - margin, ~stop
        return ids[learn], bins[learn], rest[learn], rest[stop]


# How often a Poisson draw of mean one is at most 0, 1, 2, ...
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def _facts(rest: np.ndarray, stopping: np.ndarray, task: Task) -> tuple[float, float]:
    """The largest distance, and the whole-number squared distance of the rows that tell when to stop."""
    return float(max(np.abs(rest).max(initial=0.0), np.abs(stopping).max(initial=0.0))), float(np.rint(stopping * stopping * task.loss_scale).sum())


def grown_below(rows: DataFrame, task: Task) -> tuple[dict[tuple[int, int], Tree], float, float]:
    """Whole trees below the task's nodes, by tree and path; the largest distance; the loss."""
    sent = rows.sparkSession.sparkContext.broadcast(task)

    def deal(batches) -> Iterator[pa.RecordBatch]:
        """Each batch's rows of each node as one row."""
        task, farthest, loss = sent.value, 0.0, 0.0
        for batch in batches:
            ids, bins, rest, stopping = task.rows(batch)
            own = _facts(rest, stopping, task)
            farthest, loss = max(farthest, own[0]), loss + own[1]
            g = np.rint(rest * task.scale)
            out = []
            for tree, nodes in task.nodes.items():
                w = task.weights(ids, tree)
                at = leaves_of(task.partial[tree], bins)
                for node in nodes:
                    chosen = np.flatnonzero((at == node) & (w > 0))
                    if len(chosen):
                        out.append((tree, int(task.partial[tree]["path"][node]), bins[chosen].tobytes(), w[chosen].tobytes(), (w * g)[chosen].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _DEALT_TYPES)], _DEALT)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((-1, -1, b"", np.float64(farthest).tobytes(), np.float64(loss).tobytes()), _DEALT_TYPES)], _DEALT)

    def below(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        task = sent.value
        tree, path = (k.as_py() for k in key)
        n, g = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.float64) for c in ("n", "g"))
        if tree < 0:
            found = {"path": np.array([-1]), "input": np.array([-1]), "bin": np.array([0]), "gain": np.array([0.0]), "left": np.array([-1]), "n": np.array([n.max()]), "g": np.array([g.sum()])}
        else:
            bins = np.frombuffer(b"".join(table.column("x").to_pylist()), np.uint8).reshape(len(n), -1)
            found = grow(bins, n, g, path, tree, task.cells, task.rules).arrays()
        columns = [pa.array([tree], pa.int64()), pa.array([path], pa.int64()), *(pa.array([found[c].astype(t).tobytes()], pa.binary()) for c, t in _TREE.items())]
        return pa.table(columns, names=["tree", "node", *_TREE])

    groups = 1 + sum(len(x) for x in task.nodes.values())
    dealt = rows.mapInArrow(deal, "tree long, node long, x binary, n binary, g binary")
    # A number of its own, as merging small groups would leave one task to grow all trees.
    spread = dealt.repartition(min(groups, 4096), "tree", "node")
    found = spread.groupBy("tree", "node").applyInArrow(below, "tree long, node long, " + ", ".join(f"{c} binary" for c in _TREE)).collect()
    sent.unpersist()
    trees, farthest, loss = {}, 0.0, 0.0
    for row in found:
        tree = Tree.of_arrays({c: np.frombuffer(bytes(row[c]), t) for c, t in _TREE.items()})
        if row.tree < 0:
            farthest, loss = tree.n[0], tree.g[0]
        else:
            trees[row.tree, row.node] = tree
    return trees, farthest, loss


@dataclass(frozen=True)
class Round:
    """A boosted tree, the largest distance and the loss before it; no tree after the last round."""

    tree: Tree | None
    scale: float
    farthest: float
    loss: float


def rounds_in_one(rows: DataFrame, task: Task, sizes: Sizes, first: int, count: int, bound: float, rate: float, last: bool) -> list[Round]:
    """Rounds `first` to `first + count` on a table that one task may hold, in one job without a shuffle, as single rounds would give them.

    Rounds follow each other, so the task keeps its place for all of them. What no round changes is made once: bins by column, and rows by cell.
    """
    sent = rows.sparkSession.sparkContext.broadcast(task)

    def work(batches) -> Iterator[pa.RecordBatch]:
        task, far = sent.value, bound
        ids, bins, y, margin, stop = _joined_rows([task.read(batch) for batch in batches if batch.num_rows], len(task.cells.edges))
        learn, columns = ~stop, np.ascontiguousarray(bins.T)
        counts = cell_counts(bins, task.cells)
        for k in range(first, first + count + last):
            now = replace(task, scale=whole_scale(sizes.rows, far), loss_scale=whole_scale(sizes.stop_rows, far**2))
            rest = y - margin
            farthest, loss = _facts(rest[learn], rest[stop], now)
            out = {"facts": np.array([k, now.scale, farthest, loss / now.loss_scale])}
            if k < first + count:
                chosen = (now.weights(ids, k) > 0) & learn
                g = np.where(chosen, np.rint(rest * now.scale), 0.0)
                sums = most_rows_sums(bins, np.flatnonzero(~chosen), g, now.cells, counts)
                tree = best_first(grow_on(bins, columns, np.flatnonzero(chosen), None, g, 1, k, now.cells, now.rules, sums), now.rules.max_leaves)
                found = tree.arrays()
                margin = margin + _values(found, now.scale, now.rules.penalty, rate)[leaves_by_column(tree, columns)]
                out |= {c: found[c].astype(t) for c, t in _TREE.items()}
            far = farthest * (1 + rate)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(out)), pa.array(list(out)), pa.array([x.tobytes() for x in out.values()], pa.binary())], ["k", "name", "value"])

    found: dict[int, dict[str, bytes]] = {}
    for r in rows.coalesce(1).mapInArrow(work, "k long, name string, value binary").collect():
        found.setdefault(r.k, {})[r.name] = bytes(r.value)
    sent.unpersist()
    out = []
    for k in sorted(found):
        _, scale, farthest, loss = np.frombuffer(found[k]["facts"]).tolist()
        tree = Tree.of_arrays({c: np.frombuffer(found[k][c], t) for c, t in _TREE.items()}) if "path" in found[k] else None
        out.append(Round(tree, scale, farthest, loss))
    return out


def _joined_rows(parts: list[tuple], width: int) -> list[np.ndarray]:
    empty = (np.zeros(0, np.int64), np.zeros((0, width), np.uint8), np.zeros(0), np.zeros(0), np.zeros(0, bool))
    return [np.concatenate(x) for x in zip(empty, *parts)]


_DEALT = ["tree", "node", "x", "n", "g"]
_DEALT_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_TREE = {"path": "<i8", "input": "<i2", "bin": "<i2", "gain": "<f8", "left": "<i4", "n": "<f8", "g": "<f8"}
_SPLIT = {"slot": "<i8", "input": "<i8", "bin": "<i8", "gain": "<f8", "n_left": "<f8", "g_left": "<f8", "n": "<f8", "g": "<f8"}


def searched(rows: DataFrame, task: Task) -> tuple[dict[tuple[int, int], dict[str, np.ndarray]], float, float]:
    """The best split of the task's nodes, by tree and path; the largest distance; the loss."""
    sent = rows.sparkSession.sparkContext.broadcast(task)

    def add_up(batches) -> Iterator[pa.RecordBatch]:
        task, farthest, loss = sent.value, 0.0, 0.0
        for batch in batches:
            ids, bins, rest, stopping = task.rows(batch)
            own = _facts(rest, stopping, task)
            farthest, loss = max(farthest, own[0]), loss + own[1]
            g = np.rint(rest * task.scale)
            for tree, nodes in task.nodes.items():
                w = task.weights(ids, tree)
                slot_of = np.full(len(task.partial[tree]["path"]), -1)
                slot_of[nodes] = np.arange(len(nodes))
                slots = slot_of[leaves_of(task.partial[tree], bins)]
                mine = np.flatnonzero((slots >= 0) & (w > 0))
                keys, n, total = cell_sums(slots[mine], bins[mine], w[mine], (w * g)[mine], task.cells, len(nodes))
                if len(keys):
                    paths = task.partial[tree]["path"][np.array(nodes)][keys // task.cells.total]
                    yield _cells_batch(np.full(len(keys), tree), paths, keys % task.cells.total, n, total)
        yield _cells_batch(np.array([-1]), np.array([-1]), np.array([-1]), np.array([farthest]), np.array([loss]))

    def choose(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        task = sent.value
        tree, path = (k.as_py() for k in key)
        order = np.argsort(table.column("cell").to_numpy())
        cell, n, g = (table.column(c).to_numpy()[order] for c in ("cell", "n", "g"))
        if tree < 0:
            found = {c: np.zeros(1) for c in _SPLIT} | {"n": n, "g": g}
        else:
            found = best_splits(cell, n, g, np.array([path]), tree, task.cells, task.rules)
        columns = [pa.array([tree], pa.int64()), pa.array([path], pa.int64()), *(pa.array([found[c].astype(t).tobytes()], pa.binary()) for c, t in _SPLIT.items())]
        return pa.table(columns, names=["tree", "node", *_SPLIT])

    # Whole numbers below the bound: their sums are exact in any order.
    sums = rows.mapInArrow(add_up, "tree long, node long, cell long, n double, g double").groupBy("tree", "node", "cell")
    sums = sums.agg(F.when(F.col("tree") < 0, F.max("n")).otherwise(F.sum("n")).alias("n"), F.sum("g").alias("g"))
    found = sums.groupBy("tree", "node").applyInArrow(choose, "tree long, node long, " + ", ".join(f"{c} binary" for c in _SPLIT)).collect()
    sent.unpersist()
    splits, farthest, loss = {}, 0.0, 0.0
    for row in found:
        split = {c: np.frombuffer(bytes(row[c]), t) for c, t in _SPLIT.items()}
        if row.tree < 0:
            farthest, loss = float(split["n"][0]), float(split["g"][0])
        else:
            splits[row.tree, row.node] = split
    return splits, farthest, loss


def _cells_batch(tree, node, cell, n, g) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in (tree, node, cell)), pa.array(n), pa.array(g)], ["tree", "node", "cell", "n", "g"])


def grow_together(rows: DataFrame, task: Task, numbers: Sequence[int], n: int, in_a_task: int) -> tuple[dict[int, Tree], float, float]:
    """Grow trees that don't depend on each other. Returns them, the largest distance and the loss before them."""
    trees = {k: Tree(n=float(n)) for k in numbers}
    facts = None
    while True:
        small, large = {}, {}
        for k, tree in trees.items():
            for node in nodes_to_search(tree, task.rules):
                (small if tree.n[node] <= in_a_task else large).setdefault(k, []).append(node)
        if not small and not large:
            break
        partial = {k: trees[k].arrays() for k in {**small, **large}}
        if small:
            found, *own = grown_below(rows, replace(task, partial=partial, nodes=small))
            facts = facts or own
            for k, nodes in small.items():
                for node in nodes:
                    # A node that no row reached stays a leaf.
                    trees[k].graft(node, found.get((k, trees[k].path[node]), Tree(trees[k].path[node])))
        if large:
            splits, *own = searched(rows, replace(task, partial=partial, nodes=large))
            facts = facts or own
            for k, nodes in large.items():
                for node in nodes:
                    trees[k].searched[node] = True
                    split = splits.get((k, trees[k].path[node]))
                    if split is not None:
                        apply(trees[k], [node], split)
    return {k: best_first(t, task.rules.max_leaves) for k, t in trees.items()}, *(facts or (0.0, 0.0))


def sizes_of(rows: DataFrame) -> Sizes:
    """Rows, and the target's mean and range, in sums that don't depend on order."""
    learn = ~F.col("stop")
    first = rows.agg(F.count_if(learn).alias("n"), F.count_if(F.col("stop")).alias("stops"), F.min("y").alias("low"), F.max("y").alias("high")).first()
    if not first.n:
        return Sizes(0, first.stops, 0.0, 0.0)
    middle, reach = (first.low + first.high) / 2, (first.high - first.low) / 2
    scale = whole_scale(first.n, reach)
    total = rows.where(learn).agg(F.sum(F.rint((F.col("y") - middle) * scale))).first()[0]
    mean = middle + total / scale / first.n
    return Sizes(first.n, first.stops, mean, max(first.high - mean, mean - first.low))


def whole_scale(n: int, farthest: float) -> float:
    """A power of two that makes values up to ``farthest`` whole numbers whose sum over n rows is exact."""
    return 2.0 ** math.floor(math.log2(EXACT) - math.log2(max(1, n)) - math.log2(max(farthest, 1e-200)))


@dataclass(frozen=True)
class Ensemble:
    """Trees with real thresholds: node arrays end to end, and the first node of each tree."""

    base: float
    inputs: np.ndarray
    limits: np.ndarray
    lefts: np.ndarray
    values: np.ndarray
    firsts: np.ndarray

    @staticmethod
    def of(base: float, grown: Sequence[Grown], cells: Cells) -> "Ensemble":
        columns = {"input": [np.zeros(0, np.int16)], "limit": [np.zeros(0)], "left": [np.zeros(0, np.int32)], "value": [np.zeros(0)]}
        firsts = [0]
        for tree, values in grown:
            limits = np.zeros(len(tree["input"]))
            for i in np.flatnonzero(tree["input"] >= 0).tolist():
                limits[i] = cells.edges[tree["input"][i]][tree["bin"][i]]
            for name, x in zip(columns, (tree["input"], limits, tree["left"], values)):
                columns[name].append(x)
            firsts.append(firsts[-1] + len(values))
        return Ensemble(base, *(np.concatenate(x) for x in columns.values()), np.array(firsts))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for a, b in zip(self.firsts[:-1].tolist(), self.firsts[1:].tolist()):
            tree = {"input": self.inputs[a:b], "left": self.lefts[a:b]}
            out += self.values[a:b][leaves_of(tree, x, self.limits[a:b])]
        return out


def _values(tree: dict[str, np.ndarray], scale: float, penalty: float, factor: float) -> np.ndarray:
    return factor * tree["g"] / scale / np.maximum(tree["n"] + penalty, 1e-300)


class _TreeParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    kind = Param(Params._dummy(), "kind", f"one of {KINDS}", TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "trees of a forest, or rounds of boosting at most", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "splits from the root to a leaf at most", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "factor of every boosted tree", TypeConverters.toFloat)
    share = Param(Params._dummy(), "share", "share of the rows that a boosted tree sees", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "added to the rows of a leaf in its value and in gains (L2)", TypeConverters.toFloat)
    leastRows = Param(Params._dummy(), "leastRows", "rows of a leaf at least", TypeConverters.toInt)
    maxLeaves = Param(Params._dummy(), "maxLeaves", "leaves of a tree at most, the best first; 0: no limit", TypeConverters.toInt)
    bins = Param(Params._dummy(), "bins", "bins of an input, at most 256", TypeConverters.toInt)
    patience = Param(Params._dummy(), "patience", "rounds without a smaller loss on the stop rows before boosting ends; 0: never", TypeConverters.toInt)
    stopCol = Param(Params._dummy(), "stopCol", "column that marks rows which only tell when to stop; empty: none", TypeConverters.toString)
    rowsInATask = Param(Params._dummy(), "rowsInATask", "rows of a node that one task grows to the end", TypeConverters.toInt)

    def getTrees(self) -> int:
        return self.getOrDefault(self.trees)

    def getMaxDepth(self) -> int:
        return self.getOrDefault(self.maxDepth)

    def getRate(self) -> float:
        return self.getOrDefault(self.rate)


class TreeEnsembleRegressor(Estimator, _TreeParams):
    """Estimator of :class:`TreeEnsembleModel`. Rows with a null or NaN label or input are not allowed.

    All atomic columns of the data but the label name a row for the draws; keys among them tell rows apart that are
    otherwise equal.
    """

    @keyword_only
    def __init__(
        self, *, kind=FOREST, trees=100, maxDepth=12, rate=0.1, share=1.0, penalty=0.0, leastRows=1, maxLeaves=0, bins=256, patience=0, stopCol="",
        rowsInATask=ROWS_IN_A_TASK, featuresCol="features", labelCol="label", predictionCol="prediction", seed=0,
    ):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(
            kind=FOREST, trees=100, maxDepth=12, rate=0.1, share=1.0, penalty=0.0, leastRows=1, maxLeaves=0, bins=256, patience=0, stopCol="",
            rowsInATask=ROWS_IN_A_TASK, featuresCol="features", labelCol="label", predictionCol="prediction", seed=0,
        )

    def _fit(self, dataset: DataFrame) -> "TreeEnsembleModel":
        get = lambda p: self.getOrDefault(p)
        rows = stored_rows(dataset, self.getFeaturesCol(), self.getLabelCol(), get(self.stopCol) or None)
        sizes = sizes_of(rows)
        ensemble, losses = Ensemble.of(sizes.mean, [], Cells(())), []
        if sizes.rows:
            cells = Cells(tuple(edges(rows, sizes.rows, get(self.bins))))
            table, path = binned(rows, sizes.rows + sizes.stop_rows, cells, sizes.mean)
            rules = Rules(self.getMaxDepth(), get(self.leastRows), get(self.penalty), get(self.maxLeaves), get(self.kind) == RANDOM, self.getSeed())
            share = get(self.share) if get(self.kind) == BOOSTING else 1.0
            scale = whole_scale(sizes.rows, sizes.farthest * 1.25)
            task = Task(get(self.kind), rules, cells, scale, 1.0, sizes.mean, share, (), {}, {})
            fit = _boost if get(self.kind) == BOOSTING else _forest
            ensemble, losses = fit(self, table, path, task, sizes)
        model = TreeEnsembleModel(ensemble, losses)._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
        return model


def _forest(estimator: TreeEnsembleRegressor, table: DataFrame, path: str, task: Task, sizes: Sizes) -> tuple[Ensemble, list[float]]:
    """Trees in jobs of a bounded size. A bag can hold more than all rows, hence room in the scale."""
    task = replace(task, scale=whole_scale(2 * sizes.rows, sizes.farthest))
    count = estimator.getTrees()
    together = max(1, JOB_BYTES // (sizes.rows * (len(task.cells.edges) + 16)))
    grown = []
    for first in range(0, count, together):
        numbers = range(first, min(count, first + together))
        trees, _, _ = grow_together(table, task, numbers, sizes.rows, estimator.getOrDefault(estimator.rowsInATask))
        grown += [trees[k].arrays() for k in numbers]
    delete_path(table.sparkSession, path)
    return Ensemble.of(sizes.mean, [(t, _values(t, task.scale, task.rules.penalty, 1 / count)) for t in grown], task.cells), []


def _boost(estimator: TreeEnsembleRegressor, table: DataFrame, path: str, task: Task, sizes: Sizes) -> tuple[Ensemble, list[float]]:
    """Round after round on the distances that the trees so far leave.

    A round moves no distance by more than the rate times the largest one, so that the largest one of the round before bounds
    the next, and targets keep their digits as distances shrink. Each job reports the loss on the stop rows
    after the trees before it.
    """
    rate, patience, in_a_task = estimator.getRate(), estimator.getOrDefault(estimator.patience), estimator.getOrDefault(estimator.rowsInATask)
    bound, grown, pending, losses, count = sizes.farthest, [], [], [], estimator.getTrees()
    small, k, stopped = sizes.rows + sizes.stop_rows <= in_a_task, 0, False
    while not stopped and (k < count or k == count and sizes.stop_rows):
        if len(pending) >= ROUNDS_STORED:
            table, path = _with_margins(table, path, replace(task, pending=tuple(pending)))
            pending = []
        now = replace(task, pending=tuple(pending))
        if small:
            some = min(ROUNDS_STORED, count - k) if patience else count - k
            rounds = rounds_in_one(table, now, sizes, k, some, bound, rate, last=k + some == count and sizes.stop_rows > 0)
        else:
            rounds = [_round(table, now, sizes, k, bound, in_a_task, k == count)]
        for found in rounds:
            if sizes.stop_rows:
                losses.append(found.loss / sizes.stop_rows)
                best = int(np.argmin(losses))
                stopped = bool(patience) and len(losses) - 1 - best >= patience
            if stopped or found.tree is None:
                break
            tree = found.tree.arrays()
            grown.append((tree, _values(tree, found.scale, task.rules.penalty, rate)))
            pending.append(grown[-1])
            bound = found.farthest * (1 + rate)
        k += len(rounds)
    if patience and losses:
        grown = grown[: int(np.argmin(losses))]
    delete_path(table.sparkSession, path)
    return Ensemble.of(sizes.mean, grown, task.cells), losses


def _round(table: DataFrame, task: Task, sizes: Sizes, k: int, bound: float, in_a_task: int, last: bool) -> Round:
    """One round over all tasks. After the last one only the loss is asked for."""
    now = replace(task, scale=whole_scale(sizes.rows, bound), loss_scale=whole_scale(sizes.stop_rows, bound**2))
    if last:
        _, farthest, loss = grown_below(table, now)
        return Round(None, now.scale, farthest, loss / now.loss_scale)
    trees, farthest, loss = grow_together(table, now, [k], sizes.rows, in_a_task)
    return Round(trees[k], now.scale, farthest, loss / now.loss_scale)


def _with_margins(table: DataFrame, path: str, task: Task) -> tuple[DataFrame, str]:
    """The stored rows with the pending trees in their margins."""
    sent = table.sparkSession.sparkContext.broadcast(task)

    def work(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sent.value.margins(bins, batch.column(4).to_numpy()))], ["id", "y", "x", "stop", "margin"])

    made = _stored(table.mapInArrow(work, table.schema))
    sent.unpersist()
    delete_path(table.sparkSession, path)
    return made


class TreeEnsembleModel(Model, HasFeaturesCol, HasPredictionCol, MLWritable, MLReadable):
    """A base value and trees that add to it. ``losses``: on the stop rows before each round, if there were any."""

    def __init__(self, ensemble: Ensemble | None = None, losses: Sequence[float] = ()):
        super().__init__()
        self.ensemble, self.losses = ensemble, list(losses)

    @property
    def trees(self) -> int:
        return len(self.ensemble.firsts) - 1

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sent = dataset.sparkSession.sparkContext.broadcast(self.ensemble)

        @F.arrow_udf("double")
        def predict(x: pa.Array) -> pa.Array:
            return pa.array(sent.value.predict(_matrix(x)) if len(x) else [], pa.float64())

        return dataset.withColumn(self.getPredictionCol(), predict(vector_to_array(self.getFeaturesCol())))

    def write(self) -> MLWriter:
        return _EnsembleWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EnsembleReader(cls)


class _EnsembleWriter(MLWriter):
    def __init__(self, model: TreeEnsembleModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, ensemble = SparkSession.active(), self.model.ensemble
        extra = {"base": ensemble.base, "firsts": ensemble.firsts.tolist(), "losses": self.model.losses}
        DefaultParamsWriter.saveMetadata(self.model, path, spark, extraMetadata=extra)
        nodes = pa.table({"node": np.arange(len(ensemble.values)), "input": ensemble.inputs.astype(np.int32), "limit": ensemble.limits, "left": ensemble.lefts, "value": ensemble.values})
        spark.createDataFrame(nodes).coalesce(1).write.parquet(f"{path}/nodes")


class _EnsembleReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TreeEnsembleModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        # A row for each node of the trees.
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("node").toArrow()
        column = lambda name: nodes.column(name).to_numpy()
        ensemble = Ensemble(metadata["base"], column("input"), column("limit"), column("left"), column("value"), np.array(metadata["firsts"]))
        model = TreeEnsembleModel(ensemble, metadata["losses"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
