import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from shelfcast.operators import tree_growth as growth
from shelfcast.operators import trees
from shelfcast.operators.tree_growth import Cells, Rules, Tree
from shelfcast.operators.trees import BOOSTING, FOREST, RANDOM, TreeEnsembleRegressor, whole_scale

INPUTS = ["a", "b", "c"]


def rows(n, seed=1):
    random = np.random.default_rng(seed)
    a, b, c = random.integers(0, 7, n), random.normal(size=n), random.integers(0, 400, n) / 8
    y = 10.0 * a + np.where(b > 0.3, 7, -2) * (a % 2) + c + random.normal(size=n)
    return [(i, int(a[i]), float(b[i]), float(c[i]), float(y[i])) for i in range(n)]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("trees"))
    spark.createDataFrame(rows(6000), "k long, a int, b double, c double, y double").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fit(data, inputs=INPUTS, **settings):
    estimator = TreeEnsembleRegressor(labelCol="y", predictionCol="yhat", **{"seed": 7, **settings})
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), estimator]).fit(data)


def predicted(model, data):
    return {r.k: r.yhat for r in model.transform(data).select("k", "yhat").collect()}


SETTINGS = {
    FOREST: dict(kind=FOREST, trees=5, maxDepth=6),
    RANDOM: dict(kind=RANDOM, trees=5, maxDepth=6),
    BOOSTING: dict(kind=BOOSTING, trees=4, maxDepth=3, rate=0.3, share=0.8),
    "best first": dict(kind=BOOSTING, trees=4, maxDepth=8, rate=0.3, penalty=1.0, leastRows=20, maxLeaves=9),
}


@pytest.mark.parametrize("name", SETTINGS)
def test_same_trees_whichever_way_and_however_dealt(spark, data, name):
    """Nodes searched over all tasks or grown in one, at any partitioning: predictions are equal to the last bit."""
    first = predicted(fit(data, **SETTINGS[name]), data)
    assert predicted(fit(data, rowsInATask=700, **SETTINGS[name]), data) == first
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        again = fit(data.repartition(11, "b"), rowsInATask=2500, **SETTINGS[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert predicted(again, data) == first
    assert predicted(fit(data, **{**SETTINGS[name], "seed": 8}), data) != first or name == "best first"


def by_trying(x, y, depth, penalty, least):
    """Every split of every node by its definition; the leaf's value for each row."""
    out = np.empty(len(y))

    def below(chosen, depth):
        best = None
        for k in range(x.shape[1]):
            for cut in np.unique(x[chosen, k])[:-1]:
                left = chosen[x[chosen, k] <= cut]
                right = chosen[x[chosen, k] > cut]
                if min(len(left), len(right)) >= least:
                    value = lambda part: y[part].sum() ** 2 / (len(part) + penalty)
                    gain = value(left) + value(right) - value(chosen)
                    if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = gain, left, right
        if depth == 0 or best is None:
            out[chosen] = y[chosen].sum() / (len(chosen) + penalty)
        else:
            below(best[1], depth - 1)
            below(best[2], depth - 1)

    below(np.arange(len(y)), depth)
    return out


@pytest.mark.parametrize("penalty, least", [(0.0, 1), (1.0, 5)])
def test_one_tree_equals_trying_every_split(spark, penalty, least):
    small = rows(180, seed=4)
    frame = spark.createDataFrame(small, "k long, a int, b double, c double, y double")
    model = fit(frame, kind=BOOSTING, trees=1, maxDepth=3, rate=1.0, penalty=penalty, leastRows=least)
    x, y = np.array([r[1:4] for r in small]), np.array([r[4] for r in small])
    expected = y.mean() + by_trying(x, y - y.mean(), 3, penalty, least)
    found = predicted(model, frame)
    assert [found[i] for i in range(len(y))] == pytest.approx(expected, rel=1e-7)


def test_leaves_follow_the_penalty(spark):
    """One input with two values: after k rounds the share 1 - (1 - rate n / (n + penalty))^k of each mean is reached."""
    frame = spark.createDataFrame([(i, i % 3 == 0, float(10 * (i % 3 == 0) + i % 5)) for i in range(300)], "k long, weekend boolean, y double")
    frame = frame.withColumn("weekend", F.col("weekend").cast("int"))
    found = predicted(fit(frame, ["weekend"], kind=BOOSTING, trees=7, rate=0.1, penalty=25.0, leastRows=20, maxLeaves=31), frame)
    level = {r.weekend: (r.m, r.n) for r in frame.groupBy("weekend").agg(F.avg("y").alias("m"), F.count("*").alias("n")).collect()}
    mean = frame.agg(F.avg("y")).first()[0]
    for k, yhat in found.items():
        m, n = level[int(k % 3 == 0)]
        # The mean residuals of both halves sum to less than nothing after a round, so each is what its own leaf left.
        assert yhat == pytest.approx(mean + (m - mean) * (1 - (1 - 0.1 * n / (n + 25.0)) ** 7), rel=1e-9)


def grown(n=2000, seed=3, **rules):
    random = np.random.default_rng(seed)
    x = random.normal(size=(n, 4))
    cells = Cells(tuple(growth.edges_of(x[:, k], 32) for k in range(4)))
    y = np.rint((np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2]) * 1000)
    bins = cells.bins(x)
    return bins, y, cells, growth.grow(bins, np.ones(n), y, 1, 0, cells, Rules(**rules))


def test_best_first_takes_the_largest_gains(spark):
    _, _, _, full = grown(depth=5)
    _, _, _, some = grown(depth=5, max_leaves=8)
    chosen = growth.best_first(some, 8)
    # By hand: the eight leaves of the full tree that come from opening the largest gain first.
    open_nodes, leaves = {0}, 1
    gains = []
    while leaves < 8:
        node = max((i for i in open_nodes if full.input[i] >= 0), key=lambda i: full.gain[i])
        gains.append(full.gain[node])
        open_nodes = open_nodes - {node} | {full.left[node], full.left[node] + 1}
        leaves += 1
    assert sorted(g for g in chosen.gain if g > -np.inf) == pytest.approx(sorted(gains))
    assert sum(i < 0 for i in chosen.input) == 8


def test_random_thresholds_lie_inside_the_node_and_differ(spark):
    bins, y, cells, tree = grown(depth=4, random_thresholds=True, seed=5)
    arrays = tree.arrays()
    at = np.zeros(len(bins), int)
    for _ in range(4):
        for node in np.unique(at):
            if arrays["input"][node] >= 0:
                own = bins[at == node, arrays["input"][node]]
                assert own.min() <= arrays["bin"][node] < own.max()
        inner = arrays["input"][at] >= 0
        here = at[inner]
        at[inner] = arrays["left"][here] + (bins[np.flatnonzero(inner), arrays["input"][here]] > arrays["bin"][here])
    rules = Rules(depth=4, random_thresholds=True, seed=5)
    others = [growth.grow(bins, np.ones(len(y)), y, 1, k, cells, rules).bin for k in range(1, 6)]
    assert len({tuple(x) for x in others}) == 5


def test_boosting_stops_by_patience_and_keeps_the_best_round(spark):
    """The stop rows have the training target for two rounds' worth and then none: their loss falls, then rises."""
    learn = [(i, i % 2, 10.0 * (i % 2), False) for i in range(400)]
    stop = [(1000 + i, i % 2, 5 + (i % 2 * 2 - 1) * 1.2, True) for i in range(100)]
    frame = spark.createDataFrame(learn + stop, "k long, a int, y double, stop_row boolean")
    model = fit(frame, ["a"], kind=BOOSTING, trees=100, rate=0.1, maxDepth=2, patience=4, stopCol="stop_row").stages[-1]
    # After k rounds the distance of the stop rows is |5 (1 - 0.9^k) - 1.2|.
    expected = [(5 * (1 - 0.9**k) - 1.2) ** 2 for k in range(100)]
    best = int(np.argmin(expected))
    assert model.trees == best and len(model.losses) == best + 5
    assert model.losses == pytest.approx(expected[: best + 5], rel=1e-6)


def test_boosting_without_patience_runs_all_rounds(spark, data):
    frame = data.limit(500).withColumn("stop_row", F.col("k") % 5 == 0)
    model = fit(frame, kind=BOOSTING, trees=30, rate=0.1, maxDepth=2, stopCol="stop_row").stages[-1]
    assert model.trees == 30 and len(model.losses) == 31 and model.losses[-1] < model.losses[0]


def test_models_are_stored_with_their_pipeline(data, tmp_path):
    model = fit(data, **SETTINGS[BOOSTING])
    model.write().overwrite().save(f"{tmp_path}/model")
    assert predicted(PipelineModel.load(f"{tmp_path}/model"), data) == predicted(model, data)


def test_constant_targets_and_missing_rows(spark):
    frame = spark.createDataFrame([(1, 1.0, 4.0), (2, 2.0, 4.0), (3, 2.0, 4.0)], "k long, a double, y double")
    for name in SETTINGS:
        settings = {**SETTINGS[name], "leastRows": 1}
        assert predicted(fit(frame, ["a"], **settings), frame) == {1: 4.0, 2: 4.0, 3: 4.0}
        assert predicted(fit(frame.limit(0), ["a"], **settings), frame) == {1: 0.0, 2: 0.0, 3: 0.0}
    one = spark.createDataFrame([(k, 5.0, float(k)) for k in range(4)], "k long, a double, y double")
    assert set(predicted(fit(one, ["a"], kind=BOOSTING, trees=2), one).values()) == {1.5}


def test_edges_cut_between_values():
    assert growth.edges_of([3, 1, 1, 2], 256).tolist() == [1.5, 2.5]
    assert growth.edges_of([], 8).tolist() == [] == growth.edges_of([4, 4], 8).tolist()
    many = growth.edges_of(np.arange(10_000), 256)
    assert len(many) == 255 and np.diff(many).max() < 45
    # A value that holds most rows still leaves the others bins.
    heavy = growth.edges_of([0] * 1000 + list(range(1000)), 16)
    assert 7 <= len(heavy) <= 15 and heavy[0] == 0.5
    close = growth.edges_of([1.0, np.nextafter(1.0, 2)], 8)
    assert close.tolist() == [1.0]


def test_sums_stay_exact():
    for n, far in ((10, 1e-9), (10**9, 5000.0), (1, 1e300)):
        scale = whole_scale(n, far)
        assert n * far * scale <= 2.0**52 and np.log2(scale) == int(np.log2(scale))


def test_grafted_trees_keep_their_nodes():
    whole, part = Tree(1, 10.0, 0.0), Tree(2, 4.0, 1.0)
    whole.split(0, 0, 3, 5.0, (4.0, 1.0))
    part.split(0, 1, 2, 2.0, (1.0, 0.5))
    whole.graft(1, part)
    assert whole.path == [1, 2, 3, 4, 5] and whole.input == [0, 1, -1, -1, -1] and whole.n == [10.0, 4.0, 6.0, 1.0, 3.0]


def test_all_rounds_of_a_small_table_are_one_job(data, monkeypatch):
    """Nothing is stored and read again between rounds, unless boosting may stop early; trees are the same as round by round."""
    asked, once = [], trees.rounds_in_one

    def counted(rows, task, sizes, first, count, *rest, **named):
        asked.append(count)
        return once(rows, task, sizes, first, count, *rest, **named)

    monkeypatch.setattr(trees, "ROUNDS_STORED", 3)
    monkeypatch.setattr(trees, "rounds_in_one", counted)
    settings = dict(kind=BOOSTING, trees=8, maxDepth=3, rate=0.3, share=0.8)
    found = predicted(fit(data, **settings), data)
    assert asked == [8]
    assert predicted(fit(data, rowsInATask=700, **settings), data) == found and asked == [8]


@pytest.mark.parametrize("share", [1.0, 0.9, 0.3])
def test_a_tree_from_most_rows_is_that_of_these_rows_alone(share):
    bins, y, cells, _ = grown(depth=2)
    chosen = np.random.default_rng(6).random(len(y)) < share
    g = np.where(chosen, y, 0.0)
    sums = growth.most_rows_sums(bins, np.flatnonzero(~chosen), g, cells, growth.cell_counts(bins, cells))
    columns = np.ascontiguousarray(bins.T)
    for rules in (Rules(4), Rules(8, 5, 1.0, 9)):
        found = growth.grow_on(bins, columns, np.flatnonzero(chosen), None, g, 1, 0, cells, rules, sums)
        alone = growth.grow(bins[chosen], np.ones(chosen.sum()), y[chosen], 1, 0, cells, rules)
        assert all(np.array_equal(found.arrays()[c], x) for c, x in alone.arrays().items())
        best = growth.best_first(found, rules.max_leaves)
        assert np.array_equal(growth.leaves_by_column(best, columns), growth.leaves_of(best.arrays(), bins))
