"""Boosted trees against a plain version with loops, and the same trees by every way of growing them."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from mailwatch.operators import boosting
from mailwatch.operators.boosting import TreeParams


def plain_tree(bins, g, h, p, depth=None):
    """(feature, cut, low, high) or a leaf weight, by trying every cut of every column."""
    depth = p.max_depth if depth is None else depth

    def shrunk(x):
        return math.copysign(max(abs(x) - p.alpha, 0.0), x)

    def score(rows):
        return shrunk(sum(g[i] for i in rows)) ** 2 / (sum(h[i] for i in rows) + p.lambda_)

    def grow(rows, depth):
        value = -p.learning_rate * shrunk(sum(g[i] for i in rows)) / (sum(h[i] for i in rows) + p.lambda_)
        best = (1e-6, None)
        for f in range(len(bins[0])) if depth else ():
            for cut in sorted({bins[i][f] for i in rows})[:-1]:
                low, high = [i for i in rows if bins[i][f] <= cut], [i for i in rows if bins[i][f] > cut]
                if min(sum(h[i] for i in side) for side in (low, high)) < p.min_child_weight:
                    continue
                gain = score(low) + score(high) - score(rows)
                if gain > best[0] + 1e-9 and gain >= p.gamma:
                    best = (gain, (f, cut, low, high))
        if best[1] is None:
            return value
        f, cut, low, high = best[1]
        return f, cut, grow(low, depth - 1), grow(high, depth - 1)

    return grow(list(range(len(bins))), depth)


def as_plain(tree, node=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    return tree.feature[node], tree.cut[node], as_plain(tree, tree.left[node]), as_plain(tree, tree.left[node] + 1)


def check(a, b):
    assert isinstance(a, tuple) == isinstance(b, tuple)
    if not isinstance(a, tuple):
        assert a == pytest.approx(b, abs=1e-6)
        return
    # Cuts between the same rows are the same split.
    assert a[0] == b[0]
    check(a[2], b[2])
    check(a[3], b[3])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(120, 4)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.5 * rng.normal(size=120) > 0.3).astype(float)
    return x, y, np.where(y == 1, 1.5, 1.0)


PARAMS = [
    TreeParams(max_depth=4), TreeParams(max_depth=3, alpha=1.5, lambda_=0.1, learning_rate=0.1),
    TreeParams(max_depth=6, min_child_weight=4, gamma=0.7, lambda_=1e-8), TreeParams(max_depth=2, alpha=30.0),
]


@pytest.mark.parametrize("p", PARAMS)
def test_one_tree(data, p):
    x, y, w = data
    cuts = [np.unique(x[:, f]) for f in range(4)]
    bins = boosting.binned(x, cuts)
    g, h = boosting._slopes({"label": y, "weight": w}, np.zeros(len(y)))
    layout = boosting.Layout(np.array([len(c) + 1 for c in cuts]), np.arange(4))
    tree = boosting.subtree(bins, g, h, p.max_depth, layout, p)
    check(as_plain(tree), plain_tree(bins.tolist(), w * (0.5 - y), w * 0.25, p))
    assert all(f < 0 or gain >= p.gamma for f, gain in zip(tree.feature, tree.gain))


def frame(spark, data, parts=3):
    x, y, w = data
    rows = [(f"m{i}", int(y[i]), float(w[i]), x[i].tolist()) for i in range(len(y))]
    df = spark.createDataFrame(rows, "email_id string, label int, weight double, x array<double>")
    return df.withColumn("features", array_to_vector("x")).repartition(parts)


def grown(spark, data, trials, parts=3, size=50, **how):
    df = frame(spark, data, parts)
    cuts = boosting.cut_points(df)
    return boosting.boost(boosting.blocks_of(df, None, cuts, size=size), cuts, trials, **how)


def test_rounds_follow_the_gradient(spark, data):
    """The second tree is the plain tree of the slopes that the first one leaves."""
    x, y, w = data
    p = TreeParams(max_depth=3, n_estimators=3, alpha=0.2)
    model = grown(spark, data, [p], rounds=1)[0]
    bins = boosting.binned(x, model.cuts)
    margin = np.zeros(len(y))
    for tree in model.trees:
        q = 1 / (1 + np.exp(-margin))
        check(as_plain(tree), plain_tree(bins.tolist(), w * (q - y), w * q * (1 - q), p))
        margin += tree.values(bins)
    assert len(model.trees) == 3 and np.allclose(model.margins(x), margin)
    scores = {r["email_id"]: r for r in boosting.scored(frame(spark, data), [model], ("email_id",)).collect()}
    assert all(scores[f"m{i}"]["score"] == pytest.approx(1 / (1 + math.exp(-margin[i]))) for i in range(len(y)))


def test_every_way_grows_the_same_trees(spark, data):
    trials = [replace(p, n_estimators=n, subsample=s, colsample=c) for p, n, s, c in zip(PARAMS, (3, 5, 2, 4), (1.0, 0.7, 0.6, 1.0), (0.6, 1.0, 0.75, 1.0))]
    want = grown(spark, data, trials)
    for how in ({"small": 0}, {"small": 30, "parts": 1}, {"small": 0, "sums": 1, "kept": 1, "size": 7}, {"parts": 7, "rounds": 2}):
        got = grown(spark, data, trials, **how)
        assert [[as_plain(t) for t in m.trees] for m in got] == [[as_plain(t) for t in m.trees] for m in want], how
    assert [len(m.trees) for m in want] == [3, 5, 2, 4]


def test_rows_and_columns_are_drawn_for_each_tree(spark, data):
    model = grown(spark, data, [TreeParams(max_depth=5, n_estimators=12, colsample=0.5)])[0]
    used = [{f for f in t.feature if f >= 0} for t in model.trees]
    assert all(len(u) <= 2 for u in used) and len(set.union(*used)) == 4
    key = np.arange(20_000, dtype=np.int64) * 7919
    masks = [boosting.drawn_rows(key, 0.7, 42, t) for t in range(3)]
    assert all(abs(m.mean() - 0.7) < 0.02 for m in masks) and (masks[0] != masks[1]).mean() > 0.3


@pytest.mark.parametrize("how", [{}, {"small": 40}, {"rounds": 2}])
def test_early_end(spark, data, how):
    train = frame(spark, data)
    flipped = train.withColumn("label", 1 - train["label"])  # whatever is learnt makes this worse
    cuts = boosting.cut_points(train)
    trials = [TreeParams(n_estimators=9), TreeParams(n_estimators=2)]
    bad, few = boosting.boost(boosting.blocks_of(train, flipped, cuts), cuts, trials, patience=3, **how)
    assert len(bad.trees) == 1 and len(bad.losses) == 5 and bad.losses[1] == min(bad.losses[1:])
    good, _ = boosting.boost(boosting.blocks_of(train, train, cuts), cuts, trials, patience=3, **how)
    assert len(good.trees) > 5 and len(few.trees) == 2
    x, y, _ = data
    assert good.losses[2] == pytest.approx(np.logaddexp(0, np.where(y == 1, -1, 1) * (good.trees[0].values(boosting.binned(x, cuts)) + good.trees[1].values(boosting.binned(x, cuts)))).mean(), abs=1e-6)


def test_importances(spark, data):
    share = grown(spark, data, [TreeParams(n_estimators=8, max_depth=3)])[0].importances()
    assert share.sum() == pytest.approx(1) and share.argmax() in (0, 1, 2)


def test_no_rows(spark, data):
    empty = frame(spark, data).limit(0)
    cuts = boosting.cut_points(empty)
    model = boosting.boost(boosting.blocks_of(empty, None, cuts), cuts, [TreeParams(n_estimators=3)])[0]
    assert model.trees == [] and model.margins(np.zeros((2, 0))).tolist() == [0.0, 0.0]


def test_rows_of_a_few_megabytes_take_no_job_for_each_level(spark, monkeypatch):
    """100,000 rows go on for many trees in one task of their trial."""
    levels = []
    monkeypatch.setattr(boosting, "_grow_level", lambda *a: levels.append(a) or a[3][0].large.clear())
    df = spark.range(100_000).selectExpr("string(id) AS email_id", "int(id % 7 > 2) AS label", "1.0D AS weight", "array(double(id % 7), double(id % 3)) AS x")
    df = df.withColumn("features", array_to_vector("x"))
    cuts = boosting.cut_points(df)
    model = boosting.boost(boosting.blocks_of(df, None, cuts), cuts, [TreeParams(max_depth=2, n_estimators=3)])[0]
    assert not levels and len(model.trees) == 3 and model.trees[0].feature[0] == 0


def test_two_million_rows_take_no_job_for_each_level(spark, monkeypatch):
    """300,000 rows and more go on for all trees in one task of their trial."""
    levels = []
    monkeypatch.setattr(boosting, "_grow_level", lambda *a: levels.append(a) or a[3][0].large.clear())
    df = spark.range(300_000).selectExpr("string(id) AS email_id", "int(id % 7 > 2) AS label", "1.0D AS weight", "array(double(id % 7), double(id % 3)) AS x")
    df = df.withColumn("features", array_to_vector("x"))
    cuts = boosting.cut_points(df)
    model = boosting.boost(boosting.blocks_of(df, None, cuts), cuts, [TreeParams(max_depth=2, n_estimators=2)])[0]
    assert not levels and len(model.trees) == 2 and model.trees[0].feature[0] == 0


def test_fewer_sums_grow_the_same_tree():
    """Parents kept or not, drawn rows or all: the splits of sums over every row of a node."""
    rng = np.random.default_rng(4)
    bins = np.asfortranarray(np.stack([rng.integers(0, n, 3000) for n in (2, 200, 3, 5, 2, 90, 7)], axis=1).astype(np.uint8))
    y = (bins[:, 1] > 90).astype(float) + bins[:, 0] * (bins[:, 3] > 2) + rng.normal(size=3000) > 1
    g, h = boosting._slopes({"label": y.astype(float), "weight": np.ones(3000)}, rng.normal(size=3000))
    layout = boosting.Layout(np.array([2, 200, 3, 5, 2, 90, 7]), np.array([0, 1, 2, 3, 5, 6]))
    bundles = boosting.Bundles(layout)
    assert len(bundles.sizes) < 6 and max(bundles.sizes) <= 256
    node = rng.integers(0, 3, 3000)
    found = bundles.sums(bundles.codes(bins), node, 3, [g.astype("f8"), None])
    for f, column in enumerate(layout.columns):
        for i, w in enumerate((g, np.ones(3000))):
            want = np.zeros((3, layout.sizes[f]))
            np.add.at(want, (node, bins[:, column]), w)
            assert (found[i][:, layout.first[f] : layout.first[f + 1]] == want).all()
    for p in (TreeParams(max_depth=7), TreeParams(max_depth=5, min_child_weight=0.0, gamma=0.3)):
        tree, leaves = boosting.grow(bins, None, g, h, p.max_depth, layout, p)
        again, others = boosting.grow(bins, None, g, h, p.max_depth, layout, p, cells=0)
        assert tree.packed() == again.packed() and len(tree.feature) > 20
        assert (leaves == tree.reached(bins)).all() and (leaves == others).all()
        learn = np.flatnonzero(rng.random(3000) < 0.6)
        some, leaves = boosting.grow(bins, learn, g[learn], h[learn], p.max_depth, layout, p)
        assert some.packed() == boosting.subtree(bins[learn], g[learn], h[learn], p.max_depth, layout, p).packed()
        assert (leaves == some.reached(bins, learn)).all()
