"""Trees grown by aggregates against plain numpy growers, and their edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.config import TrainConfig
from sensorloom.jobs import models, trees


def rows(spark, x, y, parts=3):
    df = spark.createDataFrame([(str(i), float(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))], "id string, y double, vec array<double>")
    return df.repartition(parts)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(7)
    y = rng.choice(3, 500, p=[0.6, 0.3, 0.1])
    x = rng.normal(size=(500, 9))
    x[:, 0] += y
    x[:, 3] = np.round(x[:, 3])
    x[:, 5] = 1.0
    return x, y


@pytest.fixture()
def small_parts(monkeypatch):
    monkeypatch.setattr(trees, "PART_ROWS", 150)
    monkeypatch.setattr(trees, "TREE_CHUNK", 4)


def entropy(w):
    w = w[w > 0]
    return float(-(w * np.log2(w / w.sum())).sum())


def grow(x, y, weight, factor, path, depth, classes, cut, least=2):
    """One tree by recursion: (feature, threshold, left, right), or class shares. cut: candidate (feature, threshold) pairs of a node in order."""
    whole = np.array([weight[y == c].sum() for c in range(classes)])
    shares = whole * factor / (whole * factor).sum()
    if depth == 0 or whole.sum() < 2 * least or (whole > 0).sum() < 2:
        return shares
    best = None
    for f, t in cut(x, weight, path):
        left = x[:, f] <= t
        part = np.array([weight[left & (y == c)].sum() for c in range(classes)])
        if part.sum() < least or (whole - part).sum() < least:
            continue
        gain = entropy(whole * factor) - entropy(part * factor) - entropy((whole - part) * factor)
        if best is None or gain > best[0] + 1e-12 * abs(gain):
            best = (gain, f, t, left)
    if best is None:
        return shares
    _, f, t, left = best
    paths = trees.child_paths(np.array([path]))
    sides = [grow(x[s], y[s], weight[s], factor, p, depth - 1, classes, cut, least) for s, p in zip((left, ~left), paths, strict=True)]
    return f, t, *sides


def same(model, node, want):
    if isinstance(want, np.ndarray):
        assert model.feature[node] == -1 and np.allclose(model.value[node], want)
        return
    assert model.feature[node] == want[0] and model.threshold[node] == want[1]
    same(model, model.left[node], want[2])
    same(model, model.left[node] + 1, want[3])


def test_extra_trees_equal_a_numpy_grower(spark, sample, small_parts):
    x, y = sample
    model, importance = trees.extra_trees(rows(spark, x, y), 10, 3, depth=6, seed=5)
    counts = np.bincount(y)

    def cut(x, weight, path):
        for f in trees.drawn_features(np.array([path]), 9, 3)[0]:
            low, high = x[:, f].min(), x[:, f].max()
            t = low + float(trees.uniform(np.array([path]) ^ trees.mixed(np.array([int(f) + (1 << 32)], dtype=np.uint64)))[0]) * (high - low)
            yield f, low if t >= high else t

    for t, path in enumerate(trees.root_paths(10, 5)):
        same(model, model.roots[t], grow(x, y, np.ones(500), 500 / (3 * counts), path, 6, 3, cut))
    assert importance.argmax() == 0 and importance[5] == 0 and abs(importance.sum() - 1) < 1e-9
    p = trees.forest_probabilities(rows(spark, x, y), model).toPandas()
    assert np.allclose(np.array(p["prob"].tolist()).sum(axis=1), 1)


def test_partitions_do_not_matter(spark, sample, monkeypatch):
    x, y = sample
    one = trees.extra_trees(rows(spark, x, y, 1), 5, 3, depth=4)[0]
    monkeypatch.setattr(trees, "PART_ROWS", 60)
    other = trees.extra_trees(rows(spark, x[::-1], y[::-1], 5).withColumn("id", (499 - F.col("id").cast("int")).cast("string")), 5, 3, depth=4)[0]
    assert (one.feature == other.feature).all() and np.allclose(one.threshold, other.threshold) and np.allclose(one.value, other.value)


def test_balanced_forest_equals_a_numpy_grower(spark, sample, small_parts):
    x, y = sample
    df = rows(spark, x, y)
    held = trees.prepared(df)
    salts, rates, factor = trees.balanced_draws(held, 8, 3, 42)
    keys = {r["id"]: r["k"] for r in df.select("id", F.xxhash64("id").alias("k")).collect()}
    key = np.array([keys[str(i)] for i in range(500)], dtype=np.int64).view(np.uint64)
    drawn = trees.draw_counts(key, salts, rates[y])
    least = np.bincount(y).min()
    sums = np.stack([drawn[y == c].sum(axis=0) for c in range(3)], axis=1)
    assert np.allclose(sums * factor, least) and (abs(sums - least) < 6 * np.sqrt(least)).all()
    assert len({tuple(d) for d in drawn.T}) == 8
    model = trees.balanced_forest(df, 8, 3, depth=5)
    edges = trees.bin_edges(held)

    def cut(x, weight, path):
        for f in trees.drawn_features(np.array([path]), 9, 3)[0]:
            yield from ((f, t) for t in np.unique(edges[f]))

    for t, path in enumerate(trees.root_paths(8, 42)):
        same_shares(model, model.roots[t], grow(x, y, drawn[:, t], factor[t], path, 5, 3, cut), x[drawn[:, t] > 0])


def same_shares(model, node, want, x):
    """As same(); of edges without rows between them, either may cut."""
    if isinstance(want, np.ndarray):
        assert model.feature[node] == -1 and np.allclose(model.value[node], want)
        return
    f, left = model.feature[node], x[:, want[0]] <= want[1]
    assert f == want[0] and ((x[:, f] <= model.threshold[node]) == left).all()
    same_shares(model, model.left[node], want[2], x[left])
    same_shares(model, model.left[node] + 1, want[3], x[~left])


def test_poisson_draws():
    keys, salts = trees.mixed(np.arange(4000, dtype=np.uint64)), trees.root_paths(50, 1)
    drawn = trees.draw_counts(keys, salts, np.full(4000, 0.7))
    assert abs(drawn.mean() - 0.7) < 0.01 and abs(drawn.var() - 0.7) < 0.01 and abs((drawn == 0).mean() - np.exp(-0.7)) < 0.01


def numpy_boosting(x, y, edges, rounds, step, classes):
    width = 1 if classes == 2 else classes
    share = np.bincount(y, minlength=classes) / len(y)
    score = np.tile([np.log(share[1] / share[0])] if width == 1 else np.log(share), (len(y), 1))
    ratio, losses = (1.0 if width == 1 else (classes - 1) / classes), []
    for _ in range(rounds):
        p = trees.Boosting.shares(score)[:, -width:]
        for c in range(width):
            g = (y == (1 if width == 1 else c)) - p[:, c]
            h = p[:, c] * (1 - p[:, c])
            parts = [np.arange(len(y))]
            for _ in range(3):
                after = []
                for at in parts:
                    best = (0.0, None)
                    for f in range(x.shape[1]):
                        for t in np.unique(edges[f]):
                            left = x[at, f] <= t
                            n, r = left.sum(), (~left).sum()
                            if n and r:
                                gain = n * r / (n + r) * (g[at][left].mean() - g[at][~left].mean()) ** 2
                                if gain > best[0] + 1e-12 * gain:
                                    best = (gain, left)
                    after += [at] if best[1] is None else [at[best[1]], at[~best[1]]]
                parts = after
            for at in parts:
                score[at, c] += step * ratio * g[at].sum() / h[at].sum()
        losses.append(-np.log(trees.Boosting.shares(score)[np.arange(len(y)), y]).mean())
    return losses


@pytest.mark.parametrize("classes", [2, 3])
def test_boosting_equals_numpy_for_ten_rounds(spark, sample, small_parts, monkeypatch, classes):
    monkeypatch.setattr(trees, "STAGE_ROUNDS", 4)
    x, y = sample[0][:300, :4], np.minimum(sample[1][:300], classes - 1)
    df = rows(spark, x, y)
    model = trees.boosting(df, 10, 0.3, classes)
    want = numpy_boosting(x, y, trees.bin_edges(trees.prepared(df)), 10, 0.3, classes)
    for r in (1, 5, 10):
        part = trees.Boosting(model.base, model.step, trees.Trees(model.trees.roots[: r * len(model.base)], *[getattr(model.trees, n) for n in ("feature", "threshold", "left", "value")]))
        got = -np.log(trees.Boosting.shares(part.scores(x))[np.arange(len(y)), y]).mean()
        assert abs(got - want[r - 1]) < 1e-9
    p = trees.boosting_probabilities(df, model).toPandas()
    assert np.allclose(np.array(p["prob"].tolist())[p["id"].astype(int).argsort()], trees.Boosting.shares(model.scores(x)))


def test_tree_edges(spark):
    """Constant features, a class of one row, two rows: leaves at once."""
    x, y = np.ones((6, 2)), np.array([0, 0, 0, 0, 0, 1])
    model, importance = trees.extra_trees(rows(spark, x, y), 3, 2, depth=4)
    assert len(model.feature) == 3 and np.allclose(model.value, 0.5) and importance.sum() == 0
    assert trees.balanced_forest(rows(spark, x, y), 3, 2, depth=4).feature.max() == -1
    assert np.allclose(trees.boosting(rows(spark, x, y), 2, 0.1, 2).scores(x), np.log(1 / 5))


# Calibration ---------------------------------------------------------------------------------------


def test_smoothed_sigmoid(spark):
    """Newton steps in numpy with step halving reach the same coefficients; separable and one-sided classes too."""
    rng = np.random.default_rng(1)
    p = rng.dirichlet([1, 1, 1], 400)
    y = np.array([rng.choice(3, p=v) for v in 0.8 * p + 0.2 / 3])
    y[p[:, 2] > 0.5], y[(p[:, 2] <= 0.5) & (y == 2)] = 2, 0
    df = spark.createDataFrame([(float(c), v.tolist()) for c, v in zip(y, p, strict=True)], "y double, prob array<double>")
    for c, got in enumerate(models.fit_sigmoids(df, [0, 1, 2])):
        n = (y == c).sum()
        t = np.where(y == c, (n + 1) / (n + 2), 1 / (len(y) - n + 2))
        x = np.c_[p[:, c], np.ones(len(y))]
        loss = lambda w: (np.logaddexp(0, x @ w) - (1 - t) * (x @ w)).sum()  # noqa: E731, B023
        w = np.array([0.0, np.log((len(y) - n + 1) / (n + 1))])
        for _ in range(200):
            q = 1 / (1 + np.exp(x @ w))
            move = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x, x.T @ (t - q))
            k = 1.0
            while loss(w - k * move) > loss(w) and k > 1e-9:
                k /= 2
            w = w - k * move
        assert np.allclose([got.a, got.b], w, rtol=1e-8, atol=1e-8)


def test_notes_say_what_was_done():
    assert models.smote_note([2, 50]) == "skipped_minority_too_small" and models.smote_note([3, 50]) == "smote_k2" and models.smote_note([90, 50]) == "smote_k5"
    row = {"recall": 0.6, "precision": 0.5, "balanced_accuracy": 0.7, "macro_f1": 0.65}
    assert models.goal_note("macro_f1", row, 0.7).startswith("macro_f1:0.650000;precision:0.500000;recall:0.600000")
    assert models.goal_note("balanced_accuracy_recall_floor", row, 0.7).startswith("balanced_accuracy_recall_floor_fallback_recall:0.600000;")
    assert TrainConfig().balanced_trees == 600


def test_boosting_of_few_rows_takes_one_task(spark, sample, monkeypatch):
    """Rows of one partition grow the trees that dealt rows grow, without dealing their sums."""
    x, y = sample
    with monkeypatch.context() as m:
        m.setattr(trees, "PART_ROWS", 150)
        want = trees.boosting(rows(spark, x, y), 3, 0.3, 3)
    monkeypatch.setattr(trees, "_splits", None)
    got = trees.boosting(rows(spark, x, y), 3, 0.3, 3)
    assert (got.trees.feature == want.trees.feature).all() and np.allclose(got.trees.value, want.trees.value)
