"""Walk-forward fits: ridge regression from running sums, and boosted trees, one task for each key and fold."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from barloom.functions.guards import some_rows
from barloom.operators.folds import NO_FOLDS


@dataclass(frozen=True)
class Ridge:
    """Least squares on standardised features with an L2 penalty."""

    penalty: float = 1.0


@dataclass(frozen=True)
class Trees:
    """Gradient-boosted regression trees on binned features, with penalties on the size of leaves.

    Each tree sees a share of the rows and of the columns. A feature that is
    missing counts as larger than any value.
    """

    trees: int = 250
    depth: int = 3
    rate: float = 0.03
    rows: float = 0.85
    columns: float = 0.85
    l2: float = 5.0
    l1: float = 0.1
    bins: int = 256
    seed: int = 42


ridge, gbt = Ridge, Trees


def solve_ridge(gram: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (constant first) and standardised ones from the Gram matrix of [1, x, y]."""
    n, k = gram[0, 0], len(gram) - 2
    mean = gram[0, 1:] / n
    centred = gram[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(centred)[:k] / n, 0))
    scale[scale < 1e-12] = 1.0
    a = centred[:k, :k] / np.outer(scale, scale) + penalty * np.eye(k)
    standard = np.linalg.solve(a, centred[:k, k] / scale)
    slopes = standard / scale
    return np.concatenate([[mean[k] - slopes @ mean[:k]], slopes]), standard


def gram_sums(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(group..., i, j, value): sums of the products of [1, columns...] over each group, i <= j.

    Each batch adds up its own rows first, so only its sums are shuffled.
    """
    kept = [df.schema[g] for g in group]
    schema = T.StructType([*kept, T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("value", T.DoubleType())])
    rows, cols = np.triu_indices(len(columns) + 1)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for values, part in frame.groupby(list(group), dropna=False):
                x = np.column_stack([np.ones(len(part)), part[list(columns)].to_numpy(float)])
                out = pd.DataFrame({"i": rows, "j": cols, "value": (x.T @ x)[rows, cols]})
                for name, value in zip(group, values, strict=True):
                    out[name] = value
                yield out[schema.names]

    return df.select(*group, *columns).mapInPandas(partial, schema).groupBy(*group, "i", "j").agg(F.sum("value").alias("value"))


def gram_matrix(frame: pd.DataFrame, size: int) -> np.ndarray:
    gram = np.zeros((size, size))
    gram[frame["i"], frame["j"]] = frame["value"]
    return gram + np.triu(gram, 1).T


def ridge_coefficients(df: DataFrame, key: Sequence[str], features: Sequence[str], target: str, penalty: float, test_rows: int = 63) -> DataFrame:
    """(key..., fold, coefficients, standard) for each fold of df (from assign_folds).

    A row enters at the first fold that trains on it; the running sum of these
    steps is every fold's expanding training set, so no row is repeated.
    """
    folds = df.filter("fold IS NOT NULL").groupBy(*key).agg(F.min("fold").alias("_first"), F.max("fold").alias("_last"), F.min("train_end").alias("_end"))
    rows = df.select(*key, "position", *features, target).join(folds, list(key))
    step = F.greatest(F.floor((F.col("position") - F.col("_end")) / test_rows).cast("int") + 1, F.lit(0))
    rows = rows.withColumn("fold", F.col("_first") + step).filter(F.col("fold") <= F.col("_last"))
    sums = gram_sums(rows, [*key, "fold"], [*features, target])
    grid = df.filter("fold IS NOT NULL").select(*key, "fold").distinct().join(sums.select(*key, "i", "j").distinct(), list(key))
    sums = grid.join(sums, [*key, "fold", "i", "j"], "left")
    running = W.partitionBy(*key, "i", "j").orderBy("fold").rowsBetween(W.unboundedPreceding, 0)
    sums = sums.withColumn("value", F.sum(F.coalesce("value", F.lit(0.0))).over(running))
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([*(df.schema[k] for k in key), T.StructField("fold", T.IntegerType()), T.StructField("coefficients", doubles), T.StructField("standard", doubles)])

    def solve(values: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found, standard = solve_ridge(gram_matrix(frame, len(features) + 2), penalty)
        return pd.DataFrame([[*values, found.tolist(), standard.tolist()]], columns=schema.names)

    return sums.groupBy(*key, "fold").applyInPandas(solve, schema)


def _binned(x: np.ndarray, train: np.ndarray, bins: int) -> np.ndarray:
    """Each column's bin, between quantiles of the training rows; code <= j means value <= edge j."""
    codes = np.empty(x.shape, int)
    for j in range(x.shape[1]):
        known = x[train, j][~np.isnan(x[train, j])]
        edges = np.unique(np.quantile(known, np.linspace(0, 1, bins)[1:-1], method="lower")) if len(known) else known
        codes[:, j] = np.searchsorted(edges, x[:, j])
    return codes


def boost(x: np.ndarray, y: np.ndarray, train: np.ndarray, p: Trees) -> tuple[np.ndarray, np.ndarray]:
    """Predictions for all rows of x by trees fit on the rows of train, and each column's share of the mean split gains."""
    rng = np.random.default_rng(p.seed)
    codes, (n, k) = _binned(x, train, p.bins), x.shape
    gains, splits = np.zeros(k), np.zeros(k)
    found = np.full(n, y[train].mean())

    def shrunk(g: np.ndarray) -> np.ndarray:
        return np.sign(g) * np.maximum(np.abs(g) - p.l1, 0)

    for _ in range(p.trees):
        own = train & (rng.random(n) < p.rows)
        cols = np.sort(rng.choice(k, max(1, int(k * p.columns)), replace=False))
        rest, shown = np.where(own, y - found, 0.0)[own], codes[np.ix_(own, cols)]
        weights = np.repeat(rest, len(cols))
        node = np.zeros(n, int)
        for level in range(p.depth):
            shape = (2**level, len(cols), p.bins)
            at = ((node[own][:, None] * shape[1] + np.arange(shape[1])) * p.bins + shown).ravel()
            left, below = (np.bincount(at, w, np.prod(shape)).reshape(shape).cumsum(2) for w in (weights, None))
            total, rows = left[:, :, -1:], below[:, :, -1:]
            gain = shrunk(left) ** 2 / (below + p.l2) + shrunk(total - left) ** 2 / (rows - below + p.l2) - shrunk(total) ** 2 / (rows + p.l2)
            gain[(below < 1) | (rows - below < 1)] = -np.inf
            best = gain.reshape(shape[0], -1).argmax(1)
            size = gain.reshape(shape[0], -1)[np.arange(shape[0]), best]
            col, cut = cols[best // p.bins], np.where(size > 1e-9, best % p.bins, p.bins)  # no gain: all rows go left
            np.add.at(gains, col[size > 1e-9], size[size > 1e-9])
            np.add.at(splits, col[size > 1e-9], 1)
            node = 2 * node + (codes[np.arange(n), col[node]] > cut[node])
        sums, rows = (np.bincount(node[own], w, 2**p.depth) for w in (rest, None))
        found = found + p.rate * (shrunk(sums) / np.maximum(rows + p.l2, 1e-9))[node]
    mean = gains / np.maximum(splits, 1)
    return found, mean / (mean.sum() or 1.0)


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """left with right's other columns where all names agree, nulls with nulls."""
    renamed = right.withColumnsRenamed({c: f"_{c}_right" for c in names})
    return left.join(renamed, [left[c].eqNullSafe(renamed[f"_{c}_right"]) for c in names]).drop(*(f"_{c}_right" for c in names))


def tree_predictions(df: DataFrame, key: Sequence[str], features: Sequence[str], target: str, learner: Trees) -> DataFrame:
    """(key..., position, prediction) of the tested rows of df (from assign_folds).

    Each row is sent to every fold that trains on it and to the fold that tests
    it: rows times about half the folds are shuffled, each group being one series.
    """
    folds = df.filter("fold IS NOT NULL").groupBy(*key).agg(F.collect_set(F.struct("fold", "train_end")).alias("_folds"))
    rows = _same(df.select(*key, "position", F.col("fold").alias("_own"), *features, target), folds, key)
    rows = rows.withColumn("_fold", F.explode("_folds")).filter("position < _fold.train_end OR _own = _fold.fold")
    rows = rows.withColumns({"_test": F.coalesce(F.col("_own") == F.col("_fold.fold"), F.lit(False)), "_fold": F.col("_fold.fold")}).drop("_folds", "_own")
    schema = T.StructType([*(df.schema[k] for k in key), df.schema["position"], T.StructField("prediction", T.DoubleType())])

    def fit(values: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position")
        test = frame["_test"].to_numpy(bool)
        found, _ = boost(frame[list(features)].to_numpy(float), frame[target].to_numpy(float), ~test, learner)
        out = pd.DataFrame({"position": frame["position"].to_numpy()[test], "prediction": found[test]})
        for name, value in zip(key, values, strict=False):  # the fold comes last
            out[name] = value
        return out[schema.names]

    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism  # a number of its own, so that small groups aren't coalesced into few tasks
    return rows.repartition(tasks, *key, "_fold").groupBy(*key, "_fold").applyInPandas(fit, schema)


def _dot(features: Sequence[str]) -> F.Column:
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features])
    return F.aggregate(F.zip_with("coefficients", x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def walk_forward(df: DataFrame, features: Sequence[str], target: str, learner: Ridge | Trees, key: Sequence[str] = ("dataset",), test_rows: int = 63) -> DataFrame:
    """The tested rows of df (from assign_folds) with their prediction; reading them fails if there is no fold."""
    tests = df.filter("fold IS NOT NULL")
    if isinstance(learner, Ridge):
        found = ridge_coefficients(df, key, features, target, learner.penalty, test_rows).drop("standard")
        out = tests.join(found, [*key, "fold"]).withColumn("prediction", _dot(features)).drop("coefficients")
    else:
        out = _same(tests, tree_predictions(df, key, features, target, learner), [*key, "position"])
    # above the joins: below one whose other side is empty the check would not run
    return some_rows(out, tests.select("fold"), NO_FOLDS)


def final_fit(features: DataFrame, rows: DataFrame, columns: Sequence[str], learner: Ridge | Trees, target: str = "target", key: Sequence[str] = ("dataset",)) -> tuple[DataFrame, DataFrame]:
    """A fit on all model rows of each key: (key, feature, importance), and the last feature row scored.

    Importance is the share of the mean split gains for trees, the size of the
    standardised coefficient for ridge. For ridge, key may have columns of rows that
    features lacks (horizon): the last row of the others is scored by each fit.
    """
    base = [k for k in key if k in features.columns]
    last = F.row_number().over(W.partitionBy(*base).orderBy(F.col("date").desc()))
    latest = features.withColumn("_at", last).filter("_at = 1").drop("_at")
    signal = F.when(F.col("prediction") > 0, 1).otherwise(-1)
    names = F.array(*map(F.lit, columns))
    if isinstance(learner, Ridge):
        whole = rows.withColumns({"fold": F.lit(0), "train_end": F.lit(2**31 - 1), "position": F.lit(0)})
        found = ridge_coefficients(whole, key, columns, target, learner.penalty)
        pairs = F.explode(F.arrays_zip(names.alias("feature"), F.transform("standard", F.abs).alias("importance"))).alias("of")
        importance = found.select(*key, pairs).select(*key, F.col("of.feature"), F.col("of.importance"))
        scored = latest.join(found.select(*key, "coefficients"), base).withColumn("prediction", _dot(columns))
        return importance, scored.select(*key, "date", "close", "prediction", signal.alias("signal"))
    schema = T.StructType([*(rows.schema[k] for k in key), T.StructField("importance", T.ArrayType(T.DoubleType())), T.StructField("prediction", T.DoubleType())])
    ask = latest.select(*key, "date", *columns, F.lit(None).cast("double").alias("_y"), F.lit(True).alias("_ask"))
    both = rows.select(*key, "date", *columns, F.col(target).alias("_y"), F.lit(False).alias("_ask")).unionByName(ask)

    def fit(values: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_ask", "date"])
        asked = frame["_ask"].to_numpy(bool)
        if asked.all():
            return pd.DataFrame(columns=schema.names)
        found, shares = boost(frame[list(columns)].to_numpy(float), frame["_y"].to_numpy(float), ~asked, learner)
        return pd.DataFrame([[*values, shares.tolist(), found[-1] if asked.any() else None]], columns=schema.names)

    found = both.repartition(4 * both.sparkSession.sparkContext.defaultParallelism, *key).groupBy(*key).applyInPandas(fit, schema)
    pairs = F.explode(F.arrays_zip(names.alias("feature"), F.col("importance"))).alias("of")
    importance = found.select(*key, pairs).select(*key, F.col("of.feature"), F.col("of.importance"))
    scored = _same(latest, found.select(*key, "prediction"), key)
    return importance, scored.select(*key, "date", "close", "prediction", signal.alias("signal"))


def top_features(importance: DataFrame, k: int = 12, key: Sequence[str] = ("dataset",)) -> DataFrame:
    """The k most important features of each key."""
    at = F.row_number().over(W.partitionBy(*key).orderBy(F.col("importance").desc(), "feature"))
    return importance.withColumn("rank", at).filter(F.col("rank") <= k)
