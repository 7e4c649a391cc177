"""Boosted trees of depth two for a three-class label and two targets, fitted on every fold at once by gradient histograms.

Features are cut into bins at quantiles of the first training window, which every fold has. A level of a tree is one aggregate
over all folds: sums of gradients and curvatures by fold, feature, bin and node, reduced on the map side to a number of rows
that folds, features and bins bound. The best cut is picked from the cumulated sums; the next level or tree follows. Trees are
columns of a row a fold, so scoring is one join and expressions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.walkforward import PROBS

MODELS = 5  # three class scores, the return and the volatility
NO_CUT = 1 << 20


def bin_edges(rows: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Inner quantile edges of each feature (a row of numbers); equal ones are merged."""
    r = rows.agg(*[F.percentile(c, [i / bins for i in range(1, bins)]).alias(c) for c in features]).first()
    return {c: sorted(set(r[c] or [])) for c in features}


def binned(rows: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """rows plus bins: for each feature the number of edges that are at most its value."""
    one = lambda c, e: sum(((F.col(c) >= v).cast("int") for v in e), F.lit(0))
    return rows.withColumn("bins", F.array(*[one(c, e) for c, e in edges.items()]))


def _leaf(cuts: str, leaves: str) -> Column:
    """The value that the row's bins reach: cuts has (feature, bin) of the root and of its left and right child."""
    at = lambda i: F.get(F.col(cuts), F.lit(i))
    left = F.get("bins", at(0)) <= at(1)
    down = F.when(left, F.get("bins", at(2)) <= at(3)).otherwise(F.get("bins", at(4)) <= at(5))
    return F.get(F.col(leaves), F.when(left, F.when(down, 0).otherwise(1)).otherwise(F.when(down, 2).otherwise(3)))


def _scores(df: DataFrame, rounds: int, rate: float) -> DataFrame:
    """df (bins, and the fold's bases and trees) plus f0 to f4."""
    return df.withColumns({f"f{m}": sum((rate * _leaf(f"cuts_{r}_{m}", f"leaves_{r}_{m}") for r in range(rounds)), F.col(f"base_{m}")) for m in range(MODELS)})


def _shares(df: DataFrame) -> DataFrame:
    df = df.withColumn("__top", F.greatest("f0", "f1", "f2")).withColumns({f"__e{k}": F.exp(F.col(f"f{k}") - F.col("__top")) for k in range(3)})
    return df.withColumns({p: F.col(f"__e{k}") / (F.col("__e0") + F.col("__e1") + F.col("__e2")) for k, p in enumerate(PROBS)}).drop("__top", "__e0", "__e1", "__e2")


class FoldTrees:
    """fit() runs two jobs a round. Afterwards table() has a row a fold."""

    def __init__(self, rounds: int = 3, rate: float = 0.3, least: int = 20, penalty: float = 1.0):
        self.rounds, self.rate, self.least, self.penalty = rounds, rate, least, penalty
        self.base: dict[int, list[float]] = {}
        self.trees: dict[int, list[list[tuple[list[int], list[float]]]]] = {}

    def table(self, spark) -> DataFrame:
        done = max((len(t) for t in self.trees.values()), default=0)
        kinds = ["fold_id bigint", *[f"base_{m} double" for m in range(MODELS)], *[f"cuts_{r}_{m} array<int>, leaves_{r}_{m} array<double>" for r in range(done) for m in range(MODELS)]]
        rows = [(f, *self.base[f], *[x for r in self.trees[f] for tree in r for x in tree]) for f in self.base]
        return spark.createDataFrame(rows, ", ".join(kinds))

    def fit(self, train: DataFrame, features: int, label: str, targets: list[str]) -> FoldTrees:
        """train: (fold_id, bins, label, targets), a row for each fold that trains on it. Persist its source before."""
        spark = train.sparkSession
        sums = train.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(label) == k).alias(f"n{k}") for k in range(3)], *[F.avg(t).alias(f"m{i}") for i, t in enumerate(targets)]).collect()  # a row a fold
        for r in sums:
            self.base[r["fold_id"]] = [float(np.log(max(r[f"n{k}"] / r["n"], 1e-9))) for k in range(3)] + [r["m0"], r["m1"]]
            self.trees[r["fold_id"]] = []
        for _ in range(self.rounds if sums else 0):
            done = len(next(iter(self.trees.values())))
            rows = _shares(_scores(train.join(F.broadcast(self.table(spark)), "fold_id"), done, self.rate))  # a row a fold
            g = [(F.col(label) == k).cast("double") - F.col(p) for k, p in enumerate(PROBS)] + [F.col(t) - F.col(f"f{3 + i}") for i, t in enumerate(targets)]
            h = [F.col(p) * (1 - F.col(p)) for p in PROBS] + [F.lit(1.0)] * 2
            rows = rows.select("fold_id", "bins", *[x.alias(f"{n}{m}") for n, xs in (("g", g), ("h", h)) for m, x in enumerate(xs)])
            roots = self._cuts(rows, features, {f: [None] * MODELS for f in self.base})
            nodes = self._cuts(rows, features, {f: [(c[0][0], c[0][1]) for c in cuts] for f, cuts in roots.items()})
            for f, cuts in nodes.items():
                trees = []
                for m, sides in enumerate(cuts):
                    leaves = [v for side in sides for v in side[2]]
                    trees.append(([*roots[f][m][0][:2], *sides[0][:2], *sides[1][:2]], leaves))
                self.trees[f].append(trees)
        return self

    def _cuts(self, rows: DataFrame, features: int, above: dict) -> dict:
        """The best cut of each node of each fold and model: (feature, bin, (left leaf, right leaf))."""
        spark = rows.sparkSession
        split = any(c is not None for cs in above.values() for c in cs)
        if split:
            table = spark.createDataFrame([(f, *[x for c in cs for x in c]) for f, cs in above.items()], "fold_id bigint, " + ", ".join(f"j{m} int, t{m} int" for m in range(MODELS)))
            rows = rows.join(F.broadcast(table), "fold_id").withColumns({f"s{m}": F.when(F.get("bins", F.col(f"j{m}")) <= F.col(f"t{m}"), 0).otherwise(1) for m in range(MODELS)})
        cells = rows.select("*", F.posexplode("bins").alias("j", "bin")).groupBy("fold_id", "j", "bin")
        sides = range(2 if split else 1)
        on = lambda m, s, x: F.sum(F.when(F.col(f"s{m}") == s, x).otherwise(0.0)) if split else F.sum(x)
        got = cells.agg(*[on(m, s, x).alias(f"{n}_{m}_{s}") for m in range(MODELS) for s in sides for n, x in (("g", F.col(f"g{m}")), ("h", F.col(f"h{m}")), ("n", F.lit(1.0)))]).collect()  # a row a fold, feature and bin
        width = 1 + max((r["bin"] for r in got), default=0)
        cell = {f: np.zeros((3, MODELS, 2, features, width)) for f in above}
        for r in got:
            for m in range(MODELS):
                for s in sides:
                    cell[r["fold_id"]][:, m, s, r["j"], r["bin"]] = [r[f"{n}_{m}_{s}"] for n in "ghn"]
        return {f: [[self._best(c[:, m, s]) for s in sides] for m in range(MODELS)] for f, c in cell.items()}

    def _best(self, c: np.ndarray) -> tuple[int, int, tuple[float, float]]:
        """c (3, features, bins) of gradients, curvatures and rows. The first of equally good cuts by feature and bin; a node
        that no cut improves stays whole."""
        left = np.cumsum(c, axis=2)
        whole = left[:, :, -1:]
        right = whole - left
        worth = lambda x: x[0] ** 2 / (x[1] + self.penalty)
        gain = np.where((left[2] >= self.least) & (right[2] >= self.least), worth(left) + worth(right) - worth(whole), -np.inf)
        value = lambda x: float(x[0] / (x[1] + self.penalty))
        j, t = np.unravel_index(int(gain.argmax()), gain.shape)
        if not gain[j, t] > 1e-9:
            return 0, NO_CUT, (value(whole[:, 0, 0]), 0.0)
        return int(j), int(t), (value(left[:, j, t]), value(right[:, j, t]))

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows (fold_id, bins, ...) plus class probabilities, expected_return and predicted_volatility (at least 0)."""
        table = self.table(rows.sparkSession)
        out = _shares(_scores(rows.join(F.broadcast(table), "fold_id"), self.rounds, self.rate))  # a row a fold
        return out.select(*rows.columns, *PROBS, F.col("f3").alias("expected_return"), F.greatest("f4", F.lit(0.0)).alias("predicted_volatility"))
