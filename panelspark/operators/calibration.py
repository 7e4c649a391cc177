"""Multinomial calibration of class probabilities on the tail of each fold's training dates, for all folds at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.walkforward import PROBS

SIZE = 4  # an intercept and three centred log-probabilities


def centred_logs(floor: float = 1e-6) -> list[Column]:
    """Log-probabilities (cut to [floor, 1 - floor]) less their mean."""
    logs = [F.log(F.greatest(F.least(F.col(p), F.lit(1 - floor)), F.lit(floor))) for p in PROBS]
    mean = (logs[0] + logs[1] + logs[2]) / 3
    return [x - mean for x in logs]


def tail_cuts(cuts: DataFrame, fraction: float, min_days: int) -> DataFrame:
    """cuts (fold_id, cut) plus fit_cut: the tail of max(min_days, round(cut * fraction)) dates is kept from fitting; a fold of at
    most that many dates and five has no tail."""
    size = F.greatest(F.lit(min_days), F.bround(F.col("cut") * fraction).cast("int"))
    return cuts.withColumn("fit_cut", F.when(F.col("cut") > size + 5, F.col("cut") - size).otherwise(F.col("cut")))


def _with_probabilities(df: DataFrame) -> DataFrame:
    """df (x0 to x3, weights w_k_i) plus p0, p1, p2; a projection for each step, so that nothing is worked out twice."""
    df = df.withColumns({f"z{k}": sum((F.col(f"x{i}") * F.col(f"w_{k}_{i}") for i in range(1, SIZE)), F.col(f"w_{k}_0")) for k in range(3)})
    df = df.withColumn("top", F.greatest("z0", "z1", "z2")).withColumns({f"z{k}": F.exp(F.col(f"z{k}") - F.col("top")) for k in range(3)})
    df = df.withColumn("top", F.col("z0") + F.col("z1") + F.col("z2"))
    return df.withColumns({f"p{k}": F.col(f"z{k}") / F.col("top") for k in range(3)}).drop("z0", "z1", "z2", "top")


WEIGHTS = [f"w_{k}_{i}" for k in range(3) for i in range(SIZE)]


def fitted(tail: DataFrame, label: str, rounds: int = 12, penalty: float = 1.0) -> DataFrame:
    """tail (fold_id, probabilities, label) -> (fold_id, w_k_i): multinomial logistic regression on the centred log-probabilities,
    the weights penalised and the intercepts (i = 0) free. Folds whose tail lacks a class have no row.

    Each round is one aggregate over all folds, run when called: their gradients, then a step by the inverse of a fixed matrix
    that bounds the curvature (half the products of the inputs, plus the penalty), so the loss never rises. Only the sums, a
    row a fold, come back. Persist the tail before."""
    x = tail.select("fold_id", F.col(label).alias("y"), F.lit(1.0).alias("x0"), *[c.alias(f"x{i + 1}") for i, c in enumerate(centred_logs())])
    pairs = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
    fixed = x.groupBy("fold_id").agg(F.count_distinct("y").alias("classes"), *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g_{i}_{j}") for i, j in pairs]).where("classes = 3").collect()  # a row a fold
    free = np.diag([0.0] + [penalty] * (SIZE - 1))
    inverse = {r["fold_id"]: np.linalg.inv(np.array([[r[f"g_{min(i, j)}_{max(i, j)}"] for j in range(SIZE)] for i in range(SIZE)]) / 2 + free) for r in fixed}
    weights = {f: np.zeros((3, SIZE)) for f in inverse}
    table = lambda: x.sparkSession.createDataFrame([(f, *w.ravel().tolist()) for f, w in weights.items()], f"fold_id {kind}, " + ", ".join(f"{w} double" for w in WEIGHTS))
    kind = x.schema["fold_id"].dataType.simpleString()
    for _ in range(rounds if weights else 0):
        rows = _with_probabilities(x.join(F.broadcast(table()), "fold_id"))  # a row a fold
        slopes = [F.sum(F.col(f"x{i}") * ((F.col("y") == k).cast("double") - F.col(f"p{k}"))).alias(f"d_{k}_{i}") for k in range(3) for i in range(SIZE)]
        for r in rows.groupBy("fold_id").agg(*slopes).collect():
            f = r["fold_id"]
            slope = np.array([[r[f"d_{k}_{i}"] for i in range(SIZE)] for k in range(3)]) - weights[f] @ free
            weights[f] = weights[f] + slope @ inverse[f]
    return table()


def calibrated(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows with calibrated probabilities (cal_down, cal_flat, cal_up); those of a fold without weights stay as they are."""
    x = rows.join(weights, "fold_id", "left").withColumns({"x0": F.lit(1.0)} | {f"x{i + 1}": c for i, c in enumerate(centred_logs())})
    x = _with_probabilities(x).withColumns({name: F.coalesce(f"p{k}", raw) for k, (name, raw) in enumerate(zip(("cal_down", "cal_flat", "cal_up"), PROBS, strict=True))})
    return x.drop(*WEIGHTS, *[f"x{i}" for i in range(SIZE)], "p0", "p1", "p2")
