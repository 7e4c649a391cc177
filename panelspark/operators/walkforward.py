"""Models fitted on every fold of a walk-forward at once.

What a fit needs are sums over its training rows. They are taken once a date (map-side combined), cumulated over the table of
dates, and read at each fold's cut, so all folds cost one pass of the panel and no fold sees a row after its cut. Models are
tables of a row a fold; scoring joins them to the evaluation rows.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.folds import date_index, walk_forward_cuts

CLASSES = (0, 1, 2)
PROBS = ("prob_down", "prob_flat", "prob_up")


def training_sums(rows: DataFrame, dates: DataFrame, cuts: DataFrame, features: list[str], label: str, targets: list[str]) -> DataFrame:
    """(fold_id, sums): of the rows of the first `cut` dates, numbers n_c, sums s_c_j and squares q_c_j by class c and feature j,
    products g_j_k of features, and y_t, h_t_j of each target t with the features. rows: complete (see training_frame)."""
    sums: dict[str, Column] = {}
    for c in CLASSES:
        mine = F.col(label) == c
        sums[f"n_{c}"] = F.count_if(mine)
        for j, x in enumerate(features):
            sums[f"s_{c}_{j}"] = F.sum(F.when(mine, F.col(x)))
            sums[f"q_{c}_{j}"] = F.sum(F.when(mine, F.col(x) * F.col(x)))
    for j, k in combinations_with_replacement(range(len(features)), 2):
        sums[f"g_{j}_{k}"] = F.sum(F.col(features[j]) * F.col(features[k]))
    for t, y in enumerate(targets):
        sums[f"y_{t}"] = F.sum(F.col(y))
        for j, x in enumerate(features):
            sums[f"h_{t}_{j}"] = F.sum(F.col(x) * F.col(y))
    by_date = rows.groupBy("date").agg(*[v.alias(k) for k, v in sums.items()]).join(dates, "date")
    w = Window.orderBy("idx")  # a date table
    total = by_date.select("idx", *[F.sum(F.coalesce(k, F.lit(0))).over(w).alias(k) for k in sums])
    return cuts.select("fold_id", (F.col("cut") - 1).alias("idx")).join(total, "idx").drop("idx")


def scales(sums: DataFrame, p: int) -> DataFrame:
    """sums plus n and each feature's mean and population deviation over the training rows (1 where there is no spread)."""
    df = sums.withColumn("n", sum((F.col(f"n_{c}") for c in CLASSES[1:]), F.col("n_0")))
    df = df.withColumns({f"mean_{j}": sum((F.col(f"s_{c}_{j}") for c in CLASSES[1:]), F.col(f"s_0_{j}")) / F.col("n") for j in range(p)})
    var = lambda j: F.greatest(F.col(f"g_{j}_{j}") / F.col("n") - F.col(f"mean_{j}") * F.col(f"mean_{j}"), F.lit(0.0))
    return df.withColumns({f"std_{j}": F.when(var(j) > 1e-18, F.sqrt(var(j))).otherwise(1.0) for j in range(p)})


def gaussian_by_fold(scaled: DataFrame, p: int) -> DataFrame:
    """scaled plus, by class, prior_c (0 where it has no row), and mean m_c_j and variance v_c_j (at least 1e-6) of the standardised
    features (0 and 1 where it has no row)."""
    out = {}
    for c in CLASSES:
        n = F.col(f"n_{c}")
        out[f"prior_{c}"] = n / F.col("n")
        for j in range(p):
            mean = F.try_divide(f"s_{c}_{j}", n)
            out[f"m_{c}_{j}"] = F.coalesce((mean - F.col(f"mean_{j}")) / F.col(f"std_{j}"), F.lit(0.0))
            spread = (F.try_divide(f"q_{c}_{j}", n) - mean * mean) / (F.col(f"std_{j}") * F.col(f"std_{j}"))
            out[f"v_{c}_{j}"] = F.when(n == 0, 1.0).otherwise(F.greatest(spread, F.lit(1e-6)))
    return scaled.withColumns(out)


def ridge_by_fold(scaled: DataFrame, p: int, targets: int, alpha: float = 1.0) -> DataFrame:
    """scaled plus b_t (the free intercept) and b_t_j: ridge coefficients of the standardised features, by a Cholesky
    factorisation written as columns. Standardised features have mean 0 in training, so the intercept is the target's mean."""
    df = scaled
    centred = lambda j, k: (F.col(f"g_{j}_{k}") - F.col("n") * F.col(f"mean_{j}") * F.col(f"mean_{k}")) / (F.col(f"std_{j}") * F.col(f"std_{k}"))
    low = lambda i, k: F.col(f"__l_{i}_{k}")
    for k in range(p):
        rest = centred(k, k) + alpha - sum((low(k, m) * low(k, m) for m in range(k)), F.lit(0.0))
        df = df.withColumn(f"__l_{k}_{k}", F.sqrt(rest))
        if k + 1 < p:
            df = df.withColumns({f"__l_{i}_{k}": (centred(k, i) - sum((low(i, m) * low(k, m) for m in range(k)), F.lit(0.0))) / low(k, k) for i in range(k + 1, p)})
    df = df.withColumns({f"b_{t}": F.col(f"y_{t}") / F.col("n") for t in range(targets)})
    for j in range(p):
        rhs = lambda t, j=j: (F.col(f"h_{t}_{j}") - F.col(f"mean_{j}") * F.col(f"y_{t}")) / F.col(f"std_{j}")
        df = df.withColumns({f"__z_{t}_{j}": (rhs(t) - sum((low(j, m) * F.col(f"__z_{t}_{m}") for m in range(j)), F.lit(0.0))) / low(j, j) for t in range(targets)})
    for j in reversed(range(p)):
        df = df.withColumns({f"b_{t}_{j}": (F.col(f"__z_{t}_{j}") - sum((low(i, j) * F.col(f"b_{t}_{i}") for i in range(j + 1, p)), F.lit(0.0))) / low(j, j) for t in range(targets)})
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def fitted_folds(rows: DataFrame, features: list[str], label: str, targets: list[str], first_train: int, eval_size: int, step: int, embargo: int, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(models of a row a fold, evaluation dates (fold_id, date))."""
    dates = date_index(rows)
    cuts = walk_forward_cuts(dates, first_train, eval_size, step, embargo)
    sums = scales(training_sums(rows, dates, cuts, features, label, targets), len(features))
    models = ridge_by_fold(gaussian_by_fold(sums, len(features)), len(features), len(targets), alpha)
    return models, eval_dates(dates, cuts, eval_size, embargo)


def eval_dates(dates: DataFrame, cuts: DataFrame, eval_size: int, embargo: int) -> DataFrame:
    """(fold_id, date) of the evaluation windows."""
    windows = cuts.select("fold_id", F.explode(F.sequence(F.col("cut") + embargo, F.col("cut") + (embargo + eval_size - 1))).alias("idx"))
    return windows.join(dates, "idx").select("fold_id", "date")


def scored(rows: DataFrame, models: DataFrame, windows: DataFrame, features: list[str], high: float = 0.5, medium: float = 0.4) -> DataFrame:
    """The evaluation rows with fold_id, class probabilities, signal, expected_return (first target), predicted_volatility (second
    target, at least 0), confidence, the fold's class shares in training (prior_0 to prior_2) and contributions: (name, value) of
    each feature's part of the expected return, the largest first. Rows of overlapping windows stand once a fold."""
    x = rows.join(windows, "date").join(models, "fold_id")
    z = {f"__x_{j}": (F.col(c) - F.col(f"mean_{j}")) / F.col(f"std_{j}") for j, c in enumerate(features)}
    x = x.withColumns(z)
    p = range(len(features))

    def density(c: int) -> Column:
        parts = (F.log(2 * math.pi * F.col(f"v_{c}_{j}")) + F.pow(F.col(f"__x_{j}") - F.col(f"m_{c}_{j}"), 2) / F.col(f"v_{c}_{j}") for j in p)
        return F.log(F.greatest(F.col(f"prior_{c}"), F.lit(1e-9))) - 0.5 * sum(parts, F.lit(0.0))

    x = x.withColumns({f"__d_{c}": density(c) for c in CLASSES})
    x = x.withColumn("__top", F.greatest(*[f"__d_{c}" for c in CLASSES]))
    x = x.withColumns({f"__e_{c}": F.exp(F.col(f"__d_{c}") - F.col("__top")) for c in CLASSES})
    x = x.withColumns({name: F.col(f"__e_{c}") / (F.col("__e_0") + F.col("__e_1") + F.col("__e_2")) for c, name in enumerate(PROBS)})
    linear = lambda t: sum((F.col(f"__x_{j}") * F.col(f"b_{t}_{j}") for j in p), F.col(f"b_{t}"))
    best = F.greatest(*PROBS)
    parts = F.array(*[F.struct((-F.abs(F.col(f"__x_{j}") * F.col(f"b_0_{j}"))).alias("k"), F.lit(c).alias("name"), (F.col(f"__x_{j}") * F.col(f"b_0_{j}")).alias("value")) for j, c in enumerate(features)])
    x = x.withColumns({
        "signal": F.col("prob_up") - F.col("prob_down"), "expected_return": linear(0), "predicted_volatility": F.greatest(linear(1), F.lit(0.0)),
        "confidence": F.when(best > high, "high").when(best > medium, "medium").otherwise("low"),
        "contributions": F.transform(F.array_sort(parts), lambda s: F.struct(s["name"].alias("name"), s["value"].alias("value"))),
    })
    return x.select(*rows.columns, "fold_id", *PROBS, "signal", "expected_return", "predicted_volatility", "confidence", "prior_0", "prior_1", "prior_2", "contributions")
