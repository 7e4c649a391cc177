"""Models as aggregates or Spark ML: a Gaussian class model, ridge, trees, calibration."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gaussian_fit(train: DataFrame, columns: list[str], label: str) -> DataFrame:
    """One row a class: log prior, mean and variance (at least 1e-6) of each column."""
    g = train.groupBy(F.col(label).alias("cls")).agg(F.count(F.lit(1)).alias("n"), *[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.greatest(F.var_pop(c), F.lit(1e-6)).alias(f"v_{c}"))])
    total = g.agg(F.sum("n").alias("t"))
    return g.crossJoin(F.broadcast(total)).withColumn("log_prior", F.log(F.col("n") / F.col("t"))).drop("n", "t")


def gaussian_posterior(df: DataFrame, model: DataFrame, columns: list[str], id_cols: list[str]) -> DataFrame:
    """(ids, cls, posterior). The model has a row a class and is broadcast."""
    x = df.crossJoin(F.broadcast(model))
    density = sum((-0.5 * (F.log(2 * math.pi * F.col(f"v_{c}")) + F.pow(F.col(c) - F.col(f"m_{c}"), 2) / F.col(f"v_{c}")) for c in columns), F.col("log_prior"))
    x = x.select(*id_cols, "cls", density.alias("l"))
    g = x.groupBy(*id_cols).agg(F.collect_list(F.struct("cls", "l")).alias("a"), F.max("l").alias("top"))  # a struct a class
    g = g.withColumn("z", F.aggregate("a", F.lit(0.0), lambda s, y: s + F.exp(y["l"] - F.col("top"))))
    return g.select(*id_cols, "z", "top", F.explode("a").alias("y")).select(*id_cols, F.col("y.cls").alias("cls"), (F.exp(F.col("y.l") - F.col("top")) / F.col("z")).alias("posterior"))


def ridge(train: DataFrame, columns: list[str], target: str, alpha: float) -> dict[str, float]:
    """Coefficients with a free intercept: one pass sums the p x p products, the small system is solved on the driver."""
    names = ["__one", *columns]
    x = train.withColumn("__one", F.lit(1.0)).dropna(subset=[*columns, target])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = x.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"g{i}") for i, (a, b) in enumerate(pairs)], *[F.sum(F.col(a) * F.col(target)).alias(f"t{i}") for i, a in enumerate(names)]).first()
    gram = np.zeros((len(names), len(names)))
    for i, (a, b) in enumerate(pairs):
        gram[names.index(a), names.index(b)] = gram[names.index(b), names.index(a)] = row[f"g{i}"] or 0.0
    penalty = alpha * np.eye(len(names))
    penalty[0, 0] = 0.0
    beta = np.linalg.lstsq(gram + penalty, np.array([row[f"t{i}"] or 0.0 for i in range(len(names))]), rcond=None)[0]
    return dict(zip(["intercept", *columns], beta.tolist(), strict=True))


def linear_score(coefficients: dict[str, float]) -> Column:
    return sum((F.col(c) * b for c, b in coefficients.items() if c != "intercept"), F.lit(coefficients["intercept"]))


def top_contributions(coefficients: dict[str, float], n: int = 5) -> Column:
    """The n features with the largest |x * coefficient|, as an array of (name, value)."""
    parts = F.array(*[F.struct((-F.abs(F.col(c) * b)).alias("k"), F.lit(c).alias("name"), (F.col(c) * b).alias("value")) for c, b in coefficients.items() if c != "intercept"])
    return F.transform(F.slice(F.array_sort(parts), 1, n), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))


def forest(train: DataFrame, df: DataFrame, columns: list[str], label: str, trees: int = 50, seed: int = 7) -> DataFrame:
    """df plus probability (vector) of a random forest."""
    asm = VectorAssembler(inputCols=columns, outputCol="__x", handleInvalid="skip")
    model = RandomForestClassifier(featuresCol="__x", labelCol=label, numTrees=trees, seed=seed).fit(asm.transform(train))
    return model.transform(asm.transform(df)).drop("__x", "rawPrediction", "prediction")


def calibrate(tail: DataFrame, df: DataFrame, probs: list[str], label: str) -> DataFrame:
    """df plus calibrated (vector): multinomial logistic regression on centred log-probabilities of the tail."""
    logs = [F.log(F.greatest(F.col(p), F.lit(1e-9))) for p in probs]
    mean = sum(logs[1:], logs[0]) / len(probs)

    def centred(x: DataFrame) -> DataFrame:
        x = x.withColumns({f"__c{i}": v - mean for i, v in enumerate(logs)})
        return VectorAssembler(inputCols=[f"__c{i}" for i in range(len(probs))], outputCol="__x").transform(x)

    model = LogisticRegression(featuresCol="__x", labelCol=label, family="multinomial", probabilityCol="calibrated").fit(centred(tail))
    return model.transform(centred(df)).drop("__x", "rawPrediction", "prediction", *[f"__c{i}" for i in range(len(probs))])


def confidence_band(p: Column, low: float = 0.4, high: float = 0.6) -> Column:
    return F.when(p >= high, "high").when(p >= low, "medium").otherwise("low")
