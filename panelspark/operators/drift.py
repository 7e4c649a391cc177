"""Distribution drift by feature: PSI, mean shift, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.stats import exact_quantiles


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def to_long(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    return df.unpivot(keep, features, "feature", "value").where("value is not null")


def winsorise(long: DataFrame, part: str = "part", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Both parts clipped to the reference part's quantiles."""
    q = long.where(F.col(part) == "reference").groupBy("feature").agg(F.percentile("value", [low, high]).alias("__q"))
    out = long.join(F.broadcast(q), "feature")  # a row a feature
    return out.withColumn("value", F.greatest(F.col("__q")[0], F.least(F.col("__q")[1], F.col("value")))).drop("__q")


def psi(long: DataFrame, bins: int = 10, part: str = "part", spread: bool = False) -> DataFrame:
    """long (feature, part, value) -> (feature, psi). Edges are the reference's quantiles (linear interpolation), made
    distinct; under three edges, equal width; outer edges open; shares are at least 1e-6.
    spread: the same quantiles by ranks inside cells, so that no task merges all distinct values of a feature; more jobs,
    for features with very many distinct values."""
    probs = [i / bins for i in range(bins + 1)]
    if spread:
        ref = exact_quantiles(long.where(F.col(part) == "reference"), "feature", "value", probs)
    else:
        ref = long.where(F.col(part) == "reference").groupBy("feature").agg(F.percentile("value", probs).alias("q"))
    ref = ref.select("feature", F.col("q").alias("e"), F.col("q")[0].alias("lo"), F.col("q")[bins].alias("hi"))
    even = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / bins)
    ref = ref.withColumn("e", F.when(F.size(F.array_distinct("e")) >= 3, F.array_distinct("e")).otherwise(F.array_distinct(even)))
    inner = F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0)))
    ref = ref.select("feature", inner.alias("inner"), F.greatest(F.size("e") - 1, F.lit(1)).alias("n_bins"))
    rows = long.join(F.broadcast(ref), "feature")  # one row a feature
    rows = rows.groupBy("feature", "n_bins", F.size(F.filter("inner", lambda e: e <= F.col("value"))).alias("bin")).agg(F.count_if(F.col(part) == "reference").alias("r"), F.count_if(F.col(part) == "current").alias("c"))
    totals = rows.groupBy("feature").agg(F.sum("r").alias("tr"), F.sum("c").alias("tc"))
    grid = ref.select("feature", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin")).join(rows.drop("n_bins"), ["feature", "bin"], "left").join(totals, "feature")
    share = lambda n, t: F.greatest(F.coalesce(F.try_divide(F.coalesce(n, F.lit(0)), t), F.lit(0.0)), F.lit(1e-6))
    r, c = share(F.col("r"), F.col("tr")), share(F.col("c"), F.col("tc"))
    return grid.groupBy("feature").agg(F.sum((c - r) * F.log(c / r)).alias("psi"))


def mean_shift(long: DataFrame, part: str = "part") -> DataFrame:
    """|current mean - reference mean| in reference deviations; without spread 0 if equal, else null with a flag."""
    is_ref = F.col(part) == "reference"
    m = long.groupBy("feature").agg(F.avg(F.when(is_ref, F.col("value"))).alias("mr"), F.stddev_pop(F.when(is_ref, F.col("value"))).alias("sr"), F.avg(F.when(~is_ref, F.col("value"))).alias("mc"))
    gap = F.abs(F.col("mc") - F.col("mr"))
    return m.select("feature", F.when(F.col("sr") > 0, gap / F.col("sr")).when(gap == 0, 0.0).alias("mean_shift"), ((F.col("sr") <= 0) & (gap > 0)).alias("infinite_shift"))


def status(score: Column, warning: float = 0.1, fail: float = 0.25) -> Column:
    return F.when(score >= fail, "FAIL").when(score >= warning, "WARNING").otherwise("PASS")


def drift_report(long: DataFrame, families: DataFrame, warning: float = 0.1, fail: float = 0.25) -> DataFrame:
    """One row a feature: PSI as it is and after winsorising, mean shift, family, status; by falling PSI."""
    raw, adjusted = psi(long), psi(winsorise(long)).withColumnRenamed("psi", "adjusted_psi")
    out = raw.join(adjusted, "feature").join(mean_shift(long), "feature").join(F.broadcast(families), "feature", "left")
    return out.withColumn("status", status(F.col("psi"), warning, fail)).orderBy(F.desc("psi"), "feature")


def run_summary(report: DataFrame) -> DataFrame:
    """One row of a drift_report: features, share of stable ones, largest and mean PSI as it is and winsorised, and the features by
    falling PSI (equal ones by name), a row a feature at most."""
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("psi")).alias("k"), "feature"))), lambda x: x["feature"])
    numbers = [f.alias(f"{n}_{c}") for c in ("psi", "adjusted_psi") for n, f in (("max", F.max(c)), ("mean", F.avg(c)))]
    return report.agg(F.count(F.lit(1)).alias("features"), F.avg((F.col("status") == "PASS").cast("double")).alias("stable_ratio"), *numbers, F.array_join(order, "|").alias("by_psi"))


def family_summary(report: DataFrame) -> DataFrame:
    flagged = F.array_sort(F.collect_list(F.when(F.col("status") != "PASS", F.col("feature"))))
    return report.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.max("psi").alias("max_psi"), F.avg("psi").alias("mean_psi"), F.array_join(flagged, "|").alias("flagged"))


def causes(report: DataFrame, thresholds: dict[str, tuple[float, float]], default: tuple[float, float], proxy_used: bool, regime_active: bool) -> DataFrame:
    """report (feature, family, psi, raw_psi, proxy_sensitive) plus status by the family's thresholds, cause and action."""
    limit = lambda i: F.coalesce(*[F.when(F.col("family") == f, F.lit(float(t[i]))) for f, t in thresholds.items()], F.lit(float(default[i])))
    df = report.withColumn("status", F.when(F.col("psi") >= limit(1), "FAIL").when(F.col("psi") >= limit(0), "WARNING").otherwise("PASS"))
    proxy, active = F.lit(proxy_used) & F.col("proxy_sensitive"), F.lit(regime_active)
    cause = F.when(F.col("status") == "PASS", "stable").when(proxy & active, "mixed_proxy_and_regime").when(proxy, "proxy_sensitive").when(F.col("family").isin("macro", "volatility") & active, "regime_sensitive").otherwise("distribution_shift")
    df = df.withColumn("cause", cause)
    return df.withColumn("action", F.when(F.col("status") == "PASS", "ignore").when(F.col("cause").isin("proxy_sensitive", "mixed_proxy_and_regime"), "watch").otherwise("trigger"))


def primary_cause(caused: DataFrame, by: list[str], proxy_used: bool, regime_active: bool) -> DataFrame:
    """What a run's flagged features point to: a proxy artefact, a regime shift, both or neither."""
    flagged = F.col("status") != "PASS"
    count = lambda c: F.count_if(flagged & c)
    fall = F.when(flagged & (F.col("raw_psi") > 0), F.greatest(F.col("raw_psi") - F.col("psi"), F.lit(0.0)) / F.greatest("raw_psi", F.lit(1e-9)))
    x = caused.groupBy(*by).agg(count(F.lit(True)).alias("flagged"), count(F.col("proxy_sensitive")).alias("p"), count(~F.col("proxy_sensitive")).alias("np"), count(F.col("family").isin("macro", "volatility")).alias("mv"), F.coalesce(F.avg(fall), F.lit(0.0)).alias("reduction"))
    used, active, p, n, m = F.lit(proxy_used), F.lit(regime_active), F.col("p"), F.col("np"), F.col("mv")
    out = F.when(F.col("flagged") == 0, "stable").when(used & (p > 0) & (n == 0) & ~active, "proxy_artifact_likely").when(active & (m > 0) & (n >= p), "regime_shift_likely").when(used & (p > 0) & (F.col("reduction") >= 0.35) & (p >= n), "proxy_artifact_likely").when(active & (m > 0), "mixed_proxy_and_regime").otherwise("mixed_or_unknown")
    return x.select(*by, "flagged", F.col("reduction").alias("mean_reduction"), out.alias("primary_cause"))
