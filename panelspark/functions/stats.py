"""Statistics that stay defined at the edges: guarded correlation, exponential means, full-window aggregates, erf."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of pairs without nulls, 0 when n < 2 or either side has no spread."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.when((F.count(x) < 2) | (spread <= 1e-12) | spread.isNull(), F.lit(0.0)).otherwise(F.try_divide(F.covar_pop(x, y), spread))


def full_window(agg: Column, x: Column, spec, n: int) -> Column:
    """agg over the frame only where it holds n values of x."""
    return F.when(F.count(x).over(spec) == n, agg.over(spec))


def weighted_mean(v: Column, w: Column) -> Column:
    """Weighted mean; the plain mean where the weights sum to nothing."""
    use = v.isNotNull() & w.isNotNull()
    total = F.sum(F.when(use, w))
    return F.coalesce(F.when(total > 0, F.try_divide(F.sum(F.when(use, v * w)), total)), F.avg(v))


def exact_quantiles(df: DataFrame, key: str, value: str, probs: list[float], cells: int = 32) -> DataFrame:
    """(key, q array, n): exact quantiles with linear interpolation, of values without nulls.

    A mergeable sketch cuts the values of a key into cells of about equal size; values are counted and ranked inside their
    cell only, so a key is spread over many tasks and no task holds all its distinct values."""
    df = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"))
    edges = df.groupBy("k").agg(F.percentile_approx("v", [i / cells for i in range(1, cells)], 1000).alias("e"), F.count("v").alias("n"))  # a row a key
    rows = df.join(F.broadcast(edges), "k").select("k", "v", "n", F.size(F.filter("e", lambda e: e < F.col("v"))).alias("b"))
    counts = rows.groupBy("k", "n", "b", "v").agg(F.count(F.lit(1)).alias("c"))
    before = counts.groupBy("k", "b").agg(F.sum("c").alias("s"))
    before = before.select("k", "b", (F.sum("s").over(Window.partitionBy("k").orderBy("b")) - F.col("s")).alias("before"))  # `cells` rows a key
    ranked = counts.join(F.broadcast(before), ["k", "b"]).withColumn("to", F.col("before") + F.sum("c").over(Window.partitionBy("k", "b").orderBy("v")))
    ranked = ranked.withColumn("from", F.col("to") - F.col("c"))
    at = [(i, p, F.floor(F.lit(p) * (F.col("n") - 1)), F.ceil(F.lit(p) * (F.col("n") - 1))) for i, p in enumerate(probs)]
    inside = lambda x: (x >= F.col("from")) & (x < F.col("to"))
    hits = F.array_compact(F.array(*[F.when(inside(lo) | inside(hi), F.struct(F.lit(i).alias("i"), F.when(inside(lo), F.col("v")).alias("lo"), F.when(inside(hi), F.col("v")).alias("hi"), (F.lit(p) * (F.col("n") - 1) - lo).alias("f"))) for i, p, lo, hi in at]))
    q = ranked.select("k", "n", F.explode(hits).alias("h")).groupBy("k", "n", "h.i").agg(F.max("h.lo").alias("lo"), F.max("h.hi").alias("hi"), F.max("h.f").alias("f"))
    one = F.struct("i", (F.col("lo") + F.col("f") * (F.col("hi") - F.col("lo"))).alias("x"))
    return q.groupBy("k", "n").agg(F.array_sort(F.collect_list(one)).alias("q")).select(F.col("k").alias(key), F.col("q.x").alias("q"), "n")


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution by a polynomial of the error function (absolute error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    # fixed coefficients of the approximation
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def ewms(df: DataFrame, key: str, order: list[str], specs: list[tuple[str, str, float]], block: int = 128) -> DataFrame:
    """For each (value, out, decay): out = exponential mean with y = decay * y + (1 - decay) * x, seeded by the first row.

    Two levels: inside blocks of rows by prefix sums of rescaled values, then the last values of earlier blocks, as far as
    their weight counts. All windows are partitioned by the key, so all means share one shuffle; memory and time are linear
    in the rows of a key. Blocks are long enough for four of them to hold all weight that counts, and short enough for the
    rescaled values to stay finite."""
    slow, fast = max(d for _, _, d in specs), min(d for _, _, d in specs)
    block = max(1, min(max(block, math.ceil(39.2 / (-4 * math.log(slow)))), int(600 / -math.log(fast))))
    w = Window.partitionBy(key).orderBy(*order)
    df = df.withColumn("__n", F.row_number().over(w) - 1)
    df = df.withColumn("__b", F.floor(F.col("__n") / block).cast("long")).withColumn("__j", F.col("__n") % block)
    inside, blocks = Window.partitionBy(key, "__b").orderBy("__j"), Window.partitionBy(key).orderBy("__b")
    for i, (value, _, decay) in enumerate(specs):
        term = F.when(F.col("__n") == 0, F.col(value)).otherwise(F.col(value) * (1 - decay)) * F.pow(F.lit(decay), -F.col("__j"))
        df = df.withColumn(f"__local{i}", F.sum(term).over(inside) * F.pow(F.lit(decay), F.col("__j")))
    lags = [max(1, math.ceil(-math.log(1e-17) / (-math.log(decay) * block))) for _, _, decay in specs]
    locals_ = [F.col(f"__local{i}").alias(f"l{i}") for i in range(len(specs))]
    df = df.withColumns({f"__end{k}": F.max(F.struct("__j", *locals_)).over(blocks.rangeBetween(-k, -k)) for k in range(1, max(lags) + 1)})  # the last row of the k-th block before
    for i, (_, out, decay) in enumerate(specs):
        carried = sum((F.coalesce(F.col(f"__end{k}.l{i}"), F.lit(0.0)) * decay ** (block * (k - 1)) for k in range(1, lags[i] + 1)), F.lit(0.0))
        df = df.withColumn(out, F.col(f"__local{i}") + carried * F.pow(F.lit(decay), F.col("__j") + 1))
    return df.drop("__n", "__b", "__j", *[f"__local{i}" for i in range(len(specs))], *[f"__end{k}" for k in range(1, max(lags) + 1)])


def ewm(df: DataFrame, key: str, order: list[str], value: str, out: str, decay: float, block: int = 128) -> DataFrame:
    return ewms(df, key, order, [(value, out, decay)], block)
