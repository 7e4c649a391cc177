"""Does the daily news signal say anything about returns: weights, coverage, variants, buckets and what is best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.calendar import bday_add
from panelspark.functions.stats import ewms, safe_corr, weighted_mean
from panelspark.operators.news import session_label

WEIGHTINGS = ("unweighted", "source_weighted", "session_weighted", "source_session_weighted")
NEUTRAL = {"headline_count": 0.0, "mapping_confidence": 0.0, "novelty": 0.0, "source_diversity": 0.0, "source_count": 0.0}


def lookup_weight(key: Column, weights: dict[str, float]) -> Column:
    """The weight of a name; 1 where it has none or one that is not positive."""
    found = F.coalesce(*[F.when(key == k, F.lit(float(w))) for k, w in weights.items()], F.lit(1.0))
    return F.when(found > 0, found).otherwise(1.0)


def with_weights(items: DataFrame, source_weights: dict[str, float], session_weights: dict[str, float]) -> DataFrame:
    """Items plus the four signal weights: relevance in 0..1, times the source's, the session's, and both weights."""
    base = F.greatest(F.least("relevance_score", F.lit(1.0)), F.lit(0.0))
    src, ses = lookup_weight(F.col("source_name"), source_weights), lookup_weight(F.col("session"), session_weights)
    return items.withColumn("w_unweighted", base).withColumn("w_source_weighted", base * src).withColumn("w_session_weighted", base * ses).withColumn("w_source_session_weighted", base * src * ses)


def daily_variants(items: DataFrame) -> DataFrame:
    """(ticker, date): sentiment and relevance under the four weightings, counts, sources and session label, in one pass."""
    scores = [weighted_mean(F.col(c), F.col(f"w_{w}")).alias(f"{c.split('_')[0]}_{w}") for c in ("sentiment_score", "relevance_score") for w in WEIGHTINGS]
    sessions = F.array_sort(F.collect_set(F.when(F.col("session") != "", F.col("session"))))
    mix = F.array_sort(F.collect_set(F.when(F.col("source_name") != "", F.col("source_name"))))
    out = items.groupBy("ticker", "date").agg(*scores, F.count(F.lit(1)).alias("headline_count"), F.avg("mapping_confidence").alias("mapping_confidence"), F.avg("novelty").alias("novelty"), F.count_distinct("source_key").alias("source_diversity"), F.count_distinct("source_name").alias("source_count"), mix.alias("__mix"), sessions.alias("__sessions"))
    return out.withColumn("source_mix", F.when(F.size("__mix") == 0, "none").otherwise(F.array_join("__mix", "|"))).withColumn("session_bucket", session_label(F.col("__sessions"))).drop("__mix", "__sessions")


def session_counts(items: DataFrame) -> DataFrame:
    """(ticker, date, counts map session -> items)."""
    rows = items.where("session <> ''").groupBy("ticker", "date", "session").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("ticker", "date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("session", "n")))).alias("session_counts"))


def newest_relevant(items: DataFrame, n: int = 10) -> DataFrame:
    """The n newest items, the more relevant first at one time."""
    return items.orderBy(F.desc("published_at"), F.desc("relevance_score"), "item_id").limit(n)


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """One table of the sources that could be read (missing ones are left out by the caller); columns that a source lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def coverage_panel(bars: DataFrame, days: int = 3) -> DataFrame:
    """(ticker, date, ret): day-on-day returns, and for each ticker the next `days` business days after the panel's last
    date with no return, so that fresh news have a row."""
    w = Window.partitionBy("ticker").orderBy("date")
    past = bars.select("ticker", "date", (F.try_divide("close", F.lag("close").over(w)) - 1).alias("ret"))
    last = bars.agg(F.max("date").alias("last"))  # one row
    ahead = bars.select("ticker").distinct().crossJoin(F.broadcast(last)).select("ticker", F.explode(F.array(*[bday_add(F.col("last"), k) for k in range(1, days + 1)])).alias("date"))
    return past.unionByName(ahead, allowMissingColumns=True)


def collapse(news: DataFrame, scores: list[str]) -> DataFrame:
    """One row a (ticker, date): scores weighted by headline count (plain mean where no row has one), summed counts, mean
    diagnostics, joined session label and source mix."""
    count = F.greatest(F.col("headline_count"), F.lit(0))
    parts = F.flatten(F.collect_list(F.split("source_mix", "[|]")))
    mix = F.array_sort(F.array_distinct(F.filter(F.transform(parts, F.trim), lambda x: (x != "") & (x != "none"))))
    sessions = F.array_sort(F.collect_set(F.when((F.trim("session_bucket") != "") & (F.trim("session_bucket") != "none"), F.trim("session_bucket"))))
    means = [F.avg(c).alias(c) for c in ("mapping_confidence", "novelty", "source_diversity")]
    out = news.groupBy("ticker", "date").agg(*[weighted_mean(F.col(c), count).alias(c) for c in scores], F.sum("headline_count").alias("headline_count"), *means, F.max("source_count").alias("source_count"), sessions.alias("__s"), mix.alias("__m"))
    return out.withColumn("session_bucket", session_label(F.col("__s"))).withColumn("source_mix", F.when(F.size("__m") == 0, "none").otherwise(F.array_join("__m", "|"))).drop("__s", "__m")


def news_panel(coverage: DataFrame, daily: DataFrame) -> DataFrame:
    """The coverage panel left joined with daily news; days without news are neutral."""
    out = coverage.join(daily, ["ticker", "date"], "left")
    scores = {c: 0.0 for c, t in daily.dtypes if c not in NEUTRAL and t == "double"}
    return out.fillna(NEUTRAL | scores).fillna({"source_mix": "none", "session_bucket": "none"})


def effective_weight(count: Column, relevance: Column, confidence: Column) -> Column:
    """count x relevance x confidence, both cut to 0..1; the count alone where that is not positive."""
    clip = lambda x: F.greatest(F.least(F.coalesce(x, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    n = F.greatest(F.coalesce(count, F.lit(0.0)), F.lit(0.0)).cast("double")
    base = n * clip(relevance) * clip(confidence)
    return F.when(base > 0, base).otherwise(n)


def signal_metrics(rows: DataFrame, by: list[str], total: Column | None = None) -> DataFrame:
    """rows (by..., signal, active, ret, source_diversity, source_count) -> coverage (active share of all rows, or of
    `total`), IC and absolute IC over active rows, share of active rows that have a return, mean diversity and sources,
    signal days. All zero without an active row."""
    on = F.coalesce(F.col("active"), F.lit(False))
    signal = F.when(on, F.col("signal"))
    mean = lambda c: F.coalesce(F.avg(F.when(on, F.col(c))), F.lit(0.0))
    out = rows.groupBy(*by).agg(F.count_if(on).alias("signal_days"), F.count(F.lit(1)).alias("__n"), safe_corr(signal, F.col("ret")).alias("ic"), F.count_if(on & F.col("ret").isNotNull()).alias("__both"), mean("source_diversity").alias("source_diversity_mean"), mean("source_count").alias("source_count_mean"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), b), F.lit(0.0))
    out = out.withColumn("coverage", share("signal_days", F.col("__n") if total is None else total)).withColumn("overlap_rate", share("__both", F.col("signal_days")))
    return out.withColumn("abs_ic", F.abs("ic")).drop("__n", "__both")


def with_signals(panel: DataFrame, weighting: str = "source_session_weighted") -> DataFrame:
    """The panel plus the chosen weighting's news_weight, signal and active flag."""
    weight = effective_weight(F.col("headline_count"), F.col(f"relevance_{weighting}"), F.col("mapping_confidence"))
    return panel.withColumn("news_weight", weight).withColumn("signal", F.col(f"sentiment_{weighting}")).withColumn("active", F.col("news_weight") > 0)


def lookback_rows(panel: DataFrame, windows: list[int]) -> DataFrame:
    """A row a look-back and panel row: weighted sentiment of the last rows of the ticker, active where they have weight."""
    w = Window.partitionBy("ticker").orderBy("date")
    kinds = []
    for n in windows:
        back = w.rowsBetween(1 - n, 0)
        total = F.sum("news_weight").over(back)
        kinds.append(F.struct(F.lit(n).alias("window_days"), F.try_divide(F.sum(F.col("signal") * F.col("news_weight")).over(back), F.when(total != 0, total)).alias("signal"), (total > 0).alias("active")))
    return panel.select("ret", "source_diversity", "source_count", F.array(*kinds).alias("k")).select("ret", "source_diversity", "source_count", F.inline("k"))


def decay_rows(panel: DataFrame, half_lives: list[int], least: float = 0.05) -> DataFrame:
    """A row a half-life and panel row: ratio of the exponential means of weighted sentiment and weight."""
    df = panel.withColumn("__x", F.col("signal") * F.col("news_weight"))
    df = ewms(df, "ticker", ["date"], [(v, f"__{c}{h}", 0.5 ** (1 / h)) for h in half_lives for v, c in (("__x", "num"), ("news_weight", "den"))])
    kinds = []
    for h in half_lives:
        den = F.col(f"__den{h}")
        kinds.append(F.struct(F.lit(h).alias("halflife_days"), F.try_divide(F.col(f"__num{h}"), F.when(den != 0, den)).alias("signal"), (den >= least).alias("active")))
    return df.select("ret", "source_diversity", "source_count", F.inline(F.array(*kinds)))


def feature_rows(panel: DataFrame) -> DataFrame:
    """A row a feature variant and panel row: sentiment, log headline count, novelty and source diversity of five rows."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-4, 0)
    total = F.sum("news_weight").over(w)
    mean5 = lambda c: F.try_divide(F.sum(F.col(c) * F.col("news_weight")).over(w), F.when(total != 0, total))
    kind = lambda name, x, on: F.struct(F.lit(name).alias("variant"), x.alias("signal"), on.alias("active"))
    kinds = F.array(kind("sentiment_1d", F.col("signal"), F.col("active")), kind("headline_count_1d", F.log1p("headline_count"), F.col("headline_count") > 0), kind("novelty_5d", mean5("novelty"), total > 0), kind("source_diversity_5d", mean5("source_diversity"), total > 0))
    return panel.select("ret", "source_diversity", "source_count", kinds.alias("k")).select("ret", "source_diversity", "source_count", F.inline("k"))


def weighting_rows(panel: DataFrame, weightings: dict[str, str], multi_source: bool = False) -> DataFrame:
    """A row a weighting (label -> column suffix) and panel row; multi_source: active only with two sources or more."""
    kinds = []
    for label, w in weightings.items():
        on = effective_weight(F.col("headline_count"), F.col(f"relevance_{w}"), F.col("mapping_confidence")) > 0
        kinds.append(F.struct(F.lit(label).alias("variant"), F.col(f"sentiment_{w}").alias("signal"), (on & (F.col("source_count") >= 2) if multi_source else on).alias("active")))
    return panel.select("ret", "source_diversity", "source_count", F.inline(F.array(*kinds)))


def bucket_metrics(panel: DataFrame) -> DataFrame:
    """(dimension, bucket, metrics) by session, source mix, both, and source diversity, in one pass of exploded buckets; the
    coverage is of the whole panel."""
    total = panel.agg(F.count(F.lit(1)).alias("__total"))  # one row
    pair = lambda d, b, on=None: F.struct(F.lit(d).alias("dimension"), b.alias("bucket"), (F.col("active") if on is None else F.col("active") & on).alias("active"))
    one = F.when(F.col("source_count") <= 1, "single_source").when(F.col("source_count") >= 2, "multi_source")
    kinds = F.array(pair("session_bucket", F.col("session_bucket")), pair("source_mix", F.col("source_mix")), pair("source_session", F.concat_ws("::", "source_mix", "session_bucket")), pair("diversity", one))
    rows = panel.crossJoin(F.broadcast(total)).select("ret", "signal", "source_diversity", "source_count", "__total", kinds.alias("k"))
    rows = rows.select("ret", "signal", "source_diversity", "source_count", "__total", F.inline("k")).where("bucket is not null and bucket not like 'none%' and bucket <> ''")
    return signal_metrics(rows, ["dimension", "bucket", "__total"], F.col("__total")).drop("__total")


def best_entry(metrics: DataFrame, by: list[str], name: str) -> DataFrame:
    """Of each group the entry with the largest (absolute IC, overlap, coverage); ties take the first by name."""
    w = Window.partitionBy(*by).orderBy(F.desc("abs_ic"), F.desc("overlap_rate"), F.desc("coverage"), name)
    return metrics.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def improvement(modes: DataFrame, better: str, others: list[str]) -> DataFrame:
    """modes (variant, abs_ic, overlap_rate): deltas of `better` against each of the others and whether it improves."""
    pick = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    one = modes.agg(*[pick(v, c).alias(f"{c}__{v}") for v in (better, *others) for c in ("abs_ic", "overlap_rate")])
    gap = lambda c, v: F.col(f"{c}__{better}") - F.col(f"{c}__{v}")
    rows = F.array(*[F.struct(F.lit(v).alias("against"), gap("abs_ic", v).alias("abs_ic_delta"), gap("overlap_rate", v).alias("overlap_rate_delta"), ((gap("abs_ic", v) > 0) & (gap("overlap_rate", v) > 0)).alias("improves_joint")) for v in others])
    return one.select(F.inline(rows))


def source_advantage(buckets: DataFrame, single: str) -> DataFrame:
    """One row: a single source against the best mix of several sources, and what the advantage rests on."""
    mixes = buckets.where("dimension = 'source_mix'")
    best = best_entry(mixes.where("bucket like '%|%'"), ["dimension"], "bucket")
    g = mixes.where(F.col("bucket") == single).agg(F.max("abs_ic").alias("ga"), F.max("overlap_rate").alias("go"), F.max("coverage").alias("gc"))
    m = best.agg(F.max("bucket").alias("best_multi_source"), F.max("abs_ic").alias("ma"), F.max("overlap_rate").alias("mo"), F.max("coverage").alias("mc"))
    gap = lambda a, b: F.coalesce(F.col(a), F.lit(0.0)) - F.coalesce(F.col(b), F.lit(0.0))
    out = g.crossJoin(m).select("best_multi_source", gap("ga", "ma").alias("abs_ic_advantage"), gap("go", "mo").alias("overlap_advantage"), gap("gc", "mc").alias("coverage_advantage"))
    ahead = F.col("abs_ic_advantage") > 0
    reason = F.when(ahead & (F.col("overlap_advantage") > 0.05), "overlap_advantage").when(ahead & (F.col("coverage_advantage") > 0.002), "coverage_advantage").when(ahead & F.col("best_multi_source").isNotNull(), "multi_source_dilution").otherwise("mixed_or_no_clear_advantage")
    return out.withColumn("dominant_reason", reason)


def mixed_session(buckets: DataFrame) -> DataFrame:
    """One row: the mixed session against the best other session."""
    s = buckets.where("dimension = 'session_bucket'")
    best = best_entry(s.where("bucket not in ('mixed', 'none')"), ["dimension"], "bucket").agg(F.max("bucket").alias("best_other"), F.max("abs_ic").alias("oa"), F.max("overlap_rate").alias("oo"))
    m = s.where("bucket = 'mixed'").agg((F.count(F.lit(1)) > 0).alias("present"), F.max("abs_ic").alias("ma"), F.max("overlap_rate").alias("mo"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return m.crossJoin(best).select("present", "best_other", (zero("ma") - zero("oa")).alias("abs_ic_advantage"), (zero("mo") - zero("oo")).alias("overlap_advantage"))


def across_runs(metrics: DataFrame, runs: DataFrame, bucket: str, value: str) -> DataFrame:
    """metrics (run_id, bucket, value), runs (run_id) -> distribution by bucket over all runs; a run without the bucket
    counts as 0."""
    names = metrics.select(bucket).distinct()
    grid = runs.select("run_id").distinct().crossJoin(names)  # runs x a few names
    full = grid.join(metrics.select("run_id", bucket, value), ["run_id", bucket], "left").fillna({value: 0.0})
    return full.groupBy(bucket).agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
