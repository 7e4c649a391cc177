"""Fixed-schema tables: required columns, coercion, defaults, first of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first in the order, which ends with all other columns so that it is total."""
    rest = [c for c, t in df.dtypes if c not in (*keys, *order) and not t.startswith("map")]
    w = Window.partitionBy(*keys).orderBy(*order, *rest)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Doubles; text that is no number and NaN become null."""
    for c in columns:
        x = F.col(c).try_cast("double")
        df = df.withColumn(c, F.when(~F.isnan(x), x))
    return df


def defaults(df: DataFrame, values: dict) -> DataFrame:
    """Missing optional columns, and nulls in them, take defaults."""
    for c, v in values.items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v))
    return df


def provenance(df: DataFrame, fetched: Column) -> DataFrame:
    """source, fetched_at, data_age_hours and stale_data_flag with their defaults."""
    df = df.withColumn("fetched_at", F.coalesce(F.col("fetched_at"), fetched) if "fetched_at" in df.columns else fetched)
    return defaults(numbers(df, ["data_age_hours"]) if "data_age_hours" in df.columns else df, {"source": "unknown", "data_age_hours": 0.0, "stale_data_flag": False})


PROVENANCE = ["source", "fetched_at", "data_age_hours", "stale_data_flag"]


def bars(df: DataFrame) -> DataFrame:
    keep = ["ticker", "timestamp_utc", "open", "high", "low", "close", "volume"]
    require(df, keep)
    df = provenance(numbers(df, keep[2:]), F.col("timestamp_utc")).dropna(subset=keep)
    return first_rows(df.select(*keep, *PROVENANCE), ["ticker", "timestamp_utc"], [])


def macro(df: DataFrame) -> DataFrame:
    keep = ["series_id", "date", "value", "available_at"]
    require(df, keep)
    df = defaults(numbers(df, ["value"]).dropna(subset=keep), {"source": "unknown"})
    return first_rows(df.select(*keep, "source"), ["series_id", "date"], ["available_at"])


def news(df: DataFrame) -> DataFrame:
    """Weighting variants take the plain scores where they are missing; diagnostics take 0, labels `none`."""
    keep = ["ticker", "published_at", "available_at", "sentiment_score", "relevance_score", "headline_count"]
    require(df, keep)
    df = numbers(df, keep[3:])
    variants = []
    for base in ("sentiment_score", "relevance_score"):
        for kind in ("unweighted", "source_weighted", "session_weighted", "source_session_weighted"):
            c = f"{base}_{kind}"
            variants.append(c)
            df = df.withColumn(c, F.coalesce(F.col(c).try_cast("double"), F.col(base)) if c in df.columns else F.col(base))
    zeros = ["mapping_confidence", "novelty_score", "source_diversity", "source_count"]
    df = defaults(numbers(df, [c for c in zeros if c in df.columns]), {c: 0.0 for c in zeros} | {"source_mix": "none", "session_bucket": "none", "source_session_breakdown": "{}"})
    df = provenance(df, F.col("available_at")).dropna(subset=keep)
    return first_rows(df.select(*keep, *variants, *zeros, "source_mix", "session_bucket", "source_session_breakdown", *PROVENANCE), ["ticker", "available_at"], [])


def fundamentals(df: DataFrame) -> DataFrame:
    ratios = ["revenue_growth", "earnings_yield", "debt_to_equity", "profitability"]
    keep = ["ticker", "report_date", "available_at", *ratios]
    require(df, keep)
    df = provenance(numbers(df, ratios), F.col("available_at")).dropna(subset=keep)
    return first_rows(df.select(*keep, *PROVENANCE), ["ticker", "available_at"], [])


def sector_map(df: DataFrame) -> DataFrame:
    require(df, ["ticker", "sector"])
    df = provenance(df, F.current_timestamp()).dropna(subset=["ticker", "sector"])
    return first_rows(df.select("ticker", "sector", *PROVENANCE), ["ticker"], ["sector"])


def clean_tickers(df: DataFrame, ticker: str = "ticker", pos: str = "pos") -> DataFrame:
    """Trimmed, upper-cased, once each in order of first appearance."""
    x = df.withColumn("t", F.upper(F.trim(ticker))).where("t <> ''")
    return x.groupBy(F.col("t").alias(ticker)).agg(F.min(pos).alias(pos))


def violations(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """(id, rule) for each row that breaks a named rule; a null condition breaks it."""
    hits = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.col(id_col), F.explode(hits).alias("rule"))


def quality_summary(df: DataFrame, key: str, date: str, count: str, stale: str, sources: str) -> DataFrame:
    return df.agg(F.count_distinct(key).alias("tickers"), F.count_distinct(date).alias("days"), F.sum(count).alias("articles"), F.avg(F.col(count).isNull().cast("double")).alias("missing_rate"), F.avg(F.col(stale).cast("double")).alias("stale_rate"), F.avg((F.col(sources) > 1).cast("double")).alias("multi_source_rate"))


def evolve(df: DataFrame, schema: dict[str, tuple[str, object]]) -> DataFrame:
    """The ledger with all columns of the schema: missing ones and nulls take typed defaults."""
    return df.select(*[F.coalesce(F.col(c).cast(t), F.lit(v).cast(t)).alias(c) if c in df.columns else F.lit(v).cast(t).alias(c) for c, (t, v) in schema.items()])


def source_summary(df: DataFrame, by: list[str], stale: str, session: str, diversity: str) -> DataFrame:
    """By source: records, stale rate, mean source diversity and a map session -> records."""
    rows = df.groupBy(*by, F.coalesce(session, F.lit("none")).alias("__s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(stale).cast("double")).alias("st"), F.sum(diversity).alias("dv"), F.count(diversity).alias("dn"))
    out = rows.groupBy(*by).agg(F.sum("n").alias("record_count"), F.sum("st").alias("st"), F.sum("dv").alias("dv"), F.sum("dn").alias("dn"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("__s", "n")))).alias("session_counts"))
    return out.select(*by, "record_count", (F.col("st") / F.col("record_count")).alias("stale_rate"), F.coalesce(F.try_divide("dv", "dn"), F.lit(0.0)).alias("source_diversity_mean"), "session_counts")
