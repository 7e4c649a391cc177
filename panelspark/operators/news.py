"""News: text to items to a daily signal, and its utility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.letters import capitals
from panelspark.functions.stats import ewm, safe_corr, weighted_mean

#: Entities of the markup.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
TOKEN = "[A-Za-z']+"


def plain_text(html: Column) -> Column:
    out = F.regexp_replace(html, "<[^>]+>", " ")
    for name, ch in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(ch))
    return F.trim(out)


def lexicon_sentiment(text: Column, positive: list[str], negative: list[str]) -> Column:
    """(positive - negative) / (positive + negative) hits of the lexicons; 0 without a hit."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), 1)
    hits = lambda words: F.size(F.filter(tokens, lambda t: t.isin(*words)))
    p, n = hits(positive), hits(negative)
    return F.coalesce(F.try_divide((p - n).cast("double"), p + n), F.lit(0.0))


def relevance(text: Column, name: Column) -> Column:
    """0.55 + 0.20 * min(hits, 2) + 0.40 * min(hits / tokens, 0.25), at most 1. Hits are of capitals, one letter for one."""
    upper, name = capitals(text), capitals(name)
    hits = F.coalesce(F.try_divide(F.length(upper) - F.length(F.replace(upper, name, F.lit(""))), F.length(name)), F.lit(0)).cast("int")
    tokens = F.greatest(F.regexp_count(text, F.lit(TOKEN)), F.lit(1))
    base = F.element_at(F.array(F.lit(0.55), F.lit(0.75), F.lit(0.95)), F.least(hits, F.lit(2)) + 1)  # sums of decimals
    return F.least(F.lit(1.0), base + 0.40 * F.least(hits / tokens, F.lit(0.25)))


def headline_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]", " "), " +", " "))


def alias_dimension(names: DataFrame, suffixes: list[str], least: int = 4) -> DataFrame:
    """names (ticker, name) -> (alias, ticker): the ticker itself, the whole name as a headline key, and its words of at
    least `least` letters that are no company suffix."""
    key = headline_key(F.col("name"))
    words = F.filter(F.split(key, " "), lambda w: (F.length(w) >= least) & ~w.isin(*suffixes))
    every = F.array_union(F.array(F.lower("ticker"), key), words)
    return names.select(F.explode(every).alias("alias"), "ticker").where("alias <> ''").distinct()


def phrase_matches(items: DataFrame, aliases: DataFrame, longest: int = 3) -> DataFrame:
    """items (item_id, body) x aliases (alias, ticker) -> (item_id, ticker, hits): bodies are spread into runs of one to
    `longest` words and joined on the phrase, an equi-join instead of a containment test."""
    items = items.select("item_id", F.split(headline_key(F.col("body")), " ").alias("words"))
    words = F.col("words")

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))

    grams = F.flatten(F.array(*[runs(n) for n in range(1, longest + 1)]))
    rows = items.select("item_id", F.explode(grams).alias("alias"))
    return rows.join(aliases, "alias").groupBy("item_id", "ticker").agg(F.count_distinct("alias").alias("hits"))


def mapping_confidence(hits: Column) -> Column:
    return F.least(F.lit(0.95), 0.62 + 0.12 * F.least(hits, F.lit(2)))


def with_fallback(items: DataFrame, matches: DataFrame, feed: str, confidence: float = 0.55) -> DataFrame:
    """Items with their matched tickers, or the feed's ticker at a low confidence where nothing matched."""
    out = items.join(matches.withColumn("confidence", mapping_confidence(F.col("hits"))).drop("hits").withColumnRenamed("ticker", "__t"), "item_id", "left")
    return out.withColumn("ticker", F.coalesce("__t", feed)).withColumn("confidence", F.coalesce("confidence", F.lit(confidence))).drop("__t")


def dedupe_items(items: DataFrame) -> DataFrame:
    """One item a (headline, time, source): the most relevant, then the smallest id."""
    w = Window.partitionBy("ticker", "headline_key", "published_at", "source_name").orderBy(F.desc("relevance_score"), "item_id")
    return items.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def novelty(items: DataFrame) -> DataFrame:
    """1 / (1 + earlier items of the same headline for the ticker)."""
    w = Window.partitionBy("ticker", "headline_key").orderBy("published_at", "item_id")
    return items.withColumn("novelty", 1.0 / F.row_number().over(w))


def daily_news(items: DataFrame) -> DataFrame:
    """(ticker, date): counts, plain and relevance-weighted sentiment, novelty, sources and their sorted mix."""
    return items.groupBy("ticker", "date").agg(
        F.count(F.lit(1)).alias("headline_count"), F.avg("sentiment_score").alias("sentiment"), weighted_mean(F.col("sentiment_score"), F.col("relevance_score")).alias("sentiment_weighted"),
        F.avg("relevance_score").alias("relevance"), F.avg("novelty").alias("novelty"), F.count_distinct("source_name").alias("source_count"), F.array_join(F.array_sort(F.collect_set("source_name")), "|").alias("source_mix"),
    )


def session_label(sessions: Column) -> Column:
    """One value, `mixed` or `none` of a collected set."""
    return F.when(F.size(sessions) == 0, "none").when(F.size(sessions) == 1, F.get(sessions, F.lit(0))).otherwise("mixed")


def source_breakdown(items: DataFrame) -> DataFrame:
    """(ticker, date, breakdown map source::session -> (articles, weight, sentiment sum))."""
    rows = items.groupBy("ticker", "date", F.concat_ws("::", "source_name", "session").alias("combo")).agg(F.count(F.lit(1)).alias("articles"), F.sum("relevance_score").alias("weight"), F.sum(F.col("relevance_score") * F.col("sentiment_score")).alias("sentiment_sum"))
    return rows.groupBy("ticker", "date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("combo", F.struct("articles", "weight", "sentiment_sum").alias("v"))))).alias("breakdown"))


def signal_windows(daily: DataFrame, lookback: int = 5, half_life: float = 5.0) -> DataFrame:
    """Weighted sentiment of the last rows, its exponential mean, and the z-score of the count (at least five rows)."""
    w = Window.partitionBy("ticker").orderBy("date")
    back, month = w.rowsBetween(1 - lookback, 0), w.rowsBetween(-19, 0)
    df = daily.withColumn("sentiment_nd", F.coalesce(F.try_divide(F.sum(F.col("sentiment") * F.col("headline_count")).over(back), F.sum("headline_count").over(back)), F.lit(0.0)))
    sd = F.stddev_samp("headline_count").over(month)
    z = F.when(F.count("headline_count").over(month) >= 5, F.try_divide(F.col("headline_count") - F.avg("headline_count").over(month), F.when(sd > 0, sd)))
    df = df.withColumn("count_z", F.coalesce(z, F.lit(0.0)))
    return ewm(df, "ticker", ["date"], "sentiment", "sentiment_decay", 0.5 ** (1 / half_life))


def utility(df: DataFrame, by: list[str], signal: str, ret: str) -> DataFrame:
    """Coverage-side metrics of a signal: rows, IC, absolute IC, share of rows whose signs agree."""
    ok = df.where(F.col(signal).isNotNull() & F.col(ret).isNotNull())
    agree = F.when(F.col(signal) != 0, (F.signum(signal) == F.signum(ret)).cast("double"))
    out = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col(signal), F.col(ret)).alias("ic"), F.coalesce(F.avg(agree), F.lit(0.0)).alias("overlap_rate"))
    return out.withColumn("abs_ic", F.abs("ic"))


def lookback_sweep(daily: DataFrame, ret: str, windows: list[int]) -> DataFrame:
    """Utility of the sentiment mean over each look-back, one pass: a column a window, then long form."""
    w = Window.partitionBy("ticker").orderBy("date")
    df = daily.select("ticker", "date", F.col(ret).alias("ret"), *[F.avg("sentiment").over(w.rowsBetween(1 - n, 0)).alias(str(n)) for n in windows])
    return utility(df.unpivot(["ret"], [str(n) for n in windows], "window", "signal"), ["window"], "signal", "ret")


def floor_weights(df: DataFrame, by: list[str], raw: str, floor: float, out: str = "weight") -> DataFrame:
    """Weights of each group that sum to 1 with none under the floor: rising raw values; the smallest prefix is fixed at the
    floor such that the scaled rest clears it. Uniform where the floor leaves no room; null where all are 0."""
    w = Window.partitionBy(*by)
    up = w.orderBy(raw, *[c for c in df.columns if c not in (*by, raw)])
    df = df.withColumn("__v", F.greatest(F.col(raw), F.lit(0.0))).withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__k", F.row_number().over(up) - 1)
    rest = F.sum("__v").over(up.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("__scale", F.try_divide(1 - F.col("__k") * floor, rest)).withColumn("__ok", F.col("__v") * F.col("__scale") >= floor)
    df = df.withColumn("__first", F.min(F.when(F.col("__ok"), F.col("__k"))).over(w))
    df = df.withColumn("__use", F.max(F.when(F.col("__k") == F.col("__first"), F.col("__scale"))).over(w))
    value = F.when(F.sum("__v").over(w) <= 0, F.lit(None)).when(F.lit(floor) * F.col("__n") >= 1, 1.0 / F.col("__n")).when(F.col("__k") < F.col("__first"), F.lit(floor)).otherwise(F.col("__v") * F.col("__use"))
    return df.withColumn(out, value).drop("__v", "__n", "__k", "__scale", "__ok", "__first", "__use")


def combo_scores(moments: DataFrame, shrinkage: float, least_samples: int) -> DataFrame:
    """moments (combo, n, sx, sy, sxx, syy, sxy) -> absolute IC, its global mean by samples, and the shrunk score."""
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    ic = F.when((F.col("n") < 2) | (vx <= 1e-12) | (vy <= 1e-12), 0.0).otherwise(F.try_divide(cov, F.sqrt(F.abs(vx)) * F.sqrt(F.abs(vy))))
    df = moments.withColumn("abs_ic", F.abs(ic))
    total = df.agg(F.try_divide(F.sum(F.col("abs_ic") * F.col("n")), F.sum("n")).alias("global_score"), F.sum("n").alias("__total"))
    df = df.crossJoin(F.broadcast(total))  # one row
    share = F.col("n") / (F.col("n") + shrinkage)
    return df.select("combo", "n", "abs_ic", "global_score", (share * F.col("abs_ic") + (1 - share) * F.col("global_score")).alias("score"), F.when(F.col("__total") < least_samples, "insufficient_total_samples").alias("invalid_reason"))
