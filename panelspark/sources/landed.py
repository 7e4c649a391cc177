"""Landed payload files (JSON, CSV, RSS) to rows. Schemas are explicit; nothing is inferred; bad text becomes null."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.calendar import bday_ord, is_business_day, ord_bday
from panelspark.operators.news import headline_key, plain_text

QUOTE = "timestamp array<bigint>, open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>"
ROWS = "results array<struct<t: bigint, o: double, h: double, l: double, c: double, v: double>>"
FACTS = "map<string, struct<units: map<string, array<struct<start: string, end: string, filed: string, val: double>>>>>"


def column_quotes(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(ticker, payload of parallel arrays) -> bars; rows with a null price go."""
    x = df.select("ticker", F.from_json(payload, QUOTE).alias("q"))
    x = x.select("ticker", F.explode(F.arrays_zip(*[F.col(f"q.{c}").alias(c) for c in ("timestamp", "open", "high", "low", "close", "volume")])).alias("r"))
    x = x.select("ticker", F.timestamp_seconds("r.timestamp").alias("timestamp_utc"), "r.open", "r.high", "r.low", "r.close", "r.volume")
    return x.dropna(subset=["timestamp_utc", "open", "high", "low", "close"])


def row_quotes(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(ticker, payload results[]) -> bars."""
    x = df.select("ticker", F.explode(F.from_json(payload, ROWS)["results"]).alias("r"))
    return x.select("ticker", F.timestamp_millis("r.t").alias("timestamp_utc"), F.col("r.o").alias("open"), F.col("r.h").alias("high"), F.col("r.l").alias("low"), F.col("r.c").alias("close"), F.col("r.v").alias("volume"))


def keyed_quotes(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(ticker, payload date -> map of text values) -> bars."""
    x = df.select("ticker", F.explode(F.from_json(payload, "map<string, map<string, string>>")).alias("day", "m"))
    value = lambda c: F.col("m")[c].try_cast("double").alias(c)
    return x.select("ticker", F.try_to_timestamp("day").alias("timestamp_utc"), *[value(c) for c in ("open", "high", "low", "close", "volume")]).dropna(subset=["timestamp_utc", "close"])


def tick_bars(ticks: DataFrame, key: str = "ticker", ts: str = "ts", price: str = "price", volume: str = "volume") -> DataFrame:
    """Ticks to daily bars: first, highest, lowest, last price; last volume that is not null."""
    have = F.col(volume).isNotNull()
    g = ticks.where(F.col(price).isNotNull()).groupBy(key, F.to_date(ts).alias("date"))
    return g.agg(F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.max_by(volume, F.when(have, F.col(ts))).alias("volume"))


def csv_series(spark: SparkSession, path: str, series_id: str) -> DataFrame:
    """date,value files with . for missing; a value is known a day later."""
    x = spark.read.schema("date string, value string").option("header", True).option("nullValue", ".").csv(path)
    d = F.to_date(F.try_to_timestamp("date"))
    return x.select(F.lit(series_id).alias("series_id"), d.alias("date"), F.col("value").try_cast("double").alias("value"), F.date_add(d, 1).alias("available_at")).dropna(subset=["date", "value"])


def observations(df: DataFrame, payload: str = "payload") -> DataFrame:
    x = df.select("series_id", F.explode(F.from_json(payload, "observations array<struct<date: string, value: string>>")["observations"]).alias("o"))
    return x.select("series_id", F.to_date(F.try_to_timestamp("o.date")).alias("date"), F.col("o.value").try_cast("double").alias("value")).dropna()


def proxy_bars(closes: DataFrame, volume: float = 1_000_000.0) -> DataFrame:
    """Close-only series on a weekday calendar: gaps take the last close, open is the previous close, high and low lie half
    of the absolute move beyond (at most a tenth). Gaps are filled between neighbours; no calendar table is joined."""
    w = Window.partitionBy("ticker").orderBy("date")
    x = closes.where(is_business_day(F.col("date"))).select("ticker", "date", "close").withColumn("o", bday_ord(F.col("date"))).withColumn("next", F.lead("o").over(w))
    x = x.withColumn("o", F.explode(F.sequence("o", F.greatest(F.coalesce(F.col("next") - 1, F.col("o")), F.col("o"))))).withColumn("date", ord_bday(F.col("o")))
    x = x.withColumn("open", F.coalesce(F.lag("close").over(w), F.col("close")))
    half = 0.5 * F.least(F.abs(F.try_divide(F.col("close") - F.col("open"), F.col("open"))), F.lit(0.1))
    return x.select("ticker", "date", "open", (F.greatest("open", "close") * (1 + half)).alias("high"), (F.least("open", "close") * (1 - half)).alias("low"), "close", F.lit(volume).alias("volume"))


def rss_items(spark: SparkSession, path: str, source: str) -> DataFrame:
    """RSS files to items; entries without a readable time go."""
    x = spark.read.format("xml").option("rowTag", "item").schema("title string, description string, pubDate string, source string").load(path)
    ts = F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]+, ", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    body = F.trim(F.concat_ws(" ", plain_text(F.coalesce("title", F.lit(""))), plain_text(F.coalesce("description", F.lit("")))))
    x = x.select(ts.alias("published_at"), body.alias("body"), F.coalesce(F.col("source"), F.lit(source)).alias("source_name"))
    return x.withColumn("headline_key", headline_key(F.col("body"))).where("published_at is not null")


def company_facts(df: DataFrame, unit_prefix: str, payload: str = "payload") -> DataFrame:
    """(ticker, payload concept -> units) -> (ticker, concept, unit, start, end, filed, val) of units with the prefix."""
    x = df.select("ticker", F.explode(F.from_json(payload, FACTS)).alias("concept", "c")).select("ticker", "concept", F.explode("c.units").alias("unit", "v"))
    x = x.where(F.col("unit").startswith(unit_prefix)).select("ticker", "concept", "unit", F.explode("v").alias("v"))
    day = lambda c: F.to_date(F.try_to_timestamp(f"v.{c}")).alias(c)
    return x.select("ticker", "concept", "unit", day("start"), day("end"), day("filed"), "v.val")


def padded_ids(df: DataFrame, payload: str = "payload") -> DataFrame:
    x = df.select(F.explode(F.from_json(payload, "map<string, struct<ticker: string, id: bigint>>")).alias("k", "v"))
    return x.select(F.upper("v.ticker").alias("ticker"), F.lpad(F.col("v.id").cast("string"), 10, "0").alias("id"))


def first_source(union: DataFrame, keys: list[str], priority: str, preferred: int = 1) -> DataFrame:
    """Of landed sources the first with data wins, by key; fallback_used where it is not the preferred one, and the number of
    sources tried up to it."""
    w = Window.partitionBy(*keys).orderBy(priority)
    x = union.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return x.withColumn("fallback_used", F.col(priority) > preferred).withColumn("attempts", F.col(priority) - preferred + 1)


def routed(tickers: DataFrame, sources: dict[str, DataFrame], crypto: list[str]) -> DataFrame:
    """Each ticker's rows from the source of its asset class (a class without a source has none), in one table."""
    t = tickers.select("ticker", asset_class(F.col("ticker"), crypto).alias("asset_class"))
    out = None
    for name, df in sources.items():
        one = df.join(t.where(F.col("asset_class") == name), "ticker")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def asset_class(ticker: Column, crypto: list[str]) -> Column:
    return F.when(ticker.isin(*crypto), "crypto").when(ticker.endswith(".T"), "tokyo").otherwise("equity")


def covering_snapshot(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """catalog (resource, first, last, fetched_at, path) x requests (request, resource, first, last): the narrowest, then
    freshest snapshot that covers the request."""
    c = catalog.select("resource", F.col("first").alias("c_first"), F.col("last").alias("c_last"), "fetched_at", "path")
    x = requests.join(c, "resource").where((F.col("c_first") <= F.col("first")) & (F.col("c_last") >= F.col("last")))
    w = Window.partitionBy("request").orderBy(F.date_diff("c_last", "c_first"), F.desc("fetched_at"), "path")
    return x.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("request", "resource", "path")


def provenance(df: DataFrame, by: list[str], flag: str, origin: str) -> DataFrame:
    return df.groupBy(*by).agg(F.bool_or(flag).alias("any_flag"), F.array_join(F.array_sort(F.collect_set(origin)), "|").alias("origins"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in spark.checkpoint.dir, which all executors share. Where that is unset a temporary folder serves a local
    master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="panelspark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_artifacts(df: DataFrame, path: str, by: str = "run_date") -> None:
    """JSON by folders of `by` (a date, or calendar.iso_week as week_id). Only folders that df has rows for are written anew, so a
    rerun leaves one copy and other days stay."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(path)


def read_artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def union_landed(spark: SparkSession, sources: dict[str, str], schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines of several sources (name -> path) as (rows with `source`, status). A source that is not there, and lines that
    are no JSON of the schema, cost their own rows only. status: (source, status, rows, broken): ok, partial where some lines
    are broken, failed where all are, missing where there is no path, and empty without lines."""
    union, missing = None, []
    for name, path in sources.items():
        try:
            lines = spark.read.text(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(name)
            continue
        parsed = F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
        one = lines.select(parsed.alias("x")).select("x.*", F.lit(name).alias("source"))
        union = one if union is None else union.unionByName(one)
    if union is None:
        union = spark.createDataFrame([], f"{schema}, _broken string, source string")
    found = union.groupBy("source").agg(F.count_if(F.col("_broken").isNull()).alias("rows"), F.count("_broken").alias("broken"))
    names = spark.createDataFrame([(n, n in missing) for n in sources], "source string, missing boolean")  # a row a source
    status = names.join(found, "source", "left").fillna({"rows": 0, "broken": 0})
    kind = F.when(F.col("missing"), "missing").when(F.col("rows") + F.col("broken") == 0, "empty").when(F.col("rows") == 0, "failed").when(F.col("broken") > 0, "partial").otherwise("ok")
    return union.where("_broken is null").drop("_broken"), status.select("source", kind.alias("status"), "rows", "broken")


def write_table(df: DataFrame, path: str) -> None:
    """A Parquet table, written anew."""
    df.write.mode("overwrite").parquet(path)


def latest_artifacts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("kind").agg(F.max_by("path", F.struct("created_at", "path")).alias("path"), F.max("created_at").alias("created_at"))


def common_window(files: DataFrame) -> DataFrame:
    """files (source, ticker, date) -> (ticker, start, end): tickers that all sources have, and the days they share."""
    n = files.agg(F.count_distinct("source").alias("n"))
    per = files.groupBy("source", "ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    g = per.groupBy("ticker").agg(F.count(F.lit(1)).alias("sources"), F.max("a").alias("start"), F.min("b").alias("end"))
    return g.crossJoin(F.broadcast(n)).where((F.col("sources") == F.col("n")) & (F.col("start") <= F.col("end"))).select("ticker", "start", "end")
