"""The driver tables as panels. The same SQL text runs on Spark and, as common table expressions, in the oracle."""

from __future__ import annotations

import functools
import re

from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from panelspark.sources.landed import shared_folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "px": """select p_brand as ticker, cast(l_shipdate as date) as date, SEQ(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) as seq,
        l_extendedprice/l_quantity as price, l_quantity as qty, l_discount, l_tax, p_type from lineitem join part on l_partkey = p_partkey""",
    "daily_bars": "select ticker, date, min_by(price,seq) as open, max(price) as high, min(price) as low, max_by(price,seq) as close, sum(qty) as volume from px group by ticker, date",
    "macro": """select o_orderpriority as series_id, cast(o_orderdate as date) as date, avg(o_totalprice) as value,
        cast(cast(o_orderdate as date) + interval 1 day as date) as available_at from orders group by o_orderpriority, cast(o_orderdate as date)""",
    "sector_map": """select ticker, sector from (select ticker, p_type as sector, row_number() over (partition by ticker order by count(*) desc, p_type) as rn
        from px group by ticker, p_type) t where rn = 1""",
    "fundamentals": """select ticker, cast(q + interval 3 month - interval 1 day as date) as report_date, cast(q + interval 3 month + interval 2 day as date) as available_at,
        revenue, profit, debt, equity from (select ticker, cast(date_trunc('quarter',date) as date) as q, sum(price*qty) as revenue, sum(price*qty*(1-l_discount)) as profit,
        sum(price*qty*l_tax) as debt, sum(price) as equity from px group by ticker, cast(date_trunc('quarter',date) as date)) t""",
    "news_items": """select event_id as item_id, concat('Brand#', cast(user_id % 25 + 1 as string)) as ticker, ts - interval 9496 day as published_at, event_type as source_name,
        concat(event_type,' ',cast(user_id % 7 as string)) as headline_key, greatest(-1.0, least(1.0, (value-50.0)/50.0)) as sentiment_score, JSONK/100.0 as relevance_score from events""",
    "mapped": """select item_id, ticker, published_at, cast(case when extract(DOWX from published_at) = 6 then published_at + interval 2 day when extract(DOWX from published_at) = 7 then published_at + interval 1 day else published_at end as date) as date,
        case when hour(published_at) < 9 then 'pre_market' when hour(published_at) < 16 then 'regular' else 'post_market' end as session, source_name, concat(source_name, '_', cast(item_id % 2 as string)) as source_key, headline_key,
        sentiment_score, relevance_score, cast(0.55 as double) + cast(0.05 as double) * (item_id % 9) as mapping_confidence from news_items""",
    "scores": """select ticker, date, exp(10*a)/(exp(10*a)+exp(10*b)+exp(c)) as prob_down, exp(10*b)/(exp(10*a)+exp(10*b)+exp(c)) as prob_flat,
        exp(c)/(exp(10*a)+exp(10*b)+exp(c)) as prob_up from (select ticker, date, avg(l_discount) as a, avg(l_tax) as b, avg(qty)/50.0 as c from px group by ticker, date) t""",
    "runs": """select o_orderpriority as ticker_set, cast(date_trunc('week',o_orderdate) as date) as as_of_date, count(*) as n, avg(o_totalprice) as metric,
        max(case when o_orderstatus='P' then 1 else 0 end) as flag from orders group by o_orderpriority, cast(date_trunc('week',o_orderdate) as date)""",
    "policy_runs": """select ticker_set as key, as_of_date as date, cast(n as bigint) as n, case n % 4 when 0 then 'low_vol' when 1 then 'transition' when 2 then 'high_vol' else 'unknown' end as regime, cast((n * 37) % 101 as double) / 101 as state_probability,
        cast(n % 7 as double) / 40 as transition_rate, n % 5 = 0 as shift_flag, cast((n * 7) % 11 as double) / 10 as pbo, cast(n % 13 as double) / 100 as ece, cast(n % 6 as bigint) as breaches, n % 3 = 0 as competition from runs""",
}
#: What the panels over a ticker's days are made of in Spark: one pass of the facts, written, for both. The oracle uses VIEWS.
DAYS = """select ticker, date, min_by(price,seq) as open, max(price) as high, min(price) as low, max_by(price,seq) as close, sum(qty) as volume,
    avg(l_discount) as a, avg(l_tax) as b, avg(qty)/50.0 as c from px group by ticker, date"""
OF_DAYS = {
    "daily_bars": "select ticker, date, open, high, low, close, volume from {days}",
    "scores": re.sub(r" from \(select .*", " from {days}", VIEWS["scores"], flags=re.S),
}
NEEDS = {"daily_bars": ["px"], "sector_map": ["px"], "fundamentals": ["px"], "scores": ["px"], "mapped": ["news_items"], "policy_runs": ["runs"]}
#: What the two dialects call the same thing.
SPARK = {"JSONK": "cast(get_json_object(props,'$.k') as double)", "SEQ(": "struct(", "DOWX": "dow_iso"}
DUCK = {"JSONK": "cast(json_extract_string(props,'$.k') as double)", "SEQ(": "row(", "DOWX": "isodow"}
#: Aggregated panels that queries use several times: computed once and kept in memory, or on disk where that is full.
KEPT = ("macro", "sector_map", "fundamentals", "runs")
#: Frames that one query call shares; the next call starts anew (see scoped).
_shared: dict[tuple, DataFrame] = {}


def scoped(query):
    """A query that shares frames within one call only: what an earlier call has persisted is given back first, and every call
    reads its tables again. A result of an earlier call stays right; it is computed anew where it is used again."""

    @functools.wraps(query)
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        for df in _shared.values():
            try:
                df.unpersist()
            except Py4JError:  # of a session that has ended
                pass
        _shared.clear()
        return query(spark, sf_dir)

    return call


def said(sql: str, dialect: dict[str, str]) -> str:
    for name, text in dialect.items():
        sql = sql.replace(name, text)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A panel over the tables of sf_dir; only the tables that it reads are opened. Panels that are aggregates of the facts (a row
    a ticker and day at most) are persisted while the query call lasts. No view of the session is made or changed."""
    if name in OF_DAYS:
        days = written(spark, sf_dir, "days", lambda: spark.sql(DAYS.replace("from px", "from {px}"), px=view(spark, sf_dir, "px")))
        return spark.sql(OF_DAYS[name], days=days)
    key = (id(spark), sf_dir, name)
    if key not in _shared:
        sql, used = said(VIEWS[name], SPARK), {}
        for base in [*NEEDS.get(name, []), *TABLES]:
            if f" {base}" in sql and (base in NEEDS.get(name, []) or name not in NEEDS):
                used[base] = (view if base in VIEWS else table)(spark, sf_dir, base)
                sql = re.sub(rf"\b(from|join) {base}\b", rf"\1 {{{base}}}", sql)
        df = spark.sql(sql, **used)
        _shared[key] = df.persist(StorageLevel.MEMORY_AND_DISK) if name in KEPT else df
    return _shared[key]


def kept(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table that several steps of a query need, such as a day's books: built and persisted once a query call."""
    key = (id(spark), sf_dir, f"kept {name}")
    if key not in _shared:
        _shared[key] = build().persist(StorageLevel.MEMORY_AND_DISK)
    return _shared[key]


def written(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Like kept, but a table in the shared folder: what reads it has a short plan, and a lost executor costs a reread only."""
    key = (id(spark), sf_dir, f"written {name}")
    if key not in _shared:
        path, df = shared_folder(spark, name.replace(" ", "-")), build()
        df.write.parquet(path)
        _shared[key] = spark.read.schema(df.schema).parquet(path)
    return _shared[key]


def with_views(sql: str, *names: str) -> str:
    """The oracle's text: the views it needs as common table expressions, then sql."""
    order = [n for n in VIEWS if n in names or any(n in NEEDS.get(m, []) for m in names)]
    ctes = [f"{n} as ({said(VIEWS[n], DUCK)})" for n in order]
    head = "with recursive " + ", ".join(ctes)
    body = sql.strip()
    return head + (", " + body[5:] if body.lower().startswith("with ") else " " + body)
