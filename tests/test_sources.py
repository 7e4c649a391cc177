"""Literal payloads to rows, normalisation, streaming twins."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import models, normalize
from panelspark.sources import landed
from panelspark.streaming import news_stream


def test_json_quotes(spark):
    q = json.dumps({"timestamp": [0, 86400], "open": [1, 2], "high": [2, 3], "low": [0.5, 1], "close": [1.5, None], "volume": [10, 20]})
    rows = landed.column_quotes(spark.createDataFrame([("A", q), ("B", "junk"), ("C", None)], "ticker string, payload string")).collect()
    assert [(r.ticker, r.close) for r in rows] == [("A", 1.5)]
    r = json.dumps({"results": [{"t": 86400000, "o": 1, "h": 2, "l": 1, "c": 2, "v": 5}]})
    assert landed.row_quotes(spark.createDataFrame([("A", r)], "ticker string, payload string")).first().close == 2
    k = json.dumps({"2026-01-05": {"open": "1", "high": "2", "low": "1", "close": "1.5", "volume": "x"}, "bad": {"close": "1"}})
    row = landed.keyed_quotes(spark.createDataFrame([("A", k)], "ticker string, payload string")).collect()
    assert len(row) == 1 and row[0].close == 1.5 and row[0].volume is None


def test_csv_and_rss(spark, tmp_path):
    (tmp_path / "s.csv").write_text("date,value\n2026-01-01,1.5\n2026-01-02,.\nbad,3\n")
    rows = landed.csv_series(spark, str(tmp_path / "s.csv"), "X").collect()
    assert [(r.value, r.available_at) for r in rows] == [(1.5, dt.date(2026, 1, 2))]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A &amp;amp; B &lt;b&gt;up&lt;/b&gt;</title><description>x</description><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate></item><item><title>n</title><pubDate>?</pubDate></item></channel></rss>")
    rows = landed.rss_items(spark, str(tmp_path / "f.xml"), "feed").collect()
    assert [(r.headline_key, r.source_name) for r in rows] == [("a b up x", "feed")]


def test_facts_and_ids(spark):
    f = json.dumps({"Sales": {"units": {"USD": [{"start": "2025-01-01", "end": "2025-03-31", "filed": "2025-05-01", "val": 5}], "EUR": [{"start": "a", "end": "b", "filed": "c", "val": 1}]}}})
    rows = landed.company_facts(spark.createDataFrame([("A", f)], "ticker string, payload string"), "USD").collect()
    assert [(r.concept, r.val, r.end) for r in rows] == [("Sales", 5.0, dt.date(2025, 3, 31))]
    ids = landed.padded_ids(spark.createDataFrame([(json.dumps({"0": {"ticker": "a", "id": 42}}),)], "payload string")).first()
    assert tuple(ids) == ("A", "0000000042")


def test_covering_snapshot_is_the_narrowest(spark):
    d = dt.date
    cat = spark.createDataFrame([("r", d(2020, 1, 1), d(2026, 1, 1), 1, "wide"), ("r", d(2025, 1, 1), d(2026, 1, 1), 2, "narrow"), ("r", d(2025, 6, 1), d(2026, 1, 1), 3, "late")], "resource string, first date, last date, fetched_at int, path string")
    req = spark.createDataFrame([(1, "r", d(2025, 2, 1), d(2025, 12, 1)), (2, "r", d(2019, 1, 1), d(2025, 1, 1))], "request int, resource string, first date, last date")
    assert [(r.request, r.path) for r in landed.covering_snapshot(cat, req).collect()] == [(1, "narrow")]


def test_normalize(spark):
    raw = spark.createDataFrame([("A", "t1", "2", "1", "1", "1", "5"), ("A", "t1", "1", "1", "1", "1", "5"), ("A", "t2", "x", "1", "1", "1", "5"), (None, "t", "1", "1", "1", "1", "1")], "ticker string, timestamp_utc string, open string, high string, low string, close string, volume string")
    rows = normalize.bars(raw).collect()
    assert [(r.ticker, r.open, r.source) for r in rows] == [("A", 1.0, "unknown")]
    with pytest.raises(ValueError, match="volume"):
        normalize.bars(raw.drop("volume"))
    led = normalize.evolve(raw.select("ticker"), {"ticker": ("string", "?"), "status": ("string", "QUEUED"), "n": ("bigint", 0)})
    assert {(r.status, r.n) for r in led.collect()} == {("QUEUED", 0)}


def test_ridge_recovers_a_line(spark):
    df = spark.createDataFrame([(float(i), float(i % 7), 3 + 2.0 * i - (i % 7)) for i in range(50)], "a double, b double, y double")
    c = models.ridge(df, ["a", "b"], "y", 1e-9)
    assert c["intercept"] == pytest.approx(3, abs=1e-4) and c["a"] == pytest.approx(2, abs=1e-6) and c["b"] == pytest.approx(-1, abs=1e-4)
    top = df.limit(1).select(models.top_contributions({"intercept": 0.0, "a": 0.0, "b": 5.0}, 1).alias("t")).first().t
    assert top[0]["name"] in ("a", "b")


def test_streams_equal_batch(spark, tmp_path):
    rows = [("A", dt.datetime(2026, 1, 5, h), float(h), 1.0) for h in (10, 11, 12)] + [("A", dt.datetime(2026, 1, 8), 1.0, 1.0)]
    schema = "ticker string, ts timestamp, price double, volume double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = news_stream.bar_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = [(r.open, r.high, r.low, r.close, r.volume) for r in spark.table("bars_out").collect()]
    assert got == [(10.0, 12.0, 10.0, 12.0, 3.0)]
    batch = landed.tick_bars(spark.createDataFrame(rows, schema)).where(F.col("date") == dt.date(2026, 1, 5)).first()
    assert (batch.open, batch.high, batch.low, batch.close) == (10.0, 12.0, 10.0, 12.0)


def streamed(spark, tmp_path, name, rows, schema, twin, batches):
    """The twin over rows that arrive in shuffled micro-batches, with one item far ahead that moves the watermark past all."""
    news_stream.state_store(spark)
    folder = str(tmp_path / name)
    for i, part in enumerate(batches):
        spark.createDataFrame([rows[j] for j in part], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{i}")
    stream = twin(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in"))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return spark.table(name).collect()


def shuffled_batches(n, seed, parts=4):
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return [order[i::parts] for i in range(parts)] + [[n]]


@pytest.mark.parametrize("seed", [1, 2])
def test_novelty_stream_equals_batch(spark, tmp_path, seed):
    from panelspark.operators import news

    rows = [("AB"[i % 2], "gh"[i // 2 % 2], dt.datetime(2026, 1, 5, i // 2 % 20, i % 7), i) for i in range(40)]
    schema = "ticker string, headline_key string, published_at timestamp, item_id bigint"
    want = {(r.ticker, r.headline_key, r.item_id, r.novelty) for r in news.novelty(spark.createDataFrame(rows, schema)).collect()}
    ahead = ("A", "z", dt.datetime(2026, 1, 9), 99)
    got = streamed(spark, tmp_path, f"novelty_{seed}", [*rows, ahead], schema, news_stream.novelty_stream, shuffled_batches(40, seed))
    assert len(got) == 40 and {(r.ticker, r.headline_key, r.item_id, r.novelty) for r in got} == want


def test_dedupe_stream_keeps_the_most_relevant(spark, tmp_path):
    rows = [("gh"[i % 2], dt.datetime(2026, 1, 5, i % 3), "s" + str(i % 5 // 4), i, [None, 0.1, 0.7, 0.7][i * 7 % 4]) for i in range(40)]
    schema = "headline_key string, published_at timestamp, source_name string, item_id bigint, relevance_score double"
    best = {}
    for h, t, s, i, r in sorted(rows, key=lambda x: (-(x[4] if x[4] is not None else -1), x[3])):
        best.setdefault((h, t, s), i)
    got = streamed(spark, tmp_path, "deduped", [*rows, ("z", dt.datetime(2026, 1, 9), "s", 99, 1.0)], schema, news_stream.dedupe_stream, shuffled_batches(40, 5))
    assert len(got) == len(best) and {(r.headline_key, r.published_at, r.source_name): r.item_id for r in got} == best
