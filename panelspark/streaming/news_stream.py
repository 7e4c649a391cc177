"""Streaming twins of batch operators. Those with timers keep their state in RocksDB: call state_store(spark) before they start."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class MostRelevant(StatefulProcessor):
    """A key's most relevant item, given out once when the watermark has passed the key's time: no item that could replace it can
    come any more. The state then ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "relevance double, item_id bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        best = self.best.get() if self.best.exists() else None
        for pdf in rows:
            for r, i in zip(pdf["relevance_score"].fillna(float("-inf")).tolist(), pdf["item_id"].tolist(), strict=True):
                if best is None or (-r, i) < (-best[0], best[1]):
                    best = (r, i)
        self.best.update(best)
        self.handle.registerTimer(int(pd.Timestamp(key[1]).timestamp() * 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.best.exists():
            relevance, item = self.best.get()
            self.best.clear()
            yield pd.DataFrame({"headline_key": [key[0]], "published_at": [key[1]], "source_name": [key[2]], "item_id": [item], "relevance_score": [None if relevance == float("-inf") else relevance]})

    def close(self) -> None:
        pass


def dedupe_stream(items: DataFrame, delay: str = "1 day") -> DataFrame:
    """Items (headline_key, published_at, source_name, item_id, relevance_score) to one a (headline, time, source): the most
    relevant, the smallest id of equal ones. It comes out once the watermark has passed its time; items that are later than
    `delay` are dropped. A null relevance is the least."""
    slim = items.select("headline_key", "published_at", "source_name", "item_id", "relevance_score").withWatermark("published_at", delay)
    out = "headline_key string, published_at timestamp, source_name string, item_id bigint, relevance_score double"
    return slim.groupBy("headline_key", "published_at", "source_name").transformWithStateInPandas(MostRelevant(), out, "Append", "EventTime")


class Numbered(StatefulProcessor):
    """A headline's items in the order of their time. Items wait until the watermark has passed them, so late ones within it are
    numbered where they belong. The count ends `keep_ms` of event time after the last item."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, item_id bigint")
        self.seen = handle.getValueState("seen", "n bigint, last bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for pdf in rows:
            at = [int(t.value // 1000) for t in pdf["published_at"]]
            self.waiting.appendList(list(zip(at, pdf["item_id"].tolist(), strict=True)))
            for ms in {-(-t // 1000) for t in at}:
                self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        n, last = self.seen.get() if self.seen.exists() else (0, 0)
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
            self.seen.update((n + len(due), due[-1][0]))
            self.handle.registerTimer(due[-1][0] // 1000 + self.keep_ms)
            yield pd.DataFrame({"ticker": key[0], "headline_key": key[1], "published_at": pd.to_datetime([r[0] for r in due], unit="us"), "item_id": [r[1] for r in due], "novelty": [1.0 / (1 + n + i) for i in range(len(due))]})
        elif n and now >= last + self.keep_ms * 1000 and not rest:
            self.seen.clear()

    def close(self) -> None:
        pass


def novelty_stream(items: DataFrame, delay: str = "1 day", keep_days: int = 30) -> DataFrame:
    """Items (ticker, headline_key, published_at timestamp, item_id) plus novelty, 1 / (1 + earlier items of the headline for
    the ticker), once the watermark has passed them; equal times in the order of ids."""
    slim = items.select("ticker", "headline_key", "published_at", "item_id").withWatermark("published_at", delay)
    out = "ticker string, headline_key string, published_at timestamp, item_id bigint, novelty double"
    return slim.groupBy("ticker", "headline_key").transformWithStateInPandas(Numbered(keep_days * 86_400_000), out, "Append", "EventTime")


def bar_stream(ticks: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Ticks (ticker, ts, price, volume) to bars by event-time window; append mode emits closed windows."""
    g = ticks.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "ticker")
    bars = g.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume"))
    return bars.select("ticker", F.to_date("w.start").alias("date"), "open", "high", "low", "close", "volume")
