"""Hard negatives by the threshold algorithm over sorted lists of each dimension.

Rows are written in blocks with one list a dimension: the block's rows in the order of that component. A search for an anchor
reads all lists in step, from the top where the anchor's component is positive and from the bottom where it is negative, and
scores every row that it meets for the first time by random access. What no list has shown yet scores at most the sum of the
anchor's components times the values just read; once this threshold lies strictly below the worst row held for each window,
or below the window itself where that is not full, the block holds nothing more. Anchors go in blocks too, and each task
carries what its anchors hold from one block of rows to the next, so later blocks stop sooner.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.vectors import usable, whole
from panelspark.llm.workspace import Workspace

BLOCK = 8192
ANCHORS = 256  # anchors a block
STEPS = 32  # places of each list that are read at once, doubled from time to time


class Lists:
    """A block of rows: ids, noid (null id), labels, x (n, d) whole numbers, orders (d, n): row numbers by rising component."""

    def __init__(self, block: bytes):
        z = np.load(io.BytesIO(block))
        self.number, self.ids, self.noid, self.labels, self.x, self.orders = int(z["number"]), z["ids"], z["noid"], z["labels"], z["x"], z["orders"]
        self._own: dict[int, tuple] = {}
        exact = int(np.abs(self.x).max(initial=0)) ** 2 * self.x.shape[1] < 1 << 53
        self.fast = self.x.astype(np.float64) if exact else None  # products are then the same in floating point

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.fast is not None and int(np.abs(anchor).max(initial=0)) * int(np.abs(self.x).max(initial=0)) * len(anchor) < 1 << 53:
            return (self.fast[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.x[rows].astype(np.int64) @ anchor

    def of_label(self, label: int) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers of the label, their lists as places in these numbers)."""
        if label not in self._own:
            rows = np.flatnonzero(self.labels == label)
            place = np.zeros(len(self.labels), dtype=np.int32)
            place[rows] = np.arange(len(rows))
            self._own[label] = rows, place[self.orders[(self.labels == label)[self.orders]].reshape(len(self.orders), len(rows))]
        return self._own[label]


def packed(number: int, ids: np.ndarray, noid: np.ndarray, labels: np.ndarray, x: np.ndarray) -> bytes:
    orders = np.argsort(x, axis=0, kind="stable").T
    small = x.astype(np.int32)
    to = io.BytesIO()
    np.savez(to, number=number, ids=ids, noid=noid, labels=labels, x=small, orders=np.ascontiguousarray(orders, dtype=np.uint16))
    return to.getvalue()


class Held:
    """The best `k` rows of a window: score down, then id up (null ids last), then block and row. low and high bound 100 times
    the score."""

    __slots__ = ("k", "low", "high", "rows")

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high, self.rows = k, low, high, []

    def add(self, scores: np.ndarray, noid: np.ndarray, ids: np.ndarray, block: int, rows: np.ndarray) -> None:
        ok = np.ones(len(scores), dtype=bool)
        if self.low is not None:
            ok = (100 * scores >= self.low) & (100 * scores <= self.high)
        if len(self.rows) == self.k:
            ok &= scores >= -self.rows[-1][0]
        at = np.flatnonzero(ok)
        if len(at) > self.k:  # only what is as good as the k-th best
            at = at[scores[at] >= np.partition(scores[at], len(at) - self.k)[len(at) - self.k]]
        if len(at):
            at = at[np.lexsort((rows[at], ids[at], noid[at], -scores[at]))[: self.k]]
            new = zip((-scores[at]).tolist(), noid[at].tolist(), ids[at].tolist(), [block] * len(at), rows[at].tolist(), strict=True)
            self.rows = sorted([*self.rows, *new])[: self.k]

    def over(self, threshold: int) -> bool:
        """Nothing that scores at most `threshold` can enter."""
        if len(self.rows) == self.k and threshold < -self.rows[-1][0]:
            return True
        return self.low is not None and (100 * threshold < self.low or self.low > self.high)


def search(anchor: np.ndarray, own: np.ndarray | None, orders: np.ndarray, lists: Lists, windows: list[Held], take) -> int:
    """Feeds the rows that may enter a window to take(row numbers, scores); the number of rows scored. Stops as the threshold
    algorithm does. own: the row numbers that `orders` counts; None for all rows."""
    n = orders.shape[1]
    dims = np.flatnonzero(anchor)
    q = anchor[dims]
    down = q > 0
    lead = np.where(down[:, None], orders[dims][:, ::-1], orders[dims])
    seen, at, step, scored = np.zeros(n, dtype=bool), 0, STEPS, 0
    if len(dims) == 0:  # every row scores 0
        take(np.arange(n) if own is None else own, np.zeros(n, dtype=np.int64))
        return n
    while at < n:
        edge = lead[:, at] if own is None else own[lead[:, at]]
        threshold = int(q @ lists.x[edge, dims].astype(np.int64))
        if all(w.over(threshold) for w in windows):
            break
        fresh = np.zeros(n, dtype=bool)
        fresh[lead[:, at : at + step]] = True
        rows = np.flatnonzero(fresh & ~seen)
        seen[rows] = True
        rows = rows if own is None else own[rows]
        take(rows, lists.scores(rows, anchor))
        scored += len(rows)
        at, step = at + step, 2 * step
        if scored == n:
            break
    return scored


def list_blocks(rows: DataFrame) -> DataFrame:
    """rows (id, label, v) -> (number, block): up to BLOCK rows of a task. number is unique."""

    def run(batches):
        from pyspark import TaskContext

        held, size, made = [], 0, 0

        def cut(n: int):
            nonlocal held, made
            every = pd.concat(held, ignore_index=True)
            held, part = [every[n:]], every[:n]
            number = (TaskContext.get().partitionId() << 32) + made
            made += 1
            x = np.stack(part["v"].to_numpy()).astype(np.int64)
            return pd.DataFrame({"number": [number], "block": [packed(number, part["id"].to_numpy(np.int64), part["noid"].to_numpy(bool), part["label"].to_numpy(np.int64), x)]})

        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            while size >= BLOCK:
                size -= BLOCK
                yield cut(BLOCK)
        if size:
            yield cut(size)

    return rows.select(F.coalesce("id", F.lit(0).cast("bigint")).alias("id"), F.col("id").isNull().alias("noid"), "label", "v").mapInPandas(run, "number bigint, block binary")


ANCHOR = "block bigint, row int, id bigint, label bigint, v array<bigint>"


def anchors_of(blocks: DataFrame, every: int) -> DataFrame:
    """The rows whose id is divisible by `every`, with the place where they stand."""

    def run(batches):
        for pdf in batches:
            for block in pdf["block"]:
                b = Lists(block)
                at = np.flatnonzero(~b.noid & (b.ids % every == 0))
                if len(at):
                    yield pd.DataFrame({"block": np.full(len(at), b.number), "row": at, "id": b.ids[at], "label": b.labels[at], "v": b.x[at].astype(np.int64).tolist()})

    return blocks.mapInPandas(run, ANCHOR)


def anchor_blocks(anchors: DataFrame) -> DataFrame:
    """(name, anchors): up to ANCHORS anchors of a task, with `positives` (array of scores) where there are some."""

    def run(batches):
        from pyspark import TaskContext

        made = 0
        for pdf in batches:
            for i in range(0, len(pdf), ANCHORS):
                part = pdf[i : i + ANCHORS]
                out = {c: part[c].to_numpy(np.int64) for c in ("block", "row", "id", "label")} | {"v": np.stack(part["v"].to_numpy()).astype(np.int64)}
                if "positives" in part:
                    out["sizes"] = np.array([len(p) for p in part["positives"]])
                    out["positives"] = np.concatenate([np.asarray(p, dtype=np.int64) for p in part["positives"]])
                to = io.BytesIO()
                np.savez(to, **out)
                yield pd.DataFrame({"name": [(TaskContext.get().partitionId() << 32) + made], "anchors": [to.getvalue()]})
                made += 1

    return anchors.mapInPandas(run, "name bigint, anchors binary")


FOUND = "block bigint, row int, nth int, rank_score bigint, noid boolean, id bigint, at_block bigint, at_row int"


def _results(z, windows) -> pd.DataFrame:
    out = [(b, r, nth, -s, noid, i, at, row) for b, r, held in zip(z["block"].tolist(), z["row"].tolist(), windows, strict=True) for nth, w in enumerate(held) for s, noid, i, at, row in w.rows]
    return pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])


def _meet(blocks: DataFrame, anchors: DataFrame, windows_of, visit) -> DataFrame:
    """Every block of anchors meets every block of rows: a stated set of queries against all rows, in blocks. Neither side is
    shuffled or broadcast beyond what Spark measures; a task keeps what its anchors hold while their blocks follow each other."""

    def run(batches):
        name, z, windows = None, None, []
        for pdf in batches:
            for now, anchor_block, block in zip(pdf["name"], pdf["anchors"], pdf["block"], strict=True):
                if now != name:
                    if z is not None:
                        yield _results(z, windows)
                    name, z = now, dict(np.load(io.BytesIO(anchor_block)))
                    windows = windows_of(z)
                lists = Lists(block)
                for i in range(len(z["id"])):
                    visit(lists, z, i, windows[i])
        if z is not None:
            yield _results(z, windows)

    return anchors.crossJoin(blocks.select("block")).mapInPandas(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("block", "row", "nth").orderBy(F.desc("rank_score"), "noid", "id", "at_block", "at_row")  # k rows a task at most
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (id divisible by `every`)
    and each of its `positives` best other rows of the same label, the first `negatives` rows of another label whose score is
    low to high hundredths of the positive's. A score is the inner product of the vectors floor(scale * x); higher scores come
    first, then smaller ids.

    Runs jobs when called. Rows with a null label or vector, or a null or non-finite component, take no part. Null ids are no
    anchors and come last among equal scores; rows of one id are several rows (a copy of an anchor is another row) and come in
    any fixed order among equal scores. Vectors of different sizes are compared as if the shorter had zeros at the end;
    components count up to 2^22 / scale either way. An empty table, an anchor without positives and a window without rows give
    no rows. Further columns are ignored. There is no text."""
    ws = Workspace(df.sparkSession)
    kept = df.where(usable(vector_col) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("v"))
    kept, _ = whole(kept, "v", scale)
    blocks = ws.save(list_blocks(kept), "blocks")
    anchors = ws.save(anchors_of(blocks, every), "anchors")

    def same(lists, z, i, held):
        rows, orders = lists.of_label(int(z["label"][i]))

        def take(at, scores):
            if lists.number == z["block"][i]:
                other = at != z["row"][i]
                at, scores = at[other], scores[other]
            held[0].add(scores, lists.noid[at], lists.ids[at], lists.number, at)

        search(z["v"][i], rows, orders, lists, held, take)

    def others(lists, z, i, held):
        def take(at, scores):
            other = lists.labels[at] != z["label"][i]
            at, scores = at[other], scores[other]
            for w in held:
                w.add(scores, lists.noid[at], lists.ids[at], lists.number, at)

        search(z["v"][i], None, lists.orders, lists, held, take)

    found = _meet(blocks, ws.save(anchor_blocks(anchors), "anchor-blocks"), lambda z: [[Held(positives)] for _ in z["id"]], same)
    best = ws.save(_best(found, positives).select("block", "row", "rank", F.when(~F.col("noid"), F.col("id")).alias("positive_id"), F.col("rank_score").alias("positive_score")), "positives")
    listed = best.groupBy("block", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))), lambda s: s["positive_score"]).alias("positives"))  # at most `positives` a row

    def windows_of(z):
        ends = np.cumsum(z["sizes"])
        return [[Held(negatives, low * p, high * p) for p in z["positives"][e - n : e].tolist()] for e, n in zip(ends.tolist(), z["sizes"].tolist(), strict=True)]

    found = _meet(blocks, ws.save(anchor_blocks(anchors.join(listed, ["block", "row"])), "windows"), windows_of, others)
    out = _best(found, negatives).select("block", "row", (F.col("nth") + 1).alias("at_rank"), "rank", F.when(~F.col("noid"), F.col("id")).alias("negative_id"), F.col("rank_score").alias("negative_score"))
    named = anchors.select("block", "row", F.col("id").alias("anchor_id")).join(best.withColumnRenamed("rank", "at_rank"), ["block", "row"])
    return named.join(out, ["block", "row", "at_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
