"""Sharding along a Hilbert curve. DataFrame functions only."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.workspace import Workspace


def _gray_inverse(g: int) -> int:
    x = 0
    while g:
        x ^= g
        g >>= 1
    return x


def _curve_tables(n: int) -> tuple[list[list[int]], list[int], list[int], list[int]]:
    """For n dimensions: rotate[d][b] (b rotated right by d + 1), and by Gray rank: rank[b], entry point, direction."""
    size = 1 << n
    rotate = [[((b >> k) | (b << (n - k))) & (size - 1) for b in range(size)] for k in [(d + 1) % n for d in range(n)]]
    back = [[((b << k) | (b >> (n - k))) & (size - 1) for b in range(size)] for k in [(d + 1) % n for d in range(n)]]
    rank = [_gray_inverse(b) for b in range(size)]
    entry, turn = [], []
    for w in range(size):
        e = 2 * ((w - 1) // 2)
        entry.append(0 if w == 0 else e ^ (e >> 1))
        v = w - 1 if w % 2 == 0 else w
        ones = (v ^ (v + 1)).bit_length() - 1
        turn.append(0 if w == 0 else ones % n)
    return rotate, back, rank, [entry, turn]


def hilbert_index(coords: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of the cell with the given coordinates (0 .. 2^bits - 1 each), as a long.

    One step a bit, from the highest: the cell's corner is turned into the current frame, its Gray rank is the next
    digit, and the frame moves on. Tables of 2^n entries are built from the rule."""
    n = len(coords)
    rotate, back, rank, (entry, turn) = _curve_tables(n)
    lit = lambda x: F.array(*[lit(y) for y in x]) if isinstance(x, list) else F.lit(x)
    at = lambda table, *i: F.element_at(table, i[0] + 1) if len(i) == 1 else F.element_at(F.element_at(table, i[0] + 1), i[1] + 1)
    corners = []
    for b in reversed(range(bits)):
        corner = F.lit(0)
        for j, c in enumerate(coords):
            corner = corner.bitwiseOR(F.shiftleft(F.shiftright(c.cast("int"), b).bitwiseAND(F.lit(1)), j))
        corners.append(corner)
    start = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))

    def step(s: Column, corner: Column) -> Column:
        w = at(lit(rank), at(lit(rotate), s["d"], corner.bitwiseXOR(s["e"])))
        return F.struct(
            (s["h"] * (1 << n) + w).cast("bigint").alias("h"),
            s["e"].bitwiseXOR(at(lit(back), s["d"], at(lit(entry), w))).alias("e"),
            ((s["d"] + at(lit(turn), w) + 1) % n).alias("d"),
        )

    return F.aggregate(F.array(*corners), start, step)["h"]


def ordinal(column: str, dtype: str, shared: int = 0) -> Column:
    """A number that keeps the order of the column: numbers as they are, strings by the six bytes after the first `shared`
    ones, which all have in common; null is lowest."""
    if dtype == "string":
        head = F.rpad(F.hex(F.substring(F.encode(F.col(column), "UTF-8"), shared + 1, 6)), 12, "0")
        return F.coalesce(F.conv(head, 16, 10).cast("double"), F.lit(-1.0))
    return F.coalesce(F.col(column).cast("double"), F.lit(float("-inf")))


def shared_prefixes(docs: DataFrame, dims: list[str]) -> dict[str, int]:
    """Bytes that all strings of each string dimension begin with, from its smallest and largest."""
    names = [c for c in dims if dict(docs.dtypes)[c] == "string"]
    if not names:
        return {}
    ends = docs.agg(*[f(F.encode(F.col(c), "UTF-8")).alias(f"{c}_{k}") for c in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    pairs = {c: (bytes(ends[f"{c}_lo"] or b""), bytes(ends[f"{c}_hi"] or b"")) for c in names}
    return {c: len(os.path.commonprefix([lo, hi])) for c, (lo, hi) in pairs.items()}


def hilbert_shards(docs: DataFrame, dims: list[str], n_shards: int = 24, bits: int = 4, tie_cols: list[str] | None = None) -> DataFrame:
    """docs plus hilbert (curve index), shard (0 .. n_shards-1) and slot (gapless from 0 in each shard).

    Each dimension is cut into 2^bits cells at quantiles from a mergeable sketch over all rows, cells are put on the
    Hilbert curve, rows are range-partitioned and sorted by (curve index, tie_cols), written once in that order, and the
    order is cut into runs whose row counts differ by at most one. The range bounds include the tie columns, so a cell
    that holds a third of all rows is spread over many tasks. Only the row count of each written run (one a task) is
    gathered to number the rows. Rows equal in all sort columns may take each other's slot.

    Nulls sort lowest. Empty tables give no rows. Columns hilbert, shard and slot of docs are replaced."""
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession)
    docs = docs.drop("hilbert", "shard", "slot", "__run", "__at")
    types = dict(docs.dtypes)
    shared = shared_prefixes(docs, dims)
    numbers = {f"__d{i}": ordinal(c, types[c], shared.get(c, 0)) for i, c in enumerate(dims)}
    cuts = [k / 2**bits for k in range(1, 2**bits)]
    bounds = docs.agg(*[F.percentile_approx(x, cuts, 2000).alias(c) for c, x in numbers.items()])
    bounds = bounds.first()  # one row of (2^bits - 1) numbers a dimension
    cells = []
    for c, x in numbers.items():
        edges = sorted(set(bounds[c] or []))
        cells.append(sum([(x > e).cast("int") for e in edges], F.lit(0)))
    keyed = docs.withColumn("hilbert", hilbert_index(cells, bits))
    order = ["hilbert", *(tie_cols or [c for c, t in docs.dtypes if t in ("bigint", "int", "string")])]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = placed.withColumn("__run", F.shiftright("__id", 33).cast("int")).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1).cast("bigint"))).drop("__id")
    placed = ws.save(placed, "runs")
    # one row for each written run (at most the number of shuffle partitions), so one task can number them
    runs = placed.groupBy("__run").agg(F.count(F.lit(1)).alias("__n"))
    every = Window.orderBy("__run")
    runs = runs.select("__run", (F.sum("__n").over(every) - F.col("__n")).alias("__from"), F.sum("__n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"))
    out = placed.join(F.broadcast(runs), "__run").withColumn("__k", F.col("__from") + F.col("__at"))
    out = out.withColumn("shard", F.expr(f"cast(__k * {n_shards} div __total as int)"))
    out = out.withColumn("slot", F.expr(f"__k - (shard * __total + {n_shards - 1}) div {n_shards}"))
    return out.drop("__run", "__at", "__from", "__total", "__k")


def write_shards(sharded: DataFrame, folder: str, dims: list[str]) -> DataFrame:
    """Writes the rows of hilbert_shards as one folder a shard, sorted by slot, and returns the pruning table: shard, rows,
    and the smallest and largest value and the number of nulls of each dimension."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    ends = [f(F.col(c)).alias(f"{c}_{k}") for c in dims for k, f in (("lo", F.min), ("hi", F.max), ("nulls", lambda x: F.count_if(x.isNull())))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *ends)


def shards_for(pruning: DataFrame, box: dict[str, tuple]) -> DataFrame:
    """The shards that can hold a row inside the box {dimension: (least, most)}; the others need not be read."""
    keep = F.lit(True)
    for c, (lo, hi) in box.items():
        keep = keep & (F.col(f"{c}_lo") <= F.lit(hi)) & (F.col(f"{c}_hi") >= F.lit(lo))
    return pruning.where(keep).select("shard", "rows")
