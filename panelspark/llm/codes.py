"""Vector codes: exact Lloyd rounds for each part of the vectors, with metric trees built by the anchors hierarchy.

1. Blocks: tasks cut their rows into blocks and build a tree for each part. Anchors: each new anchor is the point farthest
   from the centre of the widest set, and takes the points that are nearer to it. Middle out: the sets are merged pair by
   pair, smallest ball first, up to the root, and each set is divided again below. Every ball keeps its number of points and
   their sum. The trees are written once.
2. Rounds: each task walks its trees with the codebooks. A ball inherits the entries that its parent could not rule out and
   drops those that are farther than another one for every point of the ball; when one is left, the ball's cached sum and
   number go to it. Sums are reduced in the task, so a round shuffles a few rows a task, and the new codebooks are a small
   fixed number of integers.
"""

from __future__ import annotations

import hashlib
import io
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.vectors import usable, whole
from panelspark.llm.workspace import Workspace

BLOCK = 4096
LEAF = 24


def anchor_sets(x: np.ndarray, k: int) -> list[np.ndarray]:
    """x (n, d) in up to k sets of row numbers; each new anchor takes the points nearer to it than to their own. Points within
    half the distance of two anchors need no comparison."""
    far = lambda c: np.sqrt(((x - c) ** 2).sum(axis=1))
    first = int(far(x.mean(axis=0)).argmax())
    anchors, owner, dist = [first], np.zeros(len(x), dtype=np.int64), far(x[first])
    while len(anchors) < k:
        new = int(dist.argmax())
        if dist[new] == 0:
            break
        apart = np.sqrt(((x[anchors] - x[new]) ** 2).sum(axis=1))
        open_ = np.flatnonzero(dist > apart[owner] / 2)
        d = np.sqrt(((x[open_] - x[new]) ** 2).sum(axis=1))
        won = d < dist[open_]
        owner[open_[won]], dist[open_[won]] = len(anchors), d[won]
        anchors.append(new)
    return [s for a in range(len(anchors)) if len(s := np.flatnonzero(owner == a))]


class BallTree:
    """Balls over the rows of x (n, d) of whole numbers. Ball i: centre[i], radius[i] (an upper bound), count[i], total[i];
    children left[i], right[i] (-1: a leaf) and rows order[lo[i]:hi[i]]. The root is ball 0."""

    FIELDS = ("x", "order", "centre", "radius", "count", "total", "left", "right", "lo", "hi")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, x: np.ndarray) -> BallTree:
        made: list[list] = []  # centre, radius, count, total, left, right, rows

        def ball(rows: np.ndarray) -> int:
            total = x[rows].sum(axis=0)
            centre = total / len(rows)
            radius = float(np.sqrt(((x[rows] - centre) ** 2).sum(axis=1).max()))
            if len(rows) <= LEAF or radius == 0:
                made.append([centre, radius, len(rows), total, -1, -1, rows])
                return len(made) - 1
            return middle_out([ball(rows[s]) for s in anchor_sets(x[rows].astype(np.float64), max(2, int(len(rows) ** 0.5)))])

        def middle_out(tops: list[int]) -> int:
            centre, radius = np.array([made[i][0] for i in tops]), np.array([made[i][1] for i in tops])
            count, alive = np.array([made[i][2] for i in tops], dtype=np.float64), list(tops)
            apart = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2))
            size = apart + radius[:, None] + radius[None]  # the width of a ball around two
            np.fill_diagonal(size, np.inf)
            for _ in range(len(tops) - 1):
                a, b = divmod(int(size.argmin()), len(tops))
                c = (centre[a] * count[a] + centre[b] * count[b]) / (count[a] + count[b])
                r = max(np.sqrt(((centre[i] - c) ** 2).sum()) + radius[i] for i in (a, b))
                p, q = alive[a], alive[b]
                made.append([c, float(r), made[p][2] + made[q][2], made[p][3] + made[q][3], p, q, None])
                alive[a], centre[a], radius[a], count[a] = len(made) - 1, c, r, count[a] + count[b]
                gone = np.isinf(size[a])
                row = np.sqrt(((centre - c) ** 2).sum(axis=1)) + radius + r
                row[gone | (np.arange(len(tops)) == a)] = np.inf
                size[a], size[:, a] = row, row
                size[b], size[:, b] = np.inf, np.inf
                top = alive[a]
            return top if len(tops) > 1 else tops[0]

        # number the balls from the root, and the rows as the leaves stand
        root = ball(np.arange(len(x)))
        number, stack, order, at = {}, [root], [], 0
        lo, hi = np.zeros(len(made), dtype=np.int32), np.zeros(len(made), dtype=np.int32)
        while stack:
            i = stack.pop()
            if i >= 0:
                number[i] = len(number)
                lo[number[i]] = at
                if made[i][4] < 0:
                    order.append(made[i][6])
                    at += len(made[i][6])
                    hi[number[i]] = at
                else:
                    stack += [~i, made[i][5], made[i][4]]
            else:
                hi[number[~i]] = at
        by = sorted(number, key=number.get)
        child = lambda j: np.array([number.get(made[i][j], -1) for i in by], dtype=np.int32)
        order = np.concatenate(order).astype(np.int32)
        return cls(
            x=x[order], order=order, centre=np.array([made[i][0] for i in by]), radius=np.array([made[i][1] for i in by]), count=np.array([made[i][2] for i in by], dtype=np.int64),
            total=np.array([made[i][3] for i in by], dtype=np.int64), left=child(4), right=child(5), lo=lo[: len(by)], hi=hi[: len(by)],
        )

    def assign(self, entries: np.ndarray, each: bool = False):
        """(number of points, their sums) of each entry, or with `each` (nearest entry of each row of x, its squared distance):
        the nearest entry, the first of equally near ones. entries (k, d) whole numbers."""
        k = len(entries)
        _, first = np.unique(entries, axis=0, return_index=True)
        live = np.zeros(k, dtype=bool)
        live[first] = True  # an entry equal to an earlier one never gets a point
        between = np.sqrt(((entries[:, None].astype(np.float64) - entries[None]) ** 2).sum(axis=2))
        count, total = np.zeros(k, dtype=np.int64), np.zeros(entries.shape, dtype=np.int64)
        code, error = np.zeros(len(self.x), dtype=np.int64), np.zeros(len(self.x), dtype=np.int64)
        balls, lists = np.array([0]), live[None]
        while len(balls):
            d2 = ((self.centre[balls][:, None] - entries[None]) ** 2).sum(axis=2)
            best = np.where(lists, d2, np.inf).argmin(axis=1)
            near = d2[np.arange(len(balls)), best]
            # an entry is farther than the best one for every point of the ball if its bisector lies beyond the radius
            beyond = d2 - near[:, None] > 2 * self.radius[balls][:, None] * between[best] * (1 + 1e-9) + 1e-9 * (d2 + 1)
            lists = lists & ~beyond
            one = lists.sum(axis=1) == 1
            owned = balls[one]
            if each:
                for b, c in zip(owned.tolist(), best[one].tolist(), strict=True):
                    code[self.lo[b] : self.hi[b]] = c
                    error[self.lo[b] : self.hi[b]] = ((self.x[self.lo[b] : self.hi[b]].astype(np.int64) - entries[c]) ** 2).sum(axis=1)
            else:
                np.add.at(count, best[one], self.count[owned])
                np.add.at(total, best[one], self.total[owned])
            leaf = ~one & (self.left[balls] < 0)
            if leaf.any():
                sizes = (self.hi - self.lo)[balls[leaf]]
                rows = np.repeat(self.lo[balls[leaf]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                x = self.x[rows].astype(np.int64)
                d = (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)[None]
                got = np.where(np.repeat(lists[leaf], sizes, axis=0), d, np.iinfo(np.int64).max).argmin(axis=1)
                if each:
                    code[rows], error[rows] = got, d[np.arange(len(rows)), got]
                else:
                    mine = (got[:, None] == np.arange(k)).astype(np.int64)
                    count += mine.sum(axis=0)
                    total += mine.T @ x
            inner = ~one & ~leaf
            balls, lists = np.concatenate([self.left[balls[inner]], self.right[balls[inner]]]), np.concatenate([lists[inner], lists[inner]])
        return (code, error) if each else (count, total)


def _packed(ids, noid, labels, nolabel, x: np.ndarray, parts: int) -> bytes:
    out = {"ids": ids, "noid": noid, "labels": labels, "nolabel": nolabel}
    for p, part in enumerate(np.split(x, parts, axis=1)):
        tree = BallTree.build(part)
        out |= {f"{f}{p}": getattr(tree, f).astype(np.int32) if f == "x" else getattr(tree, f) for f in BallTree.FIELDS}
    to = io.BytesIO()
    np.savez(to, **out)
    return to.getvalue()


def tree_blocks(rows: DataFrame, parts: int) -> DataFrame:
    """rows (id, label, v) -> (block binary): up to BLOCK vectors of a task with a tree for each part."""

    def run(batches):
        held = {"id": [], "noid": [], "label": [], "nolabel": [], "v": []}
        size = 0

        def cut(n: int):
            every = {k: np.concatenate(v) for k, v in held.items()}
            for k, v in every.items():
                held[k] = [v[n:]]
            return pd.DataFrame({"block": [_packed(*(every[k][:n] for k in ("id", "noid", "label", "nolabel", "v")), parts)]})

        for pdf in batches:
            if not len(pdf):
                continue
            for c in ("id", "label"):
                held[c].append(pdf[c].to_numpy())
            held["noid"].append(pdf["noid"].to_numpy(dtype=bool))
            held["nolabel"].append(pdf["nolabel"].to_numpy(dtype=bool))
            held["v"].append(np.stack(pdf["v"].to_numpy()).astype(np.int64))
            size += len(pdf)
            while size >= BLOCK:
                size -= BLOCK
                yield cut(BLOCK)
        if size:
            yield cut(size)

    zero = F.lit(0).cast("bigint")
    slim = rows.select(F.coalesce("id", zero).alias("id"), F.col("id").isNull().alias("noid"), F.coalesce("label", zero).alias("label"), F.col("label").isNull().alias("nolabel"), "v")
    return slim.mapInPandas(run, "block binary")


def _trees(block: bytes, parts: int):
    z = np.load(io.BytesIO(block))
    return z, [BallTree(**{f: z[f"{f}{p}"] for f in BallTree.FIELDS}) for p in range(parts)]


def lloyd_round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry is the floor of the mean of its points; an entry without points stays."""

    def run(batches):
        sums = [(np.zeros(len(b), np.int64), np.zeros(b.shape, np.int64)) for b in books]
        for pdf in batches:
            for block in pdf["block"]:
                for (n, s), tree, entries in zip(sums, _trees(block, len(books))[1], books, strict=True):
                    count, total = tree.assign(entries)
                    n += count
                    s += total
        k, width = books[0].shape
        at = np.array(list(itertools.product(range(len(books)), range(k), range(-1, width))))
        yield pd.DataFrame({"part": at[:, 0], "entry": at[:, 1], "place": at[:, 2], "s": np.concatenate([np.column_stack(x).ravel() for x in sums])})

    out = [b.copy() for b in books]
    rows = blocks.mapInPandas(run, "part int, entry int, place int, s bigint").groupBy("part", "entry", "place").agg(F.sum("s").alias("s")).collect()  # a number a component
    got = {(r["part"], r["entry"], r["place"]): r["s"] for r in rows}
    for p, book in enumerate(out):
        for e in range(len(book)):
            if n := got.get((p, e, -1), 0):
                book[e] = [got[p, e, j] // n for j in range(book.shape[1])]
    return out


def codebook_text(books: list[np.ndarray]) -> str:
    return ",".join(str(v) for b in books for v in b.ravel().tolist())


def compress_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, code, error), codebooks): product-quantisation codes. code has the index of the nearest entry of each part
    as two hex digits, error the sum of their squared distances. Each part's codebook starts from the rows of the `entries`
    smallest ids (all, if fewer) and gets `rounds` exact Lloyd rounds in whole numbers.

    Runs jobs when called. Rows whose vector is null or holds a null or non-finite component are dropped; all others get a
    code: null ids (they stand after the others among the smallest), null labels, repeated rows, and rows of one id with
    different vectors (the smaller vector first). Vectors shorter than the longest are filled with zeros, and the dimension is
    rounded up to a multiple of `parts`; components count up to 2^22 / scale either way. An empty table gives no rows and
    empty codebooks. Further columns are ignored. There is no text."""
    spark, ws = df.sparkSession, Workspace(df.sparkSession)
    kept = df.where(usable(vector_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("v"))
    kept, size = whole(kept, "v", scale, parts)
    start = kept.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()  # a row an entry
    width = size // parts
    books = [np.array([r["v"][p * width : (p + 1) * width] for r in start], dtype=np.int64).reshape(-1, width) for p in range(parts)]
    blocks = ws.save(tree_blocks(kept, parts), "trees")
    if start:
        for _ in range(rounds):
            books = lloyd_round(blocks, books)

    def coded(batches):
        for pdf in batches:
            for block in pdf["block"]:
                z, trees = _trees(block, parts)
                codes, error = np.zeros((len(z["ids"]), parts), np.uint8), np.zeros(len(z["ids"]), np.int64)
                for p, tree in enumerate(trees):
                    c, e = tree.assign(books[p], each=True)
                    codes[tree.order, p] = c
                    error[tree.order] += e
                text = codes.tobytes().hex()
                out = pd.DataFrame({"id": pd.array(z["ids"], dtype="Int64"), "label": pd.array(z["labels"], dtype="Int64"), "code": [text[2 * parts * i : 2 * parts * (i + 1)] for i in range(len(codes))], "error": error})
                out.loc[z["noid"], "id"] = pd.NA
                out.loc[z["nolabel"], "label"] = pd.NA
                yield out

    out = ws.save(blocks.mapInPandas(coded, "id bigint, label bigint, code string, error bigint"), "codes")
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error"), books


def with_label_error(codes: DataFrame, label_col: str = "label") -> DataFrame:
    """codes plus label_error, the sum of error over equal labels; nulls are equal to each other. Sums are reduced before the
    shuffle and joined as a table of a row a label."""
    total = codes.groupBy(F.col(label_col).alias("__l")).agg(F.sum("error").alias("label_error"))
    return codes.join(total, F.col(label_col).eqNullSafe(F.col("__l"))).drop("__l")


def book_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(codebook_text(books).encode()).hexdigest()
