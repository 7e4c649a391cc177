"""A small byte convolutional network in numpy: embedding, filters of widths 2, 3 and 4, max pooling, softmax.

Tasks train it on shards of all rows, of a bounded size each, and the mean of their networks starts the next round."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTHS = (2, 3, 4)
SHARD_ROWS = 12800  # of a task's network
SHARD_SCHEMA = "shard bigint, x binary, y binary"  # x: (n, length) uint8; y: n int32


class ByteCNN:
    """The trained arrays travel with the tasks' closures."""

    def __init__(self, classes: int, filters: int = 8, size: int = 6, seed: int = 7):
        g = np.random.default_rng(seed)
        self.filters = filters
        self.p = {"emb": g.normal(0, 0.5, (256, size))}
        for w in WIDTHS:
            self.p[f"w{w}"] = g.normal(0, (2 / (w * size)) ** 0.5, (w * size, filters))
        self.p["bias"] = np.zeros(filters * len(WIDTHS))
        self.p["out"] = g.normal(0, 0.1, (filters * len(WIDTHS), classes))
        self.p["prior"] = np.zeros(classes)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self._tables = None

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 800, batch: int = 64, rate: float = 4e-3, seed: int = 11, crop: int | None = None) -> ByteCNN:
        """x (n, length) uint8. Adam on the weighted cross-entropy, `steps` batches however many rows. crop: half of the batches
        are cut to a random length of at least so many bytes."""
        g = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(u) for k, u in self.p.items()}
        order, at = g.permutation(len(x)), 0
        for t in range(1, steps + 1):
            if at >= len(x):
                order, at = g.permutation(len(x)), 0
            rows = order[at : at + batch]
            at += batch
            part = x[rows]
            if crop and g.random() < 0.5:
                part = part[:, : int(g.integers(crop, part.shape[1] + 1))]
            grad = self._gradient(part, y[rows], weight[rows])
            for k, d in grad.items():
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.001 * (d * d - v[k])
                self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self._tables = None
        return self

    def fit_shards(self, shards: DataFrame, weight: np.ndarray, rounds: int, steps: int, crop: int | None = None) -> ByteCNN:
        """shards (SHARD_SCHEMA), rows dealt by a hash. Every round each shard is fitted, all of its rows and `steps` batches at least,
        from the network that all share, which then becomes the mean of theirs by rows. weight: by class. What reaches the
        driver is at most 16 sums a round."""
        names = sorted(self.p)
        for k in range(rounds):
            start = self.p

            def run(batches):
                for pdf in batches:
                    out = []
                    for shard, x, y in zip(pdf["shard"], pdf["x"], pdf["y"], strict=True):
                        y = np.frombuffer(y, np.int32)
                        if not len(y):
                            continue
                        net = ByteCNN(1, self.filters)
                        net.p = {n: v.copy() for n, v in start.items()}  # noqa: B023
                        net.fit(np.frombuffer(x, np.uint8).reshape(len(y), -1), y, weight[y].astype(np.float32), max(steps, -(-len(y) // 64)), seed=rounds * shard + k + 11, crop=crop)  # noqa: B023
                        out.append((shard, len(y), np.concatenate([net.p[n].ravel() for n in names]).tobytes()))
                    yield pd.DataFrame(out, columns=["shard", "n", "p"])

            def add(pdf):
                pdf = pdf.sort_values("shard")
                total = sum(n * np.frombuffer(p, np.float32).astype(np.float64) for n, p in zip(pdf["n"], pdf["p"], strict=True))
                return pd.DataFrame({"part": [pdf["shard"].iloc[0] % 16], "n": [pdf["n"].sum()], "p": [total.tobytes()]})

            rows = shards.mapInPandas(run, "shard bigint, n bigint, p binary").groupBy(F.col("shard") % 16).applyInPandas(add, "part bigint, n bigint, p binary").toPandas().sort_values("part")
            mean = sum(np.frombuffer(p) for p in rows["p"]) / rows["n"].sum()
            ends = np.cumsum([self.p[n].size for n in names])
            self.p = {n: mean[e - self.p[n].size : e].reshape(self.p[n].shape).astype(np.float32) for n, e in zip(names, ends, strict=True)}
        self._tables = None
        return self

    def _gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, n, size = self.p, len(x), self.p["emb"].shape[1]
        e = p["emb"][x]
        cols, best, pooled = {}, {}, []
        for w in WIDTHS:
            c = np.concatenate([e[:, j : e.shape[1] - w + 1 + j] for j in range(w)], axis=2)
            r = c @ p[f"w{w}"]
            best[w] = r.argmax(axis=1)
            cols[w] = c
            pooled.append(np.take_along_axis(r, best[w][:, None, :], axis=1)[:, 0])
        a = np.concatenate(pooled, axis=1) + p["bias"]
        h = np.maximum(a, 0)
        z = h @ p["out"] + p["prior"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(n), y] -= 1
        dz = (q * (weight / weight.sum())[:, None]).astype(np.float32)
        grad = {"out": h.T @ dz, "prior": dz.sum(axis=0)}
        da = (dz @ p["out"].T) * (a > 0)
        grad["bias"] = da.sum(axis=0)
        de = np.zeros_like(p["emb"])
        rows = np.arange(n)[:, None]
        for k, w in enumerate(WIDTHS):
            d = da[:, k * self.filters : (k + 1) * self.filters]
            picked = cols[w][rows, best[w]]
            grad[f"w{w}"] = np.einsum("nfc,nf->cf", picked, d)
            back = np.einsum("nf,cf->nfc", d, p[f"w{w}"])
            for j in range(w):
                np.add.at(de, x[rows, best[w] + j], back[:, :, j * size : (j + 1) * size])
        grad["emb"] = de
        return grad

    def _pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses of two neighbouring bytes at a filter's first two places (all widths) and last two (widths 3, 4)."""
        if self._tables is None:
            e, size, f = self.p["emb"], self.p["emb"].shape[1], self.filters
            place = {(w, j): e @ self.p[f"w{w}"][j * size : (j + 1) * size] for w in WIDTHS for j in range(w)}
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
            first = np.concatenate([pair(place[w, 0], place[w, 1]) for w in WIDTHS], axis=1)
            last = np.concatenate([pair(place[3, 2], np.zeros((256, f), np.float32)), pair(place[4, 2], place[4, 3])], axis=1)
            self._tables = np.ascontiguousarray(first, np.float32), np.ascontiguousarray(last, np.float32)
        return self._tables

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """x (n, length >= 4) uint8 -> (n, classes). In blocks of about 32 KB, so that memory stays in cache."""
        first, last = self._pair_tables()
        f, length = self.filters, x.shape[1]
        pooled = np.empty((len(x), 3 * f), np.float32)
        step = max(1, (32 << 10) // length)
        for i in range(0, len(x), step):
            part = x[i : i + step].astype(np.int32)
            code = part[:, :-1] * 256 + part[:, 1:]
            r = first.take(code, axis=0)
            pooled[i : i + step, :f] = r[:, :, :f].max(axis=1)
            r = r[:, :-1, f:]
            r += last.take(np.concatenate([code[:, 2:], part[:, -1:] * 256], axis=1), axis=0)  # the last place of width 3 has one byte left
            pooled[i : i + step, f : 2 * f] = r[:, :, :f].max(axis=1)
            pooled[i : i + step, 2 * f :] = r[:, :-1, f:].max(axis=1)
        z = np.maximum(pooled + self.p["bias"], 0) @ self.p["out"] + self.p["prior"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        return q / q.sum(axis=1, keepdims=True)


def windows(data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed windows over whole texts, the last padded with zero bytes: (rows (n, length), text index, new bytes). Neighbours
    share as many bytes as the widest filter less one, so no place of a filter is lost at an edge."""
    share = max(WIDTHS) - 1
    step = length - share
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    counts = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - length) // step)), 0)
    buf = np.frombuffer(b"".join(d + bytes(length) for d in data), dtype=np.uint8)
    owner = np.repeat(np.arange(len(data)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = (np.cumsum(sizes + length) - sizes - length)[owner] + nth * step
    rows = np.lib.stride_tricks.sliding_window_view(buf, length)[starts] if len(owner) else np.empty((0, length), np.uint8)
    return rows, owner, np.minimum(length, sizes[owner] - nth * step) - np.where(nth > 0, share, 0)
