"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies and counts of hashed terms over all documents (partial counts a task, then a shuffle of counts).
2. A randomised SVD, by passes of Spark, of the TF-IDF rows of all the benchmark's items; every pass is A^T (A Q), summed by
   term block. The rank is at most half of the number of items. Words that no item has count in a window's length only.
3. Every window of every document, at lengths that grow by half over the range of the items' lengths, is put into the latent
   space by differences of running sums and compared with all items by cosine. The cosine that makes a candidate is not
   set by hand: it is the one that keeps a given share of simulated paraphrases of every item with as many replaced words
   as step 4 allows, placed anywhere between the windows; the new words follow the counts over all documents.
4. Candidates are checked by their longest common subsequence with the item, and with its answer (the last sentence).
Items of four to seven words are found as exact runs of words beside that.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.textkernels import word_batches
from panelspark.llm.workspace import Workspace

TERM_BITS = 18
BLOCK_ITEMS = 1 << 16
TERM_BLOCK = 256
_TABLE = bytes(32 if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def normal(text: str | None) -> bytes:
    """UTF-8, A-Z in lower case, other ASCII than letters and digits as spaces; null is empty."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE) if isinstance(text, str) else b""


def terms_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents that hold each hashed term and its places, over all documents, and the number of documents. What reaches the driver has
    at most 2^TERM_BITS + 1 rows."""

    def run(batches):
        total, places, n = np.zeros(1 << TERM_BITS, dtype=np.int64), np.zeros(1 << TERM_BITS, dtype=np.int64), 0
        for pdf in batches:
            n += len(pdf)
            for first, last, hashes, ptr in word_batches([normal(t) for t in pdf["text"]]):
                owner = np.repeat(np.arange(last - first), np.diff(ptr))
                terms = terms_of(hashes)
                places += np.bincount(terms, minlength=1 << TERM_BITS)
                keys = np.sort((owner << TERM_BITS) | terms)  # by far faster than the hash table of np.unique
                total += np.bincount(keys[np.diff(keys, prepend=-1) > 0] & ((1 << TERM_BITS) - 1), minlength=1 << TERM_BITS)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": np.append(some, -1), "n": np.append(total[some], n), "places": np.append(places[some], 0)})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "term bigint, n bigint, places bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("places").alias("places")).toPandas()
    df, places = np.zeros(1 << TERM_BITS), np.zeros(1 << TERM_BITS)
    real = rows[rows["term"] >= 0]
    df[real["term"]], places[real["term"]] = real["n"], real["places"]
    return df, places, int(rows.loc[rows["term"] < 0, "n"].sum())


def gram_pass(passages: DataFrame, own: np.ndarray, weights: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A^T (A q) for the passages' (text, scale) unit TF-IDF rows A over the terms `own` (sorted), each times its scale.
    Partial sums by term block."""
    n, r = q.shape
    sent = passages.sparkSession.sparkContext.broadcast((own, weights, q.astype(np.float32)))

    def run(batches):
        own, weights, q = sent.value
        total = np.zeros((n, r))
        for pdf in batches:
            for (at, w), scale in zip(passage_rows([normal(t) for t in pdf["text"]], own, weights), pdf["scale"], strict=True):
                if len(at):
                    total[at] += scale * scale * w[:, None] * (w @ q[at])
        for b in range(0, n, TERM_BLOCK):
            part = total[b : b + TERM_BLOCK]
            if part.any():
                yield pd.DataFrame({"block": [b], "part": [part.tobytes()]})

    def add(pdf):
        total = sum(np.frombuffer(p) for p in pdf["part"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [total.astype(np.float32).tobytes()]})

    rows = passages.select("text", "scale").mapInPandas(run, "block int, part binary").groupBy("block").applyInPandas(add, "block int, part binary").toPandas()
    sent.unpersist()
    out = np.zeros((n, r), np.float32)
    for b, p in zip(rows["block"], rows["part"], strict=True):
        out[b : b + TERM_BLOCK] = np.frombuffer(p, np.float32).reshape(-1, r)
    return out


def passage_rows(texts: list[bytes], own: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(term places, unit weights) of each text; the weight of a term is count x idf."""
    out = []
    for first, last, hashes, ptr in word_batches(texts):
        for i in range(last - first):
            terms, count = np.unique(terms_of(hashes[ptr[i] : ptr[i + 1]]), return_counts=True)
            at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
            known = own[at] == terms
            at, count = at[known], count[known]
            w = count * weights[at]
            norm = np.sqrt((w * w).sum())
            out.append((at, w / norm if norm else w))
    return out


def randomised_svd(passages: DataFrame, own: np.ndarray, weights: np.ndarray, rank: int, passes: int = 2, seed: int = 5) -> np.ndarray:
    """Basis (terms, rank) of the leading right singular vectors."""
    n = len(own)
    r = min(rank + 8, n)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, r)).astype(np.float32))[0]
    for _ in range(passes):
        q = np.linalg.qr(gram_pass(passages, own, weights, q))[0]
    values, vectors = np.linalg.eigh(q.T @ gram_pass(passages, own, weights, q))
    keep = np.argsort(-values)[:rank]
    keep = keep[values[keep] > 1e-9]
    return (q @ vectors[:, keep]).astype(np.float32)


def lcs_length(a: list[bytes], b: list[bytes]) -> int:
    """Longest common subsequence of two word lists, by rows of bits."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def answer_of(text: str) -> bytes:
    """The last sentence of an item."""
    parts = [p for p in re.split(r"[.!?\n]+", text) if normal(p).split()]
    return normal(parts[-1]) if parts else b""


class LatentSpace:
    """Terms' rows (the basis times idf; terms outside have a zero row), the squared idf of all terms, and what is made of them."""

    def __init__(self, own: np.ndarray, idf: np.ndarray, basis: np.ndarray):
        self.rows = np.concatenate([basis * idf[own][:, None], np.zeros((1, basis.shape[1]), np.float32)]).astype(np.float32)
        self.square = (idf * idf).astype(np.float32)
        self.place = np.full(1 << TERM_BITS, len(own), dtype=np.int32)
        self.place[own] = np.arange(len(own), dtype=np.int32)

    def windows(self, terms: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Latent vectors of terms[start:stop] over the length of their TF-IDF rows, each place for itself; starts rise. Running
        sums over the span of these windows."""
        lo = int(starts[0])
        part = terms[lo : int(stops.max())]
        places = self.place[part]
        known = places < len(self.rows) - 1  # other terms' rows are zero and stay out of the sums
        places, before = places[known], np.concatenate((np.zeros(1, np.int64), np.cumsum(known)))
        sums = np.zeros((len(places) // 16 + 1, 16, self.rows.shape[1]), np.float32)
        np.take(self.rows, places, axis=0, out=sums.reshape(-1, sums.shape[2])[1 : len(places) + 1], mode="clip")
        for j in range(1, 16):  # runs of 16 first, which is much faster than one running sum of rows
            sums[:, j] += sums[:, j - 1]
        sums[1:] += np.cumsum(sums[:-1, 15], axis=0)[:, None]
        sums = sums.reshape(-1, sums.shape[2])
        squares = np.concatenate((np.zeros(1), np.cumsum(self.square[part], dtype=np.float64)))
        starts, stops = starts - lo, stops - lo
        out = sums.take(before[stops], axis=0)
        out -= sums.take(before[starts], axis=0)
        out /= np.maximum(np.sqrt(squares[stops] - squares[starts]), 1e-6)[:, None].astype(np.float32)
        return out


def marked(mask: np.ndarray) -> np.ndarray:
    """Places of a flat mask's few set entries, eight at a time."""
    whole = len(mask) & ~7
    at = (8 * np.flatnonzero(mask[:whole].view(np.uint64))[:, None] + np.arange(8)).ravel()
    return np.concatenate((at[mask[at]], whole + np.flatnonzero(mask[whole:])))


class WordCounts:
    """How often each item, and its answer, has each of its terms."""

    def __init__(self, items: list[np.ndarray], answers: list[np.ndarray]):
        empty = np.empty(0, np.int64)
        keys, ends = (np.concatenate([empty, *[(k << TERM_BITS) | t for k, t in enumerate(x)]]) for x in (items, answers))
        self.keys = np.unique(np.concatenate([keys, ends]))
        self.count, self.count_answer = (np.bincount(np.searchsorted(self.keys, x), minlength=len(self.keys)) for x in (keys, ends))
        self.held = np.zeros(1 << TERM_BITS, dtype=bool)
        self.held[self.keys & ((1 << TERM_BITS) - 1)] = True

    def most(self, terms: np.ndarray, starts: np.ndarray, stops: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of item of[i], and of its answer, that can be matched at most in terms[starts[i]:stops[i]]: each as often as it is in
        both. In blocks of about 2^19 words."""
        out, out_answer = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        some = np.flatnonzero(self.held[terms])  # other words match nothing
        starts, stops, terms = np.searchsorted(some, starts), np.searchsorted(some, stops), terms[some]
        total, lo = np.cumsum(stops - starts), 0
        while lo < len(of):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 19))))
            size = (stops - starts)[lo:hi]
            owner = np.repeat(np.arange(hi - lo), size)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size - starts[lo:hi], size)
            key = (of[lo:hi][owner] << TERM_BITS) | terms[at]
            near = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[near] == key
            pair, n = np.unique(owner[hit] * len(self.keys) + near[hit], return_counts=True)
            who, near = pair // len(self.keys), pair % len(self.keys)
            for to, count in ((out, self.count), (out_answer, self.count_answer)):
                to[lo:hi] = np.bincount(who, weights=np.minimum(n, count[near]), minlength=hi - lo)
            lo = hi
        return out, out_answer


def grid(terms: np.ndarray, ptr: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the windows of texts terms[ptr[i]:ptr[i+1]], starts rising: each length steps by a quarter; one more
    ends with each text; texts shorter than the least length are one window."""
    owner = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    sizes = np.diff(ptr)
    short = (sizes < lengths[0]) & (sizes > 0)
    starts, stops = [ptr[:-1][short]], [ptr[1:][short]]
    for length in lengths:
        step = np.arange(0, len(terms) - length + 1, max(1, length // 4))
        step = step[owner[step] == owner[step + length - 1]] if len(step) else step
        last = ptr[1:][sizes >= length] - length
        starts += [step, last]
        stops += [step + length, last + length]
    a, b = np.concatenate(starts), np.concatenate(stops)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def lengths_of(sizes: list[int]) -> list[int]:
    """Window lengths: from the shortest item on, each half as long again, until one is within a half of the longest."""
    lengths = [max(min(sizes), 8)]
    while lengths[-1] * 1.5 < max(sizes):
        lengths.append(int(lengths[-1] * 1.5))
    return lengths


def gate_of(space: LatentSpace, items: list[np.ndarray], places: np.ndarray, lengths: list[int], replaced: float, recall: float, trials: int = 300, seed: int = 3) -> float:
    """The cosine at or above which `recall` of simulated paraphrases have a window: every item (as terms), as often as gives
    about `trials` in all, with a share `replaced` of its words drawn anew by the counts `places` of terms, between other words
    drawn so."""
    g = np.random.default_rng(seed)
    total = np.cumsum(places) if places.any() else np.ones(len(places)).cumsum()
    draw = lambda n: np.searchsorted(total, g.random(n) * total[-1], side="right")
    best = []
    for item in items * max(1, -(-trials // max(1, len(items)))):
        n = len(item)
        part = item.copy()
        at = g.choice(n, round(replaced * n), replace=False)
        part[at] = draw(len(at))
        left, right = (draw(n + int(g.integers(n))) for _ in "ab")
        terms = np.concatenate([left, part, right])
        a, b = grid(terms, np.array([0, len(terms)]), lengths)
        whole = space.windows(item, np.array([0]), np.array([n]))[0]
        best.append(float((space.windows(terms, a, b) @ whole).max()))
    return float(np.quantile(best, 1 - recall)) if best else 0.0


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", recall: float = 0.95, lcs: float = 0.8, lcs_with_answer: float = 0.6, answer: float = 0.8, rank: int = 96, least_words: int = 8, least_exact: int = 4) -> DataFrame:
    """(id, item_id, start_word, cosine, lcs_ratio, answer_ratio): for each document and item the best window of a leak.
    Fits the latent space by jobs when called; the search itself is lazy.

    A leak has an LCS with the item of at least `lcs` of its words, or of at least `lcs_with_answer` with at least `answer`
    of the answer's words in order, in or around a window whose latent cosine with the item is one that `recall` of
    simulated paraphrases reach (gate_of). The latent space is fitted on all items, weighted by the frequencies
    over all documents; its rank is at most `rank` and half of the items. All items are searched in one pass, 65,536 at a
    time. Items of under least_words words are leaks as exact runs (cosine 1); items of under least_exact words have no
    evidence of their own and never match. Null and empty texts match nothing; repeated rows give a row each id; an empty
    benchmark or table gives no rows. Ties take the first window. Very long texts are read whole; extra columns are ignored."""
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession)
    sc = spark.sparkContext
    kind = dict(docs.dtypes)[id_col]
    items = ws.save(benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), "items")
    schema = f"id string, item_id {dict(items.dtypes)['item_id']}, start_word bigint, cosine double, lcs_ratio double, answer_ratio double"
    n_items = items.count()
    df, places, n_docs = document_frequencies(docs, text_col)
    idf = np.maximum(np.log((n_docs + 1) / (df + 0.5)), 0.05).astype(np.float32)
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    found = None
    if n_items and n_docs:
        own = np.empty(0, np.int64)
        n_blocks = -(-n_items // BLOCK_ITEMS)
        blocks = []
        for b in range(n_blocks):
            rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).orderBy("item_id", "text").toPandas()
            rows["words"] = [normal(t).split() for t in rows["text"]]
            blocks.append(rows[[len(w) >= least_exact for w in rows["words"]]].reset_index(drop=True))
            for _, _, hashes, _ in word_batches([b" ".join(w) for w in blocks[-1]["words"]]):
                own = np.union1d(own, terms_of(hashes))
        own = own if len(own) else np.zeros(1, np.int64)
        space = LatentSpace(own, idf, randomised_svd(items.select("text", F.lit(1.0).alias("scale")), own, idf[own].astype(np.float64), max(1, min(rank, n_items // 2))))
        space = sc.broadcast(space)
        for rows in blocks:
            if len(rows):
                new = slim.mapInPandas(_searcher(sc, rows, space, places, recall, lcs, lcs_with_answer, answer, least_words), schema)
                found = new if found is None else found.unionByName(new)
    found = spark.createDataFrame([], schema) if found is None else found
    best = F.struct(F.col("lcs_ratio"), F.col("cosine"), -F.col("start_word"))
    out = found.groupBy("id", "item_id").agg(*[F.max_by(c, best).alias(c) for c in ("start_word", "cosine", "lcs_ratio", "answer_ratio")])
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def _searcher(sc, rows: pd.DataFrame, space, places: np.ndarray, recall: float, lcs: float, lcs_with_answer: float, answer: float, least_words: int):
    """The task of one block of items (item_id, text, words)."""
    words, ids = rows["words"].tolist(), rows["item_id"].tolist()
    answers = [answer_of(t).split() for t in rows["text"]]
    terms_list = []
    for first, last, hashes, ptr in word_batches([b" ".join(w) for w in words]):
        terms_list += [terms_of(hashes[ptr[i] : ptr[i + 1]]) for i in range(last - first)]
    long = [i for i, w in enumerate(words) if len(w) >= least_words]
    short: dict[int, dict[tuple, list[int]]] = {}
    for i, w in enumerate(words):
        if len(w) < least_words:
            short.setdefault(len(w), {}).setdefault(tuple(w), []).append(i)
    lengths, gate, latent = [8], 2.0, None
    if long:
        lengths = lengths_of([len(words[i]) for i in long])
        gate = gate_of(space.value, [terms_list[i] for i in long], places, lengths, 1 - lcs_with_answer, recall)
        latent = np.concatenate([space.value.windows(terms_list[i], np.array([0]), np.array([len(terms_list[i])])) for i in long])
    held = np.zeros(1 << TERM_BITS, dtype=bool)
    for i in long:
        held[terms_list[i]] = True
    firsts = {n: np.unique(np.array([terms_of(word_batches_one(w[0]))[0] for w in keys])) for n, keys in short.items()}
    sizes = np.array([len(words[i]) for i in long], dtype=np.int64)
    answer_sizes = np.array([len(answers[i]) for i in long], dtype=np.int64)
    table = WordCounts([terms_list[i] for i in long], [np.concatenate([np.empty(0, np.int64), *[terms_of(word_batches_one(w)) for w in answers[i]]]) for i in long])
    sent = sc.broadcast((words, ids, answers, terms_list, long, short, firsts, lengths, gate, latent, held, sizes, answer_sizes, table))

    def candidates(space, terms, a, b, latent, gate):
        """(windows, long items, cosines), in blocks of windows of neighbouring starts."""
        lo, found = 0, [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
        while lo < len(a):
            hi = min(lo + 4096, int(np.searchsorted(a, a[lo] + 16384)))
            scores = (space.windows(terms, a[lo:hi], b[lo:hi]) @ latent.T).ravel()
            at = marked(scores >= gate)
            found.append((lo + at // len(latent), at % len(latent), scores[at]))
            lo = hi
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def run(batches):
        words, ids, answers, terms_list, long, short, firsts, lengths, gate, latent, held, sizes, answer_sizes, table = sent.value
        sets = {}

        def checked(tokens, terms, lo, hi, i):
            n = len(words[i])
            if i not in sets:
                sets[i] = np.unique(terms_list[i])
            of = sets[i]
            near = np.minimum(np.searchsorted(of, terms[lo:hi]), len(of) - 1)
            if (of[near] == terms[lo:hi]).sum() < lcs_with_answer * n:  # at most so many can be in the subsequence
                return None
            share = lcs_length(words[i], tokens[lo:hi]) / n
            kept = lcs_length(answers[i], tokens[lo:hi]) / max(1, len(answers[i]))
            return (share, kept) if share >= lcs or (share >= lcs_with_answer and kept >= answer) else None

        for pdf in batches:
            found, data, keys = [], [normal(t) for t in pdf["text"]], pdf["id"].tolist()
            for first, last, hashes, ptr in word_batches(data):
                terms = terms_of(hashes)
                owner = np.repeat(np.arange(last - first), np.diff(ptr))
                best: dict[tuple[int, int], tuple] = {}
                tokens: dict[int, list[bytes]] = {}
                split = lambda i: tokens.setdefault(i, data[first + i].split()) if i not in tokens else tokens[i]  # noqa: E731,B023
                if long:
                    a, b = grid(terms, ptr, lengths)
                    share = np.concatenate(([0], np.cumsum(held[terms])))
                    ok = share[b] - share[a] >= 0.4 * (b - a)  # a leak has more of the items' words than that
                    a, b = a[ok], b[ok]
                    w, k, cosine = candidates(space.value, terms, a, b, latent, gate)
                    own = owner[a[w]]
                    s, length, n = a[w] - ptr[own], b[w] - a[w], sizes[k]
                    pad = np.maximum(0, n - length) + n // 2
                    x = {"own": own, "k": k, "place": (2 * s + length) // np.maximum(2, n // 2), "s": s, "cos": cosine, "left": np.maximum(0, s - pad), "right": s + length + pad}
                    order = np.lexsort((w, -cosine, x["place"], k, own))  # best cosine first in each place
                    x = {c: v[order] for c, v in x.items()}
                    heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(w)), bool), (np.diff(x["own"]) != 0) | (np.diff(x["k"]) != 0) | (np.diff(x["place"]) != 0)]))
                    ok = np.empty(0, bool)
                    if len(heads):
                        lo, hi = np.minimum.reduceat(x["left"], heads), np.maximum.reduceat(x["right"], heads)
                        at, of, tails = ptr[x["own"][heads]], x["k"][heads], np.append(heads[1:], len(w))
                        most, most_answer = table.most(terms, at + lo, np.minimum(at + hi, ptr[x["own"][heads] + 1]), of)
                        # at most so many words can be in the subsequences
                        ok = (most / sizes[of] >= lcs) | ((most / sizes[of] >= lcs_with_answer) & (most_answer / np.maximum(1, answer_sizes[of]) >= answer))
                    for p in np.flatnonzero(ok).tolist():
                        i, item, left, right = int(x["own"][heads[p]]), long[of[p]], int(lo[p]), int(hi[p])
                        own = terms[ptr[i] : ptr[i + 1]]
                        windows = [(int(x["s"][j]), float(x["cos"][j]), int(x["left"][j]), int(x["right"][j])) for j in range(heads[p], tails[p])]
                        # a subsequence of a part is one of the whole: where that fails, so do all windows
                        if (left, right) != windows[0][2:] and not checked(split(i), own, left, right, item):
                            continue
                        for s, cos, begin, end in windows:  # until one passes
                            hit = checked(split(i), own, begin, end, item)
                            if hit:
                                if (hit[0], cos, -s) > best.get((i, item), (-1.0,)):
                                    best[i, item] = (hit[0], cos, -s, hit[1])
                                break
                            if (begin, end) == (left, right):
                                break
                for n, keys_of in short.items():
                    for at in np.flatnonzero(np.isin(terms, firsts[n])).tolist():
                        i = int(owner[at])
                        s = at - int(ptr[i])
                        for item in keys_of.get(tuple(split(i)[s : s + n]), ()):
                            best.setdefault((i, item), (1.0, 1.0, -s, 1.0))
                found += [(keys[first + i], ids[item], -s, cos, share, kept) for (i, item), (share, cos, s, kept) in best.items()]
            if found:
                yield pd.DataFrame(found, columns=["id", "item_id", "start_word", "cosine", "lcs_ratio", "answer_ratio"])

    return run


def word_batches_one(word: bytes) -> np.ndarray:
    """The hash of one word."""
    return next(word_batches([word]))[2]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold a leak. Runs jobs when called. Rows with null ids are judged by a hash of their text, null and
    empty texts hold none, repeated rows stay or go together, rows of one id go if any of them holds one; very long texts are
    read whole, extra columns stay, an empty table or benchmark changes nothing."""
    key = F.coalesce(F.col(id_col).cast("string"), F.sha2(F.coalesce(text_col, F.lit("")), 256))
    keyed = docs.withColumn("__key", key)
    leaks = find_leaks(keyed, benchmark, "__key", text_col)
    bad = Workspace(docs.sparkSession).save(leaks.select(F.col("__key").alias("__bad")).distinct(), "leaks")
    return keyed.join(bad, F.col("__key") == F.col("__bad"), "left_anti").drop("__key")
