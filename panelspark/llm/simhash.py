"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Masks. Every bit position i gets a vector m(i) in {0,1}^(r+1); table v (non-zero, in {0,1}^(r+1)) compares the positions
with <m(i), v> = 1. At most r differing positions span at most r dimensions, so some v is orthogonal to all of them, and
that table's key is equal: every pair within radius r meets in a table. About half of the positions are in a mask.

Large buckets. A bucket of more than `most` fingerprints is dealt again, its key joined with that of a second covering whose
vectors are assigned anew, then a third. A pair within radius r has an orthogonal v in each covering, so it still meets.
Each level leaves about half of the free positions, so a last bucket of distinct fingerprints is bounded by 2^free.
Inside a bucket all distances are taken, and one link per member is returned (to the smallest member of its connected
part), so groups of copies never make all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.components import connected_components
from panelspark.llm.textkernels import encoded, majority_bits, mix, shingle_hashes, word_batches
from panelspark.llm.workspace import Workspace


def _xxh64_fingerprint(text: bytes, k: int) -> np.ndarray:
    words = text.split()  # of bytes: splits at exactly \x20 and \x09-\x0D
    if not words:
        return np.zeros(1, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(words) - k + 1)
    return majority_bits(hashes[:, None])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, sig array of one long) from XXH64 (seed 42) of space-joined shingles. Null and wordless texts have zero bits."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "sig": [_xxh64_fingerprint(t, shingle).view(np.int64) for t in encoded(pdf["text"])]})

    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))  # a string: pandas has no null integers
    return slim.mapInPandas(run, "id string, sig array<bigint>").withColumn("id", F.col("id").cast(kind))


def covering_masks(positions: list[int], radius: int, level: int = 0) -> list[int]:
    """2^(radius+1) - 1 masks over the given positions, as signed 64-bit values (module docstring)."""
    size = 2 ** (radius + 1) - 1
    order = sorted(positions, key=lambda p: (p * (0, 29, 47)[level] + level) % 67) if level else positions
    vectors = {p: j % size + 1 for j, p in enumerate(order)}
    masks = [sum(1 << p for p, m in vectors.items() if (m & v).bit_count() % 2) for v in range(1, size + 1)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _parts(sigs: np.ndarray, limit: int) -> np.ndarray:
    """For each row of sigs (g, m) the index of the first row that it is connected to over distances up to limit."""
    label = np.arange(len(sigs))
    for i in range(len(sigs) - 1):
        near = np.flatnonzero(np.bitwise_count(sigs[i + 1 :] ^ sigs[i]).sum(axis=1) <= limit) + i + 1
        if len(near):
            parts = np.unique(np.append(label[near], label[i]))
            if len(parts) > 1:
                label[np.isin(label, parts)] = parts[0]
    return label


def _near_pairs(labels: np.ndarray, sigs: np.ndarray, limit: int, whole: int = 64, nearest: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of sigs (g, m) with different labels and at most `limit` differing bits. Up to `whole` rows
    give all of them; more rows those of a spanning forest of the shortest links (Prim; rows of one label are one) and
    those of each row with its `nearest` nearest rows of other labels."""
    g = len(sigs)
    if g <= whole:
        i, j = np.triu_indices(g, 1)
        near = (labels[i] != labels[j]) & (np.bitwise_count(sigs[i] ^ sigs[j]).sum(axis=1) <= limit)
        return i[near], j[near]
    best, by, left, at = np.full(g, 1 << 20), np.zeros(g, dtype=np.int64), np.ones(g, dtype=bool), 0
    out = []
    for step in range(g):
        left[at] = False
        far = np.bitwise_count(sigs ^ sigs[at]).sum(axis=1).astype(np.int64)
        other = np.flatnonzero((labels != labels[at]) & (far <= limit))
        if len(other) > nearest:
            other = other[np.argsort(far[other], kind="stable")[:nearest]]
        out += [(at, j) for j in other.tolist()]
        far[labels == labels[at]] = 0
        closer = left & (far < best)
        best[closer], by[closer] = far[closer], at
        if step < g - 1:
            at = int(np.where(left, best, 1 << 21).argmin())
            if 0 < best[at] <= limit:
                out.append((by[at], at))
    pairs = np.unique(np.sort(np.array(out, dtype=np.int64).reshape(-1, 2), axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def covering_links(nodes: DataFrame, ws: Workspace, radius: int, positions: list[int], most: int = 16384) -> DataFrame:
    """nodes (node long, unique; sig array<long>) -> links (a, b) that connect all signatures that are connected over steps
    of at most `radius` differing bits of sig[0], which the masks guarantee to meet."""
    held_sig = F.concat(F.array("node"), "sig")

    def links(batches):
        for pdf in batches:
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for flat, n in zip(pdf["members"], pdf["n"], strict=True):
                rows = np.asarray(flat, dtype=np.int64).reshape(n, -1)
                rows = rows[np.argsort(rows[:, 0], kind="stable")]
                label = _parts(rows[:, 1:].view(np.uint64), radius)
                moved = np.flatnonzero(label != np.arange(n))
                a.append(rows[label[moved], 0])
                b.append(rows[moved, 0])
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    found = None
    fps = nodes.select("node", F.col("sig")[0].alias("fp"))
    dealt = fps.withColumn("mask", F.lit(0).cast("bigint"))
    for level in range(3):
        masks = F.array(*[F.lit(m).cast("bigint") for m in covering_masks(positions, radius, level)])
        dealt = dealt.select("node", "fp", F.col("mask").alias("was"), F.explode(masks).alias("m")).select("node", "fp", F.col("was").bitwiseOR(F.col("m")).alias("mask"))
        dealt = dealt.select("node", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))  # narrow rows: these are shuffled
        if level:
            dealt = ws.save(dealt.distinct(), f"dealt{level}")
        sizes = ws.save(dealt.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"buckets{level}")
        held = dealt.join(sizes, ["mask", "key"])
        last = level == 2 or sizes.where(F.col("n") > most).limit(1).count() == 0
        small = held if last else held.where(F.col("n") <= most)
        members = small.select("mask", "key", "node").join(nodes, "node").groupBy("mask", "key").agg(F.collect_list(held_sig).alias("x"))
        new = members.select(F.size("x").alias("n"), F.flatten("x").alias("members")).mapInPandas(links, "a bigint, b bigint")
        found = new if found is None else found.unionByName(new)
        if last:
            return found.distinct()
        dealt = held.where(F.col("n") > most).select("node", "mask").join(fps, "node")
    return found


def bucket_key() -> Column:
    return F.xxhash64("base", "used", F.expr("transform(anchors, (x, i) -> if(shiftright(used, i) % 2 = 1, x, 0L))"))


def _pairs_within(limit: int):
    """The task that turns buckets (n, members: node, label, sig) into candidate pairs (a, b), a < b; see _near_pairs."""

    def pairs(batches):
        for pdf in batches:
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for flat, n in zip(pdf["members"], pdf["n"], strict=True):
                rows = np.asarray(flat, dtype=np.int64).reshape(n, -1)
                rows = rows[np.argsort(rows[:, 0], kind="stable")]
                i, j = _near_pairs(rows[:, 1], np.ascontiguousarray(rows[:, 2:]).view(np.uint64), limit)
                a.append(np.minimum(rows[i, 0], rows[j, 0]))
                b.append(np.maximum(rows[i, 0], rows[j, 0]))
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return pairs


def pairs_of_buckets(entries: DataFrame, nodes: DataFrame, ws: Workspace, limit: int, most: int = 2048) -> DataFrame:
    """entries (node, label, base, used, key) deal nodes (node, label, sig of 256 bits, anchors) into buckets, by base and by
    the anchors whose bits are set in used (bucket_key) -> candidate pairs (a, b), a < b: of one bucket, of different labels, within `limit`
    bits (see _near_pairs).

    A bucket of more than `most` nodes is never collected whole. If all but most / 2 of its nodes have one label, those are
    cut into parts, and the others, which stand in every part, meet all of them. Else it is dealt again by one more anchor,
    then another (a pair shares each with the probability of its similarity), then by a covering of radius 3 over 28 bits
    of the signature. What is larger still has two equal anchors and equal bits besides; it is cut by a hash, and its
    smallest node stands in every part, which ties a group of copies together. Buckets of one label cost a row a task."""
    masks = F.array(*[F.lit(m).cast("bigint") for m in covering_masks(list(range(28)), 3)])
    slim = F.concat(F.array("node", "label"), "sig")
    found = None

    def met(members: DataFrame) -> DataFrame:
        lists = members.join(nodes.select("node", "label", "sig"), "node").groupBy("key").agg(F.collect_list(slim).alias("x"))
        return lists.select(F.size("x").alias("n"), F.flatten("x").alias("members")).mapInPandas(_pairs_within(limit), "a bigint, b bigint")

    rows = entries
    for level in range(4):
        rows = ws.save(rows.select("node", "label", "base", "used", "key"), f"dealt{level}")
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("node").alias("least")).where("l0 <> l1")
        sizes = ws.save(sizes.select("key", "n", "least"), f"buckets{level}")
        new = met(rows.join(sizes.where(F.col("n") <= most), "key").select("node", "key"))
        found = new if found is None else found.unionByName(new)
        if sizes.where(F.col("n") > most).limit(1).count() == 0:
            break
        large = ws.save(rows.join(sizes.where(F.col("n") > most), "key"), f"large{level}")
        tops = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("top"), (F.sum("c") - F.max("c")).alias("others"))
        large = large.join(ws.save(tops, f"tops{level}"), "key")
        parts = F.ceil(F.col("n") / (most // 2)).cast("int")
        own = F.array(F.pmod(F.xxhash64("node", "key"), parts).cast("int"))
        every = F.sequence(F.lit(0), parts - 1)
        few = F.col("others") <= most // 2
        at = F.when(few & (F.col("label") != F.col("top")), every).when(~few & (F.col("node") == F.col("least")), every).otherwise(own)
        cut = large if level == 3 else large.where(few)
        found = found.unionByName(met(cut.select("node", F.explode(at).alias("p"), "key").select("node", F.xxhash64("key", "p").alias("key"))))
        rest = large.where(~few)
        if level < 2:
            rest = rest.select("node", "label", "base", F.explode(F.expr("transform(filter(sequence(0, 5), k -> shiftright(used, k) % 2 = 0), k -> used + shiftleft(1, k))")).alias("used")).distinct()
            rows = rest.join(nodes.select("node", "anchors"), "node").withColumn("key", bucket_key())
        else:
            word = F.element_at(F.array(*[_word(40 * k) for k in range(6)]), F.col("used") % 6 + 1)
            rest = rest.join(nodes.select("node", "sig"), "node").select("node", "label", "base", "used", "key", word.alias("w"), F.explode(masks).alias("m"))
            rows = rest.withColumn("key", F.xxhash64("key", "m", F.col("w").bitwiseAND(F.col("m"))))
    return found.distinct()


def _all_pairs(limit: int, most: int = 1 << 20):
    """The task that turns groups (g, n, members: node, label, block, sig) into all pairs (a, b, far, g), a < b, of different labels
    within `limit` bits; where a group has several blocks, those of different blocks only. About `most` pairs are held at once."""

    def pairs(batches):
        for pdf in batches:
            parts, held = [], 0
            for g, flat, n in zip(pdf["g"], pdf["members"], pdf["n"], strict=True):
                rows = np.asarray(flat, dtype=np.int64).reshape(n, -1)
                rows = rows[np.argsort(rows[:, 0], kind="stable")]
                node, label, block, sigs = rows[:, 0], rows[:, 1], rows[:, 2], np.ascontiguousarray(rows[:, 3:]).view(np.uint64)
                several = bool((block != block[0]).any())
                for i in range(n - 1):
                    far = np.bitwise_count(sigs[i + 1 :] ^ sigs[i]).sum(axis=1)
                    near = (far <= limit) & (label[i + 1 :] != label[i])
                    at = np.flatnonzero(near & (block[i + 1 :] != block[i]) if several else near)
                    if len(at):
                        parts.append(pd.DataFrame({"a": node[i], "b": node[i + 1 + at], "far": far[at].astype(np.int32), "g": g}))
                        held += len(at)
                    if held > most:
                        yield pd.concat(parts)
                        parts, held = [], 0
            if held:
                yield pd.concat(parts)

    return pairs


def rest_of_buckets(entries: DataFrame, nodes: DataFrame, ws: Workspace, limit: int, whole: int = 64, most: int = 2048) -> DataFrame:
    """entries, nodes as in pairs_of_buckets -> (a, b, far, g), a < b: all pairs of different labels within `limit` bits of the
    buckets of more than `whole` nodes, of which pairs_of_buckets gives only some; g is a group of about `most` nodes that holds both.

    A bucket of more than `most` nodes goes in blocks of most / 2: those of its commonest label and those of all others; every
    block of others meets every block, two of the commonest label never meet. So a group holds about `most` nodes, and the rows
    grow with nodes times blocks of others: one block, unless links are missing between many."""
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1")).where((F.col("l0") != F.col("l1")) & (F.col("n") > whole))
    rows = ws.save(entries.select("node", "label", "key").join(sizes.select("key", "n"), "key"), "unmet")
    tops = rows.where(F.col("n") > most).groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    tops = ws.save(tops.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.max("c").alias("c")), "unmet-tops")
    rows = rows.join(tops, "key", "left")
    blocks = lambda n: F.greatest(F.ceil(n / (most // 2)), F.lit(1)).cast("int")
    small = F.col("top").isNull()
    is_top, tp, op = ~small & (F.col("label") == F.col("top")), blocks(F.coalesce("c", F.lit(0))), F.when(small, 1).otherwise(blocks(F.col("n") - F.coalesce("c", F.lit(0))))
    rows = rows.select("key", "node", small.alias("small"), is_top.alias("is_top"), tp.alias("tp"), op.alias("op"), F.pmod(F.xxhash64("node", "key"), F.when(is_top, tp).otherwise(op)).cast("int").alias("own"))
    with_top = F.transform(F.sequence(F.lit(0), F.when(F.col("is_top"), F.col("op")).otherwise(F.col("tp")) - 1), lambda q: F.struct(F.lit(0).alias("kind"), F.when(F.col("is_top"), F.col("own")).otherwise(q).alias("p"), F.when(F.col("is_top"), q).otherwise(F.col("own")).alias("q")))
    others = F.transform(F.sequence(F.lit(0), F.col("op") - 1), lambda q: F.struct(F.lit(1).alias("kind"), F.least(F.col("own"), q).alias("p"), F.greatest(F.col("own"), q).alias("q")))
    groups = F.when(F.col("small"), others).when(F.col("is_top"), with_top).otherwise(F.concat(with_top, others))
    block = F.when(F.col("is_top"), F.lit(-1)).otherwise(F.col("own")).cast("bigint")
    dealt = rows.select("key", "node", block.alias("block"), F.inline(groups))
    slim = F.concat(F.array("node", "label", "block"), "sig")
    lists = dealt.join(nodes.select("node", "label", "sig"), "node").groupBy("key", "kind", "p", "q").agg(F.collect_list(slim).alias("x"))
    lists = lists.select(F.xxhash64("key", "kind", "p", "q").alias("g"), F.size("x").alias("n"), F.flatten("x").alias("members"))
    found = lists.mapInPandas(_all_pairs(limit), "a bigint, b bigint, far int, g bigint")
    return found.groupBy("a", "b").agg(F.min("far").alias("far"), F.min("g").alias("g"))


def pairs_with_leaders(entries: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """Candidate pairs (a, b) of each node and the smallest node of each of its buckets, within `limit` bits: a row an entry,
    however large the bucket."""
    least = entries.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a")
    pairs = entries.join(least, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    x, y = (nodes.select(F.col("node").alias(c), F.col("sig").alias(d)) for c, d in (("a", "x"), ("b", "y")))
    far = sum([F.bit_count(F.col("x")[k].bitwiseXOR(F.col("y")[k])) for k in range(4)], F.lit(0))
    return pairs.join(x, "a").join(y, "b").where(far <= limit).select("a", "b")


def _word(at: int) -> Column:
    """64 bits of the signature from bit `at` on, the first lowest."""
    at, bit = divmod(at, 64)
    low = F.col("sig")[at]
    return low if bit == 0 else F.shiftrightunsigned(low, bit).bitwiseOR(F.shiftleft(F.col("sig")[(at + 1) % 4], 64 - bit))


def hamming_components(sigs: DataFrame, ws: Workspace, radius: int, positions: list[int]) -> DataFrame:
    """sigs (id, sig, ...) -> sigs with component: the smallest id reachable over links of at most `radius` differing
    bits, itself included (null ids count as largest). Equal signatures are one node: copies make no pairs."""
    sigs = ws.save(sigs.withColumn("node", F.col("sig")[0]), "sigs")
    nodes = ws.save(sigs.groupBy("node").agg(F.first("sig").alias("sig"), F.min("id").alias("least")), "nodes")
    links = covering_links(nodes.select("node", "sig"), ws, radius, positions)
    labels = ws.save(connected_components(links, ws), "components")
    return sigs.join(least_ids(nodes, labels, ws), "node").drop("node")


def least_ids(nodes: DataFrame, labels: DataFrame, ws: Workspace) -> DataFrame:
    """nodes (node, least), labels (node, label) -> (node, component): the smallest `least` of the node's component."""
    placed = nodes.select("node", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = ws.save(placed, "placed")
    least = ws.save(placed.groupBy("label").agg(F.min("least").alias("component")), "smallest")  # written: a join with a plain table can split a large component
    return ws.save(placed.join(least, "label").select("node", "component"), "least")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(id, fingerprint 16 hex digits, component_id) per row of docs, complete for fingerprints within radius.

    Null, empty and wordless texts have fingerprint zero and link like any other. Repeated rows and ids give a row each;
    a null id keeps its row and never is a component_id unless the component has no other id. An empty table gives no
    rows. Extra columns are ignored. Texts are read whole; only ids and fingerprints are shuffled."""
    ws = Workspace(docs.sparkSession)
    sigs = fingerprints(docs, id_col, text_col, shingle)
    out = hamming_components(sigs, ws, radius, list(range(64)))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex(F.col("sig")[0]), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


ANCHORS = 6
MOST_BROADCAST = 1_000_000  # keys of 8 bytes


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """docs (id string, text) -> (id, node, sig of 256 bits, anchors, shingles), all of the distinct shingles of a text: node
    is a hash of the set, anchors are its smallest members under six mixings, shingles the packed sorted 32-bit hashes.
    Null and wordless texts have zero bits, zero anchors and no shingle."""

    def run(batches):
        for pdf in batches:
            node, sigs, anchors, sets = [], [], [], []
            for first, last, hashes, ptr in word_batches(encoded(pdf["text"])):
                for i in range(last - first):
                    h = np.unique(shingle_hashes(hashes[ptr[i] : ptr[i + 1]], shingle))
                    sigs.append(majority_bits(np.stack([mix(h, s + 2) for s in range(4)], axis=1)).view(np.int64))
                    anchors.append(np.array([mix(h, s + 11).min() if len(h) else 0 for s in range(ANCHORS)], dtype=np.uint64).view(np.int64))
                    sets.append(np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes())
                    node.append(xxhash.xxh64_intdigest(h.tobytes(), 3) - (1 << 63))
            yield pd.DataFrame({"id": pdf["id"], "node": node, "sig": sigs, "anchors": anchors, "shingles": sets})

    return docs.mapInPandas(run, "id string, node bigint, sig array<bigint>, anchors array<bigint>, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, shingles) have a Jaccard similarity of at least `similarity`; two empty sets are equal."""

    def run(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                u, v = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(u, v, assume_unique=True)) if min(len(u), len(v)) >= similarity * max(len(u), len(v)) else 0
                keep.append(both >= similarity * (len(u) + len(v) - both) - 1e-9)
            yield pdf.loc[np.array(keep, dtype=bool), ["a", "b"]]

    x, y = (sets.select(F.col("node").alias(c), F.col("shingles").alias(d)) for c, d in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(run, "a bigint, b bigint")


def verified_in_groups(pairs: DataFrame, sets: DataFrame, ws: Workspace, similarity: float, most: int = 8 << 20) -> DataFrame:
    """pairs (a, b, far, g), sets (node, label, shingles) -> those pairs (a, b) of a Jaccard similarity of at least `similarity` that
    connect all labels which such pairs of their group connect. A set goes to each group once; nearest pairs come first, and those
    of labels that are connected by then need no comparison. Groups with sets of over `most` bytes go in parts."""
    ends = lambda df, *by: df.select(*by, F.explode(F.array("a", "b")).alias("node")).distinct().join(sets, "node")
    parts = ends(pairs, "g").groupBy("g").agg(F.ceil(F.sum(F.octet_length("shingles")) / most).cast("int").alias("n")).where("n > 1")
    parts = ws.save(parts, "parts")
    dealt = pairs.join(parts, "g", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    dealt = ws.save(dealt.select("a", "b", "far", F.xxhash64("g", F.pmod(F.xxhash64("a"), "n"), F.pmod(F.xxhash64("b"), "n")).alias("g")), "dealt-pairs")

    def run(near: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        own = {n: np.frombuffer(x, np.uint32) for n, x in zip(held["node"], held["shingles"], strict=True)}
        up, label = {}, dict(zip(held["node"], held["label"], strict=True))

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        keep = []
        near = near.sort_values(["far", "a", "b"])
        for a, b in zip(near["a"], near["b"], strict=True):
            x, y, u, v = root(label[a]), root(label[b]), own[a], own[b]
            if x != y and min(len(u), len(v)) >= similarity * max(len(u), len(v)):
                both = len(np.intersect1d(u, v, assume_unique=True))
                if both >= similarity * (len(u) + len(v) - both) - 1e-9:
                    up[y] = x
                    keep.append((a, b))
        return pd.DataFrame(keep, columns=["a", "b"], dtype="int64")

    held = ends(dealt, F.col("g").alias("of"))
    return dealt.groupBy("g").cogroup(held.groupBy("of")).applyInPandas(run, "a bigint, b bigint")


def row_key(id_col: str, text_col: str) -> Column:
    """A string that orders rows by id (a bigint), null ids last, then by the MD5 of the text; null texts are empty."""
    number = F.hex(F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63))))
    return F.concat(F.when(F.col(id_col).isNull(), "1").otherwise("0"), F.lpad(number, 16, "0"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Keeps one row of each group of near duplicates: that with the smallest id. Columns stay as they are.

    Two texts are near when their distinct shingles of five words have a Jaccard similarity of at least `similarity`; every
    link is checked on the sets. Equal sets are one node. Candidates are pairs within `limit` of 256 SimHash bits (the
    expected share of differing bits at `similarity`, arccos(2s / (1 + s)) / pi, plus 2.5 standard deviations) that meet:
    1. in one of the 15 tables of a covering of radius 3 over the first 64 bits, as all within that radius do;
    2. at a smaller similarity, where fingerprints differ in more bits than any covering of practical size allows, in a
       group that shares the smallest shingle under one of six mixings (a pair shares each with the probability of its
       similarity, whatever the size of the corpus).
    Before both, every text is compared with the smallest node of each of its groups, and each step contracts what the one
    before has linked, so a group of copies makes few candidates later. In groups of more than 64 texts, nearest pairs are
    taken first (pairs_of_buckets), then all others that these have not linked (rest_of_buckets, verified_in_groups).

    Rows are told apart by id and text, so null and repeated ids lose no other text; of rows equal in both one stays. Ties
    of ids go by a hash of the text. Rows with null ids go last. Wordless texts are one group. Very long texts are read
    whole; extra columns stay. An empty table gives no rows."""
    ws = Workspace(docs.sparkSession)
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    limit = round(256 * share + 2.5 * (256 * share * (1 - share)) ** 0.5)
    key = row_key(id_col, text_col)
    sigs = ws.save(signatures(docs.select(key.alias("id"), F.col(text_col).alias("text")), shingle), "signatures")
    nodes = sigs.groupBy("node").agg(F.first("sig").alias("sig"), F.first("anchors").alias("anchors"), F.min("id").alias("least"))
    nodes = ws.save(nodes, "nodes")
    masks = F.array(*[F.lit(m).cast("bigint") for m in covering_masks(list(range(64)), 3)])
    deal = {
        "leaders": lambda df: df.select("node", F.posexplode("anchors").alias("k", "x")).select("node", F.xxhash64("k", "x").alias("key")),
        "covering": lambda df: df.select("node", "label", "anchors", F.col("sig")[0].alias("w"), F.explode(masks).alias("m")).select("node", "label", "anchors", F.xxhash64("m", F.col("w").bitwiseAND(F.col("m"))).alias("base"), F.lit(0).alias("used")),
        "anchors": lambda df: df.select("node", "label", "anchors", F.lit(0).cast("bigint").alias("base"), F.explode(F.array(*[F.lit(1 << k) for k in range(ANCHORS)])).alias("used")),
    }
    labels, held = None, nodes.withColumn("label", F.col("node"))

    def linked(pairs: DataFrame, name: str, in_groups: bool = False) -> tuple[DataFrame, DataFrame]:
        wanted = ws.save(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "least"), "node"), "wanted")
        some = sigs.select(F.col("id").alias("least"), "node", "shingles")
        if wanted.count() <= MOST_BROADCAST:  # sets of other texts are not shuffled then
            some = some.join(F.broadcast(wanted.select("node")), "node", "left_semi")
        sets = some.join(wanted, ["least", "node"]).dropDuplicates(["node"])
        sets = ws.save(sets, "sets")
        links = verified_in_groups(pairs, sets.join(held.select("node", "label"), "node"), ws, similarity) if in_groups else verified(pairs, sets, similarity)
        links = links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        found = ws.save(connected_components(ws.save(links, "links"), ws), f"{name}-components")
        return found, ws.save(nodes.select("node", "sig", "anchors").join(found, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")

    for name in deal:
        entries = deal[name](held)
        pairs = pairs_with_leaders(ws.save(entries, "entries"), held, limit) if name == "leaders" else pairs_of_buckets(entries.withColumn("key", bucket_key()), held, ws, limit)
        pairs = ws.save(pairs, f"{name}-pairs")
        labels, held = linked(pairs, name)
        if name == "leaders":
            continue
        rest = rest_of_buckets(deal[name](held).withColumn("key", bucket_key()), held, ws, limit)
        rest = ws.save(rest.join(pairs, ["a", "b"], "left_anti"), f"{name}-rest")
        if rest.limit(1).count():
            labels, held = linked(rest, f"{name}-rest", True)
    least = least_ids(nodes, labels, ws)
    gone = ws.save(sigs.select("id", "node").join(least, "node").where("id <> component").select("id").distinct(), "gone")
    twice = sigs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    marked = ws.save(gone.unionByName(twice).select(F.xxhash64("id").alias("__hash")).distinct(), "marked")
    keyed, first = docs.withColumn("__key", key), lambda df: df.join(gone.withColumnRenamed("id", "__gone"), F.col("__key") == F.col("__gone"), "left_anti").dropDuplicates(["__key"])
    if marked.count() > MOST_BROADCAST:
        return first(keyed).drop("__key")
    # only rows that go or stand twice are shuffled, all others stay where they are
    hashed, marked = keyed.withColumn("__hash", F.xxhash64("__key")), F.broadcast(marked)
    out = hashed.join(marked, "__hash", "left_anti").unionByName(first(hashed.join(marked, "__hash", "left_semi")))
    return out.drop("__key", "__hash")
