"""SentencePiece encoding by sampling over the piece lattice, and lossless decoding.

A segmentation is drawn with probability proportional to the product of its pieces' weights by forward filtering and
backward sampling. The draw at each place depends on the row's key and the place only, so results do not depend on how
rows are batched or dealt. The forward pass runs once for each distinct chunk of a batch, the backward pass over all chunks
at once, both in numpy. Chunks are cut only where no piece of the vocabulary can cross: before a run of spaces (checked
when loaded) and between ASCII characters that stand side by side in no piece.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.textkernels import BASE, INVERSE, mix

#: Fixed symbols of the piece format.
SPACE_MARK = 0x2581
LITERAL_MARK = 0x110000  # a mark that stands in the text itself; no code point, so it takes byte pieces
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_CHARS = 1 << 19  # of texts that are encoded at once, about 250 bytes of arrays each


class Lattice:
    """The vocabulary as arrays: for each piece length, sorted hashes, ids and log weights."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1, dtype=np.int32)
        by_length: dict[int, list[tuple[int, int]]] = {}
        seen: list[tuple[int, str]] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[self.bytes_of[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                seen.append((i, piece))
                self.bytes_of[i] = piece.replace("▁", " ").encode()
                if "▁" in piece.lstrip("▁"):
                    raise ValueError("a piece crosses the start of a word")
        if (self.byte_id < 0).any():
            raise ValueError("byte pieces are missing")
        # the log weight of a piece follows its rank (Zipf), whatever scale the model's scores have
        order = sorted(seen, key=lambda x: (-sp.get_score(x[0]), x[0]))
        weight = {i: -alpha * float(np.log(r + 2)) for r, (i, _) in enumerate(order)}
        self.fallback = -alpha * float(np.log(len(order) + 2))  # for each byte
        for i, piece in seen:
            by_length.setdefault(len(piece), []).append((int(_hash(np.array([ord(c) for c in piece], dtype=np.uint64))), i))
        self.tables = {}
        for length, rows in by_length.items():
            rows.sort()
            ids = np.array([i for _, i in rows], dtype=np.int32)
            self.tables[length] = np.array([h for h, _ in rows], dtype=np.uint64), ids, np.array([weight[i] for i in ids])
        # leading hash bits of all beginnings of pieces: a walk from a place ends where none can go on
        heads: dict[int, set[str]] = {}
        for _, piece in seen:
            for k in range(1, len(piece) + 1):
                heads.setdefault(k, set()).add(piece[:k])
        self.heads = {}
        for length, texts in sorted(heads.items()):
            codes = np.array([[ord(c) for c in t] for t in texts], dtype=np.uint64)
            power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(length - 1, BASE, dtype=np.uint64))), dtype=np.uint64)
            bits = np.zeros(1 << 20, dtype=bool)
            bits[(mix(((codes + np.uint64(1)) * power).sum(axis=1, dtype=np.uint64)) >> np.uint64(44)).astype(np.int64)] = True
            self.heads[length] = bits
        # pairs of ASCII characters (128: the space mark) that stand side by side in some piece
        self.joined = np.zeros((129, 129), dtype=bool)
        place = lambda c: 128 if c == "▁" else ord(c)
        for _, piece in seen:
            for a, b in zip(piece[:-1], piece[1:], strict=True):
                if place(a) < 129 and place(b) < 129:
                    self.joined[place(a), place(b)] = True


@functools.lru_cache(maxsize=2)
def lattice(path: str, alpha: float) -> Lattice:
    return Lattice(path, alpha)


def _hash(codes: np.ndarray) -> np.uint64:
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(codes) - 1, BASE, dtype=np.uint64))), dtype=np.uint64)
    return mix(np.array([((codes + np.uint64(1)) * power).sum(dtype=np.uint64)]))[0]


def _prefix(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(codes)
    up = np.full(n + 1, BASE, dtype=np.uint64)
    down = np.full(n + 1, INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes + np.uint64(1)) * up[:n], out=sums[1:])
    return sums, down


def _utf8_len(codes: np.ndarray) -> np.ndarray:
    codes = np.where(codes == LITERAL_MARK, SPACE_MARK, codes)
    return 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)


def _forward(lat: Lattice, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Lattices of the chunks codes[starts:ends] (laid end to end, in order). Returns the edges grouped by end node:
    (first edge of each end place, start place, piece or -1, cumulative share), places counted over all codes."""
    n = len(codes)
    sums, down = _prefix(codes)
    chunk_start = np.repeat(starts, ends - starts)
    depth = np.arange(n) - chunk_start  # of the place before a code
    e_from, e_to, e_piece, e_weight = [], [], [], []
    single = np.zeros(n, dtype=bool)
    chunk_end = np.repeat(ends, ends - starts)
    at = np.arange(n)
    for length, heads in lat.heads.items():
        at = at[at + length <= chunk_end[at]]
        h = mix((sums[at + length] - sums[at]) * down[at])
        on = heads[(h >> np.uint64(44)).astype(np.int64)]
        at, h = at[on], h[on]
        if not len(at):
            break
        if length not in lat.tables:
            continue
        hashes, ids, weights = lat.tables[length]
        k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[k] == h
        found, k = at[hit], k[hit]
        if length == 1:
            single[found] = True
        e_from.append(found)
        e_to.append(found + length)
        e_piece.append(ids[k])
        e_weight.append(weights[k])
    rest = np.flatnonzero(~single)
    e_from.append(rest)
    e_to.append(rest + 1)
    e_piece.append(np.full(len(rest), -1, dtype=np.int32))
    e_weight.append(lat.fallback * _utf8_len(codes[rest].astype(np.int64)))
    src, dst, piece, weight = map(np.concatenate, (e_from, e_to, e_piece, e_weight))
    del e_from, e_to, e_piece, e_weight, chunk_start, chunk_end, sums, down
    # by depth of the end place within its chunk, then by place: every level needs earlier levels only
    level = depth[dst - 1] + 1
    order = np.lexsort((src, dst, level))
    src, dst, piece, weight, level = src[order], dst[order], piece[order], weight[order], level[order]
    alpha = np.zeros(n + 1)  # of the place after code i, at i + 1; a chunk's first place counts as 0
    node_first = np.flatnonzero(np.concatenate(([True], dst[1:] != dst[:-1])))
    node_count = np.diff(np.append(node_first, len(dst)))
    level_of_node = level[node_first]
    cuts = np.flatnonzero(np.concatenate(([True], level_of_node[1:] != level_of_node[:-1])))
    cuts = np.append(cuts, len(node_first))
    share = np.empty(len(dst))
    at_start = depth[np.minimum(src, n - 1)] == 0
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        lo, hi = node_first[a], node_first[b - 1] + node_count[b - 1]
        s = src[lo:hi]
        x = weight[lo:hi] + np.where(at_start[lo:hi], 0.0, alpha[s])
        first, count = node_first[a:b] - lo, node_count[a:b]
        top = np.maximum.reduceat(x, first)
        p = np.exp(x - np.repeat(top, count))
        total = np.add.reduceat(p, first)
        alpha[dst[lo + first]] = top + np.log(total)
        share[lo:hi] = p / np.repeat(total, count)
    run = np.cumsum(share)
    before = np.repeat(run[node_first] - share[node_first], node_count)
    cumulative = run - before
    cumulative[node_first + node_count - 1] = 2.0
    edge_of = np.full(n + 1, -1, dtype=np.int64)
    edge_of[dst[node_first]] = node_first
    return edge_of, src, piece, cumulative


def encode_batch(lat: Lattice, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
    """Sampled piece ids of each text. A text is preceded by one space mark; empty texts have no pieces."""
    parts = [np.frombuffer((" " + t).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) if t else np.empty(0, np.uint32) for t in texts]
    offsets = np.cumsum([0] + [len(p) for p in parts])
    n = int(offsets[-1])
    if n == 0:
        return [np.empty(0, np.int32) for _ in texts]
    codes = np.concatenate(parts).astype(np.uint64)
    codes[codes == SPACE_MARK] = LITERAL_MARK
    codes[codes == 32] = SPACE_MARK
    space = codes == SPACE_MARK
    cut = np.zeros(n, dtype=bool)
    small = np.where(space, 128, np.minimum(codes, 129)).astype(np.int64)
    plain = small < 129
    small[~plain] = 0
    cut[1:] = (space[1:] & ~space[:-1]) | (plain[1:] & plain[:-1] & ~lat.joined[small[:-1], small[1:]])
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    sums, down = _prefix(codes)
    _, pick, of = np.unique(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), return_index=True, return_inverse=True)
    del sums, down, small, plain, space, parts
    lengths = (ends - starts)[pick]
    u_ends = np.cumsum(lengths)
    u_starts = u_ends - lengths
    where = np.arange(int(u_ends[-1])) - np.repeat(u_starts, lengths) + np.repeat(starts[pick], lengths)
    edge_of, src, piece, cumulative = _forward(lat, codes[where], u_starts, u_ends)
    # backward: all chunks step together from their ends to their starts
    chosen = np.full(n, -2, dtype=np.int32)
    seed_of = np.repeat(seeds.astype(np.uint64), np.diff(offsets))
    local = np.arange(n, dtype=np.uint64) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.uint64)
    chunk = np.arange(len(starts))
    place = u_ends[of]  # in the lattice of the distinct chunk
    shift = starts - u_starts[of]  # from there to the text
    while len(chunk):
        end = place + shift[chunk]
        draw = (mix(seed_of[end - 1] + local[end - 1] * np.uint64(0x9E3779B97F4A7C15), 5) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        edge = edge_of[place]
        behind = np.flatnonzero(draw >= cumulative[edge])
        while len(behind):
            edge[behind] += 1
            behind = behind[draw[behind] >= cumulative[edge[behind]]]
        place = src[edge]
        chosen[place + shift[chunk]] = piece[edge]
        on = place > u_starts[of[chunk]]
        chunk, place = chunk[on], place[on]
    at = np.flatnonzero(chosen > -2)
    ids = chosen[at]
    bare = np.flatnonzero(ids == -1)
    if len(bare):
        codes_there = codes[at[bare]].astype(np.int64)
        raw = [chr(SPACE_MARK if c == LITERAL_MARK else c).encode("utf-8", "surrogatepass") for c in codes_there.tolist()]
        counts = np.ones(len(at), dtype=np.int64)
        counts[bare] = [len(r) for r in raw]
        out = np.repeat(ids, counts)
        out[np.repeat(ids == -1, counts)] = lat.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        ids, at = out, np.repeat(at, counts)
    cuts = np.searchsorted(at, offsets)
    return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def decode(lat: Lattice, ids: np.ndarray) -> str:
    """The text of piece ids: bytes joined, without the first space mark."""
    return b"".join([lat.bytes_of[i] for i in ids.tolist()])[1:].decode("utf-8", "surrogatepass")


def row_seed(key: str | None) -> int:
    h = 0xCBF29CE484222325
    for b in (key or "").encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL, alpha: float = 1.0, seed: int = 0, keep_text: bool = True) -> DataFrame:
    """docs (without the text unless keep_text) plus ids array<int>, n_pieces and lossless (decoding gave the text back). Sampled by (seed, id).

    Null texts have null ids, 0 pieces and are lossless; empty texts have no pieces. Rows with the same id and text get the
    same pieces; null ids share one seed. Columns ids, n_pieces and lossless of docs are replaced. model names a file that
    every executor has. An empty table gives no rows. Memory: a block of at most BLOCK_CHARS characters, or one longer text."""
    docs = docs.drop("ids", "n_pieces", "lossless")

    def run(batches):
        lat = lattice(model, alpha)
        for batch in batches:
            names = batch.schema.names
            sizes_in = pc.fill_null(pc.utf8_length(batch.column(names.index(text_name))), 0).to_numpy(zero_copy_only=False)
            total, first = np.cumsum(sizes_in, dtype=np.int64), 0
            while first < len(total):  # each block is a batch of its own, so only one is held
                last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + BLOCK_CHARS, side="right")))
                part = batch.slice(first, last - first)
                texts = part.column(names.index(text_name)).to_pylist()
                seeds = np.array([row_seed(k) ^ (seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for k in part.column(names.index("__key")).to_pylist()], dtype=np.uint64)
                values = encode_batch(lat, [t or "" for t in texts], seeds)
                sizes = [len(ids) for ids in values]
                lossless = [decode(lat, ids) == (t or "") for t, ids in zip(texts, values, strict=True)]
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.array([t is None for t in texts] + [False]))
                arrays = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values), type=pa.int32()))
                keep = [c for c in names if c not in ("__text", "__key")]  # __text is there only if the text itself is not kept
                yield pa.RecordBatch.from_arrays([part.column(names.index(c)) for c in keep] + [arrays, pa.array(sizes, pa.int64()), pa.array(lossless, pa.bool_())], [*keep, "ids", "n_pieces", "lossless"])
                first = last

    text_name = text_col if keep_text else "__text"
    wide = docs if keep_text else docs.withColumnRenamed(text_col, "__text")
    fields = ", ".join(f"`{c}` {t}" for c, t in wide.dtypes if c != "__text")
    wide = wide.withColumn("__key", F.col(id_col).cast("string"))
    return wide.mapInArrow(run, f"{fields}, ids array<int>, n_pieces bigint, lossless boolean")
