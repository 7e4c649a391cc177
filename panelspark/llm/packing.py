"""Best-fit packing of tokenised documents in bulk-synchronous rounds.

1. Tasks tokenise whole texts and cut those longer than a sequence into pieces.
2. Rounds, a band of lengths each, the longest first. Pieces of the band and gaps (the free places of open sequences) are
   range-sorted by size and ranked within their size. The sweep: pieces by falling length take the smallest gap that holds
   them, or open a sequence. As pieces of one length are alike and so are gaps of one size, the sweep goes over the counts of
   the at most `capacity` sizes on either side, and says which ranks of a length go to which ranks of a gap size (a scan over
   totals, bounded by the capacity, however many rows there are). The tasks then find the place of each piece by successor
   search on its rank; two pieces never get one place. Gaps are updated by what was put into them, and the next band follows.

The result is that of best-fit decreasing, one piece after another.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.workspace import Workspace

BAND = 8  # a band's longest length over its shortest
CHUNK_ROWS = 1 << 16  # pieces a sorted part
#: Fixed values of the tokenizer file's format.
WORD_END = "</w>"
PRETOKENS = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The marks of a word's end and of a text's, and the words (with what stands beside them up to a blank) that are not plain.
END, PART = "\x01", "\x02"
_ODD = "\x00-\x09\x0b-\x1f\x7f-\xa0\u0130\u0250-\U0010ffff"
ODD = re.compile(f"[{_ODD}]")
UNUSUAL = re.compile(f"[^ \n{_ODD}<]*(?:[{_ODD}]|<\\||<)[^ \n]*")
_LETTERS, _NUMBERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
MARKS = re.compile(f"'(?:[stmd]|re|ve|ll)|[{_NUMBERS}]|{PART}|[^ \n{END}{PART}{_LETTERS}{_NUMBERS}]+")


class WordTokens:
    """Ids of whole texts from a tokenizer file whose pre-tokeniser drops white space and never joins what stands on both sides
    of it. Plain Latin words go through tiktoken with the file's merges: an end mark stands for the word end, and ids rise with
    the merges, which is checked when the file is read. Other words, and all if the check fails, go through the tokenizer."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.fast = self._merges(json.load(f))
        self.part = self.fast.encode_ordinary(PART + END)[0] if self.fast else None

    @staticmethod
    def _merges(file: dict):
        model = file["model"]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves
        other = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"].get(a + b, -1) for a, b in pairs]
        singles = [model["vocab"].get(c + end, 1 << 40) for c in byte_of for end in ("", WORD_END)]
        if model.get("end_of_word_suffix") != WORD_END or PRETOKENS not in json.dumps(file["pre_tokenizer"]) or ids != sorted(set(ids)) or max(singles) > ids[0]:
            return None
        ranks = {}
        for token, i in model["vocab"].items():
            end = token.endswith(WORD_END)
            if all(c in byte_of for c in token.removesuffix(WORD_END)):
                ranks[bytes(byte_of[c] for c in token.removesuffix(WORD_END)) + END.encode() * end] = i
        if len(ranks) != len(model["vocab"]):
            return None
        import tiktoken

        return tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})

    def _plain(self, texts: list[str]) -> np.ndarray:
        """Ids of texts of plain words, one after another; the id of PART parts them."""
        marked = MARKS.sub(f"{END}\\g<0>{END}", PART.join(texts).lower()).replace("\n", END).replace(" ", END) + END
        return np.array(self.fast.encode_ordinary(marked), dtype=np.uint32)

    def _whole(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.model.encode_batch(words, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Words are parted at blanks and line ends, which every reading of white space includes."""
        if not self.fast:
            return self._whole(texts)
        runs, owner, odd, odd_at = [], [], [], []  # plain runs and unusual words in order
        for i, t in enumerate(texts):
            at = 0
            for m in UNUSUAL.finditer(t) if ODD.search(t) or "<|" in t else ():
                runs.append(t[at : m.start()])
                owner.append(i)
                odd.append(m[0])
                odd_at.append(len(runs))
                at = m.end()
            runs.append(t[at:])
            owner.append(i)
        flat = self._plain(runs)
        cuts = np.flatnonzero(flat == self.part)
        if len(cuts) != len(runs) - 1:
            raise ValueError("a plain word has the id of the mark")
        parts = np.split(flat, cuts)
        parts = [p[1:] if j else p for j, p in enumerate(parts)]
        for j, ids in zip(odd_at, self._whole(odd) if odd else [], strict=True):
            parts[j - 1] = np.concatenate([parts[j - 1], ids])
        if len(runs) == len(texts):
            return parts
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [np.concatenate(parts[a:b]) for a, b in itertools.pairwise(first.tolist())]


@functools.lru_cache(maxsize=1)
def word_tokens(path: str | None) -> WordTokens:
    """One a worker."""
    return WordTokens(path)


def tokenised(docs: DataFrame, capacity: int, end_id: int, path: str | None, keep_ids: bool) -> DataFrame:
    """docs (name, text) -> (name, piece, start, length, ids_crc32[, ids]): the ids of each text with end_id after them, in pieces
    of `capacity` ids; the last may be shorter."""

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part, rows = pdf[lo : lo + 512], []
                for name, ids in zip(part["name"], word_tokens(path).encode([t if isinstance(t, str) else "" for t in part["text"]]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for p, start in enumerate(range(0, len(ids), capacity)):
                        cut = ids[start : start + capacity]
                        rows.append((name, p, start, len(cut), zlib.crc32(cut.tobytes()), *([cut.astype(np.int64)] if keep_ids else [])))
                out = pd.DataFrame(rows, columns=["name", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])
                yield out

    return docs.mapInPandas(run, "name string, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * keep_ids)


def sweep(pieces: list[tuple[int, int]], gaps: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, ...]], int]:
    """pieces and gaps: (size, count). (moves, sequences opened): best-fit decreasing over counts. A move (size, rank, n, gap,
    gap_rank, each, used): the n pieces of `size` from `rank` on go to gaps of size `gap` (0: to opened sequences) from gap_rank
    on, `each` to one, behind `used` places of the gap. A gap takes as many pieces of one length as fit before the next gap is
    looked at, since it then is the smallest that holds them."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {g: [(g, 0, n, 0)] for g, n in gaps}  # free places -> (gap, rank, n, used)
    free, opened, moves = sorted(runs), 0, []

    def back(size: int, run: tuple[int, int, int, int]) -> None:
        if size > 0:
            if size not in runs:
                bisect.insort(free, size)
            runs.setdefault(size, []).append(run)

    for size, n in sorted(pieces, reverse=True):
        rank = 0
        while rank < n:
            at = bisect.bisect_left(free, size)
            if at < len(free):
                room = free[at]
                gap, first, count, used = runs[room].pop()
                if not runs[room]:
                    del runs[room], free[at]
            else:
                room, each = capacity, capacity // size
                gap, first, count, used = 0, opened, -(-(n - rank) // each), 0
                opened += count
            each = room // size
            full = min(count, (n - rank) // each)
            if full:
                moves.append((size, rank, full * each, gap, first, each, used))
                back(room - each * size, (gap, first, full, used + each * size))
                rank += full * each
            if full < count and rank < n:  # fewer are left than one gap holds
                moves.append((size, rank, n - rank, gap, first + full, n - rank, used))
                back(room - (n - rank) * size, (gap, first + full, 1, used + (n - rank) * size))
                rank, full = n, full + 1
            if full < count:
                back(room, (gap, first + full, count - full, used))
    return moves, opened


def ranked(df: DataFrame, rows: int, size: str, key: str, ws: Workspace, name: str) -> DataFrame:
    """df of so many rows, range-sorted by (size, key), plus rank: the row's number among those of its size, from 0. A size with
    very many rows is split over parts; parts know their offsets from a table of a row a part and size. key is unique."""
    parts = 1 + rows // CHUNK_ROWS
    df = df.repartitionByRange(parts, size, key).sortWithinPartitions(size, key)
    df = ws.save(df.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), name)
    cells = df.groupBy("__part", F.col(size).alias("__size")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # a size's cells: one a part at most
    before = cells.groupBy("__size").agg(F.sort_array(F.collect_list(F.struct("__part", "__first", "__n"))).alias("c"))
    before = before.select("__size", F.explode(F.expr("transform(c, (x, i) -> named_struct('part', x.__part, 'first', x.__first, 'before', aggregate(slice(c, 1, i), 0L, (s, y) -> s + y.__n)))")).alias("c"))
    before = before.select(F.col("__size").alias(size), F.col("c.part").alias("__part"), "c.first", "c.before")
    return df.join(before, [size, "__part"]).withColumn("rank", F.col("__at") - F.col("first") + F.col("before")).drop("__part", "__at", "first", "before")


def placed(pieces: DataFrame, moves: list[tuple[int, ...]], capacity: int) -> DataFrame:
    """pieces (row, length, rank) -> (row, length, gap, gap_rank, place): the move of each piece by successor search on its rank."""
    m = np.array(moves, dtype=np.int64).reshape(-1, 7)
    m = m[np.lexsort((m[:, 1], m[:, 0]))]

    def run(batches):
        keys = m[:, 0] << 50 | m[:, 1]
        for pdf in batches:
            size, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            mine = m[np.searchsorted(keys, size << 50 | rank, side="right") - 1]
            nth = rank - mine[:, 1]
            free = np.where(mine[:, 3] == 0, capacity, mine[:, 3])
            yield pd.DataFrame({"row": pdf["row"], "length": size, "gap": mine[:, 3], "gap_rank": mine[:, 4] + nth // mine[:, 5], "place": capacity - free + mine[:, 6] + nth % mine[:, 5] * size})

    return pieces.select("row", "length", "rank").mapInPandas(run, "row bigint, length bigint, gap bigint, gap_rank bigint, place bigint")


def best_fit(pieces: DataFrame, capacity: int, ws: Workspace) -> DataFrame:
    """pieces (row, length), row unique, 1 <= length <= capacity -> (row, sequence_id, place)."""
    spark = pieces.sparkSession
    totals = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    gaps, opened, done = None, 0, []
    high = capacity
    while high > 0:
        low = high // BAND
        band = [(s, n) for s, n in totals.items() if low < s <= high]
        here, high = (F.col("length") > low) & (F.col("length") <= high), low
        if not band:
            continue
        free = [(r["free"], r["n"]) for r in gaps.groupBy("free").agg(F.count(F.lit(1)).alias("n")).collect()] if gaps is not None else []  # a row a size
        moves, new = sweep(band, free, capacity)
        put = placed(ranked(pieces.where(here), sum(n for _, n in band), "length", "row", ws, "sorted-pieces"), moves, capacity)
        if gaps is None:
            put = put.withColumn("sequence_id", F.col("gap_rank"))
        else:  # gaps of size 0 are the sequences that this round opens
            order = ranked(gaps, sum(n for _, n in free), "free", "sequence_id", ws, "sorted-gaps")
            put = put.join(order.select(F.col("free").alias("gap"), F.col("rank").alias("gap_rank"), "sequence_id"), ["gap", "gap_rank"], "left")
            put = put.withColumn("sequence_id", F.coalesce("sequence_id", F.col("gap_rank") + opened))
        fresh = ws.save(put.select("row", "length", "sequence_id", "place"), "round")
        done.append(fresh.select("row", "sequence_id", "place"))
        used = fresh.groupBy("sequence_id").agg(F.sum("length").alias("used"))
        every = spark.range(opened, opened + new).select(F.col("id").alias("sequence_id"), F.lit(capacity).cast("bigint").alias("free"))
        every = every if gaps is None else every.unionByName(gaps)
        every = every.join(used, "sequence_id", "left").select("sequence_id", (F.col("free") - F.coalesce("used", F.lit(0))).alias("free"))
        gaps, opened = ws.save(every.where("free > 0"), "gaps"), opened + new
    if not done:
        return spark.createDataFrame([], "row bigint, sequence_id bigint, place bigint")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): all documents as pieces of token ids in as few sequences
    of at most `capacity` ids as best-fit decreasing finds. A document is the ids of its whole text and end_id; only longer ones
    are cut. offset is the piece's place in its sequence, from 0 without a gap. path: a tokenizer file that drops white space
    (None: the public one of whole words). keep_ids=False leaves the ids away, so that none are written.

    Runs jobs when called. Null and empty texts are documents of end_id alone; very long texts are cut; repeated rows, null ids
    and rows of one id with different texts are documents of their own; equal lengths are placed in the order of the rows. An
    empty table gives no rows. Further columns are ignored, whatever their names."""
    ws = Workspace(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text"))  # ids beside nulls stay exact
    pieces = ws.save(tokenised(slim, capacity, end_id, path, keep_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    out = pieces.join(best_fit(pieces.select("row", "length"), capacity, ws), "row")
    return out.select(F.col("name").cast(docs.schema[id_col].dataType).alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", F.col("place").alias("offset"), *(["ids"] if keep_ids else []))


def write_sequences(packed: DataFrame, path: str, capacity: int = 2048) -> None:
    """Writes the sequences (sequence_id, n_ids, ids) as Parquet: the ids of the pieces of each in the order of their offsets. A
    sequence has at most `capacity` pieces, so its row is bounded."""
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    rows.select("sequence_id", "n_ids", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids")).write.mode("overwrite").parquet(path)
