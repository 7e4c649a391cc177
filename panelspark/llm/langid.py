"""Language identification by a byte convolutional network."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.bytecnn import SHARD_ROWS, SHARD_SCHEMA, ByteCNN, windows
from panelspark.llm.workspace import Workspace

UND = "und"


def fold_of(id_col: str) -> Column:
    """crc32 of the id as text, mod 4; null ids have none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, length: int = 512) -> tuple[ByteCNN, list[str]]:
    """Fits on all labelled rows of the folds 0, 1 and 3, of each `length` bytes from a place given by the hash of its id, as long
    as a window of a prediction. Rows of equal ids count once. Classes are weighted by the inverse root of their frequency.
    Without labelled rows the class list is empty."""
    ws = Workspace(docs.sparkSession)
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.coalesce(fold_of(id_col), F.lit(2)) != 2))
    counts = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).count().toPandas()  # a row a language
    langs = sorted(counts["lang"])
    if len(langs) < 1:
        return ByteCNN(1), []
    start = F.pmod(F.xxhash64(F.lit("start"), F.col(id_col)), F.greatest(F.length(text_col) - length // 2, F.lit(1))).cast("int") + 1
    rank = F.xxhash64(F.concat(F.lit("train"), F.col(id_col).cast("string")))
    n = int(-(-counts["count"].sum() // SHARD_ROWS))
    rows = rows.select(F.pmod(rank, F.lit(n)).alias("shard"), rank.alias("rank"), F.substr(text_col, start, F.lit(length)).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def shard(pdf):
        pdf = pdf.sort_values(["rank", "text", "lang"]).drop_duplicates("rank")
        x = b"".join(t.encode("utf-8", "surrogatepass")[:length].ljust(length, b"\0") for t in pdf["text"])
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "x": [x], "y": [np.searchsorted(langs, pdf["lang"]).astype(np.int32).tobytes()]})

    shards = ws.save(rows.repartition(n, "shard").groupBy("shard").applyInPandas(shard, SHARD_SCHEMA), "shards")
    weight = 1 / np.sqrt(counts.set_index("lang")["count"][langs].to_numpy())
    return ByteCNN(len(langs)).fit_shards(shards, weight, rounds=4, steps=200, crop=24), langs


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", window: int = 512) -> DataFrame:
    """(id, held_out, lang_pred, score) per row. Whole texts are scored in fixed overlapping windows of bytes; their
    probabilities are averaged by new bytes held; score is the winner's mean. `und` with score 0 for null texts, texts without a letter, and
    where no labelled row exists. held_out: fold 2 (false for null ids). Ties take the first language by name. Repeated
    rows get a row each; an empty table none. Very long texts cost more windows; extra columns are ignored. Trains when called, on
    all labelled rows."""
    net, langs = train(docs, id_col, text_col, lang_col)

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            known = [bool(langs) and isinstance(t, str) and any(map(str.isalpha, t)) for t in texts]
            pred, score = np.full(len(texts), UND, dtype=object), np.zeros(len(texts))
            todo, size = [], 0
            for i, ok in enumerate(known):
                if ok:
                    todo.append(i)
                    size += len(texts[i])
                if todo and (size > 1 << 21 or i == len(known) - 1):
                    rows, owner, held = windows([texts[k].encode("utf-8", "surrogatepass") for k in todo], window)
                    q = net.probabilities(rows) * held[:, None]
                    mean = np.stack([np.bincount(owner, weights=q[:, c], minlength=len(todo)) for c in range(len(langs))], axis=1)
                    mean /= mean.sum(axis=1, keepdims=True)
                    best = mean.argmax(axis=1)
                    pred[todo], score[todo] = [langs[b] for b in best], mean.max(axis=1)
                    todo, size = [], 0
            yield pd.DataFrame({"id": pdf["id"], "held_out": pdf["held_out"], "lang_pred": pred, "score": np.clip(score, 0, 1)})

    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(fold_of(id_col) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    out = slim.mapInPandas(run, "id string, held_out boolean, lang_pred string, score double")  # a string: pandas has no null integers
    return out.select(F.col("id").cast(dict(docs.dtypes)[id_col]).alias(id_col), "held_out", "lang_pred", "score")
