"""Quality rules with adaptive thresholds. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.workspace import Workspace

SPACES = "[\\x20\\x09-\\x0D]+"
#: Metrics with adaptive fences: name -> least excess over the median that can count as an outlier.
FENCED = {"symbol_rate": 0.25, "dup_line_rate": 0.34, "word_length": 3.0}
MIN_GROUP = 50


def words_of(text: Column) -> Column:
    """Runs of characters other than \\x20 and \\x09-\\x0D; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def basic_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus __words, n_words, word_chars, n_symbols, n_dup_lines and the three fenced rates."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.withColumn("__words", words_of(F.col(text_col)))
    out = out.withColumn("n_words", F.size("__words").cast("long"))
    out = out.withColumn("word_chars", F.aggregate("__words", F.lit(0).cast("long"), lambda s, w: s + F.length(w)))
    out = out.withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
    out = out.withColumn("__n_lines", F.size(lines).cast("long"))
    out = out.withColumn("n_dup_lines", F.col("__n_lines") - F.size(F.array_distinct(lines)))
    out = out.withColumn("symbol_rate", F.coalesce(F.try_divide("n_symbols", "n_words"), F.lit(0.0)))
    out = out.withColumn("dup_line_rate", F.coalesce(F.try_divide("n_dup_lines", "__n_lines"), F.lit(0.0)))
    return out.withColumn("word_length", F.coalesce(F.try_divide("word_chars", "n_words"), F.lit(0.0)))


def with_repeat_words(df: DataFrame) -> DataFrame:
    """df with __words -> n_repeat_words: words in 3-word windows found twice or more in the text, the first included.

    All within the row. Windows are hashed; if all hashes differ, none repeats. Else hash and position are sorted
    together (packed in one long of 44 + 20 bits up to 2^20 words, as structs beyond) and neighbours of equal hash are
    flagged after their words are compared, so a chance collision does not count. A flagged window then covers three
    words less its overlap with the flagged window before it. n log n in the length of the text."""
    words = F.col("__words")
    out = df.withColumn("__h", F.transform(words, lambda w: F.xxhash64(w)))
    h = F.col("__h")
    windows = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    out = out.withColumn("__w", windows)
    w = F.col("__w")
    low = F.lit((1 << 20) - 1).cast("bigint")

    def same(i: Column, j: Column) -> Column:
        return F.slice(words, i + 1, 3) == F.slice(words, j + 1, 3)

    def at(x: Column) -> Column:
        return x.bitwiseAND(low).cast("int")

    def packed_twin(x: Column, y: Column) -> Column:
        return F.coalesce((F.shiftright(x.bitwiseXOR(y), 20) == 0) & same(at(x), at(y)), F.lit(False))

    def struct_twin(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & same(x["i"], y["i"]), F.lit(False))

    some = F.size(F.array_distinct(w)) < F.size(w)
    short = F.size(words) < (1 << 20)
    packed = F.sort_array(F.transform(w, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("bigint"))))
    structs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn("__a", F.when(some & short, packed)).withColumn("__b", F.when(some & ~short, structs))
    a, b = F.col("__a"), F.col("__b")
    of_packed = F.transform(F.filter(a, lambda x, k: packed_twin(x, F.get(a, k + 1)) | packed_twin(x, F.get(a, k - 1))), at)
    of_structs = F.transform(F.filter(b, lambda x, k: struct_twin(x, F.get(b, k + 1)) | struct_twin(x, F.get(b, k - 1))), lambda x: x["i"])
    out = out.withColumn("__p", F.sort_array(F.coalesce(of_packed, of_structs, F.array().cast("array<int>"))))
    p = F.col("__p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), x - F.coalesce(F.get(p, k - 1), F.lit(-3)))), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.withColumn("n_repeat_words", covered).drop("__h", "__w", "__a", "__b", "__p")


def adaptive_fences(metrics: DataFrame, group_cols: list[str], accuracy: int = 10000) -> DataFrame:
    """One row per group with an upper fence of each metric: median + max(3 interquartile ranges, the least excess).

    Quartiles come from mergeable sketches (percentile_approx), filled before the shuffle and merged after it, so a group
    with a third of all rows costs one sketch a task. Groups of under MIN_GROUP rows have null fences."""
    stats = metrics.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("__rows"), *[F.percentile_approx(m, [0.25, 0.5, 0.75], accuracy).alias(m) for m in FENCED])

    def fence(m: str, least: float) -> Column:
        q = F.col(m)
        return F.when(F.col("__rows") >= MIN_GROUP, q[1] + F.greatest(3.0 * (q[2] - q[0]), F.lit(least)))

    return stats.select(*group_cols, *[fence(m, least).alias(f"fence_{m}") for m, least in FENCED.items()])


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep_text: bool = True) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    Base: fewer than 50 words, or over half of the words in repeated 3-word windows, fails. Method: for each language and
    source, quartile sketches of symbols per word, share of repeated lines and mean word length give upper fences; a
    document above any fence of its group is not kept. A group with under 50 rows takes the fences of its language, then
    those of all rows. Only documents that pass the base rules fill the sketches. The metrics are written once (without
    the text unless keep_text) and joined with the fences from there.

    Nulls: a null text has no words and fails; null languages and sources are groups of their own. Ties at a fence are
    kept. Empty tables give no rows. Columns of docs that have the names of added ones are replaced,
    those named as the fenced metrics are dropped. Very long texts are read whole; other columns stay."""
    ws = Workspace(docs.sparkSession)
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *FENCED)
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    out = docs.withColumn("__lang", tag(lang_col)).withColumn("__source", tag(source_col))
    out = with_repeat_words(basic_metrics(out, text_col)).drop("__words", "__n_lines")
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = ws.save(out if keep_text else out.drop(text_col), "metrics")
    slim = out.where("not base_failed").select("__lang", "__source", *FENCED)
    fine = ws.save(adaptive_fences(slim, ["__lang", "__source"]), "fences")
    wide = adaptive_fences(slim.select(F.explode(F.array(F.col("__lang"), F.lit("*"))).alias("__wide"), *FENCED), ["__wide"])
    wide = ws.save(wide, "wide")
    lang = wide.where("__wide <> '*'").select(F.col("__wide").alias("__lang"), *[F.col(f"fence_{m}").alias(f"lang_{m}") for m in FENCED])
    every = wide.where("__wide = '*'").select(F.lit(1).alias("__one"), *[F.col(f"fence_{m}").alias(f"every_{m}") for m in FENCED])  # one row
    fences = fine.join(lang, "__lang", "left").withColumn("__one", F.lit(1)).join(F.broadcast(every), "__one", "left")
    fences = ws.save(fences.select("__lang", "__source", *[F.coalesce(f"fence_{m}", f"lang_{m}", f"every_{m}").alias(f"fence_{m}") for m in FENCED]), "joined")
    out = out.join(fences, ["__lang", "__source"], "left")
    above = F.lit(False)
    for m in FENCED:
        above = above | F.coalesce(F.col(m) > F.col(f"fence_{m}"), F.lit(False))
    out = out.withColumn("kept", ~F.col("base_failed") & ~above)
    return out.drop("__lang", "__source", *FENCED, *[f"fence_{m}" for m in FENCED])
