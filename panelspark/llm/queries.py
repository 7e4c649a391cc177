"""The queries of the llm operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.codes import book_digest, compress_vectors, with_label_error
from panelspark.llm.decontaminate import find_leaks
from panelspark.llm.langid import identify
from panelspark.llm.negatives import hard_negatives
from panelspark.llm.packing import pack_documents
from panelspark.llm.pieces import encode_pieces
from panelspark.llm.quality import quality_rules
from panelspark.llm.secrets import scan_secrets
from panelspark.llm.sharding import hilbert_shards
from panelspark.llm.simhash import simhash_components
from panelspark.llm.substrings import repeated_passages
from panelspark.llm.urlfilter import filter_urls
from panelspark.llm.warc import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archive_pages(_table(spark, sf_dir, "pages"), split_bytes=16 << 20, with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """law is rows: shard counts differ by at most one."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", size.alias("size"), crc.alias("text_crc32"))
    out = hilbert_shards(docs, ["lang", "source", "n_chars"], 24, tie_cols=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs, keep_text=False).select("doc_id", "n_pieces", "lossless", "ids")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = quality_rules(docs, keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, _table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are moved by one, as the contract says."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(rows).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, keep_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    every = (op1_warc, op2_substring_dedup, op3_decontamination, op4_hilbert_sharding, op5_secret_scans, op6_sentencepiece, op7_simhash_near_dedup, op8_quality_rules, op9_url_filters, op10_language_id, op11_vector_codes, op12_hard_negatives, op13_best_fit_packing, pipeline)
    return {f.__name__: f for f in every}


_BASE32 = " || ".join(
    "(" + " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, {5 * i + 1}, 5) as bigint) >> {s}) & 31 as integer) + 1, 1)" for s in (15, 10, 5, 0)) + ")" for i in range(8)
)
OP1_SQL = f"""with p as (select page_id, url, coalesce(html, '') as x from pages), q as (select page_id, strlen(x) as payload_bytes, sha1(x) as h, min(page_id) over (partition by x) as first, page_id is null and count(page_id) over (partition by x) = 0 or page_id is not null and row_number() over (partition by x order by page_id nulls last, url nulls first) = 1 as answers from p)
select page_id, payload_bytes, {_BASE32} as payload_digest, case when answers then 'response' else 'revisit' end as record_type, case when not answers then first end as refers_to from q"""

FENCE = {"symbol_rate": 0.25, "dup_line_rate": 0.34, "word_length": 3.0}
_RATES = ", ".join(f"case when count(*) >= 50 then quantile_disc({m}, 0.5) + greatest(3.0 * (quantile_disc({m}, 0.75) - quantile_disc({m}, 0.25)), {x}) end as {{0}}_{m}" for m, x in FENCE.items())
OP8_SQL = f"""with w as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
g as (select doc_id, i, ws[i:i+2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w) t), r as (select doc_id, i, count(*) over (partition by doc_id, g) as c from g),
c as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as j from r where c > 1) t group by doc_id),
l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from w),
b as (select w.doc_id, lang, source, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
  cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, len(ls) as n_lines from w join l on l.doc_id = w.doc_id left join c on c.doc_id = w.doc_id),
m as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, coalesce(n_symbols / nullif(n_words, 0), 0) as symbol_rate, coalesce(n_dup_lines / nullif(n_lines, 0), 0) as dup_line_rate, coalesce(word_chars / nullif(n_words, 0), 0) as word_length from b),
f1 as (select lang, source, {_RATES.format("a")} from m where not base_failed group by all), f2 as (select lang, {_RATES.format("b")} from m where not base_failed group by all), f3 as (select {_RATES.format("c")} from m where not base_failed)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({" or ".join(f"coalesce({m} > coalesce(a_{m}, b_{m}, c_{m}), false)" for m in FENCE)}) as kept
from m left join f1 on f1.lang is not distinct from m.lang and f1.source is not distinct from m.source left join f2 on f2.lang is not distinct from m.lang, f3"""


_USABLE = "embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0"
#: Each round: squared distances to the 16 entries of a part, the nearest, and the floors of the means; 64 components in 8 parts.
_NEAREST = "select vec_id, p, k, d from (select v.vec_id, v.p, b.k, " + " + ".join(f"(v.x[{j}] - b.x[{j}]) * (v.x[{j}] - b.x[{j}])" for j in range(1, 9)) + " as d, row_number() over (partition by v.vec_id, v.p order by d, b.k) as rn from v join b{0} b on b.p = v.p) t where rn = 1"
_MEANS = "select b.p, b.k, coalesce(m.x, b.x) as x from b{0} b left join (select v.p, a.k, [" + ", ".join(f"cast(floor(sum(v.x[{j}])::double / count(*)) as bigint)" for j in range(1, 9)) + "] as x from v join a{0} a on a.vec_id = v.vec_id and a.p = v.p group by v.p, a.k) m on m.p = b.p and m.k = b.k"
OP11_SQL = f"""with e as materialized (select vec_id, label, list_transform(embedding, lambda v: cast(floor(4096 * v::double) as bigint)) as x from embeddings where {_USABLE}),
v as materialized (select vec_id, p, x[8 * p + 1 : 8 * p + 8] as x from e, range(8) t(p)), f as (select vec_id, row_number() over (order by vec_id) - 1 as k from e qualify k < 16),
b0 as materialized (select p, k, x from v join f using (vec_id)), {", ".join(f"a{r} as materialized ({_NEAREST.format(r)})" + (f", b{r + 1} as materialized ({_MEANS.format(r)})" if r < 6 else "") for r in range(7))},
c as (select vec_id, string_agg(printf('%02x', k), '' order by p) as code, cast(sum(d) as bigint) as error from a6 group by vec_id), h as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, k)) as h from b6)
select c.vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from c join e using (vec_id), h"""

OP12_SQL = f"""with e as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda v: floor(256 * v::double)) as x from embeddings where label is not null and {_USABLE}),
s as materialized (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.x, b.x) as bigint) as score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as rn from s where same) t where rn <= 5),
n as (select p.*, s.vec_id as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, s.vec_id) as rank from p join s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3"""


def oracle_sql() -> dict[str, str]:
    """op8's sketches are exact on groups of under 10,000 rows, so SQL quantiles give the same fences there."""
    return {"op1_warc": OP1_SQL, "op8_quality_rules": OP8_SQL, "op11_vector_codes": OP11_SQL, "op12_hard_negatives": OP12_SQL}
