"""URL filters: fixed rules by host suffix and path prefix, and association rules over URL tokens. No Python functions."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.workspace import Workspace

#: Fixed rules: (host, path prefix, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=bad"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// up to / ? # or the end, A-Z lower-cased; path then up to ? # or the end.
    Null urls and those without :// have both empty."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*(/[^?#]*)?", 1)
    return host, path


def rule_verdict(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host and path together) that fits the host or a subdomain of it; else null."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ordered]
    pick = lambda out: F.coalesce(*[F.when(f, F.lit(out(r))) for f, r in zip(fits, ordered, strict=True)])
    return pick(lambda r: r[0] + r[1]), pick(lambda r: r[2])


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: scheme, labels of the host, whole host, words of host labels, path segments and query keys."""
    tag = lambda p, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(p), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    segments = F.filter(F.split(path, "/"), lambda x: ~x.rlike(r"^[0-9]+(\.[a-z]+)?$"))
    return F.array_distinct(F.concat(tag("h=", F.array(host)), tag("d=", F.split(host, "[.]")), tag("w=", F.array_except(F.split(host, "[.-]"), F.split(host, "[.]"))), tag("p=", segments), tag("q=", keys)))


def equivalents(transactions: DataFrame, least: int) -> DataFrame:
    """transactions (row, items) -> (item, stands_for): items that stand in exactly the same rows, as count and as the xor of
    the rows' hashes, are one item, which the first by name stands for; items of under `least` rows are left out."""
    marks = transactions.select(F.xxhash64("row").alias("h"), F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x")).where(F.col("n") >= least)
    marks = marks.withColumn("group", F.when(F.col("item") == BAD, F.lit(BAD)).otherwise(F.concat_ws(":", "n", "x")))
    first = marks.groupBy("group").agg(F.min("item").alias("stands_for"))
    return marks.join(first, "group").select("item", "stands_for", "n")


def mine_rules(transactions: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """transactions (items array, incl. BAD where bad) -> rules (antecedent array, confidence, support), pruned by both.

    Spark's FP-growth deals the conditional trees over the partitions. No bad row, or no row, gives no rule."""
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(transactions)
    rules = model.associationRules.where(F.array_contains("consequent", BAD))
    return rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")


def filter_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", min_support: float = 0.002, min_confidence: float = 0.8, min_rows: int = 20) -> DataFrame:
    """pages plus host, path, rule, verdict (allow or block), learned_confidence. Mines the rules by jobs when called.

    Fixed rules decide where one fits. Elsewhere the method does: pages whose id has a row in labels (page id = label id)
    give transactions of URL tokens, bad where toxic = 1 or quality = 0; FP-growth mines the token sets that imply bad,
    pruned by support (min_support of the transactions and min_rows) and confidence. Tokens that stand in exactly the same
    transactions are mined as one, so that a long common path does not make all its subsets. Each rule is kept under its
    rarest token (an inverted index), a URL meets only the rules under its tokens, and it is blocked if it has all tokens
    of one. Distinct token sets are matched once, so repeated URLs cost nothing.

    Null urls have empty host and path, no rule, and are allowed. Ties: equally long rules cannot fit the same URL. Ids
    may repeat. Empty pages give no rows; no labels, no learned rule. Columns with the added names are replaced, other
    columns stay; very long urls are read whole."""
    ws = Workspace(pages.sparkSession)
    pages = pages.drop("host", "path", "rule", "verdict", "learned_confidence", "__tokens")
    host, path = url_parts(F.col(url_col))
    out = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_verdict(F.col("host"), F.col("path"))
    out = out.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("__tokens", F.array_sort(url_tokens(F.col("host"), F.col("path"), F.col(url_col))))
    marks = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("__id")).agg(F.max(F.when((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0), 1).otherwise(0)).alias("bad"))
    slim = out.select(F.col(id_col).alias("__id"), "__tokens", F.col(url_col).alias("__url")).join(marks, "__id")
    items = slim.select(F.struct("__id", "__url").alias("row"), F.when(F.col("bad") == 1, F.concat("__tokens", F.array(F.lit(BAD)))).otherwise(F.col("__tokens")).alias("items"))
    items = ws.save(items, "transactions")
    total = max(1, items.count())
    support = min(1.0, max(min_support, min_rows / total))
    known = ws.save(equivalents(items, math.ceil(support * total)), "tokens")
    mined = items.select("row", F.explode("items").alias("item")).join(known, "item").groupBy("row").agg(F.collect_set("stands_for").alias("items"))
    rules = ws.save(mine_rules(ws.save(mined.select("items"), "mined"), support, min_confidence), "rules")
    # inverted index: a rule stands under the token of its antecedent that the fewest transactions have
    index = rules.select("antecedent", "confidence", F.explode("antecedent").alias("item")).join(known, "item")
    index = index.groupBy("antecedent", "confidence").agg(F.min_by("item", F.struct("n", "item")).alias("token"))
    index = ws.save(index, "index")
    sets = out.where("rule is null").select("__tokens").distinct()
    met = sets.select("__tokens", F.explode("__tokens").alias("token")).join(index, "token")
    met = met.where(F.size(F.array_except("antecedent", "__tokens")) == 0)
    met = ws.save(met.groupBy("__tokens").agg(F.max("confidence").alias("learned_confidence")), "matched")
    out = out.join(met, "__tokens", "left")
    learned = F.when(F.col("learned_confidence").isNotNull(), F.lit("block")).otherwise("allow")
    return out.withColumn("learned_confidence", F.when(F.col("rule").isNull(), F.col("learned_confidence"))).withColumn("verdict", F.coalesce("verdict", learned)).drop("__tokens")
