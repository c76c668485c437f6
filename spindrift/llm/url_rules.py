"""URL filtering by listed rules and by mined association rules.

A URL is a set of tokens: host labels, path segments with digits masked, and
query keys. Tokens below the support are left out, and tokens that stand in
exactly the same labelled URLs count as one, so a long URL that many pages
share adds one item, not all combinations of its tokens. FP-growth mines
combinations of these together with the label; combinations that imply
``block`` with enough confidence and support, too often for chance, and more
surely than any part of them, are the rules; a rule holds all tokens of its
items. Chance is bounded over all combinations that were tried: if labels fell
on URLs at random (and CONFIDENCE of them were bad at most), one rule or more
would pass in ALPHA of all cases at most.
To match, each rule is filed under its rarest token (an inverted index): a URL
meets only rules filed under one of its tokens, and holds a rule if it has all
the rest.

Everything runs on DataFrames. Tokens are matched for distinct URLs, so a URL
that a third of the rows share costs one match.

Listed rules come first: a rule (host and path prefix) fits its host and all
subdomains, and the longest that fits wins. Their list is short and becomes
one expression.

Defined results: a null url, or one without ``://``, has an empty host and
path and no tokens, and is allowed unless a rule for the empty host fits;
equal rows get equal results; labels that are null teach nothing; extra
columns are ignored; without labels nothing is mined; an empty table gives no
rows.
"""

from __future__ import annotations

import math
import os

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions

BLOCK = "=block"
SUPPORT = 0.003
CONFIDENCE = 0.75
ALPHA = 0.05
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL (column ``u``); none without ``://``."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)
    labels = F.transform(F.filter(F.split(host, "\\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(labels, segments, keys))


def transactions(urls: DataFrame, support: float) -> tuple[DataFrame, DataFrame]:
    """(items, classes) of ``urls`` (u, bad boolean): the items of each row, and token, item, freq of the frequent tokens.

    Tokens with the same number of rows and the same sums of two 64-bit hashes
    over them stand in the same rows; the smallest names the item.
    """
    marked = urls.filter(F.col("bad").isNotNull())
    spread = marked.select("u", F.explode(tokens(F.col("u"))).alias("token"))
    total = marked.agg(F.count("*").alias("total"))
    sums = [F.sum(F.xxhash64("u", F.lit(seed)).cast("decimal(20,0)")).alias(f"s{seed}") for seed in (1, 2)]
    frequent = spread.groupBy("token").agg(F.count("*").alias("freq"), *sums).crossJoin(total).filter(F.col("freq") >= F.col("total") * support)
    named = frequent.groupBy("freq", "s1", "s2").agg(F.min("token").alias("item"))
    classes = frequent.join(named, ["freq", "s1", "s2"]).select("token", "item", "freq")
    numbered = marked.withColumn("row", F.monotonically_increasing_id())  # before tokens are spread
    held = numbered.select("bad", "row", F.explode_outer(tokens(F.col("u"))).alias("token")).join(classes.select("token", "item"), "token", "left")
    held = held.groupBy("row", "bad").agg(F.collect_set("item").alias("items"))
    return held.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items")), classes


def mine(urls: DataFrame, scratch: Scratch, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules from ``urls`` (u, bad boolean): tokens, n, anchor, confidence, support, lift, chance.

    ``chance`` bounds the logarithm of the odds that any combination tried gets
    so many bad URLs of its own by chance: Chernoff's bound of the
    hypergeometric tail, times the number of combinations.
    """
    items, classes = transactions(urls, support)
    items, classes = scratch.table(items, "items"), scratch.table(classes, "classes")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence, numPartitions=partitions(urls.sparkSession)).fit(items)
    rules = model.associationRules.filter(F.col("consequent")[0] == BLOCK).filter("size(consequent) = 1 and lift > 1")
    total = items.agg(F.count("*").alias("rows"), F.avg(F.array_contains("items", BLOCK).cast("int")).alias("share"))
    tried = model.freqItemsets.filter(~F.array_contains("items", BLOCK)).agg(F.count("*").alias("tried"))
    # where nearly all rows are bad, a combination has to be surer than the threshold, not than all rows
    q, p = F.col("confidence"), F.least(F.col("share"), F.lit(confidence))
    rest = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    chance = F.log("tried") - F.round(F.col("support") * F.col("rows") / q) * (q * F.log(q / p) + rest)
    rules = rules.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(tried))  # one row each
    rules = rules.select(F.array_sort("antecedent").alias("items"), "confidence", "support", "lift", chance.alias("chance"))
    whole = rules.select("items", F.explode("items").alias("item")).join(classes, "item").groupBy("items")
    whole = whole.agg(F.array_sort(F.collect_set("token")).alias("tokens"), F.min(F.struct("freq", "token"))["token"].alias("anchor"))
    return rules.join(whole, "items").select("tokens", F.size("tokens").alias("n"), "anchor", "confidence", "support", "lift", "chance")


def significant(rules: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The mined rules of a kind that chance gives in ``alpha`` of all cases at most."""
    return rules.filter(F.col("chance") <= math.log(alpha))


def prune(rules: DataFrame) -> DataFrame:
    """Rules that no rule with fewer of their tokens matches in confidence."""
    part = rules.select(F.col("tokens").alias("fewer"), F.col("n").alias("m"), F.col("anchor").alias("token"), F.col("confidence").alias("c"))
    covered = rules.select("tokens", "n", "confidence", F.explode("tokens").alias("token")).join(part, "token")
    covered = covered.filter((F.col("m") < F.col("n")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("fewer", "tokens")) == 0))
    return rules.join(covered.select("tokens").distinct(), "tokens", "left_anti")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """u and the best confidence of the rules that it holds; URLs (distinct u) that hold none don't appear."""
    spread = urls.select("u", tokens(F.col("u")).alias("all")).select("u", "all", F.explode("all").alias("anchor"))
    met = spread.join(rules.select("anchor", "tokens", "confidence"), "anchor").filter(F.size(F.array_except("tokens", "all")) == 0)
    return met.groupBy("u").agg(F.max("confidence").alias("confidence"))


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, host and path prefix) that fits; null for none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], scratch: Scratch) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence of ``pages`` (page_id, url); ``labels`` (doc_id, quality, toxic) of the same ids.

    A page is a bad example if it is toxic or of low quality.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("u"))
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    mined = scratch.table(prune(scratch.table(significant(mine(rows.join(bad, "page_id"), scratch)), "mined")), "rules")
    held = match(rows.filter("u is not null").select("u").distinct(), mined)
    host, path = host_and_path(F.col("u"))
    parts = rows.join(held, "u", "left").select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "confidence")
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    guess = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return parts.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, guess).alias("verdict"), "confidence")


#: The rules of the registered query.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op6_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge the urls of all ``pages``."""
    read = lambda name: spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return judge(read("pages"), read("labels"), RULES, Scratch(spark, "urls"))
