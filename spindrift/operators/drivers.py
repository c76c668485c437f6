"""Corpus drivers: whole preparation steps with a log of what they did to each document.

Each takes and returns documents; what a step did stands beside the text in
columns, so a log is a projection and its totals are an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import spread, stored
from . import corpus

# Variants of characters and their simplified forms.
VARIANTS = {
    "裏": "里", "裡": "里", "羣": "群", "氹": "凼", "牀": "床", "綫": "线", "麫": "面", "賸": "剩",
    "衞": "卫", "颱": "台", "鑑": "鉴", "籲": "吁", "剗": "铲", "姦": "奸", "賾": "赜", "祕": "秘",
    "眾": "众", "纔": "才", "剋": "克", "託": "托", "註": "注", "麪": "面", "鐘": "钟", "鍾": "钟",
}


def simplify(text: Column) -> Column:
    """Variant characters in their simplified form; there is no full converter here."""
    return F.translate(text, "".join(VARIANTS), "".join(VARIANTS.values()))


def clean_markdown(text: Column) -> Column:
    """Control characters out, NFKC, lines without trailing blanks, at most two blank lines in a row, trimmed; code keeps its indents."""
    out = corpus.nfkc(F.regexp_replace(F.regexp_replace(text, "\\r\\n?", "\n"), corpus.CONTROL, ""))
    out = F.regexp_replace(F.regexp_replace(out, "(?m)[ \\t]+$", ""), "\\n{4,}", "\n\n\n")
    return F.coalesce(F.regexp_replace(out, "^\\s+|\\s+$", ""), F.lit(""))


def exam_source(source: Column) -> Column:
    """Whether a source is a Markdown file of exam questions."""
    path = F.lower(F.replace(source, F.lit("\\"), F.lit("/")))
    return F.coalesce(F.contains(path, F.lit("/questions/")) | path.endswith("_408_exam.md"), F.lit(False))


def normalize(docs: DataFrame, dates: bool = True, lists: bool = True, simplified: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, ...) with normalized text, ``changes`` (names of the steps that changed it) and ``char_delta`` (characters fewer). Blank texts stay as they are."""
    steps = [("fullwidth", corpus.halfwidth, True), ("date", corpus.normalize_dates, dates), ("time", corpus.normalize_times, dates), ("simplified", simplify, simplified), ("list_markers", corpus.list_markers, lists)]
    out = docs.withColumns({"_t0": F.col("text")})
    names = []
    for i, (name, step, wanted) in enumerate((s for s in steps if s[2])):
        out = out.withColumn(f"_t{i + 1}", F.when(F.trim(F.col(f"_t{i}")) != "", step(F.col(f"_t{i}"))).otherwise(F.col(f"_t{i}")))
        names.append(F.when(F.col(f"_t{i}") != F.col(f"_t{i + 1}"), F.lit(name)))
    last = F.col(f"_t{len(names)}")
    out = out.withColumns({"changes": F.array_compact(F.array(*names)), "char_delta": F.coalesce(F.length("_t0") - F.length(last), F.lit(0)), "text": last})
    return out.drop(*(f"_t{i}" for i in range(len(names) + 1)))


def repeated_units(text: Column) -> Column:
    """Whether a unit of 2 to 8 characters stands three times in a row in a text of at least 20 characters."""
    return F.coalesce((F.length(text) >= 20) & text.rlike("(.{2,8}?)\\1{2,}"), F.lit(False))


def content_anomalies(docs: DataFrame) -> DataFrame:
    """First phase, before dedup: ``docs`` (doc_id, text) with text, full_garbage, garbled (indexes), word_freq, actions.

    A document that is garbage as a whole is only marked; in others garbled
    paragraphs give way to a note and repeated units are collapsed.
    """
    rows = docs.withColumn("text", F.coalesce(F.trim("text"), F.lit(""))).withColumn("full_garbage", corpus.full_garbage(F.col("text")))
    rows = rows.withColumn("garbled", F.when(F.col("full_garbage"), F.array().cast("array<int>")).otherwise(corpus.garbled_paragraphs(F.col("text"))))
    rows = rows.withColumn("_isolated", F.when(F.size("garbled") > 0, corpus.isolate_garbled(F.col("text"))).otherwise(F.col("text")))
    rows = rows.withColumn("word_freq", ~F.col("full_garbage") & (repeated_units(F.col("_isolated")) | ((F.length("_isolated") >= 20) & (F.size(corpus.frequent_chars(F.col("_isolated"), 50)) > 0))))
    rows = rows.withColumn("_clean", F.when(F.col("word_freq"), corpus.collapse_repeats(F.col("_isolated"))).otherwise(F.col("_isolated")))
    actions = F.array_compact(F.array(
        F.when(F.col("full_garbage"), "full_garbage"),
        F.when(F.size("garbled") > 0, F.concat(F.lit("isolated:"), F.size("garbled").cast("string"))),
        F.when(F.length("_clean") < F.length("_isolated"), F.concat(F.lit("collapsed:"), (F.length("_isolated") - F.length("_clean")).cast("string"))),
    ))
    return rows.withColumns({"actions": actions, "text": F.col("_clean")}).drop("_isolated", "_clean")


def statistical_anomalies(docs: DataFrame) -> DataFrame:
    """Second phase, after dedup: ``docs`` (doc_id, text, actions) with outlier, zscore, suggestion, mix, and both in ``actions``."""
    lengths = corpus.length_outliers(docs.select("doc_id", "text")).select("doc_id", "outlier", "zscore", F.col("action").alias("suggestion"))
    out = docs.join(lengths, "doc_id", "left").withColumn("mix", corpus.language_mix(F.col("text")))
    mixed = F.col("mix") > 0.4
    added = F.array_compact(F.array(F.when(F.col("outlier").isNotNull(), F.concat_ws(":", F.lit("length"), "outlier")), F.when(mixed, F.lit("language_mixed"))))
    return out.withColumn("actions", F.concat("actions", added))


def anomalies(docs: DataFrame) -> DataFrame:
    """Both phases; documents that are garbage as a whole leave in between, and the rest is stored, as the second phase reads it several times."""
    return statistical_anomalies(stored(content_anomalies(spread(docs)).filter(~F.col("full_garbage")), "content"))


def anomaly_totals(found: DataFrame) -> DataFrame:
    """Number of documents by kind of action."""
    return found.select(F.explode("actions").alias("a")).groupBy(F.substring_index("a", ":", 1).alias("kind")).agg(F.count("*").alias("documents"))


def dedup(docs: DataFrame, threshold: float = 0.9, fuzzy: bool = True) -> DataFrame:
    """doc_id, kept, duplicate_of, kind ('exact', 'fuzzy', null for kept) of every document that isn't blank.

    Exact copies go first; of the rest a later near copy of a document that
    stands goes, in the order of ids. Any chain is followed without gathering it.
    """
    exact = corpus.exact_dedup(docs)
    if not fuzzy:
        return exact.withColumn("kind", F.when(~F.col("kept"), "exact"))
    left = docs.join(exact.filter("kept").select("doc_id"), "doc_id", "left_semi")
    near = corpus.greedy_keep(corpus.near_pairs(left.select("doc_id", "text"), threshold)).select(F.col("removed").alias("doc_id"), F.col("kept").alias("near"))
    out = exact.join(near, "doc_id", "left")
    return out.select(
        "doc_id",
        (F.col("kept") & F.col("near").isNull()).alias("kept"),
        F.coalesce("near", "duplicate_of").alias("duplicate_of"),
        F.when(~F.col("kept"), "exact").when(F.col("near").isNotNull(), "fuzzy").alias("kind"),
    )


def ingest_totals(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents, characters, errors and chunks by category, and in all (category null). ``docs`` (doc_id, category, text, error), ``chunks`` (doc_id)."""
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    rows = docs.select("doc_id", F.coalesce("category", F.lit("unknown")).alias("category"), F.length("text").alias("chars"), "error").join(per, "doc_id", "left")
    return rows.rollup("category").agg(F.count("*").alias("documents"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.count("error").alias("errors"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
