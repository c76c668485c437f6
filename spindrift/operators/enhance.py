"""Keywords by TextRank, and the enhancer of chunks as one step.

TextRank links words that stand within WINDOW places of each other, weighted
by how often they do, and ranks them by a random walk that stays on its word's
links with probability DAMPING. Each text's graph is an array of at most
2 * (WINDOW - 1) links for each word, and the walk is a power iteration until
nothing moves by more than TOLERANCE, so it doesn't depend on any order.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.files import spread
from . import corpus

WINDOW, DAMPING, TOLERANCE, ROUNDS = 5, 0.85, 1e-10, 500
#: Keywords of a chunk.
KEYWORDS = 8
_WORD = re.compile("[一-鿿]{2,4}|[a-zA-Z]{3,}")
#: Kinds of content that have a structure of their own.
STRUCTURED = ("section", "list", "exercise", "answer", "code_mixed", "merged_qa")


def words(text: str, stop: frozenset[str]) -> list[str]:
    """CJK runs of two to four characters and lower-cased Latin words of three letters and more, in order, without ``stop``."""
    return [w for w in map(str.lower, _WORD.findall(text)) if w not in stop]


def weights(found: np.ndarray, n: int) -> np.ndarray:
    """The rank of each of ``n`` words of a text, which is given as the numbers of its words in order."""
    pairs = [np.stack([found[:-step], found[step:]]) for step in range(1, WINDOW) if len(found) > step]
    if not pairs:
        return np.ones(n)
    a, b = np.concatenate(pairs, axis=1)
    codes, times = np.unique(np.concatenate([a * n + b, b * n + a]), return_counts=True)
    to, origin = codes // n, codes % n
    share = times / np.bincount(origin, times, n)[origin]
    rank = np.ones(n)
    for _ in range(ROUNDS):
        new = 1 - DAMPING + DAMPING * np.bincount(to, share * rank[origin], n)
        done = np.abs(new - rank).max() <= TOLERANCE
        rank = new
        if done:
            break
    return rank


def ranked(text: str, stop: frozenset[str], k: int) -> list[tuple[str, float]]:
    """The ``k`` words of the highest rank, to six digits; equal ones by their spelling."""
    listed = words(text, stop)
    number = {w: i for i, w in enumerate(dict.fromkeys(listed))}
    if not number:
        return []
    rank = np.round(weights(np.array([number[w] for w in listed], np.int64), len(number)), 6).tolist()
    return sorted(((w, r) for w, r in zip(number, rank)), key=lambda x: (-x[1], x[0]))[:k]


def text_rank(docs: DataFrame, k: int = KEYWORDS, stop: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, words array<struct<word, weight>> of ``docs`` (doc_id, text): the best ``k`` words by TextRank; none for null texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    left_out = frozenset(stop)

    def run(batches):
        element = pa.list_(pa.struct([("word", pa.string()), ("weight", pa.float64())]))
        for batch in batches:
            found = [[{"word": w, "weight": r} for w, r in ranked(t.as_py() or "", left_out, k)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, element)], names=["doc_id", "words"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, words array<struct<word:string,weight:double>>")


def _distinct(values: Column) -> Column:
    """Values without those that occurred before in another case, and without blanks."""
    seen = F.aggregate(
        F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x)),
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "") | F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return seen


def enhance(chunks: DataFrame, k: int = KEYWORDS, stop: tuple[str, ...] = ()) -> DataFrame:
    """``chunks`` (doc_id, chunk_id, source, role, heading_path, text) with what retrieval filters by.

    Added: keywords (the heading's parts, then words by TextRank; ``k`` in all),
    heading_keywords, heading_slug, has_heading, content_type, is_structured,
    has_code_block, line_count, estimated_tokens, source_name, source_ext. The
    words of a chunk are found where it is read; nothing is shuffled. Null
    texts count as empty. Columns of the names that are added are replaced.
    """
    left_out = frozenset(stop)
    names = ("keywords", "heading_keywords", "heading_slug", "has_heading", "content_type", "is_structured", "has_code_block", "line_count", "estimated_tokens", "source_name", "source_ext")
    chunks = chunks.drop(*names)

    def run(batches):
        for batch in batches:
            found = [[w for w, _ in ranked(t or "", left_out, k)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names, "_words"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    rows = spread(chunks).mapInArrow(run, fields + ", _words array<string>")
    text, source = F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))
    parts = corpus.heading_parts(F.col("heading_path"))
    ext = F.lower(F.regexp_extract(source, "(\\.[^./\\\\]+)$", 1))
    stem = F.regexp_replace(F.regexp_replace(source, "^.*[/\\\\]", ""), "(?<=.)\\.[^.]+$", "")
    # one copy of each word, whatever its case, the heading's first
    merged = F.slice(F.concat(parts, F.filter("_words", lambda w: ~F.array_contains(parts, w))), 1, k)
    out = rows.select(
        *(F.col(f"`{c}`") for c in chunks.columns),
        F.array_join(_distinct(merged), ", ").alias("keywords"),
        F.array_join(parts, ", ").alias("heading_keywords"),
        corpus.heading_slug(F.col("heading_path")).alias("heading_slug"),
        (F.size(parts) > 0).alias("has_heading"),
        corpus.content_type(text, F.col("heading_path"), F.col("role"), ext).alias("content_type"),
        (text.contains("```") | text.contains("~~~") | text.rlike("(^|\\n)\\s{4,}\\S")).alias("has_code_block"),
        F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, "\\n$", ""), "\\n"))).cast("long").alias("line_count"),
        T.estimate_tokens_by_width(text).alias("estimated_tokens"),
        stem.alias("source_name"),
        ext.alias("source_ext"),
    )
    return out.withColumn("is_structured", F.col("content_type").isin(*STRUCTURED))
