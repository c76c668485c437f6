"""Bounded, repeatable samples of labelled rows for fitting a model on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null ids have none."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


def balanced(rows: DataFrame, label: str, order: str, each: int, most: int, most_bytes: int, text: str = "text") -> list:
    """Up to ``each`` ids of every label and ``most`` ids in all, in a hashed order of ``order``; texts over ``most_bytes`` are not drawn.

    Ids of a label are counted without their texts; a filter on the hash then
    keeps about the ids wanted, so neither a label nor a shuffle of all texts
    is ever gathered in one place. An id that many rows repeat counts and is
    drawn once, with the smallest of its texts. With more than ``most`` labels
    the most frequent ones are drawn, one id each.
    """
    usable = rows.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & (F.octet_length(text) <= most_bytes) & F.col(order).isNotNull())
    ids = usable.select(label, order).distinct().groupBy(label).count().orderBy(F.desc("count"), label).limit(most)
    counts = {r[label]: r["count"] for r in ids.collect()}
    if not counts:
        return []
    each = min(each, most // len(counts))
    scale = 1 << 30
    h = F.pmod(F.xxhash64(F.col(order), F.lit(17)), F.lit(scale))
    shares = [(value, scale if n <= each else int(scale * min(1.0, (each + 4 * each**0.5 + 8) / n))) for value, n in counts.items()]
    shares = F.broadcast(rows.sparkSession.createDataFrame(shares, f"`{label}` {rows.schema[label].dataType.simpleString()}, _share long"))  # at most ``most`` labels
    drawn = usable.select(label, order, text).join(shares, label).filter(h < F.col("_share")).groupBy(h.alias("_h"), F.col(order).alias("id"), F.col(label).alias("label")).agg(F.min(text).alias("text")).collect()
    taken: dict = {}
    for row in sorted(drawn, key=lambda r: (r["_h"], r["id"], r["text"])):
        some = taken.setdefault(row["label"], [])
        if len(some) < each:
            some.append(row)
    return [r for value in sorted(taken) for r in taken[value]]
