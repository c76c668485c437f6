"""Conversations: parent chains, turn pairs, sibling order, windows, lists, message trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import top_k


def backfill_parents(messages: DataFrame) -> DataFrame:
    """``messages`` (id, conversation_id) with parent_id: the message before in the conversation."""
    return messages.withColumn("parent_id", F.lag("id").over(Window.partitionBy("conversation_id").orderBy("id")))


def sibling_order(messages: DataFrame) -> DataFrame:
    """Place of each message among those with the same parent, from 0."""
    w = Window.partitionBy("conversation_id", "parent_id").orderBy("id")
    return messages.withColumn("siblings_order", (F.row_number().over(w) - 1).cast("long"))


def child_counts(messages: DataFrame) -> DataFrame:
    counts = messages.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    return messages.join(counts, "id", "left").withColumn("children", F.coalesce("children", F.lit(0)))


def parent_chain(messages: DataFrame, leaves: DataFrame, most: int) -> DataFrame:
    """The last ``most`` messages on the way from the root to each leaf: leaf, id, depth (0 at the leaf)."""
    up = messages.select("id", "parent_id")
    front = leaves.select(F.col("id").alias("leaf"), "id").join(up, "id").withColumn("depth", F.lit(0))
    found = front.select("leaf", "id", "depth")
    for depth in range(1, most):
        front = front.select("leaf", F.col("parent_id").alias("id")).filter("id is not null").join(up, "id").withColumn("depth", F.lit(depth))
        found = found.unionByName(front.select("leaf", "id", "depth"))
    return found


def last_messages(messages: DataFrame, n: int, first: bool = False) -> DataFrame:
    """The last (or first) ``n`` messages of each conversation, with place from 1 in time order."""
    kept = top_k(messages, ["conversation_id"], [F.asc("id") if first else F.desc("id")], n).drop("rank")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("conversation_id").orderBy("id")).cast("long"))


def turn_pairs(messages: DataFrame, most: int = 6, cut: int = 200) -> DataFrame:
    """User messages with the assistant's next answer, the last ``most`` of a conversation, texts cut: conversation_id, pair, question, answer.

    A user message counts if the next message that is not the system's comes
    from the assistant.
    """
    w = Window.partitionBy("conversation_id").orderBy("id")
    rows = messages.filter(F.col("role").isin("user", "assistant")).withColumn("_r", F.lead("role").over(w)).withColumn("_t", F.lead("text").over(w))
    pairs = rows.filter((F.col("role") == "user") & (F.col("_r") == "assistant"))
    pairs = top_k(pairs, ["conversation_id"], [F.desc("id")], most)
    number = F.row_number().over(Window.partitionBy("conversation_id").orderBy("id")).cast("long")
    return pairs.select("conversation_id", number.alias("pair"), F.substring("text", 1, cut).alias("question"), F.substring("_t", 1, cut).alias("answer"))


def summary_due(count: Column, window: int = 16) -> Column:
    return (count >= window) & (count % window == 0)


def conversation_list(messages: DataFrame) -> DataFrame:
    """conversation_id, messages, summary_due, latest question."""
    return messages.groupBy("conversation_id").agg(F.count("*").alias("messages"), F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("id"))).alias("latest_query")).withColumn("summary_due", summary_due(F.col("messages")))


def history_window(messages: DataFrame, n: int = 12, cut: int = 500) -> DataFrame:
    """The last ``n`` messages of each conversation; assistant texts are cut."""
    text = F.when(F.col("role") == "assistant", F.substring("text", 1, cut)).otherwise(F.col("text"))
    return last_messages(messages, n).select("conversation_id", "place", "role", text.alias("text"))


def branch_leaf(messages: DataFrame) -> DataFrame:
    """The last child of each message, by sibling order: parent_id, leaf."""
    return messages.filter("parent_id is not null").groupBy("parent_id").agg(F.max_by("id", F.struct("siblings_order", "id")).alias("leaf"))


def ensure(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` conversations (thread_id, ...) that don't exist yet, one for each thread."""
    return wanted.dropDuplicates(["thread_id"]).join(existing.select("thread_id"), "thread_id", "left_anti")


def delete(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) without those in ``gone`` (conversation_id)."""
    return conversations.join(gone, "conversation_id", "left_anti"), messages.join(gone, "conversation_id", "left_anti")
