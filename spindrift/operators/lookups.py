"""Look-ups by key, texts of question chunks by role, and small rules of chat and tracking events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tracing import grading_event

# Agents whose answers are tracked, and names by which a question tells its subject.
TRACKED_AGENTS = ("knowledge_agent", "grading_agent", "path_agent")
SUBJECTS = [("data_structure", ["数据结构"]), ("computer_organization", ["组成原理", "计算机组成"]), ("operating_system", ["操作系统"]), ("computer_network", ["计算机网络", "网络"])]


def by_keys(rows: DataFrame, wanted: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows whose ``keys`` stand in ``wanted`` (ids, names, categories, id and owner); the first of each key by ``order`` if it is given.

    The first is found by an aggregate, so a key that very many rows share is
    never gathered.
    """
    found = rows.join(wanted.select(*keys).distinct(), keys, "left_semi")
    if not order:
        return found
    others = [c for c in rows.columns if c not in keys]
    first = F.min(F.struct(*order, *(c for c in others if c not in order)))
    return found.groupBy(*keys).agg(first.alias("_r")).select(*keys, "_r.*").select(rows.columns)


def question_text(role: Column, text: Column, question: Column, key: Column) -> Column:
    """The question of a merged chunk with its key; the whole text of others, and of one without a question."""
    whole = F.concat(question, F.when(F.coalesce(key, F.lit("")) != "", F.concat(F.lit("\n正确答案："), key)).otherwise(""))
    return F.when((role == "merged_qa") & (F.coalesce(question, F.lit("")) != ""), whole).otherwise(text)


def answer_text(role: Column, text: Column, answer: Column, key: Column) -> Column:
    """The answer of a merged chunk, after its key unless it begins with it; the whole text of others, and of one without an answer."""
    named = (F.coalesce(key, F.lit("")) != "") & ~answer.startswith(F.coalesce(key, F.lit("")))
    whole = F.when(named, F.concat(F.lit("正确答案："), key, F.lit("\n"), answer)).otherwise(answer)
    return F.when((role == "merged_qa") & (F.coalesce(answer, F.lit("")) != ""), whole).otherwise(text)


def role_context(found: DataFrame, text: Column) -> DataFrame:
    """query_id, context: ``text`` of each document of ``found`` (query_id, rank, source, heading, ...) under its source, in order of rank."""
    head = F.concat(F.lit("[来源"), F.col("rank").cast("string"), F.lit(": "), F.coalesce("source", F.lit("unknown")), F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit(" | "), "heading")).otherwise(""), F.lit("]\n"))
    rows = found.select("query_id", F.struct("rank", F.concat(head, text).alias("t")).alias("r"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["t"]), "\n\n").alias("context"))


def event_source(event_type: Column) -> Column:
    return F.when(event_type.startswith("qa_"), "qa").when(event_type.startswith("quiz_"), "quiz").when(event_type.startswith("grading_"), "grading").otherwise("unknown")


def source_stem(source: Column) -> Column:
    """The name of a source file without folders and its last extension."""
    return F.trim(F.regexp_replace(F.regexp_replace(source, "\\.[^.]*$", ""), "^.*/", ""))


def fan_out(events: DataFrame) -> DataFrame:
    """One row for each knowledge point of an event (kp_ids), in the list's order, repeats once."""
    return events.withColumn("kp", F.explode(F.array_distinct("kp_ids"))).drop("kp_ids")


def agent_events(answers: DataFrame) -> DataFrame:
    """Tracking events of answers (user_id, agent, kp_ids, confidence, answer): user_id, event_type, outcome, difficulty, kp_ids.

    Only tracked agents and answers with points give one; grading is read from
    the answer, others follow its confidence.
    """
    kept = answers.filter(F.col("agent").isin(*TRACKED_AGENTS) & (F.size("kp_ids") > 0))
    kind, outcome, difficulty = grading_event(F.col("answer"))
    high, graded = F.coalesce(F.col("confidence") == "high", F.lit(False)), F.col("agent") == "grading_agent"
    return kept.select(
        "user_id",
        F.when(graded, kind).when(high, "qa_high_confidence").otherwise("qa_low_confidence").alias("event_type"),
        F.when(graded, outcome).when(high, 1.0).otherwise(0.3).alias("outcome"),
        F.when(graded, difficulty).otherwise(1.0).alias("difficulty"),
        "kp_ids",
    )


def merged_flags(rule: dict[str, Column], model: dict[str, Column]) -> dict[str, Column]:
    """Flags that either the rules or a model set; the flags of length are those of the rules."""
    return {k: v if k in ("short", "long") else v | F.coalesce(model.get(k, F.lit(False)), F.lit(False)) for k, v in rule.items()}


def subject(text: Column) -> Column:
    """The subject that a question names; empty if it names none."""
    out = F.lit("")
    for name, words in reversed(SUBJECTS):
        out = F.when(text.rlike("|".join(words)), name).otherwise(out)
    return out


def main_collection(found: DataFrame) -> DataFrame:
    """query_id, category: the most frequent collection of ``found`` (query_id, rank, collection); of equal ones that seen first."""
    counts = found.filter("coalesce(collection, '') <> ''").groupBy("query_id", "collection").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    return counts.groupBy("query_id").agg(F.min_by("collection", F.struct(-F.col("n"), "first")).alias("category"))


def trace_category(given: Column, routes: Column, common: Column) -> Column:
    """The category of a trace: a given one; that of a single route; none for several; else the most frequent collection."""
    live = F.array_distinct(F.filter(routes, lambda r: F.coalesce(r, F.lit("")) != ""))
    return F.when(F.coalesce(given, F.lit("")) != "", given).when(F.size(live) > 1, "").when(F.size(live) == 1, F.get(live, F.lit(0))).otherwise(F.coalesce(common, F.lit("")))


def trace_items(found: DataFrame) -> DataFrame:
    """query_id, rank, content (500 characters), score: the rerank, recall or plain score, the first that isn't zero."""
    score = F.coalesce(*(F.when(F.col(c) != 0, F.col(c)) for c in ("rerank_score", "recall_score", "score")), F.lit(0.0))
    return found.select("query_id", "rank", F.substring(F.coalesce("text", F.lit("")), 1, 500).alias("content"), score.cast("double").alias("score"))


def latest_question(messages: DataFrame) -> DataFrame:
    """conv_id, text of the last message of the user in each conversation (conv_id, turn, role, text)."""
    return messages.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def difficulty_notes(evidence: DataFrame, registry: DataFrame, label) -> DataFrame:
    """query_id, point, note: the difficulty of each knowledge point that the evidence names, from its first mention.

    ``evidence`` (query_id, rank, point, difficulty, difficulty_source,
    named_level: whether a heading names the level). An automatic default that
    no heading supports is unknown; without a difficulty the ``registry``
    (name, difficulty) is asked.
    """
    first = evidence.filter("coalesce(point, '') <> ''").groupBy("query_id", "point").agg(F.min(F.struct("rank", "difficulty", "difficulty_source", "named_level")).alias("e")).select("query_id", "point", "e.*")
    known = registry.groupBy(F.col("name").alias("point")).agg(F.max("difficulty").alias("_registered"))
    rows = first.join(known, "point", "left")
    value = F.coalesce("difficulty", "_registered")
    guess = F.col("difficulty").isNotNull() & (F.coalesce("difficulty_source", F.lit("auto")) == "auto") & (F.col("difficulty") == 1.0) & ~F.coalesce("named_level", F.lit(False))
    text = F.concat(label(value), F.lit("("), F.format_number(value, 1), F.lit(")"))
    return rows.select("query_id", "point", F.when(guess | value.isNull(), "未知").otherwise(text).alias("note"))
