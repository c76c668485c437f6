"""Practice questions: parsing, quality, grading transitions, difficulty labels, practice plans."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import top_k


def difficulty_value(label: Column) -> Column:
    return F.when(label.isin("基础", "简单", "入门"), 1.0).when(label.isin("理解", "中等"), 1.3).when(label.isin("综合", "较难", "综合应用"), 1.6).when(label.isin("困难", "高级"), 2.0).otherwise(1.3)


def difficulty_label(value: Column) -> Column:
    return F.when(value <= 1.1, "基础").when(value <= 1.4, "理解").when(value <= 1.7, "综合").otherwise("高级")


def parse(rows: DataFrame) -> DataFrame:
    """Questions in free text (id, raw): id, number, question_type, difficulty, stem, answer, explanation; parts without a stem are left out."""
    parts = F.slice(F.split("raw", "(?:题目|第)[\\d一二三四五六七八九十]+[题：:]"), 2, 10_000)
    each = rows.select("id", F.posexplode(parts).alias("n", "p"))
    field = lambda pattern: F.trim(F.regexp_extract("p", pattern, 1))
    kind = F.regexp_extract("p", "类型[：:]\\s*(选择|填空|简答|综合应用|综合|计算)", 1)
    level = F.regexp_extract("p", "难度[：:]\\s*(基础|简单|中等|较难|困难|高级|入门|理解|综合)", 1)
    out = each.select(
        "id", (F.col("n") + 1).alias("number"), F.when(kind == "", "简答").otherwise(kind).alias("question_type"), F.when(level == "", 1.0).otherwise(difficulty_value(level)).alias("difficulty"),
        field("(?s)题干[：:]\\s*(.+?)(?=\\n(?:标准答案|答案|解析)[：:]|\\z)").alias("stem"), field("(?s)(?:标准答案|答案)[：:]\\s*(.+?)(?=\\n(?:解析|题目|第)[：:]|\\z)").alias("answer"),
        field("(?s)解析[：:]\\s*(.+?)\\s*\\z").alias("explanation"),
    )
    return out.filter("stem <> ''")


@functools.cache
def _ratio():
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def best(stems: pd.Series, templates: pd.Series) -> pd.Series:
        return pd.Series([max((SequenceMatcher(None, s, t).ratio() for t in ts), default=0.0) if s else 0.0 for s, ts in zip(stems, templates)])

    return best


def quality(rows: DataFrame, templates: list[str] | None = None) -> DataFrame:
    """Add quality_score: less 0.3 near a template, 0.3 for a short explanation, 0.2 for a type that its batch has five times; 0 at least."""
    many = F.count("*").over(Window.partitionBy("batch_id", "question_type")) >= 5
    score = F.lit(1.0) - F.when(F.length(F.coalesce("explanation", F.lit(""))) < 20, 0.3).otherwise(0.0) - F.when(many, 0.2).otherwise(0.0)
    if templates:
        score = score - F.when(_ratio()(F.col("stem"), F.array(*map(F.lit, templates))) > 0.8, 0.3).otherwise(0.0)
    return rows.withColumn("quality_score", F.round(F.greatest(F.lit(0.0), score), 6))


def wrong_questions(records: DataFrame, limit: int, least: float = 0.5) -> DataFrame:
    """A user's latest wrong questions; poor ones are left out after the limit, so fewer may come back."""
    latest = top_k(records.filter("is_wrong"), ["user_id"], [F.desc("created_at"), F.desc("id")], limit)
    return latest.filter(F.col("quality_score").isNull() | (F.col("quality_score") >= least))


def redo_counts(grades: DataFrame) -> DataFrame:
    """How often each question (question_id, at, is_wrong) went from wrong to right, and its last state."""
    w = Window.partitionBy("question_id").orderBy("at")
    steps = grades.withColumn("_turn", (F.lag("is_wrong").over(w) & ~F.col("is_wrong")).cast("int"))
    return steps.groupBy("question_id").agg(F.coalesce(F.sum("_turn"), F.lit(0)).alias("redo_count"), F.max_by("is_wrong", "at").alias("is_wrong"))


def grading_type(score: Column) -> Column:
    return F.when(score >= 80, "grading_excellent").when(score >= 60, "grading_pass").otherwise("grading_fail")


def practice_plan(weak: DataFrame, most: int = 3) -> DataFrame:
    """Topics of each user's weakest points and a difficulty band by mean score (under 0.3, under 0.5, above)."""
    first = top_k(weak, ["user_id"], [F.asc("effective_score"), F.asc("kp")], most)
    out = first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), "、").alias("topics"), F.avg("effective_score").alias("m"))
    return out.select("user_id", "topics", F.when(F.col("m") < 0.3, "基础").when(F.col("m") < 0.5, "理解").otherwise("综合").alias("band"))


def strip_fence(text: Column) -> Column:
    inner = F.regexp_extract(text, "(?s)```(?:\\w+)?\\s*\\n?(.*?)```", 1)
    return F.regexp_replace(F.when(inner != "", inner).otherwise(text), "^\\s+|\\s+$", "")


def loose_json(text: Column) -> Column:
    """The JSON in a text: without its fence, as a whole, else its outermost array or object; null if none parses."""
    bare = strip_fence(text)
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(ok(bare), ok(F.regexp_extract(bare, "(?s)(\\[.*\\])", 1)), ok(F.regexp_extract(bare, "(?s)(\\{.*\\})", 1)))


def render(rows: DataFrame) -> DataFrame:
    """Text of each batch's questions in order."""
    one = F.concat_ws("\n", F.concat(F.lit("题目"), F.col("number").cast("string"), F.lit("：")), F.concat(F.lit("类型："), "question_type"), F.concat(F.lit("题干："), "stem"), F.concat(F.lit("答案："), "answer"))
    listed = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("number", one.alias("t")))).alias("l"))
    return listed.select("id", F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("text"))
