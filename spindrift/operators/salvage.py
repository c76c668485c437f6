"""Salvage of JSON payloads that were cut off, and a budget of costly calls over a table.

``complete`` keeps every element of a payload that ends before the cut: an
automaton with a stack of open brackets reads the text once and remembers the
last place where an element of an outermost array, or a member of an object
outside arrays, was whole; the text up to there is closed and the rest goes.

``within_budget`` spends a number of calls on exactly the first rows, in the
order of a column, that want one. Rows are ranked by ranges (a count for each
range reaches the driver), so the result is the same for any partitioning.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import numbered
from .search import STOP_WORDS

_TOKEN = re.compile(r'\s+|"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+', re.DOTALL)
_CLOSE = {"{": "}", "[": "]"}


def closed(text: str | None) -> str | None:
    """The JSON of what is whole in ``text``, from its first bracket on; null without a bracket.

    A number or word at the very end may go on beyond the cut, so it isn't
    whole. Reading stops at a bracket or mark that can't stand where it does.
    """
    begin = min((i for i in ((text or "").find(c) for c in "{[") if i >= 0), default=-1)
    if begin < 0:
        return None
    stack: list[str] = []
    at, end, rest = begin, begin, ""  # up to ``end`` all is whole, and ``rest`` closes it
    before = ","  # the mark before; a value may follow , : [ {
    for m in iter(lambda: _TOKEN.match(text, at), None):
        token, at = m[0], m.end()
        if token.isspace():
            continue
        value = None
        if token in "{[":
            if before not in (",", ":", "[") or (stack and stack[-1] == "{" and before != ":"):
                break
            stack.append(token)
            if "[" not in stack[:-1]:
                end, rest = at, "".join(_CLOSE[c] for c in reversed(stack))
            before = token
            continue
        if token in "}]":
            if not stack or _CLOSE[stack[-1]] != token or before in (",", ":"):
                break
            stack.pop()
            value = True
        elif token in ",:":
            if not stack or before != "value" or (token == ":" and stack[-1] != "{"):
                if not (token == ":" and before == "key" and stack and stack[-1] == "{"):
                    break
            before = token
            continue
        else:
            if not stack or before in ("value", "key"):
                break
            if stack[-1] == "{" and before in ("{", ","):
                if token[0] != '"':
                    break
                before = "key"
                continue
            if token[0] != '"' and at == len(text):
                break
            value = True
        if value:
            before = "value"
            if not stack:
                return text[begin:at]
            outer = stack.index("[") if "[" in stack else None
            if outer is None or outer == len(stack) - 1:
                end, rest = at, "".join(_CLOSE[c] for c in reversed(stack))
    return text[begin:end] + rest if end > begin else None


@functools.cache
def _closer():
    @F.pandas_udf("string")
    def close(texts: pd.Series) -> pd.Series:
        return texts.map(closed, na_action="ignore")

    return close


def complete(payload: Column) -> Column:
    """A cut payload as whole JSON."""
    return _closer()(payload)


def within_budget(rows: DataFrame, wants: Column, order: str, budget: int) -> DataFrame:
    """``rows`` with ``allowed``: whether a row is among the first ``budget`` by ``order``, which tells rows apart, for which ``wants`` holds."""
    wanted = F.coalesce(wants, F.lit(False))
    asking = rows.filter(wanted & F.col(order).isNotNull()).select(order)
    last = numbered(asking, [order], "_place").filter(F.col("_place") == budget).select(order).first() if budget > 0 else None
    if budget <= 0:
        return rows.withColumn("allowed", F.lit(False))
    within = F.lit(True) if last is None else F.col(order) <= F.lit(last[0])
    return rows.withColumn("allowed", wanted & F.coalesce(within & F.col(order).isNotNull(), F.lit(False)))


#: Share of a heading's words that its text must hold, and the mark of a heading that may be wrong.
GROUNDED, GUESSED, UNNAMED = 0.5, "[推测]", "[未命名文档]"


def grounding(heading: Column, text: Column) -> Column:
    """Share of a heading's words (Latin words and CJK characters but for stop words) that the text holds; null if it has none."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    words = F.filter(F.regexp_extract_all(F.lower(heading), F.lit("[a-z0-9_]+|[\\u4e00-\\u9fff]"), F.lit(0)), lambda w: ~F.array_contains(stop, w))
    held = F.filter(words, lambda w: F.contains(F.lower(F.coalesce(text, F.lit(""))), w))
    return F.size(held) / F.when(F.size(words) > 0, F.size(words))


def grounded(heading: Column, text: Column) -> Column:
    """Whether a heading is about its text: two characters at least, not a number, half of its words in the text."""
    odd = (F.length(heading) < 2) | heading.rlike("^[\\d._\\-]+$")
    return F.coalesce(F.when(heading == UNNAMED, True).otherwise(~odd & (F.coalesce(grounding(heading, text), F.lit(0.0)) >= GROUNDED)), F.lit(False))


def headings(docs: DataFrame, budget: int) -> DataFrame:
    """doc_id, heading, method of ``docs`` (doc_id, text, given, candidate).

    A given heading stays ('given'). Others need a call to check their
    candidate: it is taken if the text bears it out ('checked'), else the first
    line is, as a guess ('rejected'). Beyond ``budget`` calls, in the order of
    ids, candidates are taken unchecked, as guesses ('degraded').
    """
    given = F.nullif(F.trim("given"), F.lit(""))
    rows = within_budget(docs.select("doc_id", "text", given.alias("given"), F.trim("candidate").alias("candidate")), given.isNull(), "doc_id", budget)
    first = F.substring(F.trim(F.regexp_extract(F.coalesce("text", F.lit("")), "(?m)^\\s*(\\S.*)$", 1)), 1, 40)
    fallback = F.when(first == "", UNNAMED).otherwise(F.concat(F.lit(GUESSED), first))
    method = F.when(F.col("given").isNotNull(), "given").when(~F.col("allowed"), "degraded").when(grounded(F.col("candidate"), F.col("text")), "checked").otherwise("rejected")
    rows = rows.withColumn("method", method)
    heading = F.when(F.col("method") == "given", F.col("given")).when(F.col("method") == "checked", F.col("candidate")).when((F.col("method") == "degraded") & (F.col("candidate") != ""), F.concat(F.lit(GUESSED), "candidate")).otherwise(fallback)
    return rows.select("doc_id", heading.alias("heading"), "method")
