"""Answer governance: sources, forged references, citations, format, confidence, reflection, context truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source words of each agent, and patterns of doubtful references.
SOURCES = {"knowledge_agent": "来源|来源依据|来源文件|来源片段|Sources|\\[来自|参考|根据教材|依据", "grading_agent": "评分依据|依据|标准答案", "path_agent": "依据来源|知识图谱|学习路径文档"}
FORGED = "根据教材第\\s*\\d+\\s*章|根据第\\s*\\d+\\s*章|教材第\\s*\\d+\\s*节|课本第\\s*\\d+\\s*页"
FILLER = "^(当然可以|好的|没问题|当然|下面我来|我来帮你|让我来|作为)"


def has_source(answer: Column, agent: Column) -> Column:
    out = F.lit(True)
    for name, words in SOURCES.items():
        out = F.when(agent == name, answer.rlike(words)).otherwise(out)
    return out


def forged(answer: Column, outputs: Column) -> Column:
    """Chapter and page references that no tool output holds."""
    found = F.regexp_extract_all(answer, F.lit(f"({FORGED})"), F.lit(1))
    key = lambda x: F.trim(F.regexp_replace(x, "[第章节页]", ""))
    return F.filter(found, lambda x: ~F.exists(outputs, lambda o: F.contains(o, key(x))))


def trigram_similarity(a: Column, b: Column) -> Column:
    grams = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3))))
    both = F.size(F.array_intersect(grams(a), grams(b))) / F.size(F.array_union(grams(a), grams(b)))
    return F.when((F.length(a) < 3) | (F.length(b) < 3), 0.0).otherwise(both)


def unverified_citations(answer: Column, outputs: Column) -> Column:
    """Citations that name a source but hardly occur in the evidence."""
    body = "([^，。！？\\n]{2,30})"
    patterns = (f"根据{body}[，。]", f"{body}中指出[，。]", f"{body}中提到[，。]", f"依据{body}[，。]")
    found = F.flatten(F.array(*(F.regexp_extract_all(answer, F.lit(p), F.lit(1)) for p in patterns)))
    named = F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x.rlike("(?i)(来源|Source|\\.md|第\\s*\\d+\\s*[章节页]|教材|知识图谱)"))
    text = F.array_join(outputs, " ")
    return F.when(F.size(outputs) > 0, F.filter(named, lambda x: trigram_similarity(x, text) < 0.3)).otherwise(F.array().cast("array<string>"))


def filler(answer: Column) -> Column:
    return F.substring(answer, 1, 50).rlike(FILLER)


def format_warnings(answer: Column, agent: Column) -> Column:
    """Number of format rules of the agent that an answer breaks."""
    miss = lambda p: (~answer.rlike(p)).cast("int")
    return (
        F.when(agent == "knowledge_agent", miss("(?i)概念解释[：:]|核心要点[：:]?|定义|核心|要点|来源依据[：:]?|\\[来源\\s*\\d+|\\[Source\\s*\\d+"))
        .when(agent == "grading_agent", miss("评分[：:]|评分（参考）") + miss("评分依据|参考评分"))
        .when(agent == "path_agent", miss("学习路径"))
        .when(agent == "question_agent", miss("题目|题干"))
        .otherwise(0)
    )


def confidence(answer: Column, agent: Column, outputs: Column) -> Column:
    return (
        F.when(F.size(forged(answer, outputs)) > 0, "low")
        .when(F.length(F.trim(answer)) < 20, "low")
        .when(~has_source(answer, agent) | (format_warnings(answer, agent) >= 2), "medium")
        .when(filler(answer), "medium")
        .otherwise("high")
    )


def disclaimer(answer: Column, agent: Column, level: Column) -> Column:
    note = F.when(level == "low", "⚠️ 此回答可能包含未经验证的内容，请谨慎参考。").when((level == "medium") & ~has_source(answer, agent), "📌 以上回答未检索到充分依据，部分内容为模型推断，仅供参考。")
    return F.when(note.isNotNull(), F.concat(F.rtrim(answer), F.lit("\n"), note)).otherwise(answer)


def reflection(answer: Column, evidence: Column) -> tuple[Column, Column]:
    """(number of issues, confidence): short answer, few shared terms, numbers on thin evidence, chapter references."""
    terms = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[一-鿿A-Za-z]{2,}"), F.lit(0)))
    mine = terms(answer)
    overlap = F.when((F.size(mine) > 0) & (evidence != ""), F.size(F.array_intersect(mine, terms(evidence))) / F.size(mine)).otherwise(0.0)
    both = (answer != "") & (evidence != "")
    issues = (
        (F.length(answer) < 20).cast("int")
        + (~(overlap > 0.3) & (F.length(answer) > 50)).cast("int")
        + (both & answer.rlike("\\d+\\s*[个次种条层级别]") & (F.length(evidence) < 100)).cast("int")
        + (both & answer.rlike("第[一二三四五六七八九十\\d]+章")).cast("int")
    )
    return issues, F.when(issues == 0, "high").when(issues <= 2, "medium").otherwise("low")


def sources_of(text: Column) -> Column:
    """Distinct source names in a text, in order: after 来源 or Source labels."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?:来源|Source)(?:文件)?\\s*\\d*[：:\\]]\\s*([^\\s，。；\\]]+)"), F.lit(1)), lambda x: F.trim(x)))


def append_sources(answer: Column, sources: Column) -> Column:
    return F.when(answer.contains("来源") | (F.size(sources) == 0), answer).otherwise(F.concat(F.rtrim(answer), F.lit("\n\n来源："), F.array_join(sources, "、")))


def fixed_chunks(text: Column, size: int = 20) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size)), lambda i: F.substring(text, (i * size + 1).cast("int"), F.lit(size))))


def fast_stream(route: Column, short: Column, flags: list[Column], layer: Column) -> Column:
    """Whether an answer may stream without checks: knowledge route, no special flag, lowest layer."""
    special = F.lit(False)
    for f in flags:
        special = special | f
    return (route == "knowledge_agent") & ~special & (layer == "L1")
