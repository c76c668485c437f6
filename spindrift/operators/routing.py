"""Query understanding and retrieval policy: flags, depth, strategy, decomposition, routes, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fusion import ROUTES, route_weight

# Words that set each flag of a query.
MARKERS = {
    "code": "代码|示例|实现|伪代码|算法实现",
    "exercise": "习题|练习|题目|选择题|判断题|填空|简答题|出题|题",
    "answer": "答案|解析|批改|评分|得分|为什么错|标准答案",
    "structured": "步骤|流程|总结|要点|区别|注意事项|清单|对比",
    "concept": "概念|定义|是什么|什么是|含义|意思|原理|介绍|应用|作用|用途|解释",
    "comparison": "区别|不同|差异|对比|比较|相同|异同|关系|联系",
    "learning_path": "怎么学|如何学|学习路线|学习路径|复习路线|复习路径|前置知识|重点章节|应该怎么学",
}
# Agents by words, first match first.
AGENTS = [
    ("grading_agent", "批改|评分|对吗|判断对错|判对错|打分|检查答案|我的回答|我答的|帮我看|批作业|纠错|学生答案|我的答案|题目："),
    ("question_agent", "出题|练习|测试|考考我|刷题|给我出|出几道|来几道|测验|模拟题|真题|选择题|填空题|简答题"),
    ("path_agent", "怎么学|学习路线|推荐路线|学习路径|怎么复习|从哪开始|学习建议|学习规划|备考建议|复习计划|接下来学"),
    ("knowledge_agent", "什么是|解释|原理|区别|对比|定义|是什么|为什么|如何理解|介绍一下|讲一下|说明|概念|过程|方法|算法|机制|条件|特点"),
]
# Fixed values: (k, skip_kg, skip_hyde, skip_rerank, metadata routes, layer, route type) of each depth.
DEPTHS = {
    "shallow": (3, True, True, True, 0, "L1", "l1_fast"),
    "standard": (5, True, False, False, 2, "L2", "l2_standard"),
    "deep": (8, False, False, False, 3, "L3", "l3_deep"),
    "code": (6, False, True, False, 2, "L3", "l3_code"),
    "text_only": (5, True, False, False, 2, "L2", "l2_text_only"),
}


def query_flags(text: Column, terms: Column) -> dict[str, Column]:
    """Seven marker flags and the two length flags of a query; a Latin identifier of four letters or more also means code."""
    lowered = F.lower(text)
    out = {name: (lowered if name == "code" else text).rlike(words) for name, words in MARKERS.items()}
    out["code"] = out["code"] | F.exists(terms, lambda t: t.rlike("^[A-Za-z_][A-Za-z0-9_.]{3,}$"))
    out["short"] = (F.size(terms) <= 2) & (F.length(text) <= 15)
    out["long"] = (F.length(text) >= 40) | (F.size(terms) >= 6)
    return out


def depth(f: dict[str, Column]) -> Column:
    return (
        F.when(f["learning_path"], F.when(f["long"], "deep").otherwise("standard"))
        .when(f["short"], "shallow")
        .when(f["comparison"], "standard")
        .when(f["code"], "code")
        .when(f["exercise"] | f["answer"], "standard")
        .when(f["long"] & f["structured"], "deep")
        .otherwise("standard")
    )


def strategy(name: Column) -> Column:
    """Struct of a depth's settings, its layer and its route type."""
    fields = ("k", "skip_kg", "skip_hyde", "skip_rerank", "max_metadata_routes", "layer", "route_type")
    out = None
    for key, values in DEPTHS.items():
        one = F.struct(*(F.lit(v).alias(n) for n, v in zip(fields, values)))
        out = F.when(name == key, one) if out is None else out.when(name == key, one)
    return out


def needs_model(f: dict[str, Column]) -> Column:
    """Whether rules say nothing about a query: no marker flag and not short."""
    any_flag = F.lit(False)
    for name in MARKERS:
        any_flag = any_flag | f[name]
    return ~any_flag & ~f["short"]


def should_decompose(text: Column, f: dict[str, Column]) -> Column:
    return ~f["short"] & (f["comparison"] | f["long"] | (F.length(text) > 30))


def decompose(text: Column, comparison: Column) -> Column:
    """A comparison of two or three things as the query and a question for each of the first two; empty otherwise."""
    head = "^(?:请|帮我|解释|说明|比较|对比|分析|讲解|一下)+"
    tail = "(?:的)?(?:区别|差异|不同|异同|关系|联系|对比|比较)$"
    strip = lambda x: F.regexp_replace(x, "^[：:，,。？? ]+|[：:，,。？? ]+$", "")
    part = lambda x: strip(F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(x), head, "")), tail, "")))
    parts = F.filter(F.transform(F.split(text, "\\s*(?:和|与|及|以及|、|，|,|\\s+vs\\s+|\\s+VS\\s+)\\s*"), part), lambda x: F.length(x) >= 2)
    subs = F.transform(F.slice(parts, 1, 2), lambda x: F.concat(x, F.lit("的核心概念")))
    fits = comparison & (F.length(text) <= 80) & text.rlike("区别|差异|不同|异同|关系|联系|对比|比较") & F.size(parts).between(2, 3)
    return F.when(fits, F.concat(F.array(text), subs)).otherwise(F.array().cast("array<string>"))


def agent(text: Column) -> Column:
    lowered = F.lower(text)
    out = F.when(lowered.rlike(AGENTS[0][1]), AGENTS[0][0])
    for name, words in AGENTS[1:]:
        out = out.when(lowered.rlike(words), name)
    return out


def recall_routes(text: Column, terms: Column, expanded: Column) -> Column:
    """Array of (route, text): semantic, keyword_bm25 with terms, focus with two terms or more, expanded if it differs."""
    row = lambda name, value: F.struct(F.lit(name).alias("route"), value.alias("text"))
    routes = F.array(
        row("semantic", text),
        F.when(F.size(terms) > 0, row("keyword_bm25", F.array_join(terms, " "))),
        F.when(F.size(terms) >= 2, row("focus", F.array_join(F.slice(terms, 1, 2), " "))),
        F.when(expanded != text, row("expanded", expanded)),
    )
    return F.array_compact(routes)


def policy(k: Column, threshold: Column, use_rerank: Column, f: dict[str, Column]) -> tuple[Column, Column]:
    """(score threshold, coarse k): the threshold grows with the heaviest route and by kind of query; k by kind and reranking."""
    heaviest = F.greatest(*(route_weight(F.lit(r), f) for r in ROUTES))
    out = threshold * heaviest / 1.5
    out = out * F.when(f["exercise"] | f["answer"], 1.2).when(f["short"], 0.75).when(f["long"] | f["comparison"], 1.1).otherwise(1.0)
    wide = F.when(f["short"] | f["code"] | f["long"], 6).otherwise(5)
    reranked = F.greatest(k, F.least(k * wide, F.lit(50)))
    plain = F.when(f["short"], F.greatest(k + 4, k * 2)).when(f["code"] | f["long"], F.greatest(k + 3, k * 2)).when(f["answer"] | f["exercise"], k + 1).otherwise(k)
    return out, F.when(use_rerank, reranked).otherwise(F.least(plain, F.lit(20)))


def route_k(k: Column, route: Column, use_rerank: Column) -> Column:
    """Results that a route is asked for."""
    own = F.when(route == "keyword_bm25", F.floor(k * 1.2)).when(route == "expanded", F.greatest(F.lit(3), F.floor(k * 0.8))).when(route.endswith("_meta"), F.greatest(F.lit(3), F.least(F.floor(k * 0.6), F.lit(10)))).otherwise(k)
    return F.least(own, F.when(use_rerank, 40).otherwise(20)).cast("long")


def needs_hyde(n_docs: Column, skip: Column) -> Column:
    """Whether a made-up answer should be searched for: fewer than two documents and the depth allows it."""
    return ~skip & (n_docs < 2)


def collections(queries: DataFrame, words: DataFrame) -> DataFrame:
    """query_id, collections (array) by the words that a query holds, all collections if none: ``words`` (collection, word, ascii).

    The words travel as one array in a single row; each query keeps those it
    holds. ASCII words must stand on their own.
    """
    listed = words.agg(F.array_sort(F.collect_list(F.struct("collection", "word"))).alias("w"), F.array_sort(F.collect_set("collection")).alias("every"))  # a fixed rule table
    text = F.lower("text")

    def held(x):
        plain = F.contains(text, F.lower(x["word"]))
        alone = F.rlike(text, F.concat(F.lit("(?<![a-z0-9_])"), F.regexp_replace(F.lower(x["word"]), "([.+/])", "\\\\$1"), F.lit("(?![a-z0-9_])")))
        return F.when(x["word"].rlike("^[A-Za-z0-9_./+-]+$"), alone).otherwise(plain)

    found = F.array_sort(F.array_distinct(F.transform(F.filter("w", held), lambda x: x["collection"])))
    return queries.crossJoin(F.broadcast(listed)).select("query_id", F.when(F.size(found) > 0, found).otherwise(F.col("every")).alias("collections"))
