"""Batch retrieval as one plan: routes over queries, search, fusion, thresholds, windows, evidence, checks and retries.

Model outputs are inputs: embeddings of queries and chunks, and an optional
rerank score for (query, chunk) pairs. Without one, the fused score decides.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import settled, stored
from . import fusion, routing, search, verify


@dataclass(frozen=True)
class Options:
    """Settings of a retrieval; the evaluation switches routes, reranking and windows through them."""

    k: int = 5
    coarse_k: int = 25
    threshold: float = 0.05
    per_section: int = 3
    window: int = 1
    budget: int = 6000
    routes: tuple[str, ...] = ("semantic", "keyword_bm25", "section_meta")
    use_rerank: bool = True
    max_tokens: int = 4000


def metadata_routes(flags: dict[str, Column], text: Column, focus: Column) -> Column:
    """Array of (route, text, column, value) by the flags of a query; equal text and filter once, the first route stays."""
    row = lambda name, value, column, want: F.struct(F.lit(name).alias("route"), value.alias("text"), F.lit(column).alias("column"), F.lit(want).alias("value"))
    f = flags
    plain = ~f["exercise"] & ~f["answer"] & ~f["concept"] & ~f["comparison"]
    fine = (f["structured"] | f["concept"]) & ~f["short"] & ~f["comparison"]
    rules = [
        (f["code"], row("code_meta", focus, "content_type", "code_mixed")),
        (f["exercise"], row("exercise_meta", text, "content_type", "exercise")),
        (f["answer"], row("answer_meta", text, "content_type", "answer")),
        (f["concept"] | f["comparison"], row("concept_meta", focus, "content_type", "section")),
        (f["comparison"], row("comparison_meta", focus, "content_type", "table")),
        (f["structured"], row("structured_meta", focus, "is_structured", "true")),
        (plain, row("section_meta", focus, "content_type", "section")),
        (fine, row("formula_meta", focus, "content_type", "formula")),
        (fine, row("table_meta", focus, "content_type", "table")),
        (f["exercise"] | f["answer"] | f["comparison"], row("merged_qa_meta", text, "content_type", "merged_qa")),
    ]
    listed = F.array_compact(F.array(*(F.when(c, r) for c, r in rules)))
    key = F.transform(listed, lambda r: F.concat_ws("\u0001", F.lower(r["text"]), r["column"], r["value"]))
    return F.filter(F.transform(listed, lambda r, i: F.when((F.array_position(key, F.get(key, i)) == i + 1) & (r["text"] != ""), r)), lambda r: r.isNotNull())


def specificity(terms: DataFrame, words: DataFrame) -> DataFrame:
    """Terms (query_id, pos, term) with 1 / number of collections that have a word with the term; 0.5 if none."""
    vocabulary = words.groupBy("collection").agg(F.collect_set(F.lower("word")).alias("w"))  # a fixed rule table
    table = vocabulary.agg(F.collect_list("w").alias("t"))
    n = F.size(F.filter("t", lambda w: F.exists(w, lambda x: F.contains(x, F.lower(F.col("term"))))))
    return terms.crossJoin(F.broadcast(table)).select("query_id", "pos", "term", F.when(n > 0, 1.0 / n).otherwise(0.5).alias("specificity"))


def route_hits(queries: DataFrame, chunks: DataFrame, options: Options) -> DataFrame:
    """Ranked hits of every route: query_id, route, key, rank, score.

    ``queries`` (query_id, terms, embedding), ``chunks`` (chunk_id, text,
    embedding, section, content_type). Queries and chunks without an embedding
    take part in the lexical routes only.
    """
    parts = []
    k = options.coarse_k
    if "semantic" in options.routes:
        hits = search.vector_top_k(chunks.filter("embedding is not null").select(F.col("chunk_id").alias("vec_id"), "embedding"), queries.select("query_id", "embedding"), k)
        parts.append(hits.select("query_id", F.lit("semantic").alias("route"), F.col("vec_id").alias("key"), "rank", F.col("similarity").alias("score")))
    docs = chunks.select(F.col("chunk_id").alias("doc_id"), "text")
    for route in ("keyword_bm25", "section_meta"):
        if route in options.routes:
            of = docs if route == "keyword_bm25" else chunks.filter("content_type = 'section'").select(F.col("chunk_id").alias("doc_id"), "text")
            hits = search.bm25(of, queries.select("query_id", "terms"), k)
            parts.append(hits.select("query_id", F.lit(route).alias("route"), F.col("doc_id").alias("key"), "rank", "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def retrieve(queries: DataFrame, chunks: DataFrame, options: Options = Options(), rerank: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, section, score, rank of the documents found: fused, few of a section, over the threshold, reranked."""
    return _found(route_hits(queries, chunks, options), chunks, options, rerank)


def _found(hits: DataFrame, chunks: DataFrame, options: Options, rerank: DataFrame | None = None, watch=lambda stage, rows: rows) -> DataFrame:
    """The documents of ``hits``; ``watch`` sees the rows of each stage, with their scores."""
    hits = watch("1-routes", hits)
    fused = watch("2-fused", fusion.rrf(hits.withColumn("weight", fusion.route_weight(F.col("route")))).select("query_id", "key", "score"))
    placed = fused.join(chunks.select(F.col("chunk_id").alias("key"), "section"), "key")
    few = watch("3-sections", fusion.section_top_n(placed, options.per_section))
    kept = watch("4-threshold", few.filter(F.col("score") >= options.threshold / 10 if len(options.routes) == 1 else F.col("score") >= options.threshold))
    if rerank is not None and options.use_rerank:
        scored = kept.join(rerank.select("query_id", F.col("chunk_id").alias("key"), "rerank_score"), ["query_id", "key"], "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))
        ranked = search.top_k(scored, ["query_id"], [F.desc("rerank_score"), F.desc("score"), F.asc("key")], options.k)
        kept = search.rerank_threshold(ranked).drop("rank")
        order = [F.desc("rerank_score"), F.desc("score"), F.asc("key")]
    else:
        order = [F.desc("score"), F.asc("key")]
    return watch("5-found", search.top_k(kept, ["query_id"], order, options.k).withColumnRenamed("key", "chunk_id"))


def composed_routes(questions: DataFrame) -> DataFrame:
    """The routes of each question: query_id, label, route, text, only, depth, skip_hyde, k, and its flags as columns f_*.

    ``questions`` (query_id, text). A comparison is decomposed; its parts are
    labels of their own and take the keyword route. The original takes
    keywords, focus and as many metadata routes as its depth allows.
    """
    terms = search.query_terms(F.col("text"))
    flags = routing.query_flags(F.col("text"), F.col("terms"))
    rows = questions.select("query_id", "text", terms.alias("terms")).withColumns({f"f_{n}": F.coalesce(c, F.lit(False)) for n, c in flags.items()})
    f = {n: F.col(f"f_{n}") for n in flags}
    rows = rows.withColumn("depth", routing.depth(f)).withColumn("_s", routing.strategy(F.col("depth")))
    route = lambda name, value, only: F.struct(F.lit("original").alias("label"), F.lit(name).alias("route"), value.alias("text"), only.alias("only"))
    none, words = F.lit(None).cast("string"), F.array_join("terms", " ")
    focus = F.array_join(F.slice("terms", 1, 2), " ")
    meta = F.slice(F.filter(metadata_routes(f, words, focus), lambda r: r["column"] == "content_type"), F.lit(1), F.col("_s.max_metadata_routes"))
    meta = F.transform(meta, lambda r: F.struct(F.lit("original").alias("label"), r["route"].alias("route"), r["text"].alias("text"), r["value"].alias("only")))
    parts = F.slice(routing.decompose(F.col("text"), f["comparison"]), 2, 3)
    parts = F.transform(parts, lambda x, i: F.struct(F.concat(F.lit("part"), i + 1).alias("label"), F.lit("keyword_bm25").alias("route"), x.alias("text"), none.alias("only")))
    every = F.concat(F.array(route("keyword_bm25", words, none)), F.when(F.size("terms") >= 2, F.array(route("focus", focus, none))).otherwise(F.array().cast("array<struct<label:string,route:string,text:string,only:string>>")), meta, parts)
    kept = ["query_id", "depth", F.col("_s.k").alias("k"), F.col("_s.skip_hyde").alias("skip_hyde"), *(f"f_{n}" for n in flags)]
    return rows.select(*kept, F.explode(every).alias("r")).select("*", "r.*").drop("r").filter("text <> ''")


def retrieve_composed(questions: DataFrame, chunks: DataFrame, options: Options = Options()) -> DataFrame:
    """Retrieval by the kind of each question: query_id, chunk_id, score, rank, depth, needs_hyde.

    ``questions`` (query_id, text, embedding or null), ``chunks`` as in
    ``route_hits``. All lexical routes of all questions and parts are one
    search; they are fused with the weights of the question's flags, and the
    depth decides how many documents stay. ``needs_hyde`` marks questions that
    found fewer than two and may ask for a made-up answer to search with.
    """
    routes = settled(composed_routes(questions))
    place = F.concat_ws("|", F.col("query_id").cast("string"), "label", "route")
    asked = routes.select(place.alias("query_id"), search.query_terms(F.col("text")).alias("terms"), "only")
    docs = chunks.select(F.col("chunk_id").alias("doc_id"), "text")
    hits = search.bm25(docs, asked, options.coarse_k, kinds=chunks.select(F.col("chunk_id").alias("doc_id"), F.col("content_type").alias("kind")))
    hits = routes.withColumn("_place", place).join(hits.withColumnRenamed("query_id", "_place"), "_place").select(*routes.columns, F.col("doc_id").alias("key"), "rank")
    flags = {c[2:]: F.col(c) for c in routes.columns if c.startswith("f_")}
    near = search.vector_top_k(chunks.filter("embedding is not null").select(F.col("chunk_id").alias("vec_id"), "embedding"), questions.select("query_id", "embedding"), options.coarse_k)
    own = routes.drop("label", "route", "text", "only").distinct()
    near = own.join(near.select("query_id", F.col("vec_id").alias("key"), "rank"), "query_id").withColumns({"label": F.lit("original"), "route": F.lit("semantic")})
    columns = ["query_id", "label", "route", "key", "rank", *(f"f_{n}" for n in flags)]
    weighted = hits.select(*columns).unionByName(near.select(*columns)).withColumn("route_weight", fusion.route_weight(F.col("route"), flags))
    fused = fusion.weighted_rrf(weighted)
    placed = fused.join(chunks.select(F.col("chunk_id").alias("key"), "section"), "key")
    kept = fusion.section_top_n(placed, options.per_section).filter(F.col("score") >= options.threshold)
    depths = own.select("query_id", "depth", "k", "skip_hyde")
    ranked = search.top_k(kept, ["query_id"], [F.desc("score"), F.asc("key")], max(v[0] for v in routing.DEPTHS.values())).join(depths, "query_id").filter("rank <= k")
    n = ranked.groupBy("query_id").agg(F.count("*").alias("_n"))
    out = ranked.join(n, "query_id").withColumn("needs_hyde", routing.needs_hyde(F.col("_n"), F.col("skip_hyde")))
    return out.select("query_id", F.col("key").alias("chunk_id"), "score", "rank", "depth", "needs_hyde")


def expand(found: DataFrame, chunks: DataFrame, options: Options = Options()) -> DataFrame:
    """The documents found and their neighbours in the section: query_id, chunk_id, section, expanded."""
    places = chunks.select("chunk_id", "section", "chunk_index", "tokens")
    hits = found.join(places.select("chunk_id", "chunk_index"), "chunk_id")
    near = fusion.window_expand(hits.select("query_id", "section", "chunk_index", "rank"), places.select("section", "chunk_index", "tokens"), options.window, options.budget)
    named = near.join(places.select("section", "chunk_index", "chunk_id"), ["section", "chunk_index"]).select("query_id", "chunk_id", "section")
    extra = named.join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("expanded", F.lit(True))
    return found.select("query_id", "chunk_id", "section").withColumn("expanded", F.lit(False)).unionByName(extra)


def evidence(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """The context of each query: query_id, context, used, n, sources.

    ``rows`` (query_id, evidence_id, key, source, text, tokens and the columns
    of ``fusion.evidence_score``) are ranked, cut to the token budget, and laid
    out with the best at both ends.
    """
    ranked = fusion.fusion_rank(rows)
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("source", F.lit("unknown")), F.lit("\n"), "text")
    kept = fusion.token_budget(ranked.withColumn("line", line), max(1000, options.max_tokens))
    cut = F.when(F.col("truncated"), F.concat(F.substring("line", F.lit(1), F.floor(F.length("line") * F.col("used") / F.greatest("tokens", F.lit(1))).cast("int")), F.lit("\n[...truncated]"))).otherwise(F.col("line"))
    n = F.count("*").over(Window.partitionBy("query_id"))
    placed = kept.withColumn("line", cut).withColumn("place", fusion.interleave(F.col("rank"), n))
    return placed.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n\n").alias("context"),
        F.sum("used").alias("used"), F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("sources"),
    )


def retrieve_with_retry(queries: DataFrame, chunks: DataFrame, options: Options = Options(), retries: int = 1) -> DataFrame:
    """Documents of each query with ``attempt``; queries whose evidence fails are tried again with more and lower hits.

    Only failed queries take part in a further pass, and each pass is run once.
    """
    left, out = queries, None
    for attempt in range(retries + 1):
        found = settled(retrieve(left, chunks, options)).withColumn("attempt", F.lit(attempt))
        rows = found.join(chunks.select("chunk_id", "text", F.col("section").alias("source")), "chunk_id")
        summary = verify.summarize(rows.select("query_id", "source", F.col("text").alias("content"), F.lit(0.0).alias("rerank_score"), F.col("score").alias("recall_score"), "score"))
        judged = verify.verify(summary.withColumns({"n_kg": F.lit(0), "kg_confidence": F.lit(0.0), "context_length": F.col("total_length")}), options.threshold)
        good = judged.filter("verdict = 'pass'").select("query_id")
        kept = found if attempt == retries else found.join(good, "query_id", "left_semi")
        out = kept if out is None else out.unionByName(kept)
        left = left.join(good, "query_id", "left_anti")
        options = replace(options, k=min(10, options.k + 3), threshold=options.threshold / 2)
    return out


def trace(queries: DataFrame, chunks: DataFrame, options: Options = Options()) -> DataFrame:
    """Number and scores of rows after each stage: query_id, stage, n, max, avg, min."""
    from .evaluate import score_stats

    hits = settled(route_hits(queries, chunks, options))
    fused = fusion.rrf(hits.withColumn("weight", fusion.route_weight(F.col("route"))))
    found = _found(hits, chunks, options)
    stages = hits.select("query_id", F.lit("1-routes").alias("stage"), "score").unionByName(fused.select("query_id", F.lit("2-fused").alias("stage"), "score")).unionByName(found.select("query_id", F.lit("3-found").alias("stage"), "score"))
    return score_stats(stages)


METRICS = "stage string, route string, n long, top double, avg double, low double"


def traced(queries: DataFrame, chunks: DataFrame, options: Options = Options(), rerank: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the documents found, what each stage let through) of one run: stage, route, n, top, avg, low.

    Every stage of the one plan is observed while it runs, so nothing is
    computed a second time: rows and scores (six digits) of each stage, and of
    each route in the first. A stage without rows has n 0 and no scores.
    """
    from pyspark.sql import Observation

    seen: dict[str, Observation] = {}

    def watch(stage: str, rows: DataFrame) -> DataFrame:
        seen[stage] = Observation(f"{stage}-{uuid.uuid4().hex[:8]}")
        metrics = [F.count(F.lit(1)).alias("n"), F.max("score").alias("top"), F.avg("score").alias("avg"), F.min("score").alias("low")]
        for i, route in enumerate(options.routes if stage == "1-routes" else ()):
            own = F.when(F.col("route") == route, F.col("score"))
            metrics += [F.count(own).alias(f"n{i}"), F.max(own).alias(f"top{i}"), F.avg(own).alias(f"avg{i}"), F.min(own).alias(f"low{i}")]
        return rows.observe(seen[stage], *metrics)

    found = stored(_found(route_hits(queries, chunks, options), chunks, options, rerank, watch), "found")
    digits = lambda x: None if x is None else round(x, 6)
    rows = []
    for stage, observation in seen.items():
        got = observation.get
        for i, route in [("", None), *enumerate(options.routes if stage == "1-routes" else ())]:
            rows.append((stage, route, got[f"n{i}"], *(digits(got[f"{m}{i}"]) for m in ("top", "avg", "low"))))
    return found, queries.sparkSession.createDataFrame(rows, METRICS)  # a row for each stage and route


def cache_store(entries: DataFrame, new: DataFrame, capacity: int = 500) -> DataFrame:
    """Cache entries (key, stored_at, ...) with ``new`` ones: the latest of a key, and the latest ``capacity`` of all."""
    cols = [c for c in entries.columns if c != "key"]
    both = entries.unionByName(new).groupBy("key").agg(F.max_by(F.struct(*cols), "stored_at").alias("v")).select("key", "v.*")
    return both.orderBy(F.desc("stored_at"), "key").limit(capacity)


def cache_compact(entries: DataFrame, now: Column, ttl_seconds: int = 1800) -> DataFrame:
    return entries.filter(now - F.col("stored_at") <= ttl_seconds)


def cache_key(query: Column, collection: Column, filter_signature: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lower(F.trim(query)), collection, filter_signature), 256), 1, 24)


def agent_query(text: Column, agent: Column) -> Column:
    """What an agent searches for, from what the user wrote."""
    graded = F.substring(F.trim(F.regexp_replace(F.get(F.split(text, "学生答案|我的答案|我答的"), F.lit(0)), "题目[：:]", "")), 1, 200)
    subject = F.trim(F.regexp_replace(text, "应该怎么学|怎么学|怎么复习|学习路线|学习路径|学习建议|学习规划|如何学", ""))
    about = F.regexp_extract(text, "关于(.+?)(?:的选择题|的填空题|的简答题|的综合题|的题)", 1)
    involving = F.regexp_extract(text, "涉及(.+?)(?:的|题)", 1)
    bare = F.trim(F.regexp_replace(text, "出一道|出几道|给我出|来几道|综合题|选择题|填空题|简答题", ""))
    question = F.when(about != "", F.trim(about)).when(involving != "", F.trim(involving)).otherwise(bare)
    return F.when(agent == "grading_agent", graded).when(agent == "path_agent", F.when(subject != "", F.concat(subject, F.lit(" 学习路线 重点章节"))).otherwise(text)).when(agent == "question_agent", question).otherwise(text)


def format_docs(found: DataFrame, most: int = 5, cut: int = 800) -> DataFrame:
    """Text of each query's first documents with their source: ``found`` (query_id, rank, source, text)."""
    rows = found.filter(F.col("rank") <= most).withColumn("t", F.concat(F.lit("[来源: "), F.coalesce("source", F.lit("unknown")), F.lit("]\n"), F.substring("text", 1, cut)))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), "\n\n").alias("text"))


def topic_candidates(text: Column, terms: Column, stop: tuple[str, ...] = (), most: int = 8) -> Column:
    """Topics that a query may be about: compared parts, its terms and words, and a short query itself."""
    strip = lambda x: F.regexp_replace(x, "^[：:，,。？? ]+|[：:，,。？? ]+$", "")
    part = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), "^(?:请|帮我|解释|说明|比较|对比|分析|讲解|一下)+", ""), "(?:的)?(?:区别|差异|不同|异同|关系|联系|对比|比较)$", "")
    parts = F.split(text, "和|与|及|以及|、|，|,|\\s+vs\\s+|\\s+VS\\s+")
    compared = F.when(F.size(parts).between(2, 4), F.transform(parts, part)).otherwise(F.array().cast("array<string>"))
    comparing = text.rlike("区别|差异|不同|异同|关系|联系|对比|比较")
    words = F.filter(F.regexp_extract_all(text, F.lit("[\\u4e00-\\u9fffA-Za-z0-9_+./-]{2,}"), F.lit(0)), lambda w: ~((w == text) & comparing))
    whole = F.when((F.length(text) <= 24) & ~comparing, F.array(text)).otherwise(F.array().cast("array<string>"))
    listed = F.array_distinct(F.transform(F.concat(compared, terms, words, whole), strip))
    fits = lambda x: (F.length(x) >= 2) & ~x.isin("", *stop) & ~x.rlike("^[a-z][a-z0-9_./+-]*$") & (x.rlike("[\\u4e00-\\u9fff]") | (F.lower(x) != x))
    return F.slice(F.filter(listed, fits), 1, most)


def text_evidence(rows: DataFrame) -> DataFrame:
    """Evidence of chunks: id from the chunk's id or its source and beginning, and the first score that isn't 0."""
    seed = F.when(F.coalesce("chunk_id", F.lit("")) != "", F.col("chunk_id")).otherwise(F.concat_ws(":", F.coalesce("source", F.lit("unknown")), F.substring("text", 1, 120)))
    first = F.coalesce(F.when(F.col("rerank_score") != 0, F.col("rerank_score")), F.when(F.col("recall_score") != 0, F.col("recall_score")), F.lit(0.0))
    return rows.withColumns({"evidence_id": F.concat(F.lit("txt_"), F.substring(F.sha2(seed, 256), 1, 16)), "score": first})


def knowledge_points(value: Column) -> Column:
    """A list of names from a JSON list or a comma list; blanks are left out."""
    parsed = F.from_json(value, "array<string>")
    parts = F.split(F.translate(value, "，", ","), ",")
    return F.filter(F.transform(F.when(value.rlike("^\\s*\\[") & parsed.isNotNull(), parsed).otherwise(parts), lambda x: F.trim(x)), lambda x: x != "")
