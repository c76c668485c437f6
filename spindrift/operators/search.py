"""Scoring and top-k: lexical BM25, exact vector search, rerank thresholds, semantic cache."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import settled, spread

K1, B = 1.5, 0.75
#: Characters of texts that are counted at a time.
CHARACTERS = 1 << 20


# Words that carry no content in a question.
STOP_WORDS = (
    "什么", "怎么", "如何", "为什么", "请问", "一下", "一下子", "有关", "关于", "这个", "那个",
    "哪些", "是否", "可以", "一下吧", "帮我", "讲解", "解释", "说明", "作用", "使用", "方法",
    "解释一下", "说明一下", "介绍一下", "讲一下", "讲讲", "简述", "阐述",
    "是", "的", "了", "在", "有", "和", "与", "及", "或", "等", "都", "也", "还", "又",
    "那", "这", "被", "把", "从", "到", "对", "向", "给", "让", "用", "以",
)
#: Of the words of one character, those that separate terms; others are also parts of words.
SEPARATORS = ("是", "的", "了", "与", "及", "或")
#: Runs of CJK characters up to this length are terms; the pairs of neighbours of longer ones are.
RUN = 4


def query_terms(text: Column, most: int = 6) -> Column:
    """The first distinct terms of a query (case-insensitive; the first spelling stays): Latin words and CJK runs.

    There is no segmenter: stop words of several characters and a few of one
    separate the runs, and a long run gives the pairs of its characters, which
    a substring search finds wherever the words stand.
    """
    breaks = "|".join(sorted((w for w in STOP_WORDS if len(w) > 1 or w in SEPARATORS), key=lambda w: (-len(w), w)))
    clean = F.regexp_replace(F.regexp_replace(F.trim(text), "\\s+", " "), breaks, " ")
    parts = F.regexp_extract_all(clean, F.lit("[A-Za-z_][A-Za-z0-9_.]+|[\\u4e00-\\u9fff]{2,}"), F.lit(0))
    pairs = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))
    found = F.flatten(F.transform(parts, lambda x: F.when(x.rlike("^[\\u4e00-\\u9fff]") & (F.length(x) > RUN), pairs(x)).otherwise(F.array(x))))
    lowered = F.transform(found, F.lower)
    first = F.filter(F.transform(found, lambda x, i: F.when(F.array_position(lowered, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())
    return F.slice(first, 1, most)


def bm25(docs: DataFrame, queries: DataFrame, k: int, df_cap: int | None = None, kinds: DataFrame | None = None) -> DataFrame:
    """Top ``k`` of ``docs`` (doc_id, text) for each of ``queries`` (query_id, terms): query_id, doc_id, score, rank.

    Documents match a term as a substring, lengths are in characters, and the
    terms of a query are summed (OR). Scores are divided by the query's best.
    Each document is scanned once for all terms of all queries and emits only
    those that it holds, and the same pass counts the corpus; there is no join
    of documents with terms. ``df_cap`` bounds a term's document frequency, as
    a store does that returns at most so many matches. With ``kinds`` (doc_id,
    kind) a query that names a kind in ``only`` gets documents of that kind;
    the statistics stay those of all documents.
    """
    used = queries.select("query_id", F.explode("terms").alias("term")).filter("term <> ''").distinct()
    counted = settled(_term_pass(docs, used))
    hits = counted.filter("term is not null")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    if df_cap:
        df = df.withColumn("df", F.least("df", F.lit(df_cap)))
    stats = counted.filter("term is null").agg(F.sum("rows").alias("n"), (F.sum("chars") / F.sum("texts")).alias("avgdl"))
    weighted = df.crossJoin(F.broadcast(stats)).withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.join(weighted, "term").select("term", "doc_id", part.alias("part"))
    total = used.join(scored, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("raw"))
    if kinds is not None:
        total = total.join(queries.select("query_id", "only"), "query_id").join(kinds, "doc_id").filter("only is null or only = kind").drop("only", "kind")
    ranked = top_k(total, ["query_id"], [F.desc("raw"), F.asc("doc_id")], k)
    best = F.max("raw").over(Window.partitionBy("query_id"))
    return ranked.select("query_id", "doc_id", F.round(F.when(best > 0, F.col("raw") / best).otherwise(F.col("raw")), 6).alias("score"), "rank")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, term, dl (characters), tf (occurrences without overlap) of the terms that each of ``docs`` holds."""
    return _term_pass(docs, terms).filter("term is not null").select("doc_id", "term", "dl", "tf")


def _term_pass(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of ``term_counts``, and for each batch a row without a term: its rows, texts and characters.

    Short terms are counted by array arithmetic over the characters of many
    texts, the others by one automaton, so the cost hardly grows with the
    number of queries, whose terms are sent to the tasks.
    """
    words = sorted(r[0] for r in terms.select("term").distinct().collect())  # bounded by the batch of queries
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import ahocorasick
        import numpy as np

        from .lexical import countable, count_grams

        short = [i for i, w in enumerate(words) if countable(w)]
        grams, number = [words[i] for i in short], np.array(short, np.int64)
        machine = ahocorasick.Automaton()
        for i in sorted(set(range(len(words))) - set(short)):
            machine.add_word(words[i], (i, len(words[i])))
        machine.make_automaton()

        def counted(texts: list[str]) -> list[np.ndarray]:
            row, which, times = count_grams(texts, grams)
            found = [np.stack([row, number[which], times])] if len(row) else []
            rest: list[tuple[int, int, int]] = []
            for r, text in enumerate(texts if len(machine) else ()):
                counts: dict[int, int] = {}
                after: dict[int, int] = {}
                for end, (i, size) in machine.iter(text):
                    if end - size + 1 >= after.get(i, 0):
                        counts[i] = counts.get(i, 0) + 1
                        after[i] = end + 1
                rest += [(r, i, n) for i, n in counts.items()]
            return found + ([np.array(rest).T] if rest else [])

        names = pa.array(words, pa.string())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lengths = np.array([len(t or "") for t in texts], np.int64)
            found = [np.zeros((3, 0), np.int64)]
            if words:
                cuts = np.searchsorted(np.cumsum(lengths), np.arange(0, lengths.sum() + CHARACTERS, CHARACTERS)).tolist()
                edges = sorted({0, *cuts, len(texts)})
                for a, b in zip(edges, edges[1:]):
                    found += [part + np.array([[a], [0], [0]]) for part in counted([t or "" for t in texts[a:b]])]
            row, which, times = np.concatenate(found, axis=1)
            none = [None] * len(row)
            columns = [batch.column(0).take(pa.array([*row.tolist(), None], pa.int64())), pa.concat_arrays([names.take(pa.array(which)), pa.nulls(1, pa.string())])]
            columns += [pa.array([*v.tolist(), None], pa.int32()) for v in (lengths[row], times)]
            columns += [pa.array([*none, n], pa.int64()) for n in (batch.num_rows, sum(t is not None for t in texts), int(lengths.sum()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "term", "dl", "tf", "rows", "texts", "chars"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, term string, dl int, tf int, rows long, texts long, chars long")


def top_k(rows: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group, with ``rank`` from 1; a partial limit runs before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Queries of a vector search that are sent to the tasks at one time.
QUERY_BLOCK = 16_384


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, same: str | None = None, live: tuple[str, str, int] | None = None) -> DataFrame:
    """Nearest ``vectors`` (vec_id, embedding) of ``queries`` (query_id, embedding) by cosine: query_id, vec_id, similarity, rank.

    Null and zero vectors have no similarity and never match. ``same`` names a
    column on both sides that must be equal; ``live`` a time of vectors, one of
    queries, and how long after the first the second may be. The queries are a stated batch
    that meets all vectors, in blocks of at most QUERY_BLOCK; a task scores its
    vectors by matrix products and returns the ``k`` best of each query.
    """
    stored, asked, ttl = live or (None, None, 0)
    fields = ["query_id", *([same] if same else []), *([asked] if live else []), "embedding"]
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    wanted = vectors.select("vec_id", *([same] if same else []), *([stored] if live else []), F.col("embedding").cast("array<double>").alias("embedding"))
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()
    parts = None
    for block in range(blocks):
        some = queries.select(*fields).filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()  # about QUERY_BLOCK rows
        part = wanted.mapInArrow(_nearest(some, k, same, live), f"query_id {kinds[0]}, vec_id {kinds[1]}, similarity double")
        parts = part if parts is None else parts.unionByName(part)
    return top_k(parts, ["query_id"], [F.desc("similarity"), F.asc("vec_id")], k)


def _nearest(queries: list, k: int, same: str | None, live: tuple[str, str, int] | None = None):
    """The ``k`` best vectors of a task for each query."""
    import numpy as np

    def unit(rows):
        """The rows by vector length: positions and unit vectors of those that have a direction."""
        flat = rows.flatten()
        start = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.fill_null(rows.value_lengths(), 0)))])
        values, empty = np.asarray(flat.fill_null(0.0)), np.cumsum(np.concatenate([[0], np.asarray(flat.is_null())]))
        sizes = np.diff(start)
        for size in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero((sizes == size) & (empty[start[1:]] == empty[start[:-1]]))
            v = values[start[at][:, None] + np.arange(size)]
            norm = np.sqrt((v * v).sum(axis=1))
            yield size, at[norm > 0], v[norm > 0] / norm[norm > 0, None]

    times = np.array([queries[i][live[1]] for i in range(len(queries))], float) if live else None  # a null time is never live
    asked = [(size, at, v, np.array([queries[i][same] for i in at]) if same else None) for size, at, v in unit(pa.array([q["embedding"] for q in queries], pa.list_(pa.float64())))]

    def run(batches):
        best: dict[int, list] = {}
        for batch in batches:
            ids, group = batch.column("vec_id").to_pylist(), np.array(batch.column(same).to_pylist()) if same else None
            since = np.array(batch.column(live[0]).to_pylist(), float) if live else None
            for size, rows, v in unit(batch.column("embedding")):
                for other, at, q, own in asked:
                    if other != size or not len(rows):
                        continue
                    for a in range(0, len(at), 512):
                        score = np.round(q[a : a + 512] @ v.T, 6)
                        if same:
                            score[own[a : a + 512, None] != group[None, rows]] = -np.inf
                        if live:
                            age = times[at[a : a + 512], None] - since[None, rows]
                            score[~((age >= 0) & (age <= live[2]))] = -np.inf
                        least = np.partition(score, max(0, len(rows) - k), axis=1)[:, max(0, len(rows) - k)]
                        for i, j in zip(*np.nonzero((score >= least[:, None]) & (score > -np.inf))):
                            best.setdefault(int(at[a + i]), []).append((-score[i, j], ids[rows[j]]))
            for i, found in best.items():
                if len(found) > k:
                    found.sort()
                    del found[k:]
        rows = [(queries[i]["query_id"], vec, -score + 0.0) for i, found in best.items() for score, vec in sorted(found)[:k]]
        if rows:
            names = ["query_id", "vec_id", "similarity"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    return run


def semantic_cache_lookup(entries: DataFrame, probes: DataFrame, threshold: float = 0.88, ttl_seconds: int = 1800) -> DataFrame:
    """The nearest live cache entry of each probe, if similar enough: query_id, vec_id, similarity, hit.

    ``entries`` (vec_id, embedding, collection, stored_at) and ``probes``
    (query_id, embedding, collection, asked_at) must agree in collection; an
    entry is live for ``ttl_seconds``. Probes meet all entries by matrix products,
    wherever these lie, so a frequent collection isn't gathered.
    """
    best = vector_top_k(entries, probes, 1, "collection", ("stored_at", "asked_at", ttl_seconds))
    return best.select("query_id", "vec_id", "similarity", (F.col("similarity") >= threshold).alias("hit"))


def rerank_threshold(ranked: DataFrame, min_keep: int = 2, relative: float = 0.3, absolute: float = 0.15) -> DataFrame:
    """Rows of ``ranked`` (query_id, rank, rerank_score) that pass both thresholds; the first ``min_keep`` if fewer do.

    A row passes with at least ``relative`` of its query's top score and at least ``absolute``.
    """
    w = Window.partitionBy("query_id")
    top = F.max_by(F.coalesce("rerank_score", F.lit(0.0)), -F.col("rank")).over(w)
    least = F.greatest(F.when(top > 0, top * relative).otherwise(0.0), F.lit(absolute))
    marked = ranked.withColumn("_ok", F.coalesce("rerank_score", F.lit(0.0)) >= least)
    enough = F.count_if(F.col("_ok")).over(w) >= min_keep
    return marked.filter(F.col("_ok")).drop("_ok") if min_keep <= 0 else marked.withColumn("_enough", enough).filter((F.col("_enough") & F.col("_ok")) | (~F.col("_enough") & (F.col("rank") <= min_keep))).drop("_ok", "_enough")
