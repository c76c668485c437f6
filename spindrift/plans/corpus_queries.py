"""Queries of corpus preparation, over documents, pages and small literal texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus
from ..sources.files import spread
from .registry import example, inline, query, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(r"""
WITH a AS (SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?im)^\s*(?:第\s*\d+\s*页|page\s*\d+|-?\s*\d+\s*-?)\s*$', '', 'g'), '\n{3,}', E'\n\n', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([^\s])[ \t]{3,}([^\s])', '\1 \2', 'g'), '(?m)[ \t]+$', '', 'g') AS t FROM b)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '')) AS digest, CAST(length(regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '')) AS BIGINT) AS n FROM c
""")
def clean_basic(spark, sf_dir):
    cleaned = corpus.clean_text(F.col("text"), unicode_form=False)
    return spread(_docs(spark, sf_dir)).select("doc_id", cleaned.alias("t")).select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query()
def clean_unicode(spark, sf_dir):
    cleaned = corpus.clean_text(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(cleaned).alias("digest"))


@query()
def web_noise_removed(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(corpus.web_noise(F.col("html"))).alias("kept"), F.length("html").alias("n"))


DATES = "(1, '2024年1月1日 和 2023年12月'), (2, '2024/1/1 12点5分'), (3, '2024.11.30 8时30分'), (4, 'none')"


@example("SELECT * FROM (VALUES (1, '2024-01-01 和 2023-12'), (2, '2024-01-01 12:05'), (3, '2024-11-30 08:30'), (4, 'none')) t(id, text)")
def date_normalize(spark, sf_dir):
    return inline(spark, DATES, "id, text").select("id", corpus.normalize_times(corpus.normalize_dates(F.col("text"))).alias("text"))


@example("SELECT * FROM (VALUES (1, '[1]first [2]second'), (2, '[3] third'), (3, E'[1] one\\n[12] twelve\\n1.5 stays'), (4, 'abcABC019')) t(id, text)")
def list_markers(spark, sf_dir):
    rows = inline(spark, "(1, '①first ②second'), (2, '3) third'), (3, '1. one\\n12. twelve\\n1.5 stays'), (4, 'ａｂｃＡＢＣ０１９')", "id, text")
    return rows.select("id", corpus.halfwidth(corpus.list_markers(F.col("text"))).alias("text"))


@example("SELECT 1 AS id, E'stem\\n#### 12 \\nnext' AS text")
def exam_headings(spark, sf_dir):
    return inline(spark, "(1, 'stem#### 12 next')", "id, text").select("id", corpus.exam_headings(F.col("text")).alias("text"))


@query(r"""
WITH l AS (SELECT source, list_filter(list_transform(string_split(text, E'\n'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
e AS (SELECT source, list_distinct(l[1:2] || CASE WHEN len(l) > 2 THEN l[greatest(3, len(l) - 1):len(l)] ELSE CAST([] AS VARCHAR[]) END) AS e FROM l),
u AS (SELECT source, unnest(list_filter(e, lambda x: length(x) <= 40)) AS line FROM e)
SELECT source, line, count(*) AS n FROM u GROUP BY ALL HAVING count(*) >= 2
""")
def pdf_edges(spark, sf_dir):
    return corpus.edge_lines(_docs(spark, sf_dir))


@query(r"""
SELECT doc_id, CASE WHEN length(trim(text)) < 10 THEN 'empty' WHEN regexp_matches(trim(text), '(此处|这里|见|参见|详见).{0,6}(图片|图|图示|插图|附件|附表|表格|视频)') THEN 'placeholder'
  WHEN len(regexp_extract_all(trim(text), '(?m)^\s*(?:```+|~~~+)')) % 2 <> 0 THEN 'truncated'
  WHEN len(regexp_extract_all(text, '[(（]')) > len(regexp_extract_all(text, '[)）]')) THEN 'truncated'
  WHEN len(regexp_extract_all(text, '[\[{【]')) > len(regexp_extract_all(text, '[\]}】]')) THEN 'truncated' ELSE 'normal' END AS status FROM documents
""")
def content_status(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", corpus.content_status(F.col("text")).alias("status"))


HEADS = "(1, '# 标题 one\\ntext', '', 'os/a.md'), (2, '第一章 绪论\\n正文', '', 'docs/b.md'), (3, 'no head here', '', 'net/c.txt'), (4, 'x', 'given', ''), (5, 'short line\\nmore', '', '')"


@example("SELECT * FROM (VALUES (1, '标题 one', 'markdown', 'os'), (2, '第一章 绪论', 'chapter', NULL), (3, 'c', 'filename', 'net'), (4, 'given', 'existing', NULL), (5, 'short line', 'first_line', NULL)) t(id, heading, method, category)")
def heading_impute(spark, sf_dir):
    rows = inline(spark, HEADS, "id, text, given, path")
    heading, method = corpus.impute_heading(F.col("text"), F.col("given"), F.col("path"))
    return rows.select("id", heading.alias("heading"), method.alias("method"), corpus.impute_category(F.col("path")).alias("category"))


@query(r"""
SELECT doc_id, round(len(regexp_extract_all(text, '[^\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3000}-\x{303f}\x{ff00}-\x{ffef}\s\x20-\x7e]')) / CAST(greatest(length(trim(text)), 1) AS DOUBLE), 6) AS ratio,
  coalesce(length(text) >= 10 AND len(regexp_extract_all(text, '[^\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3000}-\x{303f}\x{ff00}-\x{ffef}\s\x20-\x7e]')) / CAST(greatest(length(trim(text)), 1) AS DOUBLE) > 0.6, false) AS garbage FROM documents
""")
def garbage_ratio(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(corpus.garbage_ratio(F.col("text")), 6).alias("ratio"), corpus.full_garbage(F.col("text")).alias("garbage"))


@example(r"""
WITH t(id, text) AS (VALUES (1, repeat('数据abcd', 12)), (2, repeat('word ', 20)), (3, '短 text')), c AS (SELECT id, text, len(regexp_extract_all(text, '[一-鿿㐀-䶿]')) AS z, len(regexp_extract_all(text, '[a-zA-Z]')) AS l FROM t)
SELECT id, CASE WHEN length(text) >= 50 AND z + l > 0 THEN round(2.0 * least(z, l) / (z + l)::DOUBLE, 3) ELSE 0 END AS degree FROM c
""")
def language_mix(spark, sf_dir):
    rows = spark.sql("SELECT * FROM VALUES (1, repeat('数据abcd', 12)), (2, repeat('word ', 20)), (3, '短 text') AS t(id, text)")
    return rows.select("id", corpus.language_mix(F.col("text")).alias("degree"))


@query("""
WITH l AS (SELECT doc_id, length(trim(text)) AS length FROM documents), s AS (SELECT list_sort(list(length)) AS v, count(*) AS n, avg(length) AS mean, stddev_pop(length) AS sd FROM l),
q AS (SELECT v[n // 4 + 1] AS q1, v[3 * n // 4 + 1] AS q3, n, mean, sd FROM s),
o AS (SELECT doc_id, length, CASE WHEN length < q1 - 1.5 * (q3 - q1) THEN 'too_short' WHEN length > q3 + 1.5 * (q3 - q1) THEN 'too_long' END AS outlier, round((length - mean) / sd, 2) AS zscore FROM l, q WHERE n >= 4 AND q3 > q1)
SELECT doc_id, CAST(length AS INTEGER) AS length, outlier, zscore, CASE WHEN outlier = 'too_short' AND zscore < -2 THEN 'merge' WHEN outlier = 'too_short' THEN 'inspect' WHEN zscore > 3 THEN 'split' ELSE 'tune_chunks' END AS action FROM o WHERE outlier IS NOT NULL
""")
def length_outliers(spark, sf_dir):
    return corpus.length_outliers(_docs(spark, sf_dir))


@example("SELECT * FROM (VALUES (1, 'a:5'), (2, '')) t(id, chars)")
def char_freq_anomaly(spark, sf_dir):
    rows = inline(spark, "(1, 'aaaaa bcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'), (2, 'bcdefghijklmnopqrstuvwxyz')", "id, text")
    return rows.select("id", F.array_join(F.transform(corpus.frequent_chars(F.col("text")), lambda x: F.concat_ws(":", x["char"], x["n"])), ",").alias("chars"))


@example("SELECT * FROM (VALUES (1, 'abc done'), (2, '的的好'), (3, 'nothing')) t(id, text)")
def repeats_collapsed(spark, sf_dir):
    return inline(spark, "(1, 'abcabcabcabc done'), (2, '的的的的的的好'), (3, 'nothing')", "id, text").select("id", corpus.collapse_repeats(F.col("text")).alias("text"))


@example("SELECT * FROM (VALUES (1, E'good text\\n\\n[乱码段落，已隔离，原文6字符]\\n\\nmore', '1'), (2, 'clean', '')) t(id, text, indexes)")
def garbled_paragraphs(spark, sf_dir):
    rows = inline(spark, "(1, 'good text\\n\\n░▒▓█▄▀\\n\\nmore'), (2, 'clean')", "id, text")
    return rows.select("id", corpus.isolate_garbled(F.col("text")).alias("text"), F.array_join(corpus.garbled_paragraphs(F.col("text")), ",").alias("indexes"))


@query("SELECT doc_id FROM documents d WHERE length(trim(text)) > 0 AND doc_id = (SELECT min(e.doc_id) FROM documents e WHERE md5(trim(e.text)) = md5(trim(d.text)))")
def exact_dedup(spark, sf_dir):
    return corpus.exact_dedup(_docs(spark, sf_dir)).filter("kept").select("doc_id")


@query("WITH f AS (SELECT md5(trim(text)) AS h, min(doc_id) AS m FROM documents WHERE length(trim(text)) > 0 GROUP BY 1) SELECT d.doc_id, f.m AS duplicate_of, d.doc_id = f.m AS kept FROM documents d JOIN f ON md5(trim(d.text)) = f.h WHERE length(trim(text)) > 0")
def dedup_lineage(spark, sf_dir):
    return corpus.exact_dedup(_docs(spark, sf_dir))


@query("WITH f AS (SELECT source, md5(trim(text)) AS h, min(doc_id) AS m FROM documents WHERE length(trim(text)) > 0 GROUP BY ALL) SELECT d.doc_id, f.m AS duplicate_of, d.doc_id = f.m AS kept FROM documents d JOIN f ON md5(trim(d.text)) = f.h AND d.source = f.source WHERE length(trim(text)) > 0")
def dedup_per_file(spark, sf_dir):
    return corpus.exact_dedup(_docs(spark, sf_dir), ["source"])


GRAMS_SQL = """
g AS (SELECT doc_id, CASE WHEN length(t) = 0 THEN CAST([] AS VARCHAR[]) WHEN length(t) < 3 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) END AS g
  FROM (SELECT doc_id, regexp_replace(trim(text), '\\s+', ' ', 'g') AS t FROM documents))"""


@query(f"""
WITH {GRAMS_SQL}, e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / CAST(a.n + b.n - count(*) AS DOUBLE) AS s FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n)
SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.9
""")
def near_dup_jaccard(spark, sf_dir):
    """All near copies among ``documents``, from a similarity of 0.9."""
    return corpus.near_pairs(_docs(spark, sf_dir), 0.9)


@query()
def minhash_candidates(spark, sf_dir):
    """128 permutations in 8 bands, for a similarity of 0.9."""
    return corpus.minhash_pairs(_docs(spark, sf_dir), 128, 8)


@query(f"WITH {GRAMS_SQL} SELECT doc_id, CAST(coalesce(len(g), -1) AS BIGINT) AS n FROM g")
def shingle_counts(spark, sf_dir):
    return corpus.gram_counts(_docs(spark, sf_dir))


KINDS = "(1, '```\\ncode\\n```', '', '', ''), (2, '|a|b|\\n|-|-|\\n|1|2|', '', '', ''), (3, '## head\\nx', '', '', ''), (4, '- item', '', '', ''), (5, 'plain', '习题', '', '.md'), (6, 'plain', '答案', '', '.md'), (7, 'import os', '', '', ''), (8, 'plain words', '', '', ''), (9, 'q', '', 'merged_qa', ''), (10, ' ', '', '', ''), (11, '$$x$$', '', '', '')"


@example("SELECT * FROM (VALUES (1, 'code_mixed'), (2, 'table'), (3, 'section'), (4, 'list'), (5, 'exercise'), (6, 'answer'), (7, 'code_mixed'), (8, 'text'), (9, 'merged_qa'), (10, 'empty'), (11, 'formula')) t(id, kind)")
def content_type(spark, sf_dir):
    return inline(spark, KINDS, "id, text, heading, role, ext").select("id", corpus.content_type(F.col("text"), F.col("heading"), F.col("role"), F.col("ext")).alias("kind"))


@query(r"""
SELECT doc_id, CAST(floor(length(text) * 0.25) AS BIGINT) AS budget_tokens,
  CAST(greatest(1, floor(len(regexp_extract_all(text, '[\x00-\x7f]')) / 4) + length(text) - len(regexp_extract_all(text, '[\x00-\x7f]'))) AS BIGINT) AS width_tokens FROM documents
""")
def token_estimates(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.estimate_tokens(F.col("text")).alias("budget_tokens"), T.estimate_tokens_by_width(F.col("text")).alias("width_tokens"))


@query("""
WITH w AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[a-zA-Z]{3,}'), lambda x: lower(x))) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM c) SELECT doc_id, word, n, rank FROM r WHERE rank <= 8
""")
def keywords_freq(spark, sf_dir):
    return corpus.keywords(_docs(spark, sf_dir))


PATHS = "(1, '[Data Structure > Linear List > Linked List]', 3), (2, '数据结构 > 线性表', 2), (3, '综合应用', 1), (4, '', 1), (5, '[a > b]', 3)"


@example("SELECT * FROM (VALUES (1, 'data-structure/linear-list/linked-list', 'Data Structure', 'Linear List', 'Linked List', 1.6::DOUBLE), (2, '数据结构/线性表', '数据结构', '', '线性表', 1.3::DOUBLE), (3, '综合应用', '', '', '综合应用', 1.6::DOUBLE), (4, '', '', '', '', 1.0::DOUBLE), (5, 'a/b', 'a', '', 'b', 1.6::DOUBLE)) t(id, slug, subject, chapter, topic, difficulty)")
def heading_slug(spark, sf_dir):
    subject, chapter, topic = corpus.heading_fields(F.col("path"))
    rows = inline(spark, PATHS, "id, path, level")
    return rows.select("id", corpus.heading_slug(F.col("path")).alias("slug"), subject.alias("subject"), chapter.alias("chapter"), topic.alias("topic"), corpus.difficulty(F.col("path"), F.col("level")).alias("difficulty"))


MARKDOWN = "(1, 'intro\\n# A\\na1\\n### C\\nc1\\n## B\\nb1\\n# D\\nd1'), (2, 'plain')"


@example("SELECT 1 AS doc_id, 4::BIGINT AS line, 1::BIGINT AS from_level, 3::BIGINT AS to_level, 'C' AS title")
def heading_jumps(spark, sf_dir):
    return corpus.heading_jumps(inline(spark, MARKDOWN, "doc_id, text"))


@example("SELECT * FROM (VALUES (1, 0::BIGINT, 0::BIGINT, '', '', 1::BIGINT), (1, 1, 1, 'A', '[A]', 2), (1, 2, 3, 'C', '[A > C]', 2), (1, 3, 2, 'B', '[A > B]', 2), (1, 4, 1, 'D', '[D]', 2), (2, 0, 0, '', '', 1)) t(doc_id, section, level, title, path, n_lines)")
def section_tree(spark, sf_dir):
    return corpus.section_tree(inline(spark, MARKDOWN, "doc_id, text"))


@example("SELECT * FROM (VALUES (1, '1,2', 1.6::DOUBLE), (2, '3', 1.0::DOUBLE)) t(chunk_id, kp_ids, difficulty)")
def chunk_tags(spark, sf_dir):
    chunks = inline(spark, "(1, '[链表 > 栈]', 'ds'), (2, '[进程]', 'os'), (3, '[链表]', 'os')", "chunk_id, heading_path, category")
    registry = inline(spark, "(1, '链表', 'ds', 1.3D), (2, '栈', 'ds', 1.6D), (3, '进程', 'os', 1.0D)", "kp_id, name, category, difficulty")
    tagged = corpus.tag_chunks(chunks, registry)
    return tagged.select("chunk_id", F.array_join("kp_ids", ",").alias("kp_ids"), "difficulty")


@example("SELECT * FROM (VALUES (1, 'a', 'x', 'one'), (2, 'b', 'x', 'two'), (3, 'a', 'y', 'three')) t(kp_id, name, category, chapter)")
def registry_upsert(spark, sf_dir):
    existing = inline(spark, "(1, 'a', 'x', 'one')", "kp_id, name, category, chapter")
    found = inline(spark, "('a', 'x', 'late', 1), ('b', 'x', 'two', 2), ('b', 'x', 'again', 3), ('a', 'y', 'three', 4)", "name, category, chapter, seq")
    return corpus.upsert_registry(existing, found)
