"""TextRank against plain Python on all documents, and the enhancer's keywords and odd rows."""

import random
import re

from spindrift.operators import enhance
from spindrift.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(text, k=8, stop=()):
    listed = [w for w in (m.lower() for m in re.findall("[一-鿿]{2,4}|[a-zA-Z]{3,}", text or "")) if w not in stop]
    links = {w: {} for w in listed}
    for i, a in enumerate(listed):
        for b in listed[i + 1 : i + 5]:
            links[a][b] = links[a].get(b, 0) + 1
            links[b][a] = links[b].get(a, 0) + 1
    out = {w: sum(x.values()) for w, x in links.items()}
    rank = dict.fromkeys(links, 1.0)
    if len(listed) > 1:
        for _ in range(400):
            rank = {w: 0.15 + 0.85 * sum(n / out[o] * rank[o] for o, n in links[w].items()) for w in links}
    return sorted(((w, round(r, 6)) for w, r in rank.items()), key=lambda x: (-x[1], x[0]))[:k]


def close(got, expected):
    a, b = sorted(r for _, r in got), sorted(r for _, r in expected)
    return len(a) == len(b) and all(abs(x - y) <= 2e-6 for x, y in zip(a, b)) and len({w for w, _ in got} ^ {w for w, _ in expected}) <= 2


def test_ranks_equal_plain_python(spark):
    rng = random.Random(1)
    texts = ["", "one", "one one", "one two", "死锁 进程 死锁 banker Banker x yy", *(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "操作系统", "the"]) for _ in range(rng.randint(2, 80))) for _ in range(30))]
    for text in texts:
        assert close(enhance.ranked(text, frozenset(("the",)), 8), plain(text, stop=("the",)))


def test_ranks_of_all_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {}
    for r in sorted(catalogue.queries()["textrank_keywords"](spark, SF).collect(), key=lambda r: r["rank"]):
        found.setdefault(r["doc_id"], []).append((r["word"], r["weight"]))
    for i in sorted(docs, key=lambda i: len(docs[i] or ""))[:150]:
        assert close(found.get(i, []), plain(docs[i]))


def test_links_are_bounded_by_the_words_of_a_text():
    text = "alpha beta gamma " * 20_000
    assert [w for w, _ in enhance.ranked(text, frozenset(), 3)] == sorted(["alpha", "beta", "gamma"], key=lambda w: -dict(enhance.ranked(text, frozenset(), 3))[w])


def test_enhanced_chunks(spark):
    rows = [(1, "c1", "x/数据.md", None, "[OS > Dead Lock > os]", "deadlock banker deadlock resource banker\nline", 7), (2, "c2", None, None, None, None, 8), (3, "c3", "noext", "merged_qa", "", "问题 答案 one", 9)]
    out = {r["doc_id"]: r for r in enhance.enhance(spark.createDataFrame(rows, "doc_id int, chunk_id string, source string, role string, heading_path string, text string, line_count int"), 5).collect()}
    assert out[1]["keywords"].startswith("OS, Dead Lock, ") and "deadlock" in out[1]["keywords"] and out[1]["keywords"].lower().split(", ").count("os") == 1
    assert (out[1]["heading_slug"], out[1]["source_name"], out[1]["source_ext"], out[1]["line_count"]) == ("os/dead-lock/os", "数据", ".md", 2)
    assert (out[2]["keywords"], out[2]["content_type"], out[2]["line_count"], out[2]["has_heading"]) == ("", "empty", 0, False)
    assert out[3]["content_type"] == "merged_qa" and out[3]["is_structured"] and out[3]["source_ext"] == "" and "问题" in out[3]["keywords"]
