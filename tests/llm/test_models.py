import random

import numpy as np
from pyspark.sql import functions as F

from spindrift.llm import language_id, quality, url_rules
from spindrift.llm.common import Scratch

from ..oracle import by_sql
from .fixtures import documents, empty, words

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.op2_string_kernel(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    rows = got.collect()
    assert len(rows) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_is_the_remainder(spark):
    got = {(r["doc_id"], r["held_out"]) for r in language_id.op2_string_kernel(spark, SF).collect()}
    sql = by_sql("SELECT doc_id FROM documents", SF)[1]
    import zlib

    assert got == {(i, zlib.crc32(str(i).encode()) % 3 == 1) for (i,) in sql}


def brute_grams(text):
    clean = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    return {clean[i : i + n] for n in (1, 2, 3) for i in range(len(clean) - n + 1)}


KERNEL = ["the cat sat", "der hund lief", "the cat ran", "ein hund sass", "日本語の文章", "日本の言葉です", "x1y2"]


def brute_kernel(left, right):
    a, b = [brute_grams(t) for t in left], [brute_grams(t) for t in right]
    return np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in b] for x in a])


def test_kernel_is_the_cosine_of_whole_gram_sets(monkeypatch):
    labels = ["en", "de", "en", "de", "ja", "ja", "en"]
    for block in (8192, 7):
        monkeypatch.setattr(language_id, "BLOCK", block)
        model = language_id.fit(KERNEL, labels, landmarks=9)
        order = [k for kind in ("de", "en", "ja") for k, x in enumerate(labels) if x == kind]
        texts = [*KERNEL, "niemals gesehen", "кириллица", "完全に別の文字"]
        assert np.allclose(model.kernel(texts), brute_kernel(texts, [KERNEL[i] for i in order]))


def test_scores_are_those_of_kernel_ridge_regression():
    """With every text as a landmark the Nystrom map is exact, so the scores are K (K + ridge)^-1 Y."""
    labels = ["en", "de", "en", "de", "ja", "ja", "en"]
    model = language_id.fit(KERNEL, labels, landmarks=9)
    k = brute_kernel(KERNEL, KERNEL)
    targets = np.array([[float(x == kind) for kind in ("de", "en", "ja")] for x in labels])
    ridge = language_id.RIDGE * len(labels) / 3 * 0.1
    texts = ["the dog", "das haus", "文章"]
    assert np.allclose(model.scores(texts), brute_kernel(texts, KERNEL) @ np.linalg.solve(k + ridge * np.eye(len(labels)), targets), atol=1e-6)


def test_long_texts_are_read_whole(monkeypatch):
    model = language_id.fit(["the cat sat on the mat", "der hund lief schnell weg"], ["en", "de"], landmarks=2)
    assert model.scores(["1 " * language_id.PART + "der hund lief schnell weg"]).argmax() == 0
    text = "ein langer text ohne ende und zahl 123 donaudampfschifffahrt"
    whole = language_id.grams(text)
    for part in (1, 2, 5, 16):
        monkeypatch.setattr(language_id, "PART", part)
        assert (language_id.grams(text) == whole).all() and len(whole) == len(brute_grams(text))


def test_samples_take_an_id_once(spark):
    from spindrift.llm.samples import balanced

    rows = spark.createDataFrame([(7, "b", "en")] * 500 + [(7, "a", "en")] + [(i, f"t{i}", "de") for i in range(50)] + [(i, "x", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    drawn = balanced(rows, "lang", "doc_id", 10, 30, 100)
    assert len(drawn) <= 30 and [r["text"] for r in drawn if r["label"] == "en"] in ([], ["a"])
    assert [r["text"] for r in balanced(rows, "lang", "doc_id", 10, 1000, 100) if r["label"] == "en"] == ["a"]
    assert sum(r["label"] == "de" for r in balanced(rows, "lang", "doc_id", 10, 1000, 100)) == 10


def test_language_of_odd_texts(spark):
    model = language_id.fit(["the cat sat on the mat", "der hund lief schnell weg"], ["en", "de"], landmarks=2)
    docs = documents(spark).withColumn("lang_pred", F.lit("x"))
    rows = language_id.predict(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == letters and (letters or r["score"] == 0)
    assert language_id.predict(empty(spark), model).collect() == []
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.train(empty(spark), 3, 1) is None


def test_quality_held_out(spark):
    rows = quality.op8_random_indexing(spark, SF).filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_quality_is_calibrated():
    rng = random.Random(2)
    texts = [words(rng, 40) + (" ### $$$" * 10 if i % 4 == 0 else "") for i in range(400)]
    model = quality.fit(texts, [int(i % 4 != 0) for i in range(400)], {0: 0.25, 1: 0.75})
    scores = model.scores(texts)
    assert abs(scores.mean() - 0.75) < 0.1 and ((scores >= 0.3) == (np.arange(400) % 4 != 0)).mean() > 0.97


def test_random_indexing_against_brute_force():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("red green blue one two three RED ,".split()) for _ in range(30)) + "\n" + words(rng, 3) for _ in range(6)]
    vocabulary, vectors = quality._vectors(texts)
    ids = quality.Ids(vocabulary)
    names = [f"\0{i}" for i in range(quality.MARKS)] + sorted(vocabulary, key=vocabulary.get)
    index = np.zeros((len(names), quality.DIM))
    for i, name in enumerate(names):
        at, sign = quality.index_vector(name)
        index[i, at] = sign
    expected = np.zeros_like(index)
    for text in texts:
        found = quality._tokens(text, ids).tolist()
        for i, one in enumerate(found):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(found):
                    expected[one] += index[found[j]]
    expected /= np.maximum(np.linalg.norm(expected, axis=1, keepdims=True), 1e-9)
    assert np.allclose(vectors, expected + index / quality.NONZERO**0.5)
    model = quality.Model(vocabulary, vectors, np.zeros(quality.DIM), np.ones(quality.DIM), [], 1.0, 0.0)
    for text, row in zip(texts, model.features(texts)):
        assert np.allclose(row, np.mean([vectors[i] for i in quality._tokens(text, ids)], axis=0))


def test_network_and_calibration_against_brute_force():
    rng = np.random.default_rng(5)
    x, weight = rng.standard_normal((200, 6)), np.full(200, 1 / 200)
    y = (x[:, 0] + x[:, 1] ** 2 > 0.8).astype(float)
    layers = quality._train(x, y, weight)
    model = quality.Model({}, np.zeros((1, 6)), np.zeros(6), np.ones(6), layers, 1.0, 0.0)
    w1, b1, w2, b2 = layers
    z = model.logits(x)
    for row, logit in zip(x[:20], z):
        hidden = [np.tanh(sum(row[i] * w1[i, h] for i in range(6)) + b1[h]) for h in range(quality.HIDDEN)]
        assert abs(sum(v * w2[h, 0] for h, v in enumerate(hidden)) + b2[0] - logit) < 1e-9
    assert ((z > 0) == y).mean() > 0.95

    def loss(t, shift):
        q = 1 / (1 + np.exp(-(z + shift) / t))
        return -np.mean(y * np.log(q + 1e-300) + (1 - y) * np.log(1 - q + 1e-300))

    t, shift = quality._calibrate(z, y, weight)
    best = min(loss(a, b) for a in np.geomspace(0.3, 8, 40) for b in np.linspace(-2, 2, 21))
    assert abs(loss(t, shift) - best) < 1e-9


def test_quality_of_odd_texts(spark):
    rng = random.Random(2)
    model = quality.fit([words(rng, 30) for _ in range(40)] + ["$$$ " * 30] * 40, [1] * 40 + [0] * 40, {0: 0.5, 1: 0.5})
    docs = documents(spark)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]
    assert quality.score(empty(spark), model).collect() == []
    assert quality.fit([], [], {}).scores(["a"])[0] == 0.5 and quality.fit(["a"], [1], {1: 1.0}).scores(["", "b"]).tolist() == [1.0, 1.0]


def test_parts_cover_a_text(monkeypatch):
    monkeypatch.setattr(quality, "PART", 10)
    for text in ("", "abc", "a b c d e f g h i j k l", "x" * 35 + " tail", "one two three four five six"):
        assert "".join(quality.parts(text)) == text and all(quality.parts(text))


def judged(spark, pages, labels, rules=url_rules.RULES):
    p = spark.createDataFrame([(*r, "x") for r in pages], "page_id long, url string, host string")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {r["page_id"]: r for r in url_rules.judge(p, l, rules, Scratch(spark, "t")).collect()}


def brute_rule(host, path, rules):
    best = (None, None)
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return best


def brute_parts(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:] if rest[cut : cut + 1] == "/" else ""
    cut_path = min([path.find(c) for c in "?#" if c in path], default=len(path))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, path[:cut_path]


URLS = ["http://WWW.Example.ORG/en/1x?q=1#f", "https://example.org/es/9", "http://notexample.org/es/", "http://a.example.com/de/x", "http://a.example.com/fr/x", "x://É.com/de/", "noscheme/com/de/", None, "", "http://host", "http://host?x=/y", "http://h#/p", "a://b://c/de/", "http://org/", "http://com/de"]


def test_hosts_paths_and_rules_against_brute_force(spark):
    got = judged(spark, list(enumerate(URLS)), [])
    for i, url in enumerate(URLS):
        host, path = brute_parts(url)
        rule, verdict = brute_rule(host, path, url_rules.RULES)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or "allow"), url


def test_planted_combinations_are_mined(spark):
    rng = random.Random(4)
    pages, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        host = rng.choice(["ads", "shop"]) if not bad else "ads"
        url = f"http://{host}.site{i % 7}.net/{'track' if bad else rng.choice(['news', 'blog'])}/{i}"
        pages.append((i, url))
        labels.append((i, 1, int(bad)))
    pages += [(1000, "http://ads.new.net/track/7"), (1001, "http://ads.new.net/news/7"), (1002, "http://shop.new.net/blog/1"), (1003, None)]
    got = judged(spark, pages, labels, [])
    for i in range(400):
        assert got[i]["verdict"] == ("block" if i % 5 == 0 else "allow")
    assert [got[i]["verdict"] for i in (1000, 1001, 1002, 1003)] == ["block", "allow", "allow", "allow"]
    assert judged(spark, pages, labels, [("allow", "net/track/7")])[1000]["verdict"] == "allow"


def brute_mined(rows, support, confidence):
    """Rules of (tokens, bad) by all subsets of tokens; of those with the same rows only the largest."""
    from itertools import combinations

    best = {}
    for tokens in {t for t, _ in rows}:
        for n in range(1, len(tokens) + 1):
            for some in combinations(sorted(tokens), n):
                at = tuple(i for i, (t, _) in enumerate(rows) if set(some) <= t)
                if len(at) >= support * len(rows):
                    best[at] = max(best.get(at, ()), some, key=lambda x: (len(x), x))
    share = sum(b for _, b in rows) / len(rows)
    out = {}
    for at, some in best.items():
        bad = sum(rows[i][1] for i in at)
        if bad >= support * len(rows) and bad / len(at) >= confidence and bad / len(at) > share:
            out[some] = round(bad / len(at), 9)
    return out


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        host, words = rng.choice(["a.net", "b.net", "c.org"]), rng.sample(["x", "y", "z", "w"], rng.randint(0, 3))
        rows.append((f"http://{host}/{'/'.join(words)}", bool(("x" in words and host == "a.net") or rng.random() < 0.2)))
    rows += [("http://long.net/" + "/".join(f"s{chr(97 + k)}" for k in range(24)), True)] * 12 + [(None, True), ("plain", False), ("http://a.net/x", None)]
    urls = spark.createDataFrame(rows, "u string, bad boolean")
    scratch = Scratch(spark, "t")
    got = {tuple(r["tokens"]): r for r in url_rules.mine(urls, scratch, 0.05, 0.6).collect()}
    listed = [(r["t"], r["bad"]) for r in urls.select(url_rules.tokens(F.col("u")).alias("t"), "bad").collect()]
    sets = [(frozenset(t or ()), bool(b)) for t, b in listed if b is not None]
    short = [(frozenset(x for x in t if not x.startswith("p:s") and x != "h:long"), b) for t, b in sets]
    expected = brute_mined(short, 0.05, 0.6)
    long = tuple(sorted(next(t for t, _ in sets if "h:long" in t) - {"h:net"}))
    assert len(long) == 25 and got[long]["confidence"] == 1.0 and got[tuple(sorted((*long, "h:net")))]["n"] == 26
    mine = {t: round(r["confidence"], 9) for t, r in got.items() if "h:long" not in t}
    closed = {t: c for t, c in expected.items() if t}
    assert closed and {t: c for t, c in mine.items() if t in closed} == closed
    for t, c in mine.items():  # others have the rows of a larger one
        at = [b for s, b in short if set(t) <= s]
        assert round(sum(at) / len(at), 9) == c and len(at) >= 0.05 * len(short)


def test_very_long_urls_are_judged(spark):
    url = "http://a.net/" + "/".join(f"part{i}x" for i in range(4000)) + "?" + "&".join(f"k{i}=1" for i in range(2000))
    got = judged(spark, [(i, url) for i in range(40)] + [(100, "http://b.net/")], [(i, 0, 0) for i in range(40)] + [(100, 1, 0)], [])
    assert {got[i]["verdict"] for i in range(40)} == {"block"} and got[100]["verdict"] == "allow"


def test_rules_match_as_by_brute_force(spark):
    rules = spark.createDataFrame([(["h:a", "p:x"], 2, "p:x", 0.9, 0.1), (["h:b"], 1, "h:b", 0.8, 0.1), (["h:b", "p:x"], 2, "h:b", 0.8, 0.1)], "tokens array<string>, n int, anchor string, confidence double, support double")
    assert len(url_rules.prune(rules).collect()) == 2
    urls = spark.createDataFrame([("http://a/x",), ("http://a/y",), ("http://b/x",), ("http://c",)], "u string")
    assert {r["u"]: r["confidence"] for r in url_rules.match(urls, rules).collect()} == {"http://a/x": 0.9, "http://b/x": 0.8}


def test_url_edge_tables(spark):
    assert judged(spark, [], []) == {}
    got = judged(spark, [(1, "http://a/x"), (1, "http://a/x"), (None, "http://b/")], [(1, None, None)])
    assert got[1]["verdict"] == "allow"


def test_op6_stays_native(spark):
    plan = url_rules.op6_association_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_quality_does_not_depend_on_the_size_of_parts(monkeypatch):
    rng = random.Random(9)
    good = [words(rng, 60) + "\n" + words(rng, 30) for _ in range(60)]
    bad = ["\n".join([words(rng, 12)] * 6) for _ in range(60)]
    model = quality.fit(good + bad, [1] * 60 + [0] * 60, {0: 0.5, 1: 0.5})
    line, other = words(rng, 40), words(rng, 25)
    found = [
        "\n".join([line, other] * 30),
        (words(rng, 500) + "\n") * 2,
        "same same " * 300,
        "x" * 900 + " " + line + "\n" + "x" * 900,
        " ".join([line] * 10),
        "\n\n".join([line, "", line, other, "LOUD WORDS"] * 9) + "\n",
    ]
    whole, counts = model.scores(found), [np.sort(np.concatenate(list(quality._counted(t, quality.Ids(model.words))))) for t in found]
    for part in (1, 7, 64, 1000):
        monkeypatch.setattr(quality, "PART", part)
        assert np.allclose(model.scores(found), whole, atol=1e-9)
        for t, expected in zip(found, counts):
            assert (np.sort(np.concatenate(list(quality._counted(t, quality.Ids(model.words))))) == expected).all()


def test_thousands_of_languages(spark):
    rng = random.Random(4)
    rows = [(i, f"{words(rng, 4)} {chr(0x4E00 + i % 5000)}{chr(0x4E01 + i % 5000)}", f"l{i % 5000}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, 3, 1)
    assert len(model.labels) > 3000 and len(model.sizes) <= language_id.LANDMARKS
    assert language_id.predict(docs.limit(20), model).filter("lang_pred <> 'und'").count() == 20


def test_labels_at_random_give_no_rule(spark):
    rng = random.Random(6)
    urls = [f"http://{rng.choice('abcd')}.{rng.choice(['net', 'org'])}/{rng.choice('pqrstu')}/{rng.choice('vwxyz')}/{i}" for i in range(300)]
    planted = [(u, "/p/" in u and "a." in u or rng.random() < 0.1) for u in urls]
    scratch = Scratch(spark, "t")
    mined = url_rules.mine(spark.createDataFrame(planted, "u string, bad boolean"), scratch, 0.01, 0.75)
    assert [set(r["tokens"]) for r in url_rules.prune(scratch.table(url_rules.significant(mined), "m")).collect()] == [{"h:a", "p:p"}]
    labels = [b for _, b in planted]
    for _ in range(6):
        rng.shuffle(labels)
        mined = scratch.table(url_rules.mine(spark.createDataFrame(list(zip(urls, labels)), "u string, bad boolean"), scratch, 0.01, 0.75), "m")
        assert url_rules.significant(mined).isEmpty()
