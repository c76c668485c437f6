import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spindrift.llm import packing, token_store
from spindrift.llm.common import Scratch
from spindrift.llm.tokens import Encoder, default_path

from .fixtures import documents, empty, texts

PATH = default_path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH, cache_words=500)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def ids(packed):
    return np.frombuffer(packed, "<u2").tolist()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=[chr(c) for c in range(0x180)], max_size=60), st.text(alphabet="ab'stredmlv <|endofx>., \n", max_size=40)))
def test_encoder_equals_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(ENCODER.encode(text)) == library(text)


def test_encoder_on_whole_texts():
    for text in texts():
        assert ids(ENCODER.encode(text)) == library(text)


def test_other_tokenizers_go_through_the_library():
    path = default_path("byte_bpe_50k.json")
    other = Encoder(path)
    assert ids(other.encode("a  b\nc")) == Tokenizer.from_file(path).encode("a  b\nc", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(array("I", values).tobytes())


def test_store_gives_back_every_document(spark):
    docs = documents(spark)
    scratch = Scratch(spark, "t")
    store = token_store.write(docs, PATH, 2, scratch)
    expected = sorted((-1 if r["doc_id"] is None else r["doc_id"], [*library(r["text"]), 2]) for r in docs.collect())
    back = sorted((-1 if r["doc_id"] is None else r["doc_id"], ids(bytes(r["ids"]))) for r in token_store.read_back(spark, store).collect())
    assert back == expected
    rows = sorted(token_store.digests(spark, store, scratch).collect(), key=lambda r: r["start"])
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((i, len(v), crc(v)) for i, v in expected)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x or 0))


def test_equal_passages_are_stored_once(spark):
    rng = np.random.default_rng(5)
    body = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 4000))
    docs = documents(spark, [(i, f"start {i} " * i + body) for i in range(6)])
    store = token_store.write(docs, PATH, 2, Scratch(spark, "t"))
    chunks = token_store.read_chunks(spark, store).collect()
    stored, all_ids = sum(r["n"] for r in chunks), sum(r["n"] for r in token_store.read_recipes(spark, store).collect())
    assert len({bytes(r["key"]) for r in chunks}) == len(chunks)
    assert stored < 0.35 * all_ids


def test_damage_is_found(spark):
    store = token_store.write(documents(spark), PATH, 2, Scratch(spark, "t"))
    rows = token_store.read_chunks(spark, store).collect()
    bad = spark.createDataFrame([(bytes(r["key"]), r["n"], bytes(r["body"])[:-1] + b"\xff") for r in rows[:1]], "key binary, n long, body binary")
    with pytest.raises(Exception, match="doesn't match its key"):
        bad.mapInArrow(token_store._checked(False), "key binary, crc long, m long").collect()


def test_empty_tables(spark):
    scratch = Scratch(spark, "t")
    assert token_store.digests(spark, token_store.write(empty(spark), PATH, 2, scratch), scratch).collect() == []
    assert packing.pack(empty(spark), PATH, 1, 4096, scratch).collect() == []


def test_crc_of_parts():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**32, 17, np.uint32), rng.integers(0, 2**32, 1000, np.uint32)
    parts = token_store.crc_after(np.array([zlib.crc32(a.tobytes()), zlib.crc32(b.tobytes())]), np.array([1000, 0]))
    assert int(parts[0] ^ parts[1]) == zlib.crc32(np.concatenate([a, b]).tobytes())


def check_patterns(patterns, counts, capacity):
    used = np.zeros_like(counts)
    for n, items in patterns:
        assert n > 0 and sum(s * c for s, c in items) <= capacity
        for s, c in items:
            used[s] += n * c
    assert (used == counts).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60), st.integers(60, 100))
def test_solver_places_every_piece(sizes, capacity):
    counts = np.bincount(sizes, minlength=capacity + 1) if sizes else np.zeros(capacity + 1, int)
    found, first = packing.solve(counts, capacity, 300), packing.best_fit(counts, capacity)
    check_patterns(found, counts, capacity)
    check_patterns(first, counts, capacity)
    assert -(-sum(sizes) // capacity) <= sum(n for n, _ in found) <= sum(n for n, _ in first)


def fewest(sizes, capacity):
    """By brute force: the fewest sequences."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[i]:
                rest = list(rooms)
                rest.remove(room)
                place(i + 1, [*rest, room - sizes[i]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(5, 30), min_size=1, max_size=9))
def test_solver_is_optimal_on_small_inputs(sizes):
    sizes.sort(reverse=True)
    assert sum(n for n, _ in packing.solve(np.bincount(sizes, minlength=41), 40)) == fewest(sizes, 40)


def test_packing_of_documents(spark):
    docs = documents(spark)
    rows = packing.place(packing.cut(docs, PATH, 1, 64, keep_ids=True), 64, Scratch(spark, "t")).collect()
    expected = sorted((-1 if r["doc_id"] is None else r["doc_id"], [*library(r["text"]), 1]) for r in docs.collect())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(bytes(r["name"]), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(bytes(r["ids"])) == 4 * r["length"]
    got = []
    for some in by_doc.values():
        some.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in some] == [64 * i for i in range(len(some))] and all(r["length"] == 64 for r in some[:-1])
        got.append((-1 if some[0]["doc_id"] is None else some[0]["doc_id"], np.frombuffer(b"".join(bytes(r["ids"]) for r in some), "<u4").tolist()))
    assert sorted(got) == expected
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert len(by_sequence) <= 1.02 * sum(r["length"] for r in rows) / 64 + 1


def test_sequences_join_their_pieces(spark):
    placed = packing.place(packing.cut(documents(spark), PATH, 1, 64, keep_ids=True), 64, Scratch(spark, "t"))
    total = sum(len(bytes(r["ids"])) // 4 for r in packing.sequences(placed).collect())
    assert total == sum(r["length"] for r in placed.select("length").collect())


def planted(rng, bins, pieces, low, high, capacity):
    """Counts by size of pieces that fill ``bins`` sequences without waste."""
    sizes = []
    while len(sizes) < bins * pieces:
        some = rng.integers(low, high + 1, pieces - 1).tolist()
        if low <= capacity - sum(some) <= high:
            sizes += [*some, capacity - sum(some)]
    return np.bincount(sizes, minlength=capacity + 1)


@pytest.mark.parametrize(("bins", "pieces", "low", "high", "capacity"), [(8, 6, 140, 200, 1000), (10, 5, 20, 60, 200), (20, 6, 140, 200, 1000)])
def test_perfect_packings_are_found(bins, pieces, low, high, capacity):
    rng = np.random.default_rng(1)
    for _ in range(30):
        counts = planted(rng, bins, pieces, low, high, capacity)
        found = packing.solve(counts, capacity)
        check_patterns(found, counts, capacity)
        assert sum(n for n, _ in found) == bins


def brute_fillings(sizes, room):
    """By waste, all choices from ``sizes`` that fit, and whether no piece left out could stand for some of them."""
    out = {}
    for mask in range(1 << len(sizes)):
        inside = [s for i, s in enumerate(sizes) if mask >> i & 1]
        outside = [s for i, s in enumerate(sizes) if not mask >> i & 1]
        waste = room - sum(inside)
        if waste < 0:
            continue
        sums = {(sum(s for i, s in enumerate(inside) if m >> i & 1), m.bit_count()) for m in range(1, 1 << len(inside))}
        worse = any(x <= waste for x in outside) or any(total <= x <= total + waste and (n > 1 or total < x) for x in outside for total, n in sums)
        out.setdefault(waste, {})[tuple(sorted(inside))] = not worse
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(2, 25), min_size=1, max_size=8), st.integers(25, 40))
def test_fillings_are_all_that_are_undominated(sizes, capacity):
    left = np.bincount(sizes, minlength=capacity + 1)
    top = max(sizes)
    rest = sorted(sizes)[:-1]
    expected = brute_fillings(rest, capacity - top)
    got = {}
    for waste, need in packing.Fillings(left, capacity):
        if need:
            need[top] -= 1
            got.setdefault(waste, set()).add(tuple(sorted(s for s, n in need.items() for _ in range(n))))
    assert got == {w: kept for w, found in expected.items() if (kept := {x for x, good in found.items() if good})}
    assert list(got) == sorted(got)


def test_short_pieces_fill_sequences():
    rng = np.random.default_rng(1)
    sizes = rng.integers(300, 1024, 400)
    counts = np.bincount(sizes, minlength=4097)
    found = packing.solve(counts, 4096)
    check_patterns(found, counts, 4096)
    assert sum(n for n, _ in found) == -(-sizes.sum() // 4096) < sum(n for n, _ in packing.best_fit(counts, 4096))
