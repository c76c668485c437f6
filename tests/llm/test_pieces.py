import random

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
from spindrift.llm import pieces
from spindrift.llm.tokens import default_path

from .fixtures import documents, empty, texts

PATH = default_path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PIECES = pieces.Pieces(PATH, cache_words=200)
SOME = st.lists(st.sampled_from(["the", "ing", " ", "  ", "\n", "é", "日", "x", "😀", "1", "..", ",", "A", "tion", "▁", ")", "<0x0A>", "</s>"]), max_size=40).map("".join)


def check(text):
    packed = PIECES.encode(text)
    assert np.frombuffer(packed, "<u2").tolist() == LIBRARY.encode(text)
    assert PIECES.decode(packed) == text.replace("▁", " ")


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), SOME))
def test_ids_are_the_library_s(text):
    check(text)


def test_whole_texts():
    for text in texts():
        check(text or "")


@settings(max_examples=60, deadline=None)
@given(SOME, st.integers(1, 7))
def test_stream_in_parts(text, step):
    marked = "▁" + text.replace(" ", "▁")
    s = pieces.Stream(PIECES)
    out = b"".join([s.feed(marked[i : i + step]) for i in range(0, len(marked), step)] + [s.close()])
    assert np.frombuffer(out, "<u2").tolist() == (LIBRARY.encode(text) if text else out and np.frombuffer(out, "<u2").tolist())


def test_a_stretch_without_boundaries_is_committed_in_parts(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice(["internationalization", "日本語", "x", "ing", "é", ",", "😀", "the"]) for _ in range(2000))
    s, widest, early = pieces.Stream(PIECES), 0, b""
    for a in range(0, len(text) + 1, 100):
        early += s.feed(("▁" + text)[a : a + 100])
        widest = max(widest, len(s.text) + len(s.tail))
    assert widest <= 2 * (pieces.STEP + PIECES.longest) + 100
    assert np.frombuffer(early + s.close(), "<u2").tolist() == LIBRARY.encode(text)
    assert len(early) > 0.9 * 2 * len(LIBRARY.encode(text))
    monkeypatch.setattr(pieces, "PART", 700)
    check(text + "  " + text[:3000].replace("x", " ") + "\n")


def test_every_id_comes_from_the_stream(monkeypatch):
    searched = []
    search = pieces.Stream._search
    monkeypatch.setattr(pieces.Stream, "_search", lambda self, text: searched.append(text) or search(self, text))
    fresh = pieces.Pieces(PATH)
    for text in ["Two words, twice: two words.", "x" * 3000 + " y", "a  b"]:
        assert np.frombuffer(fresh.encode(text), "<u2").tolist() == LIBRARY.encode(text)
    assert set("".join(searched)) >= set("Twowrds,twice:.xyab▁") and len(searched) == len(set(searched))


def test_table(spark):
    docs = documents(spark)
    rows = pieces.round_trip(docs, PATH).collect()
    assert len(rows) == docs.count() and all(r["exact"] for r in rows)
    back = pieces.decode_table(pieces.encode_table(docs, PATH), PATH)
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")
    assert [(r["text"] or "").replace("▁", " ") for r in sorted(docs.collect(), key=key)] == [r["text"] for r in sorted(back.collect(), key=key)]
    assert pieces.round_trip(empty(spark), PATH).collect() == []
