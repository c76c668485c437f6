"""SentencePiece encoding and decoding by a streaming Viterbi search.

The model files here are of the BPE kind, whose segmentation isn't the path
with the best sum of scores. But a sequence of pieces is the BPE
segmentation of a text exactly if each two neighbours are that of their own
text. So in the lattice of all pieces, a step from one piece to the next is
allowed if the two are compatible, and then each boundary has one surviving
backpointer. The search keeps a window of one maximal piece length; once the
paths from all boundaries in it meet at one boundary, the ids before it can't
change and are committed. The ids are those of the SentencePiece library.

Two neighbouring characters that stand side by side in no piece always have a
boundary between them. So paths also meet at the start of each word, and at
some closing marks; ``encode`` cuts there and keeps the ids of words in a
bounded cache, so that only new words are searched.

Characters without a piece become byte pieces. Decoding joins pieces and
bytes, and drops the blank that encoding puts first.

Defined results: null and empty texts have no ids; the character U+2581 and a
blank are the same to the model, so decoding gives a blank for either; equal
rows give equal rows; null ids are kept; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"
_WORD_START = re.compile(f"(?<=[^{MARK}]){MARK}")
CACHE_WORDS = 500_000
#: Characters that a stream is given, and that it searches, at a time.
PART, STEP = 1 << 20, 256


class Pieces:
    """The pieces of a model file, and the rule that makes two neighbours compatible."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.bytes = [0] * 256
        self.text: list[bytes] = []
        rank: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.text.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.text.append(b"")
            else:
                rank[piece] = sp.get_score(i)
                self.ids[piece] = i
                self.text.append(piece.encode())
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the model has pieces that go on after a word")
        self.rank = rank
        self.longest = max(map(len, self.ids))
        self.ids = {p: i for p, i in self.ids.items() if self.merged(p) == [p]}  # others never come out of merging
        self.stretches = re.compile(self._cuts()).findall
        self._pairs: dict[tuple[str, str], bool] = {}
        self.committed: dict[str, bytes] = {}  # what a stream committed for a stretch
        self.cache_words = cache_words

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best neighbours, leftmost first."""
        parts, rank = list(text), self.rank
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _cuts(self) -> str:
        """A pattern for stretches of text between which no piece reaches: words, and more where the pieces allow it."""
        inside = set("".join(self.rank))
        breaks = re.escape("".join(c for c in "\n\r\t" if c not in inside))
        joined = {b for p in self.rank for a, b in zip(p, p[1:]) if a.isascii() and a.isalpha()}
        closing = re.escape("".join(c for c in ",;:!?.)" if c not in joined))
        ahead = f"{MARK}*[A-Za-z]+(?=[{closing}])|" if closing else ""
        alone = f"|[{breaks}]+" if breaks else ""
        return f"{ahead}{MARK}*[^{MARK}{breaks}]+|{MARK}+{alone}"

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 1 << 20:
                self._pairs.clear()
            known = self._pairs[key] = self.merged(left + right) == [left, right]
        return known

    def step(self, text: str, last: list[int], i: int) -> int:
        """The start of the only piece that can end at ``i``; ``last`` has those of the boundaries before, -1 for none."""
        ids, pairs = self.ids, self._pairs
        for j in range(max(0, i - self.longest), i):
            piece = text[j:i]
            if (piece in ids or j == i - 1) and last[j] >= 0:
                if j == 0:
                    return 0
                left = text[last[j] : j]
                known = pairs.get((left, piece))
                if known or known is None and self.compatible(left, piece):
                    return j
        raise AssertionError("a boundary without a path")

    def pack(self, pieces: list[str]) -> bytes:
        out = array("H")
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out.extend(self.bytes[b] for b in p.encode("utf-8", "surrogatepass"))
        return out.tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 16-bit integers."""
        if not text:
            return b""
        marked, stream = MARK + text.replace(" ", MARK), Stream(self)
        return b"".join([stream.feed(marked[a : a + PART]) for a in range(0, len(marked), PART)] + [stream.close()])

    def decode(self, packed: bytes) -> str:
        data = b"".join(map(self.text.__getitem__, np.frombuffer(packed, "<u2").tolist()))
        return data.decode("utf-8", "surrogatepass").replace(MARK, " ")[1:]


class Stream:
    """A search that gets its text in parts and commits ids as soon as they are settled."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.tail = ""  # the end of a part, whose stretch may go on
        self.open = False  # whether the window is within a stretch
        self._begin()

    def _begin(self) -> None:
        # the window begins with the committed piece before it, which ends at ``done``; -1 for places that no path may use
        self.text, self.last, self.done = "", [0], 0

    def feed(self, text: str) -> bytes:
        """Take a part of the text (with marks); returns the ids that are settled now."""
        out = []
        if self.open and text:
            word = _WORD_START.search(self.text[-1] + text)
            if not word:
                return self._search(text)
            out += [self._search(text[: word.start() - 1]), self._settle()]
            text, self.open = text[word.start() - 1 :], False
        stretches = self.pieces.stretches(self.tail + text)
        self.tail = stretches.pop() if stretches else ""
        out.append(self._commit_stretches(stretches))
        if len(self.tail) > STEP:
            out.append(self._search(self.tail))
            self.tail, self.open = "", True
        return b"".join(out)

    def close(self) -> bytes:
        return self._settle() + self._commit_stretches([self.tail] if self.tail else [])

    def _commit_stretches(self, stretches: list[str]) -> bytes:
        """The ids of whole stretches; new ones are searched, and all paths meet where they end."""
        cache = self.pieces.committed
        new = set(stretches).difference(cache)
        if not new:
            return b"".join(map(cache.__getitem__, stretches))
        known = {w: self._search(w) + self._settle() for w in new}
        if len(cache) < self.pieces.cache_words:
            cache.update((w, ids) for w, ids in known.items() if len(w) <= 64)
        return b"".join([known[w] if w in known else cache[w] for w in stretches])

    def _search(self, text: str) -> bytes:
        """Extend the window by ``text``; returns the ids before the boundary where all paths meet."""
        p, out = self.pieces, []
        for a in range(0, len(text), STEP):
            self.text += text[a : a + STEP]
            for i in range(len(self.last), len(self.text) + 1):
                self.last.append(p.step(self.text, self.last, i))
            if len(self.text) > 2 * p.longest:
                live = set(range(len(self.text) - p.longest + 1, len(self.text) + 1))
                while len(live) > 1:  # step the furthest path back until all meet
                    top = max(live)
                    live.remove(top)
                    live.add(max(self.done, self.last[top]))
                out.append(self._commit(live.pop()))
        return b"".join(out)

    def _commit(self, end: int) -> bytes:
        found, i = [], end
        while i > self.done:
            found.append(self.text[self.last[i] : i])
            i = self.last[i]
        if found:
            start = self.last[end]
            self.text, self.done = self.text[start:], end - start
            self.last = [-1] * self.done + [0] + [x - start if x >= end else -1 for x in self.last[end + 1 :]]
        return self.pieces.pack(found[::-1])

    def _settle(self) -> bytes:
        """Commit to the end of the window, where all paths meet."""
        out = self._commit(len(self.text))
        self._begin()
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The pieces of this Python worker; their caches outlive the task."""
    return Pieces(path)


ENCODED = "doc_id long, n_ids long, ids_crc32 long, text_crc32 long, exact boolean"


def encode_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, 16-bit) of ``docs`` (doc_id, text)."""

    def run(batches):
        p = pieces(path)
        for batch in batches:
            ids = [p.encode(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def decode_table(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of ``encoded`` (doc_id, ids)."""

    def run(batches):
        p = pieces(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.decode(x.as_py()) for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids of ``docs`` and of the text that they decode to."""

    def run(batches):
        p = pieces(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                packed = p.encode(text)
                back = p.decode(packed)
                wide = np.frombuffer(packed, "<u2").astype("<u4").tobytes()
                rows.append((doc_id, len(packed) // 2, zlib.crc32(wide), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == text.replace(MARK, " ")))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            columns = list(zip(*rows)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in ENCODED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def op5_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all ``documents`` with a SentencePiece model and decode them again."""
    small_batches(spark)
    from .tokens import default_path

    return round_trip(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")), default_path("piece_bpe_32k.model"))
