"""Word shingles of whole texts, as 64-bit hashes, by array arithmetic.

Words are runs of bytes other than blanks and the control characters 9 to 13,
A to Z lower-cased. A word's hash folds its bytes eight at a time through a
mix that is not linear; a shingle's is a polynomial over word hashes, mixed
again. A text with fewer words than a shingle has one for its whole sequence; a
text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from .words import byte_set, folded, mix, spans

WORDS = 5
#: Texts are hashed in blocks of about this many bytes.
BLOCK = 1 << 20
#: Longer words are hashed on their own, so that a block stays small.
LONG_WORD = 1 << 16

_U = np.uint64
_Q = [pow(0x14057B7EF767814F, k, 1 << 64) for k in range(WORDS)]
_WORD = ~byte_set((9, 13), (32, 32))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of ``data``, which is lower-cased."""
    starts, ends = spans(data, _WORD)
    return starts, folded(data, starts, ends)


def _blocks(data: bytes) -> Iterator[bytes]:
    """``data`` in blocks that end between words; a word longer than LONG_WORD is a block of its own."""
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):
            back = data[end - LONG_WORD : end]
            gap = max(back.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if gap >= 0:
                end = end - LONG_WORD + gap + 1
            else:  # within a long word: up to its end
                nexts = [x for x in (data.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0]
                end = min(nexts, default=len(data))
        yield data[at:end]
        at = end


def _words_of_long(data: bytes) -> np.ndarray:
    return np.concatenate([word_hashes(b)[1] for b in _blocks(data)])


def _shingle(words: np.ndarray) -> np.ndarray:
    n = len(words)
    with np.errstate(over="ignore"):
        if n < WORDS:
            total = np.zeros(1, _U)
            for k in range(n):
                total += words[k] * _U(_Q[k])
            return mix(total + _U(0x9E3779B97F4A7C15) * _U(n))
        out = np.zeros(n - WORDS + 1, _U)
        for k in range(WORDS):
            out += words[k : n - WORDS + 1 + k] * _U(_Q[k])
    return mix(out)


def strings(column) -> Iterator[str | None]:
    """The texts of an Arrow column one by one, so that a batch isn't held twice."""
    return (x.as_py() for x in column)


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        starts, hashes = word_hashes(b" ".join(held))
        offsets = np.cumsum([0, *(len(x) + 1 for x in held)])
        cuts = np.searchsorted(starts, offsets)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield np.unique(_shingle(hashes[a:b])) if b > a else np.zeros(0, _U)

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if len(data) > BLOCK:
            if held:
                yield from flush()
                held, size = [], 0
            words = _words_of_long(data)
            yield np.unique(_shingle(words)) if len(words) else np.zeros(0, _U)
            continue
        held.append(data)
        size += len(data)
        if size >= BLOCK:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()
