"""Fast exact encoding with a public tokenizer file.

When a tokenizer drops white space before it looks at words, a text's ids are
the ids of its words in a row. Words then come from a bounded cache and only
new ones go through the library; the ids are the library's own either way.
Latin-1 text needs no Unicode normalization, so its words are found by the
same pattern here and only the library's BPE model is asked for their ids.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: Words that the cache of a Python worker holds; later ones are encoded each time.
CACHE_WORDS = 700_000
#: Characters of a text that are split into words at a time.
SLICE_CHARS = 1 << 20


#: A control character that stands between words in one call.
MARK = "\x01"


def drops_white_space(spec: dict) -> bool:
    """True if the tokenizer turns white space into blanks and removes what its word pattern leaves out."""
    kinds = (spec.get("normalizer") or {}).get("normalizers") or []
    if [k["type"] for k in kinds] != ["NFC", "Replace", "Lowercase"] or kinds[1]["pattern"] != {"Regex": "\\s+"} or kinds[1]["content"] != " ":
        return False
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    pattern = first["pattern"].get("Regex", " ")
    return " " not in pattern and pattern.endswith("[^\\s\\p{L}\\p{N}]+") and spec.get("post_processor") is None


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level tokenizers write for each byte, as a table for str.translate."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()

# The word pattern of the tokenizer file, and the same pattern for lower-cased Latin-1 text.
CLIP_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _DIGITS, _BLANKS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_BLANKS}{_LETTERS}{_DIGITS}]+").findall


class _Pieces(dict):
    """Ids of lower-cased pieces that the word pattern found; new ones come straight from the BPE model.

    Once half full, only pieces that were met before are kept, so that words
    that occur once don't fill the bound.
    """

    def __init__(self, bpe, code: str, bound: int):
        super().__init__()
        self._bpe, self._code, self._bound = bpe, code, bound
        self._met: set[int] = set()

    def __missing__(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = array(self._code, [t.id for t in self._bpe(shown)]).tobytes()
        n = len(self)
        if n < self._bound // 2:
            self[piece] = ids
        elif n < self._bound:
            h = hash(piece) & 0xFFFFFF
            if h in self._met:
                self[piece] = ids
            else:
                if len(self._met) > 200_000:
                    self._met.clear()
                self._met.add(h)
        return ids


class Encoder:
    """Encodes texts to ids packed as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._by_word = drops_white_space(spec)
        self._latin = self._by_word and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == CLIP_PATTERN
        self.width = 2 if self._tok.get_vocab_size() <= 1 << 16 else 4
        self._code = "H" if self.width == 2 else "I"
        self._cache: dict[str, bytes] = {"": b""}
        self._cache_words = cache_words
        self._pieces = _Pieces(self._tok.model.tokenize, self._code, cache_words)
        self._special = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        mark = self._tok.encode(MARK, add_special_tokens=False).ids if self._by_word else []
        self._mark = mark[0] if len(mark) == 1 else None

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array(self._code, e.ids).tobytes() for e in self._tok.encode_batch(texts, add_special_tokens=False)]

    def _many(self, words: list[str]) -> list[bytes]:
        """Ids of each word; words share one call of the library, with a mark between them."""
        if self._mark is None or len(words) < 3 or any(MARK in w for w in words):
            return self._library(words)
        out = []
        for i in range(0, len(words), 500):
            some = words[i : i + 500]
            ids = np.array(self._tok.encode(f" {MARK} ".join(some), add_special_tokens=False).ids, f"<u{self.width}")
            ends = np.append(np.flatnonzero(ids == self._mark), len(ids)).tolist()
            packed, w, at = ids.tobytes(), self.width, 0
            for end in ends:
                out.append(packed[at * w : end * w])
                at = end + 1
        return out

    def _words(self, words: list[str]) -> bytes:
        """Ids of words between blanks, by the whole tokenizer if they are new."""
        cache = self._cache
        new = list(set(words).difference(cache))
        known = dict(zip(new, self._many(new)))
        if len(cache) < self._cache_words:
            cache.update(known)
        return b"".join([cache[w] if w in cache else known[w] for w in words])

    def _part(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._words(text.replace("\n", " ").split(" "))
        if not self._latin or any(t in text for t in self._special):
            return self._words(text.replace("\n", " ").split(" "))
        return b"".join(map(self._pieces.__getitem__, LATIN_PIECES(text.lower())))

    def encode(self, text: str | None) -> bytes:
        """The packed ids of one whole text; nothing for null."""
        if not text:
            return b""
        if not self._by_word:
            return self._library([text])[0]
        if len(text) <= SLICE_CHARS:
            return self._part(text)
        parts, at = [], 0
        while at < len(text):
            cut = text.find(" ", at + SLICE_CHARS)
            cut = len(text) if cut < 0 else cut
            parts.append(self._part(text[at:cut]))
            at = cut
        return b"".join(parts)


@lru_cache(maxsize=4)
def encoder(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """The encoder of this Python worker for a file; its cache outlives the task."""
    return Encoder(path, cache_words)


def default_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
