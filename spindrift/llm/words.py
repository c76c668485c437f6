"""Words of a block of bytes and a 64-bit number for each, by array arithmetic.

Letters are folded eight at a time through a mix that is not linear, so no
family of different words is known to meet, whatever their length.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
#: Longer words are digested one by one.
FOLDED = 64
#: The bytes that a word of n bytes keeps of eight, the first one highest.
_KEEP = np.array([0, *(((1 << 8 * n) - 1) << 8 * (8 - n) for n in range(1, 9))], _U)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags that holds for the bytes of the ranges, ends included."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def spans(data: bytes, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the longest runs of bytes for which ``of_word`` holds."""
    word = of_word[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    return edges[::2], edges[1::2]


def eights(data: bytes) -> np.ndarray:
    """At each place of ``data`` the eight bytes from there as one number, the first byte highest; zeros stand behind the end."""
    return np.ndarray((len(data),), ">u8", data + bytes(8), strides=(1,))


def folded(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of each word ``data[start:end]``; words of up to eight bytes of one length never share one."""
    at, size = eights(data), ends - starts
    with np.errstate(over="ignore"):
        out = size.astype(_U) * _U(0x9E3779B97F4A7C15)
    rest, done = np.arange(len(starts)), 0
    while len(rest):
        n = np.minimum(size[rest] - done, 8)
        out[rest] = mix(out[rest] ^ (at[starts[rest] + done].astype(_U) & _KEEP[n]))
        done += 8
        rest = rest[size[rest] > done]
        if done >= FOLDED:
            break
    for i in rest.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def terms(data: bytes, starts: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """The number of each word for a dictionary: its bytes if there are at most eight, else a hash below all of these.

    Words have no byte under ``least``, so short words are told apart exactly
    and sort as text; long ones are told apart by some 61 bits.
    """
    size = ends - starts
    out = eights(data)[starts].astype(_U) & _KEEP[np.minimum(size, 8)]
    long = np.flatnonzero(size > 8)
    out[long] = folded(data, starts[long], ends[long]) % _U(least << 56)
    return out
