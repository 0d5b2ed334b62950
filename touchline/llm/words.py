"""Words of texts as 64-bit hashes, whole batches at once."""

from __future__ import annotations

import functools
import hashlib
import sys
import unicodedata

import numpy as np

from touchline.llm.finite_state import powers

SLICE = 1_000_000   # characters hashed at once
LONG_WORD = 64      # characters from which a word is hashed by a digest


@functools.cache
def word_characters() -> np.ndarray:
    """Letters, numbers, marks and the underscore make words."""
    out = np.array([unicodedata.category(chr(p))[0] in "LNM" for p in range(sys.maxunicode + 1)])
    out[ord("_")] = True
    return out


def mixed(x: np.ndarray, factor: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    return x ^ (x >> np.uint64(27))


def _hashed(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a string and where they begin."""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = word_characters()[points]
    edges = np.diff(inside)
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = powers(1 << max(12, int(len(points)).bit_length()))
    prefix = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:len(points)], out=prefix[1:])
    hashes = mixed((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(np.uint64))
    # Sums of powers modulo 2**64 repeat for some long words, whatever the power; those get a digest.
    for i in np.flatnonzero(end - begin > LONG_WORD):
        digest = hashlib.blake2b(points[begin[i]:end[i]].tobytes(), digest_size=8).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return hashes, begin


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """Hash of every word of each text, in order; words compare without case.

    Short texts are hashed together; a long one in slices that end outside words.
    """
    out: list[np.ndarray | None] = [None] * len(texts)
    held: list[int] = []
    size = 0
    lowered = [t.lower() for t in texts]

    def flush():
        if not held:
            return
        parts = [lowered[i] for i in held]
        hashes, begin = _hashed("\n".join(parts))
        ends = np.cumsum([len(p) + 1 for p in parts])
        at = np.searchsorted(begin, ends)
        for i, a, b in zip(held, [0, *at[:-1]], at, strict=True):
            out[i] = hashes[a:b]
        held.clear()

    for i, text in enumerate(lowered):
        if len(text) > SLICE:
            out[i] = np.concatenate([_hashed(part)[0] for part in _slices(text)])
            continue
        if size + len(text) > SLICE:
            flush()
            size = 0
        held.append(i)
        size += len(text) + 1
    flush()
    return out


def _slices(text: str):
    words, start = word_characters(), 0
    while start < len(text):
        end = min(start + SLICE, len(text))
        while end < len(text) and words[ord(text[end])]:
            end += 1
        yield text[start:end]
        start = end


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; a shorter non-empty text is one run."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i:len(words) - n + 1 + i]
    return mixed(out)
