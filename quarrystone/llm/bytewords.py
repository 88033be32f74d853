"""Hashes of the words of many texts at once, by numpy over their UTF-8 bytes.

A word is a run of ASCII letters and digits and of bytes above 0x7f; A-Z count
as a-z, and so do the two-byte capitals of Latin-1 (C3 80 to C3 9E). Its hash is a polynomial of its bytes modulo 2^64, mixed at the end.
Polynomials of prefixes give every word's hash with a few passes over the bytes
and none over the words in Python. The hashes find candidates and count words;
where exactness matters, strings are compared afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quarrystone.llm.common import ship

ship(__name__)

#: bytes of text handled at a time; a longer text is cut at a word's end and its words are put together again
CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_POWERS = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        m = max(n, CHUNK + 4096)
        _POWERS["up"] = _powers(m, int(_BASE))
        _POWERS["down"] = _powers(m, pow(int(_BASE), -1, 1 << 64))
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lowered(data: np.ndarray) -> np.ndarray:
    low = _LOWER[data]
    if len(low) > 1:
        after = np.flatnonzero(low[:-1] == 0xC3) + 1
        capital = after[(low[after] >= 0x80) & (low[after] <= 0x9E) & (low[after] != 0x97)]
        low[capital] += 32
    return low


def _words_of(data: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Starts of the words in one chunk, and their hashes: whole, then of the first p characters for each p."""
    is_word = _WORD[data]
    edge = np.diff(is_word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    low = _lowered(data)
    up, down = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=total[1:])

    def hashed(stop: np.ndarray, seed: int) -> np.ndarray:
        return mix((total[stop] - total[start]) * down[start] + np.uint64(seed))

    out = [hashed(end, 0)]
    if prefixes:
        # a character begins at every byte that is no continuation
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(begins, start)
        for p in prefixes:
            at = np.minimum(first + p, len(begins))
            stop = np.where(at < len(begins), begins[np.minimum(at, len(begins) - 1)] if len(begins) else 0, len(data))
            # a shorter word has no such prefix: it is marked by the hash of its whole
            out.append(hashed(np.minimum(stop, end), p))
    return start, out


def _cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a long text, none inside a word unless the word is longer than a chunk."""
    cuts, at = [], 0
    while len(data) - at > CHUNK:
        to = at + CHUNK
        gaps = np.flatnonzero(~_WORD[data[to - 65536 : to]])
        to = to - 65536 + int(gaps[-1]) + 1 if len(gaps) else to
        cuts.append(to)
        at = to
    return [*cuts, len(data)]


def words(texts: pa.Array, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """Runs of texts as (first, last + 1, bounds, hashes): text first + i has the hashes from bounds[i] to bounds[i + 1].

    Nulls are empty texts. Runs have about ``CHUNK`` bytes; a longer text is a run of its own.
    """
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(buffers[2], dtype=np.uint8) if n and buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        if j == i + 1:
            data = raw[offsets[i] : offsets[j]]
            parts, at = [], 0
            for to in _cuts(data):
                parts.append(_words_of(data[at:to], prefixes)[1])
                at = to
            hashes = [np.concatenate(x) for x in zip(*parts, strict=True)]
            yield i, j, np.array([0, len(hashes[0])]), hashes
        else:
            # texts are put a byte apart, so that none runs into the next
            lengths = np.diff(offsets[i : j + 1])
            data = np.zeros(int(offsets[j] - offsets[i]) + (j - i), dtype=np.uint8)
            place = np.arange(int(offsets[j] - offsets[i])) + np.repeat(np.arange(j - i), lengths)
            data[place] = raw[offsets[i] : offsets[j]]
            start, hashes = _words_of(data, prefixes)
            begins = np.r_[offsets[i:j] - offsets[i] + np.arange(j - i), len(data)]
            yield i, j, np.searchsorted(start, begins), hashes
        i = j


def text_words(text: str) -> list[str]:
    """The words of one text as strings, cut as ``words`` cuts them."""
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in text)
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", low)


def shingle_hashes(word_hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words that lie within one text, and the text (counted from 0) of each."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += word_hashes[i : i + n]
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = owner[:n] == owner[k - 1 : k - 1 + n]
    return mix(out[inside]), owner[:n][inside]
