"""Words and word shingles of Arrow texts as 64-bit hashes, computed on whole arrays.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. A word's hash is a
polynomial over its bytes, read off prefix sums, and a shingle's a mix of its words' hashes. Hashes are
the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Words in a shingle.
SHINGLE_WORDS = 5
_PIECE = 1 << 21  # bytes of one text hashed at once
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = values + _U((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LETTERS = np.arange(256, dtype=np.uint64)
_LETTERS[65:91] += _U(32)
_LETTERS = mix(_LETTERS, 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACES = mix(np.arange(SHINGLE_WORDS, dtype=np.uint64), 2) | _U(1)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, length: int) -> np.ndarray:
    known = _powers.get(kind)
    if known is None or len(known) < length:
        steps = np.full(max(length, 1 << 20), _U(base))
        steps[0] = 1
        known = _powers[kind] = np.multiply.accumulate(steps)
    return known[:length]


@dataclass
class Words:
    """Words of some texts in order: hashes, first byte and end in the text, and where texts begin."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray  # text i has words offsets[i]:offsets[i + 1]


def _hash_words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of the words in ``data``; texts begin at ``begins``."""
    space = _SPACE[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0], before[1:] = True, space
    before[begins] = True
    after = np.append(space[1:], True)
    after[begins[begins > 0] - 1] = True
    starts = np.flatnonzero(~space & before[:-1])
    ends = np.flatnonzero(~space & after) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LETTERS[data] * _power("base", _BASE, len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power("inverse", _INVERSE, len(data) + 1)[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), starts, ends


def words_of(texts: pa.Array) -> Words:
    """Words of every text; null and empty texts have none."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, content = texts.buffers()
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(content, dtype=np.uint8)[at[0] : at[-1]] if content is not None else np.empty(0, np.uint8)
    at = at - at[0]
    found: list[tuple] = []
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + _PIECE)
        if hi < len(data):  # cut only where no word goes on
            cuts = np.flatnonzero(_SPACE[data[lo:hi]])
            inner = at[(at > lo) & (at <= hi)]
            best = max(cuts[-1] + 1 + lo if len(cuts) else 0, inner[-1] if len(inner) else 0)
            if best <= lo:  # a word longer than a piece
                rest = np.flatnonzero(_SPACE[data[hi:]])
                ends = at[at > hi]
                best = min(rest[0] + hi if len(rest) else len(data), ends[0] if len(ends) else len(data))
            hi = int(best)
        begins = at[(at >= lo) & (at < hi)] - lo
        hashes, starts, ends = _hash_words(data[lo:hi], begins)
        found.append((hashes, starts + lo, ends + lo))
        lo = hi
    if not found:
        empty = np.empty(0, dtype=np.int64)
        return Words(empty.astype(np.uint64), empty, empty, np.zeros(len(texts) + 1, dtype=np.int64))
    hashes, starts, ends = (np.concatenate(part) for part in zip(*found, strict=True))
    bounds = np.searchsorted(starts, at)
    owner = np.repeat(at[:-1], np.diff(bounds))
    return Words(hashes, starts - owner, ends - owner, bounds)


def combine(hashes: np.ndarray) -> int:
    """One hash for a short sequence of word hashes."""
    total = sum(int(h) * int(p) for h, p in zip(hashes, _PLACES, strict=False)) + len(hashes) % SHINGLE_WORDS
    return int(mix(np.array([total % (1 << 64)], dtype=np.uint64), 3)[0])


def shingles_at(hashes: np.ndarray) -> np.ndarray:
    """The hash of the five words from each position on, whichever text they belong to."""
    count = len(hashes) - SHINGLE_WORDS + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    total = hashes[:count] * _PLACES[0]
    for place in range(1, SHINGLE_WORDS):
        total += hashes[place : place + count] * _PLACES[place]
    return mix(total, 3)


def shingle_sets(words: Words) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text: all runs of five words, the whole sequence as one where
    there are fewer, none without words."""
    every = shingles_at(words.hashes)
    for lo, hi in zip(words.offsets[:-1], words.offsets[1:], strict=True):
        if hi - lo >= SHINGLE_WORDS:
            yield np.unique(every[lo : hi - SHINGLE_WORDS + 1])
        elif hi > lo:
            yield np.array([combine(words.hashes[lo:hi])], dtype=np.uint64)
        else:
            yield np.empty(0, dtype=np.uint64)
