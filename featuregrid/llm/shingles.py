"""Word shingles of whole texts as 64-bit hashes, computed for a batch of texts at once."""

from __future__ import annotations

import numpy as np

#: Word separators of the near-duplicate contract, [\x20\x09-\x0D].
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]  # A-Z read as a-z
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Places of a word whose terms are looked up; the terms of later ones are computed.
_TABLED = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit; its constants are fixed values of a
    well-known generator."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _terms(seeds: np.ndarray, data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What each byte adds to the hash of its word: a number of its own for each byte and place. The
    sum has no structure in the places, so no rule of repetition makes words collide."""
    return mix(seeds[data] + place.astype(np.uint64) * _STEP)


_TABLES = {fold: _terms(seeds, np.tile(np.arange(256), _TABLED), np.repeat(np.arange(_TABLED), 256)) for fold, seeds in ((False, _BYTE), (True, _FOLDED))}


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in ``data`` (UTF-8), and for each text where its words begin.

    ``offsets`` holds the byte position of each text and the end of the last.
    """
    n = len(data)
    texts = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    inside = ~_IS_SEP[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    counts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    word = np.cumsum(first, dtype=np.int32) - 1
    at = np.flatnonzero(inside)
    word = word[at]
    place = at - starts[word]
    held = data[at]
    values = _TABLES[fold][(np.minimum(place, _TABLED - 1) << 8) | held]
    late = np.flatnonzero(place >= _TABLED)
    if len(late):
        values[late] = _terms(_FOLDED if fold else _BYTE, held[late], place[late])
    begin = np.flatnonzero(first[at])
    return mix(np.add.reduceat(values, begin)), counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    words, counts = word_hashes(data, offsets)
    if len(words) >= width:
        rolled = words[: len(words) - width + 1] * np.uint64(3)
        for k in range(1, width):
            rolled = mix(rolled) + words[k : len(words) - width + 1 + k] * np.uint64(2 * k + 5)
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(counts[:-1].tolist(), counts[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for x in words[a:b]:
                short = mix(np.array([short ^ x]))[0]
            out.append(np.array([short]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a pyarrow string array; nulls count as empty texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64, count=len(column) + 1, offset=column.offset * 8)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
