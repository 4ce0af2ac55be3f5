"""Word hashes of whole Arrow text columns, computed on the bytes with numpy: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; longer texts are hashed in stretches, so that temporary arrays stay bounded.
CHUNK = 1 << 21

#: A word's hash is the sum of one random value for each (place, byte): no two words collide by their structure. Places beyond the table get their value from a mixer.
PLACES = 256
_VALUES = np.random.Generator(np.random.PCG64(20_240_501)).integers(0, 2**64, (PLACES, 256), dtype=np.uint64)
_VALUES_LOWER = _VALUES.copy()
_VALUES_LOWER[:, 65:91] = _VALUES[:, 97:123]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads every input bit over the output (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of ``texts`` of about ``limit`` bytes; a longer text is a range of its own."""
    sizes = np.diff(_offsets(texts))
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, starts and ends of their words ``[^\\x20\\x09-\\x0D]+`` in them, and each text's first word (n + 1 values).

    A null text has no words. The bytes of a multi-byte character are never separators, so bytes do for characters.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = _offsets(texts)
    data = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        empty = np.zeros(0, np.int64)
        return data, empty, empty, np.zeros(len(texts) + 1, np.int64)
    space = _SEPARATOR[data]
    first = np.empty(len(data) + 1, dtype=bool)  # a new text begins or a separator stands before
    first[0] = first[-1] = True
    first[1:-1] = space[:-1]
    first[offsets] = True
    starts = np.flatnonzero(first[:-1] & ~space)
    last = np.empty(len(data), dtype=bool)
    last[:-1] = space[1:]
    last[-1] = True
    inner = offsets[(offsets > 0) & (offsets <= len(data))] - 1
    last[inner] = True
    ends = np.flatnonzero(last & ~space) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of all texts, and each text's first word (n + 1 values). ``lower`` folds A-Z."""
    data, starts, ends, firsts = split(texts)
    values = (_VALUES_LOWER if lower else _VALUES).reshape(-1)
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        sizes = ends[i:j] - starts[i:j]
        begin = np.cumsum(sizes) - sizes  # of each word among the bytes of words
        place = np.arange(sizes.sum()) - np.repeat(begin, sizes)
        said = data[place + np.repeat(starts[i:j], sizes)]
        parts = values[np.minimum(place, PLACES - 1) * 256 + said]
        far = np.flatnonzero(place >= PLACES)
        if len(far):
            late = _LOWER[said[far]] if lower else said[far]
            parts[far] = mixed(mixed(place[far].astype(np.uint64) * np.uint64(256) + late) + _STEP)
        out[i:j] = np.add.reduceat(parts, begin)
        i = j
    return mixed(out), firsts


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words; ``len(hashes) - n + 1`` values, none when there are fewer words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:count].copy()
    for j in range(1, n):
        out *= _STEP
        out += hashes[j : j + count]
    return mixed(out)
