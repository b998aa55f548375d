"""Words and their hashes for whole batches of texts, in numpy.

A batch's texts are one byte string; a byte table says which bytes end words
and folds A-Z. A word's hash is a polynomial over random byte values modulo
2^64, read off running sums, then mixed: no loop over words or documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20250601)).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes hashed at once.
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base & (1 << 64) - 1))
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, BLOCK + 1), _powers(_INVERSE, BLOCK + 1)


def separators(kind: str) -> np.ndarray:
    """True for bytes between words: kind space ([\\x20\\x09-\\x0D]) or mark (ASCII but letters and digits)."""
    table = np.zeros(256, bool)
    if kind == "space":
        table[[32, 9, 10, 11, 12, 13]] = True
    else:
        table[:128] = True
        table[48:58] = table[65:91] = table[97:123] = False
    return table


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends], in blocks of BLOCK bytes; a word longer than that has chained blocks."""
    out = np.zeros(len(starts), U)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = int(np.searchsorted(ends, at + BLOCK, "right"))
        if j > i:
            part = data[at : ends[j - 1]]
            run = np.zeros(len(part) + 1, U)
            np.cumsum(_VALUES[part] * _UP[: len(part)], out=run[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = mix((run[e] - run[s]) * _DOWN[s] + (e - s).astype(U))
            i = j
        else:
            h = np.zeros(1, U)
            for k in range(at, ends[i], BLOCK):
                part = data[k : min(k + BLOCK, ends[i])]
                h = mix((_VALUES[part] * _UP[: len(part)]).sum(dtype=U, keepdims=True) + h)
            out[i] = h[0]
            i += 1
    return out


def word_hashes(texts: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string array in order, and offsets: words of text i are hashes[o[i]:o[i+1]]. Null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or bounds[-1] == bounds[0]:
        return np.zeros(0, U), np.zeros(len(texts) + 1, np.int64)
    data = _FOLD[np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    word = ~separators(kind)[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = bounds[1:-1][bounds[1:-1] < len(data)]
    first[inner] |= word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = inner[inner > 0] - 1
    last[cut] |= word[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _hashed(data, starts, ends), np.searchsorted(starts, bounds).astype(np.int64)


def sliced(batch: pa.RecordBatch, column: int, most: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``most`` bytes; a longer text stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)
