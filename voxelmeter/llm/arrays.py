"""Vectorised text helpers for Arrow batches: byte views, word bounds, rolling hashes."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def byte_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows in them), about ``limit`` bytes or one long text at a time.

    Null texts are empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the index of each row's first word (one more at the end)."""
    mask = table[data]
    starts, ends = mask.copy(), mask.copy()
    starts[1:] &= ~mask[:-1]
    ends[:-1] &= ~mask[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    starts[inner] = mask[inner]
    ends[inner - 1] = mask[inner - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with what it freed given back to the system at the end of a task: Python workers live on between tasks, idle ones too."""
    @functools.wraps(run)
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _POWERS.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)
    return outer


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (64-bit, unsigned)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = (n | 0xFFFF) + 1
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.ones(size, _U)
            done, step = 1, b
            while done < size:
                p[done:2 * done] = p[:min(done, size - done)] * _U(step)
                step = step * step % (1 << 64)
                done *= 2
            out.append(p)
        have = (out[0], out[1])
        if size <= 4 * CHUNK_BYTES:  # those of one very long text are not kept
            _POWERS[base] = have
    return have


class Rolling:
    """Hashes of any stretch of a symbol sequence, from prefix sums modulo 2**64."""

    def __init__(self, symbols: np.ndarray, base: int = _ODD):
        self.up, self.down = _powers(base | 1, len(symbols))
        self.sums = np.zeros(len(symbols) + 1, _U)
        np.cumsum(symbols * self.up[:len(symbols)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U))


_rng = np.random.RandomState(20240601)
BYTE_SYMBOLS = _rng.randint(0, 1 << 32, 256).astype(_U) << _U(32) | _rng.randint(0, 1 << 32, 256).astype(_U)
BYTE_SYMBOLS_2 = mix(BYTE_SYMBOLS + _U(1))
SECOND_BASE = 0xD1342543DE82EF95


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_SYMBOLS) -> np.ndarray:
    return Rolling(table[data]).of(starts, ends)


def hash_text_words(words: list[bytes]) -> np.ndarray:
    """The hash that :func:`word_hashes` gives to each of these words."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return word_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    if len(values) < width:
        return values[:0]
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out
