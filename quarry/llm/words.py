"""Word splitting and 64-bit hashing over the raw UTF-8 buffers of Arrow string columns.

Words are runs of bytes other than space, tab, LF, VT, FF and CR. A hash of a
byte span or of a run of words is a polynomial modulo 2**64 over randomised
symbols, finished with a mixing step; no text is turned into Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SEGMENT = 1 << 19
_Q, _R = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


SYMBOL = mix(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D))
FOLDED = SYMBOL.copy()
FOLDED[65:91] = SYMBOL[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _tables:
        _tables.extend((_powers(_Q, SEGMENT + 1), _powers(pow(_Q, -1, 1 << 64), SEGMENT + 1)))
    return _tables


def spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    word = ~SEPARATOR[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edge] = word[edge]
    edge = edge[edge > 0] - 1
    last[edge] = word[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbols: np.ndarray = SYMBOL) -> np.ndarray:
    """A hash of each byte span; starts and ends ascend. Memory besides the result is bounded by SEGMENT."""
    power, inverse = _power_tables()
    low, high, scale = np.empty(len(starts), U), np.zeros(len(ends), U), np.empty(len(starts), U)
    carry, shift, back, step = U(0), U(1), U(1), (power[SEGMENT], inverse[SEGMENT])
    with np.errstate(over="ignore"):
        for a in range(0, len(buf), SEGMENT):
            part = symbols[buf[a : a + SEGMENT]]
            part *= power[: len(part)]
            total = np.empty(len(part) + 1, U)
            total[0] = 0
            np.cumsum(part, out=total[1:])
            total *= shift
            total += carry
            i, j = np.searchsorted(starts, (a, a + len(part)))
            low[i:j] = total[starts[i:j] - a]
            scale[i:j] = inverse[starts[i:j] - a] * back
            i, j = np.searchsorted(ends, (a, a + len(part)), side="right")
            high[i:j] = total[ends[i:j] - a]
            carry, shift, back = total[-1], shift * step[0], back * step[1]
        return mix((high - low) * scale + (ends - starts).astype(U))


def take(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the spans behind one another."""
    size = ends - starts
    to = np.cumsum(size)
    return buf[np.arange(to[-1] if len(to) else 0) + np.repeat(starts - (to - size), size)]


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive words, by doubling; run i starts at word i. Runs across texts are among them."""
    if len(words) < n:
        return np.empty(0, U)
    with np.errstate(over="ignore"):
        block, width = words, 1
        out, have = None, 0
        while True:
            if n & width:
                if out is None:
                    out = block
                else:
                    m = len(words) - have - width + 1
                    out = out[:m] + block[have : have + m] * U(pow(_R, have, 1 << 64))
                have += width
            if 2 * width > n:
                return mix(out + U(n))
            m = len(words) - 2 * width + 1
            block = block[:m] + block[width : width + m] * U(pow(_R, width, 1 << 64))
            width *= 2


def run_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts whose words begin at first[i]: the word index of every run of n words inside one text, and its text."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    base = np.concatenate(([0], np.cumsum(count)))
    return np.arange(base[-1]) - base[text] + first[text], text


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, off - off[0]


def slices(column: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of whole texts of about `most` bytes: index of the first text, bytes, offsets. A longer text is a piece of its own."""
    buf, off = buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
