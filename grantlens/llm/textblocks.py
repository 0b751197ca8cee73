"""Arrow text columns as byte blocks: words, lines and their hashes in numpy, a block at a time.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes with A-Z lower-cased (white space is ASCII, so cutting bytes cuts
code points nowhere). Hashes are 64-bit: eight bytes at a time under a key. Nulls count as empty texts. Blocks end at documents, never inside one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: White space and ASCII punctuation: what remains are runs of letters, digits and non-ASCII characters.
NO_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = U(0x9E3779B97F4A7C15)
SECOND = U(0xC6A4A7935BD1E995)
STEP = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (xor-shift and multiply)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def ranges_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: np.uint64 = BASE) -> np.ndarray:
    """64-bit hash of data[s:e] for each range; equal bytes have equal hashes wherever they stand. Each eight bytes of a
    range pass the mixer under the key, then again with their number, and are summed; two keys give independent hashes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from every place on
    sizes = ends - starts

    def pieces(at: np.ndarray, left: np.ndarray, number) -> np.ndarray:
        keep = np.where(left >= 8, U(0xFFFFFFFFFFFFFFFF), (U(1) << (np.minimum(left, 7).astype(U) * U(8))) - U(1))
        return mix(mix((eight[at] & keep) ^ key) + number * STEP)

    out = pieces(starts, sizes, U(1))
    long = np.flatnonzero(sizes > 8)
    if len(long):
        more = (sizes[long] - 1) >> 3  # pieces after the first
        edges = np.concatenate([[0], np.cumsum(more)])
        number = np.arange(1, edges[-1] + 1) - np.repeat(edges[:-1], more)
        at = np.repeat(starts[long], more) + 8 * number
        sums = np.zeros(edges[-1] + 1, U)
        np.cumsum(pieces(at, np.repeat(ends[long], more) - at, number.astype(U) + U(1)), dtype=U, out=sums[1:])
        out[long] += sums[edges[1:]] - sums[edges[:-1]]
    return mix(out + sizes.astype(U) * BASE)


class Block:
    """Some whole documents: ``data`` (uint8, as given), ``offsets`` (one more than documents), ``first`` row in the batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.docs = len(offsets) - 1

    def words(self, space: np.ndarray = SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, bounds, starts): word hashes in order; bounds[d]:bounds[d + 1] are those of document d; start bytes.
        ``space`` marks the bytes between words; without ``lower`` A-Z stay as they are."""
        low = LOWER[self.data] if lower else self.data
        full = ~space[low]
        first = np.zeros(len(low) + 1, bool)
        first[self.offsets] = True
        begin, end = full.copy(), full.copy()
        begin[1:] &= ~full[:-1] | first[1:-1]
        end[:-1] &= ~full[1:] | first[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.low, self.word_ends = low, ends
        return ranges_hash(low, starts, ends), np.searchsorted(starts, self.offsets), starts

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first, last, bounds): each line's bytes, those without white space at both ends, and
        bounds[d]:bounds[d + 1], the lines of document d (an empty document has one empty line)."""
        cuts = np.flatnonzero(self.data == 10)
        per = np.diff(np.searchsorted(cuts, self.offsets)) + 1
        bounds = np.concatenate([[0], np.cumsum(per)])
        starts, ends = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
        head, tail = np.zeros(bounds[-1], bool), np.zeros(bounds[-1], bool)
        head[bounds[:-1]], tail[bounds[1:] - 1] = True, True
        starts[head], starts[~head] = self.offsets[:-1], cuts + 1
        ends[tail], ends[~tail] = self.offsets[1:], cuts
        full = np.flatnonzero(~SPACE[self.data])
        a, b = np.searchsorted(full, starts), np.searchsorted(full, ends)
        some = b > a
        first, last = starts.copy(), starts.copy()
        first[some], last[some] = full[a[some]], full[b[some] - 1] + 1
        return starts, ends, first, last, bounds

    def code_points(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        return total[ends] - total[starts]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The documents of a string column in blocks of about ``size`` bytes."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type):
        kind = np.int32
    else:
        raise TypeError(f"a text column is needed, not {column.type}")
    n = len(column)
    if not n:
        return
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(max(to, at + 1), n)
        yield Block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def trimmed(run: Callable) -> Callable:
    """A task function after which the worker gives freed memory back to the system: workers stay for other tasks and steps,
    and what their allocators keep would add up with what the next ones need."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return whole


def longs(values: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark's signed longs."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))
