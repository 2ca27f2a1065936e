"""Words of Arrow text columns as 64-bit codes, for use inside map tasks.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D). That is the
regular expression ``[^\\x20\\x09-\\x0D]+``, because UTF-8 never uses these bytes inside a
longer character. All functions work on whole arrays; a batch is cut into slices of
bounded text size first, so memory does not depend on how long documents are together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

SLICE_BYTES = 4 << 20
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
ROLL = 0xD6E8FEB86659FD93  # odd, so that powers can be undone modulo 2**64
_ROLL_BACK = pow(ROLL, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing step (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices with at most ``limit`` bytes of text, or a single longer document."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            done = total[start - 1] if start else 0
            stop = max(int(np.searchsorted(total, done + limit, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


@dataclass
class Words:
    """Words of a slice: word k is ``data[starts[k]:ends[k]]``; row i has words first[i]..first[i+1]-1."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """Row number of every word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty. Eight zero bytes follow."""
    column = pc.fill_null(column, "")
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(bounds) == 0:
        bounds = np.zeros(1, dtype=np.int64)
    size = int(bounds[-1] - bounds[0])
    padded = np.zeros(size + 8, dtype=np.uint8)
    if size:
        padded[:size] = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]
    return padded, bounds - bounds[0]


def split_words(column: pa.Array, lower: bool = False, breaks: np.ndarray = WHITE) -> Words:
    """All words of a string column, or the pieces between other ``breaks`` (a flag per byte)."""
    data, bounds = text_bytes(column)
    if lower:
        data = LOWER[data]
    size = int(bounds[-1])
    inside = ~breaks[data[:size]]
    edge = np.zeros(size + 1, dtype=bool)  # a row starts here
    edge[bounds] = True
    if not size:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, np.zeros(len(bounds), dtype=np.int64))
    opens = inside & edge[:size]
    opens[0] = inside[0]
    opens[1:] |= inside[1:] & ~inside[:-1]
    closes = inside & edge[1:]
    closes[:-1] |= inside[:-1] & ~inside[1:]
    starts = np.flatnonzero(opens)
    return Words(data, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, bounds))


def codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every byte range, read in words of eight bytes."""
    loads = np.ndarray((max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,))
    length = ends - starts
    out = mix(length.astype(np.uint64) + np.uint64((seed * 0x632BE59BD9B4E019 + 1) & 0xFFFFFFFFFFFFFFFF))
    live, done = np.arange(len(starts)), 0
    while live.size:
        part = loads[starts[live] + done] & _TAIL[np.minimum(length[live] - done, 8)]
        out[live] = mix((out[live] + _STEP) ^ part * np.uint64(0xFF51AFD7ED558CCD))
        done += 8
        live = live[length[live] > done]
    return out


def runs(code: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` codes that start at each position; positions near the end are left out."""
    n = len(code) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if width <= 8:
        total = np.zeros(n, dtype=np.uint64)
        for j in range(width):
            total = total * np.uint64(ROLL) + code[j : j + n]
        return mix(total)
    power = np.full(len(code), ROLL, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(code * power, dtype=np.uint64)])
    back = np.full(n, _ROLL_BACK, dtype=np.uint64)
    back[0] = 1
    return mix((sums[width:] - sums[:n]) * np.multiply.accumulate(back))
