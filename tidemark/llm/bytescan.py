"""Words and their hashes out of whole Arrow batches of text, without a Python loop over words.

Bytes of a chunk of documents are looked at together: a table lowers A-Z, another finds spaces, and
a prefix sum of ``T[byte] * R**position`` gives the hash of every word as a difference of two sums.
The hash of a word depends on its bytes only, so it is the same in every task and at every place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_R = 0xD1342543DE82EF95
_R_INVERSE = pow(_R, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _R), ("down", _R_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


@dataclass
class Chunk:
    """Some documents of a batch: their rows in it, bytes (A-Z lowered) and byte offsets."""

    first: int
    data: np.ndarray
    raw: np.ndarray
    offsets: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the longest runs of marked bytes; none reaches into two documents."""
        n = len(inside)
        begins = self.offsets[:-1][self.offsets[:-1] < n]
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        before[begins] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[max(n - 1, 0) :] = False
        after[: max(n - 1, 0)] = inside[1:]
        after[begins[begins > 0] - 1] = False
        return starts, np.flatnonzero(inside & ~after) + 1

    def words(self) -> Words:
        return self.tokens(~SPACE[self.data])

    def tokens(self, inside: np.ndarray) -> Words:
        starts, ends = self.runs(inside)
        return Words(self, starts, ends, np.searchsorted(starts, self.offsets))


@dataclass
class Words:
    """Words of a chunk: byte ranges, and for each document the range of its words."""

    chunk: Chunk
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        data = self.chunk.data
        up, down = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])


def chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a batch's text column into runs of whole documents; null counts as empty."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    if len(text) == 0:
        return
    buffers = text.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[text.offset : text.offset + len(text) + 1]
    whole = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(text):
        last = int(np.searchsorted(offsets, offsets[first] + chunk_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(text))
        raw = whole[offsets[first] : offsets[last]]
        yield Chunk(first, LOWER[raw], raw, offsets[first : last + 1] - offsets[first])
        first = last


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64())


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A list column whose i-th entry is values[bounds[i]:bounds[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), longs(values))
