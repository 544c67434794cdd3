"""Vectorised word handling over the UTF-8 bytes of a batch of texts.

A batch is one byte array plus document offsets. All functions work on whole
texts; temporaries are bounded by SLICE bytes however long one text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = 1024
_PLACE = _rng.integers(1, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def to_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def pieces(table: pa.Table | pa.RecordBatch, name: str = "text", size: int = 2 * SLICE) -> Iterator[pa.Table | pa.RecordBatch]:
    """Slices of whole rows with about size bytes of text, one row at least."""
    n = table.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(table.column(name)), 0).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else np.concatenate([pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False) for c in table.column(name).chunks])
    total = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < n:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + size, "right")))
        yield table.slice(at, to - at)
        at = to


def spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (n + 1 values)."""
    word = ~SPACE[buf]
    cut = offs[(offs > 0) & (offs < len(buf))]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[cut] = word[cut]
    last = word
    inner = last[1:].copy()
    last = last.copy()
    last[:-1] &= ~inner
    last[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _S33)
    h *= _M1
    h ^= h >> _S33
    h *= _M2
    h ^= h >> _S33
    return h


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span; spans are ordered and don't overlap.

    A span of up to PLACES bytes is a sum over its bytes of random odd numbers, one for
    the byte times one for its place; a longer one is hashed by XXH64.
    """
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    long = np.flatnonzero(lengths > PLACES)
    if len(long):
        short = np.flatnonzero(lengths <= PLACES)
        view = memoryview(np.ascontiguousarray(buf))
        out[long] = [xxhash.xxh64_intdigest(view[a:b], 1) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        out[short] = hash_spans(buf, starts[short], ends[short])
        return out
    total = np.cumsum(lengths)
    at = 0
    while at < len(starts):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + SLICE, "right")))
        own = lengths[at:to]
        begin = np.cumsum(own) - own
        place = np.arange(int(own.sum())) - np.repeat(begin, own)
        value = _BYTE[buf[place + np.repeat(starts[at:to], own)]]
        value *= _PLACE[place]
        out[at:to] = np.add.reduceat(value, begin)
        at = to
    return mix(out + lengths.astype(np.uint64) * _M2)


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from that of its front and that of its last item."""
    return mix((left ^ (left >> np.uint64(29))) * _M1 + right)


def unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the index of some occurrence of each, and the place of each key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse
