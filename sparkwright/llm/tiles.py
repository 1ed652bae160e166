"""Texts cut into tiles that repeat: each distinct tile of a chunk is worked on once.

A tokenizer that never joins two neighbouring bytes may be run on both sides apart.
Tiles lie end to end in the bytes of a chunk, so they are found, compared and put
together again without a Python object a tile."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a chunk; a longer text is a chunk of its own.
CHUNK = 4 << 20
#: What a process remembers: tiles up to so many bytes, and so many bytes in all.
TILE, REMEMBERED = 64, 32 << 20


def bounds(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tile bounds (the last is the end) from ``cuts`` (positions in data) and the
    starts of texts, and the first tile of each text (and the number of tiles)."""
    mark = np.zeros(len(data) + 1, bool)
    mark[cuts] = True
    mark[offsets] = True
    at = np.flatnonzero(mark)
    return at, np.searchsorted(at, offsets)


def distinct(data: np.ndarray, at: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The distinct tiles, and which of them each tile is."""
    buffers = [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    found = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, buffers).dictionary_encode()
    return found.dictionary, found.indices.to_numpy()


def packed(values: np.ndarray, offsets: np.ndarray) -> pa.BinaryArray:
    """Slices of ``values`` as one binary value each."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])


def joined(parts: pa.BinaryArray, which: np.ndarray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``parts`` in the order of ``which``, end to end, and their offsets."""
    out = parts.take(pa.array(which))
    if isinstance(out, pa.ChunkedArray):
        out = out.combine_chunks()
    width = np.dtype(dtype).itemsize
    offsets = np.frombuffer(out.buffers()[1], np.int64)[out.offset : out.offset + len(out) + 1] if len(out) else np.zeros(1, np.int64)
    data = out.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return values.view(dtype) if len(values) else np.zeros(0, dtype), (offsets - offsets[0]) // width


def raw(part: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column."""
    offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1] if len(part) else np.zeros(1, np.int64)
    data = part.buffers()[2]
    base = int(offsets[0])
    return (np.frombuffer(data, np.uint8)[base : int(offsets[-1])] if data is not None else np.zeros(0, np.uint8)), offsets - base


class Memory:
    """Tiles of earlier chunks and their values, bounded in bytes: when full, those of the last chunk stay."""

    def __init__(self):
        self.tiles = self.values = pa.array([], pa.large_binary())

    def of(self, kinds: pa.BinaryArray, learn: Callable[[pa.BinaryArray], pa.BinaryArray]) -> pa.BinaryArray:
        """The value of each distinct tile; ``learn`` gives those of tiles not remembered."""
        found = pc.index_in(kinds, value_set=self.tiles)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        at = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        new = kinds.filter(pa.array(~known))
        at[~known] = len(self.tiles) + np.arange(len(new))
        tiles, values = pa.concat_arrays([self.tiles, new]), pa.concat_arrays([self.values, learn(new)])
        out = values.take(pa.array(at))
        keep = np.diff(raw(tiles)[1]) <= TILE
        if tiles.nbytes + values.nbytes > REMEMBERED:
            last = np.zeros(len(tiles), bool)
            last[at] = True
            keep &= last
        if not keep.all():
            tiles, values = tiles.filter(pa.array(keep)), values.filter(pa.array(keep))
        self.tiles, self.values = tiles, values
        return out
