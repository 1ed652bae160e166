"""Token ids of whole texts by a public byte-level BPE tokenizer, each distinct tile
of a chunk encoded once.

The tokenizer cuts a text by a fixed pattern before it merges anything, and looks
only ahead when it does. Texts are cut where that pattern is bound to: before white
space that follows anything else, and between ASCII letters and ASCII marks (but not
after an apostrophe, which may begin a contraction). Texts that hold an added token's
content, which the tokenizer finds before it cuts, are encoded whole, and so is every
text where the file names another pattern or a normaliser."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sparkwright.llm import tiles

_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
_MARK = np.isin(np.arange(256), [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
#: Whether a cut between two bytes is safe whatever comes before them.
_CUT = ((np.isin(np.arange(256), range(0x21, 0x7F))[:, None] & _WHITE) | (_LETTER[:, None] & _MARK) | ((_MARK & (np.arange(256) != 0x27))[:, None] & _LETTER)).ravel()
#: Last two bytes of the white space beyond ASCII (U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000).
_WIDE = np.zeros(1 << 16, bool)
_WIDE[[0xC285, 0xC2A0, 0x9A80, *range(0x8080, 0x808B), 0x80A8, 0x80A9, 0x80AF, 0x819F]] = True


def _cuts(data: np.ndarray) -> np.ndarray:
    """Positions before which the pattern always cuts."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    pair = data[:-1].astype(np.uint16) << 8 | data[1:]
    cut = _CUT[pair]
    # White space after a character beyond ASCII that is none itself.
    cut[1:] |= _WHITE[data[2:]] & (data[1:-1] >= 0x80) & ~_WIDE[pair[:-1]]
    return 1 + np.flatnonzero(cut)


class PieceEncoder:
    """Encodes with the ``tokenizers`` library; ids as little-endian bytes of ``width`` each."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.memory = tiles.Memory()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.cuttable = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and spec.get("normalizer") is None

    def _learn(self, parts: pa.Array) -> pa.BinaryArray:
        """Ids of distinct tiles."""
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        ids, sizes = [], []
        for lo in range(0, len(parts), 4096):
            for e in batch(parts.slice(lo, 4096).cast(pa.large_string()).to_pylist(), add_special_tokens=False):
                found = e.ids
                ids += found
                sizes.append(len(found))
        return tiles.packed(np.array(ids, self.dtype), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))))

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (UTF-8, end to end, bounds ``offsets``), and their offsets."""
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        cuts = _cuts(data) if self.cuttable else np.zeros(0, np.int64)
        texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if whole.any():
            cuts = cuts[~whole[np.searchsorted(offsets, cuts, "right") - 1]]
        at, first = tiles.bounds(data, offsets, cuts)
        kinds, which = tiles.distinct(data, at)
        ids, ends = tiles.joined(self.memory.of(kinds, self._learn), which, self.dtype)
        return ids, ends[first]

    def encode(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        ids, at = self.encode_chunk(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64))))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder a process and file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
