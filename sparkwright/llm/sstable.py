"""Sorted-string-table files of documents, keyed by identifier.

A file holds data blocks, a block index, a Bloom filter and a footer:

* data block: entries in key order, each ``varint shared, varint rest, varint
  length of value, rest of key, value``; a key shares its first ``shared`` bytes
  with the key before, and every 16th entry starts anew (a restart). Restart
  offsets (u32) and their count end the block. Blocks are zlib-compressed and
  carry a CRC-32.
* index: for each block its last key, offset, stored length and entry count.
* Bloom filter: 10 bits a key, 7 probes.
* footer (fixed length): offsets and lengths of both, entries, ids, id width, magic.

Keys sort as bytes in the order of the ids: 0x00 for null, else 0x01 and the id
as a big-endian 64-bit value with its sign bit flipped. A key may repeat.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Callable, Iterator

import xxhash

RESTART, BLOCK_BYTES, BLOOM_BITS, BLOOM_PROBES = 16, 1 << 16, 10, 7
MAGIC = b"SWSSTAB1"
FOOTER = struct.Struct("<QQQQQQII8s")


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & ((1 << 64) - 1) | 1
    return [((a + i * b) & ((1 << 64) - 1)) % bits for i in range(BLOOM_PROBES)]


class Writer:
    """Writes to ``out`` (anything with write()), keys in ascending order."""

    def __init__(self, out, id_width: int):
        self.out, self.id_width = out, id_width
        self.at = self.entries = self.ids = 0
        self.index: list[bytes] = []
        self.hashes: list[bytes] = []
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.restarts, self.count, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.hashes or self.hashes[-1] != key:
            self.hashes.append(key)
        self.last, self.count = key, self.count + 1
        self.entries += 1
        self.ids += len(value) // self.id_width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.count:
            return
        self.block += struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        stored = zlib.compress(bytes(self.block), 1)
        stored += struct.pack("<I", zlib.crc32(stored))
        self.out.write(stored)
        self.index.append(struct.pack("<H", len(self.last)) + self.last + struct.pack("<QII", self.at, len(stored), self.count))
        self.at += len(stored)
        self._fresh()

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, len(self.hashes) * BLOOM_BITS)
        bloom = bytearray((bits + 7) // 8)
        for key in self.hashes:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index + bytes(bloom))
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), bits, self.entries, self.ids, self.id_width, zlib.crc32(index + bytes(bloom)), MAGIC))


class Reader:
    """Reads through ``read_at(offset, length)`` of a file of ``size`` bytes."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at = read_at
        at, length, bloom_at, self.bits, self.entries, self.ids, self.id_width, crc, magic = FOOTER.unpack(read_at(size - FOOTER.size, FOOTER.size))
        tail = read_at(at, length + (self.bits + 7) // 8)
        if magic != MAGIC or bloom_at != at + length or zlib.crc32(tail) != crc:
            raise ValueError("not a table file, or a damaged one")
        index, self.bloom = tail[:length], tail[length:]
        self.last_keys: list[bytes] = []
        self.places: list[tuple[int, int, int]] = []
        k = 0
        while k < len(index):
            n = struct.unpack_from("<H", index, k)[0]
            self.last_keys.append(index[k + 2 : k + 2 + n])
            self.places.append(struct.unpack_from("<QII", index, k + 2 + n))
            k += 2 + n + 16

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        at, length, _ = self.places[k]
        stored = self.read_at(at, length)
        if zlib.crc32(stored[:-4]) != struct.unpack("<I", stored[-4:])[0]:
            raise ValueError("a damaged block")
        data = zlib.decompress(stored[:-4])
        n = struct.unpack("<I", data[-4:])[0]
        return data[: -4 * (n + 1)], list(struct.unpack(f"<{n}I", data[-4 * (n + 1) : -4]))

    @staticmethod
    def _entries(data: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + length]
            at += length

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.places)):
            yield from self._entries(self._block(k)[0])

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key: Bloom filter, binary search of the index, then of
        the restarts of a block, then a scan of at most a few entries."""
        found: list[bytes] = []
        if not self.may_have(key):
            return found
        k = bisect.bisect_left(self.last_keys, key)
        while k < len(self.places):
            data, restarts = self._block(k)
            lo, hi = 0, len(restarts) - 1
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if next(self._entries(data, restarts[mid]))[0] < key:
                    lo = mid
                else:
                    hi = mid - 1
            for at, value in self._entries(data, restarts[lo] if restarts else 0):
                if at == key:
                    found.append(value)
                elif at > key:
                    return found
            k += 1
            if k < len(self.places) and self.last_keys[k - 1] != key:
                return found
        return found
