"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled into machines over bytes, with weights in the tropical
semiring (min, +):

* the normaliser, a transducer that rewrites the longest match of the compiled
  character map (or copies one character), and puts, strips and merges spaces;
* the lexicon, a trie whose arcs read bytes and whose final states write a piece.
  Where the text has a character that no piece is, an arc reads it and writes its
  UTF-8 byte pieces (or the unknown piece), at the unknown's weight;
* an acceptor of piece sequences. For unigram models it has one state, and a piece
  weighs minus its score. For merging (BPE) models its states are the pieces and an
  arc from one to the next weighs 0 if merging leaves that pair alone, infinity if
  it does not. A segmentation is the one that merging reaches exactly when all its
  adjacent pairs are left alone, so the shortest path is the model's own encoding.
  Arcs are expanded when a path first asks for them: the derivations of both pieces
  are unwound along their shared edge, latest merge first, and a merge across the
  edge that would have come earlier closes the arc.

An input is composed with the machines and the shortest path is taken over the
states (position, last piece), for all distinct tiles of a chunk of texts at once:
no piece holds the two bytes at which tiles meet, so paths through tiles join to
paths through texts. Nothing is kept between chunks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm import tiles
from sparkwright.llm.shared import arrow_map, runs, strings

SPACE = "▁"
#: Piece types of the model format: normal, unknown, control, user-defined, unused, byte.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Model types: unigram, merging.
UNIGRAM, MERGING = 1, 2
#: What an unknown character weighs beyond the least likely piece.
PENALTY = 10.0
#: Tiles up to so many bytes are searched side by side, longer ones one by one.
SHORT = 64
NEVER = 1 << 40


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
        elif kind == 1:
            at += 8
            yield number, data[at - 8 : at]
        elif kind == 5:
            at += 4
            yield number, data[at - 4 : at]
        else:
            n = varint()
            at += n
            yield number, data[at - n : at]


class Arcs:
    """The arcs of a machine: a fixed map of 64-bit keys (0 or more) to values, by
    open addressing. -1 where there is none."""

    def __init__(self, keys, values):
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int64)
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]] = keys[todo[won]], values[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            there, key = self.keys[at], keys[todo]
            hit = there == key
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (there >= 0)
            todo, at = todo[go], at[go]
        return out


class Rewriter:
    """The normaliser's character map: states are nodes of the double array in the
    model file, a final state writes a string."""

    def __init__(self, data: bytes):
        size = struct.unpack_from("<I", data)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", data, 4)
        self.out = data[4 + size :]
        self.seen: dict[bytes, tuple[bytes, int]] = {}

    def longest(self, text: bytes, at: int) -> tuple[bytes, int]:
        """What is written for the longest match from ``at`` on, and its length; 0 for none."""
        units, found, length = self.units, -1, 0
        jump = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = jump(units[0])
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units) or (units[node] & 0x800000FF) != text[k]:
                break
            unit = units[node]
            node ^= jump(unit)
            if unit >> 8 & 1:
                found, length = units[node] & 0x7FFFFFFF, k + 1 - at
        return (self.out[found : self.out.index(b"\0", found)], length) if length else (b"", 0)


def _char(lead: int) -> int:
    """Bytes of the character that starts with ``lead``."""
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


_CHAR = np.array([_char(b) for b in range(256)])


class PieceModel:
    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.dummy_prefix, self.strip_spaces, self.rewriter = True, True, None
        kind, bytes_on, escape, suffix = UNIGRAM, False, True, False
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                kind, suffix, bytes_on = spec.get(3, UNIGRAM), bool(spec.get(24, 0)), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                self.rewriter = Rewriter(spec[2]) if spec.get(2) else None
                self.dummy_prefix, self.strip_spaces, escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if kind not in (UNIGRAM, MERGING) or not escape or suffix or USER in self.types or UNUSED in self.types:
            raise ValueError("only unigram and merging models with escaped, leading spaces and no user-defined or unused pieces are supported")
        self.merging = kind == MERGING
        self.unknown = self.types.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE} if bytes_on or BYTE in self.types else {}
        self._lexicon()
        if self.merging:
            self._acceptor()
        self._cutter()
        spelt = [p.replace(SPACE, " ").encode() if t == NORMAL else bytes([int(p[3:5], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else b"" for p, t in zip(self.pieces, self.types, strict=True)]
        #: The decoder, a transducer of one state: what each id writes.
        self.spelt = pa.array(spelt, pa.large_binary())

    # Machines ---------------------------------------------------------------------

    def _lexicon(self) -> None:
        """Symbols: the normal pieces, then characters that pieces hold but that are
        none themselves, then one for all other characters."""
        normal = [(p.replace(SPACE, " "), i) for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL]
        self.symbols = [p for p, _ in normal]
        known = set(self.symbols)
        # In a merging model such a character takes part in merges.
        self.symbols += sorted({c for p in known for c in p} - known) if self.merging else []
        self.other = len(self.symbols)
        self.writes = np.array([i for _, i in normal] + [-1] * (self.other - len(normal) + 1))
        states = {b"": 0}
        keys, ends, final = [], [], {}
        for k, p in enumerate(self.symbols):
            spelt = p.encode()
            for n in range(1, len(spelt) + 1):
                if spelt[:n] not in states:
                    states[spelt[:n]] = len(states)
                    keys.append(states[spelt[: n - 1]] << 8 | spelt[n - 1])
                    ends.append(states[spelt[:n]])
            final[states[spelt]] = k
        self.trie = Arcs(keys, ends)
        self.final = np.full(len(states), -1)
        self.final[list(final)] = list(final.values())
        scores = np.array([self.scores[i] for _, i in normal], np.float32)
        low = float(scores.min()) if len(scores) else 0.0
        #: The tropical weight of each symbol, and of an unknown character.
        self.weight = np.concatenate((-scores.astype(float), np.full(self.other - len(normal) + 1, -(low - PENALTY))))

    def _acceptor(self) -> None:
        """The last merge of each piece (``left``, ``right``), shorter pieces first; a
        piece that merging never makes is taken out of the lexicon."""
        n, at = self.other + 1, {p: k for k, p in enumerate(self.symbols)}
        long = [k for k, p in enumerate(self.symbols) if len(p) > 1]
        #: When a piece is merged, equal for equal scores; characters are there from the start.
        self.rank = np.full(n, -1)
        self.rank[long] = np.unique([-self.scores[self.writes[k]] for k in long], return_inverse=True)[1]
        cuts = [(k, at[p[:j]], at[p[j:]]) for k in long for p in (self.symbols[k],) for j in range(1, len(p)) if p[:j] in at and p[j:] in at]
        whole, a, b = np.array(cuts, np.int64).reshape(-1, 3).T
        self.merges = Arcs(a * n + b, self.rank[whole])
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        length = np.array([len(p) for p in self.symbols] + [1])
        made = length == 1
        for size in range(2, int(length.max()) + 1):
            these = np.flatnonzero((length[whole] == size) & (self.rank[a] <= self.rank[whole]) & (self.rank[b] <= self.rank[whole]))
            these = these[made[a[these]] & made[b[these]]]
            these = these[self._alone(a[these], b[these], self.rank[whole[these]])]
            self.left[whole[these]], self.right[whole[these]], made[whole[these]] = a[these], b[these], True
        never = np.flatnonzero(~made)
        self.final[np.isin(self.final, never)] = -1

    def _alone(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether no merge across the edge of each pair comes before ``limit``, the
        rank of the merge that ends the pair. Of equal ranks the one further left
        comes first."""
        ok, n = np.ones(len(left), bool), self.other + 1
        at, a, b = np.arange(len(left)), left, right
        while len(at):
            across = self.merges.of(a * n + b)
            closed = (across >= 0) & (across < limit)
            ok[at[closed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = np.flatnonzero(~closed & ((ra >= 0) | (rb >= 0)))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def _cutter(self) -> None:
        """Which neighbouring bytes no piece joins; a character is never cut."""
        joins = np.zeros((256, 256), bool)
        joins[:, 0x80:0xC0] = True
        for p in self.symbols:
            spelt = np.frombuffer(p.encode(), np.uint8)
            joins[spelt[:-1], spelt[1:]] = True
        self.joins = joins.ravel()

    # Normaliser ---------------------------------------------------------------------

    def normalise(self, text: str) -> bytes:
        """The text as the lexicon reads it; a space stands for the space mark."""
        raw = text.encode()
        if self.rewriter:
            out, at = [], 0
            while at < len(raw):
                put, n = self.rewriter.longest(raw, at)
                if not n:
                    n = _char(raw[at])
                    put = raw[at : at + n]
                out.append(put)
                at += n
            raw = b"".join(out)
        raw = raw.replace(SPACE.encode(), b" ") if not self.strip_spaces else raw
        if self.strip_spaces:
            # Marks that the text itself holds are not stripped or merged.
            raw = b" ".join(w for w in raw.split(b" ") if w).replace(SPACE.encode(), b" ")
        return (b" " if self.dummy_prefix and raw else b"") + raw

    def _normalised(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        if self.rewriter or self.strip_spaces or SPACE.encode() in data.tobytes():
            texts = [self.normalise(data[a:b].tobytes().decode(errors="replace")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        if not self.dummy_prefix:
            return data, offsets
        filled = offsets[1:] > offsets[:-1]
        return np.insert(data, offsets[:-1][filled], 0x20), offsets + np.concatenate(([0], np.cumsum(filled)))

    # Composition and shortest path -----------------------------------------------------

    def _lattice(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs (from, to, symbol) of the input composed with the lexicon, from every
        character on; ``stop`` is the end of the tile of each byte."""
        pos = np.flatnonzero((data & 0xC0) != 0x80)
        at, state, n = pos, np.zeros(len(pos), np.int64), 0
        src, dst, sym = [], [], []
        while len(at):
            state = self.trie.of(state << 8 | data[at + n])
            live = state >= 0
            at, state, n = at[live], state[live], n + 1
            k = self.final[state]
            hit = k >= 0
            src.append(at[hit])
            dst.append(at[hit] + n)
            sym.append(k[hit])
            more = at + n < stop[at]
            at, state = at[more], state[more]
        src, dst, sym = (np.concatenate(c) for c in (src, dst, sym)) if src else (np.zeros(0, np.int64),) * 3
        # An arc of its own for each character that is no symbol.
        size = np.minimum(_CHAR[data[pos]], stop[pos] - pos)
        single = np.zeros(len(data), bool)
        single[src[dst - src == _CHAR[data[src]]]] = True
        lone = ~single[pos]
        return np.concatenate((src, pos[lone])), np.concatenate((dst, (pos + size)[lone])), np.concatenate((sym, np.full(int(lone.sum()), self.other)))

    def _paths(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the shortest path through each tile (bounds ``at``), end to end, and their offsets."""
        length = np.diff(at)
        tile = np.repeat(np.arange(len(length)), length)
        src, dst, sym = self._lattice(data, at[1:][tile])
        # The best arc into each position so far: its weight, symbol and start. Tiles
        # have a position more than bytes, so positions are counted anew.
        base = at[:-1] + np.arange(len(length))
        src, dst = src + tile[src], dst + tile[src]
        cost = np.full(len(data) + len(length), np.inf)
        cost[base] = 0
        last, back = np.full(len(cost), -1), np.full(len(cost), -1)
        rows = np.repeat(np.arange(len(length)), length + 1)
        wave = src - base[rows[src]]
        long = length[rows[src]] > SHORT
        order = np.flatnonzero(~long)
        order = order[np.argsort(wave[order], kind="stable")]
        edges = np.searchsorted(wave[order], np.arange(SHORT + 2))
        for k in range(SHORT + 1):
            arcs = order[edges[k] : edges[k + 1]]
            if len(arcs):
                self._relax(src[arcs], dst[arcs], sym[arcs], cost, last, back)
        if long.any():
            self._one_by_one(src, dst, sym, np.flatnonzero(long), cost, last, back)
        return self._read_back(data, at, base, length, cost, last, back)

    def _relax(self, src, dst, sym, cost, last, back) -> None:
        """Tropical relaxation of arcs that start at one position of their tiles."""
        live = np.isfinite(cost[src])
        if self.merging:
            live &= ~np.isfinite(cost[dst])
        src, dst, sym = src[live], dst[live], sym[live]
        if self.merging:
            inner = np.flatnonzero(last[src] >= 0)
            pairs, which = np.unique(last[src[inner]] * (self.other + 1) + sym[inner], return_inverse=True)
            a, b = np.divmod(pairs, self.other + 1)
            open_ = np.ones(len(src), bool)
            open_[inner] = self._alone(a, b, np.full(len(a), NEVER))[which]
            take, total = open_, cost[src]
        else:
            total = cost[src] + self.weight[sym]
            take = total < cost[dst]
        src, dst, sym = src[take], dst[take], sym[take]
        cost[dst], last[dst], back[dst] = total[take], sym, src

    def _one_by_one(self, src, dst, sym, arcs, cost, last, back) -> None:
        """The same for long tiles, arc by arc in the order of starts."""
        arcs = arcs[np.lexsort((dst[arcs], src[arcs]))]
        weights: dict[tuple[int, int], bool] = {}
        for s, e, k in zip(src[arcs].tolist(), dst[arcs].tolist(), sym[arcs].tolist(), strict=True):
            if cost[s] == np.inf:
                continue
            if not self.merging:
                total = cost[s] + self.weight[k]
                if total < cost[e]:
                    cost[e], last[e], back[e] = total, k, s
            elif cost[e] == np.inf:
                pair = (int(last[s]), k)
                if pair[0] >= 0 and pair not in weights:
                    weights[pair] = bool(self._alone(*(np.array([x]) for x in (*pair, NEVER)))[0])
                if pair[0] < 0 or weights[pair]:
                    cost[e], last[e], back[e] = 0, k, s

    def _read_back(self, data, at, base, length, cost, last, back):
        """Follow the paths from the ends of all tiles at once."""
        here, tile = base + length, np.arange(len(length))
        ends, tiles_, symbols = [], [], []
        while True:
            on = here > base[tile]
            here, tile = here[on], tile[on]
            if not len(here):
                break
            if (back[here] < 0).any():
                raise ValueError("no path of finite weight")
            ends.append(here)
            tiles_.append(tile)
            symbols.append(last[here])
            here = back[here]
        if not ends:
            return np.zeros(0, np.int32), np.zeros(len(length) + 1, np.int64)
        ends, tiles_, symbols = (np.concatenate(c) for c in (ends, tiles_, symbols))
        order = np.argsort(ends, kind="stable")
        ends, tiles_, symbols = ends[order], tiles_[order], symbols[order]
        ids, count = self.writes[symbols], np.ones(len(ends), np.int64)
        lone = np.flatnonzero(ids < 0)
        if len(lone) and self.byte_ids:
            count[lone] = ends[lone] - back[ends[lone]]
            to = np.zeros(256, np.int64)
            to[list(self.byte_ids)] = list(self.byte_ids.values())
            full = np.repeat(ids, count)
            first = (np.cumsum(count) - count)[lone]
            inner = np.arange(int(count[lone].sum())) - np.repeat(np.cumsum(count[lone]) - count[lone], count[lone])
            start = back[ends[lone]] - tiles_[lone]
            full[np.repeat(first, count[lone]) + inner] = to[data[np.repeat(start, count[lone]) + inner]]
            ids = full
        elif len(lone):
            ids = np.where(ids < 0, self.unknown, ids)
        return ids.astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(tiles_, count, len(length)).astype(np.int64))))

    # Texts ---------------------------------------------------------------------------

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (UTF-8, end to end, bounds ``offsets``), and their offsets."""
        data, offsets = self._normalised(data, offsets)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cuts = 1 + np.flatnonzero(~self.joins[data[:-1].astype(np.uint16) << 8 | data[1:]])
        at, first = tiles.bounds(data, offsets, cuts)
        kinds, which = tiles.distinct(data, at)
        ids, ends = tiles.joined(tiles.packed(*self._paths(*tiles.raw(kinds))), which, np.int32)
        starts = ends[first]
        if not self.byte_ids and len(ids):
            # A run of unknown characters is one unknown piece.
            again = np.concatenate(([False], (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)))
            again[starts[:-1][starts[:-1] < len(ids)]] = False
            starts = starts - np.concatenate(([0], np.cumsum(again)))[starts]
            ids = ids[~again]
        return ids, starts

    def encode(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_chunk(raw, np.array([0, len(raw)]))[0]

    def decode(self, ids) -> str:
        """What the ids write: bytes that are no UTF-8 become U+FFFD, the leading space goes."""
        return self.decode_fast(np.asarray(ids, np.int64))

    def decode_fast(self, ids: np.ndarray) -> str:
        text = b"".join(self.spelt.take(pa.array(ids, pa.int64())).to_pylist()).decode(errors="replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One compiled model a process and file."""
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = PieceModel(f.read())
    return _models[path]


def encode_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id_col, n_pieces, ids_crc32 (ids as little-endian unsigned 32-bit
    integers), decoded_crc32 and decoded_bytes (of the decoded text, UTF-8),
    round_trip (whether decoding gives the text back) and, if asked for, piece_ids.

    A null text counts as empty, which has no pieces; a text of any length is encoded
    whole. A text that itself holds U+2581 comes back with spaces there, as the format
    has it (round_trip false). Ids are passed through, null or repeated; other columns
    are not looked at. An empty table gives an empty result."""

    def rows(batch: pa.RecordBatch):
        wfst = model(path)
        data, offsets = strings(batch.column(1))
        for lo, hi in runs(offsets, tiles.CHUNK, 1 << 20):
            ids, at = wfst.encode_chunk(data, offsets[lo : hi + 1])
            back, ends = tiles.joined(wfst.spelt, ids, np.uint8)
            ends = ends[at]
            sums, back_sums, sizes, same = [], [], [], []
            for k, row in enumerate(range(lo, hi)):
                text = data[offsets[row] : offsets[row + 1]]
                a, b = int(ends[k]), int(ends[k + 1])
                if wfst.dummy_prefix and b > a and back[a] == 0x20:
                    a += 1
                decoded = back[a:b]
                equal = np.array_equal(decoded, text)
                if not equal:  # it may hold bytes that are no UTF-8
                    decoded = np.frombuffer(decoded.tobytes().decode(errors="replace").encode(), np.uint8)
                sums.append(zlib.crc32(ids[at[k] : at[k + 1]]))
                back_sums.append(zlib.crc32(np.ascontiguousarray(decoded)))
                sizes.append(len(decoded))
                same.append(equal)
            columns = [batch.column(0).slice(lo, hi - lo), *(pa.array(c, pa.int64()) for c in (np.diff(at), sums, back_sums, sizes)), pa.array(same, pa.bool_())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "n_pieces", "ids_crc32", "decoded_crc32", "decoded_bytes", "round_trip"] + ["piece_ids"] * with_ids
    schema = "id long, n_pieces long, ids_crc32 long, decoded_crc32 long, decoded_bytes long, round_trip boolean" + ", piece_ids array<int>" * with_ids
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), rows, schema).withColumnRenamed("id", id_col)
