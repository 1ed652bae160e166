"""Mixing sources to target weights in blocks of equal token counts.

Targets share a budget by weight, none above its cap. Sainte-Laguë apportionment
turns targets into whole blocks: each block goes to the highest quotient
target / (2 * blocks so far + 1). The words of a source lie end to end on an axis
(cells of documents in a seeded order) that is cut into blocks; a run of
``SHARD`` blocks is a shard, and the source's blocks are apportioned to its shards
in the same way. Within a shard a seeded permutation picks the blocks.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.llm.shared import Feistel, arrow_map, materialise, mix64, runs, slices, strings
from sparkwright.llm.wordhash import Words

#: Blocks of a shard, documents of a cell.
SHARD, CELL = 4096, 8192
#: Words of a block where none are given: the power of two that is at most this and
#: at most a ``PART``-th of the source's target.
LARGEST, PART = 2048, 128


def apportion(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Sainte-Laguë: seats by highest quotients votes / (2k + 1), at most ``caps``
    each; ties go to the earlier entry. A search for the divisor does all but a
    few seats at once."""
    votes, caps = np.asarray(votes, float), np.asarray(caps, np.int64)
    seats = int(min(seats, caps[votes > 0].sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)

    def at(divisor: float) -> np.ndarray:
        return np.minimum(caps, np.floor(np.minimum(votes / divisor, 4e18) + 0.5).astype(np.int64))

    low, high = 0.0, 4 * float(votes.max()) + 1
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (low, mid) if at(mid).sum() <= seats else (mid, high)
    out = at(high)
    queue = [(-votes[i] / (2 * out[i] + 1), i) for i in range(len(votes)) if votes[i] > 0 and out[i] < caps[i]]
    heapq.heapify(queue)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(queue)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(queue, (-votes[i] / (2 * out[i] + 1), i))
    return out


def targets(sizes: np.ndarray, weights: np.ndarray, budget: float, most: float) -> np.ndarray:
    """Shares of the budget by weight; a share above ``most`` times its size stops
    there and the excess goes to the others by weight, until none is above."""
    caps, out = most * sizes.astype(float), np.zeros(len(sizes))
    open_, left = sizes > 0, float(budget)
    while open_.any():
        share = left * weights / weights[open_].sum()
        over = open_ & (share > caps)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = caps[over]
        left -= caps[over].sum()
        open_ &= ~over
    return out


def spread(seats: int, blocks: int, most: int, shard: int) -> tuple[int, int, int]:
    """Sainte-Laguë among the shards of a source of ``blocks`` blocks, all of ``shard``
    blocks but the last: the seats of each full shard, how many of them (the first
    ones) get one more, and the seats of the last, shorter one. Full shards have equal
    votes, so their seats are counted together."""
    full, short = divmod(blocks, shard)
    if not full:
        return 0, 0, seats
    if not short:
        return seats // full, seats % full, 0
    each, last = seats * shard // blocks, seats * short // blocks
    spare = seats - each * full - last
    while spare:
        if last >= most * short or shard / (2 * each + 1) >= short / (2 * last + 1):
            if spare < full:
                break
            each, spare = each + 1, spare - full
        else:
            last, spare = last + 1, spare - 1
    return each, spare, last


def _plan(totals: DataFrame, weights: tuple, share: float, most: int, block: int | None) -> DataFrame:
    """source, source_size, target, block (words of each), blocks, and the blocks that each full shard
    (``each``, one more in the first ``extra``) and the last, shorter one get. One
    row a source, in code point order with null last."""

    def rows(batches):
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches).to_pydict()
        order = sorted(range(len(table["source"])), key=lambda i: (table["source"][i] is None, (table["source"][i] or "").encode()))
        names, sizes = [table["source"][i] for i in order], np.array([table["source_size"][i] for i in order], np.int64)
        w = np.array([weights[i % len(weights)] for i in range(len(names))], float)
        target = targets(sizes, w, share * sizes.sum(), most)
        words = np.full(len(sizes), block or 1, np.int64)
        if block is None:
            words <<= np.log2(np.clip(target / PART, 1, LARGEST)).astype(np.int64)
        blocks = -(-sizes // words)
        # Seats of the smallest block; a source with larger blocks has its seats' words in those.
        seat = int(words.min())
        seats = apportion(target, round(target.sum() / seat), most * -(-sizes // seat))
        quota = np.minimum((2 * seats * seat + words) // (2 * words), most * blocks)
        each, extra, last = [], [], []
        for n, q in zip(blocks.tolist(), quota.tolist(), strict=True):
            for column, value in zip((each, extra, last), spread(q, n, most, SHARD), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_pydict(
            {"source": names, "source_size": sizes, "target": target, "block": words, "blocks": blocks, "each": each, "extra": extra, "last": last},
            schema=pa.schema([("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), *((c, pa.int64()) for c in ("block", "blocks", "each", "extra", "last"))]),
        )

    return totals.repartition(1).mapInArrow(
        rows, "source string, source_size long, target double, block long, blocks long, each long, extra long, last long"
    )


class Taker:
    """How often each block of a source is taken, from its row of the plan."""

    def __init__(self, source: str | None, size: int, block: int, blocks: int, each: int, extra: int, last: int, seed: int):
        self.size, self.blocks, self.each, self.extra, self.last, self.block = size, blocks, each, extra, last, block
        name = b"\0" if source is None else b"\1" + source.encode()
        self.seed = seed ^ int.from_bytes(hashlib.blake2b(name, digest_size=7).digest(), "little")

    def times(self, j: np.ndarray) -> np.ndarray:
        full = self.blocks // SHARD
        shard, i = j // SHARD, j % SHARD
        out = np.zeros(len(j), np.int64)
        for whole in (True, False):
            at = np.flatnonzero((shard < full) == whole)
            if not len(at):
                continue
            n = SHARD if whole else self.blocks % SHARD
            quota = self.each + (shard[at] < self.extra) if whole else np.full(len(at), self.last)
            # Turned by a hash of the shard, so that shards do not repeat one pattern.
            turn = (mix64(shard[at].astype(np.uint64) + np.uint64(self.seed & 0xFFFFFFFF)) % np.uint64(n)).astype(np.int64)
            drawn = Feistel(n, self.seed)((i[at] + turn) % n)
            out[at] = quota // n + (drawn < quota % n)
        return out

    def spans(self, start: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words start..start+size of the axis: first word and end of each block's part, from the first word on, and its times."""
        j = np.arange(start // self.block, (start + size - 1) // self.block + 1)
        return np.maximum(j * self.block - start, 0), np.minimum((j + 1) * self.block - start, size), self.times(j)


def _placed(docs: DataFrame, weights: tuple, share: float, most: int, block: int | None, seed: int) -> DataFrame:
    """``docs`` (with id, size, text_hash, source) with their place on the axis of
    their source and the source's plan.

    Rows that agree in id and text are interchangeable. The sums over cells are one
    row a ``CELL`` documents, the plan is one row a source: both meet in one task (a
    source's, or all), which bounds the sources to some millions."""
    totals = materialise(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "totals")
    cells = max(1, -(-int(totals.agg(F.sum("rows")).first()[0] or 0) // CELL))
    plan = materialise(_plan(totals.select("source", "source_size"), weights, share, most, block), "plan")
    h = F.xxhash64("id", F.lit(seed))
    # A key that is never null: the window and the join then share one partitioning.
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    docs = docs.withColumn("h", h).withColumn("cell", F.pmod("h", F.lit(cells))).withColumn("named", named)
    sums = docs.groupBy("named", "cell").agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("named").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(sums.select("named", "cell", F.coalesce(F.sum("cell_size").over(before), F.lit(0)).alias("cell_start")), "cells")
    lead = materialise(starts.join(plan.withColumn("named", named).drop("source"), "named"), "lead")
    inside = Window.partitionBy("named", "cell").orderBy("h", "id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(lead, ["named", "cell"]).withColumn("start", F.col("cell_start") + F.col("inside"))


_PLAN = ["source", "source_size", "block", "blocks", "each", "extra", "last"]


def _takers(batch: pa.RecordBatch, seed: int):
    """For each source in a batch its taker and the batch's rows."""
    get = lambda name: batch.column(batch.schema.get_field_index(name))
    groups: dict = {}
    for i, s in enumerate(get("source").to_pylist()):
        groups.setdefault(s, []).append(i)
    for source, at in groups.items():
        row = [get(c)[at[0]].as_py() for c in _PLAN[1:]]
        yield Taker(source, *row, seed), at


def word_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, size (words), text_hash, source."""

    def rows(batch: pa.RecordBatch):
        data, offsets = strings(batch.column(1))
        counts = [Words(data, offsets[lo : hi + 1]).count for lo, hi in runs(offsets)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts).astype(np.int64)), batch.column(2), batch.column(3)], names=["id", "size", "text_hash", "source"])

    text = F.col(text_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), F.col(source_col).cast("string").alias("source"))
    return arrow_map(narrow, rows, "id long, size long, text_hash long, source string")


def mix(
    docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: int = 2, block: int | None = 8, seed: int = 11,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per row: id_col, size, source_size, target, taken, source.

    Sources in code point order, null last, take the weights in turn. A null text
    has size 0 and is not taken; a null source is a source like any other; rows
    that repeat an id are documents of their own; an empty table gives an empty
    result. Each source's taken words are within about ``block`` of its target; where
    that is None, a source has blocks of at most a ``PART``-th of its target."""
    sized = materialise(word_counts(docs, id_col, text_col, source_col), "sizes")

    def rows(batch: pa.RecordBatch):
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        start, size = get("start").to_numpy(), get("size").to_numpy()
        taken = np.zeros(batch.num_rows, np.int64)
        for taker, at in _takers(batch, seed):
            at = np.array([i for i in at if size[i]], np.int64)
            if not len(at):
                continue
            block = taker.block
            first, last = start[at] // block, (start[at] + size[at] - 1) // block
            n = last - first + 1
            row = np.repeat(np.arange(len(at)), n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row]
            part = np.minimum((j + 1) * block, (start[at] + size[at])[row]) - np.maximum(j * block, start[at][row])
            np.add.at(taken, at[row], part * taker.times(j))
        yield pa.RecordBatch.from_arrays([*(get(c) for c in ("id", "size", "source_size", "target")), pa.array(taken), get("source")], names=["id", "size", "source_size", "target", "taken", "source"])

    placed = _placed(sized, weights, share, most, block, seed).select("id", "size", "start", "target", *_PLAN)
    out = arrow_map(placed, rows, "id long, size long, source_size long, target double, taken long, source string")
    return out.withColumnRenamed("id", id_col)


def mixed_rows(
    docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: int = 2, block: int | None = None, seed: int = 11,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars",
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time that words
    of a document are taken. A row whose words are all taken has its text unchanged;
    otherwise the text runs over the words taken, stretch by stretch, a line feed
    between stretches, and ``length_col`` counts its code points. ``block`` as in ``mix``.
    A text without words, null or not, is not taken; texts of any length are cut whole
    blocks at a time; an empty table gives an empty result."""
    names = docs.columns
    at_text = names.index(text_col)
    length = names.index(length_col) if length_col in names else None
    whole = docs.withColumnsRenamed({c: f"c{i}" for i, c in enumerate(names)})

    def count(batches):
        for batch in (part for b in batches for part in slices(b, at_text)):
            data, offsets = strings(batch.column(at_text))
            sizes = [Words(data, offsets[lo : hi + 1]).count for lo, hi in runs(offsets)]
            sizes = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes)], names=[*batch.schema.names, "size"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema)
    sized = whole.mapInArrow(count, f"{kinds}, size long")
    sized = sized.withColumn("id", F.col(f"c{names.index(id_col)}").cast("long")).withColumn("text_hash", F.xxhash64(f"c{at_text}")).withColumn("source", F.col(f"c{names.index(source_col)}").cast("string"))

    def rows(batch: pa.RecordBatch):
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        start, size = get("start").to_numpy(), get("size").to_numpy()
        picked, texts = [], []
        column = get(f"c{at_text}")
        for taker, at in _takers(batch, seed):
            for i in at:
                if not size[i]:
                    continue
                lo, hi, times = taker.spans(int(start[i]), int(size[i]))
                words = None
                for turn in range(1, most + 1):
                    on = times >= turn
                    if not on.any():
                        break
                    text = column[i].as_py()
                    if not on.all():
                        if words is None:
                            data = text.encode()
                            words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
                        text = "\n".join(data[words.start[lo[a]] : words.end[hi[b - 1] - 1]].decode() for a, b in zip(edge[::2], edge[1::2], strict=True))
                    picked.append(i)
                    texts.append(text)
        kept = batch.take(pa.array(picked, pa.int64()))
        columns = [kept.column(kept.schema.get_field_index(f"c{k}")) for k in range(len(names))]
        before = columns[at_text].to_pylist()
        columns[at_text] = pa.array(texts, columns[at_text].type)
        if length is not None:
            columns[length] = pa.array([n if a == b else len(b) for n, a, b in zip(columns[length].to_pylist(), before, texts, strict=True)], columns[length].type)
        yield pa.RecordBatch.from_arrays(columns, names=names)

    placed = _placed(sized, weights, share, most, block, seed).select(*(f"c{k}" for k in range(len(names))), "size", "start", *_PLAN)
    return placed.mapInArrow(lambda batches: (x for b in batches for part in slices(b, at_text) for x in rows(part)), docs.schema)
