"""Exact top-k inner products by dual-tree search over cover trees.

Queries and data are dealt to the nearest of a few pivots (farthest-first points of
a bounded sample) and packed in that order, so that blocks of queries and chunks of
data are compact. Each has a cover tree. For a query node Q and a data node P no
inner product exceeds

    <cq, cp> + |cq| rp + |cp| rq + rq rp,

so a pair is pruned when that stays below the worst kth score among the queries of
Q: first whole chunks, before any data is moved, then pairs of nodes. Each query
starts from its kth score on the sample, and a task carries kth scores from chunk to
chunk, the most promising first. Points that are left are compared with integer
arithmetic. Each task returns at most k rows a query and chunk; the best k of all
follow from one bounded ranking.
"""

from __future__ import annotations

import pickle
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.llm.shared import arrow_map, materialise

#: Vectors of a chunk, queries of a block, points of a leaf.
CHUNK, BLOCK, LEAF = 2048, 1024, 16
#: Vectors of the sample, and pivots drawn from it.
SAMPLE, PIVOTS = 2048, 64
#: Scores saturate here in the result, and here for their order.
MOST, WIDEST = (1 << 63) - 1, 10**38 - 1
_NONE, _NOBODY = -MOST, MOST


class Tree:
    """A cover tree in arrays. Node 0 is the root; the children of a node stand
    together, and ``order[lo:hi]`` are its points, the first of them its centre."""

    def __init__(self, x: np.ndarray):
        x = np.asarray(x, float)
        self.order = np.arange(len(x))
        middle = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
        self.order[[0, middle]] = self.order[[middle, 0]]
        lo, hi, radius, first, count = [0], [len(x)], [], [], []
        k = 0
        while k < len(lo):
            points = self.order[lo[k] : hi[k]].copy()
            far = np.sqrt(((x[points] - x[points[0]]) ** 2).sum(1))
            radius.append(float(far.max()))
            first.append(len(lo))
            if len(points) > LEAF and radius[k] > 0:
                # A point further than half the radius from all centres is the next centre.
                at, left = lo[k], np.arange(len(points))
                while len(left):
                    near = far[left] <= radius[k] / 2 if at == lo[k] else np.sqrt(((x[points[left]] - x[points[left[0]]]) ** 2).sum(1)) <= radius[k] / 2
                    group = points[left[near]]
                    self.order[at : at + len(group)] = group
                    lo.append(at)
                    hi.append(at + len(group))
                    at, left = at + len(group), left[~near]
            count.append(len(lo) - first[k])
            k += 1
        self.lo, self.hi, self.first, self.count = (np.array(c, np.int64) for c in (lo, hi, first, count))
        self.radius = np.array(radius)


class Node:
    """A node of a tree, with its points."""

    def __init__(self, tree: Tree, x: np.ndarray, k: int = 0):
        self.tree, self.x, self.k = tree, x, k

    @property
    def points(self) -> np.ndarray:
        return self.tree.order[self.tree.lo[self.k] : self.tree.hi[self.k]]

    @property
    def centre(self) -> np.ndarray:
        return self.x[self.points[0]]

    @property
    def radius(self) -> float:
        return float(self.tree.radius[self.k])

    @property
    def children(self) -> list[Node]:
        first = int(self.tree.first[self.k])
        return [Node(self.tree, self.x, c) for c in range(first, first + int(self.tree.count[self.k]))]


def cover_tree(x: np.ndarray) -> Node | None:
    """A cover tree of the rows of ``x``: the children of a node of radius r cover
    its points within r / 2 of their centres, which lie further than r / 2 apart;
    the first child has its parent's centre. Nodes of at most LEAF points, or of
    equal points, are leaves."""
    return Node(Tree(x), x) if len(x) else None


class Search:
    """The best k of the points for each query: score descending, id ascending."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.query_ids, self.k = queries, query_ids, k
        self.scores = np.full((len(queries), k), _NONE, np.int64)
        self.found = np.full((len(queries), k), _NOBODY)
        #: Scores that the kth best are known to reach.
        self.floor = np.full(len(queries), -np.inf)
        self.compared = 0
        self.against(points, ids)

    def against(self, points: np.ndarray, ids: np.ndarray) -> None:
        """Search these points next; what was found so far stays."""
        self.p, self.ids = points, ids
        # Whole numbers in doubles are exact while sums stay below 2**53.
        top = lambda a: max(int(a.max(initial=0)), -int(a.min(initial=0)))
        self.exact = self.q.shape[1] * top(self.q) * top(points) < 1 << 53
        kind = float if self.exact else object
        self.a, self.b = self.q.astype(kind), points.astype(kind)
        if not self.exact and self.scores.dtype != object:
            self.scores = np.where(self.found == _NOBODY, -(MOST**3), self.scores.astype(object))

    def _compare(self, rows: np.ndarray, points: np.ndarray) -> None:
        self.compared += len(rows) * len(points)
        s = self.a[rows] @ self.b[points].T
        s = s.astype(np.int64) if self.exact else s
        big = self.scores.dtype == object
        none = -(MOST**3) if big else _NONE
        if big:
            s = np.array([[max(-WIDEST, min(WIDEST, int(v))) for v in r] for r in s], object).reshape(s.shape)
        ids = np.broadcast_to(self.ids[points], s.shape)
        own = self.query_ids[rows][:, None] == ids
        scores = np.concatenate((self.scores[rows], np.where(own, none, s)), 1)
        ids = np.concatenate((self.found[rows], np.where(own, _NOBODY, ids)), 1)
        if big:
            order = np.array([sorted(range(len(r)), key=lambda i, r=r, t=t: (-r[i], t[i])) for r, t in zip(scores, ids, strict=True)])
        else:
            order = np.lexsort((ids, -scores), axis=1)
        self.scores[rows] = np.take_along_axis(scores, order[:, : self.k], 1)
        self.found[rows] = np.take_along_axis(ids, order[:, : self.k], 1)

    def taken(self) -> pa.RecordBatch:
        """query_id, id, score (64 bits) and key (all digits) of what was found."""
        r, c = np.nonzero(self.found != _NOBODY)
        scores = [int(s) for s in self.scores[r, c]]
        columns = [pa.array(self.query_ids[r]), pa.array(self.found[r, c]), pa.array([max(-MOST, min(MOST, s)) for s in scores], pa.int64()), pa.array(map(Decimal, scores), pa.decimal128(38, 0))]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "score", "key"])

    def _worst(self, k: int) -> float:
        rows = self.qt.order[self.qt.lo[k] : self.qt.hi[k]]
        return float(np.maximum(self.scores[rows, -1].astype(float), self.floor[rows]).min())

    def _bounds(self, k: int, nodes: np.ndarray) -> np.ndarray:
        c, n, r = self.qc[k], self.qn[k], self.qt.radius[k]
        pn, pr = self.pn[nodes], self.pt.radius[nodes]
        slack = 1e-9 * (n + r) * (pn + pr) + 1e-6
        return np.maximum(self.pc[nodes] @ c + n * pr + pn * r + r * pr + slack, -float(WIDEST))

    def run(self, q: Node, p: Node) -> None:
        centres = lambda node: np.asarray(node.x, float)[node.tree.order[node.tree.lo]]
        self.qt, self.pt, self.qc, self.pc = q.tree, p.tree, centres(q), centres(p)
        self.qn, self.pn = (np.sqrt((c * c).sum(1)) for c in (self.qc, self.pc))
        self._descend(0, np.zeros(1, np.int64))

    def _descend(self, k: int, nodes: np.ndarray) -> None:
        """Search data nodes for the queries of node k."""
        leaf = self.qt.count[k] == 0
        while True:
            bounds = self._bounds(k, nodes)
            open_ = bounds >= self._worst(k)
            nodes, bounds = nodes[open_], bounds[open_]
            if not len(nodes):
                return
            wide = (self.pt.count[nodes] > 0) & (leaf | (self.pt.radius[nodes] >= self.qt.radius[k]))
            if not wide.any():
                break
            nodes = np.concatenate((nodes[~wide], _ranges(self.pt.first[nodes[wide]], self.pt.count[nodes[wide]])))
        if not leaf:
            for child in range(int(self.qt.first[k]), int(self.qt.first[k] + self.qt.count[k])):
                self._descend(child, nodes)
            return
        # The most promising leaves first, so that the bounds tighten early.
        order = np.argsort(-bounds, kind="stable")
        nodes, bounds = nodes[order], bounds[order]
        rows, size = self.qt.order[self.qt.lo[k] : self.qt.hi[k]], (self.pt.hi - self.pt.lo)[nodes]
        at, most = 0, 4 * LEAF
        while at < len(nodes):
            to = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), most, "right")))
            part = nodes[at:to]
            self._compare(rows, self.pt.order[_ranges(self.pt.lo[part], size[at:to])])
            at, most = to, 4 * most
            worst = self._worst(k)
            keep = at + np.flatnonzero(bounds[at:] >= worst)
            nodes, bounds, size, at = nodes[keep], bounds[keep], size[keep], 0


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first..first+count of each, end to end."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The narrowest whole numbers that hold ``x``."""
    for kind in (np.int16, np.int32):
        if not x.size or (np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def _places(starts: np.ndarray) -> np.ndarray:
    """Each row's place in its group; ``starts`` marks the first rows of groups."""
    return np.arange(len(starts)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]


def _fold(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the best k of any query: of equal vectors the 2k of the
    smallest ids, at most k of one id (none of a query's own rows is a candidate)."""
    order = np.lexsort((ids, *x.T[::-1]))
    new = np.ones(len(ids), bool)
    new[1:] = (x[order[1:]] != x[order[:-1]]).any(1)
    other = new.copy()
    other[1:] |= ids[order[1:]] != ids[order[:-1]]
    few = _places(other) < k
    order, new = order[few], new[few]
    return np.sort(order[_places(new) < 2 * k])


def _rows(batch: pa.RecordBatch, first: int):
    """By length of the vectors: length, rows, vectors; ``first`` is the column of vectors."""
    lists = batch.column(first)
    dims = lists.value_lengths().to_numpy()
    flat, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(dims)))
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        yield int(dim), rows, flat[at[rows][:, None] + np.arange(dim)]


class Guide:
    """What a bounded sample of the data tells: pivots, and lower bounds of kth scores."""

    def __init__(self, sample: DataFrame, k: int):
        self.k, self.by_dim = k, {}
        for batch in sample.toArrow().combine_chunks().to_batches():
            for dim, rows, x in _rows(batch, 1):
                ids = batch.column(0).to_numpy()[rows]
                far, pivots = np.full(len(x), np.inf), [0]
                while len(pivots) < min(PIVOTS, len(x)):
                    far = np.minimum(far, ((x - x[pivots[-1]].astype(float)) ** 2).sum(1))
                    if far.max() <= 0:
                        break
                    pivots.append(int(far.argmax()))
                self.by_dim[dim] = (ids, x, x[pivots].astype(float))

    def nearest(self, dim: int, x: np.ndarray) -> np.ndarray:
        """The nearest pivot of each vector."""
        if dim not in self.by_dim:
            return np.zeros(len(x), np.int64)
        pivots = self.by_dim[dim][2]
        return ((pivots**2).sum(1) - 2 * x.astype(float) @ pivots.T).argmin(1)

    def worst(self, dim: int, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """A score that the kth best of each query reaches."""
        search = Search(x, ids, x[:0], ids[:0], self.k)
        if dim in self.by_dim:
            search.against(self.by_dim[dim][1], self.by_dim[dim][0])
            for lo in range(0, len(x), 256):
                search._compare(np.arange(lo, min(lo + 256, len(x))), np.arange(len(search.p)))
        return np.where(search.found[:, -1] == _NOBODY, -np.inf, search.scores[:, -1].astype(float))


_PACKED = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("width", pa.int32()), ("tree", pa.binary()), ("centre", pa.binary()), ("radius", pa.float64()), ("least", pa.binary())])


def _packed(vectors: DataFrame, size: int, guide: Guide, queries: bool) -> DataFrame:
    """Rows of at most ``size`` vectors, near each other: their length, ids, whole-number
    components, cover tree, and its root's centre and radius; for queries also the
    scores that they reach on the sample."""

    def near(batch: pa.RecordBatch):
        pivot = np.zeros(batch.num_rows, np.int64)
        for dim, rows, x in _rows(batch, 1):
            pivot[rows] = guide.nearest(dim, x)
        yield pa.RecordBatch.from_arrays([*batch.columns, batch.column(1).value_lengths().cast(pa.int32()), pa.array(pivot)], names=["id", "v", "dim", "pivot"])

    def pack(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dim: int, ids: np.ndarray, x: np.ndarray):
            if not queries:
                keep = _fold(ids, x, guide.k)
                ids, x = ids[keep], x[keep]
            tree, narrow = Tree(x), _narrow(x)
            least = guide.worst(dim, ids, x).tobytes() if queries else b""
            columns = {"dim": dim, "ids": ids.tobytes(), "x": narrow.tobytes(), "width": narrow.itemsize, "tree": pickle.dumps(tree, protocol=5)}
            columns |= {"centre": x[tree.order[0]].astype(float).tobytes(), "radius": float(tree.radius[0]), "least": least}
            return pa.RecordBatch.from_pydict({c: [v] for c, v in columns.items()}, schema=_PACKED)

        def emit(dim: int, least: int):
            if sum(len(i) for i, _ in held.get(dim, [])) >= least:
                ids, x = (np.concatenate(c) for c in zip(*held[dim], strict=True))
                full = len(ids) // size * size if least > 1 else len(ids)
                for lo in range(0, full, size):
                    yield out(dim, ids[lo : lo + size], x[lo : lo + size])
                held[dim] = [(ids[full:], x[full:])]

        for batch in batches:
            if batch.num_rows:
                for dim, rows, x in _rows(batch, 1):
                    held.setdefault(dim, []).append((batch.column(0).to_numpy()[rows], x))
                    yield from emit(dim, size)
        for dim in list(held):
            yield from emit(dim, 1)

    dealt = arrow_map(vectors, near, "id long, v array<long>, dim int, pivot long")
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # Ranges of (pivot, id): neighbours lie together, and a crowded pivot is spread over several tasks.
    dealt = dealt.repartitionByRange(parts, "dim", "pivot", "id").sortWithinPartitions("dim", "pivot", "id")
    return dealt.mapInArrow(pack, "dim int, ids binary, x binary, width int, tree binary, centre binary, radius double, least binary")


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v: floor(scale * component) as long, for rows whose id and vector are
    given and whose components are all present and finite."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return df.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def _meet(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """block, chunk, bound: the pairs that the roots' bound does not rule out. Only
    centres and radii meet here, a row a block and a row a chunk."""
    q = queries.select("dim", "block", F.col("centre").alias("qc"), F.col("radius").alias("qr"), "least")
    p = chunks.select(F.col("dim").alias("p_dim"), "chunk", F.col("centre").alias("pc"), F.col("radius").alias("pr"))

    def rows(batch: pa.RecordBatch):
        keep, bounds = [], []
        for qc, qr, least, pc, pr in zip(*(batch.column(k).to_pylist() for k in range(2, 7)), strict=True):
            qc, pc = np.frombuffer(qc), np.frombuffer(pc)
            qn, pn = np.sqrt(qc @ qc), np.sqrt(pc @ pc)
            bounds.append(max(float(qc @ pc + qn * pr + pn * qr + qr * pr + 1e-9 * (qn + qr) * (pn + pr) + 1e-6), -float(WIDEST)))
            keep.append(bounds[-1] >= np.frombuffer(least).min())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bounds)], names=["block", "chunk", "bound"]).filter(pa.array(keep))

    met = q.join(p, q["dim"] == p["p_dim"]).select("block", "chunk", "qc", "qr", "least", "pc", "pr")
    return arrow_map(met, rows, "block long, chunk long, bound double")


def top_k(
    df: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), id_col, score: for each row whose id is divisible by
    ``query_every`` the k other rows of the highest integer inner product, ties to
    the smaller id; all of them where there are fewer.

    Vectors that are null, empty, or hold a null or non-finite component take no
    part, nor do null ids; vectors meet those of their own length only. Components
    beyond 64 bits saturate at their ends, scores at +-(2**63 - 1) in the result and at
    38 digits in their order. Rows that repeat an id are
    one candidate each; a repeated query id searches once, with the least of its
    vectors, and none of its rows is a candidate. An empty table gives an empty
    result. The sample (``SAMPLE`` rows of the smallest hashes) steers the search
    alone: every row is indexed and the result is exact."""
    spark = df.sparkSession
    vectors = quantised(df, id_col, vector_col, scale)
    guide = Guide(vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE), k)
    chunks = materialise(_packed(vectors, CHUNK, guide, False).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    asked = vectors.where(F.col("id") % query_every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = materialise(_packed(asked, BLOCK, guide, True).withColumn("block", F.monotonically_increasing_id()), "queries")
    # Both sides are dealt by (block, slot), so that one block of queries spreads over all tasks.
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    left = _meet(queries, chunks).withColumn("slot", F.pmod(F.xxhash64("chunk"), F.lit(slots)).cast("int")).join(chunks.select("chunk", "ids", "x", "width", "tree"), "chunk")
    right = queries.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).select(
        "block", "slot", "dim", F.col("ids").alias("q_ids"), F.col("x").alias("q"), F.col("width").alias("q_width"), F.col("tree").alias("q_tree"), "least"
    )
    pairs = left.join(right, ["block", "slot"]).select("block", "bound", "dim", "ids", "x", "width", "tree", "q_ids", "q", "q_width", "q_tree", "least")
    pairs = pairs.sortWithinPartitions("block", F.desc("bound"))

    def rows(batches):
        block = search = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(n)[i].as_py() for n, name in enumerate(batch.schema.names)}
                p = np.frombuffer(r["x"], f"<i{r['width']}").reshape(-1, r["dim"]).astype(np.int64)
                ids = np.frombuffer(r["ids"], np.int64)
                if r["block"] != block:
                    if search is not None:
                        yield search.taken()
                    q = np.frombuffer(r["q"], f"<i{r['q_width']}").reshape(-1, r["dim"]).astype(np.int64)
                    block, search, root = r["block"], Search(q, np.frombuffer(r["q_ids"], np.int64), p[:0], ids[:0], k), Node(pickle.loads(r["q_tree"]), q)
                    search.floor = np.frombuffer(r["least"])
                search.against(p, ids)
                search.run(root, Node(pickle.loads(r["tree"]), p))
        if search is not None:
            yield search.taken()

    best = pairs.mapInArrow(rows, "query_id long, id long, score long, key decimal(38,0)")
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
