"""Near-duplicate detection by one-permutation MinHash.

One hash of each distinct shingle serves all bins (one-permutation hashing); bins
that stay empty borrow from a bin drawn by a hash of bin and attempt (optimal
densification), the same for every document. Signatures are cut into bands; each
band of a document falls into a bucket. A bucket yields star-shaped candidate
edges only: from a few centres to the other members, so that edges stay in
proportion to the members. Every edge is confirmed on the full shingle sets, and
documents that confirmed links connect form a component.

The first stars have one centre a bucket. Buckets whose members all lie in one
component by then are done; the others get stars from ``centres`` centres, drawn
anew, to members of other components. What stays mixed after that goes through an
exact prefix join, so that no link in a bucket depends on the choice of centres.

Equal shingle sets are folded into one representative first, so that copies, how
many there may be, cost one row each and no edges. Joins on buckets, shingles, edge
ends and equal sets cut each heavy key into parts, so that no task holds a hot group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.llm.components import connected_components, extend_components
from sparkwright.llm.shared import arrow_map, discard, in_parts, materialise, mix64, runs, spread_join, strings, with_parts
from sparkwright.llm.wordhash import Words

#: 40 bands of 5 rows: a pair at similarity 0.8 shares no bucket with probability 1.2e-7.
BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
_EDGES = np.array([-((-(b << 64)) // BINS) for b in range(1, BINS)], dtype=np.uint64)
_ATTEMPTS = 1024
_PROBE = (mix64(np.arange(_ATTEMPTS * BINS, dtype=np.uint64) + np.uint64(0xA5A5_5A5A)) % np.uint64(BINS)).astype(np.int64).reshape(_ATTEMPTS, BINS)


def shingle_sets(words: Words, size: int):
    """The sorted distinct shingle hashes of each row. With fewer than ``size``
    words the whole sequence is the one shingle; without words the set is empty."""
    grams = words.grams(size)
    for first, count in zip(words.first[:-1], words.count, strict=True):
        if count >= size:
            yield np.unique(grams[first : first + count - size + 1])
        elif count:
            h = np.uint64(count)
            with np.errstate(over="ignore"):
                for x in words.hash[first : first + count]:
                    h = mix64(np.array([h * np.uint64(0xC2B2AE3D27D4EB4F) + x], np.uint64))[0]
            yield np.array([h], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def densify(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Fill each empty bin from the first filled bin among those that the hash of
    (bin, attempt) names; both arrays are documents by bins."""
    out = values.copy()
    rows = np.flatnonzero(~filled.all(1) & filled.any(1))
    if not len(rows):
        return out
    v, full, need = values[rows], filled[rows], ~filled[rows]
    for probe in _PROBE:
        take = need & full[:, probe]
        if take.any():
            part = out[rows]
            part[take] = v[:, probe][take]
            out[rows] = part
            need &= ~take
            keep = need.any(1)
            if not keep.all():
                rows, v, full, need = rows[keep], v[keep], full[keep], need[keep]
                if not len(rows):
                    return out
    for i, r in enumerate(rows):  # not reached in practice: the next filled bin to the right
        at = np.flatnonzero(full[i])
        for b in np.flatnonzero(need[i]):
            out[r, b] = v[i, at[np.searchsorted(at, b) % len(at)]]
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Documents by bands: 64-bit bucket keys, different from band to band."""
    values = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.concatenate(([0], np.searchsorted(s, _EDGES), [len(s)]))
            has = at[:-1] < at[1:]
            filled[i] = has
            values[i, has] = s[at[:-1][has]]
    sig = densify(values, filled).reshape(len(sets), BANDS, ROWS)
    key = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sets), BANDS)).copy()
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
    return key.view(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """id, text_hash, n (set size), set_key (16 bytes, equal for equal sets; null for
    the empty set), bands."""

    def rows(batch: pa.RecordBatch):
        data, offsets = strings(batch.column(2))
        for lo, hi in runs(offsets):
            sets = list(shingle_sets(Words(data, offsets[lo : hi + 1], lower=True), size))
            keys = band_keys(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[lo:hi],
                    batch.column(1)[lo:hi],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel())),
                ],
                names=["id", "text_hash", "n", "set_key", "bands"],
            )

    return arrow_map(docs, rows, "id long, text_hash long, n long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """id and the sorted shingle hashes as bytes."""

    def rows(batch: pa.RecordBatch):
        data, offsets = strings(batch.column(1))
        for lo, hi in runs(offsets):
            sets = shingle_sets(Words(data, offsets[lo : hi + 1], lower=True), size)
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"])

    return arrow_map(docs, rows, "id long, set binary")


def confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) of a materialised table with 100 * intersection >= percent *
    union, materialised. A centre may have any number of edges."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))

    def rows(batch: pa.RecordBatch):
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            both = np.concatenate((p, q))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(p) + len(q) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    pairs, total, hubs = edges, edges.count(), []
    for end, other, side in (("a", "b", left), ("b", "a", right)):
        pairs, hot = with_parts(pairs, end, edges.groupBy(end).agg(F.count("*").alias("k")), total)
        side = side.join(F.broadcast(hot), end, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        pairs = spread_join(pairs, side, end, other).drop("parts")
        hubs.append(hot)
    out = materialise(arrow_map(pairs.select("a", "b", "set_a", "set_b"), rows, "a long, b long"), "links")
    discard(*hubs)
    return out


def _stars(members: DataFrame, percent: int, centres: int, seed: int) -> DataFrame:
    """Distinct candidate edges a < b from the centres of each bucket to members
    in other components whose set sizes allow the similarity."""
    h = F.xxhash64("id", "bucket", F.lit(seed))
    drawn = (
        members.groupBy("bucket", F.pmod(h, F.lit(centres)).alias("cell"))
        .agg(F.min(F.struct(h.alias("h"), "id", "n", "comp")).alias("c"), F.max("parts").alias("parts"))
        .select("bucket", "parts", F.col("c.id").alias("c_id"), F.col("c.n").alias("c_n"), F.col("c.comp").alias("c_comp"))
    )
    fits = (100 * F.least("n", "c_n") >= percent * F.greatest("n", "c_n")) & (F.col("comp") != F.col("c_comp"))
    pairs = spread_join(members, drawn, "bucket", "id").where(fits)
    return pairs.select(F.least("id", "c_id").alias("a"), F.greatest("id", "c_id").alias("b")).distinct()


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their components by now, of the buckets that hold more than
    one component. A bucket of two has been compared in full by its first star."""
    at = members.drop("comp").join(labels.withColumnRenamed("node", "id"), "id", "left")
    at = materialise(at.select("bucket", "parts", "id", "n", F.coalesce("component", "id").alias("comp")), "labelled")
    mixed = (
        at.groupBy("bucket", F.pmod("id", F.lit(16)).alias("cell")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k"), F.max("parts").alias("parts"))
        .groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("k").alias("k"), F.max("parts").alias("parts"))
        .where("lo < hi and k > 2").select("bucket", "parts")
    )
    out = materialise(spread_join(at, mixed, "bucket", "id"), "mixed")
    discard(at)
    return out


def _residual(active: DataFrame, sets: DataFrame, percent: int, spent: list[DataFrame]) -> DataFrame:
    """Every pair a < b from different components that the stars left open and
    that may still reach the similarity: an exact prefix join. With shingles
    ranked from rare to common, a linked pair shares one among the first
    n - ceil(percent * n / 100) + 1 of each, and from the first shared one on both
    must have enough left. Shingles that only one document has fill the prefixes
    of heavily edited copies, so those drop out here instead of meeting the group.
    For each shingle only documents outside its most frequent component are
    matched, with the documents of other components. Tables that the caller may
    discard later are put into ``spent``."""
    who = active.select("id", "n", "comp").distinct()

    def rows(batch: pa.RecordBatch):
        parts = [np.frombuffer(s.as_buffer(), np.int64) for s in batch.column(3)]
        at = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k).take(pa.array(at)) for k in range(3)), pa.array(np.concatenate(parts))], names=["id", "n", "comp", "tok"]
        )

    toks = materialise(arrow_map(who.join(sets, "id").select("id", "n", "comp", "set"), rows, "id long, n long, comp long, tok long"), "tokens")
    total = toks.count()
    often = materialise(toks.groupBy("tok").agg(F.count("*").alias("df")).withColumn("parts", in_parts("df", total)), "often")
    dealt, common = with_parts(toks, "tok", often.select("tok", F.col("df").alias("k")), total)
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "tok")) - 1
    entries = spread_join(dealt, often, "tok", "id").withColumn("pos", place).where((100 * (F.col("n") - F.col("pos")) >= percent * F.col("n")) & (F.col("df") > 1))
    entries = materialise(entries.select("tok", "parts", "id", "n", "comp", "pos"), "prefixes")
    main = (
        entries.groupBy("tok", "parts", "comp").agg(F.count("*").alias("k"))
        .groupBy("tok", "parts").agg(F.max(F.struct("k", "comp")).alias("m"), F.count("*").alias("comps"))
        .where("comps > 1").select("tok", "parts", F.col("m.comp").alias("main"))
    )
    outside = materialise(spread_join(entries, main, "tok", "id").where("comp != main"), "outside")
    spent += [toks, often, common, entries, outside]
    left = outside.select("tok", "parts", *(F.col(c).alias(f"{c}_x") for c in ("id", "n", "comp", "pos")))
    room = F.least(F.col("n_x") - F.col("pos_x"), F.col("n") - F.col("pos"))
    fits = (F.col("comp") != F.col("comp_x")) & ((100 + percent) * room >= percent * (F.col("n") + F.col("n_x")))
    pairs = spread_join(entries, left, "tok", "id").where(fits)
    return pairs.select(F.least("id", "id_x").alias("a"), F.greatest("id", "id_x").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, centres: int = 2
) -> DataFrame:
    """Components of near-duplicate texts.

    Returns per input row: id_col, n_shingles (distinct shingles of ``shingle``
    lower-cased words), component_id (smallest id of the component), kept (whether
    this id is that one), group (a number of the component, of this run only) and
    text_hash (xxhash64 of the text). A null or word-free text has the empty set and
    is linked with nothing. A null id keeps a row of its own kind: it is linked with
    nothing and has a null component and kept = true; both have a null group. Rows
    are documents of their own: those that repeat an id each get a row back, in the
    component of their own text. A text of any length counts whole; other columns are
    not looked at. An empty table gives an empty result."""
    text = F.col(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    # Rows are numbered once, as they are written; a set goes by the least row that has it.
    sketch = materialise(sketches(source, shingle).withColumn("row", F.monotonically_increasing_id()), "sketch")
    usable = sketch.where("set_key is not null and id is not null")
    reps = materialise(usable.groupBy("set_key").agg(F.min("row").alias("rep"), F.min("id").alias("least"), F.count("*").alias("copies")), "reps")
    told = usable.join(reps.select("rep"), usable["row"] == F.col("rep")).select(F.col("row").alias("id"), "n", "bands")
    exploded = told.select("id", "n", F.explode("bands").alias("bucket"))
    shared = (
        exploded.groupBy("bucket", F.pmod("id", F.lit(16)).alias("cell")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("k"))
        .groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("k").alias("k")).where("lo < hi").select("bucket", "k")
    )
    shared = materialise(shared, "shared")
    total = shared.agg(F.sum("k")).first()[0] or 0
    dealt, hot = with_parts(exploded, "bucket", shared, total)
    buckets = shared.select("bucket", in_parts("k", total).alias("parts"))
    members = materialise(spread_join(dealt, buckets, "bucket", "id").withColumn("comp", F.col("id")), "members")
    wanted = usable.join(members.select(F.col("id").alias("rep")).distinct(), usable["row"] == F.col("rep")).select("id", "text_hash", "rep")
    texts = source.join(wanted, ["id", "text_hash"]).select(F.col("rep").alias("id"), "text")
    sets = materialise(full_sets(texts, shingle).dropDuplicates(["id"]), "sets")

    first = materialise(_stars(members, percent, 1, 0), "edges")
    links = confirm(first, sets, percent)
    labels = connected_components(links, "a", "b")
    active = _mixed(members, labels)
    spent = [shared, hot, members, sets, first, links, active]
    if not active.isEmpty():
        fresh = materialise(_stars(active, percent, centres, 1).join(first, ["a", "b"], "left_anti"), "edges")
        more = confirm(fresh, sets, percent)
        spent += [fresh, more, labels]
        labels = extend_components(labels, more, "a", "b")
        active = _mixed(active, labels)
        spent.append(active)
        if not active.isEmpty():
            rest = materialise(_residual(active, sets, percent, spent).join(first.union(fresh), ["a", "b"], "left_anti"), "rest")
            more = confirm(rest, sets, percent)
            spent += [rest, more]
            if not more.isEmpty():
                spent.append(labels)
                labels = extend_components(labels, more, "a", "b")
    rooted = reps.join(labels, reps["rep"] == labels["node"], "left").select("set_key", "least", "copies", F.coalesce("component", "rep").alias("group"))
    named = materialise(rooted.groupBy("group").agg(F.min("least").alias("component"), F.count("*").alias("k")), "named")
    total = reps.count()
    dealt, large = with_parts(rooted, "group", named.select("group", "k"), total)
    component = spread_join(dealt, named.select("group", "component", in_parts("k", total).alias("parts")), "group", "set_key")
    total = reps.agg(F.sum("copies")).first()[0] or 0
    component = materialise(component.select("set_key", "group", "component", in_parts("copies", total).alias("parts")), "component")
    discard(*spent, labels, named, large, reps)
    rows = ["id", "n", "group", "component", "text_hash"]
    hot = F.broadcast(component.where("parts > 1").select("set_key", "parts"))
    dealt = sketch.where("set_key is not null and id is not null").join(hot, "set_key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    joined = spread_join(dealt, component, "set_key", "row").select(*rows)
    alone = sketch.where("set_key is null or id is null").select("id", "n", F.lit(None).cast("long").alias("group"), F.col("id").alias("component"), "text_hash")
    return joined.union(alone.select(*rows)).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "group", "text_hash",
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, unchanged, with all columns of ``docs``: of the rows
    with the smallest id, the one of the smallest text hash. Rows with a null id or a
    word-free text are linked with nothing and all stay."""
    names = docs.columns
    groups = near_duplicates(docs, id_col, text_col, shingle, percent)
    kept = groups.where(F.col("kept") & F.col("group").isNotNull()).groupBy("group").agg(F.min(id_col).alias("_id"), F.min("text_hash").alias("_hash"))
    kept = materialise(kept.select("_id", "_hash").distinct(), "kept")
    spoken = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    h = "_h" + "_" * max(map(len, names))
    linked = docs.where(F.col(id_col).isNotNull() & spoken).withColumn(h, F.xxhash64(text_col))
    linked = linked.join(kept, (linked[id_col] == kept["_id"]) & (linked[h] == kept["_hash"]), "left_semi").dropDuplicates([id_col, h])
    return linked.select(*names).unionByName(docs.where(F.col(id_col).isNull() | ~spoken))
