"""MinHash components against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from sparkwright.llm import minhash
from sparkwright.llm.components import connected_components, extend_components
from sparkwright.llm.wordhash import Words

WORD = r"[^\x20\x09-\x0D]+"


def brute(rows, w, percent=80):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text in rows:
        ws = re.findall(WORD, (text or "").translate(lower))
        sets[i] = frozenset(zip(*[ws[k:] for k in range(w)], strict=False)) if len(ws) >= w else frozenset([tuple(ws)]) if ws else frozenset()
    at = {i: i for i in sets}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                at[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(40):
        rows.append([rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 12, 40, 90]))])
    base = [rng.choice(vocabulary) for _ in range(80)]
    for _ in range(90):  # a hub whose copies lie on both sides of the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(len(copy))] = f"e{rng.random()}"
        rows.append(copy)
    texts = [rng.choice([" ", "\n", " \t"]).join(r) for r in rows]
    texts += [texts[0], texts[0].upper(), texts[41], "", None, " \n", "one", "One", "one two"]
    return list(enumerate(texts, 1000))


@pytest.mark.parametrize("size", [2, 5])
def test_components_are_exact(spark, size):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, shingle=size).collect()}
    assert got == brute(rows, size)
    assert len({c for _, c in got.values()}) < len(rows)


def test_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).collect() == []
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f"), (8, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True), (None, None, True)]


def test_a_very_long_text_and_its_copy(spark):
    rng = random.Random(1)
    words = [str(rng.random()) for _ in range(120_000)]
    near = words[:-1000] + ["x"] * 1000
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "short text")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, shingle=5).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 1 << 62, 8000, dtype=np.uint64)
    a = np.unique(common[:9000])
    b = np.unique(np.concatenate((common[:6400], rng.integers(0, 1 << 62, 1600, dtype=np.uint64))))
    agree = (minhash.band_keys([a]) == minhash.band_keys([b])).mean()
    similarity = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(agree - similarity**minhash.ROWS) < 0.25


def test_densified_bins_come_from_the_same_draws():
    filled = np.zeros((2, minhash.BINS), bool)
    filled[:, [3, 90]] = True
    values = np.where(filled, np.arange(minhash.BINS, dtype=np.uint64), np.uint64(0))
    out = minhash.densify(values, filled)
    assert set(np.unique(out)) == {3, 90} and (out[0] == out[1]).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(500, 501), (501, 502), (502, 500)]
    df = spark.createDataFrame(edges, "a long, b long")
    labels = connected_components(df, "a", "b")
    got = dict(map(tuple, labels.collect()))
    want = {i: 0 for i in range(61)} | {100 + k: 100 for k in range(40)} | {500: 500, 501: 500, 502: 500}
    assert got == want
    more = spark.createDataFrame([(60, 139), (700, 502)], "a long, b long")
    got = dict(map(tuple, extend_components(labels, more, "a", "b").collect()))
    assert got == {k: {100: 0}.get(v, v) for k, v in want.items()} | {700: 500}


def test_word_boundaries_across_rows():
    data = np.frombuffer("ab c".encode() + "d".encode() + b" " + "é\u00a0f g".encode(), np.uint8)
    words = Words(data, np.array([0, 4, 4, 5, 6, len(data)]))
    assert words.count.tolist() == [2, 0, 1, 0, 2]


def test_query_equals_its_sql(spark, data, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from sparkwright.llm import queries

    base = " ".join(f"Word{i}" for i in range(60))
    texts = [base, base.lower(), base + " more", "", None, " \t\n", "one", "ONE", "one two", "Été one", base, base + " and more", "x " * 50, "x x"]
    ids = [*range(len(texts) - 2, 0, -1), None, 3]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    for folder in (str(tmp_path), data):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
        want = con.execute(queries.ORACLES["op1_minhash_near_dedup"]).fetchall()
        found = [tuple(r) for r in queries.op1_minhash_near_dedup(spark, folder).collect()]
        assert sorted(found, key=repr) == sorted(want, key=repr)
