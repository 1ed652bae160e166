"""Empty tables, null and long texts, repeated ids and clashing columns, for every operator and stage."""

import re
import zlib

import pytest

from sparkwright.llm import html_text, minhash, mixing, pieces, quality, queries, secrets, sharding, token_files, topk, urls

corpus_pipeline = pytest.importorskip("corpus_pipeline")

PIECES, TOKENS = (queries.tokenizer_file(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977} of{k % 31}" for k in range(60_000))
BASE = " ".join(f"b{k}" for k in range(60))
NEAR = BASE + " tail"
OTHER = " ".join(f"o{k}" for k in range(60))

DOC_OPERATORS = {
    "minhash": lambda d: minhash.near_duplicates(d), "keep_one": lambda d: minhash.keep_one(d), "mix": lambda d: mixing.mix(d), "mixed_rows": lambda d: mixing.mixed_rows(d), "tokens": lambda d: token_files.token_table(d, TOKENS),
    "shard": lambda d: sharding.shard(d), "pieces": lambda d: pieces.encode_table(d, PIECES, with_ids=True), "judge": lambda d: quality.judge(d, None), "keep_good": lambda d: quality.keep_good(d, None), "scan": lambda d: secrets.scan(d), "redact": lambda d: secrets.redact(d),
}


@pytest.mark.parametrize("name", DOC_OPERATORS)
def test_empty_tables(spark, name):
    assert DOC_OPERATORS[name](spark.createDataFrame([], DOCS)).collect() == []


def test_empty_pages_vectors_and_stages(spark, data, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(pages).collect() == []
    assert urls.judge(pages, queries.URL_RULES, urls.fit(urls.labelled_urls(spark, 300), trees=1)).collect() == []
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], DOCS), data).collect() == [], name


def odd_rows():
    return [
        (1, LONG, "en", "a", len(LONG)), (2, None, None, None, None), (3, "", "en", "a", 0), (None, OTHER, "en", "b", len(OTHER)), (4, BASE, "en", "a", len(BASE)), (5, OTHER, "en", "a", len(OTHER)), (5, NEAR, "en", "b", len(NEAR)),
        (6, OTHER, "en", "a", len(OTHER)), (6, OTHER, "en", "a", len(OTHER)), (7, " \n ", "x", None, 3),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    # Columns whose names operators use themselves.
    return spark.createDataFrame([(*r, "k", 0) for r in odd_rows()], DOCS + ", size string, id int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_each_operator_keeps_every_row(spark, odd):
    for name in ("mix", "tokens", "shard", "pieces", "judge", "scan", "redact", "minhash"):
        got = [r["doc_id"] for r in DOC_OPERATORS[name](odd).collect()]
        assert sorted(got, key=str) == sorted((r[0] for r in odd_rows()), key=str), name


def test_long_texts_are_whole(spark, odd):
    import sentencepiece
    from tokenizers import Tokenizer

    one = lambda name: [r for r in DOC_OPERATORS[name](odd).collect() if r["doc_id"] == 1][0]
    assert one("mix")["size"] == one("judge")["n_words"] == len(words(LONG)) == 120_000
    assert one("pieces")["piece_ids"] == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(LONG)
    assert one("tokens")["n_tokens"] == 1 + len(Tokenizer.from_file(TOKENS).encode(LONG, add_special_tokens=False).ids)
    assert one("shard")["text_crc32"] == zlib.crc32(LONG.encode()) and one("redact")["text"] == LONG
    ws = words(LONG)
    assert one("minhash")["n_shingles"] == len(set(zip(*(ws[k:] for k in range(5)), strict=False)))


@pytest.mark.parametrize("parts", [1, 7])
def test_rows_that_share_an_id_keep_their_own_components(spark, odd, parts):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd.repartition(parts)).where("doc_id in (4, 5, 6)").collect())
    assert got == [(4, 56, 4, True), (5, 56, 5, True), (5, 57, 4, False), (6, 56, 5, False), (6, 56, 5, False)]
    kept = sorted(((r["doc_id"], r["text"]) for r in minhash.keep_one(odd.repartition(parts)).collect()), key=str)
    want = [(1, LONG), (2, None), (3, ""), (None, OTHER), (4, BASE), (5, OTHER), (7, " \n ")]
    assert kept == sorted(want, key=str)
    assert minhash.keep_one(odd).columns == odd.columns


def test_mixes_repeat_where_ids_do(spark):
    rows = [(1, f"{a} two three", "s") for a in "abcdefgh"] * 3 + [(2, "x " * 50, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(r["text"] for r in mixing.mixed_rows(docs.repartition(n), block=2).collect()) for n in (1, 3, 5)]
    assert runs[0] == runs[1] == runs[2]


def test_stages_on_odd_rows(spark, odd, data):
    plain = odd.drop("size", "id")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, plain, data)
        rows = out.collect()
        if name != "sentencepiece_ids":
            assert out.columns == plain.columns
        if name in ("secret_scans", "sentencepiece_ids"):
            assert len(rows) == len(odd_rows())
        if name == "quality_rules":
            assert {r["doc_id"] for r in rows} <= {1, None, 4, 5, 6}


def test_nothing_is_left_but_what_a_result_reads(spark, odd):
    import os

    from sparkwright.llm.shared import shared_folder

    folder = f"{shared_folder(spark).removeprefix('file:')}/stages"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    minhash.near_duplicates(odd).collect()
    new = set(os.listdir(folder)) - before
    assert {n.partition("-")[0] for n in new} == {"sketch", "component"}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_have_the_contract_columns_and_types(spark, data, name):
    want = {
        "op1_minhash_near_dedup": "doc_id bigint n_shingles bigint component_id bigint kept boolean", "op2_source_mixing": "doc_id bigint size bigint source_size bigint target double taken bigint",
        "op3_token_files": "doc_id bigint start bigint n_tokens bigint ids_crc32 bigint", "op4_url_filters": "page_id bigint host string path string rule string verdict string",
        "op5_sharding": "doc_id bigint size bigint text_crc32 bigint law string shard int slot bigint grown_shard int", "op7_exact_top_k": "query_id bigint rank int vec_id bigint score bigint",
        "op8_html_extraction": "page_id bigint url string text string n_chars bigint", "op9_quality_rules": "doc_id bigint n_words bigint word_chars bigint n_symbols bigint n_dup_lines bigint n_repeat_words bigint base_failed boolean kept boolean",
        "op10_secret_scans": "doc_id bigint n_assign bigint n_access bigint n_hex bigint base_sha256 string spans string", "op6_sentencepiece": "doc_id bigint n_pieces bigint ids_crc32 bigint",
    }[name].split()
    got = dict(queries.QUERIES[name](spark, data).dtypes)
    assert {c: got.get(c) for c in want[::2]} == dict(zip(want[::2], want[1::2], strict=True))
