"""Driver queries of the operators in this subpackage: each applies its operator
to the whole intended table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm.shared import read_table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.minhash import near_duplicates

    found = near_duplicates(read_table(spark, sf_dir, "documents"), shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.mixing import mix

    return mix(read_table(spark, sf_dir, "documents"), block=None)


def op3_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from sparkwright.llm.token_files import token_table

    return token_table(read_table(spark, sf_dir, "documents"), tokenizer or tokenizer_file("byte_bpe_50k.json"))


#: (verdict, host, path), as the contract of op4 states them.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.urls import fit, judge, labelled_urls

    return judge(read_table(spark, sf_dir, "pages"), URL_RULES, fit(labelled_urls(spark))).drop("margin")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.sharding import shard

    placed = shard(read_table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    from sparkwright.llm.pieces import encode_table

    return encode_table(read_table(spark, sf_dir, "documents"), model or tokenizer_file("piece_bpe_32k.model"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.topk import top_k

    return top_k(read_table(spark, sf_dir, "embeddings"), k=5, query_every=50)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.html_text import extract

    return extract(read_table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.quality import fit, judge

    docs = read_table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, read_table(spark, sf_dir, "labels"))).drop("probability")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.secrets import scan

    found = scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file; the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_source_mixing, op3_token_files, op4_url_filters, op5_sharding, op6_sentencepiece,
        op7_exact_top_k, op8_html_extraction, op9_quality_rules, op10_secret_scans,
    )
}

#: Where SQL can state the whole result. The others need models, seeded draws,
#: transducers or files, and are tested by brute force.
ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": r"""
        WITH RECURSIVE d AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id,
                regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), g AS MATERIALIZED (SELECT DISTINCT r, unnest(list_zip(w[1:greatest(len(w) - 1, 1)], w[2:])) AS gram FROM d),
        often AS (SELECT gram, row_number() OVER (ORDER BY count(*), gram) AS tok FROM g GROUP BY gram),
        sized AS MATERIALIZED (SELECT r, list(tok ORDER BY tok) AS toks, count(*) AS n FROM g JOIN often USING (gram) GROUP BY r),
        rep AS MATERIALIZED (SELECT toks, min(r) AS rep, min(doc_id) AS least FROM sized JOIN d USING (r) WHERE doc_id IS NOT NULL GROUP BY toks),
        part AS MATERIALIZED (SELECT rep, len(toks) AS n, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM rep),
        head AS (SELECT * FROM part WHERE 100 * (n - pos + 1) >= 80 * n),
        pair AS (
            SELECT DISTINCT x.rep AS a, y.rep AS b, x.n + y.n AS total
            FROM head x JOIN head y ON x.tok = y.tok AND x.rep < y.rep AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
        ), link AS MATERIALIZED (
            SELECT a, b FROM pair JOIN part x ON x.rep = a JOIN part y ON y.rep = b AND y.tok = x.tok
            GROUP BY a, b, total HAVING 100 * count(*) >= 80 * (total - count(*))
        ), side AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT rep AS a, rep AS b FROM rep UNION SELECT reach.a, side.b FROM reach JOIN side ON side.a = reach.b),
        component AS (SELECT reach.a AS rep, min(o.least) AS component FROM reach JOIN rep o ON o.rep = reach.b GROUP BY reach.a)
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id,
            d.doc_id IS NOT DISTINCT FROM coalesce(c.component, d.doc_id) AS kept
        FROM d LEFT JOIN sized s USING (r) LEFT JOIN rep ON rep.toks = s.toks AND d.doc_id IS NOT NULL LEFT JOIN component c ON c.rep = rep.rep""",
    "op5_sharding": """
        WITH RECURSIVE crc AS (
            SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS tbl
            FROM range(256) t(i)
        ), d AS MATERIALIZED (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
                xor(4294967295, list_reduce(
                    list_prepend(4294967295, [CAST('0x' || h AS BIGINT) FOR h IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]),
                    lambda c, b: xor(c >> 8, tbl[xor(c & 255, b) + 1])
                )) AS text_crc32
            FROM documents, crc
        ), numbered AS MATERIALIZED (
            SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS r FROM d
        ), p AS (
            SELECT count(*) AS n, CAST(greatest(1, (length(bin(greatest(count(*) - 1, 1))) + 1) // 2) AS INTEGER) AS half FROM numbered
        ), seeds AS (
            SELECT k, CAST(((k + 1)::UHUGEINT + 17::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS w FROM range(6) t(k)
        ), keys AS MATERIALIZED (
            SELECT k, xor(y, y >> 31) AS key
            FROM (SELECT *, CAST(xor(x, x >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT) AS y
            FROM (SELECT *, CAST(xor(w, w >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT) AS x FROM seeds))
        ), walk AS (
            SELECT r, CAST(r >> half AS UBIGINT) AS a, CAST(r & ((1::BIGINT << half) - 1) AS UBIGINT) AS b, 0 AS step, n, half, FALSE AS done
            FROM numbered, p
            UNION ALL
            SELECT r, b, c, step + 1, n, half, (step + 1) % 6 = 0 AND (b << half) + c < n
            FROM (
                SELECT *, CAST(xor(a, xor(y, y >> 31) & ((1::UBIGINT << half) - 1)) AS UBIGINT) AS c
                FROM (SELECT *, CAST(xor(x, x >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT) AS y
                FROM (SELECT *, CAST(xor(w, w >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT) AS x
                FROM (SELECT *, CAST((b::UHUGEINT + key::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS w
                FROM walk JOIN keys ON keys.k = walk.step % 6 WHERE NOT done)))
            )
        )
        SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(((a << half) + b) % 8 AS INTEGER) AS shard,
            CAST(((a << half) + b) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM walk JOIN numbered USING (r) WHERE done""",
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5""",
}
