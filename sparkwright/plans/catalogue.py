"""All queries over the test tables, with the SQL that states the same result.

Roles: orders and lineitem are facts; customer, nation, region, part and supplier
dimensions; the eligible pool is open orders of 50,000 to 250,000; a segment is
(nation, order priority); a line quantity of 50 is the sentinel; document labels
are an optional dimension; equal texts are duplicates.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright import functions as X
from sparkwright.operators import cost, dims, facts, features, keys, profiling, quality, relational, rules, serve
from sparkwright.plans.census import Census
from sparkwright.sources import Warehouse, columns_like, csv_inferred, csv_text, fingerprint, inline_values, name_sorted, numbered_lines, row_range, schema_of, shared_folder, write_csv, write_json
from sparkwright.sources.files import Files
from sparkwright.sources.store import ConstraintError
from sparkwright.streaming import drain, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


POOL = "o_orderstatus <> 'F' AND o_totalprice BETWEEN 50000 AND 250000"
SQL_STAR = "orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"


def star(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))


# Composite queries ------------------------------------------------------------


@query(f"""SELECT n_name, o_orderpriority, count(*) AS candidates, round(avg(o_totalprice), 6) AS mean_price, round(avg(c_acctbal), 6) AS mean_balance,
  count(*) FILTER (WHERE o_totalprice >= 200000) AS censored_rows, CASE WHEN count(*) < 30 THEN 'too thin to fund' END AS note
  FROM {SQL_STAR} WHERE {POOL} GROUP BY n_name, o_orderpriority""")
def allocation(t):
    return serve.allocation(star(t).where(POOL), ["n_name", "o_orderpriority"], {"mean_price": ("o_totalprice", 6), "mean_balance": ("c_acctbal", 6)}, F.col("o_totalprice") >= 200000)


@query(f"""SELECT 'eligible pool' AS measure, count(*) AS records FROM orders WHERE {POOL}
  UNION ALL SELECT 'of those, urgent', count(*) FROM orders WHERE {POOL} AND o_orderpriority LIKE '1-%'
  UNION ALL SELECT 'of those, pending', count(*) FROM orders WHERE {POOL} AND o_orderstatus = 'P'""")
def pool_breakdown(t):
    return relational.counted(t.orders.where(POOL), {"eligible pool": F.lit(True), "of those, urgent": F.col("o_orderpriority").like("1-%"), "of those, pending": F.col("o_orderstatus") == "P"})


@query("""WITH l AS (SELECT p_type, CASE WHEN l_quantity = 50 THEN NULL ELSE l_quantity END AS q, l_quantity = 50 AS flag FROM lineitem JOIN part ON p_partkey = l_partkey)
  SELECT p_type, round(avg(q), 2) AS mean_excluding_sentinel, round(avg(coalesce(q, CASE WHEN flag THEN 50 END)), 2) AS mean_including_sentinel, count(*) FILTER (WHERE flag) AS censored_rows FROM l GROUP BY p_type""")
def sentinel_ranking(t):
    lines = facts.censor(t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")), {"l_quantity": 50})
    return lines.groupBy("p_type").agg(
        F.round(F.avg("l_quantity"), 2).alias("mean_excluding_sentinel"), F.round(F.avg(facts.uncensored("l_quantity", 50.0)), 2).alias("mean_including_sentinel"), F.count_if("l_quantity_is_topcoded").alias("censored_rows")
    )


SQL_MARKED = """WITH g AS (SELECT md5(text) AS h, min(doc_id) AS first_row FROM documents GROUP BY md5(text) HAVING count(*) > 1),
  n AS (SELECT h, CAST(row_number() OVER (ORDER BY first_row, h) AS INTEGER) AS duplicate_group_id FROM g),
  marked AS (SELECT d.doc_id, d.lang, n.duplicate_group_id, CASE WHEN n.h IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY md5(d.text) ORDER BY d.doc_id) AS INTEGER) END AS duplicate_seq
    FROM documents d LEFT JOIN n ON n.h = md5(d.text)) """


def marked_documents(t: Tables) -> DataFrame:
    hashed = t.documents.select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("h"))
    return keys.mark_duplicates(hashed, "h", "doc_id")


@query(SQL_MARKED + """SELECT count(*) AS rows_loaded, count(*) FILTER (WHERE duplicate_group_id IS NOT NULL) AS rows_in_a_duplicate_group,
  count(DISTINCT duplicate_group_id) AS duplicate_groups, count(*) FILTER (WHERE duplicate_seq > 1) AS surplus_rows FROM marked""")
def duplicate_summary(t):
    return marked_documents(t).agg(
        F.count("*").alias("rows_loaded"), F.count("duplicate_group_id").alias("rows_in_a_duplicate_group"), F.count_distinct("duplicate_group_id").alias("duplicate_groups"), F.count_if(F.col("duplicate_seq") > 1).alias("surplus_rows")
    )


@query(SQL_MARKED + "SELECT doc_id, duplicate_group_id, duplicate_seq FROM marked")
def duplicate_mark(t):
    return marked_documents(t).select("doc_id", "duplicate_group_id", "duplicate_seq")


@query(SQL_MARKED + "SELECT doc_id, lang FROM marked WHERE duplicate_seq IS NULL OR duplicate_seq = 1")
def dedup_view(t):
    return keys.deduplicated(marked_documents(t)).select("doc_id", "lang")


@query("""SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_repeat, count(*) OVER (PARTITION BY text) > 1 AS is_shared FROM documents""")
def duplicated_flags(t):
    hashed = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    w = Window.partitionBy("h")
    return hashed.select("doc_id", (F.row_number().over(w.orderBy("doc_id")) > 1).alias("is_repeat"), (F.count("*").over(w) > 1).alias("is_shared"))


@query("""SELECT l_orderkey, l_linenumber, c_mktsegment, n_name, r_name, p_type, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN part ON p_partkey = l_partkey WHERE r_name = 'ASIA'""")
def flatten_star(t):
    wide = (
        t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    )
    return wide.where("r_name = 'ASIA'").select("l_orderkey", "l_linenumber", "c_mktsegment", "n_name", "r_name", "p_type", "l_quantity")


SQL_MART = f"""SELECT n_name, o_orderpriority, CAST(count(*) AS INTEGER) AS candidates, round(avg(o_totalprice), 6) AS mean_price, CAST(count(o_totalprice) AS INTEGER) AS price_measured_on,
  round(avg(c_acctbal), 6) AS mean_balance, CAST(count(c_acctbal) AS INTEGER) AS balance_measured_on, round(100.0 * count(*) / (SELECT count(*) FROM orders WHERE {POOL}), 4) AS pct_of_eligible_pool,
  count(*) < 30 AS segment_is_sparse, NOT max(n_name = 'CHINA') AS is_assignable FROM {SQL_STAR} WHERE {POOL} GROUP BY n_name, o_orderpriority"""


def mart(t: Tables) -> DataFrame:
    return serve.segment_mart(star(t).where(POOL), ["n_name", "o_orderpriority"], {"price": "o_totalprice", "balance": "c_acctbal"}, F.col("n_name") == "CHINA")


@query(SQL_MART)
def segment_mart(t):
    return mart(t).withColumns({c: F.round(c, 6) for c in ("mean_price", "mean_balance")})


@query(f"""SELECT CAST(sum(candidates) AS BIGINT) AS pool, CAST(sum(CASE WHEN NOT segment_is_sparse AND is_assignable THEN candidates ELSE 0 END) AS BIGINT) AS actionable,
  count(*) FILTER (WHERE segment_is_sparse) AS sparse_segments, CAST(sum(CASE WHEN NOT is_assignable THEN candidates ELSE 0 END) AS BIGINT) AS unassignable FROM ({SQL_MART})""")
def tiles(t):
    return serve.tiles(mart(t))


@query(f"SELECT n_name, o_orderpriority, candidates FROM ({SQL_MART}) WHERE n_name IN ('CHINA', 'JAPAN', 'INDIA') AND NOT segment_is_sparse")
def filtered_view(t):
    return serve.filtered(mart(t), {"n_name": ["CHINA", "JAPAN", "INDIA"], "o_orderpriority": []}, hide_sparse=True).select("n_name", "o_orderpriority", "candidates")


@query(f"""SELECT n_name, o_orderpriority, CASE WHEN segment_is_sparse AND NOT is_assignable THEN 'sparse, not assignable' WHEN segment_is_sparse THEN 'sparse' WHEN NOT is_assignable THEN 'not assignable' ELSE 'ok' END AS flags FROM ({SQL_MART})""")
def flag_label(t):
    return serve.flag_labels(mart(t)).select("n_name", "o_orderpriority", "flags")


@query(f"SELECT n_name, CAST(sum(candidates) AS BIGINT) AS candidates FROM ({SQL_MART}) GROUP BY n_name")
def mart_rollup(t):
    return mart(t).groupBy("n_name").agg(F.sum("candidates").alias("candidates"))


@query("""WITH norms AS (SELECT p_type, median(p_size) AS med_size, median(p_retailprice) AS med_price FROM part GROUP BY p_type)
  SELECT p_partkey, CASE WHEN p_size < 10 THEN 'under 10' WHEN p_size < 25 THEN '10 to 24' WHEN p_size < 40 THEN '25 to 39' ELSE '40 and over' END AS size_band, CAST(p_size - med_size AS SMALLINT) AS size_vs_median,
  round(CASE WHEN med_price > 0 THEN p_retailprice / med_price END, 4) AS price_vs_median, p_size >= 35 AS is_large, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'first' ELSE 'other' END AS brand_group FROM part JOIN norms USING (p_type)""")
def feature_rows(t):
    part = t.part.join(features.norms(t.part, "p_type", {"med_size": "p_size", "med_price": "p_retailprice"}), "p_type")
    return part.select(
        "p_partkey", features.band("p_size", [(10, "under 10"), (25, "10 to 24"), (40, "25 to 39")], "40 and over", "missing").alias("size_band"), X.round_to_int(F.col("p_size") - F.col("med_size")).alias("size_vs_median"),
        F.round(F.when(F.col("med_price") > 0, F.col("p_retailprice") / F.col("med_price")), 4).alias("price_vs_median"), (F.col("p_size") >= 35).alias("is_large"), F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), "first").otherwise("other").alias("brand_group"),
    )


SQL_BUCKET = "CAST(('0x' || substr(md5(concat(coalesce(CAST(duplicate_group_id AS VARCHAR), CAST(doc_id AS VARCHAR)), CASE WHEN lang = 'en' THEN 'true' ELSE 'false' END)), 1, 8)) AS BIGINT) % 100"
SQL_SPLIT = SQL_MARKED + f", s AS (SELECT doc_id, duplicate_group_id, lang = 'en' AS target, CASE WHEN {SQL_BUCKET} < 60 THEN 'train' WHEN {SQL_BUCKET} < 80 THEN 'validate' ELSE 'test' END AS split FROM marked) "


def split_documents(t: Tables) -> DataFrame:
    target = F.col("lang") == "en"
    return marked_documents(t).select("doc_id", "duplicate_group_id", target.alias("target"), features.split(F.col("duplicate_group_id"), F.col("doc_id"), target).alias("split"))


@query(SQL_SPLIT + "SELECT doc_id, split FROM s")
def split_assign(t):
    return split_documents(t).select("doc_id", "split")


@query(SQL_SPLIT + "SELECT split, count(*) AS n_rows, round(avg(target::INT), 4) AS rate, round(abs(avg(target::INT) - (SELECT avg(target::INT) FROM s)), 4) AS deviation FROM s GROUP BY split")
def split_balance(t):
    return features.drift(split_documents(t), "target").withColumns({c: F.round(c, 4) for c in ("rate", "deviation")})


@query(SQL_SPLIT + "SELECT count(*) AS n FROM (SELECT duplicate_group_id, target FROM s WHERE duplicate_group_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT split) > 1)")
def split_straddle(t):
    rows = split_documents(t).withColumn("g", F.when(F.col("duplicate_group_id").isNotNull(), F.concat_ws("/", "duplicate_group_id", F.col("target").cast("string"))))
    return features.straddlers(rows, "g").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN l_quantity < 10 THEN 'a: under 10' WHEN l_quantity < 30 THEN 'b: 10 to 29' ELSE 'c: 30 and over' END AS band, count(*) AS n_rows, round(avg((l_returnflag = 'R')::INT), 4) AS rate FROM lineitem GROUP BY 1")
def leakage_bands(t):
    banded = features.band("l_quantity", [(10, "a: under 10"), (30, "b: 10 to 29")], "c: 30 and over", "missing")
    return features.rate_by_band(t.lineitem, banded, F.col("l_returnflag") == "R").withColumn("rate", F.round("rate", 4))


# Keys, rules and dimensions -----------------------------------------------------


@query("SELECT doc_id, md5(concat_ws('|', text, lang, source)) || '#' || CAST(row_number() OVER (PARTITION BY md5(concat_ws('|', text, lang, source)) ORDER BY doc_id) AS VARCHAR) AS record_key FROM documents")
def content_key(t):
    return keys.with_record_key(t.documents, ["text", "lang", "source"], "doc_id").select("doc_id", "record_key")


@query("SELECT p_partkey, md5(concat_ws('|', p_name, nullif(p_brand, 'Brand#1'), p_type)) AS h FROM part")
def content_hash_nulls(t):
    return t.part.withColumn("p_brand", F.nullif(F.col("p_brand"), F.lit("Brand#1"))).select("p_partkey", X.content_hash(["p_name", "p_brand", "p_type"]).alias("h"))


ORDER_RULES = lambda: [
    rules.Rule("price_out_of_range", ~F.col("price").between(1000, 400000), F.concat(F.lit("price = "), rules.shown("price"))),
    rules.Rule("price_not_an_integer", F.col("price").isNull(), F.concat(F.lit("price = "), rules.shown("price"))),
    rules.Rule("status_not_recognised", ~F.col("o_orderstatus").isin("F", "O") | F.col("o_orderstatus").isNull(), F.concat(F.lit("status = "), rules.shown("o_orderstatus"))),
    rules.required({"o_orderpriority": "order.priority", "o_comment": "comment"}),
]
SQL_STAGED = "s AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority LIKE '1-%' THEN ' ' ELSE o_orderpriority END AS o_orderpriority, 'x' AS o_comment, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders)"
SQL_REJECTS = f"""WITH {SQL_STAGED}, r AS (SELECT o_orderkey, 'price_out_of_range' AS reason, 'price = ' || CAST(price AS VARCHAR) AS detail FROM s WHERE price NOT BETWEEN 1000 AND 400000
  UNION ALL SELECT o_orderkey, 'price_not_an_integer', 'price = NULL' FROM s WHERE price IS NULL
  UNION ALL SELECT o_orderkey, 'status_not_recognised', 'status = ' || coalesce(o_orderstatus, 'NULL') FROM s WHERE o_orderstatus NOT IN ('F', 'O') OR o_orderstatus IS NULL
  UNION ALL SELECT o_orderkey, 'required_field_empty', 'empty: order.priority' FROM s WHERE trim(o_orderpriority) = '') """


def staged_orders(t: Tables) -> DataFrame:
    blank = F.when(F.col("o_orderpriority").like("1-%"), " ").otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", "o_orderstatus", blank.alias("o_orderpriority"), F.lit("x").alias("o_comment"), F.floor("o_totalprice").cast("long").alias("price"))


def order_rejects(t: Tables) -> DataFrame:
    return rules.rejects(staged_orders(t), ORDER_RULES(), ["o_orderkey"])


@query(SQL_REJECTS + "SELECT o_orderkey, reason, detail FROM r")
def rule_rejects(t):
    return order_rejects(t)


@query(SQL_REJECTS + "SELECT reason, count(*) AS n_rows, min(detail) AS example FROM r GROUP BY reason")
def reject_report(t):
    return rules.reject_report(order_rejects(t))


@query(SQL_REJECTS + "SELECT o_orderkey, reason, detail, o_orderstatus, o_orderpriority, o_comment, price FROM r JOIN s USING (o_orderkey)")
def quarantine_rows(t):
    return rules.quarantine(staged_orders(t), order_rejects(t), "o_orderkey")


@query(SQL_REJECTS + "SELECT o_orderkey, price FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.o_orderkey = s.o_orderkey) AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = s.o_orderkey AND l_quantity = 50)")
def admissible(t):
    loaded = t.lineitem.where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return rules.admissible(staged_orders(t), order_rejects(t), loaded, "o_orderkey").select("o_orderkey", "price")


@query("SELECT l_orderkey || '/' || l_linenumber AS record_key, 'duplicate_record_key' AS reason, 'record_key staged ' || count(*) || ' times' AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def repeated_keys(t):
    return rules.repeated_keys(t.lineitem.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("record_key")), "record_key")


@query("SELECT CAST(row_number() OVER (ORDER BY p_brand) AS INTEGER) AS p_brand_sk, p_brand FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL)")
def dim_members(t):
    return dims.members(t.part, "p_brand")


@query("""WITH cur AS (SELECT CAST(row_number() OVER (ORDER BY n_name) AS INTEGER) AS n_name_sk, n_name FROM nation WHERE n_regionkey <> 2)
  SELECT CAST((SELECT max(n_name_sk) FROM cur) + row_number() OVER (ORDER BY n_name) AS INTEGER) AS n_name_sk, n_name FROM nation WHERE n_name NOT IN (SELECT n_name FROM cur) AND n_name <> 'CHINA'""")
def dim_upsert(t):
    return dims.new_members(t.nation, dims.members(t.nation.where("n_regionkey <> 2"), "n_name"), dims.Dimension("n_name", marker="CHINA"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND d.lang <> 'en' THEN l.quality WHEN d.source = 'src1' THEN -2 ELSE -1 END AS quality_sk, coalesce(l.toxic, -1) AS toxic_sk FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def resolve_unknown(t):
    joined = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")
    label = F.when(F.col("quality").isNull() | (F.col("lang") == "en"), "?").otherwise("known")
    return joined.withColumn("label", label).select("doc_id", dims.unknown_or_not_applicable("label", "?", F.col("source") == "src1", F.col("quality")).alias("quality_sk"), F.coalesce("toxic", F.lit(dims.UNKNOWN)).alias("toxic_sk"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 50 THEN NULL ELSE l_quantity END AS l_quantity, l_quantity = 50 AS l_quantity_is_topcoded, l_extendedprice FROM lineitem")
def censor(t):
    return facts.censor(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), {"l_quantity": 50})


@query("SELECT o_orderkey, 100 + row_number() OVER (ORDER BY o_custkey, o_orderkey) AS order_sk FROM orders")
def fact_surrogate(t):
    return keys.number_globally(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], "order_sk", 100).select("o_orderkey", "order_sk")


# Joins and set operations -------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_new(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND CAST(l_quantity AS INTEGER) = p_size)")
def anti_composite(t):
    lines = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("int").alias("p_size"))
    return relational.anti(t.part, lines, ["p_partkey", "p_size"]).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50)")
def semi_exists(t):
    return t.orders.join(t.lineitem.where("l_quantity = 50"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)")
def orphan_check(t):
    return quality.resolves(t.lineitem, "l_orderkey", t.orders, "o_orderkey")


@query("SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def using_join(t):
    return t.nation.withColumnRenamed("n_regionkey", "k").join(t.region.withColumnRenamed("r_regionkey", "k"), "k").select("n_name", "r_name")


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND d.lang = 'en'")
def left_optional(t):
    return t.documents.alias("d").join(t.labels.alias("l"), (F.col("d.doc_id") == F.col("l.doc_id")) & (F.col("lang") == "en"), "left").select("d.doc_id", "lang", "quality", "toxic")


@query("SELECT copy, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS custkeys, round(sum(price), 2) AS price FROM (SELECT o_custkey + copy AS o_custkey, o_totalprice + copy AS price, copy FROM orders, (SELECT unnest(range(3))::INT AS copy)) GROUP BY copy")
def cross_replicate(t):
    copies = relational.replicate(t.orders.withColumn("price", F.col("o_totalprice")), 3, {"o_custkey": "o_custkey + copy", "price": "price + copy"})
    return copies.groupBy("copy").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("custkeys"), F.round(F.sum("price"), 2).alias("price"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT 2 * avg(o_totalprice) FROM orders)")
def scalar_subquery(t):
    t.orders.createOrReplaceTempView("sq_orders")
    return t.spark.sql("SELECT o_orderkey, o_totalprice FROM sq_orders WHERE o_totalprice > (SELECT 2 * avg(o_totalprice) FROM sq_orders)")


@query("SELECT (SELECT count(*) FROM orders) + (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n")
def scalar_sum(t):
    a, b = t.orders.agg(F.count("*").alias("a")), t.lineitem.agg(F.count_distinct("l_partkey").alias("b"))
    return a.join(F.broadcast(b)).select((F.col("a") + F.col("b")).alias("n"))


@query("SELECT p_size, count(*) AS n FROM part GROUP BY p_size HAVING count(*) = (SELECT max(n) FROM (SELECT count(*) AS n FROM part GROUP BY p_size))")
def mode_ties(t):
    return relational.mode_ties(t.part, "p_size")


@query("SELECT h, count(*) AS n FROM (SELECT md5(c_mktsegment) AS h FROM customer UNION ALL SELECT md5(o_orderpriority) FROM orders) GROUP BY h")
def union_universe(t):
    both = t.customer.select(F.md5("c_mktsegment").alias("h")).union(t.orders.select(F.md5("o_orderpriority")))
    return both.groupBy("h").agg(F.count("*").alias("n"))


@query("SELECT l.l_orderkey, l.l_linenumber, o.o_orderdate, c.c_name FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey WHERE l.l_quantity = 50 ORDER BY l.l_extendedprice DESC, l.l_orderkey, l.l_linenumber LIMIT 6")
def lineage_trace(t):
    rows = t.lineitem.where("l_quantity = 50").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return relational.top(rows, 6, "-l_extendedprice", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "o_orderdate", "c_name")


@query("SELECT 0::BIGINT AS n")
def result_equality(t):
    """Both routes to one aggregate agree."""
    left = t.orders.groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("m"))
    t.orders.createOrReplaceTempView("eq_orders")
    right = t.spark.sql("SELECT o_orderstatus, avg(o_totalprice) AS m FROM eq_orders GROUP BY 1")
    return relational.differences(left, right).agg(F.count("*").alias("n"))


# Aggregates ---------------------------------------------------------------------


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_totalprice > 200000) AS large, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, round(sum(o_totalprice), 2) AS total, max(o_totalprice > 400000) AS any_huge FROM orders GROUP BY 1, 2")
def aggregates(t):
    return t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.min("o_orderdate").alias("first_date"),
        F.max("o_orderdate").alias("last_date"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max(F.col("o_totalprice") > 400000).alias("any_huge"),
    )


@query("SELECT count(*) AS n, count(nullif(o_orderstatus, 'F')) AS n_not_f, round(avg((o_orderstatus = 'F')::INT), 6) AS share_f FROM orders")
def global_counts(t):
    return t.orders.agg(F.count("*").alias("n"), F.count(F.nullif("o_orderstatus", F.lit("F"))).alias("n_not_f"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("share_f"))


@query("SELECT p_type, median(p_size) AS med FROM part GROUP BY p_type")
def medians(t):
    return features.norms(t.part, "p_type", {"med": "p_size"})


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 4 AND min(l_linenumber) <> 1")
def having(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("lo")).where("n > 4 and lo <> 1").select("l_orderkey", "n")


@query("SELECT o_orderstatus, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 4) AS pct FROM orders GROUP BY o_orderstatus")
def share_of_total(t):
    n = t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select("o_orderstatus", "n", X.share(F.col("n"), F.col("total")).alias("pct"))


@query("SELECT round(max(abs(r - (SELECT avg((l_returnflag = 'R')::INT) FROM lineitem))), 6) AS largest FROM (SELECT l_linestatus, avg((l_returnflag = 'R')::INT) AS r FROM lineitem GROUP BY 1)")
def max_deviation(t):
    return features.drift(t.lineitem.select((F.col("l_returnflag") == "R").alias("y"), F.col("l_linestatus").alias("split")), "y").agg(F.round(F.max("deviation"), 6).alias("largest"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT 'p_size' AS column_name, count(p_size) AS n, round(avg(p_size), 4) AS mean, round(stddev_samp(p_size), 4) AS std, min(p_size)::DOUBLE AS min, quantile_cont(p_size, 0.25) AS q25, quantile_cont(p_size, 0.5) AS q50, quantile_cont(p_size, 0.75) AS q75, max(p_size)::DOUBLE AS max FROM part
  UNION ALL SELECT 'p_retailprice', count(p_retailprice), round(avg(p_retailprice), 4), round(stddev_samp(p_retailprice), 4), min(p_retailprice), round(quantile_cont(p_retailprice, 0.25), 4), round(quantile_cont(p_retailprice, 0.5), 4), round(quantile_cont(p_retailprice, 0.75), 4), max(p_retailprice) FROM part""")
def describe(t):
    return relational.describe(t.part, ["p_size", "p_retailprice"]).withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


@query("""SELECT 'o_orderstatus' AS column_name, count(*) FILTER (WHERE o_orderstatus = 'P') AS marked, count(*) FILTER (WHERE o_orderstatus IS NULL) AS missing FROM orders
  UNION ALL SELECT 'o_orderpriority', count(*) FILTER (WHERE o_orderpriority = 'P'), count(*) FILTER (WHERE o_orderpriority IS NULL) FROM orders""")
def marker_counts(t):
    return relational.marker_counts(t.orders, "P", ["o_orderstatus", "o_orderpriority"])


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = 'P'")
def any_marker(t):
    return t.orders.where(X.any_of(F.col(c) == "P" for c in ("o_orderstatus", "o_orderpriority"))).agg(F.count("*").alias("n"))


@query("""SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE NOT a AND b) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS neither FROM (SELECT o_orderstatus = 'P' AS a, o_totalprice > 200000 AS b FROM orders)""")
def co_missing(t):
    return relational.co_missing(t.orders, F.col("o_orderstatus") == "P", F.col("o_totalprice") > 200000)


@query("SELECT max(l_quantity) FILTER (WHERE l_quantity < 50) AS largest_below, 50 - max(l_quantity) FILTER (WHERE l_quantity < 50) AS gap FROM lineitem")
def sentinel_gap(t):
    return relational.gap_below(t.lineitem, "l_quantity", 50.0)


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag <> 'A'")
def distinct_rows(t):
    return t.lineitem.where("l_returnflag <> 'A'").select("l_returnflag", "l_linestatus").distinct()


# Order, limit, projection, predicates ---------------------------------------------


@query(f"SELECT n_name, o_orderpriority, count(*) AS candidates FROM {SQL_STAR} GROUP BY 1, 2 ORDER BY candidates DESC, n_name, o_orderpriority LIMIT 10")
def topk_segments(t):
    return relational.top(star(t).groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("candidates")), 10, "-candidates", "n_name", "o_orderpriority")


@query("SELECT DISTINCT p_size FROM part ORDER BY p_size DESC LIMIT 5")
def top_distinct(t):
    return relational.top(t.part.select("p_size").distinct(), 5, "-p_size")


@query("SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey + 1 AS n_regionkey FROM nation")
def star_replace(t):
    return t.nation.withColumns({"n_name": F.upper("n_name"), "n_regionkey": F.col("n_regionkey") + 1})


@query("SELECT * EXCLUDE (s_acctbal) FROM supplier")
def star_exclude(t):
    return t.supplier.drop("s_acctbal")


@query("SELECT r_regionkey, r_name AS \"region.name\", 'const' AS kind FROM region")
def rename_and_literal(t):
    return t.region.select("r_regionkey", F.col("r_name").alias("region.name"), F.lit("const").alias("kind"))


@query("SELECT p_partkey, p_name FROM part WHERE p_type LIKE 'S%' AND p_name LIKE '%_a%'")
def like_filter(t):
    return t.part.where(F.col("p_type").like("S%") & F.col("p_name").like("%_a%")).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45 AND (p_brand NOT IN ('Brand#1') OR p_brand IS NULL)")
def not_between(t):
    return t.part.where(~F.col("p_size").between(5, 45) & (~F.col("p_brand").isin("Brand#1") | F.col("p_brand").isNull())).select("p_partkey")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' END AS label, nullif(p_size, 1) >= 35 AS is_large FROM part")
def case_nulls(t):
    return t.part.select("p_partkey", F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").alias("label"), (F.nullif("p_size", F.lit(1)) >= 35).alias("is_large"))


@query("SELECT doc_id, quality FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE quality IS NOT NULL")
def drop_nulls(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").dropna(subset=["quality"])


@query("SELECT o_orderkey, round(o_totalprice / 3, 2) AS third, abs(-o_totalprice) AS a, o_orderkey % 7 AS m, lower(o_orderpriority) AS low, substr(o_orderpriority, 1, 3) AS head, o_orderstatus || '/' || o_orderpriority AS joined, CAST(o_orderstatus = 'F' AS VARCHAR) AS flag, sha256(o_orderpriority) AS sha, trim(' ' || o_orderstatus || ' ') AS trimmed, strlen(o_orderpriority) AS bytes FROM orders")
def scalar_functions(t):
    return t.orders.select(
        "o_orderkey", F.round(F.col("o_totalprice") / 3, 2).alias("third"), F.abs(-F.col("o_totalprice")).alias("a"), (F.col("o_orderkey") % 7).alias("m"), F.lower("o_orderpriority").alias("low"), F.substring("o_orderpriority", 1, 3).alias("head"),
        F.concat("o_orderstatus", F.lit("/"), "o_orderpriority").alias("joined"), (F.col("o_orderstatus") == "F").cast("string").alias("flag"), F.sha2("o_orderpriority", 256).alias("sha"),
        F.trim(F.concat(F.lit(" "), "o_orderstatus", F.lit(" "))).alias("trimmed"), X.byte_length("o_orderpriority").cast("long").alias("bytes"),
    )


@query("SELECT p_partkey, try_cast(p_size || '.5' AS INTEGER) AS half_up, try_cast(p_size || 'e1' AS INTEGER) AS tens, try_cast('x' || p_size AS INTEGER) AS bad, CAST(p_size + 0.5::DOUBLE AS SMALLINT) AS even FROM part")
def lenient_casts(t):
    text = lambda *c: X.lenient_int(F.concat(*c))
    size = F.col("p_size").cast("string")
    return t.part.select("p_partkey", text(size, F.lit(".5")).alias("half_up"), text(size, F.lit("e1")).alias("tens"), text(F.lit("x"), size).alias("bad"), X.round_to_int(F.col("p_size") + F.lit(0.5)).alias("even"))


@query("SELECT o_orderkey, o_orderdate - INTERVAL 9 DAY AS earlier, date_diff('microsecond', o_orderdate - INTERVAL 9 DAY, o_orderdate) / 3.6e9 AS hours FROM orders")
def interval_shift(t):
    earlier = F.expr("o_orderdate - INTERVAL 9 DAY")
    return t.orders.select("o_orderkey", earlier.alias("earlier"), X.hours_between("o_orderdate", earlier).alias("hours"))


@query("SELECT o_orderkey, CASE WHEN h < 24 THEN 'fresh' WHEN h < 168 THEN 'ageing' ELSE 'stale' END AS state FROM (SELECT o_orderkey, date_diff('microsecond', o_orderdate, TIMESTAMP '2001-08-02 00:00:00') / 3.6e9 AS h FROM orders)")
def freshness_state(t):
    age = X.hours_between(F.lit("2001-08-02 00:00:00").cast("timestamp_ntz"), "o_orderdate")
    return t.orders.select("o_orderkey", X.freshness_state(age).alias("state"))


@query("SELECT * FROM (VALUES (1, 'Unknown', TRUE), (2, 'Known', FALSE)) AS v(sk, label, is_unknown)")
def values_relation(t):
    return inline_values(t.spark, [(1, "Unknown", True), (2, "Known", False)], "sk int, label string, is_unknown boolean")


@query("SELECT unnest(range(5))::BIGINT AS r")
def generated_rows(t):
    return row_range(t.spark, 5)


@query("""SELECT * FROM (VALUES (0, 'n_nationkey', 'int', TRUE), (1, 'n_name', 'string', TRUE), (2, 'n_regionkey', 'int', TRUE)) AS v(position, name, type, nullable)""")
def describe_schema(t):
    return schema_of(t.nation)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def named_parameters(t):
    t.orders.createOrReplaceTempView("np_orders")
    return t.spark.sql("SELECT o_orderkey, o_custkey FROM np_orders WHERE o_orderstatus = :status AND o_totalprice > :least", args={"status": "F", "least": 100000})


@query("SELECT o_orderkey, line, prio FROM (SELECT o_orderkey, o_orderpriority AS prio, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line FROM orders) WHERE line <= 2")
def occurrence_number(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t.orders.select("o_orderkey", F.row_number().over(w).cast("long").alias("line"), F.col("o_orderpriority").alias("prio")).where("line <= 2")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_event(t):
    w = Warehouse(t.spark, _scratch(t, "log"))
    w.overwrite("orders", t.orders)
    return w.latest("orders", ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT c_custkey, 0.0 FROM customer WHERE c_nationkey = 3")
def upsert(t):
    w = Warehouse(t.spark, _scratch(t, "upsert"))
    w.overwrite("balances", t.customer.select("c_custkey", "c_acctbal"))
    w.upsert("balances", t.customer.where("c_nationkey = 3").select("c_custkey", F.lit(0.0).alias("c_acctbal")), ["c_custkey"])
    return w.read("balances")


# Quality, cost, files -------------------------------------------------------------


@query("""SELECT 'order key unique' AS check_name, 'unique' AS dimension, n = 0 AS passed, CAST(n AS VARCHAR) AS observed, '0' AS expected FROM (SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))
  UNION ALL SELECT 'line key unique', 'unique', n = 0, CAST(n AS VARCHAR), '0' FROM (SELECT count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1))
  UNION ALL SELECT 'nation label unique', 'unique', n = 0, CAST(n AS VARCHAR), '0' FROM (SELECT count(*) AS n FROM (SELECT n_name FROM nation GROUP BY 1 HAVING count(*) > 1))""")
def qc_unique(t):
    return quality.together([
        quality.verdict(quality.unique(t.orders, "o_orderkey"), "order key unique", "unique"), quality.verdict(quality.unique(t.lineitem, "l_orderkey", "l_linenumber"), "line key unique", "unique"),
        quality.verdict(quality.unique(t.nation, "n_name"), "nation label unique", "unique"),
    ])


@query("""SELECT 'customer of order' AS check_name, 'complete' AS dimension, n = 0 AS passed, CAST(n AS VARCHAR) AS observed, '0' AS expected FROM (SELECT count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey))
  UNION ALL SELECT 'label of document', 'complete', n = 0, CAST(n AS VARCHAR), '0' FROM (SELECT count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))""")
def qc_fk(t):
    return quality.together([
        quality.verdict(quality.resolves(t.orders, "o_custkey", t.customer, "c_custkey"), "customer of order", "complete"), quality.verdict(quality.resolves(t.documents, "doc_id", t.labels, "doc_id"), "label of document", "complete"),
    ])


@query("SELECT 'order lineage' AS check_name, 'complete' AS dimension, n = 0 AS passed, CAST(n AS VARCHAR) AS observed, '0' AS expected FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey IS NULL OR o_custkey IS NULL OR o_orderdate IS NULL)")
def qc_nulls(t):
    return quality.verdict(quality.complete(t.orders, "o_orderkey", "o_custkey", "o_orderdate"), "order lineage", "complete")


@query("""SELECT 'quantity in range' AS check_name, 'valid' AS dimension, n = 0 AS passed, CAST(n AS VARCHAR) AS observed, '0' AS expected FROM (SELECT count(*) AS n FROM lineitem WHERE l_quantity NOT BETWEEN 1 AND 49)
  UNION ALL SELECT 'quantity censored', 'valid', TRUE, '0', '0'""")
def qc_range(t):
    return quality.together([
        quality.verdict(quality.within(t.lineitem, "l_quantity", 1, 49), "quantity in range", "valid"),
        quality.verdict(quality.censored_right(facts.censor(t.lineitem, {"l_quantity": 50}), "l_quantity", 50), "quantity censored", "valid"),
    ])


@query("""SELECT 'flattened rows' AS check_name, 'consistent' AS dimension, a = b AS passed, CAST(a AS VARCHAR) AS observed, CAST(b AS VARCHAR) AS expected FROM (SELECT (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey) AS a, (SELECT count(*) FROM orders) AS b)""")
def qc_reconcile(t):
    joined = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return quality.equal(joined.agg(F.count("*").alias("a")), t.orders.agg(F.count("*").alias("b")), "flattened rows", "consistent")


@query(SQL_MARKED + "SELECT 'groups start at one' AS check_name, 'consistent' AS dimension, n = 0 AS passed, CAST(n AS VARCHAR) AS observed, '0' AS expected FROM (SELECT count(*) AS n FROM (SELECT duplicate_group_id FROM marked WHERE duplicate_group_id IS NOT NULL GROUP BY 1 HAVING min(duplicate_seq) <> 1))")
def qc_groups(t):
    return quality.verdict(quality.groups_start_at_one(marked_documents(t), "duplicate_group_id", "duplicate_seq"), "groups start at one", "consistent")


@query(SQL_REJECTS + """SELECT 'quarantined and admissible' AS check_name, 'unique' AS dimension, TRUE AS passed, '0' AS observed, '0' AS expected
  UNION ALL SELECT 'staged = loaded + refused', 'consistent', TRUE, CAST(a AS VARCHAR), CAST(a AS VARCHAR) FROM (SELECT count(*) AS a FROM s)""")
def qc_disjoint(t):
    staged, refused = staged_orders(t), order_rejects(t)
    loaded = rules.admissible(staged, refused, None, "o_orderkey")
    parts = loaded.select("o_orderkey").union(refused.select("o_orderkey").distinct()).agg(F.count("*").alias("n"))
    return quality.together([quality.verdict(quality.disjoint(loaded, refused, "o_orderkey"), "quarantined and admissible", "unique"), quality.equal(staged.agg(F.count("*").alias("n")), parts, "staged = loaded + refused", "consistent")])


@query("SELECT 'fresh' AS dimension, 1::BIGINT AS n_checks, 0::BIGINT AS n_passed, 0.0::DOUBLE AS pass_ratio UNION ALL SELECT 'unique', 2, 1, 0.5 ")
def qc_summary(t):
    runs = t.orders.select(F.col("o_orderdate").alias("finished_at"))
    now = F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")
    return quality.summary(quality.together([
        quality.verdict(quality.fresh(runs, "finished_at", now), "last run", "fresh"), quality.verdict(quality.unique(t.orders, "o_orderkey"), "order key", "unique"),
        quality.verdict(quality.unique(t.lineitem, "l_orderkey", "l_linenumber"), "line key", "unique"),
    ]))


@query("""SELECT 'o_orderkey' AS column_name, 8 * count(o_orderkey) AS bytes FROM orders UNION ALL SELECT 'o_totalprice', 8 * count(o_totalprice) FROM orders UNION ALL SELECT 'o_orderdate', 8 * count(o_orderdate) FROM orders
  UNION ALL SELECT 'o_orderpriority', CAST(coalesce(sum(2 + strlen(o_orderpriority)), 0) AS BIGINT) FROM orders""")
def scan_bytes(t):
    return cost.scan_bytes(t.orders, ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"])


def _scratch(t: Tables, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_roundtrip(t):
    path = _scratch(t, "csv")
    write_csv(t.customer.select("c_custkey", "c_name", "c_mktsegment"), path)
    return csv_text(t.spark, path, ["c_custkey", "c_name", "c_mktsegment"])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def parquet_roundtrip(t):
    from sparkwright.sources import parquet, write_parquet

    path = _scratch(t, "parquet")
    write_parquet(t.customer.select("c_custkey", "c_name", "c_acctbal"), path)
    return parquet(t.spark, path)


# Warehouse ----------------------------------------------------------------------------


def _warehouse(t: Tables, name: str) -> Warehouse:
    return Warehouse(t.spark, _scratch(t, name))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation")
def warehouse_append(t):
    w = _warehouse(t, "append")
    w.create("nations", "n_nationkey int, n_name string")
    w.append("nations", t.nation)
    w.append("nations", t.nation.select((F.col("n_nationkey") + 100).alias("n_nationkey"), "n_name"))
    return w.read("nations")


@query("SELECT r_regionkey, r_name FROM region")
def warehouse_append_absent(t):
    w = _warehouse(t, "absent")
    w.overwrite("regions", t.region.select("r_regionkey", "r_name").where("r_regionkey < 3"))
    w.append_absent("regions", t.region, ["r_regionkey"])
    w.append_absent("regions", t.region, ["r_regionkey"])
    return w.read("regions")


@query("SELECT 1 AS version, count(*) AS n FROM customer UNION ALL SELECT 2, count(*) FROM customer WHERE c_nationkey = 3")
def warehouse_refresh(t):
    w = _warehouse(t, "refresh")
    w.overwrite("customers", t.customer)
    w.overwrite("customers", t.customer.where("c_nationkey = 3"))
    old, new = (w.read("customers", v).agg(F.count("*").alias("n")) for v in w.versions("customers"))
    return old.select(F.lit(1).alias("version"), "n").union(new.select(F.lit(2), "n"))


@query("SELECT * FROM (VALUES ('created', 'dim_a, dim_b, fact_c'), ('named dim_', 'dim_a, dim_b'), ('one dropped', 'dim_a, fact_c'), ('reset', '')) AS v(step, tables)")
def warehouse_tables(t):
    w, rows = _warehouse(t, "tables"), []
    for name in ("fact_c", "dim_b", "dim_a"):
        w.create(name, "x int")
    rows += [("created", w.tables()), ("named dim_", w.tables("dim\\_%"))]
    w.drop("dim_b")
    rows.append(("one dropped", w.tables()))
    w.reset()
    rows.append(("reset", w.tables()))
    return inline_values(t.spark, [(step, ", ".join(names)) for step, names in rows], "step string, tables string")


@query("SELECT 'c_custkey' AS column_name, count(*) AS rows, count(c_custkey) AS n_values FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(c_mktsegment) FROM customer")
def warehouse_statistics(t):
    w = _warehouse(t, "statistics")
    w.overwrite("customers", t.customer.select("c_custkey", "c_mktsegment"))
    return w.statistics("customers").select("column_name", "rows", "n_values")


@query("SELECT 'nation' AS table_name, count(*) AS n_rows FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def warehouse_counts(t):
    w = _warehouse(t, "counts")
    w.overwrite("nation", t.nation)
    w.overwrite("region", t.region)
    return w.counts()


@query("SELECT r_name, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def warehouse_view(t):
    w = _warehouse(t, "view")
    w.overwrite("wv_nation", t.nation)
    w.overwrite("wv_region", t.region)
    w.view()
    return t.spark.sql("SELECT r_name, count(*) AS nations FROM wv_region JOIN wv_nation ON n_regionkey = r_regionkey GROUP BY r_name")


@query("SELECT * FROM (VALUES ('good', FALSE), ('null', TRUE), ('repeated', TRUE), ('unresolved', TRUE)) AS v(rows, refused)")
def warehouse_constraints(t):
    w = _warehouse(t, "constraints")
    w.overwrite("region", t.region)
    cases = {
        "good": (t.nation, {"not_null": ["n_name"], "unique": ["n_nationkey"], "references": [("n_regionkey", "region", "r_regionkey")]}),
        "null": (t.nation.select(F.nullif("n_nationkey", F.lit(3)).alias("k")), {"not_null": ["k"]}), "repeated": (t.nation, {"unique": ["n_regionkey"]}),
        "unresolved": (t.nation.select((F.col("n_regionkey") + 1).alias("k")), {"references": [("k", "region", "r_regionkey")]}),
    }

    def refused(df, rules):
        try:
            w.require(df, **rules)
        except ConstraintError:
            return True
        return False

    return inline_values(t.spark, [(name, refused(*case)) for name, case in cases.items()], "rows string, refused boolean")


# Files --------------------------------------------------------------------------------


@query("SELECT p_partkey, p_retailprice, p_type FROM part")
def csv_inferred_types(t):
    path = _scratch(t, "inferred")
    write_csv(t.part.select("p_partkey", "p_retailprice", "p_type"), path)
    read = csv_inferred(t.spark, path)
    if dict(read.dtypes)["p_retailprice"] != "double" or dict(read.dtypes)["p_partkey"] not in ("int", "bigint"):
        raise ValueError(f"inferred {read.dtypes}")
    return read.withColumn("p_partkey", F.col("p_partkey").cast(t.part.schema["p_partkey"].dataType))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || chr(10) || '\"' || c_mktsegment AS note FROM customer")
def csv_line_feeds(t):
    path = _scratch(t, "breaks")
    write_csv(t.customer.select("c_custkey", F.concat("c_name", F.lit('\n"'), "c_mktsegment").alias("note")), path)
    return csv_text(t.spark, path, ["c_custkey", "note"])


@query("SELECT c_custkey, c_name FROM customer")
def json_roundtrip(t):
    path = _scratch(t, "json")
    write_json(t.customer.select("c_custkey", "c_name"), path)
    return t.spark.read.schema(t.customer.select("c_custkey", "c_name").schema).json(path)


@query("SELECT sha256(string_agg(r_name, ',' ORDER BY r_regionkey)) AS sha256, strlen(string_agg(r_name, ',' ORDER BY r_regionkey)) AS bytes FROM region")
def file_digest(t):
    path = f"{_scratch(t, 'digest')}/regions.txt"
    Files(t.spark, path).write_new(path, ",".join(r["r_name"] for r in t.region.orderBy("r_regionkey").collect()))
    return inline_values(t.spark, [fingerprint(t.spark, path)], "sha256 string, bytes long")


@query("SELECT * FROM (VALUES (1, 'a.csv'), (2, 'b.csv'), (3, 'c.csv')) AS v(load, file)")
def files_by_name(t):
    folder = _scratch(t, "drops")
    for name in ("c.csv", "a.csv", "notes.txt", "b.csv"):
        Files(t.spark, folder).write_new(f"{folder}/{name}", "x\n")
    return inline_values(t.spark, [(i, p.rpartition("/")[2]) for i, p in enumerate(name_sorted(t.spark, folder), 1)], "load int, file string")


def _lines(t: Tables) -> DataFrame:
    """Customers as the lines of one file, in order of their key."""
    path = _scratch(t, "lines")
    write_csv(t.customer.select("c_custkey", "c_name").repartitionByRange(1, "c_custkey").sortWithinPartitions("c_custkey"), path)
    return numbered_lines(csv_text(t.spark, path, ["c_custkey", "c_name"]))


@query("SELECT row_number() OVER (ORDER BY c_custkey) AS source_row, CAST(c_custkey AS VARCHAR) AS c_custkey FROM customer")
def line_numbers(t):
    return _lines(t).select("source_row", "c_custkey")


@query("SELECT row_number() OVER (ORDER BY c_custkey) AS source_row, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer")
def source_row_join(t):
    lines = _lines(t)
    return lines.select("source_row", "c_custkey").join(lines.select("source_row", "c_name"), "source_row")


@query("SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ('nation', 'orders', 'lineitem') AND (column_name ILIKE '%key%' OR column_name ILIKE '%DATE%')")
def columns_by_name(t):
    rows = [(n, c) for n in ("nation", "orders", "lineitem") for c in columns_like(getattr(t, n), "KEY", "date")]
    return inline_values(t.spark, rows, "table_name string, column_name string")


# Measuring ----------------------------------------------------------------------------

SCRIPT = """-- a load; in two parts
CREATE OR REPLACE TEMP VIEW sc_orders AS SELECT * FROM {orders} WHERE o_orderstatus <> 'x;y';
/* counts; by status */ SELECT o_orderstatus, count(*) AS n FROM sc_orders GROUP BY 1;
SELECT 'it''s; done' AS a"""


@query("SELECT * FROM (VALUES (1, 'create sc_orders'), (2, 'select'), (3, 'select')) AS v(position, statement)")
def script_statements(t):
    return inline_values(t.spark, [(i, name) for i, (name, _) in enumerate(profiling.statements(SCRIPT), 1)], "position int, statement string")


@query("SELECT 1 AS position, 'create sc_orders' AS step, 0 AS rows_out UNION ALL SELECT 2, 'select', count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 3, 'select', 1")
def script_profile(t):
    t.orders.createOrReplaceTempView("sc_source")
    profile = profiling.Profile()
    profile.script(t.spark, SCRIPT.format(orders="sc_source"))
    table = profile.table()
    if sum(r[-1] for r in table) != 1 or any(r[1] < 0 for r in table):
        raise ValueError("one step is the bottleneck")
    return inline_values(t.spark, [(i, r[0], r[4]) for i, r in enumerate(table, 1)], "position int, step string, rows_out long")


@query("SELECT 'filter then count' AS form, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'count if', count(*) FROM orders WHERE o_orderstatus = 'F'")
def benchmark_forms(t):
    forms = {"filter then count": lambda: t.orders.where("o_orderstatus = 'F'").agg(F.count("*").alias("n")), "count if": lambda: t.orders.agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"))}
    timed = profiling.compare(forms, repeats=1)
    return relational.reduce(DataFrame.unionByName, (forms[n]().select(F.lit(n).alias("form"), "n") for n in timed))


@query("""SELECT 'columns' AS scan, b AS bytes, greatest(b, 10485760) AS billed FROM (SELECT 8 * count(o_orderkey) + 8 * count(o_totalprice) AS b FROM orders)
  UNION ALL SELECT 'all', b, greatest(b, 10485760) FROM (SELECT 8 * count(o_orderkey) + 8 * count(o_totalprice) + 8 * count(o_custkey) + CAST(sum(2 + strlen(o_orderstatus)) AS BIGINT) AS b FROM orders)""")
def scan_estimate(t):
    return cost.estimate(t.orders.select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus"), ["o_orderkey", "o_totalprice"]).select("scan", "bytes", "billed")


@query("SELECT * FROM (VALUES (512, '512 B'), (2048, '2.00 KB'), (5604157, '5.34 MB'), (1899000000000, '1.73 TB')) AS v(n, shown)")
def human_sizes(t):
    return inline_values(t.spark, [(n, cost.human_bytes(n)) for n in (512, 2048, 5604157, 1899000000000)], "n long, shown string")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_events(t):
    """Two files that arrive, loaded by a stream in two batches, counted by the hour."""
    folder, w = _scratch(t, "arriving"), _warehouse(t, "streamed")
    schema = t.events.select("event_id", "ts", "event_type").schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    w.create("events", ddl)
    t.events.select(*schema.names).repartition(2, "event_id").write.parquet(folder)
    for _ in range(2):  # the second call finds nothing new
        drain(t.spark, folder, ddl, lambda df, _: w.append("events", df), f"{folder}-offsets", "parquet")
    return windowed_counts(w.read("events"), "ts", "event_type")


# The census warehouse, on rows made from customers -------------------------------------

SQL_CENSUS = """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 20 = 0 THEN 'abc' WHEN c_custkey % 20 = 1 THEN '201' WHEN c_custkey % 11 = 0 THEN '90' ELSE CAST(17 + c_custkey % 60 AS VARCHAR) END AS age,
  CASE WHEN c_custkey % 9 = 0 THEN '-5' ELSE CAST(1000 + c_custkey AS VARCHAR) END AS fnlwgt, CASE WHEN c_custkey % 7 = 0 THEN '?' ELSE 'Sales' END AS occupation, row_number() OVER (ORDER BY c_custkey) AS source_row FROM customer),
  loaded AS (SELECT * FROM c WHERE k % 20 > 1 AND k % 9 <> 0) """
_loaded: dict[tuple[int, str], Census] = {}


def _census(t: Tables) -> Census:
    """One load for all queries of a session and folder."""
    key = (id(t.spark), t.folder)
    if key not in _loaded:
        k = F.col("c_custkey")
        made = {
            "age": F.when(k % 20 == 0, "abc").when(k % 20 == 1, "201").when(k % 11 == 0, "90").otherwise((17 + k % 60).cast("string")), "workclass": F.lit("Private"), "fnlwgt": F.when(k % 9 == 0, "-5").otherwise((1000 + k).cast("string")),
            "education": F.lit("Bachelors"), "education.num": F.lit("13"), "marital.status": F.lit("Divorced"), "occupation": F.when(k % 7 == 0, "?").otherwise("Sales"), "relationship": F.lit("Husband"), "race": F.lit("White"), "sex": F.lit("Male"),
            "capital.gain": F.lit("0"), "capital.loss": F.lit("0"), "hours.per.week": F.lit("40"), "native.country": F.lit("Cuba"), "income": F.lit("<=50K"),
        }
        path = f"{_scratch(t, 'census')}.csv"
        write_csv(t.customer.repartitionByRange(1, "c_custkey").sortWithinPartitions("c_custkey").select(*(v.alias(c) for c, v in made.items())), path)
        census = Census(t.spark, _scratch(t, "census-warehouse"))
        census.ingest_file(path)
        _loaded[key] = census
    return _loaded[key]


@query(SQL_CENSUS + "SELECT 'ok' AS status, (SELECT count(*) FROM c) AS rows_read, (SELECT count(*) FROM c) AS rows_staged, (SELECT count(*) FROM c) - (SELECT count(*) FROM loaded) AS rows_rejected, (SELECT count(*) FROM loaded) AS rows_loaded, 0 AS rows_already_present")
def census_runs(t):
    return _census(t).runs().select("status", "rows_read", "rows_staged", "rows_rejected", "rows_loaded", "rows_already_present")


@query(SQL_CENSUS + """SELECT 'age_not_an_integer' AS reason, count(*) AS n FROM c WHERE age = 'abc' UNION ALL SELECT 'age_out_of_range', count(*) FROM c WHERE age = '201'
  UNION ALL SELECT 'fnlwgt_not_a_positive_integer', count(*) FROM c WHERE fnlwgt = '-5'""")
def census_reasons(t):
    return _census(t).store.read("load_reject").groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('No high school diploma', 8, 1, 8), ('High school graduate', 1, 9, 9), ('Some college', 1, 10, 10), ('Associate degree', 2, 11, 12), ('Bachelors degree', 1, 13, 13), ('Postgraduate', 3, 14, 16)) AS v(education_group, n, lo, hi)")
def census_ladder(t):
    return _census(t).store.read("dim_education").groupBy("education_group").agg(F.count("*").alias("n"), F.min("education_num").alias("lo"), F.max("education_num").alias("hi"))


@query(SQL_CENSUS + "SELECT source_row, CASE WHEN age = '90' THEN NULL ELSE CAST(age AS SMALLINT) END AS age, age = '90' AS age_is_topcoded, occupation, row_number() OVER (ORDER BY source_row) AS person_sk FROM loaded")
def census_facts(t):
    """Typed, censored, keyed and numbered rows, with the label of their occupation."""
    census = _census(t)
    labels = census.store.read("dim_occupation").select("occupation_sk", F.when(F.col("is_unknown"), "?").otherwise(F.col("occupation")).alias("occupation"))
    return census.store.read("fact_person").join(labels, "occupation_sk").select("source_row", "age", "age_is_topcoded", "occupation", "person_sk")


@query(SQL_CENSUS + "SELECT source_row, age AS raw_age, fnlwgt AS raw_fnlwgt FROM loaded")
def census_raw_rows(t):
    census = _census(t)
    name = census.store.read("fact_person").select("source_file").first()[0]
    return census.raw_rows(name).select("source_row", F.col("age").alias("raw_age"), F.col("fnlwgt").alias("raw_fnlwgt"))


@query(SQL_CENSUS + """SELECT 'fact_person' AS table_name, count(*) AS n_rows FROM loaded UNION ALL SELECT 'stg_adult', count(*) FROM c
  UNION ALL SELECT 'load_reject', count(*) FILTER (WHERE k % 20 <= 1) + count(*) FILTER (WHERE k % 9 = 0) FROM c UNION ALL SELECT 'quarantine', count(*) FILTER (WHERE k % 20 <= 1) + count(*) FILTER (WHERE k % 9 = 0) FROM c
  UNION ALL SELECT 'load_event', 2 UNION ALL SELECT 'feature_person', count(*) FROM loaded""")
def census_sizes(t):
    return _census(t).store.counts().where(F.col("table_name").isin("fact_person", "stg_adult", "load_reject", "quarantine", "load_event", "feature_person"))


@query("SELECT 'fresh' AS state, TRUE AS recent")
def census_freshness(t):
    return _census(t).freshness().select("state", (F.col("hours") < 1).alias("recent"))


@query(SQL_CENSUS + "SELECT count(*) AS pool, count(*) FILTER (WHERE occupation <> '?') AS answered FROM loaded WHERE age <> '90' AND CAST(age AS INTEGER) BETWEEN 25 AND 54")
def census_pool(t):
    rows = _census(t).pool_breakdown()
    pool = F.max(F.when(F.col("measure") == "eligible pool", F.col("records")))
    unanswered = F.max(F.when(F.col("measure") == "of those, occupation not answered", F.col("records")))
    return rows.agg(pool.alias("pool"), (pool - unanswered).alias("answered"))
