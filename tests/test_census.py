"""The census warehouse on small files of our own."""

import pytest

from sparkwright.functions import lenient_int, round_to_int
from sparkwright.operators import keys, rules
from sparkwright.plans.census import COLUMNS, Census
from sparkwright.sources import Warehouse, html_report, numbered_lines, write_csv
from sparkwright.sources.store import ConstraintError

GOOD = {
    "age": "44", "workclass": "Private", "fnlwgt": "198282", "education": "Bachelors", "education.num": "13", "marital.status": "Divorced", "occupation": "Sales", "relationship": "Husband", "race": "White", "sex": "Male",
    "capital.gain": "0", "capital.loss": "0", "hours.per.week": "40", "native.country": "Cuba", "income": "<=50K",
}


def write(path, rows):
    lines = [",".join(f'"{c}"' for c in COLUMNS)] + [",".join(f'"{(GOOD | r)[c]}"' for c in COLUMNS) for r in rows]
    path.write_text("\n".join(lines) + "\n")
    return f"file:{path}"


@pytest.fixture(scope="module")
def census(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("drops")
    write(folder / "a.csv", [
        {}, {}, {}, {"age": "abc"}, {"age": "201"}, {"fnlwgt": "-5"}, {"education.num": "12"}, {"hours.per.week": "0"}, {"capital.gain": "-100"}, {"income": "50K+"}, {"sex": "Unknown"}, {"occupation": ""},
        {"occupation": "?"}, {"occupation": "?", "workclass": "Never-worked"}, {"age": "90", "capital.gain": "99999", "hours.per.week": "99"}, {"age": "0", "sex": " "},
    ])
    write(folder / "b.csv", [{}, {}, {}, {}, {"age": "30.5"}])
    c = Census(spark, f"file:{tmp_path_factory.mktemp('wh')}")
    return c, c.ingest(f"file:{folder}"), str(folder)


def test_counts_of_runs(census):
    _, (first, second), _ = census
    assert first == {"load_run_id": 1, "rows_read": 16, "rows_staged": 16, "rows_rejected": 10, "rows_loaded": 6, "rows_already_present": 0}
    # Three of the four copies are there already; the fourth is new.
    assert second == {"load_run_id": 2, "rows_read": 5, "rows_staged": 2, "rows_rejected": 0, "rows_loaded": 2, "rows_already_present": 3}


def test_a_repeat_changes_nothing(census):
    c, _, folder = census
    before = {r["table_name"]: r["n_rows"] for r in c.store.counts().collect()}
    assert all(r["rows_staged"] == 0 for r in c.ingest(f"file:{folder}"))
    after = {r["table_name"]: r["n_rows"] for r in c.store.counts().collect()}
    assert {k: v for k, v in after.items() if k != "load_event"} == {k: v for k, v in before.items() if k != "load_event"}


def test_reasons(census):
    c, _, _ = census
    found = {(r["reason"], r["detail"]) for r in c.store.read("load_reject").collect()}
    assert found == {
        ("age_not_an_integer", "age = abc"), ("age_out_of_range", "age = 201"), ("age_out_of_range", "age = 0"), ("fnlwgt_not_a_positive_integer", "fnlwgt = -5"), ("education_mapping_mismatch", "education = Bachelors, education.num = 12"),
        ("hours_per_week_out_of_range", "hours.per.week = 0"), ("capital_value_invalid", "gain = -100, loss = 0"), ("income_not_recognised", "income = 50K+"), ("sex_not_recognised", "sex = Unknown"), ("sex_not_recognised", "sex =  "),
        ("required_field_empty", "empty: occupation"), ("required_field_empty", "empty: sex"),
    }


def test_members_censoring_and_duplicates(census):
    c, _, _ = census
    rows = c.analytic().collect()
    assert sorted(r["occupation"] for r in rows if r["occupation"] != "Sales") == ["Not applicable", "Unknown"]
    top = [r for r in rows if r["age_is_topcoded"]]
    assert [(r["age"], r["hours_per_week"], r["capital_gain"], r["capital_gain_is_topcoded"]) for r in top] == [(None, None, None, True)]
    # Three copies from the first file and one from the second: numbered per load.
    assert sorted((r["load_run_id"], r["duplicate_seq"]) for r in rows if r["duplicate_group_id"]) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert sorted(r["age"] for r in rows if r["load_run_id"] == 2) == [31, 44]


def test_quality_and_faults(census):
    c, _, _ = census
    verdicts, passed = c.check_quality()
    assert passed and verdicts.count() == 32
    facts = c.store.read("fact_person")
    broken = facts.withColumn("occupation_sk", facts["occupation_sk"] + 1000)
    c.store.overwrite("fact_person", broken)
    verdicts, passed = c.check_quality()
    assert not passed and {r["check_name"] for r in verdicts.where("not passed").collect()} >= {"occupation_sk resolves"}
    c.store.overwrite("fact_person", facts)
    assert c.freshness().first()["state"] == "fresh"
    assert "<table>" in html_report(c.store.read("mart_segment_allocation"), "t")


def test_lenient_numbers(spark):
    cases = {"39.7": 40, "1e2": 100, "2.5": 3, " 39 ": 39, "+5": 5, "1d": None, "NaN": None, "1_000": None, "": None, "x": None, "99999999999": None, None: None, "-2.5": -3}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want int")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", lenient_int("t")).collect())
    halves = spark.createDataFrame([(2.5, 2), (3.5, 4), (-1.5, -2), (1e9, None)], "x double, want int")
    assert all(r["got"] == r["want"] for r in halves.withColumn("got", round_to_int("x")).collect())


def test_key_skips_nulls_unless_told(spark):
    df = spark.createDataFrame([(1, "a", None, "b"), (2, None, "a", "b")], "i int, x string, y string, z string")
    same = keys.with_record_key(df, ["x", "y", "z"], "i").collect()
    assert same[0]["record_key"][:32] == same[1]["record_key"][:32]
    apart = keys.with_record_key(df, ["x", "y", "z"], "i", null_token="\0").collect()
    assert apart[0]["record_key"][:32] != apart[1]["record_key"][:32]


def test_global_numbers_and_lines(spark, tmp_path):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k", "cast(id as string) as s")
    got = [r["n"] for r in keys.number_globally(df, ["k"], "n", 10).orderBy("k").collect()]
    assert got == list(range(11, 1011))
    write_csv(df.coalesce(1), f"file:{tmp_path}/c")
    lines = numbered_lines(spark.read.option("header", True).csv(f"file:{tmp_path}/c"))
    assert sorted(r["source_row"] for r in lines.collect()) == list(range(1, 1001))


def test_warehouse_constraints_and_upsert(spark, tmp_path):
    w = Warehouse(spark, f"file:{tmp_path}")
    w.create("t", "k int, v string")
    w.append_absent("t", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    w.append_absent("t", spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), ["k"])
    w.upsert("t", spark.createDataFrame([(1, "A")], "k int, v string"), ["k"])
    assert sorted(map(tuple, w.read("t").collect())) == [(1, "A"), (2, "b"), (3, "c")]
    assert w.tables() == ["t"] and w.tables("x%") == []
    assert {(r["column_name"], r["rows"], r["n_values"]) for r in w.statistics("t").collect()} == {("k", 3, 3), ("v", 3, 3)}
    for bad, kw in [([(None, "x")], {"not_null": ["k"]}), ([(1, "x"), (1, "y")], {"unique": ["k"]}), ([(9, "x")], {"references": [("k", "t", "k")]})]:
        with pytest.raises(ConstraintError):
            w.require(spark.createDataFrame(bad, "k int, v string"), **kw)


def test_profile_and_benchmark(spark):
    from sparkwright.operators.profiling import Profile, compare, plan_of

    df = spark.range(100).selectExpr("id % 3 as k", "id as v")
    df.createOrReplaceTempView("bench_rows")
    seconds = compare({"frame": lambda: df.groupBy("k").agg({"v": "sum"}).toDF("k", "s"), "sql": lambda: spark.sql("select k, sum(v) as s from bench_rows group by k")}, repeats=1)
    assert set(seconds) == {"frame", "sql"}
    with pytest.raises(ValueError):
        compare({"a": lambda: df, "b": lambda: df.limit(3)}, repeats=1)
    profile = Profile()
    assert profile.step("count", df.count) == 100
    assert profile.report()[0][3] and "Range" in plan_of(df)


def test_rules_ignore_unknown_conditions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, None), (2, 5)], "i int, v int")
    found = rules.rejects(df, [rules.Rule("big", F.col("v") > 3, rules.labelled(v="v"))], ["i"]).collect()
    assert [tuple(r) for r in found] == [(2, "big", "v = 5")]


def test_stream_hands_each_file_to_a_batch_load(spark, tmp_path):
    from sparkwright.streaming import drain, windowed_counts

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.csv").write_text(f"a,b\n{i},x\n")
    seen = []
    for _ in range(2):
        drain(spark, f"file:{tmp_path}/in", "a int, b string", lambda df, n: seen.extend(r["a"] for r in df.collect()), f"file:{tmp_path}/cp")
    assert sorted(seen) == [0, 1, 2]
    events = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' k union all select timestamp'2024-01-01 00:50:00', 'a'")
    assert windowed_counts(events, "ts", "k").first()["n"] == 2
