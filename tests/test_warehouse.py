"""Versions that survive a writer's death, the command line, and the page."""

import re

import pytest

from sparkwright import cli
from sparkwright.operators.profiling import statements
from sparkwright.sources import Warehouse, csv_text, dashboard
from sparkwright.sources.scratch import shared_folder

ROW = '"44","Private","198282","Bachelors","13","Divorced","Sales","Husband","White","Male","0","0","40","Cuba","<=50K"'
HEAD = "age,workclass,fnlwgt,education,education.num,marital.status,occupation,relationship,race,sex,capital.gain,capital.loss,hours.per.week,native.country,income"


def rows(w, version=None):
    return sorted(r["x"] for r in w.read("t", version).collect())


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path):
    w = Warehouse(spark, f"file:{tmp_path}")
    w.create("t", "x int")
    w.append("t", spark.createDataFrame([(1,), (2,)], "x int"))

    class Dead(Exception):
        pass

    def die(*_):
        raise Dead

    alive, w.files.write_new = w.files.write_new, die
    for write in (w.append, w.overwrite):
        with pytest.raises(Dead):  # after the data, before the manifest
            write("t", spark.createDataFrame([(9,)], "x int"))
        assert rows(w) == [1, 2] == rows(Warehouse(spark, f"file:{tmp_path}"))
    w.files.write_new = alive
    with pytest.raises(Exception):  # while the data is written
        w.append("t", spark.createDataFrame([("x",)], "y string").selectExpr("raise_error(y) as x"))
    w.overwrite("t", spark.createDataFrame([(3,)], "x int"))
    w.append("t", w.read("t").selectExpr("x + 1 as x"))
    assert rows(w) == [3, 4] and rows(w, w.versions("t")[1]) == [1, 2]


def test_two_writers_of_one_version(spark, tmp_path):
    w = Warehouse(spark, f"file:{tmp_path}")
    w.create("t", "x int")
    before = w.versions
    w.versions = lambda name: before(name)[:1]  # a writer that has not seen the other's version
    w.append("t", spark.createDataFrame([(1,)], "x int"))
    with pytest.raises(FileExistsError):
        w.append("t", spark.createDataFrame([(2,)], "x int"))
    w.versions = before
    assert rows(w) == [1]


def test_quoted_line_feeds_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,"say ""z"""\n3,\n')
    got = [tuple(r) for r in csv_text(spark, f"file:{tmp_path}/a.csv", ["a", "b"]).collect()]
    assert got == [("1", "x\ny"), ("2", 'say "z"'), ("3", None)]


def test_statements_are_cut_outside_quotes():
    script = "-- one; two\nINSERT INTO a.b SELECT 'x;''y' /* ; */;\n;DELETE FROM c; UPDATE d SET e = 1; WITH q AS (SELECT 1) SELECT * FROM q"
    assert [n for n, _ in statements(script)] == ["insert a.b", "delete c", "update d", "with"]
    assert statements(" ; -- nothing\n") == []


def test_page(spark):
    mart = spark.createDataFrame([("A & B", "x", 40, 10.5, 3.0, False, True, "ok"), ("C", "y", 3, None, 1.0, True, False, "sparse")], "seg string, grp string, candidates int, hours double, gain double, segment_is_sparse boolean, is_assignable boolean, flags string")
    page = dashboard(mart, "T <1>", ["seg", "grp"], [("pool", 1234)], "ageing", 30.0, ("hours", "gain"))
    assert "1,234" in page and "T &lt;1&gt;" in page and 'class="badge ageing"' in page and "A &amp; B" in page
    assert page.count('<tr class="row"') == 2 and page.count("<circle") == 1 and page.count("<select") == 2
    assert re.findall(r'class="bar" style="width:([\d.]+)%', page) == ["100.0", "7.5"]
    with pytest.raises(ValueError):
        dashboard(mart, "t", ["seg"], [], "fresh", 0.0, ("hours", "gain"), most=1)


def test_command_line(spark, tmp_path, capsys):
    db = f"file:{tmp_path}/db"
    assert cli.main([]) == 2
    assert cli.main([f"file:{tmp_path}/nothing.csv", "--db", db]) == 2 and "no such file" in capsys.readouterr().err
    (tmp_path / "in.csv").write_text("\n".join([HEAD, ROW, ROW, ROW.replace('"44"', '"abc"')]) + "\n")
    assert cli.main([f"file:{tmp_path}/in.csv", "--db", db, "-v", "--summary", "--report", str(tmp_path / "page.html")]) == 0
    said = capsys.readouterr()
    assert "rows_read=3 rows_staged=3 rows_rejected=1 rows_loaded=2" in said.out and "run 1 is done" in said.err and "age_not_an_integer" in said.out and "fact_person" in said.out
    assert "<svg" in (tmp_path / "page.html").read_text()
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    assert cli.main([f"file:{tmp_path}/bad.csv", "--db", db]) == 1 and "load failed" in capsys.readouterr().err
    assert cli.main(["--db", db, "--checks"]) == 0


def test_no_local_folder_on_a_cluster(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared_folder(Cluster)
    Cluster.sparkContext.master = "local[4]"
    assert shared_folder(Cluster).startswith("file:")
