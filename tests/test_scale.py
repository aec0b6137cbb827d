"""Queries over the code base at size: files are dealt out and read once, and no table of classes is broadcast by a guess of its size."""

import pytest

from quarry.operators import java_source as J
from quarry.operators import layers as L
from quarry.plans.catalogue import QUERIES
from quarry.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def classes(spark):
    return spark.createDataFrame([("a.b.Foo", "Foo"), ("c.Foo", "Foo")], "address string, name string")


def test_files_are_dealt_out(spark, folder, monkeypatch):
    monkeypatch.setattr(tables, "FILES_A_TASK", 50, raising=False)
    assert tables.Tables(spark, folder).java().rdd.getNumPartitions() > 1


def test_navigation_broadcasts_no_classes(spark, classes):
    wanted = spark.createDataFrame([("x", "Foo")], "source string, type string")
    assert "Broadcast" not in plan(L.navigated(wanted, classes))


def test_navigation_reads_the_files_once(spark, folder):
    assert "MapInArrow" not in plan(QUERIES["join_19_navigation"](spark, folder))


def test_imports_broadcast_no_classes(spark, classes):
    wanted = spark.createDataFrame([("x", "b.Foo")], "source string, name string")
    assert "Broadcast" not in plan(L.by_suffix(wanted, classes, "name"))


def test_imports_read_the_files_once(spark, folder):
    assert "MapInArrow" not in plan(QUERIES["join_09_import_resolve"](spark, folder))


def test_parameter_flow_broadcasts_no_methods(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "kept", lambda df, tag: seen.append(plan(df)) or df, raising=False)
    files = spark.createDataFrame([("A.java", "class A { B b; void f(int x) { b.g(x); } }"), ("B.java", "class B { void g(int y) { } }")], "path string, content string")
    got = [tuple(r) for r in L.parameter_flow(J.classes(files)).collect()]
    assert got == [("A#f", "x", "A#f", "B#g", 1, True)]
    assert len(seen) > 2 and not any("Broadcast" in p for p in seen)
