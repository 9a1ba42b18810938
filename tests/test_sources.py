"""Readers on small files of each format."""

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import resolution
from corpusgraph.sources import files


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lcov(spark, tmp_path):
    path = put(tmp_path, "a.info", "TN:\nSF:src/a.py\nDA:1,3\nDA:2,0\nend_of_record\nSF:b.py\nDA:7,18446744073709551615\nend_of_record\n")
    assert rows(files.read_lcov(spark, path).select("path", "line", F.col("hits").cast("string"))) == [("b.py", 7, "18446744073709551615"), ("src/a.py", 1, "3"), ("src/a.py", 2, "0")]


def test_block_profile(spark, tmp_path):
    path = put(tmp_path, "c.out", "mode: set\na.go:1.2,3.4 2 1\na.go:3.5,4.1 1 0\nnot a block\n")
    assert rows(files.read_block_profile(spark, path).select("path", "line", F.col("hits").cast("int"))) == [("a.go", 1, 1), ("a.go", 2, 1), ("a.go", 3, 1), ("a.go", 4, 0)]


def test_xml_reports(spark, tmp_path):
    cob = put(tmp_path, "cob.xml", '<coverage><packages><package><classes><class filename="a.py"><lines><line number="1" hits="2"/><line number="2" hits="0"/></lines></class></classes></package></packages></coverage>')
    assert rows(files.read_cobertura(spark, cob)) == [("a.py", 1, 2), ("a.py", 2, 0)]
    jac = put(tmp_path, "jac.xml", '<report><package name="p/q"><sourcefile name="A.java"><line nr="3" mi="0" ci="5"/><line nr="4" mi="2" ci="0"/></sourcefile></package></report>')
    assert rows(files.read_jacoco(spark, jac)) == [("p/q/A.java", 3, 1), ("p/q/A.java", 4, 0)]
    junit = put(tmp_path, "j.xml", '<testsuites><testsuite name="s"><testcase name="ok"/><testcase name="bad"><failure>no</failure></testcase></testsuite></testsuites>')
    assert rows(files.read_test_results(spark, junit)) == [("s", "bad", True), ("s", "ok", False)]


def test_diff(spark, tmp_path):
    path = put(tmp_path, "x.diff", "--- a/f.py\n+++ b/f.py\n@@ -1,2 +1,3 @@\n x\n+y\n+z\n@@ -9 +10 @@ def f\n-a\n+b\n")
    assert rows(files.read_diff(spark, path)) == [("f.py", 1, 3, 2), ("f.py", 10, 10, 1)]


def test_strict_and_lenient_logs(spark, tmp_path):
    good = put(tmp_path, "r.tsv", "d1\ta.md\tsha256:1\t2\n")
    assert rows(files.read_register(spark, good)) == [("d1", "a.md", "sha256:1", 2)]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        files.read_register(spark, put(tmp_path, "bad.tsv", "d1\ta.md\tsha256:1\tx\n")).collect()
    events = put(tmp_path, "e.tsv", "r\tf\tl\tmain\t2024-01-02T03:04:05Z\nshort\trow\nr\tf\tl\tmain\tno time\n")
    assert files.read_events(spark, events).count() == 1
    assert rows(files.read_messages(spark, put(tmp_path, "m", "one\nline\x00two\x00"))) == [("one\nline",), ("two",)]


def test_sniffing(spark):
    df = spark.createDataFrame([("a", "mode: set"), ("b", "TN:\nSF:x"), ("c", "<?xml?><coverage>"), ("d", "<report name=''>"), ("e", "?")], "path string, head string")
    assert [r.format for r in files.sniff(df).orderBy("path").collect()] == ["blocks", "lcov", "cobertura", "jacoco", None]


def test_member_lookup_takes_the_nearest_type(spark):
    calls = spark.createDataFrame([(1, "C", "f"), (2, "C", "g"), (3, "C", "h")], "call_id int, type string, name string")
    members = spark.createDataFrame([("A", "f", "A.f"), ("B", "f", "B.f"), ("A", "g", "A.g"), ("A", "h", "A.h1"), ("A", "h", "A.h2")], "type string, name string, member string")
    above = spark.createDataFrame([("C", "C", 0), ("C", "B", 1), ("C", "A", 2)], "type string, base string, depth int")
    assert rows(resolution.member_lookup(calls, members, above)) == [(1, "B.f"), (2, "A.g")]
