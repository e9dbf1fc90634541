"""Names, dates and aliases on fixed cases."""

from pyspark.sql import functions as F

from lodestack.functions import names as N
from lodestack.operators import aliases


def texts(spark, f, *values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.x for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_names(spark):
    assert texts(spark, N.predicate, " works  on", "-a/b-", "", "ünder 2", None) == ["WORKS_ON", "A_B", "", "ÜNDER_2", None]
    assert texts(spark, N.entity_name, ' ("Ann  Lee"), ', "...", None) == ["ANN LEE", "", None]
    assert texts(spark, N.fact, "-- : it  is so. ", "a;b;", None) == ["it is so", "a;b", None]
    assert texts(spark, N.search_text, "A_b-c/D.e  (f)!", None) == ["a b c d e f", None]
    assert texts(spark, N.tag_value, "ann  lee_x 3d", "!!", None) == ["Ann-Lee_x-3d", "unknown", None]
    assert texts(spark, N.uid, "a b:c", "", None) == ["a-b-c", "unknown", None]
    assert texts(spark, N.entity_slug, "a/b\x01c", None) == ["a_b_c", None]
    assert texts(spark, N.item_id, "mem_src:s:x:y", "gh:1:2", "plain", "mem_src:s", None) == ["x:y", "1:2", "plain", "s", None]
    assert texts(spark, N.parent_node, "2024/01/02/03", "2024", "root", None) == ["2024/01/02", "root", None, None]
    assert texts(spark, N.hour_of_file, "1700000000000_a.md", "x_a.md", "_a", None) == ["2023/11/14/22", None, None, None]


def test_titles(spark):
    item = lambda t: N.title(t, F.lit("item"))
    assert texts(spark, item, "\n\n ## A b \nc", "###\nx", "", None, "y" * 200) == ["A b", "item", "item", "item", "y" * 120]


def test_front_matter(spark):
    md = '---\nid: 1\nlang: "en"\n---\nbody\n---\n'
    assert texts(spark, N.front_matter, md, "no", "", None) == ['id: 1\nlang: "en"', None, None, None]
    assert texts(spark, N.body, md, "no", "", None) == ["body\n---\n", "no", "", None]
    assert texts(spark, lambda t: N.front_field(N.front_matter(t), "lang"), md, "no") == ["en", None]


def test_dates(spark):
    got = texts(spark, N.parsed_date, "1700000000000", "2024-03-05T10:00:00Z", "Tue, 5 Mar 2024 10:00:00 +0100", "5 Mar 2024 10:00:00 +0000", "2024-03-05", "soon", "", None)
    assert got == [1700000000000, 1709632800000, 1709629200000, 1709632800000, 1709596800000, None, None, None]


def test_aliases(spark):
    rows = [("p", "ANN"), ("p", "ANN LEE"), ("p", "DR ANN LEE"), ("p", "LEE"), ("p", "ANNA"), ("q", "ANN"), ("p", "ANN"), (None, "X"), ("p", None)]
    entities = spark.createDataFrame(rows, "type string, name string")
    got = {(r.type, r.alias): r.canonical for r in aliases.alias_map(entities).collect()}
    assert got == {("p", "ANN"): "ANN LEE", ("p", "LEE"): "DR ANN LEE", ("p", "ANN LEE"): "DR ANN LEE"}
    ends = {r.alias: r.canonical for r in aliases.resolved(aliases.alias_map(entities)).collect()}
    assert ends == dict.fromkeys(("ANN", "LEE", "ANN LEE"), "DR ANN LEE")
    assert [r.aliases for r in aliases.listed(aliases.resolved(aliases.alias_map(entities))).collect()] == [["ANN", "ANN LEE", "LEE"]]
    assert aliases.alias_map(entities.limit(0)).count() == 0 and aliases.resolved(aliases.alias_map(entities.limit(0))).count() == 0


def test_caps(spark):
    rows = [("a", i, "x" * 300) for i in range(10)] + [("b", i, "y") for i in range(10)]
    kept = aliases.capped(spark.createDataFrame(rows, "k string, o int, t string"), "k", "o", "t").groupBy("k").agg(F.min("o").alias("o"), F.count("*").alias("n"))
    assert {r.k: (r.o, r.n) for r in kept.collect()} == {"a": (4, 6), "b": (2, 8)}
