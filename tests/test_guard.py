"""Soft deletion, policies, masks, checks and integrity."""

import pytest
from pyspark.sql import functions as F

from tagloom.operators import guard as G
from tagloom.registry import Context, compile_tags, diagnostics
from tagloom.tags import TableTags, parse_args, parse_comment, parse_ddl, tag, tags_of


def test_cascade_takes_the_parents_time_and_restores_nothing(spark):
    parent = spark.createDataFrame([(1, "t1"), (2, None)], "id int, deleted_at string")
    child = spark.createDataFrame([(10, 1, "own"), (11, 1, None), (12, 2, "own"), (13, None, None)], "cid int, pid int, deleted_at string")
    got = {r.cid: r.deleted_at for r in G.cascade(child, parent, "pid", "id").collect()}
    assert got == {10: "t1", 11: "t1", 12: "own", 13: None}
    assert G.active(parent).count() == 1


def test_policies_are_ored_and_none_denies(spark):
    df = spark.createDataFrame([("alice", 1), ("bob", 2), (None, 3)], "owner string, n int")
    assert G.secured(df, []).count() == 0
    assert G.secured(df, [("app", "owner = 'bob'"), ("PUBLIC", "n = 3"), ("other", "true")], "app").count() == 2
    assert G.secured(df, [], "root", bypass=["root"]).count() == 3
    assert [r.n for r in G.rejected(df, ["owner = 'bob'"]).orderBy("n").collect()] == [1, 3]


def test_null_passes_a_check(spark):
    df = spark.createDataFrame([(30, "a"), (200, ""), (None, None)], "age int, name string")
    assert G.violations(df, G.in_range("age", 0, 120)).count() == 1
    assert G.violations(df, G.not_empty("name")).count() == 1
    assert {r.rule: r.violations for r in G.report(df, {"a": G.in_range("age", 0, 120), "n": G.has_length("name", 1)}).collect()} == {"a": 1, "n": 1}
    with pytest.raises(ValueError):
        G.has_length("name")


def test_keys(spark):
    df = spark.createDataFrame([(1, True), (1, True), (2, False), (2, False)], "k int, p boolean")
    assert [r.k for r in G.duplicates(df, ["k"], "p").collect()] == [1]
    assert G.orphans(df, df.filter("k = 1").withColumnRenamed("k", "id"), "k", "id").count() == 2
    assert G.nulls(df, F.when(F.col("p"), F.col("k"))).first()[0] == 2


def test_masks(spark):
    df = spark.createDataFrame([("alice",), (None,)], "name string")
    assert G.masked(df, "name", "partial", 1, "**", 1).first()[0] == "a**e"
    assert G.masked(df, "name", "null").filter("name is not null").count() == 0
    assert G.masked(df, "name", "fake").first()[0] == G.masked(df, "name", "fake").first()[0]
    with pytest.raises(ValueError):
        G.masked(df, "name", "unheard")


def test_tag_arguments_and_dotted_names():
    assert parse_args("min: -1.5, max=3, 'a, b', true, [1, 2]") == (("a, b", True, [1, 2]), {"min": -1.5, "max": 3})
    t = parse_comment("@pg.omit.all(a) then @rls")
    assert [(x.namespace, x.name) for x in t] == [("pg", "omit.all"), ("rls", None)]


def test_ddl_tags_compile_to_dataframes(spark):
    tags = parse_ddl("""
-- @softdelete
-- @validate.check('age > 1')
CREATE TABLE people (
  -- @validate.range(0, 120)
  age int,
  name text, -- @validate.notEmpty
  deleted_at timestamp
);""")["people"]
    assert [(t.namespace, t.column) for t in tags.tags] == [("softdelete", None), ("validate", None), ("validate", "age"), ("validate", "name")]
    df = spark.createDataFrame([(30, "a", None), (200, "", None), (5, "c", "x")], "age int, name string, deleted_at string")
    made = compile_tags(df, Context("people", tags))
    assert made["people_active"].count() == 2 and made["people_rejects"].count() == 1 and made["people_accepted"].count() == 2
    bad = TableTags("t", parse_comment("@nothing @validate.range(1)"))
    assert len(diagnostics(bad)) == 2
    with pytest.raises(ValueError):
        compile_tags(df, Context("t", bad))


def test_tags_in_metadata(spark):
    df = tag(spark.createDataFrame([(1,)], "n int"), "n", "validate.range", min=0, max=5)
    assert tags_of(df).tags[0].options == {"min": 0, "max": 5}
