"""Differences, renames, order and rewriting of schemas; lint."""

import pytest
from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.operators import changes as C
from tagloom.operators import guard as G
from tagloom.operators import relational as R
from tagloom.plans import parts as P
from tagloom.plans import schema as S
from tagloom.sources import tables as T


def test_a_schema_doesnt_differ_from_itself_and_changes_lead_to_the_other(spark):
    a = spark.createDataFrame([(1, "x", 2.0)], "id int, nm string, v double")
    b = spark.createDataFrame([(1, "x", "t")], "id bigint, name string, note string")
    ca, cb = T.columns_df(spark, {"t": a, "old": a}), T.columns_df(spark, {"t": b})
    assert S.table_changes(ca, ca).count() == 0
    got = {(r.table, r.column, r.change) for r in S.table_changes(ca, cb).collect()}
    assert got == {("old", None, "drop_table"), ("t", "id", "modify_column"), ("t", "nm", "drop_column"), ("t", "v", "drop_column"), ("t", "name", "add_column"), ("t", "note", "add_column")}
    assert S.destructive(S.table_changes(ca, cb)).count() == 3


def test_renames_take_the_first_of_the_same_type():
    assert S.renames([("nm", "text"), ("v", "int")], [("name", "text"), ("note", "text")]) == [("nm", "name")]
    assert S.renames([("nm", "text")], [("name", "text"), ("note", "text")], {"nm": "note"}) == [("nm", "note")]


def test_order_and_cycles():
    needs = {"a": ["b"], "b": ["c"]}
    assert S.levels(needs) == {"a": 2, "b": 1, "c": 0}
    assert S.ordered([("add_table", "a"), ("drop_table", "c"), ("drop_table", "a"), ("add_table", "c")], needs) == [("add_table", "c"), ("add_table", "a"), ("drop_table", "a"), ("drop_table", "c")]
    with pytest.raises(ValueError):
        S.levels({"a": ["b"], "b": ["a"]})
    kept, late = S.detached({"a": ["b"], "b": ["a"]})
    assert late == [("b", "a")] and S.levels(kept) == {"a": 1, "b": 0}


def test_rewriting_and_ddl(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, s string")
    assert [r.t for r in S.evolved(df, {"id": F.col("id"), "t": F.col("s")}, {"t": "?"}).orderBy("id").collect()] == ["?", "x"]
    assert S.ddl("add_column", "t", "c", "int") == "ALTER TABLE `t` ADD COLUMNS (`c` int)"
    with pytest.raises(ValueError):
        S.ddl("drop_column", "t", "c")


def test_lint_skips_only_with_a_reason(spark):
    objects = spark.createDataFrame([("a",), ("b",), ("c",)], "`table` string")
    tags = spark.createDataFrame([("a", "rls")], "`table` string, namespace string")
    ignores = spark.createDataFrame([("rls.require", "b", "public data"), ("rls.require", "c", " ")], "rule string, `table` string, reason string")
    assert {(r.table, r.skipped) for r in S.lint(objects, tags, {"rls": "warn"}, ignores).collect()} == {("b", True), ("c", False)}


def test_types_globs_and_text(spark):
    assert T.spark_type("numeric(10, 2)").simpleString() == "decimal(10,2)" and T.spark_type("text[]").simpleString() == "array<string>" and T.spark_type("tinyint(1)").simpleString() == "boolean"
    assert S.glob_regex("a.?*") == r"^a\...*$"
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "s string, n int")
    assert df.agg(X.joined_sorted("s")).first()[0] == "a, b"
    r = df.withColumn("r", X.ranged(F.lit(1), F.lit(3)))
    assert r.filter(X.in_ranged(F.col("n"), "r")).count() == 2
    assert T.execute(spark, ["SELECT 1", "SELECT nothing_here"])[0].startswith("SELECT nothing_here")


def test_globs_lint_and_keys_of_nothing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert S.excluded(df, "s", []).count() == 3 and {r.s for r in S.excluded(df, "s", ["a*"]).collect()} == {"b", None}
    assert S.lint(df.withColumnRenamed("s", "table"), spark.createDataFrame([], "`table` string, namespace string"), {}).count() == 0
    twice = spark.createDataFrame([(None,), (None,), ("x",), ("x",)], "k string")
    assert [r.k for r in G.duplicates(twice, ["k"]).collect()] == ["x"] and G.duplicates(twice, ["k"], primary=True).count() == 2


def test_not_in_with_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    keys = spark.createDataFrame([(2,), (3,)], "k int")
    assert [r.v for r in R.not_in(df, "v", keys).collect()] == [1]
    assert R.not_in(df, "v", keys.unionByName(spark.createDataFrame([(None,)], "k int"))).count() == 0
    assert R.not_in(df, "v", keys.limit(0)).count() == 3
    assert R.by_setting(df.withColumn("s", F.lit("a")), "s", "spark.tagloom.unset").count() == 0 and R.if_given(df, "v", None).count() == 3


def test_replay_takes_the_last_of_changes_at_one_time(spark):
    log = spark.createDataFrame([(1, "INSERT", "a", 5, 1), (1, "UPDATE", "c", 5, 2), (1, "UPDATE", "b", 5, 3), (2, "INSERT", "x", 5, 1), (2, "DELETE", None, 5, 2)], "k int, operation string, new_data string, changed_at int, seq int")
    assert [tuple(r) for r in C.replay(log, ["k"]).collect()] == [(1, "b")]
    assert [tuple(r) for r in C.replay(log.drop("seq"), ["k"]).collect()] == [(1, "c")]


def parts_of(spark, *rows):
    return spark.createDataFrame(rows, P.PART + ", ord int")


def test_parts_lead_from_one_schema_to_another(spark):
    a = parts_of(spark, ("table", "", "t", "", None, False, 0), ("table", "", "old", "", None, False, 1), ("column", "old", "x", "int", None, False, 0), ("column", "t", "nm", "text", None, False, 0), ("column", "t", "v", "int", None, False, 1), ("index", "t", "i1", "(nm)", "nm", True, 0), ("index", "t", "mine", "(v)", "v", False, 1), ("primary_key", "t", "pk", "(id)", "id", True, 0), ("check", "t", "c1", "v > 0", "v > 0", True, 0))
    b = parts_of(spark, ("table", "", "t", "", None, False, 0), ("column", "t", "name", "text", None, False, 0), ("column", "t", "v", "bigint", None, False, 1), ("index", "t", "i2", "(nm)", "nm", True, 0), ("index", "t", "yours", "(v)", "v", False, 1), ("primary_key", "t", "pk", "(id, v)", "id, v", True, 0), ("view", "", "w", "AS SELECT 1", None, False, 0))
    assert P.part_changes(a, a).count() == 0
    got = {(r.owner, r.name, r.change, r.to) for r in P.part_changes(a, b).collect()}
    assert got == {("", "old", "drop_table", None), ("t", "nm", "drop_column", None), ("t", "name", "add_column", None), ("t", "v", "modify_column", None), ("t", "mine", "rename_index", "yours"), ("t", "pk", "modify_primary_key", None), ("t", "c1", "drop_check", None), ("", "w", "add_view", None)}
    assert [tuple(r) for r in P.rename_candidates(a, b).collect()] == [("t", "nm", "name")]
    known = spark.createDataFrame([("column", "t", "nm", "name")], "kind string, owner string, name string, to string")
    before, changes = P.renamed(a, known)
    assert [(r.name, r.change, r.to) for r in changes.collect()] == [("nm", "rename_column", "name")]
    assert not {r.name for r in P.part_changes(before, b).collect()} & {"nm", "name"}
    assert P.destructive(P.part_changes(a, b)).count() == 2
    mine = spark.createDataFrame([("t",)], "name string")
    assert {r.name for r in P.without_external(P.part_changes(a, b), mine).collect()} == {"old", "w"} and P.external_changes(a, b, mine).count() == 6
    sql = {r.change: r.sql for r in P.statements(P.part_changes(a, b).unionByName(changes), if_exists=True).collect()}
    assert sql["drop_table"] == 'DROP TABLE IF EXISTS "old"' and sql["rename_column"] == 'ALTER TABLE "t" RENAME COLUMN "nm" TO "name"' and sql["add_view"] == 'CREATE VIEW "w" AS SELECT 1'
    phases = {r.change: r.phase for r in P.part_changes(a, b).withColumn("phase", P.phase()).collect()}
    assert phases["rename_index"] < phases["drop_check"] < phases["drop_column"] < phases["drop_table"] < phases["modify_column"] < phases["add_view"]


def test_every_change_has_a_statement_and_others_raise(spark):
    made = P._made()
    kinds = {k for k in P.KINDS if k != "attr"}
    assert {f"{v}_{k}" for v in ("add", "drop", "modify", "rename") for k in kinds} - set(made) == set()
    with pytest.raises(Exception, match="no statement for"):
        P.statements(parts_of(spark, ("x", "", "n", "", None, False, 0)).select("kind", "owner", "name", F.lit("add_x").alias("change"), F.lit(None).cast("string").alias("to"), "body")).collect()


def test_links_tags_and_comments(spark):
    objects = spark.createDataFrame([("a", "t"), ("b", "t")], "schema string, name string")
    tags = spark.createDataFrame([("x", "t"), ("y", "b.t"), ("z", "c.t")], "tag string, target string")
    assert sorted(tuple(r) for r in P.matched(tags, objects).collect()) == [("x", "a", "t"), ("x", "b", "t"), ("y", "b", "t")]
    keys = spark.createDataFrame([("t", "f", "u"), ("t", "g", "t")], "owner string, name string, target string")
    assert {r.name: r.found for r in P.linked(parts_of(spark, ("table", "", "t", "", None, False, 0)), keys).collect()} == {"f": False, "g": True}


def test_keys_of_cycles(spark):
    keys = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("z", "a"), ("e", "q"), ("s", "s"), (None, "a"), ("a", None)], "owner string, target string")
    assert {tuple(r) for r in P.cyclic(keys).collect()} == {("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d")}
    assert P.cyclic(keys.limit(0)).count() == 0 and P.cyclic(keys.filter("owner = 'z'")).count() == 0


def test_names_of_code(spark):
    df = spark.createDataFrame([("post_tags",), ("user__categories",), ("address",), ("boxes",), ("",), (None,)], "n string")
    made = [tuple(r) for r in df.select(X.pascal(F.col("n")), X.camel(F.col("n")), X.singular_last(F.col("n"))).collect()]
    assert made == [("PostTags", "postTags", "post_tag"), ("UserCategories", "userCategories", "user__category"), ("Address", "address", "address"), ("Boxes", "boxes", "box"), ("", "", ""), (None, None, None)]


def test_enriched_columns_with_keys_given_twice(spark):
    columns = spark.createDataFrame([("t_cats", "id"), ("t_cats", "b_id")], "`table` string, column string")
    primary = spark.createDataFrame([("t_cats", "id"), ("t_cats", "id")], "`table` string, column string")
    foreign = spark.createDataFrame([("t_cats", "b_id", "y"), ("t_cats", "b_id", "x")], "`table` string, column string, target string")
    made = {r.column: r for r in P.enriched(columns, primary, foreign).collect()}
    assert len(made) == 2 and made["id"].is_primary and not made["id"].is_foreign and made["b_id"].references == "x" and made["b_id"].camel == "bId" and made["id"].type_name == "TCat"
