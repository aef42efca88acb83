"""Rendered schemas, and change capture on a file stream against the batch operators."""

from datetime import datetime

from pyspark.sql import types as T

from tagloom.plans import render as R
from tagloom.streaming import capture

SCHEMA = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("tags", T.ArrayType(T.StringType(), False)), T.StructField("at", T.DateType(), True, {"tags": [{"name": "validate.notEmpty"}]})])


def test_render():
    j = R.json_schema("t", SCHEMA)
    assert j["required"] == ["id"] and j["properties"]["tags"] == {"type": ["array", "null"], "items": {"type": "string"}} and j["properties"]["at"]["format"] == "date"
    assert R.python_class("my_table", SCHEMA) == "@dataclass\nclass MyTable:\n    id: int\n    tags: list[str] | None = None\n    at: date | None = None\n"
    assert "(BaseModel)" in R.python_class("t", SCHEMA, "pydantic")
    assert "b ||--o{ a : fk" in R.mermaid({"a": SCHEMA}, [("a", "b", "fk")])
    assert "| at | date | yes | @validate.notEmpty |" in R.markdown("t", SCHEMA)


def test_streams(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 0, 0, k), v) for k, v in enumerate(["a", "b", "c"])] + [(2, datetime(2024, 1, 1), "x")]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "id long, ts timestamp, v string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id long, ts timestamp, v string").parquet(src)
    q = capture.audit_stream(stream, "id", "ts", "v").writeStream.format("memory").queryName("audited").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = [(r.id, r.operation, r.old_data, r.new_data) for r in spark.table("audited").orderBy("id", "changed_at").collect()]
    assert got == [(1, "INSERT", None, "a"), (1, "UPDATE", "a", "b"), (1, "UPDATE", "b", "c"), (2, "INSERT", None, "x")]
    q = capture.append_feed(stream, str(tmp_path / "feed"), str(tmp_path / "c2"), ["id"], 4)
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "feed")).count() == 4
    w = capture.windowed_counts(stream, "ts", "v", "1 minute", "10 minutes").writeStream.format("memory").queryName("counted").outputMode("update").option("checkpointLocation", str(tmp_path / "c3")).start()
    w.processAllAvailable()
    w.stop()
    assert spark.table("counted").count() == 4
