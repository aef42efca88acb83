"""The corpus pipeline: stages that each take and return documents, written as Parquet between them.

Stages judge rows, not ids: rows without an id or with one that others have too are kept or go by what their own text
is, repeated rows each, but that of linked rows one stays. Null and empty texts don't pass the classifier. Very long
texts go through whole. An empty table gives no rows. Columns other than those of documents are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import concluded, only, passing_paths, removed, saved, table
from tagloom.llm.kneser_ney import quality_classifier
from tagloom.llm.packing import best_fit_packing
from tagloom.llm.quality_rules import passing
from tagloom.llm.setjoin import jaccard_links
from tagloom.llm.surrogates import with_surrogates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(docs: DataFrame) -> DataFrame:
    """docs with a saved number of each row, by which a stage's verdicts find it: ids can be null or shared."""
    return saved(docs.select(COLUMNS).withColumn("_row", F.monotonically_increasing_id()))


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go."""
    docs = rows_of(docs)
    rejected = saved(quality_classifier(docs, table(spark, sf_dir, "labels")).filter("not kept").select("_row"))
    return only(docs, rejected, "left_anti", "_row").select(COLUMNS)


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; rows carry their columns through the projection, without a join."""
    return passing(docs, tuple(COLUMNS))


def by_similarity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each group of linked rows stays, one of those without an id only if none has one."""
    docs = rows_of(docs)
    groups = jaccard_links(docs.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    # A row alone in its group stays; only the others' ids are looked at.
    groups = saved(groups.join(groups.filter("component_id <> _row").select("component_id").distinct(), "component_id", "left_semi"))
    known = groups.join(docs.select("_row", "doc_id"), "_row")
    first = known.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    others = saved(groups.select("_row").join(first.select("_row"), "_row", "left_anti"))
    return only(docs, others, "left_anti", "_row").select(COLUMNS)


def with_private_data_replaced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    replaced = with_surrogates(docs)
    return replaced.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs)


STAGES = [
    ("quality classifier", by_classifier),
    ("quality rules", by_rules),
    ("n-gram Jaccard join", by_similarity),
    ("PII", with_private_data_replaced),
    ("best-fit packing", packed),
]

#: SQL can express neither the classifier nor the packing: tests/llm holds the model and the links against brute force,
#: and the whole against its stages on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with passing_paths() as paths:
        for _, stage in STAGES[:-1]:
            docs = concluded(lambda docs, stage=stage: stage(spark, docs, sf_dir))(docs)
            # Its input has been read: only what it returned stays.
            removed(spark, paths[:-1])
            del paths[:-1]
    return STAGES[-1][1](spark, docs, sf_dir)
