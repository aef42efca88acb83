"""Tables from Parquet, and the schema catalog as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def columns_df(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, ord, column, type, nullable) of some DataFrames: what an information schema would list."""
    rows = [(name, i + 1, f.name, f.dataType.simpleString(), f.nullable) for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "`table` string, ord int, `column` string, type string, nullable boolean")


def catalog_df(spark: SparkSession, database: str = "default") -> DataFrame:
    """The same of a database's tables and views."""
    rows = [(t.name, i + 1, c.name, c.dataType, c.nullable) for t in spark.catalog.listTables(database) for i, c in enumerate(spark.catalog.listColumns(t.name if t.isTemporary else f"{database}.{t.name}"))]
    return spark.createDataFrame(rows, "`table` string, ord int, `column` string, type string, nullable boolean")


def execute(spark: SparkSession, statements: list[str]) -> list[str]:
    """Runs statements in turn; returns the messages of those that failed."""
    failed = []
    for s in statements:
        try:
            spark.sql(s)
        except Exception as e:  # noqa: BLE001  each statement is reported, none hides the next
            failed.append(f"{s}: {str(e).splitlines()[0]}")
    return failed


#: SQL type names of the dialects, and what they are in Spark (fixed values).
TYPES: dict[str, T.DataType] = {
    "text": T.StringType(), "varchar": T.StringType(), "char": T.StringType(), "bpchar": T.StringType(), "name": T.StringType(), "longtext": T.StringType(), "nvarchar": T.StringType(), "ntext": T.StringType(),
    "tinyint": T.ByteType(), "smallint": T.ShortType(), "int2": T.ShortType(), "int": T.IntegerType(), "integer": T.IntegerType(), "int4": T.IntegerType(), "mediumint": T.IntegerType(), "bigint": T.LongType(), "int8": T.LongType(), "serial": T.IntegerType(), "bigserial": T.LongType(),
    "real": T.FloatType(), "float4": T.FloatType(), "double precision": T.DoubleType(), "double": T.DoubleType(), "float8": T.DoubleType(), "money": T.DecimalType(19, 2),
    "boolean": T.BooleanType(), "bool": T.BooleanType(), "bit": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "datetime": T.TimestampNTZType(), "datetime2": T.TimestampNTZType(), "timestamptz": T.TimestampType(),
    "bytea": T.BinaryType(), "blob": T.BinaryType(), "varbinary": T.BinaryType(), "json": T.StringType(), "jsonb": T.StringType(), "uuid": T.StringType(), "uniqueidentifier": T.StringType(), "inet": T.StringType(), "cidr": T.StringType(), "macaddr": T.StringType(), "xml": T.StringType(), "oid": T.LongType(),
}


def spark_type(name: str) -> T.DataType:
    """The Spark type of a SQL type name: lengths dropped, numeric(p, s) kept (38, 18 without), t[] an array."""
    name = name.strip().lower()
    if name.endswith("[]"):
        return T.ArrayType(spark_type(name[:-2]))
    base, _, inside = name.partition("(")
    base = base.strip()
    if base in ("numeric", "decimal"):
        p, s = ([int(x) for x in inside.rstrip(")").split(",")] + [0])[:2] if inside else (38, 18)
        return T.DecimalType(p, s)
    if base == "tinyint" and inside.startswith("1)"):
        return T.BooleanType()
    if base not in TYPES:
        raise ValueError(f"no Spark type for {name}")
    return TYPES[base]
