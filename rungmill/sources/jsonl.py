"""Line-delimited JSON in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rungmill.functions.text import strip


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system the session knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(strip(F.col("value")) != "")


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """(record variant): every line that isn't blank must be a JSON object, else the query fails."""
    parsed = _lines(spark, path).select(F.parse_json("value").alias("record"))
    is_object = F.schema_of_variant("record").startswith("OBJECT")
    return parsed.select(F.when(is_object, F.col("record")).otherwise(F.raise_error(F.lit("a line is no JSON object")).cast("variant")).alias("record"))


def read_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """(record variant): lines that are no JSON object are left out; a missing file gives an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], "value string").select(F.try_parse_json("value").alias("record"))
    parsed = _lines(spark, path).select(F.try_parse_json("value").alias("record"))
    return parsed.where(F.col("record").isNotNull() & F.schema_of_variant("record").startswith("OBJECT"))


def read_typed(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """Declared columns; strict fails on a line that doesn't fit, otherwise such lines are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object to a line, nulls written out, non-ASCII characters as they are; parent folders are made."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_variant(df: DataFrame, path: str, column: str = "record") -> None:
    """A variant or map column as one JSON object to a line; absent keys stay absent."""
    df.select(F.to_json(column, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
