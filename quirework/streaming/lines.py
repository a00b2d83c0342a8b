"""An extension: repeated lines counted over a stream of document files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import header_key


def read_documents(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string, lang string, source string, n_chars bigint") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def repeated_lines(docs: DataFrame, least: int = 2) -> DataFrame:
    """Running counts of lines over all documents so far; the state is one row for each line."""
    lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("line")).where(F.trim("line") != "")
    return lines.groupBy(header_key(F.col("line")).alias("key")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
