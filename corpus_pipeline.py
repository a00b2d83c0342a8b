"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), sees everything its predecessor kept, and all but
the last return the columns of documents. ORACLE_SQL is None: the classifier, the
fingerprints and the tokenizer have no SQL, so tests hold run() against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.linededup import dedup_lines
from quirework.llm.mixing import mix_sources
from quirework.llm.packing import pack
from quirework.llm.quality import score_quality, train
from quirework.llm.shared import materialise
from quirework.llm.simhash import keep_first

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's documents go; documents stay, maybe empty."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return keep_first(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands, whole, as often as the mix takes it; a source's words differ from
    its quota by at most half a document and half a block for each of its shards.

    Documents that the mix does not take go, empty ones among them.
    """
    taken = mix_sources(docs, carry=["text", "lang", "n_chars"], whole=True)
    times = F.array_repeat("text", (F.col("taken") / F.col("size")).cast("int"))
    out = taken.where("taken > 0").select("doc_id", F.explode(times).alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [("quality classifier", classify), ("line dedup", lines), ("simhash near-dedup", near_copies), ("source mix", mix), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
