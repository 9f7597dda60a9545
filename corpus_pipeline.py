"""Documents to token ids: quality rules, exact dedup, near dedup, source mix, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again for the next one.
All but the last return the columns of documents. ORACLE_SQL is None: hashed darts, merge order and the seeded
part of the mix have no short SQL form; tests/llm holds the stages against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imagelake.llm.common import table
from imagelake.llm.exactdedup import exact_dedup
from imagelake.llm.minhash import near_duplicates
from imagelake.llm.mixing import mix
from imagelake.llm.quality import quality
from imagelake.llm.sentencepieces import encode

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failed lines."""
    carry = tuple(c for c in COLUMNS if c not in ("text", "n_chars"))
    out = quality(docs, carry=carry).filter("kept").withColumnRenamed("clean_text", "text")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return _only(docs, exact_dedup(docs, keep="last").filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays: the one with the smallest doc_id."""
    return _only(docs, near_duplicates(docs).filter("lead"))


#: A row's name, without nulls: rows grouped by it lie as a join on it wants them, so texts move once.
KEY = ("_missing", "_id", "text_key")


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_missing": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """docs whose doc_id and text are among the kept ones; of rows that repeat both, the one with the smallest other
    columns. Rows are folded before they move, so a group of copies, with or without ids, doesn't meet in one task."""
    d = _named(docs.select(*COLUMNS).withColumn("text_key", F.xxhash64("text")))
    rows = d.groupBy(*KEY).agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"), F.first("text").alias("text"))
    rows = rows.join(table(_named(kept).select(*KEY).distinct(), "kept"), list(KEY), "left_semi")
    return rows.select(F.when(~F.col("_missing"), F.col("_id")).alias("doc_id"), "text", "rest.*").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times."""
    taken = mix(docs, carry=("text", "lang", "source", "n_chars")).filter("copies > 0")
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; the mix's copies are encoded as often as they stand."""
    return encode(docs, carry=("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", source_mix),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
