"""What the query modules share: the registry, the tables, and images made of their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that makes files of rows.
ROWS_PER_TASK = 5000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows in as many partitions as their number asks for: small rows that stand for long work come in few files."""
    n = rows.select(key).count()
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK)), key)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as 8-bit pixels; (id, n) names them, though not uniquely."""
    i = lambda c: F.round(c).cast("int")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), (i(F.col("l_quantity")) * 5).alias("r"),
        i(F.col("l_discount") * 1000).alias("g"), i(F.col("l_tax") * 1000).alias("b"), (F.col("l_linenumber") * 36 % 256).alias("a"),
    )


PIXELS = """px AS (SELECT l_orderkey AS id, l_linenumber AS n, CAST(round(l_quantity) AS INT) * 5 AS r, CAST(round(l_discount * 1000) AS INT) AS g,
CAST(round(l_tax * 1000) AS INT) AS b, l_linenumber * 36 % 256 AS a FROM lineitem)"""


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def byte_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.least(F.greatest(F.floor(F.col("v") * 256) + 128, F.lit(0)), F.lit(255)).cast("int")
    return raster(spark, sf_dir).withColumn("v", v)


RASTER = """rs AS (SELECT vec_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, CAST(embedding[CAST(i AS INT) + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(i)),
br AS (SELECT vec_id, y, x, CAST(least(greatest(floor(v * 256) + 128, 0), 255) AS INT) AS v FROM rs)"""
