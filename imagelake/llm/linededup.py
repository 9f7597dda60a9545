"""Line dedup by range-partitioned hashes, in DataFrame operations only.

Lines long enough get a 128-bit hash of their key (the line without ASCII white space at its ends, A-Z
lower-cased). One row per (hash, document) goes to partitions by ranges of (hash, salt), sorted by hash, salt,
document (largest first) and position. Each run of equal (hash, salt) is streamed once: its first row is the
first occurrence, and its length the number of documents. The salt is a hash of the document, so a line that a
third of all documents hold is spread over `salts` runs, and only the runs' figures meet. What returns to the
documents are not lines but keep bitmaps: 64 lines a word, words without a dropped line left out.

Defined results: a null or empty text is one empty line; null doc_ids count as one document, which comes after
all others; rows that repeat both doc_id and text are one document and get the same result; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imagelake.llm.common import SPACE, ascii_lower, table


def line_array(text: str = "text"):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, salts: int = 64) -> DataFrame:
    """(doc_id, text_key, words): words is an array of (word, drop), where bit i of drop is line 64 * word + i.
    Documents that keep all lines have no row."""
    spark = docs.sparkSession
    key = F.btrim("line", F.lit(SPACE))
    lines = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
            F.posexplode(line_array()).alias("pos", "line"),
        )
        .filter(F.length("line") >= min_chars)
        .withColumn("key", key)
        .filter(F.length("key") >= min_chars)
        .select("doc_id", "text_key", "pos", F.unhex(F.md5(ascii_lower(F.col("key")))).alias("hash"))
    )
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    held = table(salted, "lines")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = held.select("hash", "salt", "doc_id").repartitionByRange(n, "hash", "salt").sortWithinPartitions("hash", "salt", F.desc("doc_id"))
    # (hash, salt) is the partitioning's own key: each run is counted where it lies, without another exchange.
    run = Window.partitionBy("hash", "salt").orderBy(F.desc("doc_id"))
    fresh = (F.row_number().over(run) == 1) | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(run))
    firsts = ranged.withColumn("new", fresh).groupBy("hash", "salt").agg(
        F.sum(F.col("new").cast("long")).alias("n"), F.max("doc_id").alias("first")
    )
    frequent = (
        firsts.groupBy("hash").agg(F.sum("n").alias("n"), F.max("first").alias("keep"), F.collect_set("salt").alias("salts"))
        .filter(F.col("n") >= min_docs)
        .select("hash", "keep", F.explode("salts").alias("salt"))
    )
    dropped = held.join(table(frequent, "frequent"), ["hash", "salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("keep")))
    word = F.floor(F.col("pos") / 64).cast("int")
    return (
        dropped.groupBy("doc_id", "text_key", word.alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("drop"))
        .groupBy("doc_id", "text_key")
        .agg(F.sort_array(F.collect_list(F.struct("word", "drop"))).alias("words"))
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in `carry`, n_lines, n_dropped and kept_text."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.xxhash64("text").alias("text_key"), *carry).alias("d")
    b = bitmaps.alias("b")
    both = d.join(b, F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.text_key") == F.col("b.text_key")), "left")
    n_words = F.expr("element_at(words, -1).word + 1")
    lookup = F.expr("map_from_entries(words)")
    dense = F.transform(F.sequence(F.lit(0), n_words - 1), lambda w: F.coalesce(F.element_at(lookup, w), F.lit(0).cast("long")))
    both = both.select("d.*", "words", F.when(F.col("words").isNotNull(), dense).alias("dense"))
    stays = F.filter(
        F.split("text", "\n", -1),
        lambda _, i: F.coalesce(F.getbit(F.get("dense", F.floor(i / 64).cast("int")), i % 64), F.lit(0)) == 0,
    )
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    n_dropped = F.coalesce(F.aggregate("words", F.lit(0), lambda a, w: a + F.bit_count(w["drop"])), F.lit(0))
    return both.select(
        "doc_id", *carry, n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"),
        F.when(F.col("dense").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")).alias("kept_text"),
    )


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_lines (before), n_dropped, kept_text. A line whose key has at least
    min_chars code points and stands in at least min_docs documents stays only in the largest doc_id with it."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
