"""Shards that all match the corpus's mixture of sources: proportional stratified interleaving.

Rows are shuffled within their source by a seeded digest and ranked; the row of rank r of a
source of n rows stands at the fraction (2r + 1) / 2n. All rows are sorted by that fraction
and the sequence is cut into shards whose numbers of rows differ by one at most. Any run of
the sequence holds every source in proportion, to within one or two rows, so each shard does.

Neither ranking has a window over a whole source or over all rows. The first numbers the rows
of a source within slices of the digest's range, the second those of a slice of the fractions;
what stands before a slice is known from counts (first) or from the sizes of the sources alone
(second), so a source with a third of all rows is spread like any other. There are about as
many slices as rows in one, the square root of their number. The rows are checkpointed without
their texts in between; texts go with them only when shards are written.

Defined results for odd input: a null source is a source of its own; a null text has size 16
and the checksum of no bytes; rows without doc_id, and rows that repeat one, are shuffled by
their text's checksum as well; rows that agree in source, doc_id and text are interchangeable;
an empty table gives an empty result; sources with one row have it somewhere in the middle;
very long texts count as one row; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

SHARDS, SEED = 40, 13
#: Bytes that a row takes besides its text.
OVERHEAD = 16


def size() -> Column:
    return F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + OVERHEAD


def checksum() -> Column:
    return F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))


def narrow(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, stratum, shuffled): a row without its text, its source, and where the seeded shuffle puts it."""
    rows = docs.select("doc_id", size().alias("size"), checksum().alias("text_crc32"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("stratum"))
    return rows.withColumn("shuffled", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"))))


def ranked(rows: DataFrame, slices: int) -> DataFrame:
    """The rows with rank, from 0 within their stratum in shuffled order, and of, the stratum's number of rows."""
    part = F.shiftright(F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long") * slices, 32)
    rows = rows.withColumn("part", part)
    counts = rows.groupBy("stratum", "part").agg(F.count("*").alias("here"))
    running = W.partitionBy("stratum").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("stratum", "part", F.coalesce(F.sum("here").over(running), F.lit(0)).alias("before"), F.sum("here").over(W.partitionBy("stratum")).alias("of"))
    within = F.row_number().over(W.partitionBy("stratum", "part").orderBy("shuffled", "doc_id", "size")) - 1
    return rows.withColumn("within", within).join(counts, ["stratum", "part"]).withColumn("rank", F.col("before") + F.col("within")).drop("part", "within", "before")


def offsets(rows: DataFrame, slices: int) -> DataFrame:
    """(slice, ahead): how many rows have fractions below the slice. Known from the strata's sizes; a stratum adds a row for each slice that it reaches."""
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("of"))
    # ranks whose fraction is below b / slices: the odd numbers below 2 * of * b / slices
    below = lambda b: F.expr(f"((2 * of * ({b}) + {slices - 1}) div {slices}) div 2")
    full = F.col("of") > slices
    each = sizes.select("of", F.explode(F.sequence(F.lit(0).cast("long"), F.least("of", F.lit(slices)) - 1)).alias("j"))
    each = each.select(F.when(full, F.col("j")).otherwise(F.expr(f"((2 * j + 1) * {slices}) div (2 * of)")).alias("slice"), F.when(full, below("j + 1") - below("j")).otherwise(1).alias("n"))
    running = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    return each.groupBy("slice").agg(F.sum("n").alias("n")).select("slice", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("ahead"))


def assigned(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, stratum, position, shard and slot of every row.

    position is the row's place in the whole sequence. Shard s takes the positions p with
    p * shards div rows = s; slots count from 0 within a shard.
    """
    rows = durable(narrow(docs, seed))
    total = rows.count()
    slices = max(1, math.isqrt(total))
    found = ranked(rows, slices).withColumn("slice", F.expr(f"((2 * rank + 1) * {slices}) div (2 * of)"))
    fraction = (2 * F.col("rank") + 1) / (2 * F.col("of"))
    within = F.row_number().over(W.partitionBy("slice").orderBy(fraction, "stratum", "rank")) - 1
    found = found.withColumn("within", within).join(offsets(rows, slices), "slice").withColumn("position", F.col("ahead") + F.col("within"))
    shard = F.expr(f"(position * {shards}) div {max(1, total)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return found.withColumn("shard", shard).withColumn("slot", F.col("position") - first).select("doc_id", "size", "text_crc32", "stratum", "position", F.col("shard").cast("int").alias("shard"), "slot")


def write(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Whole rows as Parquet, in one folder a shard (shard=S) and in slot order within each of its files.

    Rows meet their places by source, doc_id, size and checksum; of rows that agree in all of
    these each takes one place. A shard is written by as many tasks as Spark makes of its rows.
    """
    where = assigned(docs, shards, seed)
    same = ["__stratum", "__id", "__size", "__crc", "__copy"]
    copy = lambda *by: F.row_number().over(W.partitionBy("__stratum", "__id", "__size", "__crc").orderBy(*by))
    ident = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n"))
    where = where.select(F.col("stratum").alias("__stratum"), ident.alias("__id"), F.col("size").alias("__size"), F.col("text_crc32").alias("__crc"), "shard", "slot").withColumn("__copy", copy("shard", "slot"))
    rows = docs.withColumns({"__stratum": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")), "__id": ident, "__size": size(), "__crc": checksum()}).drop("shard", "slot").withColumn("__copy", copy(F.xxhash64(F.coalesce("text", F.lit("")))))
    placed = rows.join(where, same).drop(*same)
    placed.hint("rebalance", "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row: rows are dealt out so that shards' counts differ by one at most."""
    return assigned(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
