"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import string
from functools import reduce, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postura.storage import durable, shared_folder, written  # noqa: F401

#: A word is a run of digits, lower-case ASCII letters and any non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; texts that are all ASCII take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


#: Bytes of the rows that go to Python together, about; by default up to 64 MB do, which two tasks hold in the executor and again in their workers.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold BATCH_BYTES at most, or less if it says so; results don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    most = int(spark.conf.get(key).rstrip("b"))
    if not 0 < most <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


#: The model that this process keeps, by the function that made it and its path.
HELD: dict = {}


def only_model(make):
    """make(path), kept for the tasks that follow until this process needs another model: a Python worker goes from stage to stage."""

    @wraps(make)
    def get(path: str):
        key = make.__module__, make.__qualname__, path
        found = HELD.get(key)
        if found is None:
            HELD.clear()
            found = HELD[key] = make(path)
        return found

    return get


def give_back() -> None:
    """Hands memory that this process has freed back to the machine; what idle workers hold counts as their executor's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def make_room() -> None:
    """For work without a model: one that the worker keeps from an earlier stage goes."""
    if HELD:
        HELD.clear()
        give_back()


def tidy(run, model: bool = False):
    """A function for mapInArrow that hands back memory at a task's end, and at its beginning the models of other stages, unless it needs one."""

    def whole(batches):
        if not model:
            make_room()
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


#: Words of 64 bits of a bitmap of keys, and how many bits of its word mark a key.
MARKS, BITS = 1 << 19, 4


def marks_of(columns: list[str]) -> tuple[Column, Column]:
    """The word of the bitmap, and the bits in it, that stand for the columns."""
    other = F.xxhash64(*columns, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(other, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS)]
    return F.pmod(F.xxhash64(*columns), F.lit(MARKS)).cast("int"), reduce(lambda a, b: a.bitwiseOR(b), bits)


def bitmap(keys: DataFrame, columns: list[str]) -> DataFrame:
    word, mask = marks_of(columns)
    return keys.select(word.alias("__word"), mask.alias("__mask")).groupBy("__word").agg(F.bit_or("__mask").alias("__bits"))


def marked(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose columns are among the keys, and few others, so that a join with the keys has little to send.

    The keys are marked in a bitmap of MARKS words, a table of that many rows at most, which is
    broadcast. With very many keys more rows pass, and the join that follows leaves them out.
    """
    word, mask = marks_of(columns)
    return rows.withColumn("__word", word).join(F.broadcast(bitmap(keys, columns)), "__word").where(F.col("__bits").bitwiseAND(mask) == mask).drop("__word", "__bits")


def flagged(rows: DataFrame, keys: DataFrame, columns: list[str], flag: str) -> DataFrame:
    """All rows, with a flag that is true for those that marked() would keep."""
    word, mask = marks_of(columns)
    rows = rows.withColumn("__word", word).join(F.broadcast(bitmap(keys, columns)), "__word", "left")
    return rows.withColumn(flag, F.coalesce(F.col("__bits").bitwiseAND(mask) == mask, F.lit(False))).drop("__word", "__bits")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
