"""The corpus pipeline: five training-data stages over documents, each written and read again.

Every stage works on all that the one before kept. Documents without a recognisable
language go; of near-duplicates the one with the least id stays (a row without an id goes
only if its text equals another row's); contaminated documents go; secrets are blanked out
in place; what is left is encoded. Repeated rows are copies of each other; an empty table
gives an empty result; further columns stay until the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postura.llm import decontaminate, langid, neardup, secrets, transducer
from postura.llm.common import remove, shared_folder, table

#: Least share of a text's words that has to be of its language.
LEAST_SHARE = 0.4


def identify_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is null, has no letter, or is of no language by LEAST_SHARE go."""
    found = langid.predict(docs, langid.fitted(docs), ("__language", "__share"))
    return found.where((F.col("__language") != langid.UNDETERMINED) & (F.col("__share") >= LEAST_SHARE)).select(docs.columns)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the least id; rows of one id are told apart by their texts."""
    return neardup.representatives(docs).select(docs.columns)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of the benchmark go; a row is known by its id, or its lack of one, and its text."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("k").alias("bad_k"))
    rows = docs.withColumn("__k", decontaminate.text_key())
    same = rows["doc_id"].eqNullSafe(bad["bad_id"]) & (rows["__k"] == bad["bad_k"])
    return rows.join(bad, same, "left_anti").select(docs.columns)


def blank_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; secrets in their texts are blanked out, and n_chars follows where the text changed."""
    clean = secrets.redact(docs.withColumn("__before", F.col("text")))
    length = F.when(F.col("text") != F.col("__before"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(docs.columns)


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip of every row."""
    return transducer.encode(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", blank_secrets),
    ("sentencepiece", encode),
]

#: SQL can express neither the classifier, the signatures nor the transducer.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is removed once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
