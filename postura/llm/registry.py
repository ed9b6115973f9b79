"""Queries op1 to op13 over the whole tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

from . import decontaminate, fingerprints, langid, licenses, neardup, privacy, ranking, secrets, shards, substrings, transducer, webtext, whitening
from .common import table
from .sql import ORACLES  # noqa: F401


def op1_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("k")


def op2_language_id(spark, sf_dir):
    return langid.report(table(spark, sf_dir, "documents"))


def op3_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_personal_data(spark, sf_dir):
    return privacy.report(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark, sf_dir):
    return neardup.classes(table(spark, sf_dir, "documents"))


def op6_document_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark, sf_dir):
    return substrings.report(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark, sf_dir):
    return transducer.encode(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark, sf_dir):
    return webtext.main_text(table(spark, sf_dir, "pages"))


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark, sf_dir):
    return ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_interleaved_sharding(spark, sf_dir):
    return shards.report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_language_id, op3_license_scan, op4_personal_data, op5_minhash_near_dedup,
        op6_document_fingerprints, op7_suffix_array_dedup, op8_sentencepiece, op9_secret_scan, op10_html_extraction, op11_embedding_whitening, op12_ranked_search, op13_interleaved_sharding,
    )
}
