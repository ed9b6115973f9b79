"""Documents that operators have to stand, and brute-force results."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["k", "h", "id", "term", "pos", "ws", "row", "rid", "range", "score", "lang_pred", "keys", "cells", "n", "a", "b", "rep", "before", "labels", "spans"]


def prose(seed: int, n: int, words=("the", "of", "and", "thing", "reason", "tion", "other", "from", "with", "hare", "Seldom", "quick")) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randrange(40)) * (r.random() < 0.3) for _ in range(n))


def edge_rows() -> list[tuple]:
    texts = [
        None, "", " \n\t ", "!!! ...", "word", "One two three four", "x" * 30_000, "ab " * 9_000, "é😀 ünïcode 日本語 text " * 20, prose(1, 300), prose(1, 300), prose(1, 290) + " end",
        prose(2, 3000), "password = hunter2secret token: abc", "+1 (918) 555-2191 and a.b@c.example 10.0.0.1", "\u0000 zero byte", "Under the MIT license. Apache License, Version 2.0; CC BY-NC",
        "İstanbul K KELVIN", "1" * 5_000, "a@b " * 500,
    ]
    rows = [(i, t, None if i % 5 == 0 else ("en", "de")[i % 2], None if i % 7 == 0 else f"s{i % 3}", None if t is None or i % 4 == 0 else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[9], rows[9], (None, prose(3, 40), "en", "s1", 9), (None, None, None, None, None)]


def documents(spark, rows=None, clash: bool = False):
    """A table of documents; with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows() if rows is None else rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("other") for c in CLASHING}) if clash else df


def benchmark(spark, rows=None):
    rows = [(1, prose(1, 30)), (2, "one TWO three"), (2, "one TWO three"), (3, None), (4, ""), (None, prose(2, 12)), (10, prose(2, 25))] if rows is None else rows
    return spark.createDataFrame(rows, "item_id long, text string")


def words(text: str | None) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
