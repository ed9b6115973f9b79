"""Benchmark decontamination with a stored positional inverted index (DataFrame functions only).

The corpus is read and tokenised once. A posting is (term, document, position); the
postings of the terms that the benchmark asks for are written as a table, together with
one posting that ends each document and so holds its number of words. Everything else is
read from that table: how rare the terms are, and the places of the phrases.

Of a benchmark window the list of the rarest term is read first; its postings are the
anchors. The second rarest term's list is intersected with them, adjusted by offset and
slack, then the lists of the other terms with what is left; a window with a term that the
corpus lacks is dropped before any list is read. An anchor is an exact match if every term
stands at its offset; else it is a proximity match if within len + slop - 1 words before or
after it every term stands at least as often as in the window, in any order. Of the other
terms' lists only postings near an anchor that is left are sent (a bitmap of bounded size
tells, see common.marked).

Defined results for odd input: null text has no words and gets zeros; an item without
words has no window; a repeated item_id counts once; a null item_id makes words hit but is
no item; repeated document rows each get their own, equal, row; an empty benchmark leaves
every document clean; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, marked, words, written

#: Rows of a table of windows or terms up to which it is broadcast; a row takes under 1 KB.
BLOCK = 100_000
#: Positions are compared within blocks of this size and its neighbours.
NEAR = 32
#: What ends a document in the index; no word has this character.
END = "\x00"


def sized(df: DataFrame) -> DataFrame:
    """Marked for broadcasting if it is small."""
    return F.broadcast(df) if df.limit(BLOCK + 1).count() <= BLOCK else df


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(item_id, phrase, terms): every run of n words of an item, or the whole of a shorter one."""
    return (
        benchmark.select(F.col("item_id"), words(F.col("text")).alias("ws"))
        .where(F.size("ws") > 0)
        .select("item_id", "ws", F.explode(F.sequence(F.lit(1), F.greatest(F.size("ws") - (n - 1), F.lit(1)))).alias("at"))
        .select("item_id", F.slice("ws", F.col("at"), n).alias("terms"))
        .select("item_id", F.xxhash64("terms").alias("phrase"), "terms")
        .distinct()
    )


def text_key() -> Column:
    """Tells apart rows that share a doc_id but not a text, and rows without doc_id from others."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull())


def indexed(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: (h, id, k, doc_id, pos), a posting for each place of the terms (h, term).

    h: hash of the term; id and k name a document (its doc_id, or 0, and a hash of its text);
    pos counts from 0. The posting of END stands at the document's number of words.
    """
    kind = docs.schema["doc_id"].dataType
    texts = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(0).cast(kind)).alias("id"),
        text_key().alias("k"),
        F.array_append(words(F.col("text")), F.lit(END)).alias("ws"),
    )
    places = texts.select("doc_id", "id", "k", F.posexplode("ws").alias("pos", "term")).withColumn("h", F.xxhash64("term"))
    ended = terms.unionAll(terms.sparkSession.range(1).select(F.xxhash64(F.lit(END)).alias("h"), F.lit(END).alias("term")))
    asked = ended.withColumnRenamed("term", "asked")
    return written(places.join(sized(asked), "h").where("term = asked").select("h", "id", "k", "doc_id", "pos"), "postings")


def by_rarity(windows: DataFrame, index: DataFrame) -> DataFrame:
    """(phrase, hs, h1, o1, h2) of the phrases all of whose terms the corpus has: hashes of the terms, the rarest and its offset, the second rarest."""
    lists = windows.select("phrase", "terms").distinct()
    spelled = lists.select("phrase", F.size("terms").alias("len"), F.posexplode("terms").alias("off", "term")).withColumn("h", F.xxhash64("term"))
    counts = index.groupBy("h").agg(F.count("*").alias("n"))
    return (
        spelled.join(counts, "h")
        .groupBy("phrase", "len")
        .agg(F.array_sort(F.collect_list(F.struct("off", "h")))["h"].alias("hs"), F.array_sort(F.collect_list(F.struct("n", "off", "h"))).alias("ranked"))
        .where(F.size("ranked") == F.col("len"))
        .select("phrase", "hs", F.col("ranked")[0]["h"].alias("h1"), F.col("ranked")[0]["off"].alias("o1"), F.element_at("ranked", F.least("len", F.lit(2)))["h"].alias("h2"))
    )


def parts(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / NEAR), F.floor(end / NEAR)))


def around(anchors: DataFrame, lists: DataFrame) -> DataFrame:
    """The anchors (id, k, at, phrase, reach, h, part) with the places, pos, of their terms h within reach of them."""
    return lists.join(anchors, ["id", "k", "h", "part"]).where(F.abs(F.col("pos") - F.col("at")) <= F.col("reach"))


def occurrences(index: DataFrame, ranked: DataFrame, slop: int = 5) -> DataFrame:
    """(id, k, phrase, start, len, exact): exact and proximity matches of the phrases; start counts for exact ones."""
    reach = F.size("hs") + F.lit(slop - 1)
    near_at = parts(F.col("at") - F.col("reach"), F.col("at") + F.col("reach")).alias("part")
    lists = index.select("id", "k", "h", "pos", F.floor(F.col("pos") / NEAR).alias("part"))
    first = sized(ranked.select("phrase", F.col("h1").alias("h"), "h2", reach.alias("reach")))
    anchors = index.join(first, "h").select("id", "k", F.col("pos").alias("at"), "phrase", "reach", F.col("h2").alias("h")).select("*", near_at)
    second = lists.join(sized(ranked.select(F.col("h2").alias("h")).distinct()), "h", "left_semi")
    two = durable(around(anchors, second).select("id", "k", "at", "phrase", "reach").distinct())
    sought = two.select("*", near_at)
    others = sought.join(sized(ranked.select("phrase", F.explode(F.array_distinct("hs")).alias("h"))), "phrase")
    close = marked(lists, sought, ["id", "k", "part"])  # of all lists, what lies near an anchor that is left
    found = around(others, close).groupBy("id", "k", "at", "phrase").agg(F.collect_set(F.struct("h", "pos")).alias("places"))
    start = F.col("at") - F.col("o1")
    exact = F.forall(F.sequence(F.lit(0), F.size("hs") - 1), lambda i: F.array_contains("places", F.struct(F.get("hs", i).alias("h"), (start + i).cast("int").alias("pos"))))
    often = lambda h, xs: F.size(F.filter(xs, lambda x: x == h))
    near = F.forall("hs", lambda h: often(h, F.col("places")["h"]) >= often(h, F.col("hs")))
    return (
        found.join(sized(ranked.select("phrase", "hs", "o1")), "phrase")
        .select("id", "k", "phrase", start.alias("start"), F.size("hs").alias("len"), exact.alias("exact"), near.alias("near"))
        .where("exact or near")
        .drop("near")
    )


def covered(places: Column) -> Column:
    """Words inside any of the places, an array of (start, len)."""
    step = lambda acc, p: F.struct(
        (acc["n"] + F.greatest(F.lit(0), p["start"] + p["len"] - F.greatest(acc["end"], p["start"]))).cast("long").alias("n"),
        F.greatest(acc["end"], p["start"] + p["len"]).cast("long").alias("end"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(F.array_sort(places), zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, slop: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (phrases matched by proximity only), and k, the row's text_key()."""
    windows = durable(benchmark_windows(benchmark, n))
    terms = windows.select(F.explode("terms").alias("term")).distinct().select(F.xxhash64("term").alias("h"), "term")
    index = indexed(docs, terms)
    end = F.xxhash64(F.lit(END))
    ranked = durable(by_rarity(windows, index.where(F.col("h") != end)))
    holders = windows.select("phrase", F.col("item_id").cast("string").alias("item"))
    found = (
        occurrences(index, ranked, slop)
        .groupBy("id", "k")
        .agg(
            F.collect_set(F.when(F.col("exact"), F.struct("start", "len"))).alias("places"),
            F.collect_set(F.when(F.col("exact"), F.col("phrase"))).alias("phrases"),
            F.collect_set(F.when(~F.col("exact"), F.col("phrase"))).alias("close"),
        )
        .select("id", "k", covered(F.col("places")).alias("n_hit"), F.size(F.array_except("close", "phrases")).cast("long").alias("n_near"), F.explode_outer("phrases").alias("phrase"))
        .join(sized(holders), "phrase", "left")
        .groupBy("id", "k")
        .agg(F.first("n_hit").alias("n_hit"), F.first("n_near").alias("n_near"), F.sort_array(F.collect_set("item")).alias("items"))
    )
    every = index.where(F.col("h") == end).select("doc_id", "id", "k", F.col("pos").cast("long").alias("n_words"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return every.join(found, ["id", "k"], "left").select(
        "doc_id", "n_words", zero("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        zero("n_near"), "k",
    )
