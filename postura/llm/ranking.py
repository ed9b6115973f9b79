"""Ranked lexical search, term-at-a-time over short lists and document-at-a-time over long ones.

Documents are read and split into terms once. A posting says how often a term of the queries
stands in a document; postings are written as a table, with one more for each document that
has terms at all, so that the table also tells how many documents and terms there are. Weights
and the documents' share of a score are columns over it, in 64-bit integers.

Postings are dealt out by blocks of about BLOCK documents, and every block meets all queries
(in groups of GROUP). Within a block the lists of a query are split by length:

* short lists are read term at a time, each added up into one array of accumulators;
* the accumulators then count as one more list, bounded by their largest sum, beside the long
  lists, each bounded by its largest contribution in this block. Lists are ordered by bound. As
  long as the least bounds together stay below the score that the tenth best has, documents that
  stand in such lists only are never looked at; the others are taken in order of their ids, some
  hundreds at a time, and dropped as soon as what they have and what they can still get stays
  below that score; a list is entered by binary search at the documents that are left.

Equal scores go by document, so a document is dropped only if it stays strictly below. Each block
returns its best documents for a query; the best of these are the result.

Defined results for odd input: null text, or one without terms, counts nowhere and matches
nothing; an item without terms, or whose terms no document holds, has no row; items that repeat
an id are one item with the terms of all; repeated documents are ranked each on its own, rows
without doc_id before others of the same score; ids are whole
numbers; empty tables give an empty result; a very long text is one document with many postings; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, durable, written
from .decontaminate import sized

#: A term: a run of digits, ASCII letters and any characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 10
#: Documents of a block, about, and queries of a group.
BLOCK, GROUP = 4096, 1024
#: A list is short if it holds at most this share of its block's documents.
SHORT = 1 / 32
#: Documents taken at a time.
STEP = 512
#: Stands for the document itself among its postings; no term has this character.
DOCUMENT = "\x00"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def tallied(words: Column) -> Column:
    """array<struct<term, tf>> of the different terms of a list: it is sorted, and a term ends where the next one differs."""
    ends = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))
    counted = lambda s, e: F.transform(e, lambda at, k: F.struct(F.get(s, at - 1).alias("term"), (at - F.when(k > 0, F.get(e, k - 1)).otherwise(0)).alias("tf")))
    return F.transform(F.array(F.array_sort(words)), lambda s: F.transform(F.array(ends(s)), lambda e: counted(s, e))[0])[0]


def vocabulary(queries: DataFrame, item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(item_id, term_id) and (term, term_id) of all different terms of the queries; the document's own sign has a number too."""
    found = durable(queries.select(F.col(item).alias("item_id"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct())
    numbered = durable(found.select("term").distinct().unionByName(found.sparkSession.createDataFrame([(DOCUMENT,)], "term string")).withColumn("term_id", F.monotonically_increasing_id()))
    return found.join(sized(numbered), "term").select("item_id", "term_id"), numbered


def postings(docs: DataFrame, numbered: DataFrame) -> DataFrame:
    """A written table (doc, doc_id, n, term_id, tf): doc tells rows apart, n is the document's number of terms."""
    rows = docs.select("doc_id", terms(F.col("text")).alias("ws")).where(F.size("ws") > 0).withColumn("doc", F.monotonically_increasing_id())
    own = F.array(F.struct(F.lit(DOCUMENT).alias("term"), F.lit(0).alias("tf")))
    each = rows.select("doc", "doc_id", F.size("ws").cast("long").alias("n"), F.explode(F.concat(tallied(F.col("ws")), own)).alias("p"))
    each = each.select("doc", "doc_id", "n", F.col("p.term").alias("term"), F.col("p.tf").cast("long").alias("tf"))
    return written(each.join(sized(numbered), "term").select("doc", "doc_id", "n", "term_id", "tf"), "rankings")


def hybrid(lists: list[tuple[np.ndarray, np.ndarray]], size: int, best: int = BEST) -> tuple[np.ndarray, np.ndarray]:
    """The best documents of a block and their scores, highest first, equal ones by place.

    lists: for each term the places of its documents, rising, and what it adds to them; size: places of the block.
    """
    short = [x for x in lists if len(x[0]) <= size * SHORT]
    sums = np.zeros(size, np.int64)
    for at, adds in short:  # term at a time
        sums[at] += adds
    touched = np.flatnonzero(sums)
    streams = sorted([(int(a.max()), p, a) for p, a in lists if len(p) > size * SHORT] + ([(int(sums.max()), touched, sums[touched])] if len(touched) else []), key=lambda s: -s[0])
    below = np.concatenate([np.cumsum([s[0] for s in streams][::-1])[::-1], [0]])  # what the lists from here on add at most
    places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = 0 if len(touched) < best else int(np.partition(sums[touched], -best)[-best])  # the tenth best has this much at least
    at = 0
    while at < size:
        needed = sum(1 for b in below[:-1] if b >= max(least, 1))  # the lists after these can't make a document good enough
        if not needed:
            break
        step = [p[a : a + STEP] for p, a in ((s[1], np.searchsorted(s[1], at)) for s in streams[:needed])]
        until = min([int(s[-1]) + 1 for s in step if len(s) == STEP], default=size)  # all documents of these lists up to here
        docs = np.unique(np.concatenate([s[s < until] for s in step]))
        have = np.zeros(len(docs), np.int64)
        for k, (_, where, adds) in enumerate(streams):  # document at a time: lists are entered where documents are left
            keep = have + below[k] >= max(least, 1)
            docs, have = docs[keep], have[keep]
            if not len(docs):
                break
            i = np.minimum(np.searchsorted(where, docs), len(where) - 1)
            have += np.where(where[i] == docs, adds[i], 0)
        places, scores = np.concatenate([places, docs]), np.concatenate([scores, have])
        order = np.lexsort((places, -scores))[:best]
        places, scores = places[order], scores[order]
        if len(scores) == best:
            least = max(least, int(scores[-1]))
        at = until
    good = scores > 0
    return places[good], scores[good]


def best_of_block(postings: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """postings: doc, has_id, doc_id, term_id, share; queries: item_id, term_id, weight. Columns item_id, doc, has_id, doc_id and score of the block's best."""
    out: list[pd.DataFrame] = []
    if len(postings) and len(queries):
        known = postings[["doc", "has_id", "doc_id"]].drop_duplicates("doc").sort_values(["has_id", "doc_id", "doc"], ignore_index=True)
        place = pd.Series(known.index.to_numpy(), index=known["doc"].to_numpy())
        rows = postings.assign(place=place.loc[postings["doc"].to_numpy()].to_numpy()).sort_values(["term_id", "place"])
        ids, starts = np.unique(rows["term_id"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(rows))
        at, share = rows["place"].to_numpy(np.int64), rows["share"].to_numpy(np.int64)
        for item, own in queries.groupby("item_id", sort=False, dropna=False):
            k = np.searchsorted(ids, own["term_id"].to_numpy())
            held = [(int(i), int(w)) for i, w, t in zip(k, own["weight"], own["term_id"], strict=True) if i < len(ids) and ids[i] == t and w > 0]
            found, scores = hybrid([(at[starts[i] : ends[i]], w * share[starts[i] : ends[i]]) for i, w in held], len(known))
            out.append(known.iloc[found].assign(item_id=item, score=scores))
    return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("item_id", "doc", "has_id", "doc_id", "score")})


def ranked(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the BEST documents of each query that share a term with it."""
    asked, numbered = vocabulary(queries)
    table = postings(docs, numbered)
    own = F.lit(numbered.where(F.col("term") == DOCUMENT).first()["term_id"])
    sums = table.where(F.col("term_id") == own).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    count, length = max(1, sums[0]), max(1, sums[1])
    frequency = table.where(F.col("term_id") != own).groupBy("term_id").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(count) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    asked = asked.join(frequency, "term_id").select("item_id", "term_id", weight.alias("weight"))

    m = F.expr(f"10 + (90 * n * {count}L) div {length}L")
    share = F.expr("(1000000000 * tf) div (1000 * tf + 8 * m)")
    blocks = -(-count // BLOCK)
    groups = -(-max(1, queries.count()) // GROUP)
    block = F.pmod(F.xxhash64("doc"), F.lit(blocks))
    lists = table.where(F.col("term_id") != own).withColumn("m", m).select("doc", F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "term_id", share.alias("share"), block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = lists.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(best_of_block, "item_id long, doc long, has_id boolean, doc_id long, score long")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "has_id", "doc_id", "doc")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)
    return best.select("item_id", "rank", F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "score")
