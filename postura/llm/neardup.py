"""Near-duplicate classes by DartMinHash: weighted signatures from hashed darts, banded joining, exact checks.

A document is a weighted set: its shingles of five words, weighted by how often they occur.
Every shingle owns a strip of the plane, as wide as its weight; darts thrown at the plane
by hashing lie where they lie whatever the document, so two documents share the darts of
their common regions. A document looks at the darts in its strips up to a rank that gives
it some k ln k of them, deals them to k coordinates and keeps the earliest per coordinate:
a signature whose coordinates agree with the probability of the weighted Jaccard index, at
a cost that hardly depends on k. Documents that agree in all coordinates of a band meet.

Sets are signed twice where it matters, by weights and, if a shingle repeats, with all
weights 1, and meets others on bands of either: links are of 0.8 or more in either index.

Groups never pair up with themselves. Rows with the same weighted set collapse first. In a
bucket every document meets two of its members (the least id, and the one that meets most
others, the hub). A meeting is screened by the signatures (under 40 of 80 coordinates agree
with a probability below 1e-8 at the least similarity) and decided on the texts. Classes
are the connected components of the links.

Documents of a bucket that are then in different classes could still be alike. They are
described by what sets them apart from their hub, elements removed and elements added, so
that what the whole bucket shares cancels out, and joined by the rarest of these elements:
a prefix filter with weights and positions, joined on cells of v. For a hub c of size |c|, let v(x) be the removed plus 0.8
times the added elements of x. Counting shows that x and y can be linked only if they have
(v(x) + v(y) - 0.2 |c|) / 1.8 of these elements in common, and that x is linked to c itself
unless v(x) > 0.2 |c|. So a document outside of its hub's class shares at least
v(x) - 0.2 |c| of its elements, any other at least v(y) / 1.8 of its own. No link is lost.

Defined results for odd input: texts without words (null, empty) are alike only if equal,
null counting as empty; texts of under five words have one shingle, all their words;
a row without doc_id gets the class of an equal text, if any, else null; repeated rows
share a class; rows with one doc_id and different texts are classed by their texts, and
their links count for that id; further columns are ignored. A class is named by its least
doc_id.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, marked, tidy, words

K, BANDS, SHINGLE, ALIKE = 80, 20, 5, 0.8
#: Coordinates that have to agree before texts are compared.
SCREEN = K // 2
U = np.uint64
#: Ends of the rank intervals in which darts are thrown: the first begins at 0.
LEVELS = [4.0**j for j in range(-3, 9)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def poisson_cdf(area: float) -> np.ndarray:
    terms, p, n = [], math.exp(-area), 0
    while n < area or p > 1e-18:
        terms.append(p)
        n += 1
        p *= area / n
    return np.minimum(np.cumsum(terms), 1.0)


def shingles(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) for the joined word hashes of documents of the given sizes."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    n = len(hashes)
    at = np.arange(n)
    left = ends[doc] - at  # words from here to the document's end
    first = at == (ends - sizes)[doc]
    keep = np.flatnonzero((left >= SHINGLE) | first)
    out = np.zeros(len(keep), U)
    for i in range(SHINGLE):
        there = left[keep] > i
        word = hashes[np.minimum(keep + i, n - 1)]
        out = np.where(there, mix(out * U(0x9E3779B97F4A7C15) + word), out)
    return doc[keep], out


def weighted(doc: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) and how often each occurs."""
    order = np.lexsort((x, doc))
    doc, x = doc[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (x[1:] != x[:-1])
    at = np.flatnonzero(new)
    return doc[at], x[at], np.diff(np.append(at, len(x)))


def throw(doc: np.ndarray, cell: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, rank, hash) of the darts in the cells' strips within a rank interval."""
    low = LEVELS[level - 1] if level else 0.0
    length = LEVELS[level] - low
    seed = mix(cell + U(0x632BE59BD9B4E019 * (level + 1) & (2**64 - 1)))
    count = np.searchsorted(poisson_cdf(length), uniform(seed))
    some = np.flatnonzero(count)
    count = count[some]
    which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    dart = mix(np.repeat(seed[some], count) + U(0xD1B54A32D192ED03) * (which + 1).astype(U))
    return np.repeat(doc[some], count), low + length * uniform(dart), dart


def signatures(doc: np.ndarray, x: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """K coordinates for each of n documents; a document without shingles has zeros.

    Weights are whole numbers, so a strip is a row of unit cells.
    """
    total = np.bincount(doc, weight, n)
    owner = np.repeat(doc, weight)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(weight) - weight, weight)
    cell = mix(np.repeat(x, weight) + U(0x9E3779B97F4A7C15) * nth.astype(U))
    reach = (K * math.log(K) + 3 * K) / np.maximum(total, 1)
    top = np.minimum(np.searchsorted(LEVELS, reach), len(LEVELS) - 1)
    best, value = np.full(n * K, np.inf), np.zeros(n * K, np.uint32)
    open_ = total > 0
    done = np.zeros(n, np.int64)  # levels that the document has looked at
    while open_.any():
        for level in range(int((top + 1)[open_].max())):
            use = open_ & (done <= level) & (level <= top)
            if not use.any():
                continue
            mine = use[owner]
            d, rank, dart = throw(owner[mine], cell[mine], level)
            key = d * K + (mix(dart) % U(K)).astype(np.int64)
            np.minimum.at(best, key, rank)
            won = rank == best[key]
            value[key[won]] = (dart[won] >> U(32)).astype(np.uint32)
        done = np.where(open_, top + 1, done)
        # a coordinate without a dart: look further
        open_ = open_ & np.isinf(best).reshape(n, K).any(axis=1) & (top < len(LEVELS) - 1)
        top = np.where(open_, top + 1, top)
    return value.reshape(n, K)


def bands(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, K // BANDS).astype(U)
    out = np.broadcast_to(np.arange(BANDS, dtype=U), parts.shape[:2]).copy()
    for i in range(K // BANDS):
        out = mix(out * U(0x9E3779B97F4A7C15) + parts[:, :, i])
    return out.view(np.int64)


def signed_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    hashes = batch.column("hashes")
    sizes = np.diff(hashes.offsets.to_numpy()).astype(np.int64)
    flat = hashes.flatten().to_numpy(zero_copy_only=False).view(U)
    n = len(sizes)
    doc, x, weight = weighted(*shingles(flat, sizes)) if len(flat) else (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64))
    signature = signatures(doc, x, weight, n)
    repeats = np.bincount(doc, weight > 1, n) > 0  # documents that differ from their sets
    rows = np.flatnonzero(repeats)
    mine = repeats[doc]
    plain = signatures(np.searchsorted(rows, doc[mine]), x[mine], np.ones(int(mine.sum()), np.int64), len(rows))
    keys = np.zeros((2, n), U)
    with np.errstate(over="ignore"):
        told = x * U(2) + U(1) + mix(weight.astype(U))
        np.add.at(keys[0], doc, mix(told))
        np.add.at(keys[1], doc, mix(told ^ U(0xA5A5A5A5A5A5A5A5)))
    empty = sizes == 0
    s = [np.where(empty, batch.column(c).to_numpy(), k.view(np.int64)) for c, k in zip(("t1", "t2"), keys)]
    both = np.concatenate([bands(signature), np.zeros((n, BANDS), np.int64)], axis=1)
    both[rows, BANDS:] = bands(plain)
    some = np.concatenate([np.repeat(~empty[:, None], BANDS, axis=1), repeats[:, None] & (both[:, BANDS:] != both[:, :BANDS])], axis=1)
    sets: list = [None] * n
    for i, v in zip(rows.tolist(), plain):
        sets[i] = v.tobytes()
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"), batch.column("t1"), batch.column("t2"), pa.array(s[0]), pa.array(s[1]),
            pa.array([v.tobytes() for v in signature], pa.binary()), pa.array(sets, pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some.sum(axis=1))]), pa.int32()), pa.array(both[some], pa.int64())),
        ],
        names=["doc_id", "t1", "t2", "s1", "s2", "signature", "plain", "bands"],
    )


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, s1, s2 (equal for equal weighted sets), signature (K 32-bit numbers), plain (the same of the set, if a shingle repeats) and bands."""

    def run(batches):
        for whole in batches:
            at = 0
            while at < whole.num_rows:  # some 200 thousand words at a time
                sizes = np.cumsum(whole.column("n").slice(at).to_numpy())
                k = max(1, int(np.searchsorted(sizes, 200_000)))
                yield signed_batch(whole.slice(at, k))
                at += k

    text = F.coalesce("text", F.lit(""))
    hashed = docs.select("doc_id", words(F.col("text")).alias("ws"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")).select(
        F.col("doc_id").cast("long"), F.transform("ws", lambda w: F.xxhash64(w)).alias("hashes"), F.size("ws").cast("long").alias("n"), "t1", "t2"
    )
    return hashed.mapInArrow(tidy(run), "doc_id long, t1 long, t2 long, s1 long, s2 long, signature binary, plain binary, bands array<long>")


def screened(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree often enough, by weights or as sets."""

    @F.pandas_udf("boolean")
    def often(x, px, y, py):
        unpack = lambda v: np.frombuffer(b"".join(v), np.uint32).reshape(-1, K)
        agree = lambda u, v: (unpack(u) == unpack(v)).sum(axis=1) >= SCREEN
        return pd.Series(agree(x, y) | agree(px, py))

    of = lambda c: nodes.select(F.col("rep").alias(c), F.col("signature").alias(f"s{c}"), F.coalesce("plain", "signature").alias(f"p{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(often("sa", "pa", "sb", "pb")).select("a", "b")


def shingled(text: str) -> Counter:
    low = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode("utf-8", "surrogatepass").lower())
    return Counter(zip(*(low[i:] for i in range(SHINGLE)))) if len(low) >= SHINGLE else Counter([tuple(low)])


def alike(x: Counter, y: Counter) -> bool:
    common = x.keys() & y.keys()
    low = sum(min(x[s], y[s]) for s in common)
    sets = len(common) / (len(x) + len(y) - len(common))
    return max(sets, low / (x.total() + y.total() - low)) >= ALIKE


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents with the given ids (column id), and of few others."""
    return marked(docs.select(F.col("doc_id").cast("long"), "text"), ids.select(F.col("id").alias("doc_id")), ["doc_id"])


def linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts are alike; each text goes to the pairs by joining on its id."""

    def run(batches):
        last, seen = None, Counter()  # the pairs of one b arrive together
        for batch in batches:
            a, b, ta, tb = (batch.column(c) for c in ("a", "b", "ta", "tb"))
            keep = []
            for i in range(batch.num_rows):
                if (text := tb[i].as_py() or "") != last:
                    last, seen = text, shingled(text)
                keep.append(alike(shingled(ta[i].as_py() or ""), seen))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = among(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    of = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(tidy(run), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(rep, class): the least rep of each linked node's connected component, by passing labels on and following them."""
    both = durable(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).select(F.col("a").alias("rep"), "c"))
    while True:
        near = both.join(labels.select(F.col("rep").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        passed = labels.join(near, labels["rep"] == near["a"]).select("rep", "c", F.least("c", "m").alias("m"))
        over = labels.select(F.col("rep").alias("m"), F.col("c").alias("further"))
        new = durable(passed.join(over, "m").select("rep", "c", F.least("m", "further").alias("now")))
        changed = new.where("now <> c").limit(1).count()
        labels = new.select("rep", F.col("now").alias("c"))
        if not changed:
            return labels.select("rep", F.col("c").alias("class"))


def described(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, shingles, weights): a text's distinct shingles, and how often it has each."""

    def run(batches):
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                k = max(1, int(np.searchsorted(np.cumsum(whole.column("words").slice(at).to_numpy()), 200_000)))
                batch = whole.slice(at, k)
                at += k
                sizes = np.diff(batch.column("hashes").offsets.to_numpy()).astype(np.int64)
                flat = batch.column("hashes").flatten().to_numpy(zero_copy_only=False).view(U)
                doc, x, weight = weighted(*shingles(flat, sizes)) if len(flat) else (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64))
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(sizes)))]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int64())) for v in (x.view(np.int64), weight)]
                yield pa.RecordBatch.from_arrays([batch.column("rep"), *lists], names=["rep", "shingles", "weights"])

    texts = among(docs, reps.select(F.col("rep").alias("id"))).withColumnRenamed("doc_id", "rep").join(reps, "rep", "left_semi").dropDuplicates(["rep"])
    hashed = texts.select("rep", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes")).withColumn("words", F.size("hashes").cast("long"))
    return hashed.mapInArrow(tidy(run), "rep long, shingles array<long>, weights array<long>")


def measured(sets: DataFrame) -> DataFrame:
    """(rep, n, u, w, uw): a text's distinct shingles and those that no other of the texts has; the same by weight.

    Shingles are counted over the given texts by aggregation alone: a shingle of one text
    names that text by its least rep.
    """
    each = sets.select("rep", F.explode(F.arrays_zip("shingles", "weights")).alias("s")).select("rep", F.col("s.shingles").alias("x"), F.col("s.weights").alias("times"))
    once = each.groupBy("x").agg(F.count("*").alias("texts"), F.min("rep").alias("rep"), F.first("times").alias("times"))
    alone = once.where("texts = 1").groupBy("rep").agg(F.count("*").alias("u"), F.sum("times").alias("uw"))
    whole = sets.select("rep", F.size("shingles").cast("long").alias("n"), F.aggregate("weights", F.lit(0).cast("long"), lambda a, w: a + w).alias("w"))
    return whole.join(alone, "rep", "left").select("rep", "n", F.coalesce("u", F.lit(0)).alias("u"), "w", F.coalesce("uw", F.lit(0)).alias("uw"))


def apart(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, rep, class, outside, e, removed, weight, times, behind, v, vw, most): a row for each shingle that sets a member apart from its hub c.

    The hub stands for its set. e: the shingle, its complement if it is removed; weight: how
    often it is added or removed if the member is its set (0 or 1), times: if it is its
    weighted set; v, vw: the removed ones plus ALIKE times the added ones, in the one way and in
    the other; most: (1 - ALIKE) |c|; outside: whether the member's class is not its hub's. In the
    common order the added ones come first; behind: the weight of the removed ones, behind an
    added one. Removed ones that lie beyond what a member needs are left out. A member whose
    set is alike to its hub's has a row without e, and counts as inside; for the others v is
    over most.
    """
    schema = "c long, rep long, class long, outside boolean, e long, removed boolean, weight long, times long, behind long, v double, vw double, most double"
    types = [*[pa.int64()] * 3, pa.bool_(), pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 3]
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(k: int, *values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(np.full(k, v), t) for v, t in zip(values, types)], names=names)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i] for k in batch.schema.names}
                mine, times, hub = (row[k].values.to_numpy() for k in ("shingles", "weights", "hub"))
                c, rep, group, outside = (row[k].as_py() for k in ("c", "rep", "class", "outside"))
                removed, common, most = np.setdiff1d(hub, mine), np.isin(mine, hub), (1 - ALIKE) * len(hub)
                n, once, often = len(removed), (~common).astype(np.int64), times - common
                v, vw, more = n + ALIKE * int(once.sum()), n + ALIKE * int(often.sum()), often > 0
                if outside and v <= most + 1e-6:
                    outside = False
                    yield rows(1, c, rep, group, False, pa.nulls(1, pa.int64()), False, 0, 0, 0, 0.0, 0.0, 0.0)
                yield rows(int(more.sum()), c, rep, group, outside, pa.array(mine[more]), False, pa.array(once[more]), pa.array(often[more]), n, v, vw, most)
                if n >= (v - most if outside else v / (1 + ALIKE)) - 1e-6:
                    yield rows(n, c, rep, group, outside, pa.array(~removed), True, 1, 1, 0, v, vw, most)

    hub = sets.select(F.col("rep").alias("c"), F.col("shingles").alias("hub"))
    many = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.join(sets, "rep").join(hub, "c").repartition(many).mapInArrow(tidy(run), schema)  # a hub's members go evenly to all tasks


#: Cells of v in the part of a hub that copies may lack.
CELLS = 4


def dealt(ranked: DataFrame, w: str) -> tuple[DataFrame, DataFrame]:
    """The rows that can be the lower and the upper one of a meeting, by the set (w empty) or the weights ("w"), with the keys on which these meet.

    x and y can meet only if neither's v is over the other's reach, 1.8 rest + most - v. So the
    one with the lower v covers the other's v with what lies between its own v and its reach:
    it goes to the cells of that range, the other to its own v's cell. Rows of the class that a
    shingle has most rows of go to other classes' rows only.
    """
    rest, v = (f"rest_{w}", f"v{w}") if w else ("rest", "v")
    counts = ranked.groupBy("c", "e", "class").agg(F.count("*").alias("times")).groupBy("c", "e").agg(F.max(F.struct("times", "class"))["class"].alias("top"))
    rows = ranked.select("c", "e", "rep", "class", F.col(v).alias("v"), ((1 + ALIKE) * F.col(rest) + F.col("most") - F.col(v) + 1e-5).alias("reach"), F.greatest(F.col("most") / CELLS, F.lit(1.0)).alias("cell"), F.col(f"is_x{w}").alias("is_x"), F.col(f"is_y{w}").alias("is_y"))
    rows = rows.where("is_x or is_y").join(counts, ["c", "e"]).withColumn("of_top", F.col("class") == F.col("top")).drop("top")
    at = lambda x: F.floor(F.col(x) / F.col("cell"))
    lower = rows.where("reach >= v").select("*", F.explode(F.sequence(at("v"), at("reach"))).alias("k"))
    lower = lower.select("c", "e", "k", F.explode(F.when(F.col("of_top"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("to_top"), *(F.col(c).alias(f"x_{c}") for c in ("rep", "class", "v", "reach", "is_x", "is_y")))
    upper = rows.select("c", "e", at("v").alias("k"), F.col("of_top").alias("to_top"), *(F.col(c).alias(f"y_{c}") for c in ("rep", "class", "v", "reach", "is_x", "is_y")))
    return lower, upper


MEETING = ["c", "e", "k", "to_top"]


def meeting(ranked: DataFrame) -> DataFrame:
    """(x_rep, y_rep) of rows of different classes that a shingle of both lets meet, one of them as x and the other as y."""
    found = []
    for w in ("", "w"):
        lower, upper = dealt(ranked, w)
        within = (F.col("x_v") <= F.col("y_v")) & (F.col("y_v") <= F.col("x_reach")) & (F.col("x_v") <= F.col("y_reach"))
        roles = F.col("x_is_x") & F.col("y_is_y") | F.col("x_is_y") & F.col("y_is_x")
        found.append(lower.join(upper, MEETING).where((F.col("x_class") != F.col("y_class")) & within & roles).select("x_rep", "y_rep"))
    return found[0].unionAll(found[1])


def unresolved(crowded: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): documents of a bucket and of different classes that can be alike.

    A text with n shingles, u of which no other text has, shares at most n - u with any; so
    for another with m shingles the index is at most (n - u) / (u + max(n - u, m)). That
    bound, with the least m of the bucket, drops documents at first. The others are joined,
    hub by hub, by the rarest elements that set them apart from the hub; buckets whose hubs
    lead to one that meets yet more are taken together under that one. Both steps are exact.
    """
    placed = crowded.select("rep", "h", "h2").join(found, "rep", "left").select("rep", "h", "h2", F.coalesce("class", "rep").alias("class"))
    several = lambda df: df.groupBy("h").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), *(F.min(c).alias(f"least_{c}") for c in ("n", "w") if c in df.columns)).where("lo <> hi").drop("lo", "hi")
    leads = crowded.groupBy(F.col("rep").alias("h2")).agg(F.max(F.struct("met", F.col("h2").alias("c")))["c"].alias("c"))
    left = durable(placed.join(several(placed), "h").join(leads, "h2").select("rep", "h", "class", "c"))
    sets = durable(described(docs, left.select("rep").union(left.select("c")).distinct()))
    known = durable(left.join(measured(sets), "rep"))
    most = lambda n, u, m: (n - u) / (u + F.greatest(n - u, m))
    able = known.join(several(known), "h").where(
        (most(F.col("n"), F.col("u"), F.col("least_n")) >= ALIKE) | (most(F.col("w"), F.col("uw"), F.col("least_w")) >= ALIKE)
    )
    able = able.select("c", "rep", "class").where("rep <> c").distinct()
    members = able.join(found.select(F.col("rep").alias("c"), F.col("class").alias("hub_class")), "c", "left")
    members = durable(members.select("c", "rep", "class", (F.col("class") != F.coalesce("hub_class", "c")).alias("outside")))
    mixed = members.groupBy("c").agg(F.max("outside").alias("some")).where("some").select("c")
    rows = durable(apart(members.join(mixed, "c"), sets))
    elements = rows.where("e is not null")
    # an element that one class alone has joins nothing; in the common order these come first, of the added and of the removed ones
    shared = elements.groupBy("c", "e").agg(F.count("*").alias("seen"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").drop("lo", "hi")
    mine = Window.partitionBy("c", "rep", "removed")
    earlier = mine.orderBy("seen", "e").rowsBetween(Window.unboundedPreceding, -1)
    rest = lambda w: F.col("behind") + F.sum(w).over(mine) - F.coalesce(F.sum(w).over(earlier), F.lit(0))  # noqa: E731  weight from here on
    # what it has in common with any other of another class, and with one outside of the hub's class
    to_any = lambda v: F.greatest(F.ceil(F.col(v) - F.col("most") - 1e-6), F.lit(1))
    to_outside = lambda v: F.greatest(F.ceil(F.col(v) / (1 + ALIKE) - 1e-6), F.when(F.col("outside"), to_any(v)).otherwise(1))
    ranked = (
        elements.join(shared, ["c", "e"]).withColumn("rest", rest("weight")).withColumn("rest_w", rest("times"))
        .withColumn("is_x", F.col("outside") & (F.col("weight") > 0) & (F.col("rest") >= to_any("v"))).withColumn("is_y", (F.col("weight") > 0) & (F.col("rest") >= to_outside("v")))
        .withColumn("is_xw", F.col("outside") & (F.col("rest_w") >= to_any("vw"))).withColumn("is_yw", F.col("rest_w") >= to_outside("vw"))
        .where("is_x or is_y or is_xw or is_yw")
    )
    kept = ["rep", "class", "rest", "rest_w", "v", "vw", "most", "is_x", "is_y", "is_xw", "is_yw"]
    ranked = durable(ranked.select("c", "e", *kept))
    met = meeting(ranked)
    both = met.select(F.col("x_rep").alias("x"), F.col("y_rep").alias("y")).unionAll(rows.where("e is null").select("c", "rep"))
    return both.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id."""
    return named(docs).select("doc_id", "class_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The documents, one of each class: the one with the least id. All columns stay.

    A row without doc_id goes if its text is another's; of equal ones among them one stays.
    Different texts under one id are told apart by a hash of the text.
    """
    t1 = F.xxhash64(F.coalesce("text", F.lit("")))
    found = named(docs)
    kept = found.where("doc_id = class_id").select(F.col("doc_id").alias("__id"), F.col("t1").alias("__t1")).distinct()
    rows = docs.withColumn("__t1", t1)
    with_id = rows.join(kept.withColumnRenamed("__t1", "__t"), (F.col("doc_id") == F.col("__id")) & (F.col("__t1") == F.col("__t")), "left_semi").dropDuplicates(["doc_id", "__t1"])
    copies = found.where("doc_id is null and class_id is not null").select(F.col("t1").alias("__t1")).distinct()
    without = rows.where(F.col("doc_id").isNull()).join(copies, "__t1", "left_anti").select(rows.columns).dropDuplicates(["text"])
    return with_id.unionByName(without).drop("__t1")


def named(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, and t1, t2, which tell apart rows of one id by their texts."""
    every = durable(signed(docs))
    reps = every.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    nodes = durable(every.join(reps, ["s1", "s2"]).where("doc_id = rep").select("rep", "signature", "plain", "bands"))
    meets = nodes.select("rep", F.explode("bands").alias("h"))
    crowds = meets.groupBy("h").agg(F.count("*").alias("n"), F.min("rep").alias("h1")).where("n > 1")
    crowded = durable(meets.join(crowds, "h"))
    # the one that meets most others is the likeliest to be what they are copies of
    busy = crowded.groupBy("rep").agg(F.sum("n").alias("met"))
    hubs = crowded.join(busy, "rep").groupBy("h").agg(F.max(F.struct("met", "rep")).alias("hub")).select("h", "hub.met", F.col("hub.rep").alias("h2"))
    crowded = durable(crowded.select("rep", "h", "h1").join(hubs, "h"))
    pairs = crowded.select(F.col("rep").alias("a"), F.explode(F.array_distinct(F.array("h1", "h2"))).alias("b")).where("a <> b")
    pairs = durable(screened(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), nodes))
    links = durable(linked(pairs, docs))
    found = durable(components(links))
    rest = durable(unresolved(crowded, found, docs).join(pairs, ["a", "b"], "left_anti"))
    if rest.limit(1).count():
        more = durable(linked(screened(rest, nodes), docs))
        if more.limit(1).count():
            found = components(links.unionAll(more))
    rows = every.select("doc_id", "s1", "s2", "t1", "t2").join(reps, ["s1", "s2"])
    return rows.join(found, "rep", "left").select("doc_id", F.coalesce("class", "rep").alias("class_id"), "t1", "t2")
