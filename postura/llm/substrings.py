"""Exact substring dedup: every byte of a SPAN-byte string that also starts elsewhere goes.

Two copies of a SPAN-byte string hold the same anchor, the string's least-hashed GRAM-byte
part, at the same place; so strings meet by their anchors, and a text is some one hundred and
seventieth as many anchors as bytes. An anchor's context is the union of the strings that
it stands for. Equal contexts are counted; those that occur again go as they are, and only
one of each, where an anchor has several contexts, has its bytes sent to be compared.

There the suffixes that begin at the anchors are sorted: a mergesort whose comparisons find
the common extension by binary search over prefix polynomial hashes, in logarithmic time, and
verify it on the bytes. Common extensions of neighbours then tell, for every string at once,
which contexts share its part from the anchor on; its part before the anchor is compared by
hash. What is found equal is verified on the bytes, and a group with a collision is compared
string by string. Contexts count as equal by a cryptographic digest of their bytes.

An anchor with more than CROWD contexts is split: its strings are dealt by where they lie
around the anchor into ranges, and within a range by a digest of the bytes that every string
of the range has, some seven eighths of it; so only contexts that share these meet.

Strings are judged on the input and never cross documents. Defined results for odd input:
null is an empty text; texts shorter than SPAN bytes keep all; repeated rows are each other's
copies, so all of them go; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import cmp_to_key, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flagged, marked, written

SPAN, GRAM = 400, 64
WIDTH = SPAN - GRAM + 1  # grams in a string
#: Contexts of an anchor beyond which they are split, and how many places of a string around the anchor a part has.
CROWD, PART = 1000, 48
U = np.uint64
MASK = 2**64 - 1
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that powers have inverses modulo 2**64
#: Bytes of texts or contexts that a task looks at together.
TOGETHER = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


@lru_cache(maxsize=8)
def powers(base: int, size: int) -> np.ndarray:
    """base**i modulo 2**64, for i below size."""
    out = np.full(size, base & MASK, U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Polynomial hashes of any part of a byte string, from prefix sums."""

    def __init__(self, data: np.ndarray, base: int):
        size = 1 << max(12, len(data).bit_length())
        self.inverse = powers(pow(base, -1, 2**64), size)
        self.prefix = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * powers(base, size)[: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, anchor, first, last, gram hash) of joined texts; first and last start the anchor's strings; the places count from the text's beginning.

    ends: where the texts end.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return (none, none, none, none, none)
    at = np.arange(n - GRAM + 1)
    gram = mix(Hashes(data, BASES[0]).of(at, at + GRAM))
    low = U(2**32 - 1)  # a batch has less bytes; the same bits of a hash decide whatever stands around a string
    least = (gram & ~low) | at.astype(U)  # the leftmost of equal ones
    reach, width = 1, WIDTH
    while reach * 2 <= width:  # minima over 1, 2, 4 ... grams
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    starts = np.concatenate([[0], ends[:-1]])
    text = np.searchsorted(ends, np.arange(len(least)), side="right")
    valid = np.flatnonzero(np.arange(len(least)) + SPAN <= ends[text])
    if not len(valid):
        return (none, none, none, none, none)
    anchor = (least[valid] & low).astype(np.int64)
    new = np.ones(len(valid), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[valid[1:]] != text[valid[:-1]])
    first = valid[new]
    last = valid[np.append(np.flatnonzero(new)[1:] - 1, len(valid) - 1)]
    anchor, owner = anchor[new], text[first]
    base = starts[owner]
    return owner, anchor - base, first - base, last - base, gram[anchor].view(np.int64)


def digests(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each byte string, of a cryptographic digest."""
    both = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts]), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def in_parts(batch: pa.RecordBatch, column: str):
    """Slices of a batch of some TOGETHER bytes of the column each."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        k = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, side="right"))
        k = max(k, at + 1)
        yield batch.slice(at, k - at)
        at = k


def anchored(texts: DataFrame) -> DataFrame:
    """(rid, anchor, first, last, gram, c1, c2) of every anchor of the texts (rid, text); c1 and c2: digest of the context and the anchor's place in it."""

    def run(batches):
        for whole in batches:
            for part in in_parts(whole, "text"):
                raw = [x.encode("utf-8", "surrogatepass") if x else b"" for x in part.column("text").to_pylist()]
                owner, anchor, first, last, gram = anchors(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw]))
                told = [raw[i][f : e + SPAN] + (a - f).to_bytes(4, "big") for i, a, f, e in zip(owner.tolist(), anchor.tolist(), first.tolist(), last.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid").take(pa.array(owner)), *(pa.array(x.astype(np.int32)) for x in (anchor, first, last)), pa.array(gram), *map(pa.array, digests(told))],
                    names=["rid", "anchor", "first", "last", "gram", "c1", "c2"],
                )

    return texts.select("rid", "text").mapInArrow(run, "rid binary, anchor int, first int, last int, gram long, c1 long, c2 long")


def split(gram: int, anchor: int, first: int, last: int, data: bytes):
    """(gram, first, last) of a context's strings by range of places around the anchor; gram stands for the range and the bytes all its strings have."""
    for low in range(0, WIDTH, PART):
        high = low + PART - 1
        f, e = max(first, anchor - high), min(last, anchor - low)
        if f <= e:
            must = data[anchor - low : anchor + SPAN - high]
            yield int.from_bytes(hashlib.blake2b(must + gram.to_bytes(8, "big", signed=True) + bytes([low // PART]), digest_size=8).digest(), "big", signed=True), f, e


def with_bytes(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The contexts with their bytes, cut out of the texts that they lie in; those of a crowded anchor in parts."""
    kinds = {"gram": pa.int64(), "rid": pa.binary(), "anchor": pa.int32(), "first": pa.int32(), "last": pa.int32(), "n": pa.int64(), "bytes": pa.binary()}

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for text, rid, places in zip(batch.column("text").to_pylist(), batch.column("rid").to_pylist(), batch.column("places").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                for p in places:
                    whole = p["gram"], p["first"], p["last"]
                    for gram, first, last in split(p["gram"], p["anchor"], p["first"], p["last"], data) if p["kinds"] > CROWD else [whole]:
                        rows.append((gram, rid, p["anchor"], first, last, p["n"], data[first : last + SPAN]))
                if len(rows) > 4000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    by_text = wanted.groupBy("rid").agg(F.collect_list(F.struct("gram", "anchor", "first", "last", "n", "kinds")).alias("places"))
    return marked(texts, wanted, ["rid"]).join(by_text, "rid").mapInArrow(run, "gram long, rid binary, anchor int, first int, last int, n long, bytes binary")


class Context:
    __slots__ = ("anchor", "at", "data", "first", "gram", "last", "n", "rid")

    def __init__(self, gram, rid, anchor, first, last, n, data):
        self.gram, self.rid, self.anchor, self.first, self.last, self.n, self.data = gram, rid, anchor, first, last, n, data
        self.at = 0  # where the anchor lies in the joined bytes


def extension(h: Hashes, data: bytes, a: int, b: int, most: int) -> int:
    """Length of the common extension from places a and b on, by binary search over hashes, verified on the bytes."""
    p, inv = h.prefix, h.inverse
    pa_, pb, ia, ib = int(p[a]), int(p[b]), int(inv[a]), int(inv[b])
    low, high = 0, most
    while low < high:
        m = (low + high + 1) >> 1
        if ((int(p[a + m]) - pa_) * ia - (int(p[b + m]) - pb) * ib) & MASK:
            high = m - 1
        else:
            low = m
    if data[a : a + low] == data[b : b + low]:
        return low
    return next(i for i in range(low) if data[a + i] != data[b + i])  # hashes collided


def suffix_sorted(group: list[Context], h: Hashes, data: bytes) -> tuple[list[Context], list[int]]:
    """The contexts in the order of their suffixes from the anchor on, and each one's common extension with the one before."""
    rest = {id(c): len(c.data) - (c.anchor - c.first) for c in group}

    def compare(x: Context, y: Context) -> int:
        nx, ny = rest[id(x)], rest[id(y)]
        k = extension(h, data, x.at, y.at, min(nx, ny))
        return nx - ny if k == min(nx, ny) else data[x.at + k] - data[y.at + k]

    ordered = sorted(group, key=cmp_to_key(compare))  # a mergesort
    common = [-1] + [extension(h, data, x.at, y.at, min(rest[id(x)], rest[id(y)])) for x, y in zip(ordered, ordered[1:])]
    return ordered, common


def repeated(groups: list[list[Context]]) -> list[tuple[int, int, int]]:
    """(rid, start, end) of the bytes of strings that occur in more than one context of a group."""
    flat = [c for g in groups for c in g]
    data = b"".join(c.data for c in flat)
    at = 0
    for c in flat:
        c.at = at + c.anchor - c.first
        at += len(c.data)
    h = Hashes(np.frombuffer(data, np.uint8), BASES[0])
    ordered, common = [], []
    for g in groups:
        o, k = suffix_sorted(g, h, data)
        ordered += o
        common += k
    place = np.array([c.at for c in ordered])
    least = np.array([c.anchor - c.last for c in ordered])  # bytes of a string before the anchor: from least to most
    most = np.array([c.anchor - c.first for c in ordered])
    lcp = np.array(common)
    pairs = []
    for o in range(int(least.min()), int(most.max()) + 1):
        own = np.flatnonzero((least <= o) & (o <= most))
        if len(own) < 2:
            continue
        run = np.cumsum(lcp < SPAN - o)[own]  # contexts that share the part from the anchor on
        key = mix(mix(h.of(place[own] - o, place[own])) + run.astype(U) * U(BASES[1]))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        i, j = own[order[1:][same]], own[order[:-1][same]]
        if len(i):
            pairs.append(np.stack([np.concatenate([i, j]), np.concatenate([j, i]), np.full(2 * len(i), o)]))
    if not pairs:
        return []
    i, j, o = np.concatenate(pairs, axis=1)
    order = np.lexsort((o, j, i))
    i, j, o = i[order], j[order], o[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    begin = np.flatnonzero(new)
    low, high = o[begin], o[np.append(begin[1:] - 1, len(o) - 1)]
    out, wrong = [], set()
    for x, y, lo, hi in zip(i[begin].tolist(), j[begin].tolist(), low.tolist(), high.tolist()):
        a, b, c = int(place[x]), int(place[y]), ordered[x]
        if data[a - hi : a - lo + SPAN] != data[b - hi : b - lo + SPAN]:
            wrong.add(c.gram)
        elif c.n == 1:
            out.append((c.rid, c.anchor - hi, c.anchor - lo + SPAN))
    if wrong:  # hashes collided
        grams = {c.gram for c in ordered}
        kept = [c for c in ordered if c.gram in wrong & grams]
        rids = {(c.rid, c.anchor) for c in kept}
        out = [r for r in out if not any(r[0] == x[0] and r[1] <= x[1] < r[2] for x in rids)] + plainly(kept)
    return out


def plainly(contexts: list[Context]) -> list[tuple[int, int, int]]:
    """repeated() by comparing the strings themselves."""
    strings = lambda c: ((s, c.data[s - c.first : s - c.first + SPAN]) for s in range(c.first, c.last + 1))
    seen = Counter((c.gram, x) for c in contexts for _, x in strings(c))
    return [(c.rid, s, s + SPAN) for c in contexts if c.n == 1 for s, x in strings(c) if seen[c.gram, x] > 1]


def compared(contexts: DataFrame) -> DataFrame:
    """(rid, first, end) of repeated bytes; the contexts of one anchor hash meet in one task, in bounded groups at a time."""

    def run(batches):
        todo: list[list[Context]] = []
        size = 0

        def flush():
            out = repeated(todo) if todo else []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in ((0, pa.binary()), (1, pa.int32()), (2, pa.int32()))], names=["rid", "first", "end"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "rid", "anchor", "first", "last", "n", "bytes"))):
                c = Context(*row)
                if not todo or todo[-1][0].gram != c.gram:
                    if size > TOGETHER:
                        yield flush()
                        todo, size = [], 0
                    todo.append([])
                todo[-1].append(c)
                size += len(c.data)
        yield flush()

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "rid binary, first int, end int")


def without_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans."""

    def run(batches):
        for batch in batches:
            kept, n, gone, runs = [], [], [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                parts, at, count = [], 0, 0
                for p in sorted((p["first"], p["end"]) for p in places or ()):
                    if p[0] > at or not count:
                        parts.append(data[at : p[0]])
                        count += 1
                    at = max(at, p[1])
                parts.append(data[at:])
                kept.append(b"".join(parts))
                n.append(len(data))
                gone.append(len(data) - len(kept[-1]))
                runs.append(count)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64())], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    by_text = spans.groupBy("rid").agg(F.collect_set(F.struct("first", "end")).alias("places"))
    # only texts that have spans, and few others, are sent to them
    rows = flagged(texts, spans, ["rid"], "__some")
    kept = rows.where("__some").join(by_text, "rid", "left").select("doc_id", "text", "places")
    whole = rows.where("not __some").select("doc_id", "text", F.lit(None).cast(kept.schema["places"].dataType).alias("places"))
    return kept.unionAll(whole).mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(rid, first, end): bytes of the texts that belong to strings which also start elsewhere."""
    found = written(anchored(texts), "anchors")
    contexts = found.groupBy("gram", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("rid", "anchor", "first", "last")).alias("one"))
    contexts = written(contexts, "contexts")
    again = contexts.where("n > 1").select("gram", "c1", "c2")
    whole = found.join(again, ["gram", "c1", "c2"]).select("rid", "first", (F.col("last") + SPAN).alias("end"))
    # anchors with several contexts, one of which at least occurs once only
    several = contexts.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("gram", "kinds")
    wanted = written(contexts.join(several, "gram").select("gram", "n", "kinds", "one.*"), "wanted")
    return written(whole.unionAll(compared(with_bytes(texts, wanted))), "spans")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, kept, n_bytes, n_removed, n_spans. A row is known by 128 bits of hashes of its id and text; equal rows fare alike."""
    text = F.coalesce("text", F.lit(""))
    rid = F.unhex(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(text, "doc_id"), F.xxhash64(F.lit(1), text, "doc_id")))))
    texts = docs.select("doc_id", text.alias("text"), rid.alias("rid"))
    return without_spans(texts, repeated_spans(texts))


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
