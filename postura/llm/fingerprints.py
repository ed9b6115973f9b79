"""Document fingerprints: invertible Bloom lookup sketches of paragraphs (DataFrame functions only).

A text's paragraphs are hashed to digests: its lines, and the runs of words into which
a rule of local content cuts them, so that an edit changes the digests near it only. The
rule looks at the characters around a place: it cuts between words, or within a run
without spaces, where they belong to sets that hold about a quarter of every script. A sketch of
m cells holds each digest in three cells, as a count, the exclusive or of the digests and
that of their check values. Sketches of two versions subtract cell by cell, common
paragraphs vanish, and peeling recovers the digests that differ: a cell with one digest
gives it away, it is taken out of its other cells, and so on. If peeling gets stuck, larger
sketches are made and tried; beyond the largest, the digest sets are subtracted themselves.

The likeness of two texts is the Jaccard index of their digest sets, which follows from the
sets' sizes and the number of recovered digests.

Defined results for odd input: null is an empty text; empty texts have an empty sketch and
are equal (likeness 1); a document that is alone is its own next document; rows of one
doc_id follow each other by a hash of their text, a null doc_id comes first; further
columns are ignored.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Cells of a fingerprint, and of the larger sketches that are tried on failure; multiples of three.
CELLS = 48
RETRIES = (192, 768, 3072, 12288)
#: Rounds of peeling; each takes out all the digests that then lie alone.
ROUNDS = 24
#: Documents in a range of ids that is sorted together, and the most ranges.
RANGE_ROWS, MOST_RANGES = 2000, 16384

#: Ranges of code points with the period and width of their stripes, for sets of about a quarter of each script.
STRIPES = ((0x100, 0x6FF, 8, 2), (0x700, 0x1FFF, 16, 4), (0x3040, 0x30FF, 8, 2), (0x3400, 0x9FFF, 0x100, 0x40), (0xA000, 0xD7A3, 0x40, 0x10), (0x10000, 0x3FFFF, 0x1000, 0x400))


def striped(latin: str, offset: int) -> list[tuple[str, str]]:
    """(a cheap test, a set): the given characters below U+0100, and a stripe of each period beyond, from that share of it on."""
    found = [("", f"[{latin}]")]
    for low, high, period, width in STRIPES:
        starts = range(low + period * offset // 4, high - width + 2, period)
        found.append((f"[{chr(low)}-{chr(high)}]", "[" + "".join(f"{chr(x)}-{chr(x + width - 1)}" for x in starts) + "]"))
    return found


def listed(latin: str) -> str:
    """A set's characters one by one: a set without ranges is looked up in one table."""
    return re.sub(r"(.)-(.)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), latin)


ENDS, BEGINS = striped(listed("adhlptxADHLPTX0-2.!?)\xe0-\xe3\xe8-\xeb"), 0), striped(listed("bcfmsBCFMS3-5\xc0-\xcc\xe4-\xe7\xec-\xef"), 2)
SPACE, BEYOND = r"[\t\n\x0b\x0c\r\x20]", f"{chr(0x100)}-{chr(0x10FFFF)}"
BEHIND = f"(?:(?<={ENDS[0][1]})|(?<=[{BEYOND}])(?:" + "|".join(f"(?<={cheap})(?<={one})" for cheap, one in ENDS[1:]) + "))"
AHEAD = f"(?:{BEGINS[0][1]}|(?=[{BEYOND}])(?:" + "|".join(f"(?={cheap}){one}" for cheap, one in BEGINS[1:]) + "))"
#: Ends a paragraph: a line's end, spaces after one of ENDS and before one of BEGINS, or, 24 characters into a run
#: without spaces, a place after one of ENDS and before two of BEGINS. What tells most places apart is asked first.
PARAGRAPH = rf"(?={SPACE})(?:{SPACE}*\n{SPACE}*|{BEHIND}{SPACE}+(?={AHEAD}))|(?=[{BEGINS[0][1][1:-1]}{BEYOND}])(?={AHEAD}{{2}}){BEHIND}(?<=[!-퟿]{{24}})"
#: No character: stands between paragraphs.
CUT = "\uffff"

CELL = "array<struct<cell:int,n:int,key:bigint,check:bigint>>"


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs."""
    # a replacement's pattern is compiled once, that of a split for every text
    parts = F.when(F.contains(text, F.lit(CUT)), F.split(text, PARAGRAPH)).otherwise(F.split(F.regexp_replace(text, PARAGRAPH, CUT), CUT))
    return F.array_except(F.transform(parts, lambda p: F.xxhash64(p)), F.array(F.xxhash64(F.lit(""))))


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def placed(keys: Column, sign: int, m: Column) -> Column:
    """The keys in their three cells each of m."""
    third = (m / 3).cast("int")
    at = lambda k, i: (F.pmod(F.xxhash64(k, F.lit(i)), third) + i * third).cast("int")
    one = lambda k, i: F.struct(at(k, i).alias("cell"), F.lit(sign).alias("n"), k.alias("key"), F.xxhash64(k, F.lit(77)).alias("check"))
    return F.flatten(F.transform(keys, lambda k: F.array(one(k, 0), one(k, 1), one(k, 2))))


def merged(cells: Column) -> Column:
    """Adds up entries of the same cell and drops cells that come to nothing."""
    empty = F.expr(f"cast(array() as {CELL})")
    none = F.expr("named_struct('cell', -1, 'n', 0, 'key', 0L, 'check', 0L)")

    def flushed(acc: Column) -> Column:
        last = acc["last"]
        return F.when((last["n"] == 0) & (last["key"] == 0) & (last["check"] == 0), acc["done"]).otherwise(F.concat(acc["done"], F.array(last)))

    def step(acc: Column, x: Column) -> Column:
        last = acc["last"]
        both = F.struct(x["cell"].alias("cell"), (last["n"] + x["n"]).alias("n"), last["key"].bitwiseXOR(x["key"]).alias("key"), last["check"].bitwiseXOR(x["check"]).alias("check"))
        return F.when(x["cell"] == last["cell"], F.struct(acc["done"].alias("done"), both.alias("last"))).otherwise(F.struct(flushed(acc).alias("done"), x.alias("last")))

    return F.aggregate(F.sort_array(cells), F.struct(empty.alias("done"), none.alias("last")), step, flushed)


def sketch(keys: Column, m: int = CELLS) -> Column:
    return merged(placed(keys, 1, F.lit(m)))


def negated(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.struct(c["cell"].alias("cell"), (-c["n"]).alias("n"), c["key"].alias("key"), c["check"].alias("check")))


def subtracted(a: Column, b: Column) -> Column:
    """The cells of a sketch less those of another of the same size."""
    return merged(F.concat(a, negated(b)))


def peeled(cells: Column, m: Column) -> Column:
    """struct(cells, more, fewer): what is left, and the digests recovered of the first and of the second set."""
    empty = F.expr("cast(array() as array<bigint>)")

    def alone(cells: Column, n: int) -> Column:
        return F.array_distinct(F.transform(F.filter(cells, lambda c: (c["n"] == n) & (c["check"] == F.xxhash64(c["key"], F.lit(77)))), lambda c: c["key"]))

    def step(acc: Column, _: Column) -> Column:
        def out(found: Column) -> Column:
            more, fewer = found["more"], found["fewer"]
            rest = merged(F.concat(acc["cells"], placed(more, -1, m), placed(fewer, 1, m)))
            return F.struct(rest.alias("cells"), F.concat(acc["more"], more).alias("more"), F.concat(acc["fewer"], fewer).alias("fewer"), (F.size(more) + F.size(fewer) > 0).alias("going"))

        return F.when(~acc["going"] | (F.size(acc["cells"]) == 0), acc).otherwise(let(F.struct(alone(acc["cells"], 1).alias("more"), alone(acc["cells"], -1).alias("fewer")), out))

    start = F.struct(cells.alias("cells"), empty.alias("more"), empty.alias("fewer"), F.lit(True).alias("going"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def recovered(a: Column, b: Column, a_cells: Column, b_cells: Column) -> Column:
    """struct(ok, m, more, fewer): digests of a without b, and of b without a, from the smallest sketch that peels.

    a, b: the digests; a_cells, b_cells: their fingerprints of CELLS cells.
    """
    least = F.abs(F.size(a) - F.size(b))  # so many differ at least
    nothing = F.expr("cast(array() as array<bigint>)")
    start = F.struct(F.lit(False).alias("ok"), F.lit(0).alias("m"), nothing.alias("more"), nothing.alias("fewer"))

    def attempt(acc: Column, m: Column) -> Column:
        cells = merged(F.when(m == CELLS, F.concat(a_cells, negated(b_cells))).otherwise(F.concat(placed(a, 1, m), placed(b, -1, m))))
        # more differ than the cells can tell apart if all of them are in use
        hopeful = let(cells, lambda c: F.when(F.size(c) < m, c).otherwise(F.slice(c, 1, 1)))
        done = let(peeled(hopeful, m), lambda p: F.struct((F.size(p["cells"]) == 0).alias("ok"), m.alias("m"), p["more"].alias("more"), p["fewer"].alias("fewer")))
        return F.when(acc["ok"] | (least > m), acc).otherwise(done)

    last = lambda acc: F.when(acc["ok"], acc).otherwise(F.struct(F.lit(True).alias("ok"), F.lit(0).alias("m"), F.array_except(a, b).alias("more"), F.array_except(b, a).alias("fewer")))
    return F.aggregate(F.array(*map(F.lit, (CELLS, *RETRIES))), start, attempt, last)


def likeness(a: Column, b: Column, a_cells: Column, b_cells: Column) -> Column:
    """Jaccard index of two digest sets by way of their sketches."""
    both = F.size(a) + F.size(b)
    index = let(recovered(a, b, a_cells, b_cells), lambda r: (both - F.size(r["more"]) - F.size(r["fewer"])) / (both + F.size(r["more"]) + F.size(r["fewer"])))
    return F.when(both == 0, F.lit(1.0)).otherwise(index)


def spelled(cells: Column) -> Column:
    """A sketch as text: cell.count.digests.checks by cell, in hexadecimal."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(".", F.hex(c["cell"].cast("long")), F.hex(c["n"].cast("long")), F.hex(c["key"]), F.hex(c["check"]))), " ")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, keys, cells, and those of the next document by doc_id as next_text, next_keys, next_cells.

    The ids are cut into ranges at quantiles, and a range is sorted by one task. The first
    document of each range is also sent to the range before, and the very first one to the
    last, so that every row finds its next one there.
    """
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n, least = rows.agg(F.count("*"), F.min("id")).first()
    if not n:
        ranges, bounds = 1, []
    else:
        ranges = min(MOST_RANGES, -(-n // RANGE_ROWS))
        cuts = rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges)).first()[0] if ranges > 1 else []
        bounds = sorted({b for b in cuts if b > least})
    found = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")

    def halved(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        return F.when(acc["lo"] >= acc["hi"], acc).otherwise(
            F.when(F.element_at(found, F.greatest(middle, F.lit(1))) <= F.col("id"), F.struct(middle.alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), (middle - 1).alias("hi")))
        )

    # in how many ranges' first ids the id reaches
    steps = F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length())))
    at = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halved, lambda acc: acc["lo"]) if bounds else F.lit(0)
    to = lambda r, guest, wrap: F.struct(r.cast("int").alias("range"), F.lit(guest).alias("guest"), F.lit(wrap).alias("wrap"))
    no = F.expr("cast(array() as array<struct<range:int,guest:int,wrap:int>>)")
    places = F.concat(
        F.array(to(F.col("at"), 0, 0)),
        F.when((F.col("at") > 0) & (F.element_at(found, F.greatest(F.col("at"), F.lit(1))) == F.col("id")), F.array(to(F.col("at") - 1, 1, 0))).otherwise(no) if bounds else no,
        F.when(F.col("id") == F.lit(least), F.array(to(F.lit(len(bounds)), 1, 1))).otherwise(no),
    )
    dealt = rows.withColumn("at", at).select("doc_id", "id", "text", F.explode(places).alias("p")).select("doc_id", "id", "text", "p.*").repartition("range")
    made = dealt.withColumn("keys", digests(F.col("text"))).withColumn("cells", sketch(F.col("keys"))).withColumn("h", F.xxhash64("text"))
    order = W.partitionBy("range").orderBy("wrap", "id", "guest", "h")
    following = lambda c: F.lead(c).over(order).alias(f"next_{c}")
    return made.select("doc_id", "guest", "text", "keys", "cells", following("text"), following("keys"), following("cells")).where("guest = 0").drop("guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    pairs = with_next(docs).withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter)))
    pairs = pairs.withColumn("edited_keys", digests(F.col("edited"))).withColumn("edited_cells", sketch(F.col("edited_keys")))
    same = lambda other: likeness(F.col("keys"), F.col(f"{other}_keys"), F.col("cells"), F.col(f"{other}_cells"))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        spelled(F.col("cells")).alias("fingerprint"), spelled(F.col("edited_cells")).alias("edited_fingerprint"),
        same("edited").alias("near_edited"), same("next").alias("near_next"),
    )
