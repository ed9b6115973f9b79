"""Personal data: fixed patterns, and boosted trees over candidate spans (DataFrame functions only).

Fixed patterns find e-mail addresses, IP addresses, payment cards and telephone numbers;
what they find stays. Generators with high recall propose further spans, which may overlap:
runs of digits and their separators, anything around an at sign, and spelled-out at signs.
Each candidate is described by its format (digits, separators, checksum, shape) and context
(neighbouring characters, telling words before it, words and signs of quantities around it).
Boosted trees score them. Their positives are the confirmed candidates, also in altered
forms that the fixed patterns don't know (ALTERED: without the plus, with a spelled-out at
sign, as a bare number after a telling word), so that the learner can't rely on what the
patterns ask for. Their negatives are clearly not personal: dates, versions, prices,
amounts, parts of longer words, failed check sums (refused()), and the examples of
REFUSED. Candidates that are neither are not learned from. The least threshold is chosen at
which PRECISION of the candidates, each scored by trees that its document had no part in,
are positives. Candidates over it that touch no fixed span are added as kind "other".

The trees are fitted to the counts of distinct descriptions in all documents, dealt into
FOLDS by a hash of the text. Fitting is one pass over whole texts that shuffles these
counts, the scan another one without a shuffle.

Defined results for odd input: null is scanned as an empty text and gives zero counts, the
digest of an empty string and no spans; repeated rows each give their row; without any
confirmed candidate nothing is added; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Parts of the documents, each scored by trees of the others for the threshold.
FOLDS = 3
#: Share of positives among the labelled candidates over the threshold, on held-out documents.
PRECISION = 0.95
TREES, SHRINK = 20, 0.4

# Possessive repeats keep long runs from recursion; a match begins where a run begins, or at the end of the last match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried: quick to test.
NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){15}")),
    "phone": lambda t: F.rlike(t, F.lit(r"\+[0-9]")),
}
GENERATORS = {
    r"[+(]?[0-9][0-9\x20().-]{5,}[0-9]": lambda t: F.rlike(t, F.lit(r"[0-9][0-9\x20().-]{5}")),
    r"(?:\G|(?<![^\s@]))[^\s@]++@[^\s@]++": lambda t: F.contains(t, F.lit("@")),
    r"(?i)(?:\G|(?<![a-z0-9._-]))[a-z0-9._-]++\x20?[\[(]at[\])]\x20?[a-z0-9.-]++": lambda t: F.rlike(t, F.lit(r"(?i)[\[(]at[\])]")),
}
TELLING = r"(?i)(?:mail|phone|tel|call|fax|mobile|card|visa|iban|account|ssn|address|contact|\bip)\W{0,3}\w{0,6}\W{0,3}$"
#: Before a number that is no personal one, and after it.
QUANTITY = r"(?i)(?:[$\u20ac\u00a3\u00a5#\u00a7]|\b(?:v|ver|version|release|build|isbn|issn|doi|pages?|pp|vol|volume|chapter|section|years?|since|dated|order|invoice|item|part|serial|price|costs?|total|sum|count|counted|usd|eur|gbp))\W{0,3}$"
UNIT = r"(?i)^\W{0,2}(?:[$\u20ac\u00a3\u00a5%\u00b0]|(?:usd|eur|euros?|dollars?|pounds?|percent|people|items|units|pages|years|bytes|[kmgt]b|kg|km|mm|cm)\b)"
DATE = r"^(?:[12][0-9]{3}[-.\x20]?(?:0?[1-9]|1[0-2])[-.\x20]?(?:0?[1-9]|[12][0-9]|3[01])(?:\x20[0-9]{1,2})?|(?:0?[1-9]|[12][0-9]|3[01])[-.\x20](?:0?[1-9]|[12][0-9]|3[01])[-.\x20][12][0-9]{3}|[12][0-9]{3}\x20?-\x20?[12][0-9]{3})[.-]?$"
AMOUNT = r"^(?:[0-9]+\.[0-9]{1,2}|[1-9][0-9]{0,2}(?:[.\x20][0-9]{3})+|[0-9]\.[0-9]+|[0-9]{1,3}(?:\.[0-9]{1,2}){2,}(?:\.[0-9]+)?)$"
#: Numbers, between the marks, that are clearly not personal.
REFUSED = (
    "in version <10.4.2.1183> of", "release <2.10.34.7>, then", "on <2024-03-15> the", "dated <15.03.2024> and", "at <2024-03-15 10>:22", "for $<1299.00> a", "costs <1 250 000> euro",
    "some <1250000> people", "pages <1204-1219> of", "between <1914-1918> there", "the order <20431187> was", "isbn <978-3-16-148410-0>.", "a ratio of <3.14159265>", "they counted <3500000> of",
    "a total of <18.250.731>", "serial <0004417223> of", "with <1718200000> as", "of <20240315> and", "some <48213377> of", "key a<12345678>f", "and <123456789> of", "then <4465758382889438> of",
)
#: How confirmed spans read in forms that the fixed patterns don't know: what stands before (null: the same), and the value.
ALTERED = {
    "phone": lambda v: [
        (None, F.ltrim(v, F.lit("+"))), (None, national(v)), (None, F.regexp_replace(national(v), "[()]", "")), ("phone: ", national(v)), ("call ", only_digits(national(v))),
        ("account: ", only_digits(v)), ("iban ", F.substring(only_digits(v), 1, 8)), ("ssn ", F.regexp_replace(F.substring(only_digits(v), 1, 9), "^(...)(..)", "$1-$2-")),
    ],
    "email": lambda v: [(None, F.replace(v, F.lit("@"), F.lit(x))) for x in (" [at] ", "[at]", "(at)")],
    "card": lambda v: [("account: ", F.substring(only_digits(v), 1, 12)), ("account ", F.substring(only_digits(v), 1, 10)), ("ssn ", F.regexp_replace(F.substring(only_digits(v), 1, 9), "^(...)(..)", "$1-$2-"))],
}

SHOWN = "array<struct<text:string,start:int,end:int,value:string,y:int>>"
SPANS = "array<struct<start:int,end:int,value:string>>"


def none(kind: str = SPANS) -> Column:
    return F.expr(f"cast(array() as {kind})")


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, value), in code points.

    The text splits at the matches, so their places follow from the lengths of the pieces between.
    """
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.when(x["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans")))

    return F.aggregate(found, F.struct(F.lit(0).alias("at"), none().alias("spans")), step, lambda acc: acc["spans"])


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""

    def step(acc: Column, i: Column) -> Column:
        d = digits.substr(F.length(digits) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), step) % 10 == 0


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def national(value: Column) -> Column:
    """A telephone number without its country code."""
    return F.regexp_replace(value, r"^\+[0-9]{1,2}[\x20.-]*+(?=[0-9(])", "")


def octets(value: Column) -> Column:
    small = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
    return F.forall(F.split(value, r"\."), lambda p: small(p) & (F.coalesce(F.when(small(p), F.ltrim(p, F.lit("0")).try_cast("int")), F.lit(0)) <= 255))


VALID = {
    "email": lambda v: F.lit(True),
    "ip": octets,
    "card": lambda v: F.length(only_digits(v)).between(16, 19) & luhn(only_digits(v)),
    "phone": lambda v: F.length(only_digits(v)).between(8, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    return F.when(NEEDS[kind](text), F.filter(located(text, PATTERNS[kind]), lambda s: VALID[kind](s["value"]))).otherwise(none())


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, a column of spans for each kind, and the candidates of the generators."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    proposed = [F.when(needs(text), located(text, pattern)).otherwise(none()) for pattern, needs in GENERATORS.items()]
    return rows.select("doc_id", "text", *(base_spans(text, k).alias(k) for k in KINDS), F.array_distinct(F.concat(*proposed)).alias("candidates"))


def touches(span: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Whether a fixed span overlaps the span."""
    hit = lambda x: (x["start"] < span["end"]) & (span["start"] < x["end"])
    found = F.lit(False)
    for k in kinds:
        found = found | F.exists(F.col(k), hit)
    return found


def binned(value: Column, *cuts: int) -> Column:
    return sum((value >= c).cast("int") for c in cuts)


def described(text: Column, s: Column) -> list[Column]:
    """A candidate's features, small whole numbers."""
    value = s["value"]
    digits = only_digits(value)
    around = lambda c: F.when(c == "", 0).when(F.rlike(c, F.lit(r"\s")), 1).when(F.rlike(c, F.lit(r"[A-Za-z]")), 2).when(F.rlike(c, F.lit("[0-9]")), 3).otherwise(4)
    before, after = text.substr(F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))), text.substr(s["end"] + 1, F.lit(12))
    return [
        binned(F.length(digits), 1, 7, 8, 10, 11, 12, 16, 20),
        binned(F.length(F.regexp_replace(value, r"[^\x20().-]", "")), 1, 2, 3, 4, 6),
        F.when(F.startswith(value, F.lit("+")), 3).when(F.startswith(value, F.lit("(")), 2).when(F.startswith(value, F.lit("0")), 1).otherwise(0),
        F.rlike(value, F.lit(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]{2,}")).cast("int") + F.contains(value, F.lit("@")).cast("int"),
        (F.length(digits).between(13, 19) & luhn(digits)).cast("int"),
        F.rlike(value, F.lit(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")).cast("int"),
        F.rlike(value, F.lit(r"(?i)[\[(]at[\])]")).cast("int"),
        F.when(s["start"] == 0, 0).otherwise(around(text.substr(s["start"], F.lit(1)))),
        around(text.substr(s["end"] + 1, F.lit(1))),
        F.rlike(before, F.lit(TELLING)).cast("int"),
        (F.rlike(before, F.lit(QUANTITY)) | F.rlike(after, F.lit(UNIT))).cast("int"),
        F.when(F.rlike(value, F.lit(DATE)), 2).when(F.rlike(value, F.lit(AMOUNT)), 1).otherwise(0),
        F.contains(value, F.lit("(")).cast("int"),
    ]


def shown(text: Column, s: Column, y: int, before: str | None = None, value: Column | None = None) -> Column:
    """A span with 24 characters before it and 12 behind it, or with another text before it or value, and its label."""
    value = s["value"] if value is None else value
    front = text.substr(F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))) if before is None else F.lit(f"it {before}")
    start = F.length(front)
    whole = F.concat(front, value, text.substr(s["end"] + 1, F.lit(12)))
    return F.struct(whole.alias("text"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.lit(y).alias("y"))


def refused(text: Column, s: Column) -> Column:
    """Whether a candidate that touches no fixed span is clearly nothing personal."""
    value, digits = s["value"], only_digits(s["value"])
    before, after = text.substr(F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))), text.substr(s["end"] + 1, F.lit(12))
    number = ~F.rlike(value, F.lit(r"@|(?i)[\[(]at[\])]"))
    glued = F.rlike(before, F.lit(r"[\p{L}\p{N}_]$")) | F.rlike(after, F.lit(r"^[\p{L}\p{N}_]"))
    told = F.rlike(before, F.lit(TELLING))
    shape = F.rlike(value, F.lit(DATE)) | F.rlike(before, F.lit(QUANTITY)) | F.rlike(after, F.lit(UNIT)) | (F.length(digits).between(16, 19) & ~luhn(digits)) | F.rlike(value, F.lit(r"^[0-9]+(?:\.[0-9]+){3}$"))
    return F.when(number, glued | ~told & shape).otherwise(~F.contains(value, F.lit(".")))


def examples(rows: DataFrame) -> Column:
    """The labelled spans of with_spans(): candidates, confirmed spans in altered forms, and what is clearly not personal."""
    text, none_shown = F.col("text"), F.expr(f"cast(array() as {SHOWN})")
    confirmed = F.transform(F.filter("candidates", lambda s: touches(s)), lambda s: shown(text, s, 1))
    denied = F.transform(F.filter("candidates", lambda s: ~touches(s) & refused(text, s)), lambda s: shown(text, s, 0))
    other_form = lambda k, i, before: F.transform(F.col(k), lambda s: shown(text, s, 1, before, ALTERED[k](s["value"])[i][1]))
    altered = [other_form(k, i, before) for k, forms in ALTERED.items() for i, (before, _) in enumerate(forms(F.lit("")))]
    fixed = [F.struct(F.lit(t.replace("<", "").replace(">", "")).alias("text"), F.lit(t.index("<")).alias("start"), F.lit(t.index(">") - 1).alias("end"), F.lit(t[t.index("<") + 1 : t.index(">")]).alias("value"), F.lit(0).alias("y")) for t in REFUSED]
    personal = F.size(F.concat(*map(F.col, KINDS))) > 0
    # only what a generator would propose
    proposed = lambda x: F.rlike(x["value"], F.lit("|".join(f"(?:^(?:{g})$)" for g in GENERATORS)))
    return F.concat(confirmed, denied, *(F.filter(a, proposed) for a in altered), F.when(personal, F.array(*fixed)).otherwise(none_shown))


def split_gain(x: np.ndarray, grads: np.ndarray, hess: np.ndarray, at: np.ndarray) -> tuple | None:
    """The best (gain, feature, cut, left, right) of the rows at, from histograms of the features."""
    best = None
    g_all, h_all = grads[at].sum(), hess[at].sum()
    for f in range(x.shape[1] if len(at) else 0):
        value = x[at, f]
        cuts = np.flatnonzero(np.bincount(value))[1:]
        g, h = (np.cumsum(np.bincount(value, w[at]))[cuts - 1] for w in (grads, hess))  # of the rows below each cut
        gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all * g_all / (h_all + 1)
        for cut, one in zip(cuts.tolist(), gain.tolist()):
            if best is None or one > best[0] + 1e-9:
                best = (one, f, cut)
    if not best or best[0] <= 1e-6:
        return None
    below = x[at, best[1]] < best[2]
    return (*best, at[below], at[~below])


def boosted(rows: list[tuple[tuple[int, ...], int, int]]) -> list:
    """Trees of two levels for (features, confirmed, refused), by gradient boosting of the logistic loss.

    A tree is a leaf's value or (feature, cut, tree below the cut, tree from it on).
    """
    x = np.array([r[0] for r in rows], np.int64)
    good, all_ = np.array([r[1] for r in rows], float), np.array([r[1] + r[2] for r in rows], float)
    trees, score = [], np.zeros(len(rows))

    def grow(at: np.ndarray, depth: int, grads: np.ndarray, hess: np.ndarray):
        found = split_gain(x, grads, hess, at) if depth else None
        if found:
            _, f, cut, left, right = found
            low, high = grow(left, depth - 1, grads, hess), grow(right, depth - 1, grads, hess)
            return (f, cut, low, high)
        leaf = SHRINK * float(grads[at].sum() / (hess[at].sum() + 1))
        score[at] += leaf
        return leaf

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(rows)), 2, good - all_ * p, all_ * p * (1 - p)))
    return trees


def applied(tree, x: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
    return tree


def threshold(scored: list[tuple[float, int, int]]) -> float:
    """The least score from which on PRECISION of the (score, confirmed, refused) candidates are confirmed; infinity if there is none."""
    scored = sorted(scored, reverse=True)
    least, good, bad = math.inf, 0, 0
    for k, (s, a, b) in enumerate(scored):
        good, bad = good + a, bad + b
        if good and good >= PRECISION * (good + bad) and (k + 1 == len(scored) or scored[k + 1][0] < s):
            least = s
    return least


def counted(docs: DataFrame) -> DataFrame:
    """fold, x, a, b: confirmed and refused examples of all documents by fold of their text and description."""
    fold = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(FOLDS)).cast("int")
    spans = with_spans(docs)
    each = spans.select(fold.alias("fold"), F.explode(examples(spans)).alias("c"))
    return (
        each.select("fold", F.array(*described(F.col("c.text"), F.col("c"))).alias("x"), F.col("c.y").alias("y"))
        .groupBy("fold", "x").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    )


def fitted(docs: DataFrame) -> tuple[list, float]:
    """The trees and the threshold, from the candidates of all documents: only counts of distinct descriptions come to the driver.

    A fold's candidates are scored by trees of the other folds; these scores set the threshold. The trees that stay are of all folds.
    """
    found = counted(docs).collect()

    def of(some) -> list[tuple[tuple[int, ...], int, int]]:
        sums: dict = {}
        for r in some:
            a, b = sums.get(tuple(r.x), (0, 0))
            sums[tuple(r.x)] = (a + int(r.a), b + int(r.b))
        return sorted((x, a, b) for x, (a, b) in sums.items())

    if not any(r.a for r in found):
        return [], math.inf
    scored = []
    for k in range(FOLDS):
        others = boosted(rest) if (rest := of(r for r in found if r.fold != k)) else []
        scored += [(sum(applied(t, x) for t in others), a, b) for x, a, b in of(r for r in found if r.fold == k)]
    return boosted(of(found)), threshold(scored)


def as_column(tree, x: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, low, high = tree
    return F.when(x[f] < cut, as_column(low, x)).otherwise(as_column(high, x))


def scan(docs: DataFrame, model: tuple[list, float] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_other, base_spans, spans (kind:start:end by kind, then start)."""
    trees, least = fitted(docs) if model is None else model
    rows = with_spans(docs)
    added = none()
    if trees and least < math.inf:
        def kept(s: Column) -> Column:
            score = lambda x: sum((as_column(t, x) for t in trees), F.lit(0.0))
            over = F.transform(F.array(F.array(*described(F.col("text"), s))), score)[0] >= least
            return ~touches(s) & over

        added = F.filter("candidates", kept)
    rows = rows.withColumn("other", added)
    text = lambda k: F.transform(F.array_sort(F.col(k)), lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))
    listed = [text(k) for k in KINDS]
    return rows.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in (*KINDS, "other")),
        F.array_join(F.concat(*listed), ",").alias("base_spans"), F.array_join(F.concat(*listed, text("other")), ",").alias("spans"),
    )


def report(docs: DataFrame) -> DataFrame:
    """scan(), with the digest of the fixed spans in place of their list."""
    return scan(docs).withColumn("base_sha256", F.sha2("base_spans", 256)).drop("base_spans", "n_other")
