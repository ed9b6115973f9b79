"""Operators 1, 4 and 6 against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postura.llm import decontaminate, fingerprints, privacy

from . import cases


def by_text(rows):
    """Rows of one id may differ in text; compare as sorted lists."""
    return sorted(rows, key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_contamination_equals_brute_force(spark, clash):
    docs, bench = cases.documents(spark, clash=clash), cases.benchmark(spark)
    items = {}
    for i, t in bench.collect():
        ws = cases.words(t)
        for s in range(max(len(ws) - 9, 1) if ws else 0):
            items.setdefault(tuple(ws[s : s + 10]), set()).add(i)
    expected = []
    for row in docs.collect():
        ws = cases.words(row.text)
        hit, found = set(), set()
        for w, owners in items.items():
            for s in range(len(ws) - len(w) + 1):
                if tuple(ws[s : s + len(w)]) == w:
                    hit |= set(range(s, s + len(w)))
                    found |= owners
        names = ",".join(sorted(str(i) for i in found if i is not None))
        expected.append((row.doc_id, len(ws), len(hit), len([i for i in found if i is not None]), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    got = [tuple(r) for r in decontaminate.contamination(docs, bench).drop("n_near", "k").collect()]
    assert by_text(got) == by_text(expected)
    assert any(r[5] for r in got)


def test_proximity_matches_are_found(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = cases.documents(spark, [(1, "x " + item, None, None, None), (2, "beta alpha gamma delta epsilon zeta eta theta y iota kappa", None, None, None), (3, "alpha beta gamma", None, None, None)])
    got = {r.doc_id: (r.contaminated, r.n_near) for r in decontaminate.contamination(docs, cases.benchmark(spark, [(1, item)])).collect()}
    assert got == {1: (True, 0), 2: (False, 1), 3: (False, 0)}


def test_proximity_matches_equal_brute_force(spark):
    r, vocabulary = random.Random(4), [f"t{i}" for i in range(30)]
    texts = {i: [r.choice(vocabulary) for _ in range(r.randrange(400))] for i in range(40)}
    items = [[r.choice(vocabulary) for _ in range(r.randrange(1, 5))] for _ in range(60)] + [["t1", "t1", "t2"], ["t3"] * 3]
    count = Counter(w for ws in texts.values() for w in ws)
    want = {}
    for i, ws in texts.items():
        near = set()
        for t in map(tuple, items):
            if any(tuple(ws[s : s + len(t)]) == t for s in range(len(ws))):
                continue
            rarest = min(t, key=lambda w: (count[w], t.index(w)))
            around = [Counter(ws[max(0, p - len(t) - 4) : p + len(t) + 5]) for p, w in enumerate(ws) if w == rarest]
            if any(all(c[w] >= n for w, n in Counter(t).items()) for c in around):
                near.add(t)
        want[i] = len(near)
    docs = cases.documents(spark, [(i, " ".join(ws), None, None, None) for i, ws in texts.items()])
    got = decontaminate.contamination(docs, cases.benchmark(spark, [(i, " ".join(t)) for i, t in enumerate(items)]))
    assert {x.doc_id: x.n_near for x in got.collect()} == want and sum(want.values()) > 20


def test_postings_are_stored_and_end_their_documents(spark):
    terms = spark.createDataFrame([("b",), ("absent",)], "term string").select(F.xxhash64("term").alias("h"), "term")
    index = decontaminate.indexed(cases.documents(spark, [(1, "a B b", None, None, None), (2, None, None, None, None)]), terms)
    assert sorted((r.doc_id, r.pos) for r in index.collect()) == [(1, 1), (1, 2), (1, 3), (2, 0)]
    assert index.inputFiles()


def test_contamination_of_and_by_nothing(spark):
    docs, bench = cases.documents(spark), cases.benchmark(spark)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated or n_items > 0").count() == 0


def test_tables_beyond_broadcasting_give_the_same(spark, monkeypatch):
    docs, bench = cases.documents(spark), cases.benchmark(spark)
    whole = by_text(tuple(r) for r in decontaminate.contamination(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK", 10)
    assert by_text(tuple(r) for r in decontaminate.contamination(docs, bench).collect()) == whole


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits(v):
    return re.sub("[^0-9]", "", v)


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
}
PII_TEXTS = [
    "a@b.c_d@e.f x@y..z @a.b a@b q@w.e.r", "1.2.3.4.5 999.1.1.1 0001.2.3.4 1.2.3.4.5.6.7.8 255.255.255.256", "4111 1111-1111 1111 4111111111111111 9 12 4111111111111112",
    "+1 (2) 3.4-5678 ++12345678 +1 +1234567 +1234567890123456", "é😀 4111111111111111 😀 a@b.co +44 20 7946 0958",
]


@pytest.mark.parametrize("clash", [False, True])
def test_fixed_patterns_equal_brute_force(spark, clash):
    rows = cases.edge_rows() + [(100 + i, t, None, None, None) for i, t in enumerate(PII_TEXTS)]
    expected = []
    for r in rows:
        spans, n = [], []
        for kind, (pattern, valid) in PII.items():
            found = [m.span() for m in re.finditer(pattern, r[1] or "") if (len(r[1]) < 6000 or kind != "card") and valid(m.group())]
            n.append(len(found))
            spans += [f"{kind}:{a}:{b}" for a, b in found]
        expected.append((r[0], *n, ",".join(spans)))
    got = privacy.scan(cases.documents(spark, rows, clash), ([], float("inf"))).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans")
    assert by_text(map(tuple, got.collect())) == by_text(expected)


def test_boosted_trees_add_what_resembles_the_confirmed(spark):
    texts = [f"write to user{i}.name@mail{i % 9}.example.com or call +1 (918) 555-{1000 + i} today, room {i} of {i * 37 % 1000}" for i in range(200)]
    docs = cases.documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    trees, least = privacy.fitted(docs)
    assert trees and least < float("inf")
    assert privacy.scan(docs, (trees, least)).where("n_email <> 1 or n_phone <> 1").count() == 0


def test_uncovered_formats_are_added_and_numbers_are_not(spark):
    texts = [f"word write to user{i}.name@mail{i % 9}.example.com then +1 (918) 555-{1000 + i} today, room {i} of {i * 37 % 1000}" for i in range(200)]
    personal = {
        1000: ("so call (918) 555-2191 today", "(918) 555-2191"), 1001: ("then jane.doe [at] mail.example.org said", "jane.doe [at] mail.example.org"), 1002: ("my phone: 020 7946 0958 or", "020 7946 0958"),
        1003: ("with account: 4411223344 at", "4411223344"), 1004: ("her ssn 078-05-1120 was", "078-05-1120"), 1005: ("ask jane(at)example.org for", "jane(at)example.org"),
    }
    other = ["on 2024-03-15 we", "in version 10.4.2.1183 of", "for $1299.00 each", "from 1914-1918 there", "some 1250000 people", "a code x12345678y here", "dated 15.03.2024 by", "then 4465758382889438 of"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(i, t, None, None, None) for i, (t, _) in personal.items()] + [(2000 + i, t, None, None, None) for i, t in enumerate(other)]
    got = {r.doc_id: (r.n_other, r.spans) for r in privacy.scan(cases.documents(spark, rows)).collect()}
    for i, (text, value) in personal.items():
        at = text.index(value)
        assert got[i] == (1, f"other:{at}:{at + len(value)}"), (text, got[i])
    assert all(got[2000 + i] == (0, "") for i in range(len(other))), [(t, got[2000 + i]) for i, t in enumerate(other)]
    assert all(got[i][0] == 0 for i in range(200))


def test_trees_learn_from_every_document(spark):
    plain = spark.range(8200).select("id", F.concat(F.lit("nothing to see in room "), "id").alias("text"))
    made = spark.range(10_000, 10_200).select("id", F.concat(F.lit("write to user"), "id", F.lit("@mail.example.com or call +1 (918) 555-"), F.col("id") % 9000 + 1000).alias("text"))
    # an eighth of the personal ones, all of which a sample by the parity of this hash would leave out
    docs = plain.union(made.where(F.pmod(F.xxhash64("text"), F.lit(2)) == 1).where("id % 4 = 0")).withColumnRenamed("id", "doc_id")
    trees, least = privacy.fitted(docs)
    assert trees and least < float("inf")
    one = lambda d: {tuple(r.x): (r.a, r.b) for r in privacy.counted(d).groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}
    once, twice = one(docs), one(docs.union(docs))
    assert once and twice == {x: (2 * a, 2 * b) for x, (a, b) in once.items()}


def test_no_personal_data_in_nothing(spark):
    assert privacy.report(cases.documents(spark).limit(0)).count() == 0


def test_trees_separate_what_features_separate():
    rows = [((x, y), 10 * (x > 1), 10 * (x <= 1)) for x in range(4) for y in range(3)]
    trees = privacy.boosted(rows)
    score = lambda x: sum(privacy.applied(t, x) for t in trees)
    assert min(score((x, y)) for x in (2, 3) for y in range(3)) > max(score((x, y)) for x in (0, 1) for y in range(3))


@pytest.mark.parametrize("clash", [False, True])
def test_fingerprints_equal_brute_force(spark, clash):
    rows = [r for r in cases.edge_rows() if r[0] is not None]
    rows = [*{r[0]: r for r in rows}.values()]
    got = {r.doc_id: r for r in fingerprints.fingerprints(cases.documents(spark, rows, clash)).collect()}
    texts = [r[1] or "" for r in sorted(rows)]
    pieces = lambda t: {x for x in re.split(fingerprints.PARAGRAPH, t) if x}
    jaccard = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(pieces(t), pieces(edited)))
        assert r.near_next == pytest.approx(jaccard(pieces(t), pieces(after)))
    assert got[9].fingerprint == got[10].fingerprint


SCRIPTS = {"latin": (97, 122), "greek": (0x3B1, 0x3C9), "cyrillic": (0x430, 0x44F), "arabic": (0x620, 0x64A), "devanagari": (0x905, 0x939), "hangul": (0xAC00, 0xD7A3), "cjk": (0x4E00, 0x9FA5), "thai": (0xE01, 0xE2E), "hiragana": (0x3041, 0x3096), "rare": (0x20000, 0x2A6D6)}


def one_line(script: str, spaced: bool, n: int = 6000) -> str:
    r = random.Random(script)
    letters = "".join(chr(r.randint(*SCRIPTS[script])) for _ in range(n))
    return " ".join(letters[i : i + 6] for i in range(0, n, 6)) if spaced else letters


def test_paragraphs_end_where_the_plain_rule_says(spark):
    """The rule written out with ranges and in its plain order; no set of Latin letters has a range, and no text has its pattern compiled anew."""
    ends, begins = fingerprints.striped(r"adhlptxADHLPTX0-2.!?)\xe0-\xe3\xe8-\xeb", 0), fingerprints.striped(r"bcfmsBCFMS3-5\xc0-\xcc\xe4-\xe7\xec-\xef", 2)
    behind = f"(?:(?<={ends[0][1]})|(?<=[^\x00-\xff])(?:" + "|".join(f"(?<={cheap})(?<={one})" for cheap, one in ends[1:]) + "))"
    ahead = f"(?:{begins[0][1]}|(?=[^\x00-\xff])(?:" + "|".join(f"(?={cheap}){one}" for cheap, one in begins[1:]) + "))"
    plain = rf"[\t-\r\x20]*\n[\t-\r\x20]*|(?=[\t-\r\x20]){behind}[\t-\r\x20]+(?={ahead})|{behind}(?={ahead}{{2}})(?<=[!-퟿]{{24}})"
    r = random.Random(5)
    some = [chr(x) for x in (*range(9, 14), *range(32, 256), *range(0x3B1, 0x3C9), *range(0x430, 0x450), *range(0x4E00, 0x4E80), 0xFFFE, 0xFFFF, 0x20000, 0x21000, 0x21400)]
    texts = ["".join(r.choices(some, k=400)) for _ in range(60)] + ["".join(r.choices("adhbcf \n", k=400)) for _ in range(20)] + [fingerprints.CUT * 3, "\n\n", " \n a", ""]
    texts += ["".join(r.choices(some[24 + 32 :], k=400)) for _ in range(40)] + [one_line(s, spaced, 600) for s in SCRIPTS for spaced in (True, False)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    pieces = F.array_except(F.transform(F.split("text", plain), lambda p: F.xxhash64(p)), F.array(F.xxhash64(F.lit(""))))
    made = df.select("i", pieces.alias("a"), fingerprints.digests(F.col("text")).alias("b"))
    assert made.where("a <> b").count() == 0 and made.agg(F.sum(F.size("a"))).first()[0] > 1000
    assert not re.search(r".-.", fingerprints.ENDS[0][1] + fingerprints.BEGINS[0][1])
    assert "regexp_replace" in str(fingerprints.digests(F.col("text")))


def test_long_lines_of_every_script_keep_their_likeness(spark):
    cases_ = [(s, spaced) for s in SCRIPTS for spaced in (True, False) if (s, spaced) != ("rare", False)]
    rows = [(i, one_line(*c), None, None, None) for i, c in enumerate(cases_)]
    pieces = lambda t: {x for x in re.split(fingerprints.PARAGRAPH, t) if x}
    for r in fingerprints.fingerprints(cases.documents(spark, rows)).collect():
        t, after = rows[r.doc_id][1], rows[(r.doc_id + 1) % len(rows)][1]
        a, b = pieces(t), pieces(t[: len(t) - len(t) // 4] + after[: len(t) // 4])
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b)), cases_[r.doc_id]
        assert len(a) >= 20 and r.near_edited > 0.4, (cases_[r.doc_id], len(a), r.near_edited)


def test_fingerprints_of_ties_nulls_one_and_none(spark):
    docs = cases.documents(spark)
    assert fingerprints.fingerprints(docs).count() == docs.count()
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0
    (one,) = fingerprints.fingerprints(cases.documents(spark, [(7, "abcdefgh", None, None, None)])).collect()
    assert (one.near_next, one.edited_sha256) == (1.0, hashlib.sha256(b"abcdefab").hexdigest())


def test_ranges_join_up_at_their_borders(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 3)
    rows = [(i * i, f"text {i}", None, None, None) for i in range(40)]
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(cases.documents(spark, rows)).collect()}
    assert got == {i * i: f"text {(i + 1) % 40}" for i in range(40)}


def test_peeling_recovers_differences_at_every_size(spark):
    for n in (0, 1, 5, 30, 200, 900):
        df = spark.range(1).select(
            F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: F.xxhash64(x)).alias("a"),
            F.transform(F.sequence(F.lit(1 + n), F.lit(1000 + n)), lambda x: F.xxhash64(x)).alias("b"),
        )
        r = df.select(fingerprints.recovered(F.col("a"), F.col("b"), fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))).alias("r"), "a", "b").select(
            F.size(F.array_except(F.array_except("a", "b"), "r.more")).alias("x"), F.size("r.more").alias("m"), F.size("r.fewer").alias("f"), "r.ok"
        ).first()
        assert (r.x, r.m, r.f, r.ok) == (0, n, n, True)
