"""Operators 5 and 7 and the pipeline against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from postura.llm import neardup, substrings

from . import cases


def near_copies() -> list[tuple]:
    r = random.Random(5)
    rows = []
    for g in range(12):
        base = cases.prose(100 + g, 200).split()
        for k in range(6):
            ws = list(base)
            for _ in range(k * 2):
                ws[r.randrange(len(ws))] = f"new{r.randrange(1000)}"
            rows.append((1000 + g * 10 + k, " ".join(ws), "en", "s", 1))
    # a chain: neighbours are alike, its ends are not
    chain = [f"w{i}" for i in range(300)]
    rows += [(2000 + i, " ".join(chain[i * 8 : i * 8 + 200]), "en", "s", 1) for i in range(12)]
    rows += [(3000 + i, ("again and again the same line\n" * 9) + f"end {i % 3}", "en", "s", 1) for i in range(9)]
    return rows


def expected_classes(rows) -> dict:
    sets = {i: neardup.shingled(t) for i, t, *_ in rows if cases.words(t)}
    parent = {r[0]: r[0] for r in rows}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x].keys() & sets[y].keys() and neardup.alike(sets[x], sets[y]):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    empties = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        if i not in sets:
            parent[i] = empties.setdefault(t or "", i)
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("clash", [False, True])
def test_classes_equal_brute_force(spark, clash):
    rows = [r for r in cases.edge_rows() if r[0] is not None] + near_copies()
    want = expected_classes([*{r[0]: r for r in rows}.values()])
    got = neardup.classes(cases.documents(spark, rows, clash)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == want


def test_no_id_takes_the_class_of_an_equal_text(spark):
    rows = [(None, "one two three four five six", None, None, None), (4, "One two three four five six!", None, None, None), (None, "else", None, None, None)]
    assert sorted(((r.doc_id, r.class_id) for r in neardup.classes(cases.documents(spark, rows)).collect()), key=repr) == [(4, 4), (None, 4), (None, None)]


def test_no_documents(spark):
    assert neardup.classes(cases.documents(spark).limit(0)).count() == 0
    assert substrings.report(cases.documents(spark).limit(0)).count() == 0


def test_signatures_agree_as_the_weighted_jaccard_index():
    r = np.random.default_rng(1)
    agreed, index = [], []
    for shared in (20, 200, 800):
        common, own = r.integers(1, 2**63, shared), [r.integers(1, 2**63, 200) for _ in range(2)]
        for trial in range(40):
            salt = np.uint64(trial * 7919)
            x = [np.concatenate([common, o]).astype(np.uint64) ^ salt for o in own]
            w = [np.concatenate([np.arange(shared) % 3 + 1, np.full(200, 2)]) for _ in range(2)]
            s = neardup.signatures(np.repeat([0, 1], shared + 200), np.concatenate(x), np.concatenate(w), 2)
            agreed.append((s[0] == s[1]).mean())
        low = (np.arange(shared) % 3 + 1).sum()
        index.append(low / (low + 800))
    assert np.allclose(np.array(agreed).reshape(3, -1).mean(axis=1), index, atol=0.03)


def test_every_coordinate_is_filled_whatever_the_size():
    for n in (1, 2, 7, 50, 3000, 60_000):
        x = np.arange(1, n + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        s = neardup.signatures(np.zeros(n, np.int64), x, np.ones(n, np.int64), 1)
        assert (s != 0).all()


def covered(texts: dict) -> dict:
    """(bytes, removed, runs, digest) by looking at every string."""
    data = {k: (t or "").encode() for k, t in texts}
    count = Counter(b[i : i + 400] for b in data.values() for i in range(len(b) - 399))
    out = {}
    for k, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[k] = (len(b), len(b) - len(kept), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), substrings.digest(kept))
    return out


def passages() -> list[tuple]:
    r = random.Random(1)
    p = "".join(r.choice("abcdef ") for _ in range(450))
    rows = [
        (1, None), (2, ""), (3, "x" * 1500), (4, "ab" * 700 + "y"), (5, "z" + p), (6, p[:420] + "é" * 300), (7, p[30:]), (8, "x" * 399), (9, "q" * 400), (10, "dup " * 120), (11, "dup " * 120),
        (12, cases.prose(1, 900)), (13, "new start " + cases.prose(1, 900)[200:3000]), (14, cases.prose(1, 900)[:401]), (15, p[:399]), (16, p[51:] + p[:400]),
    ]
    rows += [(100 + i, f"{i} " * 200 + p + f" {i}" * r.randrange(300)) for i in range(30)]
    return [(i, t, None, None, None) for i, t in rows]


@pytest.mark.parametrize("together", [2_000_000, 3000])
@pytest.mark.parametrize("crowd", [1000, 2])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, together, crowd):
    monkeypatch.setattr(substrings, "TOGETHER", together)
    monkeypatch.setattr(substrings, "CROWD", crowd)
    rows = passages()
    got = {r.doc_id: tuple(r)[1:] for r in substrings.report(cases.documents(spark, rows, clash=together == 3000)).collect()}
    assert got == covered([r[:2] for r in rows])


def test_equal_rows_are_each_others_copies(spark):
    text = cases.prose(9, 200)
    got = substrings.report(cases.documents(spark, [(1, text, None, None, None), (1, text, None, None, None), (None, "short", None, None, None)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", len(text)), ("1", len(text)), ("None", 0)]


def test_collisions_are_found_and_compared_plainly(monkeypatch):
    """With hashes that all collide, the bytes decide."""
    r = random.Random(3)
    a, b, shared, strange = (bytes(r.randrange(97, 123) for _ in range(n)) for n in (700, 700, 450, 440))
    texts = [a + shared, b + shared + a[:100]]

    def contexts():
        out = []
        for rid, t in enumerate(texts):
            at = t.index(shared) + 100
            out.append(substrings.Context(5, rid, at, at - 60, at - 20, 1, t[at - 60 : at - 20 + 400]))
        return out

    want = substrings.repeated([contexts()])
    assert sorted(want) == [(0, 740, 1150), (1, 740, 1150)]
    assert {r[0] for r in substrings.plainly(contexts())} == {0, 1}
    monkeypatch.setattr(substrings.Hashes, "of", lambda self, s, e: np.zeros(len(s), np.uint64))
    other = contexts()
    other[1].data = other[1].data[:10] + strange[:50] + other[1].data[60:]  # differs before the anchor
    assert substrings.repeated([other]) == []


def thue_morse(n: int, flip: bool) -> str:
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_strings_that_defeat_polynomial_hashes(spark):
    """Thue-Morse strings of 512 letters and their complements have equal hashes modulo 2**64 for every base."""
    r = random.Random(6)
    lead = ["".join(r.choice("cdefgh") for _ in range(300)) for _ in range(3)]
    rows = [(i, lead[i % 3] + thue_morse(1024, i % 2 == 1) + lead[(i + 1) % 3], None, None, None) for i in range(6)]
    data = (thue_morse(1024, False) + thue_morse(1024, True)).encode()
    h = substrings.Hashes(np.frombuffer(data, np.uint8), substrings.BASES[0])
    assert h.of(np.array([0, 1024]), np.array([1024, 2048])).tolist()[0] == h.of(np.array([0, 1024]), np.array([1024, 2048])).tolist()[1]
    assert substrings.extension(h, data, 0, 1024, 1024) == 0
    got = {x.doc_id: tuple(x)[1:] for x in substrings.report(cases.documents(spark, rows)).collect()}
    assert got == covered([x[:2] for x in rows])


def test_suffixes_are_sorted_with_their_common_extensions():
    r = random.Random(4)
    contexts = []
    for i in range(40):
        data = bytes(r.choice(b"ab") for _ in range(120))
        contexts.append(substrings.Context(1, i, 10, 0, 0, 1, data))
    data = b"".join(c.data for c in contexts)
    for i, c in enumerate(contexts):
        c.at = i * 120 + 10
    ordered, common = substrings.suffix_sorted(contexts, substrings.Hashes(np.frombuffer(data, np.uint8), substrings.BASES[0]), data)
    suffixes = [c.data[10:] for c in ordered]
    assert suffixes == sorted(suffixes)
    lcp = lambda x, y: next((i for i in range(110) if x[i] != y[i]), 110)
    assert common == [-1, *map(lcp, suffixes, suffixes[1:])]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    long = cases.prose(77, 200, ("the", "and", "with", "reading", "other", "that"))
    item = "wholly unlikely benchmark words stand here in a row for testing only"
    rows = [(i, cases.prose(500 + i, 80, ("the", "and", "with", "reading", "other", "that", "from", "hare")), "en", "s", 5) for i in range(1, 20)]
    rows += [(50, long, "en", "s", len(long)), (51, long + " extra", "en", "s", 9), (52, long, "en", "s", len(long)), (60, None, "en", "s", None), (61, "...", "en", "s", 3)]
    rows += [(70, "the and with " + item + " other that", "en", "s", 1), (80, "the secret with that password=abcdefgh1 and the other reading", "en", "s", 7)]
    cases.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    cases.benchmark(spark, [(1, item)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r.doc_id for r in docs.collect()}
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {r[0] for r in rows}
    assert left["language_id"] == ids - {60, 61}
    assert left["near_dedup"] == left["language_id"] - {51, 52}
    assert left["decontamination"] == left["near_dedup"] - {70}
    assert left["secret_scan"] == left["sentencepiece"] == left["decontamination"]
    blanked = spark.read.parquet(f"{tmp_path}/secret_scan").where("doc_id = 80").first()
    assert "[secret]" in blanked.text and "abcdefgh1" not in blanked.text and blanked.n_chars == len(blanked.text)
    assert docs.where("not round_trip").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left["sentencepiece"]


@pytest.mark.parametrize("index", range(5))
def test_stages_stand_odd_documents(spark, index, tmp_path):
    import corpus_pipeline

    cases.benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, bench = cases.documents(spark, clash=True), str(tmp_path)
    name, stage = corpus_pipeline.STAGES[index]
    got = stage(spark, docs, bench)
    assert got.count() <= docs.count()
    assert stage(spark, docs.limit(0), bench).count() == 0
    if index < 4:
        assert got.columns == docs.columns


def test_rows_of_one_id_or_none_are_told_apart_by_their_texts(spark, tmp_path):
    import corpus_pipeline

    item = "wholly unlikely benchmark words stand here in a row for testing"
    cases.benchmark(spark, [(1, item)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b, c = (cases.prose(800 + i, 60) for i in range(3))
    rows = [(1, a), (1, b), (1, "so " + item), (None, c), (None, c), (None, "but " + item), (None, a), (2, b + " more"), (3, a), (None, None)]
    docs = cases.documents(spark, [(i, t, None, None, None) for i, t in rows])
    stages = dict(corpus_pipeline.STAGES)
    left = stages["near_dedup"](spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(1, a), (1, b), (1, "so " + item), (None, c), (None, "but " + item), (None, None)], key=repr)
    left = stages["decontamination"](spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([x for x in rows if item not in (x[1] or "")], key=repr)


def crowd(seed: int = 8) -> list[tuple]:
    """Copies of one text, few edits to many; some pairs far from it are alike; a pair that differs in repeats only."""
    r = random.Random(seed)
    base, rows, at = cases.prose(700 + seed, 150).split(), [], seed * 10_000
    line = " ".join(base[20:40])
    for k in range(60):
        ws = list(base)
        for _ in range(k % 30):
            ws[r.randrange(len(ws))] = f"z{r.randrange(60)}"
        rows.append((at + k, " ".join(ws) + (" " + line) * (r.randrange(6) if k % 4 == 0 else 0), "en", "s", 1))
    for k in range(8):
        ws = list(base)
        for j in range(0, 150, 12):
            ws[j] = f"far{k}x{j}"
        rows += [(at + 1000 + 10 * k + e, " ".join(ws[: 150 - 3 * e]), "en", "s", 1) for e in range(3)]
    again, rest = f"the same sentence {seed} stands here over and over ", cases.prose(1700 + seed, 120)
    return rows + [(at + 7000, again * 40 + rest, "en", "s", 1), (at + 7001, again * 4 + rest, "en", "s", 1)]


def test_a_crowd_of_near_copies_loses_no_link(spark):
    rows = [r for seed in (1, 2, 3, 4) for r in crowd(seed)]
    got = {r.doc_id: r.class_id for r in neardup.classes(cases.documents(spark, rows)).collect()}
    assert got == plain_classes(rows)
    assert got[17001] == 17000


def plain_classes(rows) -> dict:
    """By comparing all texts, with nothing of the code under test."""
    sets = []
    for _, t, *_ in rows:
        ws = cases.words(t)
        sets.append(Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))))
    name = {r[0]: r[0] for r in rows}
    ids = [r[0] for r in rows]
    for i in range(len(ids)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if len(x.keys() & y.keys()) >= 0.8 * len(x.keys() | y.keys()) or (x & y).total() >= 0.8 * (x | y).total():
                a, b = name[ids[i]], name[ids[j]]
                name = {k: min(a, b) if v in (a, b) else v for k, v in name.items()}
    return name


def set_apart(spark, seed: int, n: int):
    """Rows as apart() and the ranking leave them, at random, many of them under one shingle and of one class."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        most = 40.0
        for e in r.sample(range(6), r.randrange(1, 4)):
            v, vw = r.randrange(2, 160) / 2, r.randrange(2, 160) / 2
            flags = [r.random() < 0.6 for _ in range(4)]
            rows.append((r.randrange(2), e, i, 0 if i % 2 else r.randrange(n), r.randrange(1, 60), r.randrange(1, 60), v, vw, most, *flags))
    return rows, spark.createDataFrame(rows, "c long, e long, rep long, class long, rest long, rest_w long, v double, vw double, most double, is_x boolean, is_y boolean, is_xw boolean, is_yw boolean")


@pytest.mark.parametrize("seed", range(3))
def test_meetings_lose_no_pair(spark, seed):
    rows, df = set_apart(spark, seed, 120)
    want = set()
    for x in rows:
        for y in rows:
            if x[:2] == y[:2] and x[3] != y[3]:
                for rest, v, is_x, is_y in ((4, 6, 9, 10), (5, 7, 11, 12)):
                    if x[is_x] and y[is_y] and min(x[rest], y[rest]) >= (x[v] + y[v] - x[8]) / 1.8 - 1e-6:
                        want.add((max(x[2], y[2]), min(x[2], y[2])))
    assert {(max(p), min(p)) for p in neardup.meeting(df).collect()} == want and want


def test_meetings_compare_a_fraction_of_all_pairs_of_a_shingle(spark):
    from pyspark.sql import functions as F

    rows, df = set_apart(spark, 9, 600)
    df = df.where("rest < 12 and rest_w < 12")  # shared shingles come late in the order, so that little is left behind them
    size = lambda d, keys: d.groupBy(*keys).count()
    plain = size(df, ["c", "e"]).agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    lower, upper = neardup.dealt(df, "")
    compared = size(lower, neardup.MEETING).join(size(upper, neardup.MEETING).withColumnRenamed("count", "n"), neardup.MEETING).agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    assert compared * 5 < plain
