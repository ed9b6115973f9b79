"""Operators 11 to 13: whitening against an exact eigen-decomposition, search and sharding against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postura.llm import ranking, shards, whitening

from . import cases

# --- 11


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def exact(rows):
    """Rows that take part as (id, x), their different vectors, eigenvalues and axes by falling eigenvalue."""
    good = [(i, np.floor(256 * np.array(v, np.float64))) for i, v, _ in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    most = Counter(len(v) for _, v in good)
    length = max(most, key=lambda k: (most[k], k))
    good = [(i, v) for i, v in good if len(v) == length]
    fit = np.unique([v for _, v in good], axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(length, length))
    return good, fit, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("dims, count", [(3, 60), (12, 200), (80, 400)])
def test_whitening_equals_eigen_decomposition(spark, dims, count):
    r = np.random.default_rng(dims)
    data = r.standard_normal((count, dims)) * np.linspace(3, 0.5, dims) @ np.linalg.qr(r.standard_normal((dims, dims)))[0]
    rows = [(i, [float(np.float32(e)) for e in v], 0) for i, v in enumerate(data)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(300)]  # one vector under many ids counts once
    rows += [(2000, None, 0), (2001, [None] * dims, 0), (2002, [math.nan] * dims, 0), (2003, [math.inf] + [0.0] * (dims - 1), 0), (2004, [], 0), (2005, [1.0] * (dims + 1), 0), (None, rows[3][1], 0)]
    good, fit, values, axes = exact(rows)
    got = whitening.whitened(vectors(spark, rows).withColumns({c: F.lit("other") for c in ("x", "n", "at", "component")}).repartition(5)).collect()
    comps = min(4, dims)
    assert Counter(g.vec_id for g in got) == Counter({i: comps * k for i, k in Counter(i for i, _ in good).items()})
    n, sums = len(fit), fit.sum(axis=0)
    at = {(g.vec_id, g.component): g for g in got}
    for c in range(comps):
        want = {i: (v - sums / n) @ axes[:, c] / math.sqrt(values[c]) for i, v in good}
        sign = 1 if sum(at[i, c + 1].whitened * w for i, w in want.items()) > 0 else -1
        assert max(abs(sign * at[i, c + 1].whitened - w) for i, w in want.items()) < 1e-7
        assert all(abs(g.explained / (values[c] / values.sum()) - 1) < 1e-9 for g in got if g.component == c + 1)
    assert all(at[i, 1].deviation == int(((n * v.astype(int) - sums.astype(int)) ** 2).sum()) for i, v in good)
    assert {g.n for g in got} == {n} and len({g.identity_error for g in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_of_little_or_nothing(spark):
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, None, 0), (2, [], 0)])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).count() == 0  # no variance
    line = whitening.whitened(vectors(spark, [(i, [float(i), 1.0, -2.0 * i], 0) for i in range(9)])).collect()  # along one axis
    assert len(line) == 9 and {g.component for g in line} == {1} and abs(line[0].explained - 1) < 1e-12


def test_passes_send_blocks_not_rows(spark):
    """What comes to the driver is as wide as the block and as long as a vector, whatever the number of rows."""
    x = spark.range(3000).select(F.array(*(F.floor(F.rand(k) * 50) for k in range(6))).alias("x"))
    found = whitening.summed(x, lambda m: m.T @ m[:, :2])
    rows = np.array([r.x for r in x.collect()], float)
    assert np.allclose(found.reshape(6, 2), rows.T @ rows[:, :2], rtol=1e-12)


# --- 12


def term_list(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked_by_hand(docs, items):
    counted = [(i, Counter(ws := term_list(t)), len(ws)) for i, t in docs]
    counted = [x for x in counted if x[2]]
    n_docs, total = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for t, k in df.items()}
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(term_list(t))
    out = set()
    for item, own in queries.items():
        scored = [(sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // total))) for t in own if c[t]), i) for i, c, n in counted]
        best = sorted(((s, i) for s, i in scored if s > 0), key=lambda x: (-x[0], x[1] is not None, x[1] or 0))[:10]
        out |= {(item, k + 1, i, s) for k, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("block, clash", [(4096, False), (16, True)])
def test_search_equals_brute_force(spark, monkeypatch, block, clash):
    monkeypatch.setattr(ranking, "BLOCK", block)
    monkeypatch.setattr(ranking, "GROUP", 3)
    rows = cases.edge_rows() + [(100 + i, cases.prose(i % 40, 5 + 7 * (i % 23)), "en", "s", 1) for i in range(200)]
    items = [(1, cases.prose(1, 30)), (2, "one TWO three"), (2, "hare"), (3, None), (4, "nowhereatall"), (5, "the of and with"), (6, "日本語 ünïcode"), (7, cases.prose(9, 60)), (8, "")]
    got = ranking.ranked(cases.documents(spark, rows, clash), cases.benchmark(spark, items)).collect()
    assert {tuple(r) for r in got} == ranked_by_hand([r[:2] for r in rows], items)


def test_hybrid_never_loses_a_document():
    r = np.random.default_rng(4)
    for trial in range(200):
        size = int(r.integers(1, 3000))
        lists = []
        for _ in range(int(r.integers(0, 9))):
            at = np.flatnonzero(r.random(size) < r.choice([0.002, 0.02, 0.3, 0.9]))
            if len(at):
                lists.append((at, r.integers(0, r.choice([2, 50, 5000]), len(at))))  # with ties and zeros
        sums = np.zeros(size, np.int64)
        for at, adds in lists:
            sums[at] += adds
        want = sorted(((-s, i) for i, s in enumerate(sums) if s > 0))[:10]
        places, scores = ranking.hybrid(lists, size)
        assert [(-s, i) for i, s in zip(places, scores)] == want, trial


def test_search_of_nothing(spark):
    empty = cases.documents(spark, [])
    assert ranking.ranked(empty, cases.benchmark(spark)).count() == 0
    assert ranking.ranked(cases.documents(spark), cases.benchmark(spark, [])).count() == 0


# --- 13


def dealt_by_hand(rows, n_shards=40, seed=13):
    keyed = []
    for i, t, _, source, _ in rows:
        data = (t or "").encode()
        crc = zlib.crc32(data)
        keyed.append((source is not None, source or "", hashlib.md5(f"{seed}:{'' if i is None else i}:{crc}".encode()).hexdigest(), i, len(data) + 16, crc))
    placed = []
    for stratum in {k[:2] for k in keyed}:
        own = sorted((k for k in keyed if k[:2] == stratum), key=lambda k: k[2])
        placed += [((2 * r + 1) / (2 * len(own)), stratum, r, *k[3:]) for r, k in enumerate(own)]
    placed.sort(key=lambda p: p[:3])
    out, first, total = [], {}, len(placed)
    for p, (*_, i, size, crc) in enumerate(placed):
        shard = p * n_shards // total
        out.append((i, size, crc, "rows", shard, p - first.setdefault(shard, p), None))
    return out


@pytest.mark.parametrize("clash", [False, True])
def test_sharding_equals_brute_force(spark, clash):
    rows = cases.edge_rows() + [(100 + i, cases.prose(i % 9, 3 + i % 5), "en", "hot" if i % 3 else f"s{i % 11}", 1) for i in range(333)]
    got = shards.report(cases.documents(spark, rows, clash)).collect()
    assert Counter(map(tuple, got)) == Counter(dealt_by_hand(rows))
    sizes = Counter(r.shard for r in got)
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 1


def test_every_shard_matches_the_mixture(spark):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 == 0 else f"s{i % 5}", 1) for i in range(4000)]
    source = {r[0]: r[3] for r in rows}
    share = Counter(source.values())
    found = {}
    for r in shards.report(cases.documents(spark, rows)).collect():
        found.setdefault(r.shard, Counter())[source[r.doc_id]] += 1
    assert all(abs(c[s] - share[s] / 40) <= 2 for c in found.values() for s in share)


def test_sharding_of_few_and_none(spark):
    assert shards.report(cases.documents(spark, [])).count() == 0
    few = shards.report(cases.documents(spark, [(1, "a", None, None, 1), (1, "a", None, None, 1), (None, None, None, None, None)])).collect()
    assert len(few) == 3 and len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}


def test_written_shards_hold_every_row_in_order(spark, tmp_path):
    rows = cases.edge_rows() + [(100 + i, cases.prose(i, 20), "en", f"s{i % 4}", 1) for i in range(200)]
    docs = cases.documents(spark, rows)
    shards.write(docs, str(tmp_path / "out"), shards=8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(tuple, back.select(docs.columns).collect())) == Counter(map(tuple, rows))
    slots = {}
    for r in back.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8
