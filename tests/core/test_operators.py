"""Facts that the operators have to reproduce."""

import random

import pytest
from pyspark.sql import functions as F

from postura.operators import advise, assess, classify, compare, graph, normalize
from postura.policy import Policy


def test_policy_is_checked_as_a_whole():
    assert Policy.from_toml("assessment_year = 2027").assessment_year == 2027
    for text in ("negotiation = 14", "latest_year = 2029", "wave_due = [2028, 2027]", "unheard_of = 1", "lifetime_cap = 0.0"):
        with pytest.raises(ValueError):
            Policy.from_toml(text)


@pytest.mark.parametrize("name, tokens", [("encryptCardNumber", "encrypt card number"), ("card_number", "card number"), ("HTTPServer", "http server"), ("services/payments/api.py", "services payments api py"), ("aes256Key", "aes 256 key"), ("", "")])
def test_tokenize(spark, name, tokens):
    got = spark.createDataFrame([(name,)], "n string").select(F.array_join(classify.tokenize(F.col("n")), " ")).first()[0]
    assert got == tokens


def assets(spark, rows):
    cols = ["asset_id", *normalize.IDENTITY]
    return spark.createDataFrame([(i, "c", "aes", *r) for i, r in enumerate(rows)], "asset_id string, component string, alg_id string, primitive string, key_bits int, parameter_set string, curve string, mode string, digest string").select(*cols)


def test_one_concrete_variant_folds_two_do_not(spark):
    bare, two = (None,) * 6, (None, 256, None, None, None, None)
    chain = assets(spark, [bare, two, (None, 256, None, None, "gcm", None)])
    assert {tuple(r) for r in normalize.refinements(chain).collect()} == {("0", "2"), ("1", "2")}
    fork = assets(spark, [bare, two, (None, 128, None, None, None, None)])
    assert normalize.refinements(fork).count() == 0


def test_equal_parameters_do_not_refine(spark):
    same = assets(spark, [(None, 256, None, None, None, None), ("block-cipher", 256, None, None, None, None)])
    assert normalize.refinements(same).count() == 0


def bfs(edges, entries):
    """Depth and owner by plain search: least depth, then the heaviest and least entry."""
    depth = {f: (0, -w, f) for f, w in entries.items()}
    frontier = set(entries)
    level = 0
    while frontier:
        level += 1
        found = {}
        for a, b in edges:
            if a in frontier and b not in depth and a != b:
                best = (level, *depth[a][1:])
                found[b] = min(found.get(b, best), best)
        depth |= found
        frontier = set(found)
    return {k: (v[0], v[2]) for k, v in depth.items()}


@pytest.mark.parametrize("seed", range(2))
def test_reach_equals_plain_search(spark, seed):
    r = random.Random(seed)
    names = [f"f{i:02}" for i in range(25)]
    kinds = {n: r.choice(["http-route", "main", None, None, None]) for n in names}
    edges = {(r.choice(names), r.choice(names)) for _ in range(40)}
    functions = spark.createDataFrame([(n, k) for n, k in kinds.items()], "function_id string, entry_kind string")
    got = graph.reached(functions, spark.createDataFrame(list(edges), "caller string, target string"))
    want = bfs(edges, {n: {"http-route": 1.0, "main": 0.3}[k] for n, k in kinds.items() if k})
    assert {x.function_id: (x.depth, x.entry) for x in got.collect()} == want


def test_names_of_too_many_functions_stay_unresolved(spark):
    functions = spark.createDataFrame([(f"c::f{i}::run", "c", f"f{i}", "run", None) for i in range(9)] + [("c::f0::go", "c", "f0", "go", None)], "function_id string, component string, path string, name string, entry_kind string")
    calls = spark.createDataFrame([("c::f0::go", "c", "f0", "run"), ("c::f1::run", "c", "f1", "go"), ("c::f2::run", "c", "zz", "run"), ("nobody", "c", "f0", "run")], "caller string, component string, path string, callee string")
    assert {tuple(r) for r in graph.resolved_calls(calls, functions).collect()} == {("c::f0::go", "c::f0::run"), ("c::f1::run", "c::f0::go")}


def test_plan_keeps_empty_waves_and_running_totals(spark):
    items = spark.createDataFrame([(1, 23.0), (1, 23.0), (2, 92.0), (3, 46.0), (4, 10.0)], "wave int, effort double")
    got = [tuple(r) for r in advise.plan(items, Policy(assessment_year=2026)).orderBy("wave").select("items", "cumulative", "engineers_needed", "overdue").collect()]
    assert got == [(2, 46.0, 0.5, False), (1, 138.0, 1.0, False), (1, 184.0, 1.0, False), (1, 194.0, None, False)]
    assert [r.items for r in advise.plan(items.limit(0)).orderBy("wave").collect()] == [0, 0, 0, 0]
    late = advise.plan(items, Policy(assessment_year=2028)).orderBy("wave").first()
    assert late.overdue and late.weeks_available is None


def test_changes(spark):
    t = "asset_id string, component string, tier string"
    old = spark.createDataFrame([("a", "c", "low"), ("b", "c", "high"), ("d", "c", "high"), ("e", "c", None)], t)
    new = spark.createDataFrame([("a", "c", "high"), ("b", "c", "low"), ("d", "c", "high"), ("e", "c", "info"), ("f", "c", "critical")], t)
    changes = compare.compare(old, new)
    assert {(r.asset_id, r.change, r.regression) for r in changes.collect()} == {("a", "worsened", True), ("b", "improved", False), ("e", "worsened", False), ("f", "added", True)}
    assert [r.asset_id for r in compare.ordered(changes).collect()] == ["f", "a", "b", "e"]
    assert not compare.gate(changes).first().passes and compare.gate(changes.limit(0)).first().passes


@pytest.mark.parametrize("bits, strength", [(512, 0), (1024, 80), (2048, 112), (3072, 128), (7680, 192), (15360, 256), (None, None)])
def test_factoring_strength(spark, bits, strength):
    assert spark.createDataFrame([(bits,)], "b int").select(assess.factoring_strength(F.col("b"))).first()[0] == strength
