"""The posture graph against plain search, and the rules for paths, bindings and edges."""

import random

import pytest

from postura.operators import evidence, graph, network

FUNCTION = "function_id string, component string, path string, name string, entry_kind string"
WEIGHT = {"http-route": 1.0, "listener": 1.0, "library-export": 0.6, "main": 0.3}


def queue_search(kinds, edges):
    """Parents by a queue: entry points by weight and id, then callees by id."""
    callees = {}
    for a, b in sorted(edges):
        if a != b:
            callees.setdefault(a, []).append(b)
    queue = sorted((f for f, k in kinds.items() if k), key=lambda f: (-WEIGHT[kinds[f]], f))
    found = {f: (0, f, None) for f in queue}
    for f in queue:
        for g in callees.get(f, []):
            if g not in found:
                found[g] = (found[f][0] + 1, found[f][1], f)
                queue.append(g)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_parents_and_paths_equal_a_queue(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "APART", 2)  # levels are written together too
    r = random.Random(seed)
    names = [f"f{i:02}" for i in range(30)]
    kinds = {n: r.choice([*WEIGHT, None, None, None, None]) for n in names}
    edges = {(r.choice(names), r.choice(names)) for _ in range(45)}
    functions = spark.createDataFrame([(n, "c", "p", n.upper(), k) for n, k in kinds.items()], FUNCTION)
    reach = graph.reached(functions, spark.createDataFrame(list(edges), "caller string, target string"))
    want = queue_search(kinds, edges)
    assert {x.function_id: (x.depth, x.entry, x.parent) for x in reach.collect()} == want

    def path(f):
        return (path(want[f][2]) + " → " if want[f][2] else "") + f.upper()

    assert {x.function_id: x.path for x in graph.paths(reach, functions).collect()} == {f: path(f) for f in want}


def test_long_paths_keep_their_end(spark):
    ids = [f"g{i:03}" for i in range(140)]
    functions = spark.createDataFrame([(f, "c", "p", f, "main" if i == 0 else None) for i, f in enumerate(ids)], FUNCTION)
    reach = spark.createDataFrame([(f, i, 0.3, ids[0], ids[i - 1] if i else None) for i, f in enumerate(ids)], "function_id string, depth int, entry_weight double, entry string, parent string")
    got = {x.function_id: x.path for x in graph.paths(reach, functions).collect()}
    for i, f in enumerate(ids):
        known = ids[max(0, i - 64) : i + 1]
        assert got[f] == ("… → " if len(known) > 64 else "") + " → ".join(known), i


def test_handlers_are_found_by_file_then_by_component(spark):
    rows = [("a", "c", "f", "go", None), ("b", "c", "g", "go", None), ("m", "c", "g", "main", "main")] + [(f"r{i}", "c", f"h{i}", "run", None) for i in range(9)]
    functions = spark.createDataFrame(rows, FUNCTION)
    bindings = spark.createDataFrame(
        [("c", "f", "go", "http-route", "GET /a"), ("c", "zz", "go", "library-export", "both"), ("c", "zz", "run", "http-route", "too many"), ("c", "g", "main", "http-route", "POST /m"), ("d", "f", "go", "main", "other component")],
        "component string, path string, handler string, entry_kind string, detail string",
    )
    got = {tuple(x) for x in graph.entries(functions, bindings).collect()}
    assert got == {("a", "http-route", "GET /a"), ("b", "library-export", "both"), ("m", "http-route", "POST /m")}
    assert [x.function_id for x in graph.in_order(graph.entries(functions, bindings)).orderBy("position").collect()] == ["a", "m", "b"]
    assert {tuple(x) for x in graph.entries(functions).collect()} == {("m", "main", "main")}


def test_calls_meet_their_own_candidates_only(spark, capsys):
    rows = [(f"{f}{n}", "c", f"p{f}", n, None) for f in range(9) for n in ("go", "run")] + [("x", "c", "p0", "far", None), ("y", "d", "p0", "run", None)]
    functions = spark.createDataFrame(rows, FUNCTION)
    calls = [("0go", "c", "p0", "run"), ("0go", "c", "p0", "far"), ("1go", "c", "p1", "far"), ("x", "c", "p9", "run"), ("y", "d", "p1", "run"), ("y", "d", "p1", "go")]
    edges = graph.resolved_calls(spark.createDataFrame(calls, "caller string, component string, path string, callee string"), functions)
    assert {tuple(e) for e in edges.collect()} == {("0go", "0run"), ("0go", "x"), ("1go", "x"), ("y", "y")}
    edges.explain("formatted")
    met = [line for line in capsys.readouterr().out.splitlines() if line.startswith("Join condition")]
    assert met and all(line.endswith(": None") for line in met)  # no pairs are made to be thrown away


def test_reasons(spark):
    exposed = spark.createDataFrame([("x", "f", "e"), ("y", None, None), ("z", None, None), ("w", None, None), ("v", None, None)], "asset_id string, function_id string, entry string")
    paths = spark.createDataFrame([("f", "e → f")], "function_id string, path string")
    entries = spark.createDataFrame([("e", "http-route", "GET /")], "function_id string, entry_kind string, detail string")
    places = spark.createDataFrame([("y", "c", "config", "etc/n.conf"), ("z", "c", "certificate", "etc/tls.pem"), ("v", "c", "source", "etc/n.conf")], "asset_id string, component string, surface string, path string")
    listeners = spark.createDataFrame([(2, "c", "etc/n.conf", "tls.pem"), (7, "c", "etc/n.conf", "tls.pem")], "listener_id long, component string, path string, served string")
    wire = spark.createDataFrame([("w", "pay.example", "cap.pcap"), ("x", "h", "p")], "asset_id string, token string, at string")
    got = {r.asset_id: r.exposure_reason for r in graph.reasons(exposed, paths, entries, evidence.serving(places, listeners), wire).collect()}
    assert got == {
        "x": "reachable from HTTP route `GET /` via e → f", "y": "configured on a TLS listener (2) at etc/n.conf", "z": "presented by the TLS listener (2) configured at etc/n.conf, which references `tls.pem`",
        "w": "negotiated in live traffic with `pay.example` (cap.pcap)", "v": graph.UNREACHED,
    }


def test_no_edge_without_both_ends(spark):
    assets = spark.createDataFrame([("x", "c", "aes", "payment"), ("y", "d", "rsa", "unclassified")], "asset_id string, component string, alg_id string, data_class string")
    functions = spark.createDataFrame([("f", "c", "p", "f", "main"), ("g", "c", "p", "g", None)], FUNCTION)
    libraries = spark.createDataFrame([("e", "openssl", "3.5"), ("e", "openssl", None), ("e", "openssl", None)], "component string, name string, version string")
    entries = graph.entries(functions)
    calls = spark.createDataFrame([("f", "g"), ("g", "g")], "caller string, target string")
    uses = spark.createDataFrame([("g", "x"), ("gone", "x"), ("g", "gone")], "function_id string, asset_id string")
    links = spark.createDataFrame([("x", "y"), ("x", "gone"), ("gone", "y")], "asset_id string, depends_on string")
    edges = network.edges(assets, functions, entries, libraries, calls, uses, links)
    nodes = network.nodes(assets, functions, entries, libraries)
    found = {(e.kind, e.source, e.target) for e in edges.collect()}
    assert {k for k, *_ in found} == {"contains", "exposes", "calls", "uses", "protects", "depends-on", "links"}
    assert {e[1:] for e in found if e[0] in ("calls", "uses", "depends-on", "exposes", "links")} == {("f", "g"), ("g", "x"), ("x", "y"), ("entry/f", "f"), ("component/e", "library/e/openssl/3.5"), ("component/e", "library/e/openssl/unknown")}
    assert network.dangling(nodes, edges).count() == 0 and nodes.count() == nodes.select("id").distinct().count() == 12
    assert network.dangling(nodes.where("id <> 'g'"), edges).count() == 3

    near = {(r.node, r.side, r.depth) for r in network.lineage(assets.where("asset_id = 'x'"), edges).collect()}
    assert {n for n in near if n[1] == "up"} == {("g", "up", 1), ("f", "up", 2), ("entry/f", "up", 3)}
    assert {n[0].split("/")[0] for n in near if n[1] == "down"} == {"y", "data"} and max(n[2] for n in near) == 3
