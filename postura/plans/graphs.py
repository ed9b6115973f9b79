"""Queries of the posture graph: entry points, paths and reasons, nodes and edges, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from postura import estate
from postura.operators import evidence, graph, network, normalize
from postura.plans import registry, sql
from postura.plans.registry import EXPOSED, GRAPH, LIGHT, LINKS, exposed, graph_sql, query
from postura.storage import written

# registrations of handlers by name, from the suppliers
BINDING = {
    "component": "n_name", "path": "concat('svc', CAST(s_suppkey AS STRING), '/f', CAST(s_suppkey % 50 AS STRING))", "handler": "concat('fn', CAST(s_suppkey % 4 AS STRING))",
    "entry_kind": estate.pick("http-route,library-export,main", "(s_suppkey % 3)"), "detail": "concat('POST /p', CAST(s_suppkey % 20 AS STRING))",
}


def bindings(spark, d):
    rows = estate.read(spark, d, "supplier").join(estate.read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(*(F.expr(e).alias(c) for c, e in BINDING.items()))


BOUND = f""",
bi AS (SELECT {', '.join(f'{e} AS {c}' for c, e in BINDING.items())} FROM supplier JOIN nation ON s_nationkey = n_nationkey),
bn AS (SELECT bi.*, f.n IS NOT NULL AS in_file, coalesce(f.n, p.n) AS n FROM bi LEFT JOIN infile f ON bi.component = f.component AND bi.path = f.path AND bi.handler = f.name LEFT JOIN incomp p ON bi.component = p.component AND bi.handler = p.name),
bt AS (SELECT t.function_id, b.entry_kind, b.detail, 1 AS bound FROM bn b JOIN fns t ON b.component = t.component AND b.handler = t.name AND (NOT in_file OR b.path = t.path) WHERE b.n BETWEEN 1 AND 8),
en AS (SELECT *, CASE entry_kind WHEN 'library-export' THEN 0.6 WHEN 'main' THEN 0.3 ELSE 1.0 END::DOUBLE AS w FROM (SELECT function_id, entry_kind, name AS detail, 0 AS bound FROM fns WHERE entry_kind IS NOT NULL UNION ALL SELECT * FROM bt)
  QUALIFY row_number() OVER (PARTITION BY function_id ORDER BY w DESC, bound, entry_kind, detail) = 1)"""


@query(graph_sql(BOUND + " SELECT DISTINCT function_id, entry_kind, detail FROM bt"))
def handler_binding(spark, d):
    """The functions that registered handler names stand for, by file, else by component."""
    functions = estate.functions(spark, d)
    names = bindings(spark, d).withColumnRenamed("handler", "name")
    return graph.targets(graph.named(names, functions), functions).select(F.col("target").alias("function_id"), "entry_kind", "detail").distinct()


@query(graph_sql(BOUND + " SELECT function_id, entry_kind, detail, w AS entry_weight, CAST(row_number() OVER (ORDER BY w DESC, function_id) - 1 AS BIGINT) AS position FROM en"))
def entry_order(spark, d):
    return graph.in_order(graph.entries(estate.functions(spark, d), bindings(spark, d)))


# the first caller of a level is the one with the least sequence of functions from its entry point on
TREE = f""", tree(function_id, key, names, entry, depth) AS (SELECT function_id, [{LIGHT.format('entry_kind')} || function_id], [name], function_id, 0 FROM fns WHERE entry_kind IS NOT NULL
  UNION ALL SELECT h.target, min(t.key || [h.target]), arg_min(t.names || [f.name], t.key || [h.target]), arg_min(t.entry, t.key || [h.target]), t.depth + 1
  FROM tree t JOIN hops h ON t.function_id = h.caller JOIN d ON d.function_id = h.target AND d.depth = t.depth + 1 JOIN fns f ON f.function_id = h.target GROUP BY h.target, t.depth),
path AS (SELECT function_id, CASE WHEN len(names) > 64 THEN '… → ' ELSE '' END || array_to_string(names[-65:], ' → ') AS path FROM tree),
serves AS (SELECT asset_id, arg_min(s, s) AS s FROM (
  SELECT asset_id, {{'turn': 0, 'l': listener_id, 'file': NULL::VARCHAR, 'at': li.path}} AS s FROM occ JOIN li ON occ.path = li.path WHERE surface IN ('config', 'cloud')
  UNION ALL SELECT asset_id, {{'turn': 1, 'l': listener_id, 'file': served, 'at': li.path}} FROM occ JOIN li ON occ.component = li.component AND string_split(occ.path, '/')[-1] = li.served) GROUP BY 1),
wire AS (SELECT asset_id, min(path) AS at, min(alg_id) AS token FROM occ WHERE surface = 'runtime' GROUP BY 1),
why AS (SELECT ex.asset_id, path.path, CASE WHEN path.path IS NOT NULL THEN 'reachable from ' || CASE e.entry_kind WHEN 'http-route' THEN 'HTTP route' WHEN 'listener' THEN 'TLS listener' WHEN 'main' THEN 'process entry' ELSE 'library export' END || ' `' || e.name || '` via ' || path.path
  WHEN s.turn = 0 THEN 'configured on a TLS listener (' || s.l || ') at ' || s.at WHEN s.turn = 1 THEN 'presented by the TLS listener (' || s.l || ') configured at ' || s.at || ', which references `' || s.file || '`'
  WHEN token IS NOT NULL THEN 'negotiated in live traffic with `' || token || '` (' || wire.at || ')' ELSE 'no detected entry point reaches it; policy default exposure applies (not assumed dead)' END AS exposure_reason
  FROM ex LEFT JOIN path ON ex.function_id = path.function_id LEFT JOIN fns e ON ex.entry = e.function_id LEFT JOIN serves ON ex.asset_id = serves.asset_id LEFT JOIN wire ON ex.asset_id = wire.asset_id)"""


@query("WITH RECURSIVE " + ",\n".join([sql.CATALOGUE, sql.OBS, sql.OCC, GRAPH]) + EXPOSED + TREE + " SELECT asset_id, path, exposure_reason FROM why")
def exposure_path(spark, d):
    """The functions from the entry point to the best reached use of every asset, and why it is exposed."""
    functions, calls = estate.call_graph(spark, d)
    reach = graph.reached(functions, graph.resolved_calls(calls, functions))
    rows = registry.places(spark, d)
    served = evidence.serving(rows.select("asset_id", "component", "surface", "path").distinct(), estate.listeners(spark, d))
    wire = rows.where("surface = 'runtime'").groupBy("asset_id").agg(F.min("path").alias("at"), F.min("alg_id").alias("token"))
    found = graph.exposure(rows, reach, served.select("asset_id", F.col("listener").alias("listener_id")))
    return graph.reasons(found, graph.paths(reach, functions), graph.entries(functions), served, wire)


@query(graph_sql(registry.REACH + """ SELECT (SELECT count(*) FROM fns) AS functions, (SELECT count(*) FROM fns WHERE entry_kind IS NOT NULL) AS entry_points, (SELECT count(*) FROM res WHERE n BETWEEN 1 AND 8) AS calls_resolved,
(SELECT count(*) FROM res WHERE coalesce(n, 0) NOT BETWEEN 1 AND 8) AS calls_unresolved, (SELECT count(*) FROM d) AS reachable_functions""", recursive=True))
def graph_totals(spark, d):
    functions, calls = estate.call_graph(spark, d)
    calls = written(calls, "calls")
    known = calls.join(functions.select(F.col("function_id").alias("caller")), "caller", "left_semi")
    resolved = written(graph.resolution(calls, functions), "resolved")
    reach = graph.reached(functions, graph.targets(resolved, functions).select("caller", "target").distinct())
    one = lambda df, c: df.agg(F.count("*").alias(c))  # noqa: E731  one row each
    rows = one(functions, "functions").crossJoin(one(functions.where("entry_kind IS NOT NULL"), "entry_points")).crossJoin(one(resolved, "calls_resolved"))
    rows = rows.crossJoin(one(known, "known")).crossJoin(one(reach, "reachable_functions"))
    return rows.select("functions", "entry_points", "calls_resolved", (F.col("known") - F.col("calls_resolved")).alias("calls_unresolved"), "reachable_functions")


@query("WITH RECURSIVE " + ",\n".join([sql.CATALOGUE, sql.OBS, sql.OCC, GRAPH]) + EXPOSED + " SELECT reachable, count(*) AS assets FROM ex GROUP BY 1")
def reachable_assets(spark, d):
    return exposed(spark, d).groupBy("reachable").agg(F.count("*").alias("assets"))


# --- nodes and edges

DATA_ID = "'data/' || data_class || '/' || substr(sha256(data_class || '|' || asset_id), 1, 16)"
LIBRARY_ID = "'library/' || component || '/' || name || '/' || version"
NETWORK = f""",
nodes AS (SELECT DISTINCT 'component/' || component AS id, 'component' AS type, component AS label FROM (SELECT component FROM classified UNION SELECT component FROM fns UNION SELECT component FROM libs)
  UNION SELECT 'entry/' || function_id, 'entry', entry_kind FROM fns WHERE entry_kind IS NOT NULL UNION SELECT function_id, 'function', name FROM fns UNION SELECT asset_id, 'crypto', alg_id FROM classified
  UNION SELECT {DATA_ID}, 'data', data_class FROM classified UNION SELECT {LIBRARY_ID}, 'library', name FROM libs),
net AS (SELECT 'component/' || component AS source, function_id AS target, 'contains' AS kind FROM fns UNION SELECT 'component/' || component, asset_id, 'contains' FROM classified
  UNION SELECT 'entry/' || function_id, function_id, 'exposes' FROM fns WHERE entry_kind IS NOT NULL UNION SELECT caller, target, 'calls' FROM edges WHERE caller <> target
  UNION SELECT function_id, asset_id, 'uses' FROM occ WHERE function_id IS NOT NULL UNION SELECT asset_id, {DATA_ID}, 'protects' FROM classified
  UNION SELECT asset_id, depends_on, 'depends-on' FROM links WHERE depends_on IN (SELECT asset_id FROM classified) UNION SELECT 'component/' || component, {LIBRARY_ID}, 'links' FROM libs)"""


# the digests that algorithms depend on are assets too
DEPENDENCY = {"alg_id": "digest", "rule_id": "rule_id || '#dependency'"} | {c: "NULL" for c in ("primitive", *sql.PARAMS)}
COLUMNS = ["alg_id", *estate.OBSERVATION]
EXPANDED = sql.OBS.replace("obs AS (", "obs0 AS (", 1) + f""",
obs AS (SELECT {', '.join(COLUMNS)} FROM obs0 UNION ALL SELECT {', '.join(DEPENDENCY.get(c, c) for c in COLUMNS)} FROM obs0 JOIN (SELECT alg_id, alg_primitive FROM catalogue) USING (alg_id) WHERE {registry.DERIVED})"""


def network_sql(select: str, recursive: bool = False) -> str:
    head = sql.query("", sql.CLASSIFIED).rstrip().replace(sql.OBS, EXPANDED) + ",\n" + sql.LIB + ",\n" + LINKS + ",\n" + GRAPH.replace("FROM obs ", "FROM obs0 ") + NETWORK + select
    return head.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else head


def parts(spark, d) -> dict:
    functions, calls = estate.call_graph(spark, d)
    catalogue = estate.catalogue(spark)
    assets, found = registry.kinds(normalize.expand_dependencies(estate.observations(spark, d), catalogue))
    return {
        "assets": assets, "functions": functions, "entries": graph.entries(functions), "libraries": estate.libraries(spark, d), "calls": graph.resolved_calls(calls, functions),
        "uses": found.where("function_id IS NOT NULL").select("function_id", "asset_id"), "links": normalize.dependency_links(assets, catalogue),
    }


def network_nodes(p: dict):
    return network.nodes(p["assets"], p["functions"], p["entries"], p["libraries"])


@query(network_sql(" SELECT id, type, label FROM nodes"))
def graph_nodes(spark, d):
    return network_nodes(parts(spark, d))


@query(network_sql(" SELECT source, target, kind FROM net"))
def graph_network(spark, d):
    """All seven kinds of edges."""
    return network.edges(**parts(spark, d))


@query(network_sql(" SELECT kind, count(*) AS edges, count(*) FILTER (source NOT IN (SELECT id FROM nodes) OR target NOT IN (SELECT id FROM nodes)) AS dangling FROM net GROUP BY 1"))
def graph_integrity(spark, d):
    """Edges by kind, and how many of them lack an end: none should."""
    p = parts(spark, d)
    edges = written(network.edges(**p), "edges")
    lost = network.dangling(network_nodes(p), edges).groupBy("kind").agg(F.count("*").alias("dangling"))
    return edges.groupBy("kind").agg(F.count("*").alias("edges")).join(lost, "kind", "left").select("kind", "edges", F.coalesce("dangling", F.lit(0)).cast("long").alias("dangling"))


@query(network_sql(""", up(asset_id, node, depth) AS (SELECT asset_id, asset_id, 0 FROM classified UNION SELECT asset_id, source, depth + 1 FROM up JOIN net ON target = node WHERE kind IN ('exposes', 'calls', 'uses') AND depth < 3),
down(asset_id, node, depth) AS (SELECT asset_id, asset_id, 0 FROM classified UNION SELECT asset_id, target, depth + 1 FROM down JOIN net ON source = node WHERE kind IN ('depends-on', 'protects') AND depth < 3)
SELECT asset_id, node, side, CAST(min(depth) AS INT) AS depth FROM (SELECT *, 'up' AS side FROM up UNION ALL SELECT *, 'down' FROM down) GROUP BY ALL HAVING min(depth) > 0""", recursive=True))
def asset_lineage(spark, d):
    """What leads to each asset, and what it depends on and protects, within three edges; all assets are searched at once."""
    p = parts(spark, d)
    return network.lineage(p["assets"], written(network.edges(**p).where(F.col("kind").isin(network.UP + network.DOWN)), "edges"))
