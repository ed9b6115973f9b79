"""Registered queries and their SQL oracles; every query reads the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postura import engine, estate
from postura.operators import advise, assess, classify, compare, graph, normalize, summary
from postura.plans import sql
from postura.storage import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function under its name, with its oracle if SQL can express it."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def observed(spark, d) -> DataFrame:
    return estate.observations(spark, d)


def occurrences(spark, d) -> DataFrame:
    return normalize.occurrences(observed(spark, d))


def inventory(spark, d) -> DataFrame:
    """Assessed and advised assets; the occurrences are joined and told apart once, and written for the steps that read them."""
    return engine.inventory(written(occurrences(spark, d), "occurrences"), estate.catalogue(spark), estate.libraries(spark, d))


def cols(*names: str) -> str:
    return ", ".join(names)


# --- normalisation

ASSET_COLS = ["asset_id", "component", "alg_id", "n", "places", "files", "liveness", "grade"]


@query(sql.query(f"SELECT {cols(*ASSET_COLS)} FROM assets", sql.ASSETS))
def identity_assets(spark, d):
    return normalize.assets(occurrences(spark, d)).select(*ASSET_COLS)


@query(sql.query("SELECT liveness, grade, count(*) AS assets FROM assets GROUP BY ALL", sql.ASSETS))
def liveness_grades(spark, d):
    return normalize.assets(occurrences(spark, d)).groupBy("liveness", "grade").agg(F.count("*").alias("assets"))


SURFACE_SET = sql.query("SELECT asset_id, string_agg(DISTINCT surface, ',' ORDER BY surface) AS surfaces FROM occ GROUP BY 1", sql.OCC)


@query(SURFACE_SET)
def surface_set(spark, d):
    return occurrences(spark, d).groupBy("asset_id").agg(F.array_join(F.array_sort(F.collect_set("surface")), ",").alias("surfaces"))


DERIVED = "digest IS NOT NULL AND coalesce(primitive, alg_primitive) NOT IN ('mac', 'kdf', 'drbg')"


@query(sql.query(f"""
SELECT alg_id, count(*) AS observations, sum(CASE WHEN derived THEN 1 ELSE 0 END)::BIGINT AS derived FROM (
  SELECT alg_id, false AS derived FROM obs UNION ALL SELECT digest, true FROM obs JOIN catalogue USING (alg_id) WHERE {DERIVED}) GROUP BY 1""", sql.OBS))
def dependency_expand(spark, d):
    rows = normalize.expand_dependencies(observed(spark, d), estate.catalogue(spark))
    return rows.groupBy("alg_id").agg(F.count("*").alias("observations"), F.sum(F.when(F.col("rule_id").endswith("#dependency"), 1).otherwise(0)).alias("derived"))


@query(sql.query(f"""
SELECT DISTINCT 'crypto/algorithm/' || alg_id || '/' || substr(sha256({sql.KEY}), 1, 16) AS asset_id,
  'crypto/algorithm/' || digest || '/' || substr(sha256(component || '|algorithm|' || digest || '||||||'), 1, 16) AS depends_on
FROM obs JOIN (SELECT alg_id, alg_primitive FROM catalogue) USING (alg_id) WHERE {DERIVED}""", sql.OBS))
def dependency_links(spark, d):
    return normalize.dependency_links(observed(spark, d), estate.catalogue(spark))


LINKS = f"""links AS (SELECT DISTINCT 'crypto/algorithm/' || alg_id || '/' || substr(sha256({sql.KEY}), 1, 16) AS asset_id,
  'crypto/algorithm/' || digest || '/' || substr(sha256(component || '|algorithm|' || digest || '||||||'), 1, 16) AS depends_on
  FROM obs JOIN (SELECT alg_id, alg_primitive FROM catalogue) USING (alg_id) WHERE {DERIVED})"""


@query(sql.query("", sql.OBS).rstrip() + ",\n" + LINKS + " SELECT DISTINCT depends_on AS asset_id FROM links")
def referenced_assets(spark, d):
    """Assets that others depend on; the expanded observations make sure that they exist."""
    rows, catalogue = observed(spark, d), estate.catalogue(spark)
    links = normalize.dependency_links(rows, catalogue).select(F.col("depends_on").alias("asset_id")).distinct()
    return normalize.assets(normalize.occurrences(normalize.expand_dependencies(rows, catalogue))).join(links, "asset_id", "left_semi").select("asset_id")


@query(sql.query("", sql.ASSETS).rstrip() + ",\n" + LINKS + " SELECT asset_id FROM assets WHERE asset_id NOT IN (SELECT depends_on FROM links)")
def root_assets(spark, d):
    """Assets that no other one depends on."""
    rows = observed(spark, d)
    links = normalize.dependency_links(rows, estate.catalogue(spark)).select(F.col("depends_on").alias("asset_id"))
    return normalize.assets(normalize.occurrences(rows)).join(links, "asset_id", "left_anti").select("asset_id")


REFINES = " AND ".join(f"(a.{p} IS NULL OR a.{p} = b.{p})" for p in sql.PARAMS)
DIFFERS = " OR ".join(f"a.{p} IS DISTINCT FROM b.{p}" for p in sql.PARAMS)


@query(sql.query(f"""
, pairs AS (SELECT a.asset_id, b.asset_id AS target FROM assets a JOIN assets b ON a.component = b.component AND a.alg_id = b.alg_id
  WHERE (a.primitive IS NULL OR a.primitive = b.primitive) AND {REFINES} AND ({DIFFERS}))
SELECT asset_id, min(target) AS refined_to FROM pairs WHERE target NOT IN (SELECT asset_id FROM pairs) GROUP BY 1 HAVING count(*) = 1""", sql.ASSETS).replace("\n\n,", ","))
def refine(spark, d):
    return normalize.refinements(normalize.assets(occurrences(spark, d)))


FOLDED = sql.query(f"""
, pairs AS (SELECT a.asset_id, b.asset_id AS target FROM assets a JOIN assets b ON a.component = b.component AND a.alg_id = b.alg_id
  WHERE (a.primitive IS NULL OR a.primitive = b.primitive) AND {REFINES} AND ({DIFFERS})),
refined AS (SELECT asset_id, min(target) AS refined_to FROM pairs WHERE target NOT IN (SELECT asset_id FROM pairs) GROUP BY 1 HAVING count(*) = 1),
folded AS (SELECT DISTINCT coalesce(r.refined_to, o.asset_id) AS asset_id, {', '.join(f'CASE WHEN r.refined_to IS NULL THEN o.{c} ELSE t.{c} END AS {c}' for c in sql.IDENTITY)}, {sql.OCCURRENCE}
  FROM occ o LEFT JOIN refined r ON o.asset_id = r.asset_id LEFT JOIN assets t ON r.refined_to = t.asset_id),
{sql.ASSETS.replace('assets AS', 'again AS', 1).replace('FROM occ GROUP', 'FROM folded GROUP')}
SELECT {cols(*ASSET_COLS)} FROM again""", sql.ASSETS).replace("\n\n,", ",")


@query(FOLDED)
def refined_inventory(spark, d):
    found = written(occurrences(spark, d), "occurrences")
    return normalize.assets(normalize.folded(found, normalize.assets(found))).select(*ASSET_COLS)


# --- classification


@query(sql.query("SELECT asset_id, data_class, score FROM scores", sql.SCORES))
def classify_scores(spark, d):
    return classify.scores(classify.evidence(occurrences(spark, d))).select("asset_id", "data_class", "score")


@query(sql.query("SELECT asset_id, data_class, confidence FROM best", sql.BEST))
def classify_best(spark, d):
    return classify.best(classify.scores(classify.evidence(occurrences(spark, d)))).select("asset_id", "data_class", "confidence")


def kinds(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The assets of observations by identity with their data class, and where they occur; both are written.

    A class doesn't depend on how often an occurrence was seen, so that these aren't told apart.
    """
    found = written(normalize.identified(rows).select("asset_id", *normalize.IDENTITY, "path", "function_id", "function_name", "api_style", "identifier", "parameter"), "places")
    assets = found.groupBy("asset_id", *normalize.IDENTITY).agg(F.count("api_style").alias("uses"))
    names = classify.names(found)
    best = classify.best(classify.scores(names, written(classify.terms(names), "terms")))
    return written(classify.classified(assets, best).select("asset_id", *normalize.IDENTITY, "data_class"), "assets"), found


def classified(spark, d) -> DataFrame:
    found = written(occurrences(spark, d), "occurrences")
    return classify.classified(normalize.assets(found), classify.best(classify.scores(classify.evidence(found))))


@query(sql.query("SELECT asset_id, data_class, lifetime, criticality, confidence, inherited FROM classified", sql.CLASSIFIED))
def inherit_class(spark, d):
    return classified(spark, d).select("asset_id", "data_class", "lifetime", "criticality", "confidence", "inherited")


@query(sql.query(f"""SELECT component, data_class, criticality, lifetime FROM classified
QUALIFY row_number() OVER (PARTITION BY component ORDER BY {sql.RANK} DESC, lifetime DESC, asset_id) = 1""", sql.CLASSIFIED))
def component_sensitivity(spark, d):
    return summary.component_sensitivity(classified(spark, d))


EXPLAINED = f"""
, n2 AS (SELECT asset_id, w, left(name, 64) AS name, list_filter({sql.SPLIT}, lambda x: x <> '') AS t FROM evidence),
t2 AS (SELECT asset_id, w, name, unnest(t) AS token FROM n2 UNION ALL SELECT asset_id, w, name, t[i] || t[i + 1] FROM (SELECT *, unnest(generate_series(1, len(t) - 1)) AS i FROM n2 WHERE len(t) > 1)),
m AS (SELECT t2.asset_id, token, w, name FROM t2 JOIN terms USING (token) JOIN best ON best.asset_id = t2.asset_id AND best.data_class = terms.data_class QUALIFY row_number() OVER (PARTITION BY t2.asset_id, token ORDER BY w DESC, name) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY CASE w WHEN 10 THEN 0 WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 3 END, name, token) AS k FROM m),
x AS (SELECT asset_id, string_agg(CASE w WHEN 10 THEN 'argument' WHEN 6 THEN 'function' WHEN 7 THEN 'parameter' ELSE 'path' END || ' `' || name || '` matches term `' || token || '`', '; ' ORDER BY k) AS said FROM r WHERE k <= 3 GROUP BY 1)
SELECT a.asset_id, coalesce(data_class || ' data (secrecy ' || regexp_replace(CAST(lifetime AS VARCHAR), '\\.0$', '') || ' years): ' || said, 'no name around this asset identifies its data; the policy default of 5 years applies') AS explanation
FROM assets a LEFT JOIN best USING (asset_id) LEFT JOIN x ON a.asset_id = x.asset_id"""


@query(sql.query(EXPLAINED, sql.BEST).replace("\n\n,", ","))
def classify_explain(spark, d):
    """Why each asset has its class: the first three matches."""
    found = written(occurrences(spark, d), "occurrences")
    evidence = classify.evidence(found)
    return classify.explained(normalize.assets(found), evidence, classify.best(classify.scores(evidence)))


NAME_TOKENS = "SELECT DISTINCT name, array_to_string(list_filter(" + sql.SPLIT + ", lambda x: x <> ''), ' ') AS tokens FROM evidence"


@query(sql.query(NAME_TOKENS, sql.EVIDENCE))
def tokenize(spark, d):
    return classify.evidence(occurrences(spark, d)).select("name", F.array_join(classify.tokenize(F.col("name")), " ").alias("tokens")).distinct()


# --- scores

def scored(*names: str, where: str = "true", name: str):
    """A query of some columns of the scored inventory."""
    ORACLES[name] = sql.query(f"SELECT {cols(*names)} FROM advised WHERE {where}")
    QUERIES[name] = lambda spark, d: inventory(spark, d).where(where).select(*names)


scored("asset_id", "bits", "status", "level", name="strength")
scored("asset_id", "qb", "threat", name="quantum_breakability")
scored("asset_id", "a_provider", "a_config", "a_negotiation", "a_centralised", "a_ready", "agility", name="agility")
scored("asset_id", "lifetime", "y_years", "urgent", "urgent_even_if_late", "urgency_years", name="mosca")
scored("asset_id", "exposure_index", name="exposure_index")
scored("asset_id", "priority", "tier", name="priority_tier")
scored("asset_id", "action", "target", "before_bytes", "after_bytes", name="recommend")
scored("asset_id", "effort", where="action <> 'retain'", name="effort")
scored("asset_id", "component", "tier", "threat", where="tier = 'critical' AND threat = 'harvest' AND lower(component) LIKE '%i%'", name="inventory_filter")


@query(sql.query("SELECT component, tier, count(*) AS assets FROM scored GROUP BY ALL"))
def tier_counts(spark, d):
    return summary.tier_counts(inventory(spark, d))


@query(sql.query("""SELECT count(*) AS assets, count(*) FILTER (qb >= 0.5) AS quantum_vulnerable, count(*) FILTER (status = 3) AS broken, count(*) FILTER (urgent) AS urgent,
count(*) FILTER (tier = 'critical') AS critical, count(*) FILTER (tier = 'high') AS high, count(*) FILTER (qb = 0) AS post_quantum, count(*) FILTER (liveness = 'confirmed') AS confirmed FROM scored"""))
def summary_totals(spark, d):
    return summary.totals(inventory(spark, d))


@query(sql.query("""SELECT component, count(*) AS assets, count(*) FILTER (tier = 'critical') AS critical, count(*) FILTER (tier = 'high') AS high, max(priority) AS max_priority
FROM scored GROUP BY 1 ORDER BY max_priority DESC, critical DESC, component LIMIT 12"""))
def component_risk(spark, d):
    return summary.top_components(inventory(spark, d))


COUNT = lambda t: f"count(*) FILTER (tier = '{t}')"


@query(sql.query("SELECT component, " + ", ".join(f"{COUNT(t)} AS {t}" for t in assess.TIERS) + f", 1000 * {COUNT('critical')} + 100 * {COUNT('high')} + 10 * {COUNT('medium')} + {COUNT('low')} AS rank_score FROM scored GROUP BY 1"))
def heatmap(spark, d):
    return summary.heatmap(inventory(spark, d))


@query(sql.query("SELECT threat, count(*) AS assets FROM scored WHERE qb >= 0.5 OR status = 3 GROUP BY 1"))
def threat_split(spark, d):
    return summary.threat_split(inventory(spark, d))


@query(sql.query("SELECT asset_id, component, priority, tier, action, target FROM advised WHERE action <> 'retain' ORDER BY priority DESC, asset_id LIMIT 15"))
def fix_first(spark, d):
    return summary.fix_first(inventory(spark, d))


@query(sql.query("SELECT asset_id, lifetime, y_years, round((lifetime + y_years) * 100) / 100 AS total FROM scored WHERE qb >= 0.5 ORDER BY total DESC, asset_id LIMIT 16"))
def mosca_timeline(spark, d):
    return summary.mosca_timeline(inventory(spark, d))


@query(sql.query("SELECT asset_id, component, priority, tier, threat FROM scored ORDER BY priority DESC, asset_id LIMIT 6"))
def top_risks(spark, d):
    return summary.top_risks(inventory(spark, d))


@query(sql.query(f"SELECT asset_id, row_number() OVER (ORDER BY CASE WHEN qb >= 0.5 THEN urgency_years ELSE -99 END DESC, asset_id) AS place FROM scored QUALIFY place <= 100"))
def mosca_order(spark, d):
    """The hundred assets with the least time left."""
    from pyspark.sql import Window as W

    first = summary.ordered(inventory(spark, d), "mosca").limit(100)
    by = summary.SORT_KEYS["mosca"]("mosca")
    return first.select("asset_id", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(by.desc(), "asset_id")).cast("long").alias("place"))  # a hundred rows


@query(sql.query(f"SELECT DISTINCT 'component' AS field, component AS value FROM scored UNION SELECT DISTINCT 'type', {sql.PR} FROM scored"))
def domain_lists(spark, d):
    return summary.domains(inventory(spark, d))


ROADMAP = "SELECT wave, asset_id, component, tier, priority, agility, y_years AS migration_years, action, target, effort, CASE wave WHEN 1 THEN 2027 WHEN 2 THEN 2028 WHEN 3 THEN 2029 END AS due_year FROM advised WHERE action <> 'retain'"


@query(sql.query(ROADMAP))
def roadmap(spark, d):
    return advise.roadmap(inventory(spark, d))


@query(sql.query("""
, sums AS (SELECT wave, count(*) AS items, sum(CAST(round(effort * 10) AS BIGINT)) AS tenths FROM advised WHERE action <> 'retain' GROUP BY 1),
w AS (SELECT v.wave, v.due_year, coalesce(items, 0) AS items, coalesce(tenths, 0) AS tenths FROM (VALUES (1, 2027), (2, 2028), (3, 2029), (4, NULL)) v(wave, due_year) LEFT JOIN sums USING (wave)),
c AS (SELECT *, sum(tenths) OVER (ORDER BY wave) / 10.0::DOUBLE AS cumulative, CASE WHEN due_year >= 2026 THEN (due_year - 2026 + 1) * 46.0::DOUBLE END AS weeks_available FROM w)
SELECT wave, items, tenths / 10.0::DOUBLE AS person_weeks, due_year, cumulative, weeks_available, round(cumulative / weeks_available * 10) / 10 AS engineers_needed, false AS overdue FROM c""").replace("\n\n,", ","))
def wave_plan(spark, d):
    return advise.plan(advise.roadmap(inventory(spark, d)))


@query(sql.query("""
, sums AS (SELECT wave, sum(CAST(round(effort * 10) AS BIGINT)) AS tenths FROM advised WHERE action <> 'retain' GROUP BY 1),
c AS (SELECT v.due_year, sum(coalesce(tenths, 0)) OVER (ORDER BY v.wave) / 10.0::DOUBLE AS cumulative FROM (VALUES (1, 2027), (2, 2028), (3, 2029), (4, NULL)) v(wave, due_year) LEFT JOIN sums USING (wave))
SELECT max(round(cumulative / ((due_year - 2026 + 1) * 46.0::DOUBLE) * 10) / 10) AS engineers_needed, false AS overdue, max(cumulative) AS person_weeks FROM c""").replace("\n\n,", ","))
def engineers_needed(spark, d):
    """The most engineers that any wave of the plan needs."""
    return advise.engineers(advise.plan(advise.roadmap(inventory(spark, d))))


@query(sql.query("SELECT wave, count(*) AS items, sum(CAST(round(effort * 10) AS BIGINT)) / 10.0::DOUBLE AS effort, max(y_years) AS max_years FROM advised WHERE action <> 'retain' GROUP BY 1"))
def wave_extents(spark, d):
    return summary.waves(advise.roadmap(inventory(spark, d)))


# --- libraries


@query(sql.query("SELECT component FROM ready", sql.READY))
def pqc_library(spark, d):
    return engine.pqc_ready(estate.libraries(spark, d))


# --- comparison

CUT = "1996-01-01"
HALF = lambda name, test: f"{name} AS (SELECT asset_id, component, tier FROM ({sql.query('SELECT asset_id, component, tier FROM scored').replace(' FROM lineitem JOIN', f' FROM (SELECT * FROM lineitem WHERE l_shipdate {test}) lineitem JOIN')}))"
TIER = lambda c: f"CASE {c} WHEN 'info' THEN 1 WHEN 'low' THEN 2 WHEN 'medium' THEN 3 WHEN 'high' THEN 4 WHEN 'critical' THEN 5 ELSE 0 END"
CHANGES = f"""WITH {HALF('o', f"< DATE '{CUT}'")}, {HALF('n', f">= DATE '{CUT}'")},
ch AS (SELECT coalesce(n.asset_id, o.asset_id) AS asset_id, coalesce(n.component, o.component) AS component,
  CASE WHEN o.asset_id IS NULL THEN 'added' WHEN n.asset_id IS NULL THEN 'removed' WHEN {TIER('n.tier')} > {TIER('o.tier')} THEN 'worsened' WHEN {TIER('n.tier')} < {TIER('o.tier')} THEN 'improved' END AS change,
  o.tier AS old_tier, n.tier AS new_tier FROM o FULL JOIN n ON o.asset_id = n.asset_id)"""
REGRESSION = f"change IN ('added', 'worsened') AND {TIER('new_tier')} >= 4"


def halves(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = observed(spark, d)
    half = lambda test: engine.inventory(written(normalize.occurrences(rows.where(f"seen {test} DATE '{CUT}'")), "occurrences"), estate.catalogue(spark), estate.libraries(spark, d)).select("asset_id", "component", "tier")
    return half("<"), half(">=")


@query(f"{CHANGES} SELECT asset_id, component, change, old_tier, new_tier, {REGRESSION} AS regression FROM ch WHERE change IS NOT NULL")
def compare_inventories(spark, d):
    return compare.compare(*halves(spark, d))


@query(f"""{CHANGES} SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'worsened') AS worsened, count(*) FILTER (change = 'improved') AS improved,
count(*) FILTER (change = 'removed') AS removed, count(*) FILTER ({REGRESSION}) AS regressions, count(*) FILTER ({REGRESSION}) = 0 AS passes FROM ch""")
def regression_gate(spark, d):
    return compare.gate(compare.compare(*halves(spark, d)))


# --- call graph

#: Sorts entry points by falling weight.
LIGHT = "CASE {} WHEN 'http-route' THEN '0' WHEN 'listener' THEN '0' WHEN 'library-export' THEN '4' ELSE '7' END"
GRAPH = f"""fns AS (SELECT function_id, min(component) AS component, min(path) AS path, min(function_name) AS name, arg_min(entry_kind, {LIGHT.format('entry_kind')} || entry_kind) AS entry_kind FROM obs WHERE function_id IS NOT NULL GROUP BY 1),
calls AS (SELECT DISTINCT function_id AS caller, component, path, callee FROM (
  SELECT *, lead(function_name) OVER (PARTITION BY order_id ORDER BY obs_id, function_id, alg_id) AS callee FROM obs WHERE function_id IS NOT NULL) WHERE callee IS NOT NULL),
infile AS (SELECT component, path, name, count(*) AS n FROM fns GROUP BY ALL), incomp AS (SELECT component, name, count(*) AS n FROM fns GROUP BY ALL),
res AS (SELECT c.*, f.n IS NOT NULL AS in_file, coalesce(f.n, p.n) AS n FROM calls c LEFT JOIN infile f ON c.component = f.component AND c.path = f.path AND c.callee = f.name
  LEFT JOIN incomp p ON c.component = p.component AND c.callee = p.name),
edges AS (SELECT DISTINCT caller, t.function_id AS target FROM res r JOIN fns t ON r.component = t.component AND r.callee = t.name AND (NOT in_file OR r.path = t.path) WHERE r.n BETWEEN 1 AND 8)"""


def graph_sql(select: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join([sql.CATALOGUE, sql.OBS, GRAPH]) + select


@query(graph_sql("\nSELECT caller, target FROM edges"))
def call_resolution(spark, d):
    fns, calls = estate.call_graph(spark, d)
    return graph.resolved_calls(calls, fns)


REACH = """, hops AS (SELECT * FROM edges WHERE caller <> target),
bfs(function_id, depth) AS (SELECT function_id, 0 FROM fns WHERE entry_kind IS NOT NULL UNION SELECT target, depth + 1 FROM bfs JOIN hops ON function_id = caller WHERE depth < 40),
d AS (SELECT function_id, min(depth) AS depth FROM bfs GROUP BY 1)"""


@query(graph_sql(REACH + " SELECT function_id, CAST(depth AS INT) AS depth FROM d", recursive=True))
def reach_depth(spark, d):
    fns, calls = estate.call_graph(spark, d)
    return graph.reached(fns, graph.resolved_calls(calls, fns)).select("function_id", "depth")


# of the entries on shortest paths the heaviest; then what of an asset's functions is reached best, else its listeners, else the wire
EXPOSED = REACH + f""", pairs(function_id, entry, depth) AS (SELECT function_id, function_id, 0 FROM fns WHERE entry_kind IS NOT NULL
  UNION SELECT h.target, p.entry, p.depth + 1 FROM pairs p JOIN hops h ON p.function_id = h.caller JOIN d ON d.function_id = h.target AND d.depth = p.depth + 1),
rc AS (SELECT p.function_id, p.entry, CASE e.entry_kind WHEN 'library-export' THEN 0.6 WHEN 'main' THEN 0.3 ELSE 1.0 END::DOUBLE AS w FROM pairs p JOIN fns e ON p.entry = e.function_id
  QUALIFY row_number() OVER (PARTITION BY p.function_id ORDER BY w DESC, p.entry) = 1),
li AS (SELECT {', '.join(f'{e} AS {c}' for c, e in estate.SERVING.items())} FROM supplier JOIN nation ON s_nationkey = n_nationkey),
sv AS (SELECT DISTINCT asset_id FROM occ JOIN li ON occ.path = li.path AND surface IN ('config', 'cloud') UNION SELECT DISTINCT asset_id FROM occ JOIN li ON occ.component = li.component AND string_split(occ.path, '/')[-1] = li.served),
bf AS (SELECT asset_id, function_id, entry, w FROM occ JOIN rc USING (function_id) QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY w DESC, function_id) = 1),
ex AS (SELECT a.asset_id, CASE WHEN bf.w IS NOT NULL THEN bf.w WHEN wire OR sv.asset_id IS NOT NULL THEN 1.0 ELSE 0.3 END::DOUBLE AS exposure, bf.w IS NOT NULL OR wire OR sv.asset_id IS NOT NULL AS reachable, bf.function_id, bf.entry
  FROM (SELECT asset_id, bool_or(surface = 'runtime') AS wire FROM occ GROUP BY 1) a LEFT JOIN bf USING (asset_id) LEFT JOIN sv ON a.asset_id = sv.asset_id)"""


def places(spark, d) -> DataFrame:
    """Where assets occur, as far as exposure asks; written, as it is read more than once."""
    return written(normalize.identified(observed(spark, d)).select("asset_id", "alg_id", "component", "surface", "path", "function_id"), "places")


def exposed(spark, d, rows: DataFrame | None = None) -> DataFrame:
    """Exposure of the assets; rows: their occurrences, if they are written already."""
    from postura.operators.evidence import listener_for

    fns, calls = estate.call_graph(spark, d)
    reach = graph.reached(fns, graph.resolved_calls(calls, fns))
    rows = places(spark, d) if rows is None else rows
    return graph.exposure(rows, reach, listener_for(rows.select("asset_id", "component", "surface", "path").distinct(), estate.listeners(spark, d)))


@query("WITH RECURSIVE " + ",\n".join([sql.CATALOGUE, sql.OBS, sql.OCC, GRAPH]) + EXPOSED + " SELECT asset_id, exposure, reachable, function_id, entry FROM ex")
def exposure(spark, d):
    """The best reached function and entry of every asset."""
    return exposed(spark, d)


def exposed_sql(select: str) -> str:
    steps = list(sql.FULL)
    steps[steps.index(sql.OCC)] = sql.OCC + ",\n" + GRAPH + EXPOSED
    steps[steps.index(sql.EXPOSURE)] = "exposed AS (SELECT s.* REPLACE (CASE WHEN ex.reachable THEN 'confirmed' ELSE liveness END AS liveness), ex.exposure FROM strength s JOIN ex USING (asset_id))"
    return "WITH RECURSIVE " + ",\n".join(steps) + "\n" + select


@query(exposed_sql("SELECT asset_id, exposure, liveness, exposure_index, priority, tier FROM scored"))
def exposed_priority(spark, d):
    """Scores of the inventory when exposure and confirmed liveness follow the call graph and the listeners."""
    found = written(occurrences(spark, d), "occurrences")
    rows = engine.inventory(found, estate.catalogue(spark), estate.libraries(spark, d), exposed(spark, d, found))
    return rows.select("asset_id", "exposure", "liveness", "exposure_index", "priority", "tier")


@query(exposed_sql("SELECT reachable, liveness, count(*) AS assets FROM (SELECT ex.reachable, s.liveness FROM scored s JOIN ex USING (asset_id)) GROUP BY ALL"))
def confirmed_liveness(spark, d):
    """Assets by whether they are reachable, and by their liveness once reachable ones are confirmed."""
    found = written(occurrences(spark, d), "occurrences")
    rows = engine.inventory(found, estate.catalogue(spark), estate.libraries(spark, d), exposed(spark, d, found))
    return rows.groupBy("reachable", "liveness").agg(F.count("*").alias("assets"))


@query(graph_sql("\nSELECT (SELECT count(*) FROM fns) AS functions, (SELECT count(*) FROM fns WHERE entry_kind IS NOT NULL) AS entries, (SELECT count(*) FROM res WHERE n BETWEEN 1 AND 8) AS resolved, (SELECT count(*) FROM edges) AS edges"))
def graph_stats(spark, d):
    fns, calls = estate.call_graph(spark, d)
    found = written(graph.resolution(calls, fns), "resolved")
    edges = graph.targets(found, fns).select("caller", "target").distinct()
    return (
        fns.agg(F.count("*").alias("functions"), F.count("entry_kind").alias("entries"))
        .crossJoin(found.agg(F.count("*").alias("resolved"))).crossJoin(edges.agg(F.count("*").alias("edges")))
    )  # fmt: skip  # one row each
