"""The queries' oracles: the same results in plain SQL, sharing only the estate's mapping and the fact tables."""

from __future__ import annotations

from postura import estate
from postura.knowledge import CURVES, DATA_CLASSES, LIBRARIES, algorithm_rows


def literal(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)


CATALOGUE = "catalogue(alg_ord, " + ", ".join(estate.CATALOGUE) + f") AS (VALUES {values(algorithm_rows())})"
CURVE = f"curves(curve_name, curve_strength, curve_status) AS (VALUES {values([c[:3] for c in CURVES])})"
CLASSES = f"terms(token, class_idx, data_class, lifetime, criticality) AS (SELECT DISTINCT * FROM (VALUES {values(sorted({(t.replace('_', ''), i, c, life, crit) for i, c, life, crit, terms in DATA_CLASSES for t in terms.split()}))}))"
OBS = (
    "obs AS (SELECT alg_id, " + ", ".join(f"{e} AS {c}" for c, e in estate.OBSERVATION.items())
    + " FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN catalogue ON l_partkey % 70 = alg_ord)"
)
PARAMS = ["key_bits", "parameter_set", "curve", "mode", "digest"]
IDENTITY = ["component", "alg_id", "primitive", *PARAMS]
KEY = "concat_ws('|', component, 'algorithm', alg_id, coalesce(primitive, ''), " + ", ".join(f"coalesce(lower(CAST({p} AS VARCHAR)), '')" for p in PARAMS) + ")"
OCCURRENCE = "surface, path, line, rule_id, kind, function_id, function_name, api_style, algorithm_source, identifier, parameter, entry_kind"
OCC = f"occ AS (SELECT DISTINCT 'crypto/algorithm/' || alg_id || '/' || substr(sha256({KEY}), 1, 16) AS asset_id, {', '.join(IDENTITY)}, {OCCURRENCE} FROM obs)"
EFFORT = "CASE surface WHEN 'source' THEN 1.5 WHEN 'binary' THEN 2.0 WHEN 'container' THEN 1.2 WHEN 'certificate' THEN 1.0 WHEN 'config' THEN 0.6 WHEN 'cloud' THEN 0.8 END"
ASSETS = f"""assets AS (
  SELECT asset_id, {', '.join(IDENTITY)}, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT coalesce(function_id, path)) AS BIGINT) AS places,
    CAST(count(DISTINCT CASE WHEN surface <> 'runtime' THEN path END) AS BIGINT) AS files,
    count(api_style) AS uses, count(CASE WHEN api_style IN ('provider', 'protocol') THEN 1 END) AS via_provider,
    bool_or(surface IN ('config', 'cloud')) AS configured, bool_or(coalesce(algorithm_source = 'dynamic', false)) AS dynamic, bool_or(coalesce(algorithm_source = 'constant', false)) AS constant,
    bool_or(coalesce(api_style = 'protocol', false) OR rule_id LIKE '%cipher%' OR rule_id LIKE '%group%' OR rule_id LIKE '%ssl%' OR rule_id LIKE '%tls%' OR rule_id LIKE '%ssh%') AS negotiated,
    max(CAST({EFFORT} AS DOUBLE)) AS surface_effort,
    CASE WHEN bool_or(surface = 'runtime') THEN 'confirmed' WHEN bool_or(surface IN ('config', 'cloud', 'certificate') OR (surface = 'source' AND kind = 'api-call')) THEN 'configured' ELSE 'capable' END AS liveness,
    substr('DCBA', CAST(1 + count(DISTINCT CASE WHEN kind <> 'heuristic' THEN CASE surface WHEN 'source' THEN 's' WHEN 'runtime' THEN 'r' ELSE 'a' END END) AS INT), 1) AS grade
  FROM occ GROUP BY ALL)"""
# word boundaries first, as the regular expressions here know no lookahead
SPLIT = "string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g')), '[^a-z0-9]+')"
EVIDENCE = """evidence AS (
  SELECT DISTINCT asset_id, 10 AS w, identifier AS name FROM occ WHERE identifier IS NOT NULL
  UNION SELECT DISTINCT asset_id, 7, parameter FROM occ WHERE parameter IS NOT NULL
  UNION SELECT DISTINCT asset_id, 6, function_name FROM occ WHERE function_name IS NOT NULL AND api_style IS NOT NULL
  UNION SELECT DISTINCT asset_id, 4, path FROM occ)"""
TOKENS = f"""names AS (SELECT asset_id, w, list_filter({SPLIT}, lambda x: x <> '') AS t FROM evidence),
tokens AS (SELECT asset_id, w, unnest(t) AS token FROM names
  UNION ALL SELECT asset_id, w, t[i] || t[i + 1] FROM (SELECT asset_id, w, t, unnest(generate_series(1, len(t) - 1)) AS i FROM names WHERE len(t) > 1))"""
SCORES = """best_tokens AS (SELECT asset_id, class_idx, data_class, lifetime, criticality, token, max(w) AS w FROM tokens JOIN terms USING (token) GROUP BY ALL),
scores AS (SELECT asset_id, class_idx, data_class, CAST(lifetime AS DOUBLE) AS lifetime, criticality, CAST(sum(w) AS BIGINT) AS score FROM best_tokens GROUP BY asset_id, class_idx, data_class, lifetime, criticality)"""
BEST = """best AS (SELECT asset_id, data_class, lifetime, criticality, score, round(least(0.35::DOUBLE + 0.2::DOUBLE * (score / 10.0::DOUBLE), 0.95::DOUBLE) * 100) / 100 AS confidence
  FROM scores QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY score DESC, lifetime DESC, class_idx DESC) = 1)"""
RANK = "CASE criticality WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
CLASSIFIED = f"""sensitive AS (SELECT a.component, b.data_class AS c_class, b.lifetime AS c_life, b.criticality AS c_crit, b.confidence AS c_conf FROM assets a JOIN best b USING (asset_id)
  QUALIFY row_number() OVER (PARTITION BY a.component ORDER BY {RANK.replace('criticality', 'b.criticality')} DESC, b.lifetime DESC, asset_id) = 1),
classified AS (SELECT a.*, b.data_class IS NULL AND a.uses = 0 AND s.c_class IS NOT NULL AS inherited,
  coalesce(b.data_class, CASE WHEN a.uses = 0 THEN c_class END, 'unclassified') AS data_class, coalesce(b.lifetime, CASE WHEN a.uses = 0 THEN c_life END, 5.0) AS lifetime,
  coalesce(b.criticality, CASE WHEN a.uses = 0 THEN c_crit END, 'medium') AS criticality,
  coalesce(b.confidence, CASE WHEN a.uses = 0 THEN round(c_conf * 0.8::DOUBLE * 100) / 100 END, 0.25) AS confidence
  FROM assets a LEFT JOIN best b USING (asset_id) LEFT JOIN sensitive s ON a.component = s.component)"""
LIB = "libs AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in estate.LIBRARY.items()) + " FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
NUMBERS = "list_transform(string_split(version, '.'), lambda x: CAST(x AS INT))"
READY = "ready AS (SELECT DISTINCT component FROM libs WHERE " + " OR ".join(
    f"name = '{n}'" if s == "any" else f"(name = '{n}' AND {NUMBERS} >= [{s.replace('.', ', ')}])" for n, s in LIBRARIES if s not in ("never", "unknown")
) + ")"
ORD = "CASE {} WHEN 'legacy' THEN 1 WHEN 'disallowed' THEN 2 WHEN 'broken' THEN 3 ELSE 0 END"
SET = "list_filter(string_split(sets, ' '), lambda s: split_part(s, ':', 1) = parameter_set)[1]"
STRENGTH = f"""strength AS (SELECT k.*, cat.* EXCLUDE (alg_id, alg_ord), ready.component IS NOT NULL AS pqc,
  CASE security WHEN 'fixed' THEN fixed_strength WHEN 'key-bits' THEN coalesce(key_bits, CASE WHEN key_sizes <> '' AND key_sizes NOT LIKE '%,%' THEN TRY_CAST(key_sizes AS INT) END)
    WHEN 'integer-factoring' THEN CASE WHEN key_bits < 1024 THEN 0 WHEN key_bits < 2048 THEN 80 WHEN key_bits < 3072 THEN 112 WHEN key_bits < 7680 THEN 128 WHEN key_bits < 15360 THEN 192 WHEN key_bits >= 15360 THEN 256 END
    WHEN 'hash-output' THEN output_bits // 2 WHEN 'parameter-set' THEN TRY_CAST(split_part({SET}, ':', 3) AS INT) WHEN 'curve' THEN curve_strength WHEN 'digest' THEN d_bits END AS bits,
  greatest({ORD.format('classical')}, CASE WHEN security = 'curve' THEN {ORD.format('curve_status')} ELSE 0 END, CASE WHEN key_bits < min_key_bits THEN 2 ELSE 0 END,
    CASE WHEN mode IS NOT NULL AND list_contains(string_split(weak_modes, ','), lower(mode)) THEN 1 ELSE 0 END, CASE WHEN alg_primitive IN ('signature', 'pke') THEN {ORD.format('d_classical')} ELSE 0 END) AS status,
  TRY_CAST(split_part({SET}, ':', 2) AS INT) AS set_level
  FROM classified k JOIN catalogue cat USING (alg_id) LEFT JOIN (SELECT alg_id AS d_id, output_bits AS d_bits, classical AS d_classical FROM catalogue) d ON digest = d_id
  LEFT JOIN curves ON security = 'curve' AND coalesce(curve, nullif(alg_curve, '')) = curve_name LEFT JOIN ready ON k.component = ready.component)"""
QB = """CASE WHEN status = 3 AND quantum <> 'post-quantum' THEN 1.0 WHEN quantum = 'shor' THEN 1.0 WHEN quantum = 'post-quantum' THEN 0.0
  WHEN alg_primitive IN ('hash', 'xof') THEN CASE WHEN coalesce(output_bits, fixed_strength) >= 384 THEN 0.1 WHEN coalesce(output_bits, fixed_strength) >= 256 THEN 0.2 ELSE 0.5 END
  WHEN bits >= 256 THEN 0.1 ELSE 0.5 END"""
EXPOSURE = "exposed AS (SELECT *, CAST(0.3 AS DOUBLE) AS exposure FROM strength)"
SCORED = f"""s1 AS (SELECT *, CAST({QB} AS DOUBLE) AS qb,
  CASE WHEN coalesce(primitive, alg_primitive) = 'signature' THEN 'forge' WHEN coalesce(primitive, alg_primitive) IN ('hash', 'xof', 'mac', 'kdf', 'drbg') THEN 'integrity' ELSE 'harvest' END AS threat,
  CASE quantum WHEN 'shor' THEN 0 WHEN 'post-quantum' THEN coalesce(set_level, 1) ELSE CASE WHEN classical = 'broken' OR bits IS NULL THEN 0
    WHEN alg_primitive = 'hash' THEN CASE WHEN output_bits >= 512 THEN 5 WHEN output_bits >= 384 THEN 4 WHEN output_bits >= 256 THEN 2 ELSE 0 END
    WHEN bits >= 256 THEN 5 WHEN bits >= 192 THEN 3 WHEN bits >= 128 THEN 1 ELSE 0 END END AS level FROM exposed),
s2 AS (SELECT *, CAST(CASE WHEN uses > 0 THEN round(40 * (via_provider / uses)) WHEN configured THEN 40 ELSE 0 END AS INT) AS a_provider,
  CASE WHEN configured OR dynamic THEN 20 WHEN constant THEN 10 ELSE 0 END AS a_config, CASE WHEN negotiated THEN 15 ELSE 0 END AS a_negotiation,
  CASE WHEN places <= 1 THEN 15 WHEN places = 2 THEN 10 WHEN places <= 5 THEN 5 ELSE 0 END AS a_centralised, CASE WHEN qb = 0 OR pqc THEN 10 ELSE 0 END AS a_ready FROM s1),
s3 AS (SELECT *, CAST(least(a_provider + a_config + a_negotiation + a_centralised + a_ready, 100) AS INT) AS agility FROM s2),
s4 AS (SELECT *, round((0.25::DOUBLE + (100 - agility) * 0.04::DOUBLE) * 100) / 100 AS y_years FROM s3),
s5 AS (SELECT *, qb >= 0.5 AND lifetime + y_years > 4 AS urgent, qb >= 0.5 AND lifetime + y_years > 9 AS urgent_even_if_late, round((lifetime + y_years - 4.0::DOUBLE) * 100) / 100 AS urgency_years,
  round(100.0::DOUBLE * exposure * least(greatest(lifetime / 25.0::DOUBLE, 0.0), 1.0) * qb * CAST(CASE liveness WHEN 'confirmed' THEN 1.0 WHEN 'configured' THEN 0.7 ELSE 0.4 END AS DOUBLE) * 100) / 100 AS exposure_index FROM s4),
s6 AS (SELECT *, greatest(exposure_index, CASE status WHEN 3 THEN 90.0 WHEN 2 THEN 70.0 WHEN 1 THEN 35.0 ELSE 0.0 END) + CASE WHEN urgent THEN 15 ELSE 0 END + CASE WHEN urgent_even_if_late THEN 10 ELSE 0 END
  + CASE WHEN criticality = 'critical' AND qb >= 0.5 THEN 5 ELSE 0 END AS p FROM s5),
s7 AS (SELECT *, CAST(round(least(greatest(CASE WHEN qb = 0 AND status = 0 THEN least(p, 5.0) ELSE p END, 0.0), 100.0)) AS INT) AS priority FROM s6),
scored AS (SELECT *, CASE WHEN priority >= 80 THEN 'critical' WHEN priority >= 60 THEN 'high' WHEN priority >= 35 THEN 'medium' WHEN priority >= 10 THEN 'low' ELSE 'info' END AS tier FROM s7)"""
PR = "coalesce(primitive, alg_primitive)"
MOD = "CAST(coalesce(key_bits, 2048) // 8 * 2 AS BIGINT)"
ADVISED = f"""r1 AS (SELECT *, CASE WHEN quantum = 'post-quantum' THEN 'retain' WHEN {PR} IN ('key-agree', 'kem', 'pke', 'signature') AND quantum = 'shor' THEN 'replace'
  WHEN {PR} = 'hash' AND status < 3 AND qb > 0.2 THEN 'replace' WHEN {PR} = 'mac' AND alg_id = 'hmac' AND digest IS NULL THEN 'review' WHEN {PR} = 'xof' AND status < 3 AND qb > 0.2 THEN 'replace'
  WHEN {PR} = 'kdf' AND alg_id = 'pbkdf2' AND status < 3 AND qb > 0.2 THEN 'upgrade' WHEN {PR} IN ('hash', 'xof') AND status = 3 THEN 'replace' WHEN {PR} IN ('mac', 'kdf') AND digest IN ('sha-1', 'md5') THEN 'upgrade'
  WHEN {PR} IN ('block-cipher', 'stream-cipher', 'ae') THEN CASE WHEN mode = 'ecb' OR status > 0 OR qb >= 0.5 THEN 'replace' ELSE 'retain' END
  WHEN qb <= 0.2 AND status < 3 THEN 'retain' ELSE 'replace' END AS action,
  CASE WHEN quantum = 'post-quantum' THEN CASE WHEN parameter_set IN ('512', '44') THEN alg_name || ' at NIST level 3 or higher' ELSE alg_name || ' (verify implementation)' END
  WHEN {PR} IN ('key-agree', 'kem', 'pke') AND quantum = 'shor' THEN 'hybrid X25519 + ML-KEM-768 (FIPS 203)' WHEN {PR} = 'signature' AND quantum = 'shor' THEN 'ML-DSA-' || CASE WHEN lifetime >= 25 THEN '87' ELSE '65' END || ' (FIPS 204), or SLH-DSA for long-term roots'
  WHEN {PR} = 'hash' AND status < 3 AND qb > 0.2 THEN 'SHA-384 (or SHA3-384)' WHEN {PR} = 'mac' AND alg_id = 'hmac' AND digest IS NULL THEN 'the HMAC digest: SHA-256 or stronger' WHEN {PR} = 'xof' AND status < 3 AND qb > 0.2 THEN 'SHAKE256'
  WHEN {PR} = 'kdf' AND alg_id = 'pbkdf2' AND status < 3 AND qb > 0.2 THEN 'PBKDF2-HMAC-SHA-256 deriving 256-bit keys at ≥600,000 iterations, or Argon2id' WHEN {PR} IN ('hash', 'xof') AND status = 3 THEN 'SHA-384 (or SHA3-384)'
  WHEN {PR} IN ('mac', 'kdf') AND digest IN ('sha-1', 'md5') THEN CASE WHEN alg_id = 'pbkdf2' THEN 'Argon2id, or PBKDF2-HMAC-SHA-256 at ≥600,000 iterations' ELSE alg_name || '-SHA-256' END WHEN {PR} IN ('block-cipher', 'stream-cipher', 'ae') THEN CASE WHEN mode = 'ecb' OR status > 0 OR qb >= 0.5 THEN 'AES-256-GCM' ELSE alg_name END
  WHEN qb <= 0.2 AND status < 3 THEN alg_name WHEN replacements <> '' THEN split_part(split_part(replacements, ',', 1), '=', 2) ELSE 'an approved replacement' END AS target FROM scored),
r2 AS (SELECT *, action = 'replace' AND quantum = 'shor' AND {PR} IN ('key-agree', 'kem', 'pke') AS exchange, action = 'replace' AND quantum = 'shor' AND {PR} = 'signature' AS signing FROM r1),
advised AS (SELECT *, CAST(CASE WHEN exchange THEN CASE WHEN alg_id = 'x25519' THEN 64 WHEN alg_id = 'x448' THEN 112 WHEN alg_id = 'ecdh' THEN CASE curve WHEN 'P-384' THEN 194 WHEN 'P-521' THEN 266 ELSE 130 END
    WHEN alg_id IN ('dh', 'rsa') THEN {MOD} ELSE 64 END
  WHEN signing THEN CASE WHEN alg_id = 'ed25519' THEN 96 WHEN alg_id = 'ed448' THEN 171 WHEN alg_id = 'ecdsa' THEN CASE curve WHEN 'P-384' THEN 201 WHEN 'P-521' THEN 272 ELSE 137 END
    WHEN alg_id IN ('rsa', 'dsa') THEN {MOD} ELSE 128 END END AS BIGINT) AS before_bytes,
  CAST(CASE WHEN exchange THEN 2336 WHEN signing THEN CASE WHEN lifetime >= 25 THEN 7219 ELSE 5261 END END AS BIGINT) AS after_bytes,
  CASE WHEN action <> 'retain' THEN greatest(round(CAST(CASE action WHEN 'rotate' THEN 0.5 WHEN 'enable' THEN 0.5 WHEN 'remove' THEN 0.5 WHEN 'review' THEN 0.5 WHEN 'upgrade' THEN 1.0 ELSE 2.0 END AS DOUBLE)
    * coalesce(surface_effort, 1.0) * (1.0::DOUBLE + (100 - agility) / 100.0::DOUBLE * 2.0::DOUBLE) * (1.0::DOUBLE + 0.5::DOUBLE * ln(greatest(files, 1)))
    * CAST(CASE criticality WHEN 'critical' THEN 1.5 WHEN 'high' THEN 1.25 ELSE 1.0 END AS DOUBLE) * 10) / 10, 0.1::DOUBLE) END AS effort,
  CASE WHEN tier IN ('high', 'critical') AND agility >= 60 THEN 1 WHEN tier IN ('high', 'critical') THEN 2 WHEN tier = 'medium' THEN 3 ELSE 4 END AS wave FROM r2)"""

FULL = [CATALOGUE, CURVE, CLASSES, OBS, OCC, ASSETS, EVIDENCE, TOKENS, SCORES, BEST, CLASSIFIED, LIB, READY, STRENGTH, EXPOSURE, SCORED, ADVISED]


def query(select: str, upto: str | None = None) -> str:
    """WITH the estate's steps, as far as needed."""
    steps = FULL if upto is None else FULL[: FULL.index(upto) + 1]
    return "WITH " + ",\n".join(steps) + "\n" + select
