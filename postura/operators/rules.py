"""Calls that rules know, and the algorithms and parameters that such a call names.

Names of calls repeat, so rules are matched with the distinct ones. A rule by name is a row
keyed by language and the last part of the name: a hash join, then the parts before that. A
rule by regular expression is an expression of its own, tried only where its language is the
call's and the longest text that it needs stands in the name.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postura.functions import names
from postura.rules import FAMILIES, IMPORTS, Rule, catalogue

VALUES = "struct<alg_id:string,key_bits:int,parameter_set:string,curve:string,mode:string,padding:string,digest:string,version:string,list:string>"


def families(language: Column) -> Column:
    """The languages whose rules hold for a language: its own, and those of its family."""
    more = F.create_map(*(x for k, v in FAMILIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.concat(F.array(language), F.coalesce(more[language], F.array().cast("array<string>")))


def needed(pattern: str) -> str:
    """The longest text that every match of a regular expression holds; empty if there is none."""
    parts = re._parser.parse(pattern)
    runs = ["".join(chr(v) for _, v in run) for literal, run in groupby(parts, key=lambda p: p[0] is re._parser.LITERAL) if literal]
    return max(runs, key=len, default="")


def keyed(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """(rule, rule_id, language, last, before, wild): a row for each name of each rule that matches by names."""
    rows = []
    for at, r in enumerate(rules):
        for language in r.languages:
            for callee in r.callees if r.kind != "assign" else ():
                first, *others = parts = callee.split(".")
                wild = first == "*"
                rows.append((at, r.id, language, parts[-1], (others if wild else parts)[:-1], wild))
    return spark.createDataFrame(rows, "rule int, rule_id string, language string, last string, before array<string>, wild boolean")


def by_expression(language: Column, callee: Column, rules: Sequence[Rule]) -> Column:
    """array<struct<rule, rule_id, captures>> of the rules whose regular expression a call's name matches."""
    found = []
    for at, r in enumerate(rules):
        if r.regex and r.kind != "assign":
            pattern = r.regex.replace("(?P<", "(?<")
            groups = re.compile(r.regex).groupindex
            captures = F.map_from_arrays(F.array(*map(F.lit, groups)), F.array(*(F.regexp_extract(callee, pattern, i) for i in groups.values()))) if groups else F.lit(None)
            hit = F.struct(F.lit(at).alias("rule"), F.lit(r.id).alias("rule_id"), captures.cast("map<string,string>").alias("captures"))
            text = needed(r.regex)
            known = F.arrays_overlap(language, F.array(*map(F.lit, r.languages)))
            found.append(F.when(known & (F.contains(callee, F.lit(text)) if text else F.lit(True)) & callee.rlike(pattern), hit))
    return F.filter(F.array(*found), lambda h: h.isNotNull()) if found else F.array().cast("array<struct<rule:int,rule_id:string,captures:map<string,string>>>")


def matched(calls: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The calls (language, callee, ...) with rule (its place in the catalogue), rule_id and captures, a row for each rule that matches.

    A rule's name matches at the end of the call's, part by part; a * before it stands for one
    part at least. The rules of a language hold for its family too.
    """
    rules = catalogue() if rules is None else rules
    known = calls.select("language", "callee").where("language IS NOT NULL AND callee IS NOT NULL").distinct()
    parts = F.filter(F.split("callee", r"\."), lambda p: p != "")
    rows = known.select("language", "callee", families(F.col("language")).alias("spoken"), parts.alias("parts")).where(F.size("parts") > 0)
    named = rows.select("language", "callee", "parts", F.explode("spoken").alias("tongue"), F.element_at("parts", -1).alias("last"))
    table = keyed(calls.sparkSession, rules).withColumnRenamed("language", "tongue")  # as many rows as the catalogue has names
    n, size = F.size("before"), F.size("parts")
    enough = size > n + F.when(F.col("wild"), 1).otherwise(0)
    ends = F.slice("parts", F.greatest(size - n, F.lit(1)), n) == F.col("before")
    exact = named.join(F.broadcast(table), ["tongue", "last"]).where(enough & ends).select("language", "callee", "rule", "rule_id", F.lit(None).cast("map<string,string>").alias("captures"))
    free = rows.select("language", "callee", F.explode(by_expression(F.col("spoken"), F.col("callee"), rules)).alias("h")).select("language", "callee", "h.*")
    hits = exact.dropDuplicates(["language", "callee", "rule"]).unionByName(free)
    return calls.join(hits, ["language", "callee"])


def assigned(assignments: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The assignments (language, property, ...) with rule, rule_id and captures of the rules that they trigger."""
    rules = catalogue() if rules is None else rules
    rows = [(at, r.id, language, p) for at, r in enumerate(rules) if r.kind == "assign" for language in r.languages for p in r.properties]
    table = assignments.sparkSession.createDataFrame(rows, "rule int, rule_id string, tongue string, property string")
    hits = assignments.withColumn("tongue", F.explode(families(F.col("language")))).join(F.broadcast(table), ["tongue", "property"]).drop("tongue")
    return hits.withColumn("captures", F.lit(None).cast("map<string,string>"))


def imported(imports: DataFrame) -> DataFrame:
    """(…, rule_id, alg_id) of imports (language, module): the module's path, with slashes, is a known one or lies below it or ends in it."""
    rows = [(i, language, module, alg) for i, language, modules, alg in IMPORTS for module in modules.split()]
    table = imports.sparkSession.createDataFrame(rows, "rule_id string, tongue string, known string, alg_id string")
    path = F.regexp_replace(F.regexp_replace("module", r"[\"'<>;(){}\s]", ""), r"(?<![A-Za-z]\.h)(::|\.(?!h$)|\\)", "/")
    rows = imports.withColumn("__path", path).withColumn("tongue", F.explode(families(F.col("language"))))
    whole = F.concat(F.lit("/"), F.col("__path"), F.lit("/")).contains(F.concat(F.lit("/"), F.col("known"), F.lit("/")))
    return rows.join(F.broadcast(table), (rows["tongue"] == table["tongue"]) & whole).drop("tongue", "known", "__path").distinct()


def sources(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """(rule, what, turn, arg, keyword, property, capture, value, grammar, less, without): a row for each value that a rule reads; turn orders those for the same."""
    rows = []
    for at, r in enumerate(rules):
        for turn, (what, s) in enumerate([("algorithm", r.source)] * bool(r.source) + list(r.parameters)):
            p = dict(s.places)
            rows.append((at, what, turn, int(p["arg"]) if "arg" in p else None, p.get("keyword"), p.get("property"), p.get("capture"), "value" in p, s.grammar, list(s.less), list(s.without)))
    return spark.createDataFrame(rows, "rule int, what string, turn int, arg int, keyword string, property string, capture string, value boolean, grammar string, less array<string>, without array<string>")


def fixed(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """(rule, kind, style, algorithms, params): what a rule says of itself."""
    rows = [(at, r.kind, r.style, list(r.algorithms), dict(r.fixed)) for at, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule int, kind string, style string, algorithms array<string>, params map<string,string>")


def parsed(grammar: Column, text: Column) -> Column:
    """Struct of what texts say by their grammars."""

    @F.pandas_udf(VALUES)
    def each(grammar: pd.Series, text: pd.Series) -> pd.DataFrame:
        fields = re.findall(r"(\w+):", VALUES.removeprefix("struct<"))
        out = pd.DataFrame([names.value(g, t) or {} for g, t in zip(grammar, text, strict=True)], columns=fields)
        return out.astype({"key_bits": "Int32"}).astype({f: object for f in fields if f != "key_bits"})

    return each(grammar, text)


def stripped(text: Column, less: Column, without: Column) -> Column:
    """The text without the first prefix, and then the first suffix, of the lists that it has."""
    ahead = F.try_element_at(F.filter(less, lambda p: F.startswith(text, p)), F.lit(1))
    rest = F.when(ahead.isNotNull(), F.substr(text, F.length(ahead) + 1)).otherwise(text)
    behind = F.try_element_at(F.filter(without, lambda s: F.endswith(rest, s)), F.lit(1))
    return F.when(behind.isNotNull(), F.left(rest, F.length(rest) - F.length(behind))).otherwise(rest)


def found(matches: DataFrame, key: str, rules: Sequence[Rule] | None = None) -> DataFrame:
    """(key, rule_id, kind, style, alg_id, key_bits, parameter_set, curve, mode, padding, digest, version, list): what matches say.

    matches: the rows of matched() or assigned() with a unique key, args (array<string>), keywords
    (map<string,string>), properties (array of maps, one for each argument that is an object) and
    value (string). A rule's algorithm is the one that it fixes, each of several, or what it reads;
    a parameter comes from the first of its places whose text follows the grammar, else from the
    algorithm's name, else it is the rule's own. Texts are parsed once each.
    """
    rules = catalogue() if rules is None else rules
    spark = matches.sparkSession
    has = lambda c, kind: F.col(c) if c in matches.columns else F.lit(None).cast(kind)
    rows = matches.select(key, "rule", "rule_id", "captures", has("args", "array<string>").alias("args"), has("keywords", "map<string,string>").alias("keywords"), has("properties", "array<map<string,string>>").alias("properties"), has("value", "string").alias("assigned"))
    read = rows.join(F.broadcast(sources(spark, rules)), "rule")
    of_any = F.try_element_at(F.filter(F.transform("properties", lambda m: F.try_element_at(m, F.col("property"))), lambda v: v.isNotNull()), F.lit(1))
    of_one = F.try_element_at(F.get("properties", F.col("arg")), F.col("property"))
    text = (
        F.when(F.col("property").isNotNull(), F.when(F.col("arg").isNotNull(), of_one).otherwise(of_any)).when(F.col("capture").isNotNull(), F.try_element_at("captures", F.col("capture")))
        .when(F.col("keyword").isNotNull(), F.try_element_at("keywords", F.col("keyword"))).when(F.col("value"), F.col("assigned")).otherwise(F.get("args", F.col("arg")))
    )
    read = read.select(key, "rule", "what", "turn", "grammar", stripped(F.trim(F.regexp_replace(text, "^['\"]|['\"]$", "")), F.col("less"), F.col("without")).alias("text")).where("text <> ''")
    meanings = read.select("grammar", "text").distinct().withColumn("v", parsed(F.col("grammar"), F.col("text")))
    read = read.join(meanings, ["grammar", "text"])
    fields = ["alg_id", "key_bits", "parameter_set", "curve", "mode", "padding", "digest", "version", "list"]
    param = {"key-bits": "key_bits", "parameter-set": "parameter_set", "curve": "curve", "mode": "mode", "padding": "padding", "digest": "digest"}
    first = lambda value, when: F.min(F.when(when & value.isNotNull(), F.struct("turn", value.alias("v"))))["v"]
    named = [first(F.col(f"v.{f}"), F.col("what") == "algorithm").alias(f"a_{f}") for f in fields]
    own = [first(F.when(F.col("grammar") == "list", F.col("v.list").cast("string")).otherwise(F.col(f"v.{f}").cast("string")), F.col("what") == what).alias(f"p_{f}") for what, f in param.items()]
    values = read.groupBy(key, "rule").agg(*named, *own)
    said = rows.select(key, "rule", "rule_id").join(F.broadcast(fixed(spark, rules)), "rule").join(values, [key, "rule"], "left")
    said = said.withColumn("alg_id", F.explode_outer(F.when(F.size("algorithms") > 0, F.col("algorithms")).otherwise(F.array("a_alg_id"))))
    given = {f: F.coalesce(F.col(f"p_{f}"), F.col(f"a_{f}").cast("string"), F.try_element_at("params", F.lit(what))) for what, f in param.items()}
    return said.select(key, "rule_id", "kind", "style", "alg_id", given["key_bits"].cast("int").alias("key_bits"), *(given[f].alias(f) for f in list(param.values())[1:]), F.col("a_version").alias("version"), F.col("a_list").alias("list"))
