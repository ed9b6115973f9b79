"""Call graph: resolution of calls by name, reachability from entry points, exposure of assets."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postura.policy import DEFAULT, Policy
from postura.storage import durable

#: A name that stands for more functions than this is left unresolved.
MOST_CANDIDATES = 8


def few(functions: DataFrame) -> DataFrame:
    """(component, name, n_component): names that few enough functions of a component have."""
    return functions.groupBy("component", "name").agg(F.count("*").alias("n_component")).where(F.col("n_component") <= MOST_CANDIDATES)


def named(rows: DataFrame, functions: DataFrame) -> DataFrame:
    """The rows (component, path, name, ...) whose name stands for few enough functions, and whether these are of the same file.

    Functions of the file come first; without any, those of the component.
    """
    by_file = functions.groupBy("component", "path", "name").agg(F.count("*").alias("n_file"))
    rows = rows.join(by_file, ["component", "path", "name"], "left").join(few(functions), ["component", "name"], "left")
    return rows.withColumn("n", F.coalesce("n_file", "n_component")).withColumn("in_file", F.col("n_file").isNotNull()).where((F.col("n") > 0) & (F.col("n") <= MOST_CANDIDATES))


def targets(rows: DataFrame, functions: DataFrame) -> DataFrame:
    """The rows of named() with each function (target) that their name stands for.

    A function is there under its file, and once more without one if few of its component have its
    name: a row meets its own candidates only, not all functions of that name.
    """
    under = lambda df, path, own: df.select(F.col("function_id").alias("target"), "component", "name", path.alias("__path"), F.lit(own).alias("in_file"))
    shared = functions.join(few(functions), ["component", "name"], "left_semi")
    target = under(functions, F.col("path"), True).unionByName(under(shared, F.lit(""), False))
    where = F.when(F.col("in_file"), F.col("path")).otherwise("")
    return rows.withColumn("__path", where).join(target, ["component", "name", "in_file", "__path"]).drop("__path")


def resolution(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """The calls of known functions whose name stands for few enough functions."""
    rows = calls.join(functions.select(F.col("function_id").alias("known")), F.col("caller") == F.col("known"), "left_semi")
    return named(rows.withColumnRenamed("callee", "name"), functions)


def resolved_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller, target): edges from callers to the functions that the called names stand for."""
    return targets(resolution(calls, functions), functions).select("caller", "target").distinct()


def entry_weight(kind: Column, policy: Policy = DEFAULT) -> Column:
    table = F.create_map(*(F.lit(x) for kv in policy.exposure.items() for x in kv))
    return table[kind]


def entries(functions: DataFrame, bindings: DataFrame | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """(function_id, entry_kind, detail) of every entry point: of a function's own one and of those bound to it the heaviest, of equal ones the function's own, then by kind and detail.

    functions: (function_id, component, path, name, entry_kind[, detail]); bindings: (component,
    path, handler, entry_kind, detail), registrations of a handler by name, which stand for the
    functions of that name in the same file, or else in the component, if these are few enough.
    """
    detail = "detail" if "detail" in functions.columns else "name"
    own = functions.where("entry_kind IS NOT NULL").select("function_id", "entry_kind", F.col(detail).alias("detail"), F.lit(0).alias("bound"))
    if bindings is not None:
        names = bindings.select("component", "path", F.col("handler").alias("name"), F.col("entry_kind").alias("kind"), F.col("detail").alias("by"))
        found = targets(named(names, functions), functions)
        own = own.unionByName(found.select(F.col("target").alias("function_id"), F.col("kind").alias("entry_kind"), F.col("by").alias("detail"), F.lit(1).alias("bound")))
    best = F.min(F.struct((-entry_weight(F.col("entry_kind"), policy)).alias("w"), "bound", "entry_kind", "detail")).alias("e")
    return own.groupBy("function_id").agg(best).select("function_id", "e.entry_kind", "e.detail")


def in_order(entries: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The entries with position, from 0, the most exposed first, then by function.

    Rows are sorted across tasks; a row's position is its place in its task and what the tasks before hold.
    """
    weight = entry_weight(F.col("entry_kind"), policy)
    rows = durable(entries.withColumn("entry_weight", weight).orderBy(F.desc("entry_weight"), "function_id").withColumn("__at", F.monotonically_increasing_id()))
    task, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(task.alias("__task")).agg(F.count("*").alias("__n"))
    before = sizes.select("__task", F.coalesce(F.sum("__n").over(W.orderBy("__task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return rows.withColumn("__task", task).join(before, "__task").withColumn("position", F.col("__before") + place).drop("__at", "__task", "__before")


#: Levels that are kept apart before they are written together.
APART = 16


def together(levels: list[DataFrame], level: DataFrame) -> list[DataFrame]:
    return [*levels, level] if len(levels) < APART else [durable(reduce(DataFrame.unionByName, [*levels, level]))]


def reached(functions: DataFrame, edges: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """(function_id, depth, entry_weight, entry, parent): functions that calls reach from entry points, level by level.

    A function is reached at its least depth, by the caller that was itself reached first: entry
    points come by falling weight, then by id, and the functions of a level in the order of their
    callers, then by id. So a function belongs to the heaviest of the entries at that depth, of
    equal ones to the least; an entry point has no parent. Calls of entry points find nothing and
    are left out first, and of the entry points those without other calls aren't numbered. A level
    is sorted across tasks, which numbers its functions; it is written once, and the loop ends when
    a level adds nothing.
    """
    weight = entry_weight(F.col("entry_kind"), policy)
    first = functions.where("entry_kind IS NOT NULL").select("function_id", F.lit(0).alias("depth"), weight.alias("entry_weight"), F.col("function_id").alias("entry"), F.lit(None).cast("string").alias("parent"))
    hops = durable(edges.where("caller <> target").join(first.select(F.col("function_id").alias("target")), "target", "left_anti").select("caller", "target"))
    calling = hops.select(F.col("caller").alias("function_id")).distinct()
    level = durable(first.join(calling, "function_id", "left_semi").orderBy(F.desc("entry_weight"), "function_id").withColumn("__turn", F.monotonically_increasing_id()))
    levels = []
    for depth in count(1):
        found = level.join(hops, F.col("function_id") == F.col("caller")).groupBy("target").agg(F.min(F.struct("__turn", "caller", "entry_weight", "entry")).alias("by"))
        if levels:
            found = found.join(reduce(DataFrame.unionByName, levels).select(F.col("function_id").alias("target")), "target", "left_anti")
        fresh = found.orderBy("by.__turn", "target")
        level = durable(fresh.select(F.col("target").alias("function_id"), F.lit(depth).alias("depth"), "by.entry_weight", "by.entry", F.col("by.caller").alias("parent")).withColumn("__turn", F.monotonically_increasing_id()))
        if not level.limit(1).count():
            break
        levels = together(levels, level)
    return reduce(DataFrame.unionByName, [first, *(x.drop("__turn") for x in levels)])


#: The most functions that a path names; what stands before them is cut.
LONGEST = 64


def paths(reach: DataFrame, functions: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(function_id, path): the names of the functions from the entry point to each reached one.

    Pointers double: a row knows the names of its last functions and who stands before them, and
    each round puts that row's names in front, so that a path of n functions takes log2(n) joins.
    Whole paths stay out of the rounds, but for being put in front.
    A path of more than longest functions keeps one more than that, behind an ellipsis.
    """
    names = functions.select("function_id", "name")
    rows = reach.select("function_id", F.col("parent").alias("up")).join(names, "function_id").select("function_id", "up", F.array("name").alias("names"))
    whole, open_ = [rows.where("up IS NULL")], durable(rows.where("up IS NOT NULL"))
    for turn in range(longest.bit_length()):
        if not open_.limit(1).count():
            break
        whole = whole if turn else [durable(*whole)]
        above = reduce(DataFrame.unionByName, [*whole, open_]).select(F.col("function_id").alias("up"), F.col("up").alias("further"), F.col("names").alias("before"))
        both = F.concat("before", "names")
        joined = durable(open_.join(above, "up").select("function_id", F.when(F.size(both) <= longest, F.col("further")).alias("up"), F.slice(both, F.greatest(F.size(both) - longest, F.lit(1)), longest + 1).alias("names")))
        whole, open_ = [*whole, joined.where("up IS NULL")], joined.where("up IS NOT NULL")
    rows = reduce(DataFrame.unionByName, [*whole, open_])
    cut = F.when(F.size("names") > longest, F.lit("… → ")).otherwise("")
    return rows.select("function_id", F.concat(cut, F.array_join("names", " → ")).alias("path"))


# How an entry point is spoken of, and what is said of an asset that none reaches.
ENTRY_NAMES = {"http-route": "HTTP route", "listener": "TLS listener", "library-export": "library export", "main": "process entry"}
UNREACHED = "no detected entry point reaches it; policy default exposure applies (not assumed dead)"


def reasons(exposed: DataFrame, paths: DataFrame, entries: DataFrame, served: DataFrame | None = None, wire: DataFrame | None = None) -> DataFrame:
    """(asset_id, path, exposure_reason): why an asset is as exposed as exposure() says.

    served: (asset_id, via, file, listener, at) of assets that a listener configures (via
    'configured') or presents ('served'); wire: (asset_id, token, at) of handshakes.
    """
    kind = F.create_map(*(F.lit(x) for kv in ENTRY_NAMES.items() for x in kv))
    via = entries.select(F.col("function_id").alias("entry"), kind[F.col("entry_kind")].alias("kind"), "detail")
    rows = exposed.select("asset_id", "function_id", "entry").join(paths, "function_id", "left").join(via, "entry", "left")
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    said = F.when(F.col("path").isNotNull(), F.concat(F.lit("reachable from "), F.col("kind"), F.lit(" "), tick(F.col("detail")), F.lit(" via "), F.col("path")))
    if served is not None:
        s = served.select("asset_id", F.struct("via", "file", "listener", "at").alias("s"))
        rows = rows.join(s, "asset_id", "left")
        by = F.concat(F.lit("TLS listener ("), F.col("s.listener"), F.lit(")"))
        said = said.when(F.col("s.via") == "configured", F.concat(F.lit("configured on a "), by, F.lit(" at "), F.col("s.at"))).when(F.col("s").isNotNull(), F.concat(F.lit("presented by the "), by, F.lit(" configured at "), F.col("s.at"), F.lit(", which references "), tick(F.col("s.file"))))
    if wire is not None:
        rows = rows.join(wire.select("asset_id", F.struct("token", "at").alias("w")), "asset_id", "left")
        said = said.when(F.col("w").isNotNull(), F.concat(F.lit("negotiated in live traffic with "), tick(F.col("w.token")), F.lit(" ("), F.col("w.at"), F.lit(")")))
    return rows.select("asset_id", "path", said.otherwise(UNREACHED).alias("exposure_reason"))


def exposure(occurrences: DataFrame, reach: DataFrame, served: DataFrame | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """(asset_id, exposure, reachable, function_id, entry) of every asset.

    The heaviest entry that reaches a function of the asset decides, and function_id and entry
    say by which function (of equal ones the least). Else an asset that a listener serves
    (served: asset_id, listener_id) or that was seen on the wire is as exposed as a listener;
    any other has the default and counts as not reachable, not as dead.
    """
    uses = occurrences.where("function_id IS NOT NULL").select("asset_id", "function_id").distinct().join(reach.where("entry_weight IS NOT NULL").select("function_id", "entry_weight", "entry"), "function_id")
    best = uses.groupBy("asset_id").agg(F.min(F.struct((-F.col("entry_weight")).alias("w"), "function_id", "entry")).alias("best"))
    rows = occurrences.groupBy("asset_id").agg(F.max(F.col("surface") == "runtime").alias("listened")).join(best, "asset_id", "left")
    if served is not None:
        found = served.where("listener_id is not null").select("asset_id", F.lit(True).alias("serves")).distinct()
        rows = rows.join(found, "asset_id", "left").withColumn("listened", F.coalesce("serves", "listened"))
    weight = F.coalesce(-F.col("best.w"), F.when(F.col("listened"), policy.exposure["listener"]), F.lit(policy.exposure["unreached"]))
    return rows.select("asset_id", weight.alias("exposure"), (F.col("best").isNotNull() | F.col("listened")).alias("reachable"), "best.function_id", "best.entry")


def relevant(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(function_id, depth): functions from which calls lead to the targets, and how many calls away.

    The search runs over reversed edges and doesn't pass through a target.
    """
    first = durable(targets.select("function_id", F.lit(0).alias("depth")).distinct())
    hops = durable(edges.where("caller <> target").join(first.select(F.col("function_id").alias("caller")), "caller", "left_anti").select("caller", "target"))
    level, levels = first, []
    for depth in count(1):
        found = level.join(hops, F.col("function_id") == F.col("target")).select(F.col("caller").alias("function_id")).distinct()
        if levels:
            found = found.join(reduce(DataFrame.unionByName, levels), "function_id", "left_anti")
        level = durable(found.select("function_id", F.lit(depth).alias("depth")))
        if not level.limit(1).count():
            break
        levels = together(levels, level)
    return reduce(DataFrame.unionByName, [first, *levels])
