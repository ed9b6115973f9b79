"""Operators over raw evidence: traces, files, layers, hosts, handshakes, protocols, audit logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Files that make their directory a component's root.
MANIFESTS = [
    "Cargo.toml", "package.json", "pom.xml", "build.gradle", "build.gradle.kts", "go.mod", "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "composer.json", "Gemfile",
    "CMakeLists.txt", "meson.build", "Package.swift", "mix.exs", "Dockerfile", "Chart.yaml",
]


# --- traces


def setup_depth(trace: DataFrame, enter: str, leave: str) -> DataFrame:
    """Adds depth: how many setups a thread is inside, before each event; leaving never goes below zero.

    A counter that stops at zero is the running sum less its least value so far, if negative.
    """
    order = W.partitionBy("pid").orderBy("ts", "event_id")
    step = F.when(F.col("function") == enter, 1).when(F.col("function") == leave, -1).otherwise(0)
    rows = trace.withColumn("__sum", F.sum(step).over(order.rowsBetween(W.unboundedPreceding, 0)))
    depth = F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("__depth", depth)
    return rows.withColumn("depth", F.coalesce(F.lag("__depth").over(order), F.lit(0))).drop("__sum", "__depth")


def setup_counts(trace: DataFrame, enter: str, leave: str) -> DataFrame:
    """Calls by executable and function: those that count, and those within setups, which don't."""
    rows = setup_depth(trace, enter, leave).where(~F.col("function").isin(enter, leave))
    ignored = F.sum(F.when(F.col("depth") > 0, 1).otherwise(0))
    return rows.groupBy("executable", "function").agg((F.count("*") - ignored).alias("calls"), ignored.alias("ignored"))


# --- files


def components(files: DataFrame, manifests: list[str] = MANIFESTS) -> DataFrame:
    """Adds component: the deepest directory above a file that holds a manifest, else '.'."""
    parent = lambda p: F.regexp_extract(p, "^(.*)/[^/]*$", 1)
    name = lambda p: F.element_at(F.split(p, "/"), -1)
    roots = files.where(name(F.col("path")).isin(*manifests)).select(parent(F.col("path")).alias("root")).distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    found = files.select("path", F.explode(above).alias("root")).join(roots, "root").groupBy("path").agg(F.max(F.struct(F.length("root").alias("n"), "root"))["root"].alias("found"))
    return files.join(found, "path", "left").withColumn("component", F.coalesce("found", F.lit("."))).drop("found")


def cache_key(*parts: str) -> Column:
    """A digest of length-prefixed parts, so that no two lists of parts run together."""
    piece = lambda c: F.concat(F.length(F.coalesce(F.col(c), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(c), F.lit("")))
    return F.sha2(F.concat(*map(piece, parts)), 256)


def misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose content is not in the cache (column key)."""
    return files.join(cache.select("key"), "key", "left_anti")


def overlay(entries: DataFrame) -> DataFrame:
    """(image, path, layer): files that survive, with the last layer that adds them.

    entries: (image, path, layer, kind); kind is 'file', 'whiteout' (the path and all below it
    go from the layers before) or 'opaque' (only what is below it goes). What a layer adds
    comes after what it removes. Every file looks at its own directories, so no pair of a
    file and an unrelated removal is made.
    """
    files = entries.where("kind = 'file'").groupBy("image", "path").agg(F.max("layer").alias("layer"))
    gone = entries.where("kind <> 'file'").groupBy("image", F.col("path").alias("root"), "kind").agg(F.max("layer").alias("hidden"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    met = files.select("image", "path", F.explode(above).alias("root")).join(gone, ["image", "root"]).where("kind = 'whiteout' or root <> path")
    hidden = met.groupBy("image", "path").agg(F.max("hidden").alias("hidden"))
    return files.join(hidden, ["image", "path"], "left").where("hidden IS NULL OR layer >= hidden").drop("hidden")


# --- networks


def attributed(seen: DataFrame, listeners: DataFrame) -> DataFrame:
    """Adds the listener's component to seen hosts: an exact name first, then '*.' and the parent; the first listener by id wins."""
    first = listeners.groupBy("host").agg(F.min(F.struct("listener_id", "component"))["component"].alias("component"))
    exact = first.select(F.col("host"), F.col("component").alias("exact"))
    wild = first.where(F.startswith("host", F.lit("*."))).select(F.substring("host", 3, 1000).alias("parent"), F.col("component").alias("wild"))
    rows = seen.withColumn("parent", F.regexp_extract("host", r"^[^.]+\.(.+)$", 1))
    return rows.join(exact, "host", "left").join(wild, "parent", "left").select(*seen.columns, F.coalesce("exact", "wild").alias("listener_component"))


def negotiated(client: Column, server: Column) -> Column:
    """The client's first algorithm that the server lists too."""
    return F.try_element_at(F.filter(client, lambda x: F.array_contains(server, x)), F.lit(1))


def distinct_settings(handshakes: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct negotiated settings, the first place where each was seen, and how often."""
    return handshakes.groupBy(*keys).agg(F.min("place").alias("first_place"), F.count("*").alias("times"))


def attach_settings(protocols: DataFrame) -> DataFrame:
    """(component, version, suites): settings without a version go to every version in the same file.

    Rows are (component, path, version, suite). Settings of files without any version stay as
    a row of their own, by file.
    """
    versioned = protocols.where("version IS NOT NULL").select("component", "path", "version", "suite")
    bare = protocols.where("version IS NULL").select("component", "path", "suite")
    places = versioned.select("component", "path", "version").distinct()
    given = bare.join(places, ["component", "path"]).select("component", "version", "suite")
    alone = bare.join(places, ["component", "path"], "left_anti").select("component", F.concat(F.lit("?"), "path").alias("version"), "suite")
    every = reduce(DataFrame.unionByName, [versioned.select("component", "version", "suite"), given, alone])
    return every.groupBy("component", "version").agg(F.array_join(F.array_sort(F.collect_set("suite")), ",").alias("suites"))


# --- audit


def broken_links(lines: DataFrame) -> DataFrame:
    """Rows of (log, seq, prev, line) that don't follow from the row before: seq plus one, and its digest."""
    order = W.partitionBy("log").orderBy("seq")
    rows = lines.select("log", "seq", "prev", F.lag("seq").over(order).alias("before"), F.lag("line").over(order).alias("last"))
    good = (F.col("seq") == F.col("before") + 1) & (F.col("prev") == F.sha2("last", 256))
    return rows.where(F.col("before").isNotNull() & ~F.coalesce(good, F.lit(False))).select("log", "seq")


def property_of(props: Column, name: str) -> Column:
    """A property of a JSON object as text, null if it is missing."""
    return F.get_json_object(props, f"$.{name}")


def listener_for(places: DataFrame, listeners: DataFrame) -> DataFrame:
    """(asset_id, listener_id): by an asset's configuration file, else by a file that a listener of its component serves.

    places: (asset_id, component, surface, path); listeners: (listener_id, component, path, served).
    """
    name = F.element_at(F.split("path", "/"), -1)
    by_path = listeners.groupBy("path").agg(F.min("listener_id").alias("by_path"))
    by_file = listeners.groupBy("component", F.col("served").alias("file")).agg(F.min("listener_id").alias("by_file"))
    none = F.lit(None).cast(listeners.schema["listener_id"].dataType)
    configured = places.where(F.col("surface").isin("config", "cloud")).select("asset_id", "path").join(by_path, "path").select("asset_id", "by_path", none.alias("by_file"))
    files = places.select("asset_id", "component", name.alias("file")).distinct()
    presented = files.join(by_file, ["component", "file"], "left").select("asset_id", none.alias("by_path"), "by_file")
    return configured.unionByName(presented).groupBy("asset_id").agg(F.coalesce(F.min("by_path"), F.min("by_file")).alias("listener_id"))


def serving(places: DataFrame, listeners: DataFrame) -> DataFrame:
    """(asset_id, via, file, listener, at): the listener that an asset's configuration sets up ('configured'), else one that refers to its file ('served').

    places and listeners as in listener_for(); at is the listener's own file. Of several listeners the least counts.
    """
    by_path = listeners.groupBy("path").agg(F.min("listener_id").alias("listener_id"))
    configured = places.where(F.col("surface").isin("config", "cloud")).select("asset_id", "path").join(by_path, "path").select("asset_id", F.lit(0).alias("turn"), "listener_id", F.lit(None).cast("string").alias("file"), F.col("path").alias("at"))
    by_file = listeners.groupBy("component", F.col("served").alias("file")).agg(F.min(F.struct("listener_id", F.col("path").alias("at"))).alias("l"))
    files = places.select("asset_id", "component", F.element_at(F.split("path", "/"), -1).alias("file")).distinct()
    presented = files.join(by_file, ["component", "file"]).select("asset_id", F.lit(1).alias("turn"), "l.listener_id", "file", "l.at")
    first = configured.unionByName(presented).groupBy("asset_id").agg(F.min(F.struct("turn", "listener_id", "file", "at")).alias("s"))
    return first.select("asset_id", F.when(F.col("s.turn") == 0, "configured").otherwise("served").alias("via"), "s.file", F.col("s.listener_id").cast("string").alias("listener"), "s.at")
