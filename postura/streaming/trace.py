"""Live traces with Structured Streaming: parsing, counts, setup suppression, bounded distinct keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

def source(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the trace files that arrive in a folder."""
    return spark.readStream.format("text").load(folder)


def parsed(lines: DataFrame) -> DataFrame:
    """(command, pid, ts, event, value) of well-formed lines; value is the field of that name.

    A line of the kernel's probe events begins with the task, before the processor in brackets:
    its command, a hyphen and the thread, and perhaps its group in parentheses. Behind that stand,
    between colons, flags and the seconds, the event, and its body, which begins with the
    address in parentheses.
    """
    halves = F.split("value", r"\s\[[0-9]+\]\s", 2)
    part = F.split(F.get(halves, 1), ": ", 3)
    head, event, body = F.trim(F.get(part, 0)), F.trim(F.get(part, 1)), F.trim(F.get(part, 2))
    task = F.regexp_replace(F.trim(F.get(halves, 0)), r"\s+\([^()]*\)$", "")
    thread = F.substring_index(task, "-", -1)
    fields = F.filter(F.split(body, r"\s(?=\w+=)"), lambda f: F.startswith(f, F.lit("value=")))
    rows = lines.select(
        F.regexp_replace(task, "-[^-]*$", "").alias("command"), thread.try_cast("long").alias("pid"), F.substring_index(head, " ", -1).try_cast("double").alias("ts"),
        event.alias("event"), F.nullif(F.replace(F.trim(F.substr(F.get(fields, 0), F.lit(7))), F.lit('"'), F.lit("")), F.lit("")).alias("value"),
        (F.rlike(event, F.lit(r"^\w+$")) & F.startswith(body, F.lit("(0x"))).alias("formed"),
    )
    return rows.where("formed and pid is not null and ts is not null").drop("formed")


def known(events: DataFrame, probes: DataFrame) -> DataFrame:
    """The events with their probe's library and function (event, library, function): a stream-static join."""
    return events.join(probes, "event")


def counts(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events by the keys; a running aggregation for output modes update and complete."""
    return events.groupBy(*keys).agg(F.count("*").alias("count"))


def without_setup(events: DataFrame, enter: str, leave: str) -> DataFrame:
    """(pid, event, counted, ignored): per thread, calls outside setups count and those inside don't.

    A thread's state is how many setups it is in; leaving never takes it below zero. Within
    a batch a thread's events are taken by time.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        depth = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        tally: dict[str, list[int]] = {}
        for event in rows["event"]:
            if event == enter:
                depth += 1
            elif event == leave:
                depth = max(0, depth - 1)
            else:
                tally.setdefault(event, [0, 0])[depth > 0] += 1
        state.update((depth,))
        yield pd.DataFrame([(key[0], e, *n) for e, n in tally.items()], columns=["pid", "event", "counted", "ignored"])

    return events.select("pid", "event", "ts").groupBy("pid").applyInPandasWithState(update, "pid long, event string, counted long, ignored long", "depth int", "append", GroupStateTimeout.NoTimeout)


def bounded_distinct(events: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """(key, value, count, dropped): counts of at most so many distinct values a key; the rest is counted as dropped."""

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = list(state.get[0]) if state.exists else []
        seen = set(names)
        tally: dict[str, int] = {}
        dropped = 0
        for rows in batches:
            for v, n in rows["value"].fillna("").value_counts().sort_index().items():
                if v not in seen and len(names) < most:
                    names.append(v)
                    seen.add(v)
                if v in seen:
                    tally[v] = tally.get(v, 0) + int(n)
                else:
                    dropped += int(n)
        state.update((names,))
        rows = [(group[0], v, n, 0) for v, n in tally.items()] + ([(group[0], None, 0, dropped)] if dropped else [])
        yield pd.DataFrame(rows, columns=["key", "value", "count", "dropped"])

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(update, "key string, value string, count long, dropped long", "names array<string>", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that has arrived, then stops; its rows as a table of the session."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def write_counts(events: DataFrame, keys: list[str], path: str, checkpoint: str) -> None:
    """Counts of all that has arrived, replaced as a whole with each batch."""
    sink = lambda batch, _: batch.write.mode("overwrite").json(path)
    counts(events, keys).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
