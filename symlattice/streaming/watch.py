"""Debounced rebuilds from a stream of file events."""

from __future__ import annotations

import contextlib
import json
import os
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from symlattice.functions.paths import tracked
from symlattice.sources.tree import ignore_rules, ignored, walk

QUICK_FILES, QUICK_MS, FULL_MS = 2, 300, 2000
BATCH = StructType([StructField("root", StringType()), StructField("n_paths", LongType()), StructField("first_ms", LongType()), StructField("flush_ms", LongType())])


def should_flush(n_paths: Column, elapsed_ms: Column) -> Column:
    """Whether a batch of changed paths is due: a few paths after a short wait, any number after a long one, none never."""
    return (n_paths > 0) & ((elapsed_ms >= FULL_MS) | ((n_paths <= QUICK_FILES) & (elapsed_ms >= QUICK_MS)))


def owner(path: Column, roots: list[str], ignores: dict[str, list[tuple[str, bool]]] | None = None) -> Column:
    """(root, rel) of the first of ``roots`` that holds an absolute path and would have it in its graph; null for others.

    The folders above the path are looked up in the list (a project's), so this is one expression, on streams too.
    ``ignores`` has the rules of each root's own ignore file.
    """
    if not roots:
        return F.lit(None).cast("struct<seq: int, root: string, rel: string>")
    clean = [r.rstrip("/") for r in roots]
    seqs = F.create_map(*[F.lit(x) for i, r in reversed(list(enumerate(dict.fromkeys(clean)))) for x in (r, i)])
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    found = F.transform(above, lambda d: F.struct(F.try_element_at(seqs, d).alias("seq"), d.alias("root"), F.substring(path, F.length(d) + 2, F.length(path)).alias("rel")))

    def wanted(x: Column) -> Column:
        out = x.seq.isNotNull() & tracked(x.rel)
        for root, rules in (ignores or {}).items():
            out = out & ((x.root != root.rstrip("/")) | ~ignored(x.rel, rules))
        return out

    return F.when(F.size(parts) > 1, F.array_min(F.filter(found, wanted)))


def attribute(events: DataFrame, roots: list[str], ignores: dict[str, list[tuple[str, bool]]] | None = None) -> DataFrame:
    """Events (path, ...) with root and the path from there; those that no root wants are left out."""
    named = events.withColumn("owner", owner(F.col("path"), roots, ignores)).where("owner is not null")
    return named.withColumn("path", F.col("owner.rel")).withColumn("root", F.col("owner.root")).drop("owner")


def root_ignores(roots: list[str]) -> dict[str, list[tuple[str, bool]]]:
    """The rules of the ignore file right in each root, for those that have one."""
    out = {}
    for root in roots:
        with contextlib.suppress(OSError), open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as file:
            out[root] = ignore_rules("", file.read())
    return out


def debounce_pass(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of events (root, path, ms), which come sorted: a root's first event opens one; it is flushed after the
    short wait if few paths came by then, else after the long one. Only the open batch's paths are held."""
    root, open_at, due, paths = None, None, 0, set()
    columns = [f.name for f in BATCH.fields]
    for part in batches:
        out = []
        for of, path, ms in zip(part["root"], part["path"], part["ms"], strict=True):
            if open_at is not None and (of != root or ms >= due):
                out.append((root, len(paths), open_at, due))
                open_at = None
            if open_at is None:
                root, open_at, paths, due = of, ms, set(), ms + QUICK_MS
            paths.add(path)
            if len(paths) > QUICK_FILES:
                due = open_at + FULL_MS
        yield pd.DataFrame(out, columns=columns)
    if open_at is not None:
        yield pd.DataFrame([(root, len(paths), open_at, due)], columns=columns)


def debounce_batches(events: DataFrame) -> DataFrame:
    """(root, n_paths, first_ms, flush_ms) of a bounded table of events (root, path, ms): a fold over each root's events in
    time order. A root's events pass through one task as a sorted stream, however many they are."""
    ordered = events.select("root", "path", "ms").repartition("root").sortWithinPartitions("root", "ms", "path")
    return ordered.mapInPandas(debounce_pass, BATCH)


class Debouncer(StatefulProcessor):
    """Per root the paths pending and the time of the first; a processing-time timer flushes them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", StructType([StructField("first_ms", LongType()), StructField("paths", StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        first, paths = (self.pending.get()[0], set(json.loads(self.pending.get()[1]))) if self.pending.exists() else (now, set())
        for pdf in rows:
            paths.update(pdf.path)
        self.pending.update((first, json.dumps(sorted(paths))))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = first + (QUICK_MS if len(paths) <= QUICK_FILES else FULL_MS)
        self.handle.registerTimer(max(due, now + 1))
        yield pd.DataFrame(columns=[f.name for f in BATCH.fields])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            first, paths = self.pending.get()
            self.pending.clear()
            yield pd.DataFrame([(key[0], len(json.loads(paths)), first, expiredTimerInfo.getExpiryTimeInMs())], columns=[f.name for f in BATCH.fields])

    def close(self) -> None:
        pass


def debounced(events: DataFrame) -> DataFrame:
    """Streaming (root, n_paths, first_ms, flush_ms) of a stream of events (root, path): one row for each rebuild that is due."""
    return events.groupBy("root").transformWithStateInPandas(Debouncer(), BATCH, "Append", "ProcessingTime")


class _TreeReader(SimpleDataSourceStreamReader):
    """Changes of trees between two looks at them. An offset is the number of looks."""

    def __init__(self, roots: list[str]):
        self.roots = roots
        self.seen = self._look()

    def _look(self) -> dict[str, tuple[int, int]]:
        return {f"{root}/{rel}": (at, size) for root in self.roots for rel, at, size in walk(root)}

    def initialOffset(self) -> dict:
        return {"looks": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now, before = self._look(), self.seen
        self.seen = now
        changed = sorted(p for p in now.keys() | before.keys() if now.get(p) != before.get(p))
        return iter([(p,) for p in changed]), {"looks": start["looks"] + bool(changed)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        # after a restart it isn't known what changed: one event a root, for a build that looks for itself; a batch of timers alone has none
        return iter([(f"{root}/restart.py",) for root in self.roots] if start != end else [])


class FileEvents(DataSource):
    """Stream source ``file_events``: (path) of files made, changed or removed below the folders of option ``roots`` (a JSON list).

    Folders are looked at for every micro-batch; ones that can't be read are passed over, and what lies beside them isn't.
    """

    @classmethod
    def name(cls) -> str:
        return "file_events"

    def schema(self) -> str:
        return "path string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _TreeReader(json.loads(self.options["roots"]))


def file_events(spark: SparkSession, roots: list[str]) -> DataFrame:
    """A stream of (path) of what changes below folders of this machine."""
    spark.dataSource.register(FileEvents)
    return spark.readStream.format("file_events").option("roots", json.dumps(roots)).load()


def watch(events: DataFrame, rebuild: Callable[[str], None], checkpoint: str, interval: str = "100 milliseconds", report: Callable[[str], None] = print) -> StreamingQuery:
    """Start a query that calls ``rebuild(root)`` for every batch of events (root, path) that is due. A rebuild that fails is reported, and watching goes on."""

    def each(batch: DataFrame, _: int) -> None:
        for row in batch.groupBy("root").agg(F.sum("n_paths").alias("n")).collect():  # the roots that are watched
            report(f"↻ {row.n} file{'' if row.n == 1 else 's'} changed in {os.path.basename(row.root)} → ensure")
            try:
                rebuild(row.root)
            except Exception as error:  # noqa: BLE001  the next change is another chance
                report(f"ensure failed: {error}")

    return debounced(events).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def watch_trees(spark: SparkSession, roots: list[str], rebuild: Callable[[str], None], checkpoint: str, interval: str = "100 milliseconds", report: Callable[[str], None] = print) -> StreamingQuery:
    """Watch folders of this machine: each batch of changes to files that belong into a root's graph calls ``rebuild(root)``."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    named = attribute(file_events(spark, roots), roots, root_ignores(roots))
    for root in roots:
        report(f"watching {root} for changes")
    return watch(named.select("root", "path"), rebuild, checkpoint, interval, report)
