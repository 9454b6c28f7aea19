"""Keeping an edge table up to date from a stream of files that changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.functions import paths
from orrery.functions.lineage import cut
from orrery.operators.diff import keyed_diff
from orrery.sources import store
from orrery.sources.edges import resolved_edges, source_roots
from orrery.sources.imports import TARGETS, import_targets

#: What is kept between batches: known paths, parsed statements, which paths each file asks for, and the edges.
STATE = {"paths": "path string, lang string", "targets": TARGETS, "asked": "key string, rooted boolean, src string", "edges": "src string, dst string, kind string, pos int"}


def no_files(spark: SparkSession) -> dict[str, DataFrame]:
    return {n: spark.createDataFrame([], s) for n, s in STATE.items()}


def _asked(targets: DataFrame) -> DataFrame:
    """The reverse index: each key that a file's statements may mean, with the file. Uses of modules ask for no path."""
    each = targets.select("src", F.explode("cands").alias("c")).where("c.kind in ('file', 'dir')")
    return each.select(F.col("c.key").alias("key"), F.col("c.rooted").alias("rooted"), "src").distinct()


def _touched(old: dict[str, DataFrame], known: DataFrame) -> DataFrame:
    """``src`` of the files whose statements may mean other paths now that the known paths are ``known(path, lang)``.

    A path that came or went is met by its own name and its directory, under each root of a language for rooted keys. Where
    the roots themselves changed, all rooted statements of the language count, and where the set of Rust's files did, all
    uses of modules.
    """
    was, now = old["paths"].select("path"), known.select("path")
    moved = cut(was.join(now, "path", "left_anti").unionByName(now.join(was, "path", "left_anti")))
    keys = moved.select(F.explode(F.array("path", paths.directory(F.col("path")))).alias("key")).distinct()
    with_dir = lambda t: t.withColumn("dir", paths.directory(F.col("path")))
    before, after = cut(source_roots(with_dir(was)).select("lang", "root")), cut(source_roots(with_dir(now)).select("lang", "root"))
    changed = before.join(after, ["lang", "root"], "left_anti").unionByName(after.join(before, ["lang", "root"], "left_anti")).select("lang").distinct()
    # A handful of prefixes: each is tried on each key that moved.
    roots = before.unionByName(after).select("root").distinct()
    below = keys.join(F.broadcast(roots), F.startswith("key", "root")).select(F.expr("substr(key, length(root) + 1)").alias("key")).unionByName(keys.join(F.broadcast(roots), F.concat("key", F.lit("/")) == F.col("root")).select(F.lit("").alias("key"))).distinct()
    asked = old["asked"]
    met = asked.where("not rooted").join(keys, "key", "left_semi").select("src").unionByName(asked.where("rooted").join(below, "key", "left_semi").select("src"))
    by_root = old["targets"].select("src", "lang").distinct().join(F.broadcast(changed), "lang", "left_semi").select("src").join(asked.where("rooted").select("src"), "src", "left_semi")
    rust = moved.where(F.col("path").endswith(".rs")).limit(1).select(F.lit("rust").alias("lang"))
    uses = old["targets"].where("lang = 'rust' and kind = 'import'").select("src", "lang").join(F.broadcast(rust), "lang", "left_semi").select("src")
    return met.unionByName(by_root).unionByName(uses).distinct()


def advanced(old: dict[str, DataFrame], changes: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The state after files ``changes(path, lang, raw)`` (one row a path; a null text: the file is gone), and which edges
    came and went: ``change, item``.

    Only changed files are parsed. Their statements, and those of other files that ask for a path that came or went, are
    resolved anew; all else stays as it is. Changes that are there already change nothing.
    """
    changes = changes.select("path", "lang", "raw")
    gone = changes.select("path")
    there = changes.where("raw is not null")
    known = cut(old["paths"].join(gone, "path", "left_anti").unionByName(there.select("path", "lang")))
    fresh = cut(import_targets(there))
    of_gone = gone.select(F.col("path").alias("src"))
    targets = old["targets"].join(of_gone, "src", "left_anti").unionByName(fresh)
    asked = old["asked"].join(of_gone, "src", "left_anti").unionByName(_asked(fresh))
    again = cut(_touched(old, known).unionByName(of_gone).distinct())
    found = cut(resolved_edges(targets.join(again, "src", "left_semi"), known)[0].select("src", "dst", "kind", F.col("pos").cast("int").alias("pos")))
    before = old["edges"].join(again, "src", "left_semi")
    report = keyed_diff(before, found, ["src", "dst", "kind"])
    edges = old["edges"].join(again, "src", "left_anti").unionByName(found)
    return {"paths": known, "targets": targets, "asked": asked, "edges": edges}, report


def refresh_edges(changes: DataFrame, folder: str, report: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """For each micro-batch of changed files ``(path, lang, raw, seq)`` (a null text: the file is gone), take the latest
    version of each and report which edges came and went.

    The state is a versioned set of tables in ``folder``, which the driver and the executors share; ``edges_in`` reads the
    edges. A batch that was saved and comes again is passed over; one that was not is reported again with the same number.
    """

    def batch(rows: DataFrame, n: int) -> None:
        kept, _ = store.load_baseline(rows.sparkSession, folder)
        if kept is not None and kept.meta.get("batch", -1) >= n:
            return
        latest = cut(rows.groupBy("path").agg(F.max_by(F.struct("lang", "raw"), "seq").alias("f")).select("path", "f.lang", "f.raw"))
        state, told = advanced(kept.tables if kept is not None else no_files(rows.sparkSession), latest)
        report(told, n)
        store.write_map(store.CodeMapTables(state, {"batch": n}), folder)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edges_in(spark: SparkSession, folder: str) -> DataFrame:
    """``src, dst, kind, pos`` as the last batch left them."""
    return store.load_map(spark, folder)["edges"]


def windowed_activity(events: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Events ``(ts, event_type, value)`` by hour and type, late ones up to a bound: ``start, event_type, n, total``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
