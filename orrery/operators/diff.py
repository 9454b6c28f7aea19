"""Keyed differences of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], item: Column | None = None) -> DataFrame:
    """``change`` (added or removed), ``item`` of the keys that one side only has; nulls are equal to nulls."""
    show = item if item is not None else F.concat_ws(" -> ", *keys)
    side = old.select(*keys, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(*keys, F.lit(0).alias("o"), F.lit(1).alias("n")))
    # A fixed number of parts: adaptive execution would put all keys into few tasks, since they are small until they lie in
    # a task's hash tables. It is not the usual number, or this shuffle would be dropped where a side is made by one on keys.
    side = side.repartition(int(side.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, *keys)
    g = side.groupBy(*keys).agg(F.max("o").alias("o"), F.max("n").alias("n")).where("o <> n")
    return g.select(F.when(F.col("n") == 1, "added").otherwise("removed").alias("change"), show.alias("item"))


def _dimensions() -> dict[str, tuple[str, list[str], Column]]:
    """The dimensions of a run: table, keys, and how an item is shown."""
    edge = F.format_string("%s -> %s (%s)", "src", "dst", "kind")
    return {
        "modules": ("modules", ["path"], F.col("path")),
        "import_edges": ("llm_edges", ["src", "dst", "kind"], edge),
        "deterministic_edges": ("ast_edges", ["src", "dst", "kind"], edge),
        "import_cycles": ("cycles", ["members"], F.array_join("members", " -> ")),
        "data_flow": ("data_flow", ["source", "destination"], F.concat_ws(" -> ", "source", "destination")),
        "entry_points": ("entry_points", ["path", "name"], F.concat_ws(" : ", "path", "name")),
        "file_summaries": ("file_summaries", ["path"], F.col("path")),
    }


def diff_runs(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> tuple[DataFrame | None, dict[str, bool]]:
    """``dimension, change, item`` over all dimensions that both runs have, and which were compared.

    A table that is missing (None) on a side is not compared: it was never made, which is not the same as empty.
    """
    out, compared = None, {}
    for name, (table, keys, item) in _dimensions().items():
        a, b = old.get(table), new.get(table)
        compared[name] = a is not None and b is not None
        if not compared[name]:
            continue
        if name == "import_cycles":
            a, b = (x.withColumn("members", F.array_sort(F.array_distinct("nodes"))) for x in (a, b))
        one = keyed_diff(a, b, keys, item).select(F.lit(name).alias("dimension"), "change", "item")
        out = one if out is None else out.unionByName(one)
    return out, compared


def changes_json(diff: DataFrame | None, compared: dict[str, bool], state: str) -> dict:
    """What changed as plain values: ``baseline, compared, all_compared, has_changes, changes`` (by dimension, what was
    added and removed, sorted). Without a diff nothing changed that is known of."""
    rows = [] if diff is None else diff.groupBy("dimension", "change").agg(F.array_sort(F.collect_list("item")).alias("items")).collect()  # two rows for each of seven dimensions
    changes: dict[str, dict[str, list[str]]] = {}
    for r in rows:
        changes.setdefault(r["dimension"], {"added": [], "removed": []})[r["change"]] = list(r["items"])
    return {"baseline": state, "compared": dict(compared), "all_compared": bool(compared) and all(compared.values()), "has_changes": bool(rows), "changes": changes}


def staleness(recorded: Column, head: Column) -> Column:
    """fresh, stale, or unknown where a commit is not known."""
    return F.when(recorded.isNull() | head.isNull(), "unknown").when(recorded == head, "fresh").otherwise("stale")
