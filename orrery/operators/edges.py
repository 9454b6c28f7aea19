"""Operators on edge tables ``(src, dst, kind)``; none of them gathers a node's edges in one task but to list them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_edges(parsed: DataFrame, asserted: DataFrame) -> DataFrame:
    """Distinct ``src, dst, kind`` with ``source``: ast, llm or both. Repeated rows of one side count once."""
    a = parsed.select("src", "dst", "kind", F.lit(True).alias("a"), F.lit(False).alias("l"))
    b = asserted.select("src", "dst", "kind", F.lit(False).alias("a"), F.lit(True).alias("l"))
    g = a.unionByName(b).groupBy("src", "dst", "kind").agg(F.bool_or("a").alias("a"), F.bool_or("l").alias("l"))
    return g.select("src", "dst", "kind", F.when(F.col("a") & F.col("l"), "both").when(F.col("a"), "ast").otherwise("llm").alias("source"))


def fan_in(edges: DataFrame) -> DataFrame:
    """``dst, n``: distinct importers other than itself."""
    return edges.where("src <> dst").groupBy("dst").agg(F.countDistinct("src").alias("n"))


def top_fan_in(edges: DataFrame, k: int) -> DataFrame:
    return fan_in(edges).orderBy(F.desc("n"), "dst").limit(k)


def file_degree(edges: DataFrame) -> DataFrame:
    """``path, degree``: edge rows at either end; a self-loop counts twice."""
    return edges.select(F.col("src").alias("path")).unionAll(edges.select(F.col("dst").alias("path"))).groupBy("path").agg(F.count("*").alias("degree"))


def neighbor_counts(edges: DataFrame) -> DataFrame:
    """``path, n_out, n_in``: distinct neighbours in either direction, itself included."""
    out = edges.select(F.col("src").alias("path"), F.col("dst").alias("o"), F.lit(None).alias("i"))
    into = edges.select(F.col("dst").alias("path"), F.lit(None).alias("o"), F.col("src").alias("i"))
    return out.unionByName(into).groupBy("path").agg(F.countDistinct("o").alias("n_out"), F.countDistinct("i").alias("n_in"))


def neighbors(merged: DataFrame, path, direction: str = "both") -> DataFrame:
    """``direction, path, kind, source`` of a node's edges, by path and kind."""
    if direction not in ("both", "out", "in"):
        raise ValueError("direction is both, out or in")
    out = merged.where(F.col("src") == path).select(F.lit("out").alias("direction"), F.col("dst").alias("path"), "kind", "source")
    into = merged.where(F.col("dst") == path).select(F.lit("in").alias("direction"), F.col("src").alias("path"), "kind", "source")
    return {"both": out.unionByName(into), "out": out, "in": into}[direction].orderBy("direction", "path", "kind")


def known_paths(*columns: tuple[DataFrame, str]) -> DataFrame:
    """Distinct non-null values of the columns as ``path``."""
    out = None
    for df, c in columns:
        one = df.select(F.col(c).alias("path")).where("path is not null")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def links(parsed: DataFrame, asserted: DataFrame) -> DataFrame:
    """Links for drawing: distinct pairs of the parsed edges, flagged where an asserted edge agrees, and the asserted pairs
    that no parsed edge has; kinds are ignored."""
    a, b = parsed.select("src", "dst").distinct(), asserted.select("src", "dst").distinct()
    agreed = a.join(b.withColumn("corroborated", F.lit(True)), ["src", "dst"], "left")
    only = b.join(a, ["src", "dst"], "left_anti")
    return agreed.select("src", "dst", F.lit("ast").alias("layer"), F.coalesce("corroborated", F.lit(False)).alias("corroborated")).unionByName(only.select("src", "dst", F.lit("llm").alias("layer"), F.lit(False).alias("corroborated")))


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """One node for each ``id``: type of the highest ``rank``, largest ``r``, longest ``description`` (the first of the longest by ``seq``)."""
    return nodes.groupBy("id").agg(
        F.max_by("type", F.struct(F.col("rank"), -F.col("seq"))).alias("type"),
        F.max("r").alias("r"),
        F.max_by("description", F.struct(F.length("description"), -F.col("seq"))).alias("description"),
    )


def directory_edges(edges: DataFrame, collapse, cyclic: Column | None = None) -> DataFrame:
    """Distinct edges between directories, ``cyclic`` if any edge underneath is; edges within one directory go."""
    rows = edges.select(collapse(F.col("src")).alias("src"), collapse(F.col("dst")).alias("dst"), (F.lit(False) if cyclic is None else cyclic).alias("cyclic"))
    return rows.where("src <> dst").groupBy("src", "dst").agg(F.bool_or("cyclic").alias("cyclic"))


def top_directories(rolled: DataFrame, k: int = 40) -> DataFrame:
    """``path, degree, in_cycle`` of the k directories of largest degree; cyclic ones first among equals, then by path."""
    both = rolled.select(F.col("src").alias("path"), "cyclic").unionAll(rolled.select(F.col("dst").alias("path"), "cyclic"))
    return both.groupBy("path").agg(F.count("*").alias("degree"), F.bool_or("cyclic").alias("in_cycle")).orderBy(F.desc("degree"), F.desc("in_cycle"), "path").limit(k)


def prefix_degrees(modules: DataFrame, degrees: DataFrame, separator: str = "/") -> DataFrame:
    """``path, degree``: a module's own degree, else the sum over the files below it.

    Files are joined by each of their ancestors, an equality join; no pair of a module and a file outside of it is made.
    """
    parts = F.split("path", separator)
    below = degrees.select("degree", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))).alias("path")).where(F.col("path") != "") if separator else degrees
    total = below.groupBy("path").agg(F.sum("degree").alias("below"))
    trimmed = modules.select("path", F.regexp_replace("path", f"{separator}+$", "").alias("key"))
    own = degrees.groupBy("path").agg(F.sum("degree").alias("own"))
    j = trimmed.join(own, "path", "left").join(total.withColumnRenamed("path", "key"), "key", "left")
    return j.select("path", F.coalesce("own", "below", F.lit(0)).cast("long").alias("degree"))


def capped_per_directory(rows: DataFrame, directory: str, order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows of each directory, and how many it has in ``n_entries``.

    Counts are combined before their shuffle, and each task passes on its first ``cap`` rows of a directory only (Spark
    limits a ranked window so), so no directory is gathered.
    """
    first = rows.withColumn("position", F.row_number().over(Window.partitionBy(directory).orderBy(*order))).where(F.col("position") <= cap)
    n = rows.groupBy(F.col(directory).alias("_directory")).agg(F.count("*").alias("n_entries"))
    return first.join(n, F.col(directory).eqNullSafe(F.col("_directory"))).drop("_directory")
