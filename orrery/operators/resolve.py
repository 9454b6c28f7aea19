"""Joins of import specifiers and user strings with known paths: the first candidate that exists wins."""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.paths import norm_path
from orrery.operators.edges import capped_per_directory
from orrery.operators.find_index import GRAM, grams_of

#: Tables of an index of paths.
PATH_TABLES = ["path_endings", "path_grams"]


def first_candidate(candidates: DataFrame, known: DataFrame, by: str = "id") -> DataFrame:
    """``id, path, prio`` of the candidate ``(id, prio, path)`` of least priority number that is a known path."""
    hit = candidates.join(known.select("path").distinct(), "path")
    return hit.groupBy(by).agg(F.min(F.struct("prio", "path")).alias("m")).select(by, F.col("m.path").alias("path"), F.col("m.prio").alias("prio"))


def unique_in_directory(known: DataFrame, directory: str = "dir") -> DataFrame:
    """``dir, path`` of directories with exactly one known path."""
    return known.groupBy(directory).agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").select(directory, "path")


def _under_roots(names: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """Adds ``lang, key, seq``: each name without each root that it begins with; roots meet the names' beginnings by equality."""
    parts = F.split(column, "/")
    begin = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(i, F.lit(1))), "/"), F.lit("/"))))
    each = names.withColumn("root", F.explode(begin)).join(roots.select("lang", "root", "seq"), "root")
    return each.withColumn("key", F.substring(F.col(column), F.length("root") + 1, F.lit(1 << 30))).drop("root")


def resolve_candidates(targets: DataFrame, known: DataFrame, roots: DataFrame) -> DataFrame:
    """``id, path, n`` for targets whose candidates exist.

    ``targets(id, lang, cands array<struct<prio, kind, key, rooted, ext>>)``: a candidate is a file (``kind`` file: its path
    is the key) or a directory (its files that end in ``ext``, tests of Go left out). Rooted keys are tried under each root
    of the language, the order of candidates before the order of roots; a directory's files are counted over all its roots.
    ``known(path, dir)``, ``roots(lang, root, seq)``. The least priority that exists decides; ``n`` is how many files it has
    (more than one: an ambiguous directory).

    Known paths are taken out of the roots above them, so that candidates meet them by language and key; no candidate meets
    a root that has nothing of its name.
    """
    each = targets.select("id", "lang", F.explode("cands").alias("c")).select("id", "lang", "c.*")
    files, dirs = known.select("path").distinct(), known.select("dir", "path")
    plain, under = each.where("not rooted"), each.where("rooted")
    none = F.lit(0).alias("seq")
    of_dir = F.col("path").endswith(F.col("ext")) & ~F.col("path").endswith("_test.go")
    hits = plain.where("kind = 'file'").join(files.select(F.col("path").alias("key"), "path"), "key").select("id", "prio", none, "path")
    hits = hits.unionByName(plain.where("kind = 'dir'").join(dirs.withColumnRenamed("dir", "key"), "key").where(of_dir).select("id", "prio", none, "path"))
    hits = hits.unionByName(under.where("kind = 'file'").join(_under_roots(files, "path", roots), ["lang", "key"]).select("id", "prio", "seq", "path"))
    hits = hits.unionByName(under.where("kind = 'dir'").join(_under_roots(dirs, "dir", roots), ["lang", "key"]).where(of_dir).select("id", "prio", none, "path"))
    found = hits.groupBy("id", "prio", "seq").agg(F.countDistinct("path").alias("n"), F.min("path").alias("path"))
    return found.groupBy("id").agg(F.min(F.struct("prio", "seq", "n", "path")).alias("m")).select("id", F.col("m.path").alias("path"), F.col("m.n").alias("n"))


def resolve_path(known: DataFrame, query: str, most: int = 20) -> DataFrame:
    """The known paths that a user's string means: ``tier, path``.

    Tiers: 0 the path itself; 1 paths that end in ``/query``; 2 the longest known path that the query ends in; 3 (only if
    the query's last part has no dot) paths that contain it, whatever the case. The first tier that has any decides; it
    must have one path, else its first ``most`` are candidates.
    """
    query = re.sub(r"^(\./)+", "", query.replace("\\", "/"))
    q = F.lit(query)
    p = F.col("path")
    tier = F.when(p == q, 0).when(F.endswith(p, F.concat(F.lit("/"), q)), 1).when(F.endswith(q, F.concat(F.lit("/"), p)), 2)
    if "." not in query.rsplit("/", 1)[-1]:
        tier = tier.when(F.contains(F.lower(p), F.lower(q)), 3)
    hits = known.select("path").distinct().withColumn("tier", tier.otherwise(F.lit(None))).where("tier is not null")
    best = hits.agg(F.min("tier").alias("best"), F.max(F.when(F.col("tier") == 2, F.length("path"))).alias("longest"))
    kept = hits.join(F.broadcast(best), F.col("tier") == F.col("best")).where((F.col("tier") != 2) | (F.length("path") == F.col("longest")))
    return kept.select("tier", "path").orderBy("path").limit(most)


def path_index(known: DataFrame, most: int = 20, keep: Callable[[DataFrame, str], DataFrame] = lambda t, name: t) -> dict[str, DataFrame]:
    """An index of ``known(path)`` for :func:`resolve_paths`, as tables to be written.

    ``path_endings`` has a row for each path and each part of one behind a slash: whether it is a path itself, how many paths
    end so, and the first ``most`` of them; common endings are combined before they are shuffled. ``path_grams`` has the
    paths (in lower case) of each run of one to three letters, and of the empty one.
    """
    paths = known.select("path").where("path is not null").distinct()
    parts = F.split("path", "/")
    each = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("ending"))
    endings = capped_per_directory(each, "ending", ["path"], most).groupBy("ending").agg(F.max("n_entries").alias("n"), F.array_sort(F.collect_list("path")).alias("paths"))
    # A path that is an ending of many others need not be among the first of them.
    whole = paths.select(F.col("path").alias("ending"), F.lit(True).alias("whole"))
    endings = endings.join(whole, "ending", "left").select("ending", F.coalesce("whole", F.lit(False)).alias("whole"), "n", "paths")
    low = F.lower("path")
    grams = paths.select(F.explode(F.concat(F.array(F.lit("")), *(grams_of(low, n) for n in range(1, GRAM + 1)))).alias("gram"), "path")
    # In order, so that a look at one key reads few row groups.
    in_order = lambda t, c: t.repartitionByRange(c).sortWithinPartitions(c)
    return {"path_endings": keep(in_order(endings, "ending"), "path_endings"), "path_grams": keep(in_order(grams, "gram"), "path_grams")}


def resolve_string(index: dict[str, DataFrame], query: str, most: int = 20) -> list[str]:
    """The known paths that one string means, as :func:`resolve_path` gives them: looked up by key, with filters that reach
    the scan, and without a join."""
    q = re.sub(r"^(\./)+", "", query.replace("\\", "/"))
    parts = q.split("/")
    tails = ["/".join(parts[i:]) for i in range(1, len(parts))]
    rows = {r["ending"]: r for r in index["path_endings"].where(F.col("ending").isin(q, *tails)).collect()}  # one row a key
    if q in rows:
        return [q] if rows[q]["whole"] else rows[q]["paths"][:most]
    for tail in tails:  # the longest first
        if tail in rows and rows[tail]["whole"]:
            return [tail]
    if "." in parts[-1]:
        return []
    low = q.lower()
    grams = index["path_grams"].where(F.col("gram") == low[:GRAM]).where(F.contains(F.lower("path"), F.lit(low)))
    return [r["path"] for r in grams.orderBy("path").limit(most).collect()]


def resolve_paths(index: dict[str, DataFrame], queries: DataFrame, most: int = 20) -> DataFrame:
    """What the strings of ``queries(qid, query)`` mean: ``qid, tier, path, candidates``, one row per query.

    The tiers of :func:`resolve_path`; ``path`` is the one known path of the first tier that has any, else null, and
    ``candidates`` then that tier's first ``most`` paths (none where no tier has any; ``tier`` is null then, and for a null
    query). Strings meet endings by equality and, in the last tier only, the paths of their rarest run of letters, so no
    query reads all paths; equal strings are resolved once. ``most`` is at most that of the index.
    """
    asked = queries.select("qid", norm_path(F.col("query")).alias("q"))
    strings = asked.select("q").where("q is not null").distinct()
    endings = index["path_endings"]
    ended = strings.join(endings.withColumnRenamed("ending", "q"), "q").select("q", F.when(F.col("whole"), 0).otherwise(1).alias("tier"), F.when(F.col("whole"), F.array("q")).otherwise(F.col("paths")).alias("paths"), F.when(F.col("whole"), 1).otherwise(F.col("n")).alias("n"))
    rest = strings.join(ended, "q", "left_anti")
    parts = F.split("q", "/")
    tails = rest.select("q", F.explode(F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.size(parts))).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("ending"))
    longer = tails.join(endings.where("whole").select("ending"), "ending").groupBy("q").agg(F.max_by("ending", F.length("ending")).alias("path")).select("q", F.lit(2).alias("tier"), F.array("path").alias("paths"), F.lit(1).alias("n"))
    rest = rest.join(longer, "q", "left_anti").where(~F.contains(F.substring_index("q", "/", -1), F.lit("."))).withColumn("low", F.lower("q"))
    # The rarest of a string's runs of letters; a short string is a run itself.
    runs = rest.select("q", "low", F.explode(F.when(F.length("low") >= GRAM, grams_of(F.col("low"), GRAM)).otherwise(F.array("low"))).alias("gram"))
    grams = index["path_grams"]
    counts = grams.join(runs.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("times"))
    rarest = runs.join(counts, "gram").groupBy("q", "low").agg(F.min(F.struct("times", "gram")).alias("m")).select("q", "low", "m.gram")
    inside = rarest.join(grams, "gram").where(F.contains(F.lower("path"), "low")).select("q", "path")
    first = inside.withColumn("position", F.row_number().over(Window.partitionBy("q").orderBy("path"))).where(F.col("position") <= most)
    held = first.groupBy("q").agg(F.array_sort(F.collect_list("path")).alias("paths")).select("q", F.lit(3).alias("tier"), "paths", F.size("paths").alias("n"))
    found = ended.unionByName(longer).unionByName(held)
    out = asked.join(found, "q", "left")
    one = F.col("n") == 1
    return out.select("qid", "tier", F.when(one, F.get("paths", F.lit(0))).alias("path"), F.when(one | F.col("n").isNull(), F.array().cast("array<string>")).otherwise(F.slice("paths", 1, most)).alias("candidates"))
