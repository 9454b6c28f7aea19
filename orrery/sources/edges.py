"""Import edges between scanned files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import paths
from orrery.operators.resolve import resolve_candidates
from orrery.sources.imports import import_targets

#: Directories that packages live under, by language, and parents under which they do not count.
PYTHON_ROOTS = ["src", "lib", "python"]
MAVEN_ROOTS = ["src/main/java", "src/test/java"]
NOT_UNDER = ["tests", "test", "__tests__", "vendor", "stubs", "stub", "fixtures"]


def source_roots(known: DataFrame) -> DataFrame:
    """``lang, root, seq``: prefixes under which a language's packages are looked up, the shortest first; always the top."""
    p = F.col("path")
    python = known.where(p.endswith("/__init__.py")).select(F.regexp_extract("dir", r"^(.*)/[^/]*$", 1).alias("root")).where(paths.basename(F.col("root")).isin(*PYTHON_ROOTS))
    python = python.where(~F.arrays_overlap(F.split(F.regexp_extract("root", r"^(.*)/[^/]*$", 1), "/"), _strings(NOT_UNDER))).select(F.lit("python").alias("lang"), "root")
    maven = F.regexp_extract("dir", rf"^((?:.*/)?(?:{'|'.join(MAVEN_ROOTS)}))(?:/.*)?$", 1)
    src = F.regexp_extract("dir", r"^((?:[^/]+/)*?src)(?:/.*)?$", 1)
    below = F.regexp_extract("dir", r"^(?:[^/]+/)*?src(?:/([^/]+).*)?$", 1)
    clean = ~F.arrays_overlap(F.split(src, "/"), _strings(NOT_UNDER))
    java = known.where(p.endswith(".java")).select(F.lit("java").alias("lang"), F.when(maven != "", maven).when(clean & ~below.isin("main", "test"), src).alias("root"))
    others = known.select(paths.language(p).alias("lang"), src.alias("root"), clean.alias("clean")).where("lang in ('csharp', 'php') and (clean or lang = 'csharp')").select("lang", "root")
    found = python.unionByName(java).unionByName(others).where("root is not null and root <> ''").distinct().select("lang", F.concat("root", F.lit("/")).alias("root"))
    top = known.sparkSession.createDataFrame([(x, "") for x in sorted(set(paths.LANGUAGES.values()))], "lang string, root string")
    order = Window.partitionBy("lang").orderBy(F.length("root"), "root")
    return top.unionByName(found).distinct().withColumn("seq", F.row_number().over(order) - 1)


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _crates(known: DataFrame) -> DataFrame:
    """``crate, dir`` of Rust's crate roots that own a directory (lib.rs before main.rs)."""
    roots = known.where("path rlike '(^|/)(lib|main)\\\\.rs$'").groupBy("dir").agg(F.min("path").alias("crate"))
    return roots.select("crate", "dir")


def _rust_uses(uses: DataFrame, known: DataFrame) -> DataFrame:
    """``id, path`` of uses ``(id, src, spec)``: the module of that path in the nearest crate above, else its parent."""
    rs = known.where(F.col("path").endswith(".rs"))
    crates = _crates(known)
    own = rs.where("dir = 'bin' or dir like '%/bin'").select(F.col("path").alias("src"), F.col("path").alias("crate"), F.lit(None).cast("string").alias("top"))
    up = F.transform(F.sequence(F.lit(0), F.size(F.split("dir", "/"))), lambda n: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), n), "/"))
    above = rs.where("not (dir = 'bin' or dir like '%/bin')").select(F.col("path").alias("src"), F.explode(F.array_distinct(up)).alias("dir")).join(crates, "dir").groupBy("src").agg(F.max_by(F.struct("crate", "dir"), F.length("dir")).alias("c")).select("src", "c.crate", F.col("c.dir").alias("top"))
    of = above.unionByName(own)
    # A file's module path below its crate's directory; of files with one path the first by name counts.
    prefix = F.when(F.col("top") == "", "").otherwise(F.concat("top", F.lit("/")))
    rel = F.regexp_replace(F.substring("src", F.length(prefix) + 1, F.lit(1 << 30)), r"(/mod)?\.rs$", "")
    module = F.when(F.col("src") == F.col("crate"), "").otherwise(rel)
    modules = of.withColumn("module", module).where(~F.col("module").startswith("bin/"))
    table = modules.groupBy("crate", "module").agg(F.min(F.struct((F.col("src") != F.col("crate")).alias("late"), "src")).alias("m")).select("crate", F.col("module").alias("key"), F.col("m.src").alias("path"))
    segs, cur = F.split("spec", "::"), F.filter(F.split("module", "/"), lambda x: x != "")
    supers = F.aggregate(segs, F.lit(0), lambda n, s: F.when((s == "super") & (n >= 0), n + 1).otherwise(n))
    base = F.when(segs[0] == "crate", F.array().cast("array<string>")).when(segs[0] == "self", cur).when(F.size(cur) >= supers, F.slice(cur, F.lit(1), F.size(cur) - supers))
    tail = F.filter(segs, lambda s: ~s.isin("crate", "self", "super"))
    asked = uses.join(modules.select("src", "crate", "module"), "src").withColumn("full", F.concat(base, tail)).where("full is not null")
    keys = asked.select("id", "src", "crate", F.posexplode(F.array(F.array_join("full", "/"), F.array_join(F.slice("full", F.lit(1), F.greatest(F.size("full") - 1, F.lit(0))), "/"))).alias("prio", "key"))
    hit = keys.join(table, ["crate", "key"]).groupBy("id", "src").agg(F.min_by("path", "prio").alias("path"))
    return hit.where("path <> src").select("id", "path")


def import_edges(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges ``src, dst, kind, pos`` between the files ``(path, lang, raw)``, and ``lang`` of the languages whose edges are
    known to be partial: a statement of a kind that is never resolved, or a directory with several candidates.

    A statement's name that is no module falls back to its package, once.
    """
    return resolved_edges(import_targets(files), files.select("path"))


def resolved_edges(targets: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and partial languages (see :func:`import_edges`) of parsed ``targets`` among the paths ``known(path)``."""
    known = known.select("path", paths.directory(F.col("path")).alias("dir"))
    targets = targets.withColumn("id", F.struct("src", "pos", "tgt"))
    roots = source_roots(known)
    hits = resolve_candidates(targets.select("id", "lang", "cands"), known, roots)
    uses = targets.where("lang = 'rust' and kind = 'import'").select("id", "src", "spec")
    hits = hits.unionByName(_rust_uses(uses, known).withColumn("n", F.lit(1).cast("long")))
    j = targets.drop("cands").join(hits, "id", "left")
    missed = j.where("not fallback and tgt > 0").groupBy("src", "pos").agg(F.bool_or(F.col("path").isNull()).alias("missed"))
    j = j.join(missed, ["src", "pos"], "left")
    found = j.where("path is not null and n = 1 and (not fallback or missed) and not (lang = 'rust' and path = src)")
    edges = found.groupBy("src", F.col("path").alias("dst"), "kind").agg(F.min("pos").alias("pos"))
    partial = j.where("not resolvable or n > 1").select("lang").distinct()
    return edges, partial
