"""Source trees as a data source: names are listed, pruned, ranked and cut first; only what is left is read.

Spark's file sources hide names that begin with ``_`` or ``.``, so ``__init__.py`` would be lost; this source lists by
itself. The tree must be in a folder that the driver and the executors share.
"""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, Not, StringContains, StringStartsWith

from orrery.functions import paths, text
from orrery.functions.lineage import cut

SCHEMA = "path string, size long, content string"
IGNORE_FILE = ".orreryignore"


def ignore_patterns(root: str) -> list[str]:
    """One pattern a line; blank lines and comments are skipped, a slash at the end goes. A link out of the tree is not followed."""
    at = os.path.join(root, IGNORE_FILE)
    if os.path.islink(at) and not os.path.realpath(at).startswith(os.path.realpath(root) + os.sep):
        return []
    try:
        with open(at, encoding="utf-8", errors="replace") as f:
            return [x.rstrip("/") for x in (line.strip() for line in f) if x and not x.startswith("#")]
    except OSError:
        return []


@dataclass
class Listing:
    """What a listing found: ``lines`` of the tree, how many entries were left out, and of them how many for which cause."""

    lines: list[str] = field(default_factory=list)
    skipped: int = 0
    causes: dict[str, int] = field(default_factory=dict)


def _excluded(path: str, patterns: list[str]) -> bool:
    parts = path.split("/")
    return any((path == p or ("/" not in p and p in parts)) if not any(c in p for c in "*?[") else fnmatch.fnmatchcase(path, p) or any(fnmatch.fnmatchcase(x, p) for x in parts) for p in patterns)


@dataclass
class Folders(InputPartition):
    """Directories of one task; ``deep`` says whether it goes on into those within."""

    names: list[str]
    deep: bool


class Lister(DataSourceReader):
    """Lists a tree in tasks. Filters on ``path`` decide about rows, and about directories that no row can come from.

    Levels from the root are opened until there are ``width`` directories, or as many were opened; those that were opened
    are listed by tasks, and those that were not are walked by tasks, each with all that is under them.
    """

    def __init__(self, options):
        self.root = options["path"]
        self.globs = json.loads(options.get("globs", "[]"))
        self.width = int(options.get("width", "64"))
        self.filters: list[Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            g = f.child if isinstance(f, Not) else f
            if isinstance(g, (EqualTo, In, StringContains, StringStartsWith)) and g.attribute == ("path",):
                self.filters.append(f)
            else:
                yield f

    def holds(self, path: str) -> bool:
        return all(_holds(f, path) for f in self.filters)

    def entered(self, rel: str) -> bool:
        """Whether rows can come from a directory; checkouts within the tree are not entered."""
        under = rel + "/"
        return all(_may_hold_under(f, under) for f in self.filters) and not _excluded(rel, self.globs) and not os.path.exists(os.path.join(self.root, rel, ".git"))

    def entries(self, rel: str) -> Iterator[tuple[str, os.DirEntry]]:
        try:
            with os.scandir(os.path.join(self.root, rel)) as found:
                for e in found:
                    p = f"{rel}/{e.name}" if rel else e.name
                    if not any("\ud800" <= c <= "\udfff" for c in p):
                        yield p, e
        except OSError:
            return

    def partitions(self):
        opened, level = [], [""]
        while level and len(level) < self.width and len(opened) + len(level) <= self.width:
            opened += level
            level = [p for d in level for p, e in self.entries(d) if e.is_dir(follow_symlinks=False) and self.entered(p)]
        level.sort()
        return [Folders(opened, False), *(Folders(level[i :: self.width], True) for i in range(min(self.width, len(level))))]

    def read(self, partition):
        base, todo = os.path.realpath(self.root), list(partition.names)
        while todo:
            for p, e in self.entries(todo.pop()):
                try:
                    row = self.row(base, p, e)
                except OSError:
                    continue  # gone meanwhile
                if row and self.holds(p):
                    yield row
                if row and row[2] and partition.deep and self.entered(p):
                    todo.append(p)

    def row(self, base: str, p: str, e: os.DirEntry) -> tuple | None:
        if e.is_symlink():
            real = os.path.realpath(e.path)
            inside = real.startswith(base + os.sep) and os.path.isfile(real)
            return p, e.name, False, os.stat(real).st_size if inside else None, os.path.relpath(real, base) if inside else None
        if e.is_dir(follow_symlinks=False):
            return p, e.name, True, None, p
        return (p, e.name, False, e.stat().st_size, p) if e.is_file() else None


def _holds(f: Filter, path: str) -> bool:
    if isinstance(f, Not):
        return not _holds(f.child, path)
    if isinstance(f, EqualTo):
        return path == f.value
    if isinstance(f, In):
        return path in f.value
    return f.value in path if isinstance(f, StringContains) else path.startswith(f.value)


def _may_hold_under(f: Filter, under: str) -> bool:
    """Whether a path that begins with ``under`` can meet a filter."""
    if isinstance(f, Not):
        g = f.child
        return not (isinstance(g, StringContains) and g.value in under or isinstance(g, StringStartsWith) and under.startswith(g.value))
    if isinstance(f, (EqualTo, In)):
        return any(v is not None and v.startswith(under) for v in (f.value if isinstance(f, In) else [f.value]))
    return isinstance(f, StringContains) or under.startswith(f.value) or f.value.startswith(under)


class ListingSource(DataSource):
    """``spark.read.format("srclist").option("path", root)``: a row for each directory, file and link of a tree.

    ``size`` is null for directories; ``target`` is the path that a link leads to, null for links to directories, to what is
    not there and out of the tree. Links and checkouts within are not entered; names that are not UTF-8 are left out. With
    ``globs`` (a JSON list), directories that match one are not entered either.
    """

    @classmethod
    def name(cls):
        return "srclist"

    def schema(self):
        return "path string, name string, dir boolean, size long, target string"

    def reader(self, schema):
        return Lister(self.options)


def register(spark: SparkSession) -> None:
    """Make the sources known; filters reach the listing, which needs a setting of the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    spark.dataSource.register(ListingSource)


def listed(spark: SparkSession, root: str, patterns: list[str]) -> DataFrame:
    """The entries of a tree, without what is under excluded directories (which are not opened); excluded entries are there.

    Names, paths and endings (``*.x``) become filters that the source takes; it gets other globs as an option.
    """
    register(spark)
    is_glob = lambda x: any(c in x for c in "*?[")
    ending = lambda x: x[:1] == "*" and "/" not in x and not is_glob(x[1:])
    out = spark.read.format("srclist").option("path", root).option("globs", json.dumps([x for x in patterns if is_glob(x) and not ending(x)])).load()
    p, wanted = F.col("path"), F.lit(True)
    for x in patterns:
        if ending(x):
            wanted &= ~p.contains(x[1:] + "/")
        elif not is_glob(x):
            wanted &= ~p.startswith(x + "/")
            if "/" not in x:
                wanted &= ~p.contains(f"/{x}/")
    return out.where(wanted)


def tree_lines(entries: DataFrame, per_dir: int) -> list[str]:
    """An indented tree of ``entries(path, name, dir)``: directories first, by name, at most ``per_dir`` of a directory and 25 times that in all."""
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rows = entries.select("path", "name", "dir", parent.alias("parent"))
    rank = Window.partitionBy("parent").orderBy(F.col("dir").desc(), "name")
    parts = F.split("path", "/")
    above = F.filter(F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i), "/")), lambda x: x != "")
    few = rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= per_dir)
    # A directory that is not drawn itself is one that ``few`` lacks; nothing under it is drawn.
    own = few.select("path", "name", "dir", F.size(parts).alias("depth"), above.alias("above"), F.when(F.col("dir"), F.concat("name", F.lit("/"))).otherwise(F.col("name")).alias("line"), F.lit(False).alias("more"))
    full = rows.groupBy("parent").agg(F.count("*").alias("n")).where(F.col("n") > per_dir)
    inner = F.when(F.col("parent") == "", F.array().cast("array<string>")).otherwise(F.split("parent", "/"))
    more = full.select(F.col("parent").alias("path"), F.lit("").alias("name"), F.lit(False).alias("dir"), (F.size(inner) + 1).alias("depth"), F.transform(inner, lambda _, i: F.array_join(F.slice(inner, 1, i + 1), "/")).alias("above"), F.concat(F.lit("("), F.col("n") - per_dir, F.lit(" more)")).alias("line"), F.lit(True).alias("more"))
    all_ = own.unionByName(more)
    needs = all_.select("path", "more", F.explode("above").alias("up"))
    hidden = needs.join(few.where("dir").select(F.col("path").alias("up")), "up", "left_anti").select("path", "more").distinct()
    # Directories sort before files, and what is left of a directory comes last: 0, 1 and 2 before the names of its entries.
    names = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/"))
    kinds = F.transform(names, lambda x, i: F.struct(F.when((i + 1 == F.size(names)) & ~F.col("dir") & ~F.col("more"), 1).otherwise(0).alias("kind"), x.alias("name")))
    key = F.when(F.col("more"), F.concat(kinds, F.array(F.struct(F.lit(2).alias("kind"), F.lit("").alias("name"))))).otherwise(kinds)
    drawn = all_.join(hidden, ["path", "more"], "left_anti").select(key.alias("key"), "depth", "line").orderBy("key").limit(25 * per_dir)
    return ["  " * (r["depth"] - 1) + r["line"] for r in drawn.collect()]


@dataclass
class Batch(InputPartition):
    names: list[str]


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.names = [x for x in options.get("names", "").split("\0") if x]
        self.batch = int(options.get("batch", "64"))

    def partitions(self):
        return [Batch(self.names[i : i + self.batch]) for i in range(0, len(self.names), self.batch)] or [Batch([])]

    def read(self, partition):
        for name in partition.names:
            try:
                with open(os.path.join(self.root, name), "rb") as f:
                    raw = f.read()
            except OSError:
                continue
            yield name, len(raw), raw.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


class TreeSource(DataSource):
    """``spark.read.format("srctree").option("path", root).option("names", ...)``."""

    @classmethod
    def name(cls):
        return "srctree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)


def scan(spark: SparkSession, root: str, *, max_files: int = 200, include_tests: bool = True, exclude: tuple[str, ...] = (), use_ignore_file: bool = True, per_dir: int = 200) -> tuple[DataFrame, Listing]:
    """The files of a tree that are worth reading: ``path, lang, rank, scan_pos, size, raw, est_tokens, line_count``.

    Binary, sensitive and excluded names are never opened, nor are links to such files; excluded directories are not listed.
    The first ``max_files`` by rank and path are read. Names stay on Spark: the driver gets those that are chosen, and the
    lines that are drawn. What was left out is counted by cause along with the choice, which takes no job of its own:
    ``excluded`` (files), ``link``, ``binary``, ``sensitive``, ``test``, ``over_limit``.
    """
    patterns = [*paths.ALWAYS_EXCLUDED, *exclude, *(ignore_patterns(root) if use_ignore_file else [])]
    p, target = F.col("path"), F.col("target")
    cause = (
        F.when(paths.excluded(p, patterns), F.when(~F.col("dir"), "excluded").otherwise("excluded_dir"))
        .when(target.isNull() | paths.excluded(target, patterns), "link")
        .when(F.col("dir"), "dir")
        .when(paths.is_binary(p) | paths.is_binary(target), "binary")
        .when(paths.is_sensitive(p) | paths.is_sensitive(target), "sensitive")
        .when(~F.lit(include_tests) & paths.is_test(p), "test")
        .otherwise("kept")
    )
    entries = cut(listed(spark, root, patterns).withColumn("cause", cause))
    seen = Observation()
    of = lambda x: F.count_if(F.col("cause") == x).alias(x)
    counted = entries.observe(seen, *map(of, ["excluded", "link", "binary", "sensitive", "test", "kept"]))
    kept = counted.where("cause = 'kept'").select("path", paths.priority(p).alias("rank"))
    chosen = kept.orderBy("rank", "path").limit(max_files).collect()  # names only, at most max_files
    causes = dict(seen.get)
    causes["over_limit"] = causes.pop("kept") - len(chosen)
    listing = Listing(tree_lines(entries.where("cause not in ('excluded', 'excluded_dir', 'link')"), per_dir), sum(causes.values()), causes)
    files = spark.read.format("srctree").option("path", root).option("names", "\0".join(r["path"] for r in chosen)).load()
    order = spark.createDataFrame([(r["path"], r["rank"], i) for i, r in enumerate(chosen)] or [("", 0, 0)], "path string, rank int, scan_pos int")
    out = files.join(F.broadcast(order), "path")
    return out.select("path", paths.language(p).alias("lang"), "rank", "scan_pos", "size", F.col("content").alias("raw"), text.token_estimate(F.col("content")).alias("est_tokens"), text.line_count(F.col("content")).alias("line_count")), listing
