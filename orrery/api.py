"""Building a map of a code base, and asking it."""

from __future__ import annotations

import datetime
import re
import subprocess
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import paths
from orrery.functions.lineage import cut, written
from orrery.operators import diff as diffs
from orrery.operators import edges, find_index, graph, quality, render, resolve, scoring, search
from orrery.sources import store
from orrery.sources.answers import answer_tables, requested_files
from orrery.sources.edges import import_edges
from orrery.sources.skeleton import outline_udf
from orrery.sources.tree import scan

VERSION = "0.1"


@dataclass
class Settings:
    """Limits of a run; the model is a callable from a prompt to an answer, or None for what is parsed alone.

    The scorer adds ``score`` to rows: to ``(path, summary, content)`` how far a summary is borne out by the file (0 to 1),
    and to ``(path, text)`` how central a module or file is (0 to 3). It gets whole tables; ``scoring.batched`` makes one of
    a function of a few rows, whose failures cost their own rows only. A scorer of tables that raises leaves no scores, and
    the run goes on.
    """

    max_files: int = 200
    max_file_chars: int = 4000
    max_prompt_files: int = 80
    max_context: int = 120_000
    include_tests: bool = True
    exclude: tuple[str, ...] = ()
    use_ignore_file: bool = True
    skeleton: bool = True
    parse: bool = True
    cycle_threshold: float = 0.0
    model: Callable[[str], str] | None = None
    scorer: Callable[[DataFrame], DataFrame] | None = None


def git_head(root: str) -> str | None:
    try:
        out = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None
    return out if re.fullmatch(r"[0-9a-f]{40}|[0-9a-f]{64}", out) else None


def _normal(e: DataFrame) -> DataFrame:
    return e.select(paths.norm_path(F.col("src")).alias("src"), paths.norm_path(F.col("dst")).alias("dst"), "kind")


def build_map(spark: SparkSession, root: str, settings: Settings | None = None) -> store.CodeMapTables:
    """Scan a tree, parse its imports, find cycles, and (with a model) ask for descriptions and compare its edges."""
    s = settings or Settings()
    files, listing = scan(spark, root, max_files=s.max_files, include_tests=s.include_tests, exclude=s.exclude, use_ignore_file=s.use_ignore_file)
    files = files.cache()
    tables: dict[str, DataFrame | None] = {"files": files.drop("raw")}
    partial: list[str] = []
    if s.parse:
        found, parts = import_edges(files)
        tables["ast_edges"] = found.select("src", "dst", "kind").cache()
        partial = sorted(r["lang"] for r in parts.collect())
    else:
        tables["ast_edges"] = None
    if s.model:
        shown = render.redacted(files, s.max_file_chars, outline_udf if s.skeleton else None)
        tree = "\n".join(listing.lines)
        first = spark.createDataFrame([(s.model("Name the files to read, as JSON {\"requested_files\": [...]}.\n" + tree),)], "text string")
        wanted = requested_files(first, files, s.max_prompt_files)
        text, _, kept = render.prompt(tree, shown.join(F.broadcast(wanted), "path").select("path", "content", "est_tokens", "seq"), tables["ast_edges"], s.max_context, bool(partial))
        tables |= answer_tables(spark.createDataFrame([(s.model(text),)], "text string"))
        # What the model has seen: these files (at most ``max_prompt_files``), as they were shown.
        seen = shown.where(F.col("path").isin(kept)).select("path", "content") if kept else shown.where("false").select("path", "content")
    base = tables["ast_edges"] if tables["ast_edges"] is not None else tables.get("llm_edges")
    if base is not None:
        norm = _normal(base)
        lines = files.select(F.col("path").alias("node"), F.col("line_count").alias("sloc"))
        tests = files.where(paths.is_test(F.col("path"))).select(F.col("path").alias("node"))
        tables["cycles"] = graph.cycles(norm, lines, tests, s.cycle_threshold)
    meta = {"created_at": datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "commit_sha": git_head(root), "engine_version": VERSION, "partial_languages": partial, "skipped": listing.skipped, "skipped_by": listing.causes}
    if tables.get("llm_edges") is not None and tables["ast_edges"] is not None:
        a, b = _normal(tables["ast_edges"]), _normal(tables["llm_edges"])
        known = list(paths.LANGUAGES)
        meta["faithfulness"] = quality.faithfulness(a, b, F.col("kind").isin(*quality.COMPARABLE) & paths.extension(F.col("src")).isin(*known) & paths.extension(F.col("dst")).isin(*known)).first().asDict()
    if s.scorer and tables.get("llm_edges") is not None:
        _scored(s.scorer, seen, tables, meta)
    return store.CodeMapTables(tables, meta)


def _scored(scorer: Callable[[DataFrame], DataFrame], seen: DataFrame, tables: dict[str, DataFrame | None], meta: dict) -> None:
    """Scores of summaries and roles of modules and files, where there are a scorer and a model's tables.

    A summary is judged by the file's text as the model saw it (``seen``); one of a file that it did not see has no score.
    """
    merged = edges.merge_edges(_normal(tables["ast_edges"]), _normal(tables["llm_edges"])) if tables["ast_edges"] is not None else _normal(tables["llm_edges"])
    degrees = edges.file_degree(merged)
    rows = quality.evidence_rows(tables["file_summaries"], seen)
    judged = scoring.or_none(scorer, rows.where("content is not null"), cut)
    if judged is not None:
        tables["evidence"] = rows.select("path").join(judged, "path", "left")
        meta["evidence"] = quality.evidence(tables["evidence"]).first().asDict()
    role = lambda t: scoring.or_none(scorer, t, cut)
    bounded = lambda t: t.select("path", F.least(F.greatest("score", F.lit(0.0)), F.lit(quality.ROLES)).alias("role"))
    modules = tables["modules"].drop("role", "degree")
    of_modules = role(modules.select("path", F.concat_ws(" ", "path", "name", "description").alias("text")))
    if of_modules is not None:
        tables["modules"] = modules.join(bounded(of_modules), "path", "left").join(edges.prefix_degrees(modules.select("path").distinct(), degrees), "path", "left").select("path", "name", "description", "role", "degree")
    of_files = role(tables["file_summaries"].select("path", F.col("summary").alias("text")))
    if of_files is not None:
        tables["file_importance"] = quality.fused_importance(bounded(of_files).join(degrees, "path", "left").select("path", "role", F.coalesce("degree", F.lit(0)).alias("degree")))


def write_and_diff(spark: SparkSession, m: store.CodeMapTables, folder: str) -> tuple[DataFrame | None, dict[str, bool], str]:
    """Write a map, with an index to search it, over the one in the folder (whose index serves for rows that stay); what changed, which dimensions were compared, and the old map's state."""
    old, state = store.load_baseline(spark, folder, m.meta.get("engine_version"))
    found, compared = diffs.diff_runs(old.tables, m.tables) if old else (None, {})
    if found is not None:
        found = cut(found)  # the old version goes when the new one is there
    corpus = find_corpus(m)
    indexed = old is not None and all(old.has(n) for n in find_index.TABLES)
    m.tables |= find_index.refreshed({n: old[n] for n in find_index.TABLES}, corpus, written) if indexed else find_index.build(corpus, written)
    m.tables |= resolve.path_index(known_of(m, merged_edges(m)), keep=written)
    store.write_map(m, folder)
    return found, compared, state


def merged_edges(t: store.CodeMapTables) -> DataFrame:
    return edges.merge_edges(_normal(t["ast_edges"]), _normal(t["llm_edges"]))


def known_of(t: store.CodeMapTables, merged: DataFrame) -> DataFrame:
    """The paths that a map knows."""
    return edges.known_paths((merged, "src"), (merged, "dst"), (t["modules"], "path"), (t["file_summaries"], "path"), (t["entry_points"], "path"))


def find_corpus(t: store.CodeMapTables) -> DataFrame:
    """What a map has to search in: ``kind, path, text, seq``."""
    corpora = [
        t["quick_reference"].select(F.lit("quick_reference").alias("kind"), F.col("location").alias("path"), F.concat_ws(" ", "query", "location").alias("text")),
        t["modules"].select(F.lit("module").alias("kind"), "path", F.concat_ws(" ", "path", "name", "description").alias("text")),
        t["entry_points"].select(F.lit("entry_point").alias("kind"), "path", F.concat_ws(" ", "path", "name", "description").alias("text")),
        t["file_summaries"].select("path", F.explode_outer("symbols").alias("s")).where("s is not null").select(F.lit("symbol").alias("kind"), "path", F.concat_ws(" ", "s.name", "s.description").alias("text")),
        t["file_summaries"].select(F.lit("file_summary").alias("kind"), "path", F.concat_ws(" ", "path", "summary").alias("text")),
    ]
    # Hits that are alike in score and path come in the order of the tables, then of their texts.
    all_ = None
    for i, c in enumerate(corpora):
        c = c.withColumn("seq", F.struct(F.lit(i).alias("table"), "text"))
        all_ = c if all_ is None else all_.unionByName(c)
    return all_


class CodeMap:
    """Questions to a map."""

    def __init__(self, tables: store.CodeMapTables):
        self.t = tables
        self.edges = merged_edges(tables).cache()
        self.known = known_of(tables, self.edges)

    def _hits(self, path: str, most: int = 20) -> list[str]:
        if all(self.t.has(n) for n in resolve.PATH_TABLES):
            return resolve.resolve_string({n: self.t[n] for n in resolve.PATH_TABLES}, path, most)
        return [r["path"] for r in resolve.resolve_path(self.known, path, most).collect()]

    def resolve(self, path: str) -> str | None:
        hits = self._hits(path, 2)
        return hits[0] if len(hits) == 1 else None

    def resolve_many(self, queries: DataFrame) -> DataFrame:
        """What the strings of ``queries(qid, query)`` mean, in one job (see ``resolve.resolve_paths``)."""
        index = {n: self.t[n] for n in resolve.PATH_TABLES} if all(self.t.has(n) for n in resolve.PATH_TABLES) else resolve.path_index(self.known)
        return resolve.resolve_paths(index, queries)

    def candidates(self, path: str) -> list[str]:
        return self._hits(path)

    def lookup(self, path: str) -> dict:
        """Whether a path means one known path, and which; else what it may have meant."""
        names = self.candidates(path)
        if len(names) == 1:
            return {"found": True, "query": path, "path": names[0]}
        hint = "Several paths match; name one of them." if names else "No known path matches; try find."
        return {"found": False, "query": path, "candidates": names, "hint": hint}

    def overview(self) -> DataFrame:
        """One row of counts; null for a table that was not made. Cycles of tests only count apart."""
        out = self.edges.agg(F.count("*").alias("edges"), F.count_if(F.col("source") == "both").alias("confirmed"))
        for name in ("modules", "file_summaries", "entry_points", "cycles", "quick_reference", "data_flow", "db_tables", "tests", "notes"):
            one = self.t[name].agg(F.count("*").alias(name), *([F.count_if("test_only").alias("test_cycles")] if name == "cycles" else []))
            if not self.t.has(name):
                one = one.select(*(F.lit(None).cast("long").alias(c) for c in one.columns))
            out = out.join(one, F.lit(True))  # rows of one each
        return out

    def top_fan_in(self, k: int = 10) -> DataFrame:
        return edges.top_fan_in(self.edges, k)

    def neighbors(self, path: str, direction: str = "both") -> DataFrame:
        return edges.neighbors(self.edges, self.resolve(path), direction)

    def dependents(self, path: str, transitive: bool = False, limit: int = 200) -> tuple[DataFrame, bool]:
        return graph.dependents(self.edges, self.resolve(path), transitive, limit)

    def module(self, path: str) -> dict[str, DataFrame]:
        """What is known of one path."""
        p = self.resolve(path)
        at = F.col("path") == p
        return {
            "degrees": edges.neighbor_counts(self.edges).where(at), "module": self.t["modules"].where(at), "summary": self.t["file_summaries"].where(at), "entry_points": self.t["entry_points"].where(at), "neighbors": edges.neighbors(self.edges, p),
            "quick_reference": self.t["quick_reference"].where(F.split_part("location", F.lit(":"), F.lit(1)) == p), "cycles": self.t["cycles"].where(F.array_contains("nodes", F.lit(p))) if p else self.t["cycles"].where("false"),
        }

    def cycles(self) -> DataFrame:
        return self.t["cycles"].withColumn("risk_score", F.bround("risk_score", 2)).orderBy(F.desc("risk_score"), "nodes")

    def entry_points(self) -> DataFrame:
        return self.t["entry_points"].orderBy("path", "name")

    def importance(self, limit: int = 40) -> DataFrame:
        """Files by falling importance, where a scorer was asked."""
        return self.t["file_importance"].orderBy(F.desc("fused"), "path").limit(limit)

    def _index(self) -> dict[str, DataFrame]:
        """The index that was written with the map; a map that was not written has none and makes one."""
        if all(self.t.has(n) for n in find_index.TABLES):
            return {n: self.t[n] for n in find_index.TABLES}
        return find_index.build(find_corpus(self.t))

    def find(self, query: str, limit: int = 20) -> DataFrame:
        """``kind, path, score`` of the best hits: from postings where the map was written with an index, else from texts."""
        if not self.t.has("find_postings"):
            return search.find(find_corpus(self.t), query, limit)
        asked = self.edges.sparkSession.createDataFrame([(0, query)], "qid int, question string")
        return find_index.find_many(self._index(), asked, limit).orderBy("position").select("kind", "path", "score")

    def find_many(self, questions: DataFrame, limit: int = 20) -> DataFrame:
        """The best hits of each of ``questions(qid, question)``, in one job (see ``find_index.find_many``)."""
        return find_index.find_many(self._index(), questions, limit)

    def count_hits(self, query: str) -> int:
        """How many hits there are without a limit."""
        if not self.t.has("find_postings"):
            return search.hits(find_corpus(self.t), query).count()
        asked = self.edges.sparkSession.createDataFrame([(0, query)], "qid int, question string")
        return find_index.hits_many(self._index(), asked).count()

    def semantic_find(self, query: str, scorer: Callable[[DataFrame], DataFrame] | None, limit: int = 10) -> DataFrame:
        """Ranked by a scorer that adds ``score`` to ``(path, text, query)``; without one, by words."""
        if scorer is None:
            return self.find(query, limit).select("path", "score")
        corpus = self.t["file_summaries"].select("path", F.col("summary").alias("text")) if self.t.has("file_summaries") else self.t["modules"].select("path", F.col("description").alias("text"))
        return search.semantic_rank(corpus.withColumn("query", F.lit(query)), scorer, limit).withColumn("score", F.bround("score", 3))

    def staleness(self, root: str) -> str:
        a, b = self.t.meta.get("commit_sha"), git_head(root)
        return "unknown" if a is None or b is None else "fresh" if a == b else "stale"
