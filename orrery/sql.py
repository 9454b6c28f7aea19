"""Questions to a map in SQL: temporary views of its tables, and table functions over them.

``SELECT * FROM dependents('app/x.py', true)``. Arguments are constants; tables of questions or strings go to
``CodeMap.find_many`` and ``CodeMap.resolve_many``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from orrery.api import find_corpus, known_of, merged_edges
from orrery.functions.lineage import cut, written
from orrery.operators import find_index, resolve
from orrery.operators.search import BONUS, STOP_WORDS, WHITE
from orrery.sources import store

_Q = "regexp_replace(replace(q, '\\\\', '/'), '^([.]/)+', '')"


def _words(text: str) -> str:
    """SQL for the words of a question."""
    return f"filter(split(translate(lower({text}), '{WHITE}?', '{' ' * (len(WHITE) + 1)}'), ' '), w -> w <> '')"


def _functions(v: str, meta: dict) -> list[str]:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    bonus = " ".join(f"WHEN '{k}' THEN {n}" for k, n in BONUS.items())
    commit = meta.get("commit_sha")
    own = f"'{commit}'" if commit else "CAST(NULL AS STRING)"
    tails = f"transform(sequence(2, greatest(size(split({_Q}, '/')), 2)), i -> array_join(slice(split({_Q}, '/'), i, size(split({_Q}, '/'))), '/'))"
    return [
        # The one path that a string means, as resolve.resolve_path has it; null where it means none or several.
        f"""known_path(q STRING) RETURNS STRING RETURN CASE
            WHEN EXISTS (SELECT 1 FROM {v}path_endings e WHERE e.ending = {_Q}) THEN (SELECT max(CASE WHEN e.whole THEN e.ending WHEN e.n = 1 THEN e.paths[0] END) FROM {v}path_endings e WHERE e.ending = {_Q})
            WHEN EXISTS (SELECT 1 FROM {v}path_endings e WHERE e.whole AND array_contains({tails}, e.ending)) THEN (SELECT max_by(e.ending, length(e.ending)) FROM {v}path_endings e WHERE e.whole AND array_contains({tails}, e.ending))
            WHEN NOT contains(substring_index({_Q}, '/', -1), '.') THEN (SELECT CASE WHEN count(*) = 1 THEN max(g.path) END FROM {v}path_grams g WHERE g.gram = substring(lower({_Q}), 1, {resolve.GRAM}) AND contains(lower(g.path), lower({_Q}))) END""",
        f"""overview() RETURNS TABLE(what STRING, n BIGINT) RETURN SELECT 'edges', count(*) FROM {v}edges UNION ALL SELECT 'confirmed', count_if(source = 'both') FROM {v}edges
            UNION ALL SELECT 'modules', count(*) FROM {v}modules UNION ALL SELECT 'file_summaries', count(*) FROM {v}file_summaries UNION ALL SELECT 'entry_points', count(*) FROM {v}entry_points
            UNION ALL SELECT 'production_cycles', count_if(NOT test_only) FROM {v}cycles UNION ALL SELECT 'test_cycles', count_if(test_only) FROM {v}cycles UNION ALL SELECT 'quick_reference', count(*) FROM {v}quick_reference""",
        f"""module(path STRING) RETURNS TABLE(known STRING, name STRING, description STRING, summary STRING, imports BIGINT, imported_by BIGINT, cycles BIGINT) RETURN
            SELECT k.p, (SELECT max(m.name) FROM {v}modules m WHERE m.path = k.p), (SELECT max(m.description) FROM {v}modules m WHERE m.path = k.p), (SELECT max(s.summary) FROM {v}file_summaries s WHERE s.path = k.p),
            (SELECT count(DISTINCT e.dst) FROM {v}edges e WHERE e.src = k.p), (SELECT count(DISTINCT e.src) FROM {v}edges e WHERE e.dst = k.p), (SELECT count(*) FROM {v}cycle_nodes c WHERE c.node = k.p) FROM (SELECT known_path(module.path) AS p) k WHERE k.p IS NOT NULL""",
        f"""neighbors(path STRING, way STRING DEFAULT 'both') RETURNS TABLE(direction STRING, other STRING, kind STRING, source STRING) RETURN
            SELECT 'out', dst, kind, source FROM {v}edges WHERE src = known_path(neighbors.path) AND way IN ('both', 'out') UNION ALL SELECT 'in', src, kind, source FROM {v}edges WHERE dst = known_path(neighbors.path) AND way IN ('both', 'in')""",
        # A level for each edge of distance; a node as far as the last level may have others behind it.
        f"""dependents(path STRING, transitive BOOLEAN DEFAULT false, deepest INT DEFAULT 20) RETURNS TABLE(other STRING, distance INT) RETURN
            WITH RECURSIVE walk(node, d) AS (SELECT DISTINCT src, 1 FROM {v}edges WHERE dst = known_path(dependents.path)
            UNION ALL SELECT DISTINCT e.src, w.d + 1 FROM walk w JOIN {v}edges e ON e.dst = w.node WHERE transitive AND w.d < deepest),
            near AS (SELECT node, min(d) AS d FROM walk WHERE node <> known_path(dependents.path) GROUP BY node)
            SELECT node, CASE WHEN transitive AND d >= deepest THEN CAST(raise_error('there may be dependents beyond the deepest level; ask with a larger one') AS INT) ELSE d END FROM near""",
        f"""find(question STRING, most INT DEFAULT 20) RETURNS TABLE(place INT, kind STRING, path STRING, score INT) RETURN
            WITH raw AS (SELECT {_words('find.question')} AS ws), asked AS (SELECT tok, count(*) AS times FROM (SELECT explode(CASE WHEN exists(ws, w -> w NOT IN ({stop})) THEN filter(ws, w -> w NOT IN ({stop})) ELSE ws END) AS tok FROM raw) GROUP BY tok),
            meant AS (SELECT tok, term, piece, 3 AS points FROM asked JOIN {v}find_terms ON term = tok WHERE NOT piece
            UNION ALL SELECT tok, term, piece, 2 FROM asked JOIN {v}find_terms ON start = substring(tok, 1, {find_index.START}) WHERE NOT piece AND length(tok) >= {find_index.START} AND length(term) >= {find_index.START} AND (startswith(term, tok) OR startswith(tok, term))
            UNION ALL SELECT tok, term, piece, 1 FROM asked JOIN {v}find_grams ON gram = substring(tok, 1, {find_index.GRAM}) WHERE contains(term, tok)),
            hits AS (SELECT tok, entry, max(points) AS points FROM meant JOIN {v}find_postings USING (term, piece) GROUP BY tok, entry),
            sums AS (SELECT entry, sum(points * times) AS raw FROM hits JOIN asked USING (tok) GROUP BY entry),
            scored AS (SELECT kind, path, CAST(raw + CASE kind {bonus} ELSE 0 END AS INT) AS score, seq, explode(sequence(1L, copies)) FROM sums JOIN {v}find_entries USING (entry)),
            ranked AS (SELECT row_number() OVER (ORDER BY score DESC, path, seq) AS place, kind, path, score FROM scored)
            SELECT place, kind, path, score FROM ranked WHERE place <= most""",
        "search(question STRING, most INT DEFAULT 10) RETURNS TABLE(place INT, path STRING, score INT) RETURN SELECT f.place, f.path, f.score FROM find(search.question, search.most) f",
        f"cycles() RETURNS TABLE(nodes ARRAY<STRING>, length INT, risk_score DOUBLE, test_only BOOLEAN) RETURN SELECT nodes, length, bround(risk_score, 2), test_only FROM {v}cycles",
        f"entry_points() RETURNS TABLE(path STRING, name STRING, kind STRING, description STRING) RETURN SELECT path, name, kind, description FROM {v}entry_points",
        f"staleness(head STRING) RETURNS STRING RETURN CASE WHEN {own} IS NULL OR head IS NULL THEN 'unknown' WHEN {own} = head THEN 'fresh' ELSE 'stale' END",
    ]


def register(spark: SparkSession, m: store.CodeMapTables, prefix: str = "code_") -> list[str]:
    """Make a map's tables temporary views (``prefix`` and their names) and its questions SQL functions; the names of these.

    Functions: ``known_path(q)``, ``overview()``, ``module(path)``, ``neighbors(path, way)``, ``dependents(path, transitive,
    deepest)``, ``find(question, most)``, ``search(question, most)`` (by words, as there is no scorer in SQL), ``cycles()``,
    ``entry_points()``, ``staleness(head)``. Paths are resolved as everywhere; one that is not known or not unique gives no
    rows. ``dependents`` takes a step for each edge of distance and fails, rather than leave some out, where ``deepest`` is not
    enough. A map that was written brings its indexes; for another one that of paths is made here, that of texts when a
    question is asked. SQL gives
    rows in no order but that of ``place``.
    """
    merged = cut(merged_edges(m))  # each level of dependents reads them
    views = {n: m[n] for n in ("modules", "file_summaries", "entry_points", "cycles", "quick_reference")} | {"edges": merged}
    views["cycle_nodes"] = m["cycles"].select(F.explode("nodes").alias("node"))
    views |= {n: m[n] for n in find_index.TABLES} if m.has("find_postings") else find_index.build(find_corpus(m))
    views |= {n: m[n] for n in resolve.PATH_TABLES} if m.has("path_endings") else resolve.path_index(known_of(m, merged), keep=written)
    for name, table in views.items():
        table.createOrReplaceTempView(prefix + name)
    made = []
    for f in _functions(prefix, m.meta):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}")
        made.append(f.split("(", 1)[0])
    return made
