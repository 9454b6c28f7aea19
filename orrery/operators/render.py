"""Small texts about a map: Markdown, Mermaid, node and link tables, prompts under a budget."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import paths, text
from orrery.operators import edges, graph
from orrery.sources.store import CodeMapTables


def _lines(df: DataFrame, line, order: list, limit: int = 5000) -> list[str]:
    """A section's lines; sections are cut at ``limit`` lines, with a note."""
    rows = df.orderBy(*order).select(line.alias("x")).limit(limit + 1).collect()
    return [r["x"] for r in rows[:limit]] + (["- …"] if len(rows) > limit else [])


def markdown(m: CodeMapTables) -> str:
    """A map as Markdown: sections in a fixed order, each sorted; empty ones are left out."""
    c = F.col
    merged = edges.merge_edges(m["ast_edges"], m["llm_edges"])
    sections = {
        "Modules": (m["modules"], F.format_string("- `%s` — %s", "path", F.coalesce("description", F.lit(""))), ["path"]),
        "Entry points": (m["entry_points"], F.format_string("- `%s` `%s` (%s)", "path", "name", "kind"), ["path", "name"]),
        "Most imported": (edges.fan_in(merged).orderBy(F.desc("n"), "dst").limit(10), F.format_string("- `%s` — %d", "dst", "n"), [F.desc("n"), "dst"]),
        "Imports": (merged, F.format_string("- `%s` → `%s` (%s, %s)", "src", "dst", "kind", "source"), ["src", "dst", "kind"]),
        "Import cycles": (m["cycles"], F.format_string("- %s risk %.2f: %s", F.when(c("test_only"), "(tests)").otherwise(""), "risk_score", F.array_join("nodes", " → ")), ["test_only", F.desc("risk_score"), "nodes"]),
        "Data flow": (m["data_flow"], F.format_string("- %s → %s: %s", "source", "destination", F.coalesce("description", F.lit(""))), ["source", "destination"]),
        "Files": (m["file_summaries"], F.format_string("- `%s` — %s", "path", F.coalesce("summary", F.lit(""))), ["path"]),
        "Tests": (m["tests"], F.format_string("- `%s` covers `%s`", "file", "covers"), ["file", "covers"]),
        "Quick reference": (m["quick_reference"], F.format_string("- %s: `%s`", "query", "location"), ["query", "location"]),
        "Notes": (m["notes"], F.concat(F.lit("- "), "note"), ["note"]),
    }
    out = ["# Code map", ""] + [f"- {k}: {v}" for k, v in sorted(m.meta.items()) if v is not None] + [""]
    for title, (df, line, order) in sections.items():
        if body := _lines(df, line, order):
            out += [f"## {title}", "", *body, ""]
    return "\n".join(out)


def mermaid(m: CodeMapTables, most: int = 40) -> str:
    """Directories and the edges between them; the parsed edges if there are any, else the asserted ones."""
    e = m["ast_edges"] if m.has("ast_edges") and not m["ast_edges"].isEmpty() else m["llm_edges"]
    members = graph.cyclic_nodes(e)
    inside = graph.intra_cycle_edges(e.select("src", "dst").distinct(), members).select("src", "dst", F.lit(True).alias("c"))
    flagged = e.select("src", "dst").distinct().join(inside, ["src", "dst"], "left")
    rolled = edges.directory_edges(flagged, paths.collapse, F.coalesce("c", F.lit(False)))
    top = edges.top_directories(rolled, most)
    base = F.regexp_replace("path", "[^A-Za-z0-9]", "_")
    same = F.row_number().over(Window.partitionBy(base).orderBy("path"))
    ids = top.withColumn("id", F.when(same == 1, F.concat(F.lit("n_"), base)).otherwise(F.concat(F.lit("n_"), base, F.lit("_"), same)))
    nodes = ids.orderBy("path").collect()  # at most `most`
    name = {r["path"]: r["id"] for r in nodes}
    drawn = rolled.where(F.col("src").isin(*name) & F.col("dst").isin(*name)).orderBy("src", "dst").collect() if name else []  # at most the square of it
    return "\n".join(["graph LR", *(f'  {r["id"]}["{r["path"]}"]' + (":::cycle" if r["in_cycle"] else "") for r in nodes), *(f"  {name[r['src']]} {'-.->' if r['cyclic'] else '-->'} {name[r['dst']]}" for r in drawn), "  classDef cycle stroke:#c00"])


def graph_tables(m: CodeMapTables) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, type, r, description, in_cycle, is_test`` and links ``src, dst, layer, corroborated`` for drawing."""
    ast, llm = m["ast_edges"], m["llm_edges"]
    degree = edges.file_degree(ast.select("src", "dst", "kind").unionByName(llm.select("src", "dst", "kind")))
    ends = degree.select(F.col("path").alias("id"), F.lit("file").alias("type"), F.lit(1).alias("rank"), F.col("degree").cast("double").alias("r"), F.lit("").alias("description"), F.lit(3).alias("seq"))
    mods = m["modules"].select(F.col("path").alias("id"), F.lit("module").alias("type"), F.lit(2).alias("rank"), F.lit(8.0).alias("r"), "description", F.lit(1).alias("seq"))
    entry = m["entry_points"].select(F.col("path").alias("id"), F.lit("entry").alias("type"), F.lit(3).alias("rank"), F.lit(10.0).alias("r"), "description", F.lit(2).alias("seq"))
    nodes = edges.upsert_nodes(ends.unionByName(mods).unionByName(entry))
    cyclic = m["cycles"].select(F.explode("nodes").alias("id")).distinct().withColumn("in_cycle", F.lit(True))
    nodes = nodes.join(cyclic, "id", "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False))).withColumn("is_test", paths.is_test(F.col("id")))
    return nodes, edges.links(ast, llm)


def html(m: CodeMapTables, title: str = "Code map") -> str:
    """A page that holds the nodes and links as data, safe inside a script, with a search box over them."""
    nodes, links = graph_tables(m)
    data = {"nodes": [json.loads(x) for x in nodes.orderBy("id").limit(20_000).toJSON().collect()], "links": [json.loads(x) for x in links.orderBy("src", "dst").limit(100_000).toJSON().collect()], "meta": m.meta}
    blob = json.dumps(data, ensure_ascii=False)
    for c in "<>&\u2028\u2029":
        blob = blob.replace(c, f"\\u{ord(c):04x}")
    script = "const d=JSON.parse(document.getElementById('d').textContent),q=document.getElementById('q'),o=document.getElementById('o');const show=()=>{const t=q.value.toLowerCase();o.replaceChildren(...d.nodes.filter(n=>n.id.toLowerCase().includes(t)).map(n=>{const p=document.createElement('li');p.textContent=n.id+(n.in_cycle?' (cycle)':'')+' '+d.links.filter(l=>l.src===n.id).map(l=>'→ '+l.dst).join(' ');return p}))};q.oninput=show;show()"
    return f"<!doctype html><meta charset=utf-8><title>{title}</title><input id=q placeholder=search><ul id=o></ul><script id=d type=application/json>{blob}</script><script>{script}</script>"


def diff_markdown(diff: DataFrame | None, compared: dict[str, bool], state: str) -> str:
    out = ["# Changes", "", f"Baseline: {state}", ""]
    for name, ok in compared.items():
        if not ok:
            out += [f"## {name}", "", "Not compared: one of the runs has no such table.", ""]
        elif diff is not None and (body := _lines(diff.where(F.col("dimension") == name), F.format_string("- %s: %s", "change", "item"), ["change", "item"])):
            out += [f"## {name}", "", *body, ""]
    return "\n".join(out)


#: Tokens kept for what surrounds the files, and the edge table's share of the rest.
OVERHEAD, EDGE_SHARE = 1500, 0.25


def _estimate(s: str) -> int:
    return len(s.encode("utf-8")) * 2 // 5


def prompt(tree: str, files: DataFrame, edge_rows: DataFrame | None, max_context: int, partial: bool = False) -> tuple[str, int, list[str]]:
    """A prompt of the tree, the edge table and the files ``(path, content, est_tokens, seq)`` that fit; its estimate; the paths.

    The edge table takes at most a quarter of what tree and overhead leave; its rows stop at the first that does not fit.
    Files go in by ``seq``; one that does not fit is passed over, and the last ones go again while the whole is too long.
    A prompt is bounded by its budget, so it is put together by the driver.
    """
    budget = max_context - OVERHEAD - _estimate(tree)
    rows, note = [], ""
    if edge_rows is not None:
        room, used = int(budget * EDGE_SHARE), 0
        for r in edge_rows.orderBy("src", "dst", "kind").limit(max(0, room)).collect():  # a row has a token at least
            line = f"{r['src']} -> {r['dst']} ({r['kind']})"
            if used + _estimate(line + "\n") > room:
                note = "These are some of the imports that were parsed."
                break
            used += _estimate(line + "\n")
            rows.append(line)
        note = (note or "These are the imports that were parsed.") + (" Some kinds of statements are not resolved." if partial else "")
        budget -= used
    order = files.where(F.col("est_tokens") <= max(0, budget)).orderBy("seq")
    total, kept = 0, []
    for r in order.select("path", "est_tokens").limit(10_000).collect():
        cost = r["est_tokens"] + _estimate(f"### {r['path']}\n")
        if total + cost <= budget:
            total += cost
            kept.append(r["path"])
    body = {r["path"]: r["content"] for r in files.where(F.col("path").isin(*kept)).select("path", "content").collect()} if kept else {}

    def whole(names: list[str]) -> str:
        parts = ["Project tree:", tree] + ([note, *rows] if rows or note else [])
        return "\n".join([*parts, *(f"### {n}\n{body[n]}" for n in names)])

    while kept and _estimate(whole(kept)) > max_context:
        kept.pop()
    out = whole(kept)
    return out, _estimate(out), kept


def orientation(m: CodeMapTables, entries: int = 6, imported: int = 5) -> list[str]:
    """A few lines to start from: entry points and the most imported files."""
    points = m["entry_points"].select("path", "name").orderBy("path", "name").limit(entries + 1).collect()
    n = m["entry_points"].count()
    top = edges.top_fan_in(m["ast_edges"].unionByName(m["llm_edges"]), imported).collect()
    out = [f"Start at `{r['path']}` ({r['name']})" for r in points[:entries]]
    return out + ([f"(+{n - entries} more)"] if n > entries else []) + [f"`{r['dst']}` is imported by {r['n']} files" for r in top]


def redacted(files: DataFrame, max_chars: int, skeleton=None) -> DataFrame:
    """``content`` as it may be shown: an outline of long Python files if there is one, else their head; secrets redacted."""
    raw = F.col("raw")
    shown = F.when((F.length(raw) > max_chars) & (F.col("lang") == "python"), F.coalesce(skeleton(raw), raw)).otherwise(raw) if skeleton is not None else raw
    return files.withColumn("content", text.redact(text.head(shown, max_chars)))
