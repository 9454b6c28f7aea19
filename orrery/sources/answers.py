"""What a language model says about a code base, as tables; the model itself is a callable that the caller brings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.paths import norm_path
from orrery.functions.text import json_object

#: Tables of an answer: field, element type.
ANSWER = (
    "modules array<struct<path:string,name:string,description:string>>, import_edges array<struct<from_path:string,to_path:string,kind:string>>, "
    "data_flow array<struct<source:string,destination:string,description:string>>, entry_points array<struct<path:string,name:string,kind:string,description:string>>, "
    "file_summaries array<struct<path:string,summary:string,symbols:array<struct<name:string,kind:string,description:string>>>>, quick_reference array<struct<query:string,location:string>>, "
    "db_tables array<struct<name:string,columns:array<struct<name:string,type:string,constraints:string>>,description:string>>, "
    "tests array<struct<file:string,covers:string>>, notes array<struct<note:string>>, requested_files array<string>"
)
_CHUNK = "choices array<struct<delta:struct<content:string>,finish_reason:string>>, usage struct<prompt_tokens:string,completion_tokens:string>"


def streamed_text(events: DataFrame) -> DataFrame:
    """Answers put together from streamed events ``(answer_id, seq, line)``: ``answer_id, text, prompt_tokens,
    completion_tokens, truncated``. The last usage counts, also on an event without choices; other lines are ignored."""
    data = events.where(F.col("line").startswith("data:")).withColumn("body", F.trim(F.substring("line", 6, 1 << 30))).where("body <> '[DONE]'")
    e = data.select("answer_id", "seq", F.from_json("body", _CHUNK).alias("e")).select("answer_id", "seq", F.get("e.choices", F.lit(0)).alias("c"), "e.usage")
    token = lambda c: F.expr(f"try_cast(max_by(usage.{c}, seq) filter (where usage is not null) as bigint)")
    # An answer is bounded by its model's output limit.
    return e.groupBy("answer_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("c.delta.content", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("text"),
        token("prompt_tokens").alias("prompt_tokens"),
        token("completion_tokens").alias("completion_tokens"),
        F.coalesce(F.bool_or(F.col("c.finish_reason") == "length"), F.lit(False)).alias("truncated"),
    )


def answer_tables(answers: DataFrame) -> dict[str, DataFrame]:
    """Tables of answers ``(text)``: fences and prose around the JSON are dropped, rows without a key are left out; modules and
    summaries have one row for each path, the last one said."""
    parsed = answers.select(F.from_json(json_object(F.col("text")), ANSWER).alias("a"))
    out = {}
    for name in ("modules", "data_flow", "entry_points", "file_summaries", "quick_reference", "db_tables", "tests", "notes"):
        out[name] = parsed.select(F.inline(f"a.{name}"))
    for name in ("modules", "file_summaries"):
        # A path that comes again, however it is written, replaces what was said before.
        each = parsed.select(F.posexplode(f"a.{name}").alias("pos", "x")).withColumn("path", norm_path(F.col("x.path"))).where("path is not null")
        out[name] = each.groupBy("path").agg(F.max_by("x", "pos").alias("x")).select("path", *(f"x.{c}" for c in out[name].columns if c != "path"))
    out["modules"] = out["modules"].select("path", "name", "description", F.lit(None).cast("double").alias("role"), F.lit(None).cast("long").alias("degree")).where("path is not null")
    out["llm_edges"] = parsed.select(F.inline("a.import_edges")).select(F.col("from_path").alias("src"), F.col("to_path").alias("dst"), "kind").where("src is not null and dst is not null")
    return out


def requested_files(answers: DataFrame, known: DataFrame, limit: int = 100) -> DataFrame:
    """The known paths that answers ask for, ``path, seq``: the path itself, else all that end in it, else the longest that it
    ends in; the first ``limit`` in the order of asking."""
    asked = answers.select(F.posexplode(F.from_json(json_object(F.col("text")), ANSWER)["requested_files"]).alias("pos", "q")).where("q is not null").select("pos", F.regexp_replace(F.replace("q", F.lit("\\"), F.lit("/")), r"^(\./)+", "").alias("q"))
    k = known.select("path").distinct()
    # A path is met at each of its endings, so that all tiers are equality joins.
    parts = F.split("path", "/")
    endings = k.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("q"))
    up = asked.select("pos", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(F.split("q", "/")), F.lit(2))), lambda i: F.array_join(F.slice(F.split("q", "/"), i, F.size(F.split("q", "/"))), "/"))).alias("path"))
    hits = asked.join(endings, "q").select("pos", "path", F.when(F.col("path") == F.col("q"), 0).otherwise(1).alias("tier")).unionByName(up.join(k, "path").select("pos", "path", F.lit(2).alias("tier")))
    best = hits.groupBy("pos").agg(F.min("tier").alias("best"), F.max(F.when(F.col("tier") == 2, F.length("path"))).alias("n"))
    kept = hits.join(best, "pos").where("tier = best and (tier < 2 or length(path) = n)")
    return kept.groupBy("path").agg(F.min("pos").alias("seq")).orderBy("seq", "path").limit(limit)
