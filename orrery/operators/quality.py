"""How far asserted edges and summaries agree with what was parsed, and which files matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of edges that a parser can confirm.
COMPARABLE = ["import", "from", "require", "static", "include"]
#: Shares of an asserted role and of the degree's rank in importance.
ROLE_SHARE, DEGREE_SHARE, ROLES = 0.6, 0.4, 3.0


def faithfulness(parsed: DataFrame, asserted: DataFrame, comparable: Column | None = None) -> DataFrame:
    """One row ``llm_edges, ast_edges, matched, precision, recall`` over distinct pairs; kinds are ignored.

    ``comparable`` filters the asserted side only. A ratio without a denominator is null.
    """
    a = parsed.select("src", "dst").distinct().withColumn("a", F.lit(1))
    b = (asserted if comparable is None else asserted.where(comparable)).select("src", "dst").distinct().withColumn("l", F.lit(1))
    n = a.join(b, ["src", "dst"], "full_outer").agg(F.count("l").alias("llm_edges"), F.count("a").alias("ast_edges"), F.count_if(F.col("a").isNotNull() & F.col("l").isNotNull()).alias("matched"))
    return n.select("*", (F.col("matched") / F.nullif("llm_edges", F.lit(0))).alias("precision"), (F.col("matched") / F.nullif("ast_edges", F.lit(0))).alias("recall"))


def evidence(scores: DataFrame, low: float = 0.5) -> DataFrame:
    """One row ``mean, scored, skipped, n_low`` of ``scores(score)``; null scores were skipped."""
    return scores.agg(F.avg("score").alias("mean"), F.count("score").alias("scored"), F.count_if(F.col("score").isNull()).alias("skipped"), F.count_if(F.col("score") < low).alias("n_low"))


def evidence_rows(summaries: DataFrame, contents: DataFrame, least: int = 64) -> DataFrame:
    """``path, summary, content`` for a scorer; content is null where the file was not read, or says too little to judge by
    (fewer than ``least`` characters but for white space at its ends)."""
    j = summaries.select("path", "summary").join(contents.select("path", "content"), "path", "left")
    return j.withColumn("content", F.when(F.length(F.trim("content", F.lit(" \t\n\r\x0b\f"))) >= least, F.col("content")))


def low_evidence(scores: DataFrame, low: float = 0.5) -> DataFrame:
    """The rows ``path, score`` under ``low``, the lowest first."""
    return scores.where(F.col("score") < low).orderBy("score", "path").select("path", "score")


def degree_rank(degrees: DataFrame) -> DataFrame:
    """Adds ``rank``: the place of a row's degree among the distinct degrees, from 0 to 1; 1 if there is one only.

    Only the distinct degrees are put in order, in one task: d different degrees add up to d (d - 1) / 2 at least, so there
    are no more than twice the square root of the number of edges. The rows join them.
    """
    distinct = degrees.select(F.coalesce("degree", F.lit(0)).alias("d")).distinct()
    w = Window.orderBy("d")
    n = F.count("*").over(Window.partitionBy())
    ranks = distinct.select("d", F.when(n == 1, 1.0).otherwise((F.row_number().over(w) - 1) / (n - 1)).alias("rank"))
    return degrees.join(ranks, F.coalesce("degree", F.lit(0)) == ranks["d"]).drop("d")


def fused_importance(modules: DataFrame) -> DataFrame:
    """``path, fused`` of the modules ``(path, role, degree)`` with a role, by falling importance, then path."""
    ranked = degree_rank(modules.where("role is not null"))
    return ranked.select("path", "role", "degree", (ROLE_SHARE * F.col("role") / ROLES + DEGREE_SHARE * F.col("rank")).alias("fused"))


def directory_granular(modules: DataFrame) -> DataFrame:
    """One row ``directories``: whether more than half of the modules' names have no dot; null without modules."""
    name = F.substring_index(F.regexp_replace("path", "/+$", ""), "/", -1)
    return modules.agg((F.avg(F.when(F.contains(name, F.lit(".")), 0.0).otherwise(1.0)) > 0.5).alias("directories"))


def importance_summary(modules: DataFrame, k: int = 3) -> DataFrame:
    """The k most important modules by :func:`fused_importance`."""
    return fused_importance(modules).orderBy(F.desc("fused"), "path").limit(k)
