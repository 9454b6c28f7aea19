"""Ranked search by words, and by scores from elsewhere."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a question says little with.
STOP_WORDS = "a an and are as at by do does find for from how i in is it of on or the this to what where which who".split()
#: White space that divides words, and what else does within texts.
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = "/._"
#: What each kind of text adds to its hits' scores.
BONUS = {"quick_reference": 2, "module": 0, "entry_point": 0, "symbol": 0, "file_summary": -1}


def query_tokens(query: str) -> list[str]:
    raw = query.lower().replace("?", " ").split()
    return [t for t in raw if t not in STOP_WORDS] or raw


def token_score(tokens: list[str], text: Column) -> Column:
    """For each token 3 if it is a word of the text, else 2 if it begins one or one begins it (four letters at least), else
    1 if it occurs at all; words are divided at slashes, dots, underscores and white space."""
    hay = F.lower(text)
    # Every word stands between spaces, so that words and their beginnings are found without dividing the text. Both forms
    # of the text are bound to a name, or they would be made again for each comparison.
    words = F.concat(F.lit(" "), F.translate(hay, SEPARATORS + WHITE, " " * len(SEPARATORS + WHITE)), F.lit(" "))

    def one(t: str, x: Column) -> Column:
        has = lambda s: F.contains(x["words"], F.lit(s))
        out = F.when(has(f" {t} "), 3)
        if len(t) >= 4:
            out = out.when(functools.reduce(lambda a, b: a | b, [has(f" {t}"), *(has(f" {t[:n]} ") for n in range(4, len(t)))]), 2)
        return out.when(F.contains(x["hay"], F.lit(t)), 1).otherwise(0)

    forms = F.array(F.struct(hay.alias("hay"), words.alias("words")))
    return F.coalesce(F.transform(forms, lambda x: functools.reduce(lambda a, b: a + b, [one(t, x) for t in tokens], F.lit(0)))[0], F.lit(0))


def hits(corpus: DataFrame, query: str) -> DataFrame:
    """Rows of ``corpus(kind, path, text, seq)`` whose words score, with ``score``: their kind's bonus comes on top."""
    raw = token_score(query_tokens(query), F.col("text"))
    bonus = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BONUS.items() for x in kv]), F.col("kind")), F.lit(0))
    return corpus.withColumn("raw", raw).where("raw > 0").withColumn("score", F.col("raw") + bonus)


def find(corpus: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Hits of ``corpus(kind, path, text, seq)``: ``kind, path, score``, by falling score, path, then order of entry."""
    limit = max(0, min(limit, 1000))
    return hits(corpus, query).orderBy(F.desc("score"), "path", "seq").limit(limit).select("kind", "path", "score")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def semantic_rank(corpus: DataFrame, score: Column | Callable[[DataFrame], DataFrame], limit: int = 10) -> DataFrame:
    """``path, score`` by falling score and path; scores come from a column or a function that adds ``score``."""
    scored = score(corpus) if callable(score) else corpus.withColumn("score", score)
    return scored.where("score is not null").orderBy(F.desc("score"), "path").limit(max(0, min(limit, 1000))).select("path", "score")
