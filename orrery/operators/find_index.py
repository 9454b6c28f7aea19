"""An inverted index for ranked search: many questions are answered by joins with postings, not by reading texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.search import BONUS, SEPARATORS, STOP_WORDS, WHITE

#: The tables of an index and their columns; the type of ``seq`` is the corpus' own.
TABLES = {
    "find_entries": ["entry", "kind", "path", "seq", "copies"],
    "find_postings": ["term", "piece", "entry"],
    "find_terms": ["term", "piece", "start", "entries"],
    "find_grams": ["gram", "term", "piece"],
}
#: Letters of a beginning, and of the pieces of terms that are looked up.
START, GRAM = 4, 3


def _split(text: Column, characters: str) -> Column:
    """Non-empty parts of a text between any of these characters."""
    plain = F.translate(text, characters, " " * len(characters))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _entries(corpus: DataFrame) -> DataFrame:
    """Rows of the corpus with a text, equal ones once; an entry's key is a digest of all that it holds."""
    rows = corpus.where("text is not null")
    seq = rows.schema["seq"].dataType.simpleString()
    key = F.unhex(F.substring(F.sha2(F.to_json(F.struct("kind", "path", "text", F.col("seq").cast(seq).alias("seq"))), 256), 1, 32))
    return rows.groupBy(key.alias("entry")).agg(*(F.first(c, ignorenulls=False).alias(c) for c in ("kind", "path", "seq", "text")), F.count("*").alias("copies"))


def _postings(entries: DataFrame) -> DataFrame:
    """Words of each entry, and the pieces between white space that separators divide into words."""
    hay = F.lower("text")
    words = F.transform(F.array_distinct(_split(hay, WHITE + SEPARATORS)), lambda w: F.struct(w.alias("term"), F.lit(False).alias("piece")))
    divided = F.filter(F.array_distinct(_split(hay, WHITE)), lambda w: F.translate(w, SEPARATORS, "") != w)
    pieces = F.transform(divided, lambda w: F.struct(w.alias("term"), F.lit(True).alias("piece")))
    return entries.select("entry", F.explode(F.concat(words, pieces)).alias("t")).select("t.term", "t.piece", "entry")


def _terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term", "piece").agg(F.count("*").alias("entries")).select("term", "piece", F.substring("term", 1, START).alias("start"), "entries")


def grams_of(text: Column, n: int) -> Column:
    """The distinct runs of n letters of a text."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _grams(terms: DataFrame) -> DataFrame:
    """All runs of one to three letters of each term."""
    each = F.concat(*(grams_of(F.col("term"), n) for n in range(1, GRAM + 1)))
    return terms.select(F.explode(each).alias("gram"), "term", "piece")


def _as_it_is(table: DataFrame, name: str) -> DataFrame:
    return table


def build(corpus: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = _as_it_is) -> dict[str, DataFrame]:
    """The index of ``corpus(kind, path, text, seq)``, as tables to be written.

    ``find_entries`` are the distinct rows with their number of copies (no texts but what ``seq`` holds), ``find_postings``
    the entries of each term, ``find_terms`` the distinct terms with how many entries have them, ``find_grams`` the terms of
    each run of letters. Rows without a text are never hits and left out; no rows give empty tables. ``keep`` may write a
    table (it gets the table and its name) and give it back as read, so that the ones after it are made from that.
    """
    entries = _entries(corpus)
    postings = keep(_postings(entries), "find_postings")
    terms = keep(_terms(postings), "find_terms")
    return {"find_entries": keep(entries.select(*TABLES["find_entries"]), "find_entries"), "find_postings": postings, "find_terms": terms, "find_grams": keep(_grams(terms), "find_grams")}


def refreshed(old: dict[str, DataFrame], corpus: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = _as_it_is) -> dict[str, DataFrame]:
    """The index of a new corpus from that of an older one: only rows that the old one has not are divided into words.

    Postings of rows that went go with them; grams are made for new terms only. Equal to ``build(corpus)``.
    """
    entries = _entries(corpus)
    keys = old["find_entries"].select("entry")
    new = entries.join(keys, "entry", "left_anti")
    postings = old["find_postings"].join(entries.select("entry"), "entry", "left_semi").select("term", "piece", "entry").unionByName(_postings(new))
    postings = keep(postings, "find_postings")
    terms = keep(_terms(postings), "find_terms")
    were = old["find_terms"].select("term", "piece")
    grams = old["find_grams"].join(terms, ["term", "piece"], "left_semi").select("gram", "term", "piece").unionByName(_grams(terms.join(were, ["term", "piece"], "left_anti")))
    return {"find_entries": keep(entries.select(*TABLES["find_entries"]), "find_entries"), "find_postings": postings, "find_terms": terms, "find_grams": keep(grams, "find_grams")}


def question_tokens(question: Column) -> Column:
    """The words of a question without those that say little, or all of them if none is left."""
    raw = _split(F.lower(question), WHITE + "?")
    # A name for the words, so that they are made once.
    return F.flatten(F.transform(F.array(raw), lambda r: F.when(F.exists(r, lambda t: ~t.isin(STOP_WORDS)), F.filter(r, lambda t: ~t.isin(STOP_WORDS))).otherwise(r)))


def _meant(tokens: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """``tok, term, piece, points``: the terms that give each token points, as in ``search.token_score``."""
    terms = index["find_terms"]
    words = terms.where("not piece")
    same = tokens.join(words, F.col("tok") == F.col("term")).select("tok", "term", "piece", F.lit(3).alias("points"))
    near = tokens.where(F.length("tok") >= START).withColumn("start", F.substring("tok", 1, START)).join(words.where(F.length("term") >= START), "start")
    near = near.where(F.startswith("term", "tok") | F.startswith("tok", "term")).select("tok", "term", "piece", F.lit(2).alias("points"))
    # A token's rarest run of letters leads to the terms that may contain it.
    runs = tokens.select("tok", F.explode(F.when(F.length("tok") >= GRAM, grams_of(F.col("tok"), GRAM)).otherwise(F.array("tok"))).alias("gram"))
    asked = runs.select("gram").distinct()
    counts = index["find_grams"].join(asked, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = runs.join(counts, "gram", "left").groupBy("tok").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")).select("tok", "m.gram")
    inside = rarest.join(index["find_grams"], "gram").where(F.contains("term", "tok")).select("tok", "term", "piece", F.lit(1).alias("points"))
    return same.unionByName(near).unionByName(inside).groupBy("tok", "term", "piece").agg(F.max("points").alias("points"))


def _profiles(index: dict[str, DataFrame], asked: DataFrame) -> DataFrame:
    """``kind, profile, path, seq, copies`` of the entries that have a point: ``profile`` is which tokens give how many.

    Entries of one kind and profile have the same score for every question, so that sums are made for profiles only.
    """
    points = _meant(asked.select("tok").distinct(), index).join(index["find_postings"], ["term", "piece"]).select("entry", "tok", "points")
    # One exchange: both groupings find an entry's rows together.
    points = points.repartition("entry").groupBy("entry", "tok").agg(F.max("points").alias("points"))
    profiles = points.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("tok", "points"))).alias("profile"))
    return profiles.join(index["find_entries"], "entry").select("kind", "profile", "path", "seq", "copies")


def _asked(questions: DataFrame) -> DataFrame:
    return questions.select("qid", F.explode(question_tokens(F.col("question"))).alias("tok")).groupBy("qid", "tok").agg(F.count("*").alias("times"))


def _hits(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """``qid, kind, path, score, seq`` of entries from ``_profiles``, one row for each copy."""
    # By profile as well as by kind, and by all columns of the entries, so that both readers share one exchange.
    kinds = entries.groupBy("kind", "profile").agg(F.count("*").alias("entries"))
    each = kinds.select("kind", "profile", F.explode("profile").alias("t")).select("kind", "profile", "t.tok", "t.points")
    scores = each.join(asked, "tok").groupBy("qid", "kind", "profile").agg(F.sum(F.col("points") * F.col("times")).cast("int").alias("raw"))
    bonus = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BONUS.items() for x in kv]), F.col("kind")), F.lit(0))
    found = scores.join(entries.withColumnRenamed("kind", "k"), scores["kind"].eqNullSafe(F.col("k")) & (scores["profile"] == entries["profile"])).withColumn("score", F.col("raw") + bonus)
    return found.select("qid", "kind", "path", "score", "seq", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")


def hits_many(index: dict[str, DataFrame], questions: DataFrame) -> DataFrame:
    """``qid, kind, path, score, seq`` of all hits of ``questions(qid, question)``, one row for each hit of the corpus."""
    asked = _asked(questions)
    return _hits(_profiles(index, asked), asked)


def find_many(index: dict[str, DataFrame], questions: DataFrame, limit: int = 20) -> DataFrame:
    """The first ``limit`` hits of each of ``questions(qid, question)``: ``qid, position`` (from 1), ``kind, path, score``.

    One plan whatever the number of questions: their words meet the index' terms (the same word, words with the same
    beginning, words that contain them), the terms their postings, and the sums their entries; what is summed are profiles
    (``_profiles``), of each of which only the first ``limit`` entries go on. Rows are those of
    ``search.find`` for each question. A null or empty question has none; ids may repeat only with the same question.
    """
    limit = max(0, min(limit, 1000))
    asked = _asked(questions)
    # Of the entries of one kind and profile, no question can want more than the first ones.
    first = F.row_number().over(Window.partitionBy("kind", "profile").orderBy("path", "seq", "copies"))
    entries = _profiles(index, asked).withColumn("n", first).where(F.col("n") <= limit).select("kind", "profile", "path", "seq", F.least("copies", F.lit(limit)).alias("copies"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "path", "seq"))
    ranked = _hits(entries, asked).withColumn("position", place).where(F.col("position") <= limit)
    return ranked.select("qid", "position", "kind", "path", "score")
