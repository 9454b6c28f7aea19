"""Benchmark decontamination by size-partitioned MinHash containment search. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions.lineage import BROADCAST_ROWS, cut, lookup
from orrery.llm.common import SPACE

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text: A-Z in lower case, divided at ASCII white space; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), SPACE), lambda w: w != "")


def shingles(ws: Column, width: Column | int, of: Callable[[Column], Column]) -> Column:
    """``of`` each run of ``width`` words; for texts of at least as many words."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.transform(F.sequence(F.lit(1), F.size(ws) - width + 1), lambda i: of(F.slice(ws, i, width)))


def _gram(run: Column) -> Column:
    return F.struct(F.array_join(run, " ").alias("gram"), F.xxhash64(run).alias("h"))


def item_sketches(items: DataFrame, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Shingles of the items and their sketches.

    ``item, w, size, gram, h`` has a row for each distinct shingle (w words: ``width``, or all words of a shorter item;
    size: how many distinct ones the item has). The sketch keeps those with the smallest hashes: as many for each item as
    its partition by size (a power of two) asks for, one more than the largest item there may miss at the threshold. So a
    text that contains an item at the threshold holds at least one hash of its sketch.
    """
    ws = items.withColumn("ws", words(F.col("text"))).where(F.size("ws") > 0).withColumn("w", F.least(F.size("ws"), F.lit(width)))
    grams = ws.select("item", "w", F.explode(shingles(F.col("ws"), F.col("w"), _gram)).alias("x")).select("item", "w", "x.h", "x.gram").distinct()
    hashed = grams.groupBy("item", "w").agg(F.array_sort(F.collect_list(F.struct("h", "gram"))).alias("g")).withColumn("size", F.size("g"))
    top = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("size").cast("double"))))
    keep = F.least(F.col("size"), (F.floor(top * (1 - threshold) + 1e-9) + 1).cast("int"))
    hashed = cut(hashed.withColumn("partition", top.cast("long")).withColumn("keep", keep))
    whole = hashed.select("item", "w", "size", F.explode("g").alias("x")).select("item", "w", "size", "x.gram", "x.h")
    sketch = hashed.select("item", "w", "partition", F.explode(F.slice("g", F.lit(1), F.col("keep"))).alias("x")).select("item", "w", "partition", "x.h")
    return whole, sketch


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs of a document and a test item whose shingles the document contains to at least ``threshold``.

    Words have A-Z in lower case and are divided at ASCII white space; shingles are ``width`` words, and an item of fewer
    words is one shingle of all its words, searched in documents at that length. Containment is the share of the item's
    distinct shingles that the document has. Candidates come from the items' MinHash sketches, partitioned by size, and
    miss no pair at the threshold; exact containment (the words themselves) then decides.

    Returns ``id, item, n_shingles`` (the item's distinct shingles), ``n_found, containment``, one row for each pair.
    Null or blank texts and items match nothing; rows with a null id are left out; repeated ids count as one document with
    all their shingles, repeated items alike. Empty tables give no rows. Other columns are ignored, whatever their names.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("item is not null")
    whole, sketch = item_sketches(items, width, threshold)
    widths = [r["w"] for r in whole.select("w").distinct().collect()]  # at most `width` numbers
    if not widths:
        return docs.sparkSession.createDataFrame([], T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("item", benchmark.schema[item_col].dataType)])).selectExpr("id", "item", "0 as n_shingles", "0 as n_found", "0D as containment")
    raw = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    texts = raw.select("id", words(F.col("text")).alias("ws"))
    # The candidate search sees one hash for each shingle; a text comes here once for each width that items have.
    hashes = None
    for w in sorted(widths):
        one = texts.where(F.size("ws") >= w).select("id", F.lit(w).alias("w"), F.explode(shingles(F.col("ws"), w, F.xxhash64)).alias("h"))
        hashes = one if hashes is None else hashes.unionByName(one)
    keys = cut(sketch.groupBy("w", "h").agg(F.collect_set("item").alias("items")))
    small = keys.count() <= BROADCAST_ROWS
    hit = hashes.join(F.broadcast(keys) if small else keys, ["w", "h"])
    candidates = cut(hit.select("id", "w", F.explode("items").alias("item")).distinct())
    # Exact containment, on candidate documents only: their shingles as words, against those of their candidate items.
    wanted = cut(candidates.groupBy("id").agg(F.collect_set("w").alias("widths")))
    found = lookup(raw, wanted, ["id"], "inner").select("id", F.explode("widths").alias("w"), words(F.col("text")).alias("ws")).where(F.size("ws") >= F.col("w"))
    grams = found.select("id", "w", F.explode(shingles(F.col("ws"), F.col("w"), lambda run: F.array_join(run, " "))).alias("gram")).distinct()
    have = candidates.join(whole, ["item", "w"]).join(grams, ["id", "w", "gram"])
    out = have.groupBy("id", "item").agg(F.first("size").alias("n_shingles"), F.count("*").cast("int").alias("n_found"))
    return out.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= threshold)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that contain a test item: all rows of an id go if these together contain one, as
    :func:`contaminated` counts them as one document; rows with a null id stay."""
    gone = contaminated(docs, benchmark, id_col, **options).select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
