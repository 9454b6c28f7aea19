"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.lineage import cut
from orrery.llm.common import ascii_words, by_batch
from orrery.llm.components import connected_components

#: Fingerprints in a tile; 2,048 x 2,048 comparisons take some 40 MB at a time.
TILE = 2048
#: The 64 bits fall into these runs (shift, width); a tile holds fingerprints with equal population counts in each run.
RUNS = ((0, 21), (21, 21), (42, 22))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of a text as a signed 64-bit number; see :func:`simhash_components`."""
    words = ascii_words(text)
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, n)
    per_byte = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    bits = (per_byte @ _BITS).ravel() * 2 > n
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id, fp`` for every row; fp is the fingerprint as a signed long."""

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": rows["id"], "fp": [fingerprint(t, width) for t in rows["text"]]})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(by_batch(batch), "id long, fp long")


def _counts(radius: int) -> list[tuple[int, ...]]:
    """Differences of the population counts that two fingerprints within the radius can have, each unordered pair once."""
    zero = (0,) * len(RUNS)
    return [d for d in product(range(-radius, radius + 1), repeat=len(RUNS)) if sum(map(abs, d)) <= radius and d >= zero]


def _tile_links(radius: int):
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_links(*map(np.asarray, row), radius) for row in zip(batch["fps"], batch["ids"], batch["fps2"], batch["ids2"], strict=True)]
            if found := [f for f in found if len(f[0])]:
                yield pd.DataFrame({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])})

    return links


def _links(left: np.ndarray, left_ids: np.ndarray, right: np.ndarray, right_ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles: each linked id with the smallest id of its group."""
    ids, back = np.unique(np.concatenate([left_ids, right_ids]), return_inverse=True)
    label = np.arange(len(ids))
    at, to = back[: len(left)], back[len(left) :]
    left, right = left.astype(np.int64), right.astype(np.int64)
    for start in range(0, len(left), 256):
        near = np.bitwise_count((left[start : start + 256, None] ^ right[None, :]).view(np.uint64)) <= radius
        for i in np.flatnonzero(near.any(axis=1)):
            groups = np.unique(label[np.append(to[near[i]], at[start + i])])
            if len(groups) > 1:
                label[np.isin(label, groups)] = groups[0]
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def simhash_links(nodes: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Links ``a, b`` that connect the distinct fingerprints ``id, fp`` as all pairs within the radius do.

    Fingerprints of equal population counts (of each run of bits) are dealt into tiles of bounded size. A pair within the
    radius has counts that differ by no more than the radius in sum, so only such pairs of tiles meet, by an equality join
    on the counts; the others are skipped. Each pair of tiles is compared whole (exclusive-or and bit counts), and gives a
    spanning forest rather than all its pairs.
    """
    counts = [F.bit_count(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))).cast("int") for shift, width in RUNS]
    with_key = nodes.select("id", "fp", F.array(*counts).alias("pc"))
    # At most 22 * 22 * 23 rows: a bound that does not grow with the data.
    sizes = with_key.groupBy("pc").agg(F.count("*").alias("n"))
    tiles = (
        with_key.join(F.broadcast(sizes), "pc")
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / tile)).cast("int"))
        .groupBy("pc", "chunk")
        .agg(F.collect_list(F.struct("fp", "id")).alias("rows"))
        .select("pc", "chunk", F.col("rows.fp").alias("fps"), F.col("rows.id").alias("ids"))
    )
    steps = F.array(*(F.array(*(F.lit(x) for x in d)) for d in _counts(radius)))
    left = tiles.select("chunk", "fps", "ids", F.explode(F.transform(steps, lambda d: F.zip_with("pc", d, lambda x, y: x + y))).alias("key"), "pc").withColumn("same", F.col("key") == F.col("pc")).drop("pc")
    right = tiles.select(F.col("pc").alias("key"), F.col("chunk").alias("chunk2"), F.col("fps").alias("fps2"), F.col("ids").alias("ids2"))
    pairs = left.join(right, "key").where("not same or chunk <= chunk2").select("fps", "ids", "fps2", "ids2")
    # Tiles are large rows, so few of them travel to Python at a time.
    return pairs.mapInPandas(_tile_links(radius), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """Groups of near-duplicate documents by SimHash.

    Words are runs of other than ASCII white space with A-Z in lower case; shingles are ``width`` words joined by a space,
    repeats included (of fewer words the whole sequence is the one shingle). A fingerprint bit is 1 if it is set in over
    half of the shingles' XXH64 (seed 42). Documents link if their fingerprints differ in at most ``radius`` bits.

    Returns one row per input row: ``id, fp`` (signed long), ``component_id`` (the smallest id that links reach).
    Null, empty and blank texts have fingerprint zero and link like any other; repeated ids are separate rows of one node;
    a null id gets the component of the documents with its very fingerprint; no rows give no rows. Other columns are
    ignored, whatever their names.
    """
    fps = cut(fingerprints(docs, id_col, text_col, width))
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("id")))
    comps = connected_components(simhash_links(nodes.where("id is not null"), radius))
    of_fp = nodes.join(comps, nodes["id"] == comps["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(of_fp, "fp").select("id", "fp", "component_id")


def near_duplicates_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest id (nulls last), of these the one whose
    digest is smallest.

    Rows are judged one by one by their fingerprints, whatever ids repeat: a row goes only if a row of its group stays. Of
    rows that are alike in all columns one stays. Null and blank texts are a group, as in :func:`simhash_components`; no
    rows give no rows; columns may have any names.
    """
    key = next(n for n in (f"_row{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    digest = F.unhex(F.substring(F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), {"ignoreNullFields": "false"}), 256), 1, 32))
    keyed = docs.withColumn(key, digest)

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": rows["key"], "id": rows["id"], "fp": [fingerprint(t, width) for t in rows["text"]]})

    texts = keyed.select(F.col(key).alias("key"), F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(texts.mapInPandas(by_batch(batch), "key binary, id string, fp long").withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)))
    nodes = rows.select(F.col("fp").alias("id"), "fp").distinct()
    comps = connected_components(simhash_links(nodes, radius)).select(F.col("node").alias("fp"), "component")
    distinct = rows.groupBy("key").agg(F.first("id").alias("id"), F.first("fp").alias("fp"), F.count("*").alias("n")).join(comps, "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    distinct = cut(distinct.select("key", "id", "n", "group"))
    stays = distinct.groupBy("group").agg(F.min_by("key", F.struct(F.col("id").isNull(), "id", "key")).alias("stays"))
    # Joined by the row and not by the group, which may hold a third of all rows.
    told = distinct.join(stays.select(F.col("stays").alias("key"), F.lit(True).alias("stay")), "key", "left")
    marked = cut(told.select(F.col("key").alias(key), F.col("stay").isNull().alias("gone"), "n").where("gone or n > 1"))
    alone = keyed.join(marked.select(key), key, "left_anti")
    twice = keyed.join(marked.where("not gone").select(key), key, "left_semi").dropDuplicates([key])
    return alone.unionByName(twice).select(*(F.col(f"`{c}`") for c in docs.columns))
