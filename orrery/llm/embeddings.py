"""Near-duplicate vectors: spherical k-means cells, blocked cosines, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.lineage import cut, lookup
from orrery.llm.common import by_batch
from orrery.llm.components import connected_components

#: Vectors that the centroids are fitted on, at least (those with the smallest hashes), and for each centroid.
FIT_ROWS, FIT_EACH = 20_000, 8
#: Vectors in a tile.
TILE = 512
#: How far a vector looks over its cell's borders, in standard deviations of how partners differ along a direction.
REACH = 2.5


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], c)
    return c


def _vector(column: str):
    """The vector as doubles, or null where it can link with nothing."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), v)


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in rows])
    # Scaled first: the squares of very large or very small components leave the range of doubles.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _spread(x: np.ndarray, centroids: np.ndarray) -> float:
    """Standard deviation, along the direction where it is largest, of the unit differences of vectors from their centroids."""
    if x.shape[1] > 4096:
        return 1.0
    home = np.concatenate([np.argmax(x[i : i + 4096] @ centroids.T, axis=1) for i in range(0, len(x), 4096)])
    apart = x - centroids[home]
    size = np.linalg.norm(apart, axis=1)
    apart = apart[size > 1e-9] / size[size > 1e-9, None]
    return math.sqrt(float(np.linalg.eigvalsh(apart.T @ apart / len(apart))[-1])) if len(apart) else 1.0


def cells_of(x: np.ndarray, centroids: np.ndarray, slope: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The home cell of each unit vector, and the cells of larger number in which a partner may be at home.

    A partner that differs by the angle whose tangent is ``slope`` (or less, along the line between two centroids) crosses
    the border to a cell if the vector's distance to that border is no more than ``slope`` times the centroids' distance.
    """
    home, visits = np.zeros(len(x), int), []
    step = max(16, (4 << 20) // len(centroids))
    for at in range(0, len(x), step):
        cos = x[at : at + step] @ centroids.T
        own = home[at : at + step] = np.argmax(cos, axis=1)
        # Distances to the other centroids from these vectors' own cells only: no table of all pairs of centroids.
        cells, back = np.unique(own, return_inverse=True)
        apart = np.sqrt(np.maximum(2 - 2 * (centroids[cells] @ centroids.T), 0))
        near = cos[np.arange(len(own)), own][:, None] - cos <= slope * apart[back] + 1e-9
        near &= np.arange(len(centroids))[None, :] > own[:, None]
        visits += [np.flatnonzero(r) for r in near]
    return home, visits


def _assign(centroids):
    """Home cells and visited cells; vectors of a length of no more than a tile share one cell."""

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for length, same in rows.groupby(rows["v"].map(len), sort=False):
            x = _unit(same["v"])
            if length in centroids.value:
                c, slope = centroids.value[length]
                home, visits = cells_of(x, c, slope)
            else:
                home, visits = np.zeros(len(x), int), [np.zeros(0, int)] * len(x)
            out.append(pd.DataFrame({"node": same["node"], "copies": same["copies"], "length": length, "home": home.astype(np.int32), "visits": [v.astype(np.int32) for v in visits], "u": [r.tobytes() for r in x]}))
        return pd.concat(out)

    return by_batch(batch)


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=np.float64).reshape(len(blobs), -1)


def _compare(threshold: float):
    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield from _tile(row, threshold)

    return pairs


def _tile(row, threshold: float) -> Iterator[pd.DataFrame]:
    """Degrees (links of each vector, copies counted) and a spanning forest of one pair of tiles."""
    a, b = np.asarray(row.nodes), np.asarray(row.nodes2)
    wa, wb = np.asarray(row.copies), np.asarray(row.copies2)
    x, y = _matrix(row.us), _matrix(row.us2)
    # A product in single precision rules out all but the pairs near or above the threshold; those are judged in double.
    # Its error is under one rounding for each component, and those of the two vectors.
    margin = 2.0**-23 * (x.shape[1] + 4)
    i, j = np.nonzero(x.astype(np.float32) @ y.astype(np.float32).T >= threshold - margin)
    if row.same:
        i, j = i[a[i] < b[j]], j[a[i] < b[j]]
    if not len(i):
        return
    ok = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    i, j = i[ok], j[ok]
    if not len(i):
        return
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    degree = np.zeros(len(nodes), dtype=np.int64)
    np.add.at(degree, back[: len(a)][i], wb[j])
    np.add.at(degree, back[len(a) :][j], wa[i])
    label = np.arange(len(nodes))
    p, q = back[: len(a)][i], back[len(a) :][j]
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    touched = np.flatnonzero(degree > 0)
    yield pd.DataFrame({"node": nodes[touched], "links": degree[touched], "root": nodes[label[touched]]})


def fitted_cells(vectors: DataFrame, threshold: float, fit_rows: int = FIT_ROWS, reach: float = REACH, exact: bool = False, tile: int = TILE) -> dict[int, tuple[np.ndarray, float]]:
    """Centroids and slope (see ``cells_of``) for each length that more than ``tile`` of vectors(key, v) have.

    There are as many cells as vectors in each, the square root of their number, so cells and centroids grow alike; what the
    driver holds grows with the root only. Each length has a sample of its own, of some ``fit_rows`` vectors, or
    ``FIT_EACH`` for each centroid if that is more: those whose keys' hashes are below the length's share, so that nothing is
    sorted. A partner's difference is taken to be spread over directions as unevenly as those of vectors from their centroids.
    """
    length = F.size("v").alias("length")
    known = {r["length"]: r["n"] for r in vectors.groupBy(length).agg(F.count("*").alias("n")).where(F.col("n") > tile).collect()}
    if not known:
        return {}
    shares = [(m, n, min(1.0, max(fit_rows, FIT_EACH * math.isqrt(n)) / n)) for m, n in known.items()]
    wanted = vectors.sparkSession.createDataFrame(shares, "length int, n long, share double")
    drawn = vectors.withColumn("length", length).join(F.broadcast(wanted), "length").where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    sample = drawn.select("length", F.xxhash64("key").alias("at"), "v").toArrow().to_pandas().sort_values(["length", "at"])
    out = {}
    for m, rows in sample.groupby("length"):
        x = _unit(rows["v"])
        k = max(1, min(math.isqrt(known[m]), len(x) // 2))
        c = _spherical_kmeans(x, k)
        slope = math.sqrt(1 - threshold**2) / threshold * (1.0 if exact else min(1.0, reach * _spread(x, c)))
        out[int(m)] = (c, slope)
    return out


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, fit_rows: int = FIT_ROWS, tile: int = TILE, reach: float = REACH, exact: bool = False) -> DataFrame:
    """Links of vectors whose cosine is at least ``threshold`` (over 0), and the groups that they make.

    Spherical k-means deals the distinct vectors into cells (``fitted_cells``). Each vector also visits the cells in which
    its partners may be at home: those to whose border its distance is within what a partner's difference reaches along a
    direction, ``reach`` standard deviations of it. Blocked cosine products compare the members of a cell with each other
    and with its visitors. With ``exact``, a vector visits every cell that any partner could be in, so no link can be lost;
    without it, one is lost if the partner differs mostly along the line between two centroids (tests compare with brute
    force). Equal vectors are compared once and count as many times as they occur.

    Returns one row per input row: ``id, n_links`` (other rows linked directly), ``component_id`` (the smallest id that
    links reach, itself included), ``kept`` (id = component_id). Vectors that are null, zero, hold a null or non-finite
    component, or differ in length from the others' link with none (vectors of each length are compared among themselves;
    those of a length that no more than ``tile`` distinct vectors have in one cell). A null id makes a row of its own with nulls. Rows of one id
    have the links of their own vectors each, and are one in components. No rows give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), _vector(vector_col).alias("v"))
    # Equal vectors meet by their bits; -0.0 equals 0.0.
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x))).withColumn("key", F.when(F.col("v").isNotNull() & F.col("id").isNotNull(), F.sha2(F.to_json("v"), 256)))
    of_key = cut(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("smallest"), F.count("*").alias("copies"), F.first("v").alias("v")))
    # A vector's own number is its smallest id, and another one if that id has several vectors.
    nodes = of_key.withColumn("node", F.xxhash64("key"))
    state = spark.sparkContext.broadcast(fitted_cells(of_key.select("key", "v"), threshold, fit_rows, reach, exact, tile))
    cells = cut(nodes.select("node", "copies", "v").mapInPandas(_assign(state), "node long, copies long, length int, home int, visits array<int>, u binary"))
    links = cut(_links(cells, threshold, tile))
    of_node = links.groupBy("node").agg(F.sum("links").alias("links"))
    # Components of ids: a vector's rows are joined by its smallest id.
    smallest = nodes.select("node", "smallest")
    ends = links.select("node", "root").where("node <> root").join(smallest, "node").join(smallest.select(F.col("node").alias("root"), F.col("smallest").alias("other")), "root").select(F.col("smallest").alias("a"), F.col("other").alias("b"))
    several = rows.where("key is not null").select("key", "id").distinct().join(of_key.select("key", "smallest"), "key").where("id <> smallest").select(F.col("id").alias("a"), F.col("smallest").alias("b"))
    comps = connected_components(ends.unionByName(several))
    per_row = rows.select("id", "key").join(nodes.select("key", "node", "copies"), "key", "left").join(of_node, "node", "left")
    per_row = per_row.withColumn("n", F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1)
    out = per_row.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select("id", F.when(F.col("id").isNotNull(), F.col("n")).cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def _links(cells: DataFrame, threshold: float, tile: int) -> DataFrame:
    """``node, links, root`` for each pair of tiles: a node's linked rows there, and the smallest node of its group there."""
    cell = ["length", "cell"]
    home = cells.select("length", F.col("home").alias("cell"), F.lit(False).alias("visitor"), "node", "copies", "u")
    away = cells.select("length", F.explode("visits").alias("cell"), F.lit(True).alias("visitor"), "node", "copies", "u")
    both = home.unionByName(away)
    sizes = cut(both.groupBy(*cell, "visitor").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks")))
    tiles = (
        lookup(both, sizes, [*cell, "visitor"], "inner")
        .withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
        .groupBy(*cell, "visitor", "chunk")
        .agg(F.collect_list(F.struct("node", "copies", "u")).alias("m"))
        .select(*cell, "visitor", "chunk", F.col("m.node").alias("nodes"), F.col("m.copies").alias("copies"), F.col("m.u").alias("us"))
    )
    left = tiles.where("not visitor").drop("visitor")
    right = tiles.select(*cell, F.col("visitor").alias("visitor2"), F.col("chunk").alias("chunk2"), F.col("nodes").alias("nodes2"), F.col("copies").alias("copies2"), F.col("us").alias("us2"))
    pairs = left.join(right, cell).where("visitor2 or chunk <= chunk2").withColumn("same", F.expr("not visitor2 and chunk = chunk2"))
    return pairs.select("nodes", "copies", "us", "nodes2", "copies2", "us2", "same").mapInPandas(_compare(threshold), "node long, links long, root long")
