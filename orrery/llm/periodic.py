"""Periodic runs of words: power-of-two names of word blocks, and grid candidates extended with them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a run has, at least, whatever its period.
LEAST = 12
#: Words whose names are made together; a longer text is a group of its own.
GROUP = 200_000


def name_levels(words: np.ndarray) -> list[np.ndarray]:
    """Karp, Miller and Rosenberg's names: at level k two places have the same name if the 2**k words from there are equal.

    A block that occurs once, or that would pass the end, has a negative name of its own and is not named further; a
    level is made of pairs of names of the level before. The last level is the first that names no block.
    """
    n = len(words)
    alone = -1 - np.arange(n)
    _, names, counts = np.unique(words, return_inverse=True, return_counts=True)
    levels = [np.where(counts[names] > 1, names, alone)]
    width = 1
    while (levels[-1] >= 0).any():
        below, above = levels[-1], alone.copy()
        at = np.flatnonzero((below[: n - width] >= 0) & (below[width:] >= 0)) if width < n else np.zeros(0, np.int64)
        _, pair, counts = np.unique(below[at] * n + below[at + width], return_inverse=True, return_counts=True)
        often = counts[pair] > 1
        above[at[often]] = pair[often]
        levels.append(above)
        width *= 2
    return levels


def _forward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from the places i and j (i < j) on are equal."""
    n, same = len(levels[0]), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero(j + same < n)
        hit = inside[levels[k][i[inside] + same[inside]] == levels[k][j[inside] + same[inside]]]
        same[hit] += 1 << k
    return same


def _backward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before the places i and j (i < j) are equal."""
    same = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        back = same + (1 << k)
        inside = np.flatnonzero(i >= back)
        hit = inside[levels[k][i[inside] - back[inside]] == levels[k][j[inside] - back[inside]]]
        same[hit] += 1 << k
    return same


def _candidates(names: np.ndarray, step: int, near: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the grid and later places of the same name that are ``near`` to ``far`` words behind them."""
    n = len(names)
    named = np.flatnonzero(names >= 0)
    keys = np.sort(names[named] * n + named)
    grid = np.arange(0, n, step)
    grid = grid[names[grid] >= 0]
    base = names[grid] * n
    lo = np.searchsorted(keys, base + np.minimum(grid + near, n))
    hi = np.searchsorted(keys, base + np.minimum(grid + far + 1, n))
    count = hi - lo
    ends = np.cumsum(count)
    which = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(lo, count)
    return np.repeat(grid, count), keys[which] % n


def runs_of(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Runs of a sequence of numbers as rows (start, length, period), by start, then period.

    A run of period p and at least max(least, 2p) words holds max(least - p, p) words or more that equal the word p behind
    them. That stretch holds a whole block of s words from a place of a grid of step t, if s + t - 1 words fit into it.
    Blocks of s = 2**k words serve the periods from 2s - 1 up to 4s - 2 (the shortest blocks all periods below as well), so
    equal names at distances in that range are all candidates; there are at most some 2n of a level. Each is extended both
    ways by the names. A multiple of a run's period gives the same stretch, and the smallest stands.
    """
    levels = name_levels(words)
    shortest = (least + 1) // 2  # the shortest stretch: that of the period of half of ``least``
    k = max(0, (2 * (shortest + 1) // 3).bit_length() - 1)
    step = max(1, shortest + 1 - (1 << k))
    near, found = 1, []
    while k < len(levels):
        s = 1 << k
        far = 4 * s - 2
        i, j = _candidates(levels[k], step, near, far)
        if len(i):
            p = j - i
            before, after = _backward(levels, i, j), _forward(levels, i, j)
            start, length = i - before, before + after + p
            ok = length >= np.maximum(least, 2 * p)
            found.append(np.stack([start[ok], length[ok], p[ok]], 1))
        k, near, step = k + 1, far + 1, 2 * s
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _numbered(texts: list[list[bytes]]) -> np.ndarray:
    """A number for each word of all texts; words of different texts have different numbers, so that no block spans two."""
    out, at = [], 0
    for words in texts:
        own: dict[bytes, int] = {}
        out.append(np.fromiter((own.setdefault(w, len(own)) for w in words), np.int64, len(words)) + at)
        at += len(own)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _judged(texts: list[list[bytes]], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its runs, and which of its words stay."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    rows = runs_of(_numbered(texts), least)
    change = np.zeros(int(sizes.sum()) + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    stays = np.cumsum(change)[:-1] == 0
    cut = np.searchsorted(rows[:, 0], np.concatenate([[0], ends]))
    for t, end in enumerate(ends):
        own = rows[cut[t] : cut[t + 1]].copy()
        own[:, 0] -= end - sizes[t]
        yield own, stays[end - sizes[t] : end]


def _groups(texts: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """Consecutive texts of at most ``GROUP`` words together, or one longer text."""
    at, words = 0, 0
    for t, own in enumerate(texts):
        if t > at and words + len(own) > GROUP:
            yield at, t
            at, words = t, 0
        words += len(own)
    if at < len(texts):
        yield at, len(texts)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Stretches of words that repeat with a period, and the texts without the repetitions.

    Words are what ASCII white space divides, as they are written. A run is a stretch of at least ``least`` words and two
    smallest periods that no neighbouring word extends. Each text's words get names for blocks of 1, 2, 4, ... words
    (``name_levels``); places of a grid and later places of the same name are candidates, extended by descending levels of
    names. Whole texts are judged, whatever their length; a very long one takes some hundred bytes a word in its task.

    Returns one row per input row: ``id, n_words, runs`` (array of start, length, period, by start, then period; numbers of
    words from 0), ``collapsed`` (the words that no run holds behind its first period, joined by one space). A null or empty
    text has no words, no runs and an empty ``collapsed``. Ids may be null or repeat; no rows give no rows; other columns
    are ignored, whatever their names. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                ids = batch["id"].iloc[at : at + 256].tolist()
                texts = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in batch["text"].iloc[at : at + 256]]
                for lo, hi in _groups(texts):
                    rows = []
                    for words, (runs, stays) in zip(texts[lo:hi], _judged(texts[lo:hi], least), strict=True):
                        kept = words if stays.all() else compress(words, stays)
                        rows.append((len(words), [{"start": a, "length": b, "period": c} for a, b, c in runs.tolist()], b" ".join(kept).decode("utf-8", "surrogatepass")))
                    out = pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])
                    out.insert(0, "id", ids[lo:hi])
                    yield out

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInPandas(run, "id string, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))
