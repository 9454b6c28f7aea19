"""Quality by hierarchical empirical Bayes: a document's own evidence over the posterior of its host and path."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.lineage import cut, lookup

#: Labelled documents that the classifiers are fitted on, at most (those whose ids have the smallest hashes).
FIT_ROWS = 12_000
#: Word features of a classifier, those with the largest chi-squares.
WORD_FEATURES = 1024
_BUCKETS = 1 << 20
_MEMORY = 400_000
_MARKS = b"!%$#*&|@=_<>{}~^"
_EDGE = ".,;:!?%$#*&|()[]{}<>\"'-_=+~^/\\"


def _word_features(token: str) -> tuple[int, ...]:
    """Buckets of a token's word without marks at its ends, and of the word's beginnings."""
    w = token.lower().strip(_EDGE)
    return tuple(dict.fromkeys(zlib.crc32(p.encode("utf-8", "surrogatepass")) % _BUCKETS for p in (w, *(w[:n] + "-" for n in range(4, 8) if len(w) >= n)))) if w else ()


def _shape(text: str, words: Counter) -> list[float]:
    """Shares of kinds of bytes, and how often words repeat."""
    raw = text.encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / max(1, len(raw))
    n = sum(words.values())
    top = max(words.values(), default=0)
    return [
        float(hist[65:91].sum()), float(hist[48:58].sum()), float(hist[list(_MARKS)].sum()), float(hist[33]), float(hist[124]), float(hist[10]), float(hist[32]), float(hist[128:].sum()), float(hist[:9].sum()),
        math.log1p(n), math.log1p(len(words)) / math.log1p(n) if n else 1.0, top / n if n > 20 else 0.0, len(text) / n / 10 if n else 0.0,
    ]


@dataclass
class Head:
    """A logistic model of one label; ``logit`` is log-odds under the training share of positives."""

    shape: np.ndarray
    words: dict[int, float]
    bias: float
    prior: float
    centre: np.ndarray
    scale: np.ndarray

    def evidence(self, shape: list[float], present: set[int]) -> float:
        z = self.bias + float(((np.array(shape) - self.centre) / self.scale) @ self.shape) + sum(self.words.get(f, 0.0) for f in present)
        return z - self.prior


@dataclass
class Model:
    heads: list[Head]
    used: set[int] = field(default_factory=set)


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def _fit_head(shape: np.ndarray, docs: list[np.ndarray], y: np.ndarray, chosen: np.ndarray, rounds: int = 300) -> Head:
    """Fit one label on the shapes and on the ``chosen`` word features of the documents."""
    flat, of = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    share = y.mean()
    # The words of a document are ones in a sparse matrix: (row, column) of each.
    hit = np.isin(flat, chosen)
    row, column = of[hit], np.searchsorted(chosen, flat[hit])
    centre, scale = shape.mean(axis=0), shape.std(axis=0) + 1e-6
    x = (shape - centre) / scale
    n, k, m = len(y), x.shape[1], len(chosen)
    w, b, vw, vb = np.zeros(k + m), 0.0, np.zeros(k + m), 0.0
    # Steps of a diagonal majorant of the loss, with momentum; the penalty keeps separable features finite.
    size = np.abs(x).sum(axis=1) + np.bincount(row, minlength=n)
    step = 1.0 / (0.25 * np.concatenate([np.abs(x).T @ size, np.bincount(column, size[row], minlength=m)]) / n + 1e-3)
    for i in range(rounds):
        aw, ab = w + i / (i + 3) * vw, b + i / (i + 3) * vb
        z = x @ aw[:k] + np.bincount(row, aw[k:][column], minlength=n) + ab
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        nw = aw - step * (np.concatenate([x.T @ g, np.bincount(column, g[row], minlength=m)]) / n + 1e-3 * aw)
        nb = ab - 0.5 * float(g.mean())
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return Head(w[:k], {int(c): float(v) for c, v in zip(chosen, w[k:], strict=True) if abs(v) > 1e-4}, float(b), _logit(share), centre, scale)


def _features(text: str | None) -> tuple[Counter, set[int]]:
    words = Counter((text or "").split())
    return words, {f for w in words for f in _word_features(w)}


def _feature_counts(heads: list[str]):
    """For each feature the documents that have it, and those of them with each label; at -1 all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.fromiter(f, np.int64, len(f)) for f in (_features(t)[1] for t in batch["text"])]
            key, at = np.unique(np.concatenate([np.append(s, -1) for s in sets]), return_inverse=True)
            of = np.repeat(np.arange(len(sets)), [len(s) + 1 for s in sets])
            yield pd.DataFrame({"feature": key, "n": np.bincount(at)} | {h: np.bincount(at, batch[h].to_numpy(float)[of]).astype(np.int64) for h in heads})

    return run


def _featurise(chosen: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep = set(chosen.tolist())
        for batch in batches:
            out = []
            for text in batch["text"]:
                words, features = _features(text)
                out.append((np.array(sorted(features & keep), np.int64).tobytes(), _shape(text or "", words)))
            yield pd.DataFrame(out, columns=["words", "shape"]).assign(**{c: batch[c].to_numpy() for c in batch.columns if c != "text"})

    return run


def fit(docs: DataFrame, labels: DataFrame, heads: list[str], fit_rows: int = FIT_ROWS) -> Model:
    """Logistic models of the 0/1 columns ``heads`` of ``labels(id, ...)``, one row for each id, from ``docs(id, text)``.

    Word features are counted by Spark, and those with the largest chi-squares chosen for each label; the driver gets the
    sample's documents as these features only.
    """
    known = labels.where(" and ".join(f"{h} in (0, 1)" for h in heads)).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    sample = docs.join(F.broadcast(cut(known)), "id").select("text", *heads)
    counts = cut(sample.mapInPandas(_feature_counts(heads), "feature long, n long, " + ", ".join(f"{h} long" for h in heads)).groupBy("feature").agg(*(F.sum(c).alias(c) for c in ["n", *heads])).where("n >= 5 or feature < 0"))
    total = counts.where("feature < 0").first()
    if total is None:
        return Model([])
    chosen = []
    for h in heads:
        share = F.lit(total[h] / total["n"])
        chi = F.pow(F.col(h) - F.col("n") * share, 2) / (F.col("n") * share * (1 - share) + 1e-9)
        top = counts.where("feature >= 0").select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(WORD_FEATURES)
        chosen.append(np.array(sorted(r["feature"] for r in top.collect()), np.int64))
    every = np.unique(np.concatenate(chosen))
    rows = sample.mapInPandas(_featurise(every), "words binary, shape array<double>, " + ", ".join(f"{h} int" for h in heads)).toArrow()
    shape = rows["shape"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    words = [np.frombuffer(b, np.int64) for b in rows["words"].to_pylist()]
    model = Model([_fit_head(shape, words, rows[h].to_numpy().astype(float), c) for h, c in zip(heads, chosen, strict=True)])
    model.used = {f for h in model.heads for f in h.words}
    return model


def _score(model, n_heads: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = model.value
        seen: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for text in batch["text"]:
                if len(seen) > _MEMORY:
                    seen.clear()
                words, present = Counter((text or "").split()), set()
                for w in words:
                    if (f := seen.get(w)) is None:
                        f = seen[w] = tuple(x for x in _word_features(w) if x in m.used)
                    if f:
                        present.update(f)
                shape = _shape(text or "", words)
                out.append([h.evidence(shape, present) for h in m.heads] or [0.0] * n_heads)
            yield batch.drop(columns="text").assign(evidence=out)

    return run


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Pseudo-counts of a beta prior around ``mean``, by the moments of groups with ``n`` rows and ``s`` positives.

    The spread of the groups' shares beyond what their sizes explain is the prior's variance.
    """
    of = groups.select("n", (F.col("s") / F.col("n")).alias("m"), mean.alias("mu"))
    r = of.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("mu"), 2)).alias("v"), F.sum(F.col("n") * F.col("mu") * (1 - F.col("mu"))).alias("w")).first()
    if not r["n"]:
        return 1.0
    within = max(r["w"] / r["n"], 1e-9)
    between = max(r["v"] / r["n"] - within * r["k"] / r["n"], within / 1e5)
    return min(max(within / between - 1, 1.0), 1e5)


def _site(site: Column | None) -> Column:
    return F.coalesce((F.lit(None) if site is None else site).cast("string"), F.lit("\0"))


def _row_key(text, host, path) -> Column:
    return F.xxhash64(text, host, path)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, quality_col: str = "quality", toxic_col: str = "toxic", label_id_col: str | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Posterior probabilities that a document is of good quality and that it is toxic.

    Logistic classifiers (byte shares, repetition, hashed words and beginnings of words) give each document's evidence, a
    log-likelihood ratio. Each document then counts at its path and host: by its label if it has one, else by its
    probability under the global prior. Hosts shrink towards the global share and paths towards their host, with strengths
    estimated from all groups by moments; a document's own count is left out of its site's. Evidence and site add up in
    log-odds (``posterior``).

    Returns one row per input row: ``id, p_quality, p_toxic, kept`` (p_quality >= 0.5 and p_toxic < 0.5), and ``key``, a
    number of the row's text, host and path. Null hosts and paths are groups of their own; a null or empty text is judged
    as an empty one; whole texts count, however long; a null id has no label; repeated ids are separate rows; of repeated
    labels of an id the lowest quality and the highest toxicity count; without labels everything is kept at probabilities
    of one half. No rows give no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    heads = ["q", "t"]
    known = labels.select(F.col(label_id_col or id_col).cast("long").alias("id"), F.col(quality_col).cast("int").alias("q"), F.col(toxic_col).cast("int").alias("t")).where("id is not null")
    known = known.groupBy("id").agg(F.min("q").alias("q"), F.max("t").alias("t"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), _site(host).alias("host"), _site(path).alias("path"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("key", _row_key("text", "host", "path"))
    model = fit(texts.select("id", "text"), known, heads, fit_rows)
    scored = texts.mapInPandas(_score(spark.sparkContext.broadcast(model), len(heads)), "id long, host string, path string, key long, evidence array<double>")
    prior = [h.prior for h in model.heads] or [0.0] * len(heads)
    rows = scored.join(known, "id", "left")
    for i, h in enumerate(heads):
        rows = rows.withColumn(f"e_{h}", F.col("evidence")[i]).withColumn(f"s_{h}", F.when(F.col(h).isin(0, 1), F.col(h).cast("double")).otherwise(_sigmoid(F.col(f"e_{h}") + F.lit(prior[i]))))
    out = posterior(cut(rows.select("id", "key", "host", "path", *(f"{a}_{h}" for h in heads for a in "es"))), heads)
    if not model.heads:
        out = out.withColumns({f"p_{h}": F.lit(0.5) for h in heads})
    out = out.select("id", "key", F.col("p_q").alias("p_quality"), F.col("p_t").alias("p_toxic"))
    return out.withColumn("kept", (F.col("p_quality") >= 0.5) & ((F.col("p_toxic") < 0.5) | F.lit(not model.heads)))


def posterior(rows: DataFrame, heads: list[str]) -> DataFrame:
    """Adds ``p_<head>`` to rows (host, path, e_<head>: evidence, s_<head>: what the row counts at its site, 0 to 1).

    With the global share g, hosts of n rows that sum up to s, and strengths k: a row's host has the share
    (s_host - s_row + k_host g) / (n_host - 1 + k_host), its path (s_path - s_row + k_path share_host) / (n_path - 1 + k_path),
    and the posterior's log-odds are the evidence and those of the path.
    """
    paths = cut(rows.groupBy("host", "path").agg(F.count("*").alias("n"), *(F.sum(f"s_{h}").alias(f"s_{h}") for h in heads)))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *(F.sum(f"s_{h}").alias(f"host_s_{h}") for h in heads))
    both = paths.join(hosts, "host")
    total = hosts.agg(F.sum("host_n").alias("n"), *(F.sum(f"host_s_{h}").alias(h) for h in heads)).first()
    n_paths = paths.count()
    out = lookup(rows, both.select("host", "path", "n", "host_n", *(F.col(f"s_{h}").alias(f"path_s_{h}") for h in heads), *(f"host_s_{h}" for h in heads)), ["host", "path"], "inner", n_paths)
    for h in heads:
        share = total[h] / total["n"] if total["n"] else 0.5
        k_host = _strength(hosts.select(F.col("host_n").alias("n"), F.col(f"host_s_{h}").alias("s")), F.lit(share))
        k_path = _strength(both.select("n", F.col(f"s_{h}").alias("s"), ((F.col(f"host_s_{h}") + k_host * share) / (F.col("host_n") + k_host)).alias("mu")), F.col("mu"))
        of_host = (F.col(f"host_s_{h}") - F.col(f"s_{h}") + k_host * share) / (F.col("host_n") - 1 + k_host)
        of_path = (F.col(f"path_s_{h}") - F.col(f"s_{h}") + k_path * of_host) / (F.col("n") - 1 + k_path)
        out = out.withColumn(f"p_{h}", _sigmoid(F.col(f"e_{h}") + _odds(of_path)))
    return out


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, **options) -> DataFrame:
    """``docs`` without the rows that their posteriors reject; each row is judged by itself, also where its id is null or repeats."""
    gone = quality(docs, labels, id_col, text_col, host, path, **options).where("not kept").select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("row_id"), _row_key(F.col(text_col).cast("string"), _site(host), _site(path)).alias("row_key"))
    return rows.join(gone, F.col("row_id").eqNullSafe(F.col("gone_id")) & (F.col("row_key") == F.col("gone_key")), "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
