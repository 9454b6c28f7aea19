"""Class-based bigrams: exchange clustering of words into classes, class transitions and word emissions."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.lineage import dropped, written
from orrery.llm.common import ascii_words

#: Classes, and words that are exchanged among them one by one (the most frequent ones; the others then join a class each).
CLASSES, CORE = 64, 8192
#: Passes over the training texts that gather contexts, and sweeps over the words after each.
PASSES, SWEEPS = 3, 2
#: Bytes of text whose vocabulary is looked up together.
BLOCK = 24 << 20
SLICE = 512
#: Words that travel back from a batch at a time, so that their copies on the way stay small.
PIECE = 32_768
END = b""  # no word is empty


class _Numbered(dict):
    """Numbers keys as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class _Known(dict):
    """Numbers of keys; other keys share one."""

    def __init__(self, numbers: dict, other: int):
        super().__init__(numbers)
        self.other = other

    def __missing__(self, key):
        return self.other


def _sequence(texts, number) -> np.ndarray:
    """Numbers of all tokens: an end before the first text and behind each."""
    end = number(END)
    out = [end]
    for t in texts:
        out += map(number, ascii_words(t))
        out.append(end)
    return np.array(out, np.int64)


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        c: Counter = Counter()
        for t in batch["text"]:
            c.update(ascii_words(t))
        for part in batched(c.items(), PIECE):
            yield pd.DataFrame({"word": [w.decode("utf-8", "replace") for w, _ in part], "n": [k for _, k in part]})


def _core_sequences(model):
    """Numbers of the core words of texts, ``SLICE`` texts to a row; all other words have the next number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        core = model.value
        number, kind = _Known(core, len(core)).__getitem__, np.min_scalar_type(len(core))
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                yield pd.DataFrame({"ids": [_sequence(batch["text"].iloc[at : at + SLICE], number).astype(kind).tobytes()]})

    return run


def _contexts_of_core(model):
    """Counts of (core word, class that follows) and (core word, class that precedes) as (key, n)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = model.value
        m, k = len(of) - 1, int(of[-1]) + 1  # the last entry stands for all other words
        total = np.zeros((2, (m + 1) * k), np.int64)
        for batch in batches:
            for blob in batch["ids"]:
                ids = np.frombuffer(blob, np.min_scalar_type(m)).astype(np.int64)
                cls, key = of[ids], ids * k
                total[0] += np.bincount(key[:-1] + cls[1:], minlength=(m + 1) * k)
                total[1] += np.bincount(key[1:] + cls[:-1], minlength=(m + 1) * k)
        flat = total.ravel()
        key = np.flatnonzero(flat)
        yield pd.DataFrame({"key": key, "n": flat[key]})

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(after: np.ndarray, before: np.ndarray, of: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Move each word, the most frequent first, to the class where the likelihood of the class bigrams gains most.

    ``after[w, c]`` and ``before[w, c]`` count the classes around word w (column ``classes``: words outside of the core);
    word 0, the end, keeps class 0 for itself.
    """
    of = of.copy()
    k = classes
    freq = after.sum(axis=1)
    into, out = np.zeros((k, k + 1)), np.zeros((k, k + 1))
    np.add.at(out, of, after)
    np.add.at(into, of, before)
    size = np.bincount(of, weights=freq, minlength=k)
    for _ in range(sweeps):
        moved = 0
        for w in range(1, len(of)):
            if not freq[w]:
                continue
            old = of[w]
            out[old] -= after[w]
            into[old] -= before[w]
            size[old] -= freq[w]
            a, b = np.flatnonzero(after[w]), np.flatnonzero(before[w])
            gain = (_xlogx(out[:, a] + after[w, a]) - _xlogx(out[:, a])).sum(axis=1) + (_xlogx(into[:, b] + before[w, b]) - _xlogx(into[:, b])).sum(axis=1) - 2 * (_xlogx(size + freq[w]) - _xlogx(size))
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            moved += new != old
            of[w] = new
            out[new] += after[w]
            into[new] += before[w]
            size[new] += freq[w]
        if not moved:
            break
    return of


_CONTEXT = np.dtype([("c", "u1"), ("n", "<u4")])


def _contexts_of_others(model):
    """For each word outside of the core: occurrences, and how often which class comes before and after it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        core, of = model.value
        m, k = len(core), int(of[-1]) + 1
        for batch in batches:
            number = _Numbered(core)
            ids = np.concatenate([_sequence(batch["text"].iloc[at : at + SLICE], number.__getitem__) for at in range(0, len(batch), SLICE)])
            at = np.flatnonzero(ids >= m)
            if not len(at):
                continue
            cls = of[np.minimum(ids, m)]
            own = ids[at] - m
            times, words = np.bincount(own), list(number)[m:]
            key, n = np.unique(np.concatenate([own * (2 * k) + cls[at - 1], own * (2 * k) + k + cls[at + 1]]), return_counts=True)
            del number, ids, at, cls, own
            rows = np.zeros(len(key), _CONTEXT)
            rows["c"], rows["n"] = key % (2 * k), n
            cut = np.searchsorted(key, np.arange(len(words) + 1) * (2 * k))
            for s in range(0, len(words), PIECE):
                part = words[s : s + PIECE]
                yield pd.DataFrame({"word": [w.decode("utf-8", "replace") for w in part], "n": times[s : s + PIECE], "ctx": [rows[a:b].tobytes() for a, b in zip(cut[s:], cut[s + 1 : s + 1 + len(part)], strict=False)]})

    return run


def _join_classes(likelihood):
    """Each word's best class; rows come sorted by word, and a word's contexts are summed as they come."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = likelihood.value
        word, count, score = None, 0, None
        for batch in batches:
            if not len(batch):
                continue
            ws = batch["word"].to_numpy()
            new = np.flatnonzero(np.concatenate([[True], ws[1:] != ws[:-1]]))
            ctx = np.frombuffer(b"".join(batch["ctx"]), _CONTEXT)
            starts = np.concatenate([[0], np.cumsum([len(x) // _CONTEXT.itemsize for x in batch["ctx"]])])
            scores = np.add.reduceat(table[ctx["c"]] * ctx["n"][:, None], starts[new], axis=0)
            counts = np.add.reduceat(batch["n"].to_numpy(), new)
            names = ws[new]
            if word is not None:
                if names[0] == word:
                    counts[0] += count
                    scores[0] += score
                else:
                    yield pd.DataFrame({"word": [word], "n": [count], "cls": [int(np.argmax(score))]})
            word, count, score = names[-1], counts[-1], scores[-1]
            yield pd.DataFrame({"word": names[:-1], "n": counts[:-1], "cls": np.argmax(scores[:-1], axis=1)})
        if word is not None:
            yield pd.DataFrame({"word": [word], "n": [count], "cls": [int(np.argmax(score))]})

    return run


def _asked_words(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        core = model.value
        for batch in batches:
            for block, rows in batch.groupby("block"):
                words: set[bytes] = set()
                for t in rows["text"]:
                    words.update(ascii_words(t))
                words.difference_update(core)
                for part in batched(words, PIECE):
                    yield pd.DataFrame({"block": block, "word": [w.decode("utf-8", "replace") for w in part]})

    return run


def _score_block(model):
    """The parts of each document's scores that need its words; ``classes`` has a byte for each token (see ``transitions``)."""

    def run(docs: pd.DataFrame, vocab: pd.DataFrame) -> pd.DataFrame:
        core, counts, cls, size, total, distinct = model.value
        known = dict(core)
        # By row: a word comes once for each batch of its block's texts, and must not shift the rows behind it.
        known.update((w.encode("utf-8"), i) for i, w in enumerate(vocab["word"], len(core)))
        n = np.concatenate([counts, vocab["n"].to_numpy(np.int64), [0]])
        known = _Known(known, len(n) - 1)
        of = np.concatenate([cls, vocab["cls"].to_numpy(np.int64), [0]])
        base = np.log10((n + 0.5) / (total + 0.5 * (distinct + 1)))
        emit = np.where(n > 0, np.log10(np.maximum(n, 1) / np.maximum(size[of], 1)), 0.0)
        k = len(size)
        code = np.where(n > 1, of, np.where(n == 1, of + k, 2 * k)).astype(np.uint8)
        out = []
        for i, held, t in zip(docs["id"], docs["held_out"], docs["text"], strict=True):
            ids = _sequence([t], known.__getitem__)[1:]
            out.append((i, held, len(ids), int((n[ids] > 0).sum()), float(base[ids].sum()), float(emit[ids].sum()), code[ids].tobytes()))
        return pd.DataFrame(out, columns=["id", "held_out", "n_tokens", "n_known", "base_score", "emission", "classes"])

    return run


def _pairs(blob: bytes, first: int) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(blob, np.uint8).astype(np.int64)
    return np.concatenate([[first], codes[:-1]]), codes


def _transition_counts(k: int, first: int):
    width = 2 * k + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width * width, np.int64)
        for batch in batches:
            for blob in batch["classes"]:
                a, b = _pairs(blob, first)
                total += np.bincount(a * width + b, minlength=width * width)
        key = np.flatnonzero(total)
        yield pd.DataFrame({"key": key, "n": total[key]})

    return run


def transitions(counts: np.ndarray, k: int, strength: float = 16.0) -> np.ndarray:
    """log10 P(class | class before) from counts of codes: class, k + class for a word seen once, 2k for an unknown word.

    Row and column ``k`` of the result are the unknown word's. Words seen once stand for unknown ones: they give the share of
    unknown words after each class, and what follows an unknown word. Rows shrink towards the classes' overall shares.
    """
    a, b = np.divmod(np.arange(counts.size), 2 * k + 1)
    n, c, once = counts.ravel().astype(float), np.zeros((k + 1, k)), np.zeros(k + 1)
    ok = (a < 2 * k) & (b < 2 * k)
    np.add.at(c, (a[ok] % k, b[ok] % k), n[ok])
    np.add.at(once, a[ok & (b >= k)] % k, n[ok & (b >= k)])
    rare = ok & (a >= k)
    np.add.at(c, (np.full(rare.sum(), k), b[rare] % k), n[rare])
    once[k] = n[rare & (b >= k)].sum()
    total = c[:k].sum()
    share = c[:k].sum(axis=0) / total if total else np.zeros(k)
    unknown = (once[:k].sum() + 0.5) / (total + 1) if total else 1.0
    rows = c.sum(axis=1)
    u = np.minimum((once + strength * unknown) / (rows + strength), 1 - 1e-9 if total else 1.0)
    p = np.zeros((k + 1, k + 1))
    p[:, :k] = (1 - u[:, None]) * (c + strength * share) / (rows[:, None] + strength)
    p[:, k] = u
    return np.log10(np.maximum(p, 1e-300))


def _final(log_t, k: int, first: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = log_t.value
        fold = np.append(np.tile(np.arange(k), 2), k)
        for batch in batches:
            scores = []
            for blob, e in zip(batch["classes"], batch["emission"], strict=True):
                a, b = _pairs(blob, first)
                scores.append(e + float(t[fold[a], fold[b]].sum()))
            yield batch.drop(columns=["classes", "emission"]).assign(score=scores)

    return run


def _dense(counts: DataFrame, n: int) -> np.ndarray:
    """A table (key, n) of at most n rows as an array; it comes in columns, as rows would take ten times the memory."""
    t, out = counts.toArrow(), np.zeros(n, np.int64)
    out[t["key"].to_numpy()] = t["n"].to_numpy()
    return out


def class_bigram_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, classes: int = CLASSES, core_words: int = CORE, passes: int = PASSES, block_bytes: int = BLOCK) -> DataFrame:
    """Scores of all texts under a class bigram model and a unigram model of the training texts.

    Words have A-Z in lower case and are divided at ASCII white space; an end token follows each text. ``held_out`` is a
    boolean column of the rows that the models do not learn from (default: CRC-32 of the id as text mod 5 is 1).

    Learning: exchange clustering moves the ``core_words`` most frequent words among the classes, each to where the class
    bigrams' likelihood gains most, by contexts counted over all training texts; every other word then joins the class under
    which its own contexts are likeliest. Class transitions are counted over all training texts, shrunk towards the classes'
    shares; a word's emission is its share of its class. Unknown words have a class of their own (see ``transitions``), so
    that the model is a distribution over the known words and one unknown word.

    Returns one row per input row: ``id, held_out, n_tokens, n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (log10, add-half unigrams), ``score`` (log10 probability of the text under the class model). Null and
    empty texts are a single end; a null id is in training; repeated ids are separate rows; without training rows every
    token is unknown and both scores are 0. No rows give no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    held = held_out if held_out is not None else F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    train = texts.where("not held_out").select("text")
    n_train = train.count()

    # The most frequent words, by counts over all training texts; only which words are exchanged depends on them.
    top = train.mapInPandas(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(core_words).collect()
    core: dict[bytes, int] = {END: 0} | {r["word"].encode("utf-8"): i + 1 for i, r in enumerate(top)}
    m, k = len(core), max(2, min(classes, len(core) - 1, 100))
    # The end and the most frequent words start with classes of their own, the others share the last one.
    of = np.minimum(np.arange(m), k - 1)
    after = before = np.zeros((m, k + 1))
    # Words are looked up once; the passes read numbers.
    sequences = written(train.mapInPandas(_core_sequences(sc.broadcast(core)), "ids binary"), "core-sequences", compression="zstd")
    for _ in range(passes):
        state = sc.broadcast(np.append(of, k))
        found = sequences.mapInPandas(_contexts_of_core(state), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        both = _dense(found, 2 * (m + 1) * (k + 1)).reshape(2, m + 1, k + 1)[:, :m].astype(float)
        after, before = both
        of = exchange(after, before, of, k)

    dropped(sequences)
    counts = after.sum(axis=1).astype(np.int64)
    counts[0] = n_train  # the end before a batch's first text is not a token
    out, into = np.zeros((k, k + 1)), np.zeros((k, k + 1))
    np.add.at(out, of, after)
    np.add.at(into, of, before)
    size = np.log(out.sum(axis=1) + 0.1 * (k + 1))
    # Contexts: the class before (0..k, k: outside of the core), then the class after.
    likelihood = np.concatenate([np.log(into.T + 0.1) - size, np.log(out.T + 0.1) - size])
    likelihood[:, 0] = -1e9  # the end's own class takes no word
    likelihood[:, 1:][:, np.bincount(of, minlength=k)[1:] == 0] -= 1e6
    state = sc.broadcast((core, np.append(of, k)))
    others = train.mapInPandas(_contexts_of_others(state), "word string, n long, ctx binary").repartition("word").sortWithinPartitions("word").mapInPandas(_join_classes(sc.broadcast(likelihood)), "word string, n long, cls int")
    others = written(others, "vocabulary")
    sums = {r["cls"]: r for r in others.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    class_size = np.bincount(of, weights=counts, minlength=k) + np.array([sums[c]["n"] if c in sums else 0 for c in range(k)])
    total = int(class_size.sum())
    distinct = (m if n_train else 0) + sum(r["v"] for r in sums.values())

    # A block of texts and the vocabulary that it uses meet in one task.
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = texts.withColumn("block", F.pmod(F.xxhash64("id", F.length("text")), F.lit(max(1, math.ceil(n_bytes / block_bytes)))).cast("int")).repartition("block")
    # All columns go along, so that both readers of the blocks share one exchange of the texts.
    asked = blocks.mapInPandas(_asked_words(sc.broadcast(core)), "block int, word string")
    answers = asked.join(others, "word").select("block", "word", "n", "cls")
    model = sc.broadcast((core, counts, of, class_size, total, distinct))
    parts = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score_block(model), "id long, held_out boolean, n_tokens long, n_known long, base_score double, emission double, classes binary")
    parts = written(parts, "class-sequences")
    first = 0 if counts[0] > 1 else (k if counts[0] == 1 else 2 * k)
    found = parts.where("not held_out").select("classes").mapInPandas(_transition_counts(k, first), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    log_t = transitions(_dense(found, (2 * k + 1) ** 2), k)
    done = parts.mapInPandas(_final(sc.broadcast(log_t), k, first), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select("id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
