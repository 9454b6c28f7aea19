"""Token counts that follow edits: a segment tree over the pre-tokens of each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.bpe import _WS, MEMORY, SLICE, Bpe
from orrery.llm.text_encoder import LONG, TextEncoder, Vocabulary, vocabulary

#: Pre-tokens in a leaf when a tree is built; a leaf that an edit makes twice as long is halved.
LEAF = 64
#: How many characters behind its end a pre-token's match can depend on ("'r" waits for an "e", white space for what follows).
REACH = 2

EDITS = "array<struct<start:int,end:int,text:string>>"


class PreTokenCounter:
    """Pre-tokens of a byte-level vocabulary and their numbers of tokens.

    With ``special_tokens``, a special token that a text spells out is one pre-token of one token, and what is between two
    of them is divided by itself, as the library does unless told otherwise; without, their letters are ordinary text.
    """

    def __init__(self, model: tuple[Bpe, Vocabulary], special_tokens: bool = True):
        self.bpe, self.encoder = model[0], TextEncoder(model[1])
        self.special = dict(self.bpe.special) if special_tokens else {}
        # The longest first: one may begin another.
        names = sorted(self.special, key=len, reverse=True)
        self.special_at = regex.compile("|".join(map(regex.escape, names))) if names else None
        # A new special token may begin so far before an edit, and what is before it then ends there.
        self.reach = REACH + max(map(len, names), default=0)
        self.pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
        self.known: dict[str, int] = {}

    def counts(self, pre: list[str]) -> np.ndarray:
        if len(self.known) > MEMORY:
            self.known.clear()
        if new := [p for p in set(pre) if p not in self.known and p not in self.special]:
            self.known.update((p, self.encoder.tokens_in(p) if len(p) < LONG else len(self.bpe.merge(p.encode("utf-8", "surrogatepass")))) for p in new)
        self.known.update(dict.fromkeys(self.special, 1))
        return np.fromiter(map(self.known.__getitem__, pre), np.int64, len(pre))

    def pieces(self, text: str, begin: int = 0) -> Iterator[tuple[str, int]]:
        """Pre-tokens from a border on, each with where it ends."""
        for m in self.special_at.finditer(text, begin) if self.special else ():
            for p in self.pattern.finditer(text, begin, m.start()):
                yield p.group(), p.end()
            yield m.group(), m.end()
            begin = m.end()
        for p in self.pattern.finditer(text, begin):
            yield p.group(), p.end()

    def measured(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and token counts of a text's pre-tokens."""
        spelled = self.special and any(x in text for x in self.special)
        pre = [p for p, _ in self.pieces(text)] if spelled else self.pattern.findall(text)
        return np.fromiter(map(len, pre), np.int64, len(pre)), self.counts(pre)


def packed(lens: np.ndarray, toks: np.ndarray) -> bytes:
    """Pre-tokens as bytes: the width of a number, their lengths, their token counts."""
    top = max(lens.max(initial=0), toks.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([width]) + lens.astype(f"<u{width}").tobytes() + toks.astype(f"<u{width}").tobytes()


def unpacked(stored: bytes) -> tuple[np.ndarray, np.ndarray]:
    lens, toks = np.frombuffer(stored, f"<u{stored[0]}", offset=1).astype(np.int64).reshape(2, -1)
    return lens, toks


class CountTree:
    """Leaves hold the lengths and token counts of some pre-tokens; inner nodes the sums over their subtrees."""

    def __init__(self, counter: PreTokenCounter, text: str, stored: bytes | None = None):
        self.counter, self.text, self.encoded = counter, text, 0
        lens, toks = counter.measured(text) if stored is None else unpacked(stored)
        self.leaves = [(lens[i : i + LEAF], toks[i : i + LEAF]) for i in range(0, len(lens), LEAF)] or [(lens, toks)]
        self._build(lens, toks, np.arange(0, len(lens), LEAF))

    def _build(self, lens: np.ndarray, toks: np.ndarray, starts: np.ndarray) -> None:
        n = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * n, 2), np.int64)
        if len(starts):
            self.sums[n : n + len(starts), 0], self.sums[n : n + len(starts), 1] = np.add.reduceat(lens, starts), np.add.reduceat(toks, starts)
        while n > 1:
            self.sums[n // 2 : n] = self.sums[n : 2 * n : 2] + self.sums[n + 1 : 2 * n : 2]
            n //= 2

    def stored(self) -> bytes:
        return packed(*(np.concatenate([leaf[i] for leaf in self.leaves]) for i in (0, 1)))

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def pre_tokens(self) -> int:
        return sum(len(le) for le, _ in self.leaves)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place`` (the last leaf, if none), and where it starts."""
        node, start, half = 1, 0, len(self.sums) // 2
        while node < half:
            node *= 2
            if place - start >= self.sums[node, 0] and node + 1 < len(self.sums) and self.sums[node + 1, 0] > 0:
                start += int(self.sums[node, 0])
                node += 1
        return min(node - half, len(self.leaves) - 1), start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from ``start`` to ``end`` (clipped to the text) by ``new``."""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        # Pre-tokens that end more than the counter's reach before the edit stay: what they depend on is as before.
        first, at = self._leaf_at(max(0, start - self.counter.reach - 1))
        borders = np.cumsum(self.leaves[first][0]) + at
        skip = int(np.searchsorted(borders, start - self.counter.reach))
        begin = int(borders[skip - 1]) if skip else at
        # Old borders at or behind the edit, leaf by leaf; new pre-tokens are made until one ends at such a border.
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        last, border, k = first, begin, skip
        place, pre = begin, []
        for piece, until in self.counter.pieces(text, begin):
            while border < end or border + shift < place:
                if k >= len(self.leaves[last][0]):
                    if last + 1 == len(self.leaves):
                        break
                    last, k = last + 1, 0
                    continue
                border += int(self.leaves[last][0][k])
                k += 1
            if border >= end and border + shift == place and place >= start + len(new):
                break
            pre.append(piece)
            place = until
        if place == len(text):
            last, k = len(self.leaves) - 1, len(self.leaves[-1][0])
        self.encoded += len(pre)
        lens, toks = np.fromiter(map(len, pre), np.int64, len(pre)), self.counter.counts(pre)
        own = (np.concatenate([self.leaves[first][0][:skip], lens, self.leaves[last][0][k:]]), np.concatenate([self.leaves[first][1][:skip], toks, self.leaves[last][1][k:]]))
        self.text = text
        if first == last and 0 < len(own[0]) <= 2 * LEAF:
            self.leaves[first] = own
            node = first + len(self.sums) // 2
            self.sums[node] = own[0].sum(), own[1].sum()
            while node > 1:
                node //= 2
                self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
        else:
            cut = [(own[0][i : i + LEAF], own[1][i : i + LEAF]) for i in range(0, len(own[0]), LEAF)]
            self.leaves[first : last + 1] = cut
            self.leaves = self.leaves or [own]
            sizes = np.fromiter((len(le) for le, _ in self.leaves), np.int64, len(self.leaves))
            lens, toks = (np.concatenate([leaf[i] for leaf in self.leaves]) for i in (0, 1))
            self._build(lens, toks, np.cumsum(sizes) - sizes if len(lens) else sizes[:0])


def _by_slices(f, columns: list[str], model, special_tokens: bool):
    """A mapInPandas function that makes rows of ``columns`` from rows, with a counter that remembers pre-tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = PreTokenCounter(model.value, special_tokens)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                rows = batch.iloc[at : at + SLICE]
                yield pd.DataFrame([f(counter, r) for r in rows.itertuples(index=False)], columns=columns)

    return run


def counted_trees(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None, special_tokens: bool = True) -> DataFrame:
    """Whole texts counted, with what ``edited_trees`` needs to count them again after edits without encoding them again.

    Returns one row per input row: ``id, text, tree`` (binary: lengths and token counts of the pre-tokens), ``n_pre_tokens,
    n_tokens`` (null: an empty text), and ``edits`` if a column of edits is given. The table can be written and kept. Ids may
    be null or repeat; no rows give no rows; other columns are ignored, whatever their names. No shuffle; each task keeps
    one document's tree at a time. A special token that a text spells out is one token, as in ``bpe.encode_documents``; with
    ``special_tokens`` off its letters are ordinary text.
    """
    model = docs.sparkSession.sparkContext.broadcast((Bpe.load(path), vocabulary(path)))

    def count(counter: PreTokenCounter, r) -> tuple:
        lens, toks = counter.measured(r.text or "")
        return (r.id, r.text, packed(lens, toks), len(lens), int(toks.sum()), *([r.edits] if edits_col else []))

    edits = [F.col(edits_col).cast(EDITS).alias("edits")] if edits_col else []
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), *edits)
    columns = ["id", "text", "tree", "n_pre_tokens", "n_tokens", *(["edits"] if edits_col else [])]
    out = rows.mapInPandas(_by_slices(count, columns, model, special_tokens), "id string, text string, tree binary, n_pre_tokens long, n_tokens long" + (f", edits {EDITS}" if edits_col else ""))
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def edited_trees(trees: DataFrame, path: str, edits_col: str = "edits", special_tokens: bool = True) -> DataFrame:
    """Counts after edits of the table of ``counted_trees``: only what the edits touch is encoded.

    ``edits_col`` holds for each row an array of (start, end, text): characters to replace, applied in order, each on the
    text that the ones before it left; places outside of the text are clipped, null members count as 0 or the empty string.

    Returns one row per input row: ``id, text`` (as edited), ``tree, n_pre_tokens, n_tokens`` (of the edited text, so that
    further edits can follow; ``special_tokens`` has to be as it was when the trees were made, and an edit may make or break
    such a token), ``n_pre_tokens_before, n_tokens_before``, and ``n_reencoded`` (pre-tokens encoded for the
    edits). A null or empty array changes nothing, but that a null text becomes an empty one. No rows give no rows; other
    columns are ignored, whatever their names. No shuffle.
    """
    model = trees.sparkSession.sparkContext.broadcast((Bpe.load(path), vocabulary(path)))

    def edit(counter: PreTokenCounter, r) -> tuple:
        tree = CountTree(counter, r.text or "", bytes(r.tree))
        for e in r.edits if r.edits is not None else []:
            if e is not None:
                tree.edit(int(e["start"] or 0), int(e["end"] or 0), e["text"] or "")
        return r.id, tree.text, tree.stored(), tree.pre_tokens, tree.tokens, r.n_pre_tokens, r.n_tokens, tree.encoded

    rows = trees.select(F.col("id").cast("string").alias("id"), "text", "tree", "n_pre_tokens", "n_tokens", F.col(edits_col).cast(EDITS).alias("edits"))
    columns = ["id", "text", "tree", "n_pre_tokens", "n_tokens", "n_pre_tokens_before", "n_tokens_before", "n_reencoded"]
    out = rows.mapInPandas(_by_slices(edit, columns, model, special_tokens), "id string, text string, tree binary, n_pre_tokens long, n_tokens long, n_pre_tokens_before long, n_tokens_before long, n_reencoded long")
    return out.withColumn("id", F.col("id").cast(trees.schema["id"].dataType))
