"""Byte-pair encoding by speculation: longest matches, verified pair by pair, merged exactly only where a pair fails."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words or chunks that a task remembers before it forgets all of them.
MEMORY = 600_000
#: Documents whose results travel back at a time.
SLICE = 256
_NEVER = np.iinfo(np.int64).max
#: What the tokenizers' patterns count as white space.
_WS = r"\t-\r \x85\xa0  -     　"


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as U+0100 onwards, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary with merges in order of preference; ``suffix`` marks the last symbol of a word."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "", extra: dict[str, int] | None = None):
        byte_of = _byte_of_char()
        raw = lambda s: bytes(byte_of[c] for c in s)
        self.size = max([*vocab.values(), *(extra or {}).values()]) + 1
        self.special = dict(extra or {})
        self.strings = [""] * self.size
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.pair: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            i, j, t = vocab[a], vocab[b], vocab[a + b]
            if self.pair.setdefault(i * self.size + j, (r, t)) == (r, t) and self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, i, j
        self.keys = np.array(sorted(self.pair), np.int64)
        self.key_rank = np.array([self.pair[k][0] for k in self.keys.tolist()], np.int64)
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {} if suffix else self.inner
        own = self._reachable()
        self.longest: dict[bytes, int] = {}
        for s, i in vocab.items():
            if own[i]:
                ends = bool(suffix) and s.endswith(suffix)
                b = raw(s[: len(s) - len(suffix)] if ends else s)
                (self.final if ends else self.inner)[b] = i
                self.longest[b[:2]] = max(len(b), self.longest.get(b[:2], 1))

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        m = d["model"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
        return cls(m["vocab"], merges, m.get("end_of_word_suffix") or "", {t["content"]: t["id"] for t in d.get("added_tokens", [])})

    def _reachable(self) -> np.ndarray:
        """Tokens that the merges make from their own symbols: both parts are, and nothing across them goes first."""
        made = np.flatnonzero(self.rank >= 0)
        fits = np.ones(self.size, bool)
        fits[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])]:
            fits[t] &= fits[self.left[t]] & fits[self.right[t]]
        return fits

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each adjacent pair of tokens, whether the merges leave the border between them alone.

        The merges of both tokens are undone from the last to the first; at each point the two symbols at the border must
        have no merge that would have come before the one undone last. All pairs are undone at once.
        """
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        limit = np.full(len(a), _NEVER) if limit is None else np.array(limit, np.int64)
        fits, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            key = a[live] * self.size + b[live]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            across = np.where(self.keys[at] == key, self.key_rank[at], _NEVER)
            early = across < limit[live]
            fits[live[early]] = False
            live = live[~early]
            ra, rb = self.rank[a[live]], self.rank[b[live]]
            more = (ra >= 0) | (rb >= 0)
            live, ra, rb = live[more], ra[more], rb[more]
            # Equal merges go from left to right, so on a tie the right one is undone, and the border's merge comes before it.
            undo = ra > rb
            x, y = live[undo], live[~undo]
            limit[x], a[x] = ra[undo], self.right[a[x]]
            limit[y], b[y] = rb[~undo] + 1, self.left[b[y]]
        return fits

    def speculate(self, word: bytes) -> list[int]:
        out, i, n = [], 0, len(word)
        inner, final, longest = self.inner, self.final, self.longest
        while i < n:
            j = min(n, i + longest.get(word[i : i + 2], 1))
            while (t := (final if j == n else inner).get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def merge(self, word: bytes) -> list[int]:
        """The exact encoding: the earliest merge first, of equal ones the leftmost."""
        s = [self.inner[word[i : i + 1]] for i in range(len(word) - 1)] + [self.final[word[-1:]]]
        if len(s) <= 64:
            return self._merge_short(s)
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        size, pair = self.size, self.pair
        heap = [(*pair[k], i) for i in range(len(s) - 1) if (k := s[i] * size + s[i + 1]) in pair]
        heap = [(r, i, t) for r, t, i in heap]
        heapq.heapify(heap)
        while heap:
            r, i, t = heapq.heappop(heap)
            j = after[i]
            if s[i] < 0 or j >= len(s) or pair.get(s[i] * size + s[j], (-1,))[0] != r:
                continue
            s[i], s[j] = t, -1
            after[i] = after[j]
            if after[i] < len(s):
                before[after[i]] = i
                if (p := pair.get(t * size + s[after[i]])) is not None:
                    heapq.heappush(heap, (p[0], i, p[1]))
            if (k := before[i]) >= 0 and (p := pair.get(s[k] * size + t)) is not None:
                heapq.heappush(heap, (p[0], k, p[1]))
        return [x for x in s if x >= 0]

    def _merge_short(self, s: list[int]) -> list[int]:
        """The same for a few symbols, where looking at all ranks is cheaper than a heap."""
        size, get, none = self.size, self.pair.get, (_NEVER, -1)
        best = [get(a * size + b, none) for a, b in zip(s, s[1:], strict=False)]
        while best:
            low = min(best)
            if low is none:
                break
            i = best.index(low)
            s[i : i + 2] = [low[1]]
            del best[i]
            if i < len(best):
                best[i] = get(s[i] * size + s[i + 1], none)
            if i:
                best[i - 1] = get(s[i - 1] * size + s[i], none)
        return s

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of non-empty words: longest matches, every adjacent pair checked, exact merging of the words that fail."""
        out = [self.speculate(w) for w in words]
        lens = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((t for o in out for t in o), np.int64, int(lens.sum()))
        word_of = np.repeat(np.arange(len(out)), lens)
        inside = np.flatnonzero(word_of[1:] == word_of[:-1])
        failed = ~self.compatible(flat[inside], flat[inside + 1])
        for w in np.unique(word_of[inside[failed]]):
            out[w] = self.merge(words[w])
        return out

    def decode(self, ids) -> str:
        """The tokens' strings joined by a space: what the library does for a vocabulary without a decoder."""
        return " ".join([self.strings[i] for i in ids])


class WordEncoder:
    """Texts to ids with a vocabulary of lower-cased words (NFC; white space dropped); remembers chunks between white space."""

    def __init__(self, bpe: Bpe, special_tokens: bool = True):
        self.bpe = bpe
        self.names = sorted(bpe.special, key=len, reverse=True) if special_tokens else []
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+")
        self.split = regex.compile(rf"[{_WS}]+").split
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.names)) + ")") if self.names else None
        self.known: dict[str, tuple[bytes, str]] = {}

    def _lower(self, chunk: str) -> str:
        if chunk.isascii():
            return chunk.lower()
        # Each character by itself: a final sigma is no special case in the library.
        return "".join(c.lower() for c in unicodedata.normalize("NFC", chunk))

    def _chunks(self, text: str) -> list[str]:
        # str.split() agrees with the pattern but for U+001C to U+001F.
        if not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return text.split()
        return [c for c in self.split(text) if c]

    def chunks(self, text: str) -> list[str]:
        if self.special and any(x in text for x in self.names):
            return [c for part in self.special.split(text) for c in ([part] if part in self.names else self._chunks(part))]
        return self._chunks(text)

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.known]
        parts = [[] if c in self.names else [p.encode("utf-8", "surrogatepass") for p in self.pieces.findall(self._lower(c))] for c in new]
        words = list({p for ps in parts for p in ps})
        ids = dict(zip(words, self.bpe.encode_words(words), strict=True))
        for c, ps in zip(new, parts, strict=True):
            own = [self.bpe.special[c]] if c in self.names else [i for p in ps for i in ids[p]]
            self.known[c] = np.array(own, "<u4").tobytes(), self.bpe.decode(own)

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        if len(self.known) > MEMORY:
            self.known.clear()
        chunks = [self.chunks(t) if t else [] for t in texts]
        self.learn(set().union(*chunks))
        found = [[self.known[c] for c in cs] for cs in chunks]
        # A chunk without tokens adds no separator.
        return [b"".join([f[0] for f in fs]) for fs in found], [" ".join([f[1] for f in fs if f[0]]) for fs in found]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", special_tokens: bool = True) -> DataFrame:
    """Whole texts encoded and decoded with the vocabulary file at ``path`` (word-level BPE in the tokenizers format).

    Returns one row per input row: ``id, ids`` (binary: the ids as little-endian unsigned 32-bit integers), ``n_tokens``,
    ``decoded``. A null or empty text has no tokens and decodes to the empty string. Ids of documents may be null or repeat;
    other columns are ignored. A special token that a text spells out is one token; with ``special_tokens`` off its letters
    are ordinary text. No shuffle: each task encodes its own rows and remembers a bounded number of chunks.
    """
    model = docs.sparkSession.sparkContext.broadcast(Bpe.load(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder(model.value, special_tokens)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                rows = batch.iloc[at : at + SLICE]
                ids, decoded = encoder.encode(rows["text"].tolist())
                yield pd.DataFrame({"id": rows["id"].to_numpy(), "ids": ids, "n_tokens": [len(x) // 4 for x in ids], "decoded": decoded})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInPandas(run, "id string, ids binary, n_tokens long, decoded string")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias("id"), "ids", "n_tokens", "decoded")
