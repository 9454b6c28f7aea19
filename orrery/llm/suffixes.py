"""Repeated byte strings by merging the Burrows-Wheeler transforms of shards.

Only places where a repeat can be are sorted. Every window of ``length`` bytes has an anchor, its 16 bytes of smallest
hash, so equal windows have equal anchors at the same place in them. The windows of a text that share an anchor make up a
piece. Pieces whose anchors occur once anywhere have no repeats; pieces that are wholly equal are told apart by their first
one. What remains, pieces with the same anchor and other contents, is dealt into buckets by the anchor's hash, and each
bucket's pieces into shards. Where very many pieces share an anchor, it is widened: half of a piece's windows have the bytes
before it in common with all that equal them, the other half those behind it, so the piece is cut in two and each half goes
by the wider string, until few share it or it is the whole window. A shard's transform has, column by column from the right end of the pieces, the bytes before
its sorted suffixes; the transforms of a bucket are merged by refining the interleave of the shards one column at a time.
The common prefixes of neighbours come along, and neighbours that share ``length`` bytes are a repeated interval.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.lineage import cut, written

GRAM = 16
#: Pieces in a bucket on average, shards of a bucket, and different pieces of one anchor above which it is widened.
BUCKET, SHARDS, HOT = 16_000, 4, 4_000
#: Bytes that a task looks at together.
CHUNK = 2 << 20
_POSITION = np.uint64((1 << 24) - 1)
_ABSENT = 256


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    x = b.astype(np.uint64)
    for width, shift in ((1, 8), (2, 16), (4, 32)):
        x = x[:-width] | (x[width:] << np.uint64(shift))
    h = x[:-8] * np.uint64(0x9E3779B97F4A7C15) + (x[8:] ^ (x[:-8] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor, hash) of the pieces of some texts of less than 16 MB together.

    The anchor of a window is its leftmost gram of the smallest hash (by the upper 40 bits).
    """
    lens = np.array([len(t) for t in texts], np.int64)
    b = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(b) < length:
        return none, none, none, none, none
    h = _gram_hashes(b)
    low = _slide_min((h & ~_POSITION) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
    of = np.repeat(np.arange(len(texts)), lens)
    inside = of[: len(low)] == of[length - 1 :]
    at = np.where(inside, (low & _POSITION).astype(np.int64), -1)
    edge = np.flatnonzero(np.diff(at)) + 1
    first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(at)]]) - 1
    kept = at[first] >= 0
    first, last = first[kept], last[kept]
    x, t = at[first], of[first]
    base = (np.cumsum(lens) - lens)[t]
    return t, first - base, last - base, x - base, h[x].view(np.int64)


def _chunks(ids, texts, length: int) -> Iterator[tuple[list, list[bytes], list[int]]]:
    """(ids, texts, places of the texts in their documents) of about CHUNK bytes; a longer text comes in overlapping parts."""
    a, b, c, size = [], [], [], 0
    for i, t in zip(ids, texts, strict=True):
        raw = (t or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(raw) - length + 1), 4 * CHUNK):
            a.append(i)
            b.append(raw[at : at + 4 * CHUNK + length - 1])
            c.append(at)
            size += len(b[-1])
            if size >= CHUNK:
                yield a, b, c
                a, b, c, size = [], [], [], 0
    if a:
        yield a, b, c


def _anchor_hashes(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, texts, _ in _chunks(batch["id"], batch["text"], length):
                yield pd.DataFrame({"hash": anchors_of(texts, length)[4]})

    return run


def _pieces(length: int):
    """A row for each piece; ``packed`` is the anchor's place, what of the piece lies before it, and its windows less one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for ids, texts, places in _chunks(batch["id"], batch["text"], length):
                t, first, last, x, h = anchors_of(texts, length)
                d = np.fromiter((digest(texts[i][s : e + length]) for i, s, e in zip(t.tolist(), first.tolist(), last.tolist(), strict=True)), np.uint64, len(t))
                packed = ((x + np.array(places, np.int64)[t]) << 14) | ((x - first) << 7) | (last - first)
                yield pd.DataFrame({"hash": h, "digest": d.view(np.int64), "doc": np.array(ids, np.int64)[t], "packed": packed})

    return run


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, bytes of the piece before it, windows."""
    return packed >> 14, (packed >> 7) & 127, (packed & 127) + 1


def _piece_bytes(length: int):
    """A row for each piece with its bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text, own in zip(batch["id"], batch["text"], batch["own"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for r in own:
                    x, off, n = (int(v) for v in _unpack(r["packed"]))
                    out.append((r["hash"], i, r["packed"], raw[x - off : x - off + n + length - 1]))
            yield pd.DataFrame(out, columns=["hash", "doc", "packed", "bytes"])

    return run


def _dealt(buckets: int):
    """Bucket and shard of pieces: those of an anchor meet in one bucket, in any of its shards."""
    bucket = F.pmod("hash", F.lit(buckets)).cast("int").alias("bucket")
    return bucket, F.pmod(F.xxhash64("doc", "packed"), F.lit(SHARDS)).cast("int").alias("shard"), "doc", "packed", "bytes"


def widened(piece: bytes, before: int, windows: int, left: int, right: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The parts of a piece by a wider anchor: (first window, windows, bytes before the anchor, new left, new right).

    All windows of the piece hold its anchor with ``left`` bytes before and ``right`` behind it; ``before`` bytes of the
    piece lie before the anchor proper. Of the bytes that a window has beside that string, those with at least half on the
    left take so many bytes on the left into the string, the others what they are then sure to have on the right.
    """
    free = length - GRAM - left - right
    half = (free + 1) // 2
    # Window j has before - j bytes left of the anchor; from before - left - half on it has too few for the left.
    split = min(max(before - left - half + 1, 0), windows)
    if split:
        yield 0, split, before, left + half, right
    if split < windows:
        yield split, windows - split, before - split, left, right + free - half + 1


def _narrowed(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                x, before, windows = (int(v) for v in _unpack(r.packed))
                for first, n, off, left, right in widened(r.bytes, before, windows, r.left, r.right, length):
                    own = r.bytes[first : first + n + length - 1]
                    key = digest(own[off - left : off + GRAM + right], left << 8 | right)
                    out.append((key, digest(own), left, right, r.doc, x << 14 | off << 7 | n - 1, own))
            found = pd.DataFrame(out, columns=["hash", "digest", "left", "right", "doc", "packed", "bytes"])
            for c in ("hash", "digest"):
                found[c] = found[c].to_numpy(np.uint64).view(np.int64)
            yield found

    return run


def shard_transform(pieces: list[bytes], before: np.ndarray, length: int) -> np.ndarray:
    """The transform of a shard: in row c the bytes of column c, in the order of the suffixes that begin one column later.

    Pieces are aligned at their anchors (column ``length - GRAM``); outside of a piece a column holds _ABSENT.
    """
    left = length - GRAM
    text = np.full((len(pieces), left + length), _ABSENT, np.uint16)
    for i, (p, off) in enumerate(zip(pieces, before.tolist(), strict=True)):
        text[i, left - off : left - off + len(p)] = np.frombuffer(p, np.uint8)
    text = np.ascontiguousarray(text.T)
    out, order = np.empty_like(text), np.arange(len(pieces))
    for c in range(len(text) - 1, -1, -1):
        out[c] = text[c][order]
        order = order[np.argsort(out[c], kind="stable")]
    return out


def merge_transforms(shards: list[np.ndarray], age: np.ndarray, length: int) -> np.ndarray:
    """Where pieces repeat: [column, piece] is set if an older piece has the ``length`` bytes from that column on.

    ``age`` ranks the pieces, shard by shard, by the places of their anchors. The interleave of the shards starts with all
    suffixes empty. Each step puts the bytes of one more column, read from the shards' transforms, before the suffixes: a
    stable distribution by those bytes is the new interleave. Two suffixes that become neighbours with equal bytes share
    one byte more than what all between them shared before; so the common prefixes need no second look at the texts.
    """
    sizes = [s.shape[1] for s in shards]
    base = np.cumsum([0, *sizes])
    n, left = int(base[-1]), length - GRAM
    repeated = np.zeros((left + 1, n), bool)
    side = np.repeat(np.arange(len(shards)), sizes)
    orders = [np.arange(m) for m in sizes]
    prefix = np.zeros(n + 1, np.uint8)
    for c in range(left + length - 1, -1, -1):
        byte = np.empty(n, np.uint16)
        for s, t in enumerate(shards):
            byte[side == s] = t[c]
            orders[s] = orders[s][np.argsort(t[c], kind="stable")]
        step = np.argsort(byte, kind="stable")
        side, now = side[step], byte[step]
        same = np.flatnonzero((now[1:] == now[:-1]) & (now[1:] != _ABSENT)) + 1
        new = np.zeros(n + 1, np.uint8)
        if len(same):
            spans = np.empty(2 * len(same), np.int64)
            spans[0::2], spans[1::2] = step[same - 1] + 1, step[same] + 1
            new[same] = np.minimum(np.minimum.reduceat(prefix, spans)[::2], length) + 1
        prefix = new
        if c > left or not (long := prefix[:n] >= length).any():
            continue
        piece = np.empty(n, np.int64)
        for s, order in enumerate(orders):
            piece[side == s] = base[s] + order
        starts = np.flatnonzero(~long)
        oldest = np.repeat(np.minimum.reduceat(age[piece], starts), np.diff(np.append(starts, n)))
        repeated[c, piece[age[piece] != oldest]] = True
    return repeated


def _build(length: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc", "packed"])
        packed = rows["packed"].to_numpy()
        t = shard_transform(rows["bytes"].tolist(), _unpack(packed)[1], length)
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "shard": rows["shard"].iloc[:1], "docs": [rows["doc"].to_numpy().tobytes()], "packed": [packed.tobytes()], "transform": [zlib.compress(t.tobytes(), 1)]})

    return run


def _merge(length: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        docs, packed = (np.frombuffer(b"".join(rows[c]), np.int64) for c in ("docs", "packed"))
        width = 2 * length - GRAM
        shards = [np.frombuffer(zlib.decompress(t), np.uint16).reshape(width, -1) for t in rows["transform"]]
        x = _unpack(packed)[0]
        age = np.empty(len(x), np.int64)
        age[np.lexsort((x, docs))] = np.arange(len(x))
        found = np.pad(merge_transforms(shards, age, length).T.astype(np.int8), ((0, 0), (1, 1)))
        turn = np.diff(found, axis=1)
        piece, start = np.nonzero(turn == 1)
        end = np.nonzero(turn == -1)[1]
        left = length - GRAM
        return pd.DataFrame({"doc": docs[piece], "lo": x[piece] + start - left, "hi": x[piece] + end - 1 - left + length})

    return run


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            out = []
            rows = batch.iloc[at : at + 256]
            for i, text, ranges in zip(rows["id"], rows["text"], rows["ranges"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for r in sorted((r["lo"], r["hi"]) for r in ranges) if ranges is not None else []:
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append(list(r))
                edges = [0, *(e for s in spans for e in s), len(raw)]
                out.append((i, len(raw), [{"start": s, "end": e} for s, e in spans], b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "spans", "kept"])


def repeated_bytes_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """Texts without the bytes of strings of ``length`` bytes that also start earlier.

    Texts are UTF-8 bytes; a string starts earlier if its document has a smaller id, or the same id and a smaller place.
    Matches do not cross documents, overlaps count, and strings are judged on the input. ``length`` is from 32 to 112.

    Returns ``id, n_bytes, spans`` (array of start, end: the maximal removed runs), ``kept`` (binary: what remains), one row
    for each id. Null and empty texts keep nothing and lose nothing. Rows with a null id are left out; of rows with one id
    that with the smallest text counts. No rows give no rows. Other columns are ignored, whatever their names.

    Anchors of more than ``hot`` different pieces are widened (``widened``), some seven times at most; then a string is the
    whole window, and equal pieces were told apart by their first one. So no anchor's group is larger, and all of them go
    through the transforms.
    """
    if not 32 <= length <= 112:
        raise ValueError("length must be from 32 to 112")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    if texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        texts = texts.groupBy("id").agg(F.min("text").alias("text"))
    # Materialised, so that the join with it has exchanges of its own: those of frequent anchors can be split.
    repeated = written(texts.mapInPandas(_anchor_hashes(length), "hash long").groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "repeated-anchors")
    pieces = texts.mapInPandas(_pieces(length), "hash long, digest long, doc long, packed long").join(repeated, "hash", "left_semi")
    pieces = written(pieces, "pieces")
    # An anchor's hash and a piece's digest, 128 bits together, tell a piece's content.
    firsts = written(pieces.groupBy("hash", "digest").agg(F.min(F.struct("doc", "packed")).alias("f")), "first-pieces")
    shared = firsts.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    judged = cut(firsts.join(shared, "hash").select("hash", "f.doc", "f.packed", (F.col("n") > hot).alias("hot")))
    place, windows = F.expr("(packed >> 14) - ((packed >> 7) & 127)"), F.expr("(packed & 127) + 1")
    spans = F.col("doc"), place.alias("lo"), (place + windows + (length - 1)).alias("hi")
    found = pieces.join(firsts, ["hash", "digest"]).where("doc <> f.doc or packed <> f.packed").select(*spans)

    def with_text(rows: DataFrame) -> DataFrame:
        own = rows.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("hash", "packed")).alias("own"))
        return texts.join(own, "id").select("id", "text", "own").mapInPandas(_piece_bytes(length), "hash long, doc long, packed long, bytes binary")

    n_cold, of_buckets = judged.where("not hot").count(), []
    if n_cold:
        of_buckets.append(with_text(judged.where("not hot")))
    wide = with_text(judged.where("hot")).select("*", F.lit(0).alias("left"), F.lit(0).alias("right")) if judged.where("hot").limit(1).count() else None
    while wide is not None:
        parts = written(wide.mapInPandas(_narrowed(length), "hash long, digest long, left int, right int, doc long, packed long, bytes binary"), "widened")
        firsts = written(parts.groupBy("hash", "digest").agg(F.min(F.struct("doc", "packed")).alias("f")), "first-widened")
        found = found.unionByName(parts.join(firsts, ["hash", "digest"]).where("doc <> f.doc or packed <> f.packed").select(*spans))
        shared = firsts.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
        sized = firsts.join(shared, "hash").select("hash", "digest", "f", (F.col("n") > hot).alias("hot"))
        # (hash, digest) with its first place is one row of the parts.
        judged = written(parts.join(sized, ["hash", "digest"]).where("doc = f.doc and packed = f.packed").drop("digest", "f"), "judged-widened")
        many = judged.where("hot")
        n_many = many.count()
        of_buckets.append(judged.where("not hot").select("hash", "doc", "packed", "bytes"))
        n_cold += judged.count() - n_many
        wide = many if n_many else None
    if of_buckets:
        dealt = reduce(DataFrame.unionByName, of_buckets).select(*_dealt(max(1, math.ceil(n_cold / bucket))))
        shards = dealt.groupBy("bucket", "shard").applyInPandas(_build(length), "bucket int, shard int, docs binary, packed binary, transform binary")
        found = found.unionByName(shards.groupBy("bucket").applyInPandas(_merge(length), "doc long, lo long, hi long"))
    ranges = found.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    return texts.join(ranges, "id", "left").select("id", "text", "ranges").mapInPandas(_cut_out, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
