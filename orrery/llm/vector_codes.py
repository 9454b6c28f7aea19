"""Vector codes: a codebook for each part of the vectors, fitted by Lloyd's rounds with Elkan's bounds on whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.lineage import BROADCAST_ROWS, dropped, written

#: Vectors that are assigned at a time.
BLOCK = 4096
#: Components of this size or more count as not finite: their squares and sums are beyond whole numbers of 64 bits.
TOO_LARGE = 1 << 50

_STATE = "id {id}, label {label}, x binary, codes binary, upper binary, lower binary, error decimal(38,0), sums array<long>"


def _up(x: np.ndarray) -> np.ndarray:
    """The nearest number of half precision that is not below x."""
    with np.errstate(over="ignore"):
        h = x.astype(np.float16)
    return np.where(h.astype(np.float64) < x, np.nextafter(h, np.float16(np.inf)), h)


def _down(x: np.ndarray) -> np.ndarray:
    """The nearest number of half precision that is not above x."""
    h = np.minimum(x, float(np.finfo(np.float16).max)).astype(np.float16)
    return np.where(h.astype(np.float64) > x, np.nextafter(h, np.float16(-np.inf)), h)


def _squares(apart: np.ndarray) -> np.ndarray:
    return (apart * apart).sum(-1)


def _root_up(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + 2.0**-50)


def _root_down(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 - 2.0**-50)


def _exact(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and entries as 64-bit numbers, or as Python's where a squared distance could leave 64 bits."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[1] * x.shape[2] * (2 * most) ** 2 < 1 << 63:
        return x, entries
    return x.astype(object), entries.astype(object)


def first_codes(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of vectors (rows, parts, components) by all distances, with the first bounds.

    ``upper`` (rows, parts) is not below the distance to the own entry, ``lower`` (rows, parts, entries) not above that to
    each entry.
    """
    x, entries = _exact(x, entries)
    far = np.stack([_squares(x - entries[None, :, j]) for j in range(entries.shape[1])], 2)
    codes = np.argmin(far, axis=2)
    near = np.take_along_axis(far, codes[:, :, None], 2)[:, :, 0]
    return codes, _up(_root_up(near)), _down(_root_down(far))


def next_codes(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes and bounds after the entries moved by ``moved`` (parts, entries; rounded up), and how many distances it took.

    Both bounds are shifted by the movement. An entry is passed over only if it is strictly farther: its lower bound, or half
    of its distance from the own entry, is above the upper bound. All others are compared by whole squared distances, the
    first of equal ones wins.
    """
    x, entries = _exact(x, entries)
    parts = np.arange(x.shape[1])[None, :]
    high = (upper.astype(np.float64) + moved[parts, codes]) * (1 + 2.0**-50)
    low = np.maximum(lower.astype(np.float64) - moved[None], 0) * (1 - 2.0**-50)
    half = np.stack([_root_down(_squares(entries - entries[:, j : j + 1])) for j in range(entries.shape[1])], 1) / 2
    left = (high[:, :, None] >= low) & (high[:, :, None] >= half[parts, codes])
    np.put_along_axis(left, codes[:, :, None], False, 2)
    row, part = np.nonzero(left.any(2))
    own = codes[row, part]
    # The own entry's distance makes the upper bound tight; then the others that are still left are measured.
    far = np.full((len(row), entries.shape[1]), 1 << 200 if x.dtype == object else np.iinfo(np.int64).max, x.dtype)
    place = np.arange(len(row))
    far[place, own] = _squares(x[row, part] - entries[part, own])
    tight = _root_up(far[place, own])
    high[row, part] = tight
    low[row, part, own] = np.maximum(low[row, part, own], _root_down(far[place, own]))
    i, j = np.nonzero(left[row, part] & (tight[:, None] >= low[row, part]) & (tight[:, None] >= half[part, own]))
    far[i, j] = _squares(x[row[i], part[i]] - entries[part[i], j])
    low[row[i], part[i], j] = _root_down(far[i, j])
    best = np.argmin(far, axis=1)
    codes = codes.copy()
    codes[row, part] = best
    high[row, part] = _root_up(far[place, best])
    return codes, _up(high), _down(low), len(row) + len(i)


def moved_by(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry (parts, entries, components) moved, rounded up."""
    apart = new.astype(object) - old.astype(object)
    return _root_up((apart * apart).sum(-1).astype(object))


def sums_of(x: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """For each part and entry the number of its parts and their componentwise sums, as one row of numbers."""
    rows, parts, width = x.shape
    out = np.zeros((parts, entries, width + 1), np.int64)
    for p in range(parts):
        order = np.argsort(codes[:, p], kind="stable")
        own, start = np.unique(codes[order, p], return_index=True)
        out[p, own, 0] = np.diff(np.append(start, rows))
        out[p, own, 1:] = np.add.reduceat(x[order, p], start, axis=0)
    return out.ravel()


def _narrow(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: the width of a number, then the numbers."""
    most = int(np.abs(x).max(initial=0))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return [bytes([width]) + r.tobytes() for r in x.reshape(len(x), -1).astype(f"<i{width}")]


def _wide(blobs: list[bytes], parts: int) -> np.ndarray:
    rows = [np.frombuffer(b, f"<i{b[0]}", offset=1).astype(np.int64) for b in blobs]
    return np.stack(rows).reshape(len(rows), parts, -1)


def _matrix(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _errors(x: np.ndarray, entries: np.ndarray, codes: np.ndarray) -> pa.Array:
    x, entries = _exact(x, entries)
    apart = x - entries[np.arange(x.shape[1])[None, :], codes]
    return pa.array([int(v) for v in (apart * apart).sum((1, 2))], pa.decimal128(38, 0))


def _assigning(parts: int, book, moved=None):
    """A mapInArrow function from rows (id, label, v) or, with ``moved``, from the state of the round before, to a state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = book.value
        for whole in batches:
            for at in range(0, len(whole), BLOCK):
                batch = whole.slice(at, BLOCK)
                if moved is None:
                    v = batch.column("v")
                    x = np.asarray(v.flatten(), np.int64).reshape(len(batch), parts, -1)
                    blobs = pa.array(_narrow(x), pa.binary())
                    codes, upper, lower = first_codes(x, entries)
                else:
                    blobs = batch.column("x")
                    x = _wide(blobs.to_pylist(), parts)
                    codes = _matrix(batch.column("codes"), np.uint8, parts).astype(np.int64)
                    upper = _matrix(batch.column("upper"), np.float16, parts)
                    lower = _matrix(batch.column("lower"), np.float16, parts, entries.shape[1])
                    codes, upper, lower, _ = next_codes(x, entries, moved.value, codes, upper, lower)
                as_bytes = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
                sums = pa.array([sums_of(x, codes, entries.shape[1])] + [None] * (len(batch) - 1), pa.list_(pa.int64()))
                columns = [batch.column("id"), batch.column("label"), blobs, as_bytes(codes.astype(np.uint8)), as_bytes(upper), as_bytes(lower), _errors(x, entries, codes), sums]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "x", "codes", "upper", "lower", "error", "sums"])

    return run


def _whole_numbers(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, label, v`` (floor of the scaled components) of the vectors that hold finite components only."""
    v = F.col(vector_col).cast("array<double>")
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < TOO_LARGE)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).where(F.col("v").isNotNull() & F.forall("v", fits))
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))


def _updated(state: DataFrame, entries: np.ndarray) -> np.ndarray:
    """Entries as the floors of their parts' means; an entry without parts stays. Only sums travel: one row for each number."""
    got = state.where("sums is not null").select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).toArrow()
    parts, k, width = entries.shape
    flat = np.zeros(parts * k * (width + 1), object)
    flat[np.asarray(got["at"])] = [int(n) for n in got["n"].to_pylist()]
    sums = flat.reshape(parts, k, width + 1)
    new = entries.copy()
    for p, e in zip(*np.nonzero(sums[:, :, 0]), strict=True):
        new[p, e] = [int(s) // int(sums[p, e, 0]) for s in sums[p, e, 1:]]
    return new


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """Product codes of vectors: each of ``parts`` equal consecutive parts becomes the number of its codebook's nearest entry.

    Components become the whole numbers floor(scale * x). A part position's codebook starts as that part of the vectors with
    the ``entries`` smallest ids (ties by components; null ids last) and takes ``rounds`` of Lloyd's: each part goes to the
    nearest entry (squared Euclidean distance, ties to the lower number), each entry becomes its parts' componentwise floor
    of the mean; entries without parts stay. Then parts are assigned once more.

    Rounds after the first use Elkan's bounds: for every vector an upper bound for each part and a lower bound for each part
    and entry are kept in the state table (half precision, rounded to the safe side), shifted by how far entries moved. A
    round reads and writes that table and moves nothing between tasks but sums of a batch for each number of the codebooks;
    the table of the round before goes when the next is whole. The driver holds the codebooks only.

    Returns a table and the codebooks (parts, entries, components). The table has a row for each vector that is not null and
    holds no null or non-finite component (nor one of 2**50 / scale or more): ``id, label, codes`` (array
    of int), ``error`` (squared distances summed over parts; null beyond a long), ``label_error`` (errors summed over
    rows of the same label, nulls together). Vectors whose length differs from that of the smallest id, or is no multiple of
    ``parts`` above zero, have null codes and errors. Ids and labels may be null or repeat, each row is a vector of its own;
    fewer vectors than entries make smaller codebooks, none an empty table. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = _whole_numbers(vectors, id_col, label_col, vector_col, scale)
    fits = F.size("v") % parts == 0
    head = rows.where(fits & (F.size("v") > 0)).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    length = len(head[0]["v"]) if head else 0
    head = [r["v"] for r in head if len(r["v"]) == length]
    if 0 < len(head) < entries:  # other lengths among the smallest ids
        head = [r["v"] for r in rows.where(F.size("v") == length).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    width = length // parts
    book = np.array(head, np.int64).reshape(len(head), parts, width).swapaxes(0, 1).copy()
    schema = _STATE.format(id=rows.schema["id"].dataType.simpleString(), label=rows.schema["label"].dataType.simpleString())
    own = F.size("v") == length if length else F.lit(False)
    send = spark.sparkContext.broadcast
    state = written(rows.where(own).mapInArrow(_assigning(parts, send(book)), schema), "vector-codes")
    for _ in range(rounds if head else 0):
        new = _updated(state, book)
        after = written(state.mapInArrow(_assigning(parts, send(new), send(moved_by(book, new))), schema), "vector-codes")
        dropped(state)
        state, book = after, new
    code = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda i: F.conv(F.hex(F.substring("codes", i, F.lit(1))), 16, 10).cast("int"))
    coded = state.select("id", "label", code.alias("codes"), "error")
    others = rows.where(~own).select("id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("decimal(38,0)").alias("error"))
    totals = state.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_ROWS else totals
    out = coded.unionByName(others).join(totals, F.col("label").eqNullSafe(F.col("of_label")), "left")
    return out.select("id", "label", "codes", *(F.col(c).try_cast("bigint").alias(c) for c in ("error", "label_error"))), book


def decoded(codes: list[int], book: np.ndarray, scale: int = 4096) -> np.ndarray:
    """The vector that codes stand for."""
    return np.concatenate([book[p, c] for p, c in enumerate(codes)]).astype(np.float64) / scale

