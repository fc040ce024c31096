"""Counts of terms that share a row, as a sparse symmetric matrix in square cells.

Terms are numbered, and term ``id`` is the ``id // blocks``-th of block ``id % blocks``.
A cell has the pairs of a lesser term of one block and a greater of another, as sorted
places with counts, packed; so a pair costs a byte or two wherever it is kept or sent,
is counted once for both orders, and a task holds one cell, whatever the vocabulary.
"""

from __future__ import annotations

import atexit
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Pairs of a cell, repeats included; pairs that a task sorts at a time, and lists at a time.
CELL, SORTED, LISTED = 1 << 22, 1 << 23, 1 << 20
#: Ranges in which terms are numbered.
SLOTS = 256
#: Rows of one batch of results.
ROWS = 1 << 16


def _remove(spark, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the folder is then its owner's to clear
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder (else the warehouse), read again; shuffle files of the step go at once, the table at exit."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path, before = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}", spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Remove a table of :func:`written` that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted places with counts: differences and counts byte plane by byte plane, compressed."""
    steps = np.diff(places, prepend=0)
    kind = np.uint32 if len(steps) == 0 or steps.max() < 1 << 32 else np.uint64
    planes = [x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in (steps.astype(kind), counts.astype(np.int64))]
    head = np.array([len(steps), np.dtype(kind).itemsize], np.int64).tobytes()
    return head + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = np.frombuffer(blob[:16], np.int64).tolist()
    raw = np.frombuffer(pa.decompress(blob[16:], n * (width + 8), codec="zstd", asbytes=True), np.uint8)
    steps = np.ascontiguousarray(raw[: n * width].reshape(width, n).T).view(np.uint32 if width == 4 else np.uint64).ravel()
    counts = np.ascontiguousarray(raw[n * width :].reshape(8, n).T).view(np.int64).ravel()
    return np.cumsum(steps, dtype=np.int64), counts


def summed(places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order, once each, with the sums of their counts."""
    order = np.argsort(places, kind="stable")
    places = places[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(places), 1), bool), places[1:] != places[:-1])))
    return places[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("ids")
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64), offsets - offsets[0]


def _margins(batches):
    """(id, n): how many terms of its rows each term meets, its own repeats left out; rows have sorted ids."""
    for batch in batches:
        ids, offsets = _lists(batch)
        if not len(ids):
            continue
        size, row = np.diff(offsets), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        first = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (row[1:] != row[:-1]))))
        times = np.diff(np.append(first, len(ids)))
        found, n = summed(ids[first], times * (size[row[first]] - times))
        yield pa.record_batch([pa.array(found), pa.array(n)], ["id", "n"])


def _met(batches, blocks: int, side: int):
    """(cell, blob): pairs of terms of each row, summed over SORTED pairs at a time."""
    span = side * side

    def flushed(held: list[np.ndarray]):
        keys = np.concatenate(held)
        held.clear()
        keys.sort()
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        times, keys = np.diff(np.append(first, len(keys))), keys[first]
        cells = np.unique(keys // span)
        low, high = np.searchsorted(keys, cells * span).tolist(), np.searchsorted(keys, (cells + 1) * span).tolist()
        blobs = [packed(keys[a:b] - c * span, times[a:b]) for c, a, b in zip(cells.tolist(), low, high, strict=True)]
        return pa.record_batch([pa.array(cells.astype(np.int32)), pa.array(blobs, pa.binary())], ["cell", "blob"])

    held, n = [], 0
    for batch in batches:
        ids, offsets = _lists(batch)
        block, place = ids % blocks, ids // blocks
        lesser, greater = block * (blocks * span) + place * side, block * span + place
        later = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(ids)) - 1
        total, a = np.cumsum(later), 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + LISTED, "right")))
            each = later[a:b]
            left = np.repeat(np.arange(a, b), each)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
            apart = ids[left] != ids[right]
            left, right = (left, right) if apart.all() else (left[apart], right[apart])
            if len(left):
                held.append(lesser[left] + greater[right])
                n += len(left)
            a = b
            if n >= SORTED:
                yield flushed(held)
                n = 0
    if n:
        yield flushed(held)


class Pairs:
    """Pairs of terms that share a row: ``words`` (id, w, n), the sums ``t`` and ``ta`` of n and n to the alpha, and blocks of cells."""

    def __init__(self, df: DataFrame, key: str, terms: Column, min_count: int, alpha: float):
        t = df.select(F.col(key).alias("key"), F.explode(F.array_distinct(terms)).alias("w"))
        slot = F.pmod(F.xxhash64("w"), F.lit(SLOTS))
        frequent = t.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= min_count).select("w", slot.alias("slot"))
        number = (F.row_number().over(W.partitionBy("slot").orderBy("w")) - 1) * SLOTS + F.col("slot")
        known = written(frequent.select("w", number.cast("long").alias("id")), "terms")
        own = t.where("key is not null").join(known, "w").groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        self.spark, self.alpha = df.sparkSession, alpha
        self.rows = written(own.where("size(ids) > 1").select("ids"), "rows")
        margins = self.rows.mapInArrow(_margins, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).where("n > 0")
        self.words = written(known.join(margins, "id").select("id", "w", "n"), "words")
        removed(known)
        s = self.words.agg(F.sum("n").alias("t"), F.sum(F.pow(F.col("n").cast("double"), F.lit(alpha))).alias("ta"), F.max("id").alias("last")).first()
        self.t, self.ta = s["t"] or 0, s["ta"] or 0.0
        self.blocks = max(1, math.ceil(math.sqrt(self.t / 2 / CELL)))
        self.side = (s["last"] or 0) // self.blocks + 1

    def met(self) -> DataFrame:
        """(cell, blob) of packed counts, several blobs a cell."""
        blocks, side = self.blocks, self.side
        return self.rows.mapInArrow(lambda batches: _met(batches, blocks, side), "cell int, blob binary")

    def placed(self, *columns: Column) -> DataFrame:
        """(block, own): the terms of each block, as structs of ``place`` and columns."""
        own = self.words.select((F.col("id") % self.blocks).cast("int").alias("block"), F.struct(F.floor(F.col("id") / self.blocks).alias("place"), *columns).alias("own"))
        return own.groupBy("block").agg(F.collect_list("own").alias("own"))

    def at_cells(self, cells: DataFrame, blocks: DataFrame) -> DataFrame:
        """Rows of each cell beside each other: ``blocks`` as part 0 (of its lesser terms) and 1 (of its greater), then its blobs as part 2."""
        n, others = self.blocks, F.sequence(F.lit(0), F.lit(self.blocks - 1))
        own = [c for c in blocks.columns if c != "block"]
        parts = F.flatten(F.transform(others, lambda k: F.array(F.struct((F.col("block") * n + k).alias("cell"), F.lit(0).alias("part")), F.struct((k * n + F.col("block")).alias("cell"), F.lit(1).alias("part")))))
        spread = blocks.select(F.inline(parts), *own)
        both = spread.unionByName(cells.withColumn("part", F.lit(2)), allowMissingColumns=True)
        return both.repartition("cell").sortWithinPartitions("cell", "part")


def cells_of(batches, columns: list[str]):
    """Over rows of :meth:`Pairs.at_cells`: (cell, values of ``columns`` of part 0, of part 1, places, counts), a cell at a time."""
    at, ends, blobs = None, [None, None], []

    def whole():
        both = [unpacked(b) for b in blobs]
        places, counts = (np.concatenate([b[k] for b in both]) if both else np.zeros(0, np.int64) for k in (0, 1))
        return (at, *ends, *(summed(places, counts) if len(both) > 1 else (places, counts)))

    for batch in batches:
        cell, part, blob = (batch.column(c) for c in ("cell", "part", "blob"))
        for i, (c, k) in enumerate(zip(cell.to_pylist(), part.to_pylist(), strict=True)):
            if c != at:
                if at is not None:
                    yield whole()
                at, ends, blobs = c, [None, None], []
            if k == 2:
                blobs.append(blob[i].as_py())
            else:
                ends[k] = [batch.column(x)[i] for x in columns]
    if at is not None:
        yield whole()


def _dense(own: pa.ListScalar, side: int) -> tuple[pa.Array, np.ndarray]:
    """Words of a block, the places they stand at in it, and their sums by place."""
    own = own.values
    place = own.field("place").to_numpy()
    at = np.zeros(side, np.int64)
    at[place] = np.arange(len(place))
    n = np.zeros(side, np.int64)
    n[place] = own.field("n").to_numpy()
    return own.field("w"), at, n


def information(pairs: Pairs) -> DataFrame:
    """(w, c, pmi): pointwise mutual information above 0, both orders of each pair."""
    side, alpha, t, ta = pairs.side, pairs.alpha, pairs.t, pairs.ta

    def mapped(batches):
        for _, low, high, places, counts in cells_of(batches, ["own"]):
            if not len(places):
                continue
            (one, one_at, one_n), (two, two_at, two_n) = _dense(low[0], side), _dense(high[0], side)
            a, b = places // side, places % side
            for w, c, w_at, c_at, nw, nc, x, y in ((one, two, one_at, two_at, one_n, two_n, a, b), (two, one, two_at, one_at, two_n, one_n, b, a)):
                for k in range(0, len(places), ROWS):
                    i, j, n = x[k : k + ROWS], y[k : k + ROWS], counts[k : k + ROWS]
                    pmi = np.log((n / t) / ((nw[i] / t) * (nc[j].astype(float) ** alpha / ta)))
                    own = np.flatnonzero(pmi > 0)
                    if len(own):
                        yield pa.record_batch([w.take(pa.array(w_at[i[own]])), c.take(pa.array(c_at[j[own]])), pa.array(pmi[own])], ["w", "c", "pmi"])

    rows = pairs.at_cells(pairs.met(), pairs.placed("w", "n"))
    return rows.mapInArrow(mapped, "w string, c string, pmi double")


def _halves(low_n: np.ndarray, high_n: np.ndarray, a: np.ndarray, b: np.ndarray, counts: np.ndarray, alpha: float, ta: float) -> np.ndarray:
    """The mean over both orders of the positive pointwise mutual information of places (a, b)."""
    with np.errstate(divide="ignore"):
        one, two = np.log(low_n.astype(float)), np.log(high_n.astype(float))
    joint = np.log(counts) + math.log(ta)
    return (np.maximum(joint - one[a] - alpha * two[b], 0) + np.maximum(joint - two[b] - alpha * one[a], 0)) / 2


def _kept(batches, side: int, alpha: float, ta: float):
    """(cell, blob): one blob a cell, of the pairs with information in either order."""
    for cell, low, high, places, counts in cells_of(batches, ["sums"]):
        if len(places):
            low_n, high_n = (np.frombuffer(x[0].as_py(), np.int64) for x in (low, high))
            own = _halves(low_n, high_n, places // side, places % side, counts, alpha, ta) > 0
            yield pa.record_batch([pa.array([cell], pa.int32()), pa.array([packed(places[own], counts[own])], pa.binary())], ["cell", "blob"])


_BLOCK = "block int, sums binary, y binary"


def _started(batches, side: int):
    """Blocks as dense arrays by place, from lists of (place, n, x)."""
    for batch in batches:
        for block, own in zip(batch.column("block").to_pylist(), batch.column("own"), strict=True):
            own = own.values
            place, x = own.field("place").to_numpy(), np.stack(own.field("x").to_numpy(zero_copy_only=False))
            n, y = np.zeros(side, np.int64), np.zeros((x.shape[1], side))
            n[place] = own.field("n").to_numpy()
            y[:, place] = x.T
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([n.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["block", "sums", "y"])


def _multiplied(batches, blocks: int, side: int, alpha: float, ta: float, turn: np.ndarray):
    """Each cell's share of the product of the matrix and the blocks' columns, turned; one more row counts a term's entries."""
    width = len(turn)
    for cell, low, high, places, counts in cells_of(batches, ["sums", "y"]):
        low_n, high_n = (np.frombuffer(x[0].as_py(), np.int64) for x in (low, high))
        one, two = (turn.T @ np.frombuffer(x[1].as_py(), float).reshape(-1, side)[:width] for x in (low, high))
        up, down = np.zeros((width + 1, side)), np.zeros((width + 1, side))
        if len(places):
            a, b = places // side, places % side
            v = _halves(low_n, high_n, a, b, counts, alpha, ta)
            first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            heads, each = a[first], np.diff(np.append(first, len(a)))
            for k in range(width):
                up[k, heads] = np.add.reduceat(v * two[k][b], first)
                down[k] = np.bincount(b, v * np.repeat(one[k][heads], each), side)
            up[width, heads], down[width] = each, np.bincount(b, minlength=side)
        i, j = divmod(cell, blocks)
        shares = [(i, up + down, low[0].as_py())] if i == j else [(i, up, None), (j, down, None)]
        yield pa.record_batch([pa.array([x[0] for x in shares], pa.int32()), pa.array([x[2] for x in shares], pa.binary()), pa.array([x[1].tobytes() for x in shares], pa.binary())], ["block", "sums", "y"])


def _gathered(batches, side: int, width: int):
    """Sums of the shares of each block, over rows sorted by block, and the products of their columns."""
    at, sums, y = None, None, None

    def whole():
        x = y.reshape(-1, side)[:width]
        return pa.record_batch([pa.array([at], pa.int32()), pa.array([sums], pa.binary()), pa.array([y.tobytes()], pa.binary()), pa.array([(x @ x.T).ravel().tolist()], pa.list_(pa.float64()))], ["block", "sums", "y", "gram"])

    for batch in batches:
        columns = [batch.column(c) for c in ("block", "sums", "y")]
        for i, block in enumerate(columns[0].to_pylist()):
            if block != at:
                if at is not None:
                    yield whole()
                at, sums, y = block, None, 0.0
            sums = columns[1][i].as_py() or sums
            y = y + np.frombuffer(columns[2][i].as_py(), float)
    if at is not None:
        yield whole()


def leading(pairs: Pairs, width: int, iterations: int) -> DataFrame:
    """(w, x): U * sqrt(S) of the symmetric part of the terms' positive mutual information, by subspace iteration; terms without any are left out.

    The matrix stays packed in cells. A round hands each cell the columns of its two
    blocks and adds its shares up by block; only ``width`` x ``width`` sums of each block
    come to the driver, to keep the columns orthogonal.
    """
    blocks, side, alpha, ta = pairs.blocks, pairs.side, pairs.alpha, pairs.ta
    unit = lambda k: F.pmod(F.xxhash64("w", F.lit(k)), F.lit(1_000_003)) / 1_000_003.0 - 0.5
    start = pairs.placed("n", F.array(*[unit(k) for k in range(width)]).alias("x"))
    y = written(start.mapInArrow(lambda b: _started(b, side), _BLOCK), "columns")
    cells = written(pairs.at_cells(pairs.met(), y.select("block", "sums")).mapInArrow(lambda b: _kept(b, side, alpha, ta), "cell int, blob binary"), "cells")
    values, turn = np.ones(width), np.eye(width)
    for _ in range(iterations):
        # the default holds this round's turn
        shares = pairs.at_cells(cells, y).mapInArrow(lambda b, turn=turn: _multiplied(b, blocks, side, alpha, ta, turn), _BLOCK)
        before, summed_ = y, shares.repartition("block").sortWithinPartitions("block").mapInArrow(lambda b: _gathered(b, side, width), f"{_BLOCK}, gram array<double>")
        y = written(summed_, "columns")
        grams = [r["gram"] for r in y.select("block", "gram").orderBy("block").collect()]  # width x width numbers a block
        y = y.drop("gram")
        removed(before)
        g = np.sum(grams, axis=0).reshape(width, width) if grams else np.zeros((width, width))
        s, u = np.linalg.eigh(g)
        s, u = np.maximum(s[::-1], 1e-12), u[:, ::-1]
        values, turn = np.sqrt(s), u / np.sqrt(s)
        turn = turn * np.where(turn[np.abs(turn).argmax(0), np.arange(width)] < 0, -1, 1)
    removed(cells)

    def rows(batches):
        for batch in batches:
            for block, own in zip(batch.column("block").to_pylist(), batch.column("y"), strict=True):
                own = np.frombuffer(own.as_py(), float).reshape(-1, side)
                x = (own[:width].T @ turn) * np.sqrt(values)
                used = np.flatnonzero(own[width] > 0) if len(own) > width else np.arange(side)
                for k in range(0, len(used), ROWS):
                    at = used[k : k + ROWS]
                    yield pa.record_batch([pa.array(at * blocks + block), pa.array(list(x[at]), pa.list_(pa.float64()))], ["id", "x"])

    return y.mapInArrow(rows, "id long, x array<double>").join(pairs.words, "id").select("w", "x")
