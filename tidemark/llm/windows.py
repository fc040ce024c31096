"""Repeated windows of a fixed number of symbols, found through the windows' own least k-gram.

Every window is filed under its least-hashed k-gram (leftmost of equals), which depends
on the window's content alone. Consecutive windows of a document with the same one form
a run; the symbols a run spans are its class. Equal classes settle whole runs at once,
and only runs whose k-gram also occurs in another class need their windows looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, mix64

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Windows of a document handled at a time.
_PIECE = 1 << 16
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    if len(_POWERS.get(base, ())) < n:
        out = np.ones(n, np.uint64)
        np.multiply.accumulate(np.full(n - 1, base, np.uint64), out=out[1:])
        _POWERS[base] = out
    return _POWERS[base][:n]


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    """Sums of symbol times power, from 0: differences are polynomial hashes up to a power."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols)), out=out[1:])
    return out


def between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end), independent of where they stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), _INVERSE)[start]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size, n = 1, len(x) - width + 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def runs(symbols: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of one document: anchor (hash of the k-gram), class, first window, last window, place of the k-gram."""
    found = []
    for a in range(0, max(len(symbols) - width + 1, 0), _PIECE):
        own = symbols[a : a + _PIECE + width - 1]
        prefix = prefix_hashes(own)
        n = len(own) - gram + 1
        at = np.arange(n)
        h = mix64(between(prefix, at, at + gram))
        least = sliding_least((h >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64), width - gram + 1)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        last = np.append(first[1:], len(least)) - 1
        place = (least[first] & np.uint64(0xFFFFFF)).astype(np.int64)
        shape = ((last - first) << 16 | (place - first)).astype(np.uint64)
        kind = mix64(between(prefix, first, last + width) ^ mix64(shape + np.uint64(1)))
        found.append((h[place], kind, first + a, last + a, place + a))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def packed(first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    """First window, number of further windows and place of the k-gram from the first, in one integer."""
    return first << 16 | (last - first) << 8 | (place - first)


def first_of(pack="pack"):
    return F.shiftright(pack, 16)


def length_of(pack="pack"):
    return F.shiftright(pack, 8).bitwiseAND(F.lit(255))


def run_rows(columns: list[str], symbols_of, width: int, gram: int):
    """A mapInArrow function: rows (columns, anchor, kind, pack) of the runs of each row of a batch.

    ``symbols_of(batch)`` yields a row's symbols as unsigned 64-bit integers.
    """

    def mapped(batches):
        for batch in batches:
            parts, counts, total = [], [], 0
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            done = 0
            for i, symbols in enumerate(symbols_of(batch)):
                anchor, kind, first, last, place = runs(symbols, width, gram)
                parts.append((anchor.view(np.int64), kind.view(np.int64), packed(first, last, place)))
                counts.append(len(anchor))
                total += len(anchor)
                if total > 200_000 or i + 1 == batch.num_rows:
                    names = [np.repeat(x[done : i + 1], counts) for x in own]
                    values = names + [np.concatenate(x) for x in zip(*parts, strict=True)]
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in values], [*columns, "anchor", "kind", "pack"])
                    parts, counts, total, done = [], [], 0, i + 1

    return mapped


def recurring(rows: DataFrame, extra: list) -> DataFrame:
    """The rows of run_rows whose anchor occurs more than once, with ``extra`` aggregates of the anchor and whether it has several classes.

    ``extra`` are aggregate columns and decide, by a column named ``live``, which anchors stay.
    """
    written = materialize(rows, "runs")
    anchors = written.groupBy("anchor").agg((F.min("kind") != F.max("kind")).alias("several"), *extra).where("live").drop("live")
    out = materialize(written.join(anchors, "anchor"), "live")
    drop_table(written)
    return out


def window_rows(symbols_of, width: int):
    """A mapInArrow function: rows (anchor, kind, offset, window) for each window of the wanted runs of each row.

    Column ``wanted`` lists the runs as structs of anchor, kind and pack.
    """

    def mapped(batches):
        for batch in batches:
            for symbols, wanted in zip(symbols_of(batch), batch.column("wanted").to_pylist(), strict=True):
                for a in range(0, len(wanted), 2048):
                    own = wanted[a : a + 2048]
                    pack = np.array([w["pack"] for w in own], np.int64)
                    first, n = pack >> 16, (pack >> 8 & 255) + 1
                    which = np.repeat(np.arange(len(own)), n)
                    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    hashed = np.empty(len(which), np.uint64)
                    for k in np.unique(first // _PIECE):  # prefix hashes over the piece that holds the windows
                        here = first[which] // _PIECE == k
                        prefix = prefix_hashes(symbols[k * _PIECE : (k + 1) * _PIECE + 2 * width + 256])
                        start = first[which][here] + offset[here] - k * _PIECE
                        hashed[here] = mix64(between(prefix, start, start + width))
                    yield pa.record_batch(
                        {
                            "anchor": pa.array(np.array([w["anchor"] for w in own], np.int64)[which]),
                            "kind": pa.array(np.array([w["kind"] for w in own], np.int64)[which]),
                            "offset": pa.array(offset.astype(np.int32)),
                            "window": pa.array(hashed.view(np.int64)),
                        }
                    )

    return mapped


WINDOW_ROWS = "anchor long, kind long, offset int, window long"


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, sorted union of the stretches [start, end); touching ones join."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[fresh], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(reach) - 1)]
