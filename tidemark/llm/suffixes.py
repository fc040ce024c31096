"""Exact substring dedup by a hash-compared suffix sort of sampled suffixes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, mix64
from .windows import WINDOW_ROWS, covered, first_of, length_of, powers, recurring, run_rows, window_rows

#: Bytes of a string that counts as repeated, and of the k-gram that files it.
WINDOW, GRAM = 200, 80
#: Classes of one anchor that are sorted together; anchors with more are settled by counting window hashes instead.
MOST_SORTED = 2048
#: Suffixes of a batch of anchors that are sorted at a time.
BATCH = 8192
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))

KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _symbols(batch):
    for text in batch.column("text").to_pylist():
        yield _VALUES[np.frombuffer(text.encode(), np.uint8)]


class Suffixes:
    """Byte strings (rows of ``data`` up to ``length``) of groups, compared through prefix polynomial hashes."""

    def __init__(self, group: np.ndarray, data: np.ndarray, length: np.ndarray):
        self.group, self.data, self.length = group, data, length
        self.hash = np.zeros((len(data), data.shape[1] + 1), np.uint64)
        np.cumsum((_VALUES[data] + np.uint64(1)) * powers(data.shape[1] or 1)[: data.shape[1]], axis=1, out=self.hash[:, 1:])

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, by binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.hash[a, middle] == self.hash[b, middle]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def after(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether a sorts after b; ``ties`` says so for equal suffixes. Both are of one group."""
        n = self.extension(a, b)
        ends_a, ends_b = n == self.length[a], n == self.length[b]
        last = max(self.data.shape[1] - 1, 0)
        at = np.minimum(n, last)
        differ = self.data[a, at] > self.data[b, at]
        return np.where(ends_a & ends_b, ties, np.where(ends_a, False, np.where(ends_b, True, differ)))

    def sort(self) -> np.ndarray:
        """Order of the suffixes, groups in sequence: a bottom-up mergesort, each merge a binary search of ranks."""
        order = np.argsort(self.group, kind="stable")
        _, begin, size = np.unique(self.group[order], return_index=True, return_counts=True)
        start, end = np.repeat(begin, size), np.repeat(begin + size, size)
        place, width = np.arange(len(order)) - start, 1
        while width < size.max(initial=0):
            run = place // width
            own = start + run * width
            other = start + (run ^ 1) * width
            stop = np.minimum(other + width, end)
            low, high = np.minimum(other, stop), stop.copy()
            left = run % 2 == 0  # of equal suffixes, those of the left run come first
            active = np.flatnonzero(low < high)
            while len(active):
                middle = (low[active] + high[active]) >> 1
                beyond = self.after(order[active], order[middle], ~left[active])
                low[active] = np.where(beyond, middle + 1, low[active])
                high[active] = np.where(beyond, high[active], middle)
                active = active[low[active] < high[active]]
            rank = low - np.minimum(other, stop)
            new = np.minimum(own, other) + (place - run * width) + rank
            merged = np.empty_like(order)
            merged[new] = order
            order, width = merged, width * 2
        return order

    def neighbours(self, order: np.ndarray) -> np.ndarray:
        """Verified common prefix of each suffix with the one before it; -1 at a group's first."""
        out = np.full(len(order), -1)
        at = np.flatnonzero(self.group[order[1:]] == self.group[order[:-1]]) + 1
        a, b = order[at], order[at - 1]
        claimed = self.extension(a, b)
        differ = self.data[a] != self.data[b]
        true = np.where(differ.any(axis=1), differ.argmax(axis=1), self.data.shape[1])
        if (np.minimum(true, np.minimum(self.length[a], self.length[b])) != claimed).any():
            raise Collision
        out[at] = claimed
        return out


class Collision(Exception):
    """Two different strings had one hash."""


def _sorted(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Order and neighbours' common prefixes; after a collision, from the bytes themselves."""
    try:
        order = s.sort()
        return order, s.neighbours(order)
    except Collision:
        rows = [bytes(x[:n]) for x, n in zip(s.data, s.length.tolist(), strict=True)]
        order = np.array(sorted(range(len(rows)), key=lambda i: (s.group[i], rows[i])), np.int64)
        exact = [-1] * len(rows)
        for i in range(1, len(rows)):
            if s.group[order[i]] == s.group[order[i - 1]]:
                a, b = rows[order[i]], rows[order[i - 1]]
                exact[i] = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return order, np.array(exact)


def _matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width), length


def repeated_windows(group: np.ndarray, spans: list[bytes], length: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of the runs also occur in another run of their group: (run, offset) pairs.

    A window that starts ``back`` bytes before the anchor is its last ``back`` bytes
    read backwards and its first WINDOW - back bytes from the anchor on. Both sides are
    sorted once; for every ``back``, stretches of neighbours that share enough are the
    equal left and right parts, and windows are equal where both parts are.
    """
    right = Suffixes(group, *_matrix([s[p : p + WINDOW] for s, p in zip(spans, place.tolist(), strict=True)], WINDOW))
    left = Suffixes(group, *_matrix([s[:p][::-1] for s, p in zip(spans, place.tolist(), strict=True)], WINDOW - GRAM))
    (order_r, same_r), (order_l, same_l) = _sorted(right), _sorted(left)
    runs, offsets = [], []
    n = len(spans)
    for back in range(int(place.max(initial=-1)) + 1):
        own = (place - length <= back) & (back <= place)
        if own.sum() < 2:
            continue
        class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
        class_r[order_r] = np.cumsum(same_r < WINDOW - back)
        class_l[order_l] = np.cumsum(same_l < back)
        at = np.flatnonzero(own)
        both = class_r[at] * (n + 1) + class_l[at]
        _, which, count = np.unique(both, return_inverse=True, return_counts=True)
        hit = at[count[which] > 1]
        runs.append(hit)
        offsets.append(place[hit] - back)
    none = np.zeros(0, np.int64)
    return (np.concatenate(runs), np.concatenate(offsets)) if runs else (none, none)


def _spans_of(batches):
    """The bytes of the wanted runs of each row."""
    for batch in batches:
        rows: list[tuple] = []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            data = text.encode()
            for w in wanted:
                first, more = w["pack"] >> 16, w["pack"] >> 8 & 255
                rows.append((w["anchor"], w["kind"], w["pack"] & 0xFFFF, data[first : first + more + WINDOW]))
                if len(rows) == 20_000:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows):
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["anchor", "kind", "shape", "span"])


def _suffix_sorted(batches):
    """Over rows sorted by anchor: (kind, anchor, offset) of windows with an equal in another run; whole anchors at a time."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows >= BATCH:
            anchor = held.column("anchor").to_numpy()
            cut = int(np.flatnonzero(anchor == anchor[-1])[0])
            if cut:
                yield from _windows(held.slice(0, cut))
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield from _windows(held)


def _windows(table: pa.Table):
    """Anchors of a table sorted by anchor, in portions of about BATCH runs."""
    anchor, kind, shape = (table.column(c).to_numpy() for c in ("anchor", "kind", "shape"))
    starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    portion = starts // BATCH
    cuts = np.append(starts[np.concatenate(([True], portion[1:] != portion[:-1]))], len(anchor))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        run, offset = repeated_windows(np.searchsorted(starts, np.arange(a, b), "right"), table.column("span").slice(a, b - a).to_pylist(), shape[a:b].astype(np.int64) >> 8, shape[a:b].astype(np.int64) & 255)
        if len(run):
            yield pa.record_batch([pa.array(anchor[a:b][run]), pa.array(kind[a:b][run]), pa.array(offset, pa.int32())], ["anchor", "kind", "offset"])


def repeats(docs: DataFrame) -> DataFrame:
    """Find repeated bytes: (key, spans), spans of structs first, last; ``key`` is the hash of id and text."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = keyed.mapInArrow(run_rows(["key"], _symbols, WINDOW, GRAM), "key long, anchor long, kind long, pack long")
    live = recurring(rows, [(F.count("*") > 1).alias("live")])
    kinds = materialize(
        live.groupBy("anchor", "kind").agg(F.count("*").alias("n"), F.first("several").alias("several"), F.min(F.struct("key", "pack")).alias("sample")), "kinds"
    )
    classes = kinds.where("several").groupBy("anchor").agg(F.count("*").alias("classes"))
    open_runs = kinds.where("several").join(classes, "anchor").select("sample.*", "anchor", "kind", (F.col("classes") > MOST_SORTED).alias("large"))
    wanted = materialize(open_runs.groupBy("key", "large").agg(F.collect_list(F.struct("anchor", "kind", "pack")).alias("wanted")), "wanted")
    found = keyed.join(wanted.hint("shuffle_hash"), "key")
    few = found.where("not large").select("text", "wanted").mapInArrow(_spans_of, "anchor long, kind long, shape int, span binary").dropDuplicates(["anchor", "kind"])
    sorted_ = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_suffix_sorted, "anchor long, kind long, offset int")
    partly = materialize(sorted_, "sorted")
    if not wanted.where("large").isEmpty():
        many = materialize(found.where("large").select("text", "wanted").mapInArrow(window_rows(_symbols, WINDOW), WINDOW_ROWS).distinct(), "windows")
        shared = many.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1")
        partly = partly.union(many.join(shared, ["anchor", "window"]).select("anchor", "kind", "offset"))
    once = kinds.where("n = 1").select("anchor", "kind", "sample.*").join(partly, ["anchor", "kind"])
    parts = once.select("key", (first_of() + F.col("offset")).alias("first"), (first_of() + F.col("offset") + WINDOW).alias("last"))
    whole = live.join(kinds.where("n > 1").select("anchor", "kind"), ["anchor", "kind"]).select("key", first_of().alias("first"), (first_of() + length_of() + WINDOW).alias("last"))
    return materialize(whole.union(parts).groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """Remove from each text of ``docs`` (doc_id, text) every byte of a WINDOW-byte string that also starts elsewhere (KEPT).

    Strings are judged on the input; overlaps count, and so do repeats within a text.
    Null counts as empty. Rows with null or equal ids are documents like any other, and
    repeated rows remove each other's strings. Texts shorter than WINDOW bytes stay
    whole. An empty table gives an empty result; other columns are ignored.
    """
    found = repeats(docs).withColumnRenamed("key", "_key").hint("shuffle_hash")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("key"))

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                data = text.encode()
                kept, removed, n = hashlib.sha256(), 0, 0
                if spans:
                    starts, ends = covered(np.array([s["first"] for s in spans]), np.array([s["last"] for s in spans]))
                    at = 0
                    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                        kept.update(data[at:a])
                        at = b
                    kept.update(data[at:])
                    removed, n = int((ends - starts).sum()), len(starts)
                else:
                    kept.update(data)
                rows.append((doc_id, len(data), removed, n, kept.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            if rows:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in KEPT.split(", ")])

    return whole.join(found, F.col("key") == F.col("_key"), "left").select("doc_id", "text", "spans").mapInArrow(cut, KEPT)


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in repeated 200-byte strings; contract of op5."""
    return dedup_bytes(documents(spark, sf_dir))
