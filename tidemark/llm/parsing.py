"""Document fingerprints by locally consistent parsing: deterministic coin tossing names phrases level by level."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mix64

#: Levels of phrases; about 2.7 symbols make a phrase of the next level, so the last has phrases of some 20 characters.
LEVELS = 3
#: Minima kept of the names of the last level, 16 bits each.
SKETCH = 64
#: Characters of texts parsed together.
CHUNK_CHARS = 1 << 16
_ROUNDS = 3  # of label reduction after the first: labels under 128, 14, 8, 6
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _reduce_table() -> np.ndarray:
    """table[a, b]: lowest bit in which labels a and b under 128 differ, doubled, plus a's bit there; 0 for equal labels."""
    a, b = np.arange(128, dtype=np.int64)[:, None], np.arange(128, dtype=np.int64)[None]
    differ = a ^ b
    low = np.where(differ > 0, np.log2(np.maximum(differ & -differ, 1)).astype(np.int64), 0)
    return (2 * low + (a >> low & 1)).astype(np.uint8)


_TABLE = _reduce_table()


def _collapsed(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one name become a name of their own; ``first`` marks the first name of each text."""
    fresh = first.copy()
    fresh[1:] |= names[1:] != names[:-1]
    start = np.flatnonzero(fresh)
    length = np.diff(np.append(start, len(names))).astype(np.uint64)
    own = names[start]
    many = length > 1
    own[many] = mix64(own[many] ^ length[many] * _FACTOR)
    return own, first[start]


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels under 6 from each name and its few left neighbours; neighbours differ."""
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[first] = ~names[first]
    differ = names ^ before
    low = differ & (~differ + np.uint64(1))
    place = np.bitwise_count(low - np.uint64(1)).astype(np.uint64)
    label = (np.uint64(2) * place + (names >> np.minimum(place, np.uint64(63)) & np.uint64(1))).astype(np.uint8)
    label &= 127
    for _ in range(_ROUNDS):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[first] = label[first] ^ 1
        label = _TABLE[label, before]
    return label


def _phrases(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases that start at local maxima of the labels, and at each text's start."""
    names, first = _collapsed(names, first)
    label = _labels(names, first).astype(np.int8)
    last = np.append(first[1:], True)
    left, right = np.empty_like(label), np.empty_like(label)
    left[1:], right[:-1] = label[:-1], label[1:]
    left[first], right[last] = 127, 127  # a text's ends are no maxima
    cut = (label > left) & (label > right) | first
    start = np.flatnonzero(cut)
    within = np.arange(len(names)) - np.repeat(start, np.diff(np.append(start, len(names))))
    return mix64(np.add.reduceat(mix64(names + within.astype(np.uint64) * _FACTOR), start)), first[start]


def names_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the last level's phrases of non-empty texts, and where each text's names start."""
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.zeros(len(names), bool)
    first[np.cumsum([0, *map(len, texts[:-1])])] = True
    names = mix64(names)
    for _ in range(LEVELS):
        names, first = _phrases(names, first)
    return names, np.flatnonzero(first)


def sketches(texts: list[str]) -> np.ndarray:
    """texts x SKETCH minima (16 bits) of seeded hashes of a text's phrase names; all 65535 for an empty text."""
    out = np.full((len(texts), SKETCH), 0xFFFF, np.uint16)
    own = [i for i, t in enumerate(texts) if t]
    if own:
        names, start = names_of([texts[i] for i in own])
        short = (names >> np.uint64(32)).astype(np.uint32)
        seeds = mix64(np.arange(1, 2 * SKETCH + 1, dtype=np.uint64))
        for k in range(SKETCH):
            flip, factor = np.uint32(seeds[k] >> np.uint64(32)), np.uint32(seeds[SKETCH + k] & np.uint64(0xFFFFFFFF)) | np.uint32(1)
            least = np.minimum.reduceat((short ^ flip) * factor, start)
            out[own, k] = (mix64(least.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal minima: an estimate of the Jaccard similarity of the phrase sets."""
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many code points from the start of ``following``, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _chunks(texts: list[str]):
    a = 0
    while a < len(texts):
        b, chars = a, 0
        while b < len(texts) and (b == a or chars + len(texts[b]) <= CHUNK_CHARS):
            chars += len(texts[b])
            b += 1
        yield a, b
        a = b


PRINTED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _printed(batches):
    """Rows in order, each with the row after it; borrowed rows only stand after others."""
    held: list[tuple] = []
    for batch in batches:
        rows = held + list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "borrowed")), strict=True))
        yield from _pairs(rows)
        held = rows[-1:]


def _pairs(rows: list[tuple]):
    texts = [t for _, t, _ in rows]
    for a, b in _chunks(texts):
        stop = min(b + 1, len(rows))  # the row after the chunk's last, which the next chunk starts with
        own = sketches(texts[a:stop])
        pairs = [i for i in range(a, stop - 1) if not rows[i][2]]
        if not pairs:
            continue
        new = [edited(texts[i], texts[i + 1]) for i in pairs]
        changed = np.concatenate([sketches(new[c:d]) for c, d in _chunks(new)])
        at = np.array(pairs) - a
        columns = [
            pa.array([rows[i][0] for i in pairs], pa.int64()),
            pa.array([len(texts[i]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
            pa.array([x.astype(">u2").tobytes().hex() for x in own[at]]),
            pa.array([x.astype(">u2").tobytes().hex() for x in changed]),
            pa.array(likeness(own[at], changed)),
            pa.array(likeness(own[at], own[at + 1])),
        ]
        yield pa.record_batch(columns, [x.split()[0] for x in PRINTED.split(", ")])


_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


def _bounds(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Lower bounds (key, mark) of about ``parts`` ranges of rows (key, mark) of about equal size; a key of many rows is split by mark."""
    cuts = rows.approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts)
    total = rows.count()
    out = {(_LOWEST, _LOWEST), *((min(int(c), _HIGHEST), _LOWEST) for c in cuts)}
    heavy = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * parts > 2 * total)  # parts / 2 keys at most
    for key, n in heavy.collect():
        pieces = n * parts // total
        out |= {(key, _LOWEST + (i << 64) // pieces) for i in range(pieces)}
    return sorted(out)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint each text of ``docs`` (doc_id, text) and its edited text; return PRINTED.

    The next document is the next by doc_id, nulls first, ties by the text's hash; after
    the last comes the first. Rows are dealt to ranges of doc_id and hash, and the first
    row of a range is lent to the range before it, so that no task sees more than its
    range and one row. Ids may have any 64-bit value. Null texts are empty; two empty
    texts are alike (1). Texts of any length are parsed whole. Repeated rows are kept and
    follow one another. One row alone follows itself; an empty table gives an empty
    result; other columns are ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    rows = docs.select(key.alias("key"), F.xxhash64("text").alias("mark"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(rows.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if rows.isEmpty():
        return docs.sparkSession.createDataFrame([], PRINTED)
    bounds = _bounds(rows.select("key", "mark"), parts)
    keys, marks = (np.array(x, np.int64) for x in zip(*bounds, strict=True))

    @F.arrow_udf("int")
    def range_of(key: pa.Array, mark: pa.Array) -> pa.Array:
        k, m = key.to_numpy(zero_copy_only=False), mark.to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, k, "right") - 1
        while (beyond := (keys[at] == k) & (marks[at] > m)).any():
            at[beyond] -= 1
        return pa.array(at.astype(np.int32))

    dealt = rows.withColumn("range", range_of("key", "mark"))
    least = sorted((r, *first) for r, first in dealt.groupBy("range").agg(F.min(F.struct("key", "mark"))).collect())  # a row a range
    before = docs.sparkSession.createDataFrame([(least[i - 1][0], k, m) for i, (_, k, m) in enumerate(least)], "before int, key long, mark long")
    lent = rows.join(F.broadcast(before), ["key", "mark"]).select(F.col("before").alias("range"), F.lit(True).alias("borrowed"), "key", "mark", "doc_id", "text")
    own = dealt.select("range", F.lit(False).alias("borrowed"), "key", "mark", "doc_id", "text")
    ranged = own.union(lent.dropDuplicates(["range"])).repartitionById(len(bounds), F.col("range"))
    return ranged.sortWithinPartitions("borrowed", "key", "mark").select("doc_id", "text", "borrowed").mapInArrow(_printed, PRINTED)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and its next; contract of op7."""
    return fingerprint_edits(documents(spark, sf_dir))
