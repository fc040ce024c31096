"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, flat, materialize
from .components import components

#: Words of a shingle and bits that linked fingerprints may differ in, by contract of op4.
SHINGLE_WORDS, MOST_BITS = 3, 2
#: Words of a shingle for the pipeline, by the rule for stages on word shingles.
STAGE_SHINGLE_WORDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashes of shingles of which a bit column is summed at a time.
_SLICE = 1 << 17


def shingle_hashes(size: int):
    """Column: XXH64 (seed 42) of every shingle of ``_words``, repeats included."""
    n = F.size("_words")
    joined = lambda i: F.array_join(F.slice("_words", i, F.lit(size)), " ")
    starts = F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1)))
    return F.when(n > 0, F.transform(starts, lambda i: F.xxhash64(joined(i)))).otherwise(F.array().cast("array<long>"))


def majority(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprint of each document: bits set in over half of its hashes; 0 without hashes."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _SLICE, "right")) - 1)
        own = np.flatnonzero(n[a:b]) + a
        if len(own):
            counts = np.zeros((len(own), 64), np.int64)
            for c in range(int(offsets[a]), int(offsets[b]), _SLICE):  # more than one round for a very long document only
                d = min(c + _SLICE, int(offsets[b]))
                bits = np.unpackbits(np.ascontiguousarray(values[c:d]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                start = np.maximum(offsets[own] - c, 0)
                counts += np.add.reduceat(bits, start, axis=0, dtype=np.int32) if d - c else 0
            out[own] = ((2 * counts > n[own][:, None]).astype(np.uint64) * weights).sum(1, dtype=np.uint64)
        a = b
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS, keep: list[str] | None = None) -> DataFrame:
    """Add ``fp``, the 64-bit fingerprint of the text as a long, to columns ``keep`` (doc_id by default)."""
    from pyspark.sql import types as T

    keep = keep or ["doc_id"]
    lowered = docs.select(*keep, words_of_lower().alias("_words")).select(*keep, shingle_hashes(size).alias("_hashes"))

    def printed(batches):
        for batch in batches:
            values, offsets = flat(batch.column("_hashes"), np.int64)
            yield pa.record_batch({**{c: batch.column(c) for c in keep}, "fp": pa.array(majority(values, offsets).view(np.int64))})

    fields = [docs.schema[c] for c in keep]
    return lowered.mapInArrow(printed, T.StructType([*fields, T.StructField("fp", T.LongType())]))


def words_of_lower():
    return F.filter(F.split(F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors within two bits of each fingerprint, with the index of the fingerprint.

    Anchors are the words of the [63, 57] Hamming code with a free 64th bit: a code of
    covering radius 1. Fingerprints at two bits or fewer have a point midway that is
    within one bit of both, and that point's nearest anchor is within radius 1 + half
    the threshold = 2 of both, so linked fingerprints share an anchor. A fingerprint has
    at most 33 anchors, and an anchor at most 1 + 64 + 2016 distinct fingerprints.
    """
    fp = fp.astype(np.uint64)
    syndrome = np.zeros(len(fp), np.uint64)
    for i in range(63):
        syndrome ^= (fp >> np.uint64(i) & np.uint64(1)) * np.uint64(i + 1)
    bit = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(63, dtype=np.uint64)))  # by column of the check, 0: none
    top = np.uint64(1) << np.uint64(63)
    nearest = fp ^ bit[syndrome]
    index = np.arange(len(fp))
    points, owners = [nearest, nearest ^ top], [index, index]
    off = index[syndrome > 0]
    s = syndrome[off].astype(np.int64)
    for i in range(1, 64):  # two flips whose columns sum to the syndrome
        j = i ^ s
        own = j > i
        points.append(fp[off[own]] ^ bit[i] ^ bit[j[own]])
        owners.append(off[own])
    return np.concatenate(points), np.concatenate(owners)


def _replicated(batches):
    for batch in batches:
        fp, rep = batch.column("fp").to_numpy().view(np.uint64), batch.column("rep").to_numpy()
        for a in range(0, len(fp), 4096):
            point, owner = anchors(fp[a : a + 4096])
            yield pa.record_batch({"anchor": pa.array(point.view(np.int64)), "fp": pa.array(fp[a : a + 4096][owner].view(np.int64)), "rep": pa.array(rep[a : a + 4096][owner])})


def _group_links(fp: np.ndarray, rep: np.ndarray) -> list[tuple[int, int]]:
    """Links of one anchor that join the same fingerprints as all of its pairs would: a forest by union-find."""
    parent = list(range(len(fp)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i in range(len(fp) - 1):
        near = np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= MOST_BITS) + i + 1
        for j in near.tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(rep[i]), int(rep[j])))
    return out


def _compared(batches):
    """Links per anchor of a partition sorted by anchor; a group that a batch cuts is carried on (2079 rows at most)."""
    held = None
    for batch in batches:
        own = [batch.column(c).to_numpy() for c in ("anchor", "fp", "rep")]
        if held is not None:
            own = [np.concatenate(x) for x in zip(held, own, strict=True)]
        anchor = own[0]
        cut = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0
        yield from _links_of(*[x[:cut] for x in own])
        held = [x[cut:] for x in own]
    if held is not None:
        yield from _links_of(*held)


def _links_of(anchor, fp, rep):
    starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(anchor)))
    two = starts[sizes == 2]
    near = two[np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= MOST_BITS]
    a, b = [rep[near]], [rep[near + 1]]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        if found := _group_links(fp[s : s + n].view(np.uint64), rep[s : s + n]):
            x, y = zip(*found, strict=True)
            a.append(np.array(x))
            b.append(np.array(y))
    a, b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
    if len(a):
        yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """Return (doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    Fingerprints at MOST_BITS bits or fewer are linked, and component_id is the
    smallest doc_id reachable. Equal fingerprints collapse first, so copies cost
    nothing further. Null and empty texts have fingerprint 0; texts shorter than a
    shingle are one shingle. Rows with a null doc_id get a null component and link
    nothing. Repeated rows and ids are kept. An empty table gives an empty result;
    other columns are ignored.
    """
    printed = materialize(fingerprints(docs, size), "fingerprints")
    kinds = materialize(printed.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").cast("long").alias("rep")), "kinds")
    copies = kinds.mapInArrow(_replicated, "anchor long, fp long, rep long")
    links = copies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compared, "a long, b long")
    joined = components(links)
    named = kinds.join(joined, F.col("rep") == F.col("id"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id"))
    out = printed.join(named, F.col("fp") == F.col("_fp"), "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; contract of op4."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
