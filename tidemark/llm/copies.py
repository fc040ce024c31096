"""Near copies of documents: five-word shingles at exact Jaccard similarity of LEAST, candidates by anchors of SimHash fingerprints and by MinHash bands."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alike import band_keys, minima, similar, sorted_sets
from .common import flat, materialize, mix64
from .simhash import anchors, majority, shingle_hashes, words_of_lower

#: Words of a shingle.
SHINGLE_WORDS = 5
#: Rows and bands of the signature, whose minima are least and greatest of half as many hashes: a pair at similarity 0.8 shares no band once in 10 billion.
ROWS, BANDS = 3, 32
_BASE, _SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
#: Hashes whose fingerprints are taken at a time.
PORTION = 1 << 15
#: Tells keys of anchors from those of bands.
_ANCHOR = np.uint64(0x5349_4D48_4153_4821)


def _sketched(batches):
    for batch in batches:
        hashes, offsets = flat(batch.column("_hashes"), np.int64)
        hashes = hashes.view(np.uint64)
        kind, fp, a, n = [], [], 0, len(offsets) - 1
        while a < n:  # few sets at a time, so that no second copy of the batch is held
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PORTION, "right")) - 1)
            sets = [np.unique(hashes[x:y]) for x, y in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist(), strict=True)]
            kind += [xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in sets]
            fp.append(majority(np.concatenate(sets), np.cumsum([0, *map(len, sets)])))
            a = b
        keys = band_keys(minima((hashes >> np.uint64(32)).astype(np.uint32), offsets, ROWS * BANDS), BANDS)
        bands = pa.array([k.tobytes() for k in keys], pa.binary())
        fp = pa.array(np.concatenate([np.zeros(0, np.uint64), *fp]).view(np.int64))
        yield pa.record_batch([batch.column("doc_id"), batch.column("print"), pa.array(kind, pa.int64()), bands, fp], ["doc_id", "print", "line", "bands", "fp"])


def anchored(batches):
    """Over rows (line, bands, fp): the keys of the anchors within two bits of the fingerprint follow those of the bands."""
    for batch in batches:
        points, owners = anchors(batch.column("fp").to_numpy().view(np.uint64))
        order = np.argsort(owners, kind="stable")
        keys, ends = mix64(mix64(points[order]) ^ _ANCHOR), np.cumsum(np.bincount(owners, minlength=batch.num_rows)).tolist()
        both = [own + keys[a:b].tobytes() for own, a, b in zip(batch.column("bands").to_pylist(), [0, *ends], ends, strict=False)]
        yield pa.record_batch([batch.column("line"), pa.array(both, pa.binary())], ["line", "bands"])


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of texts of words joined by spaces; fewer words are one shingle."""
    known: dict[str, int] = {}
    coded, n = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.split(" ") if text else []
        n[i] = len(own)
        for word in own:
            if (code := known.get(word)) is None:
                code = known[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
            coded.append(code)
    words = np.pad(np.array(coded, np.uint64), (0, SHINGLE_WORDS))
    count = np.where(n > 0, np.maximum(n - SHINGLE_WORDS + 1, 1), 0)
    offsets, start = np.concatenate(([0], np.cumsum(count))), np.cumsum(n) - n
    at = np.repeat(start - offsets[:-1], count) + np.arange(offsets[-1])
    there = np.repeat(start + n, count)  # a text's end, which a shorter text's only shingle stops at
    out = np.zeros(offsets[-1], np.uint64)
    for k in range(SHINGLE_WORDS):
        own = np.where(at + k < there, words[np.minimum(at + k, len(words) - 1)], np.uint64(k))
        out = (out ^ own) * np.uint64(_BASE)
        out ^= out >> np.uint64(29)
    return sorted_sets(out * _SPREAD, offsets)


def near_copies(docs: DataFrame) -> DataFrame:
    """Return (doc_id, print, component_id, stays) for every row of ``docs`` (doc_id, text); ``print`` is the text's hash.

    Documents whose sets of word shingles (ASCII lower case) have Jaccard similarity of
    0.8 or more are linked. The first of a group by doc_id, nulls last, and print
    ``stays``, and its doc_id is the group's component_id. Equal sets collapse first,
    the empty one included, so null and empty texts are one group. Each set has a
    SimHash fingerprint, which is covered by anchors as in op4, so that all sets within
    two bits meet. That alone would miss most pairs: at 0.8 fingerprints of 64 bits
    differ in about 10 bits and up to 20, and unlike ones in about 32 and down to 16.
    So sets that share a MinHash band meet too. Documents that met are compared by
    :func:`.alike.similar`, whole texts and all pairs that are not linked already.
    Rows that share an id are told apart by their texts; repeated rows are
    kept. An empty table gives an empty result; other columns are ignored.
    """
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), words_of_lower().alias("_words"))
    hashed = words.select("doc_id", "print", shingle_hashes(SHINGLE_WORDS).alias("_hashes"))
    sketched = materialize(hashed.mapInArrow(_sketched, "doc_id long, print long, line long, bands binary, fp long"), "sketched")
    # one row of each kind stands for it; the least id, and of rows without an id the least print
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")
    kinds = materialize(sketched.groupBy("line").agg(F.min(place).alias("first"), F.max("bands").alias("bands"), F.max("fp").alias("fp")), "kinds")

    def texts_of(wanted: DataFrame) -> DataFrame:
        first = kinds.join(wanted, "line", "left_semi").select("line", F.col("first.doc_id").alias("id"), F.col("first.print").alias("print"))
        whole = docs.select(F.col("doc_id").cast("long").alias("own"), F.xxhash64("text").alias("mark"), "text")
        found = whole.join(first.hint("shuffle_hash"), F.col("own").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("print")))
        return found.select("line", F.array_join(words_of_lower(), " ").alias("normal")).dropDuplicates(["line"])

    found = similar(kinds.select("line", "bands", "fp"), texts_of, shingle_sets, anchored).select(F.col("id").alias("line"), "component")
    of = kinds.select("line", "first").join(found, "line", "left").withColumn("component", F.coalesce("component", "line"))
    least = of.groupBy("component").agg(F.min("first").alias("least"))
    named = of.join(least, "component").select("line", F.col("least.doc_id").alias("component_id"), F.col("least.print").alias("_print"))
    return sketched.select("doc_id", "print", "line").join(named, "line").select("doc_id", "print", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("print") == F.col("_print"))).alias("stays"))
