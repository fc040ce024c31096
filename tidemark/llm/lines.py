"""Line dedup: fuzzy lines by MinHash, exact Jaccard verification and distributed union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .alike import band_keys, minima, similar, sorted_sets
from .common import documents, materialize, trim, unused

#: Characters of a shingle, and rows and bands of the signature: one of 1,900 pairs at similarity 0.8 shares no band.
SHINGLE_CHARS, ROWS, BANDS = 8, 4, 12
#: Characters of texts, and of lines, that are worked on together.
CHUNK, SLICE = 1 << 20, 1 << 16
_BASE, _SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
#: White space besides line feeds and single spaces: in ASCII, and elsewhere.
_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_MORE_SPACES = "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def normal(line: str) -> str:
    """A line as it is compared: lower case, white space collapsed."""
    return " ".join(line.split()).lower()


def normal_lines(text: str) -> list[str]:
    """The normal form of each line of a text; most texts have no white space to collapse."""
    plain = not ("  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in _SPACES))
    if plain and (text.isascii() or not any(c in text for c in _MORE_SPACES)):
        return text.lower().split("\n")
    return [normal(x) for x in text.split("\n")]


def _line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _grams(text: np.ndarray) -> np.ndarray:
    """Scrambled polynomial hashes of the SHINGLE_CHARS code points from each place on, doubled up from single ones."""
    out, base, width = np.pad(text, (0, SHINGLE_CHARS - 1)).astype(np.uint64), _BASE, 1
    while width < SHINGLE_CHARS:
        out = out[:-width] * np.uint64(base) + out[width:]
        base, width = base * base % 2**64, 2 * width
    out *= _SPREAD
    out ^= out >> np.uint64(32)
    out *= _SPREAD
    return out


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the character shingles of each line, repeats included; a shorter line is one shingle."""
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    n = np.maximum(length - SHINGLE_CHARS + 1, 1)
    offsets = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(offsets[-1], np.uint64)
    ends, a = np.cumsum(length), 0
    while a < len(lines):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + SLICE, "right")))
        step = _grams(np.frombuffer("".join(lines[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32))
        inside, last, least = np.ones(len(step), bool), ends[a:b] - done - 1, ends[a:b] - length[a:b] - done
        for k in range(SHINGLE_CHARS - 1):  # those that run over a line's end, but for the first of each line
            inside[(last - k)[last - k > least]] = False
        if length[a:b].all():
            out[offsets[a] : offsets[b]] = step[inside]
        else:  # an empty line has a place, but no character
            out[np.flatnonzero(np.repeat(length[a:b] > 0, n[a:b])) + offsets[a]] = step[inside]
        a = b
    for i in np.flatnonzero(length < SHINGLE_CHARS):  # the whole line is the shingle
        out[offsets[i]] = _line_id(lines[i]) + (1 << 63)
    return out, offsets


def shingle_sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return sorted_sets(*shingle_hashes(lines))


def bands_of(lines: list[str]) -> np.ndarray:
    """The band keys (lines x BANDS) of normalised, non-empty lines."""
    hashes, offsets = shingle_hashes(lines)
    return band_keys(minima((hashes >> np.uint64(32)).astype(np.uint32), offsets, ROWS * BANDS), BANDS)


def _lines_of(batches):
    """A row for each line that has characters: id, place, whether it is its row's first, and band keys (none where an equal line of the chunk has them)."""
    for batch in batches:
        ids, prints, texts = (batch.column(c).to_pylist() for c in ("doc_id", "print", "text"))
        a = 0
        while a < len(ids):
            b, chars = a, 0
            while b < len(ids) and (b == a or chars + len(texts[b]) <= CHUNK):
                chars += len(texts[b])
                b += 1
            place: dict[str, int] = {}
            which, row, number = [], [], []
            for i in range(a, b):
                for k, line in enumerate(normal_lines(texts[i])):
                    if line:
                        which.append(place.setdefault(line, len(place)))
                        row.append(i)
                        number.append(k)
            a = b
            if which:
                lines = list(place)
                which, row = np.array(which), np.array(row)
                first = np.zeros(len(which), bool)
                first[np.unique(which, return_index=True)[1]] = True
                keys, name = bands_of(lines), np.fromiter(map(_line_id, lines), np.int64, len(lines))
                own: list[bytes | None] = [None] * len(which)
                for at, k in zip(np.flatnonzero(first).tolist(), which[first].tolist(), strict=True):
                    own[at] = keys[k].tobytes()
                head = np.concatenate(([True], row[1:] != row[:-1]))
                columns = [pa.array(name[which]), pa.array(np.array(ids, np.int64)[row]), pa.array(np.array(prints, np.int64)[row]), pa.array(np.array(number, np.int32)), pa.array(head), pa.array(own, pa.binary())]
                yield pa.record_batch(columns, ["line", "doc_id", "print", "number", "head", "bands"])
    trim()


LINES = "line long, doc_id long, print long, number int, head boolean, bands binary"


def _wanted_texts(batches):
    for batch in batches:
        line, text = [], []
        for whole, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            own = normal_lines(whole)
            for w in wanted:
                line.append(w["line"])
                text.append(own[w["number"]])
        yield pa.record_batch([pa.array(line, pa.int64()), pa.array(text, pa.string())], ["line", "normal"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), F.coalesce("text", F.lit("")).alias("text"))


def line_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Return the lines of ``docs`` (LINES) and the components (id, component) of lines that are alike another.

    Lines of equal normal form have one id, and a line's place is its row, by id and
    hash of the text, and its number in it.
    """
    lines = materialize(_keyed(docs).mapInArrow(_lines_of, LINES), "lines")

    def texts_of(wanted: DataFrame) -> DataFrame:
        # any place of a line will do; those with band keys are fewer
        one = lines.where("bands is not null").select("line", "doc_id", "print", "number").join(wanted, "line", "left_semi").dropDuplicates(["line"])
        by_row = one.groupBy("doc_id", "print").agg(F.collect_list(F.struct("line", "number")).alias("wanted"))
        whole = _keyed(docs).join(by_row.hint("shuffle_hash"), ["doc_id", "print"])
        return whole.select("text", "wanted").mapInArrow(_wanted_texts, "line long, normal string").dropDuplicates(["line"])

    return lines, similar(lines.where("bands is not null").select("line", "bands"), texts_of, shingle_sets)


def removals(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Return (doc_id, print, removed): the numbers of the lines that go, of rows that lose any; and whether rows are repeated."""
    lines, found = line_components(docs)
    place = F.struct("doc_id", "print", "number")
    # places are compared among lines that repeat only: a minimum of structs sorts its rows
    again = lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line")
    several = again.join(found.withColumnRenamed("id", "line"), "line", "full").select("line", F.coalesce("component", "line").alias("component"))
    own = materialize(lines.select("line", "doc_id", "print", "number").join(several, "line").select("component", "doc_id", "print", "number"), "several")
    stays = own.groupBy("component").agg(F.min(place).alias("stays"))
    gone = own.join(stays, "component").where(place != F.col("stays"))
    heads = lines.where("head").groupBy("doc_id", "print").count().where("count > 1")
    return materialize(gone.groupBy("doc_id", "print").agg(F.sort_array(F.collect_set("number")).alias("removed")), "removed"), not heads.isEmpty()


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _full_lines(text: pa.Array) -> pa.Array:
    """Numbers of the lines of each text that have characters."""
    return pa.array([None if t is None else [k for k, x in enumerate(normal_lines(t)) if x] for t in text.to_pylist()], pa.list_(pa.int32()))


def _without(text, numbers):
    """Column: the text without the lines of these numbers."""
    both = F.array(F.struct(F.split(text, "\n", -1).alias("lines"), numbers.alias("gone")))
    left = F.transform(both, lambda s: F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["gone"]), lambda k: F.get(s["lines"], k)))
    return F.when(numbers.isNull(), text).otherwise(F.array_join(left[0], "\n"))


def dedup_lines(docs: DataFrame, counts: bool = False) -> DataFrame:
    """Return ``docs`` with repeated and near-repeated lines taken out of ``text``.

    Of every component of lines at Jaccard similarity 0.8 or more (over character
    shingles of the normalised line, linked transitively) the first stays, by doc_id,
    hash of the text, and line number. Rows that share a doc_id are told apart by their
    texts; of rows that share both, the copies after the first lose every line that has
    characters. Lines without characters are never repeats. ``n_chars``, if there,
    follows the text. With ``counts``, columns n_lines and n_removed follow. A null
    text stays null; a document may become empty. Texts and lines of any length are
    compared whole. Rows with a null doc_id are left alone. An empty table stays empty.
    Other columns are kept as they are, whatever their names.
    """
    found, repeated = removals(docs)
    key, mark, numbers, copy, had = unused(docs.columns, "id", "print", "removed", "copy", "had")
    gone = found.select(F.col("doc_id").alias(key), F.col("print").alias(mark), F.col("removed").alias(numbers))
    print_ = F.xxhash64("text")
    out = docs.join(gone.hint("shuffle_hash"), (F.col("doc_id").cast("long") == F.col(key)) & (print_ == F.col(mark)), "left").drop(key, mark)
    if repeated:
        same = W.partitionBy("doc_id", print_).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
        out = out.withColumn(copy, F.row_number().over(same))
        out = out.withColumn(numbers, F.when((F.col(copy) > 1) & F.col("doc_id").isNotNull(), _full_lines("text")).otherwise(F.col(numbers))).drop(copy)
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n")))
    out = out.withColumns({had: F.when(F.col("text").isNull(), 0).otherwise(breaks + 1).cast("long"), "text": _without(F.col("text"), F.col(numbers))})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    extra = [F.col(had).alias("n_lines"), F.when(F.col(numbers).isNull(), 0).otherwise(F.size(numbers)).cast("long").alias("n_removed")] if counts else []
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *extra)


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, those removed, and the SHA-256 of the text that stays."""
    kept = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), counts=True)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
