"""Mixing sources to target weights: token blocks drawn for output shards through index permutations."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, materialize, mix64, unused

#: Words of a block, slots of an output shard, weights dealt in turn to the sorted sources, uses of a word at most.
BLOCK_WORDS, SHARD_SLOTS, WEIGHTS, MOST_USES = 64, 8192, (5, 2, 1), 3
#: Parts into which the rows of a source are hashed, so that a source's running sum is never one task's work.
PARTS = 1024
SEED = 20240
#: Sources whose table of names and targets is broadcast; a longer one is joined by a shuffle.
FEW_SOURCES = 10_000


def targets(sizes: dict[str | None, int], weights=WEIGHTS, most: int = MOST_USES) -> dict[str | None, float]:
    """Share the sum of all sizes by weight; what exceeds ``most`` times a source's size is shared again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, rest = float(sum(sizes.values())), list(names)
    while rest:
        unit = left / sum(weight[s] for s in rest)
        above = [s for s in rest if unit * weight[s] > most * sizes[s]]
        if not above:
            out |= {s: unit * weight[s] for s in rest}
            break
        for s in above:
            out[s] = float(most * sizes[s])
            left -= out[s]
        rest = [s for s in rest if s not in out]
        left = max(left, 0.0)
    return out


def running_start(df: DataFrame, group: str, part: str, order: list[str], value: str) -> DataFrame:
    """Add ``start``: the sum of ``value`` over the rows of a group before this one, ordered by part and ``order``.

    Two levels: sums of parts are run through a window over parts, rows through one within a part.
    """
    sums = df.groupBy(group, part).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_g"), F.col(part).alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy(group, part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        df.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(sums, (F.col(group) == F.col("_g")) & (F.col(part) == F.col("_p")))
        .withColumn("start", F.col("_own") + F.col("_before"))
        .drop("_g", "_p", "_own", "_before")
    )


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of 0..size-1: a four-round Feistel network, walked until it falls inside."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(x):
        left, right = x >> half, x & mask
        for r in range(4):
            left, right = right, left ^ (mix64(right + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 % 2**64)) & mask)
        return left << half | right

    out = once(index.astype(np.uint64))
    while (outside := out >= size).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def draw(spark: SparkSession, blocks: list[int], expected: list[float], seed: int = SEED, slots: int = SHARD_SLOTS) -> DataFrame:
    """Return a row for each filled slot: shard, source_no, block, epoch.

    A shard's slots are dealt to sources by a stratified multinomial draw, seeded by the
    shard: each source has the whole part of what it expects, and the slots left are
    drawn by the fractions. Expectations are those of a plain draw, but a source of a few
    blocks stays near its target, which a plain draw misses by a tenth at a hundred
    blocks. A source's slots are numbered through all shards; slot j is block perm(j mod blocks) of epoch
    j div blocks, with a permutation for each source and epoch. Slots beyond the
    last epoch that a source may fill stay empty.
    """
    total = round(sum(expected))
    shards = -(-total // slots)
    schema = "shard long, part long, source_no int, n long"
    if not total:
        return spark.createDataFrame([], "shard long, source_no int, block long, epoch long")
    p = np.array(expected) / sum(expected)

    def counts(batches):
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                want = p * min(slots, total - shard * slots)
                n = np.floor(want).astype(np.int64)
                rest = round(want.sum()) - int(n.sum())
                if rest > 0:
                    part = want - n
                    n += np.random.default_rng([seed, shard]).multinomial(rest, part / part.sum())
                own = np.flatnonzero(n)
                yield pa.record_batch(
                    [pa.array(np.full(len(own), shard)), pa.array(np.full(len(own), shard // 4096)), pa.array(own.astype(np.int32)), pa.array(n[own])], ["shard", "part", "source_no", "n"]
                )

    dealt = spark.range(shards).mapInArrow(counts, schema)
    placed = running_start(dealt, "source_no", "part", ["shard"], "n")

    def slotted(batches):
        for batch in batches:
            for shard, no, n, start in zip(*(batch.column(c).to_pylist() for c in ("shard", "source_no", "n", "start")), strict=True):
                j = np.arange(start, min(start + n, MOST_USES * blocks[no]), dtype=np.int64)
                epoch = j // blocks[no]
                block = np.zeros(len(j), np.int64)
                for e in np.unique(epoch):
                    block[epoch == e] = permuted(j[epoch == e] % blocks[no], blocks[no], seed + no * MOST_USES + int(e))
                yield pa.record_batch([pa.array(np.full(len(j), shard)), pa.array(np.full(len(j), no, np.int32)), pa.array(block), pa.array(epoch)], ["shard", "source_no", "block", "epoch"])

    spread = placed.select("shard", "source_no", "n", "start").repartition(-(-shards // 64), "shard")  # 64 shards have half a million slots
    return spread.mapInArrow(slotted, "shard long, source_no int, block long, epoch long")


def _row_key():
    return F.xxhash64("text", "source")


def plan(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Return the sized rows of ``docs`` (doc_id, row_key, size, source_no, source_size, target, start) and the drawn slots.

    A row's size counts its words; a null text has none. Rows of a source are ordered
    by hashed id, id and hashed text; equal rows are interchangeable. A null source
    is a source of its own, last in order. One row a source comes to the driver: a
    mixture names its sources.
    """
    spark = docs.sparkSession
    rows = materialize(
        docs.select("doc_id", "source", _row_key().alias("row_key"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size")), "sizes"
    )
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    target = targets(sizes, weights)
    names = list(target) if sizes else []
    names.sort(key=lambda s: (s is None, s or ""))
    blocks = [-(-sizes[s] // block_words) for s in names]
    expected = [target[s] / sizes[s] * b if sizes[s] else 0.0 for s, b in zip(names, blocks, strict=True)]
    table = spark.createDataFrame([(s, i, sizes[s], target[s]) for i, s in enumerate(names)], "name string, source_no int, source_size long, target double")
    table = F.broadcast(table) if len(names) <= FEW_SOURCES else table.hint("merge")
    named = rows.join(table, F.col("source").eqNullSafe(F.col("name")))
    named = named.withColumn("part", F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(PARTS)))
    sized = running_start(named, "source_no", "part", ["doc_id", "row_key", "size"], "size")
    return sized.drop("name", "part"), draw(spark, blocks, expected)


def _spans(sized: DataFrame, block_words: int) -> DataFrame:
    """A row for each block that a document's words fall in: the words [first, last) of the document."""
    own = sized.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))))
    return own.withColumn("first", F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0))).withColumn(
        "last", F.least((F.col("block") + 1) * block_words - F.col("start"), F.col("size"))
    )


def mix_counts(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Return every row's doc_id, size, source_size, target and taken words (repeats counted).

    Empty and null texts have size and taken 0. An empty table gives an empty
    result; extra columns are ignored.
    """
    sized, slots = plan(docs, weights, block_words)
    sized = materialize(sized, "sized")
    # hints: a plan from spark.range looks small to the optimiser, which would broadcast it
    uses = slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"))
    taken = _spans(sized, block_words).join(uses.hint("merge"), ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum((F.col("last") - F.col("first")) * F.col("uses")).alias("taken"))
    # words that start at the same place as an empty row belong to another row
    key = F.when(F.col("size") > 0, F.col("start"))
    out = sized.withColumn("at", key).join(taken.withColumnRenamed("start", "at").hint("merge"), ["source_no", "at"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


_word = re.compile(WORD)


def _cut(text: str, spans: list[dict]) -> str:
    """The words of sorted spans, with the white space between neighbours."""
    at = [m.span() for m in _word.finditer(text)]
    if len(at) == sum(s["last"] - s["first"] for s in spans):
        return text
    parts, first, last = [], None, None
    for s in spans:
        if first is not None and s["first"] != last:
            parts.append(text[at[first][0] : at[last - 1][1]])
            first = None
        first, last = s["first"] if first is None else first, s["last"]
    return "\n".join([*parts, text[at[first][0] : at[last - 1][1]]])


@F.arrow_udf(T.StringType())
def _cut_texts(text: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([_cut(t, s) for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True)], pa.string())


def mixed_documents(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Return the mix as rows with the columns of ``docs``: a row for each document and epoch it is drawn in.

    The text of a row joins the drawn blocks' words, with the white space between
    neighbours kept; a document drawn whole keeps its text. ``n_chars``, if there,
    follows the text. Rows that share an id are told apart by text and source, repeated
    rows by a number, so each takes the blocks of its own words; documents that no block
    draws, null and empty ones among them, go. Texts of any length are cut. Columns of
    any names are kept; an empty table stays empty.
    """
    sized, slots = plan(docs, weights, block_words)
    sized = materialize(sized, "sized")
    key, mark, copy, spans = unused(docs.columns, "id", "key", "copy", "spans")
    same = [F.col("doc_id").alias(key), F.col("row_key").alias(mark)]
    repeated = not sized.where("size > 0").groupBy("doc_id", "row_key").count().where("count > 1").isEmpty()
    numbered = sized.withColumn("copy", F.row_number().over(W.partitionBy("doc_id", "row_key").orderBy("source_no", "start")) if repeated else F.lit(1))
    drawn = _spans(numbered, block_words).join(slots.select("source_no", "block", "epoch").hint("merge"), ["source_no", "block"])
    own = drawn.groupBy(*same, F.col("copy").alias(copy), "epoch").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias(spans)).drop("epoch")
    by = W.partitionBy("doc_id", _row_key()).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    kept = docs.withColumns({mark: _row_key(), copy: F.row_number().over(by) if repeated else F.lit(1)}).alias("kept")
    found = own.alias("own").hint("merge")
    equal = F.col("kept.doc_id").eqNullSafe(F.col(f"own.{key}")) & (F.col(f"kept.{mark}") == F.col(f"own.{mark}")) & (F.col(f"kept.{copy}") == F.col(f"own.{copy}"))
    joined = kept.join(found, equal).select(*[F.col(f"kept.`{c}`") for c in docs.columns], F.col(f"own.{spans}"))
    out = joined.withColumn("text", _cut_texts("text", F.col(spans)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; contract of op10."""
    return mix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
