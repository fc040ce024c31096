"""Substring dedup by repeated-phrase automata: recurring passages become Aho-Corasick patterns that every document is streamed through."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, drop_table, flat, materialize, words_of
from .windows import WINDOW_ROWS, recurring, run_rows, window_rows

#: Words of a window and of the k-gram that files it.
WINDOW, GRAM = 50, 25
#: Words of the patterns of one automaton, and of those that a block of documents may need: one automaton a block, as a rule.
PATTERN_WORDS, BLOCK_WORDS = 600_000, 400_000
_WORDS = re.compile(WORD)

KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _symbols(batch):
    values, offsets = flat(batch.column("words"), np.int64)
    values = values.view(np.uint64)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield values[a:b]


def passages(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirm recurring passages of ``docs``; rows with a null id take no part.

    Returns the rows (doc_id, key, anchor, kind) whose text may hold a passage, ``key``
    being the hash of id and text, and the passages (anchor, kind, phrases): of each
    class of runs its words, taken from one text that has them, with ``before``, the
    smallest id that has the class; and stretches of it whose windows start in even
    smaller ids, with theirs. Where texts hold a passage is not handed on.
    """
    hashed = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), F.transform(words_of(), lambda w: F.xxhash64(w)).alias("words")
    )
    rows = hashed.mapInArrow(run_rows(["doc_id", "key"], _symbols, WINDOW, GRAM), "doc_id long, key long, anchor long, kind long, pack long")
    live = recurring(rows, [(F.min("doc_id") < F.max("doc_id")).alias("live")])
    kinds = materialize(
        live.groupBy("anchor", "kind").agg(
            F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest"), F.first("several").alias("several"), F.min(F.struct("doc_id", "key", "pack")).alias("sample")
        ),
        "kinds",
    )
    # runs of the first document of their class: window by window, against the other classes of the anchor
    wanted = kinds.where("several").select("sample.*", "anchor", "kind").groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "kind", "pack")).alias("wanted"))
    near = hashed.join(wanted.hint("shuffle_hash"), ["doc_id", "key"]).select("words", "wanted")
    looked = materialize(near.mapInArrow(window_rows(_symbols, WINDOW), WINDOW_ROWS).distinct().join(kinds.select("anchor", "kind", "lowest"), ["anchor", "kind"]), "windows")
    least = looked.groupBy("anchor", "window").agg(F.min("lowest").alias("before"))
    partly = (
        looked.join(least, ["anchor", "window"]).where("before < lowest").groupBy("anchor", "kind")
        .agg(F.collect_set(F.struct("offset", "before")).alias("parts"))
    )
    settled = materialize(kinds.join(partly, ["anchor", "kind"], "left").where("lowest < highest or parts is not null").select("anchor", "kind", "lowest", "highest", "sample", "parts"), "settled")
    asked = settled.select("sample.*", F.struct("anchor", "kind", F.col("sample.pack").alias("pack"), "lowest", (F.col("lowest") < F.col("highest")).alias("again"), "parts").alias("own"))
    asked = asked.groupBy("doc_id", "key").agg(F.collect_list("own").alias("wanted"))
    whole = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text")
    texts = whole.join(asked.hint("shuffle_hash"), ["doc_id", "key"]).select("text", "wanted").mapInArrow(_phrases_of, _PHRASES).dropDuplicates(["anchor", "kind"])
    may = live.join(settled.select("anchor", "kind", "lowest", F.col("parts").isNotNull().alias("partly")), ["anchor", "kind"]).where("doc_id > lowest or partly")
    may = materialize(may.select("doc_id", "key", "anchor", "kind"), "may")
    for table in (live, kinds, looked):
        drop_table(table)
    return may, texts


_PHRASES = "anchor long, kind long, phrases array<struct<words:string,before:long>>"


def _phrases_of(batches):
    kind = pa.list_(pa.struct([("words", pa.string()), ("before", pa.int64())]))
    for batch in batches:
        anchors, kinds, phrases = [], [], []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            words = _WORDS.findall(text)
            for w in wanted:
                first, more = w["pack"] >> 16, w["pack"] >> 8 & 255
                own = [(0, more + WINDOW, w["lowest"])] if w["again"] else []
                own += merged([{"first": p["offset"], "last": p["offset"] + WINDOW, "before": p["before"]} for p in w["parts"] or ()])
                anchors.append(w["anchor"])
                kinds.append(w["kind"])
                phrases.append([{"words": " ".join(words[first + a : first + b]), "before": c} for a, b, c in own])
        yield pa.record_batch([pa.array(anchors, pa.int64()), pa.array(kinds, pa.int64()), pa.array(phrases, kind)], ["anchor", "kind", "phrases"])


def merged(spans: list[dict]) -> list[tuple[int, int, int]]:
    """Spans whose windows follow one another without a gap join; the latest of their first documents stands for all."""
    out: list[list[int]] = []
    for first, last, before in sorted((s["first"], s["last"], s["before"]) for s in spans):
        # windows [x, x + WINDOW) up to the last start of the one before and on from the next start
        if out and first - 1 <= out[-1][1] - WINDOW:
            out[-1][1], out[-1][2] = max(out[-1][1], last), max(out[-1][2], before)
        else:
            out.append([first, last, before])
    return [tuple(x) for x in out]


class Automaton:
    """Phrases (tuples of word numbers) with the id after which they are repeats."""

    def __init__(self):
        import ahocorasick

        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.before: dict[tuple[int, ...], int] = {}

    def add(self, phrase: tuple[int, ...], before: int) -> None:
        self.before[phrase] = min(before, self.before.get(phrase, before))

    def compile(self) -> None:
        for phrase, before in self.before.items():
            self.trie.add_word(phrase, (len(phrase), before))
        self.trie.make_automaton()

    def covered(self, words: tuple[int, ...], doc_id: int) -> np.ndarray:
        """Which words the repeats cover that are found by streaming ``words`` through the automaton."""
        marks = np.zeros(len(words) + 1, np.int64)
        if self.before and len(words) >= WINDOW:
            for end, (n, before) in self.trie.iter(words):
                if before < doc_id:
                    marks[end + 1 - n] += 1
                    marks[end + 1] -= 1
        return np.cumsum(marks[:-1]) > 0


class Block:
    """The automata of a block of documents, and the numbers of their words."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.automata: list[Automaton] = []
        self.size = PATTERN_WORDS
        self.ready = False

    def add(self, phrase: str, before: int) -> None:
        words = phrase.split(" ")
        if self.size + len(words) > PATTERN_WORDS:
            self.automata.append(Automaton())
            self.size = 0
        self.automata[-1].add(tuple([self.number.setdefault(w, len(self.number) + 1) for w in words]), before)
        self.size += len(words)

    def kept(self, doc_id: int | None, text: str) -> tuple:
        """Stream a text through all automata; return its row of KEPT."""
        if not self.ready:
            for own in self.automata:
                own.compile()
            self.ready = True
        words = _WORDS.findall(text)
        n = 0
        if self.automata and doc_id is not None:
            numbers = tuple([self.number.get(w, 0) for w in words])
            gone = np.zeros(len(words), bool)
            for own in self.automata:
                gone |= own.covered(numbers, doc_id)
            if n := int(gone.sum()):
                return doc_id, len(words), n, hashlib.sha256(" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).encode()).hexdigest()
        return doc_id, len(words), n, hashlib.sha256(" ".join(words).encode()).hexdigest()


def _streamed(batches):
    """Over rows sorted by block, phrases first: compile the phrases of a block and stream its documents."""
    at, block = None, Block()
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        rows = []
        for number, doc_id, text, phrases in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_id", "text", "phrases")), strict=True):
            if number != at:
                at, block = number, Block()
            if phrases is None:
                rows.append(block.kept(doc_id, text))
            else:
                for p in phrases:
                    block.add(p["words"], p["before"])
        if rows:
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in KEPT.split(", ")])


def dedup_phrases(docs: DataFrame) -> DataFrame:
    """Remove from each text of ``docs`` (doc_id, text) the words of windows that also start in a document with a smaller id (KEPT).

    Documents are dealt to blocks. Each passage goes to the blocks of which a document
    files a run under it, the block's passages are compiled to automata, and all of its
    documents are streamed through them; places come from the hits, word by word.

    Null texts have no words; rows with a null id keep all words and take none from
    others; rows that share an id take nothing from each other. Texts of fewer than
    WINDOW words stay whole, and texts of any length are streamed whole. Repeated rows
    are kept. An empty table gives an empty result; other columns are ignored.
    """
    may, passage = passages(docs)
    # a run's class has some 65 words, so this bounds the patterns of a block
    blocks = max(1, -(-may.count() * 65 // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block")
    none = F.lit(None)
    needed = may.select(block, "anchor", "kind").distinct().join(passage, ["anchor", "kind"])
    patterns = needed.select("block", none.cast("long").alias("doc_id"), none.cast("string").alias("text"), "phrases")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("key"))
    streams = whole.select(block, "doc_id", "text", none.cast(passage.schema["phrases"].dataType).alias("phrases"))
    both = patterns.union(streams).repartition("block").sortWithinPartitions("block", F.col("phrases").isNull())
    return both.mapInArrow(_streamed, KEPT)


def op8_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat earlier documents; contract of op8."""
    return dedup_phrases(documents(spark, sf_dir))


#: The same by joining every window; whole tables of some thousand documents are no trouble.
ORACLE_SQL = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
 s AS (SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM d)),
 f AS (SELECT k, min(doc_id) AS first FROM s GROUP BY k),
 g AS (SELECT DISTINCT doc_id, i + o AS p FROM s JOIN f USING (k), generate_series(0, {WINDOW - 1}) t(o) WHERE first < doc_id),
 x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
 r AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
 SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"""
