"""Packing by the sum-of-squares rule: token pieces of documents into sequences of fixed length."""

from __future__ import annotations

import json
import os
import string
import unicodedata
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import trim

#: Tokens of a full sequence, and the id that ends every document.
CAPACITY, END_ID = 4096, 2
#: Words whose ids a worker remembers; the memory is emptied beyond this many.
REMEMBERED = 1_000_000
#: Characters of documents tokenised together.
CHUNK_CHARS = 1 << 22
_MARK = "\x01"
#: Marks that a run of, after letters, is a piece of its own; an apostrophe may begin a contraction.
_ENDINGS = string.punctuation.replace("'", "")
_tokenizers: dict[str, WordTokenizer] = {}

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _folded(text: str) -> str:
    """Lower case where the tokenizer's own folding gives the same: Latin-1 text without special tokens."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


def _plain(word: str) -> bool:
    """Lower-case letters of Latin-1: one piece, which the tokenizer's folding leaves as it is."""
    return word.isalpha() and word.islower() and (word.isascii() or max(word) <= "\xff")


def _letters(word: str) -> bool:
    """Letters that stay letters when the tokenizer folds them: some give a mark of their own, which joins marks that follow."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n - len(a), len(a) // 2), a.dtype)])


class WordTokenizer:
    """A tokenizer that never joins across white space, with the ids of words remembered.

    Words between ASCII white space are encoded once each; a text's ids are those of its
    words in order, equal to encoding the whole text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.mark = self._encode(_MARK)
        # for plain words, of which folding and patterns would take half the time; it shares the vocabulary
        self.letters = Tokenizer(self.model.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        with open(path, encoding="utf-8") as file:
            suffix = json.load(file)["model"].get("end_of_word_suffix")
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self._empty()

    def _empty(self) -> None:
        self.place: dict[str, int] = {}
        self.used = 0
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        order, parts, lengths, others = [], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], []
        plain = [w for w in words if _plain(w) or others.append(w)]
        joined = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for own, got in zip(joined, self.letters.encode_batch_fast([" ".join(x) for x in joined], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) != len(own):  # a vocabulary that does not mark the ends of words
                others += own
                continue
            order += own
            lengths.append(np.diff(ends, prepend=-1))
            parts.append(ids)
        apart = [w for w in others if _MARK not in w]
        joined = [apart[i : i + 500] for i in range(0, len(apart), 500)] if len(self.mark) == 1 else []
        for own, got in zip(joined, self.model.encode_batch_fast([f" {_MARK} ".join(x) for x in joined], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.uint32)
            ends = np.flatnonzero(ids == self.mark[0])
            if len(ends) != len(own) - 1:  # a word that yields the mark itself
                continue
            bounds = np.concatenate(([-1], ends, [len(ids)]))
            order += own
            lengths.append(np.diff(bounds) - 1)
            parts.append(np.delete(ids, ends))
        for word in sorted(set(words).difference(order)):
            ids = self._encode(word)
            order.append(word)
            lengths.append(np.array([len(ids)]))
            parts.append(np.array(ids, np.uint32))
        self._add(order, np.concatenate(lengths).astype(np.int64), np.concatenate(parts))

    def _add(self, words: list[str], length: np.ndarray, ids: np.ndarray) -> None:
        known, used = len(self.place), self.used
        self.place.update(zip(words, range(known, known + len(words)), strict=True))
        self.length, self.start = _grown(self.length, known + len(words)), _grown(self.start, known + len(words))
        self.flat = _grown(self.flat, used + len(ids))
        self.length[known : known + len(words)] = length
        self.start[known : known + len(words)] = np.cumsum(length) - length + used
        self.flat[used : used + len(ids)] = ids
        self.used += len(ids)

    def _learn_all(self, words: set[str]) -> None:
        """Words of letters before a run of marks are made of the two, which are pieces apart."""
        ended, cores, marks = [], [], []
        for word in words:
            core = word.rstrip(_ENDINGS)
            if len(core) < len(word) and _letters(core):
                ended.append(word)
                cores.append(core)
                marks.append(word[len(core) :])
        if new := list(words.difference(ended).union(cores, marks).difference(self.place)):
            self._learn(new)
        if ended:
            pair = np.fromiter((self.place[x] for both in zip(cores, marks, strict=True) for x in both), np.int64, 2 * len(ended))
            ids, ends = self._gather(pair)
            self._add(ended, np.diff(ends[1::2], prepend=0), ids)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = self.length[at]
        ends = np.cumsum(length)
        return self.flat[np.repeat(self.start[at] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)], ends

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > REMEMBERED:
            self._empty()
        split = pc.ascii_split_whitespace(pa.array([_folded(t) for t in texts], pa.string()))
        coded = split.flatten().dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        at = np.fromiter(map(self.place.get, kinds, repeat(-1)), np.int64, len(kinds))
        if len(unknown := np.flatnonzero(at < 0)):
            new = [kinds[i] for i in unknown.tolist()]
            self._learn_all(set(new))
            at[unknown] = np.fromiter(map(self.place.__getitem__, new), np.int64, len(new))
        ids, ends = self._gather(at[coded.indices.to_numpy()])
        ends = np.concatenate(([0], ends))[split.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Packer:
    """Online packing: a document goes to the fill level that makes the sum of squared level counts least.

    ``count[h]`` is the number of open windows filled to h. Pieces of open windows
    are held; a full window's pieces are handed on.
    """

    def __init__(self, capacity: int = CAPACITY, first_sequence: int = 0):
        self.capacity, self.next = capacity, first_sequence
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        """Cut off full sequences; place what remains by the rule."""
        total, at = len(ids), 0
        while total - at >= self.capacity:
            self._close([(doc_id, at, ids[at : at + self.capacity], total)])
            at += self.capacity
        if at < total:
            self._place((doc_id, at, ids[at:], total))

    def _place(self, piece: tuple) -> None:
        n, c = len(piece[2]), self.count
        levels = np.flatnonzero(c[1 : self.capacity - n + 1]) + 1
        best, level = 2 * c[n] + 1, 0
        if len(levels):
            change = np.where(levels + n == self.capacity, 1 - 2 * c[levels], 2 * (c[levels + n] - c[levels]) + 2)
            i = len(levels) - 1 - int(np.argmin(change[::-1]))
            if change[i] <= best:
                level = int(levels[i])
        window = []
        if level:
            window = self.open[level].pop()
            c[level] -= 1
        window.append(piece)
        if level + n == self.capacity:
            self._close(window)
        else:
            c[level + n] += 1
            self.open.setdefault(level + n, []).append(window)

    def _close(self, window: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in window:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        """Fill the fullest open windows with pieces cut from the emptiest; cut the last rest at powers of two."""
        windows = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.open, self.count[:] = {}, 0
        low = len(windows) - 1
        for i in range(len(windows)):
            if i > low:
                break
            room = self.capacity - sum(len(p[2]) for p in windows[i])
            while room and low > i:
                doc_id, start, ids, total = windows[low].pop()
                cut = max(0, len(ids) - room)
                windows[i].append((doc_id, start + cut, ids[cut:], total))
                room -= len(ids) - cut
                if cut:
                    windows[low].append((doc_id, start, ids[:cut], total))
                elif not windows[low]:
                    low -= 1
            if not room:
                self._close(windows[i])
                continue
            last = windows[i]
            while last:
                left = sum(len(p[2]) for p in last)
                size, window = 1 << (left.bit_length() - 1), []
                while size:
                    doc_id, start, ids, total = last.pop(0)
                    window.append((doc_id, start, ids[:size], total))
                    if len(ids) > size:
                        last.insert(0, (doc_id, start + size, ids[size:], total))
                    size -= min(size, len(ids))
                self._close(window)

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences; return a row for each piece (PIECES).

    Every partition packs its own rows online and holds open windows only; sequence
    ids start at the partition's number times 2**33, so nothing is shuffled and a
    repeated task gives the same rows. All sequences are full, but for at most
    log2(capacity) of each partition, whose lengths are powers of two. Null and empty
    texts are documents of the end id alone. Rows with equal or null ids are packed
    like any other. An empty table gives an empty result; other columns are ignored.
    ``tokenizer_path`` must exist on every executor.
    """

    def packed(batches):
        tokenizer = _tokenizers.get(tokenizer_path) or _tokenizers.setdefault(tokenizer_path, WordTokenizer(tokenizer_path))
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            a = 0
            while a < len(ids):
                b, chars = a, 0
                while b < len(ids) and (b == a or chars + len(texts[b]) <= CHUNK_CHARS):
                    chars += len(texts[b])
                    b += 1
                for doc_id, own in zip(ids[a:b], tokenizer.encode(texts[a:b]), strict=True):
                    packer.add(doc_id, np.append(own, np.uint32(END_ID)))
                a = b
                yield from _rows(packer.take())
        packer.finish()
        yield from _rows(packer.take())
        trim()

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(packed, PIECES)


def _rows(pieces: list[tuple]):
    names = [x.split()[0] for x in PIECES.split(", ")]
    if pieces:
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*pieces, strict=True)], names)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens; contract of op3."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
