"""Sets at Jaccard similarity of LEAST or more, linked whole: candidates share a band key and are compared in cells of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, trim
from .components import components

#: Least similarity of linked sets, as a fraction, so that it is compared without rounding.
LEAST = 4, 5
#: Characters of one block of a cell; a cell has two blocks, and a longer single text is a block of its own.
CELL = 1 << 22
#: Characters whose tokens are held at a time, candidate pairs listed at a time, and band keys sorted at a time.
PORTION, PAIRS, SORTED = 1 << 21, 1 << 20, 1 << 21
#: Leading rows of a cell up to which each is compared with all others at once.
FEW = 6
#: Hashes of a set of which minima are taken at a time, so that work stays in the processor's cache.
SLICE = 1 << 15


def minima(hashes: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """Sets x ``count`` minima of 16 bits, each of an own order of the 32-bit hashes; a set without any has zeros.

    Least and greatest of a hash are first in two orders, which are used half of the
    minima apart, so that no band has both.
    """
    n = np.diff(offsets)
    half = (count + 1) // 2
    least = np.zeros((count, len(n)), np.uint32)
    step = mix64(np.arange(1000, 1000 + count, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    flip = mix64(np.arange(1, 1 + count, dtype=np.uint64)).astype(np.uint32)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
        own = np.flatnonzero(n[a:b]) + a
        if len(own):
            x, start = hashes[offsets[a] : offsets[b]], offsets[own] - offsets[a]
            each, found = np.empty_like(x), np.empty((count, len(own)), np.uint32)
            for k in range(half):
                np.bitwise_xor(x, flip[k], out=each)
                np.multiply(each, step[k], out=each)
                np.minimum.reduceat(each, start, out=found[k])
                if k + half < count:
                    np.maximum.reduceat(each, start, out=found[k + half])
            np.invert(found[half:], out=found[half:])
            least[:, own] = found
        a = b
    # low bits too: those above are small in any large set
    return np.ascontiguousarray((least ^ least >> np.uint32(15)).astype(np.uint16).T)


def band_keys(sign: np.ndarray, bands: int) -> np.ndarray:
    """Sets x ``bands`` keys: each scrambles the minima of its rows with the band's number."""
    rows = sign.shape[1] // bands
    key = np.zeros((len(sign), bands), np.uint64)
    for r in range(rows):
        key = key << np.uint64(16) | sign[:, r::rows].astype(np.uint64)
    return mix64(mix64(key) ^ mix64(np.arange(1, bands + 1, dtype=np.uint64)))


def _led(keys: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys and lines in order of keys, the place of each key's first line, and the leader of each: that line."""
    order = np.argsort(keys, kind="stable")
    keys, lines = keys[order], lines[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys, lines, first, np.repeat(lines[first], np.diff(np.append(first, len(keys))))


_LINKS = "bucket int, packed binary, key long, line long, leader long"


def _link_batch(keys: np.ndarray, lines: np.ndarray, leaders: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(bucket.astype(np.int32)), pa.nulls(len(keys), pa.binary()), *[pa.array(x.view(np.int64)) for x in (keys, lines, leaders)]]
    return pa.record_batch(columns, ["bucket", "packed", "key", "line", "leader"])


def _packed(buckets: int, keyed=None):
    """Over rows (line, bands): links to the first line of a key within the partition, and those first lines with their keys, packed by bucket of keys.

    ``keyed`` makes such rows of others first, in the same worker: a second Python step
    in a task would keep a second worker on every core for the rest of the session.
    """

    def flushed(keys: list, lines: list):
        keys, lines, first, leader = _led(np.concatenate(keys), np.concatenate(lines))
        own = np.flatnonzero(lines != leader)
        # links lie anywhere, so that a common key fills no partition
        yield _link_batch(keys[own], lines[own], leader[own], (lines[own] >> np.uint64(33)) % np.uint64(buckets))
        keys, lines = keys[first], lines[first]
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        ends = np.searchsorted(bucket, np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(ends))
        blobs = [keys[a:b].tobytes() + lines[a:b].tobytes() for a, b in zip(ends[used].tolist(), ends[used + 1].tolist(), strict=True)]
        none = pa.nulls(len(used), pa.int64())
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(blobs, pa.binary()), none, none, none], ["bucket", "packed", "key", "line", "leader"])

    def mapped(batches):
        keys, lines, n = [], [], 0
        for batch in keyed(batches) if keyed else batches:
            own = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.uint64)
            keys.append(own)
            lines.append(np.repeat(batch.column("line").to_numpy().view(np.uint64), pc.binary_length(batch.column("bands")).to_numpy() // 8))
            n += len(own)
            if n >= SORTED:
                yield from flushed(keys, lines)
                keys, lines, n = [], [], 0
        if n:
            yield from flushed(keys, lines)
        keys = lines = None
        trim()

    return mapped


def _starred(batches):
    """Over rows sorted by bucket: links pass, and of the lines that stand for a key all are linked to the first."""

    def star(blobs: list[bytes]):
        both = [np.frombuffer(b, np.uint64).reshape(2, -1) for b in blobs]
        keys, lines, _, leader = _led(np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both]))
        own = np.flatnonzero(lines != leader)
        return _link_batch(keys[own], lines[own], leader[own], np.zeros(len(own)))

    at, held = None, []
    for batch in batches:
        batch = pa.record_batch([batch.column(c) for c in ("bucket", "packed", "key", "line", "leader")], ["bucket", "packed", "key", "line", "leader"])
        links = batch.filter(batch.column("key").is_valid())
        yield links.select(["key", "line", "leader"])
        packed = batch.filter(batch.column("packed").is_valid())
        for bucket, blob in zip(packed.column("bucket").to_pylist(), packed.column("packed").to_pylist(), strict=True):
            if bucket != at and held:
                yield star(held).select(["key", "line", "leader"])
                held = []
            at = bucket
            held.append(blob)
    if held:
        yield star(held).select(["key", "line", "leader"])


def candidates(banded: DataFrame, keyed=None) -> DataFrame:
    """From (line, bands), bands being packed 64-bit keys, or rows that ``keyed`` makes such: (key, line, leader), each line of a key linked to one of them.

    A line that is the first of its key in its partition stands for it in the exchange;
    the others are linked to it at once, so a common key sends one line a partition.
    Keys travel packed, as a row apiece would cost more than the work on it.
    """
    buckets = int(banded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = banded.mapInArrow(_packed(buckets, keyed), _LINKS).repartition(F.col("bucket")).sortWithinPartitions("bucket")
    return materialize(dealt.mapInArrow(_starred, "key long, line long, leader long"), "pairs")


def sorted_sets(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's hashes in order, without repeats."""
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        flat[a:b].sort()
    fresh = np.ones(len(flat), bool)
    fresh[1:] = flat[1:] != flat[:-1]
    fresh[offsets[:-1][np.diff(offsets) > 0]] = True
    return flat[fresh], np.concatenate(([0], np.cumsum(fresh)))[offsets]


def _alike(common, a, b):
    return LEAST[1] * common >= LEAST[0] * (a + b - common)


def _star_links(flat, offsets, part, lead: int, met):
    """Links of one set with all others of a cell."""
    n, own = np.diff(offsets), flat[offsets[lead] : offsets[lead + 1]]
    if not len(own):  # the empty set is like no other kind
        return []
    ends = np.where(np.arange(len(offsets)) > lead, offsets - len(own), offsets)
    rest = np.concatenate((flat[: offsets[lead]], flat[offsets[lead + 1] :]))
    hit = own.take(np.searchsorted(own, rest), mode="clip") == rest
    common = np.diff(np.concatenate(([0], np.cumsum(hit)))[ends])
    found = np.flatnonzero(_alike(common, n, n[lead]) & met & (part != part[lead]))
    return [(int(part[lead]), int(r)) for r in np.unique(part[found])]


def _listed(owner: np.ndarray, starts: np.ndarray, sizes: np.ndarray, leads: np.ndarray):
    """Pairs (leading row, row) of rows that share a token, PAIRS at a time, rare tokens first."""
    group = np.repeat(np.arange(len(starts)), sizes)
    own = np.flatnonzero(leads[owner])
    own = own[np.argsort(sizes[group[own]], kind="stable")]
    total = np.cumsum(sizes[group[own]])
    a = 0
    while a < len(own):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
        n = sizes[group[own[a:b]]]
        other = np.repeat(starts[group[own[a:b]]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        yield np.repeat(owner[own[a:b]], n), owner[other]
        a = b


def _forest(flat, offsets, part, leads, met):
    """Links that join the same parts as all pairs of a leading and a met row of a cell at LEAST or more would.

    With tokens in any one order, rarest first here, two sets at LEAST or more share one
    among the first n - ceil(LEAST n) + 1 of each: a lossless filter, which spares the
    pairs of a family that have in common what all of the family has.
    """
    n = np.diff(offsets)
    # of numbers for each token few are held at a time, as a cell has millions
    order = np.argsort(flat)
    fresh = flat[order]
    fresh = np.concatenate((np.ones(min(len(flat), 1), bool), fresh[1:] != fresh[:-1]))
    uses = np.diff(np.append(np.flatnonzero(fresh), len(flat)))
    rare = np.argsort(uses, kind="stable")
    uses, rank = uses[rare], np.empty(len(uses), np.int32)
    rank[rare] = np.arange(len(uses))
    code = np.cumsum(fresh, dtype=np.int32)
    code -= 1
    token = np.empty(len(flat), np.int32)
    token[order] = rank[code]
    del order, fresh, code, rank, rare
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        token[a:b].sort()
    prefix = n - -(-n * LEAST[0] // LEAST[1]) + 1
    prefix = np.minimum(prefix, n)  # the empty set has none
    kept = np.repeat(np.tile([True, False], len(n)), np.stack((prefix, n - prefix), 1).ravel())
    kept &= token >= np.searchsorted(uses, 2)
    shared, owner = token[kept], np.repeat(np.arange(len(n), dtype=np.int32), n)[kept].astype(np.int64)
    del kept
    by = np.argsort(shared, kind="stable")
    shared, owner = shared[by], owner[by]
    starts = np.flatnonzero(np.concatenate((np.ones(min(len(shared), 1), bool), shared[1:] != shared[:-1])))
    sizes = np.diff(np.append(starts, len(shared)))
    label, out = np.unique(part, return_inverse=True)[1], []
    marks = np.zeros(len(uses), bool)
    both = leads & met
    for u, r in _listed(owner, starts, sizes, leads):
        small, large = np.minimum(n[u], n[r]), np.maximum(n[u], n[r])
        fit = met[r] & (label[u] != label[r]) & (LEAST[1] * small >= LEAST[0] * large) & ~(both[u] & both[r] & (u > r))
        pair = np.unique(u[fit] * len(n) + r[fit])
        if not len(pair):
            continue
        u, r = pair // len(n), pair % len(n)
        cut = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1]))).tolist()
        for a, b in zip(cut, [*cut[1:], len(u)], strict=True):
            lead, others = int(u[a]), r[a:b]
            others = others[label[others] != label[lead]]
            if not len(others):
                continue
            mine = token[offsets[lead] : offsets[lead + 1]]
            marks[mine] = True
            each = n[others]
            at = np.repeat(offsets[others] - np.cumsum(each) + each, each) + np.arange(each.sum())
            common = np.add.reduceat(marks[token[at]].astype(np.int64), np.cumsum(each) - each)
            marks[mine] = False
            for x in others[_alike(common, each, n[lead])].tolist():
                if label[x] != label[lead]:
                    label[label == label[x]] = label[lead]
                    out.append((int(part[lead]), int(part[x])))
    return out


def _cell_links(sets):
    """Over rows sorted by cell: links between parts, whole cells at a time. ``sets`` gives the sets of texts, as :func:`sorted_sets`."""

    def links(rows: pa.RecordBatch, starts: np.ndarray):
        part, leads, met = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("part", "leads", "met"))
        texts = rows.column("normal")
        ends = np.append(starts[1:], rows.num_rows)
        size = np.concatenate(([0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)))
        a, out = 0, []
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(size[ends], size[starts[a]] + PORTION, "right")))
            low, high = int(starts[a]), int(ends[b - 1])
            flat, offsets = sets(texts.slice(low, high - low).to_pylist())
            for c in range(a, b):
                x, y = int(starts[c]) - low, int(ends[c]) - low
                own = flat[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], part[x + low : y + low]
                mine = leads[x + low : y + low]
                lead = np.flatnonzero(mine)
                if len(lead) <= FEW:  # cheaper than to sort all tokens
                    for k in lead.tolist():
                        out += _star_links(*own, k, met[x + low : y + low])
                else:
                    out += _forest(*own, mine, met[x + low : y + low])
            a = b
        x, y = zip(*out, strict=True) if out else ((), ())
        return pa.record_batch([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    def mapped(batches):
        rest = None
        for batch in batches:
            rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if not rows.num_rows:
                continue
            cell = [rows.column(c).to_numpy() for c in ("key", "i", "j")]
            fresh = np.ones(rows.num_rows, bool)
            fresh[1:] = np.any([c[1:] != c[:-1] for c in cell], axis=0)
            starts = np.flatnonzero(fresh)
            if len(starts) > 1:
                yield links(rows.slice(0, int(starts[-1])), starts[:-1])
            rest = rows.slice(int(starts[-1]))
        if rest is not None and rest.num_rows:
            yield links(rest, np.zeros(1, np.int64))
        trim()

    return mapped


def _linked(cells: DataFrame, texts: DataFrame, sets) -> DataFrame:
    """Links (a, b) between parts, of cells (key, i, j, line, part, leads, met)."""
    rows = cells.join(texts, "line").select("key", "i", "j", "part", "leads", "met", "normal")
    return materialize(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_cell_links(sets), "a long, b long"), "alike")


def _blocks(chars) -> F.Column:
    return F.greatest(F.ceil(chars / CELL), F.lit(1)).cast("int")


def _block_of(line: str, blocks: str):
    return F.pmod(F.xxhash64(line), F.col(blocks)).cast("int")


def _star_cells(pending: DataFrame, sized: DataFrame) -> DataFrame:
    """Cells of each leader with its lines, in as many as their characters ask for."""
    pairs = pending.select("line", "leader").distinct().join(sized, "line")
    blocks = pairs.groupBy("leader").agg(_blocks(F.sum("chars")).alias("blocks"))
    no, yes, zero = F.lit(False), F.lit(True), F.lit(0)
    lines = pairs.join(blocks, "leader").select(F.col("leader").alias("key"), zero.alias("i"), _block_of("line", "blocks").alias("j"), "line", F.col("line").alias("part"), no.alias("leads"), yes.alias("met"))
    line = F.col("leader").alias("line")
    return lines.union(blocks.select(F.col("leader").alias("key"), zero.alias("i"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("j"), line, line.alias("part"), yes.alias("leads"), no.alias("met")))


def _members(pending: DataFrame) -> DataFrame:
    """(key, line) of the lines that have another of their key left to be compared with.

    All pairs (line, leader) were compared, and those of a key connect its lines. Where
    all lines but one were compared with one other only, that other is the one line, and
    it was compared with all of them; of two lines of a key neither is left.
    """
    both = pending.select("key", "line", F.col("leader").alias("other")).union(pending.select("key", F.col("leader").alias("line"), F.col("line").alias("other")))
    met = materialize(both.groupBy("key", "line").agg((F.min("other") != F.max("other")).alias("several")), "members")
    left = met.groupBy("key").agg(F.count("*").alias("lines"), F.count_if("several").alias("centres")).where("lines > 2")
    return met.join(left, "key").where("not several or centres > 1").select("key", "line")


def _open_cells(members: DataFrame, part: DataFrame, sized: DataFrame) -> DataFrame:
    """Cells of the keys whose lines are in several parts: lines outside the largest part lead, all are met.

    Leading lines are dealt to blocks i and all lines to blocks j, by hash and as many as
    their characters ask for, and each (i, j) is a cell; so a large group has many
    tasks, none of which holds more than two blocks.
    """
    placed = members.join(part, "line", "left").select("key", "line", F.coalesce("part", "line").alias("part"))
    mixed = placed.groupBy("key").agg((F.min("part") != F.max("part")).alias("mixed")).where("mixed").select("key")
    open_ = materialize(placed.join(mixed, "key", "left_semi").join(sized, "line"), "open")
    sums = open_.groupBy("key", "part").agg(F.sum("chars").alias("chars"))
    sums = sums.groupBy("key").agg(F.max(F.struct("chars", "part")).alias("most"), F.sum("chars").alias("chars"))
    grid = sums.select("key", F.col("most.part").alias("most"), _blocks(F.col("chars") - F.col("most.chars")).alias("down"), _blocks(F.col("chars")).alias("across"))
    row = open_.join(grid, "key").withColumns({"i": _block_of("line", "down"), "j": _block_of("line", "across"), "leads": F.col("part") != F.col("most")})
    cell = lambda i, j, leads, met: F.struct(i.alias("i"), j.alias("j"), leads.alias("leads"), met.alias("met"))
    led = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda j: cell(F.col("i"), j, F.lit(True), j == F.col("j")))
    met = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda i: cell(i, F.col("j"), F.lit(False), F.lit(True)))
    apart = F.filter(met, lambda c: c["i"] != F.col("i"))
    return row.select("key", "line", "part", F.inline(F.when(F.col("leads"), F.concat(led, apart)).otherwise(met)).alias("i", "j", "leads", "met")).select("key", "i", "j", "line", "part", "leads", "met")


def similar(banded: DataFrame, texts_of, sets, keyed=None) -> DataFrame:
    """Components (id, component) of the lines of ``banded`` (line, bands) that share a band key and are alike by their exact sets.

    ``keyed`` turns batches of other rows into (line, bands), if ``banded`` has others.

    ``texts_of`` takes lines (line) and gives their texts (line, normal), from which
    ``sets`` makes sorted sets of hashes. Lines of a key are compared with one of them
    first, and components follow. Then, in keys whose lines still lie in several, every
    pair across components that was not compared yet is settled, in cells of bounded
    size: none is given up, and only links are handed on, never the pairs compared.
    """
    pending = candidates(banded, keyed)
    texts = materialize(texts_of(pending.select("line").union(pending.select("leader")).distinct()), "texts")
    sized = texts.select("line", F.length("normal").alias("chars"))
    part = components(_linked(_star_cells(pending, sized), texts, sets)).select(F.col("id").alias("line"), F.col("component").alias("part"))
    part = materialize(part, "parts")
    merged = components(_linked(_open_cells(_members(pending), part, sized), texts, sets))
    known = part.union(merged.select(F.col("id").alias("line"), F.col("id").alias("part")).join(part, "line", "left_anti"))
    named = known.join(merged.withColumnRenamed("id", "part"), "part", "left")
    return materialize(named.select(F.col("line").alias("id"), F.coalesce("component", "part").alias("component")), "found")
