"""The pipeline's near copies meet by SimHash anchors, besides MinHash bands."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import alike as A
from tidemark.llm import copies as C
from tidemark.llm import simhash as H


def test_near_copies_meet_by_anchors(spark):
    """Sets within two bits share the key of an anchor, others none, and bands keep their keys."""
    r = random.Random(3)
    long = [" ".join(f"w{r.randrange(10**6)}" for _ in range(3000)) for _ in range(12)]
    texts = [*long, *[x.replace(" ", " changed ", 1) for x in long], "", "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    hashed = df.select("doc_id", F.xxhash64("text").alias("print"), H.words_of_lower().alias("_words")).select("doc_id", "print", H.shingle_hashes(C.SHINGLE_WORDS).alias("_hashes"))
    rows = hashed.mapInArrow(C._sketched, "doc_id long, print long, line long, bands binary, fp long").orderBy("doc_id").collect()
    fp = np.array([x["fp"] for x in rows], np.int64)
    batch = pa.record_batch({"line": pa.array([x["line"] for x in rows], pa.int64()), "bands": pa.array([bytes(x["bands"]) for x in rows], pa.binary()), "fp": pa.array(fp)})
    keys = [np.frombuffer(b, np.uint64) for out in C.anchored([batch]) for b in out.column("bands").to_pylist()]
    assert all(k[: C.BANDS].tobytes() == bytes(x["bands"]) for k, x in zip(keys, rows, strict=True))
    near = 0
    for i in range(len(rows)):
        for j in range(i):
            bits = int(np.bitwise_count(fp[i].view(np.uint64) ^ fp[j].view(np.uint64)))
            shared = len(np.intersect1d(keys[i][C.BANDS :], keys[j][C.BANDS :]))
            near += bits <= 2
            assert shared if bits <= 2 else bits <= 4 or not shared
    assert near >= 8
    stays = {x["doc_id"] for x in C.near_copies(df).where("stays").collect()}
    assert stays == {*range(12), 24, 25}


def test_keys_take_one_worker(spark, monkeypatch):
    """Anchors and bands are keyed and packed by one Python step: two in a task keep two workers on each core."""
    plans = []
    keep = A.materialize

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, name)

    monkeypatch.setattr(A, "materialize", seen)
    texts = ["a b c d e f", "a b c d e f", "g h i j k l m", "", None]
    rows = C.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [x["component_id"] for x in rows] == [0, 0, 2, 3, 3]
    (plan,) = [p for name, p in plans if name == "pairs"]
    assert "MapInArrow" in plan and all(part.count("MapInArrow") <= 1 for part in plan.split("Exchange"))


def test_settled_pairs_are_in_no_cell(spark, monkeypatch):
    """Lines compared as leader and line are not compared again; links that only a cell can find are kept."""
    cells = []
    keep = A._linked

    def seen(rows, texts, sets):
        cells.append(rows.collect())
        return keep(rows, texts, sets)

    monkeypatch.setattr(A, "_linked", seen)
    word = {1: "abcdefghij", 2: "klmnopqrst", 3: "ABCDEFGHIJ", 4: "ABCDEFGHIJ!", 5: "0123456789", 6: "uvwxyz----"}
    keys = {10: [1, 2], 11: [1, 2], 12: [1, 2, 3, 4], 13: [5, 6]}
    of = {x: np.array([k for k in keys if x in keys[k]], np.uint64).tobytes() for x in word}
    texts = spark.createDataFrame(list(word.items()), "line long, normal string")
    banded = spark.createDataFrame([(x, bytearray(of[x])) for x in word], "line long, bands binary").coalesce(1)

    def sets(lines):
        own = [np.unique(np.frombuffer(x.encode(), np.uint8).astype(np.uint64)) for x in lines]
        return np.concatenate([np.zeros(0, np.uint64), *own]), np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64)

    found = A.similar(banded, lambda wanted: texts.join(wanted, "line", "left_semi"), sets).collect()
    assert {(x["id"], x["component"]) for x in found} == {(3, 3), (4, 3)}
    assert {x["key"] for x in cells[1]} == {12} and {x["line"] for x in cells[1]} == {2, 3, 4}


def test_cells_are_compared_in_bounded_memory():
    """Numbers for each token of a large cell are held few at a time: 60 bytes a token were held before."""
    import tracemalloc

    r = np.random.default_rng(1)
    own = [np.unique(r.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(2000)]
    own += [np.unique(np.concatenate((x[:150], r.integers(0, 2**63, 150).astype(np.uint64)))) for x in own]
    offsets, flat = np.concatenate(([0], np.cumsum([len(x) for x in own]))), np.concatenate(own)
    every = np.ones(len(own), bool)
    tracemalloc.start()
    A._forest(flat, offsets, np.arange(len(own)), every, every)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 45 * len(flat)


def test_freed_memory_goes_back(spark, monkeypatch):
    """Each table written hands the driver's freed memory back, and a driver that cannot is left alone."""
    from tidemark.llm import common

    calls = []
    monkeypatch.setattr(common, "hand_back", lambda s, real=common.hand_back: calls.append(real(s)))
    assert common.materialize(spark.range(3), "few").count() == 3 and calls == [None]
    monkeypatch.setattr(common.ctypes, "CDLL", lambda name: None)
    assert common.materialize(spark.range(3), "few").count() == 3


def test_tables_have_no_checksum_files(spark, monkeypatch, tmp_path):
    """Tables are their rows' files alone, as a process is started to set the mode of every other file too."""
    from tidemark.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    table = common.materialize(spark.range(30).repartition(3), "rows")
    assert sorted(x["id"] for x in table.collect()) == list(range(30))
    names = [x.name for x in tmp_path.rglob("*") if x.is_file()]
    assert len(names) >= 3 and all(x.endswith(".parquet") for x in names)
    common.drop_table(table)
    assert not list(tmp_path.rglob("*.parquet"))
