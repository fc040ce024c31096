"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated probabilities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, hand_back, mix64

#: Table of word vectors: hashed words, width of a vector, non-zero entries of an index vector.
BUCKETS, WIDTH, NONZERO = 1 << 14, 64, 4
#: At most this many labelled rows train the network (the smallest hashed ids); the table of word vectors covers all rows.
TRAIN_ROWS = 24_000
#: Distance up to which neighbours count as context.
REACH = 2
#: Letters, digits and signs form tokens of their own, so that marks glued to words are seen.
TOKEN = r"\p{Lu}{2,}|\p{L}+|\p{N}+|[^\p{L}\p{N}\s]+"


def token_ids(text: str = "text"):
    """Column: hashed tokens. Rare words share buckets; upper-case runs and repeats have shapes of their own."""
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int"))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the sparse ternary index vector of every bucket, from its number alone."""
    seed = mix64(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    place = (seed % np.uint64(WIDTH)).astype(np.int64).reshape(BUCKETS, NONZERO)
    sign = np.where(seed >> np.uint64(63), 1.0, -1.0).reshape(BUCKETS, NONZERO)
    return place, sign


def _contexts(batches):
    """Sums, over all rows of a partition, of the index vectors around each bucket; one row a used bucket."""
    place, sign = index_vectors()
    total = np.zeros(BUCKETS * WIDTH)
    count = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        ids, offsets = flat(batch.column("ids"), np.int32)
        if not len(ids):
            continue
        count += np.bincount(ids, minlength=BUCKETS)
        row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
        for step in range(1, REACH + 1):
            for a in range(0, len(ids) - step, 1 << 18):
                here, there = ids[a : a + (1 << 18)][: len(ids) - step - a], ids[a + step : a + step + (1 << 18)]
                same = row[a : a + len(here)] == row[a + step : a + step + len(here)]
                here, there = here[same], there[same]
                for x, y in ((here, there), (there, here)):
                    cells = (x[:, None] * WIDTH + place[y]).ravel()
                    total += np.bincount(cells, sign[y].ravel(), BUCKETS * WIDTH)
    used = np.flatnonzero(count)
    yield pa.record_batch(
        {"bucket": pa.array(used.astype(np.int32)), "n": pa.array(count[used]), "v": pa.array(list(total.reshape(BUCKETS, WIDTH)[used]), pa.list_(pa.float64()))}
    )


def word_vectors(tokens: DataFrame) -> np.ndarray:
    """The BUCKETS x WIDTH table of word vectors of the whole corpus; its size is fixed, whatever the input."""
    parts = tokens.select("ids").mapInArrow(_contexts, "bucket int, n long, v array<double>")
    summed = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(WIDTH)])
    got = summed.toArrow()
    table = np.zeros((BUCKETS, WIDTH), np.float32)
    if got.num_rows:
        v = np.column_stack([got.column(f"v{i}").to_numpy() for i in range(WIDTH)])
        v = np.sign(v) * np.log1p(np.abs(v))
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        table[got.column("bucket").to_numpy()] = v
    return table


def pooled(ids: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A document's features: mean and spread of its word vectors, share of immediate and of all repeats, log length."""
    n = np.diff(offsets)
    out = np.zeros((len(n), 2 * WIDTH + 4), np.float32)
    for i in np.flatnonzero(n):
        own = ids[offsets[i] : offsets[i + 1]]
        uses = np.bincount(own, minlength=BUCKETS)
        kinds = np.flatnonzero(uses)
        v, w = table[kinds], (uses[kinds] / len(own)).astype(np.float32)
        mean = w @ v
        out[i, :WIDTH], out[i, WIDTH : 2 * WIDTH] = mean, np.sqrt(np.maximum(w @ (v * v) - mean * mean, 0))
        out[i, 2 * WIDTH :] = len(kinds) / len(own), (own[1:] == own[:-1]).sum() / len(own), w.max(), np.log1p(len(own)) / 10
    return out


class Network:
    """tanh hidden layer and one logistic output, in numpy; ``temperature`` divides the logit."""

    def __init__(self, features: int, hidden: int = 48, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(features), np.ones(features)
        self.w1, self.b1 = r.normal(0, features**-0.5, (features, hidden)), np.zeros(hidden)
        self.w2, self.b2 = r.normal(0, hidden**-0.5, hidden), 0.0
        self.temperature = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-3, seed: int = 11) -> Network:
        """Adam on the cross entropy; a fifth of the rows is kept apart to choose the epoch and the temperature."""
        r = np.random.default_rng(seed)
        order = r.permutation(len(y))
        held, own = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[own].mean(0), x[own].std(0) + 1e-4
        p = [self.w1, self.b1, self.w2, np.array(self.b2)]
        m, v, t, best = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0, (np.inf, None)
        for _ in range(epochs):
            for k in np.array_split(r.permutation(own), max(1, len(own) // 128)):
                z = (x[k] - self.mean) / self.scale
                h = np.tanh(z @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[k]) / len(k)
                back = np.outer(d, p[2]) * (1 - h * h)
                t += 1
                for i, g in enumerate((z.T @ back + decay * p[0], back.sum(0), h.T @ d + decay * p[2], d.sum())):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
            self.w1, self.b1, self.w2, self.b2 = p[0], p[1], p[2], float(p[3])
            loss = self._loss(x[held], y[held], 1.0) if len(held) else 0.0
            if loss < best[0]:
                best = loss, [np.copy(a) for a in p]
        if best[1] is not None:
            self.w1, self.b1, self.w2, self.b2 = *best[1][:3], float(best[1][3])
        if len(held):
            self.temperature = min(np.geomspace(0.25, 8, 61), key=lambda s: self._loss(x[held], y[held], s))
        return self

    def _loss(self, x, y, temperature: float) -> float:
        z = self.logit(x) / temperature
        return float(np.mean(np.logaddexp(0, z) - y * z))


def is_held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def quality_model(docs: DataFrame, labels: DataFrame):
    """Fit the classifier on ``docs`` (doc_id, text) and return its column: the probability of quality 1 of a text.

    The column takes nothing but the hashed tokens of ``text`` to the workers, so that
    rows keep their other columns in the JVM, whatever their names.

    Word vectors come from all rows of ``docs``. The network learns from at most
    TRAIN_ROWS ids that ``labels`` (doc_id, quality) marks and that are not held out
    (crc32 of the id's text modulo 4 is 2); of rows that share an id the text that is
    least in order trains, of labels that share an id the greatest. Texts alone are
    inputs, and whole ones, however long. A null text counts as empty; empty texts get
    the score of a text without tokens. Rows with a null doc_id are scored and never
    train. Without any usable label every score is 0.5; without rows of one class the
    network learns the other. Equal texts get equal scores. An empty table gives a
    model without labels. Other columns are ignored.
    """
    table = word_vectors(docs.select(token_ids().alias("ids")))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # BUCKETS x WIDTH floats, 4 MB at any input size

    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)

    def featured(batches):
        for batch in batches:
            ids, offsets = flat(batch.column("ids"), np.int32)
            x = pooled(ids, offsets, shared.value)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "x": pa.array(list(x), pa.list_(pa.float32())), "quality": batch.column("quality")})

    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # TRAIN_ROWS rows of two numbers at most
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").cast("int").alias("quality"))
        .select(F.col("doc_id").cast("long"), token_ids().alias("ids"), "quality")
        .mapInArrow(featured, "doc_id long, x array<float>, quality int")
        .toArrow()  # no object for each row, as these stay with the driver's memory
    )
    network = Network(2 * WIDTH + 4)
    if rows.num_rows:
        order = np.argsort(rows.column("doc_id").to_numpy())
        x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(order), -1)
        network.fit(x[order].astype(np.float64), rows.column("quality").to_numpy()[order].astype(np.float64))
        del x
    else:
        network.w2[:] = 0
    del rows
    hand_back(docs.sparkSession)

    @F.arrow_udf("double")
    def probability(tokens: pa.Array) -> pa.Array:
        ids, offsets = flat(tokens, np.int32)
        return pa.array(network.probability(pooled(ids, offsets, shared.value).astype(np.float64)))

    return probability(token_ids())


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Return doc_id and ``score`` of every row of ``docs``, by :func:`quality_model`; an empty table gives an empty result."""
    return docs.select("doc_id", quality_model(docs, labels).alias("score"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Every document with its quality score; contract of op1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_quality(docs, labels)
    return out.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
