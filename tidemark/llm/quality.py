"""Operator 7: document quality by random-indexing word vectors and a two-layer network.

A word's type is the word itself if the vocabulary has it, else its shape (the kinds of its first and last byte, of the
bytes between, and its length, in steps). Every type has a sparse random index vector that its hash alone decides
(SEEDS signed places of DIM). Its context vector is the sum of the index vectors of its neighbours within WINDOW words
over the sample, each rotated by its distance, so that order counts, at unit length. A word's vector is both.

A document is pooled from its words' vectors alone: their mean, their variance, and the mean product of each with the
next one. A network of one hidden layer, written in numpy, maps that to a probability; a temperature fitted on a part
of the sample that the network does not see calibrates it.

Vocabulary, vectors and network learn from a bounded sample of labelled rows (SAMPLE documents of each label by a hash
of the id, of up to SAMPLE_BYTES each and TOTAL_BYTES in all), in one task of an executor. Scoring reads whole texts and
is narrow: no shuffle.

Null and empty texts are scored too (all sums 0); rows with a null label are not learned from, nor ids that have both
labels; of rows with equal ids the least text is learned from; without both labels all scores are the share of label
1, 0.5 if there is none; repeated rows are answered once each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

SAMPLE, SAMPLE_BYTES, TOTAL_BYTES = 2000, 1 << 20, 12 << 20
DIM, SEEDS, WINDOW, VOCABULARY, HIDDEN = 48, 4, 2, 20_000, 32

#: Kinds of bytes: 0 others, 1 small and 2 capital ASCII letters, 3 digits, 4 ASCII signs, 5 of longer characters.
_KIND = np.array([5 if b >= 128 else 1 if 97 <= b < 123 else 2 if 65 <= b < 91 else 3 if 48 <= b < 58 else 4 if 33 <= b < 127 else 0 for b in range(256)], np.uint8)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """The types' sparse random vectors, dense."""
    out = np.zeros((len(hashes), DIM), np.float32)
    at = np.arange(len(hashes))
    for j in range(SEEDS):
        h = common.mix(hashes + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        out[at, (h % np.uint64(DIM)).astype(np.int64)] += np.where(h >> np.uint64(63), 1, -1).astype(np.float32)
    return out


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words' shapes, as numbers below SHAPES."""
    if not len(starts):
        return np.zeros(0, np.int64)
    kind = _KIND[data]
    inner = np.bitwise_or.reduceat((1 << kind).astype(np.uint8), starts)  # up to the next word; white space has kind 0
    size = np.minimum(np.ceil(np.log2(ends - starts + 1)).astype(np.int64), 7)
    return ((kind[starts].astype(np.int64) * 6 + kind[ends - 1]) * 32 + (inner >> 1)) * 8 + size


SHAPES = 6 * 6 * 32 * 8


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words, the n + 1 word offsets of the rows, and where the words start and end."""
    words, off, starts, ends = common.word_hashes(data, offsets, lower=False, spans=True)
    return words, off, (starts, ends)


class Quality:
    """Word vectors and network."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.keys, self.net, self.temperature = prior, np.zeros(0, np.uint64), None, 1.0

    def learn_words(self, data: np.ndarray, offsets: np.ndarray) -> None:
        words, off, _ = split(data, offsets)
        keys, counts = np.unique(words, return_counts=True)
        if len(keys) > VOCABULARY:
            keys = np.sort(keys[np.lexsort((keys, -counts))[:VOCABULARY]])
        self.keys = keys
        types, off = self.types(data, offsets)
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        n = len(self.keys) + SHAPES
        index = index_vectors(np.concatenate([self.keys, common.mix(np.arange(SHAPES, dtype=np.uint64))]))
        vectors = np.zeros((n, DIM), np.float32)
        for d in range(1, WINDOW + 1):
            same = row[d:] == row[:-d]
            for own, other, turn in ((types[:-d][same], types[d:][same], d), (types[d:][same], types[:-d][same], -d)):
                order = np.argsort(own, kind="stable")
                own, other = own[order], other[order]
                for lo in range(0, len(own), 1 << 17):
                    some = own[lo : lo + (1 << 17)]
                    first = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
                    vectors[some[first]] += np.add.reduceat(np.roll(index, turn, axis=1)[other[lo : lo + (1 << 17)]], first, axis=0)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
        self.table = np.hstack([vectors, index / np.float32(SEEDS**0.5)])

    def types(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The type of every word, and the n + 1 word offsets of the rows."""
        words, off, spans = split(data, offsets)
        at = np.minimum(np.searchsorted(self.keys, words), max(len(self.keys) - 1, 0))
        known = self.keys[at] == words if len(self.keys) else np.zeros(len(words), bool)
        return np.where(known, at, len(self.keys) + shapes(data, *spans)), off

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pooled vectors of the texts, a row each; computed in pieces, as every word's vectors are looked up."""
        parts = [self._features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in common.chunks(offsets, 1 << 18)]
        return np.vstack(parts) if parts else np.zeros((0, 6 * DIM))

    def _features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        types, off = self.types(data, offsets)
        n = np.diff(off)
        sums = np.zeros((len(n), 3, 2 * DIM))
        row = np.repeat(np.arange(len(n)), n)
        for lo in range(0, len(types), 1 << 14):  # a piece and the word after it
            own = types[lo : lo + (1 << 14) + 1]
            vectors, where = self.table[own], row[lo : lo + (1 << 14)]
            first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
            size = len(where)
            sums[where[first], 0] += np.add.reduceat(vectors[:size], first, axis=0)
            sums[where[first], 1] += np.add.reduceat(vectors[:size] ** 2, first, axis=0)
            after = row[lo + 1 : lo + 1 + size]
            product = vectors[: len(after)] * vectors[1 : len(after) + 1]
            product[where[: len(after)] != after] = 0
            if len(after):
                first = np.flatnonzero(np.append(True, after[1:] != after[:-1]))
                sums[after[first], 2] += np.add.reduceat(product, first, axis=0)
        sums /= np.maximum(n, 1)[:, None, None]
        sums[:, 1] -= sums[:, 0] ** 2
        return sums.reshape(len(n), 6 * DIM)

    def learn_labels(self, x: np.ndarray, y: np.ndarray, check_x: np.ndarray, check_y: np.ndarray, epochs: int = 80) -> None:
        """Adam on the mean log loss with weight decay, then the temperature on the rows set apart."""
        rng = np.random.default_rng(11)
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for lo in range(0, len(z), 128):
                at = order[lo : lo + 128]
                hidden = np.tanh(z[at] @ p[0] + p[1])
                error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -30, 30))) - y[at, None]) / len(at)
                back = error @ p[2].T * (1 - hidden**2)
                grads = [z[at].T @ back + 1e-3 * p[0], back.sum(axis=0), hidden.T @ error + 1e-3 * p[2], error.sum(axis=0)]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.net = p
        if len(check_y):
            logits = self._logits(check_x)
            losses = [(float(np.mean(np.logaddexp(0, -np.where(check_y > 0, 1, -1) * logits / t))), float(t)) for t in np.geomspace(0.2, 8, 50)]
            self.temperature = min(losses)[1]

    def _logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return (np.tanh(z @ self.net[0] + self.net[1]) @ self.net[2] + self.net[3])[:, 0]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        if self.net is None:
            return np.full(len(offsets) - 1, self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logits(self.features(data, offsets)) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Quality:
    """A model from a bounded sample of labelled rows, of which a fifth calibrates it."""
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    own = own.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("doc_id", "y")
    few = common.bounded_sample(own, "doc_id", "y", sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    got = rows.join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # at most 2 * sample ids
    size = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return common.learned(got.withColumn("size", size).where(F.col("size") <= TOTAL_BYTES // 2).select("doc_id", "y", "text"), learn)


def learn(table: pa.Table) -> Quality:
    """A model of rows doc_id, y, text."""
    table = table.sort_by("doc_id")
    y = table.column("y").to_numpy().astype(np.float64)
    model = Quality(float(y.mean()) if len(y) else 0.5)
    if len(set(y.tolist())) < 2:
        return model
    apart = np.arange(len(y)) % 5 == 4
    model.learn_words(*common.as_bytes(table.column("text").filter(pa.array(~apart))))
    x = model.features(*common.as_bytes(table.column("text")))
    model.learn_labels(x[~apart], y[~apart], x[apart], y[apart])
    return model


def score(docs: DataFrame, model: Quality, id_col: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted; with keep, the rows of docs whose score is 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if keep:
        rows, place, schema = docs, docs.columns.index(text), docs.schema
    else:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.held_out(id_col).alias("held_out"), F.col(text).cast("string").alias("text"))
        place, schema = 2, "doc_id long, held_out boolean, score double, predicted int"

    def task(batches):
        common.thrifty()
        model = shared.value
        for batch in batches:
            data, off = common.as_bytes(batch.column(place))
            for lo, hi in common.chunks(off, 1 << 19):
                p = model.scores(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                part = batch.slice(lo, hi - lo)
                if keep:
                    yield part.filter(pa.array(p >= 0.5))
                else:
                    yield pa.record_batch([part.column(0), part.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        common.trim()

    return rows.mapInArrow(task, schema)


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Quality:
    """The model of the rows of docs that the contract allows to learn from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(docs.where(~common.held_out()), labels.where(~common.held_out()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fitted(spark, docs, sf_dir))
