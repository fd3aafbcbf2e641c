"""Quality classifier: a factorisation machine (Rendle, 2010) over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise term is computed in linear time as half of
(sum v_i x_i)^2 - sum (v_i x_i)^2 per factor. It is trained by Adagrad on a bounded sample of labelled rows and then
scores every text whole, in the tasks that read it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, free_name, over_texts, plain_names, steps, text_bytes

#: Hash buckets of words, factors, and the labelled rows that training reads at most (the bound of its sample).
BUCKETS, FACTORS, SAMPLE = 1 << 15, 8, 6000
EPOCHS, STEPS, RATE, RIDGE, BATCH, SEED = 6, 500, 0.15, 2e-5, 64, 7
#: Score from which a text counts as good.
CUT = 0.7
#: Each statistic falls into one of so many bins, each a feature of its own.
BINS = 16

_BYTE = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "symbol": np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>!@^~=+_{}[]/\\", np.uint8)),
    "stop": np.isin(np.arange(256), np.frombuffer(b".,;:?", np.uint8)),
    "mark": np.isin(np.arange(256), np.frombuffer(b"!", np.uint8)),
    "pipe": np.isin(np.arange(256), np.frombuffer(b"|", np.uint8)),
    "feed": np.isin(np.arange(256), np.frombuffer(b"\n", np.uint8)),
}
STATISTICS = [*_BYTE, "words", "word_length", "variety", "repeat", "n_chars"]


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.float64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


@dataclass
class Rows:
    """Sparse rows: features[first[i]:first[i + 1]] with their values."""

    first: np.ndarray
    features: np.ndarray
    values: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray, buckets: int = BUCKETS) -> Rows:
    """Hashed words, scaled to length 1 per text, and binned statistics. n_chars is metadata and may be missing (NaN)."""
    w = Words(data, offsets, lower=True)
    raw = data[int(offsets[0]) : int(offsets[-1])]
    rows, n = len(offsets) - 1, w.counts.astype(np.float64)
    size = np.maximum(np.diff(w.bounds).astype(np.float64), 1)
    row = w.row_of_word()
    pair = np.unique((row.astype(np.uint64) << np.uint64(32)) | (w.h % np.uint64(buckets)))
    word_row, word = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
    distinct = np.bincount(word_row, minlength=rows).astype(np.float64)
    same = np.zeros(len(w.h), bool)
    same[1:] = (w.h[1:] == w.h[:-1]) & (row[1:] == row[:-1])
    some = np.maximum(n, 1)
    stats = {k: _per_row(lut[raw], w.bounds) / size for k, lut in _BYTE.items()}
    stats |= {"words": np.log2(n + 1) / 16, "word_length": _per_row(w.inside, w.bounds) / some / 24, "variety": distinct / some, "repeat": _per_row(same, w.first) / some}
    stats["n_chars"] = np.where(np.isnan(n_chars), 0, np.log2(np.maximum(n_chars, 0) + 1) / 24)
    dense = np.stack([np.minimum(np.sqrt(np.clip(stats[k], 0, 1)) * BINS, BINS - 1).astype(np.int64) + BINS * i for i, k in enumerate(STATISTICS)], axis=1) + buckets
    count = (distinct + len(STATISTICS)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    feature, value = np.empty(first[-1], np.int64), np.empty(first[-1], np.float64)
    own = (first[:-1, None] + np.arange(len(STATISTICS))).ravel()
    rest = np.ones(first[-1], bool)
    rest[own] = False
    feature[own], value[own] = dense.ravel(), 1 / np.sqrt(len(STATISTICS))
    feature[rest], value[rest] = word, 1 / np.sqrt(np.maximum(distinct, 1))[word_row]
    return Rows(first, feature, value)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, x: Rows) -> np.ndarray:
        v = self.factors[x.features] * x.values[:, None]
        at = x.first[:-1]
        total, square = np.add.reduceat(v, at, axis=0), np.add.reduceat(v * v, at, axis=0)
        return self.bias + np.add.reduceat(self.linear[x.features] * x.values, at) + 0.5 * (total * total - square).sum(axis=1)

    def scores(self, x: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _take(x: Rows, rows: np.ndarray) -> Rows:
    n = np.diff(x.first)[rows]
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - x.first[rows], n)
    return Rows(first, x.features[at], x.values[at])


def train(x: Rows, y: np.ndarray, buckets: int = BUCKETS, factors: int = FACTORS, epochs: int = EPOCHS) -> Machine:
    """Adagrad on the logistic loss, both classes weighing alike. Small samples are gone through more often, up to
    STEPS batches. Fixed seed: reruns agree."""
    rng = np.random.default_rng(SEED)
    size = buckets + BINS * len(STATISTICS)
    share = np.clip(y.mean(), 0.01, 0.99)
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share))
    epochs = max(epochs, -(-STEPS * BATCH // len(y)))
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, factors)))
    seen_w, seen_v, seen_b = np.full(size, 1e-2), np.full((size, factors), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            rows = order[a : a + BATCH]
            b = _take(x, rows)
            n = np.diff(b.first)
            v = m.factors[b.features] * b.values[:, None]
            total = np.add.reduceat(v, b.first[:-1], axis=0)
            logit = m.bias + np.add.reduceat(m.linear[b.features] * b.values, b.first[:-1]) + 0.5 * (total * total - np.add.reduceat(v * v, b.first[:-1], axis=0)).sum(axis=1)
            error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]
            error *= weight[rows]
            e = np.repeat(error, n) * b.values
            used, back = np.unique(b.features, return_inverse=True)
            gw = np.bincount(back, e) / len(rows) + RIDGE * m.linear[used]
            gv_each = e[:, None] * (np.repeat(total, n, axis=0) - v)
            gv = np.stack([np.bincount(back, gv_each[:, f]) for f in range(factors)], axis=1) / len(rows) + RIDGE * m.factors[used]
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            gb = float(error.mean())
            seen_b += gb * gb
            m.linear[used] -= RATE * gw / np.sqrt(seen_w[used])
            m.factors[used] -= RATE / 2 * gv / np.sqrt(seen_v[used])
            m.bias -= RATE * gb / np.sqrt(seen_b)
    return m


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, text, n_chars, _label) of at most `limit` labelled documents: those whose md5 of doc_id is smallest.

    Held-out rows, and null ids and labels, are left out; of several labels of one id the largest counts. Without a
    length column n_chars is null.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).alias("_label")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(limit)
    length = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", "text", length.alias("n_chars")).join(F.broadcast(known), "doc_id")


def _chars(column: pa.Array) -> np.ndarray:
    return np.array([np.nan if v is None else float(v) for v in column.to_pylist()], np.float64)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE) -> Machine | None:
    """The machine of the sample; None where nothing is labelled.

    The tasks turn the sampled texts into features; at most `limit` sparse rows reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            n_chars, ids, y = _chars(batch.column(2)), batch.column(0), batch.column(3)
            for i, j in steps(offsets):
                x = features(data, offsets[i : j + 1], n_chars[i:j])
                raw = [x.features[a:b].astype("<i4").tobytes() for a, b in zip(x.first[:-1], x.first[1:], strict=True)]
                value = [x.values[a:b].astype("<f4").tobytes() for a, b in zip(x.first[:-1], x.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), y.slice(i, j - i).cast(pa.int32()), pa.array(raw, pa.binary()), pa.array(value, pa.binary())], ["doc_id", "y", "f", "v"])

    sample = labelled_sample(docs, labels, label, limit)
    schema = T.StructType([sample.schema["doc_id"], T.StructField("y", T.IntegerType()), T.StructField("f", T.BinaryType()), T.StructField("v", T.BinaryType())])
    got = sorted(map(tuple, over_texts(sample, run, schema).toLocalIterator()))
    if not got:
        return None
    n = np.array([len(r[2]) // 4 for r in got])
    x = Rows(np.concatenate([[0], np.cumsum(n)]), np.frombuffer(b"".join(r[2] for r in got), "<i4").astype(np.int64), np.frombuffer(b"".join(r[3] for r in got), "<f4").astype(np.float64))
    return train(x, np.array([r[1] for r in got], np.float64))


@plain_names
def score(docs: DataFrame, machine: Machine | None, text: str = "text", length: str = "n_chars") -> DataFrame:
    """Adds score (0 to 1) to every row. A null text counts as empty: statistics alone still score it. Without a machine all score 0.5.

    Nothing but text and length is looked at; a column named score is replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() != "score"])
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at = batch.schema.get_field_index
            data, offsets = text_bytes(batch.column(at(text)))
            n_chars = _chars(batch.column(at(length))) if length in names else np.full(batch.num_rows, np.nan)
            out = np.full(batch.num_rows, 0.5)
            if m is not None:
                for i, j in steps(offsets):
                    out[i:j] = m.scores(features(data, offsets[i : j + 1], n_chars[i:j]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*names, "score"])

    return over_texts(docs, run, schema)


def keep_quality(docs: DataFrame, machine: Machine | None, cut: float = CUT) -> DataFrame:
    """The documents that score at least `cut`, columns unchanged."""
    name = free_name(docs, "_score")
    return score(docs, machine).withColumnRenamed("score", name).where(F.col(name) >= cut).select(*docs.columns)
