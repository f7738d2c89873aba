"""Operator 6: quality classifier from supervised subword embeddings.

A document's features are its words, pairs of words, the pair of a word with
itself (one feature for all words), and byte n-grams (n = 2..4,
the subwords), hashed to ``1 << BITS`` buckets; case and punctuation stay, as
they tell junk.  A bucket has a vector of ``DIM`` numbers; a document is the mean
of its features' vectors, each of the three kinds having a third of the weight, and a softmax layer gives the label.  Vectors and layer
are learned together by minibatch stochastic gradient descent in numpy, in one
task of an executor, on at most ``SAMPLE`` labelled documents (those with the smallest
hashes of the id; the bound is this parameter).  The task keeps their features in
unnamed files of its own temp folder, which it maps; the driver gets the model alone.

The trained model is one number a bucket (vector times layer), of fixed size,
broadcast; scoring adds up a chunk's gathered numbers by document.

Defined results: a null or empty text has no features and gets the score of the
bias alone; without a label of either kind every score is 0.5; repeated rows are
scored alike; a repeated id is learned from once, by its smallest label and its
text of the smallest hash, and scored row by row; an empty table gives no rows; documents without a
label, or with a null one, are not learned from but scored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from typing import IO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, crc_mod, gram_hashes, load, prefix_sums, span_hash, text_buffer, words

BITS, DIM, SAMPLE = 17, 8, 4000
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.5, 7
THRESHOLD = 0.7
#: The bucket of "the same word twice", whichever word it is.
REPEAT, KINDS = 0, 3


def features(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The kind (0 words, 1 pairs, 2 subwords), hashed features and their rows."""
    s, e, row = words(buf, offs)
    h = span_hash(prefix_sums(buf), s, e)
    top = np.uint64(64 - BITS)
    yield 0, (h >> top).astype(np.int32), row
    g, at = gram_hashes(h, row, 2)
    yield 1, (g >> top).astype(np.int32), row[at]
    again = at[h[at] == h[at + 1]]
    yield 1, np.full(len(again), REPEAT, np.int32), row[again]
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    b = buf.astype(np.uint32)
    for n in (2, 3, 4):
        m = len(b) - n + 1
        if m > 0:
            x = np.full(m, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                x = (x ^ b[k : k + m]) * np.uint32(0x85EBCA6B)
                x ^= x >> np.uint32(13)
            ok = owner[:m] == owner[n - 1 :]
            yield 2, ((x * np.uint32(0xC2B2AE35))[ok] >> np.uint32(32 - BITS)).astype(np.int32), owner[:m][ok]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(label, distinct features, their shares) of each labelled document."""
    for batch in batches:
        buf, offs = text_buffer(batch.column("text"))
        for i in range(batch.num_rows):
            own = buf[offs[i] : offs[i + 1]]
            got = list(features(own, np.array([0, len(own)])))
            size = [max(1, sum(len(f) for k, f, _ in got if k == kind)) for kind in range(KINDS)]
            ids, at = np.unique(np.concatenate([f for _, f, _ in got]), return_inverse=True)
            each = np.repeat([1 / (KINDS * size[k]) for k, _, _ in got], [len(f) for _, f, _ in got])
            share = np.bincount(at, each, len(ids)).astype(np.float32)
            yield batch.column("label")[i].as_py(), ids, share


def fit(labels: np.ndarray, ids: list[np.ndarray], shares: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """(a number a bucket, bias): the log odds of label 1 are bias plus the mean over features."""
    if len(set(labels.tolist())) < 2:
        return np.zeros(1 << BITS, np.float32), 0.0
    rng = np.random.default_rng(SEED)
    vec = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.log(np.bincount(labels, minlength=2) / len(labels)).astype(np.float32)
    one = np.eye(2, dtype=np.float32)
    power = np.full(1 << BITS, 1e-8, np.float32)  # squared steps a bucket, for its own rate
    for epoch in range(EPOCHS):
        order = rng.permutation(len(labels))
        for b in range(0, len(order), BATCH):
            rate = RATE * (1 - (epoch * len(order) + b) / (EPOCHS * len(order)))
            pick = [k for k in order[b : b + BATCH] if len(ids[k])]
            if not pick:
                continue
            f = np.concatenate([ids[k] for k in pick])
            w = np.concatenate([shares[k] for k in pick])
            size = np.array([len(ids[k]) for k in pick])
            start = np.r_[0, np.cumsum(size)[:-1]]
            mean = np.add.reduceat(vec[f] * w[:, None], start, axis=0)
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p - one[labels[pick]]
            back = np.repeat(g @ layer.T, size, axis=0) * w[:, None]
            layer -= rate * (mean.T @ g) / len(pick)
            bias -= rate * g.mean(0)
            u, inv = np.unique(f, return_inverse=True)
            step = np.stack([np.bincount(inv, back[:, k], len(u)) for k in range(DIM)], 1)
            power[u] += (step**2).sum(1)
            vec[u] -= rate * step / np.sqrt(power[u])[:, None]
    return vec @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def _mapped(file: IO[bytes], kind: type, ends: list[int]) -> list[np.ndarray]:
    """The parts of a file of numbers that end there."""
    file.flush()
    whole = np.asarray(np.memmap(file, kind, "r")) if ends[-1] else np.empty(0, kind)
    return np.split(whole, ends[:-1])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model, as one row, of all labelled documents."""
    y, ends = [], []
    with tempfile.TemporaryFile() as one, tempfile.TemporaryFile() as two:
        for label, ids, share in _extract(batches):
            one.write(ids.tobytes())
            two.write(share.tobytes())
            y.append(label)
            ends.append(len(ids) + (ends[-1] if ends else 0))
        if not y:
            return
        i, s = _mapped(one, np.int32, ends), _mapped(two, np.float32, ends)
        order = sorted(range(len(y)), key=lambda k: (len(i[k]), int(i[k].sum()), y[k]))  # as rows come in any order
        weight, bias = fit(np.array(y)[order], [i[k] for k in order], [s[k] for k in order])
    yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()], pa.binary()), pa.array([bias])], names=["weight", "bias"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Learn from at most ``sample`` of the labelled documents given."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__op6_id"), F.col(label_col).cast("int").alias("label"))
    few = known.groupBy("__op6_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("__op6_id"), "__op6_id").limit(sample)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(few), F.col(id_col) == F.col("__op6_id"))
    rows = rows.groupBy("__op6_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = rows.select("label", "text").repartition(1).mapInArrow(_learn, "weight binary, bias double").collect()
    return (np.frombuffer(got[0]["weight"], np.float32), got[0]["bias"]) if got else (np.zeros(1 << BITS, np.float32), 0.0)


def _scores(text: pa.Array, weight: np.ndarray, bias: float) -> np.ndarray:
    buf, offs = text_buffer(text)
    z = np.zeros(len(text))
    for i, j in chunks(offs):
        total, n = np.zeros((KINDS, j - i)), np.zeros((KINDS, j - i))
        for k, f, row in features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
            total[k] += np.bincount(row, weight[f], j - i)
            n[k] += np.bincount(row, minlength=j - i)
        z[i:j] = (total / np.maximum(n, 1)).mean(0)
    return 1 / (1 + np.exp(-(z + bias)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id", "held_out")) -> DataFrame:
    """The columns ``keep`` with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _scores(batch.column("__op6_text"), *shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(f"__op6_{k}") for k in range(len(keep))), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=names)

    names = [f"__op6_{k}" for k in range(len(keep))] + ["score", "predicted"]
    types = [docs.schema[k].dataType.simpleString() for k in keep]
    rows = docs.select(*(F.col(k).alias(f"__op6_{i}") for i, k in enumerate(keep)), F.col(text_col).alias("__op6_text"))
    out = rows.mapInArrow(apply, ", ".join(f"{n} {t}" for n, t in zip(names, [*types, "double", "int"], strict=True)))
    return out.select(*(F.col(f"__op6_{i}").alias(k) for i, k in enumerate(keep)), "score", "predicted")


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(text_col), *shared.value) >= threshold))

    return docs.mapInArrow(apply, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    labels = load(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2)
    return score(docs, train(docs, labels))


QUERIES = {"op6_quality": op6_quality}
SQL: dict[str, str] = {}
