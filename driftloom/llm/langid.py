"""Operator 4: language identification by multinomial naive Bayes.

Texts become lower-case letters and single spaces; character n-grams (n = 1..3)
are hashed to ``1 << BITS`` buckets.  Training adds up bucket counts by language
in numpy, one array a language and task, and sums them in Spark: every labelled
document counts, and the model has languages x buckets numbers whatever the
input's size, which is why it may be broadcast (languages are a dimension).
Prediction gathers the log probabilities of a chunk's n-grams and adds them up
by document.

Defined results: a null text, or one without a letter, gives ``und`` with score
1; with nothing to learn from every text gives ``und`` with score 0; ties go to
the language first in code-point order; an empty table gives no rows; repeated
rows come out as often as they came in; null labels are not learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, crc_mod, load, text_buffer

BITS, ORDERS, SMOOTH = 16, (1, 2, 3), 0.5
_tables: list[np.ndarray] = []


def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case, or a space if it is no letter; whether it is one."""
    if not _tables:
        lower, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
        for i in range(0x110000):
            if (c := chr(i)).isalpha():
                low = c.lower()
                lower[i], letter[i] = (ord(low) if len(low) == 1 else i), True
        _tables.extend((lower, letter))
    return _tables[0], _tables[1]


def ngrams(buf: np.ndarray, offs: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the hashed n-grams and their rows (sorted); which rows have a letter."""
    lower, letter = _letter_tables()
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offs]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(ends))
    seen = np.zeros(len(offs) - 1, bool)
    seen[row[letter[points]]] = True
    c = lower[points]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (row[1:] != row[:-1])
    c, row = c[keep], row[keep]
    out = []
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            out.append((np.empty(0, np.uint32), np.empty(0, np.int64)))
            continue
        h = np.full(m, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ c[k : k + m]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        at = row[:m] == row[n - 1 :]
        out.append(((h * np.uint32(0xC2B2AE35))[at] >> np.uint32(32 - BITS), row[:m][at]))
    return out, seen


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        buf, offs = text_buffer(batch.column("text"))
        names = batch.column("lang").dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False)
        langs = names.dictionary.to_pylist()
        for i, j in chunks(offs):
            grams, seen = ngrams(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            of = code[i:j]
            for k in np.unique(of):
                acc = sums.setdefault(langs[k], np.zeros((1 << BITS) + 1, np.int64))
                acc[-1] += int((seen & (of == k)).sum())  # the last cell counts documents
                for h, row in grams:
                    acc[:-1] += np.bincount(h[of[row] == k], minlength=1 << BITS)
    for lang, acc in sums.items():
        at = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(acc[at])], names=["lang", "bucket", "n"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probabilities by bucket and language, log priors)."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names, bucket, n = (counts.column(c) for c in ("lang", "bucket", "n"))
    langs = sorted(set(names.to_pylist()))
    table = np.zeros(((1 << BITS) + 1, len(langs)))
    where = {x: i for i, x in enumerate(langs)}
    table[bucket.to_numpy(), [where[x] for x in names.to_pylist()]] = n.to_numpy()
    docs_of, table = table[-1], table[:-1]
    logs = np.log((table + SMOOTH) / (table.sum(0) + SMOOTH * (1 << BITS)))
    return langs, logs.astype(np.float32), np.log((docs_of + 1) / (docs_of.sum() + len(langs) or 1))


def predict(docs: DataFrame, model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "held_out")) -> DataFrame:
    """The columns ``keep`` with lang_pred and score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs, prior = shared.value
        for batch in batches:
            buf, offs = text_buffer(batch.column("__op4_text"))
            best, score = np.full(batch.num_rows, len(langs)), np.zeros(batch.num_rows)
            for i, j in chunks(offs):
                grams, seen = ngrams(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                score[i:j][~seen] = 1.0 if langs else 0.0
                if not langs:
                    continue
                total = np.repeat(prior[None, :], j - i, 0)
                for h, row in grams:
                    if len(h):
                        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                        total[row[first]] += np.add.reduceat(logs[h], first, axis=0, dtype=np.float64)
                total -= total.max(1, keepdims=True)
                p = np.exp(total)
                p /= p.sum(1, keepdims=True)
                best[i:j][seen] = p.argmax(1)[seen]
                score[i:j][seen] = p.max(1)[seen]
            pred = pa.array([*langs, "und"], pa.string()).take(pa.array(best))
            yield pa.RecordBatch.from_arrays([*(batch.column(f"__op4_{k}") for k in range(len(keep))), pred, pa.array(score)], names=names)

    types = [docs.schema[k].dataType.simpleString() for k in keep]
    names = [f"__op4_{k}" for k in range(len(keep))] + ["lang_pred", "score"]
    rows = docs.select(*(F.col(k).alias(f"__op4_{i}") for i, k in enumerate(keep)), F.col(text_col).alias("__op4_text"))
    out = rows.mapInArrow(apply, ", ".join(f"{n} {t}" for n, t in zip(names, [*types, "string", "double"], strict=True)))
    return out.select(*(F.col(f"__op4_{i}").alias(k) for i, k in enumerate(keep)), "lang_pred", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    return predict(docs, train(docs.filter(~F.col("held_out"))))


QUERIES = {"op4_language_id": op4_language_id}
SQL: dict[str, str] = {}
