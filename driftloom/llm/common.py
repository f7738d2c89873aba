"""Shared pieces: tables, written checkpoints, byte-level text kernels.

The text kernels work on Arrow buffers: a batch of documents is one byte array
with offsets, words are byte ranges in it, and every hash is a vectorised
polynomial over prefix sums.  Work goes through the batch in chunks of whole
documents of about ``CHUNK`` bytes, so memory follows the chunk (or the longest
single document), never the batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20

_rng = np.random.default_rng(20240131)
#: One random 64-bit value a byte; hashes are sums of value * BASE**position.
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same, with A-Z given the value of a-z.
_TABLE_LOWER = _TABLE.copy()
_TABLE_LOWER[65:91] = _TABLE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole Parquet table ``name`` of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a folder of its own; a cluster has
    no safe default, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints/driftloom"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there,
    a lost executor costs no recomputation before it, and later plans see its
    real size, which decides whether a join may broadcast it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one key that a task gets of a join by ``split_rows`` and ``copy_rows``.
PART = 1024


def hot_keys(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, parts) of the keys that more than PART rows have: fewer than a PARTth of
    the rows, which the planner broadcasts only if they are small."""
    counted = rows.groupBy(key).agg(F.count("*").alias("rows")).filter(F.col("rows") > PART)
    return materialize(counted.select(key, F.ceil(F.col("rows") / PART).cast("int").alias("parts")), label)


def split_rows(rows: DataFrame, hot: DataFrame, key: str, *by: str) -> DataFrame:
    """``rows`` with ``part``: a hot key's rows are dealt over its parts by ``by``."""
    part = F.coalesce(F.pmod(F.xxhash64(*by), F.col("parts")).cast("int"), F.lit(0))
    return rows.join(hot, key, "left").withColumn("part", part).drop("parts")


def copy_rows(table: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``table``, which has a row a key, with a copy for each part of a hot one."""
    last = F.coalesce(F.col("parts"), F.lit(1)) - 1
    return table.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), last))).drop("parts")


def crc_mod(col: str, n: int) -> Column:
    """crc32(the id as text) mod n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i <= n, kept for the worker's life."""
    have = _powers.get(0)
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK + 1)
        for k, base in ((0, _BASE), (1, _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about ``size`` bytes; a longer row stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(buf: np.ndarray, offs: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words ``[^\\x20\\x09-\\x0D]+``, or of the
    runs of bytes that the table ``apart`` doesn't hold."""
    if not len(buf):
        e = np.empty(0, np.int64)
        return e, e, e
    inside = ~apart[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs[:-1]] = True
    before = np.empty(len(buf), bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    before |= first[:-1]
    starts = np.flatnonzero(inside & before)
    after = np.empty(len(buf), bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    after[:-1] |= first[1:-1]
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def prefix_sums(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """S with S[i] the sum over j < i of value(byte j) * BASE**j, mod 2**64."""
    pw, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_TABLE_LOWER if lower else _TABLE)[buf] * pw[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes give equal hashes anywhere."""
    _, inv = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(buf: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The words' 64-bit hashes (A-Z lowered) and rows."""
    s, e, row = words(buf, offs)
    return span_hash(prefix_sums(buf, lower), s, e), row


_GRAM = [np.uint64(int(x) | 1) for x in _rng.integers(1, 2**63, 64, dtype=np.uint64)]


def gram_hashes(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starting positions of all runs of n words within one row."""
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    m = len(h) - n + 1
    out = np.full(m, np.uint64(n), np.uint64)
    for k in range(n):
        out += h[k : k + m] * _GRAM[k]
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    return mix(out[at]), at


def row_starts(row: np.ndarray, n: int) -> np.ndarray:
    """n+1 offsets of the rows in a sorted array of row numbers."""
    return np.searchsorted(row, np.arange(n + 1))


# -- a set as bits ---------------------------------------------------------


def bit_position(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def bitmap_of(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A packed bitmap of 2**bits bits with bit (value & mask) set for every
    value of a long column that is itself a hash.

    Its size is fixed by ``bits`` whatever the data, so it may be broadcast.
    It answers "surely absent" or "maybe present": rows it lets through are
    always joined exactly afterwards, so a full bitmap costs time, not results.
    """
    low = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = (
        df.select(F.bitmap_bucket_number(low + 1).alias("b"), F.bitmap_bit_position(low + 1).alias("p"))
        .groupBy("b")
        .agg(F.bitmap_construct_agg("p").alias("m"))
        .collect()
    )
    out = np.zeros(max(1, (1 << bits) >> 3), np.uint8)
    for b, m in ((r["b"], r["m"]) for r in rows):
        part = np.frombuffer(m, np.uint8)
        at = (b - 1) * 4096
        out[at : at + len(part)] |= part[: len(out) - at]
    return out


def bitmap_has(bitmap: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes may be in the bitmap."""
    low = values & np.uint64((1 << bits) - 1)
    return (bitmap[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0
