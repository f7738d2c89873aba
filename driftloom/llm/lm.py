"""Operator 8: language-model scoring by deleted interpolation.

Tokens are words with A-Z lowered, and one end a document, which is also the
context of a document's first token.  The model is over whole words:

    P(w | u) = a1 * c(u, w) / c(u) + a2 * c(w) / N + a3 / (V + 1)

with weights that depend on the bucket (log2) of the context's count.  They are
learned by expectation-maximisation on the word pairs of a held-out tenth of the
training documents, under estimates of the others; then the estimates are taken
from all of them.  A context never seen has no a1.

Data flow: an exchange of counts.
1. Documents are read once into *chunks* of about ``TOKENS`` tokens, a written
   table: the chunk's words and the tokens as places in that list.
2. A chunk asks for each of its distinct words and word pairs once, and tells how
   often it has them.  Keys are 64-bit hashes, sorted; those of one range of hashes
   (a *part*, of about ``PART`` keys over all chunks) are one row of packed
   differences.
3. A part adds up what the chunks tell, which gives the counts of the whole corpus,
   and answers every row with the counts of its keys, in the row's order.  So only
   counts travel back, a byte or so each; they are a written table.
4. A chunk puts its answers together and scores its documents; before that,
   held-out chunks give the events of EM, by bucket and in 1/``GRID`` steps of the
   logarithms of their two estimates, which is a bounded table.

Every count is exact and every word keeps its pairs, at any size; nothing is
broadcast but the weights.  Memory follows a chunk (or the longest document) and a
part.  A word as common as can be costs a part one key a chunk.

Defined results: a null text is one end token; repeated rows are scored each; a
null id counts as empty text for the split; without training documents N and V
are 0, every token is unknown and the model is uniform; an empty table gives no
rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, crc_mod, load, materialize, mix, text_buffer, word_hashes

TOKENS, PART, ROUNDS, GRID = 1 << 20, 1 << 19, 40, 8
END = np.uint64(0x5EED0E4D5EED0E4D)
BUCKETS = 48
_FIRST = np.uint64(0x9E3779B97F4A7C15)
#: What a document is for: scored, learned from and scored, held out for the weights and scored, and the last two without being scored.
SCORED, LEARNED, HELD, LEARNED_ONLY, HELD_ONLY = range(5)


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end after each row's words, and their rows."""
    h, row = word_hashes(buf, offs)
    n = len(offs) - 1
    at = np.searchsorted(row, np.arange(n), "right")
    return np.insert(h, at, END), np.insert(row, at, np.arange(n))


# -- packing -----------------------------------------------------------------


def _pack(values: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Non-negative numbers as (bytes, a row each; width; which are escaped): in the width that
    costs least, as numbers that reach its largest are escaped to eight bytes."""
    values = values.astype("<u8")
    costs = [w * len(values) + 8 * np.count_nonzero(values >= np.uint64((1 << 8 * w) - 1)) for w in range(1, 8)]
    width = 1 + int(np.argmin([*costs, 8 * len(values)]))
    over = values >= np.uint64((1 << 8 * width) - 1) if width < 8 else np.zeros(len(values), bool)
    small = np.minimum(values, np.uint64((1 << 8 * width) - 1))
    return small.view(np.uint8).reshape(-1, 8)[:, :width], width, over


def _packed(name: str, values: np.ndarray, ends: np.ndarray) -> dict[str, pa.Array]:
    """The columns name, name_width and name_more of rows of numbers cut at ``ends`` (with a 0 first)."""
    data, width, over = _pack(values)
    more = np.r_[0, np.cumsum(over)][ends]

    def blobs(raw: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])

    return {name: blobs(data, ends * width), f"{name}_width": pa.array(np.full(len(ends) - 1, width, np.int32)), f"{name}_more": blobs(values[over].astype("<u8"), more * 8)}


def _unpack(rows: object, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the rows of a batch or struct array, and the numbers a row."""
    col = rows.field if isinstance(rows, pa.StructArray) else lambda c: rows.column(c)
    width = col(f"{name}_width").to_numpy()
    raw, offs = text_buffer(col(name))
    size = np.diff(offs) // width
    out = np.zeros(int(size.sum()), np.uint64)
    over = np.zeros(len(out), bool)
    begin = np.r_[0, np.cumsum(size)[:-1]]
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        n = size[own]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at, to = np.repeat(offs[own], n) + within * w, np.repeat(begin[own], n) + within
        got = np.zeros(len(at), np.uint64)
        for b in range(w):
            got |= raw[at + b].astype(np.uint64) << np.uint64(8 * b)
        out[to] = got
        over[to] = (got == np.uint64((1 << 8 * w) - 1)) & (w < 8)
    more, _ = text_buffer(col(f"{name}_more"))
    out[over] = np.ascontiguousarray(more).view("<u8")
    return out, size


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers below 2**32 of one row, byte by byte of all of them, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _expand(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _least_key(part: np.ndarray, parts: int) -> np.ndarray:
    part = part.astype(np.uint64)
    return (((part << np.uint64(32)) + np.uint64(parts - 1)) // np.uint64(parts)) << np.uint64(32)


# -- chunks ------------------------------------------------------------------


def _gather(kept_columns: int):
    """Rows (role, k0.., text) to chunks of one role each."""
    names = ["chunk", "role", "words", "ids", "sizes", "n_tokens", "n_docs", "n_words", *(f"k{x}" for x in range(kept_columns))]

    def out(role: int, hs: list, sizes: list, kept: list) -> pa.RecordBatch:
        words, ids, n = np.unique(np.concatenate(hs), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # the commonest words get the smallest places
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        size = np.concatenate(sizes)
        cols = [int.from_bytes(os.urandom(8), "big") >> 1, role, words[order].tobytes(), _squeeze(place[ids]), _squeeze(size), int(n.sum()), len(size), len(words)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (pa.concat_arrays([k[x] for k in kept]) for x in range(kept_columns))]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([*(pa.array([c], t) for c, t in zip(cols, types, strict=True)), *lists], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list] = {}
        for batch in batches:
            roles = batch.column("role").to_numpy()
            for role in np.unique(roles).tolist():
                part = batch.filter(pa.array(roles == role))
                buf, offs = text_buffer(part.column("text"))
                for i, j in chunks(offs):
                    h, row = _tokens(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    have = open_.setdefault(role, [[], [], [], 0])
                    have[0].append(h)
                    have[1].append(np.bincount(row, minlength=j - i))
                    have[2].append([part.column(f"k{x}").slice(i, j - i) for x in range(kept_columns)])
                    have[3] += len(h)
                    if have[3] >= TOKENS:
                        yield out(role, *open_.pop(role)[:3])
        for role, have in open_.items():
            yield out(role, *have[:3])

    return run


class _Chunk:
    """One chunk: its words in the order of hashes, its tokens, its pairs in the order of theirs."""

    def __init__(self, row: dict) -> None:
        words = np.frombuffer(row["words"], np.uint64)
        order = np.argsort(words)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.words, self.at = words[order], place[_expand(row["ids"], row["n_tokens"])]
        self.word_n = np.bincount(self.at, minlength=len(words))
        # A document's last token is an end, the next one's context.
        before = np.r_[np.searchsorted(self.words, END), self.at[:-1]]
        both, self.pair, n = np.unique(before * len(words) + self.at, return_inverse=True, return_counts=True)
        u, w = both // len(words), both % len(words)
        keys = mix(self.words[u] * _FIRST + self.words[w])
        order = np.argsort(keys)
        self.pair_at = np.empty(len(keys), np.int64)
        self.pair_at[order] = np.arange(len(keys))
        self.pairs, self.pair_n, self.u, self.w = keys[order], n[order], u[order], w[order]


def _ask(word_parts: int, pair_parts: int):
    """What chunks ask for and tell: (part, chunk, role, keys, n), both packed; parts of
    words come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                c = _Chunk(row)
                for keys, n, parts, first in ((c.words, c.word_n, word_parts, 0), (c.pairs, c.pair_n, pair_parts, word_parts)):
                    part = _part_of(keys, parts)
                    begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                    step = np.diff(keys, prepend=np.uint64(0))
                    step[begin] = keys[begin] - _least_key(part[begin], parts)
                    ends, rows = np.r_[begin, len(keys)], len(begin)
                    cols = {"part": pa.array(part[begin].astype(np.int64) + first), "chunk": pa.array(np.full(rows, row["chunk"])), "role": pa.array(np.full(rows, row["role"], np.int32))}
                    yield pa.RecordBatch.from_pydict(cols | _packed("keys", step, ends) | _packed("n", n, ends))

    return run


def _answer(word_parts: int, pair_parts: int):
    """Rows sorted by part to (chunk, part, n, held, kinds): packed counts in all
    training documents and in held-out ones; kinds is, once a part, the number of its
    keys that training has."""

    def solve(rows: pa.RecordBatch) -> pa.RecordBatch:
        part = int(rows.column("part")[0].as_py())
        words = part < word_parts
        step, size = _unpack(rows, "keys")
        told, _ = _unpack(rows, "n")
        total = np.cumsum(step, dtype=np.uint64)
        before = np.r_[np.uint64(0), total][np.cumsum(size) - size]
        least = _least_key(np.array([part if words else part - word_parts]), word_parts if words else pair_parts)[0]
        _, at = np.unique(total - np.repeat(before, size) + least, return_inverse=True)
        role = np.repeat(rows.column("role").to_numpy(), size)
        n = np.bincount(at, told * (role != SCORED)).astype(np.int64)
        held = np.bincount(at, told * ((role == HELD) | (role == HELD_ONLY)), len(n)).astype(np.int64)
        kinds = np.zeros(rows.num_rows, np.int64)
        kinds[0] = np.count_nonzero(n)
        ends = np.r_[0, np.cumsum(size)]
        return pa.RecordBatch.from_pydict({"chunk": rows.column("chunk"), "part": rows.column("part")} | _packed("n", n[at], ends) | _packed("held", held[at], ends) | {"kinds": pa.array(kinds)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        for batch in batches:
            part = batch.column("part").to_numpy()
            cut = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)] if len(part) else np.zeros(1, int)
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if open_ and open_[0].column("part")[0].as_py() != part[i]:
                    yield solve(pa.concat_batches(open_))
                    open_ = []
                open_.append(batch.slice(i, j - i))
        if open_:
            yield solve(pa.concat_batches(open_))

    return run


def _counts(chunk: _Chunk, answers: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the chunk's words and pairs, then those in held-out documents."""
    rows = answers.take(pa.array(np.argsort(answers.field("part").to_numpy(), kind="stable")))
    n, held = (_unpack(rows, c)[0].astype(np.int64) for c in ("n", "held"))
    k = len(chunk.words)
    return n[:k], n[k:], held[:k], held[k:]


def _em(estimates: np.ndarray, weight: np.ndarray, bucket: np.ndarray, n_buckets: int) -> np.ndarray:
    """Mixture weights by bucket that fit the weighted events best; estimates: (events, parts)."""
    parts = estimates.shape[1]
    lam = np.full((n_buckets, parts), 1 / parts)
    for _ in range(ROUNDS):
        share = lam[bucket] * estimates
        share *= (weight / np.maximum(share.sum(1), 1e-300))[:, None]
        got = np.stack([np.bincount(bucket, share[:, p], n_buckets) for p in range(parts)], 1) + 1e-3
        lam = got / got.sum(1, keepdims=True)
    return lam


def _bucket(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(n + 1.0)[1] - 1, BUCKETS - 1)


def _estimates(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigram and unigram estimates, and the buckets of the contexts."""
    of = counts.sum(1)
    return counts / np.maximum(of, 1)[:, None], counts.sum(0) / max(1, counts.sum()), _bucket(of)


def interpolate(counts: np.ndarray, held: np.ndarray) -> np.ndarray:
    """log10 of P by (context, word) for a dense table of counts, small enough for memory."""
    k = len(counts)
    bi, uni, bucket = _estimates(counts - held)
    u, w = np.nonzero(held)
    lam = _em(np.stack([bi[u, w], uni[w], np.full(len(u), 1 / k)], 1), held[u, w], bucket[u], BUCKETS)
    bi, uni, bucket = _estimates(counts)
    lam = lam[bucket]
    return np.log10(lam[:, :1] * bi + lam[:, 1:2] * uni[None, :] + lam[:, 2:] / k)


def _cells(tokens: int):
    """(bucket, x, y, bi, uni, held): the held-out pairs of chunks, under the counts of
    the other training documents, ``tokens`` in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                c = _Chunk(batch.slice(r, 1).drop_columns("answers").to_pylist()[0])
                word, pair, word_held, pair_held = _counts(c, batch.column("answers")[r].values)
                word, pair = word - word_held, pair - pair_held
                bi, uni, bucket = pair / np.maximum(word[c.u], 1), word[c.w] / max(1, tokens), _bucket(word[c.u])
                step = lambda p: np.where(p > 0, np.floor(np.log(np.maximum(p, 1e-300)) * GRID), 1).astype(np.int64)
                cell, at = np.unique(np.stack([bucket, step(bi), step(uni)], 1), axis=0, return_inverse=True)
                sums = [np.bincount(at.ravel(), v * c.pair_n, len(cell)) for v in (bi, uni, np.ones(len(bi)))]
                yield pa.RecordBatch.from_arrays([*(pa.array(cell[:, k].astype(np.int64)) for k in range(3)), *map(pa.array, sums)], names=["bucket", "x", "y", "bi", "uni", "held"])

    return run


def _weights(joined: DataFrame, tokens: int, kinds: int) -> np.ndarray:
    """Weights of the three estimates by bucket, from (chunk, answers) of held-out chunks."""
    cells = joined.mapInArrow(_cells(tokens), "bucket long, x long, y long, bi double, uni double, held double")
    got = cells.groupBy("bucket", "x", "y").agg(*(F.sum(c).alias(c) for c in ("bi", "uni", "held"))).toArrow()
    bucket, bi, uni, held = (got.column(c).to_numpy() for c in ("bucket", "bi", "uni", "held"))
    order = np.lexsort((uni, bi, bucket))  # as tasks end in any order
    bucket, bi, uni, held = bucket[order], bi[order], uni[order], held[order]
    lam = _em(np.stack([bi / held, uni / held, np.full(len(bi), 1 / (kinds + 1))], 1), held, bucket, BUCKETS)
    lam[0, 0] = 0  # a context never seen
    lam[0] /= lam[0].sum()
    return lam


def _score(names: list[str], lam: np.ndarray, n_all: int, kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [n for n in names if n.startswith("k")]
            slim = batch.drop_columns(["answers", *kept])
            for r in range(batch.num_rows):
                row = slim.slice(r, 1).to_pylist()[0]
                c = _Chunk(row)
                word, pair, _, _ = _counts(c, batch.column("answers")[r].values)
                size = _expand(row["sizes"], row["n_docs"])
                doc = np.repeat(np.arange(len(size)), size)
                part = lam[_bucket(word[c.u])]
                value = np.log10(part[:, 0] * pair / np.maximum(word[c.u], 1) + part[:, 1] * word[c.w] / max(1, n_all) + part[:, 2] / (kinds + 1))
                base = np.log10((word + 0.1) / (n_all + 0.1 * (kinds + 1)))
                known = np.bincount(doc, word[c.at] > 0, len(size)).astype(np.int64)
                sums = [np.bincount(doc, v, len(size)) for v in (base[c.at], value[c.pair_at][c.pair])]
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[r].values for k in kept), *map(pa.array, (size, known, *sums))], names=names)

    return run


def score(docs: DataFrame, train: DataFrame | tuple[Column, Column], keep: tuple[str, ...] = ("doc_id", "held_out"), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with n_tokens, n_known, train_tokens, base_score and score.

    ``train``: the training documents (text, held), held marking those that the
    mixture weights are learned on; or two conditions on ``docs`` that say the same,
    which reads them once."""
    kept = [F.col(k).alias(f"k{x}") for x, k in enumerate(keep)]
    if isinstance(train, DataFrame):
        role = F.lit(SCORED)
        held = F.coalesce(F.col("held").cast("int"), F.lit(0)) != 0
        none = [F.lit(None).cast(docs.schema[k].dataType).alias(f"k{x}") for x, k in enumerate(keep)]
        more = train.select(F.when(held, HELD_ONLY).otherwise(LEARNED_ONLY).alias("role"), *none, F.col("text").alias("text"))
    else:
        learned, held = train
        role, more = F.when(F.coalesce(learned, F.lit(False)), F.when(F.coalesce(held, F.lit(False)), HELD).otherwise(LEARNED)).otherwise(SCORED), None
    rows = docs.select(role.alias("role"), *kept, F.col(text_col).alias("text"))
    rows = rows if more is None else rows.union(more)
    types = [docs.schema[k].dataType.simpleString() for k in keep]
    schema = "chunk long, role int, words binary, ids binary, sizes binary, n_tokens long, n_docs long, n_words long" + "".join(f", k{x} array<{t}>" for x, t in enumerate(types))
    table = materialize(rows.mapInArrow(_gather(len(keep)), schema), "op8-chunks")
    whole = lambda c, hit=None: F.coalesce(F.sum(F.when(hit, F.col(c)) if hit is not None else F.col(c)), F.lit(0))
    total = table.agg(whole("n_tokens").alias("tokens"), whole("n_words").alias("words"), whole("n_tokens", F.col("role") != SCORED).alias("n"), whole("n_tokens", F.col("role").isin(HELD, HELD_ONLY)).alias("held"), F.count("*").alias("chunks")).first()
    n_all = int(total["n"])
    word_parts, pair_parts = (max(1, -(-int(total[c]) // PART)) for c in ("words", "tokens"))
    packed = lambda *names: ", ".join(f"{n} binary, {n}_width int, {n}_more binary" for n in names)
    asked = table.select("chunk", "role", "words", "ids", "n_tokens").mapInArrow(_ask(word_parts, pair_parts), "part long, chunk long, role int, " + packed("keys", "n"))
    answers = asked.repartition(word_parts + pair_parts, "part").sortWithinPartitions("part").mapInArrow(_answer(word_parts, pair_parts), f"chunk long, part long, {packed('n', 'held')}, kinds long")
    answers = materialize(answers, "op8-answers")
    kinds = int(answers.filter(F.col("part") < word_parts).agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0])

    def joined(of: DataFrame, few: bool) -> DataFrame:
        """Chunks with their answers, about 8 chunks a task; ``few``: most are not asked for."""
        n = max(1, int(total["chunks"]) // 8)
        by = (answers.join(of.select("chunk"), "chunk", "left_semi") if few else answers).repartition(n, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("part", *(f"{c}{x}" for c in ("n", "held") for x in ("", "_width", "_more")))).alias("answers"))
        return of.repartition(n, "chunk").join(by, "chunk")

    lam = _weights(joined(table.filter(F.col("role").isin(HELD, HELD_ONLY)).select("chunk", "words", "ids", "n_tokens"), True), n_all - int(total["held"]), kinds)
    if not n_all:
        lam[:] = (0, 0, 1)
    names = [*(f"k{x}" for x in range(len(keep))), "n_tok", "n_seen", "base_score", "score"]
    own = table.filter(F.col("role") <= HELD).drop("role", "n_words")
    out = joined(own, False).mapInArrow(_score(names, lam, n_all, kinds), ", ".join(f"{a} {b}" for a, b in zip(names, [*types, "long", "long", "double", "double"], strict=True)))
    return out.select(*(F.col(f"k{x}").alias(k) for x, k in enumerate(keep)), F.col("n_tok").alias("n_tokens"), F.col("n_seen").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = crc_mod("doc_id", 10)
    return score(load(spark, sf_dir, "documents").withColumn("held_out", part == 0), (part != 0, part == 1))


QUERIES = {"op8_lm_score": op8_lm_score}
SQL: dict[str, str] = {}
