"""Operator 5: exact substring dedup over all texts as UTF-8 bytes.

Every 200-byte window has one anchor: its 32-byte gram of smallest hash (the
leftmost of equals).  Equal windows have equal anchors at the same place, so a
repeat can be looked for among the occurrences of one gram, and one gram in about
85 is an anchor of some window.  The windows of one anchor are consecutive and
make up its *extent* (at most 368 bytes).

1. Count (gram, extent) over the corpus, pre-aggregated by task, in one shuffle by
   gram.  An extent that occurs twice is a repeat as a whole; a gram that occurs
   once is none.  What is left are the edges of repeats: different extents around
   one gram.
2. Only there is a suffix array built, one a gram: the contexts from the gram on
   are sorted with their common prefixes, a stack scan yields the tree of
   common-prefix intervals, and within each interval the left contexts are sorted
   too.  An interval whose members differ in their left extension is a maximal
   repeat; each member is told the longest left extension it shares with any other
   member, not just with its neighbours, so every occurrence is covered.
   Grams with more than ``GROUP`` different extents are not gathered: their windows
   are counted by hash in Spark instead, which gives the same bytes.
3. Covered byte ranges are gathered by document and cut out.

Bitmaps of fixed size tell the second scan which anchors may matter; what passes
is joined exactly.  Grams and whole extents are compared by 64-bit hashes (128
bits together), edges byte by byte.

Defined results: null and empty texts, and texts under 200 bytes, lose nothing;
of repeated rows every one loses what it shares with another; a null id is a
value like any other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bitmap_has, bitmap_of, chunks, load, materialize, mix, prefix_sums, span_hash, text_buffer

LENGTH, GRAM, GROUP, BITS, FLUSH = 200, 32, 4096, 25, 1_000_000
PIECE = 1 << 22  # longer rows go through in pieces that overlap by LENGTH - 1 bytes
_W = LENGTH - GRAM + 1
_LOW = np.uint64((1 << 24) - 1)


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minima of all runs of w values, from running minima within blocks of w."""
    n = len(v) - w + 1
    pad = np.full(-len(v) % w, np.uint64(2**64 - 1))
    blocks = np.concatenate([v, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def _pieces(offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first byte, offsets): chunks of rows, or pieces of one long row."""
    for i, j in chunks(offs):
        if offs[j] - offs[i] <= PIECE + LENGTH:
            yield i, int(offs[i]), offs[i : j + 1] - offs[i]
            continue
        for at in range(int(offs[i]), int(offs[j]) - LENGTH + 1, PIECE):
            yield i, at, np.array([0, min(PIECE + LENGTH - 1, int(offs[j]) - at)])


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """gram hash, extent hash, row, extent start, extent end, anchor's offset in it."""
    none = np.empty(0, np.int64)
    if len(buf) < LENGTH:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    sums = prefix_sums(buf)
    at = np.arange(len(buf) - GRAM + 1)
    h = span_hash(sums, at, at + GRAM)
    anchor = (_window_min((h & ~_LOW) | at.astype(np.uint64), _W) & _LOW).astype(np.int64)
    inside = np.zeros(len(buf) + 1, np.int8)
    has = np.diff(offs) >= LENGTH
    np.add.at(inside, offs[:-1][has], 1)
    np.add.at(inside, offs[1:][has] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(inside)[: len(anchor)])
    if not len(start):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    p = anchor[start]
    first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (start[1:] != start[:-1] + 1)])
    lo, hi, p = start[first], start[np.r_[first[1:], len(start)] - 1] + LENGTH, p[first]
    extent = mix(span_hash(sums, lo, hi) ^ mix((p - lo).astype(np.uint64)))
    return h[p], extent, np.searchsorted(offs, lo, "right") - 1, lo, hi, p - lo


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        g, e = np.concatenate(grams), np.concatenate(extents)
        order = np.lexsort((e, g))
        g, e = g[order], e[order]
        first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (e[1:] != e[:-1])])
        return pa.RecordBatch.from_arrays([pa.array(g[first].view(np.int64)), pa.array(e[first].view(np.int64)), pa.array(np.diff(np.r_[first, len(g)]))], names=["gram", "extent", "n"])

    grams, extents, size = [], [], 0
    for batch in batches:
        buf, offs = text_buffer(batch.column("text"))
        for _, at, o in _pieces(offs):
            g, e, *_ = anchors(buf[at : at + o[-1]], o)
            grams.append(g)
            extents.append(e)
            size += len(g)
            if size >= FLUSH:
                yield out()
                grams, extents, size = [], [], 0
    if size:
        yield out()


def _class_hash(g: np.ndarray, e: np.ndarray) -> np.ndarray:
    return g ^ (e * np.uint64(2) + np.uint64(1))


def _post(whole, edge):
    """Rows (id, body, gram, extent, at, length, offset, context) of the anchors
    that the bitmaps let through; equal extents of one document share a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffer(batch.column("text"))
            for i, at, o in _pieces(offs):
                own = buf[at : at + o[-1]]
                g, e, row, lo, hi, off = anchors(own, o)
                c = _class_hash(g, e)
                context = bitmap_has(edge.value, c, BITS)
                ok = context | bitmap_has(whole.value, c, BITS)
                g, e, row, lo, hi, off, context = (x[ok] for x in (g, e, row, lo, hi, off, context))
                if not len(g):
                    continue
                order = np.lexsort((e, g, row))
                g, e, row, lo, hi, off, context = (x[order] for x in (g, e, row, lo, hi, off, context))
                first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (e[1:] != e[:-1]) | (row[1:] != row[:-1])])
                base = at - int(offs[i])  # of the piece in its row
                starts = pa.ListArray.from_arrays(np.r_[first, len(g)].astype(np.int32), pa.array(lo - o[row] + base))
                bodies = [own[a:b].tobytes() if x else None for a, b, x in zip(lo[first].tolist(), hi[first].tolist(), context[first].tolist(), strict=True)]
                rows = pa.array(row[first] + i)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(rows),
                        batch.column("body").take(rows),
                        pa.array(g[first].view(np.int64)),
                        pa.array(e[first].view(np.int64)),
                        starts,
                        pa.array((hi - lo)[first].astype(np.int32)),
                        pa.array(off[first].astype(np.int32)),
                        pa.array(bodies, pa.binary()),
                    ],
                    names=["id", "body", "gram", "extent", "at", "length", "offset", "context"],
                )

    return run


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def maximal_repeats(rights: list[bytes], lefts: list[bytes], least: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each occurrence of a gram the (left, right) extents, of ``least`` bytes
    in all, that it shares with another one.

    ``rights`` are the contexts from the gram on, ``lefts`` those before it,
    reversed.  The suffix array of the rights is scanned with a stack; each
    common-prefix interval is closed once, and its members' left contexts decide
    what repeats end there.
    """
    m = len(rights)
    order = sorted(range(m), key=rights.__getitem__)
    prefix = [_common(rights[order[i - 1]], rights[order[i]]) for i in range(1, m)] + [-1]
    longest = max(map(len, lefts))
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]

    def close(right: int, begin: int, end: int) -> None:
        if right + longest < least:
            return
        members = sorted(order[begin:end], key=lefts.__getitem__)
        shared = [0, *(_common(lefts[a], lefts[b]) for a, b in zip(members, members[1:], strict=False)), 0]
        for k, member in enumerate(members):
            left = max(shared[k], shared[k + 1])
            if left + right >= least:
                out[member].append((left, right))

    stack: list[tuple[int, int]] = []
    for i, value in enumerate(prefix, 1):
        begin = i - 1
        while stack and value < stack[-1][0]:
            right, begin = stack.pop()
            close(right, begin, i)
        if value >= 0 and (not stack or value > stack[-1][0]):
            stack.append((value, begin))
    return out


def _name(*parts: bytes) -> int:
    """A repeat's id: a hash of its bytes."""
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(p)
    return int.from_bytes(h.digest(), "little", signed=True)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of the documents at the edges of repeats; rows come sorted by key."""

    def solve(rows: list[dict]) -> list[tuple]:
        rights = [r["context"][r["offset"] :] for r in rows]
        lefts = [r["context"][: r["offset"]][::-1] for r in rows]
        got = []
        for r, spans in zip(rows, maximal_repeats(rights, lefts), strict=True):
            if r["single"]:
                p, k = r["at"] + r["offset"], r["offset"]
                got += [(r["id"], r["body"], p - left, p + right, _name(r["context"][k - left : k + right])) for left, right in set(spans)]
        return got

    def batch_of(got: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names=["id", "body", "lo", "hi", "repeat"])

    open_rows: list[dict] = []
    kinds = None
    for batch in batches:
        kinds = [batch.schema.field("id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        got: list[tuple] = []
        for r in batch.to_pylist():
            if open_rows and r["key"] != open_rows[0]["key"]:
                got += solve(open_rows)
                open_rows = []
            open_rows.append(r)
        if got:
            yield batch_of(got)
    if open_rows and (got := solve(open_rows)):
        yield batch_of(got)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of groups under the keys of both halves of low..high, as far as they hold a window there."""
    for batch in batches:
        rows, keys, lows, highs = [], [], [], []
        for r, (k, context, low, high) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("offset", "context", "low", "high")), strict=True)):
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle + 1, high)):
                if max(a, LENGTH - k) <= min(b, len(context) - k):
                    rows.append(r)
                    keys.append(_name(bytes((a, b)), context[k - (LENGTH - b) : k + a]))
                    lows.append(a)
                    highs.append(b)
        rest = batch.select(["id", "body", "at", "offset", "context", "single"]).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32()), *rest.columns], names=["key", "low", "high", *rest.schema.names])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = text_buffer(batch.column("text"))
        got = []
        for r in range(batch.num_rows):
            own = buf[offs[r] : offs[r + 1]]
            spans = batch.column("spans")[r].values
            if spans is None or not len(spans):
                got.append((len(own), 0, 0, hashlib.sha256(own.tobytes()).hexdigest()))
                continue
            lo, hi = spans.field("lo").to_numpy(), spans.field("hi").to_numpy()
            edge = np.zeros(len(own) + 1, np.int64)
            np.add.at(edge, lo, 1)
            np.add.at(edge, hi, -1)
            gone = np.cumsum(edge)[:-1] > 0
            runs = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1))
            got.append((len(own), int(gone.sum()), runs, hashlib.sha256(own[~gone].tobytes()).hexdigest()))
        cols = list(zip(*got, strict=True)) if got else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(id, body, lo, hi, repeat): byte ranges, overlapping, that repeats cover; ``body``
    is a hash of the text, which tells rows of one id apart.  ``repeat`` names the bytes
    of a range, so the occurrences of one repeat are told by one name; where an
    occurrence has a longer repeat around the same anchor, it is told by that one."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(docs[text_col], F.lit(""))
    by_gram = Window.partitionBy("gram")
    counts = docs.select(text.alias("text")).mapInArrow(_count, "gram long, extent long, n long")
    counts = counts.repartition("gram").groupBy("gram", "extent").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("kinds", F.count("*").over(by_gram)).withColumn("single", F.min("n").over(by_gram) == 1)
    counts = counts.filter((F.col("n") > 1) | (F.col("kinds") > 1))
    known = materialize(counts.select("gram", "extent", (F.col("n") > 1).alias("whole"), ((F.col("kinds") > 1) & F.col("single")).alias("edge"), (F.col("kinds") > group).alias("large")), "op5-repeats")
    hashed = known.select("whole", "edge", F.col("gram").bitwiseXOR(F.shiftleft("extent", 1).bitwiseOR(F.lit(1))).alias("c"))
    whole, edge = (spark.sparkContext.broadcast(bitmap_of(hashed.filter(k), "c", BITS)) for k in ("whole", "edge"))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("body"), text.alias("text"))
    posted = rows.mapInArrow(_post(whole, edge), f"id {kind}, body long, gram long, extent long, at array<long>, length int, offset int, context binary")
    posted = materialize(posted.join(known, ["gram", "extent"]), "op5-posted")
    wholes = posted.filter("whole").select("id", "body", "length", F.xxhash64("gram", "extent").alias("repeat"), F.explode("at").alias("lo")).select("id", "body", "lo", (F.col("lo") + F.col("length")).alias("hi"), "repeat")
    one = posted.filter("edge").groupBy("gram", "extent").agg(F.first("id").alias("id"), F.first("body").alias("body"), F.first(F.get("at", F.lit(0))).alias("at"), F.first("offset").alias("offset"), F.first("context").alias("context"), F.first("large").alias("large"), (~F.first("whole")).alias("single"))
    one = materialize(one, "op5-edges")
    own = ("id", "body", "at", "offset", "context", "single")
    solved = lambda rows: rows.repartition("key").sortWithinPartitions("key").select("key", *own).mapInArrow(_edges, f"id {kind}, body long, lo long, hi long, repeat long")
    one = one.select(F.col("gram").alias("key"), F.lit(GRAM).alias("low"), F.lit(LENGTH).alias("high"), *own, "large")
    out = wholes.union(solved(one.filter(~F.col("large"))))
    large = one.filter("large").drop("large")
    halves = f"key long, low int, high int, id {kind}, body long, at long, offset int, context binary, single boolean"
    while not large.isEmpty():  # at most 8 times, as low..high halves
        split = materialize(large.mapInArrow(_halves, halves), "op5-halves")
        sizes = split.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
        split = materialize(split.join(sizes, "key"), "op5-split")
        out = out.union(solved(split.filter(F.col("size") <= group)))
        large = split.filter(F.col("size") > group).drop("size")
        # A key that is a whole window: every member has it.
        p = F.col("at") + F.col("offset")
        ended = large.filter((F.col("low") == F.col("high")) & F.col("single"))
        out = out.union(ended.select("id", "body", (p - (LENGTH - F.col("low"))).alias("lo"), (p + F.col("low")).alias("hi"), F.col("key").alias("repeat")))
        large = large.filter(F.col("low") < F.col("high"))
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``."""
    spans = repeated_spans(docs, id_col, text_col, group)
    by_doc = spans.groupBy(F.col("id").alias("__op5_id"), F.col("body").alias("__op5_body")).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    by_doc = materialize(by_doc, "op5-spans")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("body"), text.alias("text"))
    joined = rows.join(by_doc, (F.col("body") == F.col("__op5_body")) & F.col("id").eqNullSafe(F.col("__op5_id")), "left").select("id", "text", "spans")
    return joined.mapInArrow(_cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: Every window of 200 bytes, as hexadecimal digits, by its hash (cut from blocks of 256 starts).
SQL_TEXT = """WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
z AS (SELECT rid, j, substr(h, 2 * j + 1, 910) AS x FROM (SELECT rid, h, unnest(range(0, len(h) // 2 - 199, 256)) AS j FROM d)),
w AS (SELECT rid, j + i AS i, md5_number(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT rid, j, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM z)),
s AS (SELECT rid, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) t USING (k)),
b AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM b),
r AS (SELECT rid, min(i) AS a, max(i) + 200 AS e FROM g GROUP BY rid, run),
q AS (SELECT rid, a, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY a), 0) AS was FROM r),
o AS (SELECT rid, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS upto, string_agg(substr(any_h, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) AS head
  FROM (SELECT q.*, d.h AS any_h FROM q JOIN d USING (rid)) GROUP BY rid)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(from_hex(coalesce(head, '') || substr(h, 2 * coalesce(upto, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN o USING (rid)"""

QUERIES = {"op5_substring_dedup": op5_substring_dedup}
SQL = {"op5_substring_dedup": SQL_TEXT}
