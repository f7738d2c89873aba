"""Operator 9: benchmark decontamination by greedy string tiling.

Tokens are runs of ASCII letters and digits or non-ASCII bytes, A-Z lowered.  A
seed is the hash of ``SEED_TOKENS`` tokens in a row (of all of them in a shorter
item).

1. The items' seeds (item, position) are a written table, and a bitmap of fixed
   size (``BITS``) over them lets the scan of the documents post only seeds that
   some item may hold.
2. Posted seeds are joined with the items' seeds (the planner broadcasts those
   only if they are small): the common seeds are the Karp-Rabin hits of the tiling's
   minimum match length.  Hits on one diagonal in a row are a match, and matches are
   gathered by (document, item).
3. Greedy string tiling: the longest match whose tokens are free on both sides becomes a tile, and what a tile cuts
   off goes back into the queue, until no match of the least length is left.
   Tiles may lie in any order, so reordered passages count.
4. A document is contaminated by an item of whose tokens the tiles cover at
   least ``COVERAGE``.

Defined results: null or empty texts and items match nothing; an empty table
gives no rows (an empty benchmark: nothing is contaminated); of repeated
documents each row has its own result, of repeated item ids with different texts
each counts as an item; items with a null id are searched and listed last as
null; ties between matches go to the earlier place in document, then item.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bitmap_has, bitmap_of, chunks, gram_hashes, load, materialize, prefix_sums, row_starts, span_hash, text_buffer, words

SEED_TOKENS, COVERAGE, BITS = 5, 0.5, 24
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, row = words(buf, offs, _APART)
    return span_hash(prefix_sums(buf, lower=True), s, e), row


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = text_buffer(batch.column("text"))
        for r in range(batch.num_rows):
            own = buf[offs[r] : offs[r + 1]]
            h, row = _tokens(own, np.array([0, len(own)]))
            n = min(SEED_TOKENS, len(h))
            if n:
                g, at = gram_hashes(h, row, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), batch.column("item").take(pa.array(np.full(len(g), r))), pa.array(at.astype(np.int32)), pa.array(np.full(len(g), n, np.int32)), pa.array(np.full(len(g), len(h), np.int32)), pa.array(np.full(len(g), span_hash(prefix_sums(own), np.array([0]), np.array([len(own)]))[0]).view(np.int64))],
                    names=["seed", "item", "ipos", "n", "tokens", "body"],
                )


def tile(dpos: np.ndarray, ipos: np.ndarray, n: int, tokens: int) -> int:
    """Item tokens that greedy string tiling covers, from the hits of length n."""
    order = np.lexsort((dpos, dpos - ipos))
    d, i = dpos[order], ipos[order]
    fresh = np.flatnonzero(np.r_[True, (d[1:] - d[:-1] != 1) | (i[1:] - i[:-1] != 1)])
    return tile_matches(d[fresh], i[fresh], np.diff(np.r_[fresh, len(d)]) + n - 1, n, tokens)


def tile_matches(dpos: np.ndarray, ipos: np.ndarray, length: np.ndarray, n: int, tokens: int) -> int:
    """The same from maximal matches: runs of hits on one diagonal."""
    queue = [(-int(k), int(a), int(b)) for k, a, b in zip(length, dpos, ipos, strict=True)]
    heapq.heapify(queue)
    low = int(dpos.min())
    doc, item = np.zeros(int((dpos + length).max()) - low, bool), np.zeros(tokens, bool)
    while queue:
        k, a, b = heapq.heappop(queue)
        k = -k
        taken = doc[a - low : a - low + k] | item[b : b + k]
        if not taken.any():
            doc[a - low : a - low + k] = True
            item[b : b + k] = True
            continue
        edge = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
        for x, y in zip(edge[::2], edge[1::2], strict=True):
            if y - x >= n:
                heapq.heappush(queue, (-int(y - x), a + int(x), b + int(x)))
    return int(item.sum())


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = []
        for r, (n, t) in enumerate(zip(batch.column("n").to_pylist(), batch.column("tokens").to_pylist(), strict=True)):
            runs = batch.column("runs")[r].values
            got.append(tile_matches(*(runs.field(c).to_numpy().astype(np.int64) for c in ("dpos", "ipos", "length")), n, t) / t)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "body", "item")), pa.array(got, pa.float64())], names=["id", "body", "item", "coverage"])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> tuple[DataFrame, DataFrame]:
    """(id, body) of every document row, and (id, body, item, coverage) of every
    contaminated pair; ``body`` is a hash of the text, which tells rows of one id apart."""
    spark = docs.sparkSession
    source = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    kind = source.schema["item"].dataType.simpleString()
    seeds = materialize(source.mapInArrow(_item_seeds, f"seed long, item {kind}, ipos int, n int, tokens int, body long"), "op9-seeds")
    lengths = sorted(r["n"] for r in seeds.select("n").distinct().collect())  # 1 to SEED_TOKENS
    shared = spark.sparkContext.broadcast(bitmap_of(seeds, "seed", BITS))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            buf, offs = text_buffer(batch.column("text"))
            at_row, at_pos, found = [], [], []
            for i, j in chunks(offs):
                h, row = _tokens(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                begin = row_starts(row, j - i)
                for n in lengths:
                    g, at = gram_hashes(h, row, n)
                    ok = bitmap_has(bits, g, BITS)
                    at = at[ok]
                    at_row.append(row[at] + i)
                    at_pos.append((at - begin[row[at]]).astype(np.int32))
                    found.append(g[ok])
            rows, pos, g = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (at_row, at_pos, found))
            order = np.argsort(rows, kind="stable")
            ends = pa.array(row_starts(rows[order], batch.num_rows).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (pos[order].astype(np.int32), g[order].astype(np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("body"), *lists], names=["id", "body", "pos", "seed"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text"))
    posted = materialize(rows.mapInArrow(post, f"id {id_kind}, body long, pos array<int>, seed array<long>"), "op9-posted")
    hits = posted.filter(F.size("seed") > 0).distinct().select("id", "body", F.explode(F.arrays_zip("pos", "seed")).alias("x")).select("id", "body", F.col("x.pos").alias("dpos"), F.col("x.seed").alias("seed"))
    by = ["id", "body", "item", "item_body", "n", "tokens"]
    # Hits on one diagonal in a row are one match: what is gathered are matches, not hits.
    joined = hits.join(seeds.withColumnRenamed("body", "item_body"), "seed").withColumn("diagonal", F.col("dpos") - F.col("ipos"))
    place = F.row_number().over(Window.partitionBy(*by, "diagonal").orderBy("dpos"))
    runs = joined.withColumn("run", F.col("dpos") - place).groupBy(*by, "diagonal", "run").agg(F.min("dpos").alias("dpos"), F.min("ipos").alias("ipos"), (F.count("*").cast("int") + F.col("n") - 1).alias("length"))
    pairs = runs.groupBy(*by).agg(F.collect_list(F.struct("dpos", "ipos", "length")).alias("runs"), F.sum("length").alias("most"))
    # Tiles cover no more tokens than the matches have: what can't reach the threshold needs no tiling.
    pairs = pairs.filter(F.col("most") >= F.col("tokens") * F.lit(coverage))
    out = pairs.mapInArrow(_tile, f"id {id_kind}, body long, item {kind}, coverage double").filter(F.col("coverage") >= coverage)
    return posted.select("id", "body"), out


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: contaminated, its items and the largest coverage."""
    rows, pairs = contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    by_doc = pairs.groupBy("id", "body").agg(F.max("coverage").alias("coverage"), F.array_sort(F.collect_set("item")).alias("item_ids"))
    same = rows["id"].eqNullSafe(by_doc["id"]) & (rows["body"] == by_doc["body"])
    joined = rows.join(by_doc, same, "left")
    none = F.array().cast(by_doc.schema["item_ids"].dataType)
    return joined.select(rows["id"].alias("doc_id"), F.col("coverage").isNotNull().alias("contaminated"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("item_ids", none).alias("item_ids"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that some item contaminates."""
    _, pairs = contaminated(docs, items, id_col, text_col)
    bad = materialize(pairs.select(F.col("id").alias("__op9_id"), F.col("body").alias("__op9_body")).distinct(), "op9-found")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__op9_id"]) & (F.xxhash64(docs[text_col]) == bad["__op9_body"]), "left_anti")


QUERIES = {"op9_decontaminate": op9_decontaminate}
SQL: dict[str, str] = {}
