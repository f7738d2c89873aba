"""Operator 2: MinHash near-dedup by a signature-coordinate inverted join.

1. A document's set is its distinct 5-word shingles (hashed to 64 bits); equal
   sets are one class, so exact copies cost one row each and no pairs.
2. A class's signature has K coordinates; (coordinate, value) is one token.
   Tokens that only one class has can't match and are dropped, and so are classes
   left with fewer tokens than a link needs.
3. Prefix: a class posts only its rarest tokens, as many as it takes that two
   classes with ``t`` matches must meet in one of them.  ``t`` is the largest
   number of matches that a pair at the link threshold misses with probability
   below ``MISS`` (about one pair in ten million).
4. Merging skips: within a posting list every class meets the list's leader only,
   the class with the most common tokens; pairs with ``t`` collisions are confirmed
   on full sets.
   Links make components.  A second pass looks for links between components that
   one leader has, by an inverted join of the members' differences to the leader
   (see ``_second_pairs``); what it finds is confirmed on full sets too.  A group of
   m copies so costs about m pairs, not m^2, and no link is given up.

Defined results: null texts and texts without words have an empty set, no links,
and themselves as component; shorter texts have their whole word sequence as one
shingle; repeated rows are copies; a null id takes part in links but is never a
component's id unless the whole component has none; rows that repeat an id all
get that id's ``kept``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_has, bitmap_of, chunks, copy_rows, gram_hashes, hot_keys, load, materialize, mix, row_starts, split_rows, text_buffer, word_hashes
from .components import connected_components

SHINGLE, K, MISS, BITS = 5, 64, 1e-7, 24
#: A link: LINK[1] * intersection >= LINK[0] * union.
LINK = (85, 100)

_rng = np.random.default_rng(977)
_A = _rng.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, K, dtype=np.uint64)
_SALT = _rng.integers(0, 2**63, K, dtype=np.uint64)


def least_matches(k: int, similarity: float, miss: float = MISS) -> int:
    """The largest t with P(Binomial(k, similarity) < t) <= miss."""
    below, t = 0.0, 0
    while t < k and below + (p := comb(k, t) * similarity**t * (1 - similarity) ** (k - t)) <= miss:
        below, t = below + p, t + 1
    return max(1, t)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    h, row = word_hashes(buf, offs)
    g, at = gram_hashes(h, row, n)
    ends, begin = row_starts(row[at], len(offs) - 1), row_starts(row, len(offs) - 1)
    for r in range(len(offs) - 1):
        own = g[ends[r] : ends[r + 1]]
        if not len(own) and (m := begin[r + 1] - begin[r]):
            own, _ = gram_hashes(h[begin[r] : begin[r + 1]], np.zeros(m, np.int64), int(m))
        yield np.unique(own)


def signature(s: np.ndarray) -> np.ndarray:
    """The K tokens of a set: minima under K hash functions, each made its coordinate's own."""
    low = np.full(K, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 1024):
        x = _A[:, None] * s[None, i : i + 1024]
        x += _B[:, None]
        np.minimum(low, x.min(1), out=low)
    return mix(low ^ _SALT)


def _class_id(s: np.ndarray) -> bytes:
    """128 bits of a set, whatever its order."""
    one, two = mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64), mix(s * np.uint64(_BASE2)).sum(dtype=np.uint64)
    return one.tobytes() + two.tobytes()


_BASE2 = 0xC2B2AE3D27D4EB4F


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffer(batch.column("text"))
            for i, j in chunks(offs):
                sets = list(shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n))
                sigs = [signature(s) if len(s) else s for s in sets]
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(s) for s in sigs])].astype(np.int32), pa.array(np.concatenate(sigs).astype(np.uint64).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), batch.column("th").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_id(s) for s in sets], pa.binary()), lists], names=["id", "th", "n", "cid", "sig"]
                )

    return run


def _sets(n: int, shared):
    """(cid, set) of the rows whose class may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffer(batch.column("text"))
            for i, j in chunks(offs):
                got = [(_class_id(s), s) for s in shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n) if len(s)]
                first = np.array([int.from_bytes(c[:8], "big") for c, _ in got], np.uint64)
                got = [g for g, ok in zip(got, bitmap_has(shared.value, first, BITS), strict=True) if ok]
                if got:
                    lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(s) for _, s in got])].astype(np.int32), pa.array(np.concatenate([s for _, s in got]).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in got], pa.binary()), lists], names=["cid", "set"])

    return run


def _first_long(cid: Column) -> Column:
    """The first eight bytes of a class id, big-endian, as the long that the bitmap holds."""
    return F.conv(F.hex(F.substring(cid, 1, 8)), 16, -10).cast("long")


def _ends(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with the column of ``table`` for both ends.  An end of many
    pairs, such as the leader of a large group, has its pairs dealt over parts."""
    pairs = materialize(pairs.select("a", "b"), "op2-pairs")
    hot = {x: hot_keys(pairs, x, "op2-hot") for x in "ab"}
    for x, other in ("ab", "ba"):
        ends = copy_rows(table.select(F.col("cid").alias(x), F.col(column).alias(f"{column}_{x}")), hot[x], x)
        pairs = split_rows(pairs, hot[x], x, other).join(ends, [x, "part"]).drop("part")
    return pairs


def _is_link(t: int, link: tuple[int, int]) -> Column:
    """Enough collisions of the signatures, and then enough common shingles."""
    one, two = F.col("class_a.set"), F.col("class_b.set")
    both = F.size(F.array_intersect(one, two)).cast("long")
    return (F.size(F.array_intersect("class_a.tokens", "class_b.tokens")) >= t) & (both * link[1] >= (F.size(one) + F.size(two) - both) * link[0])


def _families(lists: DataFrame, sets: DataFrame, weights: DataFrame, t: int, link: tuple[int, int]) -> DataFrame:
    """(a, b, linked, n, apart): every class b of some list with that list's leader a,
    the class whose tokens are the most common; ``apart`` are the shingles that only
    one of the two has."""
    led = lists.join(weights, "cid").groupBy("token").agg(F.max_by("cid", F.struct("weight", "cid")).alias("a"))
    hot = hot_keys(lists, "token", "op2-hot")
    met = split_rows(lists, hot, "token", "cid").join(copy_rows(led, hot, "token"), ["token", "part"])
    pairs = _ends(met.filter(F.col("a") != F.col("cid")).select("a", F.col("cid").alias("b")).distinct(), sets, "class")
    apart = F.concat(F.array_except("class_a.set", "class_b.set"), F.array_except("class_b.set", "class_a.set"))
    return pairs.select("a", "b", _is_link(t, link).alias("linked"), F.size("class_b.set").alias("n"), apart.alias("apart"))


def _second_pairs(families: DataFrame, labels: DataFrame, link: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of different components that one leader has and that may be links.

    Two sets at distances X and Y from a leader differ by |X| + |Y| - 2 |X and Y|,
    and a link may differ by ``most`` = (1-j)/(1+j) * (|a| + |b|) only.  So what is
    joined are differences to the leader, again with a prefix: differences that no
    other member has can't match, and the bound on common ones says how many of the
    rarest a member must post.  Near copies of one text that edit it in different
    places share few differences, and make few pairs however many they are."""
    j = link[0] / link[1]
    slack = (1 - j) / (1 + j)
    mark = labels.withColumnRenamed("v", "b")
    f = families.join(mark, "b", "left").select("a", "b", "n", "apart", F.coalesce("label", "b").alias("label"))
    open_ = f.groupBy("a").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter(F.col("low") != F.col("high")).select("a")
    hot = hot_keys(families, "a", "op2-hot")
    f = split_rows(f, hot, "a", "b").join(copy_rows(open_, hot, "a"), ["a", "part"])
    f = materialize(f.select(F.xxhash64("a").alias("family"), F.xxhash64("a", "b").alias("member"), "b", "n", "apart", "label"), "op2-open")
    each = f.select("family", "member", F.explode("apart").alias("shingle"))
    common = each.groupBy("family", "shingle").agg(F.count("*").alias("df")).filter(F.col("df") > 1)
    got = each.join(common, ["family", "shingle"]).groupBy("family", "member").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("x"))
    got = got.join(f.select("member", "b", "n", "label", F.size("apart").alias("size")), "member")
    # Of a partner at most n / j long, and of |Y| >= common: common >= |X| - most.
    need = F.greatest(F.lit(1), F.ceil(F.col("size") - slack * F.col("n") * (1 + 1 / j) - 1e-6).cast("int"))
    got = got.withColumn("need", need).filter(F.size("x") >= F.col("need"))
    got = materialize(got.select("family", "b", "n", "label", "size", F.size("x").alias("shared"), F.transform(F.slice("x", 1, F.size("x") - F.col("need") + 1), lambda e: e["shingle"]).alias("prefix")), "op2-differences")
    side = lambda s: got.select("family", F.explode("prefix").alias("shingle"), *(F.col(c).alias(f"{c}_{s}") for c in ("b", "n", "label", "size", "shared", "prefix")))
    one, two = side("x"), side("y")
    # Both prefixes are in one order, so a pair is joined once, at its first common difference.
    first = F.get(F.array_intersect("prefix_x", "prefix_y"), F.lit(0)) == one["shingle"]
    unique = F.col("size_x") - F.col("shared_x") + F.col("size_y") - F.col("shared_y")
    close = unique + F.abs(F.col("shared_x") - F.col("shared_y")) <= slack * (F.col("n_x") + F.col("n_y")) + 1e-6
    joined = one.join(two, (one["family"] == two["family"]) & (one["shingle"] == two["shingle"]) & (F.col("label_x") != F.col("label_y")) & (F.col("b_x") < F.col("b_y")) & close & first)
    return joined.select(F.col("b_x").alias("a"), F.col("b_y").alias("b")).distinct()


def _components(docs: DataFrame, id_col: str, text_col: str, link: tuple[int, int], shingle: int) -> DataFrame:
    """(id, th, cid, n, component_id, label) of every row of ``docs``: th is its text's
    hash, and label names its component by a class."""
    spark = docs.sparkSession
    t = least_matches(K, link[0] / link[1])
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    signed = materialize(rows.mapInArrow(_sign(shingle), f"id {kind}, th long, n long, cid binary, sig array<long>"), "op2-signatures")
    some = signed.filter(F.col("n") > 0)
    classes = materialize(some.groupBy("cid").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "op2-classes")

    tokens = classes.select("cid", F.explode("sig").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") > 1)
    kept = tokens.join(shared, "token").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("x")).filter(F.size("x") >= t)
    kept = materialize(kept, "op2-tokens")
    lists = kept.select("cid", F.explode(F.slice("x", 1, F.size("x") - (t - 1))).alias("x")).select("cid", F.col("x.token").alias("token"))
    weights = kept.select("cid", F.aggregate("x", F.lit(0).cast("long"), lambda w, e: w + e["df"]).alias("weight"))

    bits = bitmap_of(lists.select(_first_long(F.col("cid")).alias("h")).distinct(), "h", BITS)
    sets = rows.mapInArrow(_sets(shingle, spark.sparkContext.broadcast(bits)), "cid binary, set array<long>")
    tokens_of = kept.select("cid", F.transform("x", lambda e: e["token"]).alias("tokens"))
    sets = sets.groupBy("cid").agg(F.first("set").alias("set")).join(tokens_of, "cid")
    sets = materialize(sets.select("cid", F.struct("set", "tokens").alias("class")), "op2-sets")

    families = materialize(_families(lists, sets, weights, t, link), "op2-families")
    edges = families.filter("linked").select("a", "b")
    labels = connected_components(edges)
    pairs = _ends(_second_pairs(families, labels, link), sets, "class")
    more = materialize(pairs.filter(_is_link(t, link)).select("a", "b"), "op2-edges")
    if not more.isEmpty():
        labels = connected_components(edges.union(more))

    named = classes.select("cid", "id").join(labels.withColumnRenamed("v", "cid"), "cid")
    roots = named.groupBy("label").agg(F.min("id").alias("component_id"))
    hot = hot_keys(labels, "label", "op2-hot")
    linked = split_rows(named, hot, "label", "cid").join(copy_rows(roots, hot, "label"), ["label", "part"]).select("cid", "component_id", "label")
    known = classes.select("cid", "id").join(linked, "cid", "left").select("cid", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("label", "cid").alias("label"))
    by_class = materialize(known, "op2-components")
    hot = hot_keys(some, "cid", "op2-hot")
    out = split_rows(signed.select("id", "th", "n", "cid"), hot, "cid", "id", "th").join(copy_rows(by_class, hot, "cid"), ["cid", "part"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "th", "cid", "n", component.alias("component_id"), "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: tuple[int, int] = LINK, shingle: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``."""
    component = F.col("component_id")
    return _components(docs, id_col, text_col, link, shingle).select("id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: tuple[int, int] = LINK) -> DataFrame:
    """``docs`` with one row of every group of near duplicates: that of the smallest id,
    of its texts the one of the smallest hash, and of equal rows one.  Texts without
    words are in no group and stay."""
    key = ["__op2_id", "__op2_th"]
    found = _components(docs, id_col, text_col, link, SHINGLE).filter(F.col("n") > 0).groupBy("id", "th", "label").agg(F.count("*").alias("rows"))
    found = materialize(found, "op2-rows")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first"))
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    hot = hot_keys(found, "label", "op2-hot")
    met = split_rows(found, hot, "label", "id", "th").join(copy_rows(first, hot, "label"), ["label", "part"])
    marks = met.select(F.col("id").alias(key[0]), F.col("th").alias(key[1]), stays.alias("__op2_stays"), "rows")
    gone = materialize(marks.filter(~F.col("__op2_stays")).select(key), "op2-gone")
    again = materialize(marks.filter(F.col("__op2_stays") & (F.col("rows") > 1)).select(key), "op2-again")
    # A bitmap of fixed size tells most rows that they stay, so only the others' texts are joined.
    marked = gone.union(again)
    row = lambda i, t: F.xxhash64(i, t)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(marked.select(row(*map(F.col, key)).alias("h")), "h", BITS))

    def split(asked: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = bitmap_has(shared.value, batch.column("__op2_h").to_numpy().view(np.uint64), BITS)
                yield batch.drop_columns(["__op2_h"]).filter(pa.array(hit == asked))

        return docs.withColumn("__op2_h", row(F.col(id_col), F.xxhash64(F.col(text_col)))).mapInArrow(run, docs.schema)

    few = materialize(split(True), "op2-asked")
    same = few[id_col].eqNullSafe(F.col(key[0])) & (F.xxhash64(few[text_col]) == F.col(key[1]))
    left = few.join(marked, same, "left_anti")
    one = few.join(again, same).dropDuplicates(key).select(*(few[c] for c in few.columns))
    return split(False).union(left).union(one)


#: Exact Jaccard similarities of all texts that share a shingle, and their closure.
SQL_TEXT = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS x FROM d),
k AS (SELECT doc_id, len(x) AS n, md5(array_to_string(x, chr(10))) AS c, x FROM s),
c AS (SELECT c, any_value(n) AS n, any_value(x) AS x, min(doc_id) AS low FROM k WHERE n > 0 GROUP BY c),
e AS (SELECT c, n, unnest(x) AS g FROM c),
p AS (SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.g = b.g AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT c, c FROM c UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
m AS (SELECT r.a AS c, min(c.low) AS component_id FROM r JOIN c ON r.b = c.c GROUP BY r.a)
SELECT doc_id, n AS n_shingles, CASE WHEN n > 0 THEN component_id ELSE doc_id END AS component_id, n = 0 OR doc_id = component_id AS kept FROM k LEFT JOIN m USING (c)"""

QUERIES = {"op2_near_dup": op2_near_dup}
SQL = {"op2_near_dup": SQL_TEXT}
