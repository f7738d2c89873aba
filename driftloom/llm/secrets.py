"""Operator 1: secret scan through a trigram inverted index, DataFrame functions only.

1. Each rule's regex gives a Boolean trigram query (:mod:`.trigram`).
2. Every text posts the trigrams of these queries that it holds: rows
   (trigram, document), the inverted index restricted to trigrams that any query
   can ask for, so its size follows the texts that hold them.
3. Postings are intersected: one row a document with its trigrams as bits, on
   which every rule's query is evaluated.  What passes is a candidate.
4. Candidates are joined back and verified by the regex on the whole text.
   Rules without a mandatory trigram (``hex``) scan every text instead.

The candidates are written to the shared folder first: the planner then knows
their size and broadcasts them only if they are small, else shuffles both sides.

Defined results: a null text counts as empty; an empty table gives no rows; a
repeated row is scanned like any other and comes out as often as it came in; a
null id is looked up by its text; other columns of the input pass through
:func:`redact` untouched, and the helper columns carry names no table has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trigram
from .common import load, materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, leftmost, not overlapping, of
    which those whose group 1 is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    least: int = 0


#: The three base kinds come first; the order settles ties of start.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    # To its END line, or over up to 60 base64 lines that follow if there is none (both engines bound the product of repetitions).
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]*-----END [A-Z ]{0,40}PRIVATE KEY-----|(?:[\x20\x09-\x0D]+[A-Za-z0-9+/=]{16,}){0,60})"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url", r"[a-z][a-z0-9+.-]{0,20}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/@]+@"),
)
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:int,kind:int,stop:int>>"
WORD = 62  # postings kept in one long of bits
BLOCK, PIECE = 128, 8192  # items folded at once; characters cut from at once
KEY, SPANS = "__op1_key", "__op1_spans"


def _holds(q, index: dict[str, int]) -> Column:
    """A rule's query on the posting bits."""
    if isinstance(q, str):
        i = index[q]
        return F.col(f"__op1_b{i // WORD}").bitwiseAND(F.lit(1 << (i % WORD))) != 0
    op, parts = q
    cols = [_holds(x, index) for x in sorted(parts, key=str)]
    out = cols[0]
    for c in cols[1:]:
        out = (out & c) if op == "and" else (out | c)
    return out


def _key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.coalesce(docs[id_col].cast("long"), F.xxhash64(docs[text_col]))


def postings(docs: DataFrame, id_col: str, text_col: str, wanted: list[str]) -> DataFrame:
    """The inverted index: (posting, key), posting numbering ``wanted``."""
    low = F.lower(docs[text_col])
    # Written as text and split, as a filter over an array would leave generated code and lower the text once a trigram.
    held = F.concat_ws(",", *(F.when(F.contains(low, F.lit(t)), F.lit(str(i))) for i, t in enumerate(wanted)))
    some = docs.select(_key(docs, id_col, text_col).alias(KEY), held.alias("held")).filter(F.col("held") != "")
    return some.select(KEY, F.explode(F.split("held", ",").cast("array<int>")).alias("posting"))


def candidates(docs: DataFrame, id_col: str, text_col: str, rules=RULES) -> DataFrame:
    """(key, rules as bits) of the documents whose postings satisfy some rule."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram.query(r.pattern)) is not True}
    wanted = sorted(set().union(*map(trigram.trigrams, queries.values())))
    index = {t: i for i, t in enumerate(wanted)}
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("posting") % WORD)
    merged = (
        postings(docs, id_col, text_col, wanted)
        .groupBy(KEY)
        .agg(*(F.coalesce(F.bit_or(F.when(F.floor(F.col("posting") / WORD) == w, bit)), F.lit(0).cast("long")).alias(f"__op1_b{w}") for w in range(len(wanted) // WORD + 1)))
    )
    mask = F.lit(0).cast("long")
    for i, q in queries.items():
        mask = mask.bitwiseOR(F.when(_holds(q, index), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return merged.select(KEY, mask.alias("__op1_rules")).filter(F.col("__op1_rules") != 0)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once, even if lambdas use it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(items: Column, op) -> Column:
    """For each item the fold of all before it, from 0.  Blocks of ``BLOCK`` items bound
    what is copied, so time is linear."""
    block = lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK))
    begin = lambda at: F.struct(at.cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
    note = lambda acc, to: F.struct(to.alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    total = lambda b: F.aggregate(block(b), F.lit(0).cast("long"), op)
    blocks = F.sequence(F.lit(0), F.ceil(F.size(items) / BLOCK).cast("int") - 1)
    starts = F.aggregate(blocks, begin(F.lit(0)), lambda acc, b: note(acc, op(acc["at"], total(b))), lambda acc: acc["out"])
    within = lambda at, b: F.aggregate(block(b), begin(at), lambda acc, x: note(acc, op(acc["at"], x)), lambda acc: acc["out"])
    return F.when(F.size(items) == 0, F.array().cast("array<long>")).otherwise(F.flatten(F.transform(starts, within)))


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """A rule's spans in one text: lengths of the matches and of what lies between,
    added up."""
    none = F.array().cast(SPAN)

    def placed(found: Column, gaps: Column) -> Column:
        gap = F.transform(gaps, F.char_length)
        sizes = F.transform(found, lambda m, i: (F.char_length(F.get(gaps, i)) + F.char_length(m)).cast("long"))

        def put(at: Column, gap: Column) -> Column:
            start = lambda i: (F.get(at, i) + F.get(gap, i)).cast("int")
            spans = F.transform(found, lambda m, i: F.when(F.length(F.regexp_extract(m, rule.pattern, 1)) >= rule.least if rule.least else F.lit(True), F.struct(start(i).alias("start"), F.lit(number).alias("kind"), (start(i) + F.char_length(m)).alias("stop"))))
            return F.filter(spans, lambda s: s.isNotNull()) if rule.least else spans

        return _let(_let(sizes, lambda s: _before(s, lambda a, b: a + b)), lambda at: _let(gap, lambda g: put(at, g)))

    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    return _let(found, lambda f: F.when(F.size(f) > 0, _let(F.split(text, rule.pattern, -1), lambda gaps: placed(f, gaps))).otherwise(none))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with the column SPANS: every rule's spans by start, then kind."""
    found = materialize(candidates(docs, id_col, text_col, rules), "op1-candidates")
    text = F.coalesce(docs[text_col], F.lit(""))
    joined = docs.withColumn(KEY, _key(docs, id_col, text_col)).join(found, KEY, "left")
    parts = []
    for i, r in enumerate(rules):
        asked = F.lit(True) if trigram.query(r.pattern) is True else F.col("__op1_rules").bitwiseAND(F.lit(1 << i)) != 0
        parts.append(F.when(asked, _spans(text, i, r)).otherwise(F.array().cast(SPAN)))
    return joined.select(*(docs[c] for c in docs.columns), F.array_sort(F.concat(*parts)).alias(SPANS))


def _joined(spans: Column, rules=RULES) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(load(spark, sf_dir, "documents"))
    spans = F.col(SPANS)
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = _joined(F.filter(spans, lambda s: s["kind"] < len(BASE)))
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)), F.sha2(base, 256).alias("base_sha256"), _joined(spans).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span of its text replaced by ``mark``;
    overlapping spans count as one.  A text without secrets stays as it is."""
    found = find_secrets(docs, id_col, text_col)
    text, spans = F.col(text_col), F.col(SPANS)

    def clean(pieces: Column, reach: Column, end: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            """Characters a to b, from the pieces that hold them."""
            own = lambda p: F.substring(F.get(pieces, p), (F.greatest(a - p * PIECE, F.lit(0)) + 1).cast("int"), (F.least(b - p * PIECE, F.lit(PIECE)) - F.greatest(a - p * PIECE, F.lit(0))).cast("int"))
            return F.when(b > a, F.array_join(F.transform(F.sequence(F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")), own), "")).otherwise("")

        kept = F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(reach, i), F.concat(cut(F.get(reach, i), s["start"].cast("long")), F.lit(mark))).otherwise(""))
        return F.array_join(F.concat(kept, F.array(cut(end, F.char_length(text).cast("long")))), "")

    stops = F.transform(spans, lambda s: s["stop"].cast("long"))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    done = _let(pieces, lambda p: _let(_let(stops, lambda s: _before(s, lambda a, b: F.greatest(a, b))), lambda r: clean(p, r, F.array_max(stops))))
    return found.select(*(F.when(F.size(SPANS) > 0, done).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns))


def _sql() -> str:
    """The same spans in DuckDB, by scanning every text with every rule."""
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        keep = f"length(regexp_extract(m, '{p}', 1)) >= {r.least}" if r.least else "true"
        parts.append(
            f"""SELECT rid, {i} AS kind, s AS start, s + length(m) AS stop FROM (
  SELECT rid, unnest(list_transform(range(1, len(found) + 1), lambda i: found[i])) AS m,
         unnest(list_transform(range(1, len(found) + 1), lambda i: coalesce(list_sum(list_transform(apart[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0)))::BIGINT AS s
  FROM (SELECT rid, regexp_extract_all(text, '{p}') AS found, regexp_split_to_array(text, '{p}') AS apart FROM d) WHERE len(found) > 0) WHERE {keep}"""
        )
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    item = f"({kinds})[kind + 1] || ':' || start || ':' || stop"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg({item}, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg({item}, ',' ORDER BY start, kind) AS spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""


QUERIES = {"op1_secret_scan": op1_secret_scan}
SQL = {"op1_secret_scan": _sql()}
