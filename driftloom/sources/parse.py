"""Text to events: clean, resilient, CSV and JSON-array parsing, all by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The longest line, and patterns of the fallbacks.
MAX_LINE = 65_536
EMBEDDED = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)?\}"
PAIR = r'"([^"]{1,60})"\s*:\s*("(?:[^"\\]|\\.)*"|-?\d+\.?\d*|true|false|null)'
DELIMITERS = (",", "\t", ";", "|")


def _object(text: Column) -> Column:
    v = F.try_parse_json(text)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def _keys(v: Column) -> Column:
    return F.size(F.map_keys(v.try_cast("map<string,variant>")))


def resilient(df: DataFrame, line: str = "line") -> DataFrame:
    """``df`` with v and parse_conf: 1.0 a JSON object, 0.7 one inside other text
    (two keys at least), 0.5 two or more "key": value pairs, 0.0 nothing.

    Lines over 64 KiB are not tried.  Text with repeated keys or NaN is not JSON
    here and goes down the ladder."""
    t = F.trim(F.col(line))
    ok = (F.length(t) > 0) & (F.length(t) <= MAX_LINE)
    out = df.withColumn("__clean", F.when(ok, _object(t)))
    inner = _object(F.regexp_extract(t, f"({EMBEDDED})", 1))
    out = out.withColumn("__inner", F.when(ok & F.col("__clean").isNull(), F.when(_keys(inner) >= 2, inner)))
    names, values = F.regexp_extract_all(t, F.lit(PAIR), F.lit(1)), F.regexp_extract_all(t, F.lit(PAIR), F.lit(2))
    # The last of equal names counts.
    last = F.filter(F.transform(names, lambda n, i: F.struct(n.alias("n"), F.get(values, i).alias("v"), i.alias("i"))), lambda x: x["i"] == F.size(names) - 1 - F.array_position(F.reverse(names), x["n"]).cast("int") + 1)
    json = F.concat(F.lit("{"), F.array_join(F.transform(last, lambda x: F.concat(F.lit('"'), F.replace(x["n"], F.lit("\\"), F.lit("\\\\")), F.lit('":'), x["v"])), ","), F.lit("}"))
    pairs = F.try_parse_json(json)
    out = out.withColumn("__pairs", F.when(ok & F.col("__clean").isNull() & F.col("__inner").isNull(), F.when(F.size(last) >= 2, pairs)))
    conf = F.when(F.col("__clean").isNotNull(), 1.0).when(F.col("__inner").isNotNull(), 0.7).when(F.col("__pairs").isNotNull(), 0.5).otherwise(0.0)
    return out.withColumn("v", F.coalesce("__clean", "__inner", "__pairs")).withColumn("parse_conf", conf).drop("__clean", "__inner", "__pairs")


def parse_stats(parsed: DataFrame, line: str = "line") -> DataFrame:
    """Lines (but for too long ones), clean, partial and skipped ones."""
    long = F.length(F.col(line)) > MAX_LINE
    blank = F.length(F.trim(F.col(line))) == 0
    c = F.col("parse_conf")
    return parsed.filter(~blank).agg(F.count_if(~long).alias("total_lines"), F.count_if(c == 1.0).alias("parsed_clean"), F.count_if((c > 0) & (c < 1)).alias("parsed_partial"), F.count_if(c == 0).alias("skipped"))


def split_by_quality(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parsed.filter("parse_conf = 1.0"), parsed.filter("parse_conf > 0 and parse_conf < 1")


def read_lines(spark: SparkSession, folder: str, pattern: str = "*.{ndjson,json,jsonl}") -> DataFrame:
    """(line, seq): lines of all files below a folder in the order of path and place.

    ``seq`` packs the file's rank and the line's own order; files whose names start
    with ``._`` are left out."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder)
    rows = text.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    rows = rows.filter(~F.element_at(F.split("file", "/"), -1).startswith("._") & (F.length(F.trim("line")) > 0))
    # The rank within one file's block, then offsets of the (few) blocks: no global sort of lines.
    w = Window.partitionBy("file", "block").orderBy("place")
    rows = rows.withColumn("i", F.row_number().over(w))
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(blocks.select("file", "block", before.alias("before")), ["file", "block"]).select("line", (F.col("before") + F.col("i") - 1).alias("seq"), "file")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, raw, v): one JSON object a line; other lines are dropped."""
    rows = read_lines(spark, folder).select("seq", F.col("line").alias("raw"))
    return rows.withColumn("v", _object(F.col("raw"))).filter(F.col("v").isNotNull())


def read_events_resilient(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(parsed lines, statistics)."""
    p = resilient(read_lines(spark, folder))
    return p.filter("parse_conf > 0"), parse_stats(p)


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, v): files that are a JSON array give its elements, others their lines."""
    whole = spark.read.option("wholetext", "true").text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))
    array = F.ltrim("text").startswith("[")
    v = F.try_parse_json("text")
    items = whole.select("file", F.explode(F.when(array, v.try_cast("array<variant>")).otherwise(F.transform(F.split("text", r"\r?\n"), lambda t: F.try_parse_json(F.when(F.length(F.trim(t)) > 0, t))))).alias("v"))
    return items.filter(F.schema_of_variant("v").startswith("OBJECT"))


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter with the same, largest count in each of the first ten lines."""
    lines = [x for x in lines[:10] if x.strip()]
    best, most = ",", 0
    for d in DELIMITERS:
        n = {x.count(d) for x in lines}
        if len(n) == 1 and (k := n.pop()) > most:
            best, most = d, k
    return best


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV's rows as (v, raw): header names, cells as boolean, integer, float or
    string, empty cells null.  The delimiter comes from the first ten lines."""
    head = [r[0] for r in spark.read.text(path).head(10)]
    rows = spark.read.option("header", "true").option("sep", sniff_delimiter(head)).option("nullValue", "").option("encoding", encoding).csv(path)

    def cell(name: str) -> Column:
        c = F.col(f"`{name}`")
        quoted = F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"^\{\"x\":(.*)\}$", 1)
        word = F.lower(c)
        number = c.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$")
        return F.when(c.isNull(), "null").when(word.isin("true", "false"), word).when(number, c).otherwise(quoted)

    quote = lambda n: '"' + n.replace("\\", "\\\\").replace('"', '\\"') + '":'
    members = [F.concat(F.lit(quote(n)), cell(n)) for n in rows.columns]
    raw = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    return rows.select(raw.alias("raw")).withColumn("v", F.parse_json("raw"))


def quality_sample(parsed: DataFrame, n: int, seed: int = 42, seq: str = "seq") -> DataFrame:
    """Up to n clean and n partial lines, by hash."""
    kind = F.when(F.col("parse_conf") == 1.0, "clean").otherwise("partial")
    rows = parsed.filter("parse_conf > 0").withColumn("quality", kind)
    w = Window.partitionBy("quality").orderBy(F.md5(F.concat(F.col(seq).cast("string"), F.lit(f"-{seed}")).cast("binary")))
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")
