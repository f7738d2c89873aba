import json

import pytest
from pyspark.sql import functions as F

from driftloom.operators import cells as C
from driftloom.operators import drift, history, incidents, inference, lineage
from driftloom.sinks import events as sinks
from driftloom.sinks import export
from driftloom.sources import parse, registry
from driftloom.streaming.watch import Phase, Watch, breaker, supervise, tumbling


def _events(spark, rows):
    return C.parse_events(spark.createDataFrame([(k, r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(rows)], "seq long, raw string"))


def test_flattening(spark):
    rows = [{"a": 1, "b": {"c": {"d": "x"}}, "t": [{"k": 2}, {"z": 1}], "s": [1], "e": [], "o": {}, "n": None}, "[1]", "bad"]
    e = _events(spark, rows)
    got = {r["path"]: (r["kind"], r["text"]) for r in C.cells(e, depth=C.depth_needed(e)).collect()}
    assert got == {"a": ("integer", "1"), "b.c.d": ("string", "x"), "t": ("array", '[{"k":2},{"z":1}]'), "t[].k": ("integer", "2"), "s": ("array", "[1]"), "e": ("array", "[]"), "n": ("null", None)}


def test_flattening_limits(spark):
    deep = "x"
    for k in range(14):
        deep = {f"k{k}": deep}
    e = _events(spark, [deep, {"_meta": 1, "a": 2}])
    assert [r["path"] for r in C.cells(e, depth=2, internal=False).filter("seq = 1").collect()] == ["a"]
    assert C.cells(e, depth=10).filter("seq = 0").count() == 0


def test_rebuild(spark):
    c = C.cells(_events(spark, [{"a": 1, "b": 'q"', "c": None, "d": True}]), depth=0)
    assert json.loads(C.rebuild(c).first()["raw"]) == {"a": 1, "b": 'q"', "c": None, "d": True}


def test_small_sample_drift(spark):
    """Twenty rows a side: thresholds instead of tests."""
    old = [{"amount": 1.5, "ts": 1700000000000 + k, "cur": "EUR"} for k in range(20)]
    new = [{"ts": "2024-01-01T00:00:00Z", "cur": "EUR", "minor": 150, "card_last_four": "1234"} for _ in range(20)]
    a, b = _events(spark, old), _events(spark, new)
    base = drift.baseline_of(C.cells(a, depth=1), a)
    got = {(r["path"], r["drift_type"]): r["tier"] for r in drift.detect(base, C.cells(b, depth=1), b).collect()}
    assert got == {("amount", "field_removed"): 3, ("ts", "type_changed"): 2, ("minor", "field_added"): 2, ("card_last_four", "new_pii"): 3}


def test_resilient_ladder(spark):
    lines = ['{"a":1}', '2024 INFO {"a":1,"b":2} x', '{"a":1,"b":"c","d":{', "garbage", "", '{"a":' + "1" * 70000 + "}", '"a":1,"a":2,"b":3']
    p = parse.resilient(spark.createDataFrame(list(enumerate(lines)), "seq long, line string"))
    rows = {r["seq"]: (r["parse_conf"], r["v"] and json.loads(r["j"])) for r in p.withColumn("j", F.to_json("v")).collect()}
    assert [rows[k][0] for k in range(6)] == [1.0, 0.7, 0.5, 0.0, 0.0, 0.0]
    assert rows[2][1] == {"a": 1, "b": "c"} and rows[6][1] == {"a": 2, "b": 3}


def test_files(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"x":1}\n\nbad\n{"x":2}\n')
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.json").write_text('{"x":3}\n')
    (tmp_path / "._d.json").write_text('{"x":4}\n')
    got = parse.read_events(spark, str(tmp_path)).orderBy("seq").collect()
    assert [json.loads(r["raw"])["x"] for r in got] == [1, 2, 3]
    assert registry.resolve(spark, str(tmp_path)).count() == 3
    with pytest.raises(ValueError, match="kinesis"):
        registry.resolve(spark, "kinesis://x")
    (tmp_path / "arr.txt").write_text('[{"a":1},{"a":2},3]')
    assert parse.read_json_files(spark, str(tmp_path / "arr.txt")).count() == 2
    (tmp_path / "t.csv").write_text("id;name;ok\n1;Ann;true\n2.5;;x\n")
    rows = [json.loads(r["raw"]) for r in parse.read_csv(spark, str(tmp_path / "t.csv")).collect()]
    assert rows == [{"id": 1, "name": "Ann", "ok": True}, {"id": 2.5, "name": None, "ok": "x"}]


def test_kafka_rows(spark):
    rows = [(p, o, json.dumps({"p": p, "o": o}).encode()) for p in range(2) for o in range(5)] + [(0, 9, None), (0, 10, b"no")]
    e = registry.kafka_events(spark.createDataFrame(rows, "partition int, offset long, value binary"), 4)
    assert sorted(json.loads(r["raw"])["o"] for r in e.collect()) == [0, 0, 1, 1]
    assert registry.tail_offsets({0: 100, 1: 3}, 10) == {0: 90, 1: 0}


def test_exports():
    f = [
        {"path": "id", "field_type": "uuid", "required": True, "pii": [], "enum": []},
        {"path": "user.email", "field_type": "email", "required": False, "nullable": True, "pii": ["email"], "enum": []},
        {"path": "kind", "field_type": "string", "required": True, "pii": [], "enum": ["a", "b"]},
        {"path": "at", "field_type": "timestamp_epoch_ms", "required": True, "pii": [], "enum": []},
    ]
    js = export.json_schema("s", f)
    assert js["properties"]["user"]["properties"]["email"]["x-pii"] == ["email"] and js["required"] == ["at", "id", "kind"]
    av = export.avro("s-x", f)
    assert av["name"] == "SX" and [x["name"] for x in av["fields"]] == ["at", "id", "kind", "user"] and av["fields"][2]["type"]["symbols"] == ["a", "b"]
    assert "google.protobuf.Timestamp at = 1;" in export.proto("s", f) and "WATERMARK FOR at" in export.flink_ddl("s", f)
    assert "ID VARCHAR KEY" in export.ksqldb("s", [*f, {"path": "x", "field_type": "mixed"}]) and "`id` STRING NOT NULL" in export.spark_ddl("s", f)
    assert "| user.email | email | no |" in export.markdown("s", f)
    assert json.loads(export.registry_payload("s", f)["schema"])["type"] == "record"


def test_parents(spark):
    s = spark.createDataFrame([("a.b", "string", 0.9, True, 0.8), ("l[].k", "integer", 0.5, False, 0.7)], "path string, field_type string, presence double, required boolean, confidence double")
    got = {r["path"]: (r["field_type"], r["presence"]) for r in export.parents(s).collect()}
    assert got["a"] == ("object", 0.9) and got["l"] == ("array", 0.5)


def test_sinks(spark):
    bad = spark.createDataFrame([("{}", 3), ("[]", 1)], "raw string, tier int")
    d = sinks.dead_letters(bad, "t", "p", F.lit("v"), F.lit("now"), min_tier=2, tier=F.col("tier")).collect()
    assert len(d) == 1 and d[0]["topic"] == "t.dlq" and json.loads(d[0]["value"])["event"] == "{}"
    assert "and 1 more" in sinks.notice("s", [{"tier": 1, "drift_type": "x", "path": "p"}] * 6)["text"]
    r = sinks.SchemaRegistry(lambda m, p, b: {"id": 7} if m == "POST" else ["s"])
    assert r.push("s", {}) == 7 and r.subjects() == ["s"]
    broken = sinks.SchemaRegistry(lambda *a: 1 / 0)
    assert broken.push("s", {}) is None and not broken.ping() and not broken.compatible("s", {})


def test_lineage_observer(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":{"c":2},"l":[{"k":1}]}'), (2, "bad")], "seq long, raw string")
    seen = lineage.observe(df, "s", "c", lambda e: (e["b"]["c"], e.get("zz"), [x["k"] for x in e["l"]], "a" in e))
    assert {r["field"] for r in seen.collect()} == {"b", "b.c", "zz", "l", "l[].k"}


def test_align_paths(spark):
    one = spark.createDataFrame([("email",), ("id",), ("x",)], "path string")
    known = spark.createDataFrame([("user.email",), ("a.id",), ("b.id",)], "path string")
    assert {r["inferred"]: r["aligned"] for r in inference.align_paths(one, known).collect()} == {"email": "user.email", "id": None, "x": None}


def test_history_accept(spark):
    schema = spark.createDataFrame([("a", "integer", 1.0, []), ("b", "string", 1.0, [])], "path string, field_type string, presence double, pii array<string>")
    found = spark.createDataFrame([("a", "type_changed", 1.0, "float", []), ("b", "field_removed", 0.0, None, []), ("c", "field_added", 0.7, "string", [])], "path string, drift_type string, after double, new_type string, pii array<string>")
    assert {(r["path"], r["field_type"]) for r in history.accept(schema, found).collect()} == {("a", "float"), ("c", "string")}


def test_incident_prune(spark):
    s = spark.createDataFrame([(None, "a", "x", 1, "resolved", "2024-01-01", "2024-01-01", 1), (None, "b", "x", 1, "open", "2024-01-01", "2024-01-01", 1)], "cluster_id string, path string, drift_type string, tier int, status string, first_detected string, last_seen string, occurrences long")
    assert [r["path"] for r in incidents.prune(s, F.lit("2024-02-01")).collect()] == ["b"]
    assert incidents.suppress(s, "b").filter("status = 'suppressed'").count() == 1


def test_phases():
    p = Phase(warmup=2, need_clean=1)
    assert [p.tick(1, 2), p.tick(0)] == ["suppress", "clean"] and p.phase == "STABILIZING"
    assert p.tick(0) == "clean" and p.phase == "STABLE"
    assert [p.tick(1, 2), p.tick(1, 2), p.tick(0), p.tick(1, 3)] == ["suppress", "alert", "clean", "tier3"]


def test_watch(spark, tmp_path):
    src, alerts = tmp_path / "in", []
    src.mkdir()
    clean = [{"id": k, "kind": "a"} for k in range(60)]
    base_events = _events(spark, clean)
    base = drift.baseline_of(C.cells(base_events, depth=0), base_events)
    w = Watch(spark, base, str(tmp_path / "state"), window=50, sample=50, on_event=lambda b, a, f: alerts.append(a), depth=0)
    stream = lambda: spark.readStream.schema("seq long, raw string").json(str(src))
    for batch, rows in enumerate([clean, [{"id": k, "email": "a@b.co"} for k in range(60)]]):
        (src / f"{batch}.json").write_text("".join(json.dumps({"seq": 1000 * batch + k, "raw": json.dumps(r)}) + "\n" for k, r in enumerate(rows)))
        w.start(stream(), str(tmp_path / "checkpoint")).awaitTermination()
    ticks = {r["batch"]: r["action"] for r in w.ticks().collect()}
    assert ticks == {0: "clean", 1: "tier3"} and alerts == ["tier3"]
    assert {(r["path"], r["drift_type"]) for r in w.incidents(1).filter("status = 'open'").collect()} == {("kind", "field_removed"), ("email", "new_pii")}
    assert spark.read.parquet(str(tmp_path / "state" / "window" / "batch=1")).count() == 50


def test_stream_windows(spark, tmp_path):
    (tmp_path / "a.json").write_text("".join(json.dumps({"ts": f"2024-01-01 00:{m:02d}:00", "event_type": "x"}) + "\n" for m in (1, 5, 15, 59)))
    s = spark.readStream.schema("ts timestamp, event_type string").json(str(tmp_path))
    q = tumbling(s, "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.sql("select n from w").collect()) == [1, 1, 2]


def test_tail_source(spark, tmp_path):
    r = registry._TailReader({"path": str(tmp_path)})
    f = tmp_path / "a.ndjson"
    f.write_text("1\n2\n")
    rows, end = r.read({})
    assert [x[2] for x in rows] == ["1", "2"]
    f.write_text("1\n2\n3\n")
    rows, end2 = r.read(end)
    assert [x[2] for x in rows] == ["3"] and [x[2] for x in r.readBetweenOffsets(end, end2)] == ["3"]
    f.write_text("9\n")
    assert [x[2] for x in r.read(end2)[0]] == ["9"]


def test_resilience():
    call, now = breaker(2, 30), [0.0]
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            call(lambda: 1 / 0, clock=lambda: now[0])
    with pytest.raises(RuntimeError):
        call(lambda: 1, clock=lambda: now[0])
    now[0] = 31.0
    assert call(lambda: 1, clock=lambda: now[0]) == 1
    waits, left = [], [3]

    def start():
        left[0] -= 1
        if left[0]:
            raise OSError

    assert supervise(start, sleep=waits.append) == 2 and waits == [5.0, 10.0]
