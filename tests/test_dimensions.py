"""Dimension files and cluster windows."""

import json

import yaml

from driftloom.operators import lineage, sampling
from driftloom.sources import dimensions


def test_dimension_files(spark, tmp_path):
    for name in ("pay.v1", "odd stream"):
        (tmp_path / name).mkdir()
    fields = [
        {"path": "a.b", "type": "string", "pii": ["email", "nonsense"], "enum_values": ["x", 1], "presence_rate": 0.5, "required": False},
        {"path": "c", "type": "integer"},
        {"path": "d", "type": "no such type"},
        {"type": "string"},
    ]
    (tmp_path / "pay.v1" / "schema.yaml").write_text(yaml.safe_dump({"stream": "pay", "version": "1.2.0", "fields": fields}))
    (tmp_path / "odd stream" / "schema.yaml").write_text("fields: [")
    (tmp_path / "odd stream" / "profile.yaml").write_text(yaml.safe_dump({"clusters": [{"cluster_id": "x"}]}))
    (tmp_path / "pay.v1" / "consumers.yaml").write_text(yaml.safe_dump({"consumers": [{"name": "ledger", "fields_used": [{"path": "c"}]}, {"team": "nameless"}, "text"]}))
    (tmp_path / "odd stream" / "consumers.yaml").write_text("")
    (tmp_path / "pay.v1" / "drift_state.yaml").write_text(yaml.safe_dump({"stream_name": "pay", "incidents": [{"path": "c", "tier": 3}]}))
    root = str(tmp_path)
    got = {r["path"]: r for r in dimensions.read_schemas(spark, root).collect()}
    assert set(got) == {"a.b", "c"} and got["a.b"]["pii"] == ["email"] and got["a.b"]["enum"] == ["x", "1"] and got["a.b"]["presence"] == 0.5
    assert got["c"]["required"] and got["c"]["presence"] == 1.0 and got["c"]["enum"] is None and {r["stream"] for r in got.values()} == {"pay"}
    consumers = dimensions.read_consumers(spark, root)
    assert [(r["stream"], r["name"], r["criticality"]) for r in consumers.collect()] == [("pay.v1", "ledger", "tier3")]
    assert [(r["stream"], json.loads(r["incident"])["tier"]) for r in dimensions.read_drift_states(spark, root).collect()] == [("pay", 3)]
    assert [r["stream"] for r in dimensions.read_profiles(spark, root).collect()] == ["odd stream"]


def test_cluster_windows(spark):
    rows = [(1, "b"), (2, "a"), (3, "b"), (4, None), (5, "c"), (6, "b"), (7, "k")]
    df = spark.createDataFrame(rows, "seq long, key string")
    kept, unrouted = sampling.cluster_windows(df, "key", ("k",), n=2, most=3)
    assert sorted((r["key"], r["seq"]) for r in kept.collect()) == [("a", 2), ("b", 3), ("b", 6), ("k", 7)]
    assert sorted(r["seq"] for r in unrouted.collect()) == [4, 5]
    kept, unrouted = sampling.cluster_windows(df.filter("false"), "key")
    assert kept.count() == unrouted.count() == 0
