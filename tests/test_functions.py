import math

import pytest
from pyspark.sql import functions as F

from driftloom.functions import pii, stats, text, types
from driftloom.operators import drift, sampling


def col(spark, c, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("z", [0.1, 0.5, 1.0, 1.96, 2.576, 3.5, 5.0])
def test_normal_p(spark, z):
    assert col(spark, stats.normal_p(F.col("z")), z=z) == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-13)


@pytest.mark.parametrize(("x", "df", "p"), [(3.841, 1, 0.05001), (5.991, 2, 0.05001), (7.815, 3, 0.05), (18.307, 10, 0.05), (0.0, 4, 1.0), (1e6, 2, 0.0)])
def test_chi2_survival(spark, x, df, p):
    assert col(spark, stats.chi2_survival(F.col("x0"), F.col("d")), x0=x, d=df) == pytest.approx(p, abs=2e-5)


def test_degenerate_z(spark):
    got = col(spark, stats.binomial_z(F.lit(1.0), F.lit(99), F.lit(100)))
    assert got["p"] == 0.0 and got["significant"]
    assert col(spark, stats.binomial_z(F.lit(1.0), F.lit(100), F.lit(100)))["p"] == 1.0


def test_wilson(spark):
    low, high = stats.wilson(F.lit(8), F.lit(10))
    assert col(spark, low) == pytest.approx(0.4902, abs=1e-4) and col(spark, high) == pytest.approx(0.9433, abs=1e-4)
    assert col(spark, stats.wilson(F.lit(0), F.lit(0))[1]) == 0.0


def test_bh_is_monotone(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216, None]
    rows = stats.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p", ["i"], q=0.05).orderBy("i").collect()
    adj = [r["p_adjusted"] for r in rows[:-1]]
    assert adj == sorted(adj) and adj[0] == pytest.approx(0.01) and adj[1] == pytest.approx(0.04) and rows[-1]["p_adjusted"] is None
    assert [r["significant"] for r in rows[:3]] == [True, True, False]


@pytest.mark.parametrize(("kind", "value", "want"), [("integer", "5", "integer"), ("integer", "1700000000000", "timestamp_epoch_ms"), ("float", "1.5", "float"), ("string", "a@b.co", "email"), ("string", "2024-01-01T10:00:00Z", "timestamp_iso8601"), ("string", "2024-01-01", "date"), ("string", "123e4567-E89B-12d3-a456-426614174000", "uuid"), ("string", "x", "string"), ("boolean", "true", "boolean"), ("null", None, "null")])
def test_semantic_types(spark, kind, value, want):
    assert col(spark, types.semantic(F.lit(kind), F.lit(value).cast("string"))) == want


def test_sets_of_types(spark):
    of = lambda *t: col(spark, types.of_values(F.array(*map(F.lit, t)) if t else F.array().cast("array<string>")))
    assert (of(), of("null"), of("integer", "null"), of("integer", "float")) == ("null", "null", "integer", "mixed")
    assert col(spark, types.of_values_named(F.array(F.lit("b"), F.lit("a")))) == "mixed(a/b)"


@pytest.mark.parametrize(
    ("path", "values", "want"),
    [
        ("user.email", ["a@b.co"], [("email", 0.95, "both")]),
        ("email", ["x"], [("email", 0.6, "name_hint")]),
        ("contact", ["a@b.co"], [("email", 0.7, "pattern")]),
        ("event_id", ["4111111111111111"], []),
        ("card_number", ["4111111111111111"], [("card_number", 0.95, "both")]),
        ("session_id", ["123e4567-e89b-12d3-a456-426614174000"], []),
        ("born", ["1990-01-02"], [("date_of_birth", 0.95, "both")]),
        ("day", ["1990-01-02"], []),
        ("host", ["192.168.1.1"], [("ip_address", 0.7, "pattern")]),
        ("version", ["1.2.3.4"], []),
        ("mailbox", ["x"], []),
    ],
)
def test_pii(spark, path, values, want):
    got = col(spark, pii.detect(F.lit(path), F.array(*map(F.lit, values))))
    assert [tuple(r) for r in got] == want


def test_pseudonyms_are_stable(spark):
    p = lambda c, v: col(spark, pii.pseudonym(F.lit(c), F.lit(v)))
    card = p("card_number", "4111 1111 1111 1111")
    assert card == p("card_number", "4111 1111 1111 1111") != "4111 1111 1111 1111" and len(card) == 19 and card[4] == " "
    assert p("email", "a@b.co").endswith("@example.com") and p("email", "a@b.co") != p("email", "c@b.co")


@pytest.mark.parametrize(
    ("kind", "before", "after", "old", "new", "tier", "cls"),
    [
        ("field_added", None, 0.3, None, "string", 1, "evolution"),
        ("field_added", None, 0.9, None, "string", 2, "drift"),
        ("field_removed", 1.0, 0.0, "float", None, 3, "drift"),
        ("field_removed", 0.3, 0.0, "float", None, 2, "drift"),
        ("presence_drop", 0.9, 0.5, "float", "float", 2, "drift"),
        ("presence_increase", 0.5, 0.9, "float", "float", 1, "evolution"),
        ("type_changed", 1.0, 1.0, "integer", "float", 2, "evolution"),
        ("type_changed", 1.0, 1.0, "timestamp_epoch_ms", "timestamp_iso8601", 2, "evolution"),
        ("type_changed", 1.0, 1.0, "float", "string", 3, "drift"),
        ("new_pii", 1.0, 1.0, "string", "string", 3, "drift"),
    ],
)
def test_tiers_and_classes(spark, kind, before, after, old, new, tier, cls):
    v = [F.lit(kind), F.lit(before).cast("double"), F.lit(after).cast("double"), F.lit(old).cast("string"), F.lit(new).cast("string")]
    none = F.lit(None).cast("array<string>")
    assert col(spark, drift.tier(*v)) == tier
    assert col(spark, drift.drift_class(v[0], v[2], v[3], v[4], none, none)) == cls
    assert col(spark, drift.drift_class(v[0], v[2], v[3], v[4], none, none, F.lit(0.4))) == "noise"


def test_names(spark):
    assert col(spark, text.bump_version(F.lit("1.2.3"), F.lit(3))) == "2.0.0"
    assert col(spark, text.safe_column(F.lit("a.b[].c-d"))) == "a_b_c_d"
    assert text.since("7d").days == 7 and text.since("24h").days == 1 and text.since("?").days == 30


def test_allocation(spark):
    s = spark.createDataFrame([("a", 900), ("b", 90), ("c", 5)], "k string, size long")
    got = {r["k"]: r["alloc"] for r in sampling.allocate(s, 100, 10).collect()}
    assert got["c"] == 5 and got["a"] > got["b"] >= 10 and sum(got.values()) <= 100
