"""Benjamini-Hochberg over large families, under a time limit that a frame scanned anew for each row exceeds."""

import contextlib
import threading
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from driftloom.functions import stats
from driftloom.plans import catalog

LIMIT = 60


@contextlib.contextmanager
def limited(spark):
    """Jobs still running after LIMIT seconds are cancelled, which raises."""
    timer = threading.Timer(LIMIT, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def adjusted(p):
    """From the largest down, as the SQL has it."""
    at, low, out = sorted(range(len(p)), key=lambda i: (p[i], i)), 1.0, [0.0] * len(p)
    for rank in range(len(p), 0, -1):
        low = out[at[rank - 1]] = min(low, p[at[rank - 1]] * len(p) / rank)
    return out


def families(n, scale):
    """{family: p of its tests} of the tests that the queries make of events 0 to n - 1."""
    out = defaultdict(list)
    for i in range(n):
        out[i % 5].append(i * 37 % 1009 / scale)
    return out


def test_bh_of_one_large_family(spark):
    n = 50_000
    p = [(i * 7919 % n / n) ** 3 if i % 4 else 1.0 for i in range(n)]  # a quarter shares one value
    t = spark.range(n).select("id", F.when(F.col("id") % 4 != 0, F.pow(F.col("id") * 7919 % n / n, F.lit(3.0))).otherwise(1.0).alias("p"))
    with limited(spark):
        rows = stats.benjamini_hochberg(t, "p", ["id"], q=0.2).collect()
    got = {r["id"]: r for r in rows}
    assert len(rows) == n and sum(r["significant"] for r in rows) > 100
    assert all(got[i]["p_adjusted"] == pytest.approx(a, rel=1e-12) for i, a in enumerate(adjusted(p)))


def test_bh_fdr_of_large_families(spark, tmp_path):
    n = 200_000
    spark.range(n).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    with limited(spark):
        rows = catalog.QUERIES["bh_fdr"](spark, str(tmp_path)).collect()
    want = {k * 5 + f: (p, a) for f, ps in families(n, 10090.0).items() for k, (p, a) in enumerate(zip(ps, adjusted(ps), strict=True))}
    assert len(rows) == n == len({r["id"] for r in rows})
    assert Counter(r["suppressed"] for r in rows) == Counter(p < 0.01 and not a < 0.01 for p, a in want.values())
    assert all(r["fam"] == r["id"] % 5 and r["p_adjusted"] == pytest.approx(want[r["id"]][1], abs=1e-6) and r["significant"] == (want[r["id"]][1] < 0.01) for r in rows)


def test_suppression_of_large_families(spark, tmp_path):
    n = 200_000
    spark.range(n).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    with limited(spark):
        rows = catalog.QUERIES["suppression"](spark, str(tmp_path)).collect()
    assert sorted(r["fam"] for r in rows) == [0, 1, 2, 3, 4]
    for r in rows:
        p = families(n, 100900.0)[r["fam"]]
        hit = [a < 0.005 for a in adjusted(p)]
        held = sum(x < 0.005 and not h for x, h in zip(p, hit, strict=True))
        assert (r["tests"], r["significant"], r["suppressed"]) == (len(p), sum(hit), held)
        assert r["rate"] == pytest.approx(held / (held + sum(hit)) if held + sum(hit) else 0.0, abs=1e-6)
