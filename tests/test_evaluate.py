"""Maps of hashes, budgets of calls and neighbours against plain Python, with nulls, ties, repeats and empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate

CASES = "case_id string, own array<string>"
POOL = "place long, text string"


def walked(case, own, pool, n):
    if case is None or not pool:
        return []
    start = int.from_bytes(hashlib.sha256(case.encode()).digest()[:8], "big") % len(pool)
    around = (pool[(start + k) % len(pool)] for k in range(len(pool)))
    return [t for t in around if t and t not in (own or [])][:n]


@pytest.mark.parametrize("pool", [[], ["", None, ""], ["a"], ["a", "b"] * 3, [""] * 40 + ["a", "b", None] + ["c"] * 30 + ["d"]])
@pytest.mark.parametrize("n", [0, 1, 4])
def test_neighbours(spark, pool, n):
    cases = [(None, ["a"]), ("", None), ("x", []), ("y", ["a", "c"]), ("y", ["a", "c"]), ("z", ["c", "d"]), ("long" * 9999, ["b"])]
    texts = spark.createDataFrame(list(enumerate(pool)), POOL).withColumn("own", F.lit("clash"))
    found = evaluate.neighbours(spark.createDataFrame(cases, CASES).withColumn("place", F.lit(1)), texts, n).collect()
    assert {(r.case_id, tuple(r.own)): r.neighbours for r in found} == {(c, tuple(o or [])): walked(c, o, pool, n) for c, o in cases}
    assert len(found) == 6


def test_neighbours_of_no_cases(spark):
    assert evaluate.neighbours(spark.createDataFrame([], CASES), spark.createDataFrame([(0, "a")], POOL), 2).count() == 0


def test_attempts(spark):
    rows = [
        ("good", 1, True, None, None),
        ("good", 2, True, "late", None),
        ("twice", 1, True, "json", None),
        ("twice", 2, False, "net", True),
        ("twice", 3, True, "json2", None),
        ("twice", 4, True, None, None),
        ("stop", 1, None, "privacy", None),
        ("stop", 2, True, None, None),
        ("open", 1, False, "net", True),
        (None, 1, True, None, None),
    ] + [("worn", k, False, f"net{k}", True) for k in range(1, 9)]
    responses = spark.createDataFrame(rows, "batch string, k long, answered boolean, error string, retryable boolean")
    tried = evaluate.attempts(responses, ["batch"], ["k"])
    ends = {r.batch: (r.calls, r.done, r.error_code) for r in evaluate.outcomes(tried, ["batch"]).collect()}
    assert ends == {
        "good": (1, True, None), "twice": (3, True, "json2"), "stop": (1, True, "privacy"), "open": (1, False, None), None: (1, True, None), "worn": (5, True, "net5"),
    }
    assert [r.repair for r in tried.where("batch = 'twice'").orderBy("k").collect()] == [False, True, True]
    assert [r.failures for r in tried.where("batch = 'worn'").orderBy("k").collect()] == [1, 2, 3, 4, 5]
    assert evaluate.outcomes(evaluate.attempts(responses.limit(0), ["batch"], ["k"]), ["batch"]).count() == 0


def test_case_hashes(spark):
    rows = [("r", "b", "1", 1), ("r", "a", "2", 1), ("r", "b", "3", 2), ("r", "b", None, 3), ("r", None, "4", 1), ("none", "a", None, 1)]
    records = spark.createDataFrame(rows, "report string, case_id string, result_sha256 string, at long")
    got = {r.report: r.case_hashes for r in evaluate.case_hashes(records, ["report"], F.col("at")).collect()}
    assert got == {"r": {"a": "2", "b": "3"}, "none": {}} and list(got["r"]) == ["a", "b"]
    assert evaluate.case_hashes(records.limit(0), ["report"], F.col("at")).count() == 0
