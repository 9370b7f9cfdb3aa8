"""Every registered query of the library against its SQL."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scan
from tidemark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_like_sql(spark, data, same_as_sql, name):
    same_as_sql(registry.QUERIES[name](spark, data), registry.ORACLE_SQL[name], data)


def test_scan_flags_are_the_stubs_of_packed_segments(spark, data):
    got = registry.scan_documents(spark, data)
    assert got.count() > 0 and got.where("risk <> 'low' OR category <> 'hate'").count() == 0
    assert got.select("tenant", "doc_id").distinct().count() == got.count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def packed_plainly(rows, most, max_tokens, base, per_item):
    out, last = {}, object()
    for s, k, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if s != last:
            last, ordinal, index, total = s, 0, 0, base
        elif index >= most or total + n + per_item > max_tokens:
            ordinal, index, total = ordinal + 1, 0, base
        out[k] = (ordinal, index)
        total, index = max(total + n + per_item, total + 1), index + 1
    return out


@pytest.mark.parametrize("sizes, most", [((1, 9, 40, 300), 16), ((5,), 7), ((1, 50, 120), 3), ((1,), 100)])
def test_packing_deals_a_hot_scan_out(spark, sizes, most):
    draw = random.Random(most)
    rows = [(draw.choice(["hot"] * 9 + [None, "a", "z"]), k, draw.choice(sizes)) for k in range(600)]
    items = spark.createDataFrame(rows, "tenant string, id long, tokens long").repartition(3)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        found = scan.pack(items, "tenant", ["id"], max_items=most, max_tokens=200, base=20, per_item=2, max_output=1000, out=1)
        got = found.withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(setting, before)
    assert len(got) == len(rows)
    assert {r.id: (r.batch_ordinal, r.item_index) for r in got} == packed_plainly(rows, most, 200, 20, 2)
    assert len({r.p for r in got if r.tenant == "hot"}) > 3


def test_of_equal_actions_the_first_of_the_table_counts(spark, tmp_path, same_as_sql):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"p_partkey": pa.array(range(1, 41), pa.int64())}), tmp_path / "part.parquet")
    lines = [(part, order, flag) for part in range(1, 41) for order, flag in ((7, "RA"[part % 2]), (7, "AR"[part % 2]), (9, "R"))]
    columns = {"l_partkey": pa.array([r[0] for r in lines], pa.int64()), "l_orderkey": pa.array([r[1] for r in lines], pa.int64())}
    columns |= {"l_linenumber": pa.array([1] * len(lines), pa.int32()), "l_returnflag": [r[2] for r in lines]}
    pq.write_table(pa.table(columns), tmp_path / "lineitem.parquet")
    same_as_sql(registry.reviewed_flags(spark, str(tmp_path)), registry.ORACLE_SQL["reviewed_flags"], str(tmp_path))


def test_texts_are_cleaned_once(spark):
    """The plan of the segments holds each step once: named twice, Spark would run it twice."""
    rows = spark.createDataFrame([("a", 1, "x<br>y")], "tenant string, doc_id long, body string")
    plan = scan.prepare(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("(?:br|BR|Br)") == 1 and plan.count("blockquote") == 1
