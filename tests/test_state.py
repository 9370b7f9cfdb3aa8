"""Keyed state on streams against the same in one go, over several deliveries and a restart in between."""

import collections
import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import store
from tidemark.sources import sinks
from tidemark.streaming import leases, usage

HOUR = datetime.timedelta(hours=1)


def streamed(spark, rows, make, folder, parts):
    """All that a stream gives out whose rows come in so many deliveries, started anew for each."""
    ordered = rows.orderBy("at").toPandas()
    for k in range(parts):
        part = ordered.iloc[len(ordered) * k // parts : len(ordered) * (k + 1) // parts]
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        assert usage.write(make(stream), f"{folder}/out", f"{folder}/state").awaitTermination(300)
    return spark.read.parquet(f"{folder}/out").collect()


def leased_plainly(events, seconds, most):
    out, states, ends = [], {}, {"success": "succeeded", "failure": "failed", "cancel": "cancelled"}
    for e in sorted(events, key=lambda e: (e.at, e.seq)):
        status, owner, until, n = states.get(e.id, ("pending", None, None, 0))
        if until is not None and until <= e.at:
            status, owner, until, n, _ = now = ("failed" if n >= most else "pending", None, None, n, until)
            out.append((e.id, now[4], "expire", status, n, "done"))
        outcome, until_ = "done", e.at + datetime.timedelta(seconds=seconds)
        if e.event == "claim" and status == "pending":
            status, owner, until, n = "running", e.owner, until_, n + 1
        elif e.event == "claim":
            outcome = "busy"
        elif status != "running" or owner != e.owner:
            outcome = "lost_lease"
        elif e.event == "heartbeat":
            until = until_
        elif e.event == "defer":
            status, owner, until, n = "pending", None, None, n - 1
        else:
            status, until = ends[e.event], None
        states[e.id] = (status, owner, until, n)
        out.append((e.id, e.at, e.event, status, n, outcome))
    return out, states


def test_leases_on_a_stream(spark, data, tmp_path):
    """events as what happens to a few items: most of them claims, some by another owner than the one that holds the lease."""
    k = F.col("event_id")
    event = F.element_at(F.array(*map(F.lit, ("claim", "heartbeat", "claim", "defer", "claim", "success", "claim", "failure", "heartbeat", "cancel"))), (k % 10 + 1).cast("int"))
    rows = spark.read.parquet(f"{data}/events.parquet").select((F.col("user_id") % 40).alias("id"), F.col("ts").cast("timestamp").alias("at"), k.alias("seq"), event.alias("event"), F.concat(F.lit("o"), k % 3).alias("owner"))
    span = rows.agg((F.max("at").cast("double") - F.min("at").cast("double")).alias("s"), F.count("*").alias("n")).first()
    seconds = max(2, int(span.s / span.n * 40))
    got = [(r.id, r.at, r.event, r.status, r.attempts, r.outcome) for r in streamed(spark, rows, lambda s: leases.leases(s, seconds, 3, "1 minute"), tmp_path, 3)]
    wanted, states = leased_plainly(rows.collect(), seconds, 3)
    kinds = collections.Counter((w[2], w[5]) for w in wanted)
    assert all(kinds[x] for x in (("expire", "done"), ("heartbeat", "done"), ("claim", "busy"), ("success", "lost_lease"), ("defer", "done"))), kinds
    # Besides, a timer may have ended a lease after an item's last event.
    extra = collections.Counter(got) - collections.Counter(wanted)
    assert not collections.Counter(wanted) - collections.Counter(got)
    assert all(e[2] == "expire" and states[e[0]][2] == e[1] for e in extra) and len(extra) <= 40


def test_timers_free_items(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, at, 1, "claim", "a"), (1, at + HOUR / 2, 2, "heartbeat", "a"), (2, at, 3, "claim", "b"), (3, at + 9 * HOUR, 4, "claim", "c"), (3, at + 10 * HOUR, 5, "claim", "c")]
    frame = spark.createDataFrame(rows, "id long, at timestamp, seq long, event string, owner string")
    got = streamed(spark, frame, lambda s: leases.leases(s, 3600, 1, "1 minute"), tmp_path, 5)
    assert {(r.id, r.at, r.status) for r in got if r.event == "expire"} == {(1, at + 1.5 * HOUR, "failed"), (2, at + HOUR, "failed"), (3, at + 10 * HOUR, "failed")}


@pytest.mark.parametrize("parts", [1, 4])
def test_idempotency_keys_expire(spark, tmp_path, parts):
    at = datetime.datetime(2024, 1, 1)
    rows = [("k", 1, at, "h", at + HOUR), ("k", 2, at + HOUR / 2, "h", None), ("k", 3, at + HOUR, "h", None), ("k", 4, at + 23 * HOUR, "x", None), ("k", 5, at + 24 * HOUR, "x", None),
            ("l", 6, at, "h", None), ("l", 7, at + 2 * HOUR, "h", None), ("l", 8, at + 2.5 * HOUR, "h", None)]
    frame = spark.createDataFrame(rows, "key string, request_id long, at timestamp, hash string, done_at timestamp")
    got = {r.request_id: r.outcome for r in streamed(spark, frame, lambda s: leases.idempotency(s, ["key"], 7200), tmp_path, parts)}
    assert got == {1: "fresh", 2: "in_progress", 3: "replay", 4: "conflict", 5: "fresh", 6: "fresh", 7: "fresh", 8: "in_progress"}


def test_a_batch_is_written_once(spark, tmp_path):
    root = str(tmp_path / "tables")

    def tables(k, broken=False):
        rows = spark.range(k * 10, k * 10 + 10)
        bad = F.when(F.lit(broken), F.raise_error(F.lit("killed"))).otherwise(F.lit("x"))
        return {"flags": rows.withColumnRenamed("id", "flag_id"), "attempts": rows.withColumn("note", bad)}

    sinks.write_batch(tables(0), root, 0)
    with pytest.raises(Exception, match="killed"):
        sinks.write_batch(tables(1, True), root, 1)
    assert [sinks.read_batches(spark, root, t).count() for t in ("flags", "attempts")] == [10, 10]
    for _ in range(2):
        sinks.write_batch(tables(1), root, 1)
    for t, key in (("flags", "flag_id"), ("attempts", "id")):
        assert sorted(r[0] for r in sinks.read_batches(spark, root, t).select(key).collect()) == list(range(20))


def test_stream_into_two_tables(spark, tmp_path):
    for k in range(3):
        spark.range(k * 5, k * 5 + 5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fails = [True]

    def tables(batch):
        if fails and batch.where("id >= 10").count():
            fails.pop()
            return {"even": batch.where("id % 2 = 0"), "odd": batch.select(F.raise_error(F.lit("killed")).alias("id"))}
        return {"even": batch.where("id % 2 = 0"), "odd": batch.where("id % 2 = 1")}

    def run():
        return sinks.write_tables(stream, tables, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)

    with pytest.raises(Exception, match="killed"):
        run()
    assert run()
    for name, k in (("even", 0), ("odd", 1)):
        assert sorted(r.id for r in sinks.read_batches(spark, str(tmp_path / "out"), name).collect()) == list(range(k, 15, 2))


def test_touched_rows_are_counted_as_they_are_written(spark, tmp_path):
    rows = spark.range(1000).withColumn("new", F.when(F.col("id") % 3 == 0, "failed").otherwise("pending"))
    told = sinks.write_counted(rows, str(tmp_path / "t"), {"failed": F.col("new") == "failed", "none": F.lit(None).cast("boolean")})
    assert told == {"failed": 334, "none": 0} and spark.read.parquet(str(tmp_path / "t")).count() == 1000
    assert sinks.write_counted(rows.where("false"), str(tmp_path / "e"), {"failed": F.col("new") == "failed"}) == {"failed": 0}


def test_recovery_from_cancellations_and_lost_workers(spark):
    now = datetime.datetime(2024, 1, 1)
    past, to_come = now - HOUR, now + HOUR
    rows = [(1, "queued", past, None), (2, "running", past, past), (3, "running", past, to_come), (4, "running", None, past), (5, "running", None, None),
            (6, "failed", past, past), (7, "queued", past, to_come), (8, "parsing", past, None), (9, "parsing", None, past), (10, None, past, past)]
    frame = spark.createDataFrame([(*r, "w", None) for r in rows], "id int, status string, cancel_requested_at timestamp, lease_expires_at timestamp, lease_owner string, finished_at timestamp")

    def after(f):
        return {r.id: (r.status, r.lease_owner, r.finished_at) for r in f(frame, F.lit(now)).collect()}

    same = {r[0]: (r[1], "w", None) for r in rows}
    gone, back = ("cancelled", None, now), ("queued", None, None)
    assert after(store.recover_scans) == same | {1: gone, 2: gone, 4: back, 7: gone}
    assert after(store.recover_imports) == same | {1: gone, 8: gone, 9: back}
    assert after(store.recover_items) == same | {2: gone}
    assert store.recover_scans(frame.limit(0), F.lit(now)).collect() == []
    attempts = spark.createDataFrame([(2, "retry", past), (2, None, None), (3, None, None), (None, None, None)], "id int, outcome string, finished_at timestamp")
    closed = store.close_attempts(attempts, spark.createDataFrame([(2,), (2,), (None,)], "id int"), ["id"], "cancelled", F.lit(now))
    assert sorted(map(tuple, closed.collect()), key=str) == sorted([(2, "retry", past), (2, "cancelled", now), (3, None, None), (None, None, None)], key=str)


def test_items_wait_for_an_identical_archive(spark):
    now = datetime.datetime(2024, 1, 1)
    kind = "tenant_id string, import_id int, status string, attempt_count int, run_after timestamp, lease_owner string, busy int"
    items = spark.createDataFrame([("t", 1, "running", 2, now, "w", 0), ("t", 2, "running", 0, now, "w", 0), ("t", 3, "pending", 1, now, None, 0), ("u", 1, "running", 1, now, "w", 0), ("t", None, "running", 1, now, "w", 0)], kind)
    claims = spark.createDataFrame([("t", 1, "busy"), ("t", 1, "busy"), ("t", 2, "busy"), ("t", 3, "busy"), ("u", 1, "duplicate"), ("t", None, "busy")], "tenant_id string, id int, outcome string")
    out = store.defer_busy(items, claims, F.lit(now))
    got = {tuple(r[:2]): tuple(r[2:6]) for r in out.collect()}
    later = now + datetime.timedelta(seconds=30)
    assert out.columns == items.columns and out.count() == 5
    assert got == {("t", 1): ("pending", 1, later, None), ("t", 2): ("pending", 0, later, None), ("t", 3): ("pending", 1, now, None), ("u", 1): ("running", 1, now, "w"), ("t", None): ("running", 1, now, "w")}
