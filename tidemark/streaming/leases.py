"""Leases on work items, and idempotency keys, as state on a stream of what happened to them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from .keyed import fold

ENDS = {"success": "succeeded", "failure": "failed", "cancel": "cancelled"}


def leases(events: DataFrame, seconds: int, max_attempts: int, late: str = "1 hour") -> DataFrame:
    """(id, at, event, status, owner, until, attempts, outcome) for each event (id, at, seq, event, owner) and each lease that runs out.

    claim takes an item that is pending for `seconds`; heartbeat moves the end of the owner's lease to so long after itself;
    success, failure and cancel end the item; defer gives it back with the attempt unspent. All but claim count only for
    the owner whose lease holds, else outcome is lost_lease; a claim of an item that is not pending is busy. A lease that
    runs out (event expire) gives the item back, or fails it when its attempts are spent; an item whose owner is gone so is
    free again without any event. Unknown events are lost. Equal instants go by seq.
    """
    length = pd.Timedelta(seconds=seconds)

    def row(at, event, state, outcome) -> dict:
        status, owner, until, attempts = state
        return {"at": at, "event": event, "status": status, "owner": owner, "until": until, "attempts": attempts, "outcome": outcome}

    def step(state, e):
        status, owner, until, attempts = state = state or ("pending", None, None, 0)
        event, at = e["event"], e["at"]
        if event == "claim":
            good = status == "pending"
            now = ("running", e["owner"], at + length, attempts + 1) if good else state
            return now, [row(at, event, now, "done" if good else "busy")]
        good = status == "running" and owner == e["owner"] and event in (*ENDS, "heartbeat", "defer")
        if not good:
            now = state
        elif event == "heartbeat":
            now = (status, owner, at + length, attempts)
        elif event == "defer":
            now = ("pending", None, None, attempts - 1)
        else:
            now = (ENDS[event], owner, None, attempts)
        return now, [row(at, event, now, "done" if good else "lost_lease")]

    def over(state):
        _, _, until, attempts = state
        now = ("failed" if attempts >= max_attempts else "pending", None, None, attempts)
        return now, [row(until, "expire", now, "done")]

    return fold(
        events, ["id"], ["at", "seq"], late, "status string, owner string, until timestamp, attempts int",
        "at timestamp, event string, status string, owner string, until timestamp, attempts int, outcome string", step, lambda s: None if pd.isna(s[2]) else s[2], over,
    )


def idempotency(requests: DataFrame, keys: list[str], lock_seconds: int, kept_hours: int = 24, late: str = "1 hour") -> DataFrame:
    """(keys, request_id, at, outcome) of each request (keys, request_id, at, hash, done_at): fresh, replay, in_progress or conflict.

    The first request of a key is fresh and locks it; it is answered at done_at, if that is not null. Later ones with
    another hash are conflicts; with the same, they replay the answer once it is there, wait while the lock holds, and
    else take over (fresh, from when the key counts anew). After kept_hours a key is forgotten, and its next request fresh.
    Only the state is kept of a key, whatever its number of requests. Equal instants go by request_id.
    """
    lock, kept = pd.Timedelta(seconds=lock_seconds), pd.Timedelta(hours=kept_hours)

    def step(state, e):
        at = e["at"]
        if state is not None and state[0] != e["hash"]:
            outcome = "conflict"
        elif state is not None and state[2] is not None and not pd.isna(state[2]) and state[2] <= at:
            outcome = "replay"
        elif state is not None and state[1] > at:
            outcome = "in_progress"
        else:
            outcome, done = "fresh", None if pd.isna(e["done_at"]) else e["done_at"]
            state = (e["hash"], at + lock, done, state[3] if state else at)
        return state, [{"request_id": e["request_id"], "at": at, "outcome": outcome}]

    return fold(
        requests, keys, ["at", "request_id"], late, "hash string, until timestamp, done_at timestamp, created timestamp",
        "request_id long, at timestamp, outcome string", step, lambda s: s[3] + kept, lambda s: (None, []),
    )
