"""State by key on a stream: what an event does to its key's state, and what time does to it.

A key's events of a micro-batch are folded in order of time; between batches only the state is kept, however many events a
key has had. A state with an end is told by a timer once the watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fold(
    events: DataFrame,
    keys: list[str],
    order: list[str],
    late: str,
    state: str,
    out: str,
    step: Callable[[tuple | None, dict], tuple[tuple | None, list[dict]]],
    ends: Callable[[tuple], pd.Timestamp | None],
    over: Callable[[tuple], tuple[tuple | None, list[dict]]],
) -> DataFrame:
    """A stream of the rows (keys, out) that step and over give for events (a stream; its time is order[0]).

    step: (state, event) to (state, rows); over: the same of a state whose end has come, before any event at that time or
    later; ends: when a state ends, or null. A null state is forgotten. Events later than `late` behind the newest, and
    those without a time, are left out by the watermark; those of one batch may be in any order.
    """
    names = [f.name for f in events.schema.fields if f.name not in keys]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now, rows = held.get if held.exists else None, []

        def passed(at: pd.Timestamp) -> None:
            nonlocal now
            while now is not None and (end := ends(now)) is not None and end <= at:
                now, more = over(now)
                rows.extend(more)

        if held.hasTimedOut:
            passed(pd.Timestamp(held.getCurrentWatermarkMs(), unit="ms"))
        else:
            for event in pd.concat(list(batches)).sort_values(order, kind="stable")[names].to_dict("records"):
                if pd.isna(event[order[0]]):
                    continue
                passed(event[order[0]])
                now, more = step(now, event)
                rows.extend(more)
        if now is None:
            if held.exists:
                held.remove()
        else:
            held.update(now)
            if (end := ends(now)) is not None:
                held.setTimeoutTimestamp(max(int(end.timestamp() * 1000), held.getCurrentWatermarkMs() + 1))
        if rows:
            told = pd.DataFrame(rows)
            yield pd.concat([pd.DataFrame([key] * len(told), columns=keys), told], axis=1)

    kinds = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)
    watched = events.withWatermark(order[0], late).groupBy(*keys)
    return watched.applyInPandasWithState(run, f"{kinds}, {out}", state, "append", GroupStateTimeout.EventTimeTimeout)
