"""Folds over the rows of a key in order: one step function serves a batch and a stream.

A step takes the key's state (None at first) and a row, and returns the new state and the rows to emit. In a batch the
rows of a task come sorted, and the task carries one state at a time, so a key with very many rows takes no more memory
than any other. In a stream the state is kept as JSON.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import _parse_datatype_string

Step = Callable[[object, tuple], tuple[object, list[tuple]]]


def in_order(rows: DataFrame, key: str, order: str, step: Step, ddl: str) -> DataFrame:
    """The rows that the steps emit; the key comes first in rows."""
    names = _parse_datatype_string(ddl).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, begun = None, None, False
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False):
                if not begun or row[0] != now:
                    now, state, begun = row[0], None, True
                state, emitted = step(state, row)
                out += emitted
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, ddl)


def streamed(rows: DataFrame, key: str, order: str, step: Step, ddl: str, timeout: GroupStateTimeout | str = GroupStateTimeout.NoTimeout, until: Callable | None = None) -> DataFrame:
    """The same over a stream; rows of a key in one trigger are taken in order. `until` gives the time in milliseconds,
    from the state, after which a key's state is dropped (with event time as the timeout)."""
    names = _parse_datatype_string(ddl).names

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, out = json.loads(state.get[0]) if state.exists else None, []
        for row in pd.concat(list(batches)).sort_values(order, kind="stable").itertuples(index=False):
            held, emitted = step(held, row)
            out += emitted
        state.update((json.dumps(held),))
        if until is not None:
            state.setTimeoutTimestamp(max(int(until(held)), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy(key).applyInPandasWithState(run, ddl, "state string", "append", timeout)
