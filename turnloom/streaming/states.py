"""The state fold on a stream: per-dialogue keyed state. An addition to the batch operators, with the same results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import DELETE


def stream_fold(events: DataFrame) -> DataFrame:
    """id, turn_id, state after each event of a stream (id, turn_id, slot, value).

    A dialogue's events of one trigger are taken in the order of their turns; what comes later than a turn already folded
    is folded after it. Only slots and last values are kept.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(*held.get)) if held.exists else {}
        rows = pd.concat(list(parts)).sort_values("turn_id")
        out = []
        for turn, slot, value in zip(rows["turn_id"], rows["slot"], rows["value"]):
            if value == DELETE:
                now.pop(slot, None)
            elif value is not None:
                now[slot] = value
            out.append(";".join(f"{k}={v}" for k, v in sorted(now.items())))
        held.update((list(now), list(now.values())))
        yield pd.DataFrame({"id": key[0], "turn_id": rows["turn_id"], "state": out})

    return events.groupBy("id").applyInPandasWithState(step, "id long, turn_id long, state string", "slots array<string>, vals array<string>", "append", GroupStateTimeout.NoTimeout)
