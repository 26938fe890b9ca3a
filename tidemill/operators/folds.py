"""Ordered folds of event logs into per-source state: circuit breakers and running metrics.

The fold of a key is a pure function of (state, event), so the batch form and the streaming form share it. The batch
form streams each key's events in order through one task, as sorted Arrow batches, and holds one state at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame

OPEN_AFTER = 3


@dataclass
class SourceState:
    """Consecutive failures, counters, and a mean that is updated by attempts, as events come."""

    attempts: int = 0
    successes: int = 0
    failures: int = 0
    in_a_row: int = 0
    times_opened: int = 0
    mean: float = 0.0

    def apply(self, kind: str, value: float | None) -> None:
        if kind == "click":
            self.attempts += 1
        elif kind == "purchase":
            self.attempts = max(self.attempts, 1)
            self.successes += 1
            self.in_a_row = 0
            self.mean = (self.mean * (self.attempts - 1) + (value or 0.0)) / self.attempts
        elif kind == "error":
            self.failures += 1
            self.in_a_row += 1
            if self.in_a_row % OPEN_AFTER == 0:
                self.times_opened += 1


STATE = ", ".join(f"{f.name} {'double' if f.type == 'float' else 'long'}" for f in fields(SourceState))


def fold_events(events: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id"), kind: str = "event_type", value: str = "value") -> DataFrame:
    """The state of each key after all its events. Partitions are sorted by key and order; only a state is held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, SourceState()
        for frame in frames:
            done = []
            for k, e, v in zip(frame[key], frame[kind], frame[value]):
                if k != now:
                    if now is not None:
                        done.append({key: now, **asdict(state)})
                    now, state = k, SourceState()
                state.apply(e, None if pd.isna(v) else float(v))
            if done:
                yield pd.DataFrame(done)
        if now is not None:
            yield pd.DataFrame([{key: now, **asdict(state)}])

    rows = events.select(key, *order, kind, value).where(f"{key} IS NOT NULL").repartition(key).sortWithinPartitions(key, *order)
    return rows.select(key, kind, value).mapInPandas(run, f"{key} long, {STATE}")
