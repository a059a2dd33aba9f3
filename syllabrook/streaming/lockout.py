"""The failure window of :mod:`syllabrook.operators.stateful` over a stream of attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from syllabrook.operators.stateful import FailurePolicy


def failure_stream(events: DataFrame, key: str, at: str, failed: Column, order: str, policy: FailurePolicy) -> DataFrame:
    """The same as a stream: one row of totals for each key and batch, state kept by the engine; late rows are folded as they come."""
    second = 1_000_000
    rows = events.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(order).cast("long").alias("o"), failed.alias("f"))

    def fold(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, start, until, recorded, blocks, ignored = state.get if state.exists else (0, 0, -1, 0, 0, 0)
        for at_, _, f in pd.concat(batches)[["t", "o", "f"]].sort_values(["t", "o"]).itertuples(index=False):
            if until > at_:
                ignored += 1
            elif not f:
                n, start, until = 0, 0, -1
            else:
                fresh = n == 0 or start <= at_ - policy.window * second
                n, start = (1, at_) if fresh else (n + 1, start)
                hit = n >= policy.limit
                until = at_ + policy.block * second if hit else -1
                recorded, blocks = recorded + 1, blocks + int(hit)
        state.update(tuple(map(int, (n, start, until, recorded, blocks, ignored))))
        yield pd.DataFrame({"key": [keys[0]], "gravadas": [recorded], "bloqueios": [blocks], "ignoradas": [ignored]})

    schema = "n int, inicio long, ate long, gravadas int, bloqueios int, ignoradas int"
    return rows.groupBy("key").applyInPandasWithState(fold, "key long, gravadas int, bloqueios int, ignoradas int", schema, "update", GroupStateTimeout.NoTimeout)
