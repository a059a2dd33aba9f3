"""Keyed state with time rules as a batch fold: failure windows with a block, sessions, tokens used once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FailurePolicy:
    """Limits of the failure window: so many failures within a window block a key for a time (seconds)."""

    limit: int = 5
    window: int = 15 * 60
    block: int = 15 * 60


def _after(state: Column, at: Column, failed: Column, policy: FailurePolicy) -> Column:
    """State after an attempt: struct<n, inicio, ate, gravadas, bloqueios, ignoradas>, times in microseconds."""
    second = 1_000_000
    blocked = state["ate"] > at
    fresh = (state["n"] == 0) | (state["inicio"] <= at - policy.window * second)
    n = F.when(fresh, F.lit(1)).otherwise(state["n"] + 1)
    hit = ~fresh & (n >= policy.limit) | fresh & (F.lit(policy.limit) <= 1)
    none = F.lit(None).cast("long")

    def made(n: Column, start: Column, until: Column, recorded: Column, blocks: Column, ignored: Column) -> Column:
        return F.struct(n.cast("int").alias("n"), start.alias("inicio"), until.alias("ate"), recorded.alias("gravadas"), blocks.alias("bloqueios"), ignored.alias("ignoradas"))

    ignored = made(state["n"], state["inicio"], state["ate"], state["gravadas"], state["bloqueios"], state["ignoradas"] + 1)
    failure = made(n, F.when(fresh, at).otherwise(state["inicio"]), F.when(hit, at + policy.block * second).otherwise(none), state["gravadas"] + 1, state["bloqueios"] + F.when(hit, 1).otherwise(0), state["ignoradas"])
    cleared = made(F.lit(0), none, none, state["gravadas"], state["bloqueios"], state["ignoradas"])
    return F.when(blocked, ignored).when(failed, failure).otherwise(cleared)


def failure_windows(events: DataFrame, key: str, at: str, failed: Column, order: str, policy: FailurePolicy) -> DataFrame:
    """Per key the failures recorded, those that blocked it and attempts ignored while blocked (K1, K2, K3).

    The window begins at the first failure of a run and is over at its full age; a success clears the
    state. Attempts are folded in order of time, ties by ``order``; null keys are left out.
    """
    rows = events.filter(F.col(key).isNotNull()).select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(order).alias("o"), failed.alias("f"))
    start = F.expr("named_struct('n', 0, 'inicio', cast(null as bigint), 'ate', cast(null as bigint), 'gravadas', 0, 'bloqueios', 0, 'ignoradas', 0)")
    ordered = F.array_sort(F.collect_list(F.struct("t", "o", "f")))
    state = F.aggregate(ordered, start, lambda s, x: _after(s, x["t"], x["f"], policy))
    return rows.groupBy(key).agg(state.alias("s")).select(key, F.col("s.gravadas").alias("gravadas"), F.col("s.bloqueios").alias("bloqueios"), F.col("s.ignoradas").alias("ignoradas"))


def last_before(rows: DataFrame, key: str, at: str, order: str, opening: Column, name: str) -> DataFrame:
    """Adds ``name``: the time of the last opening row of the key before each row (as-of by one window, no join)."""
    w = Window.partitionBy(key).orderBy(at, order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(opening, F.col(at)), ignorenulls=True).over(w))
