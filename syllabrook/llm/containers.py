"""Problem 8: texts in containers of a fixed number of tokens with as little space left as possible.

Method: bin completion by branch and bound. Around the largest text left, fillings of the rest of its
container are enumerated by waste; a filling is dominated, and left out, if a text that is left could
stand for some of its texts and waste no more. The waste of a branch is bounded by what the best
solution so far may waste and still be beaten; first incumbents are a best-fit-decreasing solution and
the one that always takes the fullest filling. A solution that meets the lower bound (all tokens over
the limit, rounded up) ends the search, else ``EFFORT`` nodes do; the search never leaves a text out.

Texts of one length are interchangeable, so all this runs on the histogram of lengths, at most
``limit`` entries however many texts there are, and a filling serves as many containers as there are
texts for. A text finds its container by its number among the texts of its length, which Spark
counts in buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syllabrook.llm import tokens
from syllabrook.session import cut_lineage

ROWS_PER_BUCKET = 100_000
EFFORT, BRANCHES = 400, 3

Filling = dict[int, int]
Plan = list[tuple[int, Filling]]


def fillings(gap: int, counts: Filling, lengths: list[int], most: int) -> Iterator[Filling]:
    """Fillings of ``gap`` by texts left (``lengths`` descending), one for each of the ``most`` fullest sums, fullest first."""
    mask = (1 << (gap + 1)) - 1
    reach, steps = 1, []
    for n in lengths:
        left = min(counts[n], gap // n) if n <= gap else 0
        share = 1
        while left > 0 and (most > 1 or not reach >> gap & 1):
            take = min(share, left)
            steps.append((n, take, reach))
            reach |= (reach << n * take) & mask
            left -= take
            share *= 2
    for _ in range(most):
        if not reach:
            return
        at = reach.bit_length() - 1
        reach ^= 1 << at
        out: Filling = {}
        for n, take, before in reversed(steps):
            if at and not before >> at & 1:
                out[n] = out.get(n, 0) + take
                at -= n * take
        yield out


def dominated(filling: Filling, gap: int, counts: Filling, lengths: list[int]) -> bool:
    """Whether one text that is left could stand for some texts of the filling and fill at least as much."""
    waste = gap - sum(n * k for n, k in filling.items())
    sums = 1
    for n, k in filling.items():
        for _ in range(k):
            sums |= sums << n
    for x in lengths:
        if x > gap or counts[x] <= filling.get(x, 0):
            continue
        # sums of some texts of the filling from x - waste to x, without nothing and without x by itself
        low = max(1, x - waste)
        if sums >> low & ((1 << (x - low + (0 if x in filling else 1))) - 1):
            return True
    return False


def best_fit(histogram: Filling, limit: int) -> Plan:
    """Best-fit decreasing: each text, longest first, into the fullest container that takes it."""
    groups: list[list] = []  # space left, how many alike, filling
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left:
            open_groups = [g for g in groups if g[0] >= n and g[1]]
            group = min(open_groups, key=lambda g: g[0]) if open_groups else [limit, left, {}]
            each = min(group[0] // n, left)
            times = min(group[1], left // each)
            if open_groups:
                group[1] -= times
            groups.append([group[0] - each * n, times, {**group[2], n: each}])
            left -= each * times
        groups = [g for g in groups if g[1]]
    return [(g[1], g[2]) for g in groups]


def _size(plan: Plan) -> int:
    return sum(t for t, _ in plan)


def fill(histogram: Filling, limit: int, effort: int = EFFORT) -> Plan:
    """Containers for all lengths of a histogram: (how many alike, how many of each length in one)."""
    start = {n: c for n, c in histogram.items() if c}
    total = sum(n * c for n, c in start.items())
    least = -(-total // limit)
    best = best_fit(start, limit)
    nodes = 0
    branches: list[tuple[Filling, Plan, int, int]] = [(start, [], 0, 0)]  # texts left, plan so far, its containers, its waste
    while branches and _size(best) > least:
        counts, plan, used, waste = branches.pop()
        counts, plan = dict(counts), list(plan)
        lengths = sorted((n for n in counts if counts[n]), reverse=True)
        spare = (_size(best) - 1) * limit - total  # a better solution wastes no more than this
        while lengths and waste <= spare:
            first = lengths[0]
            counts[first] -= 1
            found = enumerate(fillings(limit - first, counts, lengths, BRANCHES if nodes < effort else 1))
            ways = [own for i, own in found if i == 0 or not dominated(own, limit - first, counts, lengths)]
            counts[first] += 1
            for own in ways:
                own[first] = own.get(first, 0) + 1
            for own in ways[1:]:
                extra = limit - sum(n * k for n, k in own.items())
                if nodes < effort and waste + extra <= spare:
                    nodes += 1
                    branches.append(({n: c - own.get(n, 0) for n, c in counts.items()}, [*plan, (1, own)], used + 1, waste + extra))
            own = ways[0]
            times = min(counts[n] // k for n, k in own.items())
            for n, k in own.items():
                counts[n] -= times * k
            used, waste = used + times, waste + times * (limit - sum(n * k for n, k in own.items()))
            plan.append((times, own))
            lengths = [n for n in lengths if counts[n]]
        if not lengths and used < _size(best):
            best = plan
    return best


def _places(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: from which number on, in which container and how many of them in one."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    container = 0
    for times, own in plan:
        for n, k in own.items():
            start = used.get(n, 0)
            rows.setdefault(n, []).append((start, container, k))
            used[n] = start + times * k
        container += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*x, strict=True)) for n, x in rows.items()}


def containers(texts: DataFrame, id_col: str, text_col: str, limit: int = 2048, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Every text with its container: (id, peca, tokens, recipiente, texto).

    Sizes are tokens of the public tokenizer in ``vocabulary``. Only a text of more than ``limit`` tokens
    comes in pieces (``peca`` from 0), all but the last as full as characters allow. Null and blank texts
    take no space and give no row. Ids must be unique; other columns are not read.
    """
    data = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(r"text rlike '(?U)\\S'")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, k, n, a, b) for key, text in zip(batch["id"], batch["text"], strict=True) for k, (a, b, n) in enumerate(tokens.parts(text, limit, vocabulary))]
            yield pd.DataFrame(rows, columns=["id", "peca", "tokens", "inicio", "fim"])

    # texts are read by the tokenizer once; without their words they take little space
    sizes = cut_lineage(data.mapInPandas(split, "id long, peca int, tokens int, inicio int, fim int"))
    histogram = {r[0]: r[1] for r in sizes.groupBy("tokens").count().collect()}  # at most ``limit`` rows
    places = texts.sparkSession.sparkContext.broadcast(_places(fill(histogram, limit)))
    buckets = max(1, sum(histogram.values()) // ROWS_PER_BUCKET)
    sizes = sizes.withColumn("bucket", F.pmod(F.xxhash64("id", "peca"), F.lit(buckets)).cast("int"))
    before = sizes.groupBy("tokens", "bucket").agg(F.count("*").alias("c"))
    before = before.select("tokens", "bucket", (F.sum("c").over(Window.partitionBy("tokens").orderBy("bucket")) - F.col("c")).alias("before"))
    ranked = sizes.withColumn("own", F.row_number().over(Window.partitionBy("tokens", "bucket").orderBy("id", "peca")) - 1)
    ranked = ranked.join(before, ["tokens", "bucket"]).select("id", "peca", "tokens", "inicio", "fim", (F.col("before") + F.col("own")).alias("number"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number, out = batch["number"].to_numpy(), np.zeros(len(batch), np.int64)
            for n, at in batch.groupby("tokens").indices.items():
                start, container, k = places.value[n]
                p = np.searchsorted(start, number[at], "right") - 1
                out[at] = container[p] + (number[at] - start[p]) // k[p]
            batch["recipiente"] = out
            yield batch[["id", "peca", "tokens", "inicio", "fim", "recipiente"]]

    placed = ranked.mapInPandas(place, "id long, peca int, tokens int, inicio int, fim int, recipiente long")
    return data.join(placed, "id").select("id", "peca", "tokens", "recipiente", F.substring("text", F.col("inicio") + 1, F.col("fim") - F.col("inicio")).alias("texto"))
