"""Problem 4: the k most similar vectors of every vector.

Method: shifted space-filling curves. Vectors are projected on a few principal directions, turned
and shifted at random once per curve, and ordered along a Hilbert curve; Spark range-partitions
each ordering, every row meets the rows of its key window there, and the curves' short lists are
merged and cut to the best k. Where a range ends, its last rows and the first of the next range meet in
a step of their own, so every window is whole. Equal vectors are folded to one representative before
that and unfolded after, so copies fill no windows. Rows with equal keys are ordered by a finer key
within the cell, then at random, anew on each curve; windows have a fixed width, so a hot cell costs no
more than others.

Only the model of the directions is fitted on a bounded sample (``SAMPLE`` vectors); every vector is
indexed. Components travel as 16-bit integers: a cosine is right to about 2e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syllabrook.session import cut_lineage

SAMPLE = 8192
DIMS, BITS = 12, 5
#: Orderings and rows of a window on either side, for all uses.
CURVES, WINDOW = 6, 4096
ROWS_PER_PARTITION = 131_072
SCALE = 32_767


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each integer point (n, d) with ``bits`` bits a side on the d-dimensional Hilbert curve (d*bits <= 63)."""
    x = np.ascontiguousarray(cells.T).astype(np.int64)
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def fit_curves(sample: np.ndarray, curves: int, dims: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per curve a projection (d, dims) and an offset that map vectors into the unit cube, from a bounded sample."""
    rng = np.random.default_rng(seed)
    size = sample.shape[1]
    mean = sample.mean(0) if len(sample) else np.zeros(size)
    spread = np.cov((sample - mean).T) if len(sample) > 1 else np.eye(size)
    _, axes = np.linalg.eigh(np.atleast_2d(spread))
    axes = axes[:, ::-1][:, : max(dims, size * 3 // 4)]
    out = []
    for _ in range(curves):
        turn, _ = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))
        way = axes @ turn[:, :dims]
        seen = (sample - mean) @ way if len(sample) else np.ones((1, way.shape[1]))
        scale = np.maximum(seen.std(0), 1e-6) * 6
        out.append(((way / scale).astype(np.float32), (0.5 - mean @ way / scale + rng.uniform(-0.08, 0.08, way.shape[1])).astype(np.float32)))
    return out


def _unit_rows(column: pa.ChunkedArray | pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the wanted length with a finite norm above zero, as unit vectors, and their positions."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    fit = np.flatnonzero(lengths == size)
    if not len(fit):
        return np.zeros((0, size), np.float32), fit
    flat = column.take(pa.array(fit)).flatten().fill_null(float("nan"))
    x = np.asarray(flat, dtype=np.float32).reshape(-1, size)
    norm = np.linalg.norm(x.astype(np.float64), axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return (x[good] / norm[good, None]).astype(np.float32), fit[good]


def _packer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _unit_rows(batch.column(1), size)
            if not len(at):
                continue
            packed = np.rint(x * SCALE).astype("<i2")
            q = pa.Array.from_buffers(pa.binary(size * 2), len(at), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), q], ["id", "q"])

    return run


def _unpacked(column: pa.Array, size: int) -> np.ndarray:
    q = column.cast(pa.binary(size * 2))
    x = np.frombuffer(q.buffers()[1], "<i2", count=(q.offset + len(q)) * size)[q.offset * size :].reshape(-1, size).astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return x


def _indexer(model: list, size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _unpacked(batch.column(1), size)
            for curve, (way, offset) in enumerate(model):
                fine = np.clip(np.floor((x @ way + offset) * (1 << 2 * bits)), 0, (1 << 2 * bits) - 1).astype(np.int64)
                keys = hilbert_keys(fine >> bits, bits), hilbert_keys(fine & ((1 << bits) - 1), bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(batch), curve, np.int32)), *map(pa.array, keys), batch.column(0), batch.column(1)], ["curve", "key", "fine", "id", "q"]
                )

    return run


class _Best:
    """The k best partners of each row, from pairs that arrive in blocks."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.held = k, [], 0

    def add(self, row: np.ndarray, other: np.ndarray, sim: np.ndarray) -> None:
        self.parts.append((row, other, sim))
        self.held += len(row)
        if self.held > 2_000_000:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, other, sim = (np.concatenate(c) for c in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        order = np.lexsort((other, -sim, row))
        row, other, sim = row[order], other[order], sim[order]
        first = np.searchsorted(row, row)
        good = np.arange(len(row)) - first < self.k
        self.parts = [(row[good], other[good], sim[good])]
        self.held = int(good.sum())
        return self.parts[0]


def _window_pairs(x: np.ndarray, start: int, stop: int, window: int, least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows start..stop with up to ``window`` later rows that reach ``least``; both directions. Positions are relative to ``x``."""
    rows, cols, sims = [], [], []
    step = 256
    for i in range(start, stop, step):
        n = min(step, stop - i)
        end = min(len(x), i + n + window)
        s = x[i : i + n] @ x[i:end].T
        s[np.tril_indices(n)] = -2
        if least > -1:
            r, c = np.nonzero(s >= least)
            v = s[r, c]
            rows += [r + i, c + i]
            cols += [c + i, r + i]
            sims += [v, v]
        else:
            for m, base, other in ((s, i, i), (np.ascontiguousarray(s.T), i, i)):
                top = min(k, m.shape[1])
                c = np.argpartition(-m, top - 1, axis=1)[:, :top] if m.shape[1] > top else np.tile(np.arange(m.shape[1]), (m.shape[0], 1))
                r = np.repeat(np.arange(m.shape[0]), c.shape[1])
                c = c.ravel()
                v = m[r, c]
                real = v > -1.5
                rows.append(r[real] + base)
                cols.append(c[real] + other)
                sims.append(v[real])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(sims)


def _lists(ids: np.ndarray, best: _Best) -> Iterator[pa.RecordBatch]:
    """The best partners of each row as batches (id, minus_sim, other)."""
    row, other, sim = best.shrink()
    keys, first = np.unique(row, return_index=True)
    for at in range(0, len(keys), 8192):
        lo = first[at]
        hi = first[at + 8192] if at + 8192 < len(keys) else len(row)
        offsets = pa.array(np.append(first[at : at + 8192], hi) - lo, pa.int32())
        near = pa.ListArray.from_arrays(offsets, pa.array(np.clip(-np.round(sim[lo:hi].astype(np.float64), 6), -1, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[keys[at : at + 8192]]), near, pa.ListArray.from_arrays(offsets, pa.array(ids[other[lo:hi]]))], ["id", "minus_sim", "other"])


def _ends(window: int):
    """The first and last ``window`` rows of each curve in a range, with the number of the seam they lie at and their place from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        head: dict[int, int] = {}
        tail: list[pa.RecordBatch] = []

        def shown(batch: pa.RecordBatch, seam: int, place: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), seam, np.int32)), batch.column(0), pa.array(place.astype(np.int32)), batch.column(3), batch.column(4)], ["seam", "curve", "place", "id", "q"])

        for batch in batches:
            curves = np.asarray(batch.column(0))
            for curve in np.unique(curves):
                own = batch.filter(pa.array(curves == curve))
                seen = head.get(int(curve), 0)
                if part > 0 and seen < window:
                    first = own.slice(0, window - seen)
                    yield shown(first, part - 1, seen + 1 + np.arange(len(first)))
                head[int(curve)] = seen + len(own)
            tail.append(batch)
            while len(tail) > 1 and sum(map(len, tail[1:])) >= window:
                tail.pop(0)
        rest = pa.Table.from_batches(tail).combine_chunks().to_batches() if tail else []
        for batch in rest:
            last = batch.slice(max(0, len(batch) - window))
            last = last.filter(pa.array(np.asarray(last.column(0)) == np.asarray(last.column(0))[-1]))
            yield shown(last, part, np.arange(-len(last) + 1, 1))

    return run


def _seams(size: int, window: int, k: int, least: float):
    """Pairs across a seam that lie within ``window`` rows of each other; a group holds at most two windows of a curve."""

    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks()
        curve, place = np.asarray(batch.column("curve")), np.asarray(batch.column("place"))
        ids, x = np.asarray(batch.column("id")), _unpacked(batch.column("q").combine_chunks(), size)
        best = _Best(k)
        for c in np.unique(curve):
            own = np.flatnonzero(curve == c)
            before, after = own[place[own] <= 0], own[place[own] > 0]
            for at in range(0, len(before), 512):
                if not len(after):
                    break
                rows = before[at : at + 512]
                s = x[rows] @ x[after].T
                s[place[after][None, :] - place[rows][:, None] > window] = -2
                r, n = np.nonzero(s >= max(least, -1.5))
                if least <= -1:  # only the best of each row and of each column can be in a list
                    top = min(k, s.shape[1])
                    bound_r = -np.partition(-s, top - 1, axis=1)[:, top - 1]
                    low = min(k, s.shape[0])
                    bound_c = -np.partition(-s, low - 1, axis=0)[low - 1]
                    good = (s[r, n] >= bound_r[r]) | (s[r, n] >= bound_c[n])
                    r, n = r[good], n[good]
                v = s[r, n]
                best.add(np.concatenate([rows[r], after[n]]), np.concatenate([after[n], rows[r]]), np.concatenate([v, v]))
        out = list(_lists(ids, best))
        schema = pa.schema([("id", pa.int64()), ("minus_sim", pa.list_(pa.float64())), ("other", pa.list_(pa.int64()))])
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in out], schema)

    return run


def _windows(size: int, window: int, k: int, least: float):
    block = max(4096, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ids of the partition stay; of the vectors only a block and the window after it are held
        ids, base, x, best, curve = [], 0, np.zeros((0, size), np.float32), _Best(k), None
        count = 0

        def flush(final: bool) -> None:
            nonlocal x, base
            while len(x) and (final or len(x) >= block + window):
                stop = len(x) if final else len(x) - window
                r, c, v = _window_pairs(x, 0, stop, window, least, k)
                best.add(r + base, c + base, v)
                x, base = x[stop:], base + stop

        for batch in batches:
            curves = np.asarray(batch.column(0))
            for value in np.unique(curves):
                if curve is not None and value != curve:
                    flush(True)
                curve = value
                at = np.flatnonzero(curves == value)
                part = batch.slice(int(at[0]), len(at))
                x = np.concatenate([x, _unpacked(part.column(4), size)])
                ids.append(np.asarray(part.column(3)))
                count += len(at)
                flush(False)
        flush(True)
        if count:
            yield from _lists(np.concatenate(ids), best)

    return run


def nearest(vectors: DataFrame, id_col: str, vector_col: str, k: int = 5, size: int = 64, curves: int = CURVES, window: int = WINDOW, least: float = -1.0, seed: int = 7) -> DataFrame:
    """The ``k`` most similar other vectors of each vector: (id, rank, other, similarity).

    Vectors that are null, of another length, all zero or not finite take no part (no rows). Equal
    vectors are each other's neighbours at 1.0; ties go to the smaller id. ``least`` leaves out
    partners below a similarity, which shortens the lists on the way and changes none of the pairs
    above it. An empty table or a single vector gives an empty result. Ids must be long and not null;
    other columns are not read, so clashing names do no harm.
    """
    data = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).filter("id is not null and v is not null")
    rows = data.count()
    taken = data.filter(F.size("v") == size)
    if rows > SAMPLE:
        share = max(1, rows // SAMPLE)
        taken = taken.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(share)) == 0)
    sample, _ = _unit_rows(taken.select("v").limit(SAMPLE).toArrow().column(0).combine_chunks(), size)
    model = fit_curves(sample.astype(np.float64), curves, min(DIMS, size), seed)
    packed = data.mapInArrow(_packer(size), "id long, q binary")
    # classes of equal vectors by their digests; a vector itself is shuffled for them only if there are very many copies
    digests = packed.select("id", F.md5("q").alias("digest"))
    classes = digests.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    copies = cut_lineage(digests.join(classes, "digest").select("id", "first"))
    indexed = packed.join(copies.filter("id != first").select("id"), "id", "left_anti").mapInArrow(_indexer(model, size, BITS), "curve int, key long, fine long, id long, q binary")
    parts = max(1, -(-rows * curves // ROWS_PER_PARTITION))
    order = ("curve", "key", "fine", F.xxhash64("id", "curve"))
    ordered = indexed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = "id long, minus_sim array<double>, other array<long>"
    lists = ordered.mapInArrow(_windows(size, window, k, least), schema)
    if parts > 1:
        ends = ordered.mapInArrow(_ends(window), "seam int, curve int, place int, id long, q binary")
        lists = lists.unionByName(ends.groupBy("seam").applyInArrow(_seams(size, window, k, least), schema))
    merged = lists.groupBy("id").agg(F.flatten(F.collect_list(F.arrays_zip("other", "minus_sim"))).alias("all"))
    # one entry per partner, then the best k: ties go to the smaller id
    by_other = F.array_sort("all")
    single = F.filter(F.col("sorted"), lambda x, i: (i == 0) | (F.get("sorted", i - 1)["other"] != x["other"]))
    best = F.slice(F.array_sort(F.transform(F.col("single"), lambda x: F.struct(x["minus_sim"].alias("minus_sim"), x["other"].alias("other")))), 1, k)
    among = merged.select("id", by_other.alias("sorted")).select("id", single.alias("single")).select("id", F.inline(best))
    # unfold: a partner stands for its k smallest copies at least, and copies are each other's partners at 1.0
    number = F.row_number().over(Window.partitionBy("first").orderBy("id"))
    few = copies.withColumn("number", number).filter(F.col("number") <= k + 1).select("first", F.col("id").alias("copy"))
    partners = among.join(few.withColumnRenamed("first", "other"), "other", "left").select("id", "minus_sim", F.coalesce("copy", "other").alias("other"))
    partners = partners.unionByName(few.select(F.col("first").alias("id"), F.lit(-1.0).alias("minus_sim"), F.col("copy").alias("other")))
    nearest_first = F.slice(F.array_sort(F.collect_list(F.struct("minus_sim", "other"))), 1, k + 1)
    best_of = partners.groupBy("id").agg(nearest_first.alias("best"))
    rest = copies.filter("id != first")
    each = best_of.unionByName(rest.join(best_of.withColumnRenamed("id", "first"), "first").select("id", "best"))
    own = F.slice(F.filter("best", lambda x: x["other"] != F.col("id")), 1, k)
    return each.select("id", F.posexplode(own).alias("rank", "n")).select("id", (F.col("rank") + 1).alias("rank"), F.col("n.other").alias("other"), (-F.col("n.minus_sim")).alias("similarity"))


def mutual_pairs(lists: DataFrame, least: float) -> DataFrame:
    """Pairs (id_a < id_b) of a result of :func:`nearest` where either names the other with ``least`` similarity or more."""
    return lists.filter(F.col("similarity") >= least).select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
