"""Problem 2: groups of records that tell the same with small edits.

Method: deletion-variant signatures. The signature of a text is a vector of min-hash symbols. It is
cut into segments so few and long that a similar pair has a segment that differs in one symbol at
most; each segment is indexed under its variants with one symbol left out, equal variants are joined,
and the pairs are verified on the texts' sets of neighbouring words. The symbols are 64-bit min-hashes
of three-word runs rather than single bits: at similarity 0.6 two bit signatures differ in a fifth of
their places and unrelated ones in a half, which no variant with one wildcard tells apart.

A pair whose three-word runs are alike at r shares a variant of a segment with probability
r^5 + 5 r^4 (1 - r), so of ten segments at least one with 0.76 at a similarity of 0.6 (scattered one-word
edits, r about 0.45), 0.87 at 0.65, 0.96 at 0.7 and 0.99 at 0.75. Symbols of word pairs find 0.98 at 0.6,
but their candidates took more than the disk that is allowed (README).

Exact copies are folded first (an aggregation with map-side combine), so a text copied a million
times is indexed once. Variants shared by very many different texts are joined apart, salted; no bucket is
capped and no group is ever collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syllabrook.llm.wordcodes import mix, shingle_codes, word_codes
from syllabrook.session import cut_lineage, keep

SEGMENTS, SEGMENT_SIZE = 10, 5
BROADCAST_ROWS = 200_000
HOT, SALTS = 20_000, 16


def _signatures(texts: list[str], segments: int, length: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of three words or more: sorted distinct 32-bit codes of word pairs, where each text's begin, and variant keys."""
    codes, text = word_codes(texts)
    pairs, of = shingle_codes(codes, text, 2)
    sets = np.unique((of.astype(np.uint64) << np.uint64(32)) | (pairs >> np.uint64(32)))
    bounds = np.searchsorted(sets >> np.uint64(32), np.arange(len(texts) + 1))
    flat = (sets & np.uint64(0xFFFFFFFF)).astype("<u4")
    rng = np.random.default_rng(seed)
    runs, run_of = shingle_codes(codes, text, 3)
    count = segments * length
    factors, shifts = rng.integers(1, 2**63, count, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)
    first = np.searchsorted(run_of, np.arange(len(texts)))
    with np.errstate(over="ignore"):
        signature = np.stack([np.minimum.reduceat(mix(runs * a + b), first) for a, b in zip(factors, shifts, strict=True)], axis=1)
        keys = np.empty((len(texts), count), np.uint64)
        for s in range(segments):
            own = signature[:, s * length : (s + 1) * length]
            for left_out in range(length):
                key = np.full(len(texts), s * length + left_out + 1, np.uint64)
                for i in range(length):
                    if i != left_out:
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + own[:, i])
                keys[:, s * length + left_out] = key
    return flat, bounds, keys.view(np.int64)


def _coder(min_words: int, segments: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                texts = [t.replace("\x00", " ") for t in batch.column(1).to_pylist()]
                words = np.bincount(word_codes(texts)[1], minlength=len(texts))
                good = np.flatnonzero(words >= max(3, min_words))
                if not len(good):
                    continue
                flat, bounds, keys = _signatures([texts[i] for i in good], segments, length)
                sets = pa.Array.from_buffers(pa.binary(), len(good), [None, pa.py_buffer((bounds * 4).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                grid = pa.ListArray.from_arrays(pa.array(np.arange(len(good) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), sets, grid], ["id", "pairs", "keys"])

    return run


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(len(batch))
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(a.as_buffer(), "<u4"), np.frombuffer(b.as_buffer(), "<u4")
                shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                out[i] = shared / (len(x) + len(y) - shared) if len(x) + len(y) else 0.0
            hit = pa.array(np.flatnonzero(out >= least))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(hit), batch.column(1).take(hit), pa.array(out).take(hit)], ["rep_a", "rep_b", "similarity"])

    return run


def _candidates(signed: DataFrame) -> DataFrame:
    """Pairs (rep_a < rep_b) that share a variant. Variants are shuffled once; keys of more than ``HOT`` rows are joined apart, salted."""
    variants = keep(signed.select(F.explode("keys").alias("key"), "id").repartition("key"))
    hot = variants.groupBy("key").count().filter(F.col("count") > HOT).select("key")
    pairs = []
    calm = variants
    if hot.limit(1).count():
        hot = keep(hot)
        calm = variants.join(hot, "key", "left_anti")
        busy = variants.join(hot, "key", "left_semi")
        left = busy.select("key", F.col("id").alias("rep_a"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
        right = busy.select("key", F.col("id").alias("rep_b"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long").alias("salt"))
        pairs.append(left.join(right, ["key", "salt"]).select("rep_a", "rep_b"))
    left, right = calm.select("key", F.col("id").alias("rep_a")), calm.select("key", F.col("id").alias("rep_b"))
    pairs.append(left.join(right, "key").select("rep_a", "rep_b"))
    return reduce(DataFrame.union, pairs).filter("rep_a < rep_b").distinct()


def similar_texts(texts: DataFrame, id_col: str, text_col: str, least: float = 0.6, min_words: int = 50, segments: int = SEGMENTS, length: int = SEGMENT_SIZE) -> tuple[DataFrame, DataFrame]:
    """Pairs of representatives (rep_a < rep_b, similarity) and the membership (rep, id) of exact copies.

    Similarity is that of the sets of neighbouring words. Texts that are null, empty or short of
    ``min_words`` words are members of their own class of copies but of no pair. A repeated row (same
    id) counts once. An empty table gives empty results; other columns are not read.
    """
    data = texts.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id is not null")
    # a text without a letter or digit tells nothing and is the copy of none: it is a class by itself
    void = ~F.col("text").rlike(r"[\p{L}\p{N}]")
    coded = data.select("id", F.when(void, F.col("id")).otherwise(F.xxhash64("text")).alias("h1"), F.when(void, F.lit(0)).otherwise(F.xxhash64(F.lit(1), "text")).alias("h2"))
    classes = coded.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    members = keep(coded.join(classes, ["h1", "h2"]).select("rep", "id").distinct())
    copies = members.filter("rep <> id").select("id")
    few = copies.count() <= BROADCAST_ROWS
    unique = data.join(F.broadcast(copies) if few else copies, "id", "left_anti")
    signed = keep(unique.select("id", "text").mapInArrow(_coder(min_words, segments, length), "id long, pairs binary, keys array<long>"))
    sets = keep(signed.select("id", "pairs").dropDuplicates(["id"]))
    sets.count()  # fills both caches once, before two branches ask for them at a time
    candidates = _candidates(signed)
    a, b = sets.toDF("rep_a", "set_a"), sets.toDF("rep_b", "set_b")
    checked = candidates.join(a, "rep_a").join(b, "rep_b").select("rep_a", "rep_b", "set_a", "set_b").mapInArrow(_verify(least), "rep_a long, rep_b long, similarity double")
    return checked, members


def similar_pairs(texts: DataFrame, id_col: str, text_col: str, least: float = 0.6, min_words: int = 50) -> DataFrame:
    """All pairs (id_a < id_b) of similar records, copies spelled out."""
    pairs, members = similar_texts(texts, id_col, text_col, least, min_words)
    a, b = members.toDF("rep_a", "id_1"), members.toDF("rep_b", "id_2")
    between = pairs.join(a, "rep_a").join(b, "rep_b")
    # copies of one text: classes with more than one member, if the text has enough words
    enough = texts.select(F.col(id_col).cast("long").alias("rep_a"), F.regexp_count(F.col(text_col), F.lit(r"[\p{L}\p{Mn}]*\p{L}[\p{L}\p{Mn}]*")).alias("words")).filter(F.col("words") >= min_words)
    several = members.filter("rep <> id").select(F.col("rep").alias("rep_a")).distinct().join(enough.select("rep_a").distinct(), "rep_a", "left_semi")
    within = several.join(a, "rep_a").join(members.toDF("rep_a", "id_2"), "rep_a").filter("id_1 < id_2")
    return between.select("id_1", "id_2").union(within.select("id_1", "id_2")).select(F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b")).distinct()


def groups(texts: DataFrame, id_col: str, text_col: str, least: float = 0.6, min_words: int = 50) -> DataFrame:
    """Every record with its group (the smallest id linked to it) and its number of links: (id, grupo, ligacoes).

    Links join texts at ``least`` or more; a record also links to each of its exact copies. Copies are
    not spelled out into pairs.
    """
    from syllabrook.operators.components import components

    pairs, members = similar_texts(texts, id_col, text_col, least, min_words)
    pairs = cut_lineage(pairs.select("rep_a", "rep_b").distinct())
    sizes = members.groupBy("rep").agg(F.count("*").alias("copies"))
    ends = pairs.union(pairs.select("rep_b", "rep_a")).toDF("rep", "other")
    links = ends.join(sizes.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("copies").alias("linked"))
    group = components(pairs, "rep_a", "rep_b")
    full = members.join(sizes, "rep").join(links, "rep", "left").join(group.toDF("rep", "root"), "rep", "left")
    # representatives are their class's smallest id, so the smallest representative of a group is its smallest id
    return full.select("id", F.coalesce("root", "rep").alias("grupo"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("ligacoes"))
