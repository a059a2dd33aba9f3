"""Problem 9: texts of several sources mixed to target shares of all tokens.

Method: soft-membership mixing. Every document belongs to the domains (sources) by posteriors: one
that names its source belongs to it, one that does not gets the posteriors of a classifier fitted on a
bounded sample (``TRAIN_ROWS``) of those that do. Projected-gradient least squares, run over all
documents in each step, fits nonnegative rates of use, at most a document's permitted repetitions,
whose expected tokens a domain meet the targets. Each error is weighted by the domain's supply, so one
step size suits large and small sources. A rate is a function of a document's posteriors and the
errors of the steps before, so steps keep no state; all that is collected is one number a domain.

Rates become whole repetitions by hashes: a histogram of hashes by domain (``CELLS`` cells) says in
which cells a document is used once more for the domain's tokens to come out right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabrook.llm import tokens
from syllabrook.session import cut_lineage

TRAIN_ROWS = 10_000
FEATURES = 1 << 12
STEPS, CLOSE = 60, 1e-7
CELLS = 8192


class Classifier:
    """Posteriors of the domains of a document from its words and labels, and the share of held-out documents it gets right."""

    def __init__(self, domains: list[str], model: LogisticRegressionModel | None, classes: list[int], accuracy: float | None) -> None:
        self.domains, self.model, self.classes, self.accuracy = domains, model, classes, accuracy

    def posteriors(self, rows: DataFrame) -> DataFrame:
        """Adds ``p``, one number for each domain; without a model all domains are as likely."""
        if self.model is None:
            share = 1.0 / max(1, len(self.domains))
            return rows.withColumn("p", F.array(*(F.lit(share) for _ in self.domains)))
        seen = vector_to_array("probability")
        at = {c: i for i, c in enumerate(self.classes)}
        each = [F.round(F.get(seen, at[d]), 6) if d in at else F.lit(0.0) for d in range(len(self.domains))]
        return self.model.transform(_features(rows)).select(*rows.columns, F.array(*each).alias("p"))


def _features(rows: DataFrame) -> DataFrame:
    words = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")
    labels = F.array(*(F.concat(F.lit(f"{c}="), F.lower(F.coalesce(c, F.lit("")))) for c in ("lang", "tipo")))
    return HashingTF(inputCol="_words", outputCol="_features", numFeatures=FEATURES, binary=True).transform(rows.withColumn("_words", F.concat(labels, words)))


def fit_classifier(labelled: DataFrame, domains: list[str], rows: int = TRAIN_ROWS) -> Classifier:
    """Fit on at most ``rows`` documents (id, text, lang, tipo, domain) chosen by a hash of their id, a fifth of them held out to measure accuracy."""
    order = F.xxhash64("id", F.lit(3))
    sample = labelled.select("id", "text", "lang", "tipo", "domain", order.alias("order")).orderBy("order", "id").limit(rows)
    sample = cut_lineage(_features(sample).select("_features", "domain", (F.pmod("order", F.lit(5)) == 0).alias("held")))
    classes = sorted(r[0] for r in sample.filter("not held").select("domain").distinct().collect())  # at most as many as domains
    if len(classes) < 2:
        return Classifier(domains, None, classes, None)
    index = F.create_map(*(x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))))
    train = sample.withColumn("label", index[F.col("domain")])
    model = LogisticRegression(featuresCol="_features", family="multinomial", maxIter=20, regParam=0.02).fit(train.filter("not held"))
    right = model.transform(train.filter("held and label is not null")).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    return Classifier(domains, model, classes, right)


def rates(p: np.ndarray, cap: np.ndarray, errors: list[np.ndarray]) -> np.ndarray:
    """Rates of documents (posteriors ``p``, most uses ``cap``) after the projected-gradient steps with these weighted errors."""
    r = np.zeros(len(p))
    for e in errors:
        r = np.clip(r - p @ e, 0.0, cap)
    return r


def _expected(groups: DataFrame, errors: list[np.ndarray], size: int) -> np.ndarray:
    """Expected tokens of each domain at the rates that follow from ``errors``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for b in batches:
            if len(b):
                p = np.stack(b["p"].to_numpy())
                total += (rates(p, b["cap"].to_numpy(), errors) * b["tokens"].to_numpy()) @ p
        yield pd.DataFrame({"domain": np.arange(size), "tokens": total})

    out = np.zeros(size)
    for r in groups.mapInPandas(run, "domain int, tokens double").groupBy("domain").agg(F.sum("tokens")).collect():  # one row a domain
        out[r[0]] = r[1]
    return out


def fit_rates(groups: DataFrame, weights: np.ndarray, total: float | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps of the projected gradient on groups (p, cap, tokens): (weighted errors, tokens wanted, tokens expected) by domain.

    Without ``total`` the mixture is as large as it can be while every domain with documents reaches its share.
    """
    size = len(weights)
    each = groups.select(F.posexplode("p").alias("d", "share"), "cap", "tokens").groupBy("d").agg(F.sum(F.col("share") * F.col("tokens")).alias("supply"), F.sum(F.col("share") * F.col("tokens") * F.col("cap")).alias("most"))
    supply, most = np.zeros(size), np.zeros(size)
    for r in each.collect():  # one row a domain
        supply[r[0]], most[r[0]] = r[1], r[2]
    usable = (weights > 0) & (most > 0)
    share = np.where(usable, weights, 0.0)
    if not share.sum():
        return [], share, share
    share /= share.sum()
    whole = float((most[usable] / share[usable]).min()) if total is None else total
    want = share * whole
    errors: list[np.ndarray] = []
    reached = np.zeros(size)
    for _ in range(STEPS):
        off = reached - want
        if np.abs(off).max() <= CLOSE * whole:
            break
        errors.append(np.where(supply > 0, off / np.maximum(supply, 1e-9), 0.0))
        before, reached = reached, _expected(groups, errors, size)
        if len(errors) > 1 and np.abs(reached - before).max() <= CLOSE * whole:
            break
    return errors, want, reached


class Mixture:
    """A fitted mixture: documents in it, and shares wanted and reached."""

    def __init__(self, documents: DataFrame, shares: DataFrame) -> None:
        self.documents, self.shares = documents, shares


def _hash(c: Column) -> Column:
    """A number from 0 to 1 for a document."""
    return F.pmod(F.xxhash64(c, F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def mix(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total: float | None = None, vocabulary: str = tokens.VOCABULARY) -> Mixture:
    """Mix ``documents`` (with ``lang`` and ``tipo``) to ``targets`` (source, peso, max_repeticoes).

    ``documents`` of the result: (id, fonte, prevista, tokens, repeticoes, texto), one row for each
    document that is used; ``fonte`` is the named source or the likeliest one (``prevista``). ``shares``:
    (fonte, peso, alcancado, tokens, esperado, documentos, usados, maior_repeticao, acuracia), one row
    for each source of the targets or the documents; ``alcancado`` is its share of the mixture's tokens,
    a document without a source counting by its posteriors. A source of the targets without documents
    has share 0 and the others keep their proportions; a source without target is not used, whatever its
    size. Null and blank texts are not used. A repeated row of targets counts once; targets without
    weight, and empty tables, give an empty mixture. Ids must be unique.
    """
    spark = documents.sparkSession
    rows = targets.filter("source is not null").groupBy("source").agg(F.max("peso").alias("peso"), F.max("max_repeticoes").alias("cap")).orderBy("source").collect()  # a table of targets, not of data
    domains = [r["source"] for r in rows]
    other = len(domains)  # all sources without a target
    weights = np.array([float(r["peso"] or 0) for r in rows] + [0.0])
    caps = np.array([float(max(0, r["cap"] or 0)) for r in rows] + [0.0])
    data = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), "lang", "tipo", F.nullif(F.trim(source_col), F.lit("")).alias("source")).filter(r"text rlike '(?U)\\S'")
    index = F.create_map(*(x for i, d in enumerate(domains) for x in (F.lit(d), F.lit(i)))) if domains else F.create_map().cast("map<string,int>")
    data = data.withColumn("domain", F.when(F.col("source").isNotNull(), F.coalesce(index[F.col("source")], F.lit(other))))
    classifier = fit_classifier(data.filter("domain is not null"), [*domains, ""])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["tokens"] = [tokens.size(t, vocabulary) for t in b["text"]]
            yield b.drop(columns="text")

    own = F.transform(F.sequence(F.lit(0), F.lit(other)), lambda i: (i == F.col("domain")).cast("double"))
    named = data.filter("domain is not null").select("id", "text", "source", own.alias("p"))
    guessed = classifier.posteriors(data.filter("domain is null").select("id", "text", "lang", "tipo", "source")).select("id", "text", "source", "p")
    likeliest = F.array_position("p", F.array_max("p")).cast("int") - 1
    sized = named.unionByName(guessed).mapInPandas(count, "id long, source string, p array<double>, tokens long")
    cap = F.array(*(F.lit(c) for c in caps))
    sized = cut_lineage(sized.withColumn("g", likeliest).withColumn("cap", F.get(cap, F.col("g"))))
    # documents with the same posteriors have the same rate
    groups = cut_lineage(sized.groupBy("p", "cap").agg(F.sum("tokens").cast("double").alias("tokens")))
    errors, _, _ = fit_rates(groups, weights, total)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["rate"] = rates(np.stack(b["p"].to_numpy()), b["cap"].to_numpy(), errors) if len(b) else np.zeros(0)
            yield b

    rated = sized.mapInPandas(rate, "id long, source string, p array<double>, tokens long, g int, cap double, rate double")
    rated = rated.withColumn("whole", F.floor(F.col("rate") + 1e-6)).withColumn("rest", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    rated = rated.withColumn("v", F.when(F.col("rest") > 1e-6, _hash(F.col("id")) / F.col("rest")))
    # documents without a source are decided one by one; what they miss or exceed, the others of each domain make up for
    lone = F.when(F.col("source").isNull(), F.when(F.col("v") < 1, 1).otherwise(0))
    missed = rated.filter("source is null").select(F.posexplode("p").alias("d", "part"), ((F.col("rest") - lone) * F.col("tokens")).alias("t"))
    missed = {r["d"]: r["t"] for r in missed.groupBy("d").agg(F.sum(F.col("part") * F.col("t")).alias("t")).collect()}  # one row a domain
    # tokens by domain and cell: at most domains * CELLS rows
    cell = F.floor(F.col("v") / (1 + F.col("v")) * CELLS).cast("int")
    histogram = rated.filter("v is not null and source is not null").groupBy("g", cell.alias("cell")).agg(F.sum("tokens").alias("t"), F.sum(F.col("rest") * F.col("tokens")).alias("want")).collect()
    once_more = []
    for g in range(other + 1):
        cells = sorted((r["cell"], r["t"], r["want"]) for r in histogram if r["g"] == g)
        want, above = sum(w for _, _, w in cells) + missed.get(g, 0.0), 0.0
        # cells in order of their hash, then those that still fit
        for c, t, _ in cells:
            if abs(above + t - want) < abs(above - want):
                above += t
                once_more.append((g, c))
    cells = spark.createDataFrame(once_more, "g int, cell int").withColumn("more", F.lit(1))
    rated = rated.withColumn("cell", cell).join(F.broadcast(cells), ["g", "cell"], "left")
    used = rated.withColumn("repeticoes", (F.col("whole") + F.coalesce(lone, F.when(F.col("v").isNotNull(), F.col("more")), F.lit(0))).cast("int"))
    used = cut_lineage(used.select("id", "source", "p", "g", "tokens", "rate", "repeticoes"))

    name = F.get(F.array(*(F.lit(d) for d in domains), F.lit(None).cast("string")), F.col("g"))
    fonte = F.coalesce("source", name)
    plan = used.filter("repeticoes > 0").select("id", fonte.alias("fonte"), F.col("source").isNull().alias("prevista"), "tokens", "repeticoes")
    mixed = data.select("id", F.col("text").alias("texto")).join(plan, "id").select("id", "fonte", "prevista", "tokens", "repeticoes", "texto")

    soft = used.select(F.posexplode("p").alias("d", "part"), "tokens", "rate", "repeticoes").filter("part > 0").groupBy("d")
    soft = soft.agg(F.sum(F.col("part") * F.col("tokens") * F.col("repeticoes")).alias("t"), F.sum(F.col("part") * F.col("tokens") * F.col("rate")).alias("e"))
    hard = used.groupBy(F.coalesce(fonte, F.lit("")).alias("fonte")).agg(F.count("*").alias("documentos"), F.count_if(F.col("repeticoes") > 0).alias("usados"), F.max("repeticoes").alias("maior_repeticao"))
    base = spark.createDataFrame([(i, d, float(weights[i])) for i, d in enumerate(domains)], "d int, fonte string, peso double")
    whole = soft.agg(F.sum("t").alias("all"))
    shares = base.join(soft, "d", "left").join(hard, "fonte", "full_outer").join(F.broadcast(whole))  # ``whole`` is one row
    shares = shares.select(
        "fonte",
        F.coalesce("peso", F.lit(0.0)).alias("peso"),
        F.round(F.coalesce(F.try_divide("t", "all"), F.lit(0.0)), 6).alias("alcancado"),
        F.round(F.coalesce("t", F.lit(0.0)), 0).cast("long").alias("tokens"),
        F.round(F.coalesce("e", F.lit(0.0)), 0).cast("long").alias("esperado"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documentos", "usados", "maior_repeticao")),
        F.lit(None if classifier.accuracy is None else round(classifier.accuracy, 4)).cast("double").alias("acuracia"),
    )
    return Mixture(mixed, shares)
