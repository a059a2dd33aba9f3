"""Amounts recorded in different units, converted to common minutes.

Every amount is given to a calibrated tree ensemble: a random forest on magnitude, source, category and
the neighbouring fields, among them what the unit field, the raw text cell and the running text seem to
say. It is fitted on at most ``TRAIN_ROWS`` rows with a stated unit, half of them with those readings
hidden, and its confidence is calibrated by isotonic regression on held-out rows whose readings are
hidden, as they are where no unit is stated. An exact check follows: a unit that is stated stands,
whatever was predicted. Other amounts with a calibrated confidence of ``CONFIDENT`` or more are
converted, the rest come out for review without minutes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabrook.functions.text import unaccent
from syllabrook.session import cut_lineage
from syllabrook.sources.tables import once

TRAIN_ROWS = 20_000
CONFIDENT = 0.9
BUCKETS = 512
CODES = ("HORA", "HORA_AULA", "CREDITO", "MINUTO", "HORA_SEMANAL")

# Spellings of the units, on lower-case letters without accents or other signs.
SPELLINGS = (
    ("HORA_SEMANAL", r"^(h|hs|hr|hrs|hora|horas)(por|p|a)?(sem|sems|semana|semanas|semanal|semanais)$"),
    ("HORA_AULA", r"^(h|hs|hr|hrs|hora|horas)?(a|as|aula|aulas)$"),
    ("HORA", r"^(h|hs|hr|hrs|hora|horas)(r|rel|relogio)?$"),
    ("CREDITO", r"^(c|cr|crs|cred|creds|credito|creditos)$"),
    ("MINUTO", r"^(m|min|mins|minuto|minutos)$"),
)
# Portuguese number words.
NUMBER_WORDS = {
    "um": 1, "uma": 1, "dois": 2, "duas": 2, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10, "onze": 11, "doze": 12,
    "treze": 13, "quatorze": 14, "catorze": 14, "quinze": 15, "dezesseis": 16, "dezessete": 17, "dezoito": 18, "dezenove": 19, "vinte": 20, "trinta": 30,
    "quarenta": 40, "cinquenta": 50, "sessenta": 60, "setenta": 70, "oitenta": 80, "noventa": 90, "cem": 100, "cento": 100, "duzentos": 200, "duzentas": 200,
    "trezentos": 300, "trezentas": 300, "quatrocentos": 400, "quatrocentas": 400, "quinhentos": 500, "quinhentas": 500, "seiscentos": 600, "seiscentas": 600,
    "setecentos": 700, "setecentas": 700, "oitocentos": 800, "oitocentas": 800, "novecentos": 900, "novecentas": 900, "mil": 1000,
}
# A unit as it stands after an amount in running text, with the usual misreadings of scanned pages.
_RUNNING_UNIT = (
    r"(h[o0]ras?\s*(?:[-/]\s*)?au[l1]as?|h\s?/\s?a\b|h\.\s?a\b\.?|h-a\b|au[l1]as?\b|"
    r"h(?:[o0]ra)?s?\s*(?:/|p[o0]r\s|a\s)?\s*sem(?:ana[l1i]?(?:is|s)?)?\b|h[o0]ra[s5]?\b(?:\s*(?:de\s+)?re[l1]og[i1]o)?|h(?:r?s)?\b|"
    r"cr[ec]d[i1l]t[o0][s5]?\b|cr[ec]d\b|crs?\b|(?:m|rn)[i1l]nut[o0][s5]?\b|min\b|')"
)
_RUNNING = r"(\d[\d.,:]*)\s*(?:\([^)]{1,40}\)\s*)?\(?\s*" + _RUNNING_UNIT
_NUMBER_WORD = r"\b(?:" + "|".join([*NUMBER_WORDS, "e"]) + r")\b"


def unit_of(spelling: Column) -> Column:
    """The unit code that a spelling names, null if none (``-``, ``???``, ``NAO_INFO``, blank, null)."""
    letters = F.regexp_replace(unaccent(spelling), "[^a-z]", "")
    out = F.when(F.trim(spelling) == "'", F.lit("MINUTO"))
    for code, pattern in SPELLINGS:
        out = out.when(letters.rlike(pattern), F.lit(code))
    return out


def number_of(digits: Column) -> Column:
    """A number as people write it: 67,5 · 67.5 · 1.200 · 36:30 (hours and minutes); null if it is none."""
    clean = F.rtrim(digits, F.lit(".,:"))
    clock = F.regexp_extract(clean, r"^\d+", 0).cast("double") + F.regexp_extract(clean, r":(\d\d)$", 1).try_cast("double") / 60
    grouped = F.regexp_replace(clean, r"[.](?=\d{3}(\D|$))", "")
    return F.when(clean.rlike(r"^\d+:\d\d$"), clock).otherwise(F.replace(grouped, F.lit(","), F.lit(".")).try_cast("double"))


def spelled_number(folded: Column) -> Column:
    """The value of the number words of a text (lower case, no accents), null without any."""
    words = F.regexp_extract_all(folded, F.lit(r"\b(" + "|".join(NUMBER_WORDS) + r")\b"), F.lit(1))
    table = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in pair))
    value = F.aggregate(words, F.lit(0), lambda acc, w: F.when(w == "mil", F.greatest(acc, F.lit(1)) * 1000).otherwise(acc + table[w]))
    return F.when(F.size(words) > 0, value.cast("double"))


def cell_amount(cell: Column) -> tuple[Column, Column]:
    """Number and unit code of a raw amount cell such as ``CH: 67,5 hs``, ``créditos: 4``, ``oitenta horas-aula`` or ``1.800'``."""
    folded = unaccent(cell)
    digits = F.regexp_extract(folded, r"\d[\d.,:]*", 0)
    number = F.when(digits != "", number_of(digits)).otherwise(spelled_number(folded))
    rest = F.regexp_replace(F.regexp_replace(folded, r"\b(ch|total|carga|horaria|de)\b", " "), _NUMBER_WORD, " ")
    unit = F.when(folded.rlike(r"\d\s*['’´]"), F.lit("MINUTO")).otherwise(unit_of(F.regexp_replace(rest, r"[\d.,:;()]", "")))
    return number, unit


def running_unit(text: Column, amount: Column) -> Column:
    """The unit stated in running text with exactly this amount; other quantities in the text do not count."""
    flat = F.regexp_replace(F.regexp_replace(unaccent(text), "[-‐‑¬­][ \t]*\n[ \t]*", ""), r"\s+", " ")
    numbers = F.regexp_extract_all(flat, F.lit(_RUNNING), F.lit(1))
    units = F.regexp_extract_all(flat, F.lit(_RUNNING), F.lit(2))
    fitting = F.filter(F.arrays_zip(numbers.alias("n"), units.alias("u")), lambda x: number_of(x["n"]) == amount)
    repaired = F.replace(F.translate(F.get(fitting, 0)["u"], "015", "ois"), F.lit("rn"), F.lit("m"))
    # "crcditos" and "auia" are misreadings of the same words
    return unit_of(F.regexp_replace(F.regexp_replace(repaired, "crcd", "cred"), "auia", "aula"))


def stated_units(records: DataFrame, amounts: tuple[str, ...] = ("total", "teorica")) -> DataFrame:
    """Records with the resolved total and the stated unit and where it was found (``onde``: unidade, texto, ementa or null)."""
    number, cell_unit = cell_amount(F.col("carga_horaria_texto"))
    base = records.select("*", number.alias("_cell"), cell_unit.alias("_cell_unit"), unit_of(F.col("carga_horaria.unidade")).alias("_unit"))
    total = F.coalesce("carga_horaria.total", "_cell")
    base = base.select("*", total.alias("_total"))
    # a record that only has a theoretical amount may state the unit with that
    shown = F.coalesce("_total", "carga_horaria.teorica")
    needs = F.col("_unit").isNull() & F.col("_cell_unit").isNull() & shown.isNotNull() & F.col("ementa").isNotNull()
    base = base.select("*", F.when(needs, running_unit(F.col("ementa"), shown)).alias("_running"))
    where = F.when(F.col("_unit").isNotNull(), "unidade").when(F.col("_cell_unit").isNotNull(), "texto").when(F.col("_running").isNotNull(), "ementa")
    return base.select("*", F.coalesce("_unit", "_cell_unit", "_running").alias("unidade_comum"), where.alias("onde"))


def _features(stated: DataFrame) -> DataFrame:
    """Numeric features of each record: magnitude, divisibility, neighbouring fields, source and category bucket."""
    t = F.coalesce("_total", "carga_horaria.teorica", F.lit(0.0))
    theory, practice = F.col("carga_horaria.teorica"), F.col("carga_horaria.pratica")
    flags = [((t % F.lit(n)) == 0).cast("double").alias(f"d{n}") for n in (15, 17, 18, 20, 45, 50)]
    return stated.select(
        "*",
        F.log1p(F.abs(t)).alias("magnitude"),
        (t % 1).alias("fraction"),
        *flags,
        F.when(t != 0, F.coalesce(theory, F.lit(-1.0)) / t).otherwise(-1.0).alias("share_theory"),
        F.when(t != 0, F.coalesce(practice, F.lit(-1.0)) / t).otherwise(-1.0).alias("share_practice"),
        practice.isNull().cast("double").alias("no_practice"),
        F.coalesce(F.size("paginas_origem"), F.lit(0)).cast("double").alias("pages"),
        F.log1p(F.coalesce("_size", F.lit(0)).cast("double")).alias("words"),
        F.pmod(F.xxhash64(F.regexp_replace(unaccent(F.coalesce("instituicao", F.lit(""))), "[^a-z]", "")), F.lit(BUCKETS)).alias("source_bucket"),
        F.pmod(F.xxhash64(F.coalesce("matriz_codigo", F.lit("")), F.lit(1)), F.lit(BUCKETS)).alias("category_bucket"),
        *((F.coalesce(F.col("unidade_comum") == c, F.lit(False))).cast("double").alias(f"reads_{c}") for c in CODES),
    )


_READS = [f"reads_{c}" for c in CODES]
_NUMERIC = ["magnitude", "fraction", "d15", "d17", "d18", "d20", "d45", "d50", "share_theory", "share_practice", "no_practice", "pages", "words", *_READS]


def _with_shares(rows: DataFrame, bucket: str, shares: dict[int, list[float]], prior: list[float]) -> DataFrame:
    """Adds the share of each unit in a row's bucket; the joined table has ``BUCKETS`` rows."""
    names = [f"{bucket}_{i}" for i in range(len(CODES))]
    table = rows.sparkSession.createDataFrame([(i, *map(float, shares.get(i, prior))) for i in range(BUCKETS)], f"{bucket} long, " + ", ".join(f"{n} double" for n in names))
    return rows.join(F.broadcast(table), bucket, "left")


def _isotonic(confidence: np.ndarray, right: np.ndarray) -> list[tuple[float, float]]:
    """Steps (from confidence, calibrated value) by pooling adjacent violators."""
    order = np.argsort(confidence, kind="stable")
    blocks: list[list[float]] = []
    for c, r in zip(confidence[order], right[order], strict=True):
        blocks.append([c, r, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, r2, n2 = blocks.pop()
            blocks[-1][1] += r2
            blocks[-1][2] += n2
    # one success and one failure are added to each block, so a block of a few rows gives no certainty; never falling
    values = np.maximum.accumulate([(r + 1) / (n + 2) for _, r, n in blocks]) if blocks else []
    return [(b[0], float(v)) for b, v in zip(blocks, values, strict=True)]


class UnitModel:
    """A fitted forest with its bucket tables and calibration steps."""

    def __init__(self, forest: RandomForestClassificationModel, tables: dict[str, dict[int, list[float]]], prior: list[float], steps: list[tuple[float, float]], accuracy: float) -> None:
        self.forest, self.tables, self.prior, self.steps, self.accuracy = forest, tables, prior, steps, accuracy

    def columns(self, rows: DataFrame) -> DataFrame:
        """Feature columns, assembled."""
        for bucket, shares in self.tables.items():
            rows = _with_shares(rows, bucket, shares, self.prior)
        names = _NUMERIC + [f"{b}_{i}" for b in self.tables for i in range(len(CODES))]
        return VectorAssembler(inputCols=names, outputCol="_features", handleInvalid="keep").transform(rows)

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``previsto`` (unit code) and ``confianca`` (calibrated)."""
        scored = self.forest.transform(self.columns(rows))
        p = vector_to_array("probability")
        best = F.array_max(p)
        calibrated = F.lit(0.0)
        for start, value in self.steps:
            calibrated = F.when(best >= start, F.lit(float(value))).otherwise(calibrated)
        codes = F.array(*(F.lit(c) for c in CODES))
        return scored.select(*rows.columns, F.get(codes, F.col("prediction").cast("int")).alias("previsto"), calibrated.alias("confianca"))


def fit(stated: DataFrame, rows: int = TRAIN_ROWS, seed: int = 5) -> UnitModel | None:
    """Fit on at most ``rows`` records with a stated unit, a third of them held out for calibration; None without two units."""
    known = stated.filter("unidade_comum is not null and _total is not null").orderBy(F.xxhash64("registro_id", F.lit(seed)), "registro_id").limit(rows)
    train = _features(known).select("registro_id", "unidade_comum", "source_bucket", "category_bucket", *_NUMERIC, F.xxhash64("registro_id", F.lit(seed + 1)).alias("_order"))
    train = train.withColumn("held", F.pmod("_order", F.lit(3)) == 0).withColumn("label", F.array_position(F.array(*(F.lit(c) for c in CODES)), F.col("unidade_comum")).cast("double") - 1)
    hidden = F.col("held") | (F.pmod("_order", F.lit(2)) == 0)
    train = cut_lineage(train.withColumns({c: F.when(hidden, 0.0).otherwise(F.col(c)) for c in _READS}))
    counts = np.zeros(len(CODES))
    tables: dict[str, dict[int, list[float]]] = {}
    for bucket in ("source_bucket", "category_bucket"):
        seen: dict[int, np.ndarray] = {}
        for r in train.filter("not held").groupBy(bucket, "label").count().collect():  # at most BUCKETS * units rows
            seen.setdefault(int(r[0]), np.zeros(len(CODES)))[int(r[1])] += r[2]
        counts = reduce(np.add, seen.values(), np.zeros(len(CODES)))
        prior = ((counts + 1) / (counts.sum() + len(CODES))).tolist()
        tables[bucket] = {k: ((v + 4 * np.array(prior)) / (v.sum() + 4)).tolist() for k, v in seen.items()}
    if (counts > 0).sum() < 2:
        return None
    model = UnitModel(None, tables, prior, [], 0.0)  # type: ignore[arg-type]
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=24, maxDepth=7, minInstancesPerNode=3, seed=seed)
    model.forest = forest.fit(model.columns(train.filter("not held")))
    held = model.forest.transform(model.columns(train.filter("held"))).select(F.array_max(vector_to_array("probability")), F.col("prediction") == F.col("label")).collect()  # at most a third of ``rows``
    if held:
        confidence, right = np.array([r[0] for r in held]), np.array([float(r[1]) for r in held])
        model.steps, model.accuracy = _isotonic(confidence, right), float(right.mean())
    return model


def convert(records: DataFrame, units: DataFrame, confident: float = CONFIDENT, rows: int = TRAIN_ROWS) -> DataFrame:
    """Amounts in minutes: (registro_id, campo, valor, unidade, unidade_original, previsto, metodo, confianca, minutos, acuracia).

    ``previsto`` is the forest's unit, ``acuracia`` its share of right units on held-out rows with hidden
    readings. ``metodo`` says where the unit comes from: unidade, texto, ementa (stated), previsto (predicted with
    enough confidence) or revisar (left for review, minutes null). An amount that is unknown gives no
    row: a null total is taken from the raw cell, a null teorica stays unknown. Re-sent records count
    once. Without enough stated units to learn from, all other amounts go to review. Empty tables give
    an empty result.
    """
    needed = ["registro_id", "instituicao", "matriz_codigo", "ementa", "carga_horaria", "carga_horaria_texto", "paginas_origem"]
    # texts are read once, of the syllabus only its length stays; re-sent rows go before anything is counted
    read = stated_units(records.select(*needed)).withColumn("_size", F.char_length("ementa")).drop("ementa")
    stated = cut_lineage(once(read.filter("registro_id is not null"), "registro_id"))
    model = fit(stated, rows)
    if model is None:
        scored = stated.withColumn("previsto", F.lit(None).cast("string")).withColumn("confianca", F.lit(0.0))
    else:
        scored = model.predict(_features(stated)).select(*stated.columns, "previsto", "confianca")
    is_stated = F.col("onde").isNotNull()
    both = scored.select(
        *stated.columns,
        "previsto",
        F.coalesce("unidade_comum", "previsto").alias("unidade_final"),
        F.when(is_stated, F.col("onde")).when(F.col("confianca") >= confident, "previsto").otherwise("revisar").alias("metodo"),
        F.when(is_stated, F.lit(1.0)).otherwise(F.col("confianca")).alias("confianca"),
    )
    accuracy = F.lit(None if model is None else round(model.accuracy, 4)).cast("double")
    amounts = F.array(F.struct(F.lit("total").alias("campo"), F.col("_total").alias("valor")), F.struct(F.lit("teorica").alias("campo"), F.col("carga_horaria.teorica").alias("valor")))
    each = both.select("registro_id", F.col("carga_horaria.unidade").alias("unidade_original"), F.inline(amounts), "unidade_final", "previsto", "metodo", "confianca").filter("valor is not null")
    minutes = units.groupBy(F.col("codigo").alias("unidade_final")).agg(F.max("minutos").alias("_each"))
    value = F.round(F.col("valor") * F.col("_each"), 0).cast("long")
    return each.join(minutes, "unidade_final", "left").select(
        "registro_id", "campo", "valor", F.col("unidade_final").alias("unidade"), "unidade_original", "previsto", "metodo", F.round("confianca", 4).alias("confianca"),
        F.when(F.col("metodo") != "revisar", value).alias("minutos"), accuracy.alias("acuracia"),
    )
