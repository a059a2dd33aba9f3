"""Text matching: topics, token-bounded chunks, cosine and pair-local TF-IDF, top-k evidence, coverage, triage, recall.

Every operator works on rows keyed by a pair of courses, so chunks meet only within their pair (an
equality join on the pair), never in a product of all chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from syllabrook.functions.text import ACCENTED, PLAIN, evidence_key, list_pieces, sentence_pieces
from syllabrook.operators import lexical

#: The sections of a course in the order in which they are cut into chunks.
SECTION_ORDER = ("ementa", "conteudo_programatico", "objetivo_geral", "objetivos_especificos", "objetivos_nao_classificados", "competencias_habilidades")
#: Pairs of chunks of one pair of courses that are scored together.
PRODUCTS = 1 << 20
_LISTS = ("conteudo_programatico", "objetivos_especificos", "objetivos_nao_classificados")


def topics(section: Column, text: Column) -> Column:
    """Topics of a section's text: lists by line and semicolon, the syllabus by sentence, others whole."""
    whole = F.filter(F.array(F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")), lambda x: x != "")
    return F.when(section.isin(*_LISTS), list_pieces(text)).when(section == "ementa", sentence_pieces(text)).otherwise(whole)


def packed(text: Column, limit: int) -> Column:
    """A topic in runs of at most ``limit`` words, as many words each as fit (T1b with one token a word)."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: i % limit == 0)
    return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, limit), " ")), lambda x: x != "")


def chunks(courses: DataFrame, key: str, limit: int) -> DataFrame:
    """Chunks of courses: (key, secao, indice, texto), numbered from 0 within each section."""
    if limit < 1:
        raise ValueError("limit must be positive")
    sections = F.array(*(F.struct(F.lit(s).alias("secao"), F.col(s).alias("t")) for s in SECTION_ORDER))
    rows = courses.select(key, F.inline(sections)).filter("t is not null")
    parts = F.flatten(F.transform(topics(F.col("secao"), F.col("t")), lambda x: packed(x, limit)))
    return rows.select(key, "secao", F.posexplode(parts).alias("indice", "texto"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in doubles, within [-1, 1]; null for empty, unequal, zero or non-finite ones."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    value = F.try_divide(dot, norm(a) * norm(b))
    return F.when((F.size(a) == F.size(b)) & value.isNotNull() & ~F.isnan(value), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def normalized(v: Column) -> Column:
    """A vector of length one in doubles, null for a zero vector."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def grams(text: Column) -> Column:
    """Character n-grams of 3 to 5 within padded words, lower case, without accents (T2 preprocessing); short words come once."""
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    words = F.filter(F.split(plain, r"(?U)\s+"), lambda w: w != "")
    each = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column) -> Column:
        sizes = F.filter(F.array(F.lit(3), F.lit(4), F.lit(5)), lambda n: (n == 3) | (F.length(w) >= n))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, n))))

    return F.flatten(F.transform(each, of))


def lexical_pairs(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """TF-IDF cosine of all chunks of each pair: (par, destino, origem, lexical), pairs of chunks without a shared gram left out.

    Inputs are (par, id, texto). Frequencies are those of the pair's own texts, which meet in one task; a
    pair of courses with more than ``PRODUCTS`` pairs of chunks is scored in blocks of targets, each of
    which knows all its texts.
    """
    both = targets.select("par", F.lit(True).alias("alvo"), "id", "texto").unionByName(sources.select("par", F.lit(False).alias("alvo"), "id", "texto"))
    # words between single blanks, one before and one after
    plain = F.regexp_replace(F.concat(F.lit(" "), F.translate(F.lower(F.coalesce("texto", F.lit(""))), ACCENTED, PLAIN), F.lit(" ")), r"(?U)\s+", " ")
    texts = both.filter("par is not null").select("par", "alvo", "id", plain.alias("plain"))
    all_of = Window.partitionBy("par")
    a, b = F.count_if("alvo").over(all_of), F.count_if(~F.col("alvo")).over(all_of)
    sized = texts.withColumn("blocks", F.greatest(F.lit(1), F.least(a, F.ceil(a * b / PRODUCTS))).cast("int"))
    spread = sized.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")) == F.col("block")
    kind = F.when(~F.col("alvo"), lexical.SOURCE).when(own, lexical.OWN).otherwise(lexical.OTHER)
    rows = spread.select("par", "block", kind.alias("kind"), "id", "plain").repartition("par", "block").sortWithinPartitions("par", "block", "kind", "id")
    ids = both.schema["id"].dataType
    schema = StructType([both.schema["par"], StructField("destino", ids), StructField("origem", ids), StructField("lexical", DoubleType())])
    return rows.mapInArrow(lexical.cosines, schema).filter("destino is not null and origem is not null")


def top_evidence(scored: DataFrame, k: int, hybrid: bool) -> DataFrame:
    """Per (par, destino) the ``k`` best sources by ``semantica``, with ``hybrid`` also the ``k`` best by ``lexical``.

    Ties go to the smaller source; scores are compared at nine decimals. One window pass for each score.
    """
    if k < 1:
        raise ValueError("k must be positive")

    def rank(c: str) -> Column:
        return F.row_number().over(Window.partitionBy("par", "destino").orderBy(F.desc_nulls_last(F.round(c, 9)), "origem"))

    ranked = scored.withColumn("posicao", rank("semantica"))
    if not hybrid:
        return ranked.filter(F.col("posicao") <= k)
    return ranked.withColumn("posicao_lexical", rank("lexical")).filter((F.col("posicao") <= k) | (F.col("posicao_lexical") <= k))


def consolidated(evidence: DataFrame) -> DataFrame:
    """Evidence (par, destino, origem, texto, semantica) without repeats: per topic the best of each normalized text, and the counts."""
    keyed = evidence.withColumn("chave", evidence_key("texto"))
    w = Window.partitionBy("par", "destino", "chave").orderBy(F.desc(F.round("semantica", 9)), "origem")
    return keyed.withColumn("repetida", F.row_number().over(w) > 1)


@dataclass(frozen=True)
class TriagePolicy:
    """Limits of a triage; topics at ``topic`` or more are covered."""

    topic: float = 0.75
    apt: float = 0.85
    not_apt: float = 0.30

    def __post_init__(self) -> None:
        if not 0 <= self.topic <= 1 or not 0 <= self.not_apt < self.apt <= 1:
            raise ValueError("limits must lie in 0..1, the lower below the upper")


def coverage(evidence: DataFrame, policy: TriagePolicy) -> DataFrame:
    """Topics of each pair and how many have evidence at the limit or above (A4, N8): (par, topicos, cobertos, cobertura)."""
    best = evidence.groupBy("par", "destino").agg(F.max("semantica").alias("melhor"))
    out = best.groupBy("par").agg(F.count("*").alias("topicos"), F.count_if(F.col("melhor") >= policy.topic).alias("cobertos"))
    return out.withColumn("cobertura", F.try_divide("cobertos", "topicos"))


def workload_compatible(source_total: Column, source_unit: Column, target_total: Column, target_unit: Column) -> Column:
    """Whether a source course is at least as long as the target; null if a total or a common unit is missing."""
    known = source_total.isNotNull() & target_total.isNotNull() & (F.coalesce(source_unit, F.lit("")) != "") & (source_unit == target_unit)
    return F.when(known, source_total >= target_total)


def triage(status: Column, topics_total: Column, covered: Column, workload: Column, policy: TriagePolicy) -> Column:
    """The indication for a compared pair (T8), decided in the order of the specification."""
    share = F.try_divide(covered, topics_total)
    return (
        F.when((status != "comparado") | share.isNull(), "TALVEZ_APTO")
        .when(~workload, "NAO_APTO")
        .when((share >= policy.apt) & workload, "APTO_A_DISPENSA")
        .when(share < policy.not_apt, "NAO_APTO")
        .otherwise("TALVEZ_APTO")
    )


def recall(retrieved: DataFrame, relevant: DataFrame, keys: list[str]) -> DataFrame:
    """Found and total labelled pairs, distinct retrieved ones and the recall, as one row (T10, A6, J16); null without labels."""
    labels = relevant.select(*keys).distinct()
    got = retrieved.select(*keys).distinct()
    marked = labels.join(got.withColumn("_hit", F.lit(1)), keys, "left")
    found = marked.agg(F.count("_hit").alias("encontrados"), F.count("*").alias("rotulados"))
    return found.join(F.broadcast(got.agg(F.count("*").alias("recuperados")))).withColumn("revocacao", F.try_divide("encontrados", "rotulados"))  # one row each
