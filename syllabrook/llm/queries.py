"""Queries of the training-data problems over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabrook.llm import canonical, containers, entities, mixture, near_duplicates, neighbours, pieces, scans, sentences
from syllabrook.llm.name_forms import COURSE_SHORT, INSTITUTION_SHORT
from syllabrook.session import cut_lineage
from syllabrook.sources.tables import once, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that had to be cut: those with a second piece."""
    cut = pieces.pieces(table(spark, folder, "trecho_academico"), "trecho_id", "texto")
    return cut.filter("peca = 1").select(F.col("id").alias("trecho_id")).distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk in pieces of at most 128 tokens, 16 of them repeated from the piece before."""
    chunks = once(table(spark, folder, "trecho_academico").select("trecho_id", "texto"), "trecho_id")
    return pieces.pieces(chunks, "trecho_id", "texto").withColumnRenamed("id", "trecho_id")


def p1_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every chunk that its pieces hold, those they repeat counted once, and whether all pieces keep the limit."""
    out = p1_pieces(spark, folder).groupBy("trecho_id").agg((F.sum("tokens") - 16 * (F.count("*") - 1)).alias("tokens"), F.bool_and(F.col("tokens") <= 128).alias("no_limite"))
    return out.withColumn("tokens", F.greatest("tokens", F.lit(0)))


def _courses(spark: SparkSession, folder: str) -> DataFrame:
    """ementa, a line break and conteudo_programatico of every record as one text."""
    records = table(spark, folder, "disciplina_equivalencia")
    whole = F.concat_ws("\n", F.coalesce("ementa", F.lit("")), F.coalesce("conteudo_programatico", F.lit("")))
    return records.select("registro_id", whole.alias("texto"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records at similarity 0.6 or more."""
    return near_duplicates.similar_pairs(_courses(spark, folder), "registro_id", "texto")


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with the group of courses it tells the same as, and its number of links."""
    return near_duplicates.groups(_courses(spark, folder), "registro_id", "texto").withColumnRenamed("id", "registro_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks at cosine 0.85 or more of which one is among the other's five most similar."""
    vectors = table(spark, folder, "representacao_vetorial")
    lists = neighbours.nearest(vectors, "trecho_id", "vetor", k=5, least=0.8499)
    return neighbours.mutual_pairs(lists, 0.85).select(F.col("id_a").alias("trecho_id_a"), F.col("id_b").alias("trecho_id_b"))


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar other chunks of every chunk with a vector."""
    vectors = table(spark, folder, "representacao_vetorial")
    lists = neighbours.nearest(vectors, "trecho_id", "vetor", k=5)
    return lists.select(F.col("id").alias("trecho_id"), F.col("rank").alias("posicao"), F.col("other").alias("vizinho_id"), F.round("similarity", 4).alias("similaridade"))


def _fields(spark: SparkSession, folder: str) -> DataFrame:
    """ementa and conteudo_programatico of every record as (key, campo, text), re-sent records once."""
    records = once(table(spark, folder, "disciplina_equivalencia").select("registro_id", "ementa", "conteudo_programatico"), "registro_id")
    fields = F.array(*(F.struct(F.lit(c).alias("campo"), F.col(c).alias("text")) for c in ("ementa", "conteudo_programatico")))
    return records.select(F.col("registro_id").alias("key"), F.inline(fields))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of scanning noise in each syllabus field."""
    return scans.defects(_fields(spark, folder)).withColumnRenamed("key", "registro_id")


def p5_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Every syllabus field as continuous text; fields without scanning noise as they are."""
    return scans.repaired(_fields(spark, folder)).withColumnRenamed("key", "registro_id")


def _mapped(spark: SparkSession, folder: str, name: str) -> DataFrame:
    forms, short = {"instituicao": (canonical.institution_forms, INSTITUTION_SHORT), "curso": (canonical.course_forms, COURSE_SHORT)}[name]
    return canonical.map_values(table(spark, folder, name), f"{name}_id", "nome", forms(table(spark, folder, f"{name}_referencia"), short), short)


def p6_mapped(spark: SparkSession, folder: str) -> DataFrame:
    """Every institution and course of study with its reference entry, -1 where there is none."""
    sql = "SELECT 'instituicao' AS tabela, id, referencia_id FROM {a} UNION ALL SELECT 'curso' AS tabela, id, referencia_id FROM {b}"
    return spark.sql(sql, a=_mapped(spark, folder, "instituicao"), b=_mapped(spark, folder, "curso"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The same for the rows whose name is not letter for letter in the reference list."""
    odd = """SELECT '{name}' AS tabela, m.id, m.referencia_id FROM {{mapped}} m LEFT SEMI JOIN (
      SELECT {name}_id AS id FROM {{typed}} t WHERE NOT EXISTS (SELECT 1 FROM {{listed}} r WHERE r.nome = t.nome)
    ) o ON m.id = o.id"""
    a, b = (
        spark.sql(odd.format(name=name), mapped=_mapped(spark, folder, name), typed=table(spark, folder, name), listed=table(spark, folder, f"{name}_referencia"))
        for name in ("instituicao", "curso")
    )
    return spark.sql("SELECT * FROM {a} UNION ALL SELECT * FROM {b}", a=a, b=b)


def _linked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Entities of course units within their institution, and of institutions that the reference list lacks."""
    units = entities.link(table(spark, folder, "disciplina"), "disciplina_id", "nome", "instituicao_id", entities.course_units, established=True)
    rows = table(spark, folder, "instituicao")
    # written once: the match is read by several steps, each of which would plan and run it again
    unlisted = cut_lineage(_mapped(spark, folder, "instituicao").filter("referencia_id = -1").select(F.col("id").alias("instituicao_id")))
    other = rows.join(unlisted, "instituicao_id", "left_semi")
    return units, entities.link(other, "instituicao_id", "nome", None, entities.institutions, established=False)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows of one course unit or institution."""
    out = [entities.linked_pairs(x).select(F.lit(name).alias("tabela"), "id_a", "id_b") for name, x in zip(("disciplina", "instituicao"), _linked(spark, folder), strict=True)]
    return out[0].unionByName(out[1])


def p7_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Every row that names something with the entity it belongs to."""
    out = [x.select(F.lit(name).alias("tabela"), "id", "escopo", "nivel", "nome") for name, x in zip(("disciplina", "instituicao"), _linked(spark, folder), strict=True)]
    return out[0].unionByName(out[1])


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text in containers of 2,048 tokens."""
    return containers.containers(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Code points of every document that are in containers, and whether all its containers keep the limit."""
    held = p8_containers(spark, folder)
    full = held.groupBy("recipiente").agg(F.sum("tokens").alias("cheio"))
    return held.join(full, "recipiente").groupBy("doc_id").agg(F.sum(F.char_length("texto")).alias("letras"), F.bool_and(F.col("cheio") <= 2048).alias("no_limite"))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture with the times each is used, and the share its source reaches beside the one wanted."""
    mixed = mixture.mix(table(spark, folder, "documents"), table(spark, folder, "mistura_alvo"))
    shares = mixed.shares.select("fonte", "peso", "alcancado")
    return mixed.documents.join(F.broadcast(shares.filter("peso > 0")), "fonte", "left").select(F.col("id").alias("doc_id"), "fonte", "prevista", "peso", "alcancado", "tokens", "repeticoes", "texto")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares wanted and really reached of every source, and how its documents are used."""
    return mixture.mix(table(spark, folder, "documents"), table(spark, folder, "mistura_alvo")).shares


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The end of every sentence of every document."""
    return sentences.sentences(table(spark, folder, "documents"), "doc_id", "text", spell=False).withColumnRenamed("id", "doc_id")


def p10_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text as its sentences."""
    return sentences.sentences(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Code points other than white space of every document that are in sentences."""
    letters = F.char_length(F.regexp_replace("frase", r"(?U)\s+", ""))
    return p10_sentences(spark, folder).groupBy("doc_id").agg(F.sum(letters).alias("letras"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_coverage": p1_coverage, "p2_found": p2_found, "p2_groups": p2_groups, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p5_found": p5_found, "p5_repaired": p5_repaired, "p6_found": p6_found, "p6_mapped": p6_mapped, "p7_found": p7_found, "p7_entities": p7_entities, "p8_containers": p8_containers, "p8_coverage": p8_coverage, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_sentences": p10_sentences, "p10_coverage": p10_coverage}


def oracle_sql() -> dict[str, str]:
    """SQL by brute force: all records that share a pair of words, all pairs of vectors."""
    return {
        "p1_found": r"SELECT DISTINCT trecho_id FROM trecho_academico WHERE len(regexp_extract_all(texto, '[^ \t\n\x{00a0}]+')) > 128",
        "p2_found": r"""WITH t AS (SELECT registro_id AS id, any_value(regexp_extract_all(strip_accents(lower(coalesce(ementa, '') || chr(10) || coalesce(conteudo_programatico, ''))), '\p{L}+')) AS w FROM disciplina_equivalencia GROUP BY 1),
g AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM t WHERE len(w) >= 50)), n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
j AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM j JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE c / (a.n + b.n - c) >= 0.6""",
        "p2_groups": r"""WITH RECURSIVE t AS (SELECT registro_id AS id, any_value(coalesce(ementa, '') || chr(10) || coalesce(conteudo_programatico, '')) AS texto FROM disciplina_equivalencia GROUP BY 1),
w AS (SELECT id, regexp_extract_all(strip_accents(lower(texto)), '\p{L}+') AS w FROM t), g AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) >= 50)), n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
j AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
e AS (SELECT j.a, j.b FROM j JOIN n x ON x.id = j.a JOIN n y ON y.id = j.b WHERE c / (x.n + y.n - c) >= 0.6 UNION SELECT x.id, y.id FROM t x JOIN t y ON x.texto = y.texto AND x.id <> y.id WHERE regexp_matches(x.texto, '[\p{L}\p{N}]')),
r AS (SELECT id, id AS grupo FROM t UNION SELECT e.b, r.grupo FROM r JOIN e ON e.a = r.id WHERE r.grupo < e.b)
SELECT r.id AS registro_id, min(r.grupo) AS grupo, any_value(coalesce(l.n, 0)) AS ligacoes FROM r LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY 1) l ON l.a = r.id GROUP BY 1""",
        "p1_coverage": r"SELECT trecho_id, any_value(len(regexp_extract_all(texto, '[^ \t\n\x{00a0}]+'))) AS tokens, TRUE AS no_limite FROM trecho_academico WHERE texto IS NOT NULL GROUP BY 1",
        "p8_coverage": r"SELECT doc_id, length(text) AS letras, TRUE AS no_limite FROM documents WHERE regexp_matches(text, '[^\s\x0b\x{85}\p{Z}]')",
        "p10_coverage": r"SELECT doc_id, length(regexp_replace(text, '[\s\x0b\x{85}\p{Z}]+', '', 'g')) AS letras FROM documents WHERE regexp_matches(text, '[^\s\x0b\x{85}\p{Z}]')",
        "p4_found": """WITH v AS (SELECT trecho_id AS id, vetor::DOUBLE[] AS v FROM representacao_vetorial WHERE list_dot_product(vetor::DOUBLE[], vetor::DOUBLE[]) > 0),
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.id <> b.id), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(s, 6) DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS trecho_id_a, greatest(a, b) AS trecho_id_b FROM t WHERE s >= 0.85""",
    }
