"""Further reads over whole tables: orders, means, publication rules, routing, named comparisons, regions of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from syllabrook.plans.catalog import _MATCHES, _ONCE
from syllabrook.plans.matching import semantic_topk
from syllabrook.plans.registry import Registry
from syllabrook.sources.files import result_key
from syllabrook.sources.tables import once, table

registry = Registry()
query = registry.query


def _records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return once(table(spark, folder, "disciplina_equivalencia").select("registro_id", *columns), "registro_id")


@query(f"""SELECT registro_id, row_number() OVER (PARTITION BY matriz_codigo ORDER BY coalesce(list_min(paginas_origem), 999999), lower(nome) NULLS FIRST, registro_id) AS posicao FROM {_ONCE}""")
def record_order(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a grid by first page, those without a page last, then name."""
    w = Window.partitionBy("matriz_codigo").orderBy(F.coalesce(F.array_min("paginas_origem"), F.lit(999999)), F.asc_nulls_first(F.lower("nome")), "registro_id")
    return _records(spark, folder, "matriz_codigo", "paginas_origem", "nome").select("registro_id", F.row_number().over(w).cast("long").alias("posicao"))


@query(f"""SELECT avaliacao_id, count(*) AS correspondencias, count(similaridade) AS com_nota, round(avg(CASE WHEN abs(similaridade) <= 1 THEN similaridade END), 6) AS media, bool_and(similaridade IS NULL OR abs(similaridade) <= 1) AS na_escala FROM {_MATCHES} GROUP BY 1""")
def mean_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Mean score of each evaluation, null without one, and whether all lie on the scale."""
    m = once(table(spark, folder, "correspondencia_trecho"), "correspondencia_id")
    good = F.abs("similaridade") <= 1
    return m.groupBy("avaliacao_id").agg(
        F.count("*").alias("correspondencias"), F.count("similaridade").alias("com_nota"), F.round(F.avg(F.when(good, F.col("similaridade"))), 6).alias("media"), F.bool_and(F.coalesce(good, F.lit(True))).alias("na_escala")
    )


@query(f"""SELECT registro_id, coalesce(carga_horaria.unidade IN ('HORA', 'HORA_AULA') AND carga_horaria.total > 0 AND trim(ementa) <> '', FALSE) AS publicavel,
CASE WHEN coalesce(carga_horaria.unidade NOT IN ('HORA', 'HORA_AULA'), TRUE) THEN 'unidade' WHEN coalesce(carga_horaria.total <= 0, TRUE) THEN 'total' WHEN coalesce(trim(ementa) = '', TRUE) THEN 'ementa' END AS falta FROM {_ONCE}""")
def completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a record has a known unit, a total and a summary, and what is missing first."""
    unit, total, text = F.col("carga_horaria.unidade").isin("HORA", "HORA_AULA"), F.col("carga_horaria.total") > 0, F.trim("ementa") != ""
    no = F.lit(False)
    missing = F.when(~F.coalesce(unit, no), "unidade").when(~F.coalesce(total, no), "total").when(~F.coalesce(text, no), "ementa")
    return _records(spark, folder, "carga_horaria", "ementa").select("registro_id", F.coalesce(unit & total & text, no).alias("publicavel"), missing.alias("falta"))


@query(f"""SELECT registro_id, CASE WHEN regexp_matches(t, '\\b(universidade federal|univ\\.? fed)') THEN 'federal' WHEN regexp_matches(t, '\\binst(ituto|\\.)? fed') THEN 'instituto' WHEN t IS NULL THEN 'desconhecido' ELSE 'generico' END AS perfil
FROM (SELECT registro_id, translate(strip_accents(lower(instituicao)), 'ªº', 'ao') AS t FROM {_ONCE})""")
def profile_routing(spark: SparkSession, folder: str) -> DataFrame:
    """Records routed to the profile of their institution by aliases in its name, others to the general one."""
    from syllabrook.functions.text import unaccent

    t = unaccent("instituicao")
    profile = F.when(t.rlike(r"\b(universidade federal|univ\.? fed)"), "federal").when(t.rlike(r"\binst(ituto|\.)? fed"), "instituto").when(t.isNull(), "desconhecido").otherwise("generico")
    return _records(spark, folder, "instituicao").select("registro_id", profile.alias("perfil"))


@query("""SELECT a.nome, a.disciplina_id AS origem, b.disciplina_id AS destino FROM (SELECT nome, min(disciplina_id) AS disciplina_id FROM disciplina WHERE instituicao_id % 2 = 0 GROUP BY nome HAVING count(*) = 1) a
JOIN (SELECT nome, min(disciplina_id) AS disciplina_id FROM disciplina WHERE instituicao_id % 2 = 1 GROUP BY nome HAVING count(*) = 1) b ON a.nome = b.nome""")
def named_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Courses of two groups of institutions that bear one name, where the name is alone on both sides."""
    rows = table(spark, folder, "disciplina").filter("nome is not null").select("nome", "disciplina_id", (F.col("instituicao_id") % 2).alias("g"))
    one = rows.groupBy("g", "nome").agg(F.count("*").alias("n"), F.min("disciplina_id").alias("id")).filter("n = 1")
    return one.filter("g = 0").select("nome", F.col("id").alias("origem")).join(one.filter("g = 1").select("nome", F.col("id").alias("destino")), "nome")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_linenumber::DOUBLE AS y FROM lineitem)
SELECT l_orderkey, floor(x / 10)::BIGINT AS regiao, string_agg(l_partkey::VARCHAR, ' ' ORDER BY y, x, l_partkey) AS texto FROM c GROUP BY 1, 2""")
def region_text(spark: SparkSession, folder: str) -> DataFrame:
    """Text of each region of a page from the pieces whose centre lies in its half-open range, in reading order."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", F.floor(F.col("l_quantity") / 10).alias("regiao"), F.struct(F.col("l_linenumber").cast("double").alias("y"), F.col("l_quantity").alias("x"), F.col("l_partkey").alias("t")).alias("c"))
    ordered = F.transform(F.array_sort(F.collect_list("c")), lambda c: c["t"].cast("string"))
    return rows.groupBy("l_orderkey", "regiao").agg(F.array_join(ordered, " ").alias("texto"))


@query("""SELECT l_orderkey, sum(l_quantity)::DOUBLE AS soma, CASE WHEN count(*) = count(CASE WHEN l_linenumber <> 3 THEN l_quantity END) THEN sum(CASE WHEN l_linenumber <> 3 THEN l_quantity END)::DOUBLE END AS soma_estrita, coalesce(abs(sum(l_quantity) - 100) > 0.001, FALSE) AS aviso FROM lineitem GROUP BY 1""")
def table_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of a table's cells, null as soon as one cell is unknown, and a warning where they miss the stated total."""
    known = F.when(F.col("l_linenumber") != 3, F.col("l_quantity"))
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("soma"), F.when(F.count("*") == F.count(known), F.sum(known)).alias("soma_estrita"), F.coalesce(F.abs(F.sum("l_quantity") - 100) > 0.001, F.lit(False)).alias("aviso")
    )


@query("""SELECT a.l_orderkey, a.l_linenumber, a.l_partkey FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_extendedprice > a.l_extendedprice AND b.l_quantity <= a.l_quantity AND b.l_quantity + 20 >= a.l_quantity + 5)""")
def outermost_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges of a page that no larger one contains: 5 wide against 20, larger by price."""
    a = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    b = a.select("l_orderkey", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))
    inside = (F.col("p") > F.col("l_extendedprice")) & (F.col("q") <= F.col("l_quantity")) & (F.col("q") + 20 >= F.col("l_quantity") + 5)
    return a.alias("a").join(b.alias("b"), (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & inside, "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT doc_id, sha256(text) || '__pag_0_' || ceil(length(text) / 200.0)::INTEGER || '__modelo-1__v12' AS chave, md5(text) AS resumo FROM documents WHERE text IS NOT NULL""")
def block_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of results by content, pages, model and version."""
    pages = F.concat(F.lit("pag_0_"), F.ceil(F.char_length("text") / F.lit(200.0)).cast("int"))
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", result_key(F.sha2("text", 256), "modelo-1", 12, pages).alias("chave"), F.md5("text").alias("resumo"))


@query(f"""SELECT count(*) AS registros, count(*) FILTER (regexp_matches(coalesce(ementa, '') || coalesce(conteudo_programatico, ''), '\\S')) AS com_texto, count(DISTINCT matriz_codigo) AS matrizes, count(DISTINCT disciplina_id) AS disciplinas, (SELECT count(*) FROM disciplina_equivalencia) - count(*) AS reenviados FROM {_ONCE}""")
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of a run over all records; re-sent rows count once."""
    rows = table(spark, folder, "disciplina_equivalencia").groupBy("registro_id").agg(
        F.count("*").alias("n"), F.first(F.concat(F.coalesce("ementa", F.lit("")), F.coalesce("conteudo_programatico", F.lit(""))).rlike(r"\S")).alias("t"), F.first("matriz_codigo").alias("m"), F.first("disciplina_id").alias("d")
    )
    return rows.agg(F.count("*").alias("registros"), F.count_if("t").alias("com_texto"), F.countDistinct("m").alias("matrizes"), F.countDistinct("d").alias("disciplinas"), (F.sum("n") - F.count("*")).alias("reenviados"))


@query()
def evidence_by_target(spark: SparkSession, folder: str) -> DataFrame:
    """The evidence of each pair as one row with its pieces in order."""
    rows = semantic_topk(spark, folder)
    piece = F.struct("posicao", "origem", "semantica")
    return rows.groupBy("par", "destino").agg(F.to_json(F.array_sort(F.collect_list(piece))).alias("evidencias"))
