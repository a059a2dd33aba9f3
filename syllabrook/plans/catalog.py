"""Catalogue reads: joins, semi-joins, latest versions, counts, pages and sorted lists over whole tables.

The star-schema tables play the reference's roles: orders are requests, lineitem their documents or
versions, customers applicants, nations courses, regions institutions, suppliers coordinators (active
with a positive balance).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from syllabrook.operators.relational import clamp, latest_per_key, page
from syllabrook.plans.registry import Registry
from syllabrook.sources.tables import once, table

registry = Registry()
query = registry.query

_ONCE = "(SELECT * FROM disciplina_equivalencia QUALIFY row_number() OVER (PARTITION BY registro_id ORDER BY recebido_em) = 1)"
_CHUNKS = "(SELECT * FROM trecho_academico QUALIFY row_number() OVER (PARTITION BY trecho_id ORDER BY recebido_em) = 1)"
_MATCHES = "(SELECT * FROM correspondencia_trecho QUALIFY row_number() OVER (PARTITION BY correspondencia_id ORDER BY recebido_em) = 1)"


@query(f"""SELECT e.registro_id, e.nome AS nome_ementa, d.nome AS disciplina, i.nome AS instituicao, m.versao, c.nome AS curso
FROM {_ONCE} e JOIN disciplina d ON e.disciplina_id = d.disciplina_id JOIN instituicao i ON d.instituicao_id = i.instituicao_id
LEFT JOIN matriz_curricular m ON e.matriz_codigo = m.codigo LEFT JOIN curso_referencia c ON m.curso_referencia_id = c.referencia_id""")
def catalog_view(spark: SparkSession, folder: str) -> DataFrame:
    """Syllabi with their course unit and institution, and where known the grid and course of study."""
    e = once(table(spark, folder, "disciplina_equivalencia").select("registro_id", F.col("nome").alias("nome_ementa"), "disciplina_id", "matriz_codigo"), "registro_id")
    d = table(spark, folder, "disciplina").select("disciplina_id", "instituicao_id", F.col("nome").alias("disciplina"))
    i = table(spark, folder, "instituicao").select("instituicao_id", F.col("nome").alias("instituicao"))
    m = table(spark, folder, "matriz_curricular").select(F.col("codigo").alias("matriz_codigo"), "versao", "curso_referencia_id")
    c = table(spark, folder, "curso_referencia").select(F.col("referencia_id").alias("curso_referencia_id"), F.col("nome").alias("curso"))
    out = e.join(d, "disciplina_id").join(i, "instituicao_id").join(m, "matriz_codigo", "left").join(c, "curso_referencia_id", "left")
    return out.select("registro_id", "nome_ementa", "disciplina", "instituicao", "versao", "curso")


@query(f"""SELECT a.avaliacao_id, o.registro_id AS registro_matriz, c.registro_id AS registro_candidata, count(*) AS correspondencias, round(max(a.similaridade), 6) AS maior
FROM {_MATCHES} a JOIN {_CHUNKS} o ON a.trecho_destino_id = o.trecho_id JOIN {_CHUNKS} c ON a.trecho_origem_id = c.trecho_id GROUP BY ALL""")
def evaluation_view(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluations with the records on both sides: one table joined twice, once in each role."""
    a = once(table(spark, folder, "correspondencia_trecho"), "correspondencia_id")
    t = once(table(spark, folder, "trecho_academico").select("trecho_id", "registro_id"), "trecho_id")
    out = a.join(t.toDF("trecho_destino_id", "registro_matriz"), "trecho_destino_id").join(t.toDF("trecho_origem_id", "registro_candidata"), "trecho_origem_id")
    return out.groupBy("avaliacao_id", "registro_matriz", "registro_candidata").agg(F.count("*").alias("correspondencias"), F.round(F.max("similaridade"), 6).alias("maior"))


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests with applicant and number of documents, 0 without any (A1); the children are counted before the join."""
    documents = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("documentos"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    out = orders.join(customers, "o_custkey").join(documents, "o_orderkey", "left")
    return out.withColumn("documentos", F.coalesce("documentos", F.lit(0).cast("long")))


_REQUESTS = "SELECT o_orderkey, c_name, o_orderstatus, o_orderdate, count(l_orderkey) AS documentos FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey"
_GROUP = "GROUP BY o_orderkey, c_name, o_orderstatus, o_orderdate"


@query(f"{_REQUESTS} {_GROUP} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def requests_with_doc_count(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 newest requests with their number of documents."""
    rows = _requests(spark, folder).select("o_orderkey", "c_name", "o_orderstatus", "o_orderdate", "documentos")
    return page(rows, [F.desc("o_orderdate"), F.desc("o_orderkey")], 50)


@query(f"{_REQUESTS} WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 0 AND s_suppkey % 7 = 3) {_GROUP}")
def requests_for_coordinator(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of the courses that some active coordinators of a group may see."""
    allowed = table(spark, folder, "supplier").filter("s_acctbal > 0 and s_suppkey % 7 = 3").select(F.col("s_nationkey").alias("c_nationkey"))
    return _requests(spark, folder).join(allowed, "c_nationkey", "left_semi").select("o_orderkey", "c_name", "o_orderstatus", "o_orderdate", "documentos")


@query("""SELECT n_nationkey, n_name FROM nation n WHERE EXISTS (
  SELECT 1 FROM supplier s JOIN region r ON r.r_regionkey = n.n_regionkey WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 0 AND r.r_name <> 'ASIA')""")
def authorized_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Courses for which a subquery that joins itself finds an active coordinator."""
    regions = table(spark, folder, "region").filter("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"))
    active = table(spark, folder, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, folder, "nation").join(regions, "n_regionkey", "left_semi").join(active, "n_nationkey", "left_semi").select("n_nationkey", "n_name")


@query("""SELECT o_orderkey, v.l_linenumber AS versao, v.l_returnflag AS situacao, v.versoes FROM orders LEFT JOIN LATERAL (
  SELECT l_linenumber, l_returnflag, count(*) OVER () AS versoes FROM lineitem WHERE l_orderkey = o_orderkey
  ORDER BY CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END, l_linenumber DESC, l_returnflag LIMIT 1) v ON TRUE""")
def latest_version_lateral(spark: SparkSession, folder: str) -> DataFrame:
    """Each request with its latest version, published ones first, and the number of versions (J6, W2); one aggregation, no lateral loop."""
    first = F.struct(F.when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("p"), (-F.col("l_linenumber")).alias("n"), "l_returnflag")
    latest = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min_by(F.struct("l_linenumber", "l_returnflag"), first).alias("v"), F.count("*").alias("versoes")
    )
    out = table(spark, folder, "orders").select("o_orderkey").join(latest, "o_orderkey", "left")
    return out.select("o_orderkey", F.col("v.l_linenumber").alias("versao"), F.col("v.l_returnflag").alias("situacao"), "versoes")


@query("""WITH v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END, l_shipdate DESC, l_linenumber DESC) AS rn FROM lineitem)
SELECT o_orderkey, c_name, n_name, l_linenumber AS versao, l_shipdate AS atualizado FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN v ON l_orderkey = o_orderkey AND rn = 1""")
def latest_version_rownum(spark: SparkSession, folder: str) -> DataFrame:
    """The same by row numbers over a window, joined to the request's course."""
    order = [F.when(F.col("l_returnflag") == "A", 0).otherwise(1), F.desc("l_shipdate"), F.desc("l_linenumber")]
    latest = latest_per_key(table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag", "l_shipdate"), ["o_orderkey"], order)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    people = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    out = orders.join(people, "o_custkey").join(table(spark, folder, "nation").select("n_nationkey", "n_name"), "n_nationkey").join(latest, "o_orderkey", "left")
    return out.select("o_orderkey", "c_name", "n_name", F.col("l_linenumber").alias("versao"), F.col("l_shipdate").alias("atualizado"))


@query("""SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, b.l_linenumber AS outra FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_linenumber < b.l_linenumber""")
def composite_key_join(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of one request on the same subject: a join on two columns that must agree."""
    a = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return a.join(a.withColumnRenamed("l_linenumber", "outra"), ["l_orderkey", "l_partkey"]).filter("l_linenumber < outra").select("l_orderkey", "l_linenumber", "l_partkey", "outra")


@query("""SELECT o_orderkey, c_name, l_linenumber, p_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
WHERE o_orderkey % 100 = 7 AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 0)""")
def request_file(spark: SparkSession, folder: str) -> DataFrame:
    """Files of some requests by a four-way join, authorized by a semi-join."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").filter("l_orderkey % 100 = 7")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    people = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    allowed = table(spark, folder, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("c_nationkey"))
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    out = lines.join(orders, "l_orderkey").join(people, "c_custkey").join(allowed, "c_nationkey", "left_semi").join(parts, "l_partkey")
    return out.select(F.col("l_orderkey").alias("o_orderkey"), "c_name", "l_linenumber", "p_name")


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, p_partkey) AS ordem, p_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey""")
def request_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each request in order, numbered from 1."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    out = lines.join(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey").join(table(spark, folder, "part").select("p_partkey", "p_name"), "p_partkey")
    return out.select("o_orderkey", F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_linenumber", "p_partkey")).cast("long").alias("ordem"), "p_name")


@query(f"""SELECT registro_id, string_agg(texto, '; ' ORDER BY indice, trecho_id) AS tudo, string_agg(texto, '; ' ORDER BY indice, trecho_id) FILTER (secao = 'ementa') AS ementa,
string_agg(texto, '; ' ORDER BY indice, trecho_id) FILTER (secao = 'conteudo_programatico') AS conteudo, string_agg(texto, '; ' ORDER BY indice, trecho_id) FILTER (secao = 'objetivo_geral') AS objetivo FROM {_CHUNKS} WHERE registro_id IS NOT NULL GROUP BY registro_id""")
def children_text_join(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of each record joined in order, as a whole and by section; null where a section has none."""
    chunks = once(table(spark, folder, "trecho_academico").select("trecho_id", "registro_id", "secao", "indice", "texto"), "trecho_id").filter("registro_id is not null")

    def joined(section: str | None) -> F.Column:
        own = F.struct("indice", "trecho_id", "texto")
        kept = F.filter(F.array_sort(F.collect_list(own if section is None else F.when(F.col("secao") == section, own))), lambda x: x["texto"].isNotNull())
        return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda x: x["texto"]), "; "))

    return chunks.groupBy("registro_id").agg(joined(None).alias("tudo"), joined("ementa").alias("ementa"), joined("conteudo_programatico").alias("conteudo"), joined("objetivo_geral").alias("objetivo"))


@query("""SELECT a.disciplina_id, a.nome, b.n FROM disciplina a JOIN (SELECT area_conhecimento, count(*) AS n FROM disciplina GROUP BY 1) b ON a.area_conhecimento IS NOT DISTINCT FROM b.area_conhecimento""")
def null_safe_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Course units with the number of units of their area, where a null area matches null alone."""
    rows = table(spark, folder, "disciplina").select("disciplina_id", "nome", "area_conhecimento")
    areas = rows.groupBy(F.col("area_conhecimento").alias("area")).agg(F.count("*").alias("n"))
    return rows.join(areas, F.col("area_conhecimento").eqNullSafe(F.col("area"))).select("disciplina_id", "nome", "n")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def in_list_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a list of requests; the list is a table, so it may be long (P5)."""
    wanted = table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, folder, "lineitem").join(wanted, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT matriz_id, codigo, status FROM matriz_curricular WHERE status <> 'EXTINTA' AND status IN ('VIGENTE', 'EM_EXTINCAO')")
def status_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Grids without one status and of a set of others (P6); null status is in neither."""
    return table(spark, folder, "matriz_curricular").filter((F.col("status") != "EXTINTA") & F.col("status").isin("VIGENTE", "EM_EXTINCAO")).select("matriz_id", "codigo", "status")


@query("""SELECT instituicao_id, curso_id, nome, row_number() OVER (PARTITION BY instituicao_id ORDER BY codigo ASC NULLS FIRST, nome, curso_id) AS posicao FROM curso WHERE ativo""")
def active_courses(spark: SparkSession, folder: str) -> DataFrame:
    """Active courses of every institution in catalogue order, null codes first."""
    order = Window.partitionBy("instituicao_id").orderBy(F.asc_nulls_first("codigo"), "nome", "curso_id")
    return table(spark, folder, "curso").filter("ativo").select("instituicao_id", "curso_id", "nome", F.row_number().over(order).cast("long").alias("posicao"))


@query("""SELECT instituicao_id, upper(trim(codigo)) AS codigo, min(curso_id) AS curso_id, count(*) AS candidatos FROM curso WHERE codigo IS NOT NULL GROUP BY ALL""")
def natural_key_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The row that each natural key (institution and canonical code) leads to, and whether it is alone."""
    rows = table(spark, folder, "curso").filter("codigo is not null")
    return rows.groupBy("instituicao_id", F.upper(F.trim("codigo")).alias("codigo")).agg(F.min("curso_id").alias("curso_id"), F.count("*").alias("candidatos"))


@query("SELECT c_custkey, lower(trim(c_name)) AS login, CASE WHEN c_acctbal >= 5000 THEN 'coordenador' ELSE 'candidato' END AS papel FROM customer WHERE lower(trim(c_name)) LIKE '%0%'")
def user_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Users by normalized login, with their role."""
    login = F.lower(F.trim("c_name"))
    return table(spark, folder, "customer").filter(login.contains("0")).select("c_custkey", login.alias("login"), F.when(F.col("c_acctbal") >= 5000, "coordenador").otherwise("candidato").alias("papel"))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt')")
def substring_search(spark: SparkSession, folder: str) -> DataFrame:
    """Substring search over name and code in any case."""
    text = F.lit("Bolt".lower())
    return table(spark, folder, "part").filter(F.contains(F.lower("p_name"), text) | F.contains(F.lower("p_brand"), text)).select("p_partkey", "p_name", "p_brand")


_SECTIONS = ("ementa", "conteudo_programatico", "objetivo_geral", "objetivos_especificos", "objetivos_nao_classificados", "competencias_habilidades")
_HAS = " OR ".join(f"regexp_matches(coalesce({c}, ''), '\\S')" for c in _SECTIONS)


@query(f"SELECT registro_id, ({_HAS}) AS possui_conteudo FROM {_ONCE}")
def has_content(spark: SparkSession, folder: str) -> DataFrame:
    """Whether any section of a record holds more than white space."""
    rows = once(table(spark, folder, "disciplina_equivalencia").select("registro_id", *_SECTIONS), "registro_id")
    return rows.select("registro_id", F.exists(F.array(*_SECTIONS), lambda x: F.coalesce(x.rlike(r"\S"), F.lit(False))).alias("possui_conteudo"))


@query("""SELECT o_orderstatus, count(*) AS solicitacoes, count(*) FILTER (o_totalprice > 200000) AS grandes, count(*) FILTER (o_orderdate >= TIMESTAMP '1997-01-01') AS recentes FROM orders GROUP BY ALL""")
def status_dashboard(spark: SparkSession, folder: str) -> DataFrame:
    """Counters by status."""
    return table(spark, folder, "orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("solicitacoes"), F.count_if(F.col("o_totalprice") > 200000).alias("grandes"), F.count_if(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")).alias("recentes")
    )


@query("""SELECT coalesce(source, '') AS lote, count(*) AS arquivos, max(octet_length(encode(text)))::BIGINT AS maior, sum(octet_length(encode(text)))::BIGINT AS total,
count(*) > 10 OR max(octet_length(encode(text))) > 20000 OR sum(octet_length(encode(text))) > 50000 AS recusado FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def batch_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Batches against limits on files, each file and all bytes."""
    size = F.octet_length("text")
    out = table(spark, folder, "documents").filter("text is not null").groupBy(F.coalesce("source", F.lit("")).alias("lote"))
    out = out.agg(F.count("*").alias("arquivos"), F.max(size).cast("long").alias("maior"), F.sum(size.cast("long")).alias("total"))
    return out.withColumn("recusado", (F.col("arquivos") > 10) | (F.col("maior") > 20000) | (F.col("total") > 50000))


@query("""SELECT lote, doc_id, acumulado FROM (SELECT coalesce(source, '') AS lote, doc_id, sum(octet_length(encode(text))) OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id)::BIGINT AS acumulado FROM documents WHERE text IS NOT NULL) WHERE acumulado <= 50000""")
def batch_running_total(spark: SparkSession, folder: str) -> DataFrame:
    """Files of each batch that fit within its limit of bytes, in order (A18, running total)."""
    w = Window.partitionBy("lote").orderBy("doc_id")
    rows = table(spark, folder, "documents").filter("text is not null").select(F.coalesce("source", F.lit("")).alias("lote"), "doc_id", F.octet_length("text").cast("long").alias("n"))
    return rows.select("lote", "doc_id", F.sum("n").over(w).alias("acumulado")).filter("acumulado <= 50000")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS hash, count(*) AS copias FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")
def content_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """One document for each content hash, the one with the smallest id."""
    return table(spark, folder, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copias"))


@query("""SELECT d.doc_id, sha256(d.text) || '__modelo-1__v12' AS chave FROM documents d WHERE d.text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents c WHERE c.criado_em < TIMESTAMP '2024-07-01' AND c.text = d.text)""")
def cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose content, model and version are not among the results kept from before a date."""
    key = F.concat(F.sha2("text", 256), F.lit("__modelo-1__v12")).alias("chave")
    rows = table(spark, folder, "documents").filter("text is not null")
    kept = rows.filter(F.col("criado_em") < F.lit("2024-07-01").cast("timestamp")).select(key).distinct()
    return rows.select("doc_id", key).join(kept, "chave", "left_anti").select("doc_id", "chave")


@query("""SELECT o_orderkey, c_name, count(l_orderkey) AS documentos, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS linhas FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, c_name""")
def request_detail(spark: SparkSession, folder: str) -> DataFrame:
    """Each request with its documents in order as one row; their number is the list's length."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("l"))
    people = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    out = table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(people, "o_custkey").join(lines, "o_orderkey", "left")
    return out.select("o_orderkey", "c_name", F.coalesce(F.array_size("l"), F.lit(0)).cast("long").alias("documentos"), F.array_join(F.col("l").cast("array<string>"), ",").alias("linhas"))


@query("""SELECT o_orderkey, c_name, count(l_orderkey) AS documentos FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) GROUP BY o_orderkey, c_name""")
def request_detail_authorized(spark: SparkSession, folder: str) -> DataFrame:
    """The same for the courses of some coordinators."""
    allowed = table(spark, folder, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey"))
    return _requests(spark, folder).join(allowed, "c_nationkey", "left_semi").select("o_orderkey", "c_name", "documentos")


@query("""SELECT c.nome AS curso, m.codigo, m.ano_inicio, row_number() OVER (PARTITION BY c.referencia_id ORDER BY m.ano_inicio DESC NULLS LAST, m.versao DESC NULLS LAST, m.matriz_id DESC) AS posicao
FROM matriz_curricular m JOIN curso_referencia c ON m.curso_referencia_id = c.referencia_id""")
def grids_newest_first(spark: SparkSession, folder: str) -> DataFrame:
    """Grids of each course of study, newest first."""
    w = Window.partitionBy("curso_referencia_id").orderBy(F.desc_nulls_last("ano_inicio"), F.desc_nulls_last("versao"), F.desc("matriz_id"))
    c = table(spark, folder, "curso_referencia").select(F.col("referencia_id").alias("curso_referencia_id"), F.col("nome").alias("curso"))
    return table(spark, folder, "matriz_curricular").join(c, "curso_referencia_id").select("curso", "codigo", "ano_inicio", F.row_number().over(w).cast("long").alias("posicao"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def page_clamp_top(spark: SparkSession, folder: str) -> DataFrame:
    """A page of 500 requests asked for, clamped to 100."""
    return page(table(spark, folder, "orders"), [F.desc("o_orderdate"), F.desc("o_orderkey")], clamp(500, 100)).select("o_orderkey", "o_totalprice")


@query("SELECT source AS fonte, grouping(source)::INTEGER AS geral, count(*) AS documentos FROM documents GROUP BY ROLLUP (source)")
def source_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each source and the grand total."""
    return table(spark, folder, "documents").rollup("source").agg(F.grouping("source").cast("int").alias("geral"), F.count("*").alias("documentos")).withColumnRenamed("source", "fonte")


@query("""SELECT m.codigo, a.registro_id FROM matriz_curricular m JOIN (SELECT DISTINCT matriz_codigo, registro_id FROM trecho_academico) a ON a.matriz_codigo = m.codigo
WHERE coalesce(m.ano_fim, 9999) >= 2016 AND m.ano_inicio <= 2020""")
def grids_in_period(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the grids whose validity, open at its end where unknown, meets a period (D-5)."""
    m = table(spark, folder, "matriz_curricular").filter(F.struct(F.coalesce("ano_fim", F.lit(9999)), F.lit(2)) >= F.struct(F.lit(2016), F.lit(1))).filter("ano_inicio <= 2020")
    return m.select("codigo").join(table(spark, folder, "trecho_academico").select(F.col("matriz_codigo").alias("codigo"), "registro_id").distinct(), "codigo")


@query(f"""SELECT coalesce(matriz_codigo, '') AS matriz, count(*) AS registros, count(*) FILTER ({_HAS}) AS com_conteudo, count(DISTINCT disciplina_id) AS disciplinas FROM {_ONCE} GROUP BY 1""")
def input_diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    """What each grid has to be compared: records, those with content, different course units."""
    rows = has_content(spark, folder).join(once(table(spark, folder, "disciplina_equivalencia").select("registro_id", "matriz_codigo", "disciplina_id"), "registro_id"), "registro_id")
    return rows.groupBy(F.coalesce("matriz_codigo", F.lit("")).alias("matriz")).agg(F.count("*").alias("registros"), F.count_if("possui_conteudo").alias("com_conteudo"), F.countDistinct("disciplina_id").alias("disciplinas"))
