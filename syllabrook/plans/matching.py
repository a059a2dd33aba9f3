"""Comparison of courses: chunks, similarities, hybrid evidence, coverage, triage and recall, over whole tables.

A pair of courses is an evaluation of ``correspondencia_trecho``; its candidates are the chunk pairs
recorded for it, its scores the cosine of their vectors, else the recorded similarity where it lies on
the scale from -1 to 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from syllabrook.operators import matching as M
from syllabrook.plans.catalog import _CHUNKS, _MATCHES, _ONCE
from syllabrook.plans.registry import Registry
from syllabrook.sources.tables import once, table

registry = Registry()
query = registry.query
POLICY = M.TriagePolicy()

_SP = r"[\s\x0b\x{85}\p{Z}]+"
_COS = "greatest(-1.0, least(1.0, list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])))"
_SCORED = f"""SELECT m.avaliacao_id AS par, m.trecho_destino_id AS destino, m.trecho_origem_id AS origem, t.texto,
coalesce(CASE WHEN list_dot_product(a.vetor::DOUBLE[], a.vetor::DOUBLE[]) > 0 AND list_dot_product(b.vetor::DOUBLE[], b.vetor::DOUBLE[]) > 0 THEN {_COS.format(a="a.vetor", b="b.vetor")} END,
  CASE WHEN abs(m.similaridade) <= 1 THEN m.similaridade END) AS semantica, m.similaridade_lexical AS lexical
FROM {_MATCHES} m JOIN {_CHUNKS} t ON t.trecho_id = m.trecho_origem_id LEFT JOIN representacao_vetorial a ON a.trecho_id = m.trecho_destino_id LEFT JOIN representacao_vetorial b ON b.trecho_id = m.trecho_origem_id"""
_TOP = f"SELECT * FROM ({_SCORED}) WHERE semantica IS NOT NULL QUALIFY row_number() OVER (PARTITION BY par, destino ORDER BY round(semantica, 9) DESC, origem) <= 3"
_KEY = f"rtrim(trim(regexp_replace(lower(texto), '{_SP}', ' ', 'g')), '.,;:')"
_COVERED = f"""SELECT par, count(*) AS topicos, count(*) FILTER (melhor >= 0.75) AS cobertos FROM (SELECT par, destino, max(semantica) AS melhor FROM ({_TOP}) GROUP BY 1, 2) GROUP BY 1"""


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    m = once(table(spark, folder, "correspondencia_trecho"), "correspondencia_id")
    t = once(table(spark, folder, "trecho_academico").select("trecho_id", "texto"), "trecho_id")
    v = table(spark, folder, "representacao_vetorial").select("trecho_id", "vetor")
    m = m.select(F.col("avaliacao_id").alias("par"), F.col("trecho_destino_id").alias("destino"), F.col("trecho_origem_id").alias("origem"), "similaridade", F.col("similaridade_lexical").alias("lexical"))
    rows = m.join(t.toDF("origem", "texto"), "origem").join(v.toDF("destino", "a"), "destino", "left").join(v.toDF("origem", "b"), "origem", "left")
    known = F.when(F.abs("similaridade") <= 1, F.col("similaridade"))
    return rows.select("par", "destino", "origem", "texto", F.coalesce(M.cosine(F.col("a"), F.col("b")), known).alias("semantica"), "lexical")


def _top(spark: SparkSession, folder: str) -> DataFrame:
    return M.top_evidence(_scored(spark, folder).filter("semantica is not null"), 3, False)


@query(f"""WITH c AS ({_COVERED}), r AS (SELECT avaliacao_id AS par, min(d.registro_id) AS destino, min(o.registro_id) AS origem FROM {_MATCHES} m LEFT JOIN {_CHUNKS} d ON d.trecho_id = m.trecho_destino_id LEFT JOIN {_CHUNKS} o ON o.trecho_id = m.trecho_origem_id WHERE m.avaliacao_id IS NOT NULL GROUP BY 1),
j AS (SELECT r.par, r.destino, r.origem, coalesce(c.topicos, 0) AS topicos, coalesce(c.cobertos, 0) AS cobertos, CASE WHEN c.topicos > 0 THEN c.cobertos / c.topicos END AS cobertura,
  CASE WHEN coalesce(o.carga_horaria.unidade, '') <> '' AND o.carga_horaria.unidade = d.carga_horaria.unidade THEN o.carga_horaria.total >= d.carga_horaria.total END AS carga_compativel
  FROM r LEFT JOIN c ON c.par = r.par LEFT JOIN {_ONCE} d ON d.registro_id = r.destino LEFT JOIN {_ONCE} o ON o.registro_id = r.origem)
SELECT par, destino, origem, topicos, cobertos, round(cobertura, 6) AS cobertura, carga_compativel,
CASE WHEN cobertura IS NULL THEN 'TALVEZ_APTO' WHEN NOT carga_compativel THEN 'NAO_APTO' WHEN cobertura >= 0.85 AND carga_compativel THEN 'APTO_A_DISPENSA' WHEN cobertura < 0.30 THEN 'NAO_APTO' ELSE 'TALVEZ_APTO' END AS indicacao FROM j""")
def flagship_triage(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of courses compared: coverage of the target's topics, workload, indication."""
    m = once(table(spark, folder, "correspondencia_trecho"), "correspondencia_id").filter("avaliacao_id is not null")
    t = once(table(spark, folder, "trecho_academico").select("trecho_id", "registro_id"), "trecho_id")
    sides = m.join(t.toDF("trecho_destino_id", "d"), "trecho_destino_id", "left").join(t.toDF("trecho_origem_id", "o"), "trecho_origem_id", "left")
    sides = sides.groupBy(F.col("avaliacao_id").alias("par")).agg(F.min("d").alias("destino"), F.min("o").alias("origem"))
    e = once(table(spark, folder, "disciplina_equivalencia").select("registro_id", "carga_horaria"), "registro_id")
    e = e.select("registro_id", F.col("carga_horaria.total").alias("h"), F.col("carga_horaria.unidade").alias("u"))
    rows = sides.join(M.coverage(_top(spark, folder), POLICY), "par", "left").join(e.toDF("destino", "dh", "du"), "destino", "left").join(e.toDF("origem", "oh", "ou"), "origem", "left")
    rows = rows.withColumn("carga_compativel", M.workload_compatible(F.col("oh"), F.col("ou"), F.col("dh"), F.col("du")))
    status = F.when(F.col("topicos").isNull(), "origem_sem_conteudo").otherwise("comparado")
    indication = M.triage(status, F.col("topicos"), F.col("cobertos"), F.col("carga_compativel"), POLICY)
    zero = F.lit(0).cast("long")
    return rows.select("par", "destino", "origem", F.coalesce("topicos", zero).alias("topicos"), F.coalesce("cobertos", zero).alias("cobertos"), F.round("cobertura", 6).alias("cobertura"), "carga_compativel", indication.alias("indicacao"))


@query(f"""SELECT par, destino, origem, round(semantica, 6) AS semantica, row_number() OVER (PARTITION BY par, destino ORDER BY round(semantica, 9) DESC, origem) AS posicao FROM ({_TOP})""")
def semantic_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The three best sources of every target chunk."""
    return _top(spark, folder).select("par", "destino", "origem", F.round("semantica", 6).alias("semantica"), F.col("posicao").cast("long").alias("posicao"))


@query(f"""SELECT par, destino, origem, round(semantica, 6) AS semantica, round(lexical, 6) AS lexical FROM ({_SCORED}) WHERE semantica IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY par, destino ORDER BY round(semantica, 9) DESC NULLS LAST, origem) <= 1 OR row_number() OVER (PARTITION BY par, destino ORDER BY round(lexical, 9) DESC NULLS LAST, origem) <= 1""")
def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The union of the best source by meaning and the best by wording of every target chunk."""
    rows = M.top_evidence(_scored(spark, folder).filter("semantica is not null"), 1, True)
    return rows.select("par", "destino", "origem", F.round("semantica", 6).alias("semantica"), F.round("lexical", 6).alias("lexical"))


@query(f"""SELECT par, count(DISTINCT destino) AS topicos, count(*) AS originais, count(*) FILTER (rn = 1) AS unicas, count(*) FILTER (rn > 1) AS repetidas, round(max(semantica), 6) AS maior
FROM (SELECT *, row_number() OVER (PARTITION BY par, destino, {_KEY} ORDER BY round(semantica, 9) DESC, origem) AS rn FROM ({_TOP})) GROUP BY par""")
def evidence_consolidation(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of each pair with repeats of one text counted apart."""
    return M.consolidated(_top(spark, folder)).groupBy("par").agg(
        F.countDistinct("destino").alias("topicos"), F.count("*").alias("originais"), F.count_if(~F.col("repetida")).alias("unicas"), F.count_if("repetida").alias("repetidas"), F.round(F.max("semantica"), 6).alias("maior")
    )


@query(f"SELECT par, topicos, cobertos, round(cobertos / topicos, 6) AS cobertura FROM ({_COVERED})")
def topic_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage of each pair."""
    return M.coverage(_top(spark, folder), POLICY).withColumn("cobertura", F.round("cobertura", 6))


@query(f"SELECT par, destino, origem, round(semantica, 6) AS semantica FROM ({_TOP}) ORDER BY round(semantica, 9) DESC, par, destino, origem LIMIT 3")
def top3_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The three best pieces of evidence of all."""
    rows = _top(spark, folder).orderBy(F.desc(F.round("semantica", 9)), "par", "destino", "origem").limit(3)
    return rows.select("par", "destino", "origem", F.round("semantica", 6).alias("semantica"))


@query(f"""WITH c AS ({_COVERED}), r AS (SELECT avaliacao_id AS par, min(o.registro_id) AS origem FROM {_MATCHES} m JOIN {_CHUNKS} o ON o.trecho_id = m.trecho_origem_id GROUP BY 1)
SELECT r.origem, r.par, round(c.cobertos / c.topicos, 6) AS cobertura, row_number() OVER (PARTITION BY r.origem ORDER BY round(c.cobertos / c.topicos, 6) DESC NULLS LAST, r.par) AS posicao FROM r LEFT JOIN c ON c.par = r.par
WHERE r.origem IS NOT NULL AND r.par IS NOT NULL QUALIFY posicao <= 3""")
def top3_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """The three best covered targets of each source course, unknown coverage last."""
    m = once(table(spark, folder, "correspondencia_trecho"), "correspondencia_id").select(F.col("avaliacao_id").alias("par"), F.col("trecho_origem_id").alias("trecho_id"))
    t = once(table(spark, folder, "trecho_academico").select("trecho_id", "registro_id"), "trecho_id")
    r = m.join(t, "trecho_id").groupBy("par").agg(F.min("registro_id").alias("origem")).filter("origem is not null and par is not null")
    rows = r.join(topic_coverage(spark, folder).select("par", "cobertura"), "par", "left")
    w = Window.partitionBy("origem").orderBy(F.desc_nulls_last("cobertura"), "par")
    return rows.select("origem", "par", "cobertura", F.row_number().over(w).cast("long").alias("posicao")).filter("posicao <= 3")


@query(f"""SELECT a.vec_id AS destino, b.vec_id AS origem, round({_COS.format(a="a.embedding", b="b.embedding")}, 6) AS cosseno FROM embeddings a JOIN embeddings b ON a.vec_id // 50 = b.vec_id // 50 AND (a.vec_id // 25) % 2 = 1 AND (b.vec_id // 25) % 2 = 0""")
def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Cosines of all chunks of two neighbouring courses (25 vectors each), met on the pair."""
    v = table(spark, folder, "embeddings").select("vec_id", "embedding", F.expr("vec_id div 50").alias("par"), F.expr("(vec_id div 25) % 2 = 1").alias("alvo"))
    a = v.filter("alvo").select("par", F.col("vec_id").alias("destino"), F.col("embedding").alias("x"))
    b = v.filter("not alvo").select("par", F.col("vec_id").alias("origem"), F.col("embedding").alias("y"))
    return a.join(b, "par").select("destino", "origem", F.round(M.cosine(F.col("x"), F.col("y")), 6).alias("cosseno"))


@query("""SELECT trecho_id, round(sqrt(list_dot_product(vetor::DOUBLE[], vetor::DOUBLE[])), 4) AS norma, round(vetor[1]::DOUBLE / sqrt(list_dot_product(vetor::DOUBLE[], vetor::DOUBLE[])), 6) AS primeira FROM representacao_vetorial WHERE list_dot_product(vetor::DOUBLE[], vetor::DOUBLE[]) > 0""")
def normalized_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors brought to length one: their old length and first component."""
    v = table(spark, folder, "representacao_vetorial").select("trecho_id", "vetor", M.normalized(F.col("vetor")).alias("n")).filter("n is not null")
    norm = F.sqrt(F.aggregate("vetor", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return v.select("trecho_id", F.round(norm, 4).alias("norma"), F.round(F.col("n")[0], 6).alias("primeira"))


@query(rf"""WITH pieces AS (
  SELECT registro_id, 0 AS ordem, 'ementa' AS secao, unnest(string_split(regexp_replace(ementa, '([.!?]){_SP}', '\1' || chr(1), 'g'), chr(1))) AS p FROM {_ONCE} WHERE ementa IS NOT NULL
  UNION ALL SELECT registro_id, 1, 'conteudo_programatico', unnest(string_split_regex(conteudo_programatico, '\n+|;')) FROM {_ONCE} WHERE conteudo_programatico IS NOT NULL)
SELECT secao, count(*) AS topicos, sum(length(t))::BIGINT AS letras, count(DISTINCT registro_id) AS registros FROM (SELECT *, regexp_replace(p, '^{_SP}|{_SP}$', '', 'g') AS t FROM pieces) WHERE t <> '' GROUP BY 1""")
def topic_split(spark: SparkSession, folder: str) -> DataFrame:
    """Topics of syllabi by sentence and of contents by line and semicolon, counted."""
    rows = once(table(spark, folder, "disciplina_equivalencia").select("registro_id", "ementa", "conteudo_programatico"), "registro_id")
    sections = F.array(*(F.struct(F.lit(s).alias("secao"), F.col(s).alias("t")) for s in ("ementa", "conteudo_programatico")))
    each = rows.select("registro_id", F.inline(sections)).filter("t is not null").select("registro_id", "secao", F.explode(M.topics(F.col("secao"), F.col("t"))).alias("t"))
    return each.groupBy("secao").agg(F.count("*").alias("topicos"), F.sum(F.char_length("t")).alias("letras"), F.countDistinct("registro_id").alias("registros"))


@query(rf"""WITH w AS (SELECT trecho_id, i, unnest(list_filter(string_split_regex(texto, '{_SP}'), lambda x: x <> '')) AS palavra, unnest(range(len(list_filter(string_split_regex(texto, '{_SP}'), lambda x: x <> '')))) AS n FROM (SELECT trecho_id, texto, 0 AS i FROM {_CHUNKS} WHERE texto IS NOT NULL))
SELECT trecho_id, (n // 24)::INTEGER AS indice, string_agg(palavra, ' ' ORDER BY n) AS texto FROM w GROUP BY 1, 2""")
def token_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Texts packed greedily into runs of at most 24 words."""
    rows = once(table(spark, folder, "trecho_academico").select("trecho_id", "texto"), "trecho_id").filter("texto is not null")
    return rows.select("trecho_id", F.posexplode(M.packed(F.col("texto"), 24)).alias("indice", "texto"))


_SECTION = "SELECT registro_id, '{c}' AS secao, {parts} AS l FROM " + _ONCE + " WHERE {c} IS NOT NULL"
_PARTS = {c: f"string_split_regex({c}, '\\n+|;')" for c in M._LISTS} | {"ementa": rf"string_split(regexp_replace(ementa, '([.!?]){_SP}', '\1' || chr(1), 'g'), chr(1))"}
_ALL_SECTIONS = " UNION ALL ".join(_SECTION.format(c=c, parts=_PARTS.get(c, f"[{c}]")) for c in M.SECTION_ORDER)


@query(rf"""WITH p AS (SELECT registro_id, secao, unnest(l) AS p, unnest(range(len(l))) AS o FROM ({_ALL_SECTIONS})), s AS (SELECT registro_id, secao, o, list_filter(string_split_regex(p, '{_SP}'), lambda x: x <> '') AS ws FROM p),
w AS (SELECT registro_id, secao, o, unnest(ws) AS w, unnest(range(len(ws))) AS n FROM s), c AS (SELECT registro_id, secao, o, n // 64 AS c, string_agg(w, ' ' ORDER BY n) AS texto FROM w GROUP BY ALL)
SELECT registro_id, secao, (row_number() OVER (PARTITION BY registro_id, secao ORDER BY o, c) - 1)::INTEGER AS indice, texto FROM c""")
def course_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of at most 64 words of all sections of every record."""
    return M.chunks(once(table(spark, folder, "disciplina_equivalencia").select("registro_id", *M.SECTION_ORDER), "registro_id"), "registro_id", 64)


_GRAMS = r"""SELECT par, alvo, id, unnest(list_concat(list_concat(
  [substr(w, i, 3) for i in range(1, greatest(length(w) - 3 + 1, 1) + 1)],
  CASE WHEN length(w) >= 4 THEN [substr(w, i, 4) for i in range(1, length(w) - 4 + 2)] ELSE [] END),
  CASE WHEN length(w) >= 5 THEN [substr(w, i, 5) for i in range(1, length(w) - 5 + 2)] ELSE [] END)) AS g FROM words"""


@query(rf"""WITH m AS {_MATCHES}, t AS {_CHUNKS},
both_ AS (SELECT DISTINCT avaliacao_id AS par, TRUE AS alvo, trecho_destino_id AS id FROM m UNION ALL SELECT DISTINCT avaliacao_id, FALSE, trecho_origem_id FROM m),
texts AS (SELECT par, alvo, id, texto FROM both_ JOIN t ON t.trecho_id = both_.id WHERE texto IS NOT NULL AND par IS NOT NULL),
words AS (SELECT par, alvo, id, ' ' || w || ' ' AS w FROM (SELECT par, alvo, id, unnest(list_filter(string_split_regex(translate(strip_accents(lower(texto)), 'ªº', 'ao'), '{_SP}'), lambda x: x <> '')) AS w FROM texts)),
tf AS (SELECT par, alvo, id, g, count(*) AS tf FROM ({_GRAMS}) GROUP BY ALL),
n AS (SELECT par, count(*) AS n FROM texts GROUP BY 1),
idf AS (SELECT tf.par, g, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf JOIN n ON n.par = tf.par GROUP BY 1, 2),
w AS (SELECT tf.*, tf * idf AS w FROM tf JOIN idf ON idf.par = tf.par AND idf.g = tf.g),
u AS (SELECT w.par, w.alvo, w.id, w.g, w / sqrt(sum(w * w) OVER (PARTITION BY par, alvo, id)) AS w FROM w)
SELECT a.par, a.id AS destino, b.id AS origem, round(sum(a.w * b.w), 6) AS lexical FROM u a JOIN u b ON a.par = b.par AND a.g = b.g AND a.alvo AND NOT b.alvo GROUP BY 1, 2, 3""")
def tfidf_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Lexical similarity of all chunks on both sides of each evaluation."""
    m = once(table(spark, folder, "correspondencia_trecho"), "correspondencia_id").filter("avaliacao_id is not null")
    t = once(table(spark, folder, "trecho_academico").select("trecho_id", "texto"), "trecho_id").filter("texto is not null").withColumnRenamed("trecho_id", "id")
    a = m.select(F.col("avaliacao_id").alias("par"), F.col("trecho_destino_id").alias("id")).distinct().join(t, "id")
    b = m.select(F.col("avaliacao_id").alias("par"), F.col("trecho_origem_id").alias("id")).distinct().join(t, "id")
    return M.lexical_pairs(a, b).withColumn("lexical", F.round("lexical", 6))


@query("""SELECT a.disciplina_id AS origem, b.disciplina_id AS destino, CASE WHEN a.u <> '' AND a.u = b.u THEN a.h >= b.h END AS compativel
FROM (SELECT p_partkey AS disciplina_id, p_brand, p_size AS h, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'HORA' ELSE 'HORA_AULA' END AS u FROM part) a
JOIN (SELECT p_partkey AS disciplina_id, p_brand, p_size AS h, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'HORA' ELSE 'HORA_AULA' END AS u FROM part) b ON b.disciplina_id = a.disciplina_id + 1""")
def workload_compat(spark: SparkSession, folder: str) -> DataFrame:
    """Workloads of neighbouring courses: compatible, not, or unknown."""
    unit = F.when(F.col("p_size") % 3 == 1, "HORA").when(F.col("p_size") % 3 == 2, "HORA_AULA")
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("origem"), F.col("p_size").alias("oh"), unit.alias("ou"))
    targets = rows.toDF("destino", "dh", "du").withColumn("origem", F.col("destino") - 1)
    return rows.join(targets, "origem").select("origem", "destino", M.workload_compatible(F.col("oh"), F.col("ou"), F.col("dh"), F.col("du")).alias("compativel"))


@query(f"""WITH l AS (SELECT DISTINCT avaliacao_id AS par, trecho_destino_id AS destino, trecho_origem_id AS origem FROM {_MATCHES} WHERE similaridade_lexical >= 0.5), g AS (SELECT DISTINCT par, destino, origem FROM ({_TOP}))
SELECT count(g.par) AS encontrados, count(*) AS rotulados, (SELECT count(*) FROM g) AS recuperados, CASE WHEN count(*) > 0 THEN round(count(g.par) / count(*), 6) END AS revocacao FROM l LEFT JOIN g ON l.par = g.par AND l.destino = g.destino AND l.origem = g.origem""")
def recall_eval(spark: SparkSession, folder: str) -> DataFrame:
    """How many pairs that are alike in wording the retrieval by meaning finds."""
    m = once(table(spark, folder, "correspondencia_trecho"), "correspondencia_id").filter("similaridade_lexical >= 0.5")
    labels = m.select(F.col("avaliacao_id").alias("par"), F.col("trecho_destino_id").alias("destino"), F.col("trecho_origem_id").alias("origem"))
    return M.recall(_top(spark, folder), labels, ["par", "destino", "origem"]).withColumn("revocacao", F.round("revocacao", 6))


@query(f"""SELECT m.correspondencia_id, count(t.trecho_id) AS candidatos, CASE count(t.trecho_id) WHEN 1 THEN 'valida' WHEN 0 THEN 'ausente' ELSE 'ambigua' END AS situacao
FROM {_MATCHES} m JOIN {_CHUNKS} o ON o.trecho_id = m.trecho_origem_id LEFT JOIN {_CHUNKS} t ON t.secao = o.secao AND trim(t.texto) = trim(o.texto) GROUP BY 1""")
def label_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Labels led back to chunks by section and text, where exactly one must fit."""
    m = once(table(spark, folder, "correspondencia_trecho"), "correspondencia_id").select("correspondencia_id", F.col("trecho_origem_id").alias("trecho_id"))
    t = once(table(spark, folder, "trecho_academico").select("trecho_id", "secao", "texto"), "trecho_id").withColumn("texto", F.trim("texto"))
    n = t.filter("secao is not null and texto is not null").groupBy("secao", "texto").agg(F.count("*").alias("candidatos"))
    rows = m.join(t, "trecho_id").join(n, ["secao", "texto"], "left").withColumn("candidatos", F.coalesce("candidatos", F.lit(0).cast("long")))
    return rows.select("correspondencia_id", "candidatos", F.when(F.col("candidatos") == 1, "valida").when(F.col("candidatos") == 0, "ausente").otherwise("ambigua").alias("situacao"))
