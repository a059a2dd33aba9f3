"""Records: normalizers, amounts, rules, merges and outcomes of batch changes, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from syllabrook.functions import text as T
from syllabrook.operators import records as R
from syllabrook.operators import relational as L
from syllabrook.plans.catalog import _ONCE
from syllabrook.plans.registry import Registry
from syllabrook.sources.tables import once, table

registry = Registry()
query = registry.query

_SP = r"[\s\x0b\x{85}\p{Z}]+"


def _plain(c: str) -> str:
    return f"translate(strip_accents(lower({c})), 'ªº', 'ao')"


def _squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_SP}', ' ', 'g'))"


def _layout(c: str) -> str:
    t = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '^{_SP}|{_SP}$', '', 'g'), '[ \t]+', ' ', 'g'), '\n[ \t]+', chr(10), 'g'), '\n\n\n+', chr(10) || chr(10), 'g')"
    return f"nullif({t}, '')"


_ABSENT = "('nao ha', 'nao possui', 'nao se aplica', 'sem bibliografia', 'sem informacao', 'nao informado', 'nao informada', '-')"


def _says_absent(c: str) -> str:
    key = f"trim(rtrim({_squeezed(_plain(c))}, '.:;'))"
    return f"({key} IN {_ABSENT} OR regexp_matches({key}, ': (nao ha|nao se aplica|nao possui|sem bibliografia)$'))"


def _records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return once(table(spark, folder, "disciplina_equivalencia").select("registro_id", *columns), "registro_id")


@query(f"""SELECT registro_id, rtrim({_squeezed("lower(nome)")}, '.,;:') AS f1, {_squeezed(_plain("nome"))} AS f3, regexp_replace({_plain("nome")}, '[^a-z0-9]', '', 'g') AS f6,
trim(regexp_replace({_plain("nome")}, '[^a-z0-9]+', ' ', 'g')) AS f7, {_squeezed("lower(nome)")} AS f9, upper(trim(identificador)) AS f10, regexp_replace(nome, '^\\s*[A-Za-z]{{1,10}}\\s*\\d+\\s*[-–—:]\\s*', '') AS f11,
{_squeezed("coalesce(nome, '')")} AS f21, nullif(trim(nome), '') AS f24 FROM {_ONCE}""")
def name_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The keys of a name that differ on purpose: evidence, comparison, table, merge, identity, code, title, line, optional."""
    return _records(spark, folder, "nome", "identificador").select(
        "registro_id", T.evidence_key("nome").alias("f1"), T.comparison_key("nome").alias("f3"), T.table_key("nome").alias("f6"), T.merge_key("nome").alias("f7"),
        T.identity_key("nome").alias("f9"), T.code_key("identificador").alias("f10"), T.without_course_code("nome").alias("f11"), T.single_line("nome").alias("f21"), T.optional_text("nome").alias("f24"),
    )


@query(f"SELECT registro_id, {_layout('ementa')} AS f2, {_says_absent('ementa')} AS ausente, CASE WHEN NOT {_says_absent(_layout('ementa'))} THEN {_layout('ementa')} END AS conteudo FROM {_ONCE}")
def layout_and_absence(spark: SparkSession, folder: str) -> DataFrame:
    """Syllabi with their layout settled and texts that say there is none as null."""
    return _records(spark, folder, "ementa").select("registro_id", T.layout_text("ementa").alias("f2"), T.says_absent("ementa").alias("ausente"), T.content_text("ementa").alias("conteudo"))


@query(rf"""SELECT registro_id, list_aggregate(list_filter([trim(x, ' |:–-') for x in [regexp_replace(string_split_regex(nome, '(?i)\b(?:carga\s+hor[aáÁ]ria|per[ií]odo\s+letivo|docente|professor|turmas?)\s*:')[1], '(?i)\s+turmas?\s*$', '')]], lambda x: TRUE), 'min') AS nome FROM {_ONCE} WHERE nome IS NOT NULL""")
def course_names(spark: SparkSession, folder: str) -> DataFrame:
    """Course names without labels and marks behind them."""
    return _records(spark, folder, "nome").filter("nome is not null").select("registro_id", T.course_name(F.col("nome")).alias("nome"))


@query(rf"""SELECT registro_id, len(list_filter([trim(x) for x in string_split_regex(conteudo_programatico, '\r\n|[\n\r]')], lambda x: regexp_replace(x, '{_SP}', '', 'g') <> ''))::INTEGER AS linhas FROM {_ONCE} WHERE conteudo_programatico IS NOT NULL""")
def line_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Number of lines with content."""
    return _records(spark, folder, "conteudo_programatico").filter("conteudo_programatico is not null").select("registro_id", F.size(T.content_lines("conteudo_programatico")).alias("linhas"))


@query(rf"""SELECT registro_id, try_cast(nullif(regexp_extract(replace({_squeezed("carga_horaria_texto")}, ',', '.'), '(?i)^(\d+(?:\.\d+)?)\s*(?:h|horas?)?$', 1), '') AS DOUBLE) AS quantidade FROM {_ONCE} WHERE carga_horaria_texto IS NOT NULL""")
def quantities(spark: SparkSession, folder: str) -> DataFrame:
    """Quantities with a decimal comma and perhaps a unit; cells of two numbers are null."""
    return _records(spark, folder, "carga_horaria_texto").filter("carga_horaria_texto is not null").select("registro_id", T.quantity("carga_horaria_texto").alias("quantidade"))


@query(r"""SELECT instituicao_id, regexp_matches(cnpj, '^\d{14}$|^\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}$') AS cnpj_ok, regexp_matches(upper(trim(uf)), '^[A-Z]{2}$') AS uf_ok, length(nome) <= 200 AS nome_ok FROM instituicao""")
def format_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Formats of registration numbers, states and lengths; unknown stays unknown."""
    return table(spark, folder, "instituicao").select(
        "instituicao_id", F.col("cnpj").rlike(r"^\d{14}$|^\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}$").alias("cnpj_ok"), F.upper(F.trim("uf")).rlike("^[A-Z]{2}$").alias("uf_ok"), (F.char_length("nome") <= 200).alias("nome_ok")
    )


@query(r"""SELECT doc_id, regexp_extract('C:\envios\' || coalesce(source, 'x') || '/' || doc_id || '.pdf', '[^/\\]+$') AS nome, lower(regexp_replace(coalesce(source, 'x'), '\s', '', 'g')) AS pasta FROM documents""")
def file_names(spark: SparkSession, folder: str) -> DataFrame:
    """File names of Windows and Unix paths."""
    path = F.concat(F.lit("C:\\envios\\"), F.coalesce("source", F.lit("x")), F.lit("/"), F.col("doc_id"), F.lit(".pdf"))
    return table(spark, folder, "documents").select("doc_id", T.base_name(path).alias("nome"), F.lower(F.regexp_replace(F.coalesce("source", F.lit("x")), r"\s", "")).alias("pasta"))


@query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS d, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'HORA' ELSE 'HORA_AULA' END AS u, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE END AS ha, CASE WHEN p_partkey % 5 = 0 THEN p_size * 50 / 60.0 END AS hr, CASE WHEN p_partkey % 7 <> 0 THEN 50 END AS m FROM part),
c AS (SELECT *, list_distinct(list_filter([d * CASE u WHEN 'HORA' THEN 60 WHEN 'HORA_AULA' THEN m END, ha * m, hr * 60], lambda x: x IS NOT NULL)) AS known FROM p)
SELECT p_partkey, CASE WHEN NOT coalesce((u = 'HORA_AULA' AND d <> ha) OR (u = 'HORA' AND d <> hr), FALSE) AND len(known) = 1 THEN round(known[1], 4) END AS minutos FROM c""")
def workload_minutes(spark: SparkSession, folder: str) -> DataFrame:
    """Workloads in minutes where no two totals disagree."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    unit = F.when(F.col("p_size") % 3 == 1, "HORA").when(F.col("p_size") % 3 == 2, "HORA_AULA")
    minutes = R.normalized_minutes(size, unit, F.when(k % 2 == 0, size), F.when(k % 5 == 0, size * 50 / F.lit(60.0)), F.when(k % 7 != 0, F.lit(50)))
    return table(spark, folder, "part").select("p_partkey", F.round(minutes, 4).alias("minutos"))


@query(f"""SELECT registro_id, carga_horaria.total IS NULL OR coalesce(carga_horaria.teorica, 0) + coalesce(carga_horaria.pratica, 0) <= carga_horaria.total AS cabe,
(carga_horaria.total IS NOT NULL)::INTEGER + (carga_horaria.teorica IS NOT NULL)::INTEGER + (carga_horaria.pratica IS NOT NULL)::INTEGER + (carga_horaria.unidade IS NOT NULL)::INTEGER AS conhecidos,
abs(carga_horaria.total - carga_horaria.teorica - carga_horaria.pratica) <= 0.001 AS soma_exata FROM {_ONCE}""")
def workload_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether parts fit their total, how much is known, and sums with unknown parts unknown."""
    h = [F.col(f"carga_horaria.{c}") for c in ("total", "teorica", "pratica", "unidade")]
    one = F.lit("")
    return _records(spark, folder, "carga_horaria").select(
        "registro_id", R.components_fit(h[0], one, [(h[1], one), (h[2], one)]).alias("cabe"), R.workload_score(h).alias("conhecidos"), (F.abs(h[0] - h[1] - h[2]) <= 0.001).alias("soma_exata")
    )


@query(r"""SELECT p_partkey, coalesce(regexp_matches(t, '^\d+(\.\d{1,2})?$') AND try_cast(t AS DOUBLE) <= 999999.99, FALSE) AS valido FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || '.25' WHEN 2 THEN p_size || '.001' ELSE 'NaN' END AS t FROM part)""")
def amount_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts that are finite, within range and of two decimals."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    text = F.when(k == 0, size).when(k == 1, F.concat(size, F.lit(".25"))).when(k == 2, F.concat(size, F.lit(".001"))).otherwise("NaN")
    return table(spark, folder, "part").select("p_partkey", R.valid_amount(text).alias("valido"))


@query("""WITH c AS (SELECT c_custkey, lpad(((c_custkey * 7919 + 1234567) % 1000000000)::VARCHAR, 9, '0') || lpad((c_custkey % 100)::VARCHAR, 2, '0') AS cpf FROM customer),
d AS (SELECT *, [x::INTEGER for x in string_split(cpf, '')] AS d FROM c),
r AS (SELECT *, list_sum([d[i] * (11 - i) for i in range(1, 10)]) * 10 % 11 AS a, list_sum([d[i] * (12 - i) for i in range(1, 11)]) * 10 % 11 AS b FROM d)
SELECT c_custkey, cpf, (CASE a WHEN 10 THEN 0 ELSE a END = d[10]) AND (CASE b WHEN 10 THEN 0 ELSE b END = d[11]) AND len(list_distinct(d)) > 1 AS valido FROM r""")
def cpf_check(spark: SparkSession, folder: str) -> DataFrame:
    """Check digits of eleven-digit numbers."""
    k = F.col("c_custkey")
    cpf = F.concat(F.lpad(((k * 7919 + 1234567) % 1000000000).cast("string"), 9, "0"), F.lpad((k % 100).cast("string"), 2, "0"))
    return table(spark, folder, "customer").select("c_custkey", cpf.alias("cpf")).select("c_custkey", "cpf", R.valid_cpf(F.col("cpf")).alias("valido"))


@query("""SELECT registro_id::VARCHAR AS chave, 'nome_em_branco' AS regra FROM {one} WHERE trim(nome) = ''
UNION ALL SELECT registro_id::VARCHAR, 'total_negativo' FROM {one} WHERE carga_horaria.total < 0
UNION ALL SELECT registro_id::VARCHAR, 'ementa_longa' FROM {one} WHERE length(ementa) > 30000
UNION ALL SELECT registro_id::VARCHAR, 'recebido_antes' FROM {one} WHERE recebido_em < criado_em
UNION ALL SELECT matriz_id::VARCHAR, 'periodo' FROM matriz_curricular WHERE ano_fim < ano_inicio
UNION ALL SELECT correspondencia_id::VARCHAR, 'escala' FROM correspondencia_trecho WHERE NOT similaridade BETWEEN -1 AND 1
UNION ALL SELECT curso_id::VARCHAR, 'codigo_repetido' FROM curso c WHERE (SELECT count(*) FROM curso d WHERE d.instituicao_id = c.instituicao_id AND d.codigo = c.codigo) > 1
UNION ALL SELECT curso_id::VARCHAR, 'instituicao_ausente' FROM curso c WHERE c.instituicao_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM instituicao i WHERE i.instituicao_id = c.instituicao_id)
UNION ALL SELECT registro_id::VARCHAR, 'disciplina_ausente' FROM {one} e WHERE e.disciplina_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM disciplina d WHERE d.disciplina_id = e.disciplina_id)""".replace("{one}", _ONCE))
def validate_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Violations of checks, filtered uniqueness and references as (key, rule)."""
    e = _records(spark, folder, "nome", "carga_horaria", "ementa", "criado_em", "recebido_em", "disciplina_id")
    checks = {
        "nome_em_branco": F.trim("nome") != "", "total_negativo": F.col("carga_horaria.total") >= 0, "ementa_longa": F.char_length("ementa") <= 30000, "recebido_antes": F.col("recebido_em") >= F.col("criado_em"),
    }
    curso = table(spark, folder, "curso")
    out = L.violations(e, "registro_id", checks)
    out = out.unionByName(L.violations(table(spark, folder, "matriz_curricular"), "matriz_id", {"periodo": F.col("ano_fim") >= F.col("ano_inicio")}))
    out = out.unionByName(L.violations(table(spark, folder, "correspondencia_trecho"), "correspondencia_id", {"escala": F.col("similaridade").between(-1, 1)}))
    out = out.unionByName(L.repeated(curso, "curso_id", ["instituicao_id", "codigo"], "codigo_repetido"))
    out = out.unionByName(L.dangling(curso, "curso_id", "instituicao_id", table(spark, folder, "instituicao"), "instituicao_id", "instituicao_ausente"))
    return out.unionByName(L.dangling(e, "registro_id", "disciplina_id", table(spark, folder, "disciplina"), "disciplina_id", "disciplina_ausente"))


@query(f"""SELECT registro_id, CASE WHEN NOT {_says_absent(_layout('objetivo_geral'))} THEN {_layout('objetivo_geral')} END AS objetivo_geral,
array_to_string(list_sort(list_distinct(list_filter(paginas_origem, lambda p: p > 0))), ',') AS paginas, row_number() OVER (PARTITION BY matriz_codigo ORDER BY registro_id) AS numero FROM {_ONCE}""")
def record_normalization(spark: SparkSession, folder: str) -> DataFrame:
    """Records with texts and pages normalized, numbered from 1 in their lot."""
    rows = R.clean_record(_records(spark, folder, "objetivo_geral", "paginas_origem", "matriz_codigo"), ["objetivo_geral"])
    number = F.row_number().over(Window.partitionBy("matriz_codigo").orderBy("registro_id")).cast("long")
    return rows.select("registro_id", "objetivo_geral", F.array_join(F.col("paginas_origem").cast("array<string>"), ",").alias("paginas"), number.alias("numero"))


@query("""WITH d AS (SELECT doc_id, ceil(coalesce(length(text), 0) / 200.0)::INTEGER AS n FROM documents), b AS (SELECT doc_id, n, unnest(range(0, n, 20)) AS inicio FROM d WHERE n > 0)
SELECT doc_id, inicio::INTEGER AS inicio, least(inicio + 25, n)::INTEGER AS fim FROM b WHERE inicio = 0 OR inicio + 5 < n""")
def block_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping blocks of pages, 25 with 5 repeated."""
    pages = F.ceil(F.coalesce(F.char_length("text"), F.lit(0)) / F.lit(200.0)).cast("int")
    return table(spark, folder, "documents").select("doc_id", F.inline(R.block_ranges(pages, 25, 5)))


@query("""SELECT l_orderkey, array_to_string(list_sort(list_distinct([x for x in list(l_linenumber - 3 + l_orderkey % 5) if x > 0])), ',') AS paginas FROM lineitem GROUP BY l_orderkey""")
def page_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Page numbers of a block moved to the document's, sorted, positive and once each."""
    rows = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber") - 3).alias("p"))
    return rows.select("l_orderkey", F.array_join(R.pages(F.col("p"), (F.col("l_orderkey") % 5).cast("int")).cast("array<string>"), ",").alias("paginas"))


_KEYED = f"(SELECT *, matriz_codigo || '|' || trim(regexp_replace({_plain('nome')}, '[^a-z0-9]+', ' ', 'g')) AS chave FROM {_ONCE} WHERE matriz_codigo IS NOT NULL AND nome IS NOT NULL)"


@query(f"""SELECT chave, count(*) AS partes, arg_max(ementa, struct_pack(n := length(trim(ementa)), o := -registro_id)) AS ementa, arg_min(objetivo_geral, registro_id) FILTER (trim(objetivo_geral) <> '') AS objetivo_geral,
coalesce(array_to_string(list_sort(list_distinct(flatten(list(paginas_origem) FILTER (paginas_origem IS NOT NULL)))), ','), '') AS paginas, bool_or(carga_horaria.total IS NOT NULL) AS com_carga, count(DISTINCT carga_horaria.total) > 1 AS cargas_divergem FROM {_KEYED} GROUP BY chave""")
def block_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Records of one grid and name merged: longest text, first text, all pages, workload conflict."""
    rows = _records(spark, folder, "nome", "matriz_codigo", "ementa", "objetivo_geral", "paginas_origem", "carga_horaria").filter("matriz_codigo is not null and nome is not null")
    key = F.concat("matriz_codigo", F.lit("|"), T.merge_key("nome"))
    order = F.col("registro_id")
    all_pages = F.array_sort(F.array_distinct(F.flatten(F.collect_list("paginas_origem"))))
    return rows.groupBy(key.alias("chave")).agg(
        F.count("*").alias("partes"), R.longest_text(F.col("ementa"), order).alias("ementa"), R.first_text(F.col("objetivo_geral"), order).alias("objetivo_geral"),
        F.array_join(all_pages.cast("array<string>"), ",").alias("paginas"), F.bool_or(F.col("carga_horaria.total").isNotNull()).alias("com_carga"), (F.countDistinct("carga_horaria.total") > 1).alias("cargas_divergem"),
    )


_MERGE = "trim(regexp_replace({}, '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH l AS (SELECT matriz_codigo, {_MERGE.format(_plain("nome"))} AS nome, registro_id, unnest(string_split(conteudo_programatico, chr(10))) AS l, unnest(range(len(string_split(conteudo_programatico, chr(10))))) AS i FROM {_ONCE} WHERE matriz_codigo IS NOT NULL AND nome IS NOT NULL AND conteudo_programatico IS NOT NULL),
f AS (SELECT *, trim(l) AS t, row_number() OVER (PARTITION BY matriz_codigo, nome, trim(l) = '', {_MERGE.format(_plain("trim(l)"))} ORDER BY registro_id, i) AS rn FROM l)
SELECT matriz_codigo, nome, coalesce(string_agg(t, chr(10) ORDER BY registro_id, i) FILTER (rn = 1 AND t <> ''), '') AS conteudo FROM f GROUP BY 1, 2""")
def merged_contents(spark: SparkSession, folder: str) -> DataFrame:
    """Contents of records of one grid and name as one list, each line once."""
    rows = _records(spark, folder, "nome", "matriz_codigo", "conteudo_programatico").filter("matriz_codigo is not null and nome is not null and conteudo_programatico is not null")
    parts = rows.groupBy("matriz_codigo", T.merge_key("nome").alias("nome")).agg(F.array_sort(F.collect_list(F.struct("registro_id", "conteudo_programatico"))).alias("p"))
    return parts.select("matriz_codigo", "nome", R.merged_lines(F.transform("p", lambda x: x["conteudo_programatico"])).alias("conteudo"))


@query(f"""WITH r AS (SELECT DISTINCT matriz_codigo, nome, trim(regexp_replace({_plain("regexp_replace(nome, '^\\s*[A-Za-z]{1,10}\\s*\\d+\\s*[-–—:]\\s*', '')")}, '[^a-z0-9]+', ' ', 'g')) AS nome_base, regexp_replace(nome, '^\\s*[A-Za-z]{{1,10}}\\s*\\d+\\s*[-–—:]\\s*', '') <> nome AS codigo FROM {_ONCE} WHERE nome IS NOT NULL)
SELECT matriz_codigo, nome_base, count(*) AS formas, count(*) FILTER (codigo) AS com_codigo, CASE WHEN count(*) = 1 THEN 'unica' WHEN count(*) > 2 THEN 'mais_de_duas_formas' WHEN count(*) FILTER (codigo) = 1 THEN 'unir' ELSE 'codigos_diferentes' END AS decisao FROM r GROUP BY 1, 2""")
def title_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """Titles that are one but for a code, merged only where nothing speaks against it."""
    return R.reconciled_titles(_records(spark, folder, "nome", "matriz_codigo").filter("nome is not null"), "matriz_codigo")


@query("""SELECT c_custkey, CASE WHEN k IS NULL OR (n IS NULL) THEN c_mktsegment ELSE n END AS c_mktsegment, CASE WHEN k IS NULL OR b IS NULL THEN c_acctbal ELSE b END AS c_acctbal, CASE WHEN k IS NULL THEN 'mantido' ELSE 'atualizado' END AS resultado
FROM customer LEFT JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) || '*' END AS n, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS b FROM customer WHERE c_custkey % 5 <> 0) ON k = c_custkey""")
def import_merge(spark: SparkSession, folder: str) -> DataFrame:
    """An import in which missing values keep the stored ones."""
    stored = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = stored.filter("c_custkey % 5 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.upper("c_mktsegment"), F.lit("*"))).alias("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"))
    return R.merged_import(stored, new, "c_custkey", ["c_mktsegment", "c_acctbal"])


@query("""WITH ch AS (SELECT l_orderkey * 2 AS o_orderkey, min(l_linenumber) % 3 AS versao, min(l_suppkey) AS ordem FROM lineitem GROUP BY l_orderkey)
SELECT ch.o_orderkey, ch.ordem, CASE WHEN o.o_orderkey IS NULL THEN 'nao_encontrado' WHEN ch.versao = o.o_orderkey % 3 AND o.o_orderstatus = 'O' THEN 'atualizado' ELSE 'conflito' END AS resultado FROM ch LEFT JOIN orders o ON o.o_orderkey = ch.o_orderkey""")
def optimistic_update(spark: SparkSession, folder: str) -> DataFrame:
    """Changes against versions: done, in conflict, or without a row."""
    stored = table(spark, folder, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("versao"), "o_orderstatus")
    changes = table(spark, folder, "lineitem").groupBy((F.col("l_orderkey") * 2).alias("o_orderkey")).agg((F.min("l_linenumber") % 3).alias("versao"), F.min("l_suppkey").alias("ordem"))
    return R.optimistic_outcome(stored, changes, "o_orderkey", F.col("o_orderstatus") == "O")


@query("""SELECT n.nome, CASE WHEN k.n = 1 THEN k.id END AS id, CASE WHEN k.n IS NULL THEN 'criar' WHEN k.n = 1 THEN 'reutilizar' ELSE 'conflito' END AS resultado
FROM (SELECT DISTINCT instituicao AS nome FROM disciplina_equivalencia WHERE instituicao IS NOT NULL) n LEFT JOIN (SELECT nome, count(*) AS n, min(instituicao_id) AS id FROM instituicao GROUP BY 1) k ON k.nome = n.nome""")
def dimension_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Institutions named in records led to rows: reused, in conflict or to be created."""
    incoming = table(spark, folder, "disciplina_equivalencia").filter("instituicao is not null").select(F.col("instituicao").alias("nome"))
    return R.resolved_dimension(table(spark, folder, "instituicao").select("nome", "instituicao_id"), incoming, "nome", "instituicao_id")


@query("""SELECT n.n_nationkey, CASE WHEN n.n_nationkey >= 20 THEN 'inserir' ELSE 'igual' END AS resultado, TRUE AS gravar FROM nation n""")
def registration_outcome(spark: SparkSession, folder: str) -> DataFrame:
    """A batch registered again: equal rows stay, new ones are inserted, one that differs stops all."""
    batch = table(spark, folder, "nation")
    return R.registration(batch.filter("n_nationkey < 20"), batch, "n_nationkey", ["n_name", "n_regionkey"])


@query(f"""SELECT registro_id, sha256('{{"ementa":' || coalesce(to_json(ementa)::VARCHAR, 'null') || ',"nome":' || coalesce(to_json(nome)::VARCHAR, 'null') || '}}') AS proveniencia, length('inst1-' || substr(sha256(coalesce(nome, '')), 1, 40)) = 46 AS chave_ok FROM {_ONCE} WHERE nome IS NOT NULL AND ementa IS NOT NULL AND NOT regexp_matches(ementa || nome, '[\\x00-\\x1f"\\\\/\\x7f-\\x{{9f}}]')""")
def provenance_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of records as canonical JSON, fields in alphabetical order, and keys made of them."""
    rows = _records(spark, folder, "nome", "ementa").filter("nome is not null and ementa is not null").filter(~F.concat("ementa", "nome").rlike(r'[\x00-\x1f"\\/\x7f-\x{9f}]'))
    key = F.concat(F.lit("inst1-"), F.substring(F.sha2("nome", 256), 1, 40))
    return rows.select("registro_id", F.sha2(F.to_json(F.struct("ementa", "nome")), 256).alias("proveniencia"), key.rlike("^inst1-[0-9a-f]{40}$").alias("chave_ok"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_valid(props) AS json_ok FROM events")
def doc_json_parse(spark: SparkSession, folder: str) -> DataFrame:
    """A field of a JSON document and whether it is one."""
    return table(spark, folder, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.try_parse_json("props").isNotNull().alias("json_ok"))


@query(f"""SELECT registro_id, matriz_codigo FROM {_ONCE} e WHERE matriz_codigo IS NOT NULL AND paginas_origem IS NOT NULL AND NOT EXISTS (
SELECT 1 FROM {_ONCE} h WHERE h.matriz_codigo = e.matriz_codigo AND h.registro_id < e.registro_id AND h.paginas_origem IS NOT NULL AND len(list_filter(e.paginas_origem, lambda p: NOT list_contains(h.paginas_origem, p))) = 0)""")
def page_subsets(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose pages are not all among those of an earlier record of their grid (J17, P10, Z6); met page by page, never all with all.

    A record is left out if some earlier one shares as many of its pages as it has; records without pages are in every other.
    """
    rows = _records(spark, folder, "matriz_codigo", "paginas_origem").filter("matriz_codigo is not null and paginas_origem is not null")
    rows = rows.select("registro_id", "matriz_codigo", F.array_distinct("paginas_origem").alias("p"))
    each = rows.select("matriz_codigo", "registro_id", F.size("p").alias("n"), F.explode("p").alias("pagina"))
    shared = each.join(each.select("matriz_codigo", "pagina", F.col("registro_id").alias("h")), ["matriz_codigo", "pagina"]).filter("h < registro_id")
    inside = shared.groupBy("registro_id", "h").agg(F.count("*").alias("c"), F.first("n").alias("n")).filter("c = n").select("registro_id").distinct()
    first = Window.partitionBy("matriz_codigo").orderBy("registro_id")
    empty = rows.withColumn("_n", F.row_number().over(first)).filter("size(p) = 0 and _n > 1").select("registro_id")
    return rows.select("registro_id", "matriz_codigo").join(inside.unionByName(empty), "registro_id", "left_anti")


@query(f"""SELECT matriz_codigo, count(DISTINCT nome) AS nomes, CASE WHEN count(DISTINCT nome) = 1 THEN min(nome) END AS atribuido, count(DISTINCT nome) > 1 AS aviso FROM {_ONCE} WHERE matriz_codigo IS NOT NULL GROUP BY 1""")
def conflict_detect(spark: SparkSession, folder: str) -> DataFrame:
    """A field is assigned where all sources agree, else it is a warning."""
    rows = _records(spark, folder, "matriz_codigo", "nome").filter("matriz_codigo is not null")
    n = F.countDistinct("nome")
    return rows.groupBy("matriz_codigo").agg(n.alias("nomes"), F.when(n == 1, F.min("nome")).alias("atribuido"), (n > 1).alias("aviso"))


@query(f"""SELECT registro_id, (length(ementa) >= 30 OR length(conteudo_programatico) >= 30) IS TRUE AND ((length(objetivo_geral) >= 30) IS TRUE OR (length(competencias_habilidades) >= 30) IS TRUE OR carga_horaria.total IS NOT NULL) AS suficiente,
CASE WHEN nome IS NOT NULL AND identificador IS NOT NULL AND carga_horaria.total > 0 THEN 'identificada' ELSE 'inconclusiva' END AS situacao FROM {_ONCE}""")
def sufficiency(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a record holds enough to stand alone, and its promotion."""
    def enough(c: str) -> F.Column:
        return F.coalesce(F.char_length(c) >= 30, F.lit(False))

    good = (enough("ementa") | enough("conteudo_programatico")) & (enough("objetivo_geral") | enough("competencias_habilidades") | F.col("carga_horaria.total").isNotNull())
    known = F.coalesce(F.col("nome").isNotNull() & F.col("identificador").isNotNull() & (F.col("carga_horaria.total") > 0), F.lit(False))
    rows = _records(spark, folder, "nome", "identificador", "ementa", "conteudo_programatico", "objetivo_geral", "competencias_habilidades", "carga_horaria")
    return rows.select("registro_id", good.alias("suficiente"), F.when(known, "identificada").otherwise("inconclusiva").alias("situacao"))


