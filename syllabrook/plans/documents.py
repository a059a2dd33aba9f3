"""Ordered lines and table cells: sections, segments, margins, coverage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from syllabrook.functions.text import SECTIONS, is_course_name, section_header, without_bullets
from syllabrook.operators import extract as X
from syllabrook.operators import lines as N
from syllabrook.plans.catalog import _ONCE
from syllabrook.plans.registry import Registry
from syllabrook.sources.tables import once, table

registry = Registry()
query = registry.query

_LINES = """(SELECT doc_id, i::INTEGER AS indice, (i // 40 + 1)::INTEGER AS pagina, trim(l) AS texto FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents))"""
_START = "regexp_matches(texto, '^(\\d+\\.|[A-ZÁÉÍÓÚÂÊÔÃÕÇ]{4})')"
_SEG = f"(SELECT *, sum(CASE WHEN {_START} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY indice) AS segmento FROM {_LINES})"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return N.lines_of(table(spark, folder, "documents"), "doc_id", "text")


def _is_start() -> F.Column:
    return F.col("texto").rlike(r"^(\d+\.|[A-ZÁÉÍÓÚÂÊÔÃÕÇ]{4})")


@query(f"SELECT doc_id, segmento::BIGINT AS segmento, min(indice) AS de, max(indice) AS ate, count(*) AS linhas FROM {_SEG} GROUP BY 1, 2")
def marker_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of documents from one start line to the next."""
    rows = N.segments(_lines(spark, folder), "doc_id", _is_start())
    return rows.groupBy("doc_id", "segmento").agg(F.min("indice").alias("de"), F.max("indice").alias("ate"), F.count("*").alias("linhas"))


_LABELS = ", ".join(f"('{name}', '{field}')" for field, names in SECTIONS.items() for name in names)
_KEYED = r"trim(trim(regexp_replace(translate(strip_accents(lower(trim(regexp_replace(texto, '^\s*(?:\d+(?:\.\d+)*(?:\s*[.\-–):]\s*|\s+))', '')))), 'ªº', 'ao'), '[\s\x0b\x{85}\p{Z}]+', ' ', 'g')), ' :;().')"


@query(f"""SELECT l.doc_id, l.indice, r.campo FROM {_LINES} l JOIN (VALUES {_LABELS}) r(rotulo, campo) ON {_KEYED} = r.rotulo WHERE NOT contains(l.texto, ':') OR NOT regexp_matches(l.texto, ':.')""")
def section_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that are a section's label and nothing more."""
    h = section_header(F.col("texto"))
    rows = _lines(spark, folder).filter(~F.col("texto").rlike(":.")).select("doc_id", "indice", h.alias("h"))
    return rows.filter("h is not null").select("doc_id", "indice", F.col("h.campo").alias("campo"))


@query()
def section_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with the section they stand in, by the last header of their segment."""
    rows = N.active_section(N.segments(N.headed(_lines(spark, folder)), "doc_id", _is_start()), "doc_id")
    return rows.filter("secao is not null and not cabecalho").select("doc_id", "indice", "secao", without_bullets("texto").alias("texto"))


@query(f"""SELECT doc_id, indice, min(CASE WHEN {_START} THEN indice END) OVER (PARTITION BY doc_id, pagina ORDER BY indice ROWS BETWEEN 18 PRECEDING AND 1 PRECEDING) AS contexto FROM {_LINES}""")
def lookback_context(spark: SparkSession, folder: str) -> DataFrame:
    """The first heading among the 18 lines before, on the same page."""
    rows = _lines(spark, folder)
    return rows.select("doc_id", "indice", N.look_back(rows, "doc_id", _is_start()).alias("contexto"))


@query(f"""SELECT doc_id, indice FROM (SELECT *, max(CASE WHEN regexp_matches(texto, '^(Atenciosamente|Assinatura|www\\.)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pagina ORDER BY indice) AS f FROM {_LINES}) WHERE f = 0 AND texto <> ''""")
def body_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that are not blank and not below a footer of their page."""
    rows = _lines(spark, folder)
    below = N.after_footer(rows, "doc_id", F.col("texto").rlike(r"^(Atenciosamente|Assinatura|www\.)"))
    return rows.withColumn("_below", below).filter("not _below and texto <> ''").select("doc_id", "indice")


@query(r"""WITH l AS (SELECT source, doc_id AS pagina, i AS indice, trim(t) AS texto FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)),
n AS (SELECT *, row_number() OVER (PARTITION BY source, pagina ORDER BY indice) AS a, row_number() OVER (PARTITION BY source, pagina ORDER BY indice DESC) AS b FROM l)
SELECT source, trim(regexp_replace(texto, '[\s\x0b\x{85}\p{Z}]+', ' ', 'g')) AS texto, count(DISTINCT pagina) AS paginas FROM n WHERE (a <= 2 OR b <= 2) AND trim(regexp_replace(texto, '[\s\x0b\x{85}\p{Z}]+', ' ', 'g')) <> '' GROUP BY 1, 2 HAVING count(DISTINCT pagina) >= 3""")
def repeated_margins(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that open or close three or more documents of a source, each taken for a page."""
    rows = table(spark, folder, "documents").filter("text is not null and source is not null")
    lines = rows.select("source", F.col("doc_id").alias("pagina"), F.posexplode(F.split("text", "\n")).alias("indice", "texto")).withColumn("texto", F.trim("texto"))
    return N.repeated_margins(lines, "source")


@query()
def document_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Starts of documents' parts that lie 18 lines apart and differ in name."""
    rows = _lines(spark, folder).filter(_is_start() & is_course_name(F.col("texto")))
    starts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("indice", F.col("texto").alias("nome")))).alias("s"))
    return starts.select("doc_id", F.inline(N.kept_starts(F.col("s"), 18)))


@query(f"""SELECT matriz_codigo, p AS pagina, string_agg(DISTINCT registro_id::VARCHAR, ',' ORDER BY registro_id::VARCHAR) AS registros, count(*) AS sinais FROM (SELECT matriz_codigo, registro_id, unnest(paginas_origem) AS p FROM {_ONCE}) GROUP BY 1, 2""")
def coverage_report(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of each grid with the records on them."""
    rows = once(table(spark, folder, "disciplina_equivalencia").select("registro_id", "matriz_codigo", "paginas_origem"), "registro_id")
    each = rows.select("matriz_codigo", F.col("registro_id").cast("string").alias("registro"), F.explode("paginas_origem").alias("pagina"))
    return N.coverage(each, "matriz_codigo", "pagina", "registro")


@query(f"""WITH p AS (SELECT matriz_codigo, max(x) AS n FROM (SELECT matriz_codigo, unnest(paginas_origem) AS x FROM {_ONCE} WHERE matriz_codigo IS NOT NULL) GROUP BY 1)
SELECT matriz_codigo, q::INTEGER AS pagina FROM (SELECT matriz_codigo, unnest(range(1, n + 1)) AS q FROM p) a WHERE NOT EXISTS (SELECT 1 FROM {_ONCE} e WHERE e.matriz_codigo = a.matriz_codigo AND list_contains(e.paginas_origem, a.q::INTEGER))""")
def pages_without_records(spark: SparkSession, folder: str) -> DataFrame:
    """Pages up to the last one of a grid that no record names."""
    rows = once(table(spark, folder, "disciplina_equivalencia").select("registro_id", "matriz_codigo", "paginas_origem"), "registro_id").filter("matriz_codigo is not null")
    each = rows.select("matriz_codigo", F.explode("paginas_origem").alias("p")).groupBy("matriz_codigo").agg(F.collect_set("p").alias("p"))
    return each.filter("array_max(p) >= 1").select("matriz_codigo", F.explode(F.array_except(F.sequence(F.lit(1), F.array_max("p")), "p")).alias("pagina"))


@query("""WITH h AS (SELECT DISTINCT l_orderkey, l_linenumber AS rotulo, l_linenumber * 7.0 AS centro FROM lineitem), c AS (SELECT l_orderkey, l_partkey AS valor, l_quantity AS x0, l_quantity + 4 AS x1 FROM lineitem)
SELECT h.l_orderkey, h.rotulo, count(c.valor) AS celulas, CASE WHEN count(c.valor) = 1 THEN min(c.valor) END AS valor FROM h LEFT JOIN c ON c.l_orderkey = h.l_orderkey AND c.x0 <= h.centro AND h.centro <= c.x1 GROUP BY 1, 2""")
def label_cell_range(spark: SparkSession, folder: str) -> DataFrame:
    """The one cell under each header's centre."""
    rows = table(spark, folder, "lineitem")
    headers = rows.select("l_orderkey", F.col("l_linenumber").alias("rotulo"), (F.col("l_linenumber") * 7.0).alias("centro")).distinct()
    cells = rows.select("l_orderkey", F.col("l_partkey").alias("valor"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 4).alias("x1"))
    return N.cells_under(headers, cells, ["l_orderkey"], 4.0)


@query("""SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, arg_min(b.l_quantity, struct_pack(d := b.l_quantity - a.l_quantity, p := b.l_partkey)) AS vizinho FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_quantity - a.l_quantity BETWEEN 1 AND 35 GROUP BY ALL""")
def adjacent_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest cell 1 to 35 points to the right of each cell of a row."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").distinct()
    w = Window.partitionBy("l_orderkey").orderBy("l_quantity").rangeBetween(1, 35)
    near = rows.withColumn("vizinho", F.min("l_quantity").over(w)).filter("vizinho is not null")
    return near.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min_by("vizinho", F.col("vizinho") - F.col("l_quantity")).alias("vizinho"))


@query("SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'vazia' WHEN (length(text) - length(regexp_replace(text, '[^\\p{L}\\p{N}\\s\\p{P}\\p{M}]', '', 'g'))) / length(text) > 0.05 THEN 'ilegivel' WHEN length(text) < 40 THEN 'esparsa' ELSE 'texto' END AS decisao FROM documents")
def page_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """What a page's text is good for: nothing, too many strange characters, too little, or as it is."""
    odd = F.char_length("text") - F.char_length(F.regexp_replace("text", r"[^\p{L}\p{N}\s\p{P}\p{M}]", ""))
    decision = F.when(F.coalesce("text", F.lit("")) == "", "vazia").when(odd / F.char_length("text") > 0.05, "ilegivel").when(F.char_length("text") < 40, "esparsa").otherwise("texto")
    return table(spark, folder, "documents").select("doc_id", decision.alias("decisao"))


@query()
def extracted_records(spark: SparkSession, folder: str) -> DataFrame:
    """Courses found in documents, line by line."""
    out = X.records(_lines(spark, folder), "doc_id")
    return out.withColumn("paginas_origem", F.array_join(F.col("paginas_origem").cast("array<string>"), ","))


@query(r"""SELECT doc_id, indice, try_cast(replace(nullif(regexp_extract(texto, '(?i)carga\s+hor[aáÁ]ria(?:\s+total)?(?:\s*\(h/a\))?\s*:?\s*(\d+(?:[,.]\d+)?)\s*(horas?|h/a|h)?\s*$', 1), ''), ',', '.') AS DOUBLE) AS total FROM {lines} WHERE regexp_matches(texto, '(?i)carga\s+hor[aáÁ]ria(?:\s+total)?(?:\s*\(h/a\))?\s*:?\s*(\d+(?:[,.]\d+)?)\s*(horas?|h/a|h)?\s*$')""".replace("{lines}", _LINES))
def workload_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that state a total workload."""
    return _lines(spark, folder).select("doc_id", "indice", X.workload(F.col("texto"), "total").alias("total")).filter("total is not null")
