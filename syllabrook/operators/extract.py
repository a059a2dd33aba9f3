"""Records out of ordered lines: starts, segments, sections, workloads, sufficiency; one set-based chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syllabrook.functions.text import SECTIONS, comparison_key, course_name, is_course_name, squeeze
from syllabrook.operators import lines as N

# How a line names a course, and how it states a workload with its label.
IDENTITY = r"(?iu)^(?:\d+[º°ª]?\s+)?(?:c[oó]digo\s*/\s*disciplina|nome\s+da\s+disciplina|componente\s+curricular|disciplina(?:\s*/\s*\*?unidade\s+curricular)?)\s*(?::|[-–]|\s)\s*(.*)$"
WORKLOADS = {
    "total": r"(?iu)carga\s+hor[aá]ria(?:\s+total)?(?:\s*\(h/a\))?\s*:?\s*(\d+(?:[,.]\d+)?)\s*(horas?|h/a|h)?\s*$",
    "teorica": r"(?iu)^(?:parte\s+|ch\s+)?te[oó]rica\s*:?\s*(\d+(?:[,.]\d+)?)\s*(horas?|h/a|h)?\s*$",
    "pratica": r"(?iu)^(?:parte\s+|ch\s+)?pr[aá]tica\s*:?\s*(\d+(?:[,.]\d+)?)\s*(horas?|h/a|h)?\s*$",
}


def workload(c: Column, field: str) -> Column:
    """The amount that a line states for a field, null without one."""
    return F.replace(F.regexp_extract(c, WORKLOADS[field], 1), F.lit(","), F.lit(".")).try_cast("double")


def workload_unit(c: Column) -> Column:
    """The unit of a line that states a workload: hora_aula, hora_declarada, or null where none is said."""
    stated = F.lit(None).cast("string")
    for pattern in WORKLOADS.values():
        found = c.rlike(pattern)
        unit = F.when(F.contains(comparison_key(c), F.lit("h/a")), "hora_aula").when(F.regexp_extract(c, pattern, 2) != "", "hora_declarada")
        stated = F.coalesce(stated, F.when(found, unit))
    return stated


def starts(lines: DataFrame, key: str, apart: int = 1) -> DataFrame:
    """Headed lines at which a course begins, with its name: (key, indice, nome).

    Either the line names it after a label, or it is a fair name right before a syllabus header. Of starts
    less than ``apart`` lines after the last one, or of the same name, the first stays.
    """
    named = F.nullif(course_name(F.regexp_extract("texto", IDENTITY, 1)), F.lit(""))
    nxt = F.lead("abre.campo").over(Window.partitionBy(key).orderBy("indice"))
    rows = lines.withColumn("_next", nxt).withColumn("_named", named).filter("_named is not null or _next = 'ementa'")
    # few lines are left for the dearer test
    found = rows.select(key, "indice", F.coalesce("_named", course_name("texto")).alias("nome")).filter(is_course_name(F.col("nome")))
    each = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("indice", "nome"))).alias("s"))
    return each.select(key, F.inline(N.kept_starts(F.col("s"), apart)))


def records(lines: DataFrame, key: str) -> DataFrame:
    """Courses found in lines (key, indice, pagina, texto): name, sections, workload, pages, whether it is enough.

    Lines that repeat at the margins of three pages or more go first. A field of the workload is taken if
    all lines that state it agree, else null with a warning. Documents without a start give no row.
    """
    margins = N.repeated_margins(lines, key).select(key, F.col("texto").alias("_margin"))
    body = N.headed(lines.withColumn("_margin", squeeze("texto")).join(margins, [key, "_margin"], "left_anti").select(key, "indice", "pagina", "texto"))
    begun = body.join(starts(body, key), [key, "indice"], "left")
    rows = N.active_section(N.segments(begun, key, F.col("nome").isNotNull()), key).filter("segmento > 0")
    rows = rows.withColumns({f"h_{f}": workload(F.col("texto"), f) for f in WORKLOADS}).withColumn("h_unidade", workload_unit(F.col("texto")))
    rows = rows.withColumn("t", F.nullif(F.when(F.col("cabecalho"), F.col("abre.valor")).otherwise(F.col("texto")), F.lit("")))

    def text(field: str) -> Column:
        own = F.array_sort(F.collect_list(F.when((F.col("secao") == field) & F.col("t").isNotNull(), F.struct("indice", "t"))))
        return F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda x: x["t"]), "\n")).alias(field.replace(".", "_"))

    def agreed(c: str) -> Column:
        return F.when(F.size(F.collect_set(c)) == 1, F.get(F.collect_set(c), 0))

    out = rows.groupBy(key, "segmento").agg(
        F.first("nome", ignorenulls=True).alias("nome"),
        F.array_sort(F.collect_set("pagina")).alias("paginas_origem"),
        *(text(f) for f in SECTIONS if f != "_parar"),
        *(agreed(f"h_{f}").alias(f"carga_{f}") for f in (*WORKLOADS, "unidade")),
        (F.size(F.collect_set("h_total")) > 1).alias("cargas_divergem"),
    )
    long = lambda c: F.coalesce(F.char_length(c) >= 30, F.lit(False))
    others = [c for c in out.columns if c.startswith(("objetivos_", "competencias", "bibliografia_"))]
    more = F.col("carga_total").isNotNull()
    for c in others:
        more = more | long(c)
    return out.withColumn("suficiente", (long("ementa") | long("conteudo_programatico")) & more)


def keyed_hash(c: Column, secret: bytes) -> Column:
    """HMAC-SHA256 of a text as hex, made of the built-in hash (H4)."""
    import hashlib

    block = (secret if len(secret) <= 64 else hashlib.sha256(secret).digest()).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ p for b in block).hex())) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(c, "UTF-8")), 256))), 256)


def checked_page(limit: int, most: int = 100) -> int:
    """A page size that must lie within its limits; unlike :func:`syllabrook.operators.relational.clamp` it is refused otherwise."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must lie in 1..{most}")
    return limit
