"""Operators on ordered lines and table cells: sections, segments, running margins, look-back, cells under headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syllabrook.functions.text import merge_key, section_header, squeeze


def lines_of(texts: DataFrame, key: str, text: str, per_page: int = 40) -> DataFrame:
    """Lines of texts: (key, indice, pagina, texto), pages of ``per_page`` lines where a text has none of its own (S5 interface)."""
    rows = texts.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("indice", "texto"))
    return rows.select(key, "indice", (F.expr(f"indice div {per_page}") + 1).cast("int").alias("pagina"), F.trim("texto").alias("texto"))


def segments(lines: DataFrame, key: str, start: Column) -> DataFrame:
    """Adds ``segmento``: 0 before the first start, then counted by start lines."""
    w = Window.partitionBy(key).orderBy("indice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("segmento", F.sum(F.when(start, 1).otherwise(0)).over(w))


def headed(lines: DataFrame) -> DataFrame:
    """Adds ``abre``, the section that a line opens with the text after its label, recognized once for all who ask."""
    return lines.withColumn("abre", section_header(F.col("texto")))


def active_section(lines: DataFrame, key: str) -> DataFrame:
    """Adds ``secao`` to headed lines: the field of the last header of the segment, null after a label that ends it or after a skipped page."""
    order = Window.partitionBy(key, "segmento").orderBy("indice")
    marked = lines.withColumn("_gap", F.col("pagina") > F.lag("pagina").over(order) + 1)
    mark = F.when(F.col("abre").isNotNull(), F.col("abre.campo")).when(F.col("_gap"), F.lit("_parar"))
    last = F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("secao", F.nullif(last, F.lit("_parar"))).withColumn("cabecalho", F.col("abre").isNotNull()).drop("_gap")


def after_footer(lines: DataFrame, key: str, footer: Column) -> Column:
    """Whether a footer stands on the same page at or above the line."""
    w = Window.partitionBy(key, "pagina").orderBy("indice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.max(F.when(footer, 1).otherwise(0)).over(w) == 1


def repeated_margins(lines: DataFrame, key: str, least: int = 3, rows: int = 2) -> DataFrame:
    """Texts that stand in the first or last lines of at least ``least`` pages of a document: (key, texto, paginas)."""
    page = Window.partitionBy(key, "pagina")
    top = F.row_number().over(page.orderBy("indice"))
    bottom = F.row_number().over(page.orderBy(F.desc("indice")))
    near = lines.withColumn("_t", top).withColumn("_b", bottom).filter((F.col("_t") <= rows) | (F.col("_b") <= rows))
    near = near.select(key, squeeze("texto").alias("texto"), "pagina").filter("texto <> ''")
    return near.groupBy(key, "texto").agg(F.countDistinct("pagina").alias("paginas")).filter(F.col("paginas") >= least)


def look_back(lines: DataFrame, key: str, header: Column, reach: int = 18) -> Column:
    """The first line of a kind among the ``reach`` lines before, on the same page."""
    w = Window.partitionBy(key, "pagina").orderBy("indice").rowsBetween(-reach, -1)
    return F.min(F.when(header, F.col("indice"))).over(w)


def kept_starts(starts: Column, apart: int) -> Column:
    """Of the ordered starts of a document, array<struct<indice, nome>>, those at least ``apart`` lines after the last kept and of another name.

    Depends on what was kept before, so it is a fold over the document's starts.
    """
    nothing = F.filter(starts, lambda x: F.lit(False))

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        near = (F.size(kept) > 0) & ((x["indice"] - last["indice"] < apart) | (merge_key(x["nome"]) == merge_key(last["nome"])))
        return F.when(F.coalesce(near, F.lit(False)), kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(starts, nothing, step)


def cells_under(headers: DataFrame, cells: DataFrame, keys: list[str], width: float) -> DataFrame:
    """The cell whose range holds the centre of a header; null where none or several do.

    ``headers``: keys, rotulo, centro; ``cells``: keys, valor, x0, x1 of at most ``width``. Ranges meet by
    bins of that width, an equality join on two bins, not by comparing all with all.
    """
    grid = lambda x: F.floor(x / F.lit(float(width)))
    left = headers.withColumn("_bin", grid(F.col("centro")))
    right = cells.withColumn("_bin", F.explode(F.array_distinct(F.array(grid(F.col("x0")), grid(F.col("x1"))))))
    met = left.join(right, [*keys, "_bin"]).filter("x0 <= centro and centro <= x1")
    one = met.groupBy(*keys, "rotulo").agg(F.count("*").alias("n"), F.min("valor").alias("valor"))
    out = headers.select(*keys, "rotulo").distinct().join(one, [*keys, "rotulo"], "left")
    return out.select(*keys, "rotulo", F.coalesce("n", F.lit(0)).cast("long").alias("celulas"), F.when(F.col("n") == 1, F.col("valor")).alias("valor"))


def coverage(records: DataFrame, key: str, page: str, record: str) -> DataFrame:
    """Pages of a document with the records and how many signals they have: (key, page, registros, sinais)."""
    return records.groupBy(key, page).agg(F.array_join(F.array_sort(F.collect_set(record)).cast("array<string>"), ",").alias("registros"), F.count("*").alias("sinais"))
