"""Record operators: workloads, check digits, merges of overlapping extractions, outcomes of batch changes, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syllabrook.functions.text import content_text, merge_key, without_course_code


def normalized_minutes(declared: Column, unit: Column, lesson_total: Column, clock_total: Column, lesson_minutes: Column) -> Column:
    """A workload in minutes from up to three totals, null if any two disagree or none is known."""
    clash = ((unit == "HORA_AULA") & (declared != lesson_total)) | ((unit == "HORA") & (declared != clock_total))
    factor = F.when(unit == "HORA", F.lit(60.0)).when(unit == "HORA_AULA", lesson_minutes.cast("double"))
    known = F.array_distinct(F.array_compact(F.array(declared * factor, lesson_total * lesson_minutes, clock_total * F.lit(60.0))))
    return F.when(~F.coalesce(clash, F.lit(False)) & (F.size(known) == 1), F.get(known, 0))


def components_fit(total: Column, unit: Column, parts: list[tuple[Column, Column]]) -> Column:
    """Whether parts in the total's unit add up to no more than it; other units and nulls count as 0 (V2)."""
    own = F.lit(0.0)
    for value, part_unit in parts:
        own = own + F.when(part_unit == unit, F.coalesce(value, F.lit(0.0))).otherwise(0.0)
    return total.isNull() | (own <= total)


def valid_amount(text: Column) -> Column:
    """Whether a text is a finite number from 0 to 999,999.99 with two decimals at most."""
    value = text.try_cast("double")
    return F.coalesce(text.rlike(r"^\d+(\.\d{1,2})?$") & (value <= 999999.99), F.lit(False))


def valid_cpf(text: Column) -> Column:
    """Whether the digits of a text are a CPF: eleven, not all alike, with both check digits right."""
    digits = F.regexp_replace(text, r"[.\-]", "")
    d = F.transform(F.filter(F.split(digits, ""), lambda x: x != ""), lambda x: x.try_cast("int"))

    def check(n: int) -> Column:
        rest = F.aggregate(F.zip_with(F.slice(d, 1, n), F.sequence(F.lit(n + 1), F.lit(2)), lambda x, w: x * w), F.lit(0), lambda s, x: s + x) * 10 % 11
        return F.when(rest == 10, 0).otherwise(rest) == F.get(d, n)

    good = digits.rlike(r"^\d{11}$") & ~digits.rlike(r"^(\d)\1{10}$")
    return F.coalesce(F.when(good, check(9) & check(10)), F.lit(False))


def pages(column: Column, offset: Column | int = 0) -> Column:
    """Positive page numbers, moved by ``offset``, sorted and once each."""
    shift = offset if isinstance(offset, Column) else F.lit(offset)
    return F.array_sort(F.array_distinct(F.filter(F.transform(column, lambda p: p + shift), lambda p: p > 0)))


def block_ranges(total: Column, size: int, overlap: int) -> Column:
    """Overlapping blocks of pages as array<struct<inicio, fim>>; the first block that reaches the end is the last."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the size")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)), F.lit(step))
    blocks = F.transform(starts, lambda s: F.struct(s.alias("inicio"), F.least(s + size, total).alias("fim")))
    return F.when(total > 0, F.filter(blocks, lambda b: (b["inicio"] == 0) | (b["inicio"] + overlap < total))).otherwise(F.array().cast("array<struct<inicio:int,fim:int>>"))


def workload_score(columns: list[Column]) -> Column:
    """How many of the fields are known."""
    out = F.lit(0)
    for c in columns:
        out = out + c.isNotNull().cast("int")
    return out


def longest_text(text: Column, order: Column) -> Column:
    """Aggregate: the longest of several texts, of equally long ones the first in ``order``."""
    return F.max_by(text, F.when(text.isNotNull(), F.struct(F.char_length(F.trim(text)).alias("n"), (-order).alias("o"))))


def first_text(text: Column, order: Column) -> Column:
    """Aggregate: the first text in ``order`` that is not blank."""
    return F.min_by(text, F.when(F.trim(text) != "", order))


def merged_lines(texts: Column) -> Column:
    """Lines of several texts in order, each normalized line once, as one text."""
    lines = F.filter(F.transform(F.flatten(F.transform(texts, lambda t: F.split(t, "\n"))), lambda x: F.trim(x)), lambda x: x != "")
    keys = F.transform(lines, lambda x: merge_key(x))
    kept = F.filter(F.arrays_zip(lines.alias("l"), keys.alias("k")), lambda x, i: F.array_position(keys, x["k"]) == i + 1)
    return F.array_join(F.transform(kept, lambda x: x["l"]), "\n")


def reconciled_titles(names: DataFrame, group: str) -> DataFrame:
    """Names that are one but for a leading code: (group, nome_base, formas, com_codigo, decisao).

    Two forms of which exactly one has no code are merged; anything else is left and says why.
    """
    base = merge_key(without_course_code("nome"))
    rows = names.select(group, "nome", base.alias("nome_base"), (without_course_code("nome") != F.col("nome")).alias("codigo")).distinct()
    out = rows.groupBy(group, "nome_base").agg(F.count("*").alias("formas"), F.count_if("codigo").alias("com_codigo"))
    why = F.when(F.col("formas") == 1, "unica").when(F.col("formas") > 2, "mais_de_duas_formas").when(F.col("com_codigo") == 1, "unir").otherwise("codigos_diferentes")
    return out.withColumn("decisao", why)


def merged_import(stored: DataFrame, incoming: DataFrame, key: str, columns: list[str], replace_absent: bool = False) -> DataFrame:
    """Rows after an import: a new value wins, a missing one keeps the old unless ``replace_absent`` (T15, M6), with the outcome of each row."""
    new = incoming.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_in"))
    rows = stored.select(key, *columns, F.lit(True).alias("_old")).join(new, key, "full_outer")
    out = [F.when(F.col("_in").isNull() | (F.col(f"_new_{c}").isNull() & F.lit(not replace_absent)), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c) for c in columns]
    outcome = F.when(F.col("_in").isNull(), "mantido").when(F.col("_old").isNull(), "inserido").otherwise("atualizado")
    return rows.select(key, *out, outcome.alias("resultado"))


def optimistic_outcome(stored: DataFrame, changes: DataFrame, key: str, editable: Column) -> DataFrame:
    """What becomes of changes guarded by a version: atualizado, conflito (other version or not editable) or nao_encontrado (M1, M2).

    Both have ``versao``; of several changes to one key and version the first by ``ordem`` wins.
    """
    first = changes.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("ordem")))
    base = stored.select(key, F.col("versao").alias("_versao"), editable.alias("_editable"))
    rows = first.join(base, key, "left")
    good = (F.col("versao") == F.col("_versao")) & F.col("_editable") & (F.col("_n") == 1)
    return rows.select(key, "ordem", F.when(F.col("_versao").isNull(), "nao_encontrado").when(good, "atualizado").otherwise("conflito").alias("resultado"))


def resolved_dimension(stored: DataFrame, incoming: DataFrame, name: str, key: str) -> DataFrame:
    """Names led to dimension rows: reused, in conflict (several rows bear the name) or created (M4)."""
    known = stored.groupBy(F.col(name).alias("nome")).agg(F.count("*").alias("n"), F.min(key).alias("id"))
    rows = incoming.select(F.col(name).alias("nome")).distinct().join(known, "nome", "left")
    return rows.select("nome", F.when(F.col("n") == 1, F.col("id")).alias("id"), F.when(F.col("n").isNull(), "criar").when(F.col("n") == 1, "reutilizar").otherwise("conflito").alias("resultado"))


def registration(stored: DataFrame, batch: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Outcome of an all-or-nothing, repeatable registration: inserir, igual or divergente, and whether the batch may be written."""
    own = batch.select(key, F.sha2(F.to_json(F.struct(*sorted(content))), 256).alias("novo"))
    old = stored.select(key, F.sha2(F.to_json(F.struct(*sorted(content))), 256).alias("velho"))
    rows = own.join(old, key, "left").withColumn("resultado", F.when(F.col("velho").isNull(), "inserir").when(F.col("velho") == F.col("novo"), "igual").otherwise("divergente"))
    bad = rows.agg(F.count_if(F.col("resultado") == "divergente").alias("_bad"))  # one row
    return rows.join(F.broadcast(bad)).select(key, "resultado", (F.col("_bad") == 0).alias("gravar"))


def clean_record(record: DataFrame, texts: list[str]) -> DataFrame:
    """A record with every text normalized (absence as null) and its pages positive, sorted and once each."""
    return record.withColumns({c: content_text(c) for c in texts}).withColumn("paginas_origem", pages(F.col("paginas_origem")))
