import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from syllabrook.operators import extract, lines, relational
from syllabrook.sources.tables import table

COURSE = "Disciplina: {0}\nCarga Horária: 60 horas\nEMENTA\nEstudo de {0} com provas e exemplos.\nOBJETIVO GERAL\nDominar os conceitos fundamentais da área.\nMETODOLOGIA\nAulas.\nBIBLIOGRAFIA BÁSICA\nLivro de {0}."


def found(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return extract.records(lines.lines_of(df, "doc_id", "text"), "doc_id").orderBy("doc_id", "segmento").collect()


def test_courses_of_documents(spark):
    rows = found(spark, COURSE.format("Algoritmos"), COURSE.format("Redes") + "\n" + COURSE.format("Grafos"), "Histórico\nAlgoritmos 8,0\nRedes 7,5", None, "")
    assert [(r.doc_id, r.nome) for r in rows] == [(0, "Algoritmos"), (1, "Redes"), (1, "Grafos")]
    one = rows[0]
    assert one.ementa == "Estudo de Algoritmos com provas e exemplos." and one.bibliografia_basica == "Livro de Algoritmos."
    assert one.carga_total == 60.0 and one.carga_unidade == "hora_declarada" and one.suficiente and not one.cargas_divergem


def test_keyed_hash(spark):
    for secret in (b"segredo", b"x" * 100):
        got = spark.createDataFrame([("olá",)], "t string").select(extract.keyed_hash(F.col("t"), secret)).first()[0]
        assert got == hmac.new(secret, "olá".encode(), hashlib.sha256).hexdigest()


def test_pages_are_clamped_or_refused():
    assert relational.clamp(500, 100) == 100 and relational.clamp(0, 100) == 1 and extract.checked_page(5) == 5
    with pytest.raises(ValueError):
        extract.checked_page(0)


def test_columns_of_a_table_are_checked(spark):
    rows = table(spark, "/root/testdata/sf0.001", "region", {"r_regionkey": "long"})
    assert dict(rows.dtypes) == {"r_regionkey": "bigint"}
    with pytest.raises(ValueError):
        table(spark, "/root/testdata/sf0.001", "region", {"nada": "long"})
