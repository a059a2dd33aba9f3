import json

from pyspark.sql import functions as F

from syllabrook.sources import files


def test_documents_of_a_folder(spark, tmp_path):
    course = {"nome": "Cálculo", "ementa": "Limites", "paginas_origem": [1, 2], "carga_horaria": {"total": 60, "unidade": "HORA"}}
    (tmp_path / "a__gemini.json").write_text("\ufeff" + json.dumps({"resultado": {"instituicao": "U", "curso": "C", "disciplinas": [course, {"nome": " "}]}}), encoding="utf-8")
    (tmp_path / "b__gemini.json").write_text(json.dumps({"instituicao": "V", "disciplinas": []}))
    (tmp_path / "c__gemini.json").write_text("{nada")
    (tmp_path / "d__gemini.json").write_text("{}")
    (tmp_path / "e.txt").write_text("x")
    documents = files.json_documents(spark, str(tmp_path), "*__gemini.json")
    errors = {r.arquivo[-14]: r.erro for r in documents.collect()}
    assert errors == {"a": None, "b": None, "c": "json_invalido", "d": "sem_disciplinas"}
    rows = files.courses(documents).collect()
    assert [(r.instituicao, r.curso, r.numero, r.nome, r.carga_horaria.total) for r in rows] == [("U", "C", 1, "Cálculo", 60.0)]


def test_pdf_files(spark, tmp_path):
    (tmp_path / "um.pdf").write_bytes(b"junk %PDF-1.7 ...")
    (tmp_path / "dois.pdf").write_bytes(b"no")
    (tmp_path / "tres.pdf").write_bytes(b"%PDF-1.4")
    out = {r.arquivo.rsplit("/", 1)[-1]: r for r in files.pdf_files(spark, str(tmp_path)).collect()}
    assert out["um.pdf"].recusa is None and out["dois.pdf"].recusa == "nao_e_pdf" and len(out["tres.pdf"].sha256) == 64


def test_kept_results(spark):
    inputs = spark.createDataFrame([(1, "a"), (2, "b")], "i int, h string").withColumn("chave", files.result_key(F.col("h"), "m", 3))
    kept = inputs.filter("i = 1")
    assert [r.chave for r in files.misses(inputs, kept, "chave").collect()] == ["b__m__v3"]
    assert files.misses(inputs, kept, "chave", force=True).count() == 2


def test_labels(spark, tmp_path):
    side = {"arquivo": "a", "disciplina": "d", "secao": "ementa", "texto": "t"}
    rows = [{"id": "1", "origem": side, "destino": side, "classificacao_validada": "RELACIONADO"}, {"id": "1", "origem": side, "destino": side, "classificacao_validada": "RELACIONADO"}, {"id": "2", "origem": side, "destino": {**side, "texto": " "}, "classificacao_validada": "RELACIONADO"}, {"id": "3", "origem": side, "destino": side, "classificacao_validada": None}]
    path = tmp_path / "l.json"
    path.write_text(json.dumps(rows))
    good, bad = files.labels(spark, str(path))
    assert good.count() == 2 and sorted(map(tuple, bad.collect())) == [("1", "id_repetido"), ("2", "lado_em_branco")]


def test_json_sink(spark, tmp_path):
    files.write_json(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
