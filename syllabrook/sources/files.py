"""File sources and sinks: extracted documents as JSON, PDF files by content, results kept by content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HOURS = "struct<total:double,teorica:double,pratica:double,unidade:string>"
COURSE = f"struct<nome:string,tipo_ocorrencia:string,carga_horaria:{_HOURS},objetivos:struct<geral:string,especificos:string,nao_classificados:string>,competencias_habilidades:string,ementa:string,conteudo_programatico:string,bibliografia:struct<basica:string,complementar:string,nao_classificada:string>,paginas_origem:array<int>,observacoes:array<string>>"
DOCUMENT = f"struct<instituicao:string,curso:string,disciplinas:array<{COURSE}>,observacoes_documento:array<string>>"

#: Limits of a PDF file: bytes, and where its mark must stand.
MAX_BYTES, MARK_WITHIN = 100 * 1024 * 1024, 1024


def json_documents(spark: SparkSession, folder: str, pattern: str = "*.json", recursive: bool = False) -> DataFrame:
    """Extracted documents of a folder: (arquivo, documento, erro), one row a file.

    A byte order mark is tolerated, the document may stand bare or in an envelope ``resultado``. A file
    that is no JSON, or no document, comes out with its reason in ``erro`` and stops no other.
    """
    files = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).text(folder)
    rows = files.select(F.col("_metadata.file_path").alias("arquivo"), F.regexp_replace("value", "^\ufeff", "").alias("t"))
    both = F.from_json("t", f"struct<resultado:{DOCUMENT},disciplinas:array<{COURSE}>,instituicao:string,curso:string,observacoes_documento:array<string>>")
    rows = rows.withColumn("json_ok", F.try_parse_json("t").isNotNull()).withColumn("b", both)
    bare = F.struct(*(F.col(f"b.{c}") for c in ("instituicao", "curso", "disciplinas", "observacoes_documento")))
    document = F.coalesce(F.col("b.resultado"), F.when(F.col("b.disciplinas").isNotNull(), bare))
    error = F.when(~F.col("json_ok"), "json_invalido").when(document.isNull() | document["disciplinas"].isNull(), "sem_disciplinas")
    return rows.select("arquivo", F.when(error.isNull(), document).alias("documento"), error.alias("erro"))


def courses(documents: DataFrame) -> DataFrame:
    """One row for each course of each document, institution and course of study from the document."""
    d = F.col("documento")
    rows = documents.filter("documento is not null").select("arquivo", d["instituicao"].alias("instituicao"), d["curso"].alias("curso"), F.posexplode(d["disciplinas"]).alias("numero", "c"))
    return rows.select("arquivo", "instituicao", "curso", (F.col("numero") + 1).alias("numero"), "c.*").filter(F.trim("nome") != "")


def pdf_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """PDF files with size, content hash and what speaks against them: (arquivo, bytes, sha256, recusa).

    Two names that differ in case alone would overwrite each other's results, so both are refused (S26).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    mark = F.locate("255044462D", F.hex(F.substring("content", 1, MARK_WITHIN)))
    stem = F.lower(F.regexp_extract("path", r"[^/]+$", 0))
    rows = files.select(F.col("path").alias("arquivo"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), (mark % 2 == 1).alias("_pdf"), stem.alias("_stem"))
    twice = rows.groupBy("_stem").agg(F.count("*").alias("_n"))
    refusal = F.when(F.col("bytes") > MAX_BYTES, "grande_demais").when(~F.col("_pdf"), "nao_e_pdf").when(F.col("_n") > 1, "nome_repetido")
    return rows.join(twice, "_stem").select("arquivo", "bytes", "sha256", refusal.alias("recusa"))


def result_key(content_hash: Column, model: str, version: int, block: Column | None = None) -> Column:
    """Key under which a result is kept: content, perhaps pages of a block, model and version."""
    parts = [content_hash, *([block] if block is not None else []), F.lit(model), F.lit(f"v{version}")]
    return F.concat_ws("__", *parts)


def misses(inputs: DataFrame, kept: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Inputs without a kept result; all of them with ``force`` (S13). Process these, then add them to the kept ones."""
    return inputs if force else inputs.join(kept.select(key).distinct(), key, "left_anti")


def write_json(rows: DataFrame, folder: str) -> None:
    """Write rows as JSON lines; readers see the folder only when the job is committed."""
    rows.write.mode("overwrite").json(folder)


def labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Validated labels of a JSON list and what is wrong with the file: (labels, problems(id, problema)).

    Labels without a validated class are skipped; repeated ids, unknown classes and blank sides are problems.
    """
    side = T.StructType([T.StructField(c, T.StringType()) for c in ("arquivo", "disciplina", "secao", "texto")])
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("area", T.StringType()), T.StructField("origem", side), T.StructField("destino", side), T.StructField("classificacao_validada", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", True).json(path).filter(F.col("classificacao_validada").isNotNull())
    blank = F.lit(False)
    for s in ("origem", "destino"):
        for c in ("arquivo", "disciplina", "secao", "texto"):
            blank = blank | (F.coalesce(F.trim(f"{s}.{c}"), F.lit("")) == "")
    repeated = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("id_repetido").alias("problema"))
    return rows.filter(~blank), rows.filter(blank).select("id", F.lit("lado_em_branco").alias("problema")).unionByName(repeated)
