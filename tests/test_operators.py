"""Edge cases of the core's operators on small rows."""

import math
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from syllabrook.functions import text as T
from syllabrook.operators import lexical, lines, matching, records, relational, stateful
from syllabrook.operators.components import components


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def test_absence_phrases(spark):
    for t in ("não há", "Não possui.", "Bibliografia: não possui", "Sem bibliografia.", "-"):
        assert one(spark, t, T.content_text("x")) is None
    for t in ("inexistente", "n/a", "--", "não consta", "Cálculo"):
        assert one(spark, t, T.content_text("x")) == t


def test_letters_without_marks(spark):
    composed = "ÁÀÂÃÄÇÉÊÍÓÔÕÚÜÑŠŽőů"
    for t in (composed, unicodedata.normalize("NFD", composed)):
        want = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
        assert one(spark, t, T.unaccent("x")) == want
    assert one(spark, "Straße", T.unaccent("x")) == "straße"


@pytest.mark.parametrize("t, want", [("", None), ("0h", 0.0), ("20h", 20.0), ("20 40", None), ("67,5 horas", 67.5), (None, None)])
def test_quantities(spark, t, want):
    assert one(spark, t, T.quantity("x")) == want


@pytest.mark.parametrize("t, want", [("1. Ementa:", ("ementa", "")), ("OBJETIVO GERAL", ("objetivos.geral", "")), ("Metodologia", ("_parar", "")), ("Ementa: Limites.", ("ementa", "Limites.")), ("EEMMEENNTTAA", ("ementa", "")), ("Limites", None), ("", None)])
def test_section_headers(spark, t, want):
    got = one(spark, t, T.section_header(F.col("x")))
    assert (tuple(got) if got else None) == want


def test_course_names(spark):
    assert one(spark, "Álgebra Linear Carga Horária: 60", T.course_name("x")) == "Álgebra Linear"
    assert one(spark, "Álgebra Linear", T.is_course_name(F.col("x"))) and not one(spark, "Ementa", T.is_course_name(F.col("x")))


@pytest.mark.parametrize("n, want", [(40, [(0, 25), (20, 40)]), (25, [(0, 25)]), (45, [(0, 25), (20, 45)]), (0, [])])
def test_block_ranges(spark, n, want):
    assert [tuple(b) for b in one(spark, n, records.block_ranges(F.col("x"), 25, 5), "int")] == want


@pytest.mark.parametrize("t, want", [("529.982.247-25", True), ("52998224725", True), ("111.111.111-11", False), ("123.456.789-00", False), ("123", False), ("", False), ("abc", False), ("529.982.247-26", False), (None, False)])
def test_cpf(spark, t, want):
    assert one(spark, t, records.valid_cpf(F.col("x"))) is want


def test_normalized_minutes(spark):
    rows = [(80.0, "HORA_AULA", None, 66.67, None), (80.0, "HORA_AULA", None, 66.67, 50.0), (None, None, None, None, 50.0), (60.0, "HORA", None, None, None), (4.0, "CREDITO", None, None, None)]
    df = spark.createDataFrame(rows, "a double, u string, b double, c double, m double")
    got = [r[0] for r in df.select(records.normalized_minutes(*(F.col(c) for c in "aubcm"))).collect()]
    assert got[0] == pytest.approx(4000.2) and got[1:] == [None, None, 3600.0, None]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), ([], []), (None, [1.0]), ([3.0, 4.0], [-3.0, -4.0]), ([float("nan"), 1.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r[0] for r in df.select(matching.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, None, None, None, None, -1.0, None]


def test_grams_of_short_words(spark):
    def g(t):
        return one(spark, t, matching.grams(F.col("x")))

    assert g("a") == [" a "] and sorted(g("de")) == [" de", " de ", "de "]
    assert len([x for x in g("casa") if len(x) == 3]) == 4 and len([x for x in g("casa") if len(x) == 5]) == 2
    assert g("") == []


def test_lexical_similarity(spark):
    a = spark.createDataFrame([(1, 1, "redes de computadores"), (1, 2, "culinária")], "par int, id int, texto string")
    b = spark.createDataFrame([(1, 7, "Redes de Computadores"), (1, 8, "")], "par int, id int, texto string")
    out = {(r.destino, r.origem): r.lexical for r in matching.lexical_pairs(a, b).collect()}
    assert out[(1, 7)] == pytest.approx(1.0) and (1, 8) not in out


def test_lexical_pairs_in_blocks_agree_with_sums_over_grams(spark, monkeypatch):
    texts = ["redes de computadores", "Redes  e\tprotocolos", "", " a ", "ção é", "algoritmos em redes", "日本 日本語", None]
    a = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "redes"), (None, 0, "redes")], "par int, id int, texto string")
    b = spark.createDataFrame([(1, 5 + i, t) for i, t in enumerate(reversed(texts))] + [(3, 0, "redes"), (None, 0, "redes")], "par int, id int, texto string")
    docs = {}
    for alvo, side in ((True, a), (False, b)):
        for r in side.filter("par = 1").withColumn("g", matching.grams(F.col("texto"))).collect():
            docs[alvo, r.id] = Counter(r.g or [])
    df = Counter(g for d in docs.values() for g in d)
    w = {k: {g: c * (math.log((1 + len(docs)) / (1 + df[g])) + 1) for g, c in d.items()} for k, d in docs.items()}
    norm = {k: math.sqrt(sum(x * x for x in d.values())) for k, d in w.items()}
    want = {(1, i, j): sum(x * w[False, j].get(g, 0) for g, x in w[True, i].items()) / norm[True, i] / norm[False, j] for s, i in w if s for t, j in w if not t and w[True, i].keys() & w[False, j].keys()}
    for products in (1 << 20, 10):
        monkeypatch.setattr(matching, "PRODUCTS", products)
        got = {(r.par, r.destino, r.origem): r.lexical for r in matching.lexical_pairs(a, b).collect()}
        assert got == pytest.approx(want) and got.keys() == want.keys()


def test_grams_in_parts_give_the_same_sums(monkeypatch):
    rows = {"par": [1] * 4 + [2] * 2, "block": [0] * 6, "kind": [0, 0, 1, 2, 0, 1], "id": [1, 1, 2, 3, 1, 1], "plain": [" redes ", " rede a ", " a redes ", " redes ", " ", " a "]}
    batches = pa.table(rows).to_batches(max_chunksize=1)
    whole = pa.Table.from_batches(lexical.cosines(iter(batches))).to_pylist()
    for name in ("LETTERS", "SORTED", "PRODUCTS", "_WIDE"):
        monkeypatch.setattr(lexical, name, 5)
    parts = pa.Table.from_batches(lexical.cosines(iter(batches))).to_pylist()
    assert [(r["par"], r["destino"], r["origem"]) for r in parts] == [(1, 1, 2)] and parts[0]["lexical"] == pytest.approx(whole[0]["lexical"])


def test_lexical_pairs_shuffle_texts_not_grams(spark):
    a = spark.createDataFrame([(1, 1, "redes")], "par int, id int, texto string")
    plan = matching.lexical_pairs(a, a)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Join" not in plan


def test_triage_boundaries(spark):
    rows = [("comparado", 20, 17, True), ("comparado", 20, 17, None), ("comparado", 10, 3, True), ("comparado", 10, 10, False), ("comparado", 10, 2, None), ("origem_sem_conteudo", 0, 0, True), ("comparado", 0, 0, True)]
    df = spark.createDataFrame(rows, "s string, t long, c long, w boolean")
    got = [r[0] for r in df.select(matching.triage(F.col("s"), F.col("t"), F.col("c"), F.col("w"), matching.TriagePolicy())).collect()]
    assert got == ["APTO_A_DISPENSA", "TALVEZ_APTO", "TALVEZ_APTO", "NAO_APTO", "NAO_APTO", "TALVEZ_APTO", "TALVEZ_APTO"]
    with pytest.raises(ValueError):
        matching.TriagePolicy(apt=0.2)


def test_lockout(spark):
    minutes = [(0, "f"), (1, "f"), (2, "f"), (3, "f"), (4, "f"), (10, "f"), (20, "f"), (21, "s"), (22, "f"), (37, "f")]
    df = spark.createDataFrame([(1, i, m, k) for i, (m, k) in enumerate(minutes)], "u int, i int, m int, k string").withColumn("ts", F.timestamp_seconds(F.col("m") * 60))
    out = stateful.failure_windows(df, "u", "ts", F.col("k") == "f", "i", stateful.FailurePolicy()).first()
    assert (out.gravadas, out.bloqueios, out.ignoradas) == (8, 1, 1)


def test_sections_end_and_go_on(spark):
    text = "Ementa\nLimites\nMetodologia\nAulas\nBibliografia básica\nLivro"
    rows = lines.segments(lines.headed(lines.lines_of(spark.createDataFrame([(1, text), (2, None)], "k int, t string"), "k", "t")), "k", F.lit(False))
    got = {r.texto: r.secao for r in lines.active_section(rows, "k").filter("not cabecalho and texto <> ''").collect()}
    assert got == {"Limites": "ementa", "Aulas": None, "Livro": "bibliografia.basica"}


def test_starts_apart(spark):
    df = spark.createDataFrame([([(0, "A b c"), (5, "D e f"), (20, "a  B c"), (40, "G")],)], "s array<struct<indice:int,nome:string>>")
    assert [r[0] for r in df.select(F.inline(lines.kept_starts(F.col("s"), 18))).collect()] == [0, 40]


def test_merge_and_outcomes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, records.merged_import(old, new, "k", ["v"]).collect())) == [(1, "a", "mantido"), (2, "b", "atualizado"), (3, "c", "inserido")]
    assert dict(records.merged_import(old, new, "k", ["v"], True).select("k", "v").collect())[2] is None
    stopped = spark.createDataFrame([(1, "x"), (4, "d")], "k int, v string")
    assert sorted(map(tuple, records.registration(old, stopped, "k", ["v"]).collect())) == [(1, "divergente", False), (4, "inserir", False)]


def test_unknown_is_no_violation(spark):
    df = spark.createDataFrame([(1, None), (2, -1), (3, 5)], "k int, v int")
    assert [tuple(r) for r in relational.violations(df, "k", {"v": F.col("v") >= 0}).collect()] == [("2", "v")]


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b")
    out = components(edges, "a", "b").collect()
    assert len(out) == 301 and {r.root for r in out} == {0}
    assert components(edges.limit(0), "a", "b").count() == 0
