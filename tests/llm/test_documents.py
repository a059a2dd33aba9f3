import subprocess
import sys
from pathlib import Path

from syllabrook.llm import containers, queries

FOLDER = "/root/testdata/sf0.001"


def test_each_document_query_covers_all_texts(spark):
    named = queries.queries()
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").filter(r"text rlike '(?U)\\S'").select("doc_id").distinct().count()
    for name in ("p10_found", "p10_sentences", "p8_containers"):
        assert named[name](spark, FOLDER).select("doc_id").distinct().count() == documents
    assert named["p10_found"](spark, FOLDER).count() == named["p10_sentences"](spark, FOLDER).count()


def test_containers_hold_every_token_and_no_more_than_the_limit(spark):
    texts = [(i, " ".join(["a"] * n)) for i, n in enumerate([6, 6, 5, 5, 5, 5, 4, 4, 3, 3, 2, 2, 25, 1])] + [(99, None), (98, " \n")]
    out = containers.containers(spark.createDataFrame(texts, "id long, text string"), "id", "text", limit=10).collect()
    held: dict[int, int] = {}
    for r in out:
        assert len(r.texto.split()) == r.tokens
        held[r.recipiente] = held.get(r.recipiente, 0) + r.tokens
    assert sum(held.values()) == 76 and max(held.values()) <= 10
    assert len(held) == 8
    assert sorted(r.peca for r in out if r.id == 12) == [0, 1, 2]
    assert all(r.peca == 0 for r in out if r.id != 12)


def test_one_length_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(containers, "ROWS_PER_BUCKET", 10)
    texts = spark.range(100).selectExpr("id", "'a b c' as text")
    sizes = containers.containers(texts, "id", "text", limit=7).groupBy("recipiente").count().collect()
    assert sorted(r["count"] for r in sizes) == [2] * 50


def test_thai_blanks_end_sentences_and_the_search_goes_on():
    # in a process of its own: the search used to find the same blank for ever
    code = "from syllabrook.llm.sentences import Splitter; print(Splitter().ends('สวัสดี ครับ ผม'))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=30)
    assert out.stdout.strip() == "[6, 11, 14]"
