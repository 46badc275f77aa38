"""Jobs end to end on the smallest given tables."""

import os

from pyspark.sql import functions as F

from conftest import SF001
from lexiscope.functions.tokens import byte_tokens, char_tokens
from lexiscope.operators import tokstats
from lexiscope.plans import jobs
from lexiscope.plans.registry import MODELS
from lexiscope.sources.testdata import corpus
from lexiscope.streaming.embed_stream import embed_append_stream


def test_special_case_matrix(spark):
    m = tokstats.special_case_matrix(spark, {"char": lambda c: char_tokens(c),
                                             "byte": lambda c: byte_tokens(c)})
    rows = m.collect()
    assert [r.char for r in rows] == [46, 43, 44, 39, 26, 43, 42, 27]
    assert [r.byte for r in rows] == [45, 42, 43, 38, 35, 42, 41, 26]
    assert rows[5].text == "def hello_world(): return 'Hello, World!..."


def test_embed_all_models_and_stream(spark, tmp_path):
    docs = corpus(spark, SF001)
    out = str(tmp_path / "emb")
    done = jobs.embed_all_models(docs, [MODELS["byte-hashed"], MODELS["char-hashed"]], out)
    assert done == {"byte-hashed": True, "char-hashed": True}
    t = spark.read.parquet(out)
    assert t.where(F.col("model") == "byte-hashed").count() == docs.count()
    assert t.select(F.size("embedding")).distinct().first()[0] == 256
    # stream the same documents as new files and append them
    src = str(tmp_path / "incoming")
    docs.select("doc_id", "title", "text").write.parquet(src)
    m = MODELS["byte-hashed"]
    _, idf = jobs.embed_corpus(docs, m)
    q = embed_append_stream(spark, src, docs.select("doc_id", "title", "text").schema, m, idf,
                            str(tmp_path / "stream_out"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    s = spark.read.parquet(str(tmp_path / "stream_out"))
    assert s.count() == docs.count()
    batch, _ = jobs.embed_corpus(docs, m)
    a = {r.doc_id: r.embedding for r in batch.collect()}
    for r in s.limit(20).collect():
        assert max(abs(x - y) for x, y in zip(r.embedding, a[r.id])) < 1e-6


def test_evaluations_take_all_titles(spark, tmp_path):
    from lexiscope.plans.queries import _prepared

    rows = [(i, f"text number {i} about things that nobody else says {i * i}", "en", f"source {i}", 1) for i in range(3001)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "number 3000 about things that nobody else says"), (2, "number 7 about things that nobody else says")],
                          "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    _, kept, _, _, aligned = _prepared(spark, str(tmp_path), None)
    assert kept.count() == 3001 and sorted(r["query_id"] for r in aligned.collect()) == [1, 2]
    _, kept, _, _, aligned = _prepared(spark, str(tmp_path), 3000)
    assert kept.count() == 3000 and [r["query_id"] for r in aligned.collect()] == [2]
