"""Appending to the embedding table: repeated ids, failed batches, idf."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from lexiscope.plans import jobs
from lexiscope.plans.registry import MODELS
from lexiscope.sources.testdata import corpus
from lexiscope.streaming import embed_stream
from lexiscope.streaming.embed_stream import append_batch, embed_append_stream

MODEL = MODELS["byte-hashed"]


@pytest.fixture(scope="module")
def docs(spark):
    return corpus(spark, SF001).select("doc_id", "title", "text").where("doc_id < 90").cache()


def vectors(spark, path):
    return {r["id"]: r["embedding"] for r in spark.read.parquet(path).collect()}


def test_restart_in_mid_batch_and_repeated_ids(spark, docs, tmp_path, monkeypatch):
    src, out, freq, ckpt = (str(tmp_path / x) for x in ("in", "out", "freq", "ckpt"))
    docs.where("doc_id < 40").write.parquet(src)
    schema = docs.schema
    start = lambda: embed_append_stream(spark, src, schema, MODEL, None, out, ckpt, frequency_path=freq)
    start().awaitTermination()
    # a file that repeats ids of the table and of itself, rows without id; the job fails behind the frequencies
    again = docs.where("doc_id >= 20").unionByName(docs.where("doc_id between 60 and 70")) \
        .unionByName(spark.createDataFrame([(None, "t", "x")], schema))
    again.write.mode("append").parquet(src)
    real = embed_stream.hashed_vector

    def broken(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(embed_stream, "hashed_vector", broken)
    query = start()
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    monkeypatch.setattr(embed_stream, "hashed_vector", real)
    start().awaitTermination()
    t = spark.read.parquet(out)
    assert t.count() == t.select("id").distinct().count() == docs.count()
    n, df = embed_stream.frequencies(spark, freq, MODEL.dim)
    _, idf = jobs.embed_corpus(docs, MODEL)
    assert n == docs.count() and np.allclose(idf, [np.log((n + 1) / (x + 1)) for x in df])
    late = vectors(spark, out)
    want = {r["doc_id"]: r["embedding"] for r in jobs.embed_corpus(docs, MODEL)[0].where("doc_id >= 40").collect()}
    assert all(np.allclose(late[i], v, atol=1e-6) for i, v in want.items())


def test_a_batch_done_twice_is_there_once(spark, docs, tmp_path):
    out, freq = str(tmp_path / "out"), str(tmp_path / "freq")
    for number, low in ((0, 0), (1, 30), (1, 30), (0, 0)):
        append_batch(docs.where(F.col("doc_id").between(low, low + 40)), number, MODEL, None, out, frequency_path=freq)
    ids = [r["id"] for r in spark.read.parquet(out).collect()]
    assert sorted(ids) == list(range(71))
    assert embed_stream.frequencies(spark, freq, MODEL.dim)[0] == 71


def test_models_with_their_own_vectorizer(spark, docs, tmp_path):
    model = MODELS["word2vec"]
    _, state = jobs.embed_corpus(docs, model)
    out = str(tmp_path / "out")
    append_batch(docs, 0, model, state, out)
    append_batch(docs, 1, MODEL, jobs.embed_corpus(docs, MODEL)[1], out)  # another model of the same table
    t = spark.read.parquet(out)
    assert {r["model"]: r["n"] for r in t.groupBy("model").agg(F.count("*").alias("n")).collect()} == {model.name: docs.count(), MODEL.name: docs.count()}
    want = {r["doc_id"]: r["embedding"] for r in jobs.embed_corpus(docs, model, idf=state)[0].collect()}
    got = {r["id"]: r["embedding"] for r in t.where(F.col("model") == model.name).collect()}
    assert all(np.allclose(got[i], v, atol=1e-6) for i, v in want.items())
