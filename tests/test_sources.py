"""Readers and writers against the fixtures of FIXTURES.md section 3."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lexiscope.sources import io


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_read_corpus_tolerant(spark, tmp_path):
    p = _write(tmp_path / "c.jsonl", "\n".join([
        '{"_id":"d1","title":"a","text":"x"}', "", "{bad", '{"title":"q"}',
        '{"_id":"","text":"z"}', '{"_id":"d2","title":null,"text":"y"}']) + "\n")
    ok, counts = io.read_corpus_tolerant(spark, str(p), with_counts=True)
    rows = io.embedding_content(ok).orderBy("pos").select("_id", "content").collect()
    assert [(r._id, r.content) for r in rows] == [("d1", "a: x"), ("d2", ": y")]
    c = counts.first()
    assert (c.malformed, c.missing_id, c.kept) == (1, 2, 2)


def test_read_queries_strict_fails_on_bad_json(spark, tmp_path):
    p = _write(tmp_path / "q.jsonl", '{"_id":"q1","text":"a"}\n{bad\n')
    with pytest.raises(Exception):
        io.read_queries_strict(spark, str(p)).collect()


def test_read_docs_capped_counts_blank_lines(spark, tmp_path):
    p = _write(tmp_path / "d.jsonl", '{"title":"t1","text":"a"}\n\n{"title":"t3","text":"c"}\n'
               '{"title":"t4","text":"d"}\n')
    got = [r.text for r in io.read_docs_capped(spark, str(p), 3).orderBy("pos").collect()]
    assert got == ["t1 a", "t3 c"]
    assert io.read_docs_capped(spark, str(p), None).count() == 3


def test_read_qrels(spark, tmp_path):
    p = _write(tmp_path / "q.tsv", "query-id\tcorpus-id\tscore\nq0\td0\t1\nq0\td2\t0\n")
    rows = io.read_qrels(spark, str(p)).orderBy("pos").collect()
    assert [(r.query_id, r.doc_id) for r in rows] == [("q0", "d0"), ("q0", "d2")]


def test_embedding_table_overwrite_keeps_other_models(spark, tmp_path):
    out = str(tmp_path / "emb")
    a = spark.createDataFrame([("1", "t", "x", [1.0, 0.0])], "id string, title string, text string, embedding array<double>")
    io.embedding_table_write(a, out, "m1", 2)
    io.embedding_table_write(a, out, "m2", 2)
    io.embedding_table_write(a.withColumn("id", F.lit("9")), out, "m1", 2)
    back = spark.read.parquet(out)
    assert sorted((r.model, r.id) for r in back.collect()) == [("m1", "9"), ("m2", "1")]
    assert back.schema["embedding"].dataType.simpleString() == "array<float>"
    bad = spark.createDataFrame([("1", "t", "x", [1.0])], a.schema)
    with pytest.raises(Exception):
        io.embedding_table_write(bad, out, "m3", 2)
    dup = a.union(a)
    with pytest.raises(ValueError):
        io.embedding_table_write(dup, out, "m4", 2)


def test_csv_sinks(spark, tmp_path):
    v = spark.createDataFrame([("1", "a\tb", "x  y", [0.1, 0.2])],
                              "id string, title string, text string, embedding array<float>")
    io.embedding_csv_write(v, str(tmp_path / "e"))
    lines = [l for f in sorted(os.listdir(tmp_path / "e")) if f.endswith(".csv")
             for l in open(tmp_path / "e" / f)]
    data = [l for l in lines if not l.startswith("id,")]
    assert len(data) == 1 and all(l == "id,title,text,embedding\n" for l in lines if l not in data)
    line = data[0]
    assert line.startswith("1,a b,x y,")
    assert json.loads(line.split(",", 3)[3].strip().strip('"')) == [0.10000000149011612, 0.20000000298023224]


def test_write_filtered_jsonl_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("d1", None, "x", 0)], "_id string, title string, text string, pos long")
    io.write_filtered_jsonl(df, str(tmp_path / "o"))
    txt = "".join(open(tmp_path / "o" / f).read() for f in os.listdir(tmp_path / "o")
                  if f.endswith(".json"))
    assert json.loads(txt.strip()) == {"_id": "d1", "title": None, "text": "x"}


def _read_dir(path, suffix):
    return "".join(open(os.path.join(path, f), encoding="utf-8").read()
                   for f in sorted(os.listdir(path)) if f.endswith(suffix))


def test_dump_and_read_corpus_text(spark, tmp_path):
    df = spark.createDataFrame([(2, "c\nd"), (0, "a"), (1, "b b")], "pos long, text string")
    io.dump_corpus_text(df, str(tmp_path / "t"), n_docs=2)
    assert sorted(_read_dir(tmp_path / "t", ".txt").splitlines()) == ["a", "b b"]
    back = io.read_corpus_text(spark, str(tmp_path / "t"))
    assert sorted(r.text for r in back.collect()) == ["a\n", "b b\n"]


def test_metrics_and_stats_csv(spark, tmp_path):
    m = spark.createDataFrame([("m", 4, 0.35385, 1.0, 0.5, 0.25, 0.125, 0.2, 0.1, 0.05, 0.01)],
                              "model string, num_queries long, mrr double, recall_at_1 double, "
                              "recall_at_5 double, recall_at_10 double, recall_at_15 double, "
                              "precision_at_1 double, precision_at_5 double, "
                              "precision_at_10 double, precision_at_15 double")
    io.metrics_csv_write(m, str(tmp_path / "m"))
    lines = _read_dir(tmp_path / "m", ".csv").splitlines()
    assert lines[0].startswith("model,num_queries,mrr,recall@1")
    assert lines[1].startswith("m,4,0.3539,1.0000")


def test_vocab_dump(spark, tmp_path):
    v = spark.createDataFrame([(257, bytearray(b"ab")), (97, bytearray(b"a"))],
                              "token_id int, bytes binary")
    io.vocab_dump(v, str(tmp_path / "v"))
    assert _read_dir(tmp_path / "v", ".csv").splitlines() == ["97\t61", "257\t6162"]


def test_embed_external(spark):
    import numpy as np

    from lexiscope.operators.vectorize import embed_external

    def make_fn():
        def predict(texts):
            return np.stack([[len(t), t.count("a"), 1.0] for t in texts]).astype(np.float32)
        return predict

    df = spark.createDataFrame([("1", "banana"), ("2", "kiwi")], "id string, text string")
    got = {r.id: r.embedding for r in embed_external(df, "text", make_fn, 3).collect()}
    assert got == {"1": [6.0, 3.0, 1.0], "2": [4.0, 0.0, 1.0]}
    with pytest.raises(Exception):
        embed_external(df, "text", make_fn, 4).collect()
