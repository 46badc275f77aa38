"""Ids of any type, file order, whole vocabularies, exact restriction of
generation, and what the writers and jobs report."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiscope.functions.text import truncate_tokens
from lexiscope.operators import lm, ordering, retrieve, wordpiece
from lexiscope.plans import jobs
from lexiscope.plans.registry import BYTE, MODELS, Model, Tokenizer
from lexiscope.sources import io, testdata


def write_lines(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def test_files_to_metrics_with_string_ids(spark, tmp_path):
    topics = ["apple pie baking", "engine oil change", "violin string tuning", "desert cactus bloom"]
    write_lines(tmp_path / "corpus.jsonl", [{"_id": f"doc{i}", "title": f"t{i % 4}", "text": f"{topics[i % 4]} note {i}"}
                                            for i in range(8)])
    write_lines(tmp_path / "queries.jsonl", [{"_id": f"test{i}", "text": topics[i]} for i in range(4)])
    (tmp_path / "qrels.tsv").write_text("query-id\tcorpus-id\tscore\n" + "".join(
        f"test{i}\tdoc{d}\t1\n" for i in range(4) for d in (i, i + 4)))
    corpus = io.read_corpus_tolerant(spark, str(tmp_path / "corpus.jsonl")).withColumnRenamed("_id", "doc_id")
    queries = io.read_queries_strict(spark, str(tmp_path / "queries.jsonl")).withColumnRenamed("_id", "query_id")
    qrels = io.read_qrels(spark, str(tmp_path / "qrels.tsv"))
    kept, aligned, rel = jobs.prepare(corpus, queries, qrels, 10)
    res = jobs.evaluate(kept, aligned, rel, [MODELS["byte-hashed"]]).collect()[0]
    assert res["num_queries"] == 2 and res["mrr"] == 1.0 and res["recall_at_5"] == 1.0

    model, path = MODELS["byte-hashed"], str(tmp_path / "vectors")
    assert jobs.embed_all_models(kept, [model], path) == {"byte-hashed": True}
    hits = jobs.search_table(spark, path, model, aligned, 2, idf=jobs.fit_idfs(kept, [model])["byte-hashed"])
    got = {(r["query_id"], r["doc_id"]) for r in hits.collect()}
    assert got == {(f"test{i}", f"doc{d}") for i in range(4) for d in (i, i + 4)}


def test_failed_models_are_named(spark, tmp_path):
    docs = spark.createDataFrame([("a", "t", "x y")], "doc_id string, title string, text string")
    bad = Model("bad", Tokenizer("bad", 1, lambda c: F.raise_error(F.lit("no such model")).cast("array<int>")))
    with pytest.raises(ExceptionGroup) as e:
        jobs.embed_all_models(docs, [bad, MODELS["byte-hashed"]], str(tmp_path / "v"))
    assert [x.__notes__ for x in e.value.exceptions] == [["model bad"]]
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1


def test_append_checks_ids_of_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    v = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, embedding array<double>")
    io.embedding_table_write(v, path, "m", 1)
    io.embedding_table_write(v.withColumn("id", F.concat("id", F.lit("2"))), path, "m", 1, mode="append")
    io.embedding_table_write(v, path, "other", 1, mode="append")
    with pytest.raises(ValueError):
        io.embedding_table_write(v.where("id = 'a'"), path, "m", 1, mode="append")


def test_rows_follow_the_files(spark, tmp_path):
    write_lines(tmp_path / "a.jsonl", [{"_id": "a0"}])
    write_lines(tmp_path / "b.jsonl", [{"_id": f"b{i}"} for i in range(5)])
    write_lines(tmp_path / "c.jsonl", [{"_id": f"c{i}", "title": "x" * 50} for i in range(400)])
    want = ["a0", *[f"b{i}" for i in range(5)], *[f"c{i}" for i in range(400)]]
    got = io.read_corpus_tolerant(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r["_id"] for r in got] == want
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = io.read_corpus_tolerant(spark, str(tmp_path))
        assert [r["_id"] for r in df.orderBy("pos").collect()] == want
        assert [r["_id"] for r in ordering.first_rows(df, 9, ["pos"]).orderBy("pos").collect()] == want[:9]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_white_lines_are_no_documents(spark, tmp_path):
    write_lines(tmp_path / "d.jsonl", ["\t", '{"title":"a","text":"b"}', " ", '{"title":"c","text":"d"}'])
    read = lambda n: [r["text"] for r in io.read_docs_capped(spark, str(tmp_path / "d.jsonl"), n).orderBy("pos").collect()]
    assert read(None) == ["a b", "c d"] and read(2) == ["a b"] and read(1) == []


def test_splits_and_first_rows(spark):
    df = spark.createDataFrame([(i * 7 % 25, f"k{i:02}") for i in range(25)], "pos long, id string")
    parts = {r["split"]: r["count"] for r in ordering.split_80_10_10(df, "id").groupBy("split").count().collect()}
    assert parts == {"train": 20, "validation": 2, "test": 3}
    half = ordering.split_by_position(df, 0.5).collect()
    assert {r["pos"] for r in half if r["split"] == "validation"} == set(range(12))
    assert sorted(r["pos"] for r in ordering.first_rows(df, 3, ["pos"]).collect()) == [0, 1, 2]
    assert ordering.first_rows(df, 99, ["pos"]).count() == 25
    empty = ordering.split_80_10_10(df.limit(0), "id")
    assert empty.count() == 0 and "split" in empty.columns
    plan = ordering.split_80_10_10(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("limit", [1 << 28, 1])
def test_search_by_string_ids(spark, monkeypatch, limit):
    monkeypatch.setattr(retrieve, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 5)).round(1)
    vectors[7] = vectors[3]
    rows = [(f"d{i}", v.tolist(), i % 3) for i, v in enumerate(vectors)]
    docs = spark.createDataFrame(rows + [("null", None, 0)], "doc_id string, embedding array<double>, tag int")
    queries = docs.selectExpr("doc_id AS query_id", "embedding")
    got = retrieve.topk_cosine(queries, docs, 4, carry=["tag"], exclude_self=True, max_broadcast_bytes=limit)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    dist = np.round(1 - unit @ unit.T, 9) + 0.0
    want = {f"d{i}": sorted((dist[i, j], f"d{j}") for j in range(40) if j != i)[:4] for i in range(40)}
    seen = {}
    for r in got.orderBy("query_id", "rank").collect():
        seen.setdefault(r["query_id"], []).append((r["doc_id"], r["tag"]))
    assert seen == {q: [(d, int(d[1:]) % 3) for _, d in hits] for q, hits in want.items()}


def test_widths_must_agree(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    d = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0])], "doc_id long, embedding array<double>").coalesce(1)
    with pytest.raises(Exception, match="different widths"):
        retrieve.topk_cosine(q, d, 1).collect()


def test_word_vocabulary_keeps_every_character(spark):
    text = "".join(chr(0x4E00 + i) for i in range(40)) + " hello world hello"
    df = spark.createDataFrame([(text,)], "text string")
    with pytest.raises(ValueError, match="cannot hold"):
        wordpiece.build_vocab(df, "text", 30)
    vocab = wordpiece.build_vocab(df, "text", 4 + 2 * 47 + 1)
    assert vocab[-1] == "hello" and len(vocab) == 99 and sum(v.startswith("##") for v in vocab) == 47
    ids = df.select(wordpiece.wordpiece_tokens("text", vocab, special=False).alias("t")).first()["t"]
    assert vocab.index("[UNK]") not in ids
    long = spark.createDataFrame([("hello" * 30,)], "text string")
    assert len(long.select(wordpiece.wordpiece_tokens("text", vocab, special=False).alias("t")).first()["t"]) == 1 + 29 * 5
    assert len(long.select(wordpiece.wordpiece_tokens("text", vocab, False, max_word_chars=100).alias("t")).first()["t"]) == 1
    assert df.select(wordpiece.basic_words(F.lit("a b　c")).alias("w")).first()["w"] == ["a", "b", "c"]


def test_generation_restricts_exactly(spark):
    counts = spark.createDataFrame([(0, 1, 5), (1, 2, 3)], "ctx int, tok int, cnt long")
    order, sums = lm.next_token_table(counts, 6, top_k=2)
    assert order.shape == (6, 2) and order[0].tolist() == [1, 0] and order[5].tolist() == [0, 1]
    assert np.allclose(sums[:, -1], 1)
    seeds = spark.createDataFrame([(f"s{i}", [0]) for i in range(40)] + [("none", None)], "doc_id string, tokens array<int>")
    gen = {r["doc_id"]: r["generated"] for r in lm.lm_generate_batch(seeds, counts, 6, length=9, top_k=2).collect()}
    assert all(len(g) == 9 for g in gen.values())
    assert {t for g in gen.values() for t in g} <= {0, 1, 2}
    again = lm.lm_generate_batch(seeds.repartition(5), counts, 6, length=9, top_k=2).collect()
    assert {r["doc_id"]: r["generated"] for r in again} == gen
    kept = lm.lm_generate_batch(spark.createDataFrame([(1, [0] * 12)], "doc_id long, tokens array<int>"), counts, 6, length=9)
    assert len(kept.first()["generated"]) == 12
    with pytest.raises(ValueError, match="too large"):
        lm.next_token_table(counts, 10_000)


def test_probabilities_leave_the_unseen_their_share(spark):
    counts = spark.createDataFrame([(0, 1, 5), (0, 2, 1), (1, 2, 3)], "ctx int, tok int, cnt long")
    rows = lm.ngram_prob(counts, 6, 0.1).collect()
    for ctx in (0, 1):
        own = [r for r in rows if r["ctx"] == ctx]
        assert sum(r["p"] for r in own) + (6 - len(own)) * own[0]["p_unseen"] == pytest.approx(1)


def test_truncation_keeps_the_end_mark(spark):
    df = spark.createDataFrame([("abcdefgh",)], "t string")
    cut = Tokenizer("b", 259, BYTE.column_fn, max_length=4, end_marks=1)
    assert df.select(cut.tokens(F.col("t")).alias("x")).first()["x"] == [100, 101, 102, 1]
    assert df.select(truncate_tokens(F.array(F.lit(1), F.lit(2)), 1).alias("x")).first()["x"] == [1]


@pytest.mark.parametrize("scan_bytes", [testdata.SCAN_BYTES, 300])
def test_judgments_by_brute_force(spark, scan_bytes):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5)]
    docs = [(f"d{i}", " ".join(rng.choice(words, 30))) for i in range(40)]
    items = [(f"q{i}", docs[i][1][3:3 + 4 * i]) for i in range(25)] + [("e", ""), ("n", None), ("x", "w1 w9 w1 w2 w3 w4")]
    got = testdata.qrels_by_containment(spark.createDataFrame(docs, "doc_id string, text string"),
                                        spark.createDataFrame(items, "query_id string, text string"), scan_bytes=scan_bytes)
    assert {tuple(r) for r in got.collect()} == {(q, d) for q, t in items if t for d, text in docs if t in text}
    assert got.count() == len({tuple(r) for r in got.collect()})


def test_models_with_their_own_vectorizer(spark, tmp_path):
    from lexiscope.plans.registry import WordVectors, external_model

    def make():
        return lambda texts: np.array([[t.count("a"), t.count("b"), 1.0] for t in texts], dtype=np.float32)

    corpus = spark.createDataFrame([(f"d{i}", "t", ["a a", "b b"][i % 2] + " c" * (i // 2), i) for i in range(6)],
                                   "doc_id string, title string, text string, pos int")
    queries = spark.createDataFrame([(f"q{i}", ["a a", "b b"][i % 2], i) for i in range(4)], "query_id string, text string, pos int")
    qrels = spark.createDataFrame([(f"q{i}", f"d{i % 2}") for i in range(4)], "query_id string, doc_id string")
    words = Model("words", MODELS["word2vec"].tokenizer, dim=8, vectorizer=WordVectors(8, min_count=1))
    models = [MODELS["byte-hashed"], words, external_model("own", make, 3)]
    res = {r["model"]: r for r in jobs.evaluate(corpus, queries, qrels, models).collect()}
    assert set(res) == {"byte-hashed", "words", "own"} and res["own"]["mrr"] == 1.0
    assert all(r["num_queries"] == 2 for r in res.values())
    assert jobs.embed_all_models(corpus, models, str(tmp_path / "v")) == {m.name: True for m in models}
    table = spark.read.parquet(str(tmp_path / "v"))
    assert {r["model"]: r["count"] for r in table.groupBy("model").count().collect()} == {m.name: 6 for m in models}
    assert {tuple(r) for r in table.where("model = 'own'").select("id", "text").collect()} == \
        {(r["doc_id"], r["text"]) for r in corpus.collect()}


def test_filtered_queries_come_back(spark, tmp_path):
    rows = [("q1", "a b", ["d1", "d2"]), ("q2", "c", None)]
    df = spark.createDataFrame(rows, "_id string, text string, `corpus-id` array<string>").coalesce(1)
    io.write_filtered_jsonl(df, str(tmp_path / "q"))
    got = io.read_filtered_queries(spark, str(tmp_path / "q")).orderBy("pos").drop("pos").collect()
    assert [tuple(r) for r in got] == rows


def test_one_query_and_vocabulary_dump(spark, tmp_path):
    from lexiscope.operators import bpe

    docs = spark.createDataFrame([("x", [1.0, 0.0]), ("w", [1.0, 0.0]), ("z", [0.6, 0.8]), ("o", [0.0, 0.0])],
                                 "doc_id string, embedding array<double>")
    got = retrieve.topk_single(docs, [1.0, 0.0], 3).collect()
    assert [r["doc_id"] for r in got] == ["w", "x", "z"] and got[2]["distance"] == pytest.approx(0.4)
    io.vocab_dump(bpe.bpe_vocab(spark, {(97, 98): 256}), str(tmp_path / "v"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert len(lines) == 257 and "97\t61" in lines and lines[-1] == "256\t6162"


def test_statistics_table_as_csv(spark, tmp_path):
    stats = spark.createDataFrame([("byte", 256, 80, 31.25, 10.0, 9.0, 1.5, 1.0, 1.0, 1.0)],
                                  "tokenizer string, vocab_size int, unique_tokens_used int, vocab_utilization double, "
                                  "avg_tokens_per_doc double, median_tokens_per_doc double, avg_tokens_per_word double, "
                                  "avg_tokens_per_char double, avg_tokens_per_byte double, compression_ratio double")
    io.token_stats_csv_write(stats, str(tmp_path / "s"))
    (row,) = spark.read.option("header", True).csv(str(tmp_path / "s")).collect()
    assert row["vocab_utilization"] == "31.25%" and row["avg_tokens_per_word"] == "1.500"
