"""Golden values of FIXTURES.md (hand-computed) for preparation, metrics,
windows, text counts and vectors."""

import math

import pytest
from pyspark.sql import functions as F

from lexiscope.functions import text as X
from lexiscope.functions import tokens as TK
from lexiscope.operators import lm, metrics, prep
from lexiscope.operators.ordering import split_80_10_10, split_by_position
from lexiscope.operators.retrieve import topk_cosine


@pytest.fixture()
def corpus(spark):
    rows = [("d0", "B", 0), ("d1", "A", 1), ("d2", "B", 2), ("d3", "C", 3), ("d4", None, 4),
            ("d5", "A", 5)]
    return spark.createDataFrame(rows, "doc_id string, title string, pos long")


def test_first_n_titles(corpus):
    got2 = sorted(r.doc_id for r in prep.first_n_titles(corpus, 2).collect())
    assert got2 == ["d0", "d1", "d2", "d5"]
    assert prep.first_n_titles(corpus, 4).count() == 6
    assert corpus.agg(F.count_distinct("title")).first()[0] == 3


def test_align_queries(spark, corpus):
    qrels = spark.createDataFrame(
        [("q0", "d0", 0), ("q0", "d2", 1), ("q1", "d1", 2), ("q1", "d3", 3), ("q2", "d5", 4),
         ("q2", "d5", 5)], "query_id string, doc_id string, pos long")
    queries = spark.createDataFrame([("q0",), ("q1",), ("q2",), ("q3",)], "query_id string")
    kept = prep.first_n_titles(corpus, 2)
    aligned = prep.align_queries(queries, qrels, kept)
    assert sorted(r.query_id for r in aligned.collect()) == ["q0", "q2"]
    lists = {r.query_id: r.corpus_ids for r in
             prep.queries_with_qrels(aligned, qrels, qrel_pos="pos").collect()}
    assert lists == {"q0": ["d0", "d2"], "q2": ["d5", "d5"]}


def _score(spark, retrieved, relevant, ks=(1, 5, 10)):
    ranked = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(retrieved)],
                                   "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", d) for d in relevant] or [("x", "x")],
                                  "query_id string, doc_id string")
    flagged = metrics.match_relevant(ranked, qrels)
    pq = metrics.per_query_metrics(flagged, metrics.relevant_counts(qrels),
                                   spark.createDataFrame([("q",)], "query_id string"), ks)
    return pq.first()


def test_metric_goldens(spark):
    r = _score(spark, ["doc0", "doc5", "doc99", "doc1", "doc42"], ["doc0", "doc1"])
    assert r.recall_at_5 == 1.0 and r.precision_at_5 == 0.4 and r.rr == 1.0
    assert r.recall_at_1 == 0.5 and r.precision_at_1 == 1.0 and r.precision_at_10 == 0.2
    none = _score(spark, ["a", "b"], [])
    assert (none.rr, none.recall_at_5, none.precision_at_5) == (0.0, 0.0, 0.0)
    dup = _score(spark, ["d5"], ["d5", "d5"])
    assert dup.n_relevant == 1 and dup.recall_at_1 == 1.0


def test_mrr_average(spark):
    ranked = spark.createDataFrame([("a", "x", 1), ("b", "y", 3), ("c", "z", 1)],
                                   "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "w")], "query_id string, doc_id string")
    pq = metrics.per_query_metrics(metrics.match_relevant(ranked, qrels),
                                   metrics.relevant_counts(qrels),
                                   spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string"))
    avg = metrics.average_metrics(pq).first()
    assert avg.num_queries == 3 and abs(avg.mrr - 0.4444444) < 1e-6


def test_split_by_position(spark):
    q = spark.createDataFrame([(i, i * 10) for i in range(5)], "query_id long, pos long")
    got = {r.query_id: r.split for r in split_by_position(q, 0.5, id_col="query_id").collect()}
    assert [got[i] for i in range(5)] == ["validation"] * 2 + ["test"] * 3


def test_split_80_10_10_sizes(spark):
    d = spark.createDataFrame([(i,) for i in range(25)], "doc_id long")
    c = {r.split: r["count"] for r in split_80_10_10(d, "doc_id").groupBy("split").count().collect()}
    assert c == {"train": 20, "validation": 2, "test": 3}


def test_windows(spark):
    for n, expected in [(0, 0), (4, 0), (5, 0), (6, 1), (7, 1), (8, 2), (9, 2)]:
        df = spark.createDataFrame([(list(range(n)),)], "tokens array<int>")
        assert lm.lm_windows(df, "tokens", 4, 2).count() == expected, n
    df = spark.createDataFrame([(list(range(8)),)], "tokens array<int>")
    w = [(r.start, r.input, r.target) for r in lm.lm_windows(df, "tokens", 4, 2).orderBy("start").collect()]
    assert w == [(0, [0, 1, 2, 3], [1, 2, 3, 4]), (2, [2, 3, 4, 5], [3, 4, 5, 6])]


TEXT_CASES = [
    ("The quick brown fox jumps over the lazy dog.", 9, 36, 44, 44, 46, 45),
    ("The year 2024 has 365 days and 12 months.", 9, 33, 41, 41, 43, 42),
    ("iPhone, JavaScript, and HTML5 are popular.", 6, 37, 42, 42, 44, 43),
    ("Hello! How are you? I'm fine, thanks.", 7, 31, 37, 37, 39, 38),
    ("Café, naïve, résumé, 日本語", 4, 21, 24, 34, 26, 35),
    ("def hello_world(): return 'Hello, World!'", 5, 37, 41, 41, 43, 42),
    ("https://www.example.com/path?query=value", 1, 40, 40, 40, 42, 41),
    ("user.name+tag@example.com", 1, 25, 25, 25, 27, 26),
]


def test_text_counts(spark):
    df = spark.createDataFrame([(t,) for t, *_ in TEXT_CASES], "t string")
    out = df.select(X.count_words("t"), X.count_characters("t"), F.length("t"), X.count_bytes("t"),
                    F.size(TK.char_tokens("t")), F.size(TK.byte_tokens("t"))).collect()
    assert [tuple(r) for r in out] == [tuple(c[1:]) for c in TEXT_CASES]


def test_clean_text(spark):
    df = spark.createDataFrame([("a  b\x1c\x1dc　d\x85e\t\r\nf ​g",), (None,),
                                ("",), ("  x  ",)], "t string")
    assert [r[0] for r in df.select(X.clean_text("t")).collect()] == \
        ["a b c d e f ​g", "", "", "x"]


def test_decoders(spark):
    df = spark.createDataFrame([("Café 日本 😀",)], "t string")
    r = df.select(TK.byte_decode(TK.byte_tokens("t")), TK.char_decode(TK.char_tokens("t"))).first()
    assert r[0] == "Café 日本 😀" and r[1] == "Café 日本 😀"


def test_vector_fixture(spark):
    docs = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (0, [1.0, 0.0]), (4, [0.0, 0.0])],
        "doc_id long, embedding array<float>")  # x=1, y=2, z=3, w=0 (copy of x), o=4
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = [(r.doc_id, r.distance) for r in topk_cosine(q, docs, 5).orderBy("rank").collect()]
    assert [g[0] for g in got] == [0, 1, 3, 2, 4]
    assert abs(got[2][1] - 0.4) < 1e-6 and got[3][1] == 1.0 and math.isnan(got[4][1])


def test_head_sample(spark):
    df = spark.createDataFrame([(p, str(p)) for p in (50, 10, 30, 20, 40)], "pos long, v string")
    assert sorted(r.pos for r in prep.head_sample(df, 3).collect()) == [10, 20, 30]
    assert prep.head_sample(df, None).count() == 5
