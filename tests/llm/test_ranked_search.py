"""Ranked search against scores of all documents, and its bounds."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from lexiscope.llm import ranked_search
from lexiscope.llm.ranked_search import Queries, Tops, count_terms, fold_sketches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def every_score(docs, items, top=50):
    """(item_id, rank, doc_id, score) by definition; None ids last."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for doc, c in counts:
            m = 100 - 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, d[3], -d[0]) for k, d in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def texts(n, seed=1, words=60, vocabulary=400):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, vocabulary + 1)
    return [" ".join(f"w{x}" for x in rng.choice(vocabulary, rng.integers(1, words), p=p / p.sum())) for _ in range(n)]


@pytest.mark.parametrize("query_bytes", [1 << 20, 900])
def test_tops_of_many_documents(spark, query_bytes):
    docs = [(i % 900, t) for i, t in enumerate(texts(1000))]
    items = [(i, t) for i, t in enumerate(texts(20, seed=2, words=12))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = ranked_search.ranked_search(d, spark.createDataFrame(items, "item_id long, text string"), top=7, query_bytes=query_bytes)
    assert sorted(map(tuple, found.collect()), key=repr) == every_score(docs, items, 7)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,;"), (4, "ALPHA beta Ünder_x"), (4, "ALPHA beta Ünder_x"), (None, "alpha beta ünder"), (5, "alpha " * 70_000),
            (6, "beta " * 300 + "alpha"), (-7, "gamma 12a"), (8, "alpha")]
    items = [("a", "Alpha, BETA!"), ("a", "Alpha, BETA!"), ("b", None), ("c", ""), ("d", "nowhere"), (None, "gamma alpha alpha"), ("e", "x Ünder"),
             ("a", "gamma")]
    d = spark.createDataFrame([(*r, 1, "x", 2.0) for r in docs], "doc_id long, text string, n int, score string, `a.b` double").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id string, text string, doc_id int")
    assert sorted(map(tuple, ranked_search.ranked_search(d, q).collect()), key=repr) == every_score(docs, items)
    assert ranked_search.ranked_search(d.where("doc_id = 99"), q).collect() == []
    assert ranked_search.ranked_search(d, q.where("item_id = 'z'")).collect() == []
    wordless = d.where("doc_id in (1, 2, 3)")
    assert ranked_search.ranked_search(wordless, q).collect() == []


def sketched(docs):
    raw = [t.encode() for t in docs]
    n, entries, hashes, times = count_terms(np.cumsum([0] + [len(r) for r in raw]), np.frombuffer(b"".join(raw), np.uint8))
    cut = [(hashes[a:b].astype("<u8").tobytes(), times[a:b].astype("<u4").tobytes()) for a, b in zip(entries[:-1], entries[1:], strict=True)]
    return n, fold_sketches(entries, hashes, times), [c[0] for c in cut], [c[1] for c in cut]


def test_bounds_hold_and_spare_documents():
    docs = texts(3000, words=80, vocabulary=5000) + ["w1 " * 400]
    asked = texts(15, seed=9, words=20, vocabulary=5000)
    n, sketches, held, times = sketched(docs)
    queries = Queries(asked)
    df = Counter(t for d in docs for t in set(d.split()))
    place = {t: i for t in {w for q in asked for w in q.split()} for i in [int(np.searchsorted(queries.terms, Queries([t]).terms[0]))]}
    queries.weigh(len(docs), int(n.sum()), {i: df[t] for t, i in place.items()})
    bounds = queries.bounds(sketches, n)
    tops = Tops(len(asked), 10)
    tops.search(queries, np.arange(len(docs)), np.zeros(len(docs), np.int64), n, sketches, held, times)
    scores = {(i, d): s for i, _, d, s in every_score(list(enumerate(docs)), list(enumerate(asked)), len(docs))}
    assert all(bounds[d, i] >= s for (i, d), s in scores.items())
    for i, kept in enumerate(tops.kept):
        best = sorted(((-s, d) for (j, d), s in scores.items() if j == i))[:10]
        assert [(-int(s), int(d)) for s, _, d in kept] == best
    assert tops.rescored < 0.5 * len(docs) * len(asked)
