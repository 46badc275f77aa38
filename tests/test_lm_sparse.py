"""The sparse generator against the dense one and against its definition."""

import random

import numpy as np
import pytest

from lexiscope.operators import lm, lm_sparse


def tables(spark, v, seed):
    rnd = random.Random(seed)
    counts = {(rnd.randrange(v), rnd.randrange(v)): rnd.randint(1, 4) for _ in range(3 * v)}
    df = spark.createDataFrame([(a, b, n) for (a, b), n in counts.items()], "ctx int, tok int, cnt long")
    seeds = [(i, [rnd.randrange(v) for _ in range(rnd.randint(2, 6))]) for i in range(40)] + [(90, None), (91, [])]
    return df, spark.createDataFrame(seeds, "doc_id long, tokens array<int>").repartition(3)


def texts(df):
    return {r["doc_id"]: r["generated"] for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"top_k": 3, "new_tokens": 2}, {"temperature": 0.6, "top_k": 25, "seed": 7}])
def test_same_text_as_the_dense_form(spark, monkeypatch, options):
    monkeypatch.setattr(lm_sparse, "WAITING", 5)
    counts, seeds = tables(spark, 30, 1)
    options = {"length": 6, **options}
    assert texts(lm_sparse.lm_generate_sparse(seeds, counts, 30, **options)) == texts(lm.lm_generate_batch(seeds, counts, 30, **options))


def test_a_large_vocabulary(spark):
    counts, seeds = tables(spark, 49_000, 2)
    got = texts(lm.lm_generate_batch(seeds, counts, 49_000, new_tokens=2))
    before = {r["doc_id"]: r["tokens"] or [] for r in seeds.collect()}
    assert got.keys() == before.keys()
    assert all(got[k][:-2] == before[k] and len(got[k]) == len(before[k]) + 2 and max(got[k]) < 49_000 for k in got)
    assert texts(lm.lm_generate_batch(seeds, counts, 49_000, new_tokens=2)) == got


def test_every_unseen_token_can_be_drawn():
    rng = np.random.default_rng(1)
    context = lm_sparse.Context(np.array([7, 2, 3]), np.array([1.0, 5.0, 1.0]), 10, 1.0, None, 0.5)
    share = 1 / (7 + 5)
    want = {2: 5.5 * share, 3: 1.5 * share, 7: 1.5 * share} | {t: 0.5 * share for t in (0, 1, 4, 5, 6, 8, 9)}
    drawn = context.draw(rng.random(200_000))
    for token, p in want.items():
        assert abs((drawn == token).mean() - p) < 0.005
    assert context.draw(np.array([0.0, 1 - 1e-16])).tolist() == [2, 9]
