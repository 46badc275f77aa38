"""N-gram tables, interpolated models and windows by definition."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from lexiscope.operators import lm, ngram

V = 6


def sequences(seed, n=30):
    rnd = random.Random(seed)
    return [[rnd.choice([1, 1, 1, 2, 3, 4]) for _ in range(rnd.randint(0, 25))] for _ in range(n)]


def frame(spark, seqs):
    return spark.createDataFrame([(s,) for s in [*seqs, None]], "tokens array<int>").repartition(3)


def grams(seqs, order):
    return Counter(tuple(s[i:i + order]) for s in seqs for i in range(len(s) - order + 1))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_counts(spark, order, monkeypatch):
    monkeypatch.setattr(ngram, "SLICE_TOKENS", 40)
    seqs = sequences(order)
    got = {tuple(r)[:-1]: r["cnt"] for r in ngram.gram_counts(frame(spark, seqs), order).collect()}
    assert got == grams(seqs, order)
    with pytest.raises(ValueError):
        ngram.gram_counts(frame(spark, seqs), 4)


def model(train, order, weights):
    known = {k: grams(train, k) for k in range(1, order + 1)}
    total = sum(known[1].values())

    def p(gram):
        f = [1 / V, known[1][gram[-1:]] / total]
        for k in range(2, order + 1):
            tail = gram[-k:]
            seen = sum(n for g, n in known[k].items() if g[:-1] == tail[:-1])
            f.append(known[k][tail] / seen if seen else f[-1])
        return [w * x for w, x in zip(weights, f, strict=True)]

    return p


@pytest.mark.parametrize("order", [1, 2, 3])
def test_weights_and_loss(spark, order):
    train, held, test = sequences(10), sequences(11, 8), [*sequences(12, 8), [5, 5, 0]]
    fitted = ngram.Interpolated.train(frame(spark, train), order, V).fit(ngram.gram_counts(frame(spark, held), order), steps=4)
    weights = [1 / (order + 1)] * (order + 1)
    for _ in range(4):
        sums, p = [0.0] * (order + 1), model(train, order, weights)
        for g, n in grams(held, order).items():
            parts = p(g)
            sums = [s + n * x / sum(parts) for s, x in zip(sums, parts, strict=True)]
        weights = [s / sum(sums) for s in sums]
    assert np.allclose(fitted.weights, weights)
    p = model(train, order, weights)
    asked = grams(test, order)
    loss = sum(-n * math.log(sum(p(g))) for g, n in asked.items()) / sum(asked.values())
    row = fitted.score(ngram.gram_counts(frame(spark, test), order)).first()
    assert row["n_pairs"] == sum(asked.values()) and math.isclose(row["loss"], loss)
    # probabilities of all tokens behind any context sum to 1
    for ctx in ([1, 1], [2, 4], [5, 5]):
        assert math.isclose(sum(sum(p((*ctx, t)[-order:])) for t in range(V)), 1)


def test_nothing_held_out_keeps_equal_weights(spark):
    m = ngram.Interpolated.train(frame(spark, sequences(1)), 2, V)
    assert m.fit(ngram.gram_counts(frame(spark, []), 2)).weights == [1 / 3] * 3


@pytest.mark.parametrize("length, stride", [(4, 2), (5, 5), (3, 7), (1, 1)])
def test_windows_are_counted_without_being_made(spark, length, stride):
    seqs = sequences(20, 40)
    windows = lm.lm_windows(frame(spark, seqs), "tokens", length, stride).collect()
    want = Counter(p for w in windows for p in zip(w["input"], w["target"], strict=True))
    got = {(r["t1"], r["t2"]): r["cnt"] for r in ngram.gram_counts(frame(spark, seqs), 2, windows=(length, stride)).collect()}
    assert got == want
