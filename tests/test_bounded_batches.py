"""What a task holds beside its batch does not grow with the rows of the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lexiscope.functions import tokens as TK
from lexiscope.functions.parts import row_parts
from lexiscope.operators import bpe, ngram, tokstats, vectorize

TEXT = "Bäume wachsen langsam; 日本 𐍈 and then some plain words. " * 40


def _peak(fn) -> int:
    tracemalloc.start()
    try:
        fn()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def _texts(rows):
    return pa.array([TEXT + str(i) if i % 7 else None for i in range(rows)])


def test_parts_cover_all_rows_in_order():
    sizes = np.array([3, 0, 9, 1, 1, 1, 20, 0])
    assert list(row_parts(sizes, 5)) == [(0, 2), (2, 3), (3, 6), (6, 7), (7, 8)]
    assert list(row_parts(np.zeros(0, int), 5)) == []


def test_tokenizers_hold_little_beside_their_output():
    texts = _texts(1000)
    for fn in (TK._byte_ids, TK._code_points):
        out = fn(texts, True)
        assert _peak(lambda fn=fn: fn(texts, True)) < len(out.values) * 4 + (24 << 20)


def test_counting_holds_little():
    tokens = TK._byte_ids(_texts(1000), True).cast(pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(["byte"] * 1000), tokens, pa.array(np.arange(1000))], names=["tokenizer", "tokens", "pos"])
    for order, pairs in ((None, False), ("pos", False), (None, True)):
        run = tokstats._partial_counts_fn("tokens", ["tokenizer"], None, order, pairs)
        assert _peak(lambda run=run: [None for _ in run([batch])]) < 64 << 20
    assert _peak(lambda: vectorize._bucket_counts(tokens, 256, 2)) < 64 << 20


def test_counts_are_those_of_the_whole_batch():
    tokens = TK._byte_ids(_texts(700), True).cast(pa.list_(pa.int32()))
    counts, valid = vectorize._bucket_counts(tokens, 64, 2)
    for i in (0, 1, 6, 350, 699):
        assert (counts[i] == vectorize._part_counts(tokens.slice(i, 1), 64, 2)[0]).all()
    assert valid.tolist() == [i % 7 != 0 for i in range(700)]
    batch = pa.RecordBatch.from_arrays([tokens], names=["tokens"])
    run = tokstats._partial_counts_fn("tokens", [], None, None, True)
    found = {}
    for b in run([batch]):
        for a, c, n in zip(*(b.column(x).to_pylist() for x in ("left", "right", "cnt")), strict=True):
            found[a, c] = found.get((a, c), 0) + n
    assert sum(found.values()) == sum(len(t) - 1 for t in tokens.to_pylist() if t)


def test_greedy_ids_by_parts(monkeypatch):
    greedy = bpe.GreedyTable(bpe.transitions({(116, 104): 256, (256, 101): 257}))
    texts = pa.array(["the then", None, "", TEXT, "th" * 50, "thethe"])
    whole = bpe._encode_array(texts, greedy)
    from lexiscope.functions import parts
    monkeypatch.setattr(bpe, "row_parts", lambda sizes: parts.row_parts(sizes, 4))
    assert bpe._encode_array(texts, greedy).equals(whole)


def test_gram_tables_do_not_depend_on_the_parts(spark, monkeypatch):
    df = spark.createDataFrame([([1, 2, 1, 2, 3],), (None,), ([],), ([1, 2],)], "tokens array<int>").coalesce(1)
    whole = sorted(map(tuple, ngram.gram_counts(df, 2).collect()))
    monkeypatch.setattr(ngram, "SLICE_TOKENS", 1)
    assert sorted(map(tuple, ngram.gram_counts(df, 2).collect())) == whole == [(1, 2, 3), (2, 1, 1), (2, 3, 1)]
