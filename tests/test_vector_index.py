"""The index of cells against comparing every pair."""

import numpy as np
import pytest

from lexiscope.operators import vector_index
from lexiscope.operators.retrieve import topk_cosine


def vectors(spark, n=600, seed=1, width=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    m = centres[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, width))
    m[rng.random(n) < 0.3] = m[0]  # one vector is a third of all
    m[n - 1] = 0
    rows = [(f"v{i:04d}", x.tolist()) for i, x in enumerate(m)] + [("none", None)]
    return spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(4)


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], "nan" if np.isnan(r["distance"]) else round(r["distance"], 7)) for r in df.collect())


@pytest.mark.parametrize("cells, probes, k, blocks", [(None, 3, 5, 20_000), (40, 1, 10, 25), (1, 1, 3, 7), (7, 7, 4, 20_000), (10, 2, 700, 50)])
def test_exact_search_is_that_of_all_pairs(spark, monkeypatch, cells, probes, k, blocks):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", max(4, blocks // 2))
    emb = vectors(spark)
    asked = emb.where("vec_id rlike '[05]3$|599|none|v0000'").withColumnRenamed("vec_id", "query_id")
    index = vector_index.build(emb, cells=cells)
    assert index.rows.sum() == 600 and len(index.centres) == (cells or 25)
    got = vector_index.search(index, asked, k, probes=probes, exact=True)
    assert rows_of(got) == rows_of(topk_cosine(asked, emb.withColumnRenamed("vec_id", "doc_id"), k))


def test_the_query_itself_can_be_left_out(spark):
    emb = vectors(spark, 120)
    asked = emb.withColumnRenamed("vec_id", "query_id")
    got = vector_index.search(vector_index.build(emb, cells=8), asked, 4, probes=2, exact=True, exclude_self=True)
    assert rows_of(got) == rows_of(topk_cosine(asked, emb.withColumnRenamed("vec_id", "doc_id"), 4, exclude_self=True))


def test_tuned_probes_reach_the_recall(spark):
    emb = vectors(spark, 800, 3, 16)
    asked = emb.where("vec_id rlike '[27]$'").withColumnRenamed("vec_id", "query_id")
    index = vector_index.build(emb)
    probes = vector_index.tune_probes(index, asked, 10, 0.95)
    assert 1 <= probes < len(index.centres)
    exact = topk_cosine(asked, emb.withColumnRenamed("vec_id", "doc_id"), 10)
    row = vector_index.recall(vector_index.search(index, asked, 10, probes=probes), exact).first()
    assert row["recall"] >= 0.9 and row["n_pairs"] == 10 * row["n_queries"]


def test_empty_tables(spark):
    emb = vectors(spark, 10)
    none = emb.where("vec_id = 'x'")
    index = vector_index.build(none)
    assert vector_index.search(index, emb.withColumnRenamed("vec_id", "query_id"), 3, exact=True).collect() == []
    assert vector_index.search(vector_index.build(emb), none.withColumnRenamed("vec_id", "query_id"), 3).collect() == []


def test_centres_have_no_empty_cells():
    rng = np.random.default_rng(0)
    sample = np.repeat(rng.normal(size=(5, 4)), 20, axis=0) + 1e-3 * rng.normal(size=(100, 4))
    centres = vector_index.fit_centres(sample, 9)
    cell = (sample / np.linalg.norm(sample, axis=1)[:, None] @ centres.T).argmax(axis=1)
    assert len(centres) == 9 and len(set(cell.tolist())) >= 5 and np.allclose(np.linalg.norm(centres, axis=1), 1)
