"""End-to-end jobs: prepare, embed, evaluate, analyse. Plain functions over
DataFrames; every stage hands the next a DataFrame (or a written table)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_for_embedding
from ..operators import prep
from ..operators.metrics import (DEFAULT_KS, average_metrics, match_relevant, per_query_metrics,
                                 relevant_counts)
from ..operators.ordering import split_by_position
from ..operators.retrieve import topk_cosine, topk_cosine_models
from ..operators.vectorize import embed_hashed, fit_idf, hashed_counts, hashed_tf, hashed_vector, weighted_vector
from ..session import checkpoint_dir
from .registry import Model


def prepare(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, n_titles: int | None = 3000):
    """Corpus of the first ``n_titles`` titles (all if None), queries whose judged
    documents all survive, and their judgments."""
    kept = prep.first_n_titles(corpus, n_titles)
    aligned = prep.align_queries(queries, qrels, kept)
    return kept, aligned, prep.aligned_qrels(qrels, aligned)


def term_counts(corpus: DataFrame, models: list[Model], *, title: str = "title", text: str = "text") -> DataFrame:
    """``doc_id`` and the hashed term counts of every model in a column named like
    it: one pass over the corpus."""
    content = content_for_embedding(title, text)
    return corpus.select("doc_id", *[hashed_counts(m.tokenizer.tokens(content), m.dim, m.ngram).alias(m.name) for m in models])


def fit_idfs(corpus: DataFrame, models: list[Model], *, title: str = "title", text: str = "text") -> dict[str, list[float] | None]:
    """The idf of every model in one pass over the corpus."""
    return idfs_of_counts(term_counts(corpus, models, title=title, text=text), models)


def idfs_of_counts(counts: DataFrame, models: list[Model]) -> dict[str, list[float] | None]:
    """The idf of every model from its column of term counts, named like it: one
    Summarizer for each inside a single aggregation (each result is ``dim``
    numbers)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    with_idf = [m for m in models if m.use_idf]
    out: dict[str, list[float] | None] = {m.name: None for m in models}
    if not with_idf:
        return out
    row = counts.select(*[Summarizer.metrics("numNonZeros", "count")
                          .summary(array_to_vector(F.col(f"`{m.name}`").cast("array<double>"))).alias(f"s{i}")
                          for i, m in enumerate(with_idf)]).collect()[0]
    for i, m in enumerate(with_idf):
        n = int(row[f"s{i}"]["count"])
        nnz = row[f"s{i}"]["numNonZeros"].toArray()
        out[m.name] = [math.log((n + 1.0) / (float(x) + 1.0)) for x in nnz]
    return out


def embed_corpus(corpus: DataFrame, model: Model, *, doc_id: str = "doc_id",
                 title: str = "title", text: str = "text", idf=None):
    """(vectors, state): one row per document with ``embedding`` of width
    ``model.dim``; the state (the idf, or what the model's own vectorizer fits)
    comes from this corpus unless given as ``idf``."""
    tok = corpus.select(F.col(doc_id).alias("doc_id"), F.col(title).alias("title"),
                        F.col(text).alias("text"),
                        model.tokenizer.tokens(content_for_embedding(title, text)).alias("tokens"))
    if model.vectorizer is not None:
        tok = tok.withColumnRenamed("text", "_own").withColumn("text", content_for_embedding("title", "_own"))
        state = model.vectorizer.fit(tok) if idf is None else idf
        vecs = model.vectorizer.transform(tok, state).drop("tokens", "text")
        return vecs.withColumnRenamed("_own", "text"), state
    if model.use_idf and idf is None:
        _, idf = fit_idf(tok.select(hashed_tf("tokens", model.dim, model.ngram).alias("tf")), "tf")
    vecs = embed_hashed(tok, "tokens", model.dim, model.ngram, use_idf=model.use_idf, idf=idf)
    return vecs.drop("tokens"), idf


def embed_queries(queries: DataFrame, model: Model, idf, *, query_id: str = "query_id",
                  text: str = "text") -> DataFrame:
    tok = queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("text"),
                         model.tokenizer.tokens(F.col(text)).alias("tokens"))
    if model.vectorizer is not None:
        return model.vectorizer.transform(tok, idf).drop("tokens", "text")
    tok = tok.drop("text")
    return embed_hashed(tok, "tokens", model.dim, model.ngram, use_idf=model.use_idf,
                        idf=idf).drop("tokens")


def evaluate(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, models: list[Model], *,
             ks=DEFAULT_KS, val_ratio: float = 0.5) -> DataFrame:
    """Retrieval quality of every model on the test part of ``queries``:
    one row per model with ``num_queries, mrr, recall_at_k, precision_at_k``
    and ``dim``. One pass over the corpus counts the terms of all hashed models;
    the counts, kept in the checkpoint folder, give their idf, vectors and search; a model with a vectorizer of its own
    is fitted and searched by itself."""
    # the evaluated queries are few and read several times: written once
    checkpoint_dir(corpus.sparkSession)
    asked = test_queries(queries, val_ratio).checkpoint()
    hashed = [m for m in models if m.vectorizer is None]
    parts = []
    if hashed:
        # texts are tokenized and counted once: the counts give the idf, then the vectors
        counts = term_counts(corpus, hashed).checkpoint()
        idfs = idfs_of_counts(counts, hashed)
        held = [weighted_vector(F.col(f"`{m.name}`"), m.dim, idfs[m.name]).alias(m.name) for m in hashed]
        own = [hashed_vector(m.tokenizer.tokens(F.col("text")), m.dim, m.ngram, idfs[m.name]).alias(m.name) for m in hashed]
        parts.append(topk_cosine_models(asked.select("query_id", *own), counts.select("doc_id", *held), [m.name for m in hashed], max(ks)))
    for m in models:
        if m.vectorizer is not None:
            doc_vecs, state = embed_corpus(corpus, m)
            parts.append(topk_cosine(embed_queries(asked, m, state), doc_vecs, max(ks)).withColumn("model", F.lit(m.name)))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    names = F.array(*[F.struct(F.lit(m.name).alias("model"), F.lit(m.dim).alias("dim")) for m in models])
    each = asked.select("query_id", F.explode(names).alias("m")).select("query_id", "m.model", "m.dim")
    per_query = per_query_metrics(match_relevant(hits, qrels).join(each, ["query_id", "model"]), relevant_counts(qrels),
                                  each, ks, group_cols=("model", "dim"))
    return average_metrics(per_query, ks, group_cols=("model", "dim"))


def score_hits(hits: DataFrame, qrels: DataFrame, asked: DataFrame, model: str, *,
               ks=DEFAULT_KS) -> DataFrame:
    """Averaged metrics of one model's ranked hits (one row)."""
    flagged = match_relevant(hits, qrels)
    pq = per_query_metrics(flagged, relevant_counts(qrels), asked.select("query_id"), ks)
    return average_metrics(pq.withColumn("model", F.lit(model)), ks, group_cols=("model",))


def evaluate_reduced(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, models: list[Model], width: int, *,
                     ks=DEFAULT_KS, val_ratio: float = 0.5) -> DataFrame:
    """As ``evaluate``, with the vectors of every model, whatever their width, in
    ``width`` principal components of the model's document vectors."""
    from ..operators.pca import fit_components, project

    checkpoint_dir(corpus.sparkSession)
    asked = test_queries(queries, val_ratio).checkpoint()
    out = None
    for m in models:
        vecs, state = embed_corpus(corpus, m)
        vecs = vecs.select("doc_id", "embedding").checkpoint()
        components = fit_components(vecs, width)
        hits = topk_cosine(project(embed_queries(asked, m, state).select("query_id", "embedding"), components, centre=False),
                           project(vecs, components, centre=False), max(ks))
        row = score_hits(hits, qrels, asked, m.name, ks=ks)
        out = row if out is None else out.unionByName(row)
    return out


def test_queries(queries: DataFrame, val_ratio: float = 0.5) -> DataFrame:
    """The scored part of the positional split."""
    return (split_by_position(queries, val_ratio, pos="pos", id_col="query_id")
            .where(F.col("split") == "test").drop("split"))


def embed_all_models(corpus: DataFrame, models: list[Model], path: str, *,
                     mode: str = "overwrite", id_col: str = "doc_id") -> dict[str, bool]:
    """One embedding table per model (Parquet partition ``model=<name>``). When
    a model fails the others still run; the failures are raised together at the
    end, each with its cause."""
    from ..sources.io import embedding_table_write

    failed: list[Exception] = []
    for m in models:
        try:
            vecs, _ = embed_corpus(corpus, m, doc_id=id_col)
            embedding_table_write(vecs.withColumnRenamed("doc_id", "id"), path, m.name, m.dim,
                                  mode=mode, id_col="id")
        except Exception as e:  # noqa: BLE001 - raised below
            e.add_note(f"model {m.name}")
            failed.append(e)
    if failed:
        raise ExceptionGroup(f"{len(failed)} of {len(models)} models failed", failed)
    return {m.name: True for m in models}


def search_table(spark, path: str, model: Model, queries: DataFrame, k: int = 15, *, idf=None) -> DataFrame:
    """Hits of ``queries`` in the stored vectors of a model, without embedding
    the corpus again. ``idf`` is the one the table was written with."""
    stored = spark.read.parquet(path).where(F.col("model") == model.name) \
        .select(F.col("id").alias("doc_id"), "embedding")
    return topk_cosine(embed_queries(queries, model, idf), stored, k)


def analyze_tokenizers(docs: DataFrame, tokenizers: dict, *, text: str = "text",
                       pos: str = "pos", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(comparison table, top tokens): every tokenizer's output in one frame,
    summarised by one ``groupBy(tokenizer)``. ``tokenizers`` maps a name to
    (column function, vocabulary size)."""
    from ..operators import tokstats

    spark = docs.sparkSession
    frames = [docs.select(F.lit(name).alias("tokenizer"), F.col(doc_id).alias("doc_id"),
                          F.col(pos).alias("pos"), F.col(text).alias("text"),
                          fn(F.col(text)).alias("tokens"))
              for name, (fn, _) in tokenizers.items()]
    tok = frames[0]
    for f in frames[1:]:
        tok = tok.unionByName(f)
    sizes = spark.createDataFrame([(n, int(v)) for n, (_, v) in tokenizers.items()],
                                  "tokenizer string, vocab_size long")
    return tokstats.analyze(tok, sizes), tokstats.token_frequency(tok, top=5)
