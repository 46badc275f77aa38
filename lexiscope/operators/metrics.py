"""Retrieval metrics: recall@k, precision@k, reciprocal rank, averages.

Definitions (per query, over the ranked list of length max(k)):

* recall@k    = distinct relevant documents in the top k / distinct relevant
                documents; 0 when the query has no relevant document;
* precision@k = distinct relevant documents in the top k / k, even if fewer
                than k came back; 0 when nothing is relevant or k = 0;
* reciprocal rank = 1 / rank of the first relevant document, else 0.

Everything is a conditional aggregate over the ranked hits; no per-query
Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The cut-offs the evaluation reports.
DEFAULT_KS = (1, 5, 10, 15)


def match_relevant(ranked: DataFrame, qrels: DataFrame, *, query_id: str = "query_id",
                   doc_id: str = "doc_id") -> DataFrame:
    """Flag each ranked hit that is a relevant (query, doc) pair. Duplicate
    judgments count once."""
    rel = (qrels.select(F.col(query_id).alias("query_id"), F.col(doc_id).alias("doc_id"))
           .distinct().withColumn("is_relevant", F.lit(True)))
    return (ranked.join(rel, ["query_id", "doc_id"], "left")
            .withColumn("is_relevant", F.coalesce(F.col("is_relevant"), F.lit(False))))


def relevant_counts(qrels: DataFrame, *, query_id: str = "query_id",
                    doc_id: str = "doc_id") -> DataFrame:
    """Distinct relevant documents per query."""
    return (qrels.groupBy(F.col(query_id).alias("query_id"))
            .agg(F.count_distinct(F.col(doc_id)).alias("n_relevant")))


def per_query_metrics(flagged: DataFrame, n_relevant: DataFrame, queries: DataFrame,
                      ks=DEFAULT_KS, *, group_cols=()) -> DataFrame:
    """One row per evaluated query (``queries`` has ``query_id`` and the
    ``group_cols``): ``n_relevant, rr, recall_at_k, precision_at_k``.

    ``flagged`` holds ranked hits with ``rank`` and ``is_relevant``.
    ``n_relevant`` has ``query_id, n_relevant`` (+ group columns if it depends
    on them). Queries with no hit or no relevant document score 0.
    """
    keys = list(group_cols) + ["query_id"]
    hit = F.col("is_relevant")
    aggs = [F.sum(F.when(hit & (F.col("rank") <= k), 1).otherwise(0)).alias(f"_hits_{k}")
            for k in ks]
    aggs.append(F.min(F.when(hit, F.col("rank"))).alias("_first_hit"))
    stats = flagged.groupBy(*keys).agg(*aggs)
    rel_keys = [c for c in keys if c in n_relevant.columns]
    base = (queries.select(*keys).join(n_relevant, rel_keys, "left")
            .join(stats, keys, "left"))
    nrel = F.coalesce(F.col("n_relevant"), F.lit(0)).cast("long")
    cols: list[Column] = [F.col(c) for c in keys] + [nrel.alias("n_relevant")]
    cols.append(F.when(F.col("_first_hit").isNotNull(), 1.0 / F.col("_first_hit"))
                .otherwise(0.0).alias("rr"))
    for k in ks:
        h = F.coalesce(F.col(f"_hits_{k}"), F.lit(0)).cast("double")
        cols.append(F.when(nrel > 0, h / nrel).otherwise(0.0).alias(f"recall_at_{k}"))
    for k in ks:
        h = F.coalesce(F.col(f"_hits_{k}"), F.lit(0)).cast("double")
        cols.append((F.when((nrel > 0) & F.lit(k > 0), h / F.lit(max(k, 1)))
                     .otherwise(0.0)).alias(f"precision_at_{k}"))
    return base.select(*cols)


def average_metrics(per_query: DataFrame, ks=DEFAULT_KS, *, group_cols=(),
                    num_asked: DataFrame | None = None) -> DataFrame:
    """Plain means over scored queries, one row per group (e.g. per model):
    ``num_queries, mrr, recall_at_k..., precision_at_k...``; 0 when empty."""
    aggs = [F.count(F.lit(1)).alias("num_queries"),
            F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr")]
    aggs += [F.coalesce(F.avg(f"recall_at_{k}"), F.lit(0.0)).alias(f"recall_at_{k}") for k in ks]
    aggs += [F.coalesce(F.avg(f"precision_at_{k}"), F.lit(0.0)).alias(f"precision_at_{k}")
             for k in ks]
    out = per_query.groupBy(*group_cols).agg(*aggs)
    if num_asked is not None:
        out = out.join(num_asked, list(group_cols), "left")
    return out


def round_metrics(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (for comparison with another engine)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if f.dataType.typeName() == "double" else F.col(f.name)
                       for f in df.schema.fields])
