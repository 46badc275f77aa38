"""Registered queries on the readers and writers: each writes a given table with a
sink into the checkpoint folder, reads it back and reports what came back; the SQL
reads the given table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources import io
from ..sources.testdata import corpus, table
from ..sources.testdata import qrels as test_qrels
from ..sources.testdata import queries as items
from .queries import _QRELS_SQL, register


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _written_corpus(spark, sf_dir) -> str:
    path = _folder(spark, "corpus")
    docs = corpus(spark, sf_dir).select(F.col("doc_id").cast("string").alias("_id"), "title", "text", "pos")
    io.write_filtered_jsonl(docs, path)
    return path


@register("io_corpus_jsonl", """SELECT doc_id::VARCHAR AS _id, coalesce(source, '') AS title, md5(coalesce(text, '')) AS text_md5
FROM documents WHERE doc_id IS NOT NULL""")
def q_io_corpus_jsonl(spark, sf_dir):
    """The corpus as JSON lines, read by the tolerant reader."""
    back = io.read_corpus_tolerant(spark, _written_corpus(spark, sf_dir))
    return back.select("_id", "title", F.md5("text").alias("text_md5"))


@register("io_corpus_counts", """SELECT 0::BIGINT AS malformed, count(*) FILTER (WHERE doc_id IS NULL)::BIGINT AS missing_id,
count(doc_id)::BIGINT AS kept FROM documents""")
def q_io_corpus_counts(spark, sf_dir):
    """What the tolerant reader skips."""
    return io.read_corpus_tolerant(spark, _written_corpus(spark, sf_dir), with_counts=True)[1]


@register("io_queries_jsonl", "SELECT item_id::VARCHAR AS _id, text FROM benchmark")
def q_io_queries_jsonl(spark, sf_dir):
    path = _folder(spark, "queries")
    io.write_filtered_jsonl(items(spark, sf_dir).select(F.col("query_id").cast("string").alias("_id"), "text"), path)
    return io.read_queries_strict(spark, path).select("_id", "text")


@register("io_qrels_tsv", f"SELECT query_id::VARCHAR AS query_id, doc_id::VARCHAR AS doc_id FROM ({_QRELS_SQL})")
def q_io_qrels_tsv(spark, sf_dir):
    """Judgments as a tab-separated file with a header."""
    path = _folder(spark, "qrels")
    rows = test_qrels(spark, sf_dir).select(F.col("query_id").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.lit(1).alias("score"))
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return io.read_qrels(spark, path).select("query_id", "doc_id")


@register("io_corpus_text", """SELECT md5(replace(text, chr(10), ' ') || chr(10)) AS line_md5, count(*) AS n
FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def q_io_corpus_text(spark, sf_dir):
    """Every text as one line of a text file."""
    path = _folder(spark, "text")
    io.dump_corpus_text(corpus(spark, sf_dir).where(F.col("text").isNotNull()), path)
    return io.read_corpus_text(spark, path).groupBy(F.md5("text").alias("line_md5")).agg(F.count("*").alias("n"))


@register("io_embedding_table", """SELECT vec_id AS id, len(embedding)::INT AS dim, round(embedding[1]::DOUBLE, 6) AS first,
round(embedding[len(embedding)]::DOUBLE, 6) AS last FROM embeddings""")
def q_io_embedding_table(spark, sf_dir):
    """The given vectors through the embedding table of one model."""
    path = _folder(spark, "vectors")
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    io.embedding_table_write(emb, path, "given", 64)
    back = spark.read.parquet(path).where(F.col("model") == "given")
    return back.select("id", F.size("embedding").alias("dim"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"),
                       F.round(F.element_at("embedding", -1).cast("double"), 6).alias("last"))
