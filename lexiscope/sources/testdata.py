"""Roles of the given Parquet tables.

* corpus      = ``documents``: ``doc_id`` is the id and the order (``pos``),
                ``source`` plays the title;
* queries     = ``benchmark``: ``item_id`` is the id and the order;
* judgments   = (item, document) pairs where the document text contains the
                item text (derived by anchors, see
                :func:`qrels_by_containment`);
* vectors     = ``embeddings`` (``vec_id``, 64 floats, ``label``).
"""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Tables whose rows carry long texts: per-row work (tokenizing, scanning) is
# heavy, so the scan's splits are spread over the cores when there are fewer
# splits than cores.
TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over ``defaultParallelism`` partitions when the
    scan reads a single file (the small test tables); with many files the scan
    is left as it is, so no shuffle is added."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < 2:
        return df.repartition(target)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if name in TEXT_TABLES else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, title, text, pos`` from ``documents``."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id"), F.col("source").alias("title"), F.col("text"),
        F.col("doc_id").alias("pos"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, text, pos`` from ``benchmark``."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text"), F.col("item_id").alias("pos"))


# Consecutive parts (between spaces) of an item that anchor it.
ANCHOR = 3
# Item text that is sent to the tasks at once; an automaton takes about a hundred
# times its size.
SCAN_BYTES = 1 << 20


def _scan(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, doc_id) of few items (``query_id, _t``): one automaton of all of
    them reads every text once."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    held = items.toArrow()
    ids, texts = held.column(0).combine_chunks(), held.column(1).to_pylist()
    schema = T.StructType([T.StructField("query_id", items.schema["query_id"].dataType),
                           T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    target = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast((ids, texts))

    def find(batches):
        import ahocorasick

        ids, texts = shared.value
        by_text: dict[str, list[int]] = {}
        for i, t in enumerate(texts):
            by_text.setdefault(t, []).append(i)
        automaton = ahocorasick.Automaton()
        for t, own in by_text.items():
            automaton.add_word(t, own)
        automaton.make_automaton()
        for b in batches:
            rows, found = [], []
            for row, text in enumerate(b.column(1).to_pylist()):
                if text and by_text:
                    hits = {i for _, own in automaton.iter(text) for i in own}
                    rows += [row] * len(hits)
                    found += hits
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(found, pa.int64())).cast(target.field(0).type),
                                              b.column(0).take(pa.array(rows, pa.int64())).cast(target.field(1).type)], schema=target)

    return docs.select("doc_id", "_text").mapInArrow(find, schema)


def qrels_by_containment(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id",
                         doc_text: str = "text", item_id: str = "query_id",
                         item_text: str = "text", scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """(query_id, doc_id) for every document whose text contains the item text.

    Items of at most ``scan_bytes`` of text are sent to the tasks, where an
    automaton finds all of them in one reading of each text. Of more items those
    with an anchor are joined: where an item lies in a document, all its parts
    between spaces but the first and last are parts of the document, so the hash of
    the ``ANCHOR`` parts behind its first is joined with the hashes of all such runs
    of the documents, and ``contains`` checks the candidates. Items with fewer parts
    are few words long and are scanned for, ``scan_bytes`` of them at a time. Empty
    and null item texts are skipped (an empty one would match every document). Ids
    keep their type.
    """
    items = items.select(F.col(item_id).alias("query_id"), F.col(item_text).alias("_t")).where(F.length("_t") > 0)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("_text"))
    size = F.sum(F.octet_length("_t") + 64)
    total = items.agg(size.alias("n")).first()["n"] or 0
    if total <= scan_bytes:
        return _scan(d, items).distinct()
    items = items.withColumn("_w", F.split("_t", " "))
    anchored = items.where(F.size("_w") >= ANCHOR + 2)
    key = F.xxhash64(*[F.col("_w")[i + 1] for i in range(ANCHOR)])
    words = d.select("doc_id", F.split("_text", " ").alias("_w")).where(F.size("_w") >= ANCHOR)
    runs = words.select("doc_id", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.size("_w") - ANCHOR),
        lambda i: F.xxhash64(*[F.get(F.col("_w"), i + j) for j in range(ANCHOR)])))).alias("_k"))
    near = runs.join(anchored.select("query_id", key.alias("_k")), "_k").select("doc_id", "query_id")
    out = near.join(d, "doc_id").join(anchored.select("query_id", "_t"), "query_id") \
        .where(F.contains("_text", "_t")).select("query_id", "doc_id")
    short = items.where(F.size("_w") < ANCHOR + 2).select("query_id", "_t")
    n = math.ceil((short.agg(size.alias("n")).first()["n"] or 0) / scan_bytes)
    for part in range(n):
        out = out.unionByName(_scan(d, short.where(F.pmod(F.xxhash64("query_id", "_t"), F.lit(n)) == part)))
    return out.distinct()


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments of the test tables: ``query_id, doc_id``."""
    return qrels_by_containment(table(spark, sf_dir, "documents"), queries(spark, sf_dir))
