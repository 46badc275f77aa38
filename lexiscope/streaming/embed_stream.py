"""Incremental embedding of newly arriving corpus files.

The reference's append mode (keep the table, add rows) as a Structured Streaming
job: new files of a folder are tokenized, vectorized and appended to the embedding
table. The checkpoint location records which files were processed.

Each micro-batch is a partition of the table named by its number and is written
whole, so a batch that is done again after a failure replaces what it left. Rows
without id are left out, and ids that the table has from other batches, or that
come twice in a batch, are not added again. Document frequencies are a table of
counts by batch beside the vectors: they add up, so the idf of a batch is that of
all documents so far, and doing a batch again changes nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_for_embedding
from ..operators.vectorize import hashed_tf, hashed_vector
from ..plans.registry import Model


def _table(spark: SparkSession, path: str, schema: T.StructType, parts: list[str]) -> DataFrame:
    """The table at ``path`` with its partition columns; it is made if there is
    none."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*parts).parquet(path)
    return spark.read.schema(schema).parquet(path)


def frequencies(spark: SparkSession, path: str, dim: int, but: int | None = None) -> tuple[int, list[int]]:
    """(documents, documents that hold each bucket) over all batches ``but`` one."""
    schema = T.StructType().add("bucket", "integer").add("df", "long").add("batch", "long")
    held = _table(spark, path, schema, ["batch"])
    if but is not None:
        held = held.where(F.col("batch") != but)
    found = {r["bucket"]: r["df"] for r in held.groupBy("bucket").agg(F.sum("df").alias("df")).collect()}  # dim + 1 rows
    return found.get(-1, 0), [found.get(i, 0) for i in range(dim)]


def append_batch(batch: DataFrame, number: int, model: Model, state, out: str, *, frequency_path: str | None = None,
                 id_col: str = "doc_id", title: str = "title", text: str = "text") -> None:
    """Add one batch to the table at ``out`` as its partition ``number``. With
    ``frequency_path`` the idf comes from the batches so far, this one included,
    instead of ``state``."""
    spark = batch.sparkSession
    rows = batch.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(title).alias("title"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("title", T.StringType()), T.StructField("text", T.StringType()),
                           T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("model", T.StringType()),
                           T.StructField("batch", T.LongType())])
    held = _table(spark, out, schema, ["model", "batch"]).where((F.col("model") == model.name) & (F.col("batch") != number)).select("id")
    known = held.join(rows.select("id").distinct(), "id", "left_semi")  # of the table only ids are read, and few are kept
    rows = rows.dropDuplicates(["id"]).join(known, "id", "left_anti")
    content = content_for_embedding("title", "text")
    tokens = model.tokenizer.tokens(content)
    if model.vectorizer is not None:
        tok = rows.select("id", "title", F.col("text").alias("_own"), tokens.alias("tokens")).withColumn("text", content_for_embedding("title", "_own"))
        vecs = model.vectorizer.transform(tok, state).drop("text", "tokens").withColumnRenamed("_own", "text")
    else:
        if frequency_path is not None and model.use_idf:
            tf = rows.select(hashed_tf(tokens, model.dim, model.ngram).alias("tf"))
            seen = tf.select(F.posexplode("tf").alias("bucket", "n")).where("n > 0").groupBy("bucket").agg(F.count("*").alias("df"))
            own = seen.unionByName(rows.agg(F.lit(-1).alias("bucket"), F.count("*").alias("df")))
            own.coalesce(1).write.mode("overwrite").parquet(f"{frequency_path}/batch={number}")
            n, df = frequencies(spark, frequency_path, model.dim)
            state = [math.log((n + 1.0) / (x + 1.0)) for x in df]
        vecs = rows.withColumn("embedding", hashed_vector(tokens, model.dim, model.ngram, state if model.use_idf else None))
    vecs.select("id", "title", "text", F.col("embedding").cast("array<float>")).write.mode("overwrite") \
        .parquet(f"{out}/model={model.name}/batch={number}")


def embed_append_stream(spark: SparkSession, src: str, schema: T.StructType, model: Model, state, out: str, checkpoint: str, *,
                        fmt: str = "parquet", id_col: str = "doc_id", title: str = "title", text: str = "text",
                        frequency_path: str | None = None, available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``. ``state`` is the idf or
    what the model's own vectorizer fitted."""
    stream = spark.readStream.schema(schema).format(fmt).load(src)

    def add(batch: DataFrame, number: int) -> None:
        append_batch(batch, number, model, state, out, frequency_path=frequency_path, id_col=id_col, title=title, text=text)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
