"""Readers and writers of the reference's file formats.

All readers use explicit schemas and Spark's own readers, so files are split
and parsed in parallel. Rows keep their order in ``pos``, a string that sorts by
file (in order of their paths), place of the split in the file, and row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text as _clean
from ..functions.text import content_for_embedding, flatten_newlines
from ..operators.ordering import first_rows
from ..operators.prep import require_id

CORPUS_SCHEMA = T.StructType([
    T.StructField("_id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("metadata", T.StringType())])
QUERY_SCHEMA = T.StructType([
    T.StructField("_id", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("metadata", T.StringType())])
QRELS_SCHEMA = T.StructType([
    T.StructField("query-id", T.StringType()), T.StructField("corpus-id", T.StringType()),
    T.StructField("score", T.StringType())])


def _with_pos(df: DataFrame, name: str = "pos") -> DataFrame:
    """Add the order of the rows of a file scan. ``monotonically_increasing_id``
    alone follows the packing of splits into tasks, largest first."""
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    files = df.sparkSession.createDataFrame(list(enumerate(sorted(df.inputFiles()))), "_file int, _path string") \
        .select("_file", plain("_path").alias("_path"))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # the place is taken in the scan, before anything can move rows
    placed = df.select("*", plain(F.col("_metadata.file_path")).alias("_path"),
                       F.col("_metadata.file_block_start").alias("_start"), row.alias("_row"))
    file = F.coalesce(F.col("_file"), F.raise_error(F.concat(F.lit("no file named "), F.col("_path"))).cast("int"))
    pos = F.concat_ws("-", F.lpad(file.cast("string"), 8, "0"), F.lpad(F.col("_start").cast("string"), 14, "0"),
                      F.lpad(F.col("_row").cast("string"), 10, "0"))
    return placed.join(F.broadcast(files), "_path", "left").select(*df.columns, pos.alias(name))


def read_corpus_tolerant(spark: SparkSession, path: str, schema: T.StructType = CORPUS_SCHEMA,
                         with_counts: bool = False):
    """JSON lines; blank lines are dropped by the reader, malformed lines and
    rows without a usable ``_id`` are skipped, missing title/text become ''.

    With ``with_counts`` also returns a one-row frame of skipped counts, from a
    read of its own that also parses the other columns: Spark does not allow a
    query over the corrupt-record column alone.
    """
    s = T.StructType(list(schema.fields) + [T.StructField("_corrupt", T.StringType())])
    raw = (spark.read.schema(s).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt").json(path))
    bad = F.col("_corrupt").isNotNull()
    no_id = F.col("_id").isNull() | (F.col("_id") == "")
    ok = require_id(_with_pos(raw).where(~bad)).select(
        "_id", F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("text", F.lit("")).alias("text"), "pos")
    if not with_counts:
        return ok
    counts = raw.agg(F.sum(bad.cast("long")).alias("malformed"),
                     F.sum((~bad & no_id).cast("long")).alias("missing_id"),
                     F.sum((~bad & ~no_id).cast("long")).alias("kept"))
    return ok, counts


def read_queries_strict(spark: SparkSession, path: str,
                        schema: T.StructType = QUERY_SCHEMA) -> DataFrame:
    """JSON lines; a malformed line fails the job (``FAILFAST``)."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return _with_pos(df).drop("metadata")


def read_filtered_queries(spark: SparkSession, path: str) -> DataFrame:
    """Filtered queries: ``_id, text, corpus-id`` (list of ids)."""
    s = T.StructType([T.StructField("_id", T.StringType()), T.StructField("text", T.StringType()),
                      T.StructField("corpus-id", T.ArrayType(T.StringType()))])
    return _with_pos(spark.read.schema(s).option("mode", "FAILFAST").json(path))


def read_docs_capped(spark: SparkSession, path: str, max_docs: int | None = None) -> DataFrame:
    """First ``max_docs`` **physical lines** (blank lines use up the cap and
    are then dropped); text = ``title + ' ' + text``. ``None`` or 0: no cap."""
    lines = _with_pos(spark.read.text(path), "line")
    if max_docs:
        lines = first_rows(lines, max_docs, ["line"])
    lines = lines.where(_clean("value") != "")
    parsed = lines.select("line", F.from_json("value", CORPUS_SCHEMA,
                                              {"mode": "FAILFAST"}).alias("d"))
    return parsed.select(
        F.col("line").alias("pos"),
        F.concat(F.coalesce("d.title", F.lit("")), F.lit(" "),
                 F.coalesce("d.text", F.lit(""))).alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated judgments with a header; every row counts as relevant
    (any score is ignored)."""
    df = (spark.read.option("sep", "\t").option("header", True).schema(QRELS_SCHEMA).csv(path))
    return _with_pos(df.select(F.col("query-id").alias("query_id"),
                               F.col("corpus-id").alias("doc_id")))


def read_corpus_text(spark: SparkSession, path: str) -> DataFrame:
    """A text file as lines, each with its newline put back (the reference
    reads the whole file as one string)."""
    df = spark.read.text(path)
    return _with_pos(df.select(F.concat("value", F.lit("\n")).alias("text")))


def write_filtered_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; null fields are written (``ignoreNullFields=false``)."""
    df.drop("pos").write.mode(mode).option("ignoreNullFields", False).json(path)


def dump_corpus_text(corpus: DataFrame, path: str, n_docs: int | None = None,
                     text: str = "text", pos: str = "pos") -> None:
    """First ``n_docs`` texts by position (all when None), newlines inside a
    text replaced by a space, one text per line."""
    src = corpus
    if n_docs:
        src = first_rows(corpus.select(pos, text), n_docs, [pos])
    src.select(flatten_newlines(text).alias("value")).write.mode("overwrite").text(path)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path, in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def embedding_table_write(vectors: DataFrame, path: str, model: str, dim: int,
                          mode: str = "overwrite", id_col: str = "id",
                          unique: bool = True) -> None:
    """Parquet table partitioned by ``model``. ``overwrite`` replaces only
    this model's partition (dynamic partition overwrite); ``append`` adds rows.
    Every vector must have width ``dim``; ids must be unique unless
    ``unique=False``, with ``append`` also against the rows of the model that the
    table holds. Vectors are stored single precision."""
    checked = vectors.withColumn(
        "embedding", F.when(F.size("embedding") == dim, F.col("embedding").cast("array<float>"))
        .otherwise(F.raise_error(F.lit(f"embedding width is not {dim}"))))
    if unique:
        ids = vectors.select(F.col(id_col).cast("string").alias("_id"))
        if mode == "append" and _exists(vectors.sparkSession, path):
            held = vectors.sparkSession.read.parquet(path)
            ids = ids.unionByName(held.where(F.col("model") == model).select(F.col(id_col).cast("string").alias("_id")))
        if not ids.groupBy("_id").count().where(F.col("count") > 1).isEmpty():
            raise ValueError(f"duplicate {id_col} in embedding table for {model}")
    (checked.withColumn("model", F.lit(model))
     .write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("model").parquet(path))


def embedding_csv_write(vectors: DataFrame, path: str, id_col: str = "id",
                        clean: bool = True) -> None:
    """CSV with header ``id,title,text,embedding``; the vector as JSON text."""
    cols = [F.col(id_col).alias("id"),
            (_clean("title") if clean else F.col("title")).alias("title"),
            (_clean("text") if clean else F.col("text")).alias("text"),
            # widen to double first: a float vector prints as Python's list dump
            # of its float32 values does (0.1 -> 0.10000000149011612)
            F.to_json(F.col("embedding").cast("array<double>")).alias("embedding")]
    (vectors.select(*cols).write.mode("overwrite").option("header", True)
     .option("escape", '"').csv(path))


def metrics_csv_write(metrics: DataFrame, path: str, ks=(1, 5, 10, 15)) -> None:
    """One row per model; scores with 4 decimals, times with 2 (formatting
    only at the sink)."""
    cols = [F.col("model"), F.col("num_queries"), F.format_string("%.4f", "mrr").alias("mrr")]
    for c in ("avg_embedding_ms", "avg_retrieval_ms", "avg_total_ms"):
        if c in metrics.columns:
            cols.append(F.format_string("%.2f", c).alias(c))
    cols += [F.format_string("%.4f", f"recall_at_{k}").alias(f"recall@{k}") for k in ks]
    cols += [F.format_string("%.4f", f"precision_at_{k}").alias(f"precision@{k}") for k in ks]
    metrics.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def token_stats_csv_write(stats: DataFrame, path: str) -> None:
    """The tokenizer comparison table; floats with 3 decimals."""
    f3 = lambda c: F.format_string("%.3f", c).alias(c)
    cols = [F.col("tokenizer"), F.col("vocab_size"), F.col("unique_tokens_used"),
            F.format_string("%.2f%%", "vocab_utilization").alias("vocab_utilization"),
            f3("avg_tokens_per_doc"), f3("median_tokens_per_doc"), f3("avg_tokens_per_word"),
            f3("avg_tokens_per_char"), f3("avg_tokens_per_byte"), f3("compression_ratio")]
    stats.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def vocab_dump(vocab: DataFrame, path: str) -> None:
    """``id<TAB>bytes`` lines sorted by id (bytes as hex)."""
    (vocab.orderBy("token_id").select(F.col("token_id"), F.hex("bytes").alias("bytes"))
     .coalesce(1).write.mode("overwrite").option("sep", "\t").csv(path))


def embedding_content(df: DataFrame, clean: bool = False) -> DataFrame:
    """Adds ``content`` = ``"{title}: {text}"`` (cleaned when ``clean``)."""
    c = content_for_embedding("title", "text")
    return df.withColumn("content", _clean(c) if clean else c)
