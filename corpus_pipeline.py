"""Corpus preparation: five stages over ``documents``, each an operator of
``lexiscope.llm``.

language ID -> near duplicates -> substring dedup -> benchmark decontamination
-> packing. Each stage is a function (spark, docs, sf_dir) -> DataFrame; its
result is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``documents``; ``n_chars`` stays the length of
the original text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm import decontaminate, jaccard_join, langid, packing, substring_dedup
from lexiscope.llm.arrow_rows import col, free_prefix, table
from lexiscope.session import checkpoint_dir, ship_package


def _columns(docs: DataFrame, text=None) -> list:
    """The columns of ``docs``, whatever their names, with ``text`` for the text."""
    return [text.alias("text") if c == "text" and text is not None else col(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, or with no letter of those that name their
    language: in none of the languages learned. A low score alone drops nothing,
    as it falls with the length of a text and the size of its alphabet. The
    language named in ``lang`` is not overwritten.

    Null and empty texts go; repeated rows go or stay alike; a long text is read
    as a whole; an empty table stays empty; other columns, whatever their names,
    come through as they are."""
    ship_package(spark)
    own = free_prefix(docs.columns)
    scored = langid.identify(docs, langid.learn_profiles(docs), prefix=own, letters=langid.learn_letters(docs))
    return scored.where(col(own + "lang_pred") != langid.UNDETERMINED).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of the Jaccard join, the first by id and
    text hash.

    Rows alike in id and text are one document, of which one row stays.
    Documents without words, null texts included, stay; rows without id rank
    last. An empty table stays empty; other columns, whatever their names, come
    through as they are."""
    ship_package(spark)
    groups = jaccard_join.jaccard_groups(docs.select("doc_id", "text"))
    own = free_prefix(docs.columns)
    keys = [own + "id", own + "no_id", own + "hash"]
    first = groups.where("doc_id <=> class_id and text_hash = class_hash").select(
        F.coalesce("doc_id", F.lit(0)).alias(keys[0]), F.col("doc_id").isNull().alias(keys[1]), F.col("text_hash").alias(keys[2]))
    keyed = docs.select(*_columns(docs), F.coalesce("doc_id", F.lit(0)).alias(keys[0]), F.col("doc_id").isNull().alias(keys[1]),
                        F.xxhash64("text").alias(keys[2]))
    return keyed.join(first, keys, "left_semi").dropDuplicates(keys).select(*_columns(docs))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines and passages that an earlier document has; drop what is left
    without text.

    A null or empty text stays. Rows alike in id and text are one document and
    come out alike; rows without id rank last. A long text is cut as a whole.
    An empty table stays empty; other columns, whatever their names, come through
    as they are."""
    ship_package(spark)
    own = free_prefix(docs.columns)
    cut = substring_dedup.dedup_units(docs, prefix=own)
    text = col(own + "kept_text")
    return cut.where((col(own + "n_removed") == 0) | (F.trim(text) != "")).select(*_columns(docs, text))


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of ``benchmark``; drop documents that were nothing else.

    Null and empty texts stay; repeated rows come out alike; a long text is
    scanned as a whole; an empty table stays empty, and an empty benchmark cuts
    nothing; other columns, whatever their names, come through as they are."""
    ship_package(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their ids, sequence and offset: what a
    model trains on.

    A null or empty text is a piece of the end id; repeated rows give a piece
    each; a long text is cut into pieces; an empty table gives none. Of other
    columns nothing is read."""
    ship_package(spark)
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", remove_repeated_passages),
    ("benchmark decontamination", remove_benchmark_passages),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot express the stages; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the packed pieces with their token ids. The
    tables between the stages, named by number and stage, stay in a folder of
    this run under ``spark.checkpoint.dir``."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{base}/{k}-{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
