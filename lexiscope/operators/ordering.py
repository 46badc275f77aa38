"""Order-dependent operators without a single-task window.

A DataFrame has no order, so "first N" and "split by position" need dense
positions. ``number_rows`` gives them the way ``zipWithIndex`` does, with
DataFrame operators only: range-partition and sort by the order keys, count
rows per partition (one small aggregate, at most one row per partition),
turn the counts into offsets and add each row's index inside its partition.
No step holds more than one partition's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def number_rows(df: DataFrame, order_cols: list[str], name: str = "pos",
                num_partitions: int | None = None, with_total: bool = False) -> DataFrame:
    """Add a dense 0-based position by ``order_cols`` (which must be unique).

    The sorted rows are checkpointed, so the counting pass and the numbering
    pass see the same partitions, also after an executor is lost; callers number
    keys, not whole rows. ``with_total`` adds ``_total`` (row count).
    """
    spark = df.sparkSession
    n_parts = num_partitions or max(spark.sparkContext.defaultParallelism,
                                    int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_df = (df.repartitionByRange(n_parts, *order_cols)
                 .sortWithinPartitions(*order_cols)
                 .withColumn("_pid", F.spark_partition_id())
                 .withColumn("_mid", F.monotonically_increasing_id()))
    sorted_df = sorted_df.withColumn(
        "_lid", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    checkpoint_dir(spark)
    sorted_df = sorted_df.checkpoint()
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # at most one row per partition: bounded by the partition count, so the
    # running sum and the broadcast below stay small at any data size
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    out = (sorted_df.join(F.broadcast(offsets), "_pid")
           .withColumn(name, (F.col("_off") + F.col("_lid")).cast("long"))
           .drop("_pid", "_mid", "_lid", "_off"))
    return out if with_total else out.drop("_total")


def keys_at(df: DataFrame, order_cols: list[str], ranks) -> tuple[int, dict[int, tuple]]:
    """(rows, {rank: order key}) for the 0-based ``ranks`` among the rows of
    ``df`` in order, where they exist. Only the keys are sorted and numbered; a
    handful of rows come back. ``ranks(total)`` names the ranks."""
    total = df.count()
    wanted = sorted({r for r in ranks(total) if 0 <= r < total})
    if not wanted:
        return total, {}
    numbered = number_rows(df.select(*order_cols), order_cols, name="_rank")
    rows = numbered.where(F.col("_rank").isin(wanted)).collect()
    return total, {r["_rank"]: tuple(r[c] for c in order_cols) for r in rows}


def before_key(order_cols: list, key: tuple | None):
    """Whether a row's order key is smaller than ``key`` (true without one): a
    native comparison, so the rows themselves need no join or shuffle."""
    if key is None:
        return F.lit(True)
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)]) \
        < F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(key)])


def split_by_position(df: DataFrame, ratio: float = 0.5, pos: str = "pos",
                      id_col: str | None = None) -> DataFrame:
    """First ``int(n * ratio)`` rows by ``pos`` are ``validation``, the rest
    ``test`` (only test is scored by the evaluation). The key at the cut is
    looked up, and each row is compared with it."""
    order = [pos] + ([id_col] if id_col and id_col != pos else [])
    cut = lambda n: int(n * ratio)
    total, keys = keys_at(df.select(*order), order, lambda n: [cut(n)])
    return df.withColumn("split", F.when(before_key(order, keys.get(cut(total))), "validation").otherwise("test"))


def split_80_10_10(df: DataFrame, id_col: str, seed: int = 42,
                   fractions=(0.8, 0.1)) -> DataFrame:
    """Exact-size split: order by ``md5(seed || id)``, first ``int(0.8 n)``
    train, next ``int(0.1 n)`` validation, rest test. ``id_col`` must be
    unique. Only the keys are sorted; the rows are compared with the two keys at
    the cuts."""
    md5 = F.md5(F.concat(F.lit(str(seed)), F.col(id_col).cast("string")))
    first = lambda n: int(n * fractions[0])
    second = lambda n: int(n * fractions[0]) + int(n * fractions[1])
    total, keys = keys_at(df.select(md5.alias("_key"), id_col), ["_key", id_col], lambda n: [first(n), second(n)])
    order = [md5, F.col(id_col)]
    return df.withColumn("split", F.when(before_key(order, keys.get(first(total))), "train")
                         .when(before_key(order, keys.get(second(total))), "validation").otherwise("test"))


def first_rows(df: DataFrame, n: int, order_cols: list[str]) -> DataFrame:
    """The first ``n`` rows by ``order_cols``, found by the key at the cut."""
    _, keys = keys_at(df, order_cols, lambda total: [n])
    return df.where(before_key(order_cols, keys.get(n))) if n > 0 else df.limit(0)
