"""N-gram tables of order 1 to 3, interpolated models, and scoring by windows.

A table of order n has the columns ``t1 .. tn`` (the last is the predicted
token) and ``cnt``. Grams are counted within each Arrow batch before the shuffle,
so a gram that fills a third of the corpus is a row a batch.

The interpolated model mixes the relative frequencies of all orders with the
uniform distribution,

    p(t | a b) = w3 f(t | a b) + w2 f(t | b) + w1 f(t) + w0 / V,

where a context never seen in training takes the frequency of the next shorter
one. The weights are fitted on held-out grams by expectation-maximisation: the
frequencies of each distinct gram are joined once, and a step is one aggregate
over them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parts import PART_SIZE, batch_parts, list_sizes
from ..session import checkpoint_dir

BITS = 21  # of a token id
MAX_ORDER = 3
STEPS = 10
SLICE_TOKENS = PART_SIZE  # counted at once in a task


def window_counts(n: np.ndarray, at: np.ndarray, seq_length: int, stride: int) -> np.ndarray:
    """How many windows predict the token at place ``at`` (from 0) of a sequence of
    ``n`` tokens: windows start at 0, stride, ... below n - seq_length - 1 and
    predict the ``seq_length`` tokens behind their first."""
    windows = np.maximum(0, -(-(n - seq_length - 1) // stride))
    last = np.minimum(windows - 1, (at - 1) // stride)
    first = np.maximum(0, -((seq_length - at) // stride))
    return np.where(at >= 1, np.maximum(0, last - first + 1), 0)


def gram_counts(seqs: DataFrame, order: int, tokens: str = "tokens", windows: tuple[int, int] | None = None) -> DataFrame:
    """``t1 .. tn, cnt`` over all places of all sequences. With
    ``windows=(seq_length, stride)`` a place counts once for each of the windows
    of ``lm_windows`` that predict it, without making them. Null sequences have no
    grams; ids from 2**21 on are an error."""
    if not 1 <= order <= MAX_ORDER:
        raise ValueError(f"orders from 1 to {MAX_ORDER}")

    def count(batches):
        for batch in batches:
            for part in batch_parts(batch, "tokens", SLICE_TOKENS):
                yield from some(part.column(0))

    def some(column):
        column = column.filter(column.is_valid())
        v = np.asarray(column.flatten(), dtype=np.int64)
        sizes = list_sizes(column)
        if len(v) and (v.max() >= 1 << BITS or v.min() < 0):
            raise ValueError(f"a token id does not fit {BITS} bits")
        n = np.repeat(sizes, sizes)
        at = np.arange(len(v)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        held = np.flatnonzero(at >= order - 1)
        code = np.zeros(len(held), np.int64)
        for k in range(order - 1, -1, -1):
            code = code << BITS | v[held - k]
        weight = np.ones(len(held), np.int64) if windows is None else window_counts(n[held], at[held], *windows)
        held = weight > 0
        codes, place = np.unique(code[held], return_inverse=True)
        sums = np.zeros(len(codes), np.int64)
        np.add.at(sums, place, weight[held])
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], names=["code", "cnt"])

    held = F.col(tokens)
    if seqs.schema[tokens].dataType.elementType not in (T.IntegerType(), T.LongType()):
        held = held.cast("array<long>")
    part = seqs.select(held.alias("tokens")).mapInArrow(count, "code long, cnt long")
    total = part.groupBy("code").agg(F.sum("cnt").alias("cnt"))
    ids = [F.shiftrightunsigned("code", BITS * (order - 1 - k)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias(f"t{k + 1}")
           for k in range(order)]
    return total.select(*ids, "cnt")


class Interpolated:
    """Relative frequencies of all orders and their weights (``weights[k]`` is that
    of order k, ``weights[0]`` of the uniform distribution)."""

    def __init__(self, tables: dict[int, DataFrame], vocab_size: int, weights: list[float] | None = None):
        self.tables, self.vocab_size = tables, vocab_size
        self.order = max(tables)
        self.weights = weights or [1 / (self.order + 1)] * (self.order + 1)

    @classmethod
    def train(cls, seqs: DataFrame, order: int, vocab_size: int, tokens: str = "tokens") -> Interpolated:
        """Tables of every order up to ``order``, written once to the checkpoint
        folder."""
        checkpoint_dir(seqs.sparkSession)
        return cls({k: gram_counts(seqs, k, tokens).checkpoint() for k in range(1, order + 1)}, vocab_size)

    def frequencies(self, grams: DataFrame) -> DataFrame:
        """``n, f1 .. fn`` for each gram of a table of this order."""
        order = self.order
        out = grams.withColumnRenamed("cnt", "n")
        total = self.tables[1].agg(F.sum("cnt").alias("n")).first()["n"] or 0
        for k in range(1, order + 1):
            names = [f"t{j}" for j in range(order - k + 1, order + 1)]  # the gram's last k tokens
            table = self.tables[k].select(*[F.col(f"t{j + 1}").alias(name) for j, name in enumerate(names)], F.col("cnt").alias(f"c{k}"))
            out = out.join(table, names, "left")
            if k > 1:
                out = out.join(table.groupBy(*names[:-1]).agg(F.sum(f"c{k}").alias(f"s{k}")), names[:-1], "left")
        f = F.coalesce("c1", F.lit(0)) / F.lit(total) if total else F.lit(1 / self.vocab_size)
        out = out.withColumn("f1", f)
        for k in range(2, order + 1):
            out = out.withColumn(f"f{k}", F.when(F.col(f"s{k}").isNull(), F.col(f"f{k - 1}")).otherwise(F.coalesce(f"c{k}", F.lit(0)) / F.col(f"s{k}")))
        return out.select("n", *[f"f{k}" for k in range(1, order + 1)])

    def _mixed(self) -> list:
        parts = [F.lit(self.weights[0] / self.vocab_size)]
        return parts + [F.lit(self.weights[k]) * F.col(f"f{k}") for k in range(1, self.order + 1)]

    def fit(self, held_out: DataFrame, steps: int = STEPS) -> Interpolated:
        """Weights after ``steps`` steps of expectation-maximisation from equal
        ones, on a table of held-out grams; unchanged if it is empty."""
        known = self.frequencies(held_out).checkpoint()
        out = Interpolated(self.tables, self.vocab_size)
        for _ in range(steps):
            parts = out._mixed()
            whole = parts[0]
            for p in parts[1:]:
                whole = whole + p
            row = known.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * p / whole).alias(f"w{k}") for k, p in enumerate(parts)]).first()
            if not row["n"]:
                break
            out = Interpolated(self.tables, self.vocab_size, [row[f"w{k}"] / row["n"] for k in range(out.order + 1)])
        return out

    def score(self, grams: DataFrame) -> DataFrame:
        """One row: ``n_pairs, loss, perplexity, bits_per_token, sum_nll`` of a table
        of grams."""
        parts = self._mixed()
        whole = parts[0]
        for p in parts[1:]:
            whole = whole + p
        res = self.frequencies(grams).agg(F.sum("n").alias("n_pairs"), F.sum(F.col("n") * -F.log(whole)).alias("sum_nll"))
        res = res.select("n_pairs", (F.col("sum_nll") / F.col("n_pairs")).alias("loss"), "sum_nll")
        return res.select("n_pairs", "loss", F.exp("loss").alias("perplexity"), (F.col("loss") / F.lit(math.log(2.0))).alias("bits_per_token"), "sum_nll")
