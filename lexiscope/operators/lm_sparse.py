"""Text from a bigram model of a large vocabulary.

The dense form ships a V x V table; here each context keeps the tokens seen behind
it, and the tokens never seen, all equally likely, are not written out: the j-th
of them follows from the seen ids in order. A step brings the sequences whose last
token is a context together with that context's row, in one shuffle, and draws in
the task. Contexts that many sequences wait at are sent to several tasks. What is
drawn is that of the dense form: the same order of tokens, the same numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Sequences that meet a context in one task.
WAITING = 20_000


class Context:
    """The tokens that may follow, most likely first, equal ones by id."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, vocab_size: int, temperature: float, top_k: int | None, alpha: float):
        order = np.lexsort((tokens, -counts))
        share = 1.0 / (float(counts.sum()) + alpha * vocab_size)
        self.tokens, self.seen = tokens[order], np.sort(tokens)
        size = min(top_k or vocab_size, vocab_size)
        weight = ((counts[order] + alpha) * share) ** (1.0 / temperature)
        self.sums = np.cumsum(weight[:size])
        self.rest = (alpha * share) ** (1.0 / temperature)
        self.unseen = max(0, size - len(tokens))  # of them may be drawn
        self.total = (self.sums[-1] if len(self.sums) else 0.0) + self.unseen * self.rest

    def draw(self, u: np.ndarray) -> np.ndarray:
        x = u * self.total
        at = np.searchsorted(self.sums, x, side="right")
        out = self.tokens[np.minimum(at, max(0, len(self.tokens) - 1))] if len(self.tokens) else np.zeros(len(u), np.int64)
        late = at >= len(self.sums)
        if late.any() and self.unseen:
            before = self.sums[-1] if len(self.sums) else 0.0
            j = np.minimum(((x[late] - before) / self.rest).astype(np.int64), self.unseen - 1)
            # the j-th id that is not seen: each seen id not above it moves it on by one
            gaps = self.seen - np.arange(len(self.seen))
            out[late] = j + np.searchsorted(gaps, j, side="right")
        elif late.any():
            out[late] = self.tokens[len(self.sums) - 1]
        return out


def context_table(counts: DataFrame) -> DataFrame:
    """``ctx, toks, cnts``: a row for each context, bounded by the vocabulary."""
    held = counts.groupBy("ctx").agg(F.array_sort(F.collect_list(F.struct(F.col("tok").cast("int").alias("tok"), F.col("cnt").cast("long").alias("cnt")))).alias("l"))
    return held.select(F.col("ctx").cast("int").alias("ctx"), F.col("l.tok").alias("toks"), F.col("l.cnt").alias("cnts"))


def lm_generate_sparse(seeds: DataFrame, counts: DataFrame, vocab_size: int, *, tokens: str = "tokens", key: str = "doc_id",
                       length: int = 50, new_tokens: int | None = None, temperature: float = 1.0, top_k: int | None = None,
                       alpha: float = 0.1, seed: int = 42) -> DataFrame:
    """As ``lm_generate_batch``, for vocabularies of any size. Every step is
    written to the checkpoint folder, so a lost task repeats one step."""
    from .lm import _uniform

    checkpoint_dir(seeds.sparkSession)
    contexts = context_table(counts).checkpoint()
    start = F.coalesce(F.col(tokens).cast("array<int>"), F.expr("array()").cast("array<int>"))
    want = F.lit(new_tokens) if new_tokens is not None else F.greatest(F.lit(length) - F.size(start), F.lit(0))
    state = seeds.select(F.col(key).alias("key"), F.xxhash64(key).alias("hash"), start.alias("generated"), want.cast("int").alias("left"),
                         F.coalesce(F.try_element_at(start, F.lit(-1)), F.lit(0)).alias("last")).checkpoint()
    steps = state.agg(F.max("left").alias("n")).first()["n"] or 0

    def drawer(step):
        def draw(batches):
            now, context = None, None
            for b in batches:
                last, side = b.column("last").to_numpy(), b.column("side").to_numpy()
                edges = np.flatnonzero((last[1:] != last[:-1]) | (side[1:] != side[:-1])) + 1
                for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(last)], strict=True):
                    if e == s:
                        continue
                    if now != last[s]:
                        now, context = last[s], None
                    if side[s] == 0:
                        context = Context(np.asarray(b.column("toks")[s].values, np.int64), np.asarray(b.column("cnts")[s].values, np.float64),
                                          vocab_size, temperature, top_k, alpha)
                        continue
                    if context is None:
                        context = Context(np.zeros(0, np.int64), np.zeros(0), vocab_size, temperature, top_k, alpha)
                    part = b.slice(s, e - s)
                    drawn = context.draw(_uniform(seed, np.ascontiguousarray(part.column("hash").to_numpy()), step))
                    yield pa.RecordBatch.from_arrays([part.column("key"), part.column("hash"), part.column("generated"), part.column("left"),
                                                      pa.array(drawn.astype(np.int32))], names=["key", "hash", "generated", "left", "drawn"])

        return draw

    kind = state.schema["key"].dataType
    schema = state.drop("last").schema.add("drawn", "integer")
    for step in range(steps):
        going = state.where(F.col("left") > 0)
        sizes = going.groupBy("last").agg(F.ceil(F.count("*") / F.lit(WAITING)).cast("int").alias("parts"))
        none = lambda name, t: F.lit(None).cast(t).alias(name)
        waiting = going.join(sizes.hint("shuffle_hash"), "last").select(
            "last", F.pmod("hash", F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), "key", "hash", "generated", "left",
            none("toks", "array<int>"), none("cnts", "array<long>"))
        known = contexts.join(sizes.withColumnRenamed("last", "ctx").hint("shuffle_hash"), "ctx").select(
            F.col("ctx").alias("last"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"),
            none("key", kind), F.lit(0).cast("long").alias("hash"), none("generated", "array<int>"), F.lit(0).alias("left"), "toks", "cnts")
        met = waiting.unionByName(known).repartition("last", "part").sortWithinPartitions("last", "part", "side") \
            .select("last", "side", "key", "hash", "generated", "left", "toks", "cnts")
        moved = met.mapInArrow(drawer(step), schema).select(
            "key", "hash", F.concat("generated", F.array("drawn")).alias("generated"), (F.col("left") - 1).alias("left"), F.col("drawn").alias("last"))
        state = moved.unionByName(state.where(F.col("left") <= 0)).checkpoint()
    return state.select(F.col("key").alias(key), "generated")
