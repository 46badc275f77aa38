"""Language-model data and scoring.

The reference trains neural next-token models on token windows. The
tabular job around them stays (windows, exact-size split, loss, perplexity,
bits per token / character); the model becomes a count-based bigram model
with add-alpha smoothing, which is a Spark aggregation.

Pairs are aggregated to ``(ctx, tok, n)`` before any join, so joins only see
at most V x V rows (V = vocabulary size).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import types as T
from pyspark.sql import functions as F

from .tokstats import token_pair_counts

LN2 = math.log(2.0)


def lm_windows(seqs: DataFrame, tokens: str = "tokens", seq_length: int = 128,
               stride: int = 64, include_last: bool = False) -> DataFrame:
    """Windows of ``seq_length`` tokens every ``stride`` tokens; target =
    input shifted by one. Starts run over ``0, stride, ... < n - L - 1`` as in
    the reference (a document needs at least L + 2 tokens);
    ``include_last=True`` also allows the start ``n - L - 1``."""
    n = F.size(tokens)
    last = n - seq_length - (0 if include_last else 1)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)),
                      lambda i: i < last if not include_last else i <= last)
    starts = F.when(last > (-1 if include_last else 0), starts)
    # the windows alone are exploded: with the tokens beside them each window
    # would copy its whole document. explode_outer: a plain explode makes Spark
    # add a filter on its input, which would evaluate an upstream Python
    # tokenizer a second time
    held = F.transform(starts, lambda i: F.struct(i.alias("start"), F.slice(tokens, i + 1, seq_length + 1).alias("span")))
    others = [c for c in seqs.columns if c != tokens]
    ex = seqs.select(*others, F.explode_outer(held).alias("_w")).where(F.col("_w").isNotNull())
    return ex.select(*others, "_w.start", F.slice("_w.span", 1, seq_length).alias("input"),
                     F.slice("_w.span", 2, seq_length).alias("target"))


def ngram_counts(seqs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Bigram counts ``ctx, tok, cnt``, combined per Arrow batch and per task."""
    return token_pair_counts(seqs, tokens).withColumnsRenamed({"left": "ctx", "right": "tok"})


def ngram_prob(counts: DataFrame, vocab_size: int, alpha: float = 0.1) -> DataFrame:
    """Add-alpha probabilities of the observed pairs: ``ctx, tok, p`` and
    ``p_unseen``, that of each token never seen behind the context."""
    ctx = counts.groupBy("ctx").agg(F.sum("cnt").alias("ctx_cnt"))
    total = F.col("ctx_cnt") + alpha * vocab_size
    return counts.join(ctx, "ctx").select("ctx", "tok", ((F.col("cnt") + alpha) / total).alias("p"),
                                          (F.lit(alpha) / total).alias("p_unseen"))


def lm_eval(train_counts: DataFrame, eval_counts: DataFrame, vocab_size: int,
            alpha: float = 0.1, chars: DataFrame | None = None) -> DataFrame:
    """Loss (mean negative log-likelihood per predicted token), perplexity,
    bits per token (= loss / ln 2, the reference's coded value) and, given the
    character count of the evaluated text, bits per character."""
    agg = eval_counts.withColumnRenamed("cnt", "n")
    ctx = train_counts.groupBy("ctx").agg(F.sum("cnt").alias("ctx_cnt"))
    j = (agg.join(train_counts, ["ctx", "tok"], "left")
         .join(ctx, "ctx", "left")
         .select("n", F.coalesce("cnt", F.lit(0)).alias("c"),
                 F.coalesce("ctx_cnt", F.lit(0)).alias("cc")))
    nll = -F.log((F.col("c") + alpha) / (F.col("cc") + alpha * vocab_size))
    res = j.agg(F.sum("n").alias("n_pairs"), F.sum(F.col("n") * nll).alias("sum_nll"))
    res = res.select("n_pairs", (F.col("sum_nll") / F.col("n_pairs")).alias("loss"), "sum_nll")
    res = res.select("n_pairs", "loss", F.exp("loss").alias("perplexity"),
                     (F.col("loss") / F.lit(LN2)).alias("bits_per_token"), "sum_nll")
    if chars is not None:
        res = _with_chars(res, chars)
    return res.drop("sum_nll")


def _with_chars(res: DataFrame, chars: DataFrame) -> DataFrame:
    """Put the character total next to the one-row result: both are global
    aggregates, stacked and folded by one more aggregate (no join)."""
    cols = res.columns
    a = res.withColumn("_chars", F.lit(None).cast("long"))
    b = chars.agg(F.sum("n_chars").cast("long").alias("_chars"))
    for c in cols:
        b = b.withColumn(c, F.lit(None).cast(res.schema[c].dataType))
    both = a.unionByName(b)
    out = both.agg(*[F.max(c).alias(c) for c in cols], F.max("_chars").alias("_chars"))
    return out.withColumn("bits_per_char",
                          F.col("sum_nll") / (F.lit(LN2) * F.col("_chars"))).drop("_chars")


def lm_select(train_counts: DataFrame, eval_counts: DataFrame, vocab_size: int,
              alphas=(0.01, 0.1, 1.0)) -> DataFrame:
    """Validation loss for every smoothing value in one job and the value
    with the lowest loss (strict: the first of equal losses in grid order)."""
    agg = eval_counts.withColumnRenamed("cnt", "n")
    ctx = train_counts.groupBy("ctx").agg(F.sum("cnt").alias("ctx_cnt"))
    j = (agg.join(train_counts, ["ctx", "tok"], "left").join(ctx, "ctx", "left")
         .select("n", F.coalesce("cnt", F.lit(0)).alias("c"),
                 F.coalesce("ctx_cnt", F.lit(0)).alias("cc")))
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(a)).alias("alpha"))
                     for i, a in enumerate(alphas)])
    g = j.select("*", F.explode(grid).alias("_g"))
    a = F.col("_g.alpha")
    nll = -F.log((F.col("c") + a) / (F.col("cc") + a * vocab_size))
    per = g.groupBy(F.col("_g.i").alias("grid_idx"), a.alias("alpha")).agg(
        (F.sum(F.col("n") * nll) / F.sum("n")).alias("loss"))
    # one row per grid value: the window holds len(alphas) rows
    return per.withColumn("best_alpha", F.min_by(F.col("alpha"), F.struct("loss", "grid_idx"))
                          .over(Window.partitionBy()))


def oov_rate(train_words: DataFrame, test_words: DataFrame, word: str = "word") -> DataFrame:
    """Share of test word occurrences whose word never occurs in training."""
    vocab = train_words.select(word).distinct()
    test = test_words.groupBy(word).agg(F.count(F.lit(1)).alias("n"))
    flagged = test.join(vocab.withColumn("_seen", F.lit(True)), word, "left")
    return flagged.agg(
        F.sum(F.when(F.col("_seen").isNull(), F.col("n")).otherwise(0)).cast("long")
        .alias("oov_tokens"),
        F.sum("n").cast("long").alias("test_tokens")).withColumn(
        "oov_rate", F.col("oov_tokens") / F.col("test_tokens"))


# Cells of the probability table that is shipped to the executors.
MAX_TABLE_CELLS = 16_000_000


def _uniform(seed: int, key: np.ndarray, step: int) -> np.ndarray:
    """A number in [0, 1) for each key, fixed by (seed, key, step)."""
    with np.errstate(over="ignore"):
        x = key.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + step * 0xD1342543DE82EF95) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def next_token_table(counts: DataFrame, vocab_size: int, temperature: float = 1.0,
                     top_k: int | None = None, alpha: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """For each context the tokens by falling probability (equal ones by id),
    only the first ``top_k`` of them, and the running sums of their share.
    Raises before anything is collected if the table would be too large."""
    if vocab_size * vocab_size > MAX_TABLE_CELLS:
        raise ValueError(f"a vocabulary of {vocab_size} is too large for a bigram table on every executor")
    p = np.full((vocab_size, vocab_size), alpha)
    t = counts.select(F.col("ctx").cast("int"), F.col("tok").cast("int"), F.col("cnt").cast("double")).toArrow()
    p[t["ctx"].to_numpy(), t["tok"].to_numpy()] += t["cnt"].to_numpy()  # at most V x V rows
    p = (p / p.sum(axis=1, keepdims=True)) ** (1.0 / temperature)
    order = np.argsort(-p, axis=1, kind="stable")[:, :top_k or vocab_size]
    sums = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
    return order.astype(np.int32), sums / sums[:, -1:]


def lm_generate_batch(seeds: DataFrame, counts: DataFrame, vocab_size: int, *,
                      tokens: str = "tokens", key: str = "doc_id", length: int = 50,
                      new_tokens: int | None = None, temperature: float = 1.0, top_k: int | None = None,
                      alpha: float = 0.1, seed: int = 42) -> DataFrame:
    """Extend every seed sequence by tokens of the smoothed bigram model to
    ``length`` tokens in all (a longer seed stays as it is), or by
    ``new_tokens`` where given. The next token is drawn from
    p(. | last)^(1/temperature), among the ``top_k`` most likely when given,
    with numbers fixed by (seed, key, step): reruns and lost tasks give the same
    text. An empty or null seed goes on from token 0.

    Up to ``MAX_TABLE_CELLS`` the probability table of V x V cells is shipped with
    the function, and a batch of seeds takes each step together; a larger
    vocabulary goes the way of ``lm_generate_sparse``, to the same text.
    """
    if vocab_size * vocab_size > MAX_TABLE_CELLS:
        from .lm_sparse import lm_generate_sparse

        return lm_generate_sparse(seeds, counts, vocab_size, tokens=tokens, key=key, length=length, new_tokens=new_tokens,
                                  temperature=temperature, top_k=top_k, alpha=alpha, seed=seed)
    shared = seeds.sparkSession.sparkContext.broadcast(next_token_table(counts, vocab_size, temperature, top_k, alpha))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def _gen(ks: pa.Array, seqs: pa.Array) -> pa.Array:
        order, sums = shared.value
        keys = np.ascontiguousarray(ks.to_numpy(zero_copy_only=False), dtype=np.int64)
        out = [list(s or []) for s in seqs.to_pylist()]
        last = np.array([s[-1] if s else 0 for s in out], dtype=np.int64)
        want = np.array([new_tokens if new_tokens is not None else max(0, length - len(s)) for s in out], dtype=np.int64)
        drawn = np.zeros((len(out), int(want.max(initial=0))), dtype=np.int32)
        for step in range(drawn.shape[1]):
            u = _uniform(seed, keys, step)
            pick = np.minimum((sums[last] <= u[:, None]).sum(axis=1), order.shape[1] - 1)
            last = order[last, pick].astype(np.int64)
            drawn[:, step] = last
        lists = [s + drawn[i, :want[i]].tolist() for i, s in enumerate(out)]
        return pa.array(lists, pa.list_(pa.int32()))

    return seeds.select(key, _gen(F.xxhash64(key), F.col(tokens)).alias("generated"))
