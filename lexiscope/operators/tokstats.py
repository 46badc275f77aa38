"""Token statistics per tokenizer: vocabulary use, tokens per document,
tokens per word / character / byte, most frequent tokens, adjacent pairs.

Input is one long frame ``(tokenizer, doc_id, pos, text, tokens)`` holding
every tokenizer's output, so all tokenizers are summarised by a single
``groupBy("tokenizer")`` instead of one job per tokenizer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parts import batch_parts
from ..functions.text import count_bytes, count_characters, count_words


_SHIFT = 21  # pair code = left << 21 | right


def pair_count_arrays(arr: pa.Array, weights: np.ndarray | None = None,
                      order: np.ndarray | None = None) -> dict:
    """Weighted adjacent-pair counts of one list<int> Arrow array as NumPy
    arrays ``left, right, cnt`` (+ ``first_pos, first_idx`` when ``order``
    gives each row's position)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n_rows = len(arr)
    valid = np.asarray(arr.is_valid())
    vals = np.asarray(arr.flatten().fill_null(0), dtype=np.int64)
    offs = np.asarray(arr.offsets, dtype=np.int64)
    offs = offs - offs[0]
    lengths = np.where(valid, np.diff(offs), 0)
    empty = {"left": np.zeros(0, np.int32), "right": np.zeros(0, np.int32),
             "cnt": np.zeros(0, np.int64), "first_pos": np.zeros(0, np.int64),
             "first_idx": np.zeros(0, np.int64)}
    if len(vals) < 2:
        return empty
    row = np.repeat(np.arange(n_rows, dtype=np.int64), lengths)
    ok = row[:-1] == row[1:]
    erow = row[:-1][ok]
    if len(erow) == 0:
        return empty
    w = weights[erow] if weights is not None else None
    v = int(vals.max()) + 1
    if order is None and v * v <= (1 << 22):
        # small id space (e.g. during BPE training): dense counting, linear time
        dense = vals[:-1][ok] * v + vals[1:][ok]
        binc = np.bincount(dense, weights=w, minlength=v * v)
        nz = np.flatnonzero(binc)
        return {"left": (nz // v).astype(np.int32), "right": (nz % v).astype(np.int32),
                "cnt": np.rint(binc[nz]).astype(np.int64)}
    codes = ((vals[:-1] << _SHIFT) | vals[1:])[ok]
    uniq, inv = np.unique(codes, return_inverse=True)
    out = {"left": (uniq >> _SHIFT).astype(np.int32),
           "right": (uniq & ((1 << _SHIFT) - 1)).astype(np.int32),
           "cnt": np.rint(np.bincount(inv, weights=w if w is not None else np.ones(len(codes)),
                                      minlength=len(uniq))).astype(np.int64)}
    if order is not None:
        idx = (np.arange(len(vals), dtype=np.int64) - np.repeat(offs[:-1], lengths))[:-1][ok]
        pos = order[erow]
        o = np.lexsort((idx, pos, inv))
        firsts = o[np.r_[0, np.flatnonzero(np.diff(inv[o])) + 1]]
        out["first_pos"], out["first_idx"] = pos[firsts], idx[firsts]
    return out


def _partial_counts_fn(tokens, group_cols, weight, order, pairs):
    def run(batches):
        for rb in (part for batch in batches for part in batch_parts(batch, tokens)):
            arr = rb.column(tokens)
            n_rows = rb.num_rows
            if n_rows == 0:
                continue
            if pairs and not group_cols:
                w = (np.asarray(rb.column(weight).to_numpy(zero_copy_only=False), dtype=np.float64)
                     if weight else None)
                pos = np.asarray(rb.column(order).to_numpy(zero_copy_only=False), dtype=np.int64) if order else None
                found = pair_count_arrays(arr, w, pos)
                names = ["left", "right", "cnt"] + ["first_pos", "first_idx"] * bool(order)
                yield pa.RecordBatch.from_pydict({c: pa.array(found[c]) for c in names})
                continue
            valid = np.asarray(arr.is_valid())
            vals = np.asarray(arr.flatten().fill_null(0), dtype=np.int64)
            offs = np.asarray(arr.offsets, dtype=np.int64)
            offs = offs - offs[0]
            lengths = np.where(valid, np.diff(offs), 0)
            row = np.repeat(np.arange(n_rows, dtype=np.int64), lengths)
            idx = np.arange(len(vals), dtype=np.int64) - np.repeat(offs[:-1], lengths)
            if pairs:
                ok = row[:-1] == row[1:] if len(vals) > 1 else np.zeros(0, dtype=bool)
                codes = ((vals[:-1] << _SHIFT) | vals[1:])[ok] if len(vals) > 1 else vals[:0]
                erow = row[:-1][ok] if len(vals) > 1 else row[:0]
                eidx = idx[:-1][ok] if len(vals) > 1 else idx[:0]
            else:
                codes, erow, eidx = vals, row, idx
            if len(codes) == 0:
                continue
            if not pairs and weight is None and int(codes.max()) < (1 << 22):
                gvals = {g: rb.column(g).to_pylist() for g in group_cols}
                if all(len(set(x)) == 1 for x in gvals.values()):
                    # one group in this batch (each union branch is one tokenizer)
                    yield from _dense_token_counts(codes, erow, eidx, rb, order,
                                                   {g: x[0] for g, x in gvals.items()})
                    continue
            if group_cols:
                gkeys = pd.MultiIndex.from_arrays(
                    [rb.column(g).to_pandas() for g in group_cols]) if len(group_cols) > 1 \
                    else pd.Index(rb.column(group_cols[0]).to_pandas())
                gcode, guniq = pd.factorize(gkeys)
                key = gcode.astype(np.int64)[erow] * (1 << 42) + codes
            else:
                key = codes
            uniq, inv = np.unique(key, return_inverse=True)
            w = (np.asarray(rb.column(weight).to_numpy(zero_copy_only=False), dtype=np.float64)[erow]
                 if weight else np.ones(len(codes)))
            cnt = np.bincount(inv, weights=w, minlength=len(uniq)).astype(np.int64)
            out = {}
            if group_cols:
                gsel = (uniq >> 42).astype(np.int64)
                if len(group_cols) == 1:
                    out[group_cols[0]] = pa.array(np.asarray(guniq)[gsel])
                else:
                    for j, g in enumerate(group_cols):
                        out[g] = pa.array(np.asarray([t[j] for t in guniq])[gsel])
                code_u = uniq & ((1 << 42) - 1)
            else:
                code_u = uniq
            if pairs:
                out["left"] = pa.array((code_u >> _SHIFT).astype(np.int32))
                out["right"] = pa.array((code_u & ((1 << _SHIFT) - 1)).astype(np.int32))
            else:
                out["token"] = pa.array(code_u.astype(np.int32))
            out["cnt"] = pa.array(cnt)
            if order:
                pos = np.asarray(rb.column(order).to_numpy(zero_copy_only=False),
                                 dtype=np.int64)[erow]
                o = np.lexsort((eidx, pos, inv))
                firsts = o[np.r_[0, np.flatnonzero(np.diff(inv[o])) + 1]]
                out["first_pos"] = pa.array(pos[firsts])
                out["first_idx"] = pa.array(eidx[firsts])
            yield pa.RecordBatch.from_pydict(out)
    return run


def _dense_token_counts(vals, erow, eidx, rb, order, group_vals):
    """Token counts (and first appearance) of one batch with ``bincount`` and
    ``minimum.at`` over the id space: linear in the tokens, no sort of them."""
    v = int(vals.max()) + 1
    cnt = np.bincount(vals, minlength=v)
    nz = np.flatnonzero(cnt)
    out = {g: pa.array([val] * len(nz)) for g, val in group_vals.items()}
    out["token"] = pa.array(nz.astype(np.int32))
    out["cnt"] = pa.array(cnt[nz].astype(np.int64))
    if order:
        row_pos = np.asarray(rb.column(order).to_numpy(zero_copy_only=False), dtype=np.int64)
        by_pos = np.argsort(row_pos, kind="stable")          # rows, not tokens
        row_rank = np.empty_like(by_pos)
        row_rank[by_pos] = np.arange(len(by_pos))
        span = int(eidx.max()) + 1
        key = row_rank[erow] * span + eidx
        first = np.full(v, np.iinfo(np.int64).max, dtype=np.int64)
        np.minimum.at(first, vals, key)
        k = first[nz]
        rows = by_pos[k // span]
        out["first_pos"] = pa.array(row_pos[rows])
        out["first_idx"] = pa.array((k % span).astype(np.int64))
    yield pa.RecordBatch.from_pydict(out)


def partial_token_counts(df: DataFrame, tokens: str = "tokens", group_cols=(),
                         weight: str | None = None, order: str | None = None,
                         pairs: bool = False) -> DataFrame:
    """Token (or adjacent-pair) counts per group, combined inside every Arrow
    batch, a bounded part of it at a time, with NumPy before Spark's shuffle: a
    part emits one row per distinct (group, token) it saw instead of one row per
    token. With
    ``order`` also the first appearance (``first_pos`` = order value,
    ``first_idx`` = position in the sequence). Finish with a ``groupBy``."""
    group_cols = list(group_cols)
    fields = [df.schema[g] for g in group_cols]
    fields = [T.StructField(f.name, f.dataType) for f in fields]
    if pairs:
        fields += [T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType())]
    else:
        fields += [T.StructField("token", T.IntegerType())]
    fields += [T.StructField("cnt", T.LongType())]
    if order:
        fields += [T.StructField("first_pos", T.LongType()), T.StructField("first_idx", T.LongType())]
    cols = group_cols + [tokens] + ([weight] if weight else []) + ([order] if order else [])
    src = df.select(*[F.col(c).cast("long") if c in (weight, order) else F.col(c) for c in cols])
    return src.mapInArrow(_partial_counts_fn(tokens, group_cols, weight, order, pairs),
                          T.StructType(fields))


def per_doc_counts(tokenized: DataFrame, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """Adds ``n_tokens, n_words, n_chars, n_bytes`` per document."""
    return tokenized.select(
        "*", F.size(tokens).cast("long").alias("n_tokens"),
        count_words(text).alias("n_words"), count_characters(text).alias("n_chars"),
        count_bytes(text).alias("n_bytes"))


def _ratio(n, d):
    """Mean of ratios: documents with a zero divisor leave this mean only."""
    return F.avg(F.try_divide(F.col(n).cast("double"), F.nullif(F.col(d), F.lit(0))))


def doc_level_stats(counted: DataFrame, group: str = "tokenizer") -> DataFrame:
    """avg / median / min / max tokens per document and the three ratios."""
    return counted.groupBy(group).agg(
        F.count(F.lit(1)).alias("num_docs"),
        F.sum("n_tokens").alias("total_tokens"),
        F.avg("n_tokens").alias("avg_tokens_per_doc"),
        F.median("n_tokens").alias("median_tokens_per_doc"),
        F.min("n_tokens").alias("min_tokens_per_doc"),
        F.max("n_tokens").alias("max_tokens_per_doc"),
        _ratio("n_tokens", "n_words").alias("avg_tokens_per_word"),
        _ratio("n_tokens", "n_chars").alias("avg_tokens_per_char"),
        _ratio("n_tokens", "n_bytes").alias("avg_tokens_per_byte"),
    ).withColumn("compression_ratio", F.col("avg_tokens_per_byte"))


def distinct_tokens(tokenized: DataFrame, tokens: str = "tokens",
                    group: str = "tokenizer") -> DataFrame:
    """Distinct token ids used per tokenizer. Each Arrow batch contributes its
    distinct ids only, and the aggregation is partial per task before the
    shuffle."""
    part = partial_token_counts(tokenized, tokens, [group])
    return (part.groupBy(group, "token").agg(F.lit(1).alias("_one"))
            .groupBy(group).agg(F.count(F.lit(1)).alias("unique_tokens_used")))


def vocab_utilization(tokenized: DataFrame, vocab_sizes: DataFrame, tokens: str = "tokens",
                      group: str = "tokenizer") -> DataFrame:
    """``vocab_size, unique_tokens_used, total_tokens, vocab_utilization`` (%),
    from one pass over the tokens."""
    used = (partial_token_counts(tokenized, tokens, [group]).groupBy(group, "token").agg(F.sum("cnt").alias("cnt"))
            .groupBy(group).agg(F.count(F.lit(1)).alias("unique_tokens_used"), F.sum("cnt").alias("total_tokens")))
    return (vocab_sizes.join(used, group)
            .select(group, "vocab_size", "unique_tokens_used", "total_tokens",
                    (F.col("unique_tokens_used") / F.col("vocab_size") * 100.0)
                    .alias("vocab_utilization")))


def token_frequency(tokenized: DataFrame, top: int = 5, tokens: str = "tokens",
                    pos: str = "pos", group: str = "tokenizer") -> DataFrame:
    """Most frequent tokens per tokenizer; ties go to the token seen first
    (document order, then position inside the document)."""
    part = partial_token_counts(tokenized, tokens, [group], order=pos)
    counts = part.groupBy(group, "token").agg(
        F.sum("cnt").alias("cnt"),
        F.min(F.struct(F.col("first_pos").alias("_doc"), F.col("first_idx").alias("_idx")))
        .alias("_first"))
    w = Window.partitionBy(group).orderBy(F.col("cnt").desc(), F.col("_first").asc())
    return (counts.withColumn("rank", F.row_number().over(w).cast("long"))
            .where(F.col("rank") <= top)
            .select(group, "rank", "token", "cnt"))


def token_pair_counts(seqs: DataFrame, tokens: str = "tokens", weight: str | None = None,
                      keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts of adjacent pairs over sequences (overlaps count: ``aaa`` has
    (a, a) twice), optionally weighted. Combined per Arrow batch, then per
    task, before the shuffle."""
    part = partial_token_counts(seqs, tokens, list(keys), weight=weight, pairs=True)
    return part.groupBy(*keys, "left", "right").agg(F.sum("cnt").alias("cnt"))


def analyze(tokenized: DataFrame, vocab_sizes: DataFrame, tokens: str = "tokens",
            text: str = "text", group: str = "tokenizer") -> DataFrame:
    """The tokenizer comparison table: one row per tokenizer."""
    counted = per_doc_counts(tokenized, text, tokens)
    docs = doc_level_stats(counted, group)
    # two passes over the tokens: per-document counts and distinct ids
    voc = vocab_sizes.join(distinct_tokens(tokenized, tokens, group), group).withColumn(
        "vocab_utilization", F.col("unique_tokens_used") / F.col("vocab_size") * 100.0)
    return docs.join(voc, group).select(
        group, "vocab_size", "unique_tokens_used", "total_tokens", "vocab_utilization",
        "avg_tokens_per_doc", "median_tokens_per_doc", "min_tokens_per_doc",
        "max_tokens_per_doc", "avg_tokens_per_word", "avg_tokens_per_char",
        "avg_tokens_per_byte", "compression_ratio")


# The eight special-case strings of the reference's analysis,
# in its order (name, text).
SPECIAL_CASES = (
    ("Standard English", "The quick brown fox jumps over the lazy dog."),
    ("Numbers", "The year 2024 has 365 days and 12 months."),
    ("Mixed Case", "iPhone, JavaScript, and HTML5 are popular."),
    ("Punctuation", "Hello! How are you? I'm fine, thanks."),
    ("Unicode", "Café, naïve, résumé, 日本語"),
    ("Code", "def hello_world(): return 'Hello, World!'"),
    ("URL", "https://www.example.com/path?query=value"),
    ("Email", "user.name+tag@example.com"),
)


def special_case_matrix(spark, tokenizers: dict, cases=SPECIAL_CASES) -> DataFrame:
    """Token counts of fixed strings x tokenizers: one row per case with the
    text cut for display and one count column per tokenizer."""
    from ..functions.text import display_truncate

    base = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(cases)],
                                 "idx int, case string, text string")
    cols = [F.size(fn(F.col("text"))).alias(name) for name, fn in tokenizers.items()]
    return base.select("idx", "case", display_truncate("text").alias("text"), *cols).orderBy("idx")
