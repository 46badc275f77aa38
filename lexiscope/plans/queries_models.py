"""Registered queries on trained models: published and trained tokenizers,
interpolated language models, the index of cells."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import bpe, lm, ngram, ranked_bpe, vector_index, wordpiece_train
from ..operators.bpe_string import bpe_train_string
from ..operators.retrieve import topk_cosine
from ..session import checkpoint_dir
from ..sources.testdata import corpus, table
from ..sources.testdata import queries as items
from . import jobs
from .oracle import cosine_sql
from .queries import (_LM_DOCS_SQL, ALPHA, K, LM_VOCAB, SEQ_LEN, STRIDE, WP_VOCAB, _analysis_docs, _lm_docs, _md5_of, _prepared, register,
                      round_metrics)
from .registry import MODELS, skipgram_model

# ---------------------------------------------------------------------------
# The training job's merges and word pieces: trained once for a table and
# application, saved, and read by the queries that use them.
# ---------------------------------------------------------------------------

BPE_VOCAB = 2000  # the training job's size
_SAVED: dict[tuple, str] = {}


def train_merges(spark, sf_dir: str):
    """Train on the whole corpus and save the table."""
    merges = bpe_train_string(corpus(spark, sf_dir).select("pos", "text"), BPE_VOCAB)
    path = f"{checkpoint_dir(spark).rstrip('/')}/merges-{uuid.uuid4().hex}"
    bpe.merges_save(merges, path, BPE_VOCAB)
    _SAVED[spark.sparkContext.applicationId, sf_dir] = path
    return merges


def trained_merges(spark, sf_dir: str) -> dict[tuple[int, int], int]:
    """The saved table of this application, trained if there is none yet."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SAVED:
        train_merges(spark, sf_dir)
    return bpe.merges_dict(bpe.merges_load(spark, _SAVED[key])[0])


def trained_pieces(spark, sf_dir: str) -> list[str]:
    """The trained vocabulary, saved and read again like the merges."""
    key = (spark.sparkContext.applicationId, sf_dir, "pieces")
    if key not in _SAVED:
        pieces = wordpiece_train.train_vocab(_analysis_docs(spark, sf_dir), "text", WP_VOCAB)
        path = f"{checkpoint_dir(spark).rstrip('/')}/pieces-{uuid.uuid4().hex}"
        spark.createDataFrame(list(enumerate(pieces)), "token_id int, token string").coalesce(1).write.parquet(path)
        _SAVED[key] = path
    return [r["token"] for r in spark.read.parquet(_SAVED[key]).orderBy("token_id").collect()]


@register("bpe_train")
def q_bpe_train(spark, sf_dir):
    """All merges of the training job, over the corpus as one string."""
    return train_merges(spark, sf_dir)


@register("wordpiece_train")
def q_wordpiece_train(spark, sf_dir):
    """The trained word pieces with their ids."""
    _SAVED.pop((spark.sparkContext.applicationId, sf_dir, "pieces"), None)
    return spark.createDataFrame(list(enumerate(trained_pieces(spark, sf_dir))), "token_id int, token string")


@register("bpe_encode_trained")
def q_bpe_encode_trained(spark, sf_dir):
    """Greedy ids of every document with the trained table, and their way back."""
    m = trained_merges(spark, sf_dir)
    enc = table(spark, sf_dir, "documents").select("doc_id", "text", bpe.bpe_encode_col("text", m).alias("ids"))
    return enc.select("doc_id", F.size("ids").alias("n_tokens"), _md5_of("ids").alias("ids_md5"),
                      (bpe.bpe_decode("ids", m) == F.col("text")).alias("roundtrip"))


PUBLISHED = "byte_bpe_50k.json"


def published(name: str = PUBLISHED) -> ranked_bpe.RankedTable:
    """A file of the installed ``public_tokenizers``, or one by its path."""
    if "/" not in name:
        import public_tokenizers
        name = public_tokenizers.path(name)
    return ranked_bpe.read_ranks(name)


@register("published_bpe_tokens")
def q_published_bpe_tokens(spark, sf_dir):
    """Ids of every document by a published table of ranks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", ranked_bpe.ranked_tokens("text", published()).alias("ids"))
    return docs.select("doc_id", F.size("ids").alias("n_tokens"), _md5_of("ids").alias("ids_md5"))


# ---------------------------------------------------------------------------
# Interpolated language models and scoring by windows.
# ---------------------------------------------------------------------------

_CHARS_SQL = "(SELECT sum(length(text)) FROM lmdocs WHERE split = 'test')"


def _grams_sql(order: int) -> str:
    cols = ", ".join(f"t[i + {k}] AS t{k + 1}" for k in range(order))
    return (f"g{order} AS (SELECT split, {', '.join(f't{k + 1}' for k in range(order))}, count(*) AS cnt FROM (SELECT split, {cols} "
            f"FROM (SELECT split, t, unnest(range(1, len(t) - {order - 2})) AS i FROM lmdocs)) GROUP BY ALL)")


def _model_sql(order: int) -> str:
    """CTEs f{order}_{split} (n, f1 ..), w{order} (the fitted weights) and r{order}
    (the row of the result)."""
    out = []
    for split in ("validation", "test"):
        joins = ""
        for k in range(1, order + 1):
            on = " AND ".join(f"c{k}.t{j} = e.t{order - k + j}" for j in range(1, k + 1))
            joins += f" LEFT JOIN (SELECT * FROM g{k} WHERE split = 'train') c{k} ON {on}"
            if k > 1:
                names = ", ".join(f"t{j}" for j in range(1, k))
                on = " AND ".join(f"s{k}.t{j} = e.t{order - k + j}" for j in range(1, k))
                joins += f" LEFT JOIN (SELECT {names}, sum(cnt) AS s FROM g{k} WHERE split = 'train' GROUP BY {names}) s{k} ON {on}"
        f = {1: "coalesce(c1.cnt, 0)::DOUBLE / (SELECT sum(cnt) FROM g1 WHERE split = 'train')"}
        for k in range(2, order + 1):
            f[k] = f"CASE WHEN s{k}.s IS NULL THEN {f[k - 1]} ELSE coalesce(c{k}.cnt, 0)::DOUBLE / s{k}.s END"
        cols = ", ".join(f"{f[k]} AS f{k}" for k in f)
        out.append(f"f{order}_{split} AS (SELECT e.cnt AS n, {cols} FROM (SELECT * FROM g{order} WHERE split = '{split}') e{joins})")
    names = [f"w{k}" for k in range(order + 1)]
    mixed = " + ".join([f"w0 / {LM_VOCAB}"] + [f"w{k} * f{k}" for k in range(1, order + 1)])
    parts = [f"w0 / {LM_VOCAB}"] + [f"w{k} * f{k}" for k in range(1, order + 1)]
    out.append(f"em{order}_0 AS (SELECT {', '.join(f'{1 / (order + 1)!r}::DOUBLE AS {w}' for w in names)})")
    for step in range(1, ngram.STEPS + 1):
        cols = ", ".join(f"sum(n * ({p}) / ({mixed})) / sum(n) AS {w}" for p, w in zip(parts, names, strict=True))
        out.append(f"em{order}_{step} AS (SELECT {cols} FROM f{order}_validation, em{order}_{step - 1})")
    weights = ", ".join(f"round(any_value(w{k}), 6) AS w{k}" if k <= order else f"NULL::DOUBLE AS w{k}" for k in range(ngram.MAX_ORDER + 1))
    out.append(f"r{order} AS (SELECT {order} AS model_order, sum(n)::BIGINT AS n_pairs, sum(n * -ln({mixed})) AS nll, {weights} "
               f"FROM f{order}_test, em{order}_{ngram.STEPS})")
    return ",\n".join(out)


@register("lm_interpolated", "WITH " + _LM_DOCS_SQL + ",\n" + ",\n".join(_grams_sql(k) for k in (1, 2, 3)) + ",\n" + _model_sql(2) + ",\n"
          + _model_sql(3) + f"""
SELECT model_order, n_pairs, round(nll / n_pairs, 6) AS loss, round(exp(nll / n_pairs), 6) AS perplexity,
       round(nll / n_pairs / ln(2), 6) AS bits_per_token, round(nll / (ln(2) * {_CHARS_SQL}), 6) AS bits_per_char, w0, w1, w2, w3
FROM (SELECT * FROM r2 UNION ALL SELECT * FROM r3)""")
def q_lm_interpolated(spark, sf_dir):
    """Interpolated models of order 2 and 3: weights fitted on the validation
    part, loss on the test part."""
    d = _lm_docs(spark, sf_dir)
    part = {s: d.where(F.col("split") == s) for s in ("train", "validation", "test")}
    chars = part["test"].agg(F.sum(F.length("text")).alias("n")).first()["n"]
    trained = ngram.Interpolated.train(part["train"], 3, LM_VOCAB)
    out = None
    for order in (2, 3):
        model = ngram.Interpolated({k: t for k, t in trained.tables.items() if k <= order}, LM_VOCAB)
        model = model.fit(ngram.gram_counts(part["validation"], order))
        row = model.score(ngram.gram_counts(part["test"], order)).select(
            F.lit(order).alias("model_order"), "n_pairs", "loss", "perplexity", "bits_per_token",
            (F.col("sum_nll") / (F.log(F.lit(2.0)) * F.lit(chars))).alias("bits_per_char"),
            *[F.lit(model.weights[k] if k <= order else None).cast("double").alias(f"w{k}") for k in range(ngram.MAX_ORDER + 1)])
        out = row if out is None else out.unionByName(row)
    return round_metrics(out)


@register("lm_eval_windows", "WITH " + _LM_DOCS_SQL + f""",
windows AS (SELECT t, unnest(range(0, len(t) - {SEQ_LEN} - 1, {STRIDE})) AS s FROM lmdocs WHERE split = 'test'),
ev AS (SELECT ctx, tok, count(*) AS n FROM (
         SELECT t[s + j] AS ctx, t[s + j + 1] AS tok FROM (SELECT t, s, unnest(range(1, {SEQ_LEN} + 1)) AS j FROM windows)) GROUP BY ctx, tok),
j AS (SELECT ev.n, coalesce(tc.cnt, 0) AS c, coalesce(ctxc.cc, 0) AS cc
      FROM ev LEFT JOIN train_counts tc USING (ctx, tok) LEFT JOIN ctxc USING (ctx)),
x AS (SELECT sum(n)::BIGINT AS n_pairs, sum(n * -ln((c + {ALPHA}) / (cc + {ALPHA} * {LM_VOCAB}))) AS nll FROM j)
SELECT n_pairs, round(nll / n_pairs, 6) AS loss, round(exp(nll / n_pairs), 6) AS perplexity,
       round(nll / n_pairs / ln(2), 6) AS bits_per_token FROM x""")
def q_lm_eval_windows(spark, sf_dir):
    """The loss over overlapping windows: each place counts as often as windows
    predict it."""
    d = _lm_docs(spark, sf_dir)
    counts = lm.ngram_counts(d.where(F.col("split") == "train"), "tokens")
    grams = ngram.gram_counts(d.where(F.col("split") == "test"), 2, windows=(SEQ_LEN, STRIDE))
    return round_metrics(lm.lm_eval(counts, grams.withColumnsRenamed({"t1": "ctx", "t2": "tok"}), LM_VOCAB, ALPHA))


@register("lm_generate_published")
def q_lm_generate_published(spark, sf_dir):
    """Continue every benchmark passage by 10 tokens of a bigram model over the
    50,000 tokens of a published table."""
    known = published()
    size = max(max(new for _, new in known.merges.values()), *known.byte_ids) + 1
    docs = _lm_docs(spark, sf_dir).where(F.col("split") == "train").select(ranked_bpe.ranked_tokens("text", known).alias("tokens"))
    seeds = items(spark, sf_dir).select("query_id", ranked_bpe.ranked_tokens("text", known).alias("tokens"))
    gen = lm.lm_generate_batch(seeds, ngram.gram_counts(docs, 2).withColumnsRenamed({"t1": "ctx", "t2": "tok"}), size, key="query_id",
                               new_tokens=10, top_k=50)
    return gen.select("query_id", F.size("generated").alias("n_tokens"), F.array_join(F.slice("generated", -10, 10).cast("array<string>"), ",").alias("tokens"))


# ---------------------------------------------------------------------------
# The index of cells on ``embeddings``: every vector whose id is divisible by
# 20 is a query against all vectors.
# ---------------------------------------------------------------------------

EVERY = 20
RECALL = 0.95


def _cells(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = emb.where(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "query_id")
    return emb, asked, vector_index.build(emb)


@register("topk_cells", f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {cosine_sql('q.e', 'd.e')} AS distance
          FROM v q JOIN v d ON q.vec_id % {EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS rank FROM pairs)
SELECT query_id, doc_id, rank, round(distance, 6) AS distance FROM ranked WHERE rank <= {K}""")
def q_topk_cells(spark, sf_dir):
    """Exact neighbours by the index: cells by distance, then all that can still
    hold a nearer vector."""
    _, asked, index = _cells(spark, sf_dir)
    hits = vector_index.search(index, asked, K, exact=True)
    return hits.select("query_id", "doc_id", "rank", F.round("distance", 6).alias("distance"))


@register("topk_cells_recall")
def q_topk_cells_recall(spark, sf_dir):
    """Recall of the approximate search against comparing everything; the number
    of cells asked is tuned on a sample of the queries."""
    emb, asked, index = _cells(spark, sf_dir)
    probes = vector_index.tune_probes(index, asked, K, RECALL)
    found = vector_index.search(index, asked, K, probes=probes)
    exact = topk_cosine(asked, emb.withColumnRenamed("vec_id", "doc_id"), K)
    return vector_index.recall(found, exact).select(
        "n_queries", "n_pairs", F.round("recall", 6).alias("recall"), F.lit(probes).alias("probes"), F.lit(len(index.centres)).alias("cells"))


# ---------------------------------------------------------------------------
# All models at one width.
# ---------------------------------------------------------------------------

COMMON_WIDTH = 32


@register("metrics_common_width")
def q_metrics_common_width(spark, sf_dir):
    """Retrieval by every model with its vectors reduced to one width."""
    docs, kept, qs, qr, aligned = _prepared(spark, sf_dir, None)
    models = [MODELS[name] for name in ("byte-hashed", "char-hashed", "word2vec")]
    return round_metrics(jobs.evaluate_reduced(kept, aligned, qr, models, COMMON_WIDTH)).withColumn("width", F.lit(COMMON_WIDTH))


@register("skipgram_metrics")
def q_skipgram_metrics(spark, sf_dir):
    """Retrieval by word vectors of the sharded trainer."""
    docs, kept, qs, qr, aligned = _prepared(spark, sf_dir, None)
    return round_metrics(jobs.evaluate(kept, aligned, qr, [skipgram_model()]).drop("dim"))
