"""Registered queries: one Spark plan per operator, each with the SQL that
DuckDB runs on the same tables as an independent check (where SQL can say
it). Every query reads whole tables.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, sql or None)``
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import average_metrics, per_query_metrics, round_metrics
from ..operators.retrieve import topk_cosine
from ..session import bounded_batches, checkpoint_dir
from ..sources.testdata import table
from .oracle import cosine_sql, metrics_sql

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            bounded_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = (run, sql)
        return fn
    return deco


# ---------------------------------------------------------------------------
# Vector retrieval on ``embeddings``: every vector is a query against all the
# others; relevant = the other vectors with the same label.
# ---------------------------------------------------------------------------

K = 15


def _embedding_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    emb = table(spark, sf_dir, "embeddings")
    hits = topk_cosine(
        emb.select(F.col("vec_id").alias("query_id"), "embedding"),
        emb.select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("doc_label")),
        k=K, carry=["doc_label"], exclude_self=True)
    q = emb.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"))
    flagged = (hits.join(q, "query_id")
               .withColumn("is_relevant", F.col("doc_label") == F.col("q_label")))
    return flagged, q


_EMB_TOP_SQL = f"""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.label = d.label AS is_relevant,
         {cosine_sql('q.e', 'd.e')} AS distance
  FROM v q JOIN v d ON q.vec_id <> d.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS rank
  FROM pairs),
top AS (SELECT * FROM ranked WHERE rank <= {K})"""


@register("topk_cosine", _EMB_TOP_SQL + """
SELECT query_id, doc_id, rank, round(distance, 6) AS distance FROM top""")
def q_topk_cosine(spark, sf_dir):
    flagged, _ = _embedding_hits(spark, sf_dir)
    return flagged.select("query_id", "doc_id", "rank", F.round("distance", 6).alias("distance"))


@register("rank_hits", _EMB_TOP_SQL + """
SELECT query_id, doc_id, rank, is_relevant FROM top""")
def q_rank_hits(spark, sf_dir):
    flagged, _ = _embedding_hits(spark, sf_dir)
    return flagged.select("query_id", "doc_id", "rank", "is_relevant")


@register("topk_metrics", _EMB_TOP_SQL + """,
asked AS (SELECT vec_id AS query_id FROM embeddings),
nrel AS (
  SELECT e.vec_id AS query_id, c.n - 1 AS n_relevant
  FROM embeddings e JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) c
    ON e.label = c.label),""" + metrics_sql("top", "nrel", "asked"))
def q_topk_metrics(spark, sf_dir):
    flagged, q = _embedding_hits(spark, sf_dir)
    label_n = q.groupBy("q_label").agg(F.count(F.lit(1)).alias("_n"))
    n_rel = q.join(label_n, "q_label").select("query_id", (F.col("_n") - 1).alias("n_relevant"))
    per_query = per_query_metrics(flagged, n_rel, q.select("query_id"))
    return round_metrics(average_metrics(per_query))


# ---------------------------------------------------------------------------
# Text functions and token statistics on ``documents`` (analysis content is
# ``title + ' ' + text`` with ``source`` as title) and ``pages``.
# ---------------------------------------------------------------------------

from ..functions.text import (clean_text, content_for_analysis, count_bytes,  # noqa: E402
                              count_characters, count_words)
from ..functions.tokens import (BYTE_VOCAB_SIZE, CHAR_VOCAB_SIZE, byte_tokens,  # noqa: E402
                                char_tokens)
from ..operators import tokstats  # noqa: E402
from ..sources.testdata import corpus  # noqa: E402
from .oracle import WS_CLASS_SQL  # noqa: E402


def _analysis_docs(spark, sf_dir):
    return corpus(spark, sf_dir).select(
        "doc_id", "pos", content_for_analysis("title", "text").alias("text"))


def _tokenized(spark, sf_dir, which=("byte", "char")):
    d = _analysis_docs(spark, sf_dir)
    fns = {"byte": byte_tokens, "char": char_tokens}
    frames = [d.select(F.lit(n).alias("tokenizer"), "doc_id", "pos", "text",
                       fns[n]("text").alias("tokens")) for n in which]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _vocab_sizes(spark):
    return spark.createDataFrame([("byte", BYTE_VOCAB_SIZE), ("char", CHAR_VOCAB_SIZE)],
                                 "tokenizer string, vocab_size long")


_WORD_RE = "[^" + WS_CLASS_SQL[1:] + "+"
_DOCS_SQL = "SELECT doc_id, doc_id AS pos, source || ' ' || text AS text FROM documents"
_BYTES_OF = ("flatten(list_transform(string_split({t}, ''), lambda c: "
             "list_transform(range(strlen(c)), lambda j: ('0x' || substr(hex(c), 2*j+1, 2))::INT)))")
_TOK_SQL = f"""
WITH d AS ({_DOCS_SQL}),
tok AS (
  SELECT 'byte' AS tokenizer, doc_id, pos, text,
         list_transform({_BYTES_OF.format(t='text')}, lambda b: b + 3) || [1] AS tokens FROM d
  UNION ALL
  SELECT 'char' AS tokenizer, doc_id, pos, text,
         [57344] || (CASE WHEN length(text) = 0 THEN []::INT[]
                     ELSE list_transform(string_split(text, ''), lambda c: unicode(c)) END)
         || [57345] AS tokens FROM d),
counted AS (
  SELECT tokenizer, doc_id, pos, tokens, len(tokens)::BIGINT AS n_tokens,
    len(regexp_extract_all(text, '{_WORD_RE}'))::BIGINT AS n_words,
    length(replace(replace(replace(text, ' ', ''), chr(10), ''), chr(9), ''))::BIGINT AS n_chars,
    strlen(text)::BIGINT AS n_bytes
  FROM tok),
docstats AS (
  SELECT tokenizer, count(*) AS num_docs, sum(n_tokens)::BIGINT AS total_tokens,
    avg(n_tokens) AS avg_tokens_per_doc, median(n_tokens)::DOUBLE AS median_tokens_per_doc,
    min(n_tokens) AS min_tokens_per_doc, max(n_tokens) AS max_tokens_per_doc,
    avg(n_tokens::DOUBLE / nullif(n_words, 0)) AS avg_tokens_per_word,
    avg(n_tokens::DOUBLE / nullif(n_chars, 0)) AS avg_tokens_per_char,
    avg(n_tokens::DOUBLE / nullif(n_bytes, 0)) AS avg_tokens_per_byte
  FROM counted GROUP BY tokenizer),
voc AS (
  SELECT tokenizer, count(DISTINCT token) AS unique_tokens_used
  FROM (SELECT tokenizer, unnest(tokens) AS token FROM tok) GROUP BY tokenizer),
sizes AS (SELECT * FROM (VALUES ('byte', {BYTE_VOCAB_SIZE}), ('char', {CHAR_VOCAB_SIZE}))
          t(tokenizer, vocab_size)),
stats AS (
  SELECT s.tokenizer, s.vocab_size::BIGINT AS vocab_size, v.unique_tokens_used,
    d.total_tokens, round(v.unique_tokens_used * 100.0 / s.vocab_size, 6) AS vocab_utilization,
    round(d.avg_tokens_per_doc, 6) AS avg_tokens_per_doc,
    round(d.median_tokens_per_doc, 6) AS median_tokens_per_doc,
    d.min_tokens_per_doc, d.max_tokens_per_doc,
    round(d.avg_tokens_per_word, 6) AS avg_tokens_per_word,
    round(d.avg_tokens_per_char, 6) AS avg_tokens_per_char,
    round(d.avg_tokens_per_byte, 6) AS avg_tokens_per_byte,
    round(d.avg_tokens_per_byte, 6) AS compression_ratio
  FROM sizes s JOIN voc v USING (tokenizer) JOIN docstats d USING (tokenizer))"""


def _stats(spark, sf_dir, which=("byte", "char")):
    return round_metrics(tokstats.analyze(_tokenized(spark, sf_dir, which), _vocab_sizes(spark)))


@register("byte_token_stats", _TOK_SQL + "\nSELECT * FROM stats WHERE tokenizer = 'byte'")
def q_byte_token_stats(spark, sf_dir):
    return _stats(spark, sf_dir, ("byte",))


@register("char_token_stats", _TOK_SQL + "\nSELECT * FROM stats WHERE tokenizer = 'char'")
def q_char_token_stats(spark, sf_dir):
    return _stats(spark, sf_dir, ("char",))


@register("tokens_per_doc_stats", _TOK_SQL + """
SELECT tokenizer, avg_tokens_per_doc, median_tokens_per_doc, min_tokens_per_doc,
       max_tokens_per_doc FROM stats""")
def q_tokens_per_doc_stats(spark, sf_dir):
    return _stats(spark, sf_dir).select(
        "tokenizer", "avg_tokens_per_doc", "median_tokens_per_doc", "min_tokens_per_doc",
        "max_tokens_per_doc")


@register("token_ratios", _TOK_SQL + """
SELECT tokenizer, avg_tokens_per_word, avg_tokens_per_char, avg_tokens_per_byte,
       compression_ratio FROM stats""")
def q_token_ratios(spark, sf_dir):
    return _stats(spark, sf_dir).select(
        "tokenizer", "avg_tokens_per_word", "avg_tokens_per_char", "avg_tokens_per_byte",
        "compression_ratio")


@register("vocab_utilization", _TOK_SQL + """
SELECT tokenizer, vocab_size, unique_tokens_used, total_tokens, vocab_utilization FROM stats""")
def q_vocab_utilization(spark, sf_dir):
    return round_metrics(tokstats.vocab_utilization(_tokenized(spark, sf_dir),
                                                    _vocab_sizes(spark)))


@register("token_frequency", _TOK_SQL + """,
ex AS (SELECT tokenizer, pos, unnest(tokens) AS token, unnest(range(len(tokens))) AS idx FROM tok),
cnt AS (SELECT tokenizer, token, count(*) AS cnt, min(pos) AS p0,
          arg_min(idx, (pos, idx)) AS i0 FROM ex GROUP BY tokenizer, token),
ranked AS (SELECT tokenizer, token, cnt, row_number() OVER (
            PARTITION BY tokenizer ORDER BY cnt DESC, p0, i0) AS rank FROM cnt)
SELECT tokenizer, rank, token, cnt FROM ranked WHERE rank <= 5""")
def q_token_frequency(spark, sf_dir):
    return tokstats.token_frequency(_tokenized(spark, sf_dir), top=5)


@register("token_pair_counts", f"""
WITH d AS (SELECT doc_id, {_BYTES_OF.format(t='text')} AS b FROM documents),
p AS (SELECT b[i] AS "left", b[i + 1] AS "right"
      FROM (SELECT b, unnest(range(1, len(b))) AS i FROM d))
SELECT "left", "right", count(*) AS cnt FROM p GROUP BY "left", "right" """)
def q_token_pair_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    seqs = docs.select(byte_tokens("text", special=False).alias("tokens"))
    return tokstats.token_pair_counts(seqs)


@register("count_text", f"""
WITH d AS ({_DOCS_SQL})
SELECT doc_id, len(regexp_extract_all(text, '{_WORD_RE}'))::BIGINT AS n_words,
  length(replace(replace(replace(text, ' ', ''), chr(10), ''), chr(9), ''))::BIGINT AS n_chars,
  strlen(text)::BIGINT AS n_bytes FROM d""")
def q_count_text(spark, sf_dir):
    d = _analysis_docs(spark, sf_dir)
    return d.select("doc_id", count_words("text").alias("n_words"),
                    count_characters("text").alias("n_chars"), count_bytes("text").alias("n_bytes"))


@register("clean_text", f"""
SELECT page_id, trim(regexp_replace(coalesce(html, ''), '{WS_CLASS_SQL}+', ' ', 'g'), ' ')
       AS cleaned FROM pages""")
def q_clean_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", clean_text("html").alias("cleaned"))


# ---------------------------------------------------------------------------
# Corpus preparation: first N titles, judgments, query alignment, split.
# ---------------------------------------------------------------------------

from ..operators import prep  # noqa: E402
from ..operators.ordering import split_by_position  # noqa: E402
from ..sources.testdata import qrels as test_qrels  # noqa: E402
from ..sources.testdata import queries as test_queries  # noqa: E402

N_TITLES = 10  # where first-N is the feature; the evaluations take all titles

_QRELS_SQL = """SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d
  ON contains(d.text, b.text) WHERE length(b.text) > 0"""
def _kept_sql(n):
    if n is None:
        return "kept AS (SELECT doc_id, source AS title FROM documents)"
    return f"""kept_titles AS (SELECT source, min(doc_id) AS f FROM documents GROUP BY source
                ORDER BY f LIMIT {n}),
kept AS (SELECT doc_id, source AS title FROM documents d
         WHERE EXISTS (SELECT 1 FROM kept_titles t WHERE t.source IS NOT DISTINCT FROM d.source))"""
def _align_sql(n):
    return f"""WITH qrels AS ({_QRELS_SQL}),
{_kept_sql(n)},
aligned AS (
  SELECT b.item_id AS query_id FROM benchmark b
  WHERE b.item_id IN (SELECT query_id FROM qrels)
    AND b.item_id NOT IN (SELECT query_id FROM qrels
                          WHERE doc_id NOT IN (SELECT doc_id FROM kept)))"""


def _prepared(spark, sf_dir, n_titles: int | None = N_TITLES):
    docs = corpus(spark, sf_dir)
    kept = prep.first_n_titles(docs, n_titles)
    qs = test_queries(spark, sf_dir)
    # judgments are small (queries x relevant documents) and read several times
    checkpoint_dir(spark)
    qr = test_qrels(spark, sf_dir).checkpoint()
    aligned = prep.align_queries(qs, qr, kept)
    return docs, kept, qs, qr, aligned


@register("qrels_containment", _QRELS_SQL)
def q_qrels_containment(spark, sf_dir):
    return test_qrels(spark, sf_dir)


@register("first_n_titles", f"WITH {_kept_sql(N_TITLES)}\nSELECT doc_id, title FROM kept")
def q_first_n_titles(spark, sf_dir):
    return prep.first_n_titles(corpus(spark, sf_dir), N_TITLES).select("doc_id", "title")


@register("queries_with_qrels", f"""WITH qrels AS ({_QRELS_SQL})
SELECT b.item_id AS query_id, g.corpus_ids FROM benchmark b LEFT JOIN (
  SELECT query_id, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) AS corpus_ids
  FROM qrels GROUP BY query_id) g ON b.item_id = g.query_id""")
def q_queries_with_qrels(spark, sf_dir):
    out = prep.queries_with_qrels(test_queries(spark, sf_dir), test_qrels(spark, sf_dir))
    return out.select("query_id", F.array_join(F.transform("corpus_ids", lambda x: x.cast("string")),
                                               " ").alias("corpus_ids"))


@register("align_queries", _align_sql(N_TITLES) + "\nSELECT query_id FROM aligned")
def q_align_queries(spark, sf_dir):
    return _prepared(spark, sf_dir)[4].select("query_id")


@register("prep_counts", _align_sql(N_TITLES) + """
SELECT 'corpus_rows' AS metric, count(*)::BIGINT AS value FROM documents
UNION ALL SELECT 'distinct_titles', count(DISTINCT source)::BIGINT FROM documents
UNION ALL SELECT 'kept_rows', count(*)::BIGINT FROM kept
UNION ALL SELECT 'queries', count(*)::BIGINT FROM benchmark
UNION ALL SELECT 'qrel_pairs', count(*)::BIGINT FROM qrels
UNION ALL SELECT 'kept_queries', count(*)::BIGINT FROM aligned""")
def q_prep_counts(spark, sf_dir):
    docs, kept, qs, qr, aligned = _prepared(spark, sf_dir)
    return prep.prep_counts(docs, kept, qs, qr, aligned)


@register("split_by_position", """
SELECT item_id AS query_id,
  CASE WHEN row_number() OVER (ORDER BY item_id) - 1 < floor(count(*) OVER () * 0.5)
       THEN 'validation' ELSE 'test' END AS split
FROM benchmark""")
def q_split_by_position(spark, sf_dir):
    return split_by_position(test_queries(spark, sf_dir), 0.5, pos="pos", id_col="query_id") \
        .select("query_id", "split")


# ---------------------------------------------------------------------------
# Hashed-feature embeddings and text retrieval (benchmark -> documents).
# ---------------------------------------------------------------------------

from ..operators import vectorize  # noqa: E402
from ..operators.metrics import DEFAULT_KS  # noqa: E402
from . import jobs  # noqa: E402
from .oracle import hashed_scores_sql, hashed_weights_sql  # noqa: E402
from .registry import MODELS  # noqa: E402

DIM = 256
_EMB_DOCS = "SELECT doc_id, source || ': ' || text AS text FROM documents"


def _sparse_rows(vecs: DataFrame) -> DataFrame:
    ex = vecs.select("doc_id", F.posexplode_outer("embedding").alias("bucket", "weight"))
    return ex.where(F.col("weight") != 0).select(
        "doc_id", F.col("bucket").cast("bigint").alias("bucket"),
        F.round("weight", 6).alias("weight"))


def _embed_sql(model_key: str) -> str:
    return f"""WITH docs AS ({_EMB_DOCS}),
{hashed_weights_sql('docs', None, DIM, {'m': model_key})},
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS nn FROM dw GROUP BY doc_id)
SELECT doc_id, bucket::BIGINT AS bucket, round(w / nn, 6) AS weight
FROM dw JOIN dn USING (doc_id) WHERE w <> 0 AND nn > 0"""


@register("embed_hashed_byte", _embed_sql("byte"))
def q_embed_hashed_byte(spark, sf_dir):
    vecs, _ = jobs.embed_corpus(corpus(spark, sf_dir), MODELS["byte-hashed"])
    return _sparse_rows(vecs)


@register("embed_hashed_char", _embed_sql("char"))
def q_embed_hashed_char(spark, sf_dir):
    vecs, _ = jobs.embed_corpus(corpus(spark, sf_dir), MODELS["char-hashed"])
    return _sparse_rows(vecs)


@register("idf_table", f"""WITH docs AS ({_EMB_DOCS}),
{hashed_weights_sql('docs', None, DIM, {'m': 'byte'})}
SELECT b.bucket::INT AS bucket, coalesce(f.df, 0)::BIGINT AS df,
       round(ln((n + 1.0) / (coalesce(f.df, 0) + 1.0)), 6) AS idf
FROM range({DIM}) b(bucket) LEFT JOIN dfq f ON f.bucket = b.bucket, ndocs""")
def q_idf_table(spark, sf_dir):
    m = MODELS["byte-hashed"]
    docs = corpus(spark, sf_dir)
    tok = docs.select(m.tokenizer.tokens(
        jobs.content_for_embedding("title", "text")).alias("tokens"))
    tf = tok.select(vectorize.hashed_tf("tokens", m.dim, m.ngram).alias("tf"))
    return round_metrics(vectorize.idf_table(tf, "tf"))


@register("hashed_topk", f"""WITH docs AS ({_EMB_DOCS}),
asked AS (SELECT item_id AS query_id, text FROM benchmark),
{hashed_weights_sql('docs', 'asked', DIM, {'byte-hashed': 'byte'})},
{hashed_scores_sql('docs', 'asked')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY model, query_id
           ORDER BY round(distance, 9), doc_id) AS rank FROM scored)
SELECT query_id, doc_id, rank, round(distance, 6) AS distance FROM ranked WHERE rank <= 15""")
def q_hashed_topk(spark, sf_dir):
    m = MODELS["byte-hashed"]
    doc_vecs, idf = jobs.embed_corpus(corpus(spark, sf_dir), m)
    q_vecs = jobs.embed_queries(test_queries(spark, sf_dir), m, idf)
    hits = topk_cosine(q_vecs, doc_vecs, 15)
    return hits.select("query_id", "doc_id", "rank", F.round("distance", 6).alias("distance"))


_MODELS_SQL = {"byte-hashed": "byte", "char-hashed": "char"}


def _flagship_sql(select: str, models: dict[str, str] = _MODELS_SQL) -> str:
    return _align_sql(None) + f""",
asked AS (SELECT query_id FROM (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS r,
          count(*) OVER () AS n FROM aligned) WHERE r >= floor(n * 0.5)),
docs AS (SELECT d.doc_id, d.source || ': ' || d.text AS text
         FROM documents d JOIN kept k ON d.doc_id = k.doc_id),
qtext AS (SELECT b.item_id AS query_id, b.text FROM benchmark b JOIN asked a ON a.query_id = b.item_id),
{hashed_weights_sql('docs', 'qtext', DIM, models)},
{hashed_scores_sql('docs', 'asked')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY model, query_id
           ORDER BY round(distance, 9), doc_id) AS rank FROM scored),
top AS (SELECT r.model, r.query_id, r.doc_id, r.rank, q.query_id IS NOT NULL AS is_relevant
        FROM ranked r LEFT JOIN (SELECT DISTINCT query_id, doc_id FROM qrels) q
        ON r.query_id = q.query_id AND r.doc_id = q.doc_id WHERE r.rank <= 15),
nrel AS (SELECT m.model, n.query_id, n.n_relevant FROM (SELECT DISTINCT model FROM dtok) m,
         (SELECT query_id, count(DISTINCT doc_id) AS n_relevant FROM qrels GROUP BY query_id) n),
asked_m AS (SELECT m.model, a.query_id FROM (SELECT DISTINCT model FROM dtok) m, asked a),
wide AS (WITH {metrics_sql('top', 'nrel', 'asked_m', ('model',))})
{select}"""


def _flagship(spark, sf_dir):
    docs, kept, qs, qr, aligned = _prepared(spark, sf_dir, None)
    qtext = aligned.join(qs.select("query_id"), "query_id")
    res = jobs.evaluate(kept, qtext, qr, [MODELS["byte-hashed"], MODELS["char-hashed"]],
                        ks=DEFAULT_KS)
    return res


@register("retrieval_metrics_wide", _flagship_sql(
    "SELECT model, num_queries, mrr, " + ", ".join(
        [f"recall_at_{k}" for k in DEFAULT_KS] + [f"precision_at_{k}" for k in DEFAULT_KS])
    + " FROM wide"))
def q_retrieval_metrics_wide(spark, sf_dir):
    return round_metrics(_flagship(spark, sf_dir).drop("dim"))


@register("accuracy_per_dimension", _flagship_sql(
    f"SELECT model, {DIM}::INT AS dim, round(mrr / {DIM}, 9) AS mrr_per_dim, "
    f"round(recall_at_10 / {DIM}, 9) AS recall_at_10_per_dim FROM wide"))
def q_accuracy_per_dimension(spark, sf_dir):
    res = round_metrics(_flagship(spark, sf_dir))
    return res.select("model", F.col("dim").cast("int").alias("dim"),
                      F.round(F.col("mrr") / F.col("dim"), 9).alias("mrr_per_dim"),
                      F.round(F.col("recall_at_10") / F.col("dim"), 9).alias("recall_at_10_per_dim"))


def _string_id_sql() -> str:
    sql = _flagship_sql("SELECT model, num_queries, mrr, recall_at_10, precision_at_10 FROM wide", {"byte-hashed": "byte"})
    by_query = "row_number() OVER (ORDER BY query_id) - 1 AS r"
    assert by_query in sql and sql.startswith("WITH ")
    sql = sql.replace(by_query, "row_number() OVER (ORDER BY substr(query_id, 2)::BIGINT) - 1 AS r")
    return ("WITH documents AS (SELECT 'd' || doc_id AS doc_id, source, text FROM main.documents),\n"
            "benchmark AS (SELECT 'q' || item_id AS item_id, text FROM main.benchmark),\n") + sql[len("WITH "):]


@register("string_id_search", _string_id_sql())
def q_string_id_search(spark, sf_dir):
    """Ids that are strings through every step: prepare, write the vectors of
    the corpus as a table, read it back, search it, score the hits."""
    model = MODELS["byte-hashed"]
    docs = corpus(spark, sf_dir).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    qs = test_queries(spark, sf_dir).withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    judged = test_qrels(spark, sf_dir).select(F.concat(F.lit("q"), "query_id").alias("query_id"),
                                              F.concat(F.lit("d"), "doc_id").alias("doc_id"))
    base = checkpoint_dir(spark)
    kept, aligned, rel = jobs.prepare(docs, qs, judged.checkpoint(), None)
    path = f"{base.rstrip('/')}/vectors-{uuid.uuid4().hex}"
    jobs.embed_all_models(kept, [model], path)
    asked = jobs.test_queries(aligned)
    hits = jobs.search_table(spark, path, model, asked, max(DEFAULT_KS), idf=jobs.fit_idfs(kept, [model])[model.name])
    return round_metrics(jobs.score_hits(hits, rel, asked, model.name)).select(
        "model", "num_queries", "mrr", "recall_at_10", "precision_at_10")


# ---------------------------------------------------------------------------
# Language-model data and scoring (byte-model tokens of the analysis text).
# ---------------------------------------------------------------------------

from ..operators import lm  # noqa: E402
from ..operators.ordering import split_80_10_10  # noqa: E402
from .oracle import TOKENS_SQL  # noqa: E402

SEQ_LEN, STRIDE = 128, 64
LM_VOCAB = 259 + 1  # byte-model ids 0..258, plus one for padding
ALPHA = 0.1
ALPHAS = (0.01, 0.1, 1.0)

_SPLIT_SQL = """split AS (
  SELECT doc_id, CASE WHEN rk < floor(n * 0.8) THEN 'train'
                      WHEN rk < floor(n * 0.8) + floor(n * 0.1) THEN 'validation'
                      ELSE 'test' END AS split
  FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42' || doc_id::VARCHAR), doc_id) - 1 AS rk,
               count(*) OVER () AS n FROM documents))"""
_LM_DOCS_SQL = f"""{_SPLIT_SQL},
lmdocs AS (SELECT d.doc_id, s.split, d.source || ' ' || d.text AS text,
             {TOKENS_SQL['byte'].format(t="(d.source || ' ' || d.text)")} AS t
           FROM documents d JOIN split s USING (doc_id)),
pairs AS (SELECT split, t[i] AS ctx, t[i + 1] AS tok
          FROM (SELECT split, t, unnest(range(1, len(t))) AS i FROM lmdocs)),
train_counts AS (SELECT ctx, tok, count(*) AS cnt FROM pairs WHERE split = 'train'
                 GROUP BY ctx, tok),
ctxc AS (SELECT ctx, sum(cnt) AS cc FROM train_counts GROUP BY ctx)"""


def _lm_docs(spark, sf_dir):
    d = corpus(spark, sf_dir).select("doc_id", content_for_analysis("title", "text").alias("text"))
    d = split_80_10_10(d, "doc_id", seed=42)
    return d.withColumn("tokens", byte_tokens("text"))


def _md5_of(tokens: str):
    """Digest of a whole token list."""
    return F.md5(F.array_join(F.col(tokens).cast("array<string>"), ","))


@register("split_80_10_10", "WITH " + _SPLIT_SQL + "\nSELECT doc_id, split FROM split")
def q_split_80_10_10(spark, sf_dir):
    return split_80_10_10(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", seed=42)


@register("lm_windows", f"""WITH d AS (
  SELECT doc_id, {TOKENS_SQL['byte'].format(t="(source || ' ' || text)")} AS t FROM documents),
w AS (SELECT doc_id, t, unnest(range(0, len(t) - {SEQ_LEN} - 1, {STRIDE})) AS start FROM d)
SELECT doc_id, start, md5(array_to_string(t[start + 1:start + {SEQ_LEN}], ',')) AS input_md5,
       md5(array_to_string(t[start + 2:start + {SEQ_LEN} + 1], ',')) AS target_md5 FROM w""")
def q_lm_windows(spark, sf_dir):
    d = corpus(spark, sf_dir).select(
        "doc_id", byte_tokens(content_for_analysis("title", "text")).alias("tokens"))
    w = lm.lm_windows(d, "tokens", SEQ_LEN, STRIDE)
    return w.select("doc_id", F.col("start").cast("bigint").alias("start"),
                    _md5_of("input").alias("input_md5"), _md5_of("target").alias("target_md5"))


MAX_TOKENS = 512


@register("truncate_tokens", f"""SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ',')) AS ids_md5
FROM (SELECT doc_id, CASE WHEN len(t) > {MAX_TOKENS} THEN t[1:{MAX_TOKENS - 1}] || [1] ELSE t END AS t
      FROM (SELECT doc_id, {TOKENS_SQL['byte'].format(t="(source || ' ' || text)")} AS t FROM documents))""")
def q_truncate_tokens(spark, sf_dir):
    """Byte-model ids cut to the model's limit, its end mark inside."""
    cut = replace(MODELS["byte-hashed"].tokenizer, max_length=MAX_TOKENS)
    d = corpus(spark, sf_dir).select("doc_id", cut.tokens(content_for_analysis("title", "text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), _md5_of("t").alias("ids_md5"))


@register("ngram_counts", "WITH " + _LM_DOCS_SQL + "\nSELECT ctx, tok, cnt FROM train_counts")
def q_ngram_counts(spark, sf_dir):
    d = _lm_docs(spark, sf_dir)
    return lm.ngram_counts(d.where(F.col("split") == "train"), "tokens")


@register("lm_eval", "WITH " + _LM_DOCS_SQL + f""",
ev AS (SELECT ctx, tok, count(*) AS n FROM pairs WHERE split = 'test' GROUP BY ctx, tok),
j AS (SELECT ev.n, coalesce(tc.cnt, 0) AS c, coalesce(ctxc.cc, 0) AS cc
      FROM ev LEFT JOIN train_counts tc USING (ctx, tok) LEFT JOIN ctxc USING (ctx)),
s AS (SELECT sum(n)::BIGINT AS n_pairs, sum(n * -ln((c + {ALPHA}) / (cc + {ALPHA} * {LM_VOCAB}))) AS nll
      FROM j),
ch AS (SELECT sum(length(text)) AS chars FROM lmdocs WHERE split = 'test')
SELECT n_pairs, round(nll / n_pairs, 6) AS loss, round(exp(nll / n_pairs), 6) AS perplexity,
       round(nll / n_pairs / ln(2), 6) AS bits_per_token,
       round(nll / (ln(2) * chars), 6) AS bits_per_char FROM s, ch""")
def q_lm_eval(spark, sf_dir):
    d = _lm_docs(spark, sf_dir)
    counts = lm.ngram_counts(d.where(F.col("split") == "train"), "tokens")
    test = d.where(F.col("split") == "test")
    pairs = lm.ngram_counts(test, "tokens")
    res = lm.lm_eval(counts, pairs, LM_VOCAB, ALPHA,
                     chars=test.select(F.length("text").alias("n_chars")))
    return round_metrics(res)


@register("lm_select", "WITH " + _LM_DOCS_SQL + f""",
ev AS (SELECT ctx, tok, count(*) AS n FROM pairs WHERE split = 'validation' GROUP BY ctx, tok),
j AS (SELECT ev.n, coalesce(tc.cnt, 0) AS c, coalesce(ctxc.cc, 0) AS cc
      FROM ev LEFT JOIN train_counts tc USING (ctx, tok) LEFT JOIN ctxc USING (ctx)),
grid AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a})' for i, a in enumerate(ALPHAS))})
         g(grid_idx, alpha)),
per AS (SELECT grid_idx, alpha, sum(n * -ln((c + alpha) / (cc + alpha * {LM_VOCAB}))) / sum(n)
        AS loss FROM j, grid GROUP BY grid_idx, alpha)
SELECT grid_idx, alpha::DOUBLE AS alpha, round(loss, 6) AS loss,
       (SELECT arg_min(alpha, (loss, grid_idx)) FROM per)::DOUBLE AS best_alpha FROM per""")
def q_lm_select(spark, sf_dir):
    d = _lm_docs(spark, sf_dir)
    counts = lm.ngram_counts(d.where(F.col("split") == "train"), "tokens")
    pairs = lm.ngram_counts(d.where(F.col("split") == "validation"), "tokens")
    res = lm.lm_select(counts, pairs, LM_VOCAB, ALPHAS)
    return round_metrics(res.select(F.col("grid_idx").cast("int"), "alpha", "loss", "best_alpha"))


@register("oov_rate", "WITH " + _SPLIT_SQL + f""",
w AS (SELECT s.split, unnest(regexp_extract_all(d.source || ' ' || d.text, '{_WORD_RE}')) AS word
      FROM documents d JOIN split s USING (doc_id)),
voc AS (SELECT DISTINCT word FROM w WHERE split = 'train'),
t AS (SELECT word FROM w WHERE split = 'test')
SELECT count(*) FILTER (WHERE word NOT IN (SELECT word FROM voc))::BIGINT AS oov_tokens,
       count(*)::BIGINT AS test_tokens,
       round(count(*) FILTER (WHERE word NOT IN (SELECT word FROM voc)) / count(*), 6) AS oov_rate
FROM t""")
def q_oov_rate(spark, sf_dir):
    d = corpus(spark, sf_dir).select("doc_id", content_for_analysis("title", "text").alias("text"))
    d = split_80_10_10(d, "doc_id", seed=42)
    words = d.select("split", F.explode(F.regexp_extract_all("text", F.lit(_WORD_RE_JAVA), 0))
                     .alias("word"))
    return round_metrics(lm.oov_rate(words.where(F.col("split") == "train"),
                                     words.where(F.col("split") == "test")))


from ..functions.text import WORD as _WORD_RE_JAVA  # noqa: E402


# ---------------------------------------------------------------------------
# BPE on the documents with a table that SQL can apply as well. Training, and
# what is done with trained tables, is in ``queries_models``.
# ---------------------------------------------------------------------------

from ..operators import bpe  # noqa: E402

# A fixed table of ASCII merges, so that SQL can encode as well: greedy encoding
# takes the longest string that merges with a byte on the right can spell.
FIXED_STRINGS = ("th", "the", "the ", "he", "in", "ing", "ing ", "er", "on", "an", "and", "and ", "re", "ti", "tio", "tion",
                 " t", " th", "en", "es", "e ", ", ", "de", "la", "ch")


def _fixed_merges() -> dict[tuple[int, int], int]:
    """(left, right) -> id; every string but the last byte is one before it."""
    ids = {bytes([i]): i for i in range(256)}
    for text in FIXED_STRINGS:
        ids[text.encode()] = 256 + len(ids) - 256
    return {(ids[t.encode()[:-1]], t.encode()[-1]): ids[t.encode()] for t in FIXED_STRINGS}


_FIXED_TOKENS = """(SELECT flatten(list_transform(regexp_extract_all({t}, '{alternatives}|[\\s\\S]'),
  lambda x: CASE {cases} ELSE list_transform(range(strlen(x)), lambda j: ('0x' || substr(hex(x), 2*j+1, 2))::INT) END)))"""


def _fixed_tokens_sql(t: str) -> str:
    longest_first = sorted(FIXED_STRINGS, key=lambda x: (-len(x), x))
    cases = " ".join(f"WHEN x = '{x}' THEN [{256 + FIXED_STRINGS.index(x)}]" for x in FIXED_STRINGS)
    return _FIXED_TOKENS.format(t=t, alternatives="|".join(longest_first), cases=cases).replace("\\\\", "\\")


@register("bpe_encode", f"""SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ',')) AS ids_md5, true AS roundtrip
FROM (SELECT doc_id, {_fixed_tokens_sql('text')} AS t FROM documents)""")
def q_bpe_encode(spark, sf_dir):
    m = _fixed_merges()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    enc = docs.select("doc_id", "text", bpe.bpe_encode_col("text", m).alias("ids"))
    return enc.select("doc_id", F.size("ids").alias("n_tokens"), _md5_of("ids").alias("ids_md5"),
                      (bpe.bpe_decode("ids", m) == F.col("text")).alias("roundtrip"))


def _fixed_stats_sql() -> str:
    bpe_tok = f"""tok AS (
  SELECT 'bpe' AS tokenizer, doc_id, pos, text, {_fixed_tokens_sql('text')} AS tokens FROM d),
counted AS ("""
    sql = _TOK_SQL[:_TOK_SQL.index("tok AS (")] + bpe_tok + _TOK_SQL[_TOK_SQL.index("counted AS (") + len("counted AS ("):]
    old = f"(VALUES ('byte', {BYTE_VOCAB_SIZE}), ('char', {CHAR_VOCAB_SIZE}))"
    assert old in sql
    return sql.replace(old, f"(VALUES ('bpe', {256 + len(FIXED_STRINGS)}))") + "\nSELECT * FROM stats"


@register("bpe_token_stats", _fixed_stats_sql())
def q_bpe_token_stats(spark, sf_dir):
    m = _fixed_merges()
    d = _analysis_docs(spark, sf_dir)
    tok = d.select(F.lit("bpe").alias("tokenizer"), "doc_id", "pos", "text",
                   bpe.bpe_encode_col("text", m).alias("tokens"))
    sizes = spark.createDataFrame([("bpe", 256 + len(m))], "tokenizer string, vocab_size long")
    return round_metrics(tokstats.analyze(tok, sizes))


# ---------------------------------------------------------------------------
# Vector utilities on ``embeddings``.
# ---------------------------------------------------------------------------


def _dims(df: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    return df.select(key, F.posexplode(vec).alias("idx", "value")).select(
        key, F.col("idx").cast("bigint").alias("idx"), F.round("value", 6).alias("value"))


@register("l2_normalize", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS nn FROM e),
x AS (SELECT vec_id, unnest(v) AS value, unnest(range(len(v))) AS idx, nn FROM n)
SELECT vec_id, idx, round(CASE WHEN nn > 0 THEN value / nn ELSE 0.0 END, 6) AS value FROM x""")
def q_l2_normalize(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    return _dims(vectorize.normalize_rows(emb, "embedding"), "vec_id")


@register("mean_pool", """
WITH e AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v,
                  unnest(range(len(embedding))) AS idx FROM embeddings),
m AS (SELECT label, idx, avg(v) AS v FROM e GROUP BY label, idx),
n AS (SELECT label, sqrt(sum(v * v)) AS nn FROM m GROUP BY label)
SELECT label, idx, round(CASE WHEN nn > 0 THEN v / nn ELSE 0.0 END, 6) AS value
FROM m JOIN n USING (label)""")
def q_mean_pool(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    pooled = vectorize.mean_pool(emb, ["label"], "embedding")
    return _dims(vectorize.normalize_rows(pooled, "embedding"), "label")


# ---------------------------------------------------------------------------
# Typo robustness: swap two adjacent characters of every evaluated query at
# a position fixed by its id, evaluate again and report the drop.
# ---------------------------------------------------------------------------

TYPO_MULT = 7919


def typo_swap(text, qid):
    """Swap characters p and p+1 (0-based), p = (id * 7919) mod (length - 1);
    texts shorter than 2 characters stay as they are."""
    n = F.length(text)
    p = F.pmod(qid.cast("long") * TYPO_MULT, F.greatest(n - 1, F.lit(1))).cast("int")
    swapped = F.concat(F.substring(text, 1, p), F.substring(text, p + 2, 1),
                       F.substring(text, p + 1, 1),
                       F.substring(text, p + 3, 1 << 30))
    return F.when(n >= 2, swapped).otherwise(text)


def _typo_sql() -> str:
    clean = _flagship_sql("SELECT * FROM wide")
    typo = clean.replace(
        "qtext AS (SELECT b.item_id AS query_id, b.text FROM benchmark b JOIN asked a ON a.query_id = b.item_id)",
        f"""qtext AS (SELECT b.item_id AS query_id, CASE WHEN length(b.text) >= 2 THEN
             substr(b.text, 1, p) || substr(b.text, p + 2, 1) || substr(b.text, p + 1, 1)
             || substr(b.text, p + 3) ELSE b.text END AS text
           FROM (SELECT *, ((item_id * {TYPO_MULT}) % greatest(length(text) - 1, 1))::INT AS p
                 FROM benchmark) b JOIN asked a ON a.query_id = b.item_id)""")
    return f"""WITH c AS ({clean}), t AS ({typo})
SELECT c.model, c.mrr AS mrr_clean, t.mrr AS mrr_typo, round(c.mrr - t.mrr, 6) AS mrr_drop,
       c.recall_at_10 AS recall_at_10_clean, t.recall_at_10 AS recall_at_10_typo,
       round(c.recall_at_10 - t.recall_at_10, 6) AS recall_at_10_drop
FROM c JOIN t USING (model)"""


@register("typo_robustness", _typo_sql())
def q_typo_robustness(spark, sf_dir):
    docs, kept, qs, qr, aligned = _prepared(spark, sf_dir, None)
    models = [MODELS["byte-hashed"], MODELS["char-hashed"]]
    qtext = aligned.join(qs.select("query_id"), "query_id")
    clean = round_metrics(jobs.evaluate(kept, qtext, qr, models))
    typo_q = qtext.withColumn("text", typo_swap(F.col("text"), F.col("query_id")))
    typo = round_metrics(jobs.evaluate(kept, typo_q, qr, models))
    c = clean.select("model", F.col("mrr").alias("mrr_clean"),
                     F.col("recall_at_10").alias("recall_at_10_clean"))
    t = typo.select("model", F.col("mrr").alias("mrr_typo"),
                    F.col("recall_at_10").alias("recall_at_10_typo"))
    j = c.join(t, "model")
    return j.select("model", "mrr_clean", "mrr_typo",
                    F.round(F.col("mrr_clean") - F.col("mrr_typo"), 6).alias("mrr_drop"),
                    "recall_at_10_clean", "recall_at_10_typo",
                    F.round(F.col("recall_at_10_clean") - F.col("recall_at_10_typo"), 6)
                    .alias("recall_at_10_drop"))


# ---------------------------------------------------------------------------
# Tokenizer comparison with trained tokenizers (rows only: BPE and WordPiece
# encoders have no SQL form over whole texts) and trained vectors.
# ---------------------------------------------------------------------------

from ..operators import wordpiece  # noqa: E402

WP_VOCAB = 2000


@register("tokenizer_comparison")
def q_tokenizer_comparison(spark, sf_dir):
    """Bytes, characters, the trained merges (greedy, and by rank), a published
    table of ranks and trained word pieces on the whole corpus."""
    from ..operators import ranked_bpe
    from .queries_models import published, trained_merges, trained_pieces

    d = _analysis_docs(spark, sf_dir)
    merges, vocab, known = trained_merges(spark, sf_dir), trained_pieces(spark, sf_dir), published()
    ranked = ranked_bpe.RankedTable.trained(merges)
    toks = {
        "byte": (lambda c: byte_tokens(c), BYTE_VOCAB_SIZE),
        "char": (lambda c: char_tokens(c), CHAR_VOCAB_SIZE),
        "bpe": (lambda c: bpe.bpe_encode_col(c, merges), 256 + len(merges)),
        "bpe-ranked": (lambda c: ranked_bpe.ranked_tokens(c, ranked, ranked_bpe.WORDS), 256 + len(merges)),
        "bpe-published": (lambda c: ranked_bpe.ranked_tokens(c, known), 256 + len(known.merges)),
        "wordpiece": (lambda c: wordpiece.wordpiece_tokens(c, vocab), len(vocab)),
    }
    stats, _ = jobs.analyze_tokenizers(d, toks)
    return round_metrics(stats)


@register("wordpiece_frequency")
def q_wordpiece_frequency(spark, sf_dir):
    from .queries_models import trained_pieces

    d = _analysis_docs(spark, sf_dir)
    vocab = trained_pieces(spark, sf_dir)
    tok = d.select(F.lit("wordpiece").alias("tokenizer"), "doc_id", "pos", "text",
                   wordpiece.wordpiece_tokens(F.col("text"), vocab).alias("tokens"))
    return tokstats.token_frequency(tok, top=5)


@register("word2vec_metrics")
def q_word2vec_metrics(spark, sf_dir):
    docs, kept, qs, qr, aligned = _prepared(spark, sf_dir, None)
    return round_metrics(jobs.evaluate(kept, aligned, qr, [MODELS["word2vec"]]).drop("dim"))


PCA_WIDTH = 32  # half the width of the given vectors (64)


@register("pca_reduce")
def q_pca_reduce(spark, sf_dir):
    """Every given vector in its first 32 principal components."""
    from ..operators.pca import fit_components, project

    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return project(emb, fit_components(emb, PCA_WIDTH))


@register("lm_generate_batch")
def q_lm_generate_batch(spark, sf_dir):
    """Continue every benchmark passage (whole text as the seed) by 50 tokens
    of the bigram model trained on the training documents."""
    d = _lm_docs(spark, sf_dir)
    counts = lm.ngram_counts(d.where(F.col("split") == "train"), "tokens")
    seeds = test_queries(spark, sf_dir).select(
        F.col("query_id").alias("doc_id"),
        F.filter(byte_tokens("text"), lambda t: t != 1).alias("tokens"))  # drop the end mark
    gen = lm.lm_generate_batch(seeds, counts, LM_VOCAB, new_tokens=50, top_k=20)
    return gen.select(F.col("doc_id").alias("query_id"), F.size("generated").alias("n_tokens"),
                      byte_decode("generated").alias("text"))


from ..functions.tokens import byte_decode  # noqa: E402


@register("lm_generate_greedy", "WITH RECURSIVE " + _LM_DOCS_SQL + f""",
best AS (SELECT ctx, arg_min(tok, (-cnt, tok)) AS nxt FROM train_counts GROUP BY ctx),
seeds AS (SELECT item_id AS query_id, {TOKENS_SQL['byte'].format(t="text")} AS t FROM benchmark),
g AS (SELECT query_id, 0 AS step, CASE WHEN len(t) > 1 THEN t[len(t) - 1] ELSE 0 END AS last FROM seeds
      UNION ALL
      SELECT g.query_id, step + 1, coalesce(b.nxt, 0) FROM g LEFT JOIN best b ON b.ctx = g.last WHERE step < 20)
SELECT query_id, string_agg(last::VARCHAR, ',' ORDER BY step) AS tokens FROM g WHERE step > 0 GROUP BY query_id""")
def q_lm_generate_greedy(spark, sf_dir):
    """The 20 tokens that follow each passage when the likeliest is taken."""
    counts = lm.ngram_counts(_lm_docs(spark, sf_dir).where(F.col("split") == "train"), "tokens")
    seeds = test_queries(spark, sf_dir).select("query_id", F.filter(byte_tokens("text"), lambda t: t != 1).alias("tokens"))
    gen = lm.lm_generate_batch(seeds, counts, LM_VOCAB, key="query_id", new_tokens=20, top_k=1)
    return gen.select("query_id", F.array_join(F.slice("generated", -20, 20).cast("array<string>"), ",").alias("tokens"))


# ---------------------------------------------------------------------------
# Token statistics per text source: prose (documents), markup (pages) and
# dialogue (conversations), byte and character tokenizers.
# ---------------------------------------------------------------------------

_SOURCES_SQL = {
    "documents": "SELECT doc_id, doc_id AS pos, source || ' ' || text AS text FROM documents",
    "pages": "SELECT page_id AS doc_id, page_id AS pos, coalesce(html, '') AS text FROM pages",
    "conversations": ("SELECT conv_id * 100000 + turn AS doc_id, conv_id * 100000 + turn AS pos, "
                      "coalesce(text, '') AS text FROM conversations"),
}


def _sources_sql() -> str:
    docs = " UNION ALL ".join(f"SELECT '{n}' AS src, * FROM ({q})" for n, q in _SOURCES_SQL.items())
    sql = _TOK_SQL.replace(f"WITH d AS ({_DOCS_SQL}),", f"WITH d AS ({docs}),")
    sql = sql.replace("SELECT 'byte' AS tokenizer, doc_id, pos, text,",
                      "SELECT src || '/byte' AS tokenizer, doc_id, pos, text,")
    sql = sql.replace("SELECT 'char' AS tokenizer, doc_id, pos, text,",
                      "SELECT src || '/char' AS tokenizer, doc_id, pos, text,")
    sizes = ", ".join(f"('{n}/byte', {BYTE_VOCAB_SIZE}), ('{n}/char', {CHAR_VOCAB_SIZE})"
                      for n in _SOURCES_SQL)
    sql = sql.replace(f"VALUES ('byte', {BYTE_VOCAB_SIZE}), ('char', {CHAR_VOCAB_SIZE})",
                      f"VALUES {sizes}")
    return sql + "\nSELECT * FROM stats"


@register("source_token_stats", _sources_sql())
def q_source_token_stats(spark, sf_dir):
    srcs = {
        "documents": _analysis_docs(spark, sf_dir).select("doc_id", "pos", "text"),
        "pages": table(spark, sf_dir, "pages").select(
            F.col("page_id").alias("doc_id"), F.col("page_id").alias("pos"),
            F.coalesce("html", F.lit("")).alias("text")),
        "conversations": table(spark, sf_dir, "conversations").select(
            (F.col("conv_id") * 100000 + F.col("turn")).alias("doc_id"),
            (F.col("conv_id") * 100000 + F.col("turn")).alias("pos"),
            F.coalesce("text", F.lit("")).alias("text")),
    }
    frames, sizes = [], []
    for name, d in srcs.items():
        for tname, fn, vsize in (("byte", byte_tokens, BYTE_VOCAB_SIZE),
                                 ("char", char_tokens, CHAR_VOCAB_SIZE)):
            frames.append(d.select(F.lit(f"{name}/{tname}").alias("tokenizer"), "doc_id", "pos",
                                   "text", fn("text").alias("tokens")))
            sizes.append((f"{name}/{tname}", vsize))
    tok = frames[0]
    for f in frames[1:]:
        tok = tok.unionByName(f)
    vs = spark.createDataFrame(sizes, "tokenizer string, vocab_size long")
    return round_metrics(tokstats.analyze(tok, vs))


@register("retrieval_all_models")
def q_retrieval_all_models(spark, sf_dir):
    """The reference's results table: every tokenizer (byte, character,
    trained BPE, trained word pieces) with the same hashed vectorizer, evaluated
    on the test passages in one job; one row per model."""
    from .queries_models import trained_merges, trained_pieces
    from .registry import bpe_model, wordpiece_model

    docs, kept, qs, qr, aligned = _prepared(spark, sf_dir, None)
    merges, vocab = trained_merges(spark, sf_dir), trained_pieces(spark, sf_dir)
    models = [MODELS["byte-hashed"], MODELS["char-hashed"], bpe_model(merges), wordpiece_model(vocab)]
    qtext = aligned.join(qs.select("query_id"), "query_id")
    return round_metrics(jobs.evaluate(kept, qtext, qr, models))


from . import queries_io, queries_models  # noqa: E402, F401  register theirs
