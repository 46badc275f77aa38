"""SQL building blocks for the DuckDB oracle queries.

These strings are the independent check of the Spark plans: the same
definitions written as plain SQL over the given tables.
"""

from __future__ import annotations

KS = (1, 5, 10, 15)


def metrics_sql(top: str, nrel: str, asked: str, group: tuple[str, ...] = ()) -> str:
    """Averages over queries.

    ``top``   relation (group..., query_id, doc_id, rank, is_relevant)
    ``nrel``  relation (group..., query_id, n_relevant)
    ``asked`` relation (group..., query_id): the evaluated queries
    """
    g = list(group)
    keys = ", ".join(g + ["query_id"])
    hits = ",\n    ".join(
        f"sum(CASE WHEN is_relevant AND rank <= {k} THEN 1 ELSE 0 END) AS h{k}" for k in KS)
    join_rel = " AND ".join([f"a.{c} = r.{c}" for c in g + ["query_id"]])
    join_st = " AND ".join([f"a.{c} = s.{c}" for c in g + ["query_id"]])
    nr = "coalesce(r.n_relevant, 0)"
    rec = ",\n      ".join(
        f"CASE WHEN {nr} > 0 THEN coalesce(s.h{k}, 0)::DOUBLE / {nr} ELSE 0.0 END AS recall_at_{k}"
        for k in KS)
    prec = ",\n      ".join(
        f"CASE WHEN {nr} > 0 THEN coalesce(s.h{k}, 0)::DOUBLE / {k} ELSE 0.0 END AS precision_at_{k}"
        for k in KS)
    sel_g = "".join(f"a.{c}, " for c in g)
    avg_cols = ",\n  ".join(
        [f"round(avg(recall_at_{k}), 6) AS recall_at_{k}" for k in KS]
        + [f"round(avg(precision_at_{k}), 6) AS precision_at_{k}" for k in KS])
    out_g = "".join(f"{c}, " for c in g)
    group_by = f"GROUP BY {', '.join(g)}" if g else ""
    return f"""
stats AS (
  SELECT {keys},
    {hits},
    min(CASE WHEN is_relevant THEN rank END) AS first_hit
  FROM {top} GROUP BY {keys}),
per_query AS (
  SELECT {sel_g}a.query_id,
      CASE WHEN s.first_hit IS NOT NULL THEN 1.0 / s.first_hit ELSE 0.0 END AS rr,
      {rec},
      {prec}
  FROM {asked} a LEFT JOIN {nrel} r ON {join_rel} LEFT JOIN stats s ON {join_st})
SELECT {out_g}count(*) AS num_queries, round(avg(rr), 6) AS mrr,
  {avg_cols}
FROM per_query {group_by}"""


def cosine_sql(a: str, b: str) -> str:
    """Cosine distance of two DOUBLE[] expressions, NaN for a zero vector."""
    return (f"CASE WHEN sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) = 0 "
            f"THEN 'NaN'::DOUBLE ELSE 1 - list_dot_product({a}, {b}) / "
            f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END")


# Same whitespace class as ``lexiscope.functions.text.WHITESPACE_CLASS``; RE2
# reads it the way Java does.
WS_CLASS_SQL = ("[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
                "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")


HASH_MULT = 1000003
HASH_MOD = 2147483647

# Token lists of the byte and character tokenizers, written in DuckDB SQL.
BYTES_OF = ("flatten(list_transform(string_split({t}, ''), lambda c: "
            "list_transform(range(strlen(c)), lambda j: ('0x' || substr(hex(c), 2*j+1, 2))::INT)))")
TOKENS_SQL = {
    "byte": "list_transform(" + BYTES_OF + ", lambda b: b + 3) || [1]",
    "char": ("[57344] || (CASE WHEN length({t}) = 0 THEN []::INT[] ELSE "
             "list_transform(string_split({t}, ''), lambda c: unicode(c)) END) || [57345]"),
}


def hashed_weights_sql(docs: str, queries: str | None, dim: int, models: dict[str, str]) -> str:
    """CTEs dw(model, doc_id, bucket, w) and, with queries, qw(model, query_id,
    bucket, w): idf-weighted hashed 1- and 2-gram counts.

    ``docs`` has (doc_id, text); ``queries`` has (query_id, text); ``models``
    maps model name -> tokenizer key of TOKENS_SQL.
    """
    def tok(rel, id_col):
        return " UNION ALL ".join(
            f"SELECT '{m}' AS model, {id_col}, {TOKENS_SQL[k].format(t='text')} AS t FROM {rel}"
            for m, k in models.items())

    def feats(rel, id_col):
        return (f"SELECT model, {id_col}, (({HASH_MULT} + t::BIGINT) % {HASH_MOD}) % {dim} AS bucket "
                f"FROM (SELECT model, {id_col}, unnest(t) AS t FROM {rel}) "
                f"UNION ALL SELECT model, {id_col}, ((((2 * {HASH_MULT} + t[i]::BIGINT) % {HASH_MOD}) "
                f"* {HASH_MULT} + t[i + 1]::BIGINT) % {HASH_MOD}) % {dim} AS bucket "
                f"FROM (SELECT model, {id_col}, t, unnest(range(1, len(t))) AS i FROM {rel})")

    out = f"""dtok AS ({tok(docs, 'doc_id')}),
dtf AS (SELECT model, doc_id, bucket, count(*) AS tf FROM ({feats('dtok', 'doc_id')})
        GROUP BY model, doc_id, bucket),
ndocs AS (SELECT count(*) AS n FROM {docs}),
dfq AS (SELECT model, bucket, count(*) AS df FROM dtf GROUP BY model, bucket),
dw AS (SELECT model, doc_id, bucket, tf * ln((n + 1.0) / (df + 1.0)) AS w
       FROM dtf JOIN dfq USING (model, bucket), ndocs)"""
    if queries:
        out += f""",
qtok AS ({tok(queries, 'query_id')}),
qtf AS (SELECT model, query_id, bucket, count(*) AS tf FROM ({feats('qtok', 'query_id')})
        GROUP BY model, query_id, bucket),
qw AS (SELECT model, query_id, bucket, tf * ln((n + 1.0) / (coalesce(df, 0) + 1.0)) AS w
       FROM qtf LEFT JOIN dfq USING (model, bucket), ndocs)"""
    return out


def hashed_scores_sql(docs: str, asked: str) -> str:
    """CTE scored(model, query_id, doc_id, distance) over every (query, doc)
    pair: cosine of the weighted vectors; needs dw and qw."""
    return f"""dn AS (SELECT model, doc_id, sqrt(sum(w * w)) AS nn FROM dw GROUP BY model, doc_id),
qn AS (SELECT model, query_id, sqrt(sum(w * w)) AS nn FROM qw GROUP BY model, query_id),
dots AS (SELECT q.model, q.query_id, d.doc_id, sum(q.w * d.w) AS dot
         FROM qw q JOIN dw d ON q.model = d.model AND q.bucket = d.bucket
         GROUP BY q.model, q.query_id, d.doc_id),
pairs AS (SELECT m.model, a.query_id, k.doc_id
          FROM (SELECT DISTINCT model FROM dtok) m, {asked} a, {docs} k),
scored AS (
  SELECT p.model, p.query_id, p.doc_id,
    CASE WHEN coalesce(qn.nn, 0) * coalesce(dn.nn, 0) = 0 THEN 'NaN'::DOUBLE
         ELSE 1 - coalesce(dots.dot, 0) / (qn.nn * dn.nn) END AS distance
  FROM pairs p LEFT JOIN qn USING (model, query_id) LEFT JOIN dn USING (model, doc_id)
  LEFT JOIN dots USING (model, query_id, doc_id))"""
