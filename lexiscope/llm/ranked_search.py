"""Ranked lexical search with hashed max-sketches.

The index holds a row for each document: its number of terms, its terms (hashed)
with their frequencies, and a sketch of ``WIDTH`` coordinates. Each term falls
into one coordinate by its hash, and the sketch keeps the largest frequency
there. A term's impact grows with its frequency in a document of given length,
so that is the coordinatewise maximum of the impacts, and it does not depend on
the length of the corpus or on the queries.

To search, a task turns the sketches of some documents into impacts and
multiplies them with the queries' weights per coordinate: one product gives the
upper bounds of all scores. Then, query by query, documents are rescored exactly
in descending order of their bounds until no bound reaches the least of the top
scores so far. What a task returns is bounded by the queries; tops of the tasks
are merged in two levels. Queries are sent in blocks of a fixed number of
bytes; a larger query table is searched block after block.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.llm.arrow_rows import col, rows_to, slices, table, utf8
from lexiscope.llm.decontaminate import find_words, hash_words
from lexiscope.llm.jaccard_join import mix
from lexiscope.session import checkpoint_dir

TOP = 50
WIDTH = 512
FULL = 255  # a frequency of so many or more in a sketch
QUERY_BYTES = 256 << 10
SALTS = 64
DOCUMENTS = 2_048
RESCORED = 32


# ----------------------------------------------------------------------- index

def count_terms(offsets: np.ndarray, data: np.ndarray):
    """(terms of each text with repeats, first entry of each text, term hashes,
    frequencies): a text's entries are its different terms by hash."""
    folded, starts, ends, first = find_words(offsets, data)
    hashes = mix(hash_words(folded, starts, ends))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.r_[at, len(hashes)])
    return np.diff(first), np.searchsorted(text[at], np.arange(len(first))), hashes[at], times


def coordinates(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(WIDTH)).astype(np.int64)


def fold_sketches(entries: np.ndarray, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A row of ``WIDTH`` largest frequencies (at most ``FULL``) for each text."""
    n = len(entries) - 1
    out = np.zeros((n, WIDTH), np.uint8)
    text = np.repeat(np.arange(n), np.diff(entries))
    np.maximum.at(out, (text, coordinates(hashes)), np.minimum(times, FULL).astype(np.uint8))
    return out


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, sketch, terms, times) of every row with a term, written to the
    folder of ``spark.checkpoint.dir`` and read again by column."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/sketches-{uuid.uuid4().hex}"

    def make(part: pa.RecordBatch):
        n, entries, hashes, times = count_terms(*utf8(part.column(1)))
        sketch = fold_sketches(entries, hashes, times)
        raw, counts = hashes.astype("<u8").tobytes(), times.astype("<u4").tobytes()
        some = np.flatnonzero(n)
        bounds = [(int(entries[i]), int(entries[i + 1])) for i in some]
        yield pa.RecordBatch.from_arrays([
            part.column(0).take(pa.array(some)), pa.array(n[some]),
            pa.array([sketch[i].tobytes() for i in some], pa.binary()),
            pa.array([raw[8 * a:8 * b] for a, b in bounds], pa.binary()),
            pa.array([counts[4 * a:4 * b] for a, b in bounds], pa.binary())], names=["doc_id", "n", "sketch", "terms", "times"])

    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    rows_to(rows, "text", "doc_id long, n long, sketch binary, terms binary, times binary", make).write.parquet(path)
    return spark.read.parquet(path)


# --------------------------------------------------------------------- queries

class Queries:
    """A block of queries: the hashes of their terms, and each query's places
    among them. ``weigh`` adds the weights of a corpus."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        offsets = np.cumsum([0] + [len(r) for r in raw])
        _, entries, hashes, _ = count_terms(offsets, np.frombuffer(b"".join(raw), np.uint8))
        self.terms = np.unique(hashes)
        self.places = [np.searchsorted(self.terms, hashes[a:b]) for a, b in zip(entries[:-1], entries[1:], strict=True)]

    def weigh(self, n_docs: int, n_terms: int, found: dict[int, int]) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        known = [found.get(i, 0) for i in range(len(self.terms))]
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in known], dtype=np.float64)
        self.lookup = np.zeros((WIDTH, len(self.places)))
        for q, places in enumerate(self.places):
            np.add.at(self.lookup[:, q], coordinates(self.terms[places]), self.weights[places])

    def impacts(self, times: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of frequencies in documents of ``n`` terms; whole numbers as doubles."""
        m = 100 - 50 + (50 * n * self.n_docs) // self.n_terms
        return ((1_000_000_000 * times) // np.maximum(1000 * times + 20 * m, 1)).astype(np.float64)

    def bounds(self, sketches: np.ndarray, n: np.ndarray) -> np.ndarray:
        """No score of a document (row) for a query (column) is larger."""
        top = self.impacts(sketches.astype(np.int64), n[:, None])
        top[sketches == FULL] = 1_000_000
        return top @ self.lookup


class Tops:
    """The best documents of each query so far."""

    def __init__(self, n: int, top: int):
        self.top = top
        self.least = np.ones(n)  # the score that a document must reach
        self.kept = [np.zeros((0, 3), np.int64)] * n  # score, no id, id
        self.rescored = 0

    def add(self, q: int, rows: np.ndarray) -> None:
        rows = np.concatenate([self.kept[q], rows[rows[:, 0] > 0]])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[:self.top]]
        self.kept[q] = rows
        if len(rows) == self.top:
            self.least[q] = rows[-1, 0]

    def search(self, queries: Queries, ids: np.ndarray, no_id: np.ndarray, n: np.ndarray, sketches: np.ndarray,
               terms: list[bytes], times: list[bytes]) -> None:
        """Take some documents in."""
        hashes = np.frombuffer(b"".join(terms), "<u8")
        entries = np.cumsum([0] + [len(t) // 8 for t in terms])
        at = np.minimum(np.searchsorted(queries.terms, hashes), max(0, len(queries.terms) - 1))
        known = np.flatnonzero(queries.terms[at] == hashes) if len(queries.terms) else np.zeros(0, np.int64)
        place = at[known]
        doc = np.searchsorted(entries, known, side="right") - 1
        impact = queries.impacts(np.frombuffer(b"".join(times), "<u4")[known].astype(np.int64), n[doc])
        first = np.searchsorted(doc, np.arange(len(n) + 1))
        bounds = queries.bounds(sketches, n)
        weight = np.zeros(len(queries.terms))
        for q in np.flatnonzero((bounds >= self.least).any(axis=0)).tolist():
            bound = bounds[:, q]
            order = np.flatnonzero(bound >= self.least[q])
            order = order[np.argsort(-bound[order], kind="stable")]
            weight[queries.places[q]] = queries.weights[queries.places[q]]
            start, size = 0, RESCORED
            while start < len(order) and bound[order[start]] >= self.least[q]:
                some = order[start:start + size]
                sizes = first[some + 1] - first[some]
                own = np.repeat(np.arange(len(some)), sizes)
                entry = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[some], sizes)
                score = np.bincount(own, weight[place[entry]] * impact[entry], len(some)).astype(np.int64)
                self.add(q, np.stack([score, no_id[some], ids[some]], axis=1))
                self.rescored += len(some)
                start, size = start + size, 2 * size
            weight[queries.places[q]] = 0


# ---------------------------------------------------------------------- search

def _document_frequencies(index: DataFrame, queries: Queries) -> dict[int, int]:
    """Place of a query term -> documents that hold it."""
    shared = index.sparkSession.sparkContext.broadcast(queries.terms)

    def count(batches):
        terms = shared.value
        found = np.zeros(len(terms), np.int64)
        for b in batches:
            for part in slices(b, "terms"):
                hashes = np.frombuffer(b"".join(part.column(0).to_pylist()), "<u8")
                at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                found += np.bincount(at[terms[at] == hashes], minlength=len(terms))
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(found[held])], names=["place", "df"])

    if not len(queries.terms):
        return {}
    partial = index.select("terms").mapInArrow(count, "place long, df long")
    return {r["place"]: r["df"] for r in partial.groupBy("place").agg(F.sum("df").alias("df")).collect()}


def _search_block(index: DataFrame, queries: Queries, top: int) -> DataFrame:
    """(item, doc_id, score): the tops of each task."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def search(batches):
        queries = shared.value
        tops = Tops(len(queries.places), top)
        for b in batches:
            for start in range(0, b.num_rows, DOCUMENTS):
                part = b.slice(start, DOCUMENTS)
                ids = part.column(0)
                tops.search(queries, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
                            part.column(1).to_numpy(zero_copy_only=False),
                            np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(-1, WIDTH),
                            part.column(3).to_pylist(), part.column(4).to_pylist())
        rows = np.concatenate([np.zeros((0, 3), np.int64), *tops.kept])
        item = np.repeat(np.arange(len(tops.kept)), [len(k) for k in tops.kept])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(rows[:, 2], mask=rows[:, 1] > 0), pa.array(rows[:, 0])],
                                         names=["item", "doc_id", "score"])

    return index.select("doc_id", "n", "sketch", "terms", "times").mapInArrow(search, "item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The ``top`` documents (doc_id, text) with the highest scores above 0 for
    each item (item_id, text): item_id, rank from 1, doc_id, score; equal scores
    by doc_id, documents without one last.

    Null, empty and wordless texts of either side find nothing. Repeated rows of
    ``docs`` are documents of their own. Rows of ``items`` alike in id and text
    are one item; those of one id with different texts, or without id, are
    ranked each for itself under their id. Long texts are whole documents. Terms
    are told apart by 64 bits of hash. Empty tables give an empty table; columns
    other than those named are not read."""
    spark = docs.sparkSession
    index = build_index(docs)
    total = index.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    asked = items.select(col("item_id").alias("item_id"), col("text").cast("string").alias("text")) \
        .where(F.col("text").isNotNull()).dropDuplicates(["item_id", "text"])
    size = asked.agg(F.sum(F.octet_length("text") + 200).alias("b")).first()["b"] or 0
    n_blocks = max(1, math.ceil(size / query_bytes)) if total["n"] else 0
    id_type = asked.schema["item_id"].dataType
    out = None
    for k in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()
        queries = Queries([r["text"] for r in part])
        queries.weigh(total["n"], total["l"], _document_frequencies(index, queries))
        known = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(part)],
                                      f"item long, item_id {id_type.simpleString()}")
        found = _search_block(index, queries, top).withColumn("block", F.lit(k)).join(F.broadcast(known), "item")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id long, score long")
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = out.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op12_ranked_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
items AS (
    SELECT DISTINCT item_id, unnest(list_distinct(regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
corpus AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM texts WHERE len(t) > 0),
held AS (
    SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
    FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM texts) WHERE term IN (SELECT term FROM items) GROUP BY r, term),
weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM held GROUP BY term), corpus),
scores AS (
    SELECT item_id, r, any_value(doc_id) AS doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM items JOIN held USING (term) JOIN weights USING (term), corpus GROUP BY item_id, r),
ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
    FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
