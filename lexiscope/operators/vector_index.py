"""Top-k search by cosine distance over an index of cells.

``build`` fits the centres of cells on a bounded sample by spherical k-means and
assigns every vector to its nearest centre. Each cell knows the angle of its
farthest vector. The vectors are written by cell; a cell above ``BLOCK_ROWS``
vectors is dealt to several blocks.

``search`` sends a query to the cells whose centres are nearest; a task brings the
queries and vectors of one block together and keeps the best k of each query. No
table of pairs is made. With ``exact=True`` a second round follows: a vector of a
cell can be no nearer to a query than the angle between the query and the centre
less the cell's own angle, so the round asks the cells not asked before whose
bound reaches the k-th distance found, and the result is that of comparing
everything.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import checkpoint_dir
from .retrieve import TIE_DIGITS, _block_topk_fn, _rank, _vectors

#: Rows that the centres are fitted on, at most; the number of cells is about the
#: root of the number of vectors, and at most CELLS.
SAMPLE_ROWS = 50_000
CELLS = 4_096
ITERATIONS = 12
PROBES = 8
BLOCK_ROWS = 20_000
QUERY_ROWS = 20_000  # of a cell's queries in one task
BLOCK_CELLS = 1_000_000  # angles computed at once
_SLACK = 1e-6  # radians, for the rounding of angles


@dataclass
class CellIndex:
    """``vectors``: id, cell, vec; ``centres``: a row for each cell, of length 1;
    ``widest``: the largest angle between a centre and a vector of its cell;
    ``rows``: vectors of each cell."""

    vectors: DataFrame
    centres: np.ndarray
    widest: np.ndarray
    rows: np.ndarray


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(length > 0, length, 1.0)[:, None]


def fit_centres(sample: np.ndarray, n: int, iterations: int = ITERATIONS, seed: int = 0) -> np.ndarray:
    """Centres of length 1 by spherical k-means; a cell that loses all its
    vectors takes the vector that fits its own centre least."""
    unit = _unit(sample)
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), min(n, len(unit)), replace=False)]
    step = max(1, BLOCK_CELLS // max(len(centres), 1))
    cell, best = np.zeros(len(unit), np.int64), np.zeros(len(unit))
    for _ in range(iterations):
        for s in range(0, len(unit), step):
            near = unit[s:s + step] @ centres.T
            cell[s:s + step], best[s:s + step] = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, unit)
        empty = np.flatnonzero(np.bincount(cell, minlength=len(centres)) == 0)
        if len(empty):
            sums[empty] = unit[np.argsort(best)[:len(empty)]]
        centres = _unit(sums)
    return centres


def _blocks(batches, cells: int):
    """Batches in blocks of rows, each of which meets all ``cells`` at once."""
    step = max(1, BLOCK_CELLS // max(cells, 1))
    for b in batches:
        for s in range(0, b.num_rows, step):
            yield b.slice(s, step)


def _angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angle of each vector (row) and centre; of a zero vector a right angle."""
    return np.arccos(np.clip(_unit(vectors) @ centres.T, -1.0, 1.0))


def build(vectors: DataFrame, *, key: str = "vec_id", vec: str = "embedding", cells: int | None = None,
          sample_rows: int = SAMPLE_ROWS) -> CellIndex:
    """The index of all rows with a vector; zero vectors are in it, too. Vectors
    of different widths are an error."""
    spark = vectors.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cells-{uuid.uuid4().hex}"
    rows = vectors.select(F.col(key).alias("doc_id"), F.col(vec).cast("array<double>").alias("vec")).where(F.col("vec").isNotNull())
    n = rows.count()
    n_cells = min(CELLS, cells or math.ceil(math.sqrt(n)) or 1)
    scale = 1 << 40
    share = min(scale, math.ceil(scale * sample_rows / max(n, 1)))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share).select("vec").limit(2 * sample_rows).toArrow()
    if not sample.num_rows:
        sample = rows.select("vec").limit(1).toArrow()
    centres = fit_centres(_vectors(sample.column(0)), n_cells) if sample.num_rows else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(centres)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("vec", T.ArrayType(T.DoubleType())),
                           T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    target = to_arrow_schema(schema)

    def assign(batches):
        for b in _blocks(batches, len(shared.value)):
            if b.num_rows:
                mat = _vectors(b.column(1), shared.value.shape[1])
                angle = _angles(mat, shared.value)
                cell = angle.argmin(axis=1)
                own = np.where(mat.any(axis=1), angle[np.arange(len(cell)), cell], 0.0)  # a zero vector comes last anyway
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).cast(target.field(0).type), b.column(1).cast(target.field(1).type), pa.array(cell.astype(np.int32)),
                     pa.array(own)], schema=target)

    rows.mapInArrow(assign, schema).write.parquet(path)
    held = spark.read.parquet(path)
    widest, counts = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in held.groupBy("cell").agg(F.max("angle").alias("a"), F.count("*").alias("n")).collect():  # a row for each cell
        widest[r["cell"]], counts[r["cell"]] = r["a"], r["n"]
    return CellIndex(held, centres, widest, counts)


def _asked(queries: DataFrame, index: CellIndex, cells_of) -> DataFrame:
    """``queries`` with each cell that ``cells_of(angles, batch)`` names for them."""
    shared = queries.sparkSession.sparkContext.broadcast(index.centres)
    schema = T.StructType([queries.schema["query_id"], queries.schema["vec"], T.StructField("cell", T.IntegerType())])

    def ask(batches):
        for b in _blocks(batches, len(shared.value)):
            b = b.filter(b.column(1).is_valid())
            if b.num_rows and len(shared.value):
                row, cell = cells_of(_angles(_vectors(b.column(1), shared.value.shape[1]), shared.value), b)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cell.astype(np.int32))],
                                                 names=["query_id", "vec", "cell"])

    return queries.mapInArrow(ask, schema)


def _scan(asked: DataFrame, index: CellIndex, kk: int, exclude_self: bool) -> DataFrame:
    """The best of each query in each block of the cells asked."""
    spark = asked.sparkSession
    docs = index.vectors.select("doc_id", "vec", "cell")
    blocks = [(c, max(1, math.ceil(int(n) / BLOCK_ROWS))) for c, n in enumerate(index.rows)]
    sides = asked.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(QUERY_ROWS)).cast("int").alias("qn"))
    cells = F.broadcast(spark.createDataFrame(blocks, "cell int, dn int").join(sides, "cell"))  # a row for each cell
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    none = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
    left = asked.join(cells, "cell").select("cell", part("query_id", "qn").alias("q"), span("dn").alias("d"), "dn", F.lit(0).alias("side"),
                                            "query_id", none(docs.schema["doc_id"]), "vec")
    right = docs.join(cells, "cell").select("cell", span("qn").alias("q"), part("doc_id", "dn").alias("d"), "dn", F.lit(1).alias("side"),
                                            none(asked.schema["query_id"]), "doc_id", "vec")
    dealt = left.unionByName(right).select("cell", (F.col("q") * F.col("dn") + F.col("d")).alias("block"), "side", "query_id", "doc_id", "vec") \
        .repartition("cell", "block").sortWithinPartitions("cell", "block", "side")
    schema = T.StructType([asked.schema["query_id"], docs.schema["doc_id"], T.StructField("distance", T.DoubleType()),
                           T.StructField("_key", T.DoubleType())])
    return dealt.mapInArrow(_block_topk_fn(kk, exclude_self, [], to_arrow_schema(schema)), schema)


def search(index: CellIndex, queries: DataFrame, k: int = 15, *, query_id: str = "query_id", query_vec: str = "embedding",
           probes: int = PROBES, exact: bool = False, exclude_self: bool = False) -> DataFrame:
    """``query_id, doc_id, distance, rank``: the k nearest vectors of each query
    among the ``probes`` nearest cells, or of all with ``exact=True``. Ties as in
    ``topk_cosine``; a zero vector has distance NaN and ranks last. A query
    without a vector finds nothing."""
    spark = queries.sparkSession
    checkpoint_dir(spark)
    kk = k + exclude_self
    # a zero vector of either side is at no angle: such queries go everywhere, such vectors match last
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("vec")).checkpoint()
    n_cells = len(index.centres)
    live = index.rows > 0

    def nearest(angles, b):
        angles = np.where(live, angles, np.inf)
        some = np.argpartition(angles, min(probes, n_cells) - 1, axis=1)[:, :probes]
        return np.repeat(np.arange(len(angles)), some.shape[1]), some.ravel()

    found = _scan(_asked(asked, index, nearest).checkpoint(), index, kk, exclude_self)
    if not exact or probes >= n_cells:
        return _rank(found, k)
    found = found.checkpoint()
    reached = _rank(found, k).groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.coalesce(F.nanvl("distance", F.lit(9.0)), F.lit(9.0))).alias("far"))
    again = asked.join(reached.hint("shuffle_hash"), "query_id", "left") \
        .select("query_id", "vec", F.when(F.col("n") >= k, F.col("far")).otherwise(9.0).alias("far"))
    widest = index.widest

    def others(angles, b):
        far = b.column(2).to_numpy(zero_copy_only=False)
        reach = np.where(far > 2.5, np.inf, np.arccos(np.clip(1.0 - far - 2 * 10.0 ** -TIE_DIGITS, -1.0, 1.0)))
        zero = ~np.any(_vectors(b.column(1)), axis=1)
        can = (angles - widest[None, :] <= reach[:, None] + _SLACK) | zero[:, None]
        can &= live[None, :]
        rows, some = nearest(angles, b)
        can[rows, some] = False
        return np.nonzero(can)

    rest = _scan(_asked(again, index, others).checkpoint(), index, kk, exclude_self)
    return _rank(found.unionByName(rest), k)


def tune_probes(index: CellIndex, queries: DataFrame, k: int, wanted: float, *, query_id: str = "query_id",
                query_vec: str = "embedding", sample: int = 200) -> int:
    """The least number of cells to ask so that the share ``wanted`` of the k
    nearest vectors of about ``sample`` queries lie in them."""
    n = queries.count()
    scale = 1 << 40
    share = min(scale, math.ceil(scale * sample / max(n, 1)))
    some = queries.where(F.col(query_vec).isNotNull() & (F.pmod(F.xxhash64(query_id), F.lit(scale)) < share))
    some = some.limit(2 * sample).select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("vec")).checkpoint()
    hits = search(index, some, k, query_vec="vec", exact=True).select("query_id", "doc_id")
    cells = index.vectors.select("doc_id", "cell").join(F.broadcast(hits), "doc_id").select("query_id", "cell").toArrow()
    held = some.toArrow()
    if not held.num_rows or not cells.num_rows:
        return min(PROBES, max(1, len(index.centres)))
    angles = np.where(index.rows > 0, _angles(_vectors(held.column(1)), index.centres), np.inf)
    place = np.argsort(np.argsort(angles, axis=1, kind="stable"), axis=1, kind="stable")
    row = {q: i for i, q in enumerate(held.column(0).to_pylist())}
    asked = np.sort([place[row[q], c] for q, c in zip(cells.column(0).to_pylist(), cells.column(1).to_pylist(), strict=True)])
    return int(asked[min(len(asked), math.ceil(wanted * len(asked))) - 1]) + 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, pairs of the exact result, the share of them found."""
    pairs = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id").withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return pairs.agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_pairs"),
                     (F.count("hit") / F.count("*")).alias("recall"))
