"""N-gram Jaccard self-join by chosen paths.

Every document becomes the set of its five-word shingles. Documents with equal
sets are one class, and only classes are joined. To join, each set is reduced
to ``COORDINATES`` minimum hashes; two sets of similarity s agree in each with
probability s. A run starts a path for every class and extends it by the values
of a few sampled coordinates, 1/threshold of them on average, so a class sits
at the ends of several paths. Classes at the same end form a bucket. A bucket
of more than ``BUCKET`` members is split by one more step, up to ``DEPTH``
steps, after which its members are alike; buckets are then compared by brute
force, large ones block against block in separate tasks. The number of runs
follows from the chance that a pair at the threshold shares the end of a path
at the full depth, and the target recall.

A bucket task compares the minimum hashes and keeps links that could reach the
threshold (more than five standard deviations below it) as stars, not as
pairs. The connected groups of these are small; the shingle sets of their
members, and of no others, are then made again from the texts, brought together
once for each group and compared exactly. The exact comparison counts the
links of each class; pairs are never written out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.arrow_rows import rows_to, table, utf8
from lexiscope.llm.components import connected_components
from lexiscope.llm.decontaminate import find_words, hash_words
from lexiscope.session import checkpoint_dir

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
COORDINATES = 64
BUCKET = 400
DEPTH = 3
BLOCK = 256
BLOCK_SHINGLES = 400_000
_SEEDS = np.arange(1, COORDINATES + 1, dtype=np.uint64)


def mix(x):
    """splitmix64 of an array or number of 64 bits."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_A = mix(_SEEDS) | np.uint64(1)
_B = mix(_SEEDS + np.uint64(1 << 32))


# --------------------------------------------------------------- shingle sets

def shingle_sets(offsets: np.ndarray, data: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A text of fewer words,
    but not none, is one shingle; a text without words has none."""
    folded, starts, ends, first = find_words(offsets, data)
    h = mix(hash_words(folded, starts, ends))
    n = len(h) - words + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(words if n > 0 else 0):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + h[j:j + n]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a:b - words + 1]))
        else:
            short = np.uint64(b - a)
            for x in h[a:b]:
                short = mix(short ^ x)
            out.append(np.array([short] if b > a else [], dtype=np.uint64))
    return out


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that tell sets apart."""
    with np.errstate(over="ignore"):
        one = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
        two = np.array([mix(s ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    return one.view(np.int64), two.view(np.int64)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``COORDINATES`` 32-bit values for each set; sets are not empty."""
    out = np.empty((len(sets), COORDINATES), dtype=np.uint32)
    if not sets:
        return out
    every = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    with np.errstate(over="ignore"):
        for c in range(COORDINATES):
            out[:, c] = np.minimum.reduceat((every * _A[c] + _B[c]) >> np.uint64(32), at)
    return out


def document_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, th, n, node, check, sig) of each row: doc_id, text hash, number of
    shingles, two digests of the set, minimum hashes (null for an empty set)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")) \
        .withColumn("th", F.xxhash64("text"))

    def make(part: pa.RecordBatch):
        sets = shingle_sets(*utf8(part.column(1)), words)
        n = np.array([len(s) for s in sets], dtype=np.int32)
        one, two = digests(sets)
        sig = np.zeros((len(sets), COORDINATES), dtype=np.uint32)
        sig[n > 0] = minhashes([s for s in sets if len(s)])
        yield pa.RecordBatch.from_arrays([
            part.column(0), part.column(2), pa.array(n), pa.array(one), pa.array(two),
            pa.array([r.tobytes() if k else None for r, k in zip(sig, n, strict=True)], pa.binary())],
            names=["id", "th", "n", "node", "check", "sig"])

    return rows_to(rows, "text", "id long, th long, n int, node long, check long, sig binary", make, 1 << 20)


# ---------------------------------------------------------------- chosen paths

def survival(depth: int, threshold: float) -> float:
    """The chance that a pair at the threshold shares the end of a path: each
    node takes one coordinate, and a second with the chance that makes
    1/threshold on average."""
    extra, alive = 1 / threshold - 1, 1.0
    for _ in range(depth):
        lost = 1 - threshold * alive
        alive = 1 - ((1 - extra) * lost + extra * lost * lost)
    return alive


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth, threshold)))


def extend(paths: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(longer paths, row each comes from): the coordinates a node samples
    depend on its path alone, so all sets on a path take the same."""
    rows = np.arange(len(paths))
    out, src = [], []
    second = mix(paths ^ np.uint64(77)) < np.uint64(int((1 / threshold - 1) * 2.0 ** 64))
    for j, take in ((0, np.ones(len(paths), dtype=bool)), (1, second)):
        coordinate = ((mix(paths) >> np.uint64(8 + 24 * j)) % np.uint64(COORDINATES)).astype(np.int64)
        if j:  # not the first one again
            one = ((mix(paths) >> np.uint64(8)) % np.uint64(COORDINATES)).astype(np.int64)
            coordinate = np.where(coordinate == one, (coordinate + 1) % COORDINATES, coordinate)
        value = sig[rows, coordinate].astype(np.uint64)
        longer = mix(paths ^ mix(value | (coordinate.astype(np.uint64) << np.uint64(32))))
        out.append(longer[take])
        src.append(rows[take])
    return np.concatenate(out), np.concatenate(src)


def _sig(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)


def _step(nodes: DataFrame, threshold: float) -> DataFrame:
    """(path, node, sig) -> (path, node) one step further."""
    def step(batches):
        for b in batches:
            if b.num_rows:
                paths, src = extend(b.column(0).to_numpy().view(np.uint64), _sig(b.column(2)), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), b.column(1).take(pa.array(src))],
                                                 names=["path", "node"])

    return nodes.select("path", "node", "sig").mapInArrow(step, "path long, node long")


def buckets(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(path, node, members): the ends of all paths with two members or more."""
    n_runs = runs_needed(threshold, recall)
    roots = mix(np.arange(n_runs, dtype=np.uint64) + np.uint64(1 << 40)).view(np.int64).tolist()
    grown = _step(classes.select(F.explode(F.array(*[F.lit(r) for r in roots])).alias("path"), "node", "sig"), threshold)
    leaves = None
    for depth in range(1, DEPTH + 1):
        sizes = grown.groupBy("path").agg(F.count("*").alias("members")).where("members > 1")
        sized = grown.join(sizes.hint("shuffle_hash"), "path").checkpoint()
        done = sized if depth == DEPTH else sized.where(F.col("members") <= BUCKET)
        leaves = done if leaves is None else leaves.unionByName(done)
        large = sized.where(F.col("members") > BUCKET)
        if depth == DEPTH or large.isEmpty():
            break
        grown = _step(large.join(classes.select("node", "sig").hint("shuffle_hash"), "node"), threshold)
    return leaves


# ---------------------------------------------------------- grouped comparison

def into_blocks(rows: DataFrame, group: str, blocks) -> DataFrame:
    """``rows`` once for each pair of blocks they take part in: columns
    ``a <= b`` name the pair, ``own`` the row's block."""
    own = F.pmod(F.xxhash64("node"), F.col("__blocks")).cast("int")
    return rows.withColumn("__blocks", blocks.cast("int")).withColumn("own", own) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))) \
        .withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")) \
        .drop("__blocks", "other")


def _groups(batches, keys: int):
    """Runs of rows with equal first ``keys`` columns over the stream of sorted
    batches, as tables. Many short runs share a batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(i).to_numpy() for i in range(keys)], axis=1)
        edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        bounds = [0, *edges.tolist(), b.num_rows]
        if held and tuple(key[0]) != last:
            yield pa.Table.from_batches(held)
            held = []
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            if held and s:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
        last = tuple(key[-1])
    if held:
        yield pa.Table.from_batches(held)


def roots_of(linked: np.ndarray) -> np.ndarray:
    """The first member of each member's connected group."""
    n = len(linked)
    root = np.arange(n)
    linked = linked | linked.T | np.eye(n, dtype=bool)
    while True:
        new = np.where(linked, root[None, :], n).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _cross(a: int, b: int, own: np.ndarray) -> np.ndarray:
    """Which pairs this pair of blocks answers for."""
    return np.ones((len(own), len(own)), dtype=bool) if a == b else own[:, None] != own[None, :]


def _bucket_links(leaves: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Stars (first, node) over the classes that may reach the threshold."""
    least = COORDINATES * threshold - 5 * math.sqrt(COORDINATES * threshold * (1 - threshold))
    rows = into_blocks(leaves, "path", F.ceil(F.col("members") / F.lit(BLOCK)))
    rows = rows.join(classes.select("node", "sig").hint("shuffle_hash"), "node").select("path", "a", "b", "own", "node", "sig")
    rows = rows.repartition("path", "a", "b").sortWithinPartitions("path", "a", "b", "node")

    def compare(batches):
        first, second = [], []
        for g in _groups(batches, 3):
            if g.num_rows < 2:
                continue
            node, sig = g.column(4).to_numpy(), _sig(g.column(5))
            if len(node) == 2:
                if np.count_nonzero(sig[0] == sig[1]) >= least and node[0] != node[1]:
                    first.append(node[:1])
                    second.append(node[1:])
                continue
            same = np.zeros((len(node), len(node)), dtype=np.int16)
            for c in range(COORDINATES):
                same += sig[:, c, None] == sig[None, :, c]
            own = g.column(3).to_numpy()
            root = roots_of((same >= least) & _cross(g.column(1)[0].as_py(), g.column(2)[0].as_py(), own))
            tied = np.flatnonzero((root != np.arange(len(node))) & (node[root] != node))
            first.append(node[root[tied]])
            second.append(node[tied])
            if len(first) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(second))], names=["src", "dst"])
                first, second = [], []
        if first:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(second))], names=["src", "dst"])

    return rows.mapInArrow(compare, "src long, dst long").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, over the shingles that several sets hold."""
    n = len(sets)
    out = np.zeros((n, n), dtype=np.float32)
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[at]
    owner, number = owner[keep], number[at[keep]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    width = 8192
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        s, e = np.searchsorted(number, [start, start + width])
        held = np.zeros((n, width), dtype=np.float32)
        held[owner[s:e], number[s:e] - start] = 1
        out += held @ held.T
    return out


def _exact(docs: DataFrame, members: DataFrame, threshold: float, words: int) -> DataFrame:
    """(node, root, links, alone) from each task: ``root`` is the first member
    of the node's exact group there, ``links`` the documents of other classes at
    the threshold, ``alone`` whether the task saw the whole candidate group."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")) \
        .withColumn("th", F.xxhash64("text")).withColumn("no_id", F.col("id").isNull()) \
        .withColumn("id", F.coalesce("id", F.lit(0)))
    rows = members.withColumn("no_id", F.col("id").isNull()).withColumn("id", F.coalesce("id", F.lit(0)))
    found = texts.join(rows.hint("shuffle_hash"), ["id", "no_id", "th"]).select("text", "node", "check", "size", "group", "members", "shingles")

    def make(part: pa.RecordBatch):
        sets = shingle_sets(*utf8(part.column(0)), words)
        one, two = digests(sets)
        right = np.flatnonzero((one == part.column(1).to_numpy()) & (two == part.column(2).to_numpy()))
        out = part.select(["node", "size", "group", "members", "shingles"]).take(pa.array(right))
        yield out.append_column("set", pa.array([sets[i].tobytes() for i in right], pa.binary()))

    sets = rows_to(found, "text", "node long, size long, group long, members long, shingles long, set binary", make, 1 << 20)
    blocks = F.greatest(F.ceil(F.col("members") / F.lit(BLOCK)),
                        F.least(F.col("members"), F.ceil(F.col("shingles") / F.lit(BLOCK_SHINGLES))))
    rows = into_blocks(sets, "group", blocks)
    rows = rows.select("group", "a", "b", "own", "node", "size", "members", "set") \
        .repartition("group", "a", "b").sortWithinPartitions("group", "a", "b", "node")

    def compare(batches):
        for g in _groups(batches, 3):
            node = g.column(4).to_numpy()
            once = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])  # repeated rows of one document
            g, node = g.take(pa.array(once)), node[once]
            sets = [np.frombuffer(x, dtype=np.uint64) for x in g.column(7).to_pylist()]
            n = np.array([len(s) for s in sets], dtype=np.float32)
            both = overlaps(sets)
            a, b = g.column(1)[0].as_py(), g.column(2)[0].as_py()
            linked = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-3
            np.fill_diagonal(linked, False)
            linked &= _cross(a, b, g.column(3).to_numpy())
            root = node[roots_of(linked)]
            alone = g.column(6).to_numpy() == len(node)
            links = linked @ g.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(links.astype(np.int64)), pa.array(alone)],
                                             names=["node", "root", "links", "alone"])

    return rows.mapInArrow(compare, "node long, root long, links long, alone boolean")


# --------------------------------------------------------------------- the join

def jaccard_groups(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
                   words: int = WORDS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, text_hash (xxhash64 of the text),
    class_id, class_hash, n_links and n_copies.

    ``class_id`` and ``class_hash`` are the doc_id and text hash of the first of
    the documents connected by links of similarity ``threshold`` or more (by id,
    then hash); ``n_links`` counts the other documents
    linked to this one directly, equal shingle sets included; ``n_copies``
    those with an equal set. A null, empty or wordless text links to nothing
    and is a class of its own. Null doc_ids rank last: a class of such rows
    alone has class_id null. Repeated rows are documents of their own. A long
    text is one set of all its shingles. An empty table gives an empty table. Columns other than doc_id and text are not read."""
    checkpoint_dir(docs.sparkSession)
    sets = document_sets(docs, words).checkpoint()
    rank = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("th"))
    classes = sets.where("n > 0").groupBy("node", "check").agg(
        F.count("*").alias("size"), F.min(rank).alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig")) \
        .select("node", "check", "size", "n", "first.id", "first.th", "sig").checkpoint()

    near = connected_components(_bucket_links(buckets(classes, threshold, recall), classes, threshold))
    near = near.join(classes.drop("sig").hint("shuffle_hash"), "node").checkpoint()
    totals = near.groupBy("group").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    members = near.drop("n").join(totals.hint("shuffle_hash"), "group")
    exact = _exact(docs, members, threshold, words).checkpoint()
    split = exact.where("not alone and root != node").select(F.col("root").alias("src"), F.col("node").alias("dst"))
    joined = connected_components(split.distinct()).select("node", F.col("group").alias("wide"))
    groups = exact.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root")) \
        .join(joined.hint("shuffle_hash"), "node", "left") \
        .select("node", "links", F.coalesce("wide", "root").alias("group"))

    known = classes.select("node", "check", "size", rank.alias("first")).join(groups.hint("shuffle_hash"), "node", "left") \
        .withColumn("group", F.coalesce("group", "node")).withColumn("links", F.coalesce("links", F.lit(0)))
    smallest = known.groupBy("group").agg(F.min("first").alias("head"))
    known = known.join(smallest.hint("shuffle_hash"), "group").select("node", "check", "size", "links", "head")
    alone = F.col("n") == 0
    return sets.drop("sig").join(known.hint("shuffle_hash"), ["node", "check"], "left").select(
        F.col("id").alias("doc_id"), F.col("th").alias("text_hash"),
        F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.when(alone, F.col("th")).otherwise(F.col("head.th")).alias("class_hash"),
        F.coalesce(F.col("links") + F.col("size") - 1, F.lit(0)).alias("n_links"),
        F.coalesce(F.col("size") - 1, F.lit(0)).alias("n_copies"))


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash", "class_hash")
