"""SimHash near-duplicates by vantage-point trees.

A document's fingerprint has a bit set where over half the hashes of its word
shingles have it. Equal fingerprints are one node, and nodes link at ``RADIUS``
or fewer differing bits. The nodes are dealt to shards by a vantage-point tree
that is grown on a bounded sample of them and sent to the tasks: an inner node
of the tree holds a vantage fingerprint and a radius, and a fingerprint goes to
the inner or outer side by its Hamming distance from it. By the triangle
inequality a link crosses the radius only where its inner end lies within
``RADIUS`` of it; such an end is sent to the outer side too, as a query, and a
query goes down every side that its ball overlaps. So each linked pair meets in
the home shard of one of its ends, as a member and either a member or a query.

Within a shard further vantage points part members from queries as long as that
prunes, and the rest is compared exactly. A shard keeps a forest over its rows
instead of the pairs, so what it returns grows with its rows. Where splitting
would send most points to both sides (a dense cluster of near copies) the tree
stops, and a shard above ``BLOCK_ROWS`` rows is compared block against block in
separate tasks.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.arrow_rows import rows_to, table, utf8
from lexiscope.llm.components import connected_components
from lexiscope.llm.jaccard_join import _groups, into_blocks
from lexiscope.session import checkpoint_dir

WORDS = 3
RADIUS = 2
SEED = 42
#: Members a shard should have; the tree has at most so many shards and is grown
#: on about so many sampled fingerprints for each.
SHARD = 4_000
MAX_SHARDS = 1 << 16
SAMPLED = 16
#: A split that sends more than this share to both sides is not made.
CROSSING = 0.75
BLOCK_ROWS = 200_000
CELLS = 1 << 22
CHUNK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


# ---------------------------------------------------------------- fingerprints

def shingle_hashes(raw: bytes, words: int = WORDS):
    """The hashes of all shingles of a UTF-8 text, some at a time: a long text is
    read in runs of about ``CHUNK`` bytes that carry their last words on."""
    start, carried, short = 0, [], True
    while start < len(raw):
        stop = min(start + CHUNK, len(raw))
        if stop < len(raw):
            space = _SPACE.search(raw, stop)
            stop = space.start() if space else len(raw)
        found = carried + raw[start:stop].lower().split()
        start = stop
        if len(found) >= words:
            short = False
            yield [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))]
        carried = found[len(found) - words + 1:] if len(found) >= words else found
    if short and carried:
        yield [xxhash.xxh64_intdigest(b" ".join(carried), SEED)]


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprint_texts(offsets: np.ndarray, data: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The 64-bit fingerprint of each text; zero for a text without words."""
    n = len(offsets) - 1
    set_bits, total = np.zeros((n, 64), dtype=np.int64), np.zeros(n, dtype=np.int64)
    held: list[int] = []
    runs: list[tuple[int, int]] = []

    def count():
        if runs:
            at = np.cumsum([0] + [size for _, size in runs[:-1]])
            sums = np.add.reduceat(_bits(np.array(held, dtype=np.uint64)), at, axis=0, dtype=np.int32)
            np.add.at(set_bits, [row for row, _ in runs], sums)
            held.clear()
            runs.clear()

    raw = data.tobytes()
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for hashes in shingle_hashes(raw[a:b], words):
            held += hashes
            runs.append((row, len(hashes)))
            total[row] += len(hashes)
            if len(held) > 100_000:
                count()
    count()
    return np.packbits(2 * set_bits > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, node) of each row: ``node`` is the fingerprint as a signed long."""
    def make(part: pa.RecordBatch):
        found = fingerprint_texts(*utf8(part.column(1)), words)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["doc_id", "node"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows_to(rows, "text", "doc_id long, node long", make)


# ------------------------------------------------------------------------ tree

def distance(points: np.ndarray, other) -> np.ndarray:
    return np.bitwise_count(points ^ other).astype(np.int16)


class VantageTree:
    """Inner nodes by depth: a vantage fingerprint, a radius, and the places of
    the inner and outer child; a leaf has its shard's number in their stead."""

    def __init__(self, sample: np.ndarray, shards: int, radius: int = RADIUS):
        self.radius = radius
        vantage, split, inner, outer = [], [], [], []
        rng = np.random.default_rng(0)
        self.shards = 0
        todo = [(np.unique(sample), shards, None)]
        while todo:
            points, share, parent = todo.pop()
            at = len(vantage)
            if parent is not None:
                (inner if parent[1] == 0 else outer)[parent[0]] = at
            found = self._split(points, rng) if share > 1 and len(points) > 1 else None
            vantage.append(found[0] if found else 0)
            split.append(found[1] if found else -1)
            inner.append(-1 if found else self.shards)
            outer.append(-1)
            if found:
                near = distance(points, found[0]) <= found[1]
                todo += [(points[~near], share // 2, (at, 1)), (points[near], share // 2, (at, 0))]
            else:
                self.shards += 1
        self.vantage, self.split = np.array(vantage, np.uint64), np.array(split, np.int16)
        self.inner, self.outer = np.array(inner, np.int64), np.array(outer, np.int64)

    def _split(self, points: np.ndarray, rng) -> tuple | None:
        """The vantage point, of a few, whose median radius the fewest cross."""
        some = rng.choice(points, 512) if len(points) > 512 else points
        best = None
        for v in rng.choice(points, min(8, len(points)), replace=False):
            d = distance(some, v)
            r = int(np.median(d))
            if r == d.max():
                r -= 1
            crossing = ((d > r - self.radius) & (d <= r + self.radius)).mean()
            if r >= 0 and (best is None or crossing < best[2]):
                best = (v, r, crossing)
        return best if best and best[2] <= CROSSING else None

    def deal(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, row, member) of every place a point goes to."""
        at, row, member = np.zeros(len(points), np.int64), np.arange(len(points)), np.ones(len(points), bool)
        shard, rows, members = [], [], []
        while len(at):
            leaf = self.split[at] < 0
            shard.append(self.inner[at[leaf]])
            rows.append(row[leaf])
            members.append(member[leaf])
            at, row, member = at[~leaf], row[~leaf], member[~leaf]
            d, r = distance(points[row], self.vantage[at]), self.split[at]
            inside = d <= np.where(member, r, r + self.radius)
            outside = np.where(member, d > r, d > r - self.radius)
            copy = member & inside & (d > r - self.radius)  # an inner member, as a query of the outer side
            at, row, member = (np.concatenate([self.inner[at[inside]], self.outer[at[outside]], self.outer[at[copy]]]),
                               np.concatenate([row[inside], row[outside], row[copy]]),
                               np.concatenate([member[inside], member[outside], np.zeros(int(copy.sum()), bool)]))
        return np.concatenate(shard), np.concatenate(rows), np.concatenate(members)


# ------------------------------------------------------------------ in a shard

def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of each i and j in a forest of smallest roots, in place."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root[:] = further


def link(points: np.ndarray, members: np.ndarray, others: np.ndarray, root: np.ndarray, radius: int = RADIUS) -> None:
    """Unite every member with every other row within ``radius``; both are places
    in ``points``. Vantage points part them while that spares a fifth of the
    comparisons."""
    todo = [(members, others)]
    while todo:
        m, q = todo.pop()
        if not len(m) or not len(q):
            continue
        if len(m) * len(q) > CELLS:
            v = points[m[len(m) // 2]]
            dm, dq = distance(points[m], v), distance(points[q], v)
            r = int(np.median(dm))
            parts = [(m[dm <= r], q[dq <= r + radius]), (m[dm > r], q[dq > r - radius])]
            if sum(len(x) * len(y) for x, y in parts) < 0.8 * len(m) * len(q):
                todo += parts
                continue
        width = max(1, CELLS // len(q))
        for s in range(0, len(m), width):
            near = np.bitwise_count(points[m[s:s + width], None] ^ points[None, q]) <= radius
            i, j = np.nonzero(near)
            unite(root, m[s + i], q[j])


def near_pairs(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, dst): a forest whose connected groups are those of the links among
    the fingerprints ``node`` (distinct longs) of ``nodes``."""
    n = nodes.count()
    shards = min(MAX_SHARDS, 1 << max(0, math.ceil(math.log2(max(1, n / shard)))))
    scale = 1 << 40
    taken = min(scale, math.ceil(scale * shards * SAMPLED / max(1, n)))
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(scale)) < taken).select("node").toPandas()["node"]
    tree = VantageTree(sample.to_numpy(np.int64).view(np.uint64), shards, radius)
    shared = nodes.sparkSession.sparkContext.broadcast(tree)

    def deal(batches):
        for b in batches:
            at, row, member = shared.value.deal(b.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0).take(pa.array(row)), pa.array(member)],
                                             names=["shard", "node", "member"])

    dealt = nodes.select("node").mapInArrow(deal, "shard long, node long, member boolean").checkpoint()
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("rows"))  # at most MAX_SHARDS rows
    rows = into_blocks(dealt.join(F.broadcast(sizes), "shard"), "shard", F.ceil(F.col("rows") / F.lit(block_rows)))
    rows = rows.select("shard", "a", "b", "own", "node", "member").repartition("shard", "a", "b") \
        .sortWithinPartitions("shard", "a", "b", "node")

    def compare(batches):
        for g in _groups(batches, 3):
            a, b = g.column(1)[0].as_py(), g.column(2)[0].as_py()
            points = g.column(4).to_numpy().view(np.uint64)
            member, own = g.column(5).to_numpy(), g.column(3).to_numpy()
            root = np.arange(len(points))
            if a == b:
                link(points, np.flatnonzero(member), root.copy(), root, radius)
            else:
                link(points, np.flatnonzero(member & (own == a)), np.flatnonzero(own == b), root, radius)
                link(points, np.flatnonzero(member & (own == b)), np.flatnonzero(own == a), root, radius)
            tied = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(points[root[tied]].view(np.int64)), pa.array(points[tied].view(np.int64))],
                                             names=["src", "dst"])

    return rows.mapInArrow(compare, "src long, dst long").distinct()


# ------------------------------------------------------------------- documents

def simhash_components(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, fingerprint (16 hex digits) and
    component_id, the smallest doc_id among the documents connected by links of
    ``radius`` or fewer differing bits, itself included.

    Null, empty and wordless texts have fingerprint zero and link as any other;
    a text of fewer than ``words`` words, but not none, is one shingle. Long texts
    are read in runs. Rows without doc_id take part and have the smallest doc_id
    of their component, null if it has none. Repeated rows stay rows of their
    own. An empty table gives an empty table; columns other than doc_id and text
    are not read."""
    checkpoint_dir(docs.sparkSession)
    prints = fingerprints(docs, words).checkpoint()
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("first")).checkpoint()
    near = connected_components(near_pairs(nodes, radius)).checkpoint()
    heads = nodes.join(near.hint("shuffle_hash"), "node").groupBy("group").agg(F.min("first").alias("head"))
    near = near.join(heads.hint("shuffle_hash"), "group").select("node", F.col("group").isNotNull().alias("tied"), "head")
    known = nodes.join(near.hint("shuffle_hash"), "node", "left").select(
        "node", F.when(F.col("tied"), F.col("head")).otherwise(F.col("first")).alias("component_id"))
    return prints.join(known.hint("shuffle_hash"), "node").select(
        "doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


def op11_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
