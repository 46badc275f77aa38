"""Lempel-Ziv phrase fingerprints.

A text is parsed from left to right into phrases: each is the shortest run of
characters that is not a phrase yet, and becomes one (LZ78). Texts that compress
each other well share phrases. The set of phrases is reduced to a minimum-hash
signature: the hash of a phrase picks one of ``BINS`` bins and the smallest rest
in each bin is kept. Two signatures are as alike as the bins that agree, among
those that are filled in either.

An edited text that begins like the original is parsed on from where they part;
the parse up to there is shared.
"""

from __future__ import annotations

import gc
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.arrow_rows import table
from lexiscope.llm.jaccard_join import mix

BINS = 128
EMPTY = 0xFFFF
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        p = np.full(n + n // 2, _PRIME)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        _POWERS[0] = p
    return _POWERS[0][:n]


class Parse:
    """Phrases of a text. The dictionary is a tree of dicts, one character to a
    step; ``follow`` notes what it adds so that it can be taken back."""

    def __init__(self):
        self.root: dict = {}

    def follow(self, text: str, node: dict | None = None, start: int = 0, undo: list | None = None):
        """Parse ``text`` on from ``node``. (ends of phrases, node at the end):
        positions are counted from ``start``."""
        root, ends = self.root, []
        at = root if node is None else node
        add = ends.append
        for i, c in enumerate(text, start + 1):
            if c in at:
                at = at[c]
            else:
                at[c] = {}
                if undo is not None:
                    undo.append((at, c))
                add(i)
                at = root
        return ends, at


def signature(codes: np.ndarray, ends: list[int]) -> np.ndarray:
    """Minimum hashes of the phrases of a text given as code points, cut at
    ``ends``; the last phrase ends with the text and may be one known before."""
    out = np.full(BINS, EMPTY, dtype=np.uint16)
    if not len(codes):
        return out
    stops = np.array(ends if ends and ends[-1] == len(codes) else [*ends, len(codes)], dtype=np.int64)
    starts = np.concatenate([[0], stops[:-1]])
    within = np.arange(len(codes)) - np.repeat(starts, stops - starts)
    with np.errstate(over="ignore"):
        h = mix(np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * _powers(int(within.max()) + 1)[within], starts))
    rest = ((h >> np.uint64(7)) % np.uint64(EMPTY)).astype(np.uint16)
    np.minimum.at(out, (h & np.uint64(BINS - 1)).astype(np.int64), rest)
    return out


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """Bins that agree among those filled in either; two empty texts are alike."""
    filled = (one != EMPTY) | (two != EMPTY)
    n = int(np.count_nonzero(filled))
    return float(np.count_nonzero((one == two) & filled)) / n if n else 1.0


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def fingerprint(text: str) -> np.ndarray:
    ends, _ = Parse().follow(text)
    return signature(_codes(text), ends)


def with_edit(text: str, tail: str) -> tuple[np.ndarray, np.ndarray, str]:
    """(signature, signature of the edited text, edited text): the last third
    of ``text``, rounded down, replaced by as much of the start of ``tail``."""
    cut = len(text) - len(text) // 3
    edited = text[:cut] + tail[:len(text) // 3]
    parse, undo = Parse(), []
    head, node = parse.follow(text[:cut])
    own, _ = parse.follow(text[cut:], node, cut, undo)
    for at, c in reversed(undo):
        del at[c]
    other, _ = parse.follow(edited[cut:], node, cut)
    return signature(_codes(text), head + own), signature(_codes(edited), head + other), edited


def hex_of(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def fingerprint_with_neighbours(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """For each row of ``docs`` in descending doc_id: n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next. The next document
    of the last is the first; a table of one row is its own next.

    A null text is an empty one, whose bins are all empty; two of them are
    alike (1.0). Ties of doc_id are ordered by text hash, rows without id come
    last; repeated rows follow each other. A long text is parsed as a whole. An empty table
    gives an empty table; columns other than doc_id and text are not read.

    Documents are dealt to ranges of doc_id. The first document of each range
    is also sent to the range before, so every document meets its next one with
    a single shuffle of the texts."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if blocks is None:
        blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ranges are cut at quantiles of the ids: their number is fixed, not their place
    cuts = sorted(set(rows.where("doc_id is not null").approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 0.1 / blocks)))
    id_or_last = F.col("doc_id")
    block = F.lit(len(cuts) + 1)  # rows without id
    if cuts:
        # two levels: of every so many cuts the last one, then those between
        wide = math.isqrt(len(cuts)) + 1
        parts = [[int(c) for c in cuts[i:i + wide]] for i in range(0, len(cuts), wide)]
        lit = lambda part: F.array(*[F.lit(c) for c in part])
        below = lambda some: F.size(F.filter(some, lambda c: c < id_or_last))
        level = below(lit([p[-1] for p in parts]))
        above = F.least(level * wide + F.coalesce(below(F.get(F.array(*[lit(p) for p in parts]), level)), F.lit(0)), F.lit(len(cuts)))
        block = F.when(F.col("doc_id").isNotNull(), F.lit(len(cuts)) - above).otherwise(block)
    else:
        block = F.when(F.col("doc_id").isNotNull(), F.lit(0)).otherwise(block)
    order = [F.col("no_id"), F.desc("doc_id"), F.col("hash")]
    keyed = rows.withColumn("block", block.cast("int")).withColumn("no_id", F.col("doc_id").isNull()) \
        .withColumn("hash", F.xxhash64("text"))
    # the first of each range: as many rows as ranges
    first = keyed.select("block", "doc_id", "hash").groupBy("block").agg(
        F.min(F.struct(F.bitwise_not("doc_id"), F.col("hash"))).alias("f")).collect()
    heads = sorted((r["block"], None if r["f"][0] is None else ~r["f"][0], r["f"][1]) for r in first)
    if not heads:
        guests = None
    else:
        before = [heads[-1][0], *[h[0] for h in heads[:-1]]]
        guests = [(b, i, h, g) for (b, i, h), g in zip(heads, before, strict=True)]
    dealt = keyed.withColumn("guest", F.lit(False))
    if guests:
        known = spark.createDataFrame(guests, "block int, gid long, ghash long, to int")
        extra = keyed.join(F.broadcast(known), "block") \
            .where("doc_id <=> gid and hash = ghash").groupBy("block", "to", "no_id", "doc_id", "hash") \
            .agg(F.first("text").alias("text"))
        dealt = dealt.unionByName(extra.select(F.col("doc_id"), F.col("text"), F.col("to").alias("block"), "no_id", "hash",
                                               F.lit(True).alias("guest")))
    dealt = dealt.repartition(blocks, "block").sortWithinPartitions("block", "guest", *order)
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def run(batches):
        gc.disable()  # phrase trees are many dicts without cycles
        try:
            yield from rows_of(batches)
        finally:
            gc.enable()

    def rows_of(batches):
        held = None  # block, doc_id, text, whose next document is still to come
        waiting: list[tuple] = []
        out: list[tuple] = []

        def close(next_sig):
            _, doc, text, own, changed, edited = waiting.pop()
            out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), hex_of(own), hex_of(changed),
                        likeness(own, changed), likeness(own, next_sig)))

        def flush():
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = [x.split()[0] for x in schema.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
            out.clear()
            return batch

        for b in batches:
            for blk, doc, text, guest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(),
                                             b.column(3).to_pylist(), strict=True):
                if held is not None and held[0] == blk:
                    own, changed, edited = with_edit(held[2], text)
                    if waiting:
                        close(own)
                    waiting.append((*held, own, changed, edited))
                    held = None
                if guest:
                    if waiting:
                        close(fingerprint(text))
                    held = None
                else:
                    held = (blk, doc, text)
                if len(out) >= 500:
                    yield flush()
        yield flush()

    return dealt.select("block", "doc_id", "text", "guest").mapInArrow(run, schema)


def op10_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how near they
    are to each other and to the next document's."""
    return fingerprint_with_neighbours(table(spark, sf_dir, "documents"))
