"""Benchmark decontamination.

The words of the test items are cut into windows of ten, whose hashes form a
set that is broadcast; a task reads its documents' words, looks each window up,
compares the words of every hit with the item's, and marks them.

Words are runs of digits, ASCII letters (lower-cased) and all characters beyond
ASCII. An item of fewer than ten words, but not none, is one window. The item
side is sent in parts of at most ``PART_BYTES`` of text: a larger benchmark is
scanned part after part, with the hits kept in the checkpoint folder between.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexiscope.llm.arrow_rows import by_place, col, free_prefix, map_texts, placed, table, utf8
from lexiscope.session import checkpoint_dir

WINDOW = 10
PART_BYTES = 2 << 20
_WORD = np.uint64(0x9E3779B97F4A7C15)  # odd multipliers of the two hashes
_SEQ = np.uint64(0xD6E8FEB86659FD93)

_FOLD = np.zeros(256, dtype=np.uint8)  # lower-cased byte of a word, 0 between words
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def find_words(offsets: np.ndarray, data: np.ndarray):
    """(folded bytes, word starts, word ends, first word of each text and the
    number of words): UTF-8 bytes beyond ASCII all belong to words, so bytes
    are as good as characters here."""
    folded = _FOLD[data]
    inside = folded != 0
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    opens[first] = inside[first]
    closes[last] = inside[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return folded, starts, ends, np.searchsorted(starts, offsets)


def hash_words(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    powers = np.full(int(sizes.max()), _WORD)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    total = int(sizes.sum())
    within = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    body = folded[folded != 0].astype(np.uint64) * powers[within]
    h = np.add.reduceat(body, np.cumsum(sizes) - sizes)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class TestIndex:
    """Windows of the items: a bit filter and sorted hashes for the lookup, and
    the words themselves for the check of every hit."""

    __test__ = False

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window = window
        self.owners: dict[bytes, set[str]] = {}
        by_width: dict[int, list[int]] = {}
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            folded, starts, ends, _ = find_words(np.array([0, len(raw)]), raw)
            if not len(starts):
                continue
            width = min(window, len(starts))
            words = [folded[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
            hashes = self._windows(hash_words(folded, starts, ends), width)
            for i, h in enumerate(hashes.tolist()):
                by_width.setdefault(width, []).append(h)
                self.owners.setdefault(b" ".join(words[i:i + width]), set()).add(str(item_id))
        self.hashes = {w: np.unique(np.array(h, np.uint64)) for w, h in by_width.items()}
        n = max((len(h) for h in self.hashes.values()), default=1)
        self.shift = np.uint64(64 - max(16, (64 * n).bit_length()))
        self.filter = {}
        for w, h in self.hashes.items():
            self.filter[w] = np.zeros(1 << int(64 - self.shift), dtype=bool)
            self.filter[w][(h >> self.shift).astype(np.int64)] = True

    @staticmethod
    def _windows(words: np.ndarray, width: int) -> np.ndarray:
        n = len(words) - width + 1
        out, power = np.zeros(max(n, 0), np.uint64), np.uint64(1)
        with np.errstate(over="ignore"):
            for j in range(width if n > 0 else 0):
                out += words[j:j + n] * power
                power = power * _SEQ
        return out

    def scan(self, offsets: np.ndarray, data: np.ndarray):
        """(words per text, hit runs, items per text, words): a run is
        (text, first word, end word), counted from the text's first word."""
        folded, starts, ends, first = find_words(offsets, data)
        n_words = np.diff(first)
        hit = np.zeros(len(starts) + 1, dtype=np.int64)
        items: dict[int, set[str]] = {}
        if self.hashes and len(starts):
            words = hash_words(folded, starts, ends)
            doc = np.repeat(np.arange(len(n_words)), n_words)
            seen: dict[bytes, bytes] = {}
            for width, known in self.hashes.items():
                h = self._windows(words, width)
                at = np.flatnonzero(self.filter[width][(h >> self.shift).astype(np.int64)])
                at = at[doc[at] == doc[at + width - 1]]
                h = h[at]
                at = at[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]
                for i in at.tolist():
                    raw = folded[starts[i]:ends[i + width - 1]].tobytes()
                    key = seen.get(raw)
                    if key is None:
                        if len(seen) > 50_000:
                            seen.clear()
                        key = seen[raw] = b" ".join(x for x in raw.split(b"\0") if x)
                    if owners := self.owners.get(key):
                        hit[i] += 1
                        hit[i + width] -= 1
                        items.setdefault(int(doc[i]), set()).update(owners)
        marked = np.cumsum(hit[:-1]) > 0
        return n_words, first, marked, items, starts, ends


def _runs(marked: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, marked, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _without(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the byte spans; words left and right stay apart."""
    out, at = b"", 0
    for s, e in spans:
        out += raw[at:s]
        at = e
        if out and not out[-1:].isspace() and raw[e:e + 1] and not raw[e:e + 1].isspace():
            out += b" "
    return (out + raw[at:]).decode()


def report_fields(prefix: str = "") -> list[T.StructField]:
    return [T.StructField(prefix + "n_words", T.LongType()), T.StructField(prefix + "n_hit", T.LongType()),
            T.StructField(prefix + "items", T.ArrayType(T.StringType())),
            T.StructField(prefix + "spans", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField(prefix + "clean_text", T.StringType())]


def _item_parts(benchmark: DataFrame, part_bytes: int) -> list[DataFrame]:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                             F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // part_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.where(part == i) if n > 1 else items for i in range(n)]


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                   part_bytes: int = PART_BYTES, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``docs`` (of it the columns ``keep``, all if None) with n_words, n_hit (words inside an occurrence of a window),
    items (ids of the items found, as sorted strings), spans ([start, end) byte
    pairs of the hit runs) and clean_text (the text without those spans), named with ``prefix`` in front.

    A null text has no words and stays null; an empty text or an item without
    words hits nothing; an item without id counts as 'None'; repeated documents
    are each reported; an empty benchmark hits nothing; columns of ``docs``
    named like the new ones are replaced."""
    spark = docs.sparkSession
    fields = report_fields(prefix)
    parts = _item_parts(benchmark, part_bytes)
    shared = [spark.sparkContext.broadcast(TestIndex([tuple(r) for r in p.collect()], window))
              for p in parts] if len(parts) == 1 else None

    def report(arr: pa.Array, n_words, first, marked, items, starts, ends) -> list:
        offsets, data = utf8(arr)
        hits, spans, clean = [], [], []
        counts = np.r_[0, np.cumsum(marked)]
        texts = None
        for d in range(len(arr)):
            a, b = int(first[d]), int(first[d + 1])
            n = int(counts[b] - counts[a])
            hits.append(n)
            if not n:
                spans.append([])
                continue
            spans.append([[int(starts[a + s] - offsets[d]), int(ends[a + e - 1] - offsets[d])]
                          for s, e in _runs(marked[a:b])])
        if any(hits):
            texts = arr.to_pylist()
            clean = pa.array([_without(t.encode(), s) if s else t for t, s in zip(texts, spans, strict=True)])
        else:
            clean = arr
        return [pa.array(n_words, pa.int64()), pa.array(hits, pa.int64()),
                [sorted(items.get(d, ())) for d in range(len(arr))], spans, clean]

    if shared:
        index = shared[0]
        return map_texts(docs, "text", fields, lambda arr: report(arr, *index.value.scan(*utf8(arr))), keep=keep)

    # several parts: a pass for each, the hits so far in an extra column
    checkpoint_dir(spark)
    own = free_prefix([*docs.columns, *(f.name for f in fields)])
    marks = [T.StructField(f"{own}hits{i}", T.ArrayType(T.LongType())) for i in range(len(parts))]
    found = [T.StructField(f"{own}items{i}", T.ArrayType(T.StringType())) for i in range(len(parts))]
    out = docs
    for p, m, f in zip(parts, marks, found, strict=True):
        index = spark.sparkContext.broadcast(TestIndex([tuple(r) for r in p.collect()], window))

        def scan(arr, index=index):
            _, first, marked, items, _, _ = index.value.scan(*utf8(arr))
            return [[[x for run in _runs(marked[a:b]) for x in run] for a, b in zip(first[:-1], first[1:], strict=True)],
                    [sorted(items.get(d, ())) for d in range(len(arr))]]

        out = map_texts(out, "text", [m, f], scan).checkpoint()
        index.destroy()
    # merge the parts: hits and items travel in front of the text
    new = {f.name for f in fields}
    schema = T.StructType([f for f in docs.schema.fields if f.name not in new and (keep is None or f.name in keep)] + fields)
    kept = [f.name for f in schema.fields[:-len(fields)]]
    target = to_arrow_schema(placed(schema))
    n = len(kept)

    def merge(batches):
        for b in batches:
            arr = b.column(n)
            offsets, data = utf8(arr)
            _, starts, ends, first = find_words(offsets, data)
            marked = np.zeros(len(starts), dtype=bool)
            for d, runs in enumerate(b.column(n + 1).to_pylist()):
                for s, e in zip(runs[::2], runs[1::2], strict=True):
                    marked[first[d] + s:first[d] + e] = True
            items = dict(enumerate(b.column(n + 2).to_pylist()))
            arrays = b.columns[:n] + report(arr, np.diff(first), first, marked, items, starts, ends)
            yield pa.RecordBatch.from_arrays(
                [x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type)
                 for x, f in zip(arrays, target, strict=True)], schema=target)

    work = out.select(*[col(c) for c in kept], F.col("text").cast("string"), F.concat(*[col(m.name) for m in marks]),
                      F.array_sort(F.array_distinct(F.concat(*[col(f.name) for f in found]))))
    return by_place(work).mapInArrow(merge, placed(schema)).toDF(*schema.names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans",
                  window: int = WINDOW) -> DataFrame:
    """``docs`` without test passages, in their own columns. ``remove='spans'``
    cuts the hit words out of the text and drops a document of which no word is
    left; ``remove='documents'`` drops every document with a hit. Documents
    without a hit stay as they are, also null and empty ones."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove must be 'spans' or 'documents', not {remove!r}")
    names, own = docs.columns, free_prefix(docs.columns)
    report = scan_documents(docs, benchmark, window, prefix=own)
    n_hit = col(own + "n_hit")
    if remove == "documents":
        return report.where(n_hit == 0).select(*[col(c) for c in names])
    kept = report.where((n_hit == 0) | (n_hit < col(own + "n_words")))
    return kept.select(*[col(own + "clean_text").alias("text") if c == "text" else col(c) for c in names])


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Which words of each document lie in passages of ``benchmark``."""
    found = scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
with b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bi as (select item_id, w, least(len(w), 10) m, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from b where len(w) > 0),
bw as (select distinct item_id, m, array_to_string(w[i:i + m - 1], ' ') g from bi),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
di as (select doc_id, w, unnest(range(1, len(w) + 1)) i from d),
dw as (select doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') g
       from di, (select distinct m from bw) where i + m - 1 <= len(w)),
h as (select doc_id, i, m, item_id from dw join bw using (m, g)),
n as (select doc_id, count(*) n_hit from (select distinct doc_id, unnest(range(i, i + m)) k from h) group by doc_id),
t as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids
      from (select distinct doc_id, cast(item_id as varchar) item_id from h) group by doc_id)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join n using (doc_id) left join t using (doc_id)
"""
