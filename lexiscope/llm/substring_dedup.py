"""Substring dedup by line hashing.

A text is cut into lines, and each line into sentences (after ``.``, ``!`` or
``?`` and a space, or after a sentence mark that no space need follow), so that a passage set inside a line is found as well as one
on a line of its own. A unit is normalised (lower case, every run of
characters other than letters and digits one space) and hashed to 128 bits.

Spark finds the earliest occurrence of each digest over all documents, ordered
by doc_id, then text hash, then place. Map tasks reduce their units first, so
a digest held by every document costs one row for each task. What comes back to
a document is the list of its places that are first: a row for each digest,
grouped by the document it was found in, never by the digest.

A unit that is not the first of its digest is a repeat. A line goes if it is a
repeat of at least ``min_line_words`` words. A run of sentences next to each
other, all repeats, goes if it has ``min_run_words`` words or more, also over
line ends; a line of one sentence is one. Shorter repeats stay: languages repeat
them by themselves. In scripts without spaces between words, characters are
counted instead (``_length``).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexiscope.llm.arrow_rows import by_place, col, free_prefix, placed, rows_to, table

MIN_LINE_WORDS = 16  # of documents without copies, 95 in 100 keep all of their text; 67 with 8 words
MIN_RUN_WORDS = 25
_LINE = re.compile(r"[^\n]+")
_FULL = "\u3002\uff01\uff1f\uff61\uff0e\u0964\u0965\u061f\u06d4"  # sentence marks that no space need follow
_CLOSING = "\u300d\u300f\u201d\u2019\uff09\u300b\u3009\u3011"
_SENTENCE = re.compile(rf"[^.!?{_FULL}]*(?:[.!?]+(?! )[^.!?{_FULL}]*)*(?:[.!?]+ +|[{_FULL}][.!?{_FULL}]*[{_CLOSING}]* *|$)")
_OTHER = re.compile(r"[\W_]+")
#: Scripts without spaces between words: Han, kana and Yi, of which two characters count as a word; Thai, Lao, Tibetan,
#: Burmese and Khmer, of which three letters do.
_DENSE = re.compile("[\u2e80-\u2fdf\u3005-\u3007\u3021-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua4cf\uf900-\ufaff"
                    "\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]")
_THIN = re.compile("[\u0e00-\u109f\u1780-\u17ff]")


def _length(norm: str) -> int:
    """The words of a normalised text."""
    if norm.isascii():
        return norm.count(" ") + 1
    rest, dense = _DENSE.subn(" ", norm)
    rest, thin = _THIN.subn(" ", rest)
    return len(rest.split()) + (dense + 1) // 2 + (thin + 2) // 3


def units(text: str) -> list[tuple[int, int, int, str, int]]:
    """(start, end, line number, normalised text, words) of the lines and, for
    lines of more than one sentence, behind each line those of its sentences.
    Units without a letter or digit are left out."""
    out = []
    for number, line in enumerate(_LINE.finditer(text)):
        whole = _OTHER.sub(" ", line.group().lower()).strip()
        if not whole:
            continue
        out.append((line.start(), line.end(), number, whole, _length(whole)))
        spans = [m.span() for m in _SENTENCE.finditer(text, line.start(), line.end()) if m.end() > m.start()]
        if len(spans) > 1:
            for s, e in spans:
                norm = _OTHER.sub(" ", text[s:e].lower()).strip()
                if norm:
                    out.append((s, e, number, norm, _length(norm)))
    return out


def _digests(norms: list[str]) -> list[bytes]:
    import xxhash
    d = xxhash.xxh3_128_digest
    return [d(n) for n in norms]


def _first_places(docs: DataFrame, keys: list[str], places: str) -> DataFrame:
    """``places``: the places of each document's units that are the first of their
    digest anywhere, by ``keys`` (no id, id, text hash)."""
    def cut(part: pa.RecordBatch):
        seen: dict[bytes, tuple] = {}
        for *rank, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            for place, d in enumerate(_digests([u[3] for u in units(text)])):
                old = seen.get(d)
                if old is None or (rank, place) < old:
                    seen[d] = (rank, place)
        ranks = list(seen.values())
        yield pa.RecordBatch.from_arrays([
            pa.array(list(seen), pa.binary()), pa.array([r[0][0] for r in ranks], pa.bool_()),
            pa.array([r[0][1] for r in ranks], pa.int64()), pa.array([r[0][2] for r in ranks], pa.int64()),
            pa.array([r[1] for r in ranks], pa.int32())], names=["digest", "no_id", "id", "th", "place"])

    found = rows_to(docs.select(*keys, "text"), "text",
                    "digest binary, no_id boolean, id long, th long, place int", cut)
    first = found.groupBy("digest").agg(F.min(F.struct("no_id", "id", "th", "place")).alias("f"))
    return first.groupBy(*[F.col(f"f.{x}").alias(k) for x, k in zip(("no_id", "id", "th"), keys, strict=True)]) \
        .agg(F.collect_list("f.place").alias(places))


def _removals(text: str, first: set[int], min_line: int, min_run: int) -> list[tuple[int, int]]:
    """The spans of ``text`` to take out."""
    found = units(text)
    lines: list[tuple[int, int]] = []  # repeated lines, long enough to go alone
    runs: list[list[int]] = []  # start, end and words of repeats next to each other
    going = False
    i = 0
    while i < len(found):
        j = i + 1
        while j < len(found) and found[j][2] == found[i][2]:
            j += 1
        start, end, _, _, words = found[i]
        if i not in first and words >= min_line:
            lines.append((start, end))
        for k in range(i + 1 if j > i + 1 else i, j):
            if k in first:
                going = False
            elif going:
                runs[-1][1:] = [found[k][1], runs[-1][2] + found[k][4]]
            else:
                runs.append([found[k][0], found[k][1], found[k][4]])
                going = True
        i = j
    out: list[tuple[int, int]] = []
    for s, e in sorted([(s, e) for s, e, words in runs if words >= min_run] + lines, key=lambda x: (x[0], -x[1])):
        if not out or s >= out[-1][1]:
            out.append((s, e))
        elif e > out[-1][1]:
            out[-1] = (out[-1][0], e)
    return out


def _cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a line left empty goes with its line end."""
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
        left = s == 0 or text[s - 1] == "\n"
        if left and at < len(text) and text[at] == "\n":
            at += 1
        elif at == len(text) or text[at] == "\n":
            kept = "".join(out).rstrip(" ")
            out = [kept[:-1] if left and at == len(text) and kept.endswith("\n") else kept]
    out.append(text[at:])
    return "".join(out)


def report_fields(prefix: str = "") -> list[T.StructField]:
    return [T.StructField(prefix + "removed", T.ArrayType(T.ArrayType(T.IntegerType()))),
            T.StructField(prefix + "n_removed", T.IntegerType()), T.StructField(prefix + "removed_words", T.LongType()),
            T.StructField(prefix + "kept_text", T.StringType())]


def dedup_units(docs: DataFrame, min_line_words: int = MIN_LINE_WORDS,
                min_run_words: int = MIN_RUN_WORDS, prefix: str = "") -> DataFrame:
    """``docs`` with ``removed`` ([start, end) character pairs in the original
    text), ``n_removed``, ``removed_words`` and ``kept_text``, named with ``prefix``
    in front.

    Rows that repeat both doc_id and text are one document and come out alike.
    Rows without doc_id rank last, then by text hash. A null text stays null
    with nothing removed; an empty one stays empty; a text whose units are all
    repeats becomes empty. A long text is cut as a whole; an empty table gives an
    empty table. Columns named like the new ones are replaced; others may have any name."""
    fields = report_fields(prefix)
    new = {f.name for f in fields}
    kept = [f for f in docs.schema.fields if f.name not in new]
    own = free_prefix(docs.columns)
    keys, places = [own + "no_id", own + "id", own + "hash"], own + "places"
    at = [f.name for f in kept].index("text")
    row = docs.select(*[F.col("text").cast("string").alias("text") if f.name == "text" else col(f.name) for f in kept],
                      F.col("doc_id").isNull().alias(keys[0]), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(keys[1]),
                      F.xxhash64(F.col("text").cast("string")).alias(keys[2]))
    first = _first_places(row.where("text <> ''"), keys, places)
    joined = row.join(first.hint("shuffle_hash"), keys, "left").select(*[col(f.name) for f in kept], places)
    kept = [T.StructField(f.name, T.StringType()) if f.name == "text" else f for f in kept]
    schema = T.StructType(kept + fields)
    target = to_arrow_schema(placed(schema))
    n = len(kept)

    def drop(part: pa.RecordBatch):
        spans, texts, words = [], [], []
        for text, places in zip(part.column(at).to_pylist(), part.column(n), strict=True):
            own = _removals(text, set(places.values.to_numpy().tolist()) if places.is_valid else set(),
                            min_line_words, min_run_words) if text else []
            spans.append([list(s) for s in own])
            words.append(sum(len(text[s:e].split()) for s, e in own))
            texts.append(_cut_out(text, own) if own else text)
        made = [pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array([len(s) for s in spans], pa.int32()),
                pa.array(words, pa.int64()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(part.columns[:n] + made, target, strict=True)],
                                         schema=target)

    return rows_to(by_place(joined), f"c{at}", placed(schema), drop).toDF(*schema.names)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What line hashing removes from each document, with original offsets, and
    the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_units(docs).select("doc_id", "n_removed", "removed_words", "removed", F.col("kept_text").alias("text"))
