"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams (one to three letters, with a
mark at either end of a word) of a text or of all texts of a language, most
frequent first. A document goes to the language from whose profile its own
n-grams are least out of place: for each, the difference of the two ranks, or
the length of the profile where the language's lacks it.

N-grams are 63-bit numbers of three code points, counted by sorting arrays. The
counts of all learning documents are summed in Spark; only the profiles, a few
hundred rows for each language, reach the driver and are broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiscope.llm.arrow_rows import map_texts, rows_to, table

PROFILE = 300
BATCH_BYTES = 1 << 20  # an n-gram takes 16 bytes, a letter makes three, and they are sorted
MAX_LANGUAGES = 1000
UNDETERMINED = "und"
_EDGE = 1  # stands for the end of a word; no letter has this code point
_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram numbers, text of each): grouped by text. Lower case, whole texts."""
    joined = ["\n" + t.lower() + "\n" for t in texts]
    sizes = np.fromiter(map(len, joined), dtype=np.int64, count=len(joined))
    chars = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(joined), dtype=np.int64), sizes)
    letter = _letter_table()[chars]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one mark behind a word
    keep[:-1] |= letter[1:]  # and one before it
    c = np.where(letter, chars, _EDGE).astype(np.int64)[keep]
    is_letter, own = letter[keep], owner[keep]
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the mark behind a word may also be the one before the next: no n-gram has a mark inside
    one, one_own = c[is_letter], own[is_letter]
    two_ok = (is_letter[:-1] | is_letter[1:]) & (own[:-1] == own[1:])
    two = (c[:-1] << 21 | c[1:])[two_ok]
    three_ok = is_letter[1:-1] & (own[:-2] == own[2:])
    three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[three_ok]
    grams = np.concatenate([one, two, three])
    owners = np.concatenate([one_own, own[:-1][two_ok], own[:-2][three_ok]])
    order = np.argsort(owners, kind="stable")
    return grams[order], owners[order]


def _ranked(grams: np.ndarray, size: int) -> np.ndarray:
    """The most frequent, ties by number."""
    values, counts = np.unique(grams, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Language -> its ``size`` most frequent n-grams over all rows of ``docs``
    with a text and a lang. Raises beyond ``MAX_LANGUAGES`` languages."""
    rows = docs.where("text is not null and lang is not null").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def count(part: pa.RecordBatch):
        langs = np.array(part.column(0).to_pylist(), dtype=object)
        texts = part.column(1).to_pylist()
        for lang in sorted(set(langs)):
            grams, _ = ngrams([texts[i] for i in np.flatnonzero(langs == lang)])
            values, counts = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(values), pa.string()), pa.array(values, pa.int64()),
                 pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    counts = rows_to(rows, "text", "lang string, gram long, n long", count, BATCH_BYTES) \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= size)
    found = best.limit(MAX_LANGUAGES * size + 1).collect()
    if len(found) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    profiles: dict[str, list[int]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def learn_letters(docs: DataFrame) -> list[int]:
    """The code points of all letters, in lower case, of the rows of ``docs`` with
    a text and a lang; at most as many as there are letters."""
    rows = docs.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"))

    def letters(part: pa.RecordBatch):
        chars = np.frombuffer("".join(part.column(0).to_pylist()).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.zeros(0x110000, dtype=bool)
        seen[chars] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen & _letter_table()).astype(np.int32))], names=["letter"])

    return sorted(r["letter"] for r in rows_to(rows, "text", "letter int", letters, BATCH_BYTES).distinct().collect())


class Classifier:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE, letters: list[int] | None = None):
        self.size, self.langs = size, sorted(profiles)
        self.letters = None if letters is None else np.array(sorted(letters), dtype=np.int64)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.int64))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.grams, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text: 1 less the mean out-of-place
        distance as a part of the largest."""
        grams, owners = ngrams(texts)
        ends = np.searchsorted(owners, np.arange(len(texts) + 1))
        langs, scores = [], []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if a == b or not self.langs:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            if self.letters is not None and not any(np.isin(g, self.letters).any() for g in (grams[a:min(b, a + 64)], grams[a:b])):
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            own = _ranked(grams[a:b], self.size)
            at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
            at = np.where(self.grams[at] == own, at, len(self.grams))
            theirs = self.ranks[:, at]
            apart = np.where(theirs < 0, self.size, np.minimum(self.size, np.abs(theirs - np.arange(len(own)))))
            total = apart.sum(axis=1)
            best = int(np.argmin(total))
            langs.append(self.langs[best])
            scores.append(1.0 - float(total[best]) / (self.size * len(own)))
        return langs, scores


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE,
             keep: list[str] | None = None, prefix: str = "", letters: list[int] | None = None) -> DataFrame:
    """``docs`` (of it the columns ``keep``, all if None) with ``lang_pred`` and
    ``score`` (0 to 1) from whole texts, named with ``prefix`` in front.

    ``und`` with score 0 for a null text, one without a letter, or when there
    are no profiles, or, where ``letters`` are given, for one with none of them;
    neither its length nor the size of its alphabet counts. Ties go to the language first in the alphabet. Repeated
    rows get the same answer; a long text is read as a whole; an empty table gives an
    empty table; columns named like the new ones are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(Classifier(profiles, size, letters))

    def predict(arr: pa.Array) -> list:
        langs, scores = shared.value.predict([t or "" for t in arr.to_pylist()])
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return map_texts(docs, "text", [T.StructField(prefix + "lang_pred", T.StringType()),
                                    T.StructField(prefix + "score", T.DoubleType())],
                     predict, BATCH_BYTES, keep)


def fold(docs: DataFrame, parts: int = 3):
    """crc32 of the id's text modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every whole document; learned from two folds of three."""
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.where(fold(docs) != 1))
    return identify(docs, profiles, keep=["doc_id"]).select(
        "doc_id", F.coalesce(fold(docs) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
