"""WordPiece: vocabulary from the corpus and longest-match-first encoding.

The vocabulary is trained (``wordpiece_train``), given by the user as a list, or
built from whole words and characters:

* special tokens, every character seen (as a word start and as a ``##``
  continuation), then the most frequent words, by frequency, in the room that
  is left; a size that cannot hold the characters is an error;
* words come from basic tokenisation: lower case, split on whitespace, every
  punctuation character is its own word.

Counting words is a Spark aggregation with partial aggregation per task; only
the chosen vocabulary (bounded by ``vocab_size``) reaches the driver, and it is
shipped to executors with the encoding function.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text

# The special tokens, in id order.
SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")
MARK = "##"  # of a piece that continues a word
PUNCT_RE = r"[\p{P}\p{S}]"


def basic_words(text) -> Column:
    """Lower-cased words; punctuation characters split off as words."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    spaced = F.regexp_replace(t, "(" + PUNCT_RE + ")", " $1 ")
    return F.filter(F.split(clean_text(spaced), " "), lambda w: w != "")


def build_vocab(docs: DataFrame, text: str = "text", vocab_size: int = 2000) -> list[str]:
    """Specials + all characters (plain and ``##``, most frequent first) + the
    most frequent words. There are at most as many characters as Unicode has."""
    words = docs.select(F.explode(basic_words(text)).alias("w"))
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    chars = (counts.select(F.explode(F.split("w", "")).alias("c"), "n").where(F.col("c") != "")
             .groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "c").collect())
    base = list(SPECIALS) + [r["c"] for r in chars] + ["##" + r["c"] for r in chars]
    if len(base) > vocab_size:
        raise ValueError(f"a vocabulary of {vocab_size} cannot hold the {len(chars)} characters of the texts "
                         f"({len(base)} entries)")
    top = counts.where(F.length("w") > 1).orderBy(F.col("n").desc(), F.col("w")).limit(vocab_size - len(base)).collect()
    return base + [r["w"] for r in top]


class WordEncoder:
    """Ids of words, longest match first; each distinct word is matched once
    and a bounded number is remembered."""

    LIMIT = 200_000

    def __init__(self, index: dict[str, int], max_word_chars: int | None = None):
        self.index, self.max_word_chars = index, max_word_chars
        self.unknown = [index["[UNK]"]]
        self.longest = max(map(len, index), default=1)
        self.known: dict[str, list[int]] = {}

    def ids(self, word: str) -> list[int]:
        out = self.known.get(word)
        if out is None:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            out = self.known[word] = self._match(word)
        return out

    def _match(self, word: str) -> list[int]:
        if self.max_word_chars is not None and len(word) > self.max_word_chars:
            return self.unknown
        out, at = [], 0
        while at < len(word):
            mark = "##" if at else ""
            ends = range(min(len(word), at + self.longest), at, -1)
            end = next((e for e in ends if mark + word[at:e] in self.index), None)
            if end is None:
                return self.unknown
            out.append(self.index[mark + word[at:end]])
            at = end
        return out


def wordpiece_tokens(text, vocab: list[str], special: bool = True, max_word_chars: int | None = None) -> Column:
    """Word-piece ids of a text column (greedy longest match first, ``##``
    continuation, ``[UNK]`` for a word that cannot be covered); ``[CLS]`` and
    ``[SEP]`` around each text when ``special``. With ``max_word_chars`` a longer
    word is ``[UNK]``; off by default."""
    index = {tok: i for i, tok in enumerate(vocab)}
    cls, sep = index["[CLS]"], index["[SEP]"]
    encoder = WordEncoder(index, max_word_chars)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def _enc(words: pa.Array) -> pa.Array:
        off = [0]
        flat = array("i")
        for row in words:
            if row.is_valid:
                if special:
                    flat.append(cls)
                for w in row.as_py():
                    flat.extend(encoder.ids(w))
                if special:
                    flat.append(sep)
            off.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.array(flat, np.int32)))

    return _enc(basic_words(text))
