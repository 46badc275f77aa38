"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes. A text is cut at safe boundaries: before a run
of spaces that follows a character other than a space, where no piece of the
vocabulary can reach across (checked when the model is loaded: no piece has
the space mark after another character). The segments between are encoded in
one batch, each distinct one once, and the worker remembers a bounded number
of their lengths. A text that holds the space mark itself is encoded whole.
"""

from __future__ import annotations

from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexiscope.llm.arrow_rows import map_texts, table, utf8, vocabulary

MODEL = "piece_bpe_32k.model"
SPACE_MARK = "▁"
CACHE_ENTRIES = 800_000
_LOADED: dict = {}


def _loaded(model: str):
    """(processor, lengths of segments, whether cutting at spaces is safe)."""
    if model not in _LOADED:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(model))
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        safe = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        # the model must also leave white space as it is
        safe = safe and sp.encode("a  b", out_type=str) == [SPACE_MARK + "a", SPACE_MARK, SPACE_MARK + "b"]
        _LOADED[model] = (sp, {}, safe)
    return _LOADED[model]


def segments(text: str) -> list[str]:
    """Cut before each run of spaces that follows another character. One space
    of the run goes: the model puts one before each text it encodes. A text that
    ends in one space ends in an empty segment."""
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, run = [], []
    for p in parts:
        run.append(p)
        if p:
            out.append(" ".join(run))
            run = []
    if run:
        out.append(" ".join(run))
    return out


def count_batch(texts: list[str], model: str = MODEL) -> list[int]:
    """Tokens of each text; null is empty, and an empty text has none."""
    sp, known, safe = _loaded(model)
    texts = [t or "" for t in texts]
    if not safe:
        return [len(x) for x in sp.encode(texts, num_threads=1)]
    cut = [segments(t) if SPACE_MARK not in t else None for t in texts]
    missing = [s for s in set(chain.from_iterable(c for c in cut if c)) if s not in known]
    if len(known) + len(missing) > CACHE_ENTRIES:
        known.clear()
        missing = list(set(chain.from_iterable(c for c in cut if c)))
    for i in range(0, len(missing), 20_000):
        part = missing[i:i + 20_000]
        known.update(zip(part, map(len, sp.encode(part, num_threads=1)), strict=True))
    known[""] = len(sp.encode("a ")) - len(sp.encode("a"))  # one space at the end of a text
    length = known.__getitem__
    return [0 if not t else sum(map(length, c)) if c is not None else len(sp.encode(t))
            for t, c in zip(texts, cut, strict=True)]


def count_tokens(df: DataFrame, column: str = "text", model: str = MODEL, limit: int = 4096,
                 keep: list[str] | None = None) -> DataFrame:
    """``df`` (of it the columns ``keep``, all if None) with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    A null or empty text has 0 of both. Repeated rows each get their count; an
    empty table gives an empty table; columns named like the new ones are
    replaced. No begin, end or other special token is counted or read."""
    def lengths(arr: pa.Array) -> list:
        offsets, _ = utf8(arr)
        n = pa.array(count_batch(arr.to_pylist(), model), pa.int64())
        return [pa.array(offsets[1:] - offsets[:-1], pa.int64()), n,
                pc.greater(n, limit)]

    return map_texts(df, column, [T.StructField("n_bytes", T.LongType()),
                                  T.StructField("n_tokens", T.LongType()),
                                  T.StructField("over_limit", T.BooleanType())], lengths, keep=keep)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text of ``documents``."""
    return count_tokens(table(spark, sf_dir, "documents"), keep=["doc_id"])
