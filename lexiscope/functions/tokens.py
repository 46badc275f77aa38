"""Tokenizer column functions: text -> ``array<int>`` and back.

* byte tokens      -- UTF-8 bytes shifted by the byte model's 3 special ids,
                      plus its end mark (count = bytes + 1);
* character tokens -- code points between the character model's start and
                      end marks (count = code points + 2);
* BPE tokens       -- greedy left-to-right fold over the bytes (see
                      ``lexiscope.operators.bpe``).

Byte and code-point extraction and the BPE fold run as Arrow-batched
functions (whole Arrow buffers handled by NumPy, no per-row Python for bytes
or characters). Every decoder is a native expression.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .parts import row_parts

# Fixed values of the byte model's tokenizer: ids 0, 1, 2 are pad, end and
# unknown; byte b has id b + 3; 125 extra sentinel ids follow the bytes.
BYTE_OFFSET = 3
BYTE_EOS = 1
BYTE_VOCAB_SIZE = 256
# Fixed values of the character model's tokenizer: code points are ids; the
# start mark is U+E000 and the end mark U+E001; other special code points are
# 0 (pad), U+E002, U+E003 and U+E004. Vocabulary = all Unicode code points.
CHAR_CLS = 0xE000
CHAR_SEP = 0xE001
CHAR_SPECIALS = (0, 0xE000, 0xE001, 0xE002, 0xE003, 0xE004)
CHAR_VOCAB_SIZE = 1114112


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _utf8_parts(arr: pa.Array):
    """(offsets, data, validity) of a string array as NumPy."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    b = arr.cast(pa.large_binary())
    n = len(b)
    offsets = np.frombuffer(b.buffers()[1], dtype=np.int64)[b.offset:b.offset + n + 1]
    data_buf = b.buffers()[2]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    valid = np.asarray(b.is_valid())
    return offsets, data, valid


def _lists(counts: np.ndarray, values: np.ndarray, valid: np.ndarray) -> pa.Array:
    mask = pa.array(~valid) if not valid.all() else None
    return pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int64()),
                                         pa.array(values, pa.int32()), mask=mask)


def _byte_ids(arr: pa.Array, special: bool) -> pa.Array:
    offsets, data, valid = _utf8_parts(arr)
    lengths = np.where(valid, np.diff(offsets), 0)
    if not special:
        return _lists(lengths, data[offsets[0]:offsets[-1]].astype(np.int32), valid)
    values = np.empty(int(lengths.sum() + valid.sum()), dtype=np.int32)
    at = 0
    for s, e in row_parts(lengths):
        body = data[offsets[s]:offsets[e]]
        # every valid text is followed by the end mark
        ends = np.cumsum(lengths[s:e])[valid[s:e]]
        marks = ends + np.arange(len(ends))
        part = values[at:at + len(body) + len(ends)]
        is_body = np.ones(len(part), dtype=bool)
        is_body[marks] = False
        part[is_body] = body.astype(np.int32) + BYTE_OFFSET
        part[marks] = BYTE_EOS
        at += len(part)
    return _lists(lengths + valid, values, valid)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _byte_tokens_special(s: pa.Array) -> pa.Array:
    return _byte_ids(s, True).cast(pa.list_(pa.int32()))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _byte_tokens_raw(s: pa.Array) -> pa.Array:
    return _byte_ids(s, False).cast(pa.list_(pa.int32()))


def byte_tokens(c, special: bool = True) -> Column:
    """Byte-model ids. ``special=False`` gives the raw UTF-8 bytes 0..255."""
    return (_byte_tokens_special if special else _byte_tokens_raw)(_col(c))


def _decoded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, characters before each byte and in all) of UTF-8 bytes: every
    lead byte starts a character; continuation bytes are folded in."""
    lead = (data & 0xC0) != 0x80
    before = np.r_[0, np.cumsum(lead)]
    pos = np.flatnonzero(lead)
    pad = np.concatenate([data, np.zeros(4, dtype=np.uint8)])
    cp = pad[pos].astype(np.int32)
    wide = np.flatnonzero(cp >= 0x80)
    if len(wide):
        b0, at = cp[wide], pos[wide]
        b1, b2, b3 = (pad[at + k].astype(np.int32) & 0x3F for k in (1, 2, 3))
        cp[wide] = np.where(b0 < 0xE0, ((b0 & 0x1F) << 6) | b1,
                   np.where(b0 < 0xF0, ((b0 & 0x0F) << 12) | (b1 << 6) | b2,
                            ((b0 & 0x07) << 18) | (b1 << 12) | (b2 << 6) | b3))
    return cp, before


def _code_points(arr: pa.Array, special: bool) -> pa.Array:
    """UTF-8 -> code points with NumPy, a bounded part of the rows at a time."""
    offsets, data, valid = _utf8_parts(arr)
    lengths = np.where(valid, np.diff(offsets), 0)
    counts = np.zeros(len(lengths), dtype=np.int64)
    parts = list(row_parts(lengths))
    size = sum(int(np.count_nonzero((data[offsets[s]:offsets[e]] & 0xC0) != 0x80)) for s, e in parts)
    values = np.empty(size + (2 * int(valid.sum()) if special else 0), dtype=np.int32)
    filled = 0
    for s, e in parts:
        cp, before = _decoded(data[offsets[s]:offsets[e]])
        rel = offsets[s:e + 1] - offsets[s]
        own = np.where(valid[s:e], before[rel[1:]] - before[rel[:-1]], 0)
        if special:
            heads = np.cumsum(own)[valid[s:e]] - own[valid[s:e]] + 2 * np.arange(int(valid[s:e].sum()))
            tails = heads + own[valid[s:e]] + 1
            part = values[filled:filled + len(cp) + 2 * len(heads)]
            is_body = np.ones(len(part), dtype=bool)
            is_body[heads] = is_body[tails] = False
            part[is_body], part[heads], part[tails] = cp, CHAR_CLS, CHAR_SEP
            own = own + 2 * valid[s:e]
        else:
            part = values[filled:filled + len(cp)]
            part[:] = cp
        counts[s:e] = own
        filled += len(part)
    return _lists(counts, values, valid)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _char_tokens_special(s: pa.Array) -> pa.Array:
    return _code_points(s, True).cast(pa.list_(pa.int32()))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _char_tokens_raw(s: pa.Array) -> pa.Array:
    return _code_points(s, False).cast(pa.list_(pa.int32()))


def char_tokens(c, special: bool = True) -> Column:
    """Character-model ids: code points (also above U+FFFF), between the start
    and end marks. The empty string gives no code point."""
    return (_char_tokens_special if special else _char_tokens_raw)(_col(c))


def byte_decode(ids) -> Column:
    """Byte-model ids -> text; special ids dropped, broken UTF-8 -> U+FFFD."""
    kept = F.filter(_col(ids), lambda i: (i >= BYTE_OFFSET) & (i < BYTE_OFFSET + 256))
    hexes = F.transform(kept, lambda i: F.lpad(F.hex(i - BYTE_OFFSET), 2, "0"))
    return F.make_valid_utf8(F.unhex(F.array_join(hexes, "")).cast("string"))


def char_decode(ids) -> Column:
    """Character-model ids -> text; special code points dropped."""
    kept = F.filter(_col(ids), lambda i: ~i.isin(*CHAR_SPECIALS))
    hexes = F.transform(kept, lambda i: F.lpad(F.hex(i), 8, "0"))
    return F.decode(F.unhex(F.array_join(hexes, "")), "UTF-32")


def vocab_decode(ids, vocab_hex: list[str]) -> Column:
    """Ids -> text through a vocabulary (id -> bytes as hex), looked up by
    position in a literal array (bounded by the vocabulary size). An unknown
    id raises (index out of bounds)."""
    table = F.array(*[F.lit(h) for h in vocab_hex])
    hexes = F.transform(_col(ids), lambda i: F.element_at(table, i + 1))
    return F.make_valid_utf8(F.unhex(F.array_join(hexes, "")).cast("string"))
