"""Best-fit packing with Martello-Toth dominance reduction.

``tokenize_pieces`` cuts documents into pieces of at most ``capacity`` tokens.
``pack`` places items of any table with a length into as few sequences of that
capacity as it can:

1. Spark counts the items of each length. There are at most ``capacity``
   different lengths, so the histogram is the whole instance and has a fixed
   size bound, however many items there are.
2. On the histogram (driver, counts instead of items) the reduction fixes sets
   that provably dominate every other sequence holding the same largest item,
   and what remains is packed by best fit, longest first.
3. The result is a list of runs: so many items of one length, so many to a
   sequence, from that sequence and offset on. Items are numbered within their
   length by Spark (hot lengths are split into salted groups first), and each
   finds its run by its number.
"""

from __future__ import annotations

import os
import string
import zlib
from bisect import bisect_left, bisect_right, insort
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lexiscope.llm.arrow_rows import rows_to, table, vocabulary
from lexiscope.session import checkpoint_dir

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
CACHE_ENTRIES = 800_000
CACHE_CHARS = 32 << 20
SALT_ROWS = 2_000
MARKS = string.punctuation
_LOADED: dict = {}


# ---------------------------------------------------------------- tokenizing

class _Encoder:
    """Ids of whole texts. The tokenizer drops white space, so the ids of a text
    are those of its parts between spaces. Each distinct part is encoded once;
    the ids of a bounded number of parts are remembered one behind the other."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.place: dict[str, int] = {}  # part -> its number
        self.chars = 0  # of all parts
        self.ids = np.zeros(0, "<u4")
        self.ends = np.zeros(1, np.int64)  # of each part's ids, from the second on
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids that end a word
        for piece, i in vocab.items():
            self.last[i] = piece.endswith("</w>")

    def _raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one behind the other, how many of each)."""
        found = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum())), sizes

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_raw``, of words of letters: a hundred at a time, as a word's last
        id marks its end."""
        ids, sizes = [], []
        for i in range(0, len(words), 20_000):
            some = words[i:i + 20_000]
            raw, _ = self._raw([" ".join(some[j:j + 100]) for j in range(0, len(some), 100)])
            ends = np.flatnonzero(self.last[raw]) + 1
            if len(ends) != len(some):
                raw, own = self._raw(some)
            else:
                own = np.diff(ends, prepend=0)
            ids.append(raw)
            sizes.append(own)
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def _learn(self, parts: list[str]) -> None:
        """Letters with ASCII marks behind them are two words of the tokenizer,
        the letters and the marks, if the letters stay letters in lower case."""
        stems: dict[str, int] = {}
        others: dict[str, int] = {}  # marks, and whatever is encoded as a whole
        first, second = [], []  # of each part: its stem or -1, what stands behind or in its stead
        for p in parts:
            stem = p.rstrip(MARKS)
            if stem.isalpha() and (stem.isascii() or stem.lower().isalpha()):
                first.append(stems.setdefault(stem, len(stems)))
                second.append(others.setdefault(p[len(stem):], len(others)) if len(stem) < len(p) else -1)
            else:
                first.append(-1)
                second.append(others.setdefault(p, len(others)))
        ids, sizes = self._words(list(stems))
        more, own = self._raw(list(others))
        ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, own, [0]])
        starts = np.cumsum(sizes) - sizes
        none = len(sizes) - 1
        one, two = np.array(first, np.int64), np.array(second, np.int64)
        place = np.stack([np.where(one < 0, none, one), np.where(two < 0, none, two + len(stems))], axis=1).ravel()
        total = sizes[place].reshape(-1, 2).sum(axis=1)
        begin = len(self.place)
        self.place.update(zip(parts, range(begin, begin + len(parts)), strict=True))
        self.chars += sum(map(len, parts))
        self.ids = np.concatenate([self.ids, ids[_spread(starts[place], sizes[place])]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(total)])

    def _forget(self) -> None:
        """Keep the later half of the parts."""
        half = -(-len(self.place) // 2)
        self.place = {p: i - half for p, i in self.place.items() if i >= half}
        self.chars = sum(map(len, self.place))
        self.ids = self.ids[self.ends[half]:]
        self.ends = self.ends[half:] - self.ends[half]

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with ``end_id`` behind them; where each text's
        begin, and the end)."""
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " "), " ")
        words = cut.flatten().dictionary_encode()
        names = words.dictionary  # lower case but for what may be a special string
        names = pc.if_else(pc.match_substring(names, "<|"), names, pc.ascii_lower(names)).dictionary_encode()
        parts = names.dictionary.to_pylist()
        missing = [w for w in parts if w not in self.place]
        while self.place and (len(self.place) + len(missing) > CACHE_ENTRIES or self.chars + sum(map(len, missing)) > CACHE_CHARS):
            self._forget()
            missing = [w for w in parts if w not in self.place]
        if missing:
            self._learn(missing)
        number = np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))
        number = number[names.indices.to_numpy()][words.indices.to_numpy()]
        bounds = np.asarray(cut.offsets, dtype=np.int64)
        bounds = bounds - bounds[0]
        # the end id is one more part, behind the last one of each text
        number = np.insert(number, bounds[1:], len(self.place))
        begin, size = np.append(self.ends[:-1], len(self.ids)), np.append(np.diff(self.ends), 1)
        sizes = size[number]
        before = np.concatenate([[0], np.cumsum(sizes)])
        return np.append(self.ids, np.uint32(end_id))[_spread(begin[number], sizes)], before[bounds + np.arange(len(bounds))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        ids, starts = self.encode_all(pa.array(texts, pa.string()), END_ID)
        return [ids[a:b - 1].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs of these sizes, one behind the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total + int(starts.max(initial=0)) < 1 << 31 else np.int64
    return np.arange(total, dtype=kind) + np.repeat((starts - (ends - sizes)).astype(kind), sizes)


def encoder(path: str) -> _Encoder:
    if path not in _LOADED:
        _LOADED[path] = _Encoder(vocabulary(path))
    return _LOADED[path]


def tokenize_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY,
                    end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]) of every document:
    its ids, then ``end_id``, cut into pieces of ``capacity``.

    A null or empty text is the end id alone. Repeated rows each give their
    pieces; an empty table gives none; other columns are not read. A very long
    text is encoded by itself."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def pieces(part: pa.RecordBatch):
        ids, bounds = encoder(tokenizer).encode_all(part.column(1), end_id)
        sizes = np.diff(bounds)
        n = -(-sizes // capacity)
        doc = np.repeat(np.arange(len(n)), n)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        length = np.minimum(sizes[doc] - start, capacity)
        begin = bounds[doc] + start
        raw = memoryview(ids).cast("B")
        crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
        columns = [part.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.view("<i4"))))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows_to(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")),
                   "text", schema, pieces)


# ------------------------------------------------------------------ planning

class _Plan:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {int(k): int(v) for k, v in counts.items() if v}
        self.next_rank = dict.fromkeys(self.left, 0)
        self.runs: list[tuple] = []  # length, first rank, items, per sequence, first sequence, offset
        self.sequences = 0

    def take(self, length: int, items: int, per: int, first: int, offset: int) -> None:
        self.runs.append((length, self.next_rank[length], items, per, first, offset))
        self.next_rank[length] += items
        self.left[length] -= items
        if not self.left[length]:
            del self.left[length]

    def fix(self, group: list[int], times: int) -> None:
        """``times`` sequences that hold the lengths of ``group``."""
        offset = 0
        for length in group:
            self.take(length, times, 1, self.sequences, offset)
            offset += length
        self.sequences += times


def reduce_instance(plan: _Plan) -> None:
    """Fix every dominating set of up to three items, largest item first. For
    the largest item of a set, with room r beside it:

    * nothing fits: it stays alone;
    * an item fills r: the pair dominates whatever else could go there;
    * no two items fit r together: the pair with the largest that fits;
    * no three fit: the pair with the largest fitting item, if no pair of
      fitting items is longer (their places can swap); or the triple whose
      second is that largest item, if for every other fitting pair the third
      is at least as long as the pair's shorter item.

    A rule that holds goes on holding while its items last, since taking items
    away only shrinks the alternatives: whole counts are fixed at once."""
    for big in sorted(plan.left, reverse=True):
        while plan.left.get(big):
            room = plan.capacity - big
            have = plan.left[big]
            sizes = sorted(plan.left)
            count = lambda s: plan.left[s] - (s == big)  # noqa: E731  without the item itself
            smallest: list[int] = []
            for s in sizes:
                smallest += [s] * min(3, count(s))
                if len(smallest) >= 3:
                    break
            if not smallest or smallest[0] > room:
                plan.fix([big], have)
                continue
            best = max(s for s in sizes if s <= room and count(s))
            times = have // 2 if best == big else min(have, plan.left[best])
            if best == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
                plan.fix([big, best], max(1, times))
                continue
            if len(smallest) > 2 and sum(smallest[:3]) <= room:
                break
            pairs = _fitting_pairs([s for s in sizes if s < room and count(s)], room,
                                   lambda s: count(s))
            if best >= max(x + y for x, y in pairs):
                plan.fix([big, best], max(1, times))
                continue
            third = max((y for x, y in pairs if x == best), default=0)
            if third and all(y <= third for x, y in pairs) and big not in (best, third):
                times = min(have, plan.left[best], plan.left[third]) if best != third else min(have, plan.left[best] // 2)
                plan.fix([big, best, third], max(1, times))
                continue
            break


def _fitting_pairs(sizes: list[int], room: int, count) -> list[tuple[int, int]]:
    """For each size x the longest y <= x that fits beside it."""
    out = []
    for x in sizes:
        at = bisect_right(sizes, min(x, room - x)) - 1
        if at >= 0 and sizes[at] == x and count(x) < 2:
            at -= 1
        if at >= 0:
            out.append((x, sizes[at]))
    return out


def best_fit(plan: _Plan) -> None:
    """Best fit of what is left, longest first, on groups of equal sequences:
    an item goes where the least room stays. The sequence it went to has then
    less room than any other that can take one more of its length, so each
    sequence in turn takes as many as fit."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted(plan.left, reverse=True):
        while plan.left.get(length):
            need = plan.left[length]
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = plan.capacity // length
                n = -(-need // per)
                first, room = plan.sequences, plan.capacity
                plan.sequences += n
            else:
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
                per = room // length
            full = min(n, need // per)
            offset = plan.capacity - room
            if full:
                plan.take(length, full * per, per, first, offset)
                put(room - per * length, first, full)
            need -= full * per
            rest = n - full
            if rest and need:
                plan.take(length, need, need, first + full, offset)
                put(room - need * length, first + full, 1)
                put(room, first + full + 1, rest - 1)
            else:
                put(room, first + full, rest)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, reduce: bool = True) -> tuple[list[tuple], int]:
    """(runs, number of sequences) for so many items of each length."""
    if any(k < 1 or k > capacity for k in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    plan = _Plan(counts, capacity)
    if reduce:
        reduce_instance(plan)
    best_fit(plan)
    return plan.runs, plan.sequences


# ------------------------------------------------------------------- placing

def pack(items: DataFrame, key: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``items`` (with a column ``length`` of 1 to ``capacity``) with
    ``sequence_id`` and ``offset``: gapless from 0 in each sequence.

    ``key`` names columns that tell items apart; rows with the same key are
    separate items. Nulls in the key sort first. An empty table gives an empty
    table; columns named like the new ones are replaced; a null length or one
    out of range is an error."""
    items = items.drop("sequence_id", "offset", "__salt", "__salts", "__rank")
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if None in counts:
        raise ValueError("an item has no length")
    runs, _ = plan_packing(counts, capacity)
    runs.sort()
    run = np.array(runs, dtype=np.int64).reshape(-1, 6)

    # number the items within their length; a hot length in many groups
    spark = items.sparkSession
    hot = spark.createDataFrame([(k, -(-n // SALT_ROWS)) for k, n in counts.items()], "length long, __salts long")
    hot = hot.withColumn("length", F.col("length").cast(items.schema["length"].dataType))  # at most ``capacity`` rows
    salted = items.join(F.broadcast(hot), "length") \
        .select(*items.columns, F.pmod(F.xxhash64(*key), F.col("__salts")).cast("long").alias("__salt"))
    groups = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__salt").orderBy(*key)
    ranked = (salted.withColumn("__in", F.row_number().over(within) - 1)
              .join(groups, ["length", "__salt"])
              .withColumn("__rank", F.col("__before") + F.col("__in")))

    shared = spark.sparkContext.broadcast(run)
    kept = [c for c in items.columns]
    ranked = ranked.select(*kept, F.col("length").cast("long").alias("__len"), F.col("__rank").cast("long"))
    schema = items.schema.add("sequence_id", "long").add("offset", "long")
    target = to_arrow_schema(schema)

    def place(batches):
        runs = shared.value
        # one sorted key for (length, first rank)
        scale = int(max(1, (runs[:, 1] + runs[:, 2]).max(initial=0) + 1))
        keys = runs[:, 0] * scale + runs[:, 1]
        for b in batches:
            length = b.column(b.num_columns - 2).to_numpy()
            rank = b.column(b.num_columns - 1).to_numpy()
            r = runs[np.searchsorted(keys, length * scale + rank, side="right") - 1]
            i = rank - r[:, 1]
            seq, off = r[:, 4] + i // r[:, 3], r[:, 5] + (i % r[:, 3]) * length
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(b.columns[:-2], target, strict=False)]
                + [pa.array(seq, pa.int64()), pa.array(off, pa.int64())], schema=target)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY,
                   keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their place. The pieces are cut once and
    kept in the folder of ``spark.checkpoint.dir``: planning reads the lengths,
    placing reads them again."""
    checkpoint_dir(docs.sparkSession)
    pieces = tokenize_pieces(docs, tokenizer, capacity, keep_ids=keep_ids).checkpoint()
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, keep_ids=False)
