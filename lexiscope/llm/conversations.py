"""Conversation structure repair over a suffix-shared automaton.

A conversation's rows, in the order of their turns, are one word over nine
symbols: the row has to go (blank or duplicate), or it has a role initial (s, u,
a or another) and is whole or truncated. The cheapest edits that make the role
initials match ``(s?(ua)+)?`` depend on that word alone, and from any row on only
on its suffix and on what the grammar expects next. So the suffixes of all
conversations are the nodes of one acyclic automaton, shared from the end: each
node holds, for each of four grammar states, the cost to go and the best next
edit, and both follow from the node one symbol shorter.

Spark sorts the reversed words by range, so words with a common suffix lie side
by side. A task keeps the nodes of the current word on a stack, goes back to
where the next word parts from it and adds what is new: every node is computed
once, but for those of the path at the border of two partitions. As at most one
edit of each initial leaves a state, the ASCII-least of equally cheap audits
follows from the initials, and the audit is read off the stack.

The edits are carried out on the rows as they stream by in order, after a second
shuffle that brings each conversation's audit in front of its rows. No task
holds a conversation's texts.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lexiscope.llm.arrow_rows import col, table
from lexiscope.session import checkpoint_dir

WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
KINDS = 20
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BATCH_BYTES = 4 << 20

#: Grammar states: nothing yet, after s, after u, after a. From each one the
#: initial that an inserted or reroled row takes, and the state behind it.
EXPECTED = "uuau"
NEXT = (2, 2, 3, 2)
#: At the end of a word: the costs and moves of the four states ("." stops).
_END = ((0, 4, 2, 0), ".II.")


# ------------------------------------------------------------------ the grammar

def kept_state(symbol: str, state: int) -> int | None:
    """The state behind a kept row, None where the grammar forbids it."""
    initial = symbol.lower()
    if initial == "s":
        return 1 if state == 0 else None
    return NEXT[state] if initial == EXPECTED[state] else None


@functools.lru_cache(maxsize=100_000)
def step(costs: tuple, symbol: str) -> tuple[int, tuple, str]:
    """(least cost, costs above it, moves) of the node that puts ``symbol``
    before one of the given costs. Of equally cheap edits the first letter wins."""
    late = TRUNCATED * (symbol in "SUAO")
    found = []
    for state in range(4):
        options = [(DELETE + costs[state], "D")]
        if symbol != "X":
            after = kept_state(symbol, state)
            if after is not None:
                options.append((late + costs[after], "K"))
            options.append((REROLE + late + costs[NEXT[state]], "R"))
        found.append(min(options))
    best = list(found)
    for _ in range(2):  # two rows may be inserted one behind the other
        for state in range(4):
            best[state] = min(found[state], (INSERT + best[NEXT[state]][0], "I"))
    least = min(cost for cost, _ in best)
    return least, tuple(cost - least for cost, _ in best), "".join(move for _, move in best)


class SuffixStack:
    """The automaton's nodes along one word, from its end; ``read`` moves on to
    the next word, keeping the nodes of the suffix they share."""

    def __init__(self):
        self.word = ""  # reversed
        self.base, self.costs, self.moves = [0], [_END[0]], [_END[1]]
        self.made = 0

    def read(self, word: str) -> tuple[int, str]:
        """(cost, audit) of a reversed word."""
        shared, most = 0, min(len(word), len(self.word))
        while shared < most and word[shared] == self.word[shared]:
            shared += 1
        for stack in (self.base, self.costs, self.moves):
            del stack[shared + 1:]
        for symbol in word[shared:]:
            least, costs, moves = step(self.costs[-1], symbol)
            self.base.append(self.base[-1] + least)
            self.costs.append(costs)
            self.moves.append(moves)
            self.made += 1
        self.word = word
        return self.base[-1] + self.costs[-1][0], self.audit()

    def audit(self) -> str:
        out, state, at = [], 0, len(self.word)
        while (move := self.moves[at][state]) != ".":
            out.append(move)
            if move == "I":
                state = NEXT[state]
                continue
            at -= 1
            if move == "K":
                state = kept_state(self.word[at], state)
            elif move == "R":
                state = NEXT[state]
        return "".join(out)


# ---------------------------------------------------------------------- damage

def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of each row of a table of
    conversations, damaged by the remainder of crc32(``conv_id:turn``) and 20:
    0 drops it (no copies), 1 empties its text, 2 takes the marks ``.!?`` out of
    it, 3 repeats it (two copies), 4 sets its role to user. Nulls count as one
    space."""
    said = lambda name: F.coalesce(col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % KINDS
    return rows.select(
        col("conv_id").alias("conv_id"), col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(said("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ENDS, "")).otherwise(said("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


# ------------------------------------------------------------------ signatures

def _keyed(rows: DataFrame, copies: str | None) -> DataFrame:
    times = col(copies).cast("int") if copies else F.lit(1)
    said = lambda name: F.coalesce(col(name).cast("string"), F.lit(" "))
    rows = rows.select(col("conv_id").alias("conv_id"), col("turn").cast("long").alias("turn"), said("role").alias("role"),
                       said("text").alias("text"), times.alias("copies"))
    return rows.withColumn("digest", F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text"))))


def _by_batch(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def signatures(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """(conv_id, word, gaps, blank, duplicate, truncated, illegal) of each
    conversation; ``word`` is reversed. Texts stay where they are: the rows
    shuffled hold flags and digests, equal rows of a turn as one."""
    ended = F.rtrim(F.col("text"), F.lit(WHITE))
    light = _keyed(rows, copies).groupBy("conv_id", "turn", "digest").agg(
        F.sum("copies").alias("copies"), F.first(F.substring("role", 1, 1)).alias("initial"),
        F.first(ended == "").alias("blank"), F.first(~F.substring(ended, -1, 1).isin(*ENDS)).alias("open"))
    first = Window.partitionBy("conv_id", "digest").orderBy("here", "turn")
    light = light.withColumn("here", F.col("copies") == 0).withColumn("again", F.row_number().over(first) > 1).drop("here")
    light = light.select("conv_id", "turn", "copies", "initial", "blank", "open", "again", "digest") \
        .repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "digest")
    schema = light.select("conv_id").schema
    for name, kind in (("word", "string"), *((n, "long") for n in ("gaps", "blank", "duplicate", "truncated", "illegal"))):
        schema = schema.add(name, kind)
    target = to_arrow_schema(schema)

    def read(rows):
        def end():
            return conv, word[::-1].decode(), high - low + 1 - turns if turns else 0, n_blank, n_dup, n_open, n_illegal

        started, conv = False, None
        for conv_id, turn, copies, initial, blank, still_open, again, _ in rows:
            if not started or conv_id != conv:
                if started:
                    yield end()
                started, conv = True, conv_id
                word, before = bytearray(), None
                low = high = None
                turns = n_blank = n_dup = n_open = n_illegal = 0
            if not copies:
                continue
            if turn is not None and turn != high:
                low, high, turns = (turn if low is None else low), turn, turns + 1
            kept = not blank and not again
            letter = initial if initial in ("s", "u", "a") else "o"
            word += ((letter.upper() if still_open else letter) if kept else "X").encode() + b"X" * (copies - 1)
            n_blank += copies * blank
            n_dup += (copies - kept) * (not blank)
            n_open += kept and still_open
            n_illegal += (before is not None and before + initial not in ("su", "ua", "au")) + copies - 1
            before = initial
        if started:
            yield end()

    return light.mapInArrow(lambda batches: _by_batch(read(_rows(batches)), target), schema)


def plan_repairs(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each
    conversation."""
    words = signatures(rows, copies)
    schema = words.drop("word").schema.add("cost", "long").add("audit", "string")
    target = to_arrow_schema(schema)

    def read(rows):
        stack, last, found = SuffixStack(), None, (0, "")
        for word, *rest in rows:
            if word != last:
                last, found = word, stack.read(word)
            yield (*rest, *found)

    ordered = words.select("word", *[c for c in words.columns if c != "word"]) \
        .repartitionByRange(F.col("word"), F.col("conv_id")).sortWithinPartitions("word")
    return ordered.mapInArrow(lambda batches: _by_batch(read(_rows(batches)), target), schema)


# ----------------------------------------------------------------------- edits

def _edited(audit: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(edit, role, text) in order, deleted rows too, for the rows (role, text,
    copies) of one conversation."""
    copies = ((role, text) for role, text, n in rows for _ in range(n))
    state = 0
    for move in audit:
        role, text = (b"", b"") if move == "I" else next(copies)
        if move in "IR":
            role, state = (b"user" if EXPECTED[state] == "u" else b"assistant"), NEXT[state]
        elif move == "K":
            state = 1 if role[:1] == b"s" else NEXT[state]
        yield move, role, text


def _in_order(rows: DataFrame, plans: DataFrame, copies: str | None) -> DataFrame:
    """Each conversation's plan and, behind it, its rows in order; all columns of
    the other kind are null."""
    keyed = _keyed(rows, copies).withColumn("role", F.col("role").cast("binary")).withColumn("text", F.col("text").cast("binary"))
    both = plans.withColumn("row", F.lit(False)).unionByName(keyed.withColumn("row", F.lit(True)), allowMissingColumns=True)
    names = [c for c in plans.columns if c != "conv_id"]
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "row", F.asc_nulls_first("turn"), "digest") \
        .select("row", "role", "text", "copies", "conv_id", *names)


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(plan, its rows as they come) over the stream of ``_in_order``."""
    count = 0

    def number(r):
        nonlocal count
        count += not r[0]
        return count

    for _, mine in itertools.groupby(rows, number):
        plan = next(mine)
        yield plan[4:], (r[1:4] for r in mine)


def repaired_turns(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """The repaired conversations: (conv_id, place, edit, role, text) with ``place``
    from 0 and ``edit`` one of Keep, Rerole, Insert. See ``repair_conversations``."""
    checkpoint_dir(rows.sparkSession)
    ordered = _in_order(rows, plan_repairs(rows, copies).select("conv_id", "audit"), copies)
    schema = ordered.select("conv_id").schema.add("place", "long").add("edit", "string").add("role", "binary").add("text", "binary")
    names = {"K": "Keep", "R": "Rerole", "I": "Insert"}

    def read(rows):
        for (conv_id, audit), mine in _conversations(rows):
            kept = (x for x in _edited(audit, mine) if x[0] != "D")
            for place, (move, role, text) in enumerate(kept):
                yield conv_id, place, names[move], role, text

    target = to_arrow_schema(schema)
    out = ordered.mapInArrow(lambda batches: _by_batch(read(_rows(batches)), target), schema)
    return out.withColumn("role", F.col("role").cast("string")).withColumn("text", F.col("text").cast("string"))


def repair_conversations(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """A row for each conv_id of ``rows`` (conv_id, turn, role, text): gaps, blank,
    duplicate, truncated, illegal, cost, audit and repaired_sha256. ``copies``
    names a column with the number of rows that a row stands for, side by side.

    Rows go by turn, nulls first; rows of one turn by a digest of role and text,
    equal ones side by side. Null roles and texts count as one space, so a null
    text is blank. A null conv_id is a conversation of its own. A role is told by
    its first letter, upper case and an empty role by none. Rows of no copies
    only name their conversation: without another row it has zeros, an empty
    audit and the hash of the empty string. Long texts pass by one at a time; a
    conversation's audit, a letter for each row, is held as a whole. An empty
    table gives an empty table; other columns are not read."""
    checkpoint_dir(rows.sparkSession)
    plans = plan_repairs(rows, copies).checkpoint()
    ordered = _in_order(rows, plans, copies)
    schema = plans.schema.add("repaired_sha256", "string")
    target = to_arrow_schema(schema)
    audit_at = plans.columns.index("audit")

    def read(rows):
        for plan, mine in _conversations(rows):
            digest, behind = hashlib.sha256(), b""
            for move, role, text in _edited(plan[audit_at], mine):
                if move != "D":
                    digest.update(behind + role + b":")
                    digest.update(text)
                    behind = b"\n"
            yield (*plan, digest.hexdigest())

    return ordered.mapInArrow(lambda batches: _by_batch(read(_rows(batches)), target), schema)


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every damaged conversation."""
    return repair_conversations(damage(table(spark, sf_dir, "conversations")), copies="copies")
