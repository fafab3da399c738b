"""Cheapest repair of the order of roles in conversations.

A repaired conversation is empty or has perhaps one system turn and then pairs of user and
assistant turns. Turns are kept, given another role or deleted, and empty turns inserted.
What the rest of a conversation costs from each of the four places in that pattern is a
vector; less its least number it is one of a few dozen, so what a block of turns does to it
is worked out once for all blocks and vectors (the tables below) and looked up after that.
Vectors run from the last turn to the first; every block is then expanded backward from the
vector behind it and traced forward, taking the least letter among the cheapest edits.

A conversation may hold any share of the rows: turns are sorted over all tasks, every
batch of a conversation becomes a chunk with a matrix of costs between entries and exits,
and only those matrices, one for some thousands of turns, pass through one task.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from gapwise.llm.shared import keep

# Places in the pattern: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
# The place after a system, user or assistant turn; None where the pattern has no such turn.
_AFTER = ((SYSTEM, USER, None), (None, USER, None), (None, None, ASSISTANT), (None, USER, None))
# The place after the turn that the pattern asks for, which is what gets inserted.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
DELETE, REROLE, INSERT, CUT = 3, 2, 2, 1
# Symbol 0 must go; the others are 1 + 2 * (place of the initial in INITIALS, 3 for others) + cut.
SYMBOLS = 9
BLOCK = 4
_NONE = 1 << 20

WHITE = " \t\n\x0b\f\r"
_KEYS = ["has_conv", "conv", "has_turn", "turn", "role", "digest"]
_KEY_TYPES = "has_conv boolean, conv long, has_turn boolean, turn long, role string, digest binary"
_CHUNKS = _KEY_TYPES + ", copies long, fault int, chunk long, pos int, symbols binary"
_CHUNK = "has_conv boolean, conv long, chunk long, symbols binary"
_EDITS = "chunk long, pos int, edits string, place int"
FAULTS = ("none", "blank", "duplicate", "truncated")


def _closed(costs: list[int]) -> tuple[int, ...]:
    """Costs when turns may be inserted first."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[_NEXT[p]]) for p, c in enumerate(costs)]
    return tuple(min(c, _NONE) for c in costs)


def _before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs in front of a turn from those behind it."""
    costs = [DELETE + c for c in after]
    if symbol:
        initial, cut = divmod(symbol - 1, 2)
        for p in range(4):
            costs[p] = min(costs[p], REROLE + cut + after[_NEXT[p]])
            kept = _AFTER[p][initial] if initial < 3 else None
            if kept is not None:
                costs[p] = min(costs[p], cut + after[kept])
    return _closed(costs)


def _normal(costs) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(_NONE if c >= _NONE else c - least for c in costs), least


END = _closed([0, _NONE, _NONE, 0])
EXITS = tuple(tuple(0 if p == q else _NONE for p in range(4)) for q in range(4))


class Tables:
    """All vectors that occur, and what a turn or a block of turns does to each."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.number: dict[tuple[int, ...], int] = {}
        steps, waiting = [], [END, *EXITS]
        for costs in waiting:
            self.number.setdefault(costs, len(self.number))
        waiting = list(self.number)
        for costs in waiting:
            row = []
            for symbol in range(SYMBOLS):
                after, least = _normal(_before(costs, symbol))
                if after not in self.number:
                    self.number[after] = len(self.number)
                    waiting.append(after)
                row.append((self.number[after], least))
            steps.append(row)
        self.vectors = np.array(waiting)
        step = np.array(steps)
        self.to, self.add = step[:, :, 0], step[:, :, 1]
        to = np.arange(len(waiting))[:, None]
        add = np.zeros_like(to)
        for _ in range(block):
            first = self.to[to]                          # vector, later turns, earlier turn
            total = add[:, :, None] + self.add[to]
            to = first.transpose(0, 2, 1).reshape(len(waiting), -1)
            add = total.transpose(0, 2, 1).reshape(len(waiting), -1)
        self.block_to, self.block_add = to, add
        self.weights = SYMBOLS ** np.arange(block - 1, -1, -1)
        self.traced: dict[tuple[int, int, int], tuple[tuple[str, ...], tuple[int, ...], int]] = {}

    def codes(self, symbols: np.ndarray) -> tuple[list[int], list[int]]:
        """Single turns in front and the codes of the blocks behind them."""
        loose = len(symbols) % self.block
        blocks = symbols[loose:].reshape(-1, self.block).astype(np.int64) @ self.weights
        return symbols[:loose].tolist(), blocks.tolist()

    def run(self, symbols: np.ndarray, after: int) -> tuple[int, int]:
        """Vector in front of the turns, and what is to be added to it."""
        loose, blocks = self.codes(symbols)
        total = 0
        for code in reversed(blocks):
            total += self.block_add[after, code]
            after = self.block_to[after, code]
        for symbol in reversed(loose):
            total += self.add[after, symbol]
            after = self.to[after, symbol]
        return int(after), int(total)

    def costs(self, symbols: np.ndarray) -> list[int]:
        """Cost from every entry to every exit, row by row."""
        columns = []
        for exit_costs in EXITS:
            vector, add = self.run(symbols, self.number[exit_costs])
            columns.append(np.minimum(self.vectors[vector] + add, _NONE))
        return np.array(columns).T.ravel().tolist()

    def turn(self, after: int, symbol: int, place: int) -> tuple[str, int]:
        """The least cheapest letters for one turn, insertions before it included."""
        behind = self.vectors[after]
        front = self.vectors[self.to[after, symbol]] + self.add[after, symbol]
        initial, cut = divmod(symbol - 1, 2)
        letters = ""
        while True:
            cost, following = front[place], _NEXT[place]
            if DELETE + behind[place] == cost:
                return letters + "D", place
            if INSERT + front[following] == cost:
                letters, place = letters + "I", following
                continue
            kept = _AFTER[place][initial] if symbol and initial < 3 else None
            if kept is not None and cut + behind[kept] == cost:
                return letters + "K", kept
            return letters + "R", following

    def _block(self, after: int, code: int, place: int):
        known = self.traced.get((after, code, place))
        if known is None:
            symbols = [code // w % SYMBOLS for w in self.weights.tolist()]
            inner = [after]
            for symbol in reversed(symbols[1:]):
                inner.append(int(self.to[inner[-1], symbol]))
            letters, places, now = [], [], place
            for symbol, behind in zip(symbols, reversed(inner)):
                places.append(now)
                text, now = self.turn(behind, symbol, now)
                letters.append(text)
            known = self.traced[after, code, place] = tuple(letters), tuple(places), now
        return known

    def trace(self, symbols: np.ndarray, after: int, place: int
              ) -> tuple[list[str], list[int], int]:
        """Letters of every turn, the place in front of each, and the place at the end."""
        loose, blocks = self.codes(symbols)
        behind = []
        for code in reversed(blocks):
            behind.append(after)
            after = int(self.block_to[after, code])
        single = []
        for symbol in reversed(loose):
            single.append(after)
            after = int(self.to[after, symbol])
        letters, places = [], []
        for symbol, vector in zip(loose, reversed(single)):
            places.append(place)
            text, place = self.turn(vector, symbol, place)
            letters.append(text)
        for code, vector in zip(blocks, reversed(behind)):
            some, at, place = self._block(vector, code, place)
            letters += some
            places += at
        return letters, places, place


@cache
def tables() -> Tables:
    return Tables()


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Offsets of the runs of equal rows."""
    n = len(columns[0])
    new = np.zeros(n + 1, bool)
    new[[0, n]] = True
    for c in columns:
        new[1:n] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns in; chunk, place in it and, on its first row, the symbols of all."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        if not batch.num_rows:
            continue
        has, conv = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("has_conv", "conv"))
        starts = _runs(has, conv)
        symbols = batch.column("symbol").to_numpy(zero_copy_only=False).astype(np.uint8)
        sizes = np.diff(starts)
        heads: list[bytes | None] = [None] * batch.num_rows
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            heads[a] = symbols[a:b].tobytes()
        own = number + np.arange(len(sizes))
        number += len(sizes)
        yield pa.RecordBatch.from_pydict({
            **{c: batch.column(c) for c in (*_KEYS, "copies", "fault")},
            "chunk": np.repeat(own, sizes),
            "pos": (np.arange(batch.num_rows) - np.repeat(starts[:-1], sizes)).astype(np.int32),
            "symbols": pa.array(heads, pa.binary())})


def _each(batches, name: str, kind, value) -> Iterator[pa.RecordBatch]:
    """Adds a column worked out from every row (as a dict)."""
    for batch in batches:
        found = [value(row) for row in batch.to_pylist()]
        yield batch.append_column(name, pa.array(found, kind))


def _symbols(row: dict) -> np.ndarray:
    return np.frombuffer(row["symbols"], np.uint8)


def _costs(batches):
    return _each(batches, "costs", pa.list_(pa.int32()), lambda row: tables().costs(_symbols(row)))


def _after(batches):
    """Chunks of a conversation from the last to the first: the vector behind each."""
    state = {"conv": None, "after": END}
    number = tables().number

    def value(row):
        conv = (row["has_conv"], row["conv"])
        if conv != state["conv"]:
            state.update(conv=conv, after=END)
        after = state["after"]
        costs = np.array(row["costs"]).reshape(4, 4) + np.array(after)
        state["after"] = _normal(np.minimum(costs.min(axis=1), _NONE).tolist())[0]
        return number[after]

    return _each(batches, "after", pa.int32(), value)


def _exits(batches):
    return _each(batches, "exits", pa.list_(pa.int32()), lambda row: [
        tables().trace(_symbols(row), row["after"], place)[2] for place in range(4)])


def _entries(batches):
    """Chunks of a conversation from the first to the last: the place in front of each."""
    state = {"conv": None, "place": START}

    def value(row):
        conv = (row["has_conv"], row["conv"])
        if conv != state["conv"]:
            state.update(conv=conv, place=START)
        place = state["place"]
        state["place"] = row["exits"][place]
        return place

    return _each(batches, "entry", pa.int32(), value)


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        found = [tables().trace(_symbols(r), r["after"], r["entry"]) for r in rows]
        sizes = [len(f[0]) for f in found]
        yield pa.RecordBatch.from_pydict({
            "chunk": np.repeat(np.array([r["chunk"] for r in rows], np.int64), sizes),
            "pos": np.concatenate([np.arange(n) for n in sizes] or [[]]).astype(np.int32),
            "edits": pa.array(itertools.chain.from_iterable(f[0] for f in found), pa.string()),
            "place": pa.array(itertools.chain.from_iterable(f[1] for f in found), pa.int32())})


def _keyed(turns: DataFrame, conv_col, turn_col, role_col, text_col) -> DataFrame:
    conv, turn = F.col(f"`{conv_col}`").cast("long"), F.col(f"`{turn_col}`").cast("long")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(" "))
    return turns.select(
        conv.isNotNull().alias("has_conv"), F.coalesce(conv, F.lit(0)).alias("conv"),
        turn.isNotNull().alias("has_turn"), F.coalesce(turn, F.lit(0)).alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"),
        F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))


def turn_edits(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
               role_col: str = "role", text_col: str = "text") -> DataFrame:
    """What becomes of every turn in the cheapest repair of its conversation.

    Turns come in the order of turn (nulls first), role and SHA-256 of the text. A null role
    or text is one space; a null conversation is one of its own. Equal rows are one row with
    their number in ``copies``: all but the first are duplicates and deleted. Other columns
    are not read; an empty table gives an empty result.

    Columns: has_conv and conv, has_turn and turn (0 where null), role, digest (of the text),
    copies, fault (number in FAULTS, of the first copy), chunk and pos (order within a
    conversation), edits (letters of the turn, insertions before it first; D for each further
    copy is not written out), place (in the pattern, in front of those letters). What has to
    be inserted behind the last turn follows from where its letters lead.
    """
    rows = _keyed(turns, conv_col, turn_col, role_col, text_col)
    trimmed = F.rtrim("text", F.lit(WHITE))
    slim = rows.select(*_KEYS, (trimmed == "").alias("blank"),
                       (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    merged = slim.groupBy(*_KEYS).agg(
        F.count(F.lit(1)).alias("copies"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    firsts = merged.groupBy("has_conv", "conv", "role", "digest").agg(
        F.min("has_turn").alias("has_turn"), F.min(F.when(F.col("has_turn"), F.col("turn"))).alias("t"))
    firsts = firsts.select(*[c for c in _KEYS if c != "turn"],
                           F.when(F.col("has_turn"), F.col("t")).otherwise(0).alias("turn"),
                           F.lit(True).alias("first"))
    # Both sides have one row for a key.
    told = merged.join(firsts, _KEYS, "left")
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    initial = F.coalesce(
        F.nullif(F.instr(F.lit(INITIALS), F.left("role", F.lit(1))), F.lit(0)), F.lit(4)) - 1
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    symbol = F.when(F.col("fault").isin(1, 2), 0).otherwise(
        1 + 2 * initial + (F.col("fault") == 3).cast("int"))
    told = told.select(*_KEYS, "copies", fault.alias("fault")).withColumn("symbol", symbol.cast("int"))
    chunks = keep(told.repartitionByRange(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(
        _chunks, _CHUNKS), "turns")
    conv = ["has_conv", "conv"]
    heads = chunks.filter(F.col("symbols").isNotNull()).select(*conv, "chunk", "symbols")
    costs = heads.mapInArrow(_costs, _CHUNK + ", costs array<int>")
    after = costs.repartition(*conv).sortWithinPartitions(*conv, F.desc("chunk")).mapInArrow(
        _after, _CHUNK + ", costs array<int>, after int")
    exits = after.select(*conv, "chunk", "symbols", "after").repartition("chunk").mapInArrow(
        _exits, _CHUNK + ", after int, exits array<int>")
    entries = exits.repartition(*conv).sortWithinPartitions(*conv, "chunk").mapInArrow(
        _entries, _CHUNK + ", after int, exits array<int>, entry int")
    letters = entries.select("chunk", "symbols", "after", "entry").repartition("chunk").mapInArrow(
        _letters, _EDITS)
    return chunks.select(*_KEYS, "copies", "fault", "chunk", "pos").join(letters, ["chunk", "pos"])


def repaired_turns(edits: str, place: int, role: str, text: str) -> tuple[list[str], int]:
    """The turns (``role:text``) that the letters of one turn leave, and the place after them."""
    lines = []
    for letter in edits:
        if letter == "D":
            continue
        if letter == "K":
            following = _AFTER[place][INITIALS.index(role[0])]
            lines.append(f"{role}:{text}")
        else:
            following = _NEXT[place]
            lines.append(f"{_ROLE[following]}:{text if letter == 'R' else ''}")
        place = following
    return lines, place


_DIGEST = ("has_conv boolean, conv long, gaps long, blank long, duplicate long, truncated long, "
           "illegal long, cost long, audit string, repaired_sha256 string")
_PRICE = {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}
_LEGAL = {"su", "ua", "au"}


class _Digest:
    """One conversation, turn by turn."""

    def __init__(self, conv):
        self.conv, self.place, self.role, self.lines = conv, START, None, 0
        self.faults = [0, 0, 0, 0]
        self.illegal = self.cost = self.turns = 0
        self.low = self.high = None
        self.audit, self.sha = [], hashlib.sha256()

    def write(self, lines):
        for line in lines:
            self.sha.update((b"\n" if self.lines else b"") + line.encode())
            self.lines += 1

    def add(self, row, text):
        copies, fault, role = row["copies"], row["fault"], row["role"]
        self.faults[fault] += 1
        self.faults[1 if fault == 1 else 2] += copies - 1
        if self.role is not None:
            self.illegal += self.role[:1] + role[:1] not in _LEGAL
        self.illegal += copies - 1
        self.role = role
        if row["has_turn"] and row["turn"] != self.high:
            self.turns += 1
            self.low = row["turn"] if self.low is None else self.low
            self.high = row["turn"]
        edits = row["edits"]
        self.cost += sum(map(_PRICE.get, edits)) + DELETE * (copies - 1)
        self.cost += CUT if fault == 3 and edits[-1] != "D" else 0
        self.audit.append(edits + "D" * (copies - 1))
        lines, self.place = repaired_turns(edits, self.place, role, text)
        self.write(lines)

    def row(self):
        tail = 0
        while END[self.place]:
            self.place = _NEXT[self.place]
            self.write([_ROLE[self.place] + ":"])
            tail += 1
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (*self.conv, gaps, *self.faults[1:], self.illegal, self.cost + INSERT * tail,
                "".join(self.audit) + "I" * tail, self.sha.hexdigest())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of a turn, then its text, in the order of conversations."""
    names = [c.split()[0] for c in _DIGEST.split(", ")]
    kinds = [pa.bool_(), *[pa.int64()] * 7, pa.string(), pa.string()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    now, waiting, done = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            conv = (row["has_conv"], row["conv"])
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.row())
                now = _Digest(conv)
            if row["edits"] is not None:
                waiting = row
            elif waiting is not None:
                # Further copies of the text follow; they add nothing.
                now.add(waiting, row["text"])
                waiting = None
        if done:
            yield batch_of(done)
            done = []
    if now is not None:
        yield batch_of([now.row()])


def conversation_repairs(turns: DataFrame, conversations: DataFrame | None = None,
                         conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: its faults, the cheapest repair and a digest of the result.

    ``conversations`` (default: ``turns``) names those to report; one without turns has zeros,
    an empty audit and the digest of nothing. Nulls, order and equal rows are treated as in
    ``turn_edits``. The audit and the digest are each one value over a whole conversation, so
    its turns pass one task in order, none of them held longer than a moment.
    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    edits = turn_edits(turns, conv_col, turn_col, role_col, text_col)
    body = _keyed(turns, conv_col, turn_col, role_col, text_col)
    none = F.lit(None)
    both = edits.select(*_KEYS, F.lit(0).alias("kind"), "copies", "fault", "edits",
                        none.cast("string").alias("text")).unionByName(
        body.select(*_KEYS, F.lit(1).alias("kind"), none.cast("long").alias("copies"),
                    none.cast("int").alias("fault"), none.cast("string").alias("edits"), "text"))
    found = both.repartition("has_conv", "conv").sortWithinPartitions(*_KEYS, "kind").mapInArrow(
        _digests, _DIGEST)
    conv = F.col(f"`{conv_col}`").cast("long")
    named = (turns if conversations is None else conversations).select(
        conv.isNotNull().alias("has_conv"), F.coalesce(conv, F.lit(0)).alias("conv")).distinct()
    numbers = [f.split()[0] for f in _DIGEST.split(", ") if f.endswith(" long")][1:]
    return named.join(found, ["has_conv", "conv"], "left").select(
        F.when(F.col("has_conv"), F.col("conv")).alias("conv_id"),
        *[F.coalesce(c, F.lit(0).cast(LongType())).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged(turns: DataFrame, share: int = 20) -> DataFrame:
    """Turns with faults put in by the CRC of ``conv_id:turn`` modulo ``share``: 0 drops the
    turn, 1 empties it, 2 takes its full stops, 3 repeats it, 4 makes its role user. A null in
    any column counts as one space there; conv_id and turn stay null."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c)
                     for c in ("conv_id", ":", "turn")])
    what = F.crc32(key) % share
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                        what.alias("what")).filter("what <> 0").select(
        "conv_id", "turn",
        F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("what") == 1, "").when(
            F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("what") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
