"""Repair of conversation structure: faults, and the cheapest edits to alternating turns.

The initials of a repaired conversation's roles read ``(s?(ua)+)?``.  Rows are kept (0),
given the role user or assistant (3), or deleted (4; blank and duplicate rows must be),
and empty rows of user or assistant inserted anywhere (3); a truncated row that stays adds
3.  The edits' initials K, R, D, I form the audit; of equally cheap audits the ASCII-least
is taken, which also fixes the repaired rows.

Conversations are dealt out by their id, sorted by turn, and stream through a dynamic
program whose state outlives Arrow batches: for each state of the role automaton the
least cost, and the rank of the least audit among those of all states.  Audits that have
used up the same rows and end in one of them are never prefixes of each other, so ranks
are enough to settle every tie.  What a row does to a state is learned once and looked up
from then on; the number of that transition is the row's backpointer.

Giant conversations (over ``rows`` rows or ``size`` bytes) do not pass through one task:
their rows are dealt out by ranges of turns and cut into blocks.  A block is solved from
every state it may be entered in; its backpointers and rows are spilled as one row of a
table in the shared folder.  The blocks' costs and ranks, a few numbers each, are then
chained per conversation, and each block is traced back from the state it is left in.

Edge cases: a null role or text is one space; a null turn comes first and counts in no gap;
null ids are one conversation; rows of one turn are ordered by role and by a hash of the
text; a role without an initial fits nowhere and is given one or deleted; a row whose
``present`` is false names its conversation only; a conversation without rows has zeros,
an empty audit and the hash of no text; very long texts are handled row by row; an empty
table gives none; only the named columns are read, so further ones never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, in_chunks, materialised

#: From so many rows, or bytes of text, on a conversation is a giant; rows and bytes of its blocks.
GIANT_ROWS, GIANT_BYTES, BLOCK_ROWS, BLOCK_BYTES = 50_000, 64 << 20, 20_000, 16 << 20

#: Automaton: nothing yet, after a system row, after a user row, after an assistant row.
STATES, COMPLETE = range(4), (0, 3)
INITIALS = "sua"
_FITS = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}}  # initial: state before -> after
_NEXT = (2, 2, 3, 2)  # what user or assistant leads to

#: Kinds of rows: initial (3: any other), plus 4 if truncated; blank or duplicate.
OTHER, TRUNCATED, REFUSED = 3, 4, 8
ROLE = {2: "user", 3: "assistant"}


def moves(state: int, kind: int) -> list[tuple[str, int, int]]:
    """(edits, cost, state after) that a row allows, insertions before it included."""
    out, fined = [], 3 if TRUNCATED <= kind < REFUSED else 0
    for k in range(3):
        inserted = "I" * k
        out.append((inserted + "D", 3 * k + 4, state))
        if kind != REFUSED:
            after = _FITS.get(kind % 4, {}).get(state)
            if after is not None:
                out.append((inserted + "K", 3 * k + fined, after))
            out.append((inserted + "R", 3 * k + 3 + fined, _NEXT[state]))
        state = _NEXT[state]
    return out


_MOVES = [[moves(s, kind) for s in STATES] for kind in range(REFUSED + 1)]


class Program:
    """The dynamic program from each of ``entries``, its transitions learned as they come.

    A node is (costs, ranks) over entries and states, costs less the entry's least."""

    def __init__(self, entries: tuple[int, ...] = (0,)):
        self.entries = entries
        self.start = (tuple(0 if s == e else None for e in entries for s in STATES), (0,) * (4 * len(entries)))
        self.nodes, self.number = [self.start], {self.start: 0}
        self.known: dict[tuple[int, int], tuple[int, int]] = {}
        self.back: list[bytes] = []
        self.gain: list[tuple[int, ...]] = []

    def _learn(self, node: int, kind: int) -> tuple[int, int]:
        costs, ranks = self.nodes[node]
        best: dict[int, tuple] = {}
        for at, cost in enumerate(costs):
            if cost is not None:
                for edits, more, after in _MOVES[kind][at % 4]:
                    to = at - at % 4 + after
                    candidate = (cost + more, ranks[at], edits, at % 4)
                    if to not in best or candidate < best[to]:
                        best[to] = candidate
        order = {x: i for i, x in enumerate(sorted({(r, e) for _, r, e, _ in best.values()}))}
        least = tuple(min(best[4 * e + s][0] for s in STATES if 4 * e + s in best) for e in range(len(self.entries)))
        places = range(len(costs))
        new = (
            tuple(best[at][0] - least[at // 4] if at in best else None for at in places),
            tuple(order[best[at][1:3]] if at in best else 0 for at in places),
        )
        if new not in self.number:
            self.number[new] = len(self.nodes)
            self.nodes.append(new)
        # state before, insertions, edit
        self.back.append(bytes(best[at][3] | (len(best[at][2]) - 1) << 2 | "DKR".index(best[at][2][-1]) << 4 if at in best else 0 for at in places))
        self.gain.append(least)
        self.known[node, kind] = self.number[new], len(self.back) - 1
        return self.known[node, kind]

    def run(self, kinds: list[int]) -> tuple[list[int], list[int | None], tuple[int, ...]]:
        """Transition of each row, costs and ranks at the end."""
        node, path, known = 0, [], self.known
        for kind in kinds:
            node, step = known.get((node, kind)) or self._learn(node, kind)
            path.append(step)
        costs, ranks = self.nodes[node]
        base = np.sum([self.gain[t] for t in path], axis=0, dtype=np.int64) if path else np.zeros(len(self.entries), np.int64)
        return path, [None if c is None else int(c + base[at // 4]) for at, c in enumerate(costs)], ranks


def ending(costs: list[int | None], ranks: list[int]) -> tuple[int, int, int]:
    """(cost, state, insertions after it) of the cheapest, least end."""
    ends = []
    for s in STATES:
        if costs[s] is not None:
            at = s
            for k in range(3):
                if at in COMPLETE:
                    ends.append((costs[s] + 3 * k, ranks[s], k, s))
                at = _NEXT[at]
    cost, _, k, s = min(ends)
    return cost, s, k


def traced(back: list[bytes], entry: int, state: int) -> tuple[list[tuple[int, str, int]], int]:
    """(insertions before, edit, state after) of each row, and the state before all, from
    the state after all."""
    out = []
    for codes in reversed(back):
        code = codes[4 * entry + state]
        out.append((code >> 2 & 3, "DKR"[code >> 4], state))
        state = code & 3
    out.reverse()
    return out, state


def edited(steps: list[tuple[int, str, int]], rows: list[tuple[str, str]], state: int, last: int) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) of every edit; ``last`` insertions end them."""
    for (inserted, edit, after), (role, text) in zip(steps, rows):
        for _ in range(inserted):
            state = _NEXT[state]
            yield "I", ROLE[state], ""
        yield edit, ROLE[after] if edit == "R" else role, text
        state = after
    for _ in range(last):
        state = _NEXT[state]
        yield "I", ROLE[state], ""


class Digest:
    """SHA-256 of repaired rows, joined by line ends."""

    def __init__(self):
        self.hash, self.some = hashlib.sha256(), False

    def add(self, edits: list[tuple[str, str, str]]) -> None:
        for edit, role, text in edits:
            if edit != "D":
                self.hash.update((("\n" if self.some else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                self.some = True

    def text(self) -> str:
        return self.hash.hexdigest()


@dataclass
class Tally:
    """Faults of rows in order."""

    turns: list[int] = field(default_factory=lambda: [0, 0, 0])  # least, largest, distinct
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0))
    last: int | None = None
    kinds: list[int] = field(default_factory=list)

    def row(self, turn: int | None, initial: int, blank: bool, seen: bool, cut: bool) -> None:
        if turn is not None:
            least, largest, n = self.turns
            self.turns = [turn, turn, 1] if not n else [least, turn, n + (turn > largest)]
        if self.last is not None and not fits(self.last, initial):
            self.counts["illegal"] += 1
        self.last = initial
        fault = "blank" if blank else "duplicate" if seen else "truncated" if cut else None
        if fault:
            self.counts[fault] += 1
        self.kinds.append(REFUSED if blank or seen else initial + (TRUNCATED if cut else 0))

    def gaps(self) -> int:
        least, largest, n = self.turns
        return largest - least + 1 - n if n else 0


def fits(a: int, b: int) -> bool:
    """Whether a row of initial ``b`` may follow one of ``a``."""
    return (a, b) in ((0, 1), (1, 2), (2, 1))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _fields(kind: T.DataType, *more: str) -> T.StructType:
    return T.StructType([T.StructField("conv", kind), *T._parse_datatype_string(", ".join(more)).fields])


_SUMMARY = (*(f"{c} long" for c in COUNTS), "audit string", "repaired_sha256 string")
_EDITS = ("block long", "edits array<struct<edit: string, role: string, text: string>>")


def described(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None) -> DataFrame:
    """The rows with what the program needs of them, under names of its own."""
    named = lambda c: F.col(f"`{c}`")
    space = lambda c: F.coalesce(named(c), F.lit(" "))
    closed = F.rtrim(F.translate(F.col("text"), "\t\n\x0b\x0c\r", " " * 5))
    rows = df.select(
        named(conv_col).alias("conv"), named(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
    )
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    return rows.select(
        "*", place.alias("initial"), (~F.rlike("text", F.lit(WORD))).alias("blank"), (~F.substring(closed, -1, 1).isin(".", "!", "?")).alias("cut"), F.xxhash64("text").alias("th")
    )


def _order() -> list[Column]:
    return [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("th")]


def _runs(batches: Iterator[pa.RecordBatch], names: list[str], by: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of equal ``by`` columns over all batches, each with its rows of ``names`` as they stream."""
    from itertools import groupby

    def rows():
        for batch in in_chunks(batches, "text") if "text" in names else batches:
            yield from zip(*(batch.column(c).to_pylist() for c in names))

    at = [names.index(c) for c in by]
    yield from groupby(rows(), key=lambda r: tuple(r[i] for i in at))


def _small(rows: DataFrame, kind: T.DataType, listed: bool) -> DataFrame:
    """Summaries of conversations that fit in a task's memory, or their edits."""
    names = ["conv", "turn", "role", "text", "present", "initial", "blank", "cut"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program, out, size = Program(), [], 0
        for (conv,), group in _runs(batches, names, ["conv"]):
            tally, kept, seen = Tally(), [], set()
            for _, turn, role, text, present, initial, blank, cut in group:
                if present:
                    tally.row(turn, initial, blank, (role, text) in seen, cut)
                    seen.add((role, text))
                    kept.append((role, text))
            path, costs, ranks = program.run(tally.kinds)
            cost, state, last = ending(costs, ranks)
            steps, _ = traced([program.back[t] for t in path], 0, state)
            edits = list(edited(steps, kept, 0, last))
            if listed:
                out.append((conv, 0, edits))
                size += sum(len(t) for _, _, t in edits)
            else:
                digest = Digest()
                digest.add(edits)
                out.append((conv, tally.gaps(), *tally.counts.values(), cost, "".join(e for e, _, _ in edits), digest.text()))
            if len(out) >= 1000 or size > BLOCK_BYTES:
                yield from packed(out)
                out, size = [], 0
        yield from packed(out)

    schema = _fields(kind, *(_EDITS if listed else _SUMMARY))
    arrow = _arrow(schema)

    def packed(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    sorted_rows = rows.repartition("conv").sortWithinPartitions(*_order()).select(*names)
    return sorted_rows.mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _blocks(rows: DataFrame, kind: T.DataType) -> DataFrame:
    """Giant conversations in solved blocks, spilled to the shared folder."""
    rows = materialised(rows.filter("present").withColumn("uid", F.monotonically_increasing_id()))
    # a duplicate is a row that is not its text's first; copies shrink to one row before they meet
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"), F.col("uid"))
    keyed = rows.withColumn("same", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    firsts = keyed.groupBy("conv", "same").agg(F.min(place).alias("first"))
    flags = keyed.select("conv", "same", "uid").join(
        firsts.select(F.col("conv").alias("c"), F.col("same").alias("s"), F.col("first.uid").alias("first")), F.col("conv").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s"))
    )
    flags = flags.select("uid", (F.col("uid") != F.col("first")).alias("seen"))
    names = ["conv", "turn", "role", "text", "initial", "blank", "cut", "seen"]
    order = [*_order(), F.asc("uid")]
    dealt = rows.join(flags, "uid").repartitionByRange(*order).sortWithinPartitions(*order).select(*names)
    schema = _fields(
        kind, "part long", "block long", "costs array<long>", "ranks array<int>", "back binary", "first int", "last int", "blank long", "duplicate long", "truncated long", "illegal long",
        "rows array<struct<role: string, text: string>>",
    )
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, program = TaskContext.get().partitionId(), Program(tuple(STATES))

        def solved(conv, number: int, tally: Tally, kept: list[tuple[str, str]], first: int) -> pa.RecordBatch:
            path, costs, ranks = program.run(tally.kinds)
            back = b"".join(program.back[t] for t in path)
            c = tally.counts
            row = (conv, part, number, costs, list(ranks), back, first, tally.last, c["blank"], c["duplicate"], c["truncated"], c["illegal"], kept)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow)], schema=arrow)

        for (conv,), group in _runs(batches, names, ["conv"]):
            number, size, tally, kept, first = 0, 0, Tally(), [], None
            for _, turn, role, text, initial, blank, cut, seen in group:
                first = initial if first is None else first
                tally.row(turn, initial, blank, seen, cut)
                kept.append((role, text))
                size += len(text)
                if len(kept) >= BLOCK_ROWS or size >= BLOCK_BYTES:
                    yield solved(conv, number, tally, kept, first)
                    number, size, tally, kept, first = number + 1, 0, Tally(), [], None
            if kept:
                yield solved(conv, number, tally, kept, first)

    return materialised(dealt.mapInArrow(run, schema))


def _chained(blocks: DataFrame, kind: T.DataType) -> DataFrame:
    """For each block the states it is entered and left in and the insertions behind it;
    the conversation's totals stand with its last block."""
    names = ["conv", "part", "block", "costs", "ranks", "first", "last", "blank", "duplicate", "truncated", "illegal"]
    schema = _fields(kind, "part long", "block long", "entered int", "left int", "inserted int", *(f"{c} long" for c in COUNTS[1:]))
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), group in _runs(batches, names, ["conv"]):
            costs, ranks, last = [0, None, None, None], [0] * 4, None
            totals, met = dict.fromkeys(COUNTS[1:], 0), []
            for _, part, number, c, r, first, end, *found in group:
                best: dict[int, tuple] = {}
                for at, (more, rank) in enumerate(zip(c, r)):
                    before, after = divmod(at, 4)
                    if more is not None and costs[before] is not None:
                        candidate = (costs[before] + more, ranks[before], rank, before)
                        if after not in best or candidate < best[after]:
                            best[after] = candidate
                order = {x: i for i, x in enumerate(sorted({b[1:3] for b in best.values()}))}
                costs, ranks = [best[s][0] if s in best else None for s in STATES], [order[best[s][1:3]] if s in best else 0 for s in STATES]
                met.append((part, number, bytes(best[s][3] if s in best else 0 for s in STATES)))
                for name, n in zip(COUNTS[1:], found):
                    totals[name] += n
                totals["illegal"] += last is not None and not fits(last, first)
                last = end
            totals["cost"], state, inserted = ending(costs, ranks)
            out = []
            for i, (part, number, before) in enumerate(reversed(met)):
                out.append((conv, part, number, before[state], state, inserted if not i else 0, *([*totals.values()] if not i else [0] * len(totals))))
                state = before[state]
            for start in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[start : start + 10_000]), arrow)], schema=arrow)

    return blocks.select(*names).repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "part", "block").mapInArrow(run, schema)


def _traced_blocks(blocks: DataFrame, kind: T.DataType) -> DataFrame:
    """(conv, part, block, edits, and totals in the last block), a row for each block."""
    chained = _chained(blocks, kind)
    keys = [F.col("chain.conv").eqNullSafe(F.col("solved.conv")), F.col("chain.part") == F.col("solved.part"), F.col("chain.block") == F.col("solved.block")]
    joined = blocks.select("conv", "part", "block", "back", "rows").alias("solved").join(chained.alias("chain"), keys)
    totals = COUNTS[1:]
    schema = _fields(kind, "part long", *_EDITS, *(f"{c} long" for c in totals))
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                back = row["back"]
                steps, _ = traced([back[k : k + 16] for k in range(0, len(back), 16)], row["entered"], row["left"])
                edits = list(edited(steps, [(r["role"], r["text"]) for r in row["rows"]], row["entered"], row["inserted"]))
                out = (row["conv"], row["part"], row["block"], edits, *(row[c] for c in totals))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, arrow)], schema=arrow)

    return joined.select("solved.*", "entered", "left", "inserted", *totals).mapInArrow(run, schema)


def _giant_summaries(blocks: DataFrame, rows: DataFrame, kind: T.DataType) -> DataFrame:
    """Summaries of giant conversations: their blocks stream past in order."""
    turns = rows.filter("present").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv")
    gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    names = ["conv", "edits", *COUNTS[1:]]
    schema = _fields(kind, *_SUMMARY)
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), group in _runs((b.slice(i, 1) for b in batches for i in range(b.num_rows)), names, ["conv"]):
            digest, audit, totals = Digest(), [], dict.fromkeys(COUNTS, 0)
            for _, edits, *found in group:
                digest.add([(e["edit"], e["role"], e["text"]) for e in edits])
                audit.append("".join(e["edit"] for e in edits))
                for name, n in zip(COUNTS[1:], found):
                    totals[name] += n
            row = (conv, *totals.values(), "".join(audit), digest.text())
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow)], schema=arrow)

    found = _traced_blocks(blocks, kind).repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "part", "block").select(*names).mapInArrow(run, schema)
    return found.alias("f").join(gaps.alias("g"), F.col("f.conv").eqNullSafe(F.col("g.conv"))).select("f.conv", "g.gaps", *(f"f.{c}" for c in (*COUNTS[1:], "audit", "repaired_sha256")))


def _parts(rows: DataFrame, limit_rows: int, limit_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of conversations that fit in memory, rows of giants or None)."""
    sizes = rows.filter("present").groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    giants = materialised(sizes.filter((F.col("n") > limit_rows) | (F.col("b") > limit_bytes)).select(F.col("conv").alias("giant")))
    if giants.isEmpty():
        return rows, None
    same = F.col("conv").eqNullSafe(F.col("giant"))
    return rows.join(giants, same, "left_anti"), rows.join(giants, same, "left_semi")


def repair(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    present: Column | None = None, giant_rows: int = GIANT_ROWS, giant_bytes: int = GIANT_BYTES,
) -> DataFrame:
    """One row per conversation: its faults, the cost and audit of its repair, and the SHA-256
    of its repaired rows (``role:text``, joined by line ends)."""
    kind = df.schema[conv_col].dataType
    small, giant = _parts(described(df, conv_col, turn_col, role_col, text_col, present), giant_rows, giant_bytes)
    found = _small(small, kind, listed=False)
    if giant is not None:
        found = found.unionByName(_giant_summaries(_blocks(giant, kind), giant, kind))
    return found.withColumnRenamed("conv", conv_col)


def repaired_rows(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    present: Column | None = None, giant_rows: int = GIANT_ROWS, giant_bytes: int = GIANT_BYTES,
) -> DataFrame:
    """(conversation, block, pos, edit, role, text) of every edit, deleted rows included: the
    repaired conversation is what is not D, by block and pos."""
    kind = df.schema[conv_col].dataType
    small, giant = _parts(described(df, conv_col, turn_col, role_col, text_col, present), giant_rows, giant_bytes)
    found = _small(small, kind, listed=True)
    if giant is not None:
        blocks = _traced_blocks(_blocks(giant, kind), kind)
        found = found.unionByName(blocks.select("conv", (F.col("part") * F.lit(1 << 32) + F.col("block")).alias("block"), "edits"))
    listed = found.select("conv", "block", F.posexplode("edits").alias("pos", "edit"))
    return listed.select(F.col("conv").alias(conv_col), "block", "pos", "edit.edit", "edit.role", "edit.text")
