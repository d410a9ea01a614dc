"""Conversation structure repair by a run-length DP (operator 13).

The rows of a conversation, in order of turn (nulls first), become symbols: the initial of the role
(s, u, a or another) and the row's first fault (blank, duplicate, truncated or none). Equal symbols
in a row are one run. A row is a min-plus transition between the places of `(s?(ua)+)?`: at the
start, after s, after u, after a. The cost from every place to the end is carried backwards over the
runs, over one of n rows by the cached binary powers of its symbol's transition; the edits are then
unrolled forwards, the least of the cheapest in ASCII order at each step.

How the work is dealt: equal rows of a conversation are counted before they are shuffled; the rows are
sorted into ranges and written, so a conversation of any share of the table is many tasks' work up to
the symbols and the pieces of text. One task per conversation then gets runs of symbols and pieces
of about PIECE_BYTES: the edits, which the result holds as one string, and the digest, which can
only be taken in order, as a stream that keeps one piece at a time.

Rows of equal turn come in order of role and text. A null role or text counts as one space. Null ids
are a conversation like any other. Repeated rows are duplicates. An empty table gives an empty
result; extra columns are not read. Roles are judged by their initial; an empty role has none and is
like any other role that does not fit. Very long texts are single rows of a piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import giving_back, map_batches, written

#: Bytes of text from which a piece of a conversation is closed.
PIECE_BYTES = 1 << 20
#: Space, tab, line feed, vertical tab, form feed and carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Symbols are 4 x initial + fault.
INITIALS, FAULTS = "sua", ("", "truncated", "blank", "duplicate")
#: What keeping, giving another role, deleting and inserting cost, and an undeleted truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

NEVER = 1 << 60
#: Places: at the start, after s, after u, after a. By initial, the places that it leads from and to.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}

Vector = tuple[int, int, int, int]


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32 of `conv_id:turn` modulo 20 (nulls are a space):
    0 drops the row, 1 empties its text, 2 takes out sentence marks, 3 repeats it, 4 makes it user's."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("_n")).drop("_n")


def _actions(symbol: int) -> list[tuple[str, int, int, int]]:
    """(edit, place, next place, cost) of a row with the symbol."""
    initial, fault = (INITIALS + "-")[symbol // 4], FAULTS[symbol % 4]
    found = [("D", k, k, DELETE) for k in range(4)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault else 0
        found += [("K", k, to, more) for k, to in STEPS.get(initial, {}).items()]
        found += [("R", k, to, REROLE + more) for k, (_, to) in NEXT.items()]
    return found


def _inserted(place: int, times: int) -> int:
    for _ in range(times):
        place = NEXT[place][1]
    return place


#: No three insertions in a row are cheaper than one that leads to the same place.
STEPS_OF = [[("I" * n + edit, k, to, n * INSERT + cost) for k in range(4) for n in range(3) for edit, at, to, cost in _actions(s) if at == _inserted(k, n)] for s in range(16)]
END: Vector = tuple(min(n * INSERT for n in range(3) if _inserted(k, n) in ENDS) for k in range(4))  # type: ignore[assignment]


class Transitions:
    """Min-plus transitions of symbols, with their binary powers, and the edits that go with them."""

    def __init__(self):
        self.powers: dict[tuple[int, int], list[list[int]]] = {}
        self.choices: dict[tuple[int, int, Vector], tuple[str, int]] = {}

    def power(self, symbol: int, k: int) -> list[list[int]]:
        """The transition of 2 ** k rows."""
        found = self.powers.get((symbol, k))
        if found is None:
            if k:
                half = self.power(symbol, k - 1)
                found = [[min(half[i][m] + half[m][j] for m in range(4)) for j in range(4)] for i in range(4)]
            else:
                found = [[min([cost for _, at, to, cost in STEPS_OF[symbol] if (at, to) == (i, j)], default=NEVER) for j in range(4)] for i in range(4)]
            self.powers[symbol, k] = found
        return found

    def back(self, symbol: int, n: int, after: Vector) -> Vector:
        """The costs to the end before n rows, from those after them."""
        k = 0
        while n:
            if n & 1:
                step = self.power(symbol, k)
                after = tuple(min(step[i][j] + after[j] for j in range(4)) for i in range(4))
            n, k = n >> 1, k + 1
        return after

    def choice(self, symbol: int, place: int, after: Vector) -> tuple[str, int]:
        """The edits of a row and the place that they lead to: the least of the cheapest."""
        low = min(after)
        key = symbol, place, tuple(x - low for x in after)
        found = self.choices.get(key)
        if found is None:
            _, edits, to = min((cost + after[to], edits, to) for edits, at, to, cost in STEPS_OF[symbol] if at == place)
            found = self.choices[key] = edits, to
        return found

    def unroll(self, symbol: int, n: int, after: Vector, place: int) -> tuple[str, int]:
        """The edits of n equal rows. The costs before each, but for a constant, repeat after a few rows."""
        seen: dict[Vector, int] = {}
        costs: list[Vector] = []
        now = after
        while len(costs) < n:
            low = min(now)
            shape = tuple(x - low for x in now)
            if shape in seen:
                break
            seen[shape] = len(costs)
            costs.append(shape)
            now = self.back(symbol, 1, shape)
        start = seen[shape] if len(costs) < n else 0
        cycle = len(costs) - start
        out = []
        for left in range(n - 1, -1, -1):
            edits, place = self.choice(symbol, place, costs[left if left < len(costs) else start + (left - start) % cycle])
            out.append(edits)
        return "".join(out), place

    def repair(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[int, str]:
        """Cost and edits of a conversation, given as runs."""
        runs = list(zip(symbols.tolist(), lengths.tolist(), strict=True))
        after = [END]
        for symbol, n in reversed(runs):
            after.append(self.back(symbol, n, after[-1]))
        cost, place, audit = after[-1][0], 0, []
        for symbol, n in runs:
            after.pop()
            edits, place = self.unroll(symbol, n, after[-1], place)
            audit.append(edits)
        while place not in ENDS:
            audit.append("I")
            place = NEXT[place][1]
        return cost, "".join(audit)


class Lines:
    """Applies the edits of a conversation to its rows, in order, and takes the digest of what they leave."""

    def __init__(self, audit: str, keep: bool):
        self.audit, self.at, self.place, self.some = audit, 0, 0, False
        self.digest, self.lines = hashlib.sha256(), [] if keep else None

    def _say(self, role: str, text: str) -> None:
        self.digest.update((f"\n{role}:{text}" if self.some else f"{role}:{text}").encode())
        self.some = True
        if self.lines is not None:
            self.lines.append({"role": role, "text": text})

    def _insert(self) -> None:
        while self.audit.startswith("I", self.at):
            initial, self.place = NEXT[self.place]
            self._say(ROLES[initial], "")
            self.at += 1

    def row(self, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self._insert()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.place = STEPS[role[0]][self.place]
                self._say(role, text)
            elif edit == "R":
                initial, self.place = NEXT[self.place]
                self._say(ROLES[initial], text)

    def end(self) -> str:
        self._insert()
        return self.digest.hexdigest()


def _sorted(rows: DataFrame) -> DataFrame:
    """Each different row with its copies and its place in the order (seq), written down."""
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    keys = ["conv_id", "turn", "role", "text"]
    counted = plain.groupBy(*keys).agg(F.count("*").alias("copies"))
    return written(counted.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("seq", F.monotonically_increasing_id()))


def _symbols(rows: DataFrame) -> DataFrame:
    """Runs of symbols of each conversation and chunk of the sorted rows, with the chunk's turns."""
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(said == "", 2).when(~F.substring(said, -1, 1).isin(*".!?"), 1).otherwise(0)
    light = rows.select("conv_id", "seq", "turn", "copies", F.instr(F.lit(INITIALS), F.substring("role", 1, 1)).alias("initial"), F.length("role").alias("named"), fault.alias("fault"), F.unhex(F.sha2(F.concat_ws("\x00", "role", "text"), 256)).alias("said"))
    firsts = light.groupBy("conv_id", "said").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    initial = F.when((F.col("named") > 0) & (F.col("initial") > 0), F.col("initial") - 1).otherwise(3)
    flagged = light.join(firsts, "seq", "left").select("conv_id", "seq", "turn", "copies", initial.alias("initial"), F.when((F.col("fault") == 2) | F.col("first"), F.col("fault")).otherwise(3).alias("fault"), F.shiftright("seq", 33).alias("chunk"))
    id_type = rows.schema["conv_id"].dataType

    def runs(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("seq")
        codes = pc.dictionary_encode(chunk["conv_id"].combine_chunks(), null_encoding="encode").indices.to_numpy()
        column = {c: chunk[c].to_numpy() for c in ("seq", "copies", "initial", "fault")}
        turn, known = chunk["turn"].fill_null(0).to_numpy(), chunk["turn"].is_valid().to_numpy()
        symbol = column["initial"] * 4 + column["fault"]
        again = column["initial"] * 4 + np.where(column["fault"] == 2, 2, 3)
        # A row is its own symbol once, and that of a repeat for each further copy.
        of, symbol, times = np.repeat(codes, 2), np.stack([symbol, again], axis=1).ravel(), np.stack([np.ones_like(column["copies"]), column["copies"] - 1], axis=1).ravel()
        of, symbol, times = of[times > 0], symbol[times > 0], times[times > 0]
        begin = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (symbol[1:] != symbol[:-1])]))
        of, symbol, times = of[begin], symbol[begin].astype(np.uint8), np.add.reduceat(times, begin).astype("<i8")
        out = []
        row_bounds, run_bounds = (np.append(np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), len(x)) for x in (codes, of))
        for i, j, k, m in zip(row_bounds, row_bounds[1:], run_bounds, run_bounds[1:], strict=False):
            turns = turn[i:j][known[i:j]]
            out.append((chunk["conv_id"][int(i)].as_py(), int(column["seq"][i]), symbol[k:m].tobytes(), times[k:m].tobytes(), *((int(turns[0]), int(turns[-1]), 1 + int(np.count_nonzero(np.diff(turns)))) if len(turns) else (None, None, 0))))
        names = ["conv_id", "seq", "symbols", "lengths", "low", "high", "turns"]
        kinds = [to_arrow_type(id_type), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(list(x), type=of) for x, of in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    fields = [T.StructField("conv_id", id_type), T.StructField("seq", T.LongType()), T.StructField("symbols", T.BinaryType()), T.StructField("lengths", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("low", "high", "turns")]]
    return flagged.groupBy("chunk").applyInArrow(giving_back(runs), T.StructType(fields))


def _pieces(rows: DataFrame) -> DataFrame:
    """Consecutive rows of a conversation as pieces of bounded size."""
    id_type = rows.schema["conv_id"].dataType
    kinds = [to_arrow_type(id_type), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        piece, size, held = None, 0, 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(x), type=of) for x, of in zip(zip(*done, strict=True), kinds, strict=True)], names=["conv_id", "seq", "roles", "texts", "copies"])
            done.clear()
            return out

        for part in batches:
            for of, seq, role, text, copies in zip(*(part.column(c).to_pylist() for c in ("conv_id", "seq", "role", "text", "copies")), strict=True):
                if piece is None or of != piece[0] or seq != piece[1] + len(piece[2]) or size >= PIECE_BYTES:
                    if piece:
                        done.append(piece)
                        held += size
                        if held >= PIECE_BYTES:
                            yield batch()
                            held = 0
                    piece, size = (of, seq, [], [], []), 0
                for column, value in zip(piece[2:], (role, text, copies), strict=True):
                    column.append(value)
                size += len(text)
        if piece:
            done.append(piece)
            yield batch()

    fields = [T.StructField("conv_id", id_type), T.StructField("seq", T.LongType()), T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("copies", T.ArrayType(T.LongType()))]
    return map_batches(rows.select("conv_id", "seq", "role", "text", "copies"), run, T.StructType(fields))


def _counts(symbols: np.ndarray, lengths: np.ndarray) -> list[int]:
    """Blank, duplicate and truncated rows, and adjacent rows whose initials are not su, ua or au."""
    faults = np.bincount(symbols % 4, weights=lengths, minlength=4).astype(np.int64)
    initial = symbols // 4
    legal = np.isin(initial[:-1] * 4 + initial[1:], [1, 6, 9])  # su, ua, au
    return [int(faults[2]), int(faults[3]), int(faults[1]), int((lengths - 1).sum() + np.count_nonzero(~legal))]


def repair(rows: DataFrame, keep_lines: bool = False) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): gaps among its turns, blank, duplicate
    and truncated rows, illegal neighbours, the cost and the edits (audit) of the cheapest repair, and
    the digest of its lines. With keep_lines also the lines, as one array per conversation, which is
    as long as the conversation is."""
    ordered = _sorted(rows)
    id_type = ordered.schema["conv_id"].dataType
    runs = _symbols(ordered).withColumn("kind", F.lit(0))
    both = runs.unionByName(_pieces(ordered).withColumn("kind", F.lit(1)), allowMissingColumns=True)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    shape = pa.struct([("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transitions, now = Transitions(), None
        head: list[dict] = []
        lines: Lines | None = None
        found: list[int] = []
        out: list[tuple] = []

        def begin() -> None:
            nonlocal lines, found
            symbols = np.frombuffer(b"".join(x["symbols"] for x in head), dtype=np.uint8).astype(np.int64)
            lengths = np.frombuffer(b"".join(x["lengths"] for x in head), dtype="<i8")
            timed = [x for x in head if x["turns"]]
            distinct = sum(x["turns"] for x in timed) - sum(x["high"] == y["low"] for x, y in zip(timed, timed[1:], strict=False))
            gaps = timed[-1]["high"] - timed[0]["low"] + 1 - distinct if timed else 0
            cost, audit = transitions.repair(symbols, lengths)
            lines, found = Lines(audit, keep_lines), [gaps, *_counts(symbols, lengths), cost]
            head.clear()

        def end() -> None:
            nonlocal lines
            out.append((now[0], *found, lines.audit, lines.end(), *([lines.lines] if keep_lines else [])))
            lines = None

        def batch() -> pa.RecordBatch:
            kinds = [to_arrow_type(id_type), *[pa.int64()] * len(counts), pa.string(), pa.string(), *([pa.list_(shape)] if keep_lines else [])]
            made = pa.RecordBatch.from_arrays([pa.array(list(x), type=of) for x, of in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", *counts, "audit", "repaired_sha256", *(["lines"] if keep_lines else [])])
            out.clear()
            return made

        for part in batches:
            for row in range(part.num_rows):
                x = {c: part.column(c)[row].as_py() for c in part.schema.names}
                if now != (x["conv_id"],):
                    if lines:
                        end()
                    now = (x["conv_id"],)
                if not x["kind"]:
                    head.append(x)
                    continue
                if lines is None:
                    begin()
                for role, text, copies in zip(x["roles"], x["texts"], x["copies"], strict=True):
                    lines.row(role, text, copies)
            if out:
                yield batch()
        if lines:
            end()
            yield batch()

    fields = [T.StructField("conv_id", id_type), *[T.StructField(c, T.LongType()) for c in counts], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    fields += [T.StructField("lines", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])))] if keep_lines else []
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "seq")
    return map_batches(ordered, run, T.StructType(fields))
