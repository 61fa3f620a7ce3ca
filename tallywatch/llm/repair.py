"""Conversation repair by iterative-deepening A*.

Each row of a conversation is kept (K, cost 0), given the role user or assistant (R, 3) or deleted (D, 4), and rows
of empty text may be inserted (I, 3), so that the role initials become ``(s?(ua)+)?``. Blank and repeated rows must
be deleted; a truncated row that stays adds 3. The answer is the cheapest list of edits, of equally cheap ones
the least in ASCII order.

The search goes depth first, edits in ASCII order, and gives up a path where its cost and a lower bound of the rest
exceed the limit; the limit grows by one until a path accepts, which is then the answer. A table holds, for every
state (row, what was emitted last), the greatest remaining budget that failed. The lower bound is the cost of the rest
in an easier problem, where a system row alone is a whole conversation.

Deletions that must be made are no choice, so they are runs between the rows that the search sees; D is the
least letter, so they come before insertions at the same place.

Rows are dealt by ranges of (conversation, turn, role, text), so a long conversation is cut over many tasks. A task
reads its rows in order and cuts them into segments of bounded size. A conversation that is one segment is searched
as a whole. Of others, each segment is searched from every state to every state, and one pass over these few costs and edits
of a conversation's segments picks the cheapest chain. The result equals that of one search: insertions are made
before rows only, except at the end, so no list of edits of a segment is the beginning of another of equal cost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import written

#: Rows and bytes of text of a segment; a larger single row is a segment of its own.
SEGMENT_ROWS, SEGMENT_BYTES = 1_024, 4_000_000
#: Repeated messages that may be broadcast, some 50 MB.
BROADCAST_ROWS = 300_000
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
BLANKS = " \t\n\x0b\x0c\r"

#: What was emitted last: nothing, a system row, a user row, an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: State after keeping a row of an initial, and after a row whose role is made to fit.
_KEPT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
_MADE = [USER, USER, ASSISTANT, USER]
_ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What must be inserted after the last row to end well.
_CLOSING = ["", "II", "I", ""]
#: States that the easier problem takes for one: after a system row, and after an assistant row.
_EASIER, _SAME = [0, 1, 2, 1], [0, 1, 2, 3]
_FAR = 1 << 60


def lower_bounds(rows: list[tuple[str, int]], merged: list[int], ends: list[int]) -> list[list[int]]:
    """For each row number (and the end) and state, the cost of the rest if states of equal ``merged`` were one; ``ends`` are the costs at the end."""
    ahead = [min(e for e, x in zip(ends, merged) if x == c) for c in merged]
    out = [ahead]
    for initial, extra in reversed(rows):
        # Deleted, kept or given the role that fits.
        own = [min(DELETE + ahead[p], extra + ahead[kept[initial]] if initial in (kept := _KEPT[p]) else _FAR, REROLE + extra + ahead[_MADE[p]]) for p in range(4)]
        own = [min(e for e, x in zip(own, merged) if x == c) for c in merged]
        ahead = [min(own[p], INSERT + own[_MADE[p]], 2 * INSERT + own[_MADE[_MADE[p]]]) for p in range(4)]
        ahead = [min(e for e, x in zip(ahead, merged) if x == c) for c in merged]
        out.append(ahead)
    return out[::-1]


def _within(rows: list[tuple[str, int]], start: int, end: int | None, bounds: list[list[int]], limit: int, failed: dict[tuple[int, int], int]) -> str | None:
    """The first accepting list of edits of cost ``limit`` or less in ASCII order, by depth-first search."""
    n, path = len(rows), []
    stack = [[0, start, 0, 0]]
    while stack:
        frame = stack[-1]
        i, state, spent, option = frame
        if option == 0:
            if i == n and (state in (NOTHING, ASSISTANT) if end is None else state == end):
                return "".join(path)
            if failed.get((i, state), -1) >= limit - spent:
                option = 4
        step = None
        while option < 4 and step is None:
            if option == 0 and i < n:
                step = ("D", i + 1, state, DELETE)
            elif option == 1 and (i < n or end is None):
                step = ("I", i, _MADE[state], INSERT)
            elif option == 2 and i < n and rows[i][0] in _KEPT[state]:
                step = ("K", i + 1, _KEPT[state][rows[i][0]], rows[i][1])
            elif option == 3 and i < n:
                step = ("R", i + 1, _MADE[state], REROLE + rows[i][1])
            option += 1
            if step is not None and spent + step[3] + bounds[step[1]][step[2]] > limit:
                step = None
        frame[3] = option
        if step is not None:
            path.append(step[0])
            stack.append([step[1], step[2], spent + step[3], 0])
        else:
            failed[i, state] = max(failed.get((i, state), -1), limit - spent)
            stack.pop()
            if path:
                path.pop()
    return None


def cheapest_edits(rows: list[tuple[str, int]], start: int = NOTHING, end: int | None = None) -> tuple[int, str] | None:
    """(cost, edits) of ``rows`` (initial, cost of staying): the cheapest, of equally cheap ones the least.

    Without ``end``, a whole conversation is repaired, and rows may be inserted at its end. With it, the edits lead
    from state ``start`` to ``end`` and insert before rows only; None if none do.
    """
    if end is None:
        bounds = lower_bounds(rows, _EASIER, [0, 2 * INSERT, INSERT, 0])
    else:
        bounds = lower_bounds(rows, _SAME, [0 if p == end else _FAR for p in range(4)])
    limit, failed = bounds[0][start], {}
    while limit < _FAR:
        edits = _within(rows, start, end, bounds, limit, failed)
        if edits is not None:
            return limit, edits
        limit += 1
    return None


def _initial(role: str) -> str:
    return role[:1] or " "


class _Segment:
    """Rows (turn, role, text, copies, fault) of one conversation that follow each other; of ``copies`` equal rows the first has the
    fault, the others are duplicates."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows

    def counts(self) -> dict[str, int | str | None]:
        out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        last = None
        for _, role, _, copies, fault in self.rows:
            first = _initial(role)
            out["illegal"] += copies - 1 + (last is not None and last + first not in ("su", "ua", "au"))
            last = first
            if fault in ("blank", "duplicate"):
                out[fault] += copies
            else:
                out["truncated"] += fault == "truncated"
                out["duplicate"] += copies - 1
        turns = sorted({r[0] for r in self.rows if r[0] is not None})
        return out | {"first_initial": _initial(self.rows[0][1]), "last_initial": last, "turns": len(turns), "least_turn": turns[0] if turns else None, "most_turn": turns[-1] if turns else None}

    def paths(self, whole: bool) -> list[dict | None]:
        """Cheapest edits of the rows that the search sees: of the whole conversation, or from each state to each."""
        seen = [(_initial(role), TRUNCATED if fault == "truncated" else 0) for _, role, _, _, fault in self.rows if fault not in ("blank", "duplicate")]
        found = [cheapest_edits(seen)] if whole else [cheapest_edits(seen, p, q) for p in range(4) for q in range(4)]
        return [None if x is None else {"cost": x[0], "edits": x[1]} for x in found]


_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("fault", pa.string())])
_COUNTS = [("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string()), ("turns", pa.int64()), ("least_turn", pa.int64()), ("most_turn", pa.int64())]
_PATH = pa.struct([("cost", pa.int64()), ("edits", pa.string())])
_HEAD = [("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_())]
_SEGMENT_ARROW = pa.schema([*_HEAD, *_COUNTS, ("paths", pa.list_(_PATH)), ("rows", pa.list_(_ROW))])
_COUNTS_SQL = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, turns bigint, least_turn bigint, most_turn bigint"
_SEGMENT_SQL = f"conv_id bigint, part int, seq int, whole boolean, {_COUNTS_SQL}, paths array<struct<cost: bigint, edits: string>>, rows array<struct<turn: bigint, role: string, text: string, copies: bigint, fault: string>>"
_REPAIRED_SQL = f"conv_id bigint, part int, seq int, whole boolean, {_COUNTS_SQL}, cost bigint, audit string, repaired array<struct<role: string, text: string, edit: string>>"
_REPAIRED_ARROW = pa.schema([*_HEAD, *_COUNTS, ("cost", pa.int64()), ("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])))])


def _batches(rows: Iterator[tuple[int, dict]], schema: pa.Schema, most: int = 2 * SEGMENT_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (bytes, row)."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if size >= most or len(held) >= 2_048:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield from batch.slice(start, rows).to_pylist()


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults that follow from crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1
    empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes it the user's. A null counts as one blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_")).drop("_")


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, fault): equal rows are one, with their number; ``fault`` is that of the first of them."""
    rows = written(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")), "conversation-rows")
    message = F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"))
    seen = rows.groupBy(F.col("conv_id").alias("_conv"), message.alias("_message")).agg(F.min(F.struct("turn")).alias("_first"), F.count("*").alias("_n"))
    seen = written(seen.where("_n > 1").drop("_n"), "repeated-messages")
    if seen.count() <= BROADCAST_ROWS:
        seen = F.broadcast(seen)
    rows = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("_conv")) & (message == F.col("_message")), "left")
    trimmed = F.rtrim("text", F.lit(BLANKS))
    again = F.col("_first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first.turn"))
    fault = F.when(trimmed == "", "blank").when(again, "duplicate").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def segments(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Rows of ``with_faults`` cut into segments, in the order of their ``part`` and ``seq``, each with its cheapest edits."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def made() -> Iterator[tuple[int, dict]]:
            held, size, seq, now, begun = [], 0, 0, None, False

            def flush(ended: bool) -> tuple[int, dict]:
                segment = _Segment(held)
                whole = begun and ended
                head = {"conv_id": now, "part": part, "seq": seq, "whole": whole}
                return size, head | segment.counts() | {"paths": segment.paths(whole), "rows": [dict(zip(("turn", "role", "text", "copies", "fault"), r)) for r in held]}

            for row in _slices(batches):
                n = len(row["text"])
                other = bool(held) and row["conv_id"] != now
                if held and (other or len(held) >= segment_rows or size + n > SEGMENT_BYTES):
                    yield flush(other)
                    # The first conversation of a task may have begun in another one.
                    held, size, seq, begun = [], 0, seq + 1, other
                now = row["conv_id"]
                held.append((row["turn"], row["role"], row["text"], row["copies"], row["fault"]))
                size += n
            if held:
                yield flush(False)

        return _batches(made(), _SEGMENT_ARROW)

    key = ["conv_id", "turn", "role", "text"]
    return rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(cut, _SEGMENT_SQL)


class _Chain:
    """Edits of a conversation's segments so far; those of one depth are compared by cost, then by their letters."""

    __slots__ = ("before", "state", "edits", "cost")

    def __init__(self, before: _Chain | None, state: int, edits: str, cost: int):
        self.before, self.state, self.edits, self.cost = before, state, edits, cost

    def less(self, other: _Chain) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b, left, right = self, other, [], []
        while a is not b:
            left.append(a.edits)
            right.append(b.edits)
            a, b = a.before, b.before
        return "".join(reversed(left)) < "".join(reversed(right))

    def pieces(self) -> list[tuple[int, str]]:
        """(state before, edits) of each segment."""
        out, at = [], self
        while at is not None:
            out.append((at.state, at.edits))
            at = at.before
        return out[::-1]


def _extended(ends: list[_Chain | None], paths: list[dict | None]) -> list[_Chain | None]:
    out: list[_Chain | None] = [None] * 4
    for q in range(4):
        for p in range(4):
            path = paths[p * 4 + q]
            if path is not None and (p == NOTHING if ends is None else ends[p] is not None):
                before = None if ends is None else ends[p]
                chain = _Chain(before, p, path["edits"], path["cost"] + (before.cost if before else 0))
                if out[q] is None or chain.less(out[q]):
                    out[q] = chain
    return out


def chosen_edits(cut: DataFrame) -> DataFrame:
    """(part, seq, state, edits) of the segments that are not a whole conversation: the cheapest chain of their conversation."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("state", pa.int32()), ("edits", pa.string())])

        def made() -> Iterator[tuple[int, dict]]:
            now, names, ends = None, [], None

            def closed() -> Iterator[tuple[int, dict]]:
                last = None
                for p, chain in enumerate(ends or []):
                    if chain is not None:
                        chain = _Chain(chain.before, chain.state, chain.edits + _CLOSING[p], chain.cost + INSERT * len(_CLOSING[p]))
                        last = chain if last is None or chain.less(last) else last
                for (part, seq), (state, edits) in zip(names, last.pieces() if last else []):
                    yield len(edits), {"part": part, "seq": seq, "state": state, "edits": edits}

            for row in _slices(batches):
                if names and row["conv_id"] != now:
                    yield from closed()
                    names, ends = [], None
                now = row["conv_id"]
                names.append((row["part"], row["seq"]))
                ends = _extended(ends, row["paths"])
            yield from closed()

        return _batches(made(), schema)

    split = cut.where("NOT whole").select("conv_id", "part", "seq", "paths")
    return split.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(choose, "part int, seq int, state int, edits string")


def _applied(row: dict) -> dict:
    """A segment's repaired rows, audit and cost from its rows, the ``state`` before it and the ``edits`` of those that the search saw."""
    edits, state, at, audit, cost, out = row.pop("edits"), row.pop("state"), 0, [], 0, []

    def put(edit: str, role: str | None = None, text: str = "") -> None:
        nonlocal state
        state = _MADE[state] if role is None else _KEPT[state][_initial(role)]
        out.append({"role": _ROLES[state] if role is None else role, "text": text, "edit": edit})
        audit.append(edit)

    for r in row.pop("rows"):
        forced = r["copies"]
        if r["fault"] not in ("blank", "duplicate"):
            forced -= 1
            while edits[at] == "I":
                put("I")
                cost += INSERT
                at += 1
            if edits[at] == "D":
                audit.append("D")
                cost += DELETE
            else:
                put(edits[at], r["role"] if edits[at] == "K" else None, r["text"])
                cost += (TRUNCATED if r["fault"] == "truncated" else 0) + (REROLE if edits[at] == "R" else 0)
            at += 1
        audit.append("D" * forced)
        cost += DELETE * forced
    for _ in edits[at:]:
        put("I")
        cost += INSERT
    return row | {"cost": cost, "audit": "".join(audit), "repaired": out}


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The repaired conversations of ``rows`` (conv_id, turn, role, text), a row a segment: conv_id, part and seq (their order),
    whole (the segment is a conversation), counts of its rows before the repair, cost, audit (the edits) and
    repaired (role, text and edit of each row that stays).

    Rows are taken by turn (nulls first), role and text; a null text or role counts as one blank, an empty role never fits. Rows without
    conversation are one conversation. A row is blank without a character other than blanks, a duplicate if its role and text came
    before in the conversation, truncated if it does not end in ``.!?``; the first of these counts. Rows that are equal in all
    are duplicates of each other. An empty table gives no rows; other columns are ignored.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), blank("role"), blank("text"))
    cut = written(segments(with_faults(rows), segment_rows), "conversation-segments")
    chosen = written(chosen_edits(cut), "chosen-edits")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sized = ((sum(len(r["text"]) for r in row["rows"]), row) for row in _slices(batches))
        return _batches(((n, _applied(row)) for n, row in sized), _REPAIRED_ARROW)

    whole = cut.where("whole").select("*", F.lit(NOTHING).alias("state"), F.col("paths")[0]["edits"].alias("edits")).drop("paths")
    split = cut.where("NOT whole").drop("paths").join(chosen, ["part", "seq"])
    # The flag is a literal on both sides, so that a filter by it leaves one side out.
    return whole.mapInArrow(apply, _REPAIRED_SQL).withColumn("whole", F.lit(True)).unionByName(split.mapInArrow(apply, _REPAIRED_SQL).withColumn("whole", F.lit(False)))


def repaired_rows(repaired: DataFrame) -> DataFrame:
    """(conv_id, part, seq, place, role, text, edit) of every row of the repaired conversations; part, seq and place order them."""
    return repaired.select("conv_id", "part", "seq", F.posexplode("repaired").alias("place", "row")).select("conv_id", "part", "seq", "place", "row.*")


def digest(original: DataFrame, repaired: DataFrame) -> DataFrame:
    """The columns of the registered query, a row for every conv_id of ``original``; zeros where no row is left."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    schema = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in names])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[int, dict]]:
            now, total, audit, sha, turns, last, lines = None, None, [], None, [], None, 0

            def closed() -> tuple[int, dict]:
                gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
                row = {"conv_id": now, "gaps": min(gaps, (1 << 63) - 1), **total, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
                return len(row["audit"]), row

            for row in _slices(batches):
                if total is None or row["conv_id"] != now:
                    if total is not None:
                        yield closed()
                    now, total, audit, sha, turns, last, lines = row["conv_id"], dict.fromkeys(names[2:7], 0), [], hashlib.sha256(), [], None, 0
                for c in total:
                    total[c] += row[c]
                if last is not None:
                    total["illegal"] += last + row["first_initial"] not in ("su", "ua", "au")
                last = row["last_initial"]
                if row["turns"]:
                    same = turns and turns[1] == row["least_turn"]
                    turns = [turns[0], row["most_turn"], turns[2] + row["turns"] - same] if turns else [row["least_turn"], row["most_turn"], row["turns"]]
                audit.append(row["audit"])
                for x in row["repaired"]:
                    sha.update(f"{chr(10) if lines else ''}{x['role']}:{x['text']}".encode("utf-8", "surrogatepass"))
                    lines += 1
            if total is not None:
                yield closed()

        return _batches(made(), schema)

    sql = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'bigint'}" for c in names)
    split = repaired.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    found = repaired.where("whole").mapInArrow(fold, sql).unionByName(split.mapInArrow(fold, sql))
    every = original.select(F.col("conv_id").cast("bigint").alias("_conv")).distinct()
    zero: Column = F.lit(0).cast("bigint")
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    joined = every.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(F.col("_conv").alias("conv_id"), *(F.coalesce(c, none.get(c, zero)).alias(c) for c in names[1:]))
