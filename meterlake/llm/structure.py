"""Repair of conversations to ``system?``, then turns of user and assistant, by the cheapest edits.

A conversation's rows, in order, are levels of a graph whose nodes are what the last row kept was. Keep,
Rerole and Delete lead to the next level, Insert stays on one. The least costs from the start (forward)
and to the end (backward) tell the arcs that lie on some cheapest way: those whose forward cost, own
cost and backward cost add up to the least of all. A walk over these arcs alone holds the set of nodes
that the letters so far can lead to and takes the least letter each time.

No conversation need fit in a task. Rows are sorted over all tasks by ranges of (conversation, turn),
and a task's part of a conversation is a chunk. Chunks in the middle of a range hold whole
conversations and are done at once. The first and last of a range may be cut off: each gives the
least costs between its four states on either side, as a matrix; the matrices of a conversation, a few
numbers for each range, multiply to the costs at all cuts, both ways; then every chunk walks from each
state it may be entered in, and a last pass follows them from chunk to chunk. Only the digest of a
conversation's text must go through one task, in order and row by row, as its hash has no other way.

Order and ties: by turn (null first), then role, then text. Null role and text are a single space; a null
conv_id is a conversation of its own. A row's first fault counts: blank (no character but white space),
duplicate (role and text seen earlier in the conversation), truncated (the last such character is not
one of ``.!?``). Roles count by their first letter; others than s, u and a fit nowhere. A conversation of
which nothing is left has no lines. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import slices, stored

START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: Initials of the states, and the role that must follow a state where a row may get or be any role.
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
REQUIRED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAULTS = ["", "blank", "duplicate", "truncated"]
FAR = 1 << 50
BLANKS = " \t\n\x0b\x0c\r"
Costs = list[int]


def _arcs(code: int) -> list[list[tuple[str, int, int]]]:
    """By state the arcs of a row to the next level: letter, state and cost. A code is an initial's state (0 for others) and 4 times its fault."""
    initial, fault = code % 4, FAULTS[code // 4]
    out: list[list[tuple[str, int, int]]] = []
    for state in STATES:
        found = [("D", state, DELETE)]
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            if initial and (initial == REQUIRED[state] or (state == START and initial == SYSTEM)):
                found.append(("K", initial, more))
            found.append(("R", REQUIRED[state], REROLE + more))
        out.append(found)
    return out


ARCS = [_arcs(code) for code in range(16)]


def with_inserts(costs: Costs) -> Costs:
    """Least costs at a level once rows may be inserted there."""
    out = list(costs)
    for _ in range(2):  # more than two inserts in a row come back to where they began
        for state in STATES:
            out[REQUIRED[state]] = min(out[REQUIRED[state]], out[state] + INSERT)
    return out


def forward(costs: Costs, code: int) -> Costs:
    out = [FAR] * 4
    for state in STATES:
        for _, to, cost in ARCS[code][state]:
            out[to] = min(out[to], costs[state] + cost)
    return out


def backward(costs: Costs, code: int | None) -> Costs:
    """Costs to the end before a row, or before inserts only, from those after it; inserts count where the row begins."""
    out = [min(costs[to] + cost for _, to, cost in ARCS[code][state]) for state in STATES] if code is not None else list(costs)
    for _ in range(2):
        out = [min(out[state], out[REQUIRED[state]] + INSERT) for state in STATES]
    return out


#: Costs to the end of a conversation after its last row: nothing, or an answer, may be last.
AT_END = backward([0, FAR, FAR, 0], None)


def matrix(codes: bytes) -> list[Costs]:
    """Least costs from each state before a chunk to each state after it; inserts after its last row belong to what follows."""
    rows = [[0 if s == t else FAR for t in STATES] for s in STATES]
    for code in codes:
        rows = [forward(with_inserts(r), code) for r in rows]
    return rows


def walks(codes: bytes, entry: Costs, exit_: Costs, total: int, last: bool) -> list[tuple[str, int] | None]:
    """For each state that the chunk may be entered in on a cheapest way, the least letters through it and the state after them."""
    levels, to_end = [], [exit_]
    costs = entry
    for code in codes:
        costs = with_inserts(costs)
        levels.append(costs)
        costs = forward(costs, code)
    levels.append(with_inserts(costs))
    for code in reversed(codes):
        to_end.append(backward(to_end[-1], code))
    to_end.reverse()

    def walk(state: int) -> tuple[str, int]:
        frontier, at, letters = {state}, 0, []
        while at < len(codes) or (last and not any(to_end[at][s] == 0 for s in frontier)):
            tight: dict[str, set[int]] = {}
            for s in frontier:
                if levels[at][s] + INSERT + to_end[at][REQUIRED[s]] == total:
                    tight.setdefault("I", set()).add(REQUIRED[s])
                for letter, to, cost in ARCS[codes[at]][s] if at < len(codes) else ():
                    if levels[at][s] + cost + to_end[at + 1][to] == total:
                        tight.setdefault(letter, set()).add(to)
            letter = min(tight)
            frontier, at = tight[letter], at + (letter != "I")
            letters.append(letter)
        return "".join(letters), min(frontier)

    return [walk(s) if entry[s] < FAR and entry[s] + to_end[0][s] == total else None for s in STATES]


def steps(codes: bytes, state: int, letters: str) -> list[list[tuple[str, str | None]]]:
    """For each row of a chunk its edits in order, with the role that a rerole or an insert gives."""
    out: list[list[tuple[str, str | None]]] = [[] for _ in codes]
    at, held = 0, []
    for letter in letters:
        if letter in "IR":
            state = REQUIRED[state]
        elif letter == "K":
            state = codes[at] % 4
        held.append((letter, ROLES[state] if letter in "IR" else None))
        if letter != "I":
            out[at], held, at = held, [], at + 1
    out[-1] += held
    return out


def _coded(role: Column, text: Column, first: Column) -> Column:
    rest = F.rtrim(text, F.lit(BLANKS))
    fault = F.when(rest == "", 1).when(~first, 2).when(~F.substring(rest, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring(role, 1, 1)
    state = F.coalesce(*[F.when(initial == i, s) for i, s in INITIALS.items()], F.lit(0))
    return (state + 4 * fault).cast("int")


def ordered(rows: DataFrame) -> DataFrame:
    """Stored: conv_id, turn, role and text in order over all tasks; ``place`` rises with the order, by one within a range."""
    filled = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    dealt = filled.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return stored(dealt.withColumn("place", F.monotonically_increasing_id()), "ordered")


def coded(rows: DataFrame) -> DataFrame:
    """place, conv_id and code of each row of ``ordered``; the first row with a role and a text is found by their digest."""
    said = F.md5(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"))
    first = rows.groupBy("conv_id", F.unhex(said).alias("said")).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    narrow = rows.select("place", "conv_id", *[_coded(F.col("role"), F.col("text"), F.lit(f)).alias(n) for f, n in ((True, "as_first"), (False, "as_later"))])
    return narrow.join(first, "place", "left").select("place", "conv_id", F.when(F.col("first"), F.col("as_first")).otherwise(F.col("as_later")).alias("code"))


def _chunked(batches: Iterator) -> Iterator:
    """Chunks from rows (place, conv_id, code) in order: whole conversations with their letters, others with their matrix."""
    import pyarrow as pa

    held: list[tuple] = []
    now, first, codes, at_edge = None, 0, bytearray(), True

    def out(edge: bool) -> None:
        if edge:
            held.append((first, now[1], bytes(codes), [c for r in matrix(codes) for c in r], None))
        else:
            start = [0, FAR, FAR, FAR]
            costs = AT_END
            for code in reversed(codes):
                costs = backward(costs, code)
            held.append((first, now[1], bytes(codes), None, walks(bytes(codes), start, AT_END, costs[START], True)[START][0]))

    def batch_of(like) -> pa.RecordBatch:
        types = (pa.int64(), like, pa.binary(), pa.list_(pa.int64()), pa.string())
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], ["first", "conv_id", "codes", "costs", "letters"])
        held.clear()
        return made

    like = None
    for batch in slices(batches, 5000):
        like = batch.column(1).type
        for place, conv, code in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            here = (place >> 33, conv)
            if here != now:
                if now is not None:
                    out(at_edge or here[0] != now[0])
                at_edge = now is None or here[0] != now[0]
                now, first, codes = here, place, bytearray()
            codes.append(code)
        if len(held) > 1000:
            yield batch_of(like)
    if now is not None:
        out(True)
    if held:
        yield batch_of(like)


def _costs_at_cuts(batches: Iterator) -> Iterator:
    """From the matrices of each conversation's chunks, in order, the costs from its start and to its end at each chunk's ends."""
    import pyarrow as pa

    now, held = None, []

    def out() -> pa.RecordBatch:
        entry, entries = [0, FAR, FAR, FAR], []
        for _, m in held:
            entries.append(entry)
            entry = [min(entry[s] + m[4 * s + t] for s in STATES) for t in STATES]
        exit_, exits = AT_END, []
        for _, m in reversed(held):
            exits.append(exit_)
            exit_ = [min(m[4 * s + t] + exit_[t] for t in STATES) for s in STATES]
        exits.reverse()
        n = len(held)
        columns = [pa.array([h[0] for h in held]), pa.array(entries, pa.list_(pa.int64())), pa.array(exits, pa.list_(pa.int64())), pa.array([exit_[START]] * n), pa.array([k == n - 1 for k in range(n)])]
        return pa.RecordBatch.from_arrays(columns, ["first", "entry", "exit", "total", "last"])

    for batch in batches:
        for conv, first, costs in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            if held and conv != now:
                yield out()
                held = []
            now = conv
            held.append((first, costs))
    if held:
        yield out()


def _walked(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        rows = batch.to_pylist()
        found = [walks(r["codes"], r["entry"], r["exit"], r["total"], r["last"]) for r in rows]
        columns = [batch.column(0), batch.column(1), batch.column(2), pa.array([[w and w[0] for w in f] for f in found], pa.list_(pa.string())), pa.array([[w and w[1] for w in f] for f in found], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["first", "conv_id", "codes", "ways", "after"])


def _followed(batches: Iterator) -> Iterator:
    """Of each chunk's ways the one from the state that the chunk before is left in, over rows in order."""
    import pyarrow as pa

    now, state = None, START
    for batch in batches:
        picked = []
        for first, conv, codes, ways, after in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
            if now is None or conv != now[0]:
                now, state = (conv,), START
            picked.append((first, codes, state, ways[state]))
            state = after[state]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*picked, strict=True) if picked else ((),) * 4, (pa.int64(), pa.binary(), pa.int64(), pa.string()), strict=True)], ["first", "codes", "state", "letters"])


def _stepped(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kind = pa.list_(pa.struct([("edit", pa.string()), ("given", pa.string())]))
    for batch in batches:
        for first, codes, state, letters in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
            found = [[{"edit": e, "given": g} for e, g in row] for row in steps(codes, state, letters)]
            faults = [FAULTS[c // 4] or None for c in codes]
            yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(codes)), pa.int64()), pa.array(faults, pa.string()), pa.array(found, kind)], ["place", "fault", "steps"])


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per edit, in order of conv_id, place and step: the row as it was given, its fault, and the line that stays, if any.

    ``edit`` is K (kept), R (``new_role`` is given), D (deleted) or I (a line without text, beside the row at ``place``).
    """
    rows = ordered(conversations)
    conv = rows.schema["conv_id"].dataType.simpleString()
    by_range = coded(rows).withColumn("range", F.shiftright("place", 33)).repartition("range").sortWithinPartitions("place").select("place", "conv_id", "code")
    chunks = stored(by_range.mapInArrow(_chunked, f"first long, conv_id {conv}, codes binary, costs array<long>, letters string"), "chunks")
    edges = chunks.where("costs is not null")
    together = edges.select("conv_id", "first", "costs").repartition("conv_id").sortWithinPartitions("conv_id", "first")
    cuts = together.mapInArrow(_costs_at_cuts, "first long, entry array<long>, exit array<long>, total long, last boolean")
    met = edges.select("first", "conv_id", "codes").join(cuts, "first")
    walked = met.mapInArrow(_walked, f"first long, conv_id {conv}, codes binary, ways array<string>, after array<long>")
    chosen = walked.repartition("conv_id").sortWithinPartitions("conv_id", "first").mapInArrow(_followed, "first long, codes binary, state long, letters string")
    done = chunks.where("costs is null").select("first", "codes", F.lit(START).cast("long").alias("state"), "letters").unionByName(chosen)
    edits = done.mapInArrow(_stepped, "place long, fault string, steps array<struct<edit:string,given:string>>")
    each = rows.join(edits, "place").select("*", F.posexplode("steps").alias("step", "done"))
    inserted = F.col("done.edit") == "I"
    return each.select(
        "conv_id", "place", "step", F.col("done.edit").alias("edit"), F.when(~inserted, F.col("turn")).alias("turn"), F.when(~inserted, F.col("role")).alias("role"), F.when(~inserted, F.col("fault")).alias("fault"),
        F.coalesce("done.given", F.when(F.col("done.edit") == "K", F.col("role"))).alias("new_role"), F.when(inserted, F.lit("")).otherwise(F.col("text")).alias("text"),
    )


class Report:
    """What is gathered of a conversation while its edits pass by in order."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(FAULTS[1:], 0)
        self.gaps = self.illegal = self.cost = 0
        self.before: str | None = None
        self.least: int | None = None
        self.turn: int | None = None
        self.turns = 0
        self.letters: list[str] = []
        self.hash, self.lines = hashlib.sha256(), 0

    def take(self, edit: str, turn: int | None, role: str | None, fault: str | None, new_role: str | None, text: str) -> None:
        self.letters.append(edit)
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if edit != "I":
            initial = role[:1]
            self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
            self.before = initial
            if turn is not None and turn != self.turn:
                self.least, self.turn, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
            if fault:
                self.counts[fault] += 1
                self.cost += TRUNCATED if fault == "truncated" and edit != "D" else 0
        if edit != "D":
            self.hash.update(f"{chr(10) if self.lines else ''}{new_role}:{text}".encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = self.turn - self.least + 1 - self.turns if self.turn is not None else 0
        return (gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.letters), self.hash.hexdigest())


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _reported(batches: Iterator) -> Iterator:
    import pyarrow as pa

    now, report, like, held = None, Report(), None, []
    names = ["conv_id", *REPORT, "audit", "repaired_sha256"]

    def out() -> pa.RecordBatch:
        types = (like, *[pa.int64()] * len(REPORT), pa.string(), pa.string())
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
        held.clear()
        return made

    for batch in slices(batches, 2000):
        like = batch.column(0).type
        for conv, *edit in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
            if now is None or conv != now[0]:
                if now is not None:
                    held.append((now[0], *report.row()))
                now, report = (conv,), Report()
            report.take(*edit)
        if len(held) > 1000:
            yield out()
    if now is not None:
        held.append((now[0], *report.row()))
        yield out()


def reports(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repaired``: gaps in its turns, its faults, what its edits cost, and the digest of what stays."""
    conv = edits.schema["conv_id"].dataType.simpleString()
    in_order = edits.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step").select("conv_id", "edit", F.col("turn").cast("long"), "role", "fault", "new_role", "text")
    return in_order.mapInArrow(_reported, f"conv_id {conv}, {', '.join(f'{c} long' for c in REPORT)}, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by ``crc32(conv_id:turn) % 20``: 0 drops, 1 empties the text, 2 takes its marks, 3 repeats, 4 makes it the user's. Nulls are one space."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat_ws(":", *said[:2]).cast("binary")) % 20
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said[3], "[.!?]", "")).otherwise(said[3])
    return conversations.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said[2]).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def audit(conversations: DataFrame) -> DataFrame:
    """The reports of damaged and repaired conversations, for every conv_id given."""
    found = reports(repaired(damaged(conversations))).withColumnRenamed("conv_id", "reported")
    ids = conversations.select("conv_id").distinct()
    empty = {c: F.lit(0).cast("long") for c in REPORT} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return ids.join(found, ids["conv_id"].eqNullSafe(found["reported"]), "left").select("conv_id", *[F.coalesce(c, e).alias(c) for c, e in empty.items()])
