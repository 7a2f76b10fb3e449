"""Repair of conversation structure as a shortest path, by the auction algorithm.

A conversation is legal if its role initials read ``(s?(ua)+)?``. Keeping, re-roling, deleting and inserting
turns walk a lattice of places between rows and states of that grammar; every edit is an arc with an integer
cost and the repair is the cheapest path, of several the one whose edit letters are least in ASCII order.

The auction algorithm keeps a price for every node, at most the cost of an arc plus the price behind it,
and a path from the origin along arcs where the two are equal. At the path's end it either extends along
the cheapest arc, or, if none is that cheap, raises the node's price and contracts by one node. When the
path reaches the exit, the prices along all cheapest paths are exact; arcs where price and cost agree are
tight, and the trace takes the tight arc of the least letter. An off-path node may still be priced too
low; the trace lets the auction run from there first, so no dead end is taken. Prices start at what the
rows behind must cost at least, which spares most of their climb.

The climb may grow with the square of a conversation, so long ones are cut into segments of ``SEGMENT``
rows. The auction prices each segment from every state to every state, one row a segment carries the exit
prices back through the conversation, and every segment is traced for each state it may be entered in.
Segments are dealt by ranges of (conversation, turn): a conversation with a third of all rows is many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Tables

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT_ROLE = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}
#: What ending a conversation in a state costs, and the insertions that end it.
END_COST, END_LETTERS = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
LEGAL = {"su", "ua", "au"}
#: Rows of a segment.
SEGMENT = 64
INF = 1 << 60
NO_TURN = -(2**63)


class Lattice:
    """The edits of one segment and their prices.

    codes: a row that may be kept is 2 x its initial's place in ``INITIALS`` (3 for another) + 1 if truncated; a run of n rows
    that must go is -n. exits: the price of leaving in each state, ``INF`` where one must not; letters: what leaving adds.
    """

    def __init__(self, codes: list[int], exits: list[int] | tuple[int, ...], letters: tuple[str, ...] = ("",) * 4):
        self.codes, self.exits, self.letters = codes, exits, letters
        self.end = 4 * len(codes) + 4
        self.known: dict[int, list[tuple[str, int, int]]] = {}
        states = range(4)
        if exits[USER] >= INF and exits[ASSISTANT] >= INF:  # no way back from a user turn
            states = range(2 if exits[SYSTEM] < INF else 1)
        self.states = set(states)
        last_system = max((i for i, c in enumerate(codes) if c in (0, 1)), default=-1) if max(states) == SYSTEM else len(codes)
        self.price = [INF] * (self.end + 1)
        self.price[self.end] = 0
        least = min(exits)
        for i in range(len(codes), -1, -1):
            if i < len(codes):
                c = codes[i]
                least += -c * DELETE if c < 0 else min(DELETE, TRUNCATED) if c % 2 else KEEP
            for s in states:
                if (i < len(codes) and (s != START or i <= last_system)) or (i == len(codes) and exits[s] < INF):
                    self.price[4 * i + s] = least

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """(letter, cost, next node) in the order of letters."""
        if node not in self.known:
            i, s = divmod(node, 4)
            if i == len(self.codes):
                self.known[node] = [(self.letters[s], self.exits[s], self.end)]
            else:
                c, down, new = self.codes[i], node + 4, STEP[s, NEXT_ROLE[s]]
                if c < 0:
                    self.known[node] = [("D" * -c, -c * DELETE, down), ("I", INSERT, 4 * i + new)]
                else:
                    extra = TRUNCATED if c % 2 else 0
                    self.known[node] = [("D", DELETE, down), ("I", INSERT, 4 * i + new)]
                    if c < 6 and (kept := STEP.get((s, INITIALS[c // 2]))) is not None:
                        self.known[node].append(("K", KEEP + extra, 4 * i + 4 + kept))
                    self.known[node].append(("R", REROLE + extra, 4 * i + 4 + new))
        return self.known[node]

    def converge(self, origin: int) -> int:
        """Extend and contract a path until it reaches the exit; the origin's price is then its distance."""
        price, path = self.price, [origin]
        while path[-1] != self.end:
            node = path[-1]
            best, to = min((min(cost + price[then], INF), then) for _, cost, then in self.arcs(node))
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            elif best >= INF:
                break
            else:
                path.append(to)
        return price[origin]

    def trace(self, entry: int) -> tuple[int, int, str]:
        """(cost of the segment, state on leaving, letters) of the least cheapest path from a state."""
        total, node, letters = self.converge(entry), entry, []
        while True:
            for letter, cost, to in self.arcs(node):
                if cost + self.price[to] == self.price[node] and cost + self.converge(to) == self.price[node]:
                    break
            else:
                raise AssertionError("no tight arc")
            letters.append(letter)
            if to == self.end:
                state = node % 4
                return total - self.exits[state] + (END_COST[state] if self.letters[state] else 0), state, "".join(letters)
            node = to


def crossings(codes: list[int]) -> list[int]:
    """Cheapest cost from each state to each state (16 numbers, ``INF`` where there is no way)."""
    out = [INF] * 16
    for to in range(4):
        lattice = Lattice(codes, [0 if s == to else INF for s in range(4)])
        for entry in sorted(lattice.states):
            out[4 * entry + to] = lattice.converge(entry)
    return out


def apply(codes: list[int], roles: list[str], texts: list[str], state: int, letters: str) -> list[dict]:
    """The repaired turns of a segment: edit, role and text of all but the deleted ones."""
    out, row, kept = [], 0, 0
    left = -codes[0] if codes else 0  # deletions left of a run that must go
    for letter in letters:
        if letter != "I" and codes[row] < 0:
            left -= 1
            if left == 0:
                row += 1
                left = -codes[row] if row < len(codes) else 0
            continue
        if letter == "K":
            out.append({"edit": "K", "role": roles[kept], "text": texts[kept]})
            state = STEP[state, roles[kept][:1]]
        elif letter in "RI":
            role = NEXT_ROLE[state]
            out.append({"edit": letter, "role": ROLES[role], "text": texts[kept] if letter == "R" else ""})
            state = STEP[state, role]
        if letter != "I":
            row, kept = row + 1, kept + 1
            left = -codes[row] if row < len(codes) else 0
    return out


def _faults(rows: DataFrame) -> DataFrame:
    """Equal rows together, in their number, with what is wrong with the text and whether an equal row stands before."""
    null = lambda name: F.coalesce(F.col(name), F.lit(" "))
    keys = [
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.col("conv_id").isNull().alias("none"),
        F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN)).alias("t"), null("role").alias("role"), F.md5(null("text")).alias("digest"),
    ]
    names = ["c", "none", "t", "role", "digest"]
    equal = rows.select(*keys, null("text").alias("text")).groupBy(*names).agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))
    # the join's keys hold the turn, so no key is hot, and no text but the row's own moves
    first = rows.select(*keys).groupBy("c", "none", "role", "digest").agg(F.min("t").alias("t")).withColumn("first", F.lit(True))
    end = F.substring(F.expr(r"trim(TRAILING ' \t\n\u000b\f\r' FROM text)"), -1, 1)
    return equal.join(first, names, "left").select(
        *names, "text", "copies", F.coalesce("first", F.lit(False)).alias("first"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"),
    )


_SEGMENTS = pa.schema([
    ("c", pa.string()), ("none", pa.bool_()), ("part", pa.int64()), ("at", pa.int64()), ("whole", pa.bool_()),
    ("codes", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    ("head", pa.string()), ("tail", pa.string()), ("illegal", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()),
    ("crossings", pa.list_(pa.int64())), ("entry", pa.int64()), ("cost", pa.int64()), ("letters", pa.string()),
])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.bool_(): "boolean", pa.int64(): "long", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)


def _segments(most: int):
    """Rows in order -> segments; a conversation that is one segment and surely ends here is repaired at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, conversations, done = TaskContext.get().partitionId(), 0, 0, []
        now: dict | None = None

        def start(c, none, alone):
            return {
                "c": c, "none": none, "codes": [], "roles": [], "texts": [], "head": None, "tail": None, "illegal": 0, "blank": 0,
                "duplicate": 0, "truncated": 0, "first_turn": None, "last_turn": None, "turns": 0, "alone": alone,
            }

        def close(s, ends):
            nonlocal at
            whole = s.pop("alone") and ends
            s |= {"part": part, "at": at, "whole": whole, "crossings": None, "entry": None, "cost": None, "letters": None}
            if whole:
                cost, _, letters = Lattice(s["codes"], END_COST, END_LETTERS).trace(START)
                s |= {"entry": START, "cost": cost, "letters": letters}
            else:
                s["crossings"] = crossings(s["codes"])
            at += 1
            done.append(s)

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or (row["c"], row["none"]) != (now["c"], now["none"]):
                    if now is not None:
                        close(now, True)
                    now = start(row["c"], row["none"], conversations > 0)  # the first may have begun in another task
                    conversations += 1
                elif len(now["codes"]) >= most:
                    now["alone"] = False
                    close(now, False)
                    now = start(row["c"], row["none"], False)
                n, role = row["copies"], row["role"]
                initial = role[:1]
                if now["head"] is None:
                    now["head"] = initial
                else:
                    now["illegal"] += now["tail"] + initial not in LEGAL
                now["tail"] = initial
                now["illegal"] += n - 1  # a row and its copy
                if row["t"] != NO_TURN and row["t"] != now["last_turn"]:
                    now["turns"] += 1
                    now["last_turn"] = row["t"]
                    if now["first_turn"] is None:
                        now["first_turn"] = row["t"]
                if row["blank"]:
                    now["blank"] += n
                else:
                    if row["first"]:
                        place = INITIALS.find(initial) if initial else 3
                        now["codes"].append(2 * (3 if place < 0 else place) + row["cut"])
                        now["truncated"] += row["cut"]
                        now["roles"].append(role)
                        now["texts"].append(row["text"])
                        n -= 1
                    now["duplicate"] += n
                if n:
                    if now["codes"] and now["codes"][-1] < 0:
                        now["codes"][-1] -= n
                    else:
                        now["codes"].append(-n)
            if done:
                yield pa.RecordBatch.from_pylist(done, _SEGMENTS)
                done = []
        if now is not None:
            close(now, False)  # it may go on in another task
            yield pa.RecordBatch.from_pylist(done, _SEGMENTS)

    return run


_OUT = pa.schema([("part", pa.int64()), ("at", pa.int64()), ("last", pa.bool_()), ("exits", pa.list_(pa.int64()))])


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments from last to first -> the price of leaving each in each state."""
    key, price = None, None
    for batch in batches:
        out = []
        for s in batch.to_pylist():
            last = (s["c"], s["none"]) != key
            if last:
                key, price = (s["c"], s["none"]), list(END_COST)
            out.append({"part": s["part"], "at": s["at"], "last": last, "exits": price})
            price = [min(s["crossings"][4 * i + t] + price[t] for t in range(4)) for i in range(4)]
        yield pa.RecordBatch.from_pylist(out, _OUT)


_TRACES = pa.schema([
    ("c", pa.string()), ("none", pa.bool_()), ("part", pa.int64()), ("at", pa.int64()),
    ("costs", pa.list_(pa.int64())), ("leave", pa.list_(pa.int64())), ("ways", pa.list_(pa.string())),
])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for s in batch.to_pylist():
            lattice = Lattice(s["codes"], s["exits"], END_LETTERS if s["last"] else ("",) * 4)
            costs, leave, ways = zip(*(lattice.trace(entry) for entry in range(4)), strict=True)
            out.append({k: s[k] for k in ("c", "none", "part", "at")} | {"costs": costs, "leave": leave, "ways": ways})
        yield pa.RecordBatch.from_pylist(out, _TRACES)


_CHOSEN = pa.schema([("part", pa.int64()), ("at", pa.int64()), ("entry", pa.int64()), ("cost", pa.int64()), ("letters", pa.string())])


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Traced segments from first to last -> the trace that each is entered by."""
    key, state = None, START
    for batch in batches:
        out = []
        for s in batch.to_pylist():
            if (s["c"], s["none"]) != key:
                key, state = (s["c"], s["none"]), START
            out.append({"part": s["part"], "at": s["at"], "entry": state, "cost": s["costs"][state], "letters": s["ways"][state]})
            state = s["leave"][state]
        yield pa.RecordBatch.from_pylist(out, _CHOSEN)


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Segments of all conversations with their cheapest edits.

    rows: conv_id, turn, role, text; others are ignored. Null roles and texts count as one space, a null conv_id is a conversation,
    null turns (and the least long) come first. Rows of one turn stand by role, then by the MD5 of the text; equal rows of a turn are one row
    and its copies. A row's first fault counts: blank, duplicate (role and text stand earlier in the conversation), truncated.
    A role of another initial than s, u, a (none included) can't be kept as it is. An empty table gives an empty result.

    A segment (part, at: its place) has c (conv_id as text) and none (no conv_id), codes, roles and texts of the rows that may stay, the
    faults, entry (grammar state), cost and letters of its edits. ``repaired_turns`` and ``report`` read it.
    """
    tables = Tables(rows.sparkSession, "repair")
    order = ["none", "c", "t", "role", "digest"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _faults(rows).repartitionByRange(n, *order).sortWithinPartitions(*order)
    segments = tables.write("segments", dealt.mapInArrow(_segments(segment), _ddl(_SEGMENTS)))
    open_ = segments.where("not whole")
    place, key = ["part", "at"], ["none", "c"]
    back = open_.select(*key, *place, "crossings").repartition(*key).sortWithinPartitions(*key, F.desc("part"), F.desc("at"))
    priced = open_.select(*key, *place, "codes").join(back.mapInArrow(_backwards, _ddl(_OUT)), place)
    traces = priced.mapInArrow(_traced, _ddl(_TRACES)).repartition(*key).sortWithinPartitions(*key, *place)
    chosen = tables.write("chosen", traces.mapInArrow(_forwards, _ddl(_CHOSEN)))
    mended = open_.drop("entry", "cost", "letters").join(chosen, place).select(*segments.columns)
    return segments.where("whole").unionByName(mended)


def repaired_turns(segments: DataFrame) -> DataFrame:
    """c, none, part, at and turns (array of edit, role, text) of every segment: the repaired conversation in order of (part, at, array)."""
    turn = pa.struct([(n, pa.string()) for n in ("edit", "role", "text")])
    schema = pa.schema([("c", pa.string()), ("none", pa.bool_()), ("part", pa.int64()), ("at", pa.int64()), ("turns", pa.list_(turn))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                {k: s[k] for k in ("c", "none", "part", "at")} | {"turns": apply(s["codes"], s["roles"], s["texts"], s["entry"], s["letters"])}
                for s in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_pylist(out, schema)

    ddl = "c string, none boolean, part long, at long, turns array<struct<edit: string, role: string, text: string>>"
    return segments.select("c", "none", "part", "at", "codes", "roles", "texts", "entry", "letters").mapInArrow(run, ddl)


_REPORT = pa.schema([
    ("c", pa.string()), ("none", pa.bool_()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
    ("audit", pa.string()), ("repaired_sha256", pa.string()),
])


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order -> one row per conversation; texts pass through the digest and are not held."""
    sums = ("blank", "duplicate", "truncated", "illegal", "cost")
    now, digest, lines = None, None, 0

    def close():
        out = {k: now[k] for k in ("c", "none", *sums)}
        gaps = now["last_turn"] - now["first_turn"] + 1 - now["turns"] if now["turns"] else 0
        return out | {"gaps": gaps, "audit": "".join(now["letters"]), "repaired_sha256": digest.hexdigest()}

    for batch in batches:
        out = []
        for s in batch.to_pylist():
            if now is None or (s["c"], s["none"]) != (now["c"], now["none"]):
                if now is not None:
                    out.append(close())
                now, digest, lines = s | {"letters": [s["letters"]]}, hashlib.sha256(), 0
            else:
                now["illegal"] += now["tail"] + s["head"] not in LEGAL
                now["turns"] += s["turns"] - (s["turns"] > 0 and s["first_turn"] == now["last_turn"])
                now["first_turn"] = s["first_turn"] if now["first_turn"] is None else now["first_turn"]
                now["last_turn"] = now["last_turn"] if s["last_turn"] is None else s["last_turn"]
                now["tail"] = s["tail"]
                now["letters"].append(s["letters"])
                for k in sums:
                    now[k] += s[k]
            for turn in apply(s["codes"], s["roles"], s["texts"], s["entry"], s["letters"]):
                digest.update((("\n" if lines else "") + turn["role"] + ":" + turn["text"]).encode("utf-8", "surrogatepass"))
                lines += 1
        if out:
            yield pa.RecordBatch.from_pylist(out, _REPORT)
    if now is not None:
        yield pa.RecordBatch.from_pylist([close()], _REPORT)


def report(segments: DataFrame, kind: str = "long") -> DataFrame:
    """conv_id (as ``kind``), gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation that has rows.

    A digest needs its conversation in order, so the segments of one that has several pass through one task, one at a time.
    """
    whole = segments.where("whole").mapInArrow(_reported, _ddl(_REPORT))
    rest = segments.where("not whole").repartition("none", "c").sortWithinPartitions("none", "c", "part", "at").mapInArrow(_reported, _ddl(_REPORT))
    return whole.unionByName(rest).select(F.when(~F.col("none"), F.col("c").cast(kind)).alias("conv_id"), *_REPORT.names[2:])
