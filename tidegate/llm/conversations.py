"""Repair of conversation structure by the cheapest edits, in checkpointed dynamic programming.

The lines of a conversation, in order, are kept (0), given the role of user or assistant (1)
or deleted (2); empty lines of user or assistant are inserted anywhere (5); a truncated line
that stays costs 5 more; blank and repeated lines must go.  The result begins with a system
line at most and then alternates user and assistant, ending with the latter: `(s?(ua)+)?`
over the roles' initials.  Of the cheapest edits the ASCII-least initials D, I, K, R win.

The cost of the rest of a conversation depends on its place in that pattern only, four
states, so the backward pass keeps a vector of four costs per line.  No task holds these
vectors for a whole conversation: lines are cut into blocks of about the square root of the
longest conversation's number of lines, and

1. every block is reduced to the cheapest cost from each state before it to each after it;
2. these are folded per conversation from its end, a stream of one row per block; the
   vectors met at the ends of blocks, the checkpoints, are all that is stored;
3. blocks recompute their vectors from the checkpoint behind them and walk forward from each
   state, which gives the state each block is entered in;
4. with that known, each block walks forward once and emits its edits.

Copies of a line are one row with a number.  Lines are ordered by range partitioning, so a
conversation with a third of all rows spreads over many tasks.  Texts move only for the
lines that stay.

Defined cases: a null role or text is one space; null ids form one conversation; turns sort
with nulls first, lines of one turn by role, the text's first 32 characters and its SHA-256;
a role with no initial or an unknown one can be changed, not kept; equal lines are repeats
of the first; very long texts are hashed, and carried once if they stay; a table without
rows gives empty results; other columns are not read, whatever their names.  `gaps` is null
if it does not fit into 64 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import stored

USER, ASSISTANT = "user", "assistant"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEAST_BITS = 8  # of a block's number of lines
HEAD = 32  # characters of a text that order lines of one turn and role
NEVER = 1 << 60  # cost of what cannot be

# States: nothing yet, after system, after user, after assistant.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)  # state after an inserted or rerolled line
_KEPT = {  # state after a kept line, by state and initial
    (_START, "s"): _SYSTEM,
    (_START, "u"): _USER,
    (_SYSTEM, "u"): _USER,
    (_USER, "a"): _ASSISTANT,
    (_ASSISTANT, "u"): _USER,
}
_LEGAL = {"su", "ua", "au"}

Vector = tuple[int, int, int, int]
Symbol = tuple[str, bool, bool]  # initial, must go, truncated


# ------------------------------------------------------------------- one step, remembered


def with_inserts(costs: list[int]) -> Vector:
    """Costs per state when lines may also be inserted first."""
    user = min(costs[_USER], INSERT + costs[_ASSISTANT])
    assistant = min(costs[_ASSISTANT], INSERT + costs[_USER])
    return (
        min(costs[_START], INSERT + user, NEVER),
        min(costs[_SYSTEM], INSERT + user, NEVER),
        min(user, NEVER),
        min(assistant, NEVER),
    )


END = with_inserts([0, NEVER, NEVER, 0])  # costs behind the last line


class Steps:
    """Backward and forward steps over one line, each computed once per vector and line kind.

    Vectors are kept less their least entry, of which there are few; `before` also returns
    what was taken off.
    """

    def __init__(self):
        self._before: dict[tuple[Vector, Symbol], tuple[Vector, int]] = {}
        self._edits: dict[tuple[Vector, Symbol, int], tuple[str, int, int]] = {}

    def before(self, after: Vector, line: Symbol) -> tuple[Vector, int]:
        """Costs in front of a line, given those behind it."""
        found = self._before.get((after, line))
        if found is None:
            full = with_inserts([self._cheapest(after, line, q) for q in range(4)])
            least = min(full)
            found = tuple(c if c >= NEVER else c - least for c in full), least
            self._before[after, line] = found
        return found

    def _choices(self, after: Vector, line: Symbol, state: int) -> list[tuple[str, int, int]]:
        """Edits of the line itself: initial, cost, next state, in ASCII order."""
        initial, gone, truncated = line
        found = [("D", DELETE, state)]
        if not gone:
            extra = TRUNCATED if truncated else 0
            if (state, initial) in _KEPT:
                found.append(("K", extra, _KEPT[state, initial]))
            found.append(("R", extra + REROLE, _NEXT[state]))
        return found

    def _cheapest(self, after: Vector, line: Symbol, state: int) -> int:
        return min(cost + after[to] for _, cost, to in self._choices(after, line, state))

    def edits(self, after: Vector, line: Symbol, state: int) -> tuple[str, int, int]:
        """Edits up to and including the line from this state: initials, cost, next state."""
        found = self._edits.get((after, line, state))
        if found is None:
            here, taken = self.before(after, line)
            audit, cost, at = "", 0, state
            while True:
                left = here[at] + taken
                tight = [c for c in self._choices(after, line, at) if c[1] + after[c[2]] == left]
                insert = INSERT + here[_NEXT[at]] + taken == left
                if insert and not (tight and tight[0][0] < "I"):
                    audit, cost, at = audit + "I", cost + INSERT, _NEXT[at]
                    continue
                initial, own, to = tight[0]
                found = audit + initial, cost + own, to
                break
            self._edits[after, line, state] = found
        return found


def closing(state: int) -> str:
    """Inserts behind the last line."""
    audit = ""
    while state not in (_START, _ASSISTANT):
        audit, state = audit + "I", _NEXT[state]
    return audit


def vectors_before(steps: Steps, lines: list[Symbol], end: Vector) -> list[Vector]:
    """The vector behind each line, less its least entry, from the one behind the last."""
    least = min(end)
    vector = tuple(c if c >= NEVER else c - least for c in end)
    found = [vector] * len(lines)
    for k in range(len(lines) - 1, -1, -1):
        found[k] = vector
        vector = steps.before(vector, lines[k])[0]
    return found


def through(steps: Steps, lines: list[Symbol], copies: list[int]) -> list[int]:
    """Least cost from each state before the lines to each after them, 16 numbers."""
    columns = []
    deletes = DELETE * (sum(copies) - len(copies))
    for to in range(4):
        vector = with_inserts([0 if q == to else NEVER for q in range(4)])
        total = deletes
        for line in reversed(lines):
            vector, taken = steps.before(vector, line)
            total += taken
        columns.append([min(c + total, NEVER) for c in vector])
    return [columns[to][q] for q in range(4) for to in range(4)]


# ------------------------------------------------------------------------------- columns


def _key(column: Column) -> Column:
    """A text for every id, null ones too."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def _turn(column: Column) -> Column:
    """A turn with nulls first, as a value that is never null and can be compared."""
    return F.struct(column.isNotNull().alias("known"), F.coalesce(column, F.lit(0)).alias("at"))


def lines_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The columns that the operator reads: key, turn, role, text, with nulls defined."""
    space = F.lit(" ")
    return conversations.select(
        _key(F.col(conv)).alias("key"),
        _turn(F.col(turn).cast("bigint")).alias("turn"),
        F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"),
    )


def damaged(conversations: DataFrame, kinds: int = 20) -> DataFrame:
    """Rows with faults by the crc32 of `conv_id:turn`: 0 drops a row, 1 empties its text, 2
    removes full stops, exclamation and question marks, 3 repeats it, 4 makes its role user."""
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
        (F.crc32(name.cast("binary")) % kinds).alias("kind"),
    )
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(kind == 4, USER).otherwise(F.col("role")).alias("role"),
        F.explode(F.when(kind == 3, F.array(text, text)).otherwise(F.array(text))).alias("text"),
    )


# -------------------------------------------------------------------------- lines in order


def _ordered(lines: DataFrame) -> DataFrame:
    """Classes of equal lines of a turn in order, numbered by `seq`, with their faults.

    No texts are in it.  `copies` counts equal lines; `first` tells that no equal line of
    the conversation stands earlier.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ends = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    marked = lines.select(
        "key",
        "turn",
        "role",
        F.substring("text", 1, HEAD).alias("head"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
        blank.alias("blank"),
        (~blank & ~ends).alias("truncated"),
    )
    classes = marked.groupBy(*marked.columns).agg(F.count("*").alias("copies"))
    classes = stored(classes, "lines")
    repeated = (
        classes.where("not blank")
        .groupBy("key", "role", "digest")
        .agg(F.min("turn").alias("_least"), F.count("*").alias("_turns"))
        .where("_turns > 1")
        .drop("_turns")
    )
    joined = classes.join(repeated, ["key", "role", "digest"], "left")
    marks = joined.withColumn("first", F.coalesce(F.col("turn") == F.col("_least"), F.lit(True))).drop("_least")
    order = ["key", "turn", "role", "head", "digest"]
    placed = marks.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(placed.withColumn("seq", F.monotonically_increasing_id()), "ordered")


def _block_bits(ordered: DataFrame) -> int:
    """Blocks of about the square root of the longest conversation's number of lines."""
    longest = ordered.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    return max(LEAST_BITS, math.ceil(math.log2(longest) / 2))


def _together(rows: DataFrame, by: str, *order: str) -> DataFrame:
    return rows.repartition(by).sortWithinPartitions(by, *order)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Rows of equal keys that follow each other; the rows of one block at a time."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _symbol(row: dict) -> Symbol:
    return row["initial"], row["gone"], row["truncated"]


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


# --------------------------------------------------------------------------- the four passes


def _transfers(lines: DataFrame) -> DataFrame:
    """Pass 1, per block of a conversation: costs through it, its outer initials, and the
    number of neighbours in it with roles that do not follow each other."""
    schema = pa.schema(
        [("key", pa.string()), ("block", pa.int64()), ("costs", pa.list_(pa.int64())), ("head", pa.string()), ("tail", pa.string()), ("illegal", pa.int64())]
    )

    def reduce(batches):
        steps = Steps()

        def rows():
            for run in _runs(batches, ["block", "key"]):
                symbols = [_symbol(r) for r in run]
                initials = [r["initial"] for r in run]
                illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
                illegal += sum(r["copies"] - 1 for r in run)  # an initial never follows itself
                yield {
                    "key": run[0]["key"],
                    "block": run[0]["block"],
                    "costs": through(steps, symbols, [r["copies"] for r in run]),
                    "head": initials[0],
                    "tail": initials[-1],
                    "illegal": illegal,
                }

        return _batches(rows(), schema)

    types = "key string, block bigint, costs array<bigint>, head string, tail string, illegal bigint"
    return stored(_together(lines, "block", "key", "seq").mapInArrow(reduce, types), "transfers")


def _checkpoints(transfers: DataFrame) -> DataFrame:
    """Pass 2, from the end of each conversation: costs behind every block, and its
    neighbours.  One row per block streams by; a vector is held."""
    schema = pa.schema(
        [("key", pa.string()), ("block", pa.int64()), ("after", pa.list_(pa.int64())), ("next", pa.int64()), ("illegal", pa.int64())]
    )

    def fold(batches):
        def rows():
            key, vector, following, head = None, END, None, None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["key"] != key:
                        key, vector, following, head = r["key"], END, None, None
                    across = head is not None and r["tail"] + head not in _LEGAL
                    yield {
                        "key": key,
                        "block": r["block"],
                        "after": list(vector),
                        "next": following,
                        "illegal": r["illegal"] + across,
                    }
                    costs, behind = r["costs"], vector
                    vector = tuple(
                        min(min(costs[4 * q + to] + behind[to] for to in range(4)), NEVER) for q in range(4)
                    )
                    following, head = r["block"], r["head"]

        return _batches(rows(), schema)

    arranged = transfers.repartition("key").sortWithinPartitions("key", F.desc("block"))
    types = "key string, block bigint, after array<bigint>, next bigint, illegal bigint"
    return stored(arranged.mapInArrow(fold, types), "checkpoints")


def _entries(lines: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Pass 3: the state in which every block but a conversation's first is entered."""
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("next", pa.int64()), ("exits", pa.list_(pa.int64()))])

    def walk(batches):
        steps = Steps()

        def rows():
            for run in _runs(batches, ["block", "key"]):
                if len(run) < 2 or run[0]["seq"] >= 0:
                    continue  # a block that no other follows has no checkpoint here
                symbols = [_symbol(r) for r in run[1:]]
                vectors = vectors_before(steps, symbols, tuple(run[0]["after"]))
                exits = []
                for state in range(4):
                    for vector, symbol in zip(vectors, symbols):
                        state = steps.edits(vector, symbol, state)[2]
                    exits.append(state)
                yield {"key": run[0]["key"], "block": run[0]["block"], "next": run[0]["next"], "exits": exits}

        return _batches(rows(), schema)

    followed = checkpoints.where("next is not null")
    needed = lines.join(followed.select("key", "block"), ["key", "block"], "left_semi")
    marked = _with_checkpoints(needed, followed)
    exits = _together(marked, "block", "key", "seq").mapInArrow(walk, "key string, block bigint, next bigint, exits array<bigint>")

    returned = pa.schema([("key", pa.string()), ("block", pa.int64()), ("entry", pa.int64())])

    def chain(batches):
        def rows():
            key, state = None, _START
            for batch in batches:
                for r in batch.to_pylist():
                    if r["key"] != key:
                        key, state = r["key"], _START
                    state = r["exits"][state]
                    yield {"key": key, "block": r["next"], "entry": state}

        return _batches(rows(), returned)

    entries = exits.repartition("key").sortWithinPartitions("key", "block")
    return stored(entries.mapInArrow(chain, "key string, block bigint, entry bigint"), "entries")


def _with_checkpoints(lines: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Lines, and the checkpoint of each block as a row in front of its lines."""
    marks = checkpoints.withColumn("seq", F.lit(-1).cast("bigint"))
    return lines.unionByName(marks, allowMissingColumns=True)


_EDITS = pa.schema(
    [
        ("key", pa.string()),
        ("block", pa.int64()),
        ("seq", pa.int64()),
        ("part", pa.int64()),
        ("role", pa.string()),
        ("digest", pa.binary()),
        ("given", pa.string()),
        ("edit", pa.string()),
        ("audit", pa.string()),
        ("cost", pa.int64()),
    ]
)


def _edits(lines: DataFrame, checkpoints: DataFrame, entries: DataFrame) -> DataFrame:
    """Pass 4: per block a row with its edits' initials and cost (`audit` is not null), and a
    row per line that stays or is inserted, in order of (seq, part); `given` is its role."""

    def walk(batches):
        steps = Steps()
        role_of = {_USER: USER, _ASSISTANT: ASSISTANT}

        def rows():
            for run in _runs(batches, ["block", "key"]):
                mark, own = run[0], run[1:]
                symbols = [_symbol(r) for r in own]
                vectors = vectors_before(steps, symbols, tuple(mark["after"]))
                state, audit, cost = mark["entry"] or _START, [], 0
                place = {"key": mark["key"], "block": mark["block"]}

                def inserted(seq, part, state):
                    return {**place, "seq": seq, "part": part, "given": role_of[state], "edit": "I"}

                for r, vector, symbol in zip(own, vectors, symbols):
                    edits, spent, to = steps.edits(vector, symbol, state)
                    for part, _ in enumerate(edits[:-1]):
                        state = _NEXT[state]
                        yield inserted(r["seq"], part, state)
                    if edits[-1] != "D":
                        given = r["role"] if edits[-1] == "K" else role_of[to]
                        yield {
                            **place,
                            "seq": r["seq"],
                            "part": len(edits),
                            "role": r["role"],
                            "digest": r["digest"],
                            "given": given,
                            "edit": edits[-1],
                        }
                    audit.append(edits + "D" * (r["copies"] - 1))
                    cost += spent + DELETE * (r["copies"] - 1)
                    state = to
                if mark["next"] is None:
                    last = closing(state)
                    for part in range(len(last)):
                        state = _NEXT[state]
                        yield inserted(own[-1]["seq"], 100 + part, state)
                    audit.append(last)
                    cost += INSERT * len(last)
                yield {**place, "seq": -1, "part": 0, "audit": "".join(audit), "cost": cost}

        return _batches(rows(), _EDITS)

    marked = _with_checkpoints(lines, checkpoints.join(entries, ["key", "block"], "left"))
    types = (
        "key string, block bigint, seq bigint, part bigint, role string, digest binary, given string, "
        "edit string, audit string, cost bigint"
    )
    return stored(_together(marked, "block", "key", "seq").mapInArrow(walk, types), "edits")


# ------------------------------------------------------------------------------- the operator


@dataclass(frozen=True)
class Repair:
    """`summary`: one row per conversation with rows (key, gaps, blank, duplicate, truncated,
    illegal, cost, audit).  `rows`: the repaired conversations (key, seq, part, role, text,
    edit), in order of (seq, part)."""

    summary: DataFrame
    rows: DataFrame


def repaired(conversations: DataFrame) -> Repair:
    """Faults, cheapest edits and repaired rows of every conversation (conv_id, turn, role, text)."""
    texts = lines_of(conversations)
    ordered = _ordered(texts)
    bits = _block_bits(ordered)
    lines = ordered.select(
        "key",
        F.shiftright("seq", bits).alias("block"),
        "seq",
        "role",
        "digest",
        "copies",
        "truncated",
        F.substring("role", 1, 1).alias("initial"),
        (F.col("blank") | ~F.col("first")).alias("gone"),
    )
    checkpoints = _checkpoints(_transfers(lines))
    edits = _edits(lines, checkpoints.drop("illegal"), _entries(lines, checkpoints.drop("illegal")))

    staying = edits.where("edit in ('K', 'R')").select("key", "role", "digest", "seq", "part", "given", "edit")
    one = texts.groupBy("key", "role", F.unhex(F.sha2("text", 256)).alias("digest")).agg(F.first("text").alias("text"))
    kept = one.join(staying, ["key", "role", "digest"]).select("key", "seq", "part", F.col("given").alias("role"), "text", "edit")
    inserted = edits.where("edit = 'I'").select("key", "seq", "part", F.col("given").alias("role"), F.lit("").alias("text"), "edit")

    faults = _faults(ordered)
    pieces = edits.where("audit is not null").groupBy("key").agg(
        F.sum("cost").alias("cost"),
        F.array_sort(F.collect_list(F.struct("block", "audit"))).alias("pieces"),
    )
    audits = pieces.select("key", "cost", F.array_join("pieces.audit", "").alias("audit"))
    illegal = checkpoints.groupBy("key").agg(F.sum("illegal").alias("illegal"))
    summary = faults.join(illegal, "key").join(audits, "key")
    return Repair(summary, kept.unionByName(inserted))


def _faults(ordered: DataFrame) -> DataFrame:
    """Numbers of faults per conversation; a line's first fault counts."""
    n = F.col("copies")
    counted = ordered.groupBy("key").agg(
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(n - F.col("first").cast("int"))).alias("duplicate"),
        F.count_if(F.col("truncated") & F.col("first")).alias("truncated"),
    )
    turns = ordered.where("turn.known").groupBy("key", F.col("turn.at").alias("at")).agg(F.count("*").alias("_n"))
    at = F.col("at").cast("decimal(20,0)")
    spread = turns.groupBy("key").agg((F.max(at) - F.min(at) + 1 - F.count("*")).alias("wide"))
    gaps = spread.select("key", F.expr("try_cast(wide as bigint)").alias("gaps"))
    found = counted.join(gaps.withColumn("_known", F.lit(True)), "key", "left")
    filled = F.when(F.col("_known"), F.col("gaps")).otherwise(F.lit(0))
    return found.withColumn("gaps", filled).drop("_known")


def text_digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of the `role:text` lines of every key, joined by newlines in order.

    One hash reads its conversation in one stream by definition; rows are sorted by Spark and
    pass by, so memory does not grow with the conversation.
    """
    schema = pa.schema([("key", pa.string()), ("sha256", pa.string())])

    def digest(batches):
        def found():
            key, state = None, None
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("key", "role", "text")]
                for at, role, text in zip(*columns):
                    if state is None or at != key:
                        if state is not None:
                            yield {"key": key, "sha256": state.hexdigest()}
                        key, state = at, hashlib.sha256()
                    else:
                        state.update(b"\n")
                    state.update(f"{role}:{text}".encode())
            if state is not None:
                yield {"key": key, "sha256": state.hexdigest()}

        return _batches(found(), schema)

    arranged = rows.select("key", "seq", "part", "role", "text").repartition("key")
    return arranged.sortWithinPartitions("key", "seq", "part").mapInArrow(digest, "key string, sha256 string")


def of_every(conversations: DataFrame, repair: Repair) -> DataFrame:
    """The summary and digest of every id in `conversations`, those without lines too."""
    ids = conversations.groupBy("conv_id").agg(F.count("*").alias("_n")).select("conv_id", _key(F.col("conv_id")).alias("key"))
    found = ids.join(repair.summary, "key", "left").join(text_digests(repair.rows), "key", "left")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    none = F.col("audit").isNull()
    return found.select(
        "conv_id",
        F.when(none, F.lit(0)).otherwise(F.col("gaps")).cast("bigint").alias("gaps"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
