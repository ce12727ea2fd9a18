"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidegate.llm import conversations, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(lines):
    """Least (cost, initials) of edits; lines are (role, text, gone, truncated)."""
    best = {}

    def rest(i, state, inserts=0):
        """state: initials given so far as '', 's', 'u' or 'a' for the last one."""
        if (i, state, inserts) in best:
            return best[i, state, inserts]
        options = []
        other = "a" if state == "u" else "u"
        if i == len(lines):
            if state in ("", "a"):
                options.append((0, ""))
        else:
            role, _, gone, truncated = lines[i]
            options.append((2, "D", rest(i + 1, state)))
            if not gone:
                extra = 5 * truncated
                first = role[:1]
                if first == other or (state == "" and first == "s"):
                    options.append((extra, "K", rest(i + 1, first)))
                options.append((extra + 1, "R", rest(i + 1, other)))
        if inserts < 3:
            options.append((5, "I", rest(i, other, inserts + 1)))
        full = [o if len(o) == 2 else (o[0] + o[2][0], o[1] + o[2][1]) for o in options]
        best[i, state, inserts] = min(full, default=(10**9, ""))
        return best[i, state, inserts]

    return rest(0, "")


def replay(lines, audit):
    """The repaired rows that the initials of the edits mean."""
    out, last, left = [], "", list(lines)
    stays = len(audit.replace("D", ""))
    for k, edit in enumerate(audit):
        line = None if edit == "I" else left.pop(0)
        if edit == "D":
            continue
        if edit == "K":
            out.append((line[0], line[1]))
        else:
            out.append(("assistant" if last == "u" else "user", "" if line is None else line[1]))
        last = out[-1][0][0]
    assert len(out) == stays and not left
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    return out


def plain(original, lines_by_conv):
    found = {}
    for conv in {r[0] for r in original}:
        rows = sorted(
            lines_by_conv.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:32], hashlib.sha256(r[3].encode()).digest())
        )
        seen, lines, counts = set(), [], [0, 0, 0]
        for _, _, role, text in rows:
            bare = text.strip(WHITE)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            seen.add((role, text))
            lines.append((role, text, fault in (0, 1), fault == 2))
        turns = {r[1] for r in rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        cost, audit = cheapest(lines)
        text = "\n".join(f"{r}:{t}" for r, t in replay(lines, audit))
        found[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return found


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def collected(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def random_rows(seed, convs=60, longest=14):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "Three?", "no end", "", " \t", None, "a. ", "b.\n", "ends ,", "x" * 3000 + "."]
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "system", "tool", "", None, "User"]
    rows = []
    for conv in [*range(convs), None]:
        turn = rng.randint(-3, 3)
        for _ in range(rng.randint(0, longest)):
            turn += rng.choice([0, 1, 1, 1, 2])
            own = rng.choice(["s", "u", "a"]) + str(turn) + "." if rng.random() < 0.5 else rng.choice(texts)
            rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(roles), own))
    return rows


@pytest.mark.parametrize("bits", [None, 1, 3])
def test_against_all_edits(spark, monkeypatch, bits):
    if bits is not None:
        monkeypatch.setattr(conversations, "_block_bits", lambda ordered: bits)
    rows = random_rows(7)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    extra = table.withColumns({c: F.lit("own") for c in ("key", "seq", "block", "cost", "audit", "copies", "digest")})
    repair = conversations.repaired(extra)
    got = collected(conversations.of_every(extra, repair))
    expected = plain(rows, grouped(clean))
    assert got == expected
    # The repaired rows themselves are in order and hold what the digest says.
    rows_of = {}
    for r in repair.rows.orderBy("key", "seq", "part").collect():
        rows_of.setdefault(r.key, []).append(f"{r.role}:{r.text}")
    for conv, values in expected.items():
        key = "" if conv is None else f"={conv}"
        assert hashlib.sha256("\n".join(rows_of.get(key, [])).encode()).hexdigest() == values[-1]


def test_long_conversation_in_square_root_blocks(spark):
    rng = random.Random(2)
    rows = [(5, t, rng.choice(["user", "assistant"]), rng.choice([f"t{t}.", f"t{t}", "", "same."])) for t in range(900)]
    rows += [(6, 1, "user", "copy.")] * 700 + [(6, 2, "assistant", "Yes.")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    ordered = conversations._ordered(conversations.lines_of(table))
    assert conversations._block_bits(ordered) == conversations.LEAST_BITS
    got = collected(conversations.of_every(table, conversations.repaired(table)))
    assert got[6][5:7] == (2 * 699, "K" + "D" * 699 + "K")
    blank, duplicate = got[5][1:3]
    assert blank == sum(r[3] == "" for r in rows) and duplicate == len([r for r in rows if r[3] == "same."]) - 2
    assert sum(got[5][6].count(c) for c in "DKR") == 900
    expected = forward_costs([(r[2], r[3]) for r in rows[:900]])
    assert got[5][5] == expected


def forward_costs(rows):
    """Least cost by a forward pass, for conversations too long for the search."""
    seen, costs = set(), {"": 0}
    for role, text in [*rows, (None, None)]:
        for _ in range(3):
            for state, cost in list(costs.items()):
                to = "a" if state == "u" else "u"
                costs[to] = min(costs.get(to, 10**9), cost + 5)
        if role is None:
            return min(costs.get("", 10**9), costs.get("a", 10**9))
        gone = not text.strip(WHITE) or (role, text) in seen
        extra = 0 if text.strip(WHITE)[-1:] in (".", "!", "?") and text else 5
        seen.add((role, text))
        after = {state: cost + 2 for state, cost in costs.items()}
        if not gone:
            for state, cost in costs.items():
                to = "a" if state == "u" else "u"
                after[to] = min(after.get(to, 10**9), cost + extra + (role[0] != to))
        costs = after


def test_damage_and_query(spark, tmp_path):
    rows = random_rows(11, convs=40, longest=9)
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    got = collected(queries.QUERIES["op12_repair"](spark, folder))
    assert got == plain(rows, grouped(damage(rows)))


def test_query_on_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(queries.QUERIES["op12_repair"](spark, folder)) == plain(rows, grouped(damage(rows)))


def test_empty(spark, tmp_path):
    table = spark.createDataFrame([], SCHEMA)
    assert conversations.of_every(table, conversations.repaired(table)).collect() == []
