"""Conversation repair against a plain search over whole conversations."""

import hashlib
import random
import zlib

from cuelog.llm import conversations
from cuelog.llm.queries import QUERIES

SPACES = " \t\n\v\f\r"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        for _ in range((0 if kind == 0 else 1) + (kind == 3)):
            yield conv, turn, role, text


def verdict(rows):
    """Everything about one conversation; cheapest edits by a table of (cost, audit, messages) for every state."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), sha(r[3])))
    turns = {r[1] for r in rows} - {None}
    seen, faults = set(), []
    for _, _, role, text in rows:
        core = text.rstrip(SPACES)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    def inserted(table):
        for _ in range(2):
            for state, (cost, audit, out) in list(table.items()):
                for r in NEXT[state]:
                    if r in NAMES:
                        better(table, r, (cost + 3, audit + "I", (*out, NAMES[r] + ":")))
        return table

    def better(table, state, way):
        if state not in table or way[:2] < table[state][:2]:
            table[state] = way

    table = {"": (0, "", ())}
    for (_, _, role, text), fault in zip(rows, faults):
        # Inserts differ in length, so ways are not merged by state between them and the row's own letter.
        ways = [(s, *w) for s, w in table.items()]
        for _ in range(2):
            ways += [(r, c + 3, a + "I", (*o, NAMES[r] + ":")) for s, c, a, o in ways for r in NEXT[s] if r in NAMES]
        table = {}
        for state, cost, audit, out in ways:
            better(table, state, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault else 0
            if role[:1] in NEXT[state]:
                better(table, role[0], (cost + more, audit + "K", (*out, f"{role}:{text}")))
            for r in NEXT[state]:
                if r in NAMES:
                    better(table, r, (cost + 3 + more, audit + "R", (*out, f"{NAMES[r]}:{text}")))
    table = inserted(table)
    cost, audit, out = min(table[s] for s in ("", "a") if s in table)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(out))


def brute(rows):
    by = {r[0]: [] for r in rows}
    for r in damaged(rows):
        by[r[0]].append(r)
    return sorted(((conv, *verdict(group)) for conv, group in by.items()), key=str)


def _rows(rng, convs, longest):
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system", "tool", "", "ｕser", None, "ua"]
    texts = ["fine.", "fine!", "other?", "cut", " \t", "", None, "ends. \n", "a b", "x.", "y.", "z.", "Ende…"]
    out = []
    for conv in [*range(convs), None]:
        turn = rng.randrange(3)
        for k in range(rng.randrange(1, longest)):
            turn += rng.choice([0, 1, 1, 1, 1, 2, 5])
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[k % 2]
            out.append((conv, turn if rng.random() < 0.95 else None, role, rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    return out


def _run(spark, rows, size):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, pos int").repartition(3)
    got = conversations.repaired(conversations.damage(frame), frame, size)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def test_crossings_without_spark():
    """The least audit of every short sequence of codes, whatever it is cut into."""
    rng = random.Random(3)
    for _ in range(400):
        rows = conversations.Rows("".join(rng.choice(conversations.CODES) for _ in range(rng.randrange(1, 14))))
        end = conversations.cheapest_end(rows, 0)
        audit = "".join(conversations.ways(c)[a][b][1] for c, (a, b) in zip(rows.codes, conversations.crossings(rows, 0, end)))
        ways = {0: {(0, "")}}
        for c in rows.codes:
            after = {}
            for a, found in ways.items():
                for b, way in enumerate(conversations.ways(c)[a]):
                    if way:
                        after.setdefault(b, set()).update((x + way[0], y + way[1]) for x, y in found)
            ways = {s: {w for w in found if w[0] == min(found)[0]} for s, found in after.items()}
        whole = min((x + 3 * len(conversations.TAIL[s]), y + "I" * len(conversations.TAIL[s])) for s, found in ways.items() for x, y in found)
        assert audit + "I" * len(conversations.TAIL[end]) == whole[1]
        parts = conversations.Blocks([conversations.summary(conversations.Rows(rows.codes[i:i + 3])) for i in range(0, len(rows), 3)])
        assert conversations.cheapest_end(parts, 0) == end
        assert list(conversations.crossings(parts, 0, end))[0][1] == list(conversations.crossings(rows, 0, end))[min(3, len(rows)) - 1][1]


def test_odd_rows(spark):
    rows = _rows(random.Random(1), 60, 12) + [(500, 1, "user", "a.")] * 7 + [(501, None, None, None)] * 2
    assert _run(spark, rows, conversations.BLOCK) == brute(rows)


def test_blocks_and_storeys(spark):
    rows = _rows(random.Random(2), 6, 70)
    assert _run(spark, rows, 3) == brute(rows)


def test_empty(spark):
    assert _run(spark, [], conversations.BLOCK) == []


def test_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = QUERIES["op13_conversation_repair"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect()), key=str) == brute([tuple(r) for r in table.collect()])
