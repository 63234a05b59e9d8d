"""Conversation structure repair: Hirschberg's divide and conquer over cost vectors of four states.

The roles of a repaired conversation are an optional system message and pairs of user and assistant.  A
row is kept (K), given another role (R) or deleted (D), and empty messages may be inserted (I).  What a row, a
block of rows or a block of blocks costs from state to state is one small matrix, so long conversations
are cut into blocks whose matrices are chained before the blocks are solved one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SPACE, cut_lineage, schema_of
from .ranks import ranked

#: Rows of a block, and blocks of a block of the next storey.
BLOCK = 4096
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant.  What may come next, and where it leads.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Empty messages that lead from a state to an end.
TAIL = ("", "ua", "a", "")
_FAR = 1 << 60
#: A row's code: its role's initial (other: o), then 0 sound, 1 truncated, 2 has to go.
INITIALS, CODES = "suao", "abcdefghijkl"
_LEGAL = {"su", "ua", "au"}

Vector = tuple[tuple[int, ...], tuple[int, ...]]  # costs by state, and order of the audits that give them
Matrix = tuple[Vector, Vector, Vector, Vector]


@lru_cache(None)
def ways(code: str) -> tuple[tuple[tuple[int, str, str] | None, ...], ...]:
    """[from][to]: (cost, audit, messages) of the cheapest, then ASCII-least edits up to and with the row.

    Messages: ``u`` and ``a`` are inserted ones, ``K`` the row as it is, ``U`` and ``A`` the row as user and as assistant.
    """
    initial, fault = INITIALS[CODES.index(code) // 3], CODES.index(code) % 3
    out = []
    for start in range(4):
        best: list[tuple[int, str, str] | None] = [None] * 4
        state, made = start, ""
        for n in range(3):
            found = [(state, DELETE, "D", "")]
            if fault < 2:
                stays = TRUNCATED if fault else 0
                role = next(r for r in NEXT[state] if r != "s")
                found.append((NEXT[state][role], REROLE + stays, "R", role.upper()))
                if initial in NEXT[state]:
                    found.append((NEXT[state][initial], stays, "K", "K"))
            for to, cost, letter, message in found:
                way = (cost + n * INSERT, "I" * n + letter, made + message)
                if best[to] is None or way < best[to]:
                    best[to] = way
            role = next(r for r in NEXT[state] if r != "s")
            state, made = NEXT[state][role], made + role
        out.append(tuple(best))
    return tuple(out)


@lru_cache(None)
def matrix_of(code: str) -> Matrix:
    """A row's matrix: for every state before it the vector of the states after it."""
    out = []
    for row in ways(code):
        audits = sorted(w[1] for w in row if w)
        out.append((tuple(w[0] if w else _FAR for w in row), tuple(audits.index(w[1]) if w else 4 for w in row)))
    return tuple(out)


def advance(vector: Vector, matrix: Matrix) -> Vector:
    """The vector after one more row or block: cheapest first, then least audit.

    Audits of one start that end in different states differ before either ends (a row's last letter
    is never ``I``), so their order is all that has to be known of them.
    """
    costs, order = vector
    best = []
    for to in range(4):
        best.append(min((min(costs[via] + matrix[via][0][to], _FAR), order[via], matrix[via][1][to]) for via in range(4)))
    places = sorted({b[1:] for b in best})
    return tuple(b[0] for b in best), tuple(places.index(b[1:]) for b in best)


def retreat(costs: tuple[int, ...], matrix: Matrix) -> tuple[int, ...]:
    """Costs to the end from the states before a row or block."""
    return tuple(min(min(matrix[start][0][to] + costs[to], _FAR) for to in range(4)) for start in range(4))


class Rows:
    """A sequence of rows by their codes; steps are remembered, as few different ones occur."""

    def __init__(self, codes: str):
        self.codes = codes

    def __len__(self) -> int:
        return len(self.codes)

    @staticmethod
    @lru_cache(100_000)
    def _advance(vector: Vector, code: str) -> tuple[int, Vector]:
        costs, order = advance(vector, matrix_of(code))
        low = min(costs)
        return low, (tuple(c - low if c < _FAR else _FAR for c in costs), order)

    @staticmethod
    @lru_cache(100_000)
    def _retreat(costs: tuple[int, ...], code: str) -> tuple[int, tuple[int, ...]]:
        costs = retreat(costs, matrix_of(code))
        low = min(costs)
        return low, tuple(c - low if c < _FAR else _FAR for c in costs)

    def forward(self, vector: Vector, low: int, high: int) -> tuple[int, Vector]:
        base = 0
        for code in self.codes[low:high]:
            more, vector = self._advance(vector, code)
            base += more
        return base, vector

    def backward(self, costs: tuple[int, ...], low: int, high: int) -> tuple[int, ...]:
        for code in reversed(self.codes[low:high]):
            costs = self._retreat(costs, code)[1]
        return costs


class Blocks:
    """A sequence of blocks by their matrices."""

    def __init__(self, matrices: Sequence[Matrix]):
        self.matrices = matrices

    def __len__(self) -> int:
        return len(self.matrices)

    def forward(self, vector: Vector, low: int, high: int) -> tuple[int, Vector]:
        for matrix in self.matrices[low:high]:
            vector = advance(vector, matrix)
        return 0, vector

    def backward(self, costs: tuple[int, ...], low: int, high: int) -> tuple[int, ...]:
        for matrix in reversed(self.matrices[low:high]):
            costs = retreat(costs, matrix)
        return costs


def _from(state: int) -> Vector:
    return tuple(0 if k == state else _FAR for k in range(4)), tuple(0 if k == state else 1 for k in range(4))


def _to(state: int) -> tuple[int, ...]:
    return tuple(0 if k == state else _FAR for k in range(4))


def summary(items: Rows | Blocks) -> Matrix:
    """The matrix of a whole sequence."""
    out = []
    for start in range(4):
        base, (costs, order) = items.forward(_from(start), 0, len(items))
        out.append((tuple(min(c + base, _FAR) for c in costs), order))
    return tuple(out)


def cheapest_end(items: Rows | Blocks, start: int) -> int:
    """The state after the last row of the cheapest, then least audit that reaches an end."""
    _, (costs, order) = items.forward(_from(start), 0, len(items))
    return min(range(4), key=lambda k: (costs[k] + INSERT * len(TAIL[k]), order[k]))


def crossings(items: Rows | Blocks, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(state before, state after) every item of the cheapest, then ASCII-least way from ``start`` to ``end``.

    Forward costs of the first half and backward costs of the second meet in the middle; of the states with the least
    sum, the one with the least audit before it is crossed.  Both halves are solved alike: n log n
    steps, and no more memory than the sequence itself.
    """
    def solve(low: int, high: int, start: int, end: int) -> Iterator[tuple[int, int]]:
        if high - low == 1:
            yield start, end
            return
        middle = (low + high) // 2
        costs, order = items.forward(_from(start), low, middle)[1]
        after = items.backward(_to(end), middle, high)
        cross = min(range(4), key=lambda k: (costs[k] + after[k], order[k]))
        yield from solve(low, middle, start, cross)
        yield from solve(middle, high, cross, end)

    if len(items):
        yield from solve(0, len(items), start, end)


def _numbers(matrix: Matrix) -> list[int]:
    return [x for costs, order in matrix for x in (*costs, *order)]


def _matrix(numbers: Sequence[int]) -> Matrix:
    return tuple((tuple(numbers[8 * k:8 * k + 4]), tuple(numbers[8 * k + 4:8 * k + 8])) for k in range(4))


def _map(df: DataFrame, schema: str, work) -> DataFrame:
    """``work(row)`` yields tuples of ``schema`` for every row."""
    made = schema_of(schema)
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for row in batch.to_pylist() for out in work(row)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], names=arrow.names)

    return df.mapInArrow(run, made)


def _solve(row: dict) -> Iterator[tuple]:
    """Audit, messages and cost of one block of rows; the last one of a conversation ends it."""
    codes, last = row["codes"], row["last"]
    items = Rows(codes)
    end = row["end"] if row["end"] is not None else cheapest_end(items, row["start"])
    taken = [ways(c)[a][b] for c, (a, b) in zip(codes, crossings(items, row["start"], end), strict=True)]
    tail = TAIL[end] if last else ""
    initials = "".join(INITIALS[CODES.index(c) // 3] for c in codes)
    illegal = sum(initials[k:k + 2] not in _LEGAL for k in range(len(initials) - 1))
    yield (row["key"], row["block"], "".join(w[1] for w in taken) + "I" * len(tail), [w[2] for w in taken], tail,
           sum(w[0] for w in taken) + INSERT * len(tail), illegal, initials[0], initials[-1])


def _storeys(blocks: DataFrame, most: int, size: int) -> DataFrame:
    """Every block's state before (``start``) and after it (``end``; null: whatever is cheapest, for a conversation of one block)."""
    free = lambda df: df.withColumn("start", F.lit(0)).withColumn("end", F.lit(None).cast("int"))
    if most <= 1:
        return free(blocks)
    numbers = "key string, block long, matrix array<long>"
    made = cut_lineage(_map(blocks.select("key", "block", "codes"), numbers, lambda r: [(r["key"], r["block"], _numbers(summary(Rows(r["codes"]))))]))
    above = []
    while True:
        parts = F.expr("array_sort(collect_list(struct(block, matrix)))").alias("parts")
        above.append(cut_lineage(made.groupBy("key", F.expr(f"block div {size}").alias("_up")).agg(parts).select("key", F.col("_up").alias("block"), "parts")))
        most = -(-most // size)
        if most <= 1:
            break
        made = cut_lineage(_map(above[-1], numbers, lambda r: [(r["key"], r["block"], _numbers(summary(Blocks([_matrix(p["matrix"]) for p in r["parts"]]))))]))

    def part(row: dict) -> Iterator[tuple]:
        items = Blocks([_matrix(p["matrix"]) for p in row["parts"]])
        end = row["end"] if row["end"] is not None else cheapest_end(items, row["start"])
        for p, (a, b) in zip(row["parts"], crossings(items, row["start"], end), strict=True):
            yield row["key"], p["block"], a, b

    goals = None
    for storey in reversed(above):
        asked = free(storey) if goals is None else storey.join(goals, ["key", "block"])
        goals = cut_lineage(_map(asked, "key string, block long, start int, end int", part))
    return blocks.join(goals, ["key", "block"])


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role`` and ``text`` of ``rows``, some dropped, emptied, cut, repeated or given the role user.

    What happens hangs on the checksum of ``conv_id:turn``, modulo 20; nulls are one space in it, and in role and text.
    """
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn"))) % 20
    hit = rows.select("conv_id", "turn", spelled("role").alias("role"), spelled("text").alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_copy")).drop("_copy")


def _key(column: str) -> Column:
    """A text that is never null, other for every value and for null."""
    return F.coalesce(F.concat(F.lit(":"), F.col(column).cast("string")), F.lit(""))


def repair(rows: DataFrame, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Verdicts on conversations, and their messages after repair, of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``).

    Verdicts: ``conv_id``, ``gaps`` in the turns, rows that are ``blank``, ``duplicate`` or ``truncated`` (the first fault counts),
    ``illegal`` neighbours, ``cost`` and ``audit`` of the edits.  Messages: ``conv_id``, ``pos`` and ``step`` (their order), ``role``,
    ``text`` and ``edit``.

    Rows of a conversation are taken by turn (nulls first), then role, then a hash of the text, so equal rows
    are neighbours.  A null role or text is one space; rows without a conversation are one conversation; an empty text is blank; other
    columns play no part; no rows give no verdicts and no messages.  A conversation's rows are dealt over
    blocks of ``size`` rows, its texts by hash; only its verdict is one row, with a letter a row in the audit.
    """
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    base = rows.select("conv_id", _key("conv_id").alias("key"), "turn", _key("turn").alias("turn_key"), spelled("role").alias("role"), spelled("text").alias("text"))
    hashed = base.withColumn("digest", F.sha2("text", 256))
    # Words end at six characters only; trimming those leaves the last character of a row, if it has one.
    end = F.regexp_extract("text", f"([^{SPACE}])[{SPACE}]*\\z", 1)
    light = cut_lineage(hashed.select("conv_id", "key", "turn", "turn_key", "role", "digest", (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("open")))
    placed = ranked(light, ["key"], ["turn", "role", "digest"])
    placed = cut_lineage(placed)
    again = placed.filter("NOT blank").groupBy("key", "role", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("open"), "truncated")
    judged = placed.join(again, ["key", "role", "digest"], "left").withColumn("fault", fault)
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 3).when(initial == "a", 6).otherwise(9) + F.when(F.col("fault") == "truncated", 1).when(F.col("fault").isNull(), 0).otherwise(2)
    coded = judged.withColumn("code", F.substring(F.lit(CODES), number + 1, 1))
    member = F.struct((F.col("pos") % size).alias("at"), "code", "turn_key", "role", "digest")
    count = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    blocks = cut_lineage(coded.groupBy("key", F.expr(f"pos div {size}").alias("block")).agg(
        F.max("n").alias("n"), F.expr("first(conv_id)").alias("conv_id"), *map(count, ("blank", "duplicate", "truncated")),
        F.array_sort(F.collect_list(member)).alias("members")).withColumn("codes", F.array_join("members.code", "")))
    most = blocks.agg(F.max("n")).first()[0] or 0
    asked = _storeys(blocks.select("key", "block", "codes", ((F.col("block") + 1) * size >= F.col("n")).alias("last")), -(-most // size), size)
    solved = cut_lineage(_map(asked, "key string, block long, audit string, made array<string>, tail string, cost long, illegal long, first string, final string", _solve))

    seams = solved.select("key", (F.col("block") + 1).alias("block"), "final").join(solved.select("key", "block", "first"), ["key", "block"])
    seams = seams.filter(~F.concat("final", "first").isin(*sorted(_LEGAL))).groupBy("key").agg(F.count(F.lit(1)).alias("_seams"))
    turns = placed.select("key", "turn").distinct().groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    faults = blocks.groupBy("key").agg(F.first("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    edits = solved.groupBy("key").agg(F.sum("illegal").alias("_inner"), F.sum("cost").alias("cost"), F.array_join(F.array_sort(F.collect_list(F.struct("block", "audit")))["audit"], "").alias("audit"))
    verdicts = faults.join(turns, "key").join(edits, "key").join(seams, "key", "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", (F.col("_inner") + F.coalesce("_seams", F.lit(0))).alias("illegal"), "cost", "audit")

    made = blocks.select("key", "conv_id", "block", "members").join(solved.select("key", "block", "made"), ["key", "block"])
    made = made.select("conv_id", "key", "block", F.explode(F.arrays_zip("members", "made")).alias("x")).filter("x.made <> ''")
    made = made.select("conv_id", "key", (F.col("block") * size + F.col("x.members.at")).alias("pos"), "x.members.turn_key", "x.members.role", "x.members.digest", F.col("x.made").alias("made"))
    texts = hashed.groupBy("key", "turn_key", "role", "digest").agg(F.first("text").alias("text"))
    kept = made.join(texts, ["key", "turn_key", "role", "digest"]).select("conv_id", "pos", "made", "role", "text")
    ends = blocks.select("key", "block", "conv_id", "n").join(solved.filter("tail <> ''").select("key", "block", "tail"), ["key", "block"])
    ends = ends.select("conv_id", F.col("n").alias("pos"), F.col("tail").alias("made"), F.lit("").alias("role"), F.lit("").alias("text"))
    return verdicts, kept.unionByName(ends).select("conv_id", "pos", F.expr("posexplode(split(made, ''))").alias("step", "_made"), "role", "text").select(
        "conv_id", "pos", "step",
        F.when(F.col("_made") == "K", F.col("role")).when(F.lower("_made") == "u", "user").otherwise("assistant").alias("role"),
        F.when(F.col("_made").isin("u", "a"), "").otherwise(F.col("text")).alias("text"),
        F.when(F.col("_made") == "K", "K").when(F.col("_made").isin("u", "a"), "I").otherwise("R").alias("edit"))


def digests(messages: DataFrame) -> DataFrame:
    """``conv_id`` and ``repaired_sha256``: the hash of a conversation's ``role:text`` lines, joined by newlines.

    One hash of one text cannot be shared out: a conversation's messages stream by one task in their order, a batch of them held at a time.
    """
    made = schema_of("key string, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for k, role, text in zip(*[batch.column(batch.schema.get_field_index(c)) for c in ("key", "role", "text")], strict=True):
                if k.as_py() != key:
                    if key is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k.as_py(), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role.as_py()}:{text.as_py()}".encode())
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=made.names)
                out = []
        if key is not None:
            out.append((key, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=made.names)

    keyed = messages.select(_key("conv_id").alias("key"), "pos", "step", "role", "text")
    return keyed.repartition("key").sortWithinPartitions("key", "pos", "step").select("key", "role", "text").mapInArrow(run, made)


def repaired(rows: DataFrame, ids: DataFrame, size: int = BLOCK) -> DataFrame:
    """The verdicts with ``repaired_sha256`` for every distinct ``conv_id`` of ``ids``; zeros and empty texts for those without rows."""
    verdicts, messages = repair(rows, size)
    wanted = ids.select("conv_id").distinct().withColumn("key", _key("conv_id"))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    met = wanted.join(verdicts.withColumn("key", _key("conv_id")).drop("conv_id"), "key", "left").join(digests(messages), "key", "left")
    return met.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
