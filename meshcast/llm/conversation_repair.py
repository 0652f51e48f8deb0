"""Repair of damaged conversations at least cost, over runs of equal rows.

A row is one of nine symbols: by its role's initial (s, u, a or another) and whether it is truncated, or one that must go (blank or repeated).
Edits: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or assistant turn 2, and 1 for each truncated row that stays. What stays must be
nothing, or an optional system turn and then pairs of user and assistant. So a grammar of four states decides, and a row is a 4 x 4 matrix of costs in min-plus
algebra. Equal consecutive symbols are one run, passed by the binary powers of its matrix, which are kept. From the costs to go at the ends of runs the edits are
unrolled, the least letter that is still cheapest first, halving runs by the same powers.

Rows are dealt by ranges of (conversation, turn), so a conversation of any size is split. Those that lie within one range are solved there. Of the others, at most two
a range, each range gives the product of its matrices; the products meet on the driver (16 numbers a range), and go back as costs to go and states of entry.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the state after a user or assistant turn where one may stand
ROLE = {USER: "user", ASSISTANT: "assistant"}
MUST_GO, NEVER = 8, 1 << 60
LEGAL = frozenset({"su", "ua", "au"})
#: Least inserts from a state to another.
INSERTS = ((0, NEVER, 1, 2), (NEVER, 0, 1, 2), (NEVER, NEVER, 0, 1), (NEVER, NEVER, 1, 0))
#: Costs to go after the last row.
AT_END = (0, 4, 2, 0)
Vector = tuple[int, ...]


def symbol(initial: str, truncated: bool) -> int:
    """0 to 7: two for each of s, u, a and any other initial."""
    return 2 * ("sua".index(initial) if initial in ("s", "u", "a") else 3) + truncated


def kept_to(sym: int, q: int) -> int | None:
    """The state after a row is kept as it is; None where it may not stand."""
    return {0: SYSTEM if q == START else None, 1: NEXT[q] if NEXT[q] == USER else None, 2: NEXT[q] if NEXT[q] == ASSISTANT else None}.get(sym // 2)


def times(a: tuple[Vector, ...], b: tuple[Vector, ...]) -> tuple[Vector, ...]:
    return tuple(tuple(min(NEVER, *(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


def applied(a: tuple[Vector, ...], h: Vector) -> Vector:
    return tuple(min(NEVER, *(a[i][k] + h[k] for k in range(4))) for i in range(4))


@lru_cache(None)
def power(sym: int, k: int) -> tuple[Vector, ...]:
    """Costs from state to state over 2^k rows of a symbol, inserts before each of them included."""
    if k:
        return times(power(sym, k - 1), power(sym, k - 1))
    own = [[NEVER] * 4 for _ in range(4)]
    for q in range(4):
        own[q][q] = 3
        if sym != MUST_GO:
            for to, cost in ((kept_to(sym, q), sym % 2), (NEXT[q], 2 + sym % 2)):
                if to is not None:
                    own[q][to] = min(own[q][to], cost)
    return times(tuple(tuple(x if x == NEVER else 2 * x for x in row) for row in INSERTS), tuple(map(tuple, own)))


def passed(sym: int, n: int, h: Vector) -> Vector:
    """Costs to go before n rows of a symbol."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            h = applied(power(sym, k), h)
    return h


def row_edits(sym: int, q: int, h: Vector) -> tuple[str, int]:
    """The edits up to one row from state q, with costs to go after it, and the state then."""
    before, letters = applied(power(sym, 0), h), ""
    while True:
        left = before[q]
        kept = kept_to(sym, q)
        if 3 + h[q] == left:
            return letters + "D", q
        if 2 + before[NEXT[q]] == left:
            letters, q = letters + "I", NEXT[q]
        elif kept is not None and sym % 2 + h[kept] == left:
            return letters + "K", kept
        else:
            return letters + "R", NEXT[q]


def run_edits(sym: int, n: int, q: int, h: Vector, out: list[str]) -> int:
    """Append the edits of n rows of a symbol; the state after them."""
    if sym == MUST_GO:  # D is the least letter, and an insert can as well come later
        out.append("D" * n)
        return q
    while n > 1:
        k = (n - 1).bit_length() - 1
        q = run_edits(sym, 1 << k, q, passed(sym, n - (1 << k), h), out)
        n -= 1 << k
    letters, q = row_edits(sym, q, h)
    out.append(letters)
    return q


def end_edits(q: int) -> tuple[str, int]:
    letters = ""
    while AT_END[q]:
        letters, q = letters + "I", NEXT[q]
    return letters, q


WHITE = " \t\n\x0b\x0c\r"


class Part:
    """Consecutive rows of one conversation: (turn, role, text, n equal ones, whether all of them repeat an earlier row)."""

    def __init__(self, rows):
        self.rows, self.runs = rows, []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        turns, before = set(), None
        for turn, role, text, n, repeated in rows:
            if turn is not None:
                turns.add(turn)
            last = text.rstrip(WHITE)[-1:]
            if not last:
                self.blank += n
                self._run(MUST_GO, n)
            else:
                self.duplicate += n - 1 + repeated
                if repeated:
                    self._run(MUST_GO, n)
                else:
                    self.truncated += last not in ".!?"
                    self._run(symbol(role[:1], last not in ".!?"), 1)
                    self._run(MUST_GO, n - 1)
            self.illegal += n - 1 + (before is not None and before + role[:1] not in LEGAL)
            before = role[:1]
        self.first, self.last, self.turns = rows[0][1][:1], before, turns

    def _run(self, sym: int, n: int) -> None:
        if n and self.runs and self.runs[-1][0] == sym:
            self.runs[-1][1] += n
        elif n:
            self.runs.append([sym, n])

    def matrix(self) -> list[Vector]:
        """Costs from each state to each, row by row."""
        columns = []
        for q in range(4):
            h = tuple(0 if i == q else NEVER for i in range(4))
            for sym, n in reversed(self.runs):
                h = passed(sym, n, h)
            columns.append(h)
        return [tuple(c[i] for c in columns) for i in range(4)]

    def edits(self, q: int, h: Vector) -> tuple[str, int, int]:
        """The edits of all rows from state q with costs to go after them, the state then, and the cost to go before them."""
        after = [h]
        for sym, n in reversed(self.runs):
            after.append(passed(sym, n, after[-1]))
        out: list[str] = []
        cost = after[-1][q]
        for (sym, n), h in zip(self.runs, after[-2::-1]):
            q = run_edits(sym, n, q, h, out)
        return "".join(out), q, cost

    def repaired(self, audit: str, q: int):
        """(role, text) of what the edits leave, from state q; edits after the last row included."""
        i = 0
        for _, role, text, n, _ in self.rows:
            while audit[i] == "I":
                q, i = NEXT[q], i + 1
                yield ROLE[q], ""
            if audit[i] == "K":
                q = kept_to(symbol(role[:1], False), q)
                yield role, text
            elif audit[i] == "R":
                q = NEXT[q]
                yield ROLE[q], text
            i += n
        for _ in audit[i:]:
            q = NEXT[q]
            yield ROLE[q], ""


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SUMMARY = "conv_id string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
ROW = "turn string, role string, text string, n long, repeated boolean"


def _gaps(turns) -> int:
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0


def _ranges(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, repeated): equal rows as one, whether an equal text of the role stands at an earlier turn, dealt by ranges and in order.
    Nulls of role and text are one space; rows are ordered by turn, nulls first, then role and text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    equal = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    equal = equal.withColumn("said", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    first = equal.groupBy(F.col("conv_id").alias("conv"), F.col("said").alias("same")).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    both = equal.join(first, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("said") == F.col("same")))
    out = both.select("conv_id", "turn", "role", "text", "n", (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("repeated"))
    # Texts are long, so ranges are cut by their beginnings; rows that agree so far stay in one range.
    dealt = out.repartitionByRange("conv_id", "turn", F.substring("role", 1, 20), F.substring("text", 1, 40))
    # Ids and turns go to Python as text: pandas would make doubles of long numbers beside nulls.
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "role", "text", "n", "repeated")


def _rows_of(pdf: pd.DataFrame) -> list[tuple]:
    return [(None if pd.isna(t) else int(t), r, x, int(n), bool(d)) for t, r, x, n, d in zip(pdf.turn, pdf.role, pdf.text, pdf.n, pdf.repeated)]


SOLVED = f"{SUMMARY}, turns array<struct<role string, text string>>, part int, place long, {ROW}"
ARROW = pa.schema(
    [("conv_id", pa.string()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
    + [("part", pa.int32()), ("place", pa.int64()), ("turn", pa.string()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("repeated", pa.bool_())]
)
_NAMES = [f.split()[0] for f in SUMMARY.split(", ")]
_OPEN = ["conv_id", "part", "place", "turn", "role", "text", "n", "repeated"]


def _solve(with_turns: bool):
    """Summaries of the conversations that begin and end within a range; the rows of its first and last one as they are, with its number and theirs."""

    def whole(conv, rows) -> dict:
        part = Part(rows)
        audit, q, cost = part.edits(START, AT_END)
        audit += end_edits(q)[0]
        turns = list(part.repaired(audit, START))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        return dict(zip(_NAMES, (conv, _gaps(part.turns), part.blank, part.duplicate, part.truncated, part.illegal, cost, audit, digest))) | {"turns": [{"role": r, "text": t} for r, t in turns] if with_turns else None}

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, ARROW)

    def run(batches):
        part, place, seen, conv, rows = TaskContext.get().partitionId(), 0, 0, None, []

        def opened(conv, rows):
            nonlocal place
            out = [dict(zip(_OPEN, (conv, part, place + i, None if r[0] is None else str(r[0]), *r[1:]))) for i, r in enumerate(rows)]
            place += len(rows)
            return table(out)

        for batch in batches:
            done = []
            for c, turn, *row in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "repeated"))):
                row = (None if turn is None else int(turn), *row)
                if not seen or c != conv:
                    if seen == 1:
                        yield opened(conv, rows)
                    elif seen:
                        done.append(whole(conv, rows))
                    seen, conv, rows = seen + 1, c, []
                rows.append(row)
            if seen == 1:  # the first one is passed on as it comes
                yield opened(conv, rows)
                rows = []
            if done:
                yield table(done)
        if seen:
            yield opened(conv, rows)

    return run


def _spanning(spark, rows: DataFrame) -> tuple[DataFrame, dict]:
    """Of conversations given in parts (conv_id, part, place, ...): their repaired turns by part and place, the part's edits as those at place -1; and their counts."""
    facts = "conv_id string, part int, matrix array<long>, first string, last string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long"

    def fact(pdf: pd.DataFrame) -> pd.DataFrame:
        p = Part(_rows_of(pdf.sort_values("place")))
        turns = sorted(p.turns)
        row = (pdf.conv_id[0], pdf.part[0], [x for r in p.matrix() for x in r], p.first, p.last, *((turns[0], turns[-1]) if turns else (None, None)), len(turns), p.blank, p.duplicate, p.truncated, p.illegal)
        out = pd.DataFrame([row], columns=[f.split()[0] for f in facts.replace("array<long>", "x").split(", ")])
        return out.astype({"low": "Int64", "high": "Int64"})

    # At most two parts a range, of some numbers each.
    found = sorted(rows.groupBy("conv_id", "part").applyInPandas(fact, facts).collect(), key=lambda r: r.part)
    convs: dict = {}
    for r in found:
        convs.setdefault(r.conv_id, []).append(r)
    after, summaries = {}, {}
    for conv, parts in convs.items():
        h = AT_END
        for r in reversed(parts):
            after[conv, r.part] = h
            h = applied(tuple(tuple(r.matrix[4 * i : 4 * i + 4]) for i in range(4)), h)
        lows, highs = [r.low for r in parts if r.low is not None], [r.high for r in parts if r.high is not None]
        some = [r for r in parts if r.low is not None]
        distinct = sum(r.turns for r in parts) - sum(a.high == b.low for a, b in zip(some, some[1:]))
        illegal = sum(r.illegal for r in parts) + sum(a.last + b.first not in LEGAL for a, b in zip(parts, parts[1:]))
        summaries[conv] = (max(highs) - min(lows) + 1 - distinct if lows else 0, *(sum(r[c] for r in parts) for c in ("blank", "duplicate", "truncated")), illegal, h[START])

    def told(name: str, values: dict, schema: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(c, p, v, p == convs[c][-1].part) for (c, p), v in values.items()], f"conv string, at int, {name} {schema}, is_last boolean"))

    def joined(table: DataFrame) -> DataFrame:
        return rows.join(table, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("at"))).drop("conv", "at")

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        p = Part(_rows_of(pdf.sort_values("place")))
        h = tuple(map(int, pdf.h[0]))
        return pd.DataFrame([(pdf.conv_id[0], pdf.part[0], [p.edits(q, h)[1] for q in range(4)])], columns=["conv_id", "part", "exits"])

    ends = {(r.conv_id, r.part): r.exits for r in joined(told("h", after, "array<long>")).groupBy("conv_id", "part").applyInPandas(exits, "conv_id string, part int, exits array<int>").collect()}
    entries = {}
    for conv, parts in convs.items():
        q = START
        for r in parts:
            entries[conv, r.part] = [q, *after[conv, r.part]]
            q = ends[conv, r.part][q]

    def unrolled(pdf: pd.DataFrame) -> pd.DataFrame:
        p = Part(_rows_of(pdf.sort_values("place")))
        q, *h = map(int, pdf.h[0])
        audit, end, _ = p.edits(q, tuple(h))
        audit += end_edits(end)[0] if pdf.is_last[0] else ""
        out = [(pdf.conv_id[0], pdf.part[0], -1, audit, None)] + [(pdf.conv_id[0], pdf.part[0], i, r, t) for i, (r, t) in enumerate(p.repaired(audit, q))]
        return pd.DataFrame(out, columns=["conv_id", "part", "place", "role", "text"])

    lines = joined(told("h", entries, "array<long>")).groupBy("conv_id", "part").applyInPandas(unrolled, "conv_id string, part int, place long, role string, text string")
    return staged(lines, "lines"), summaries


def _digests(lines: DataFrame) -> DataFrame:
    """The SHA-256 of each conversation needs its turns in order: those of one pass through one task, sorted on disk and streamed."""

    def run(batches):
        conv, digest, any_ = None, None, False
        for pdf in batches:
            out = []
            for c, r, t in zip(pdf.conv_id, pdf.role, pdf.text):
                if digest is None or c != conv:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest, any_ = c, hashlib.sha256(), False
                digest.update((("\n" if any_ else "") + f"{r}:{t}").encode())
                any_ = True
            if out:
                yield pd.DataFrame(out, columns=["conv", "sha"])
        if digest is not None:
            yield pd.DataFrame([(conv, digest.hexdigest())], columns=["conv", "sha"])

    order = lines.where("place >= 0").repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    return order.select("conv_id", "role", "text").mapInPandas(run, "conv string, sha string")


def _parts(rows: DataFrame, with_turns: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = rows.sparkSession
    solved = staged(_ranges(rows).mapInArrow(_solve(with_turns), SOLVED), "solved")
    lines, summaries = _spanning(spark, solved.where("part is not null").select(*_OPEN))
    counts = spark.createDataFrame([(c, *v) for c, v in summaries.items()], "conv_id string, " + ", ".join(f"{c} long" for c in COUNTS))
    return solved.where("part is null"), lines, counts


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation of `rows` (conv_id, turn, role, text; other
    columns are not read).

    gaps: missing numbers among the turns, null ones aside. blank, duplicate (role and text at an earlier row), truncated (last character not one of .!?): rows
    by their first fault. illegal: neighbours whose roles' initials are not su, ua or au. audit: the initials of the cheapest edits, the least of equally cheap
    ones; edits of nothing are an empty text. repaired_sha256: of the repaired role:text lines. Null roles and texts are one space, null turns come first, rows of
    one turn go by role and text, equal rows are repeats, null conv_ids are one conversation; an empty table gives an empty one. The audit of a conversation is one
    value and its digest one stream; everything else of a large conversation is split.
    """
    solved, lines, counts = _parts(rows, False)
    pieces = lines.where("place = -1").groupBy(F.col("conv_id").alias("conv")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "role"))), lambda x: x["role"]), "").alias("audit"))
    out = counts.join(pieces, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv").join(_digests(lines), F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    out = out.withColumn("repaired_sha256", F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())))
    return solved.select(*_NAMES).union(out.select(*_NAMES)).withColumn("conv_id", F.col("conv_id").cast("long"))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, part, place, role, text): the turns of the repaired conversations, ordered by part and place. Odd inputs as in `repair`."""
    solved, lines, _ = _parts(rows, True)
    whole = solved.select("conv_id", F.lit(0).alias("part"), F.posexplode("turns").alias("place", "t")).select("conv_id", "part", F.col("place").cast("long"), "t.role", "t.text")
    return whole.union(lines.where("place >= 0")).withColumn("conv_id", F.col("conv_id").cast("long"))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of conversations with faults drawn by crc32('conv_id:turn') % 20, nulls read as one space: 0 drops a row, 1 empties its text, 2 removes its
    .!?, 3 repeats it, 4 makes its role user; others stay as they are."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(said("role"))
    times_ = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("kind", kind).where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times_.alias("copy")).drop("copy")
