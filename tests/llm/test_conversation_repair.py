"""Repair against a plain search over edits, whole conversations and split ones."""

import hashlib
import random
import re
import zlib

import pytest

from meshcast.llm import conversation_repair as C
from meshcast.llm import queries

WHITE = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, repaired) by a forward search that keeps the least text per state after each row."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best, seen = {"": (0, "", [])}, set()

    def inserts(best):
        best = dict(best)
        for _ in range(3):
            for q, (c, audit, out) in list(best.items()):
                for r, role in (("u", "user"), ("a", "assistant")):
                    if r in step[q]:
                        to, new = step[q][r], (c + 2, audit + "I", [*out, (role, "")])
                        if to not in best or new[:2] < best[to][:2]:
                            best[to] = new
        return best

    for role, text in rows:
        blank, again = not text.strip(WHITE), (role, text) in seen
        cut = int(not blank and text.rstrip(WHITE)[-1] not in ".!?")
        seen.add((role, text))
        after = {}
        for q, (c, audit, out) in inserts(best).items():
            options = [(q, (c + 3, audit + "D", out))]
            if not blank and not again:
                if role[:1] in step[q]:
                    options.append((step[q][role[:1]], (c + cut, audit + "K", [*out, (role, text)])))
                options += [(step[q][r], (c + 2 + cut, audit + "R", [*out, (name, text)])) for r, name in (("u", "user"), ("a", "assistant")) if r in step[q]]
            for to, new in options:
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        best = after
    return min((x for q, x in inserts(best).items() if q in ("", "a")), key=lambda x: x[:2])


def summary(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    plain = [(r, t) for _, r, t in rows]
    cost, audit, repaired = cheapest(plain)
    assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in repaired))
    turns = {t for t, *_ in rows if t is not None}
    blank = [not t.strip(WHITE) for _, t in plain]
    again = [not b and x in plain[:i] for i, (x, b) in enumerate(zip(plain, blank))]
    cut = [not b and not a and t.rstrip(WHITE)[-1] not in ".!?" for (_, t), b, a in zip(plain, blank, again)]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0, sum(blank), sum(again), sum(cut), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()


def drawn(rng, conv, n):
    roles, texts = ["user", "assistant", "system", "tool", "User", " ", "", "ux"], ["Yes.", "no", "", " \t\n", "a ", "ok!  ", "x: y", "same?", "\U0001f600."]
    return [(conv, rng.choice([None, *range(9)]) if rng.random() < 0.3 else i, rng.choice(roles[: rng.choice([2, 3, 8])]), rng.choice(texts) if rng.random() < 0.4 else f"text {i}.") for i in range(n)]


def checked(spark, rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        found = {r.conv_id: tuple(r)[1:] for r in C.repair(df).collect()}
        convs: dict = {}
        for c, *r in rows:
            convs.setdefault(c, []).append(tuple(r))
        assert found == {c: summary(r) for c, r in convs.items()}
        lines: dict = {}
        for r in sorted(C.repaired_turns(df).collect(), key=lambda r: (r.part, r.place)):
            lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        for c in convs:
            assert hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == found[c][-1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_many_conversations(spark):
    rng = random.Random(5)
    rows = [r for c in range(150) for r in drawn(rng, c, rng.randint(1, 12))]
    rows += [(None, t, r, x) for _, t, r, x in drawn(rng, 0, 9)] + [((1 << 60) + 1, 1, "user", "a."), ((1 << 60) + 3, (1 << 60) + 1, "user", "b."), ((1 << 60) + 3, None, "user", "b.")]
    checked(spark, rows, 4)


@pytest.mark.parametrize("seed", range(3))
def test_a_conversation_over_many_ranges(spark, seed):
    rng = random.Random(seed)
    rows = drawn(rng, 7, 400) + [(7, 500 + i, "user", f"long run {i}.") for i in range(150)] + [(7, 900, "assistant", "again.")] * 60 + drawn(rng, None, 40) + drawn(rng, 3, 5)
    checked(spark, rows, 11)


def test_runs_by_powers():
    for sym in range(9):
        h = C.AT_END
        for n in range(40):
            assert C.passed(sym, n, C.AT_END) == h
            h = C.applied(C.power(sym, 0), h)
    assert C.Part([(0, "user", "a.", 10**12, True)]).matrix()[0][0] == 3 * 10**12


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair(empty).count() == 0 and C.repaired_turns(empty).count() == 0
    rows = spark.createDataFrame([(1, 0, None, None, 5, "x"), (1, 1, "user", "hi " * 50_000 + ".", 5, "x")], "conv_id long, turn long, role string, text string, part int, place string")
    got = C.repair(rows).first()
    assert (got.blank, got.audit, got.cost) == (1, "DKI", 5)


def test_query(spark, tmp_path):
    rows = [(c, t, r, x) for c in range(80) for _, t, r, x in drawn(random.Random(c), c, 9)] + [(None, None, None, None), (990, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    left: dict = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        left[c] += [(t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = {c: summary(v) if v else (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c, v in left.items()}
    got = queries.op12_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", *C.COUNTS, "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == want
