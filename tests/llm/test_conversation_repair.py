"""Repairs of conversations beside a search over all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from rasterlake.llm import conversation_repair as R

SF = "/root/testdata/sf0.001"
GRAMMAR = re.compile(r"(s?(ua)+)?")
INITIAL = {"user": "u", "assistant": "a"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def choices(rows):
    """Per row: (cost, letter, line or None)."""
    seen, out, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        row = [(2, "D", None)]
        if fault not in ("blank", "duplicate"):
            more = 5 * (fault == "truncated")
            row += [(more, "K", (role, text))] if role[:1] in ("s", "u", "a") else []
            row += [(1 + more, "R", (r, text)) for r in ("user", "assistant")]
        out.append(row)
    return out, counts


def brute(rows):
    """All edits with at most one insert per gap, and two for an empty result's pair, cheapest then ASCII-least."""
    options, counts = choices(rows)
    gaps = [(0, "", ())] + [(5, "I", ((r, ""),)) for r in INITIAL] + [(10, "II", ((a, ""), (b, ""))) for a in INITIAL for b in INITIAL]
    best = None
    for picks in itertools.product(*options):
        base = sum(c for c, _, _ in picks)
        if best and base > best[0]:
            continue
        for holes in itertools.product(gaps, repeat=len(rows) + 1):
            cost = base + sum(h[0] for h in holes)
            if best and cost > best[0]:
                continue
            lines, audit = list(holes[0][2]), holes[0][1]
            for (_, letter, line), hole in zip(picks, holes[1:]):
                lines += ([line] if line else []) + list(hole[2])
                audit += letter + hole[1]
            if GRAMMAR.fullmatch("".join(r[:1] for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))
    return best, counts


def table(rows):
    """The same by a table over (row, state) that keeps whole results; right for any length."""
    options, counts = choices(rows)
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def inserted(reach):
        for _ in range(4):
            for p, (c, a, lines) in list(reach.items()):
                for r, x in INITIAL.items():
                    q = step.get((p, x))
                    if q is not None and (q not in reach or (c + 5, a + "I") < reach[q][:2]):
                        reach[q] = (c + 5, a + "I", lines + [f"{r}:"])
        return reach

    reach = inserted({0: (0, "", [])})
    for row in options:
        nxt = {}
        for p, (c, a, lines) in reach.items():
            for cost, letter, line in row:
                q = step.get((p, line[0][:1])) if line else p
                new = (c + cost, a + letter, lines + [":".join(line)] if line else lines)
                if q is not None and (q not in nxt or new[:2] < nxt[q][:2]):
                    nxt[q] = new
        reach = inserted(nxt)
    cost, audit, lines = min((reach[p] for p in (0, 3) if p in reach), key=lambda v: v[:2])
    return (cost, audit, "\n".join(lines)), counts


def expected(rows, search):
    (cost, audit, text), counts = search(rows)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def run(rows, block):
    seen, c = set(), R.Repair(block)
    for turn, role, text in rows:
        body = text.rstrip(R.SPACES)
        c.add(turn, role, text, not body, (role, text) in seen, body[-1:] not in (".", "!", "?"))
        seen.add((role, text))
    return c.result()


def some_rows(rng, n):
    return [(i, rng.choice(["user", "assistant", "system", "tool", "", " "]), rng.choice(["a.", "b!", "c", "", f"{i}?", f"{i}."])) for i in range(n)]


def test_table_equals_all_edits():
    rng = random.Random(1)
    for _ in range(60):
        rows = some_rows(rng, rng.randrange(4))
        assert expected(rows, table) == expected(rows, brute)


def test_lightest_derivation_equals_table_in_blocks_of_any_size():
    rng = random.Random(2)
    for _ in range(400):
        rows = some_rows(rng, rng.randrange(14))
        want = expected(rows, table)
        assert all(run(rows, block) == want for block in (1, 2, 5, 256))


def test_goal_ends_the_agenda():
    edits = [R.edits(r, False, False) for r in "suauaua"]
    assert R.lightest({0: (0, "")}, edits, True) == {None: (0, "KKKKKKK", 0)}


ROWS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Hello"), (1, 1, "assistant", "Hello"), (1, None, "system", "Be kind."), (1, 5, "tool", "x."), (1, 9, None, None),
    (None, 0, "user", "a."), (None, 1, "assistant", "b."), (2, None, None, None), (3, 7, "", "c."), (3, 7, "user", "c."), (4, 0, "user", " \t\n"),
    *[(5, i, "user" if i % 3 else "assistant", f"{i}." * (i % 4)) for i in range(600)], (6, 0, "user", "long " * 100_000 + "."),
]


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "conv_id long, turn long, role string, text string, conv string, code int, gone boolean").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in R.repaired(df).collect()}
    convs = {r[0] for r in rows}
    assert set(got) == convs
    for conv in convs:
        assert got[conv] == expected(damaged([r for r in rows if r[0] == conv]), table)


def test_odd_rows(spark):
    check(spark, ROWS)
    check(spark, ROWS[:1] + [(k, None, "user", "x") for k in range(40)])


def test_every_dropped_row_leaves_its_conversation(spark):
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in R.repaired(df).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert R.repaired(df.limit(0)).count() == 0


def test_given_conversations(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    check(spark, [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_repaired_rows_have_the_digest(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    rows = R.damage(R.named(df))
    repairs = R.repair(rows)
    lines = R.repaired_rows(rows, repairs)
    assert lines.filter(~F.col("edit").isin("K", "R", "I")).isEmpty()
    texts = {}
    for r in lines.orderBy("conv", "line").collect():
        texts.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    for r in repairs.collect():
        assert hashlib.sha256("\n".join(texts.get(r.conv, [])).encode()).hexdigest() == r.repaired_sha256
