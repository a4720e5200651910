"""Repair of damaged conversations by Knuth's lightest derivation.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``. Its rows, sorted by turn, are repaired by edits:
keep (K, 0), give another role (R, 1), delete (D, 2; required for blank and duplicate rows), insert an empty row (I, 5); a
truncated row that stays adds 5. The repair is a deduction system with weights:

    prefix(k, p)  edit(k, r)  |-  prefix(k + 1, step(p, r))        prefix(k, p)  insert(r)  |-  prefix(k, step(p, r))
    prefix(n, p)  |-  goal, where p may end a conversation

``prefix(k, p)`` says that the first k rows are edited and the roles so far lead to state p. A weight is (cost, rows,
audit): costs and rows add, audits join. An agenda pops the lightest item, which is final then, because the functions are
superior: an edit adds a row and an insert adds cost, so no conclusion is lighter than its premisses. They are monotone:
all derivations of an item cover the same rows, and the letters of an audit fix its cost, so of two audits of equal cost
none begins the other and joining more letters on the right keeps their order. The agenda ends when the goal is popped.

Rows are moved once, by conversation, and stream through a task in order: blocks of ``BLOCK`` rows are derived one after
the other, each from the final items of the block before (at most one per state), so memory is bounded for a conversation of any
length but for its audit, which is one cell of the result. The digest of the repaired text is that of one sequence, so the
rows of one conversation stay in one task; nothing but that digest asks for it, and no group is gathered.

Defined cases: a null role, text or part of the hashed key is one space; a null conversation id is a conversation of its
own; rows of equal turn are ordered by role and text; a role without a first letter can only be replaced or deleted; a conversation without
rows has zeros, an empty audit and the digest of the empty string; an empty table gives an empty result; further columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

BLOCK = 256
BLOCK_CHARS = 4_000_000
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: states of ``(s?(ua)+)?``: nothing, after s, after u, after a; a conversation may end in the first and the last
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
STATES, ENDS = (0, 1, 2, 3), (0, 3)
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def following(state: int) -> str:
    """The initial of a row that is inserted or given a role in this state; the grammar allows one only."""
    return "a" if state == 2 else "u"


def edits(initial: str, delete: bool, truncated: bool) -> list[tuple[int, str, str]]:
    """(cost, letter, initial afterwards) of every edit of a row; a deleted row has no initial."""
    out = [(DELETE, "D", "")]
    if not delete:
        more = TRUNCATED if truncated else 0
        out += [(REROLE + more, "R", r) for r in "ua"]
        if initial and initial in "sua":
            out.append((KEEP + more, "K", initial))
    return out


def lightest(entries: dict[int, tuple[int, str]], rows: list[list[tuple[int, str, str]]], last: bool) -> dict:
    """The lightest derivations of a block: {state: (cost, audit, entry state)} of its last prefix items, or of the goal
    alone under the key None. ``entries`` holds (cost, audit) of the prefix items before the block, ``rows`` the edits."""
    n = len(rows)
    agenda: list = []
    for p, (cost, audit) in entries.items():
        heappush(agenda, (cost, 0, audit, ("prefix", 0, p), p))
    for k, row in enumerate(rows):
        for cost, letter, r in row:
            heappush(agenda, (cost, 1, letter, ("edit", k, r, letter), -1))
    for r in "ua":
        heappush(agenda, (INSERT, 0, "I", ("insert", r), -1))
    prefixes: list[dict] = [{} for _ in range(n + 1)]
    final_edits: list[list] = [[] for _ in range(n + 1)]
    inserts: list = []
    done = set()

    def conclude(k, p, left, r, right, kind):
        q = STEP.get((p, r)) if r else p
        if q is not None:
            to = k + 1 if kind == "edit" else k
            item = ("prefix", to, q)
            if item not in done:
                heappush(agenda, (left[0] + right[0], left[1] + right[1], left[2] + right[2], item, left[3]))

    while agenda:
        cost, count, audit, item, entry = heappop(agenda)
        if item in done:
            continue
        done.add(item)
        weight = (cost, count, audit, entry)
        if item[0] == "goal":
            return {None: (cost, audit, entry)}
        if item[0] == "edit":
            k, r = item[1], item[2]
            final_edits[k].append((r, weight))
            for p, left in prefixes[k].items():
                conclude(k, p, left, r, weight, "edit")
        elif item[0] == "insert":
            inserts.append((item[1], weight))
            for k, known in enumerate(prefixes):
                for p, left in known.items():
                    conclude(k, p, left, item[1], weight, "insert")
        else:
            k, p = item[1], item[2]
            prefixes[k][p] = weight
            for r, right in final_edits[k]:
                conclude(k, p, weight, r, right, "edit")
            for r, right in inserts:
                conclude(k, p, weight, r, right, "insert")
            if last and k == n and p in ENDS:
                heappush(agenda, (cost, count, audit, ("goal",), entry))
            elif not last and len(prefixes[n]) == len(STATES):
                break
    return {p: (w[0], w[2], w[3]) for p, w in prefixes[n].items()}


class Repair:
    """One conversation as a stream of (turn, role, text, delete, truncated) rows."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.held: list = []
        self.size = 0
        # by state: cost, audit so far, digest of the lines so far, whether there are lines
        self.open = {0: (0, "", hashlib.sha256(), False)}
        self.counts = dict.fromkeys(COUNTS, 0)
        self.turns = [None, None, 0]
        self.before = None

    def add(self, turn, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if len(self.held) >= self.block or self.size >= BLOCK_CHARS:
            self.derive(last=False)
        c = self.counts
        fault = "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else None
        if fault:
            c[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            c["illegal"] += 1
        self.before = initial
        if turn is not None:
            low, high, distinct = self.turns
            self.turns = [turn if low is None else low, turn, distinct + (turn != high)]
        self.held.append((role, text, edits(initial, blank or duplicate, fault == "truncated")))
        self.size += len(text)

    def derive(self, last: bool) -> None:
        # letters of inserts at an end go to the next block, so that what is left before them are audits of equal rows,
        # of which none begins another: their rank stands for them
        stems = {p: audit.rstrip("I") for p, (_, audit, _, _) in self.open.items()}
        ranks = {stem: chr(48 + i) for i, stem in enumerate(sorted(set(stems.values())))}
        tails = {p: ranks[stem] + "I" * (len(self.open[p][1]) - len(stem)) for p, stem in stems.items()}
        exits = lightest({p: (v[0], tails[p]) for p, v in self.open.items()}, [row[2] for row in self.held], last)
        after = {}
        for q, (cost, audit, entry) in exits.items():
            _, so_far, digest, lines = self.open[entry]
            letters = audit[len(tails[entry]) :]
            digest = digest.copy()
            lines = self.write(letters, entry, digest, lines)
            after[q] = (cost, so_far + letters, digest, lines)
        self.open, self.held, self.size = after, [], 0

    def write(self, letters: str, state: int, digest, lines: bool) -> bool:
        k = 0
        for letter in letters:
            role, text = "", ""
            if letter != "I":
                role, text, _ = self.held[k]
                k += 1
            if letter == "D":
                continue
            initial = role[:1] if letter == "K" else following(state)
            state = STEP[state, initial]
            line = f"{role if letter == 'K' else NAMES[initial]}:{text}"
            digest.update((("\n" if lines else "") + line).encode("utf-8", "surrogatepass"))
            lines = True
        return lines

    def result(self) -> tuple:
        self.derive(last=True)
        cost, audit, digest, _ = self.open[None]
        low, high, distinct = self.turns
        self.counts["gaps"] = 0 if low is None else high - low + 1 - distinct
        self.counts["cost"] = cost
        return *[self.counts[c] for c in COUNTS], audit, digest.hexdigest()


def _repair(block: int):
    def run(batches):
        open_key, current = None, None
        for batch in batches:
            kind, keys, results = batch.schema.field("conv").type, [], []
            for key, gone, turn, role, text, blank, duplicate, truncated in zip(*[c.to_pylist() for c in batch.columns]):
                if current is None or key != open_key:
                    if current is not None:
                        keys.append(open_key)
                        results.append(current.result())
                    open_key, current = key, Repair(block)
                if not gone:
                    current.add(turn, role, text, blank, duplicate, truncated)
            yield _batch(keys, results, kind)
        if current is not None:
            yield _batch([open_key], [current.result()], kind)

    return run


def _batch(keys: list, results: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*results)) or [[]] * (len(COUNTS) + 2)
    kinds = [pa.int64()] * len(COUNTS) + [pa.string()] * 2
    arrays = [pa.array(keys, kind), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]]
    return pa.RecordBatch.from_arrays(arrays, ["conv", *COUNTS, "audit", "repaired_sha256"])


def named(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) of the input, null roles and texts as one space."""
    role, text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col)]
    return conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """``named`` rows as crc32(``conv:turn``) % 20 damages them, with ``gone`` true for a dropped one."""
    key = F.concat(*[F.coalesce(c, F.lit(" ")) for c in (F.col("conv").cast("string"), F.lit(":"), F.col("turn").cast("string"))])
    rows = rows.withColumn("code", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.expr("array_repeat(code = 0, if(code = 3, 2, 1))")
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    damaged = rows.select("conv", F.explode(times).alias("gone"), "turn", role.alias("role"), text.alias("text"))
    return damaged.select("conv", "gone", "turn", "role", F.when(F.col("gone"), "").otherwise(F.col("text")).alias("text"))


def faults(rows: DataFrame) -> DataFrame:
    """Adds blank, duplicate and truncated to damaged rows, which are moved to the tasks of their conversations."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    again = F.row_number().over(Window.partitionBy("conv", "gone", "role", "text").orderBy("turn")) > 1
    return rows.repartition("conv").select(
        "*", (end == "").alias("blank"), again.alias("duplicate"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation of (conv, gone, turn, role, text) rows: counts of faults, cost and audit of the lightest
    repair, digest of the repaired conversation."""
    ordered = faults(rows).sortWithinPartitions("conv", "gone", "turn", "role", "text")
    kind = rows.schema["conv"].dataType.simpleString()
    schema = ", ".join([f"conv {kind}", *[f"{c} long" for c in COUNTS], "audit string, repaired_sha256 string"])
    return ordered.mapInArrow(_repair(block), schema)


def repaired_rows(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired conversations themselves: (conv, line, role, text, edit), lines from 1.

    An audit is split into one piece per row (the inserts before it and its own letter), joined to the rows by their
    place; the role of a row that is inserted or replaced follows from the number of lines before it.
    """
    place = Window.partitionBy("conv").orderBy("turn", "role", "text")
    numbered = rows.filter("not gone").select("*", (F.row_number().over(place) - 1).alias("place"))
    pieces = repairs.select("conv", F.posexplode(F.split("audit", "(?<=[KRD])")).alias("place", "piece")).filter("piece <> ''")
    left, right = pieces.alias("a"), numbered.alias("b")
    on = F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.place") == F.col("b.place"))
    joined = left.join(right, on, "left").select("a.conv", "a.place", "piece", "role", "text")
    letters = joined.select("conv", "place", "role", "text", F.posexplode(F.split("piece", "(?<=.)(?=.)")).alias("at", "edit"))
    kept = letters.filter("edit <> 'D'")
    order = Window.partitionBy("conv").orderBy("place", "at")
    counted = kept.withColumn("line", F.row_number().over(order))
    system = F.first(F.when((F.col("edit") == "K") & F.col("role").startswith("s"), 1).otherwise(0)).over(order)
    turn = F.when((F.col("line") - system) % 2 == 1, "user").otherwise("assistant")
    inserted = F.col("edit") == "I"
    return counted.select(
        "conv", F.col("line").cast("long").alias("line"), F.when(F.col("edit") == "K", F.col("role")).otherwise(turn).alias("role"),
        F.when(inserted, "").otherwise(F.col("text")).alias("text"), "edit",
    )


def repaired(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Damages and repairs every conversation: one row per ``conv_id``."""
    return repair(damage(named(conversations, conv_col, turn_col, role_col, text_col))).withColumnRenamed("conv", "conv_id")
