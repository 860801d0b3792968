"""Repair of damaged conversations by weighted interval parsing of their rows.

The grammar in Chomsky normal form derives rows whose role initials read ``(s?(ua)+)?``. Its nonterminals are ``N[p, q]``: a
span of rows, edited, leads from state p to state q of that language. A binary rule ``N[p, r] -> N[p, q] N[q, r]`` joins two
spans, terminal rules edit one row (keep, rerole, delete), and the insertion closure puts inserted rows on either side
of each span. A cell holds, for each nonterminal, the minimum of (cost, audit), where the audit spells the edits. Cells are
combined bottom-up by span length. As every nonterminal carries its outer states, any division of a span gives the same
cell, so spans of doubling length suffice and the parse is linear in the rows, not cubic.

Audits of one span and cost are never prefixes of each other (a longer one holds more insertions, which cost), so the
smallest audit of a joined span is made of smallest audits of its parts.

Rows are dealt by ranges of (conversation, turn), so the rows of one huge conversation spread over tasks. A task parses the part it
holds; the cells of the few conversations that lie in more than one part are joined afterwards, and their repaired text is hashed
as it streams by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import stage

#: States: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row. 0 and 3 may end.
START, ENDS, STATES = 0, (0, 3), range(4)
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
SOLID = r"[^\x20\x09-\x0D]"

Cell = dict[tuple[int, int], tuple[int, str]]


def join_cells(left: Cell, right: Cell) -> Cell:
    """All binary rules over two neighbouring spans."""
    out: Cell = {}
    for (p, q), (cost, audit) in left.items():
        for r in STATES:
            other = right.get((q, r))
            if other is not None:
                found = (cost + other[0], audit + other[1])
                if (p, r) not in out or found < out[p, r]:
                    out[p, r] = found
    return out


def _closure() -> Cell:
    """Insertions alone: from each state to each that inserted user and assistant rows reach."""
    out: Cell = {(p, p): (0, "") for p in STATES}
    for _ in STATES:
        one: Cell = {(p, q): (INSERT, "I") for step in ("u", "a") for p, q in STEPS[step].items()}
        for key, found in join_cells(out, one).items():
            if key not in out or found < out[key]:
                out[key] = found
    return out


CLOSURE = _closure()


@lru_cache(maxsize=None)
def leaf(kind: str) -> tuple:
    """Cell of one row as items. ``kind``: ``x`` must go; else the role initial (``o`` for others), upper case if truncated."""
    edits: Cell = {(p, p): (DELETE, "D") for p in STATES}
    if kind != "x":
        extra = TRUNCATED if kind.isupper() else 0
        choices = [(extra, "K", STEPS.get(kind.lower(), {}))] + [(REROLE + extra, "R", STEPS[c]) for c in ("u", "a")]
        for cost, letter, steps in choices:
            for p, q in steps.items():
                if (p, q) not in edits or (cost, letter) < edits[p, q]:
                    edits[p, q] = (cost, letter)
    return tuple(join_cells(join_cells(CLOSURE, edits), CLOSURE).items())


@lru_cache(maxsize=1 << 15)
def short_span(kinds: str) -> tuple:
    """Cell of up to eight rows; conversations repeat few patterns of them."""
    if len(kinds) == 1:
        return leaf(kinds)
    half = len(kinds) // 2
    return tuple(join_cells(dict(short_span(kinds[:half])), dict(short_span(kinds[half:]))).items())


def combine(cells: list[Cell]) -> Cell:
    """One cell over neighbouring spans, span lengths doubling; no rows give the insertion closure."""
    if not cells:
        return CLOSURE
    while len(cells) > 1:
        cells = [join_cells(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def parse(kinds: str) -> Cell:
    return combine([dict(short_span(kinds[i:i + 8])) for i in range(0, len(kinds), 8)])


def best(cell: Cell) -> tuple[int, str]:
    """Cheapest whole parse; a conversation without rows needs no edit."""
    return min(cell[START, q] for q in ENDS if (START, q) in cell)


class Writer:
    """Applies an audit to rows as they come and hashes the repaired ``role:text`` lines."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.first, self.sha = audit, 0, START, True, hashlib.sha256()

    def _line(self, role: str, text: str, initial: str) -> None:
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first, self.state = False, STEPS[initial][self.state]

    def _turn(self) -> str:
        return "a" if self.state == 2 else "u"

    def insertions(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self._line(ROLES[self._turn()], "", self._turn())
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insertions()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self._line(role, text, role[0])
        elif edit == "R":
            self._line(ROLES[self._turn()], text, self._turn())

    def digest(self) -> str:
        self.insertions()
        return self.sha.hexdigest()


ROLES = {"u": "user", "a": "assistant"}


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys`` where null equals null; the keys of ``left`` stay."""
    side = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    joined = left.join(side, reduce(lambda a, b: a & b, same), how)
    return joined.drop(*[f"_r_{k}" for k in keys])


def damage(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, copy`` of the rows left by the seeded damage; nulls of role and text become one space.

    ``crc32('conv:turn') % 20`` decides: 0 drops a row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes it a user's.
    Equal rows are folded first and dealt out again by number, so ``(conv_id, turn, given role, given text, copy)`` orders rows strictly.
    """
    space = F.lit(" ")
    rows = conversations.groupBy(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("given_role"),
        F.coalesce(F.col(text), space).alias("given_text"),
    ).agg(F.count(F.lit(1)).alias("times"))
    fate = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    many = F.col("times") * F.when(F.col("fate") == 3, 2).otherwise(1)
    return rows.withColumn("fate", fate).where("fate <> 0").select(
        "conv_id", "turn", "given_role", "given_text",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("given_role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("given_text", "[.!?]", "")).otherwise(F.col("given_text")).alias("text"),
        F.explode(F.sequence(F.lit(1).cast("long"), many)).alias("copy"),
    )


#: Order of the rows of a conversation: by turn, null turns first; rows of one turn by the role and text given, then by copy.
ORDER = ["turn", "given_role", "given_text", "copy"]


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``kind`` (see ``leaf``), and ``fault``, the first that counts: blank, duplicate, truncated or null.

    A row is a duplicate unless it is the first of its conversation, role and text: the least in order, an aggregate and not a
    window, so that no conversation is sorted in one place for it.
    """
    key = ["conv_id", "role", "text"]
    first = rows.where("copy = 1").groupBy(*key).agg(F.min(F.struct(*ORDER)).alias("first"))
    joined = match(rows, first, key, "left")
    blank = ~F.col("text").rlike(SOLID)
    again = ~F.struct(*ORDER).eqNullSafe(F.col("first"))
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault: Column = F.when(blank, "blank").when(again, "duplicate").when(~ended, "truncated")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    return joined.withColumn("fault", fault).withColumn("kind", kind).drop("first")


LEGAL = {"su", "ua", "au"}
PART = (
    "conv_id {type}, part int, rows long, blank long, duplicate long, truncated long, illegal long, head string, tail string, "
    "froms array<int>, tos array<int>, costs array<bigint>, audits array<string>, repaired_sha256 string"
)


class _Part:
    """The rows of one conversation that one task holds."""

    def __init__(self, conv: object, keep: bool):
        self.conv, self.keep, self.kinds, self.lines = conv, keep, [], []
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.head, self.tail = 0, None, None

    def add(self, role: str, text: str, fault: str | None, kind: str) -> None:
        if fault:
            self.count[fault] += 1
        initial = role[:1]
        if self.tail is None:
            self.head = initial
        elif self.tail + initial not in LEGAL:
            self.illegal += 1
        self.tail = initial
        self.kinds.append(kind)
        if self.keep:
            self.lines.append((role, text))

    def result(self, part: int) -> tuple:
        cell = parse("".join(self.kinds))
        sha = None
        if self.keep:
            writer = Writer(best(cell)[1])
            for role, text in self.lines:
                writer.row(role, text)
            sha = writer.digest()
        return (
            self.conv, part, len(self.kinds), *self.count.values(), self.illegal, self.head, self.tail, [p for p, _ in cell],
            [q for _, q in cell], [c for c, _ in cell.values()], [a for _, a in cell.values()], sha,
        )


def _same(a: object, b: object) -> bool:
    return a == b or (a is None and b is None)


def _plain(value: object) -> object:
    return None if value is None or value != value else value


def parse_parts(rows: DataFrame) -> DataFrame:
    """One row per conversation and task that holds some of it, with the cell of its rows there.

    The text is hashed at once where a conversation can only lie in this task: neither the first nor the last one of the
    task. Those two are read again for their hash, see ``hash_split``.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "role", "text", "fault", "kind"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, first = TaskContext.get().partitionId(), None, True
        out: list[tuple] = []
        for batch in batches:
            for conv, role, text, fault, kind in zip(*(batch[n].astype(object) for n in names)):
                conv = _plain(conv)
                if held is None or not _same(held.conv, conv):
                    if held is not None:
                        out.append(held.result(part))
                        first = False
                    held = _Part(conv, keep=not first)
                held.add(role, text, _plain(fault), kind)
            if len(out) >= 500:
                yield _frame(out)
                out = []
        if held is not None:
            done = held.result(part)
            out.append((*done[:-1], None))  # the next task may hold more of it
        if out:
            yield _frame(out)

    return rows.select(*names).mapInPandas(run, PART.format(type=kind))


def _frame(out: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in PART.split(", ")]
    frame = pd.DataFrame(out, columns=names)
    frame["conv_id"] = frame["conv_id"].astype(object)
    return frame


def merge_parts(parts: DataFrame) -> DataFrame:
    """One row per conversation of several parts, or of one without a hash: its cells joined in order of the parts."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    counts = ["rows", "blank", "duplicate", "truncated", "illegal"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        cells = [
            {(p, q): (c, a) for p, q, c, a in zip(*columns)}
            for columns in zip(frame["froms"], frame["tos"], frame["costs"], frame["audits"])
        ]
        cost, audit = best(combine(cells))
        sums = {c: int(frame[c].sum()) for c in counts}
        seams = zip(frame["tail"].tolist()[:-1], frame["head"].tolist()[1:])
        sums["illegal"] += sum(a + b not in LEGAL for a, b in seams)
        return pd.DataFrame([{"conv_id": _plain(frame["conv_id"].iloc[0]), **sums, "cost": cost, "audit": audit}]).astype({"conv_id": object})

    schema = f"conv_id {kind}, {', '.join(f'{c} long' for c in counts)}, cost long, audit string"
    return parts.groupBy("conv_id").applyInPandas(run, schema)


def hash_split(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` for the conversations of ``audits``: rows stream in order past the edits; none is held."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    plain = [*ORDER, "role", "text"]
    left = rows.select("conv_id", *plain, F.lit(None).cast("string").alias("audit"), F.lit(1).alias("_after"))
    head = audits.select("conv_id", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in plain], "audit", F.lit(0).alias("_after"))
    lined = head.unionByName(left).repartition("conv_id").sortWithinPartitions("conv_id", "_after", *ORDER)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, writer, out = None, None, []
        for batch in batches:
            for key, role, text, audit, after in zip(batch["conv_id"].astype(object), batch["role"], batch["text"], batch["audit"], batch["_after"]):
                if not after:
                    if writer is not None:
                        out.append((conv, writer.digest()))
                    conv, writer = _plain(key), Writer(audit)
                else:
                    writer.row(role, text)
        if writer is not None:
            out.append((conv, writer.digest()))
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"]).astype({"conv_id": object})

    return lined.select("conv_id", "role", "text", "audit", "_after").mapInPandas(run, f"conv_id {kind}, repaired_sha256 string")


def repair_conversations(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Every ``conv_id`` of ``conversations`` with the faults, edits and repaired hash of its ``rows`` (given ones or the damaged).

    Columns: ``gaps`` (turns missing between the least and the greatest, null turns ignored), ``blank, duplicate, truncated`` (first
    fault of each row), ``illegal`` (neighbouring initials other than su, ua, au), ``cost, audit`` (cheapest edits, ties to the
    ASCII-least audit) and ``repaired_sha256``. Edits: keep 0, rerole to user or assistant 2, delete 3 (required for blank and duplicate
    rows), insert an empty user or assistant row 2; a truncated row that stays costs 1 more.

    A null role or text counts as one space. A null ``conv_id`` is a conversation of its own; null turns come first. Rows
    of one turn go by role, then text, repeated rows stand side by side and all but the first are duplicates. A conversation
    without rows has zeros, an empty audit and the hash of nothing. Long texts are read whole; an empty table gives no row; other columns
    play no part.
    """
    rows = damage(conversations) if rows is None else rows
    checked = stage(faults(rows), "repair-rows")
    dealt = checked.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    parts = stage(parse_parts(dealt), "repair-parts")
    # At most two conversations of each task are open, whatever the input: their ids are few.
    open_ids = F.broadcast(parts.where("repaired_sha256 IS NULL").select("conv_id").distinct())
    split = match(parts, open_ids, ["conv_id"], "left_semi")
    merged = stage(merge_parts(split), "repair-merged")
    texts = match(checked, open_ids, ["conv_id"], "left_semi")
    hashed = hash_split(texts, merged.select("conv_id", "audit"))
    late = match(merged, hashed, ["conv_id"], "inner")
    cells = F.arrays_zip("froms", "tos", "costs", "audits")
    ends = F.filter(cells, lambda c: (c["froms"] == START) & c["tos"].isin(*ENDS))
    least = F.array_min(F.transform(ends, lambda c: F.struct(c["costs"].alias("cost"), c["audits"].alias("audit"))))
    early = match(parts, open_ids, ["conv_id"], "left_anti").withColumn("_best", least).select(
        "conv_id", "rows", "blank", "duplicate", "truncated", "illegal", F.col("_best.cost").alias("cost"), F.col("_best.audit").alias("audit"), "repaired_sha256"
    )
    found = early.unionByName(late)
    turns = checked.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps")
    )
    ids = conversations.select("conv_id").distinct()
    out = match(match(ids, found, ["conv_id"], "left"), turns, ["conv_id"], "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
