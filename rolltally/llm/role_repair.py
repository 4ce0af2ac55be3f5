"""Conversation structure repair: generalised LR parsing of role sequences with weighted edits.

The role grammar ``S -> empty | C | s C;  C -> P | C P;  P -> u a`` gives an LR automaton. Every turn of a conversation is kept, reroled or deleted, and turns
may be inserted; each choice forks the parse. The live parses form a graph-structured stack: stacks share what lies below their tops, and equal tops are merged
by the least (cost, audit), since what may follow depends on the top alone. So a turn costs a handful of steps, however many repairs there are.

Distribution: equal rows are counted before any exchange, rows are range-sorted by (conversation, turn, role, text), and each task parses stretches of at most
``BLOCK_ROWS`` rows. A stretch whose beginning lies in another task is parsed from each kind of stack top. Then one row per stretch, not per turn, goes to its
conversation, where stretches are chained: the same merge of equal tops, with four digests running. So one conversation may hold any share of all rows.

Defined cases: a null role or text is one space; a null turn comes first, equal turns go by role and text; a null conv_id is a conversation of its own;
repeated rows are duplicates of the first; a role is judged by its first character, so any unknown or empty role must be reroled or deleted; a
conversation of which nothing is left has zeros, an empty audit and the digest of the empty text; texts are read whole; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache, partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolltally.llm.store import store

#: Rows and characters of a stretch at most (a longer text is a stretch of its own).
BLOCK_ROWS = 1024
BLOCK_CHARS = 1 << 22

# Fixed values: the grammar of role initials, and what the edits cost.
GRAMMAR = (("S", ""), ("S", "C"), ("S", "sC"), ("C", "P"), ("C", "CP"), ("P", "ua"))
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
TERMINALS = frozenset("sua")

_WORD_CHAR = re.compile(r"[^\x20\x09-\x0D]")
_LAST_CHAR = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")


class Automaton(NamedTuple):
    """LR(0) automaton: ``goto[state, symbol]``, and of each state the productions to reduce, those of ``S`` at the end only."""

    goto: dict[tuple[int, str], int]
    reduce: dict[int, list[tuple[str, int]]]
    final: dict[int, list[tuple[str, int]]]


@cache
def automaton() -> Automaton:
    def closed(items: frozenset) -> frozenset:
        out, todo = set(items), list(items)
        while todo:
            _, body, dot = todo.pop()
            for left, right in GRAMMAR:
                item = (left, right, 0)
                if dot < len(body) and body[dot] == left and item not in out:
                    out.add(item)
                    todo.append(item)
        return frozenset(out)

    states, goto, reduce, final = [closed(frozenset({("", "S", 0)}))], {}, {}, {}
    for n, state in enumerate(states):  # grows while it is walked
        for symbol in sorted({body[dot] for _, body, dot in state if dot < len(body)}):
            target = closed(frozenset((left, body, dot + 1) for left, body, dot in state if body[dot : dot + 1] == symbol))
            if target not in states:
                states.append(target)
            goto[n, symbol] = states.index(target)
        done = [(left, len(body)) for left, body, dot in state if dot == len(body) and left]
        reduce[n] = [p for p in done if p[0] != "S"]
        final[n] = [p for p in done if p[0] == "S"]
    return Automaton(goto, reduce, final)


#: A stack is (state, stack below); a top of the graph-structured stack maps to its least (cost, audit) and the stack that gave it.
Stack = tuple[int, "Stack | None"]
Tops = dict[int, tuple[tuple[int, str], Stack]]


def shift(stack: Stack, symbol: str) -> Stack | None:
    """``symbol`` pushed, and everything reduced that needs no lookahead; null where the automaton has no such move."""
    auto = automaton()
    to = auto.goto.get((stack[0], symbol))
    if to is None:
        return None
    stack = (to, stack)
    while auto.reduce[stack[0]]:
        left, size = auto.reduce[stack[0]][0]
        for _ in range(size):
            stack = stack[1]
        stack = (auto.goto[stack[0], left], stack)
    return stack


def _merge(tops: Tops, value: tuple[int, str], stack: Stack) -> bool:
    have = tops.get(stack[0])
    if have is None or value < have[0]:
        tops[stack[0]] = (value, stack)
        return True
    return False


def with_inserts(tops: Tops) -> Tops:
    """The tops and all that inserted turns lead to."""
    out, todo = dict(tops), list(tops)
    while todo:
        (cost, audit), stack = out[todo.pop()]
        for symbol in ROLES:
            after = shift(stack, symbol)
            if after is not None and _merge(out, (cost + INSERT, audit + "I"), after):
                todo.append(after[0])
    return out


def consume(tops: Tops, initial: str, forced: bool, truncated: bool, copies: int = 1) -> Tops:
    """The tops after one turn and its ``copies - 1`` repetitions, which must be deleted as a ``forced`` turn must."""
    repeated = copies - 1
    more, tail = DELETE * repeated, "D" * repeated
    out: Tops = {}
    for (cost, audit), stack in tops.values():
        _merge(out, (cost + DELETE + more, audit + "D" + tail), stack)
    if forced:  # an insertion before a deletion never beats one after it
        return out
    extra = more + (TRUNCATED if truncated else 0)
    for (cost, audit), stack in with_inserts(tops).values():
        for symbol, price, letter in ((initial, KEEP, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")):
            after = shift(stack, symbol) if symbol in TERMINALS else None
            if after is not None:
                _merge(out, (cost + price + extra, audit + letter + tail), after)
    return out


@cache
def entries() -> tuple[Stack, ...]:
    """A stack of each kind: nothing yet, after the system turn, after a user turn, after a pair. What may follow depends on the kind alone."""
    start: Stack = (0, None)
    pair = shift(shift(start, "u"), "a")
    return start, shift(start, "s"), shift(start, "u"), pair


@cache
def _kinds() -> dict[int, int]:
    kinds = {stack[0]: i for i, stack in enumerate(entries())}
    system = entries()[1]
    kinds[shift(shift(system, "u"), "a")[0]] = 3
    return kinds


def exits(tops: Tops) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) of each kind of top."""
    out: dict[int, tuple[int, str]] = {}
    for state, (value, _) in tops.items():
        kind = _kinds()[state]
        out[kind] = min(out.get(kind, value), value)
    return out


@cache
def ending(kind: int) -> tuple[int, str]:
    """What it costs to end a conversation whose stack is of this kind."""
    auto, best = automaton(), []
    for value, stack in with_inserts({entries()[kind][0]: ((0, ""), entries()[kind])}).values():
        if auto.final[stack[0]]:
            best.append(value)
    return min(best)


class Turn(NamedTuple):
    initial: str
    role: str | None  # of a turn that must go: null
    text: str | None
    truncated: bool
    copies: int


def parse(turns: list[Turn], kind: int = 0) -> dict[int, tuple[int, str]]:
    """(cost, audit) by the kind of stack that the turns lead to, from a stack of ``kind``."""
    tops: Tops = {entries()[kind][0]: ((0, ""), entries()[kind])}
    for turn in turns:
        tops = consume(tops, turn.initial, turn.text is None, turn.truncated, turn.copies)
    return exits(tops)


def repaired(turns: list[Turn], kind: int, audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns that ``audit`` leaves or inserts."""
    waiting, state = iter(turns), kind
    turn = None
    skip = 0
    for edit in audit:
        if skip:
            skip -= 1
            continue
        if edit == "I":
            said = (ROLES["a" if state == 2 else "u"], "")
        else:
            turn = next(waiting)
            skip = turn.copies - 1
            if edit == "D":
                continue
            said = (turn.role if edit == "K" else ROLES["a" if state == 2 else "u"], turn.text)
        yield said
        initial = said[0][:1]
        state = 1 if initial == "s" else 2 if initial == "u" else 3


# ---- Spark


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows after the contract's damage, equal ones counted; a dropped row leaves its conversation with 0 copies."""
    blank = F.lit(" ")
    conv, turn = conversations["conv_id"].cast("long"), conversations["turn"].cast("long")
    name = F.concat(F.coalesce(conv.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))
    case = (F.crc32(name.cast("binary")) % 20).alias("case")
    rows = conversations.select(
        conv.alias("conv_id"), turn.alias("turn"), F.coalesce(conversations["role"], blank).alias("role"), F.coalesce(conversations["text"], blank).alias("text"), case
    )
    stays = F.col("case") != 0
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return counted(
        rows.select(
            "conv_id", F.when(stays, F.col("turn")).alias("turn"), F.when(stays, F.when(F.col("case") == 4, "user").otherwise(F.col("role"))).alias("role"),
            F.when(stays, text).alias("text"), F.when(~stays, 0).when(F.col("case") == 3, 2).otherwise(1).cast("long").alias("copies"),
        )
    )


def undamaged(conversations: DataFrame) -> DataFrame:
    """The same columns from rows as they are, for conversations to be repaired as found."""
    c = conversations
    return counted(
        c.select(
            c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), F.coalesce(c["role"], F.lit(" ")).alias("role"),
            F.coalesce(c["text"], F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("copies"),
        )
    )


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def with_repeats(rows: DataFrame) -> DataFrame:
    """Add ``repeat``: role and text were said at an earlier turn of the conversation. Groups are narrow and combinable; only those of several turns are joined."""
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("said", said)
    groups = rows.where("said is not null").groupBy(F.col("conv_id").alias("_conv"), F.col("said").alias("_said")).agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("turn").isNull()).alias("_null"), F.min("turn").alias("_first")
    )
    joined = rows.join(groups.where("_n > 1"), rows["conv_id"].eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")), "left")
    later = F.col("turn").isNotNull() & (F.col("_null") | (F.col("turn") > F.col("_first")))
    return joined.select("conv_id", "turn", "role", "text", "copies", F.coalesce(later, F.lit(False)).alias("repeat"))


_KEY = ["conv_id", "turn", "role", "text"]
_BLOCK = pa.schema(
    [
        ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("last_turn", pa.int64()),
        ("first", pa.string()), ("last", pa.string()), ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
        ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
        ("moves", pa.list_(pa.struct([("enter", pa.int8()), ("leave", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())]))),
        ("said", pa.list_(pa.struct([("initial", pa.string()), ("role", pa.string()), ("text", pa.string()), ("truncated", pa.bool_()), ("copies", pa.int64())]))),
    ]
)
_BLOCK_DDL = (
    "conv_id long, turn long, role string, text string, last_turn long, first string, last string, turns long, low long, high long, blank long, duplicate long, "
    "truncated long, illegal long, moves array<struct<enter:tinyint,leave:tinyint,cost:bigint,audit:string>>, "
    "said array<struct<initial:string,role:string,text:string,truncated:boolean,copies:bigint>>"
)


class _Stretch:
    """Rows of one conversation while they come in, and their summary."""

    def __init__(self, conv_id: int | None, kinds: set[int], rows: int) -> None:
        self.conv_id, self.kinds, self.rows = conv_id, kinds, rows
        self.key: tuple = (None, None, None)
        self.said: list[Turn] = []
        self.chars = 0
        self.first = self.last = None
        self.last_turn = self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, repeat: bool) -> None:
        initial = role[:1]
        if not self.said:
            self.key = (turn, role, text)
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1
        if turn is not None:
            if turn != self.last_turn:
                self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.last, self.last_turn = initial, turn
        end = _LAST_CHAR.search(text) if _WORD_CHAR.search(text) else None
        forced, cut = end is None or repeat, False
        if end is None:
            self.blank += copies
        else:
            cut = not repeat and end.group() not in ".!?"
            self.duplicate += copies if repeat else copies - 1
            self.truncated += cut
        self.said.append(Turn(initial, None if forced else role, None if forced else text, cut, copies))
        self.chars += len(text)

    @property
    def full(self) -> bool:
        return len(self.said) >= self.rows or self.chars >= BLOCK_CHARS

    def row(self) -> tuple[dict, set[int]]:
        moves, left = [], set()
        for kind in sorted(self.kinds):
            for to, (cost, audit) in sorted(parse(self.said, kind).items()):
                moves.append({"enter": kind, "leave": to, "cost": cost, "audit": audit})
                left.add(to)
        turn, role, text = self.key
        row = {
            "conv_id": self.conv_id, "turn": turn, "role": role, "text": text, "last_turn": self.last_turn, "first": self.first, "last": self.last, "turns": self.turns,
            "low": self.low, "high": self.high, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "moves": moves,
            "said": [t._asdict() for t in self.said],
        }
        return row, left


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows in order of ``_KEY`` -> one row per stretch."""
    stretch: _Stretch | None = None
    out: list[dict] = []
    held = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(lo, BLOCK_ROWS)
            for conv_id, turn, role, text, copies, repeat in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if stretch is None or stretch.conv_id != conv_id or stretch.full:
                    kinds = {0, 1, 2, 3} if stretch is None else {0}  # the first conversation of a task may have begun in another one
                    if stretch is not None:
                        row, left = stretch.row()
                        out.append(row)
                        held += stretch.chars
                        kinds = left if stretch.conv_id == conv_id else kinds
                    stretch = _Stretch(conv_id, kinds, rows)
                if copies:
                    stretch.add(turn, role, text, copies, repeat)
            if len(out) >= BLOCK_ROWS or held >= BLOCK_CHARS:
                yield pa.RecordBatch.from_pylist(out, schema=_BLOCK)
                out, held = [], 0
    if stretch is not None:
        out.append(stretch.row()[0])
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_BLOCK)


_RESULT = pa.schema(
    [("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
     ("audit", pa.string()), ("repaired_sha256", pa.string()), ("path", pa.string())]
)
_RESULT_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, path string"


class _Way(NamedTuple):
    """The best parse that leads to a kind of stack: ``audit`` and ``path`` are linked lists of the pieces of each stretch, ``rank`` orders the audits of all ways."""

    cost: int
    rank: int
    audit: tuple | None
    path: tuple | None
    digest: "hashlib._Hash"


def _spelled(link: tuple | None) -> str:
    parts = []
    while link is not None:
        parts.append(link[1])
        link = link[0]
    return "".join(reversed(parts))


class _Chain:
    """A conversation from its stretches, in order."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.ways: dict[int, _Way] = {0: _Way(0, 0, None, None, hashlib.sha256())}
        self.last = self.last_turn = self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, row: dict) -> None:
        if row["first"] is not None:  # else nothing but dropped rows
            self.turns += row["turns"]
            if self.last is not None:
                self.illegal += self.last + row["first"] not in LEGAL
                if row["turn"] is not None and row["turn"] == self.last_turn:
                    self.turns -= 1
            self.last, self.last_turn = row["last"], row["last_turn"]
            self.low = row["low"] if self.low is None else self.low
            self.high = self.high if row["high"] is None else row["high"]
            for name in ("blank", "duplicate", "truncated", "illegal"):
                setattr(self, name, getattr(self, name) + row[name])
        best: dict[int, tuple] = {}
        for move in row["moves"]:
            way = self.ways.get(move["enter"])
            if way is not None:
                value = (way.cost + move["cost"], way.rank, move["audit"], move["enter"])
                best[move["leave"]] = min(best.get(move["leave"], value), value)
        ranks = {audit: i for i, audit in enumerate(sorted({(rank, audit) for _, rank, audit, _ in best.values()}))}
        said = [Turn(**t) for t in row["said"]]
        ways = {}
        for leave, (cost, rank, audit, enter) in best.items():
            way = self.ways[enter]
            digest = way.digest.copy()
            fresh = enter == 0
            for role, text in repaired(said, enter, audit):
                digest.update((f"{role}:{text}" if fresh else f"\n{role}:{text}").encode())
                fresh = False
            ways[leave] = _Way(cost, ranks[rank, audit], (way.audit, audit), (way.path, str(enter)), digest)
        self.ways = ways

    def result(self) -> dict:
        ends = []
        for kind, way in self.ways.items():
            cost, audit = ending(kind)
            ends.append((way.cost + cost, way.rank, audit, kind))
        cost, _, tail, kind = min(ends)
        way = self.ways[kind]
        digest, fresh = way.digest, kind == 0
        for role, text in repaired([], kind, tail):
            digest.update((f"{role}:{text}" if fresh else f"\n{role}:{text}").encode())
            fresh = False
        return {
            "conv_id": self.conv_id, "gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns, "blank": self.blank, "duplicate": self.duplicate,
            "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": _spelled(way.audit) + tail, "repaired_sha256": digest.hexdigest(),
            "path": _spelled(way.path) + str(kind),
        }


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches in order of ``_KEY`` -> one row per conversation."""
    chain: _Chain | None = None
    out: list[dict] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            for row in batch.slice(lo, 64).to_pylist():
                if chain is None or chain.conv_id != row["conv_id"]:
                    if chain is not None:
                        out.append(chain.result())
                    chain = _Chain(row["conv_id"])
                chain.add(row)
            if len(out) >= BLOCK_ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=_RESULT)
                out = []
    if chain is not None:
        out.append(chain.result())
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_RESULT)


def stretches(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per stretch of at most ``block_rows`` rows of a conversation; its first turn, role and text order it."""
    return with_repeats(rows).repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(partial(_blocks, rows=block_rows), _BLOCK_DDL)


def chained(blocks: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, path`` of each conversation."""
    return blocks.repartition("conv_id").sortWithinPartitions(*_KEY).mapInArrow(_chained, _RESULT_DDL)


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``conv_id, block, said, audit, enter, leave`` -> the turns of the repaired stretch."""
    for batch in batches:
        for row in batch.to_pylist():
            turns = list(repaired([Turn(**t) for t in row["said"]], row["enter"], row["audit"]))
            yield pa.RecordBatch.from_pydict(
                {"conv_id": [row["conv_id"]] * len(turns), "block": [row["block"]] * len(turns), "place": list(range(len(turns))),
                 "role": [r for r, _ in turns], "text": [t for _, t in turns]},
                schema=pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]),
            )


def repaired_turns(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The repaired conversations themselves, ``conv_id, block, place, role, text``: ``(block, place)`` orders the turns of a conversation."""
    blocks = store(stretches(undamaged(conversations), block_rows), "role-stretches")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")  # one row per stretch
    numbered = blocks.select("*", (F.row_number().over(order) - 1).cast("long").alias("block"))
    found = chained(blocks).select(F.col("conv_id").alias("_conv"), "path", "audit")
    joined = numbered.join(found, numbered["conv_id"].eqNullSafe(F.col("_conv")))
    kind = lambda at: F.substring("path", at, F.lit(1)).cast("tinyint")  # noqa: E731
    joined = joined.select("conv_id", "block", "said", "moves", kind(F.col("block").cast("int") + 1).alias("enter"), kind(F.col("block").cast("int") + 2).alias("leave"))
    move = F.get(F.filter("moves", lambda m: (m["enter"] == F.col("enter")) & (m["leave"] == F.col("leave"))), F.lit(0))
    inner = joined.select("conv_id", "block", "said", "enter", move["audit"].alias("audit")).where("audit is not null")
    ends = found.select(
        F.col("_conv").alias("conv_id"), (F.length("path") - 1).cast("long").alias("block"), F.array().cast(blocks.schema["said"].dataType).alias("said"),
        F.substring("path", F.length("path"), F.lit(1)).cast("tinyint").alias("enter"),
    )
    tails = F.create_map(*[x for k in range(4) for x in (F.lit(k).cast("tinyint"), F.lit(ending(k)[1]))])
    ends = ends.withColumn("audit", F.element_at(tails, F.col("enter")))
    return inner.unionByName(ends).select("conv_id", "block", "said", "enter", "audit").mapInArrow(_said, "conv_id long, block long, place long, role string, text string")


def op13_conversations(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Contract query: the damage, the repair and the digest columns, one row per conversation."""
    return chained(stretches(damaged(conversations), block_rows)).drop("path")


# ---- the contract in SQL: one row per turn, and for each kind of stack the least (cost, audit, text)


def _after(way: str, cost: str | int, letters: str, text: str) -> str:
    return f"CASE WHEN {way} IS NOT NULL THEN {{'c': {way}.c + {cost}, 'a': {way}.a || '{letters}', 't': {way}.t || {text}}} END"


_NEW = {x: f"chr(10) || '{role}:'" for x, role in ROLES.items()}
_BOTH = {"ua": f"{_NEW['u']} || {_NEW['a']}", "au": f"{_NEW['a']} || {_NEW['u']}"}


def _inserted(way: str) -> dict[int, str]:
    """What insertions make of the way to one kind of stack."""
    kind = int(way[-1])
    if kind == 2:
        return {3: _after(way, INSERT, "I", _NEW["a"])}
    return {2: _after(way, INSERT, "I", _NEW["u"]), 3: _after(way, 2 * INSERT, "II", _BOTH["ua"])}


def _taken(kind: int) -> str:
    """The ways that keep or rerole a turn so that a stack of ``kind`` results."""
    role, sources = {1: ("s", [0]), 2: ("u", [0, 1, 3]), 3: ("a", [2])}[kind]
    keep = ", ".join(f"CASE WHEN r = '{role}' THEN {_after(f'c{x}', 'cut', 'K', 'chr(10) || role || chr(58) || text')} END" for x in sources)
    if role == "s":
        return keep
    return keep + ", " + ", ".join(_after(f"c{x}", f"{REROLE} + cut", "R", f"{_NEW[role]} || text") for x in sources)


_CLOSED = ", ".join(
    f"least(s{kind}{''.join(', ' + _inserted(f's{x}')[kind] for x in range(4) if kind in _inserted(f's{x}'))}) AS c{kind}" if kind > 1 else f"s{kind} AS c{kind}"
    for kind in range(4)
)
_STEPPED = ", ".join(
    f"least({_after(f's{kind}', DELETE, 'D', repr(''))}{f', CASE WHEN NOT forced THEN least({_taken(kind)}) END' if kind else ''}) AS s{kind}" for kind in range(4)
)

ORACLE_SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), named AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), hashed AS (
  SELECT named.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM named, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), seen AS (
  SELECT *, substr(role, 1, 1) AS r, regexp_replace(text, '[ 	-]', '', 'g') AS chars, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM ranked
), faults AS (
  SELECT *, chars = '' OR nth > 1 AS forced, CASE WHEN chars <> '' AND nth = 1 AND right(chars, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut,
    lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM seen
), p AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s1,
    NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s2, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s3 FROM named
  UNION ALL
  SELECT conv_id, i, {_STEPPED} FROM (
    SELECT p.conv_id, f.i, f.r, f.role, f.text, f.forced, f.cut, s0, s1, s2, s3, {_CLOSED}
    FROM p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1)
), ended AS (
  SELECT conv_id, arg_max(least(s0, {_after('s1', 2 * INSERT, 'II', _BOTH['ua'])}, {_after('s2', INSERT, 'I', _NEW['a'])}, s3), i) AS best FROM p GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (chars = '') AS blank,
    count(*) FILTER (chars <> '' AND nth > 1) AS duplicate, sum(cut) AS truncated, count(*) FILTER (prior IS NOT NULL AND prior || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM ended e LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM e.conv_id
"""
