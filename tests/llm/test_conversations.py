"""Conversation repair against a search over all edits, on small tables with every fault, ties, nulls, and conversations longer than a stretch."""

import functools
import hashlib
import itertools
import random
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from rolltally.llm import role_repair as R

DDL = "conv_id long, turn long, role string, text string"


def faults(rows):
    """(initial, fault) of rows in order."""
    seen, out = set(), []
    for _, role, text in rows:
        chars = re.sub(r"[\x20\x09-\x0D]", "", text)
        if not chars:
            out.append((role[:1], "blank"))
        elif (role, text) in seen:
            out.append((role[:1], "duplicate"))
        else:
            out.append((role[:1], "" if chars[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    return out


def cheapest(turns):
    """Least (cost, audit, roles) by trying every edit; ``want``: what the grammar may take next."""
    rest = {"start": "su", "sys": "u", "user": "a", "pair": "u"}
    after = {"s": "sys", "u": "user", "a": "pair"}

    @functools.cache
    def best(i, state, inserted):
        options = [(0, "", "")] if i == len(turns) and state in ("start", "pair") else []
        add = lambda price, letter, role, tail: options.append((price + tail[0], letter + tail[1], role + tail[2])) if tail else None
        if inserted < 2:
            for x in set(rest[state]) & set("ua"):
                add(2, "I", x, best(i, after[x], inserted + 1))
        if i < len(turns):
            initial, fault = turns[i]
            add(3, "D", "", best(i + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                for x in rest[state]:
                    if initial == x:
                        add(cut, "K", x, best(i + 1, after[x], 0))
                    if x in "ua":
                        add(2 + cut, "R", x, best(i + 1, after[x], 0))
        return min(options) if options else None

    sys.setrecursionlimit(50_000)
    return best(0, "start", 0)


def expected(rows):
    """The contract's row of one conversation after damage; ``rows``: (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    found = faults(rows)
    cost, audit, roles = cheapest(tuple(found))
    said, kept, it = [], iter(roles), iter(rows)
    for edit in audit:
        row = next(it) if edit != "I" else (None, None, "")
        if edit != "D":
            x = next(kept)
            said.append(f"{row[1] if edit == 'K' else {'u': 'user', 'a': 'assistant'}[x]}:{row[2]}")
    turns = [t for t, _, _ in rows if t is not None]
    n = [f for _, f in found]
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(found))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, n.count("blank"), n.count("duplicate"), n.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub(r"[.!?]", "", text)}.get(case, text)
        role = "user" if case == 4 else role
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(case, 1)
    return out


def conversations(seed, n=120, long=0):
    rng = random.Random(seed)
    texts = ["Yes.", "No?", "and then", "", "  \t", "Élan!", "well. ", "x" * 50 + ".", None, "a\nb", "3 < 4"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "System", "Pair", "CP"]
    out = []
    for c in range(n):
        size = rng.choice([1, 2, 3, 5, 8, 12])
        for t in range(size):
            calm = rng.random() < 0.6
            role = ("user", "assistant")[t % 2] if calm else rng.choice(roles)
            turn = None if rng.random() < 0.05 else rng.choice([t, t, t, 2 * t, 0])
            out.append((c, turn, role, f"t{rng.randrange(9)}." if calm else rng.choice(texts)))
    for t in range(long):
        out.append((-7, rng.choice([t, t // 3, None]) if t % 50 == 0 else t, rng.choice(roles[:6]), rng.choice(texts) if t % 4 else f"said {t}" + rng.choice([".", ""])))
    out += [(None, 1, "user", "Hi."), (None, None, "assistant", "Hm."), out[3], out[3], (5_000, 0, "user", None)]
    return out


@pytest.mark.parametrize("block_rows, long", [(1024, 0), (1024, 400), (7, 400), (1, 60)])
def test_repair_matches_a_search_over_all_edits(spark, block_rows, long):
    rows = conversations(block_rows + long, long=long)
    docs = spark.createDataFrame(rows, DDL).withColumns({c: F.lit("x") for c in ("case", "copies", "said", "repeat", "path", "moves", "_conv")}).repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in R.op13_conversations(docs, block_rows).collect()}
    want = {c: expected(kept) for c, kept in damaged(rows).items()}
    assert got == want


def test_query_matches_sql(spark, sf_dir, tmp_path):
    """On the whole table, and on one with every fault, nulls, odd roles and ties."""
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(conversations(3), DDL).write.parquet(f"{tmp_path}/c")
    for path, files in ((f"{sf_dir}/conversations.parquet",) * 2, (f"{tmp_path}/c", f"{tmp_path}/c/*.parquet")):
        with duckdb.connect() as con:
            con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{files}'")
            want = con.execute(R.ORACLE_SQL).fetchall()
        got = R.op13_conversations(spark.read.parquet(path)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) > 5


def test_all_rows_dropped_and_empty_table(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone
    got = R.op13_conversations(spark.createDataFrame([(c, 0, "user", "Hi.") for c in gone], DDL)).collect()
    zero = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert sorted(r["conv_id"] for r in got) == gone and {tuple(r)[1:] for r in got} == {zero}
    assert R.op13_conversations(spark.createDataFrame([], DDL)).collect() == []


def test_a_conversation_of_one_repeated_row_is_counted_before_it_travels(spark):
    n = 20_000
    turn = next(t for t in range(99) if zlib.crc32(f"1:{t}".encode()) % 20 > 4)
    docs = spark.range(n).select(F.lit(1).alias("conv_id"), F.lit(turn).alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text"))
    assert R.counted(R.damaged(docs)).count() == 1
    row = R.op13_conversations(docs).first()
    assert row["audit"] == "K" + "D" * (n - 1) + "I" and row["duplicate"] == row["illegal"] == n - 1 and row["cost"] == 3 * (n - 1) + 2


@pytest.mark.parametrize("block_rows", [1024, 3])
def test_repaired_turns_are_the_digested_text(spark, block_rows):
    rows = conversations(9, 60, 90)
    said = R.repaired_turns(spark.createDataFrame(rows, DDL), block_rows).toPandas().sort_values(["block", "place"])
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, *(" " if x is None else x for x in (role, text))))
    for conv, kept in by_conv.items():
        mine = said[said.conv_id.isna()] if conv is None else said[said.conv_id == conv]
        text = "\n".join(f"{r}:{t}" for r, t in zip(mine.role, mine.text, strict=True))
        assert hashlib.sha256(text.encode()).hexdigest() == expected(kept)[-1], conv
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r[0] for r in mine.role))


def test_equal_tops_are_merged():
    tops = {R.entries()[0][0]: ((0, ""), R.entries()[0])}
    rng = random.Random(2)
    for _ in range(300):
        tops = R.consume(tops, rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.2)
        assert len(tops) <= 6
