"""Periodic runs against brute force over all periods and places."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolltally.llm import periodic_runs as P


def brute_runs(words):
    found = {}
    n = len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q):
                found.setdefault((i, length), q)  # the smallest period comes first
            i = max(j, i + 1) if j > i else i + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def contract(doc_id, text, damaged=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if damaged and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, k, q in runs for i in range(s + q, s + k)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(kept)), kept


def texts(seed, n=150):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        alphabet = rng.choice([["a"], ["a", "b"], ["a", "b", "é"], [f"w{i}" for i in range(60)]])
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts += rng.choices(alphabet, k=rng.randint(0, 30))
            unit = rng.choices(alphabet + ["Z\x1c"], k=rng.choice([1, 2, 3, 5, 7, 8, 9, 13, 16, 31, 32, 33, 40]))
            size = rng.choice([20, 23, 24, 25, 3 * len(unit), 3 * len(unit) - 1, 3 * len(unit) + 1, 100])
            parts += (unit * (size // len(unit) + 1))[:size]
        out.append(rng.choice([" ", "  ", "\n\t", "\x0b"]).join(parts))
    return out + [None, "", " \n", "w " * 23, "w " * 24, "w " * 5000, "a b " * 12, " ".join(map(str, range(90))), "a b " * 30, "x" * 100_000 + " " + "y " * 30]


@pytest.mark.parametrize("damaged", [True, False])
def test_runs_match_brute_force(spark, damaged):
    rows = [(i * 7, t) for i, t in enumerate(texts(3 + damaged))]
    rows += [(None, "q r " * 20), rows[4], rows[4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({c: F.lit(1) for c in ("row", "runs", "at", "words", "octave", "period")})
    found = P.find_runs(docs, damaged=damaged, texts=True).collect()
    got = sorted((tuple(r)[:8] for r in found), key=str)
    want = sorted((contract(i, t, damaged)[0] for i, t in rows), key=str)
    assert got == want
    texts_of = {i: contract(i, t, damaged)[1] for i, t in rows}
    assert all(r["kept"] == texts_of[r["doc_id"]] for r in found if r["kept"] is not None)
    assert all(len(r["runs"]) == r["n_runs"] for r in found)


def test_query_and_empty_table(spark):
    rows = [(i, "the end of it all " * 9) for i in range(60)]
    got = P.op12_runs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(contract(*r)[0] for r in rows)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert P.op12_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(map(tuple, P.op12_runs(docs).collect()))
    short = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if len(r["text"]) < 12_000]
    want = {r[0]: r for r in (contract(*x)[0] for x in short)}
    assert len(want) > 100 and all(want[r[0]] == r for r in got if r[0] in want)
    assert len(got) == docs.count()


def test_z_function_and_tiles():
    rng = random.Random(1)
    for _ in range(300):
        s = rng.choices([1, 2], k=rng.randint(0, 30))
        z = P.z_function(s)
        assert z == [0 if not i else next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
    # Every boundary's interval is the maximal stretch of matches around it, as far as the tile shows it.
    for _ in range(300):
        octave = rng.randrange(4)
        words = (rng.choices([1, 2], k=rng.randint(1, 9)) * 40)[: rng.randint(30, 120)] + rng.choices([1, 2, 3], k=rng.randint(0, 20))
        at = rng.randrange(len(words) - 8)
        found = P.solve_tile(words, at, octave)
        for q in range(1 << octave, 2 << octave):
            same = np.array([i + q < len(words) and words[i] == words[i + q] for i in range(len(words))])
            ahead = next((k for k in range(len(words) - at) if not same[at + k]), len(words) - at)
            behind = next((k for k in range(at) if not same[at - 1 - k]), at)
            assert ((q, at - behind, at + ahead) in found) == (ahead >= max(8, 1 << octave))


def test_long_texts_are_coded_in_stretches(monkeypatch):
    text = " ".join(f"w{i % 50}\n" for i in range(999)).encode()
    whole = P._coded(text, P._Codes()).tolist(), P._digest(text, None), P._words(text, (3, 5))
    monkeypatch.setattr(P, "_STRETCH", 10)
    assert (P._coded(text, P._Codes()).tolist(), P._digest(text, None), P._words(text, (3, 5))) == whole
    assert whole[1] == hashlib.sha256(b" ".join(text.split())).hexdigest()
