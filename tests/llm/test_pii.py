"""Personal data: base spans against the plain patterns, disguised identifiers against where they were put."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rolltally.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    good = {
        "email": lambda t: True,
        "ip": lambda t: all(int(x) <= 255 for x in t.split(".")),
        "card": lambda t: 14 <= len(re.sub(r"\D", "", t)) <= 19 and luhn(re.sub(r"\D", "", t)),
        "phone": lambda t: 10 <= len(re.sub(r"\D", "", t)) <= 15,
    }
    found = [(m.start(), k, m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if good[k](m.group())]
    order = list(PATTERNS)
    return sorted(found, key=lambda s: (s[0], order.index(s[1]), s[2]))


def said(found):
    return ",".join(f"{k}:{s}:{e}" for s, k, e in found)


def noise(seed, n=400):
    rng = random.Random(seed)
    alphabet = "ab.@-+ 0123456789()_%é\n" + "4@.+"
    pieces = ["a@b.c", "x.y@z-w.org", "1.2.3.4", "300.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 555-1234", "at", " dot ", "+", "12345678901234567890", "5500-0000-0000-0004"]
    return ["".join(rng.choice(pieces) if rng.random() < 0.2 else rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_base_spans_match_the_patterns():
    for text in [*noise(1, 4000), "1" * 3000, "a" * 3000 + "@b", "@".join("abc"), "a@b.c@d.e", "+" * 50 + "1" * 12, "0" * 4000 + ".1.1.1", "1.2.3.4.5.6.7.8"]:
        got = [(s, pii.KINDS[k], e) for s, k, e in pii.spans(text)[0]]
        assert got == base(text), text


# Identifiers and their disguises.
DISGUISED = [
    ("email", "john.doe at example dot com"), ("email", "john dot doe at mail dot example dot com"), ("email", "john (at) example [dot] com"), ("email", "john[at]example.com"),
    ("email", "jane @ example.com"), ("email", "jane@example dot com"), ("email", "jane @ example . com"), ("email", "jane {arobase} exemple {point} fr"), ("email", "juan (arroba) ejemplo (punto) es"),
    ("email", "jоhn@exаmple.cоm"), ("email", "john＠example．com"), ("email", "jo​hn@exam­ple.com"),
    ("ip", "192[.]168[.]10[.]1"), ("ip", "10 dot 0 dot 0 dot 255"), ("ip", "one nine two dot one six eight dot zero dot one"), ("ip", "１２.34.56.78"), ("ip", "192.168 punkt 1.1"),
    ("phone", "plus one five five five one two three four five six seven"), ("phone", "+1 five five five, one two three, four five six seven"), ("phone", "+١ (٥٥٥) 123-4567"),
    ("phone", "plus vier neun null eins drei null fünf acht sieben zwei eins"), ("phone", "plus trois trois un deux trois quatre cinq six sept huit neuf"),
    ("card", "four one one one one one one one one one one one one one one one"), ("card", "4111–1111–1111–1111"), ("card", "cuatro uno uno uno 1111 1111 1111"),
    ("card", "４111 1111 1111 11１１"),
]


@pytest.mark.parametrize("kind, disguise", DISGUISED)
def test_disguises_map_back_to_their_characters(kind, disguise):
    for before, after in (("", ""), ("État : ", "."), ("café​ аб ", " кonec"), ("(see ", ") one. Two dots at a time")):
        text = before + disguise + after
        found = pii.spans(text)[1]
        assert (len(before), pii.KINDS.index(kind), len(before) + len(disguise)) in found, (text, found)
        assert f"{before}[{kind.upper()}]{after}" == pii.masked(text)


@pytest.mark.parametrize(
    "text",
    ["look at the dot on this", "meet at noon. Two or three", "one two three four", "10 @ 2.50", "au point de vue", "we met at home dot", "f(at) x", "version 1 dot 2", "siſ ſix six one",
     "привет как дела", "a@ b", "see section 1.2.3 . Then", "at dot com", "@ dot com", " at x dot com"],
)
def test_clean_texts_stay_clean(text):
    assert pii.spans(text) == ([], []) and pii.masked(text) == text


def test_edits_keep_offsets():
    rng = random.Random(4)
    for _ in range(500):
        source = "".join(rng.choices("abcdef", k=20))
        cuts = sorted(rng.sample(range(21), 6))
        edits = [pii.Edit(a, b, rng.choice(["", "X", "YZ"])) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        r = pii.Rewrite(source, edits)
        origin = []
        at = 0
        for e in edits:
            origin += [(i, i + 1) for i in range(at, e.start)] + [(e.start, e.end)] * len(e.plain)
            at = e.end
        origin += [(i, i + 1) for i in range(at, 20)]
        assert len(origin) == len(r.text)
        for i in range(len(origin)):
            assert (r.start(i), r.end(i + 1)) == origin[i]


def test_query_on_nulls_repeats_and_clashing_names(spark):
    texts = [None, "", *noise(2, 120), "mail ann at example dot org or bob@example.org", "x " * 40_000 + "+1 (555) 555-1234"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "a@b.cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("spans", "n_email", "kind")}).repartition(3)
    got = sorted(map(tuple, pii.op11_pii(docs).collect()), key=str)
    want = []
    for i, t in rows:
        found = base(t or "")
        added = [(s, pii.KINDS[k], e) for s, k, e in pii.spans(t or "")[1]]
        both = sorted(found + added, key=lambda s: (s[0], pii.KINDS.index(s[1]), s[2]))
        want.append((i, *[sum(x[1] == k for x in found) for k in PATTERNS], hashlib.sha256(said(found).encode()).hexdigest(), said(both), len(added)))
    assert got == sorted(want, key=str)
    assert pii.op11_pii(docs).where("doc_id = 122").first()["spans"] == "email:5:27,email:31:46"
    masked = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert masked[122]["text"] == "mail [EMAIL] or [EMAIL]" and masked[0]["text"] is None and masked[1]["kind"] == 1
    assert pii.op11_pii(docs.limit(0)).collect() == []


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = pii.op11_pii(docs).collect()
    assert len(got) == len(texts)
    assert all(r["spans"] == said(base(texts[r["doc_id"]] or "")) and r["n_added"] == 0 for r in got)  # nothing there is disguised
    assert sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in got)
