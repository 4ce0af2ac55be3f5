"""Licence scan with a positional rare-token index, in DataFrame functions only.

The index is over licence templates: word -> (template, position). A first pass over the texts keeps of each document only the places of
template words (and nothing of a document without a rare one). From these come the document frequencies of all rare
template words over the whole corpus. Each document looks templates up by the words it holds itself, those of the highest inverse document frequency first:
its rarest word in a template's key phrases is the anchor, and each place of it says where the template would begin. Such a
candidate counts if all words of the template's mandatory key phrases stand where they belong, in the words around the anchor; its score is the share of
all template words that do. So a document's labels depend on its own text only. The phrases of the base labels are counted everywhere.

Defined cases: a null or empty text has no words and no labels ('' and score 0); repeated rows are scanned each; equal document frequencies are ordered
by the word; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolltally.llm.store import store

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases that make a base label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, opening words or notice of a licence; key phrases that must be complete stand in brackets.
TEMPLATES = (
    ("apache", "licensed under the [apache license] version 2 0"),
    ("apache", "you may not use this file [except in compliance with the license] you may obtain a copy of the license at http www [apache org licenses]"),
    ("mit", "released under the [mit license]"),
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files the software [to deal in the software without restriction]"),
    ("gpl", "this work is licensed under the [gnu general public license] version 3"),
    ("gpl", "this program is [free software] you can redistribute it and or modify it under the terms of the [gnu general public license] as published by the free software foundation"),
    ("lgpl", "under the terms of the [gnu lesser general public license] as published by the free software foundation"),
    ("agpl", "under the terms of the [gnu affero general public license] as published by the free software foundation"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the [mozilla public license] v 2 0"),
    ("isc", "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under a [creative commons attribution] 4 0 international license"),
    ("cc-by-nc", "licensed under [cc by nc 4 0]"),
    ("cc-by-sa", "licensed under [cc by sa 4 0]"),
    ("unlicense", "this is free and unencumbered software [released into the public domain]"),
)
# Template words too frequent to be looked up by.
FREQUENT = frozenset("a and any are as at by can for free in into is it may not of or that the this to use with without you 0 2 3 4 v http www".split())


def parsed(template: str) -> tuple[list[str], list[bool]]:
    """Words of a template, and which of them belong to a key phrase."""
    words, must, inside = [], [], False
    for word in template.split():
        inside = inside or word.startswith("[")
        words.append(word.strip("[]"))
        must.append(inside)
        inside = inside and not word.endswith("]")
    return words, must


_PARSED = [(label, *parsed(text)) for label, text in TEMPLATES]
VOCABULARY = sorted({w for _, words, _ in _PARSED for w in words} | {w for phrase in BASE for w in phrase.split()})
_CODE = {w: i + 1 for i, w in enumerate(VOCABULARY)}
RARE = [w for w in VOCABULARY if w not in FREQUENT]


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def license_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, hits``: places (from 0) and codes of template words, null in documents without a rare one."""
    lowered = F.translate(F.coalesce(docs[text], F.lit("")), UPPER, LOWER)
    words = docs.select(docs[doc_id].alias("doc_id"), F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("words"))
    vocabulary = _strings(VOCABULARY)
    places = F.filter(
        F.transform("words", lambda w, i: F.struct(i.cast("int").alias("p"), F.array_position(vocabulary, w).cast("int").alias("w"))), lambda h: h["w"] > 0
    )
    return words.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.arrays_overlap("words", _strings(RARE)), places).alias("hits")
    )


def rarest_first(found: DataFrame) -> list[str]:
    """The rare template words by falling inverse document frequency over all documents of ``found``; the counts are one row per word."""
    rare = F.array(*[F.lit(_CODE[w]) for w in RARE])
    held = found.where("hits is not null").select(F.explode(F.array_intersect(F.transform("hits", lambda h: h["w"]), rare)).alias("w"))
    frequency = {VOCABULARY[r["w"] - 1]: r["count"] for r in held.groupBy("w").count().collect()}
    return sorted(RARE, key=lambda w: (frequency.get(w, 0), w))


def _standing(hits: Column, phrase: str) -> Column:
    """Places where the words of ``phrase`` stand one after the other: neighbours in the text are neighbours in ``hits``."""
    codes = [_CODE[w] for w in phrase.split()]

    def at(h: Column, i: Column) -> Column:
        all_there = h["w"] == codes[0]
        for j, code in enumerate(codes[1:], 1):
            other = F.get(hits, i + j)
            all_there = all_there & F.coalesce((other["w"] == code) & (other["p"] == h["p"] + j), F.lit(False))
        return F.when(all_there, h["p"])

    return F.filter(F.transform(hits, at), lambda p: p.isNotNull())


def _best(hits: Column, own: Column, words: list[str], must: list[bool]) -> Column:
    """Best score of a template in a document, null where no candidate has all key phrases; ``own``: codes of the document's rare words, rarest first."""
    codes = F.array(*[F.lit(_CODE[w]) for w in words])
    needed = F.array(*[F.lit(m) for m in must])
    posting = {_CODE[w]: [i for i, x in enumerate(words) if x == w and must[i]] for w, m in zip(words, must, strict=True) if m and w in RARE}
    anchor = F.get(F.array_intersect(own, F.array(*[F.lit(c) for c in posting])), F.lit(0))
    at = F.filter(F.transform(hits, lambda h, i: F.when(h["w"] == anchor, F.struct(h["p"].alias("p"), i.alias("i"), h["w"].alias("w")))), lambda a: a.isNotNull())
    candidates = F.flatten(
        F.transform(
            at,
            lambda a: F.coalesce(
                *[F.when(a["w"] == code, F.array(*[F.struct((a["p"] - F.lit(place)).alias("begin"), a["i"].alias("i")) for place in places])) for code, places in posting.items()]
            ),
        )
    )
    reach = len(words) - 1

    def score(c: Column) -> Column:
        begin = c["begin"]
        near = F.slice(hits, F.greatest(c["i"] - F.lit(reach), F.lit(0)) + F.lit(1), F.lit(2 * reach + 1))  # hits are at different places
        there = F.filter(near, lambda h: (h["p"] >= begin) & F.coalesce(F.get(codes, h["p"] - begin) == h["w"], F.lit(False)))
        complete = F.size(F.filter(there, lambda h: F.get(needed, h["p"] - begin))) == sum(must)
        return F.when(complete, F.size(there) / F.lit(float(len(words))))

    return F.array_max(F.transform(candidates, score))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per row of ``docs``."""
    found = store(license_words(docs, doc_id, text), "license-words")
    by_idf = F.array(*[F.lit(_CODE[w]) for w in rarest_first(found)])
    found = found.withColumn("own", F.array_intersect(by_idf, F.transform("hits", lambda h: h["w"])))
    hits = F.col("hits")
    base = found.select("*", *[F.coalesce(_standing(hits, phrase), F.array().cast("array<int>")).alias(f"base_{i}") for i, phrase in enumerate(BASE)])
    scored = base.select(
        "doc_id", "n_words", F.array_sort(F.concat(*[F.col(f"base_{i}") for i in range(len(BASE))])).alias("starts"),
        F.array_compact(F.array(*[F.when(F.size(f"base_{i}") > 0, F.lit(label)) for i, label in enumerate(BASE.values())])).alias("base"),
        F.array(*[F.when(hits.isNotNull(), _best(hits, F.col("own"), words, must)) for _, words, must in _PARSED]).alias("scores"),
    )
    own = F.filter(F.transform(_strings([label for label, *_ in _PARSED]), lambda label, i: F.when(F.get("scores", i).isNotNull(), label)), lambda x: x.isNotNull())
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scored.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.get("starts", F.lit(0)).cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"), joined(F.col("base")).alias("base_labels"), joined(F.concat("base", own)).alias("labels"),
        F.coalesce(F.array_max("scores"), F.lit(0.0)).alias("score"),
    )


def op2_licenses(docs: DataFrame) -> DataFrame:
    return scan(docs)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


ORACLE_SQL = rf"""
WITH postings(template, label, place, word, must) AS (VALUES {_values([(t, label, i, w, int(must[i])) for t, (label, words, must) in enumerate(_PARSED) for i, w in enumerate(words)])}),
phrase(label, words) AS (VALUES {_values([(label, phrase) for phrase, label in BASE.items()])}),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents
), w AS (
  SELECT doc_id, i - 1 AS p, word FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d WHERE len(ws) > 0)
), c AS (
  SELECT DISTINCT doc_id, template, p - place AS start FROM w JOIN postings USING (word)
  WHERE place = (SELECT min(place) FROM postings q WHERE q.template = postings.template AND must = 1)
), v AS (
  SELECT c.doc_id, c.template, any_value(q.label) AS label, c.start, count(w.word)::DOUBLE / count(*) AS score,
         sum(must) FILTER (WHERE w.word IS NOT NULL) = sum(must) AS complete
  FROM c JOIN postings q USING (template) LEFT JOIN w ON w.doc_id = c.doc_id AND w.p = c.start + q.place AND w.word = q.word
  GROUP BY c.doc_id, c.template, c.start
), b AS (
  SELECT w.doc_id, label, p FROM w JOIN d USING (doc_id) JOIN phrase ON w.word = string_split(words, ' ')[1]
  WHERE array_to_string(ws[p + 1 : p + len(string_split(words, ' '))], ' ') = words
), bb AS (
  SELECT doc_id, count(*) AS n, min(p) AS first, max(p) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY doc_id
), vv AS (
  SELECT doc_id, max(score) AS score FROM v WHERE complete GROUP BY doc_id
), ll AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM v WHERE complete) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(bb.n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word,
       coalesce(bb.labels, '') AS base_labels, coalesce(ll.labels, '') AS labels, coalesce(vv.score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN bb USING (doc_id) LEFT JOIN ll USING (doc_id) LEFT JOIN vv USING (doc_id)
"""
