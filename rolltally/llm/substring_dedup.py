"""Substring dedup by level-wise doubling: only windows repeated at one length are extended to the next, about twice as long.

Two windows of 7 words that overlap in one word make a window of 13, so the levels for 13 are 7 and 13 (in general
``ceil(n / 2)`` and ``n``; the doubling ends with the length that is asked for). At the first level a window is represented by its minimizer, the short window of
smallest hash inside it: equal windows have equal minimizers, so nothing is lost, and about a fourth of all positions is looked up.
A window goes on if its minimizer also occurs in another document. At the second level the whole window is looked up, and it is
repeated if it starts in a document of smaller id. A word covered by a repeated window is removed.

Before each exchange a batch of rows emits a window's hash once, for its smallest document; the batch's other documents
know already that they repeat it. Windows per hash are then as many as batches, even if a third of all documents hold one passage. The whole text
goes through one exchange, which the plan's three joins on documents reuse. Documents whose word sequence equals that of a smaller id are removed whole
and emit nothing at the second level.

Defined cases: a null, empty or blank text has no words (kept text is empty); fewer than 13 words: nothing is removed; rows that share an id never
remove each other's words; rows with a null id neither lose words nor take any; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolltally.llm.minhash_dedup import sequence_key
from rolltally.llm.store import store
from rolltally.llm.words import mixed, slices, split, windows, word_hashes

WINDOW = 13

_CLASSES = "doc_id long, text_key long, n_words long, s1 long, s2 long"
_HITS = "hash long, doc_id long, at long"
_REST = "doc_id long, text_key long, n_words long, n_removed long, kept_text {kind}"

#: ``at``: 24 bits of the text's hash (rows that share an id), two flags, 36 bits of place.
_KEY_BITS, _KEY_SHIFT, _KNOWN, _FOLLOWED = 24, 38, 1 << 36, 1 << 37
#: Windows that are pre-aggregated at once.
_HELD = 400_000


def levels(window: int = WINDOW) -> tuple[int, int]:
    """Lengths of the two levels: a window of the second consists of two of the first that share at most one word."""
    return (window + 1) // 2, window


def minimizers(short: np.ndarray, span: int) -> np.ndarray:
    """For each stretch of ``span`` consecutive short windows the place of its smallest hash (the first of equal ones)."""
    count = len(short) - span + 1
    if count <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at = short[:count].copy(), np.zeros(count, dtype=np.int64)
    for j in range(1, span):
        other = short[j : j + count]
        less = other < best
        best[less] = other[less]
        at[less] = j
    return at + np.arange(count)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column(2)):
            part = batch.slice(lo, hi - lo)
            hashes, first = word_hashes(part.column(2))
            keys = [sequence_key(hashes[first[i] : first[i + 1]]) for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.diff(first)), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())],
                names=["doc_id", "text_key", "n_words", "s1", "s2"],
            )


def _emit(hashes: list, docs: list, keys: list, places: list) -> Iterator[pa.RecordBatch]:
    """Windows of some documents, in their order: per hash the smallest document goes to the exchange under the hash, the others, as known
    repeats, under a key of their own. ``at`` holds the text's key, the flags and the place."""
    if not hashes:
        return
    h, d, k, p = (np.concatenate(x) for x in (hashes, docs, keys, places))
    order = np.lexsort((d, h))
    sorted_h = h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = sorted_h[1:] != sorted_h[:-1]
    group = np.empty(len(h), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    known = d != d[order[np.flatnonzero(new)]][group]
    followed = np.zeros(int(new.sum()), dtype=bool)
    followed[group[known]] = True
    flags = _KNOWN * known + _FOLLOWED * (followed[group] & ~known)
    key = np.where(known, mixed(mixed(d.view(np.uint64)) + p.astype(np.uint64)), h).view(np.int64)
    at = (k << _KEY_SHIFT) | flags | p
    for i in range(0, len(h), 65_536):
        j = slice(i, i + 65_536)
        yield pa.RecordBatch.from_arrays([pa.array(key[j]), pa.array(d[j]), pa.array(at[j])], names=["hash", "doc_id", "at"])


def _windows(batches: Iterator[pa.RecordBatch], find: Callable[[np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Emit what ``find(word hashes, seeds)`` returns for each text: hashes of windows and their places."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    held = 0
    for batch in batches:
        valid = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        ids = batch.column(0).fill_null(0).to_numpy()
        keys = batch.column(1).to_numpy()
        for lo, hi in slices(batch.column(2)):
            hashes, first = word_hashes(batch.column(2).slice(lo, hi - lo))
            for i in range(lo, hi):
                if not valid[i]:
                    continue
                seeds = None
                if batch.num_columns > 3:
                    if not batch.column(3)[i].is_valid:
                        continue
                    seeds = batch.column(3)[i].values.to_numpy()
                found, at = find(hashes[first[i - lo] : first[i - lo + 1]], seeds)
                if len(at):
                    for x, y in zip(out, (found, np.full(len(at), ids[i]), np.full(len(at), keys[i]), at), strict=True):
                        x.append(y)
                    held += len(at)
                if held >= _HELD:
                    yield from _emit(*out)
                    out, held = ([], [], [], []), 0
    yield from _emit(*out)


def _first_level(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    short, whole = levels(window)

    def find(words: np.ndarray, _: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        own = windows(words, short)
        at = np.unique(minimizers(own, whole - short + 1))
        found, one = np.unique(own[at], return_index=True)  # one place of each: a document repeats itself freely
        one.sort()
        return own[at[one]], at[one]

    return _windows(batches, find)


def _second_level(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    short, whole = levels(window)

    def find(words: np.ndarray, seeds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        own = windows(words, short)
        live = np.isin(own, own[seeds])  # a seed stands for every place of its hash in this document
        at = np.flatnonzero(live[minimizers(own, whole - short + 1)])
        return windows(words, whole)[at], at

    return _windows(batches, find)


def _without(batches: Iterator[pa.RecordBatch], window: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column(2)):
            part = batch.slice(lo, hi - lo)
            data, starts, ends, first = split(part.column(2))
            covered = np.zeros(len(starts) + 1, dtype=np.int64)
            for i in range(hi - lo):
                n = int(first[i + 1] - first[i])
                if part.column(3)[i].as_py() and n >= window:  # the words of a smaller id, in the same order
                    covered[first[i]] += 1
                    covered[first[i + 1]] -= 1
                elif part.column(4)[i].is_valid:
                    at = first[i] + np.unique(part.column(4)[i].values.to_numpy())
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + window, -1)
            keep = np.cumsum(covered)[:-1] == 0
            kept_first = np.concatenate([[0], np.cumsum(keep)])[first]
            flags = np.zeros(len(data) + 1, dtype=np.int8)
            np.add.at(flags, starts[keep], 1)
            np.add.at(flags, ends[keep], -1)
            flags = np.cumsum(flags)[:-1].astype(bool)
            # One separator behind each kept word but the last of a text.
            last = np.zeros(int(keep.sum()), dtype=bool)
            last[kept_first[1:][kept_first[1:] > kept_first[:-1]] - 1] = True
            gaps = ends[keep][~last]
            flags[gaps] = True
            data = data.copy()
            data[gaps] = 0x20
            size = np.concatenate([[0], np.cumsum(flags)])
            body = data[flags].tobytes()
            bounds = np.append(starts, len(data))[np.minimum(first, len(starts))]
            texts = [body[size[bounds[i]] : size[bounds[i + 1]]] for i in range(hi - lo)]
            kept = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()) if digest else pa.array(texts, pa.binary()).cast(pa.string())
            n_words, n_kept = np.diff(first), np.diff(kept_first)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n_words), pa.array(n_words - n_kept), kept], names=["doc_id", "text_key", "n_words", "n_removed", "kept_text"]
            )


def _repeated(hits: DataFrame) -> DataFrame:
    """Adds ``least`` and ``most``, smallest and largest document under a hash, and the parts of ``at``. A hash has about as many rows as
    pre-aggregated lots of documents."""
    same = Window.partitionBy("hash")
    return hits.select(
        "doc_id", F.min("doc_id").over(same).alias("least"), F.max("doc_id").over(same).alias("most"),
        F.shiftright("at", _KEY_SHIFT).alias("text_key"), F.col("at").bitwiseAND(F.lit(_KNOWN - 1)).cast("int").alias("place"),
        (F.col("at").bitwiseAND(F.lit(_KNOWN)) != 0).alias("known"), (F.col("at").bitwiseAND(F.lit(_FOLLOWED)) != 0).alias("followed"),
    )


def _text_key(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit((1 << _KEY_BITS) - 1))


def without_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, text_key, n_words, n_removed, kept_text`` (its sha-256 with ``digest``)."""
    texts = docs.select(docs[doc_id].cast("long").alias("doc_id"), _text_key(docs[text]).alias("text_key"), docs[text].alias("text"))
    on = ["doc_id", "text_key"]

    classes = store(texts.mapInArrow(_classes, _CLASSES), "repeats-classes").where(F.col("n_words") >= window).where("doc_id is not null")
    first = classes.groupBy("s1", "s2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("s1", "s2", "first")
    copies = store(classes.join(first, ["s1", "s2"]).where("doc_id > first").select(*on, F.lit(True).alias("copy")).distinct(), "repeats-copies")

    hits = texts.mapInArrow(partial(_first_level, window=window), _HITS)
    seeds = (
        _repeated(hits).where("known or followed or least < most")
        .groupBy(*on).agg(F.collect_list("place").alias("seeds"))
        .join(copies, on, "left_anti")
    )
    seeds = store(seeds, "repeats-seeds")

    open_texts = texts.join(seeds, on, "left").select("doc_id", "text_key", "text", "seeds")
    hits = open_texts.mapInArrow(partial(_second_level, window=window), _HITS)
    repeats = _repeated(hits).where("known or doc_id > least").groupBy(*on).agg(F.collect_list("place").alias("places"))
    marks = repeats.join(copies, on, "full")
    return texts.join(marks, on, "left").select("doc_id", "text_key", "text", "copy", "places").mapInArrow(
        partial(_without, window=window, digest=digest), _REST.format(kind="string")
    )


def op3_substring_dedup(docs: DataFrame) -> DataFrame:
    return without_repeats(docs, digest=True).select("doc_id", "n_words", "n_removed", F.col("kept_text").alias("kept_sha256"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``. A text without repeats is unchanged, one of which nothing is left goes."""
    rest = without_repeats(docs).where("n_removed > 0").select("doc_id", "text_key", "n_words", "n_removed", "kept_text").distinct()
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), _text_key(docs["text"]).alias("text_key"))
    joined = rows.join(rest, ["doc_id", "text_key"], "left").where("n_removed is null or n_removed < n_words")
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.coalesce("kept_text", "row.text")}
    if "n_chars" in docs.columns:
        cut = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.when(F.col("kept_text").isNull(), F.col("row.n_chars")).otherwise(cut)
    return joined.select(*[c.alias(n) for n, c in out.items()])


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), f AS (
  SELECT win, min(doc_id) AS first FROM g GROUP BY win
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (win) WHERE g.doc_id > f.first
), k AS (
  SELECT p.doc_id, count(*) FILTER (WHERE c.i IS NOT NULL) AS n_removed,
         string_agg(word, ' ' ORDER BY p.i) FILTER (WHERE c.i IS NULL) AS kept
  FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w WHERE len(ws) > 0) p
  LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i GROUP BY p.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
