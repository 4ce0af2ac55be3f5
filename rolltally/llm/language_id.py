"""Language ID by rank-order profiles: out-of-place distance between a document's most frequent n-grams and each language's.

A profile is the ranking of the most frequent n-grams (1 to 3 letters, words padded by a blank) of a language's training texts. For a document each of its
own top n-grams costs the difference of the two ranks, or the profile's length if the profile lacks it; the language of the smallest sum wins.

Profiles are fitted on a hash sample of the labelled texts, about ``fit_documents`` per language at most, whatever the input's size.
Every text is read whole: n-grams are counted in stretches, so memory is bounded for very long ones.

Defined cases: a null text or one without letters, or no labelled text at all, gives ``und`` with score 0; equal distances go to the smaller language
name, equal counts to the smaller n-gram; repeated rows are predicted each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
TOP = 300
ORDERS = 3
#: Labelled documents per language from which profiles are fitted, on average.
FIT_DOCUMENTS = 4000
#: Documents less like the best profile than this (0 to 1) are in none of the languages.
LEAST_SCORE = 0.1
_STRETCH = 1 << 18


def _numerals() -> str:
    """Characters that ``re`` counts as parts of words though they are neither letters nor decimal digits (½, ², ①), as ranges of a class."""
    odd = [c for c in range(0x80, 0x110000) if chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal()]
    firsts = [c for c, before in zip(odd, [-1, *odd]) if c != before + 1]
    lasts = [c for c, after in zip(odd, [*odd[1:], -1]) if after != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(firsts, lasts, strict=True))


_LETTERS = re.compile(rf"[^\W\d_{_numerals()}]+")
_BITS = np.uint64(21)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 1:
        return keys[0], counts[0]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the lower-cased letters of ``text`` (code points packed into a long) and their counts."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, size = 0, len(text or "")
    while at < size:
        end = min(size, at + _STRETCH)
        while end < size and text[end].isalpha() and end < at + 2 * _STRETCH:
            end += 1
        words = _LETTERS.findall(text[at:end].lower())
        at = end
        if not words:
            continue
        code = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        blank = code == 32
        gram, found = code, [code[~blank]]
        for n in range(2, ORDERS + 1):
            gram = (gram[:-1] << _BITS) | code[n - 1 :]
            inner = np.zeros(len(gram), dtype=bool)  # a blank stands at the edge of an n-gram only
            for j in range(1, n - 1):
                inner |= blank[j : j + len(gram)]
            found.append(gram[~inner])
        distinct, count = np.unique(np.concatenate(found).view(np.int64), return_counts=True)
        keys.append(distinct)
        counts.append(count)
        if len(keys) > 16:
            merged = _merged(keys, counts)
            keys, counts = [merged[0]], [merged[1]]
    return _merged(keys[1:], counts[1:]) if len(keys) == 2 else _merged(keys, counts)


def ranking(keys: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The ``top`` most frequent n-grams, most frequent first."""
    if len(keys) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        chosen = counts >= least
        keys, counts = keys[chosen], counts[chosen]
    return keys[np.lexsort((keys, -counts))][:top]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, text`` -> counts of n-grams, summed over a lot of texts."""
    held: dict[str, tuple[list, list, int]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (keys, counts, _) in sorted(held.items()):
            k, c = _merged(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(c.astype(np.int64))], names=["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            k, c = ngrams(text.as_py())
            keys, counts, n = held.setdefault(lang.as_py(), ([], [], 0))
            keys.append(k)
            counts.append(c)
            if len(keys) > 256:
                m = _merged(keys, counts)
                keys[:], counts[:] = [m[0]], [m[1]]
    yield from rows()


def fit(labelled: DataFrame, fit_documents: int = FIT_DOCUMENTS, top: int = TOP) -> dict[str, list[int]]:
    """``doc_id, lang, text`` of labelled documents -> each language's n-grams by falling frequency. ``top`` longs per language come to the driver."""
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 40)) / float(1 << 40)
    sample = labelled.join(F.broadcast(sizes), "lang").where(chance * F.col("docs") < fit_documents).select("lang", "text")
    sums = sample.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    ranked = sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    out: dict[str, list[int]] = {}
    for row in sorted(ranked.select("lang", "rank", "gram").collect()):
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


def distances(own: np.ndarray, profiles: np.ndarray, order: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Out-of-place distance of one document's ranking to each profile. ``profiles`` are all profile n-grams in ascending
    order, ``ranks`` (n-gram, language) their ranks, with the profile length where a language lacks one."""
    at = np.minimum(np.searchsorted(profiles, own), len(profiles) - 1)
    known = profiles[at] == own
    cost = np.full((len(own), ranks.shape[1]), TOP, dtype=np.int64)
    found = ranks[at[known]]
    cost[known] = np.where(found < TOP, np.abs(found - order[: len(own)][known][:, None]), TOP)
    return cost.sum(axis=0)


def _predicted(batches: Iterator[pa.RecordBatch], fitted: dict[str, list[int]]) -> Iterator[pa.RecordBatch]:
    langs = sorted(fitted)
    profiles = np.unique(np.array([g for lang in langs for g in fitted[lang]], dtype=np.int64)) if langs else np.zeros(1, np.int64)
    ranks = np.full((len(profiles), len(langs)), TOP, dtype=np.int64)
    for j, lang in enumerate(langs):
        ranks[np.searchsorted(profiles, np.array(fitted[lang], dtype=np.int64)), j] = np.arange(len(fitted[lang]))
    order = np.arange(TOP)
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            names, scores = [], []
            for text in part.column(2):
                own = ranking(*ngrams(text.as_py()))
                if not len(own) or not langs:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                far = distances(own, profiles, order, ranks)
                best = int(far.argmin())
                names.append(langs[best])
                scores.append(float(1 - far[best] / (TOP * len(own))))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def predict(docs: DataFrame, fitted: dict[str, list[int]]) -> DataFrame:
    """``doc_id, held_out, text`` -> ``doc_id, held_out, lang_pred, score``."""
    return docs.select("doc_id", "held_out", "text").mapInArrow(partial(_predicted, fitted=fitted), "doc_id long, held_out boolean, lang_pred string, score double")


def held_out() -> Column:
    """Rows that no profile is fitted on; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training(rows: DataFrame) -> DataFrame:
    return rows.where(~held_out()).where("lang is not null and text is not null").select("doc_id", "lang", "text")


def identify(docs: DataFrame) -> DataFrame:
    """Predict every row of ``docs``; profiles come from rows with a language whose crc32(doc_id) mod 3 is not 1."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang"))
    return predict(rows.withColumn("held_out", held_out()), fit(training(rows)))


def op1_language(docs: DataFrame) -> DataFrame:
    return identify(docs)


def _known(batches: Iterator[pa.RecordBatch], fitted: dict[str, list[int]], least: float, column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        none = pa.nulls(batch.num_rows)
        rows = pa.RecordBatch.from_arrays([none, none, batch.column(column)], names=["doc_id", "held_out", "text"])
        said = pa.Table.from_batches(_predicted(iter([rows]), fitted))
        if said.num_rows:
            keep = [lang != UNKNOWN and score >= least for lang, score in zip(said["lang_pred"].to_pylist(), said["score"].to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep))


def in_known_language(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Rows of ``docs`` with letters whose n-grams are not foreign to every language; all columns stay as they are. Without any
    labelled text there is nothing to compare with, and every text with letters stays."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang"))
    fitted = fit(training(rows))
    if not fitted:
        return docs.where(F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False)))
    return docs.mapInArrow(partial(_known, fitted=fitted, least=least, column=docs.columns.index("text")), docs.schema)
