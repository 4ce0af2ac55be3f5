"""Periodic run detection: scale-tiled, with Z-functions at tile boundaries.

A run of period q is a stretch of words that equal the word q places on; ``match positions`` of period q are the places where that holds. A run of at least
max(24, 3q) words has at least max(17, 2q) match positions, so the octave of its period, q in [2**k, 2**(k + 1)), finds one of its boundaries (multiples of W = max(8,
2**k)) with the W places after it inside the run. So a document is exploded, octave by octave, into overlapping tiles of about 5 W words around the boundaries; window hashes doubled from
octave to octave skip the tiles whose boundary window comes back at no period of the octave. Each tile is solved alone: the Z-function of what follows the boundary and that of
the reversed words before it give, for every period of the octave at once, how far the match reaches. These intervals are shuffled by (document, period), stitched where they touch, and those long enough
are runs; of equal stretches the smallest period counts, since the others are its multiples (Fine and Wilf). Hashes only skip; words are compared by exact codes.

Work is O(n log n) for n words. Documents travel through one exchange only if they have a tile; tiles go through none.

Defined cases: a null or empty text has no words and no runs (nulls, digests of the empty text); a null doc_id is never damaged; repeated rows are solved each; of runs
of equal exponent the first, then the smaller period is the best; long texts are coded in stretches and tiled as all others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolltally.llm.store import store
from rolltally.llm.words import mixed, slices

#: A run has at least LEAST words and EXPONENT periods.
LEAST = 24
EXPONENT = 3
_WINDOW_BITS = 3  # windows of 8 words are the shortest that are looked for
_STRETCH = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class _Codes(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def _stretches(text: bytes) -> Iterator[list[bytes]]:
    """Words of ``text``, some megabytes at a time: ``bytes.split`` knows just the six separators."""
    at = 0
    while at < len(text):
        end = _SPACE.search(text, at + _STRETCH)
        stop = end.start() if end else len(text)
        yield text[at:stop].split()
        at = stop


def _coded(text: bytes, codes: _Codes) -> np.ndarray:
    parts = [np.fromiter(map(codes.__getitem__, words), np.int32, len(words)) for words in _stretches(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32)


def damage(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The contract's damage: (a, p) if from word ``a`` on the ``p`` words there repeat, else null."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _source(n: int, how: tuple[int, int] | None) -> np.ndarray:
    """Which original word stands at each place."""
    at = np.arange(n)
    if how is not None:
        a, p = how
        at[a:] = a + (at[a:] - a) % p
    return at


def z_function(s: list[int]) -> list[int]:
    """Length of the longest common prefix of ``s`` and each of its suffixes (0 for ``s`` itself)."""
    n, z = len(s), [0] * len(s)
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve_tile(words: list[int], at: int, octave: int) -> list[tuple[int, int, int]]:
    """(period, first, end) of the match positions around the boundary ``at`` of a tile, for each period of the octave that holds over the boundary's window."""
    low = 1 << octave
    window = max(1 << _WINDOW_BITS, low)
    ahead = z_function(words[at:])
    periods = [q for q in range(low, min(2 * low, len(ahead))) if ahead[q] >= window]
    if not periods:
        return []
    reach = periods[-1]
    turned = words[: at + reach][::-1]
    behind = z_function(turned[reach:] + [-1] + turned)
    return [(q, at - behind[at + 1 + reach - q], at + ahead[q]) for q in periods]


def tile_boundaries(lengths: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of documents with these numbers of words, one after the other in ``codes``: (octave, document, boundary, its document's first word) of the tiles that can hold a run. Places count in ``codes``."""
    docs = np.flatnonzero(lengths >= LEAST)
    first = np.cumsum(lengths) - lengths
    shape = None
    octave = 0
    while True:
        docs = docs[lengths[docs] >= max(LEAST, EXPONENT << octave)]
        if not len(docs):
            return
        window = max(1 << _WINDOW_BITS, 1 << octave)
        if shape is None or lengths[docs].sum() < 0.7 * len(place):  # long documents alone go on
            place = np.concatenate([np.arange(first[d], first[d] + lengths[d]) for d in docs])
            stop = np.repeat(np.cumsum(lengths[docs]), lengths[docs])
            owner = np.repeat(docs, lengths[docs])
            seed = mixed(codes[place].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            shape, size = seed, 1
        while size < window:  # hash of the next ``size`` words of each place
            after = np.zeros_like(shape)
            after[:-size] = shape[size:]
            shape = mixed(shape * np.uint64(0xD1342543DE82EF95) + after)
            size *= 2
        n, low = len(shape), 1 << octave
        count = -(-n // window)
        head = shape[::window]
        found_at, found_q = [], []
        if low < window:
            for q in range(low, 2 * low):
                other = shape[q::window]
                hit = np.flatnonzero(head[: len(other)] == other) * window
                found_at.append(hit)
                found_q.append(np.full(len(hit), q))
        else:
            later = np.zeros((count + 1) * window, dtype=shape.dtype)
            later[: n] = shape
            row, col = np.nonzero(later[window:].reshape(count, window) == head[:, None])
            found_at.append(row * window)
            found_q.append(col + low)
        at, q = np.concatenate(found_at), np.concatenate(found_q)
        at = np.unique(at[at + q + window <= stop[at]])
        if len(at):
            yield octave, owner[at], place[at], first[owner[at]]
        octave += 1


_TILED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("digest", pa.string()), ("text", pa.binary()),
     ("octave", pa.int32()), ("at", pa.int64()), ("begin", pa.int64()), ("words", pa.list_(pa.int32()))]
)
_TILED_DDL = "row long, doc_id long, n_words long, digest string, text binary, octave int, at long, begin long, words array<int>"
_NO_WORDS = hashlib.sha256().hexdigest()


def _tiled(batches: Iterator[pa.RecordBatch], damaged: bool) -> Iterator[pa.RecordBatch]:
    """``row, doc_id, text`` -> a row per document (``octave`` null, the text of those with tiles) and a row per tile."""
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for lo, hi in slices(batch.column(2).fill_null("")):
            codes, parts, hows = _Codes(), [], []
            ids = batch.column(1).slice(lo, hi - lo).to_pylist()
            raw = [t or b"" for t in texts.slice(lo, hi - lo).to_pylist()]
            for doc_id, text in zip(ids, raw, strict=True):
                part = _coded(text, codes)
                hows.append(damage(doc_id, len(part)) if damaged else None)
                parts.append(part if hows[-1] is None else part[_source(len(part), hows[-1])])
            rows = batch.column(0).slice(lo, hi - lo).to_numpy()
            lengths = np.array([len(p) for p in parts], dtype=np.int64)
            flat = np.concatenate(parts)
            tiled = np.zeros(len(raw), dtype=bool)
            for octave, doc, at, first in tile_boundaries(lengths, flat):
                tiled[doc] = True
                window = max(1 << _WINDOW_BITS, 1 << octave)
                begin = np.maximum(at - window, first)
                end = np.minimum(at + 2 * window + (2 << octave), first + lengths[doc])
                for some in np.array_split(np.arange(len(at)), -(-len(at) * 5 * window // (1 << 20))):
                    words = pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(end[some] - begin[some])]), pa.int32()),
                        pa.array(np.concatenate([flat[b:e] for b, e in zip(begin[some], end[some], strict=True)]), pa.int32()),
                    )
                    none = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[doc[some]], pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.string()), pa.nulls(none, pa.binary()),
                         pa.array(np.full(none, octave), pa.int32()), pa.array(at[some] - first[some], pa.int64()), pa.array(begin[some] - first[some], pa.int64()), words],
                        schema=_TILED,
                    )
            # Documents with tiles are digested with their runs.
            digests = [None if t else _digest(text, how) for t, text, how in zip(tiled.tolist(), raw, hows, strict=True)]
            n = len(raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column(1).slice(lo, n), pa.array(lengths), pa.array(digests, pa.string()),
                 pa.array([text if t else None for t, text in zip(tiled.tolist(), raw, strict=True)], pa.binary()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32()))],
                schema=_TILED,
            )


def _digest(text: bytes, how: tuple[int, int] | None) -> str:
    if how is not None:
        return hashlib.sha256(b" ".join(_words(text, how))).hexdigest()
    out, fresh = hashlib.sha256(), True
    for words in _stretches(text):
        if words:
            out.update(b" ".join(words) if fresh else b" " + b" ".join(words))
            fresh = False
    return out.hexdigest()


def _words(text: bytes, how: tuple[int, int] | None) -> list[bytes]:
    words = [w for some in _stretches(text) for w in some]
    if how is not None:
        a, p = how
        cycle = words[a : a + p]
        words[a:] = [cycle[i % p] for i in range(len(words) - a)]
    return words


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles -> match positions ``row, period, begin, end``; touching ones of neighbouring tiles are joined before they travel."""
    schema = pa.schema([("row", pa.int64()), ("period", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        held: dict[tuple[int, int], tuple[int, int]] = {}
        out: list[tuple[int, int, int, int]] = []
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("row", "octave", "at", "begin", "words")]
        for row, octave, at, begin, words in zip(*columns, strict=True):
            row, begin = row.as_py(), begin.as_py()
            for q, lo, hi in solve_tile(words.values.to_pylist(), at.as_py() - begin, octave.as_py()):
                lo, hi = lo + begin, hi + begin
                have = held.get((row, q))
                if have and lo <= have[1] and have[0] <= hi:
                    lo, hi = min(lo, have[0]), max(hi, have[1])
                elif have:
                    out.append((row, q, *have))
                held[row, q] = lo, hi
        out += [(*k, *v) for k, v in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], schema=schema)


def tiles(docs: DataFrame, damaged: bool = False) -> DataFrame:
    """Documents (``octave`` null) and their tiles, written to the shared folder; ``row`` tells repeated rows apart."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return store(rows.mapInArrow(partial(_tiled, damaged=damaged), _TILED_DDL), "run-tiles")


def stitched(tiled: DataFrame) -> DataFrame:
    """``row, runs``: the runs of each document that has any, as (start, length, period) by start, then period."""
    pieces = tiled.where("octave is not null").select("row", "octave", "at", "begin", "words").mapInArrow(_solved, "row long, period long, begin long, end long")
    along = Window.partitionBy("row", "period").orderBy("begin", "end")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = pieces.withColumn("fresh", F.when(F.col("begin") <= reached, 0).otherwise(1))
    whole = fresh.withColumn("stretch", F.sum("fresh").over(along)).groupBy("row", "period", "stretch").agg(F.min("begin").alias("start"), F.max("end").alias("end"))
    long = whole.select("row", "period", "start", (F.col("end") - F.col("start") + F.col("period")).alias("length"))
    long = long.where(F.col("length") >= F.greatest(F.lit(LEAST), EXPONENT * F.col("period")))
    runs = long.groupBy("row", "start", "length").agg(F.min("period").alias("period"))
    return runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


_FOUND_DDL = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start:bigint,length:bigint,period:bigint>>, kept string"
)
_FOUND = pa.schema(
    [("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
     ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("kept", pa.string())]
)


def _found(batches: Iterator[pa.RecordBatch], damaged: bool, texts: bool) -> Iterator[pa.RecordBatch]:
    """``doc_id, n_words, digest, text, runs`` -> result rows; ``kept``: the text without what repeats, where it was asked for."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            out = []
            for r in batch.slice(lo, 256).to_pylist():
                runs = [(x["start"], x["length"], x["period"]) for x in r["runs"] or []]
                row = {"doc_id": r["doc_id"], "n_runs": len(runs), "runs_sha256": hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()}
                if runs:
                    start, length, period = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
                    row |= {"start": start, "length": length, "period": period, "exponent_milli": 1000 * length // period}
                if r["text"] is None:
                    row["collapsed_sha256"] = r["digest"]
                else:
                    words = _words(r["text"], damage(r["doc_id"], r["n_words"]) if damaged else None)
                    keep = np.ones(len(words), dtype=bool)
                    for s, n, q in runs:
                        keep[s + q : s + n] = False
                    kept = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
                    row["collapsed_sha256"] = hashlib.sha256(kept).hexdigest()
                    row["kept"] = kept.decode() if texts else None
                row["runs"] = [{"start": s, "length": n, "period": q} for s, n, q in runs]
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=_FOUND)


def find_runs(docs: DataFrame, damaged: bool = False, texts: bool = False) -> DataFrame:
    """One row per document with all its ``runs``, the best one and the digests; ``kept``, if ``texts``, is the collapsed text of a document that has tiles (null: nothing to collapse)."""
    tiled = tiles(docs, damaged)
    whole = tiled.where("octave is null").select("row", "doc_id", "n_words", "digest", "text")
    joined = whole.join(stitched(tiled), "row", "left").select("doc_id", "n_words", "digest", "text", "runs")
    return joined.mapInArrow(partial(_found, damaged=damaged, texts=texts), _FOUND_DDL)


def op12_runs(docs: DataFrame) -> DataFrame:
    """Contract query: damaged documents, digests of their runs and of what stays."""
    return find_runs(docs, damaged=True).drop("runs", "kept")
