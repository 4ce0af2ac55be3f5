"""MinHash near-dedup by min-max hashing: of every permutation both the smallest and the largest value are kept.

64 permutations give 128 values; a band is two minima and two maxima (32 bands of 4 values, so a pair of similarity 0.75 shares
a band with probability 1 - (1 - 0.75^4)^32 = 0.999995). Links are confirmed on the full shingle sets. Within a bucket no group is
expanded into all pairs: every member is compared with the bucket's smallest id, and then only with those members of other components that known
counts don't rule out (what a set shares with the bucket's smallest id, and how many of its shingles no other set has).

Texts with equal word sequences form one class, represented by its smallest id; only representatives go on.

Defined cases: a null, empty or blank text has an empty set and links with nothing; a text of one to four words has one shingle, its whole
sequence; rows that share an id count as one document with each of their texts; a null id links with nothing (component null, not kept);
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolltally.llm.components import components
from rolltally.llm.store import store
from rolltally.llm.words import mixed, slices, windows, word_hashes

SHINGLE = 5
SIMILARITY = 75  # percent
PERMUTATIONS = 64
BANDS = 32
_PER_BAND = PERMUTATIONS // BANDS
_rng = np.random.Generator(np.random.PCG64(7))
_MULTIPLIERS = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALT = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
#: Shingles that are permuted at once, which bounds temporary arrays for very long texts.
_ROWS = 4096


def shingles(hashes: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingles of one text's word hashes."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(windows(hashes, min(n, len(hashes))) ^ np.uint64(min(n, len(hashes))))


def bands(values: np.ndarray) -> np.ndarray:
    """Band keys of a shingle set from minima and maxima under each permutation."""
    low, high = np.full(PERMUTATIONS, np.uint64(2**64 - 1)), np.zeros(PERMUTATIONS, dtype=np.uint64)
    for i in range(0, len(values), _ROWS):
        permuted = values[i : i + _ROWS, None] * _MULTIPLIERS[None, :]
        np.minimum(low, permuted.min(axis=0), out=low)
        np.maximum(high, permuted.max(axis=0), out=high)
    key = _BAND_SALT.copy()
    for part in (*low.reshape(BANDS, _PER_BAND).T, *high.reshape(BANDS, _PER_BAND).T):
        key = mixed(key ^ part)
    return key


def sequence_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a word sequence."""
    n = len(hashes)
    places = np.arange(1, n + 1, dtype=np.uint64)
    one, two = mixed(hashes ^ mixed(places)), mixed(hashes + mixed(~places))
    return int(one.sum(dtype=np.uint64).astype(np.int64)), int((two.sum(dtype=np.uint64) ^ np.uint64(n)).astype(np.int64))


_SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"
_SETS = "doc_id long, shingles array<long>"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            hashes, first = word_hashes(part.column(1), lower=True)
            count, keys, flat, ends = [], [], [], [0]
            for i in range(hi - lo):
                own = hashes[first[i] : first[i + 1]]
                values = shingles(own)
                count.append(len(values))
                keys.append(sequence_key(own))
                if len(values):
                    flat.append(bands(values).view(np.int64))
                ends.append(BANDS * len(flat))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(count, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), lists],
                names=["doc_id", "n_shingles", "s1", "s2", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            hashes, first = word_hashes(part.column(1), lower=True)
            sets = [shingles(hashes[first[i] : first[i + 1]]).view(np.int64) for i in range(hi - lo)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], names=["doc_id", "shingles"]
            )


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b`` -> with sizes of both sets and of their intersection, on the full sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select(
        "a", "b", F.size("set_a").cast("long").alias("n_a"), F.size("set_b").cast("long").alias("n_b"),
        F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("both"),
    )


def _linked(similarity: int) -> Column:
    return 100 * F.col("both") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("both"))


def _open_rows(rows: DataFrame, label: DataFrame) -> DataFrame:
    """Rows of buckets whose members still are in several components, with their component."""
    placed = rows.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    several = placed.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("band")
    return store(placed.join(several, "band"), "minhash-open")


def _may_link(similarity: int) -> Column:
    """False only if sizes and known intersections rule the similarity of sets a and b out.

    Two sets share at most the smaller of their parts within their leader's set, and outside it the smaller of the parts that
    any other set has, too.
    """
    common = F.least("common_a", "common_b") + F.least(F.expr("n_a - common_a - alone_a"), F.expr("n_b - common_b - alone_b"))
    return 100 * common >= similarity * (F.col("n_a") + F.col("n_b") - common)


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``."""
    texts = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    signed = store(texts.mapInArrow(_signed, _SIGNED), "minhash-signed")
    classes = store(signed.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "minhash-classes")
    member = store(signed.join(classes, ["s1", "s2"], "left").withColumn("bands", F.when(F.col("doc_id") == F.col("rep"), F.col("bands"))), "minhash-members")

    rows = member.where("bands is not null").select("doc_id", F.explode("bands").alias("band")).distinct()
    buckets = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("leader")).where("n > 1").select("band", "leader")
    rows = store(rows.join(buckets, "band"), "minhash-buckets")

    candidates = rows.select("doc_id").distinct()
    sets = store(texts.join(candidates, "doc_id", "left_semi").mapInArrow(_sets, _SETS), "minhash-sets")

    first = rows.where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    tested = store(_verified(first, sets), "minhash-tested")
    links = tested.where(_linked(similarity)).select("a", "b")
    label = components(links)
    shared = tested.groupBy(F.col("a").alias("leader"), F.col("b").alias("doc_id")).agg(F.max("n_b").alias("n"), F.max("both").alias("common"))
    rows = store(rows.join(shared, ["leader", "doc_id"]), "minhash-shared")

    # The rest: pairs of different components that share a bucket and may link.
    open_rows = _open_rows(rows, label)
    spread = open_rows.select("doc_id").union(open_rows.select("leader")).distinct()
    spread = sets.join(spread, "doc_id", "left_semi").select("doc_id", F.explode("shingles").alias("shingle"))
    alone = spread.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    alone = alone.groupBy("doc_id").agg(F.count(F.lit(1)).alias("alone"))
    shared = open_rows.groupBy("doc_id").agg(F.collect_set("band").alias("bands"))  # at most BANDS
    open_rows = open_rows.join(shared, "doc_id").join(alone, "doc_id", "left").withColumn("alone", F.coalesce("alone", F.lit(0).cast("long")))
    open_rows = store(open_rows, "minhash-bounds")
    x, y = (open_rows.select("band", F.col("doc_id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("label", "n", "common", "alone", "bands")]) for k in "ab")
    apart = (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b"))
    once = F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("band")  # a pair counts in one of its buckets
    # A pair that its counts rule out in that bucket is ruled out for good, so no other bucket needs to ask.
    rest = x.join(y, "band").where(apart & _may_link(similarity) & once).select("a", "b")
    more = store(_verified(rest, sets).where(_linked(similarity)).select("a", "b"), "minhash-rest")
    if not more.isEmpty():
        label = components(links.unionByName(more))

    label = label.select(F.col("id").alias("rep"), "label")
    own = F.coalesce("label", "rep", "doc_id")
    return member.join(label, "rep", "left").select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def op7_minhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


def keep_representatives(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` without those that have a near duplicate of smaller id; rows with a null id and rows that share a kept id stay."""
    gone = near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS id, doc_id AS label FROM documents
  UNION
  SELECT e.b, r.label FROM r JOIN e ON e.a = r.id WHERE r.label < e.b
), c AS (
  SELECT id, min(label) AS label FROM r GROUP BY id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.label AS component_id, d.doc_id = c.label AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
