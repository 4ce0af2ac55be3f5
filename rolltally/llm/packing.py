"""Best-fit packing with a grouping genetic algorithm on islands.

Documents become pieces of at most 2048 tokens (only longer documents are cut, their first piece may be shorter). Pieces are dealt into blocks of about
a thousand; each block is evolved on several islands, which are rows that Spark spreads over the cluster. An individual assigns pieces to
sequences. Crossover injects whole well-filled sequences of one parent into the other, removes the other's sequences that hold the
same pieces, and best-fits the displaced pieces, longest first. After every epoch the best individual of each island migrates to the next island of its block
through an exchange; at the end the block's best individual wins. Then the sequences of all blocks that are not quite full are opened, their pieces dealt into new blocks,
fewer and of another mixture, and evolved again, as long as that takes fewer sequences.

Token ids are those of the byte-level BPE file: texts of characters below U+0250 go through the same vocabulary and pattern in a faster encoder, all others through
the reference tokenizer itself (the tests compare both).

Defined cases: a null text is an empty one (a single id 0); repeated rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolltally.llm.store import store

CAPACITY = 2048
END = 0
BLOCK_PIECES = 1024
ISLANDS = 3
EPOCHS = 3
POPULATION = 4
CHILDREN = 6
#: A sequence filled to this share is passed on whole.
WELL_FILLED = 0.97
#: Sequences filled to less than this share are opened again when all blocks are packed.
OPEN = 0.9995
PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]

_PLAIN = re.compile(r"[^\t\n\r -~\xa0-ɏ]")


@cache
def _encoders(path: str):
    """The reference tokenizer, and an encoder with the same ranks and pattern; both are loaded once per worker."""
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = True
    # The file spells each byte as a printable character: printable bytes as themselves, the others from U+0100 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    special = {t["content"] for t in json.load(open(path, encoding="utf-8")).get("added_tokens", [])}
    ranks = {bytes(spelled[c] for c in token): i for token, i in exact.get_vocab().items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return exact, fast


def token_ids(text: str, path: str) -> list[int]:
    exact, fast = _encoders(path)
    return exact.encode(text, add_special_tokens=False).ids if _PLAIN.search(text) else fast.encode_ordinary(text)


def cuts(count: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece of ``count`` tokens."""
    first = count % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, count, capacity)]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            rows = []
            for doc, text in zip(part.column(0), part.column(1), strict=True):
                ids = np.array(token_ids(text.as_py() or "", path) + [END], dtype="<u4")
                for n, (start, length) in enumerate(cuts(len(ids), capacity)):
                    rows.append((doc.as_py(), n, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit(lengths: np.ndarray, items: np.ndarray, bins: np.ndarray, free: list[tuple[int, int]], fresh: int, capacity: int) -> int:
    """Put ``items``, in their order, into the fullest sequence that still takes them; ``free`` is sorted (room, sequence). Returns the next unused number."""
    size = lengths.tolist()
    for i in items.tolist():
        need = size[i]
        at = bisect_left(free, (need, -1))
        if at < len(free):
            room, number = free.pop(at)
        else:
            room, number = capacity, fresh
            fresh += 1
        bins[i] = number
        if room > need:
            insort(free, (room - need, number))
    return fresh


def packed(lengths: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    bins = np.full(len(lengths), -1, dtype=np.int32)
    best_fit(lengths, order, bins, [], 0, capacity)
    return bins


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then the larger mean square of their filling."""
    fill = np.bincount(bins, weights=lengths) / capacity
    used = np.count_nonzero(fill)
    return -used, float((fill**2).sum() / max(1, used))


def crossover(lengths: np.ndarray, mother: np.ndarray, father: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fill = np.bincount(father, weights=lengths)
    good = (fill >= WELL_FILLED * capacity) & (rng.random(len(fill)) < 0.5)
    injected = good[father]
    hit = np.zeros(mother.max() + 1, dtype=bool)
    hit[mother[injected]] = True
    # A few of the mother's worst sequences are opened, too.
    own = np.bincount(mother, weights=lengths)
    loose = (own > 0) & (own < WELL_FILLED * capacity) & (rng.random(len(own)) < 0.5)
    moved = (hit | loose)[mother] & ~injected
    child = np.where(injected, father + len(hit), mother).astype(np.int32)
    rest = np.bincount(mother[~moved & ~injected], weights=lengths[~moved & ~injected], minlength=len(hit)).astype(np.int64)
    free = sorted((int(capacity - rest[b]), int(b)) for b in np.flatnonzero((rest > 0) & (rest < capacity)))
    filled = np.flatnonzero(good)
    free = sorted(free + [(int(capacity - fill[b]), int(b) + len(hit)) for b in filled if fill[b] < capacity])
    displaced = np.flatnonzero(moved)
    best_fit(lengths, displaced[np.argsort(-lengths[displaced] + rng.random(len(displaced)) * 0.5, kind="stable")], child, free, len(hit) + len(fill), capacity)
    return np.unique(child, return_inverse=True)[1].astype(np.int32)


def evolve(lengths: np.ndarray, population: list[np.ndarray], children: int, capacity: int, rng: np.random.Generator) -> list[np.ndarray]:
    """A population after some births, best individual first. An empty one is founded by best fit in falling and in disturbed orders."""
    if not population:
        population = [packed(lengths, np.argsort(-lengths, kind="stable"), capacity)]
        for spread in np.linspace(0.1, 1.0, POPULATION - 1):
            population.append(packed(lengths, np.argsort(-lengths * (1 + spread * (rng.random(len(lengths)) - 0.5)), kind="stable"), capacity))
    scored = sorted(((fitness(lengths, p, capacity), -i, p) for i, p in enumerate(population)), key=lambda x: x[:2], reverse=True)[:POPULATION]
    least = -(-int(lengths.sum()) // capacity)
    for birth in range(children):
        if -scored[0][0][0] <= least:
            break
        a, b = rng.choice(len(scored), 2, replace=False) if len(scored) > 1 else (0, 0)
        child = crossover(lengths, scored[a][2], scored[b][2], capacity, rng)
        scored.append((fitness(lengths, child, capacity), -POPULATION - birth, child))
        scored.sort(key=lambda x: x[:2], reverse=True)
        scored = scored[:POPULATION]
    return [p for *_, p in scored]


_ISLAND = "block long, island int, lengths array<int>, population array<array<int>>, best array<int>, sequences int, filling double"


def _evolved(batches: Iterator[pa.RecordBatch], epoch: int, capacity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            lengths = np.array(row["lengths"], dtype=np.int64)
            population = [np.array(p, dtype=np.int32) for p in (row["population"] or [])]
            if row["guest"] is not None:
                population.append(np.array(row["guest"], dtype=np.int32))
            rng = np.random.default_rng([epoch, row["island"], row["block"]])
            population = evolve(lengths, population, CHILDREN, capacity, rng)
            used, filling = fitness(lengths, population[0], capacity)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["block"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([row["lengths"]], pa.list_(pa.int32())),
                    pa.array([[p.tolist() for p in population]], pa.list_(pa.list_(pa.int32()))), pa.array([population[0].tolist()], pa.list_(pa.int32())),
                    pa.array([-used], pa.int32()), pa.array([filling], pa.float64()),
                ],
                names=["block", "island", "lengths", "population", "best", "sequences", "filling"],
            )


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their best individual -> one row per piece, with sequence and offset."""
    for batch in batches:
        for i in range(batch.num_rows):
            block = batch.column(0)[i].as_py()
            items = batch.column(1)[i].values
            bins = batch.column(2)[i].values.to_numpy()
            length = items.field("length").to_numpy()
            order = np.argsort(bins, kind="stable")
            sums = np.cumsum(length[order]) - length[order]
            first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
            offset = np.empty(len(bins), dtype=np.int64)
            offset[order] = sums - sums[first][np.cumsum(first) - 1]
            yield pa.RecordBatch.from_arrays(
                [items.field("doc_id"), items.field("piece"), items.field("start"), items.field("length"), items.field("ids_crc32"), pa.array(block * (1 << 20) + bins.astype(np.int64)), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece. ``tokenizer`` is the path of a tokenizer file."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    pieces = store(source.mapInArrow(partial(_pieces, path=tokenizer, capacity=capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    placed, blocks = in_blocks(pieces, capacity, 0)
    while True:
        fill = placed.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
        loose = store(fill.where(F.col("fill") < OPEN * capacity), "packing-open")
        count, tokens = loose.agg(F.count(F.lit(1)), F.coalesce(F.sum("fill"), F.lit(0))).first()
        if count <= -(-tokens // capacity):
            return placed
        again, more = in_blocks(placed.join(loose, "sequence_id", "left_semi").select(*PIECE), capacity, blocks)
        if again.select("sequence_id").distinct().count() >= count:
            return placed
        blocks += more
        placed = store(placed.join(loose, "sequence_id", "left_anti").select(again.columns).unionByName(again), "packing-placed")


def in_blocks(pieces: DataFrame, capacity: int, number: int) -> tuple[DataFrame, int]:
    """Pieces with sequence and offset, packed in blocks of about ``BLOCK_PIECES`` that are numbered from ``number``, and how many blocks there are."""
    blocks = max(1, -(-pieces.count() // BLOCK_PIECES))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(*PIECE, F.lit(number)), F.lit(blocks)).cast("long") + number)
    items = F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("by"), *PIECE)))
    dealt = store(dealt.groupBy("block").agg(items.alias("items")), "packing-blocks")

    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    island = dealt.select(
        "block", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), F.transform("items", lambda x: x["length"].cast("int")).alias("lengths"),
        F.lit(None).cast("array<array<int>>").alias("population"), F.lit(None).cast("array<int>").alias("guest"),
    )
    for epoch in range(EPOCHS):
        grown = store(island.repartition(tasks, "block", "island").mapInArrow(partial(_evolved, epoch=epoch, capacity=capacity), _ISLAND), "packing-epoch")
        elite = grown.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("best").alias("guest"))
        island = grown.join(elite, ["block", "island"]).select("block", "island", "lengths", "population", "guest")
    best = grown.groupBy("block").agg(F.min_by("best", F.struct("sequences", -F.col("filling"), "island")).alias("best"))
    rows = dealt.join(best, "block").select("block", "items", "best").repartition(tasks, "block").mapInArrow(
        _placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return store(rows, "packing-placed"), blocks


def op6_packing(docs: DataFrame) -> DataFrame:
    return pack(docs)
