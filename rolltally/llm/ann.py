"""Approximate nearest neighbours: a neighbour graph by NN-descent, queries by greedy search on it.

The graph starts from random-hyperplane buckets. In each round every vector's neighbours and reverse neighbours are compared with each other, if at
least one of the two is new to the list, and each vector keeps its best. Vectors are dealt into blocks of similar ones; a block gets the
lists of its vectors and every vector named there once, so vectors don't travel once per pair. A block hands on as many links per vector as a vector
can keep, so that none is lost on the way. Long reverse lists are dealt into lots anew in each round; each lot meets the forward list, and there old pairs are
compared again, since they may have been in different lots. Rounds end when hardly a link is new. A query starts at its own node and expands the best nodes
found so far, on links in both directions, until none of them is open. What is returned is scored again in double precision on the original vectors.

Equal vectors are folded and unfolded at the end: of each group only its smallest ids can be among the nearest.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows with a null id, take no part; neighbours have the query's length; fewer
candidates than asked for are all returned; ties go to the smaller id; rows that repeat an id count once per vector; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from rolltally.llm.store import store
from rolltally.llm.vectors import lists, matrix, sizes, usable

DEGREE = 36
ROUNDS = 30
#: Rounds end when a smaller share of all links is new.
SETTLED = 0.002
TABLES, BUCKET, FIRST = 3, 256, 20
#: Vectors per block; smaller ones, down to the second figure, where there would be fewer blocks than keep all cores busy.
BLOCK, LEAST_BLOCK, BLOCKS_PER_CORE = 2048, 128, 4
LOT = 128
BEAM = 128
#: Open nodes that a query expands at a time.
STEP = 24
QUERY_BLOCK = 64

_LINK = "u long, w long, d float"


def _plain(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, in single precision."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def _links(u: np.ndarray, w: np.ndarray, d: np.ndarray, most: int) -> pa.Table:
    """Distinct links, of each ``u`` the ``most`` shortest."""
    order = np.lexsort((w, d, u))
    u, w, d = u[order], w[order], d[order]
    again = np.zeros(len(u), dtype=bool)
    again[1:] = (u[1:] == u[:-1]) & (w[1:] == w[:-1])
    u, w, d = u[~again], w[~again], d[~again]
    rank = np.arange(len(u)) - np.searchsorted(u, u)
    keep = rank < most
    return pa.table({"u": u[keep], "w": w[keep], "d": d[keep].astype(np.float32)})


_EMPTY = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))


def _within(table: pa.Table, size: int) -> pa.Table:
    """Links inside one bucket."""
    ids, x = _plain(table, "id"), matrix(table.column("vector"), size).astype(np.float32)
    if len(ids) < 2:
        return _links(*_EMPTY, 1)
    d = _squared(x, x)
    np.fill_diagonal(d, np.inf)
    most = min(FIRST, len(ids) - 1)
    near = np.argpartition(d, most - 1, axis=1)[:, :most]
    return _links(np.repeat(ids, most), ids[near].reshape(-1), np.take_along_axis(d, near, axis=1).reshape(-1), most)


def _two_tables(work):
    """The two-argument function that a cogroup asks for."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left, right)

    return both


def _joined(members: pa.Table, vectors: pa.Table, size: int, degree: int) -> pa.Table:
    """One block: memberships (center, lot, member, fresh, split) and the vectors of all members with their worst kept distance."""
    ids = _plain(vectors, "id")
    by_id = np.argsort(ids)
    ids = ids[by_id]
    x = matrix(vectors.column("vector"), size).astype(np.float32)[by_id]
    worst = _plain(vectors, "worst")[by_id].astype(np.float32)
    at = np.searchsorted(ids, _plain(members, "member"))
    center, lot, fresh = _plain(members, "center"), _plain(members, "lot"), _plain(members, "fresh").astype(bool)
    split = _plain(members, "split").astype(bool)
    order = np.lexsort((~fresh, at, lot, center))
    at, center, lot, fresh, split = at[order], center[order], lot[order], fresh[order], split[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (center[1:] != center[:-1]) | (lot[1:] != lot[:-1])
    bounds = np.append(np.flatnonzero(new), len(at))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if not (split[lo] or fresh[lo:hi].any()):
            continue
        m, one = np.unique(at[lo:hi], return_index=True)
        if len(m) < 2:
            continue
        old = np.flatnonzero(~fresh[lo:hi][one])
        d = _squared(x[m], x[m])
        np.fill_diagonal(d, np.inf)
        if not split[lo]:
            d[old[:, None], old[None, :]] = np.inf  # met before
        most = min(degree, len(m) - 1)
        near = np.argpartition(d, most - 1, axis=1)[:, :most]
        v = np.take_along_axis(d, near, axis=1)
        i, j = np.nonzero(v < worst[m][:, None])
        if len(i):
            out.append((m[i], m[near[i, j]], v[i, j]))
    if not out:
        return _links(*_EMPTY, 1)
    u, w, d = (np.concatenate(c) for c in zip(*out, strict=True))
    return _links(ids[u], ids[w], d, degree)


def _measured(pairs: pa.Table, vectors: pa.Table, size: int) -> pa.Table:
    """One block: pairs (query, node), each once or several times, and the vectors of all queries and nodes in them."""
    ids = _plain(vectors, "id")
    by_id = np.argsort(ids)
    x = matrix(vectors.column("vector"), size).astype(np.float32)[by_id]
    query, node, worst = _plain(pairs, "query"), _plain(pairs, "node"), _plain(pairs, "worst")
    order = np.lexsort((node, query))
    query, node, worst = query[order], node[order], worst[order]
    new = np.ones(len(query), dtype=bool)
    new[1:] = (query[1:] != query[:-1]) | (node[1:] != node[:-1])
    query, node, worst = query[new], node[new], worst[new]
    a, b = np.searchsorted(ids[by_id], query), np.searchsorted(ids[by_id], node)
    d = np.empty(len(a), dtype=np.float32)
    for i in range(0, len(a), 65_536):
        j = slice(i, i + 65_536)
        d[j] = ((x[a[j]] - x[b[j]]) ** 2).sum(axis=1)
    nearer = d < worst
    return pa.table({"u": query[nearer], "w": node[nearer], "d": d[nearer]})


def _best(links: DataFrame, most: int) -> DataFrame:
    """Of every ``u`` the ``most`` shortest links, with the distance that a link must beat: infinite as long as there are fewer. A link that was there is not fresh."""
    distinct = links.groupBy("u", "w").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("u").orderBy("d", "w")
    kept = distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    last = F.max(F.when(F.col("rank") == most, F.col("d"))).over(Window.partitionBy("u"))
    return kept.withColumn("worst", F.coalesce(last, F.lit(float("inf")).cast("float")))


def graph(points: DataFrame, size: int, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """``id, vector, codes, block`` -> links ``u, w, d, fresh, rank, worst``, about ``degree`` per vector."""
    coded = points.select("id", "vector", F.posexplode(F.slice("codes", 1, TABLES)).alias("turn", "code"))
    lots = coded.groupBy("turn", "code").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("lots"))
    dealt = coded.join(lots, ["turn", "code"]).withColumn("lot", F.pmod(F.xxhash64("id", "turn"), F.col("lots")))
    found = dealt.select("turn", "code", "lot", "id", "vector").groupBy("turn", "code", "lot").applyInArrow(lambda t: _within(t, size), _LINK)
    links = store(_best(found.withColumn("fresh", F.lit(True)), degree), "ann-links")
    for turn in range(rounds):
        both = links.select(F.col("u").alias("center"), F.col("w").alias("member"), "fresh", F.lit(False).alias("back")).unionByName(
            links.select(F.col("w").alias("center"), F.col("u").alias("member"), "fresh", F.lit(True).alias("back"))
        )
        active = both.groupBy("center").agg(F.max("fresh").alias("active"), F.ceil(F.greatest(F.count_if("back"), F.lit(1)) / LOT).cast("int").alias("lots")).where("active")
        centers = active.join(points.select(F.col("id").alias("center"), "block"), "center")
        lots = F.when(F.col("back"), F.array(F.pmod(F.xxhash64("member", F.lit(turn)), F.col("lots")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("lots") - 1))
        members = store(both.join(centers, "center").select("block", "center", "member", "fresh", (F.col("lots") > 1).alias("split"), F.explode(lots).alias("lot")), "ann-members")
        # Whoever is linked has a first link of its own: buckets and blocks link both ways.
        held = links.where(F.col("rank") == 1).select(F.col("u").alias("id"), "worst")
        wanted = members.select(F.col("block").alias("at"), F.col("member").alias("id")).distinct().join(points.select("id", "vector"), "id").join(held, "id")
        compare = partial(_joined, size=size, degree=degree)
        found = members.groupBy("block").cogroup(wanted.select("at", "id", "vector", "worst").groupBy("at")).applyInArrow(_two_tables(compare), _LINK)
        old = links.select("u", "w", "d", F.lit(False).alias("fresh"))
        seen = Observation()
        better = _best(old.unionByName(found.withColumn("fresh", F.lit(True))), degree)
        links = store(better.observe(seen, F.avg(F.col("fresh").cast("int")).alias("share")), "ann-links")
        share = seen.get["share"]
        if not share or share < SETTLED:
            break
    return links


def _coded(batches, size: int, bits: list[int]):
    """``id, vector`` -> with ``codes``: per entry of ``bits`` the sides of so many random hyperplanes through the origin, as an integer."""
    planes = [np.random.default_rng(seed).normal(size=(size, n)) for seed, n in enumerate(bits)]
    for batch in batches:
        x = matrix(batch.column(1), size)
        codes = np.stack([(x @ p > 0) @ (1 << np.arange(p.shape[1], dtype=np.int64)) if p.shape[1] else np.zeros(len(x), np.int64) for p in planes], axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(codes.astype(np.int64))], names=["id", "vector", "codes"])


def _distances(pairs: DataFrame, points: DataFrame, size: int, blocks: int, parts: int) -> DataFrame:
    """``query, node, worst`` -> ``u, w, d`` of those nearer than ``worst``. Pairs are dealt by query and by node into blocks that get every vector they need once."""
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)) * parts + F.pmod(F.xxhash64("node", F.lit("part")), F.lit(parts))
    dealt = pairs.withColumn("block", block)
    needed = dealt.select(F.col("block").alias("at"), F.explode(F.array("node", "query")).alias("id")).distinct()
    vectors = needed.join(points.select("id", "vector"), "id").select("at", "id", "vector")
    return dealt.groupBy("block").cogroup(vectors.groupBy("at")).applyInArrow(_two_tables(partial(_measured, size=size)), _LINK)


def greedy(queries: DataFrame, links: DataFrame, points: DataFrame, size: int, beam: int = BEAM, step: int = STEP) -> DataFrame:
    """``query`` (ids of nodes) -> the best nodes met, ``query, node, d``, up to ``beam`` each; ends when no node among these is open.

    A query is one row, its beam an array of (d, node, open) in this order, of which the first ``step`` open nodes are expanded at a time. A node that
    a full beam pushed out needs no memory: the beam only gets better, so it would be pushed out again.
    """
    both = store(links.select("u", "w").union(links.select("w", "u")).distinct(), "ann-both")
    count = queries.count()
    blocks = max(1, -(-count // QUERY_BLOCK))
    parts = max(1, -(-BLOCKS_PER_CORE * points.sparkSession.sparkContext.defaultParallelism // blocks))
    entry = F.struct(F.lit(0.0).cast("float").alias("d"), F.col("query").alias("node"), F.lit(True).alias("open"))
    state = store(queries.select("query", F.array(entry).alias("beam")), "ann-beam")
    left = count
    while left:
        now = F.slice(F.filter("beam", lambda n: n["open"]), 1, step)["node"]
        worst = F.when(F.size("beam") >= beam, F.element_at("beam", -1)["d"]).otherwise(float("inf")).cast("float")
        frontier = state.select("query", worst.alias("worst"), F.explode(now).alias("u"))
        reached = frontier.join(both, "u").select("query", F.col("w").alias("node"), "worst")
        found = _distances(reached, points, size, blocks, parts)
        near = found.groupBy(F.col("u").alias("query")).agg(F.collect_list(F.struct("d", F.col("w").alias("node"), F.lit(True).alias("open"))).alias("near"))
        kept = F.transform("beam", lambda n: F.struct(n["d"].alias("d"), n["node"].alias("node"), (n["open"] & ~F.array_contains(F.col("now"), n["node"])).alias("open")))
        old = state.withColumn("now", now).select("query", kept.alias("beam"))
        unmet = F.filter("near", lambda n: ~F.array_contains(F.col("beam.node"), n["node"]))
        merged = F.when(F.col("near").isNull(), F.col("beam")).otherwise(F.slice(F.array_sort(F.concat("beam", unmet)), 1, beam))
        opened = old.join(near, "query", "left").select("query", merged.alias("beam"))
        seen = Observation()
        state = store(opened.observe(seen, F.count_if(F.exists("beam", lambda n: n["open"])).alias("left")), "ann-beam")
        left = seen.get["left"]
    return state.select("query", F.explode("beam").alias("n")).select("query", "n.node", "n.d")


def search(table: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest rows found of each row whose id is divisible by ``every``: ``query_id, rank, vec_id, score``. Each length of vectors has a graph of its own."""
    rows = table.select(table[vec_id].cast("long").alias("vec_id"), table[vector].alias("vector"))
    taken = rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    out = table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rounds = _rounds_session(table.sparkSession)
    for size in sizes(taken):
        out = out.unionByName(_search(taken.where(F.size("vector") == size), rounds, size, every, k, degree, beam))
    return out


def _rounds_session(spark: SparkSession) -> SparkSession:
    """A session with the same settings, in which a round is one job of shuffles.

    Adaptive plans take a job, a thread and a new plan per exchange, broadcasts a thread and a table in the driver. Over dozens of small rounds that is most of
    the driver's memory, and the rounds' tables are even by construction: ids are hashed, hubs and large blocks are dealt into lots.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return own


def _search(taken: DataFrame, rounds: SparkSession, size: int, every: int, k: int, degree: int, beam: int) -> DataFrame:
    # A group of equal vectors answers with its k + 1 smallest ids at most.
    place = Window.partitionBy("vector").orderBy("vec_id")
    few = taken.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1)
    folded = few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("id"))
    nodes = store(folded, "ann-nodes", rounds)
    count = nodes.count()
    cores = taken.sparkSession.sparkContext.defaultParallelism
    # Nothing merges small partitions, so there are no more than the smallest blocks would be.
    most = int(taken.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds.conf.set("spark.sql.shuffle.partitions", str(min(most, max(1, -(-count // LEAST_BLOCK)))))
    points = nodes.select("id", F.col("vector").cast("array<float>").alias("vector"))
    blocks = max(count // BLOCK, min(count // LEAST_BLOCK, BLOCKS_PER_CORE * cores))
    bits = [(count // BUCKET).bit_length()] * TABLES + [blocks.bit_length()]
    points = points.mapInArrow(partial(_coded, size=size, bits=bits), "id long, vector array<float>, codes array<long>")
    points = store(points.withColumn("code", F.get("codes", F.lit(TABLES))), "ann-coded")
    # A code that many vectors share makes several blocks.
    parts = points.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("id", F.lit("block")), F.col("parts"))
    points = store(points.join(parts, "code").select("id", "vector", "codes", (F.shiftleft("code", 24) + part).alias("block")), "ann-points")
    links = graph(points, size, max(1, min(degree, count - 1)))
    asked = store(taken.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector").distinct(), "ann-asked", rounds)
    asked = store(asked.join(nodes.select("vector", F.col("id").alias("query")), "vector").select("query_id", "query").distinct(), "ann-queries")
    near = greedy(asked.select("query").distinct(), links, points, size, beam)
    exact = nodes.select("id", "ids", F.col("vector").cast("array<double>").alias("vector"))
    pairs = near.join(exact.select(F.col("id").alias("query"), F.col("vector").alias("q")), "query").join(exact.withColumnRenamed("id", "node"), "node")
    squares = F.zip_with("q", "vector", lambda a, b: (a - b) * (a - b))
    scored = pairs.select("query", "ids", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)).alias("score"))
    found = asked.join(scored, "query").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return store(ranked, "ann-near", taken.sparkSession)


def op9_neighbours(table: DataFrame) -> DataFrame:
    return search(table)
