"""Vector operators against brute force."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolltally.llm import ann, components, embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"
CLASHING = ["id", "rep", "n", "cell", "block", "unit", "vector", "u", "w", "d", "rank", "query", "links"]


def vectors(n=260, size=16, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, size))
    out = []
    for i in range(n):
        v = rng.normal(size=size) if i % 3 == 0 else centers[i % 12] + rng.normal(size=size) * rng.choice([0.02, 0.15, 0.3])
        out.append((i * 2, [float(np.float32(x)) for x in v], 0))
    same = out[7][1]
    out += [(1001 + 2 * i, same, 1) for i in range(25)]
    out += [(3001, None, 0), (3003, [0.0] * size, 0), (3005, [1.0, None] + [0.0] * (size - 2), 0), (3007, [float("nan")] * size, 0), (3009, [1.0, 2.0], 0), (3011, [float("inf")] * size, 0)]
    out += [(3100, [float(np.float32(10 * x)) for x in same], 0)]
    return out


def good(v, size=16):
    return v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in CLASHING}).cache()


@pytest.mark.parametrize(("block", "lot"), [(1024, 4096), (7, 11)])
def test_embedding_dedup(table, block, lot, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "LOT", lot)
    data = vectors()
    ids = [i for i, v, _ in data if good(v)]
    x = np.array([v for _, v, _ in data if good(v)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    label = np.arange(len(ids))
    for _ in range(len(ids)):
        low = np.minimum(label, np.where(linked, label[None, :], len(ids)).min(axis=1))
        if (low == label).all():
            break
        label = low
    order = np.argsort(ids)
    assert (order == np.arange(len(ids))).all()  # labels are positions, ids ascend
    want = {i: (i, 0, i, True) for i, *_ in data}
    want |= {ids[k]: (ids[k], int(linked[k].sum()), ids[label[k]], bool(label[k] == k)) for k in range(len(ids))}
    got = embedding_dedup.op5_embedding_dedup(table).collect()
    assert len(got) == len(data) and {r.vec_id: tuple(r) for r in got} == want


def test_vectors_of_every_length(spark):
    rows = [(1000, [1.0, 2.0]), (1003, [2.0, 4.0]), (1100, [1.0, 2.0]), (1005, [-2.0, 1.0]), (7, [3.0]), (200, [5.0]), (9, [-1.0]), (300, [1.0, 0.0, 0.0]), (11, []), (300, [1.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = sorted(tuple(r) for r in embedding_dedup.op5_embedding_dedup(table).collect())
    assert got == sorted([
        (1000, 2, 1000, True), (1003, 2, 1000, False), (1100, 2, 1000, False), (1005, 0, 1005, True), (7, 1, 7, True), (200, 1, 7, False), (9, 0, 9, True),
        (300, 1, 300, True), (300, 1, 300, True), (11, 0, 11, True),
    ])
    near = {}
    for r in ann.op9_neighbours(table).collect():
        near.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [v for _, v in sorted(n)] for q, n in near.items()} == {1000: [1100, 1003, 1005], 1100: [1000, 1003, 1005], 200: [7, 9]}


def test_traversal_takes_cells_by_their_sum():
    rng = np.random.default_rng(8)
    for _ in range(200):
        one, two = (np.sort(np.append(rng.random(rng.integers(0, 9)), 0.0)) for _ in range(2))
        radius = rng.random()
        got = embedding_dedup.traversal(one.tolist(), two.tolist(), radius)
        sums = one[:, None] + two[None, :]
        assert got[0] == (0, 0) and sorted(got) == sorted(zip(*map(list, np.nonzero(sums <= radius)), strict=True))
        assert all(sums[a] <= sums[b] for a, b in zip(got, got[1:], strict=False))


def test_multi_index_finds_random_partners():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = embedding_dedup.Grid(x[:1500], 8, 0.95, 0.998)
    other = rng.normal(size=x.shape)
    other -= (other * x).sum(axis=1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * other
    own, visited = grid.visits(x)
    back, visited_back = grid.visits(y)
    found = [b in set(v) or a in set(w) for a, b, v, w in zip(own, back, visited, visited_back, strict=True)]
    assert np.mean(found) >= 0.998 and np.mean([len(v) for v in visited]) < 64
    assert all(v[0] == a for a, v in zip(own, visited, strict=True))


@pytest.mark.parametrize("seed", [0, 5])
def test_neighbours(spark, seed):
    data = vectors(1500, seed=seed)
    ids = np.array([i for i, v, _ in data if good(v)])
    x = np.array([v for _, v, _ in data if good(v)])
    got = collections.defaultdict(list)
    for r in ann.op9_neighbours(spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit(1) for c in CLASHING})).collect():
        got[r.query_id].append(r)
    hit = 0
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    for i in got:
        d = np.sqrt(((x - x[ids == i]) ** 2).sum(axis=1))
        d[ids == i] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        mine = sorted(got[i], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        assert all(r.score == pytest.approx(d[ids == r.vec_id][0], abs=1e-9) for r in mine)
        hit += len(set(want) & {r.vec_id for r in mine})
    assert hit / (10 * len(got)) >= 0.9


def test_a_block_hands_on_all_links_that_can_be_kept():
    n, degree = 30, 36
    ids, x = np.arange(n), np.random.default_rng(1).normal(size=(n, 4)).astype(np.float32)

    def tables(fresh, split):
        members = pa.table({"center": [0] * n, "lot": [0] * n, "member": ids, "fresh": [fresh] * n, "split": [split] * n})
        return members, pa.table({"id": ids, "vector": pa.array(x.tolist(), pa.list_(pa.float32())), "worst": pa.array([float("inf")] * n, pa.float32())})

    assert ann._joined(*tables(True, False), 4, degree).num_rows == n * (n - 1)
    assert ann._joined(*tables(True, False), 4, 7).num_rows == n * 7
    assert ann._joined(*tables(False, False), 4, degree).num_rows == 0  # met before
    assert ann._joined(*tables(False, True), 4, degree).num_rows == n * (n - 1)  # dealt into lots, so perhaps not


@pytest.mark.parametrize("beam, step", [(3, 1), (3, 3), (10, 2)])
def test_a_beam_keeps_the_best_it_met(spark, beam, step):
    """On a line the beam ends with the nodes nearest to the query, whatever was pushed out on the way."""
    links = spark.createDataFrame([(i, i + j, 1.0) for i in range(40) for j in (1, 2) if i + j < 40], "u long, w long, d float")
    points = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id long, vector array<float>")
    got = ann.greedy(spark.createDataFrame([(20,), (0,)], "query long"), links, points, 2, beam, step).collect()
    for q in (0, 20):
        mine = sorted((r.d, r.node) for r in got if r.query == q)
        assert mine == sorted((float((i - q) ** 2), i) for i in range(40))[:beam]


def test_greedy_search_walks_to_the_end(spark):
    links = spark.createDataFrame([(i, i + 1, 1.0) for i in range(9)], "u long, w long, d float")
    points = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "id long, vector array<float>")
    got = ann.greedy(spark.createDataFrame([(0,)], "query long"), links, points, 2)
    assert sorted((r.query, r.node, r.d) for r in got.collect()) == [(0, i, float(i * i)) for i in range(10)]


def test_a_round_is_few_jobs_and_settings_stay(spark, monkeypatch):
    """What a job, an exchange of an adaptive plan or a broadcast leaves in the driver adds up over the rounds: a write per table, no more."""
    writes, plain = [], ann.store
    monkeypatch.setattr(ann, "store", lambda df, name, *to: writes.append(name) or plain(df, name, *to))
    before = dict(spark.conf.getAll)
    spark.sparkContext.setJobGroup("few-jobs", "neighbours")
    try:
        assert len(ann.op9_neighbours(spark.createDataFrame(vectors(300), SCHEMA)).collect()) == 70
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert dict(spark.conf.getAll) == before
    assert writes.count("ann-members") >= 2 and writes.count("ann-beam") >= 3  # there were rounds
    assert len(jobs) <= len(writes) + 20


def test_pairs_are_measured_once():
    pairs = pa.table({"query": [5, 1, 5, 5, 1], "node": [2, 2, 2, 3, 2], "worst": pa.array([9.0, 9.0, 9.0, 0.5, 9.0], pa.float32())})
    nodes = pa.table({"id": [3, 1, 2, 5], "vector": pa.array([[3.0], [1.0], [2.0], [5.0]], pa.list_(pa.float32()))})
    got = ann._measured(pairs, nodes, 1).to_pydict()
    assert sorted(zip(*got.values(), strict=True)) == [(1, 2, 1.0)]  # 5 to 2 is 9, 5 to 3 is 4: not nearer than the worst


def test_few_neighbours(spark):
    data = [(0, [1.0, 0.0], 0), (100, [1.0, 0.0], 0), (7, [0.0, 1.0], 0), (200, None, 0)]
    got = [tuple(r) for r in ann.op9_neighbours(spark.createDataFrame(data, SCHEMA)).collect()]
    root = math.sqrt(2)
    assert sorted(got) == [(0, 1, 100, 0.0), (0, 2, 7, root), (100, 1, 0, 0.0), (100, 2, 7, root)]


@pytest.mark.parametrize("op", [embedding_dedup.op5_embedding_dedup, ann.op9_neighbours])
def test_empty_and_unusable(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).collect() == []
    got = op(spark.createDataFrame([(1, None, 0), (None, [1.0], 0), (100, [0.0], 0)], SCHEMA)).collect()
    assert len(got) == (3 if op is embedding_dedup.op5_embedding_dedup else 0)


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r.id: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
