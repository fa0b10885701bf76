"""Top-k search and hard negatives against plain Python, with ties, copies and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesmart.llm import hard_negatives, top_search, whole_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, id int, n string, shard int, kth int"


def _rows(seed, count, length, spread=1.0):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(length)] for _ in range(9)]
    rows = []
    for i in range(count):
        centre = draw.choice(centres)
        vector = [c + spread * draw.gauss(0, 0.3) for c in centre]
        if i % 3 == 0:
            vector = [float(x) for x in centres[0]]  # a third are copies
        rows.append((i, vector, draw.randrange(4)))
    return rows


def _odd_rows():
    return [
        (None, [1.0, 2.0], 1),
        (1000, None, 1),
        (1100, [1.0, None], 1),
        (1200, [float("nan"), 1.0], 1),
        (1300, [float("inf"), 1.0], 1),
        (1400, [1e308, 1.0], 1),
        (1500, [], 1),
        (1550, [], 2),
        (1600, [0.5, -0.25], None),
        (1700, [0.5, -0.25], 1),
        (1700, [0.5, -0.25], 1),
        (1800, [0.5, -0.25], 1),
        (1850, [0.25, -0.25], 2),
        (1900, [1e15, 1e15], 1),
        (1950, [1e15, -1e15], 2),
        (2000, [1e15, 1.0], 1),
    ]


def _frame(spark, rows):
    data = [(*row, 1, "x", 2, 3) for row in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(4)


def _whole(rows):
    for name, vector, label in rows:
        if name is None or vector is None or any(x is None or not math.isfinite(256 * x) for x in vector):
            continue
        yield name, [math.floor(256 * x) for x in vector], label


def _score(a, b):
    return max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b))))


def _first(rows):
    """The smallest vector of each id asks."""
    found = {}
    for name, vector, label in rows:
        found[name] = min(found.get(name, (label, vector)), (label, vector))
    return [(name, vector, label) for name, (label, vector) in found.items()]


def _best(rows, divisor, k):
    rows = [(name, vector, 0) for name, vector, _ in _whole(rows)]
    out = []
    for query, vector, _ in _first(rows):
        if query % divisor:
            continue
        found = sorted(
            (-_score(vector, other), name)
            for name, other, _ in rows
            if name != query and len(other) == len(vector)
        )
        out += [(query, r + 1, name, -score) for r, (score, name) in enumerate(found[:k])]
    return sorted(out)


def _mined(rows, divisor):
    rows = [row for row in _whole(rows) if row[2] is not None]
    out = []
    for anchor, vector, label in _first(rows):
        if anchor % divisor:
            continue
        scored = sorted(
            (-_score(vector, other), name, of)
            for name, other, of in rows
            if name != anchor and len(other) == len(vector)
        )
        for positive, name, of in [s for s in scored if s[2] == label][:5]:
            hard = [
                (-s, n) for s, n, of in scored
                if of != label and -30 * positive <= -100 * s <= -90 * positive
            ]
            out += [
                (anchor, name, r + 1, n, -positive, s) for r, (s, n) in enumerate(hard[:10])
            ]
    return sorted(out)


@pytest.mark.parametrize("rows", [_rows(1, 1500, 8), _rows(2, 900, 3, 0.0), _odd_rows(), []])
def test_search_is_exact(spark, monkeypatch, rows):
    monkeypatch.setattr(whole_vectors, "FEWEST_ROWS", 100)  # several cells and shards
    found = top_search.search(_frame(spark, rows), F.col("vec_id") % 50 == 0, 5)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == _best(rows, 50, 5)


@pytest.mark.parametrize("rows", [_rows(3, 1500, 8), _rows(4, 900, 3, 0.0), _odd_rows(), []])
def test_negatives_are_exact(spark, monkeypatch, rows):
    monkeypatch.setattr(whole_vectors, "FEWEST_ROWS", 100)
    found = hard_negatives.mine(_frame(spark, rows), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, found.collect())) == _mined(rows, 50)


@pytest.mark.parametrize("size, length", [(1.0, 64), (3e4, 7), (1e9, 5), (1e30, 4), (0.0, 3)])
def test_fields_hold_exact_scores(size, length):
    draw = np.random.default_rng(5)
    rows = np.floor(256 * size * draw.normal(size=(37, length)))
    anchors = np.floor(256 * size * draw.normal(size=(5, length)))
    theirs = [[_score([int(x) for x in a], [int(x) for x in r]) for r in rows] for a in anchors]
    ours = hard_negatives.Packed(rows).scores(anchors)
    assert ours.dtype == np.int64
    assert ours.tolist() == theirs


def test_search_skips_nodes_and_takes_the_shared_score(spark):
    """On clustered rows a query sees few leaves, fewer still with a k-th score from elsewhere."""
    draw = np.random.default_rng(3)
    centres = 4_000 * draw.normal(size=(64, 16))
    rows = np.floor(np.repeat(centres, 64, axis=0) + 50 * draw.normal(size=(4_096, 16)))
    tree = top_search.BallTree(np.arange(4_096), rows, leaf=32)
    seen = []

    class Counted(dict):
        def __getitem__(self, node):
            seen.append(node)
            return dict.__getitem__(self, node)

    tree.leaves = Counted(tree.leaves)
    query = rows[5]
    bounds = top_search.upper_bounds(query[None], tree.centres, tree.radii)[0]
    scores, ids = tree.search(5, query, bounds, -np.inf, 5)
    plain = sorted(((-int(s), i) for i, s in enumerate(rows @ query) if i != 5))[:5]
    assert list(zip((-scores).tolist(), ids.tolist())) == plain
    alone = len(seen)
    assert alone < len(tree.leaves) / 4
    tree.search(5, query, bounds, float("inf"), 5)
    assert len(seen) == alone


def test_radius_bounds_every_row():
    draw = np.random.default_rng(9)
    rows = np.floor(1e4 * draw.normal(size=(1_000, 24)))
    tree = top_search.BallTree(np.arange(1_000), rows, leaf=16)
    queries = np.floor(1e4 * draw.normal(size=(50, 24)))
    bounds = top_search.upper_bounds(queries, tree.centres, tree.radii)
    for node, (_, part) in tree.leaves.items():
        assert ((queries @ part.T).max(axis=1) <= bounds[:, node]).all()
