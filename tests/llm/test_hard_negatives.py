import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordergauge.llm import hard_negatives, queries
from tests.llm.support import SF_DIR, plain

SCHEMA = "vec_id long, embedding array<float>, label int, score string, block int, copies int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def expected(rows, relabel=True):
    """By the definition: all scores of each anchor, sorted."""
    own = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in vector]
        own.append((vec_id, (label + 1) % 10 if relabel and vec_id % 7 == 0 else label, whole))
    out = []
    for i, (anchor, label, a) in enumerate(own):
        if anchor % 50:
            continue
        scored = [
            (-sum(x * y for x, y in zip(a, b, strict=True)), n, k == label)
            for j, (n, k, b) in enumerate(own)
            if j != i and len(b) == len(a)
        ]
        scored.sort()
        for p, positive, _ in [s for s in scored if s[2]][:5]:
            inside = [(s, n) for s, n, same in scored if not same and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(anchor, positive, rank, n, -p, -s) for rank, (s, n) in enumerate(inside[:3], 1)]
    return out


def mined(spark, rows):
    return hard_negatives.mine(frame(spark, rows), relabelled=queries.relabelled())


def vectors(n, dims, seed, spread=1.0, centres=6):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, dims))
    found = middle[draw.integers(0, centres, n)] + spread * draw.normal(size=(n, dims))
    return [[float(x) for x in row] for row in (found / np.sqrt(dims)).astype(np.float32)]


def test_query_on_the_stored_table(spark):
    got = queries.hard_negatives_of(spark, SF_DIR)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got.columns == columns and dict(got.dtypes)["rank"] == "int"
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    assert plain(got.collect()) == plain(expected(rows)) and got.count() > 0


@pytest.mark.parametrize("blocks", [(8192, 512), (40, 3)])
def test_random_and_clustered_rows(spark, monkeypatch, blocks):
    monkeypatch.setattr(hard_negatives, "BLOCK", blocks[0])
    monkeypatch.setattr(hard_negatives, "SLAB", blocks[1])
    monkeypatch.setattr(hard_negatives, "DEPTH", 2)
    draw = random.Random(3)
    for spread in (0.05, 2.0):
        rows = [(i, v, draw.choice([0, 1, 1, 1, 2])) for i, v in enumerate(vectors(400, 6, 4, spread))]
        assert plain(mined(spark, rows).collect()) == plain(expected(rows))


def test_troubled_rows(spark):
    plain_rows = [(i, v, i % 3) for i, v in enumerate(vectors(160, 4, 9))]
    same = [0.5, -0.25, 0.125, 0.0]
    rows = plain_rows + [
        # a third of all rows is one vector, some of them rows repeated whole, anchors too
        *[(200 + i, same, i % 2) for i in range(60)], *[(200, same, 0)] * 3, *[(777, same, 1)] * 20, *plain_rows[:2],
        (50, same, 2), (300, [0.0] * 4, 0), (301, [0.0] * 4, 1), (350, [-x for x in same], 1), (100, None, 1), (150, same, None),
        (None, same, 0), (401, [0.1, None, 0.2, 0.3], 1), (402, [0.1, float("nan"), 0.2, 0.3], 1),
        (403, [float("inf"), 0.0, 0.0, 0.0], 1), (500, [1.0, 2.0], 0), (501, [1.0, 1.9], 0), (502, [0.5, 1.5], 1),
        (550, [], 0), (551, [], 0), (552, [], 1), (600, [5e6, -5e6, 3e6, 5.0], 0), (601, [45e5, -45e5, 3e6, 5.0], 0),
        (602, [4e6, -3e6, 3e6, 5.0], 1), (-50, same, 0), (650, [0.001, 0.0, 0.0, 0.0], 4),
    ]
    want = expected(rows)
    assert plain(mined(spark, rows).collect()) == plain(want)
    assert max(Counter(want).values()) > 1
    assert mined(spark, []).count() == 0


def test_reading_stops_strictly_below_the_kth_score():
    found = np.array([[9, 9], [8, 8], [8, 8], [1, 0], [0, 1]] + [[0, 0]] * 200)
    lists, reads = hard_negatives.Lists(found), []

    def stop(rows, scores, threshold):
        reads.append((len(rows), threshold))
        return len(scores) >= 2 and threshold < np.sort(scores)[-2]

    monkey, hard_negatives.DEPTH = hard_negatives.DEPTH, 1
    try:
        rows, scores = lists.scores(np.array([1, 1]), stop)
    finally:
        hard_negatives.DEPTH = monkey
    # at depth 2 the threshold is 16, equal to the second best: the tie at depth 3 must still be read
    assert [t for _, t in reads[:2]] == [18, 16] and {1, 2} <= set(rows.tolist()) and len(rows) < 20
    assert (scores == found[rows].sum(axis=1)).all()


def test_windows():
    for positive in range(-300, 301):
        low, high = hard_negatives.window_of(positive)
        inside = [s for s in range(-400, 401) if 50 * positive <= 100 * s <= 95 * positive]
        assert inside == list(range(low, high + 1))


def test_other_numbers(spark):
    rows = [(i, v, i % 2) for i, v in enumerate(vectors(60, 3, 5))]
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") == 7, positives=1, negatives=9, least=-100, most=100).collect()
    assert len(got) <= 9 and {r.anchor_id for r in got} == {7} and len({r.positive_id for r in got}) == 1
