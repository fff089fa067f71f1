import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroframe.llm import bitslice
from hydroframe.llm.shared import materialize

SCHEMA = "vec_id long, embedding array<float>, n int, Bits int, `ids.x` int"


def whole(v):
    """The components as whole numbers, or nothing if the vector takes no part."""
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    out = [math.floor(1024 * float(np.float32(x))) for x in v]
    most = min(2.0**31 - 1, math.sqrt(9.0e18 / max(1, len(v)))) - 1
    return out if all(abs(1024 * float(np.float32(x))) <= most for x in v) else None


def plain_top(rows, every, k):
    vectors = [(i, x) for i, v in rows if i is not None and (x := whole(v)) is not None]
    out = []
    for a, (i, q) in enumerate(vectors):
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, c)), j) for b, (j, c) in enumerate(vectors) if b != a)
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def search(spark, rows, every, k, parts):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(parts)
    index = materialize(bitslice.build_index(df), "test-index")
    queries = materialize(bitslice.query_blocks(df.where(F.col("vec_id") % every == 0)), "test-queries")
    return sorted(map(tuple, bitslice.top_k(index, queries, k).collect()))


@pytest.mark.parametrize("dims, scale, parts", [(64, 0.125, 3), (5, 2.0, 2), (1, 0.002, 1), (16, 30_000.0, 2)])
def test_rows_equal_all_scores_compared(spark, dims, scale, parts):
    rng = random.Random(dims)
    rows = [(k, [rng.gauss(0, scale) for _ in range(dims)]) for k in range(700)]
    rows += [(k, rows[k % 7][1]) for k in range(700, 760)]  # equal vectors: ties go to the smaller identifier
    assert search(spark, rows, 20, 10, parts) == plain_top(rows, 20, 10)


def test_odd_rows_have_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, -1.0]), (10, [0.0, 0.0]), (20, None), (30, []), (40, [1.0]), (50, [nan, 1.0]), (60, [None, 1.0]), (70, [inf, 0.0]),
        (80, [3e38, 0.0]), (90, [-0.5, 0.25, 7.0]), (-10, [1.0, 2.0]), (None, [1.0, 2.0]), (7, [1e6, -1e6]), (8, [1e-9, -1e-9]), (11, [-3.0, 4.0]), (100, [2e6]), (101, [2_000_000.0] * 3),
    ]
    assert search(spark, rows, 10, 4, 2) == plain_top(rows, 10, 4)
    assert search(spark, rows, 10, 100, 3) == plain_top(rows, 10, 100)
    assert search(spark, [], 10, 4, 1) == [] and search(spark, [(1, [1.0])], 10, 4, 1) == [] and search(spark, [(10, [1.0])], 10, 4, 1) == []


def test_bitmaps_add_up_to_the_sums():
    rng = np.random.default_rng(3)
    terms = [(int(rng.integers(0, 9)), rng.integers(0, 2, (3, 128))) for _ in range(200)]
    want = sum(x << p for p, x in terms)
    slices = bitslice.add_up((p, np.packbits(x.astype(np.uint8), axis=1, bitorder="little").view(np.uint64).copy()) for p, x in terms)
    got = sum(np.unpackbits(s.view(np.uint8), axis=1, bitorder="little").astype(int) << p for p, s in enumerate(slices) if s is not None)
    assert (got == want).all()


def test_few_rows_are_scored_exactly_and_blocks_raise_the_floor():
    rng = np.random.default_rng(4)
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    x = rng.normal(0, 128, (8192, 64)).astype(np.int64)
    blocks = [sliced(x[:4096], 0), sliced(x[4096:], 4096)]
    q = x[:16]
    alone = [len(b.boundary(q, 11, np.full(16, -np.inf))[0]) for b in blocks]
    first = bitslice.search_block(blocks[0], q, np.arange(16), nothing, 11)
    floor = first[1][np.cumsum(np.bincount(first[0])) - 1].astype(float)
    assert max(alone) < 0.1 * 16 * 4096 and len(blocks[1].boundary(q, 11, floor)[0]) < alone[1]
    query, score, ids, _ = bitslice.search_block(blocks[1], q, np.arange(16), first, 11)
    for k in range(16):
        order = sorted((-int(s), i) for i, s in enumerate(x @ q[k]))[:11]
        assert [(-int(s), int(i)) for s, i in zip(score[query == k], ids[query == k])] == order


def sliced(x, first):
    return bitslice.Block.of(bitslice.block_row(np.arange(first, first + len(x)), x))
