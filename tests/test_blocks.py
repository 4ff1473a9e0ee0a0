"""Nearest centres and woven pairs over several blocks against brute force, with ties and odd rows."""

import itertools

import pytest

from recollect.operators import similarity as S
from recollect.plans import queries as own

ROWS = [(i, [float((i * 7 + j * j) % 11 - 5) / 20 for j in range(6)], i % 3) for i in range(60)]
ROWS += [(100 + i, [0.2] * 6, i % 3) for i in range(20)]  # equal vectors: ties, of which the smallest ids count
ODD = [(200, None, 1), (201, [0.5, 0.5], 0), (202, [None] + [0.1] * 5, 2), (None, [0.1] * 6, 0), (203, [0.5, 0.5], 1), (204, [0.3] * 6, None)]


def dot(x, y):
    total = 0.0
    for a, b in zip(x, y):
        total += a * b
    return total


@pytest.fixture(scope="module")
def v(spark):
    return spark.createDataFrame(ROWS + ODD, "id bigint, embedding array<double>, label int").repartition(3)


def arrow_stages(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_nearest_over_blocks(v):
    centres = v.where("label = 0").select(own.F.col("id").alias("centre"), own.F.col("embedding").alias("centre_vector"))
    found = S.nearest(v.where("label <> 0"), centres, 0.01, block_rows=7)
    assert arrow_stages(found)  # not one Spark row a pair
    usable = [r for r in ROWS + ODD if r[0] is not None and r[1] and None not in r[1]]
    want = {}
    for i, x, label in usable:
        met = [(-dot(x, y), c) for c, y, k in usable if k == 0 and len(x) == len(y)] if label else []
        if met and -min(met)[0] >= 0.01:
            want[i] = (min(met)[1], -min(met)[0])
    assert {r.id: (r.centre, r.similarity) for r in found.collect()} == want


@pytest.mark.parametrize("limit", [5, 400])
def test_weave_over_blocks(v, limit):
    found = S.weave_apart(v, "label", 0.05, 0.24, limit, block_rows=9)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().replace("Join Inner", "", 1)  # the blocks' join alone
    usable = [r for r in ROWS + ODD if r[0] is not None and r[1] and None not in r[1] and r[2] is not None]
    all_pairs = [(-dot(x, y), *sorted((a, b))) for (a, x, k), (b, y, m) in itertools.combinations(usable, 2) if k != m and len(x) == len(y)]
    want = sorted(p for p in all_pairs if 0.05 <= -p[0] < 0.24)[:limit]
    assert len(want) == limit
    assert [(-r.similarity, r.a, r.b) for r in found.collect()] == want
