"""Similar pairs against brute force, over several blocks."""

import itertools

from recollect.operators.similarity import pairs


def test_pairs_over_blocks(spark):
    rows = [(f"k{i}", [float((i * 7 + j * j) % 11 - 5) / 20 for j in range(6)]) for i in range(60)]
    odd = [("null", None), ("short", [0.5, 0.5]), ("hole", [None, 0.1, 0.1, 0.1, 0.1, 0.1]), (None, [0.1] * 6), ("short2", [1.0, 0.5])]
    v = spark.createDataFrame(rows + odd, "id string, embedding array<double>")
    dot = lambda x, y: max(-1.0, min(1.0, sum(a * b for a, b in zip(x, y))))
    for lower, upper in ((0.1, None), (0.05, 0.12), (2.0, None)):
        want = {(*sorted((a, b)), round(dot(x, y), 9)) for (a, x), (b, y) in itertools.combinations(rows, 2) if dot(x, y) >= lower and (upper is None or dot(x, y) < upper)}
        if lower <= dot([0.5, 0.5], [1.0, 0.5]) and (upper is None):
            want.add(("short", "short2", 0.75))
        got = [(r.a, r.b, round(r.similarity, 9)) for r in pairs(v, lower, upper, block_rows=9).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert pairs(v.limit(0), 0.0).count() == 0
