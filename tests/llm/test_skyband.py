"""The skyband against its definition, whatever the size of a step."""

import random

from quarry.llm.source_divergence import _in_skyband


def test_skyband_equals_all_comparisons_in_any_step():
    rng = random.Random(3)
    for size in (0, 1, 40, 300):
        rows = [(n := rng.randrange(1, 9), n + rng.randrange(5), b"t%d" % rng.randrange(60)) for _ in range(size)]
        for k in (1, 3):
            left = [r for r in rows if sum(o[0] >= r[0] and o[1] <= r[1] and o[2] < r[2] for o in rows) < k]
            for step in (1, 7, 256):
                assert sorted(_in_skyband(list(rows), k, step)) == sorted(left)
