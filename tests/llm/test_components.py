"""Connected components against a brute-force version."""
import random

import pytest

from arpent.llm.simhash_cover import connected

_RNG = random.Random(3)
CASES = {
    "empty": [],
    "own end": [(1, 1)],
    "pair twice": [(2, 1), (1, 2)],
    "path": [(k, k + 1) for k in range(40)],
    "hub above": [(100, k) for k in range(60)],
    "random": [(_RNG.randint(-60, 60), _RNG.randint(-60, 60)) for _ in range(70)],
    "joined stars": [(0, k) for k in range(5, 15)] + [(20, k) for k in range(21, 30)] + [(29, 14)],
}


def _labels(edges):
    label = {k: k for e in edges if e[0] != e[1] for k in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            if u != v and label[u] != label[v]:
                label[u] = label[v] = min(label[u], label[v])
                changed = True
    return {k: low for k, low in label.items() if k != low}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    found = connected(spark.createDataFrame(CASES[name], "u long, v long")).collect()
    assert len({r["node"] for r in found}) == len(found)
    assert {r["node"]: r["label"] for r in found} == _labels(CASES[name])
