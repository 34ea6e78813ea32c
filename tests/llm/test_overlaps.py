"""Spaced seeds against comparing every document with every item at every offset."""
import itertools
import random

import numpy as np

from arpent.llm import decontaminate
from tests.llm.test_pipeline_stages import documents


def _overlap(text, item, least=13):
    """Whether any stretch of an alignment has `least` tokens, or the item's if fewer, and 80 in 100 agree."""
    t, w = text.split(), item.split()
    need = min(least, len(w))
    for shift in range(-len(w) + 1, len(t)):
        same = [t[k + shift] == x for k, x in enumerate(w) if 0 <= k + shift < len(t)]
        for a, b in itertools.combinations(range(len(same) + 1), 2):
            if b - a >= need and 5 * sum(same[a:b]) >= 4 * (b - a):
                return True
    return False


def test_masks_hit_every_overlap():
    """A stretch of 26 or more has a half that agrees as well, so lengths to 25 stand for all."""
    for length in range(11, 26):
        wrong = np.array(list(itertools.combinations(range(length), length // 5)))
        same = np.ones((len(wrong), length), dtype=bool)
        np.put_along_axis(same, wrong, False, axis=1)
        hit = np.zeros(len(same), dtype=bool)
        for mask in decontaminate.MASKS:
            at = np.flatnonzero([c == "1" for c in mask])
            for k in range(length - len(mask) + 1):
                hit |= same[:, at + k].all(axis=1)
        assert hit.all(), length


def test_overlaps_against_brute_force(spark):
    rng = random.Random(8)
    items = [" ".join(f"i{k}t{j}" for j in range(n)) for k, n in enumerate([13, 14, 15, 16, 20, 25, 40, 12])]
    texts = []
    for item in items:
        n = len(item.split())
        for wrong in [{2}, {n - 3}, set(range(4, n, 5)), *(set(rng.sample(range(n), rng.randint(1, n // 4 + 1))) for _ in range(12))]:
            words = ["zz" if k in wrong else w for k, w in enumerate(item.split())]
            texts.append(" ".join([f"f{rng.random()}".replace(".", "") for _ in range(30)] + words + ["end"] * rng.randint(0, 5)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.report(documents(spark, enumerate(texts)), bench).collect()}
    want = {k: ",".join(str(i) for i, item in enumerate(items) if _overlap(t, item)) for k, t in enumerate(texts)}
    assert got == want and "" in want.values()
