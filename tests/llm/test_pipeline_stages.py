"""The pipeline's stages against brute-force versions."""
import itertools
import random

import numpy as np
import pytest

from arpent.llm import decontaminate, line_templates, near_jaccard, quality_rules, simhash_cover
from arpent.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", None, 0) for k, t in rows], SCHEMA)


def _shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}


def _components(texts, limit=0.8):
    sets, label = [_shingles(t) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        x, y = sets[a], sets[b]
        if label[a] != label[b] and len(x & y) >= limit * len(x | y) - 1e-12:
            low, high = sorted((label[a], label[b]))
            label = [low if m == high else m for m in label]
    return label


def _variants(rng, groups=6, each=12):
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(40, 160))]
        for _ in range(each):
            words = base.copy()
            for k in rng.sample(range(len(words)), rng.randint(0, 4)):
                words[k] = f"x{rng.randint(0, 99)}"
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("options", [{}, {"hot": 3}, {"rounds": 0, "block": 4}])
def test_near_dedup_against_brute_force(spark, options):
    texts = _variants(random.Random(4)) + [r["text"] for r in table(spark, SF, "documents").orderBy("doc_id").limit(100).collect()] + [None, "", "one two", "One  TWO"]
    want = sorted(set(_components(texts)))
    got = near_jaccard.keep_one(documents(spark, enumerate(texts)), **options)
    assert sorted(r["doc_id"] for r in got.collect()) == want


@pytest.mark.parametrize("keep", [simhash_cover.keep_one, near_jaccard.keep_one])
def test_rows_without_id_or_with_the_same_id_stay(spark, keep):
    rng = random.Random(6)
    texts = [" ".join(str(rng.random()) for _ in range(30)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3]), (None, texts[4]), (9, texts[4]), (10, texts[5])]
    got = sorted((str(r["doc_id"]), r["text"]) for r in keep(documents(spark, rows)).collect())
    assert got == sorted([("None", texts[0]), ("None", texts[1]), ("7", texts[2]), ("7", texts[3]), ("9", texts[4]), ("10", texts[5])])


def test_a_leak_without_id_takes_no_other_row(spark):
    item = " ".join(f"t{k}" for k in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, item), (None, "clean"), (3, f"so {item}"), (3, "clean too"), (4, None)]
    for options in ({}, {"block_bytes": 8}):
        got = decontaminate.keep_clean(documents(spark, rows), bench, **options).collect()
        assert sorted(r["text"] or "" for r in got) == ["", "clean", "clean too"]


def test_blocks_of_items_change_no_row(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(20)) for c in "ab")
    bench = spark.createDataFrame([(None, a), (2, b), (3, b)], "item_id long, text string")
    rows = [(None, f"{a} x"), (None, "clean"), (5, b), (5, b), (5, "other"), (6, None), (7, f"{a} {b}")]
    want = sorted([("None", True, 1, "", 20), ("None", False, 0, "", 0), ("5", True, 2, "2,3", 40), ("5", True, 2, "2,3", 40), ("5", False, 0, "", 0), ("6", False, 0, "", 0), ("7", True, 3, "2,3", 60)])
    for size in (4 << 20, 30, 8):
        got = decontaminate.report(documents(spark, rows), bench, block_bytes=size).collect()
        assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in got) == want


def test_equal_spans_count_once_in_one_block_and_in_many(spark):
    a = " ".join(f"a{k}" for k in range(20))
    bench = spark.createDataFrame([(1, a), (1, f"{a} more words behind")], "item_id long, text string")
    for size in (4 << 20, 8):
        got = decontaminate.report(documents(spark, [(1, a), (2, "no")]), bench, block_bytes=size).orderBy("doc_id").collect()
        assert [tuple(r) for r in got] == [(1, True, 1, "1", 20), (2, False, 0, "", 0)]


def test_good_rows_stay_by_their_own_text(spark):
    """Rejected texts go though a row of the same id stays; null ids are no one row."""
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(80))
    bad = lambda: " ".join("".join(rng.choices("abcdefgh", k=3)) + "###$$$" for _ in range(80))
    train = [(k, bad() if k % 3 == 0 else good()) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)], "doc_id long, quality int, toxic int")
    kept, gone = [good() for _ in range(4)], [bad() for _ in range(3)]
    more = list(zip([None, None, 7, 1000], kept)) + list(zip([None, 7, 1000], gone)) + [(2000, None), (2001, "")]
    got = quality_rules.keep_good(documents(spark, train + more), labels).collect()
    texts = {r["text"] for r in got}
    assert texts >= {*kept, *(t for k, t in train if k % 3)} and not texts & {*gone, *(t for k, t in train if k % 3 == 0)}


def test_wide_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(8)
    for size in (0, 1, 3, 500, 513, 2000, 9000):
        a = np.unique(rng.integers(0, 1 << 56, size))
        for other in (0, size // 2, size, 2 * size + 5):
            b = np.unique(np.concatenate([a[: len(a) // 2], rng.integers(0, 1 << 56, other)]))
            apart = near_jaccard.wide_distance(near_jaccard.wide_of(a), near_jaccard.wide_of(b))
            assert apart <= len(np.setxor1d(a, b)) and apart == near_jaccard.wide_distance(near_jaccard.wide_of(b), near_jaccard.wide_of(a))
            assert apart % 2 == len(np.setxor1d(a, b)) % 2
