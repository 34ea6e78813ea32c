"""The corpus pipeline stage by stage on planted and odd rows, each stage against a plain version of it."""
import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from arpent.llm import quality_rules
from tests.llm.test_ops import _brute_templates
from tests.llm.test_overlaps import _overlap
from tests.llm.test_pipeline_stages import _components

ITEM = " ".join(f"item{k}" for k in range(18))


def _texts():
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    prose = lambda n=70: " ".join(word() for _ in range(n))
    spam = lambda: " ".join("".join(rng.choices("abc", k=3)) + "###$$$" for _ in range(70))
    rows = [(k, spam() if k % 4 == 0 else prose()) for k in range(120)]
    # a line of one template in 15 documents, near copies, exact copies, leaks with and without changed tokens
    rows += [(200 + k, f"{prose(60)}\nshared by reader {word()} on the wall of this page\n{prose(10)}") for k in range(15)]
    base = prose(90).split()
    for k in range(5):
        words = base.copy()
        words[10 + 7 * k] = "other"
        rows.append((300 + k, " ".join(words)))
    rows += [(310 + k, rows[1][1]) for k in range(3)]
    changed = ITEM.split()
    changed[5] = changed[11] = "x"
    rows += [(400, f"{prose(30)} {ITEM} {prose(30)}"), (401, f"{prose(40)} {' '.join(changed)} {prose(20)}"), (402, f"{prose(40)} {' '.join(ITEM.split()[:9])} {prose(20)}")]
    # odd rows: null, empty, blank, repeated, without id, one id with two texts, a long text
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, prose(5)), (7, prose()), (None, prose()), (None, None), rows[2], rows[2], (504, " ".join(word() for _ in range(30_000)))]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(k, t, "en", "s", 0) for k, t in _texts()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(120)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


def _rows(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=repr)


def test_every_stage_against_a_plain_version(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for c in ("_id", "_hash", "row", "key", "n_lines", "n_words", "spans", "component", "label"):
        docs = docs.withColumn(c, F.lit("clash"))
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = _rows(docs)
        out = stage(spark, docs, folder)
        assert k == 4 or out.columns == columns, name
        out.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        seen[name] = (before, docs)

    before, after = seen["quality rules"]
    worded = lambda rows: [r for r in rows if (r[1] or "").split()]
    assert worded(_rows(after)) == [r for r in worded(before) if "###" not in r[1]]
    wordless = [r for r in before if r not in worded(before)]  # all their counts are zero, so one verdict holds for all
    assert [r for r in _rows(after) if r not in worded(before)] in (wordless, [])

    before, after = seen["line dedup"]
    gone, want = _brute_templates([t for _, t in before]), []
    for (i, t), at in zip(before, gone):
        lines = (t or "").split("\n")
        full = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in lines)
        want.append((i, t if not at or len(at) == full else "\n".join(x for k, x in enumerate(lines) if k not in at)))
    assert _rows(after) == sorted(want, key=repr) and sum(map(bool, gone)) == 15

    before, after = seen["SimHash near-dedup"]
    once = list(dict.fromkeys(before))
    label = _components([t for _, t in once])
    smallest = {}
    for (i, t), c in zip(once, label):
        smallest.setdefault(c, []).append(i)
    kept = _rows(after)
    assert len(kept) == len(smallest) == len(set(kept)) and {r[0] for r in kept if r[0] is not None} >= {min(x for x in ids if x is not None) for ids in smallest.values() if any(x is not None for x in ids)}

    before, after = seen["benchmark decontamination"]
    assert _rows(after) == [r for r in before if not _overlap(r[1] or "", ITEM)] and {400, 401} == {i for i, t in before if (i, t) not in _rows(after)}

    before, after = seen["byte-level BPE"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in before:
        ids = encoding.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sorted(map(repr, corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(map(repr, after.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))


def test_every_stage_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def test_rules_are_learned_from_labels_alone(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert docs.count() == len(_texts())
    assert quality_rules.keep_good(docs, spark.read.parquet(f"{folder}/labels.parquet").where("false")).count() == docs.count()
