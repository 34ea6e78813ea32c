"""Rows of the registered queries against plain versions, on the given tables and on a table of odd rows."""
import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from arpent.llm import queries

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
ODD = [
    (1, None, "en"), (2, "", "fr"), (3, " \t\n", None), (4, "x", "en"), (5, "long " * 20_000, "en"), (6, "same text here " * 20, "en"), (6, "same text here " * 20, "en"), (7, "é日本😀 \\ < > <|endoftext|>", None),
    (8, "a b c a b c\na b c a b c\n\n \na b c a b c", "en"), (None, "no id", "en"), (9, "1 2 3 ### $$", "de"), (10, "le chat de la maison " * 30, "fr"),
]


@pytest.fixture(scope="module", params=["given", "odd"])
def folder(request, spark, tmp_path_factory):
    if request.param == "given":
        return SF
    path = tmp_path_factory.mktemp("odd")
    rows = [(k, t, lang, "s", 0) for k, t, lang in ODD]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(4, 0, 0), (5, 1, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


@pytest.fixture(scope="module")
def documents(spark, folder):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def _rows(frame, *columns):
    return sorted(((repr(r["doc_id"]), *(r[c] for c in columns)) for r in frame.collect()), key=repr)


def _sha(x):
    return hashlib.sha256(x).hexdigest()


def test_quality_counts(spark, folder, documents):
    def counts(text):
        text = text or ""
        words = re.findall(WORD, text)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = {w for w in windows if windows.count(w) > 1} if len(windows) < 3_000 else {w for w in set(windows) if len(windows) > len(set(windows))}
        inside = {k + j for k, w in enumerate(windows) if w in often for j in range(3)}
        seen, repeated = set(), 0
        for line in text.split("\n"):
            if re.search(WORD, line):
                repeated += line in seen
                seen.add(line)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(inside)

    got = queries.op5_quality_rules(spark, folder)
    want = []
    for i, text, _ in documents:
        c = counts(text)
        want.append((repr(i), *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert _rows(got, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert not [r for r in got.collect() if r["base_failed"] and r["kept"]]


def test_token_counts(spark, folder, documents):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.no_truncation()
    want = [(repr(i), len((text or "").encode()), n := len(t.encode(text or "", add_special_tokens=False).ids), n > 512) for i, text, _ in documents]
    assert _rows(queries.op6_token_prefix(spark, folder), "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_languages(spark, folder, documents):
    got = queries.op7_language_id(spark, folder).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 4 == 2
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(i) for i, *_ in documents)
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    text = {i: t for i, t, _ in documents}
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in text[r["doc_id"]] or "")) for r in got)
    learned = {lang for i, _, lang in documents if lang and not held(i)}
    assert {r["lang_pred"] for r in got} <= learned | {"und"}
    if folder == SF:
        lang = {i: x for i, _, x in documents}
        judged = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and r["lang_pred"] != "und"]
        assert len(judged) > 20 and np.mean(judged) > 0.9


def test_byte_bpe(spark, folder, documents):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text, _ in documents:
        ids = encoding.encode_ordinary(text or "")
        want.append((repr(i), len(ids), _sha(np.array(ids, dtype="<u4").tobytes()), _sha((text or "").encode())))
    assert _rows(queries.op9_byte_bpe(spark, folder), "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_repeated_bytes(spark, folder, documents):
    places = {}
    raw = [(text or "").encode() for _, text, _ in documents]
    for d, b in enumerate(raw):
        for k in range(len(b) - 199):
            places.setdefault(b[k : k + 200], []).append((d, k))
    gone = [np.zeros(len(b) + 1, dtype=bool) for b in raw]
    for at in places.values():
        if len(at) > 1:
            for d, k in at:
                gone[d][k : k + 200] = True
    want = []
    for (i, *_), b, g in zip(documents, raw, gone):
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~g[:-1]])
        want.append((repr(i), len(b), int(g.sum()), int((np.diff(g.astype(int), prepend=0) > 0).sum()), _sha(kept)))
    assert _rows(queries.op8_repeat_spans(spark, folder), "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


def test_held_out_texts_are_likelier_than_by_base_counts(spark):
    """Where every token is known: base counts give an unknown word one share, whichever it is, so they add up to more than one."""
    held = [r for r in queries.op1_lattice_lm(spark, SF).collect() if r["held_out"]]
    known = [r for r in held if r["n_known"] == r["n_tokens"]]
    assert known and sum(r["score"] for r in known) > sum(r["base_score"] for r in known)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in held)
