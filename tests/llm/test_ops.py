import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from arpent.llm import byte_bpe, chat_format, common, decontaminate, language_id, lattice_lm, line_templates, near_jaccard, quality_rules, queries, repeat_spans, simhash_cover, token_prefix
from arpent.llm.common import table
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en"):
    return spark.createDataFrame([(k, t, lang, None, 0) for k, t in enumerate(texts)], SCHEMA)


ODD = [None, "", " \t\n", "x", "a" * 30_000, "same text here", "same text here", "é日本😀 \\ < > <|endoftext|>", "1 2 3\n\n1 2 3"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), connect(SF).sql(queries.ORACLES[name]))


def _results(spark, docs):
    path = P.path("byte_bpe_50k.tiktoken")
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    return {
        "lattice": lattice_lm.score(docs, P.path("piece_bpe_32k.model")),
        "lines": line_templates.drop_recurring(docs),
        "simhash": simhash_cover.near_duplicates(docs),
        "keep_one": simhash_cover.keep_one(docs),
        "quality": quality_rules.judge(docs, labels),
        "prefix": token_prefix.token_budget(docs, P.path("byte_bpe_50k.json"), P.PATTERN),
        "language": language_id.predict(docs, language_id.fit(docs)),
        "repeats": repeat_spans.report(docs),
        "bpe": byte_bpe.round_trip(docs, path, P.PATTERN),
        "bench": decontaminate.report(docs, bench),
        "clean": decontaminate.keep_clean(docs, bench),
        "good": quality_rules.keep_good(docs, labels),
        "near": near_jaccard.keep_one(docs),
        "reduced": line_templates.drop_recurring(docs, counts=False),
    }


def test_only_results_stay_in_the_shared_folder(spark, tmp_path, monkeypatch):
    for module in (common, repeat_spans):
        monkeypatch.setattr(module, "shared_dir", lambda _: f"file://{tmp_path}")
    docs, tables = documents(spark, ["same text " * 30, "same text " * 30, None]), len(spark.catalog.listTables())
    outs = (repeat_spans.report(docs), simhash_cover.near_duplicates(docs), line_templates.drop_recurring(docs))
    assert [out.count() for out in outs] == [3, 3, 3] and len(list(tmp_path.iterdir())) == 3
    assert len(spark.catalog.listTables()) == tables


def test_the_last_thread_puts_the_setting_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    first, second = common.shuffles_dropped(spark), common.shuffles_dropped(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(key) == "true"
    second.__exit__(None, None, None)
    assert spark.conf.get(key) == before


def test_commonest_languages_are_learned(spark):
    rows = [(k, f"{'le chat' if k % 3 else 'the cat'} {k}", "fr" if k % 3 else "en", None, 0) for k in range(60)] + [(99, "el gato", "es", None, 0)]
    model = language_id.fit(spark.createDataFrame(rows, SCHEMA), max_labels=2)
    assert model.languages == ["en", "fr"]


def test_empty_table_gives_empty_table(spark):
    for name, out in _results(spark, documents(spark, [])).items():
        assert out.count() == 0, name


def test_odd_rows_and_clashing_columns(spark):
    docs = documents(spark, ODD).unionByName(spark.createDataFrame([(None, "no id", None, None, None)], SCHEMA))
    for c in ("key", "k", "text_", "fingerprint", "label", "chunk", "word", "anchor", "_at", "size", "_id", "_hash", "row", "n_lines", "n_dropped", "n_words", "kept", "spans", "repeats"):
        docs = docs.withColumn(c, F.lit("clash"))
    for name, out in _results(spark, docs).items():
        # null, the empty and the blank text are one component, and so are the two copies
        assert out.count() == (len(ODD) + 1 - 3 if name in ("keep_one", "near") else len(ODD) + 1), name
        if name in ("keep_one", "near", "clean", "good", "reduced"):
            assert out.columns == docs.columns, name


def test_lattice_sums_over_all_segmentations():
    pieces, prior, byte_at = lattice_lm.read_pieces(P.path("piece_bpe_32k.model"))
    lattice = lattice_lm.Lattice(pieces, byte_at, prior)
    at = {t: k for k, t in enumerate(pieces) if k not in set(byte_at.tolist())}

    def brute(word):
        text, total = lattice_lm.BORDER + word, 0.0
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            parts, last = [], 0
            for k, c in enumerate(cuts, 1):
                if c:
                    parts.append(text[last:k])
                    last = k
            parts.append(text[last:])
            p = 1.0
            for part in parts:
                w = prior[at[part]] if part in at else 0.0
                if len(part) == 1:
                    w += np.prod(prior[byte_at[list(part.encode())]])
                p *= w
            total += p
        return total

    words = ["the", "hand", "é日x", "aaaa", "q"]
    assert np.allclose(lattice.log_probability(words), np.log([brute(w) for w in words]))
    assert lattice.expected(["hand"], np.ones(1)).sum() > 1


def test_lattice_base_and_score(spark):
    docs = table(spark, SF, "documents")
    got = {r["doc_id"]: r for r in lattice_lm.score(docs, P.path("piece_bpe_32k.model")).collect()}
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    tokens = {r["doc_id"]: [*re.findall(r"[^\x20\x09-\x0D]+", r["text"].translate(low)), None] for r in docs.collect()}
    counts = collections.Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert np.isfinite(got[i]["score"]) and got[i]["score"] < 0


def test_chat_merges_and_reads_back(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", "a<part>"), (1, 3, "assistant", "\\l</turn>\n"), (1, 4, None, None)]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = out.select("n_blocks", "formatted", chat_format.read_back(F.col("formatted")).alias("t"), chat_format.under_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).first()
    assert [tuple(x) for x in r["t"]] == [("user", "a<part>"), ("user", "b"), ("assistant", "\\l</turn>\n"), ("", "")]
    assert r["n_blocks"] == 3 and r["l"] == "\\l</turn>\n"


def test_chat_of_odd_and_long_conversations(spark):
    rng = random.Random(12)
    texts = ["", None, "<", "\\\\<turn x>", "a\n</turn>\n", "é😀", "plain words", "\\l\\g<part>"]
    roles = ["user", "assistant", "assistant", "system>\\", None, ""]
    rows = [(c, rng.choice([None, 1, 2, 3, 4]), rng.choice(roles), rng.choice(texts)) for c in (1, 2, None) for _ in range(12)] + [(9, k, "assistant" if k % 3 else "user", f"t{k}") for k in range(3000)] + [(10, k, "user", "same") for k in range(2000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("b", F.lit("clash")).withColumn("blocks", F.lit(1))
    out = chat_format.format_conversations(frame.repartition(3))
    got = {r["conv_id"]: r for r in out.select("*", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for conv in (1, 2, None, 9, 10):
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [tuple(t) for t in got[conv]["turns"]] == [(r, x) for *_, r, x in mine]
        assert got[conv]["loss"] == "".join(x for *_, r, x in mine if r == "assistant")
        assert got[conv]["n_blocks"] == len(list(itertools.groupby(r for *_, r, _ in mine)))
        assert all(got[conv]["formatted"][a - 1] == ">" and got[conv]["formatted"][a + n] == "<" for a, n in got[conv]["loss_spans"])
    assert chat_format.format_conversations(frame.where("false")).count() == 0


def _brute_templates(texts, depth=3, similarity=0.8, least=10):
    """For each text, the positions of its lines in recurring templates."""
    rows = []
    for d, text in enumerate(texts):
        for at, line in enumerate((text or "").split("\n") if text is not None else []):
            t = ["<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line)]
            if t:
                rows.append((d, at, t))
    count = collections.Counter((len(t), *t[:depth], k, w) for _, _, t in rows for k, w in enumerate(t) if k >= depth)
    holders = collections.defaultdict(set)
    named = []
    for d, at, t in rows:
        found = [count[(len(t), *t[:depth], k, w)] if k >= depth else math.inf for k, w in enumerate(t)]
        enough = sorted(found, reverse=True)[math.ceil(round(similarity * len(t), 6)) - 1]
        name = tuple(w if c >= enough else None for w, c in zip(t, found))
        named.append((d, at, name))
        holders[name].add((d, texts[d]))
    out = [set() for _ in texts]
    for d, at, name in named:
        if len(holders[name]) >= least:
            out[d].add(at)
    return out


def test_templates_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = [f"Copyright {1990 + k} by some name here today\nbody {word()} {word()} {word()}" for k in range(20)]
    # two templates in one leaf, one of them commoner; their variable words have no digit
    texts += [f"Read more on our {word()} page today please\n{word()} own" for _ in range(20)]
    texts += [f"{word()} x\nRead more on the best {word()} right now" for _ in range(25)]
    texts += ["\n".join(f"Listed all the same {word()} items by name" for _ in range(12))]  # recurs in one document only
    texts += ["first line of all\nsecond line of all"] * 12 + [None, "", " \n\t", "1 2 3\n1 2 3"]
    got = {r["doc_id"]: r for r in line_templates.drop_recurring(documents(spark, texts)).collect()}
    want = _brute_templates(texts)
    for k, text in enumerate(texts):
        kept = None if text is None else "\n".join(x for at, x in enumerate(text.split("\n")) if at not in want[k])
        assert (got[k]["text"], got[k]["n_dropped"]) == (kept, len(want[k])), text
    assert all(got[k]["n_dropped"] == 1 for k in range(65)) and not got[65]["n_dropped"]
    whole = {r["doc_id"]: r for r in line_templates.drop_recurring(documents(spark, texts), keep_whole=True).collect()}
    assert all(whole[k]["text"] == texts[k] and whole[k]["n_recurring"] == 2 for k in range(66, 78))
    assert all(whole[k]["n_dropped"] == 1 for k in range(65))


@pytest.mark.parametrize("n", [4, 9, 10, 11, 50])
def test_fields_with_common_values_stay_fields(spark, n):
    """Every pair of n values in two fields: each of the n * n documents has the line, and none keeps it."""
    value = lambda k: "abcdefghijklmnopqrstuvwxyz"[k % 26] * (1 + k // 26)
    texts = [f"posted by user {value(i)} in the section {value(j)} of this site today\nown {value(i)} {value(j)} words" for i in range(n) for j in range(n)]
    texts += [f"posted by user {value(i)} who wrote {value(i)} plain words of prose here" for i in range(5)]  # same leaf, five documents
    got = line_templates.drop_recurring(documents(spark, texts)).collect()
    assert all(r["n_dropped"] == (r["doc_id"] < n * n) for r in got)
    assert all(not r["text"].startswith("posted") for r in got if r["doc_id"] < n * n)


def test_field_with_one_common_value(spark):
    """A value that most lines share is a field like the others, in a leaf with another template."""
    names = ["anna"] * 300 + ["berta"] * 40 + [f"name{'xyz' * k}" for k in range(20)]
    texts = [f"written on monday by {x} for all the readers of this page" for x in names] + [f"written on monday by the editor {'q' * k} about all kinds of things" for k in range(1, 30)]
    got = line_templates.drop_recurring(documents(spark, texts)).collect()
    assert len(got) == len(texts) and all(r["n_dropped"] == 1 for r in got)


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a line that one document holds\nown", "en", None, 0)] * 12
    out = line_templates.drop_recurring(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 12 and all(r["n_recurring"] == 0 for r in out)
    rows = [(k, f"a line that many documents hold\nown {'xyz' * k}", "en", None, 0) for k in range(12)]
    out = line_templates.drop_recurring(spark.createDataFrame(rows + rows[:3] * 2, SCHEMA)).collect()
    assert len(out) == 18 and all(r["n_dropped"] == 1 for r in out)


def test_covering_masks_lose_no_pair():
    masks = simhash_cover.covering_masks(3)
    assert len(masks) == 15
    for bits in itertools.combinations(range(0, 64, 3), 3):
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


@pytest.mark.parametrize("limit", [512, 4])
def test_components_against_brute_force(spark, limit):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    values = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(25)})
    signed = [simhash_cover._signed(v) for v in values]
    found = simhash_cover.connected(simhash_cover.links(spark.createDataFrame([(v,) for v in signed], "value long"), 3, limit))
    got = {r["node"]: r["label"] for r in found.collect()}
    parent = {v: v for v in signed}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert all(got.get(v, v) == find(v) for v in signed)


def test_fingerprint_by_hand():
    assert simhash_cover.fingerprint_of(None) == 0
    import xxhash

    assert simhash_cover.fingerprint_of(b"One TWO") == xxhash.xxh64_intdigest(b"one two", 42)


def test_quality_counts_and_rules():
    got = dict(zip(quality_rules.COUNTS, quality_rules.statistics_of("a b c a b c é#\na b c a b c é#\n \nx".encode())))
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == (15, 17, 2, 1, 14)
    rng = np.random.RandomState(1)
    x = {"a": rng.rand(600), "b": rng.rand(600)}
    bad = (x["a"] > 0.8) & (x["b"] < 0.5)
    rules = quality_rules.learn(x, bad, np.arange(600) % 3 == 0)
    hit = np.zeros(600, dtype=bool)
    for r in rules:
        hit |= quality_rules._covers(r, x, 600)
    assert (hit == bad).mean() > 0.97


def test_prefix_counts_are_the_librarys():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), token_prefix.PrefixCounter(P.path("byte_bpe_50k.json"), P.PATTERN)
    rng = random.Random(2)
    parts = [*"aethse  \n\t'rvl12.,!<|>é日😀 AB", "<|endoftext|>", "   ", "'re", "\n\n\n", " hello"]
    for text in ["".join(rng.choices(parts, k=25)) for _ in range(60)] + ["ab" * 3000]:
        counts = own.prefix_counts(text)
        for n in range(1, len(text) + 1, 1 if len(text) < 500 else 997):
            assert len(library.encode(text[:n], add_special_tokens=False).ids) == counts[n - 1], text[:n]
    assert own.longest_within(np.array([1, 2, 1, 3]), 1) == 3


def test_language_held_out(spark):
    got = queries.op7_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def _brute_repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(t, mark) if not m)
        out.append((len(t), sum(mark), sum(m and not (k and mark[k - 1]) for k, m in enumerate(mark)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [256, 2, 1])
def test_repeats_against_brute_force(spark, hot):
    texts = [r["text"] for r in table(spark, SF, "documents").orderBy("doc_id").limit(60).collect()] + ["a" * 7000, "b" + "a" * 900, "ab" * 150 + "q" * 9 + "ab" * 120, None, ""]
    got = {r[0]: tuple(r)[1:] for r in repeat_spans.report(documents(spark, texts), hot=hot).collect()}
    for k, want in enumerate(_brute_repeats([(t or "").encode() for t in texts], 200)):
        assert got[k] == want, k


@pytest.mark.parametrize("hot, rows", [(1024, 10_000), (2, 10_000), (1, 3)])
def test_keeping_the_first_repeat(spark, hot, rows):
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choices("abcdefghij", k=n))
    passage = noise(300)
    texts = [noise(100) + passage + noise(50), noise(40) + passage, noise(30) + passage + noise(10), passage]
    seen, want = set(), {}
    for k, t in enumerate(texts):
        gone = set()
        for i in range(len(t) - 199):
            if t[i : i + 200] in seen:
                gone |= set(range(i, i + 200))
            seen.add(t[i : i + 200])
        want[k] = len(gone)
    assert want[0] == 0 and want[3] == 300
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)  # classes go across batches too
    try:
        got = {r["doc_id"]: r["n_removed"] for r in repeat_spans.report(documents(spark, texts), keep="first", hot=hot).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_previous_factors():
    rng = random.Random(3)
    for depth in (1, 3, 8, 13, 20):
        for _ in range(20):
            d = bytes(rng.choices(b"ab", k=rng.randint(0, 60)))
            place = np.array(rng.sample(range(100), max(0, len(d) - depth + 1)), dtype=np.int64)
            cut = [d[i : i + depth] for i in range(len(place))]
            rank = repeat_spans.suffix_ranks(np.frombuffer(d, dtype=np.uint8), depth)
            assert rank.tolist() == [sorted(set(cut)).index(x) for x in cut]
            later, source = repeat_spans.previous_factors(rank, place)
            assert sorted(later.tolist()) == [i for i, x in enumerate(cut) if any(x == y and place[j] < place[i] for j, y in enumerate(cut))]
            assert all(cut[i] == cut[j] and place[j] < place[i] for i, j in zip(later, source))


def test_periodic_bytes_have_few_anchors():
    for period in (1, 8, 100):
        text = bytes(range(97, 97 + 20)) * 5
        text = (text[:period] * (1_000_000 // period))[: 1_000_000 - 7]
        h, first, last, _ = repeat_spans.anchors_of(text, 200)
        assert len(h) < 40_000 and first[0] == 0 and last[-1] == len(text) - 200 and (first[1:] == last[:-1] + 1).all()
        many = repeat_spans.anchors_of_many([text[:5000], text[:5000]], 200)
        assert len(many[0]) < 600


def test_bpe_is_tiktokens_and_decodes():
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    own = byte_bpe.ByteBpe(path, P.PATTERN)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: k for k, t in enumerate(own.tokens)}, special_tokens={})
    for text in [t or "" for t in ODD] + ["a\u00a0b\u2003c\u0085d \r\n x", "don't  we'll"]:
        ids = own.encode([text])[0]
        assert ids == other.encode_ordinary(text) and own.decode(ids) == text
    ids, spans = own.encode_with_offsets(["x😀"])[0]
    assert own.decode(ids[:-1]).endswith("�") and spans[-1] == (1, 2)


def test_overlaps_tolerate_substitutions(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    words = item.split()
    words[6], words[13] = "WRONG", "Other"
    filler = " ".join(f"w{k}" for k in range(40))
    docs = documents(spark, [f"{filler} {' '.join(words).title()}, {filler}", filler, " ".join(item.split()[:6]), "Tiny Item"])
    bench = spark.createDataFrame([(5, item), (6, "tiny item"), (7, None)], "item_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in decontaminate.report(docs, bench).collect()}
    assert got == {0: (True, "5"), 1: (False, ""), 2: (False, ""), 3: (True, "6")}
    split = {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in decontaminate.report(docs, bench, block_bytes=20).collect()}
    assert split == got


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    ids = {r["doc_id"] for r in out.collect()}
    bench = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    assert ids and ids <= set(docs)
    assert not [i for i in ids if any(b in docs[i] for b in bench)]
    texts = [docs[i] for i in ids]
    assert len(texts) == len(set(texts))
