"""Source divergence, page extraction and whitening against plain versions, and their odd rows."""
import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from arpent.llm import embedding_whitening, html_extract, queries, source_divergence
from arpent.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- source divergence


def _brute_audit(rows, least, top):
    seen, count, groups = collections.defaultdict(collections.Counter), collections.Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        seen[lang].update(set(words))
        count.update((lang, source, w) for w in words)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for w, n in seen[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)

        def shares(ns):
            return [1 + 1000000000 * (n + 2) // (sum(ns) + 2 * len(kept)) for n in ns]

        raw = {s: [count[lang, s, w] for w in kept] for s in sources}
        p = {s: shares(raw[s]) for s in sources}
        q = shares([sum(raw[s][k] for s in sources) for k in range(len(kept))])
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in sources:
            pairs = [(-sum(map(f, p[s], p[t])), t.encode()) for t in sources if t != s]
            terms = [(-f(a, b), w.encode()) for a, b, w, n in zip(p[s], q, kept, raw[s], strict=True) if n and a > b]
            for part, items in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(items), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item.decode(), -value, rank))
    return sorted(out)


ROWS = [
    ("One two TWO é É two", "en", "a"), ("one x1y two-three", "en", "b"), (None, "en", "c"), ("", "en", "c"), ("one two", "en", "a"),
    ("one two", "en", "a"), ("solo", "xx", "only"), (None, None, None), ("null words words", None, "z"), ("words", "", ""), ("日本 one", "en", "é"), ("İ ß ſ K one", "en", "é"),
]


@pytest.mark.parametrize("least", [1, 2, 4, 100])
def test_audit_like_brute_force(spark, least):
    docs = spark.createDataFrame([(k, *r, 0) for k, r in enumerate(ROWS)], DOCS)
    for c in ("term", "item", "value", "rank", "block", "p", "n", "docs", "total"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = source_divergence.audit(docs, min_docs=least, top=3, blocks=5)
    assert sorted(map(tuple, got.collect())) == _brute_audit(ROWS, least, 3)


def test_audit_of_long_texts_and_nothing(spark):
    rows = [("word " * 50_000 + f"w{k}", "en", "s%d" % (k % 2)) for k in range(12)]
    docs = spark.createDataFrame([(k, *r, 0) for k, r in enumerate(rows)], DOCS)
    assert sorted(map(tuple, source_divergence.audit(docs).collect())) == _brute_audit(rows, 10, 10)
    assert source_divergence.audit(docs.where("false")).count() == 0


# --- pages

HEAD = "<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head>"
PAGES = {
    # the article by its tag; a header in it keeps headings only
    "<body><header><h1>Site</h1></header><nav><a href=/>x</a></nav><article><header><h1>A &amp; B</h1><span>by me</span></header><p>One,<br>two.<p>Three\n  four</article><footer>f</footer>": "A & B\nOne, two.\nThree four",
    # by its score, with a heading and a sibling; comments have more text than it
    "<div id=page><div class=menu><ul><li><a href=1>a</a></ul></div><div class=wrap><h1>Head</h1><div class=x><p>Some words, some more, and more of them.</p><p>More.</p></div>"
    "<div class=y><p>A second part, which is long, too.</p></div></div><h3>See too</h3><div id=comments><p>Me, me, me, and me, and I say so, and so, and so on, and on, and on.</p></div></div>": "Head\nSome words, some more, and more of them.\nMore.\nA second part, which is long, too.",
    # a class on an element around the article does not drop it, one in it does
    "<body class='has-sidebar'><div class='content-sidebar'><main><div><p>Text, of the page, in main.</p><div class='ad'>Buy, buy, buy</div><form><label>mail</label><input></form><p class=cookie-notice>We use cookies</p></div>"
    "<aside>Aside</aside></main></div>": "Text, of the page, in main.",
    # a whole page in a form; scripts that hold tags; unclosed tags; white space
    "<form action=x><div><script>var a='</p><p>no';</script><p>In a form,&nbsp;\t whole <b>bold<p>next <i>one</div><input></form>": "In a form, whole bold\nnext one",
    # list items, quotes, cells; a box of links in the article is left out
    "<article><ul><li>one<li>two <ul><li>deep</ul></ul><blockquote>said</blockquote><table><tr><td>a<td>b</table><ul><li><a href=1>Link one</a><li><a href=2>Link two</a><li><a href=3>Link three</a></ul>tail</article>": "one\ntwo\ndeep\nsaid\na\nb\ntail",
    "<p>Only a paragraph &lt;b&gt; &#233; &eacute &am": "Only a paragraph <b> é é &am",
    "<article><p>kept</p><section id=comments><article class=comment><p>first, reader</p></article></section></article>": "kept",
    # little text beside longer adverts, notices, a sidebar and comments, all by class
    "<div class=content><h2>Short</h2><p>Hi.</p></div><div class=ad-slot>Buy this, and that, and more of it, today, or tomorrow.</div><ins class=adsbygoogle>Buy</ins><div class=site-notice>We, the makers, tell you, at length, of changes.</div>"
    "<div id=sidebar><p>Other, quite long, text, of others.</p></div><section id=reader-comments><p>A long, long, long comment, by a reader, on it all.</p></section>": "Short\nHi.",
    "<div class='layout sidebar-right'><h1>All</h1><p>One.</p><p>Two, and more words.</p></div><div id=site-footer>Foot, foot, foot</div>": "All\nOne.\nTwo, and more words.",
    "<table><tr><td width=20><a href=1>x</a><a href=2>y</a></td><td><p>Old page, in a cell.</p><p>Next.</p></td></tr></table>": "Old page, in a cell.\nNext.",
    "<nav>menu</nav><footer>foot</footer>": "",
    "plain text": "plain text",
    "": "",
    "<": "<",
    "<p": "",
    "<!-- <p>no</p> --><p hidden>no</p><p style='display: none'>no</p><p>yes</p>": "yes",
}


@pytest.mark.parametrize("html", PAGES)
def test_main_text(html):
    assert html_extract.main_text(html) == PAGES[html]
    assert html_extract.main_text(HEAD + html) == PAGES[html]


def test_main_text_of_given_pages(spark):
    """The given pages hold one `article` of `h1` and `p`, cut out here by patterns."""
    import html as h

    found = queries.op12_html_extract(spark, SF).join(table(spark, SF, "pages").select("page_id", "html"), "page_id").collect()
    assert len(found) == table(spark, SF, "pages").count() > 0
    for r in found:
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(h.unescape(re.sub("<[a-z/][^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_pages_keep_rows_and_columns(spark):
    long = "<article>" + "<p>word, " * 30_000 + "</article>"
    rows = [(1, None, None, "k"), (1, None, None, "k"), (None, "u", "", None), (2, "u", long, "x"), (3, "u", "<div>" * 3_000 + "deep" + "<b>" * 3_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, `n chars.` string").withColumn("n_chars", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = html_extract.extract(pages)
    assert got.columns == ["page_id", "url", "n chars.", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got.collect()) == [(0, 0), (1, 0), (1, 0), (2, 30_000 * 6 - 1), (3, 4)]
    assert html_extract.extract(pages.where("false")).count() == 0


# --- whitening


def _check_whitening(rows, got, top=4):
    """`rows` (id, vector) that count, `got` the result; by exact sums and numpy."""
    x = [[int(np.floor(256 * float(c))) for c in v] for _, v in rows]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    centred = np.array([[n * v[j] - sums[j] for j in range(d)] for v in fit], dtype=object)
    cov = ((centred.T @ centred) / n**3).astype(float)
    values, vectors = np.linalg.eigh(cov)
    want = collections.Counter((i, k + 1, n, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))) for (i, _), v in zip(rows, x, strict=True) for k in range(min(top, d)))
    assert collections.Counter((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got) == want
    at = {i: np.array([n * a - s for a, s in zip(v, sums, strict=True)], dtype=float) / n for (i, _), v in zip(rows, x, strict=True)}
    signs = {}
    for r in got:
        e, v = values[-r["component"]], vectors[:, -r["component"]]
        plain = at[r["vec_id"]] @ v / np.sqrt(e)
        if abs(plain) > 1e-3:
            assert signs.setdefault(r["component"], np.sign(plain * r["whitened"])) == np.sign(plain * r["whitened"])
        assert abs(r["whitened"]) == pytest.approx(abs(plain), rel=1e-6, abs=1e-7)
        assert r["explained"] == pytest.approx(e / np.trace(cov), rel=1e-6) and r["identity_error"] < 1e-8


def test_whitening_of_given_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    _check_whitening(rows, queries.op13_embedding_whitening(spark, SF).collect())


def test_whitening_of_odd_vectors(spark):
    random = np.random.default_rng(3)
    good = [(k, [float(c) for c in random.normal(size=3) * scale]) for scale in (1.0, 1e4) for k in range(20)]
    good += [(100 + k, [0.5, -0.0, 1e-9]) for k in range(30)] + [(None, [1.0, 2.0, 3.0])]
    bad = [(7, None), (8, []), (9, [1.0, None, 2.0]), (10, [1.0, float("nan"), 2.0]), (11, [1.0, float("inf"), 2.0]), (12, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in good + bad], "vec_id long, embedding array<double>, x string").withColumn("n", F.lit("clash")).withColumn("component", F.lit(1))
    ids = [(i if i is None else i + 1000 * (k >= 20) * (i < 20), v) for k, (i, v) in enumerate(good)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in ids + bad], frame.select("vec_id", "embedding", "x").schema).repartition(5)
    _check_whitening(ids, embedding_whitening.whiten(frame).collect())
    assert embedding_whitening.whiten(frame.where("false")).count() == 0


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = embedding_whitening.whiten(one).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got) == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [8.0, 2.0])], "vec_id long, embedding array<float>")
    got = embedding_whitening.whiten(flat).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in got) and got[0]["identity_error"] < 1e-12


def test_residues_give_exact_products():
    import pyarrow as pa

    x = np.array([[2**40, -(2**41), 3], [5, -7, 2**42 + 1]], dtype=np.int64)
    moduli = embedding_whitening.primes(4 * 2**86)
    batch = pa.record_batch({"x": pa.array(x.tolist(), pa.list_(pa.int64()))})
    found = collections.defaultdict(dict)
    for out in embedding_whitening.residues(iter([batch]), moduli, 3):
        for p, cell, value in zip(*(c.to_pylist() for c in out.columns), strict=True):
            found[cell][p] = value
    full = np.hstack([np.ones((2, 1), dtype=object), x.astype(object)])
    want = (full.T @ full)[np.triu_indices(4)]
    assert [embedding_whitening.remaindered(found[k], moduli) for k in range(len(want))] == want.tolist()
