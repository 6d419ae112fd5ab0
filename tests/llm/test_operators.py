import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from terrane.llm import bpe, decontam, html, lines, quality, substrings, tokens, toxicity, urls
from tokenizers import Tokenizer

ODD = [None, "", " \n\t ", "Hello,  World!!", "a\x1cb \x85 c\xa0d", "ÉÀ İstanbul ΣΑΣ ß", "x" * 3000, "日本語 текст 123 4567", "don't I'll we've", "<|endoftext|> mid <|startoftext|>", "tab\tand\r\nnew  line  ", "e\u0301 é \u200b z", "😀😀 1️⃣", "a" * 7 + " " * 9 + "b"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens string")


def test_codec_as_the_library(odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    for r in bpe.digests(odd, path).collect():
        ids = library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), ODD[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert r.n_tokens == len(ids)
    texts = dict(map(tuple, bpe.decode(bpe.encode(odd, path), path).collect()))
    assert texts[3] == library.decode(library.encode(ODD[3], add_special_tokens=False).ids, skip_special_tokens=False)


def test_counts_as_the_library(odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in tokens.count_tokens(odd, path).collect():
        text = ODD[r.doc_id] or ""
        assert (r.n_tokens, r.n_bytes) == (len(library.encode(text, add_special_tokens=False).ids), len(text.encode())), text


def test_quality_of_odd_texts_and_ablations(odd):
    rows = quality.ledger(odd)
    assert rows.count() == len(ODD)
    assert rows.where("doc_id = 0").first().n_words == 0
    assert {r.rule: r.n_failed for r in quality.ablations(rows, "base").collect()}["few_words"] == len(ODD)


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.b.COM?x"), (4, "http://x.bad.org/p/q#f"), (5, "http://bad.org"), (6, "http://notbad.org/"), (7, "a://n.net/es/1"), (7, "a://n.net/es/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([("http://bad.org/",), (None,), ("http://bad.org/",)], "url string")
    got = sorted(tuple(r) for r in urls.judge(pages, [("allow", "com/"), ("block", "net/es/")], listed).select("page_id", "host", "path", "rule", "verdict").collect() if r.page_id != 7)
    assert got == [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.b.com", "", None, "allow"), (4, "x.bad.org", "/p/q", None, "block"), (5, "bad.org", "", None, "allow"), (6, "notbad.org", "/", None, "allow")]
    assert urls.judge(pages, [("block", "net/es/")], listed).where("page_id = 7 AND verdict = 'block' AND rule = 'net/es/'").count() == 2
    assert urls.judge(pages.limit(0), [], listed.limit(0)).count() == 0


def test_html():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><div class="cookie-notice">We use</div>
    <main><article><h1>Head</h1><p>One <b>t</b>wo &amp; three<p>Four<br>five<ul><li>a<li>b</ul><script>if (a < b) "</p>"</script><form>Name</form>
    <div class="comments"><p>First!</p></div></article></main><aside>Side</aside><footer>&copy;</footer></body>"""
    assert " ".join(t for _, t, _ in html.Page(page).main()) == "Head One two & three Four five a b"
    assert html.Page("").blocks == [] and [b[1] for b in html.Page("plain < text &am").blocks] == ["plain < text &am"]


def test_style_tree_cuts_what_a_site_repeats(spark):
    rows = [(i, "http://s.org/%d" % i, f"<body><div class=a>Same on all pages</div><div class=b>Text {i} about {i * 7}</div>") for i in range(12)]
    rows += [(50, None, None), (51, "http://one.org/", "<div class=a>Same on all pages</div>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"Text {i} about {i * 7}" for i in range(12)}, 50: "", 51: "Same on all pages"}


def test_decontamination(spark):
    words = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(words[:30])), (2, "Tiny item"), (3, None), (4, "")], "item_id long, text string")
    docs = [(1, "x y " + " ".join(words[:30]).upper() + "! z"), (2, " ".join(words[:27])), (3, " ".join(words[:20])), (4, "a tiny, ITEM here"), (5, None), (6, "")]
    got = {(r.doc_id, r.item_id, r.n_shared) for r in decontam.contained(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1, 26), (2, 1, 23), (4, 2, 1)}
    assert decontam.contained(spark.createDataFrame([], "doc_id long, text string"), items).count() == 0


def test_substrings_of_null_short_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(120))
    rows = [(5, text), (5, text), (2, "pre " + " ".join(f"w{i}" for i in range(30, 90)) + " post"), (7, None), (8, "w1 w2"), (9, text)]
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 120, 60), (2, 62, 0), (7, 0, 0), (8, 2, 0), (9, 120, 120)}


def test_lines(spark):
    rows = [(1, "The same line of text here\nshort"), (2, "The same line of test here\n\nshort\nown"), (3, "The same line of text here!"), (4, None), (5, ""), (6, "shorT")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, removed string")
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup(docs.drop("removed")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\nown", 2), 3: ("", 1), 4: (None, 0), 5: ("", 0), 6: ("shorT", 0)}


def test_toxicity_gradients_and_few_labels(spark):
    r, net = np.random.default_rng(0), toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    index, mask = r.integers(0, 9, (6, 4)), np.ones((6, 4), bool)
    mask[4:, 0] = False
    args = r.integers(0, 100, 9), r.random((9, 256)), index, mask, np.array([0, 1, 1, 0.0])
    grads = net.gradients(*args)[0]
    for k, g in grads.items():
        flat, at = net.p[k].reshape(-1), int(np.argmax(np.abs(np.asarray(g))))
        old, losses = flat[at], []
        for step in (1e-3, -1e-3):
            flat[at] = old + step
            losses.append(net.gradients(*args)[1])
        flat[at] = old
        assert abs((losses[0] - losses[1]) / 2e-3 - np.asarray(g).reshape(-1)[at]) < 1e-4
    docs = spark.createDataFrame([(1, "a b", 0), (2, None, 0), (3, "", 1)], "doc_id long, text string, score int")
    model = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert all(0 <= x.s < 0.5 for x in toxicity.score(docs, model, "s").collect())


def test_toxicity_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).where(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").select("score", "toxic").toPandas()
    good = ((rows.score >= 0.5) == (rows.toxic == 1)).mean()
    assert len(rows) > 30 and good > 0.8 and re.match("float", str(rows.score.dtype))
