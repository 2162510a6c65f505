"""Encoding, search and extraction: against a library or plain Python."""

import random
import time
from collections import defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mediacairn.llm import bpe, html_extract, topk_search, toxicity
from mediacairn.llm.queries import QUERIES

from .conftest import SF
from .test_exact_mixing import fold, plan
from .test_near import brute

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Encoder(bpe.Vocabulary(f.read()), remembered=40)  # forgets often


def assert_like_library(encoder, library, texts):
    ids, decoded = encoder(texts)
    for t, i, d in zip(texts, ids, decoded):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(i, "<u4").tolist() == want, t[:100]
        assert d == library.decode(want, skip_special_tokens=False)


def test_encoding_like_the_library(encoder, library, documents):
    assert_like_library(encoder, library, [r.text for r in documents().collect()])


def test_odd_texts_like_the_library(encoder, library):
    rng = random.Random(5)
    alphabet = "abcdefxyzABZ019 \t\n'\"!?.,-_<>|#éÉßñçüÄ日本語Ωσς́\x00\x1c\x85\xa0​😀"
    texts = ["", " ", "a" * 4000, "ab" * 999, "<|endoftext|>a<|startoftext|><|endoftext|", "x<|ENDOFTEXT|>y", "ΑΣ ΣΑΣ Σ", "İ ſ K ﬁ", "don't I'LL WE'VE it's'd", "́a", "e\x00b"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(600)]
    assert_like_library(encoder, library, texts)


def test_tree_takes_the_leftmost_lowest_pair(encoder):
    v = encoder.v
    rank = {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(r) for p, r in zip(v.pairs, v.ranks)}
    rng = random.Random(6)
    words = ["".join(rng.choice("theandrio") for _ in range(rng.randrange(1, 70))) for _ in range(300)]
    for word, (ids, _) in zip(words, encoder.merger.words([w.encode() for w in words])):
        symbols = [int(v.inner[b]) for b in word.encode()[:-1]] + [int(v.last[word.encode()[-1]])]
        while len(symbols) > 1:
            r, at = min((rank.get(p, 1 << 40), k) for k, p in enumerate(zip(symbols, symbols[1:])))
            if r == 1 << 40:
                break
            symbols[at:at + 2] = [int(v.made[r])]
        assert np.frombuffer(ids, "<u4").tolist() == symbols


def test_long_words_like_the_library(encoder, library):
    rng = random.Random(8)
    texts = ["".join(rng.choice("etaoinshr") for _ in range(32_000)), "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(10_000)),
             "".join(rng.choice("ab") for _ in range(5000)) + " " + "z" * 4097]
    start = time.process_time()
    ids, decoded = encoder(texts)
    assert time.process_time() - start < 3  # 13 s when every merge was a step of arrays
    for text, i, d in zip(texts, ids, decoded):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(i, "<u4").tolist() == want and d == library.decode(want, skip_special_tokens=False)


def test_encode_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op4_bpe"](spark, SF).collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(want) and r.ids_sha256 == sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_encode_odd_rows(docs, odd, library):
    table = docs(*odd, clashing=True)
    got = bpe.encode(table, PATH)
    assert got.select("row.*").columns == table.columns
    for r in got.select("row.text", F.col("ids"), F.col("decoded")).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode(r.text or "", add_special_tokens=False).ids
    assert got.count() == len(odd)


def test_search_against_python(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", 40)
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.0, 0.5, -0.25, 0.7512]) for _ in range(rng.choice([0, 3, 6]))]) for i in range(150)]
    rows += [(200, None), (250, [1.0, None]), (300, [float("nan")]), (350, [float("inf"), 1.0]), (None, [1.0, 1.0]), (50, [0.5, 0.5, 0.5]), (151, [0.5] * 6), (151, [0.5] * 6)]
    table = topk_search.quantised(spark.createDataFrame(rows, "id bigint, vec array<double>"))
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert sorted(map(tuple, table.select("id", F.col("w").cast("string")).collect())) == sorted((i, str(w)) for i, w in good)
    found = defaultdict(list)
    for i, w in good:
        if i % 50 == 0 and i:
            found[i] += [(-sum(a * b for a, b in zip(w, u)), j) for j, u in good if j != i]
    want = sorted((i, r + 1, j, -s) for i, x in found.items() for r, (s, j) in enumerate(sorted(x)[:5]))
    got = topk_search.top_k(table.filter("id % 50 = 0 AND id > 0"), table, 5).collect()
    assert sorted(map(tuple, got)) == want


def test_fewer_candidates_than_k(spark):
    table = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (2, [])], "id bigint, w array<bigint>")
    assert sorted(map(tuple, topk_search.top_k(table.filter("id = 0"), table, 5).collect())) == [(0, 1, 1, 11), (0, 2, 2, 0)]


PROSE = "A sentence of plain prose, with commas, that goes on for a while and says nothing much at all. "

PAGES = {
    "nothing": ("", ""),
    "blank": (" \n ", ""),
    "bare text": ("just &lt;text&gt; &amp; more", "just <text> & more"),
    "article": (f"<body><nav><a href=x>Home</a></nav><header>Site</header><article class='post'><header><h1>Ti&eacute;tle</h1></header><p>{PROSE}<p>Two <b>bo</b>ld\n\t words&nbsp;x.</article><footer>foot</footer>",
                f"Tiétle {PROSE.strip()} Two bold words x."),
    "containers": (f"<div id=wrap><div class='sidebar'><p>{PROSE}</p></div><div class='content with-sidebar'><h2>Head</h2><div><p>{PROSE}</p><p>{PROSE}</p></div><div class='share'>Tell</div>"
                   f"<ul class='comments'><li>{PROSE}</li></ul></div></div>", f"Head {PROSE.strip()} {PROSE.strip()}"),
    "sections": (f"<main><section><p>{PROSE * 2}</p></section><aside>{PROSE}</aside><section><p>{PROSE * 2}</p></section><form>{PROSE}<input></form></main>", " ".join([PROSE.strip()] * 4)),
    "markup": (f"<article><script>if (a<b) '</p>'</script><style>p{{}}</style><!-- <p>no</p> --><p>{PROSE}</p><table><tr><td>1<td>2<tr><td>3</table><br>a<br/>b</article>", f"{PROSE.strip()} 1 2 3 a b"),
    "unclosed": (f"<html><body><div class=ad>buy</div><article><h1>T</h1><p><b>{PROSE}<p>Then<ul><li>one<li>two", f"T {PROSE.strip()} Then one two"),
    "hidden": (f"<article><p>{PROSE}</p><p style='display: none'>x</p><div hidden>y</div><div class='cookie-notice'>z</div><p>{PROSE}</p></article>", " ".join([PROSE.strip()] * 2)),
    "stray ends": (f"</div></p><article></b><p>{PROSE}</span></p></article></article>", PROSE.strip()),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_main_text(name):
    page, want = PAGES[name]
    assert html_extract.main_text(page) == want


KEPT = {
    "layout": (f'<body><div class="content-sidebar-wrap"><p>{PROSE}</p></div><div class=sidebar><p>Our shop</p></div></body>', PROSE.strip()),
    "filed": (f'<body><article class="post category-social tag-search"><h1>T</h1><p>{PROSE}</p></article><p>Imprint of the house</p></body>', f"T {PROSE.strip()}"),
    "drawing": (f'<article><svg class="i"/><p>{PROSE}</p><svg viewBox="0"><text>icon</text></svg><math/><p>{PROSE}</p></article>', f"{PROSE.strip()} {PROSE.strip()}"),
    "frame": (f'<article><iframe src=a /><p>{PROSE}</p><iframe src=b>no frames</iframe><script src=x /><p>{PROSE}</p></article>', f"{PROSE.strip()} {PROSE.strip()}"),
    "headline": (f'<div class="header">Site</div><article><div class="header"><h1>Head</h1></div><p>{PROSE}</p></article>', f"Head {PROSE.strip()}"),
    "wrapper": (f'<body><div id="ad-wrapper"><div class="related-posts"><p>More</p></div><div><p>{PROSE}</p><p>{PROSE}</p></div></div></body>', f"{PROSE.strip()} {PROSE.strip()}"),
    "threads": (f'<body><div class="entry-content"><p>{PROSE}</p></div>' + f'<div class="post-comments"><p>{PROSE}</p></div>' * 9 + "</body>", PROSE.strip()),
    "systems": (f'''<body class="single postid-7 content-sidebar"><div id="page" class="hfeed site"><div class="site-header">S</div><div id="primary" class="content-area">
        <main id="main" class="site-main"><article class="post type-post status-publish format-standard category-ads"><header class="entry-header"><h1 class="entry-title">H</h1></header>
        <div class="entry-content"><p>{PROSE}</p><div class="sharedaddy share-buttons"><p>Tell others</p></div></div><footer class="entry-footer">Filed</footer></article>
        <nav class="navigation post-navigation">Next</nav></main></div><div id="secondary" class="widget-area"><p>Blogroll</p></div></div></body>''', f"H {PROSE.strip()}"),
}


@pytest.mark.parametrize("name", list(KEPT))
def test_articles_that_names_must_not_cost(name):
    page, want = KEPT[name]
    assert html_extract.main_text(page) == want


def test_deep_and_long_pages():
    assert html_extract.main_text("<div>" * 20000 + PROSE) == PROSE.strip()
    assert html_extract.main_text(f"<article>{f'<p>{PROSE}</p>' * 5000}</article>") == " ".join([PROSE.strip()] * 5000)


def test_extract_rows(spark):
    table = spark.createDataFrame([(1, None, None, "t"), (1, "u", "<p>x, y</p>", None), (None, "", "", "")], "page_id bigint, url string, html string, text string")
    got = html_extract.extract(table).select("row.*", F.col("text").alias("found")).collect()
    assert {(r.page_id, r.text, r.found) for r in got} == {(1, "t", ""), (1, None, "x, y"), (None, "", "")}


def test_pipeline_against_python(spark, library):
    """Every stage on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), {}
    assert list(stages) == ["toxicity", "exact dedup", "near dedup", "mixing", "bpe"]
    for name, stage in stages.items():
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        kept[name] = rows = docs.collect()
        if name != "bpe":
            assert docs.columns == columns
        if name == "toxicity":
            flagged = toxicity.predict(spark.read.parquet(f"{SF}/documents.parquet"), toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), labels)).filter("toxic")
            assert {r.doc_id for r in rows} == set(before) - {r.doc_id for r in flagged.select("row.doc_id").collect()}
        elif name == "exact dedup":
            largest = {fold(r.text): i for i, r in sorted(before.items())}
            assert sorted(r.doc_id for r in rows) == sorted(largest.values())
        elif name == "near dedup":
            want = brute([(i, r.text) for i, r in before.items()], 5)
            assert sorted(r.doc_id for r in rows) == sorted(i for i, (_, c) in want.items() if c == i)
        elif name == "mixing":
            sizes, words, target = plan([(i, r.text, r.source) for i, r in before.items()])
            copies = defaultdict(int)
            for r in rows:
                assert r == before[r.doc_id]
                copies[r.doc_id] += 1
            for i, s, n in sizes:
                assert copies[i] in (int(target[s] / words[s] + 1e-9), -int(-target[s] // words[s]))
        else:
            assert len(rows) == len(kept["mixing"])
            for r in rows:
                want = library.encode(before[r.doc_id].text, add_special_tokens=False).ids
                assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want and r.n_tokens == len(want)
                assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, kept["bpe"]))
