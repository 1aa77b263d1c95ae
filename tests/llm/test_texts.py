"""Pages, toxicity, tokens and the pipeline."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

import kinfold.llm.piecebpe as pb
from kinfold.llm.htmltext import candidates, extract_pages, main_text, parse
from kinfold.llm.piecebpe import PieceBPE, token_digests
from kinfold.llm.queries import model_path
from kinfold.llm.toxicity import Model, _without_copies, document_counts, drop_toxic, fit, score_documents

from .helpers import documents, odd_docs

# ---- pages -------------------------------------------------------------------------------------------------------


def test_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r for r in pages.collect()}
    for r in extract_pages(pages).collect():
        article = re.search("<article>(.*?)</article>", source[r.page_id].html, re.S)[1]
        want = " ".join(html.unescape(re.sub("</?(p|h1|br)>", " ", re.sub("</?b>", "", article))).split())
        assert (r.text, r.n_chars, r.url) == (want, len(want), source[r.page_id].url)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><h1>A&amp;B</h1><p>one <b>t</b>wo<p>three<br>four</article><footer>no</footer>", "A&B one two three four"),
        ("<body><nav>no</nav><header>no</header><main><p>yes</p><aside>no</aside><form>no<input value='x'></form></main></body>", "yes"),
        ("<article><p>a</p><div class='comments list'><p>no</p></div><section id=\"cookie-notice\">no</section><p>b</p></article>", "a b"),
        ("<article><p>x<script>if (a < b) { '</p>' }</script>y<style>p{}</style>&#233;&nbsp;z<!-- <p>no --></article>", "xyé z"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table><ul><li>a<li>b</ul></article>", "1 2 3 a b"),
        ("<p>unclosed <i>text", "unclosed text"), ("", ""), ("< not a tag & 1 < 2", "< not a tag & 1 < 2"), ("<div role=banner>no</div><div hidden>no</div>kept", "kept"),
        ("<title>no</title><p title='a>b'>yes</p></div></span>", "yes"), ("<article><p>a</p></article><article><p>b</p></article>", "a b"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_templates_go_by_host(spark):
    menu, offer = "<div><span>Our shop</span><p>Terms apply</p></div>", "<table><tr><td>Call us now</td></tr></table>"
    rows = [(i, f"https://one.example/{i}", f"<body>{menu}<p>Text number {i}.</p>{offer}</body>", "x") for i in range(12)]
    rows += [(100 + i, f"https://two.example/{i}", f"<body>{menu if i == 0 else ''}<p>Other {i}</p></body>", "x") for i in range(12)]
    rows += [(200, None, None, "x"), (201, None, "", "x"), (None, "http://one.example/x", "<p>Odd</p>", "x"), (0, rows[0][1], rows[0][2], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in extract_pages(df).collect()]
    assert len(got) == len(rows)
    assert {t for i, t in got if i is not None and i < 12} == {f"Text number {i}." for i in range(12)}
    assert (100, "Our shop Terms apply Other 0") in got and (200, "") in got and (None, "Odd") in got
    assert extract_pages(df.limit(0)).count() == 0


def test_templates_inside_articles_go_and_copied_articles_stay(spark):
    """A neutral share block in every article goes; exact and near copies of one article keep what they share, and so
    does a word in bold that recurs."""
    share = "<div class='x1'>Tell your friends <b>now</b></div>"
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"https://one.example/{i}", f"<main><p>{words(i)}</p>{share}<p>An <b>odd</b> end {i}</p></main>") for i in range(10)]
    rows += [(100 + i, f"https://two.example/{i}", f"<article><p>{words(0)}</p><p>short {i}</p><p>same</p></article>") for i in range(10)]
    rows += [(200 + i, f"https://three.example/{i}", f"<body><div><p>{words(0)}</p></div></body>") for i in range(10)]
    rows += [(300 + i, f"https://four.example/{i}", f"<article><p>{words(i)}</p>{share if i < 2 else ''}</article>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_pages(df).collect()}
    assert all(got[i] == f"{words(i)} An odd end {i}" for i in range(10))
    assert all(got[100 + i] == f"{words(0)} short {i} same" and got[200 + i] == words(0) for i in range(10))
    assert all(got[300 + i] == words(i) + (" Tell your friends now" if i < 2 else "") for i in range(20))


def test_deep_pages_don_t_overflow():
    deep = "<div>" * 30_000 + "deep"
    assert main_text(deep) == "deep" and parse("<b>" * 5000).kids and candidates(parse(deep))[0] == [] and len(candidates(parse("<p>some more text</p>" + deep))[0]) == 30_000


# ---- toxicity ----------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs = documents(spark, "sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    hit = sum(r.predicted and truth[r.doc_id] for r in out)
    assert hit >= 0.8 * sum(truth[r.doc_id] for r in out) and hit >= 0.9 * sum(r.predicted for r in out)
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    sure = [r for r in out if r.score > 0.8]
    assert sum(truth[r.doc_id] for r in sure) >= 0.8 * len(sure)


def test_nearest_examples_equal_brute_force():
    import numpy as np

    rnd = random.Random(1)
    entries = sorted({(tuple(t := sorted(rnd.sample(range(30), rnd.randint(1, 6)))), tuple(rnd.randint(1, 4) for _ in t)) for _ in range(400)})
    m = Model([f"t{i}" for i in range(30)], np.array([1 + rnd.random() * 4 for _ in range(30)]), entries, np.ones((len(entries), 2)), np.arange(len(entries)), 0.1, k=10)
    for terms, counts in entries[::17]:
        q = dict(zip(terms, m.weights(terms, counts)))
        all_scores = [(sum(q.get(t, 0) * w for t, w in zip(e, m.weights(e, c))), i) for i, (e, c) in enumerate(entries)]
        want = sorted((s for s, _ in all_scores if s > 0), reverse=True)[:10]
        assert [s for s, _ in m.nearest(terms, counts)] == pytest.approx(want)


def test_neighbours_of_documents_equal_brute_force(spark):
    """Cosines over dense vectors, idf over all documents, against the index for every document of a table."""
    import numpy as np

    docs, labels = documents(spark, "sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    m = fit(docs, labels)
    texts = [r.text for r in docs.collect()]
    assert m.vocabulary and len(set(m.vocabulary)) == len(m.vocabulary)
    df, n = document_counts(docs, m.vocabulary)
    sets = [set(re.findall(r"\w+", t.lower())) for t in texts]
    assert n == len(texts) and df.tolist() == [sum(v in s for s in sets) for v in m.vocabulary]
    dense = np.zeros((len(m.entries), len(m.vocabulary)))
    for i, (terms, counts) in enumerate(m.entries):
        dense[i, list(terms)] = m.weights(terms, counts)
    for t in texts:
        found = Counter(w for w in re.findall(r"\w+", t.lower()) if w in set(m.vocabulary))
        terms, counts = m.vector(t)
        assert {m.vocabulary[i]: c for i, c in zip(terms, counts)} == found
        if terms:
            q = np.zeros(len(m.vocabulary))
            q[list(terms)] = m.weights(terms, counts)
            want = np.sort((dense @ q)[dense @ q > 0])[::-1][: m.k]
            assert [s for s, _ in m.nearest(terms, counts)] == pytest.approx(want.tolist())


def test_near_copies_and_repeated_ids_count_once(spark):
    assert _without_copies([(1, 1, (1, 2, 3)), (2, 0, (1, 9, 8)), (3, 1, (1, 2, 7)), (4, 1, (5, 6, 7))]) == [(1, 1), (2, 0), (4, 1)]
    docs = spark.createDataFrame([(i // 3, f"foul word number {i}" if i % 2 else "a kind word") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    m = fit(docs, labels)
    assert 0 <= sum(m.votes.ravel()) <= sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200))


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs = spark.createDataFrame([(i, "foul words here" if i % 2 else "kind words here") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, (i % 2) ^ (zlib.crc32(str(i).encode()) % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    flipped = spark.createDataFrame([(i, 0, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    a, b = fit(docs, labels), fit(docs, flipped)
    assert a.vocabulary == b.vocabulary and a.entries == b.entries and (a.votes == b.votes).all()


def test_odd_toxicity_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = score_documents(odd_docs(spark), labels).collect()
    assert len(got) == 13 and not any(r.predicted for r in got)
    assert score_documents(odd_docs(spark), labels.limit(0)).count() == 13 and score_documents(odd_docs(spark).limit(0), labels).count() == 0
    kept = drop_toxic(documents(spark, "sf0.01"), labels)
    assert kept.columns == documents(spark).columns
    bad = {r.doc_id for r in score_documents(documents(spark, "sf0.01"), labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in documents(spark, "sf0.01").collect()} - bad and bad


# ---- tokens ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    return PieceBPE(model_path()), sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.mark.parametrize("text", ["", " ", "  ", "\n", "a", "▁", "▁▁a b", "<s> hi </s> <0x0A> <unk>", "a\x00b", "﻿x", "日本語 😀😀 　 x", "x" * 300, " " * 77 + "q", "é" * 50 + " " * 5 + "\n\n\n  y", "ab" * 20_000, " \U0010ffff", "\r\n\t"])
def test_tokens_equal_the_library(both, text):
    mine, library = both
    ids = library.encode(text)
    assert mine.encode(text) == ids and mine.decode(ids) == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("thisonedarg  ▁\n.,<>0xé中'"), max_size=60))
def test_random_tokens_equal_the_library(both, text):
    mine, library = both
    assert mine.encode(text) == library.encode(text) and mine.decode(library.encode(text)) == library.decode(library.encode(text))


def test_pieces_in_a_row_equal_the_library(both):
    mine, library = both
    rnd, pieces = random.Random(1), sorted(both[0].id_of)
    for _ in range(3000):
        text = "".join(rnd.choice(pieces).replace("▁", " ") for _ in range(rnd.randint(1, 10)))
        assert mine.encode(text) == library.encode(text)


def digests(library, text):
    ids = library.encode(text or "")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))


@pytest.mark.parametrize("text", ["".join(random.Random(4).choice("thisonedarg中é") for _ in range(70_000)), "x" * 40_000, "ab12" * 15_000 + "é"])
def test_long_segments_equal_the_library(both, text):
    assert both[0].encode(text) == both[1].encode(text)


def test_digest_of_decoded_text_follows_the_ids(both):
    mine = PieceBPE(model_path())
    text = "one wrong id shows"
    assert mine.digests(text)[:3] == digests(both[1], text)
    segment = mine.segments(text)[1]
    mine.listed[segment] = ",".join(str(i + 1) for i in mine._encode_segment(segment))
    n, ids, decoded, listed = mine.digests(text)
    assert ids != digests(both[1], text)[1] and decoded == hashlib.sha256(both[1].decode(list(map(int, listed.split(",")))).encode()).hexdigest() != digests(both[1], text)[2]


def test_line_ends_decode_with_the_other_ids(both, monkeypatch):
    """Nearly every text has line ends, which are byte ids: decoding such a text part by part took a third of the time."""
    mine = PieceBPE(model_path())
    monkeypatch.setattr(mine, "tell", lambda listed: pytest.fail("decoded part by part"))
    for text in ("one\ntwo\r\n\n three\x00\t", "\n", " \n ", "\x7f\nb"):
        assert mine.digests(text)[:3] == digests(both[1], text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\x00\x7f\x80éß中😀\u0378\U0010ffff▁"), max_size=40))
def test_bytes_in_a_row_decode_as_in_the_library(both, text):
    assert both[0].digests(text)[:3] == digests(both[1], text)


def test_word_tables_are_bounded(both, monkeypatch):
    import kinfold.llm.piecebpe as pb

    monkeypatch.setattr(pb, "CACHE_WORDS", 50)
    mine = PieceBPE(model_path())
    text = " ".join(f"word{i} {'y' * 200}{i}" for i in range(500))
    assert mine.digests(text)[:3] == digests(both[1], text) and len(mine.listed) + len(mine.old) <= 102
    assert all(len(s) <= pb.CACHE_LETTERS for s in mine.listed)


def test_words_are_kept_once(both, monkeypatch):
    """Two tables of ids by word at most: workers of two cores share an executor's memory with its JVM."""
    monkeypatch.setattr(pb, "CACHE_WORDS", 50)
    mine = PieceBPE(model_path())
    held = lambda: sum(len(x) for k, x in vars(mine).items() if isinstance(x, dict) and k != "known")
    before = held()
    for k in range(300):
        text = f"word{k * 7919} \U0001f98a{k}"
        assert mine.digests(text)[:3] == digests(both[1], text)
    assert held() - before <= 102


def test_token_digests(spark, both):
    for docs in (documents(spark, "sf0.01"), odd_docs(spark)):
        got = token_digests(docs, model_path(), with_ids=True).collect()
        assert sorted(((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got)) == sorted(digests(both[1], r.text) for r in docs.collect())
        assert all(len(r.ids) == r.n_tokens for r in got)
    assert token_digests(odd_docs(spark).limit(0), model_path()).count() == 0


def test_batches_of_texts_are_small(spark):
    import corpus_pipeline as cp

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    wide = spark.range(0, 200, 1, 1).selectExpr("id AS doc_id", "repeat('x', 100000) AS text", "'en' AS lang", "'a' AS source", "100000L AS n_chars")

    def largest():
        def size(parts):
            for p in parts:
                yield p.from_pydict({"n": [p.nbytes]})

        return wide.select("text").mapInArrow(size, "n long").agg({"n": "max"}).first()[0]

    spark.conf.unset(key)
    assert largest() > 15 << 20
    try:
        for name, stage in cp.STAGES:
            if name != "source_mix":
                spark.conf.unset(key)
                stage(spark, wide.limit(2), "/root/testdata/sf0.001")
                assert largest() < 5 << 20, name
        spark.conf.set(key, "1m")
        cp.token_ids(spark, wide, "/root/testdata/sf0.001")
        assert largest() < 2 << 20  # a smaller limit stays
    finally:
        spark.conf.unset(key)


# ---- pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, both):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    out = cp.run(spark, sf).collect()
    assert 0.5 * n < len(out) < 1.5 * n and len(cp.STAGES) == 5
    assert {r.doc_id for r in out} <= set(range(n)) and all(len(r.ids) == r.n_tokens for r in out)
    assert all(both[1].decode(r.ids) is not None and hashlib.sha256(both[1].decode(r.ids).encode()).hexdigest() == r.decoded_sha256 for r in out[:50])
    again = cp.run(spark, sf).collect()
    key = lambda r: (r.doc_id, r.ids_sha256)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_stages_take_odd_rows_and_clashing_names(spark):
    import corpus_pipeline as cp
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    odd = odd_docs(spark)
    odd = odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("ids", "n_tokens", "fp", "shard", "host", "part", "key", "grp", "spans", "toxic", "n"))])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns and 0 < out.count() <= 3 * 13, name
        assert stage(spark, odd.limit(0), sf).count() == 0, name
    last = cp.STAGES[-1][1]
    got = last(spark, odd, sf)
    assert len(set(got.columns)) == len(got.columns) and got.count() == 13 and "text" not in got.columns
    assert {r.n_tokens for r in got.where("size(ids) = 0").collect()} == {0} and last(spark, odd.limit(0), sf).count() == 0
