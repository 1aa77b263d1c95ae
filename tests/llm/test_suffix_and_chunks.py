import hashlib
import random
from collections import Counter

import pytest

from kinfold.llm.chunkdedup import LONGEST, MIN_RUN, SHORTEST, chunk_dedup, chunk_ends
from kinfold.llm.suffixdedup import PASSAGE, anchors, merge_spans, remove_repeats, suffix_dedup

from .helpers import documents, odd_docs


LENGTH = 400


def brute(texts, n=LENGTH):
    seen = Counter(hash(t[i : i + n]) for t in texts for i in range(len(t) - n + 1))
    return [merge_spans([(i, i + n) for i in range(len(t) - n + 1) if seen[hash(t[i : i + n])] > 1]) for t in texts]


def outcome(data, spans, short):
    edges = [0, *(x for s in spans for x in s), len(data)]
    rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), sum(b - a for a, b in short)


def outcomes(raw):
    return [outcome(*x) for x in zip(raw, brute(raw), brute(raw, PASSAGE))]


def listed(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_repeated) for r in rows.collect()}


def made(seed):
    """Texts of few letters, runs of one byte, periods, shared passages at their ends, and equal texts."""
    rnd = random.Random(seed)
    letters = rnd.choice(["ab", "abcdefgh ", "a", "xyz\n é"])
    word = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    passages = [word(rnd.randint(380, 1500)) for _ in range(3)] + ["x" * rnd.randint(398, 420), "ab" * rnd.randint(195, 300), "x" * 400]
    passages += [word(rnd.randint(190, 250)), "y" * rnd.randint(200, 380) + word(300), "x" * 208]
    parts = lambda: rnd.choice([word(rnd.randint(0, 300)), rnd.choice(passages), rnd.choice(passages)[rnd.randint(0, 50) :]])
    texts = ["".join(parts() for _ in range(rnd.randint(1, 5))) for _ in range(16)]
    return texts + texts[:2]


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("bucket_rows", [20_000, 3])
def test_removed_bytes_equal_brute_force(spark, seed, bucket_rows):
    texts = made(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert listed(suffix_dedup(df, bucket_rows=bucket_rows)) == dict(enumerate(outcomes([t.encode() for t in texts])))


def test_documents_equal_brute_force(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    raw = [r.text.encode() for r in rows]
    assert listed(suffix_dedup(docs)) == {r.doc_id: o for r, o in zip(rows, outcomes(raw))}


@pytest.mark.parametrize("length", [96, 208, 400])
def test_stage_cuts_repeats_of_any_length(spark, length):
    texts = sorted(set(made(11)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in remove_repeats(df, length).collect()}
    raw = [t.encode() for t in texts]
    for i, (d, spans) in enumerate(zip(raw, brute(raw, length))):
        edges = [0, *(x for s in spans for x in s), len(d)]
        rest = b"".join(d[a:b] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8", "ignore")
        assert got.get(i, "").strip() == rest.strip() if not rest.strip() else got[i] == rest


def test_passages_of_51_words_go(spark):
    """Copies of a passage between other text lose it all, and clean documents lose nothing."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, kept = [], {}
    for k in range(100):
        passage = text(51 + k % 50)
        for i in (3 * k, 3 * k + 1):
            kept[i] = (text(40), text(30))
            rows.append((i, f"{kept[i][0]} {passage} {kept[i][1]}"))
        kept[3 * k + 2] = (text(90), "")
        rows.append((3 * k + 2, kept[3 * k + 2][0]))
    got = {r.doc_id: r.text for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[i]) <= len(a) + len(b) + 2 for i, (a, b) in kept.items())
    assert all(got[3 * k + 2] == kept[3 * k + 2][0] for k in range(100))


def test_anchors_are_sparse_and_cover_every_window():
    rnd = random.Random(3)
    data = bytes(rnd.randrange(97, 123) for _ in range(30_000))
    for least, most, share in ((208, 400, 0.02), (400, 400, 0.01)):
        pos, _, _ = anchors(data, least, most)
        assert len(pos) < share * len(data) and max(b - a for a, b in zip(pos, pos[1:])) <= least
        assert anchors(b"x" * 5000, least, most)[2] == [(0, 5000)] and len(anchors(b"x" * 5000, least, most)[0]) < 8
    long = b"ab" + b"x" * (1 << 19) + b"cd" * 300
    assert anchors(long, 208, 400)[2] == [(2, 2 + (1 << 19))]


def test_odd_rows(spark):
    got = suffix_dedup(odd_docs(spark)).collect()
    assert len(got) == 13 and sum(r.n_bytes == 0 for r in got) == 4
    assert {r.doc_id for r in got if r.n_removed == r.n_bytes > 0} == {1, 2, 6}
    assert suffix_dedup(odd_docs(spark).limit(0)).count() == 0
    cut = remove_repeats(odd_docs(spark))
    assert cut.columns == odd_docs(spark).columns
    rows = cut.collect()
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None) and sum(r.text is None for r in rows) == 3
    assert not {1, 2, 6} & {r.doc_id for r in rows} and {3, 4, 5, 7, 8} <= {r.doc_id for r in rows}


def test_chunks_tile_the_text_and_fall_in_step_again():
    rnd = random.Random(9)
    data = bytes(rnd.randrange(97, 123) for _ in range(20_000))
    ends = chunk_ends(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and all(SHORTEST <= s <= LONGEST for s in sizes[:-1]) and 35 < sum(sizes) / len(sizes) < 60
    moved = b"inserted bytes" + data
    cut = lambda d, e: {d[a:b] for a, b in zip([0, *e], e)}
    assert len(cut(data, ends) & cut(moved, chunk_ends(moved))) > 0.97 * len(ends)
    assert chunk_ends(b"") == [] and chunk_ends(b"abc") == [3] and chunk_ends(b"a" * 2000)[-1] == 2000


def test_chunk_dedup_catches_passages_and_leaves_the_rest(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(90)
    rows = [(i, f"{text(80)} {passage} {text(70)}" if i < 6 else text(200)) for i in range(20)] + [(30, "short copy"), (31, "short copy")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in chunk_dedup(df).collect()}
    size = len(passage)
    assert got[0].n_removed == 0 and 0.4 * size < got[0].n_repeated <= size
    assert all(0.6 * size < got[i].n_removed <= size for i in range(1, 6))
    assert all(got[i].n_removed == got[i].n_repeated == 0 for i in range(6, 20))
    assert got[30].n_removed == 0 and got[31].n_removed == 10 and got[31].kept_text == ""
    for r in got.values():
        assert len(r.kept_text.encode()) == r.n_bytes - r.n_removed and hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("min_run", [MIN_RUN, 1])
def test_chunk_dedup_equals_plain_python(spark, min_run):
    docs = documents(spark)
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    where = {}
    for i, t in texts.items():
        e = chunk_ends(t)
        for a, b in zip([0, *e], e):
            where.setdefault(t[a:b], []).append((i, a))
    for r in chunk_dedup(docs, min_run).collect():
        t, e = texts[r.doc_id], chunk_ends(texts[r.doc_id])
        runs, last = [], -1
        for a, b in zip([0, *e], e):
            if len(where[t[a:b]]) > 1:
                runs = runs if last == a else [*runs, []]
                runs[-1].append((a, b))
                last = b
        again = [c for run in runs if run[-1][1] - run[0][0] >= min(min_run, len(t)) for c in run]
        gone = [(a, b) for a, b in again if min(where[t[a:b]]) != (r.doc_id, a)]
        assert (r.n_bytes, r.n_repeated, r.n_removed) == (len(t), sum(b - a for a, b in again), sum(b - a for a, b in gone))


def test_hot_chunks_and_batches_give_the_same(spark, monkeypatch):
    import pyarrow as pa

    import kinfold.llm.chunkdedup as cd

    docs = documents(spark).unionByName(documents(spark).limit(50)).unionByName(odd_docs(spark).select(*documents(spark).columns))
    order = lambda df: sorted(map(str, df.collect()))
    want = order(chunk_dedup(docs))
    monkeypatch.setattr(cd, "SAMPLED", 1)
    monkeypatch.setattr(cd, "HOT", 10**9)  # every chunk with more than 20 rows is hot
    assert order(chunk_dedup(docs)) == want
    rnd = random.Random(4)
    rows = sorted(((rnd.randrange(5), 0, rnd.choice([None, 1, 2, 3]), k, k, k, 1, rnd.random() < 0.2) for k in range(200)), key=lambda r: (r[0], r[2] is None, r[2] or 0))
    names = ["h1", "h2", "doc_id", "k1", "k2", "start", "size", "again", "hot", "first"]
    columns = [pa.array([r[i] for r in rows], pa.bool_() if i == 7 else pa.int64()) for i in range(8)]
    whole = pa.RecordBatch.from_arrays([*columns, pa.nulls(200, pa.bool_()), pa.nulls(200, pa.int64())], names)
    every = [x for b in cd._repeats(iter([whole])) for x in b.to_pylist()]
    for n in (1, 3, 50):
        assert [x for b in cd._repeats(whole.slice(a, n) for a in range(0, 200, n)) for x in b.to_pylist()] == every
    lead = {h: next(r[2] for r in rows if r[0] == h) for h in range(5)}
    assert [(r[3], r[7] or r[2] != lead[r[0]]) for r in rows] == [(x["k1"], x["gone"]) for x in every]


def test_odd_chunk_rows(spark):
    got = chunk_dedup(odd_docs(spark)).collect()
    assert len(got) == 13 and sum(r.n_bytes == 0 and r.n_removed == 0 for r in got) == 4
    assert next(r for r in got if r.doc_id == 2).n_removed > 0 and all(r.n_removed < r.n_bytes for r in got if r.doc_id == 6)
    assert chunk_dedup(odd_docs(spark).limit(0)).count() == 0


def test_chunk_dedup_finds_passages_of_50_to_100_words(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for k in range(300):
        passage = text(51 + k % 50)
        rows += [(2 * k, f"{text(40)} {passage} {text(40)}"), (2 * k + 1, f"{text(60)} {passage} {text(30)}")]
    got = {r.doc_id: r.n_removed for r in chunk_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[2 * k + 1] > 0 for k in range(300))
    assert found >= 297 and not any(got[2 * k] for k in range(300)), found
