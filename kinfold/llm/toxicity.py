"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled documents is learned from (``max_examples``). A term weighs tf times idf, counted over all
documents, times its evidence: the lower end of the interval for the log ratio of its shares in toxic and clean examples,
0 if chance explains the ratio. Every term with evidence is in the vectors; without that factor a few telling words are
lost among hundreds of rarer ones. Examples with equal vectors are one entry. The index keeps postings by term, cut into
blocks of entries with the largest weight of each term in each block; a query visits blocks by falling upper bound and
stops when no block can hold a nearer entry, so the nearest ones are exact; blocks are scored a few at a time. They vote with weights by distance, and the
votes are calibrated by isotonic regression over leave-one-out votes of the sample. The model's size is bounded by its
parameters; every document is scored on its whole text by a task that holds the model, without any shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import sqrt

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import materialize, sliced

TOKEN = re.compile(r"\w+")
BLOCK, FIRST = 32, 16
#: Entries whose votes calibrate the scores.
CALIBRATED = 4000
#: Odd factors that permute 64-bit hashes, one for each min-hash.
MIXES = [np.uint64(xxhash.xxh64_intdigest(bytes([k]), 9) | 1) for k in range(6)]
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, evidence_ids array<long>, evidence_cosines array<double>"


def held_out():
    """Rows whose labels are never learned from: crc32 of the doc_id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms and counts of labelled documents, and min-hashes of their 5-word shingles."""
    for part in sliced(parts):
        terms, counts, least = [], [], []
        for x in part.column(2):
            found = TOKEN.findall((x.as_py() or "").lower())
            count = Counter(found)
            terms.append(list(count))
            counts.append(list(count.values()))
            h = np.array([xxhash.xxh3_64_intdigest(" ".join(found[i : i + 5])) for i in range(max(1, len(found) - 4))], np.uint64)
            least.append([int((h * m).min() >> np.uint64(1)) for m in MIXES])
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64())), pa.array(least, pa.list_(pa.int64()))], ["doc_id", "toxic", "terms", "counts", "least"])


class Words:
    """Finds the terms of a vocabulary in texts."""

    def __init__(self, vocabulary: list[str]):
        self.auto = ahocorasick.Automaton()
        for i, t in enumerate(vocabulary):
            self.auto.add_word(t, (i, len(t)))
        self.auto.make_automaton()
        self.any = bool(vocabulary)

    def vector(self, text: str | None) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Known terms of a whole text, as whole words of its lower case, and their counts."""
        low, count = (text or "").lower(), Counter()
        inner = lambda c: c.isalnum() or c == "_"
        if self.any:
            for last, (i, n) in self.auto.iter(low):
                at = last + 1 - n
                if not (at and inner(low[at - 1])) and not (last + 1 < len(low) and inner(low[last + 1])):
                    count[i] += 1
        pairs = sorted(count.items())
        return tuple(i for i, _ in pairs), tuple(c for _, c in pairs)


@dataclass
class Model:
    """The fitted index; ``score`` is deterministic and keeps no state but a cache."""

    vocabulary: list[str]
    idf: np.ndarray  # times the evidence
    entries: list[tuple[tuple[int, ...], tuple[int, ...]]]  # distinct vectors: term numbers, counts
    votes: np.ndarray  # per entry: toxic, clean examples
    example: np.ndarray  # per entry: smallest doc_id
    prior: float  # of documents without a term
    k: int = 25
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))  # calibration: raw score from, calibrated score
    cache: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        n, terms = len(self.entries), len(self.vocabulary)
        self.blocks = -(-n // BLOCK)
        size = np.array([len(e[0]) for e in self.entries], np.int64)
        term = np.array([t for e in self.entries for t in e[0]], np.int64)
        weight = np.concatenate([self.weights(*e) for e in self.entries]) if n else np.zeros(0)
        entry = np.repeat(np.arange(n), size)
        order = np.argsort(term, kind="stable")  # postings by term, entries ascending
        self.ids, self.w = entry[order], weight[order]
        cell = term[order] * self.blocks + self.ids // BLOCK
        self.cuts = np.searchsorted(cell, np.arange(terms * self.blocks + 1)).astype(np.int32)  # postings of each term and block
        self.block_max = np.zeros(terms * self.blocks)
        np.maximum.at(self.block_max, cell, self.w)
        self.block_max = self.block_max.reshape(terms, self.blocks)
        self.words = Words(self.vocabulary)

    def state(self) -> tuple:
        """What a worker needs to build the model again."""
        return self.vocabulary, self.idf, self.entries, self.votes, self.example, self.prior, self.k, self.steps

    def vector(self, text: str | None) -> tuple[tuple[int, ...], tuple[int, ...]]:
        return self.words.vector(text)

    def weights(self, terms: tuple[int, ...], counts: tuple[int, ...]) -> np.ndarray:
        w = (1 + np.log(np.array(counts, float))) * self.idf[list(terms)]
        return w / sqrt(float(w @ w))

    def nearest(self, terms: tuple[int, ...], counts: tuple[int, ...], skip: int = -1) -> list[tuple[float, int]]:
        """The k entries of largest cosine, ties by number: exact."""
        q, t = self.weights(terms, counts), np.array(terms)
        bound = q @ self.block_max[t]
        live = np.flatnonzero(bound > 0)
        live = live[np.argsort(-bound[live], kind="stable")]
        score, ids = np.zeros(0), np.zeros(0, np.int64)
        for some in (live[:FIRST], live[FIRST:]):
            if len(score) >= self.k:  # blocks that may hold a nearer entry than the last one found
                some = some[: np.searchsorted(-bound[some], 1e-9 - score[self.k - 1], "right")]
            if not len(some):
                break
            cell = (t[:, None] * self.blocks + some[None]).ravel()
            lo = self.cuts[cell]
            size = self.cuts[cell + 1] - lo
            filled = np.flatnonzero(size)
            lo, size = lo[filled], size[filled]
            term, block = np.divmod(filled, len(some))
            spot = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
            found = np.bincount(np.repeat(block * BLOCK, size) + self.ids[spot] % BLOCK, np.repeat(q[term], size) * self.w[spot], len(some) * BLOCK)
            if len(found) > 4 * self.k and (floor := np.partition(found, len(found) - 2 * self.k)[len(found) - 2 * self.k]) > 0:
                hit = np.flatnonzero(found >= floor - 1e-9)
            else:
                hit = np.flatnonzero(found > 0)
            number = some[hit // BLOCK] * BLOCK + hit % BLOCK
            keep = number != skip
            score, ids = np.concatenate([score, found[hit][keep]]), np.concatenate([ids, number[keep]])
            best = np.lexsort((ids, -score.round(12)))[: self.k]
            score, ids = score[best], ids[best]
        return list(zip(score.tolist(), ids.tolist()))

    def raw(self, found: list[tuple[float, int]], take_out: int = -1, label: int = 0) -> float:
        up, down = self.prior, 1.0
        for cos, e in found:
            pos, neg = self.votes[e]
            if e == take_out:
                pos, neg = pos - label, neg - (1 - label)
            if pos + neg > 0:
                up += cos * cos * pos / (pos + neg)
                down += cos * cos
        return float(up / down)

    def calibrate(self) -> None:
        """Isotonic regression (pool adjacent violators) of labels on leave-one-out votes of CALIBRATED entries at most,
        evenly over all."""
        points = [(self.prior, self.prior, 1.0)]
        for e in range(0, len(self.entries), -(-len(self.entries) // CALIBRATED) or 1):
            terms, counts = self.entries[e]
            found = self.nearest(terms, counts)
            for label in (0, 1):
                if n := self.votes[e][0 if label else 1]:
                    points.append((self.raw(found, e, label), float(label), float(n)))
        points.sort()
        pools: list[list[float]] = []  # from, sum, weight
        for x, y, w in points:
            pools.append([x, y * w, w])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                _, s, w2 = pools.pop()
                pools[-1][1] += s
                pools[-1][2] += w2
        self.steps = (np.array([p[0] for p in pools]), np.array([(p[1] + 0.5 * self.prior) / (p[2] + 0.5) for p in pools]))
        self.cache.clear()

    def score(self, terms: tuple[int, ...], counts: tuple[int, ...]) -> tuple[float, list[int], list[float]]:
        if not terms:
            return self.prior, [], []
        key = (terms, counts)
        if (got := self.cache.get(key)) is None:
            found = self.nearest(terms, counts)
            raw = self.raw(found)
            at = int(np.searchsorted(self.steps[0], raw, "right")) - 1
            final = float(self.steps[1][max(at, 0)]) if len(self.steps[0]) else raw
            got = (min(1.0, max(0.0, final)), [int(self.example[e]) for _, e in found[:3]], [c for c, _ in found[:3]])
            if len(self.cache) < 100_000:
                self.cache[key] = got
        return got


def _without_copies(rows: list[tuple[int, int, tuple[int, ...]]]) -> list[tuple[int, int]]:
    """(doc_id, toxic) of the rows (doc_id, toxic, min-hashes) that don't share two or more min-hashes with an earlier one."""
    holders: dict[tuple[int, int], list[int]] = {}
    kept = []
    for at, (doc_id, toxic, least) in enumerate(rows):
        marks = list(enumerate(least))
        met = Counter(x for m in marks for x in holders.get(m, ()))
        if not met or max(met.values()) < 2:
            kept.append((doc_id, toxic))
            for m in marks:  # a copy adds nothing: its first row stands for it
                holders.setdefault(m, []).append(at)
    return kept


def document_counts(docs: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """How many of all documents hold each term, and how many documents there are. Every task counts its own; what
    meets is one number for each term and task."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, total = Words(shared.value), np.zeros(len(shared.value), np.int64), 0
        for part in sliced(parts):
            for x in part.column(0):
                n[list(words.vector(x.as_py())[0])] += 1
            total += part.num_rows
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(n[held], total))], ["term", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = np.zeros(len(vocabulary) + 1, np.int64)  # the last one is the number of documents
    for r in counted.collect():
        found[r["term"]] = r["n"]
    return found[:-1], int(found[-1])


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 20_000, chance: float = 3.0, seed: int = 42) -> Model:
    """Learn from at most ``max_examples`` labelled documents (smallest hash of the id) that aren't held out, one text for
    each id. A term's evidence is its log ratio less ``chance`` standard errors, counted without near copies (two or more
    of six min-hashes equal). A term with evidence is in several examples, so what reaches the driver is bounded by the
    sample. Labels that are null or neither 0 nor 1, and ids without a document, are left out; no labels give a model that
    calls nothing toxic."""
    usable = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_examples)
    chosen = materialize(chosen)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "toxic", "text")
    sample = materialize(texts.mapInArrow(_features, "doc_id long, toxic int, terms array<string>, counts array<long>, least array<long>"))
    kept = _without_copies(sorted((r[0], r[1], tuple(r[2])) for r in sample.select("doc_id", "toxic", "least").collect()))
    n1 = sum(t for _, t in kept)
    n0 = len(kept) - n1
    spark = docs.sparkSession
    only = spark.createDataFrame([(d,) for d, _ in kept], "doc_id long")
    counted = sample.join(F.broadcast(only), "doc_id").select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    a, b = F.col("a").cast("double"), (F.col("n") - F.col("a")).cast("double")
    ratio = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    evidence = ratio - chance * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    known = sorted((r["term"], r["evidence"]) for r in counted.withColumn("evidence", evidence).where("evidence > 0").select("term", "evidence").collect())
    vocabulary = [t for t, _ in known]
    number = {t: i for i, t in enumerate(vocabulary)}
    df, total = document_counts(docs, vocabulary)
    idf = (np.log((1 + total) / (1 + df)) + 1) * np.array([e for _, e in known], float)
    wanted = spark.createDataFrame([(t,) for t in vocabulary], "term string")
    pairs = sample.select("doc_id", "toxic", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("doc_id", "toxic", F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    held = pairs.join(F.broadcast(wanted), "term").groupBy("doc_id").agg(F.collect_list(F.struct("term", "n")).alias("p"))
    groups: dict[tuple, list] = {}
    blank = [0, 0]
    for doc_id, toxic, found in sorted((r[0], r[1], r[2]) for r in sample.select("doc_id", "toxic").join(held, "doc_id", "left").select("doc_id", "toxic", F.coalesce("p", F.array().cast("array<struct<term:string,n:bigint>>"))).collect()):
        if not found:
            blank[1 - toxic] += 1
            continue
        vector = sorted((number[x[0]], x[1]) for x in found)
        entry = groups.setdefault((tuple(t for t, _ in vector), tuple(c for _, c in vector)), [0, 0, doc_id])
        entry[1 - toxic] += 1
    order = sorted(groups)  # entries with the same leading terms stand together, which sharpens block maxima
    votes = np.array([groups[g][:2] for g in order], float).reshape(-1, 2)
    model = Model(vocabulary, idf, order, votes, np.array([groups[g][2] for g in order], np.int64), (blank[0] + 0.5) / (sum(blank) + 2))
    model.calibrate()
    return model


def score_documents(docs: DataFrame, labels: DataFrame, max_examples: int = 20_000) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): doc_id, held_out, score, predicted, and the nearest examples
    as evidence. Only the text is scored. Null and empty texts, and texts without a known term, get the share of toxic
    examples among such. Null ids count as held out; repeated rows stay; empty tables work; extra columns are ignored."""
    return score_with(docs, fit(docs, labels, max_examples))


def score_with(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of ``docs`` by a fitted model, as :func:`score_documents` returns them."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for part in sliced(parts):
            got = [m.score(*m.vector(x.as_py())) for x in part.column(2)]
            score = [g[0] for g in got]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(score), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))],
                ["doc_id", "held_out", "score", "predicted", "evidence_ids", "evidence_cosines"],
            )

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, labels: DataFrame, max_examples: int = 20_000) -> DataFrame:
    """``docs`` without the documents that the scores reject: rows and columns stay as they are, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_examples).state())
    at = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for part in sliced(parts):
            keep = [m.score(*m.vector(x.as_py()))[0] < 0.5 for x in part.column(at)]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
